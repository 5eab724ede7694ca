"""Session helpers shared by the operators: durable lineage cuts and lookups that survive hot keys."""

from __future__ import annotations

import gc
import os
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``.

    Where none is named, a folder below the session's warehouse is taken: executors and driver share the warehouse, but
    not a temporary folder of one machine.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        configured = spark.conf.get("spark.checkpoint.dir", None)
        sc.setCheckpointDir(configured or f"{spark.conf.get('spark.sql.warehouse.dir')}/_checkpoints")
    return sc.getCheckpointDir()


def importable(spark: SparkSession) -> SparkSession:
    """Let Python workers find this package where it lies on the driver's path without being installed."""
    root = str(Path(__file__).resolve().parent.parent)
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in known.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [root, known]))
    return spark


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut lineage through a table written to the checkpoint folder, so a lost executor replays from the written copy.

    A written table also carries its true size: the planner broadcasts it only when it really is small, and size
    estimates do not multiply from round to round of an iteration.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._written_to = path
    return table


def release(*tables: DataFrame) -> None:
    """Delete tables made by ``checkpointed`` that nothing reads any more, such as the last round of an iteration."""
    for table in tables:
        jvm = table.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(table._written_to)
        path.getFileSystem(table.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def discard_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of tables that nothing refers to: it looks for them when the driver's heap is collected."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


# A key that owns more rows than this is split over several tasks.
ROWS_PER_TASK = 2_000_000


def salted_lookup(facts: DataFrame, lookup: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Join many rows to a small dictionary (guides, listed genes) when some keys may be very hot.

    Fact rows of one key are spread by a hash of the whole row and every dictionary row is repeated once per salt, so no
    pass is needed to find the hot keys. The number of salts follows the session's shuffle width.
    """
    width = int(facts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salts = min(256, max(8, width // 4))
    spread = facts.withColumn("_salt", F.pmod(F.xxhash64(*facts.columns), F.lit(salts)).cast("int"))
    repeated = lookup.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return spread.join(repeated, [*on, "_salt"], how).drop("_salt")


def hot_keys(counts: DataFrame, on: list[str], rows: str) -> DataFrame:
    """Keys of a count table that own too many rows for one task, with the number of tasks each needs.

    Every listed key owns more than ``ROWS_PER_TASK`` rows, so the list is at most total rows / ``ROWS_PER_TASK`` long.
    """
    salts = F.ceil(F.col(rows) / ROWS_PER_TASK).cast("int").alias("_salts")
    return counts.where(F.col(rows) > ROWS_PER_TASK).select(*on, salts)


def hot_keys_of(facts: DataFrame, on: list[str]) -> DataFrame:
    """As ``hot_keys``, counting the facts first."""
    return hot_keys(facts.groupBy(*on).agg(F.count(F.lit(1)).alias("_rows")), on, "_rows")


def hot_keys_within(facts: DataFrame, on: list[str]) -> DataFrame | None:
    """As ``hot_keys_of``, written; None for a table so short that no key of it can own too many rows for one task."""
    if facts.count() <= ROWS_PER_TASK:
        return None
    return checkpointed(hot_keys_of(facts, on))


def hot_lookup(facts: DataFrame, lookup: DataFrame, on: list[str], hot: DataFrame | None, how: str = "inner") -> DataFrame:
    """Join facts to a large table, splitting only the keys listed in ``hot`` and repeating only their lookup rows."""
    if hot is None:
        return facts.join(lookup, on, how)
    hot = F.broadcast(hot)
    salts = F.coalesce("_salts", F.lit(1))
    spread = facts.join(hot, on, "left").withColumn(
        "_salt", F.pmod(F.xxhash64(*facts.columns), salts).cast("int")
    )
    repeated = lookup.join(hot, on, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1)))
    return spread.drop("_salts").join(repeated.drop("_salts"), [*on, "_salt"], how).drop("_salt")


def total(df: DataFrame, measure: Column) -> Column:
    """One aggregate over a whole table as a scalar subquery, ready to be used in any expression."""
    return df.agg(measure.alias("_total")).scalar()
