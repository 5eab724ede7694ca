"""Reading and writing the tables of an experiment. Columns are matched by name and typed on the way in."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# The columns of the cell sheet, in file order.
CELL_COLUMNS = {
    "index": "string",
    "guide_cov": "string",
    "louvain": "int",
    "donor_cov": "string",
    "well_cov": "string",
    "numi_cov": "double",
    "multiplet_cov": "string",
    "nsnp_cov": "long",
    "percent_mito": "double",
    "n_counts": "double",
}


def _delimited(spark: SparkSession, path: str, sep: str) -> DataFrame:
    return spark.read.option("header", True).option("sep", sep).option("nullValue", "NA").csv(path)


def read_cells(spark: SparkSession, path: str) -> DataFrame:
    """Cell sheet, CSV or Parquet; ``index`` becomes ``cell_id``."""
    raw = spark.read.parquet(path) if path.rstrip("/").endswith(".parquet") else _delimited(spark, path, ",")
    typed = [F.col(c).cast(t).alias("cell_id" if c == "index" else c) for c, t in CELL_COLUMNS.items()]
    return raw.select(*typed)


def read_guide_genes(spark: SparkSession, path: str) -> DataFrame:
    """Guide–gene associations; the file calls the guide ``cluster`` and may lack ``fdr``."""
    raw = _delimited(spark, path, "\t")
    fdr = F.col("fdr").cast("double") if "fdr" in raw.columns else F.lit(None).cast("double").alias("fdr")
    return raw.select(F.col("cluster").alias("guide"), "gene", fdr)


def read_cluster_genes(spark: SparkSession, path: str) -> DataFrame:
    return _delimited(spark, path, "\t").select(F.col("cluster").cast("int"), "gene")


def read_feature_lists(spark: SparkSession, path: str) -> DataFrame:
    return _delimited(spark, path, "\t").select(F.col("cluster").cast("int"), "enriched", "depleted")


def write_expression(df: DataFrame, path: str) -> None:
    """Matrix rows laid out by cluster, so that reading some clusters touches only their files."""
    df.write.mode("overwrite").partitionBy("louvain").parquet(path)


def read_expression(spark: SparkSession, path: str, clusters: Sequence[int] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df if clusters is None else df.where(F.col("louvain").isin(list(clusters)))


def write_cell_table(df: DataFrame, name: str, path: str, buckets: int) -> None:
    """Rows of cells (the sheet, or the matrix) as a table of the session: cluster folders, buckets of cells inside them.

    The sheet and the matrix, written with the same number of buckets, join on the cell without moving either.
    """
    writer = df.write.mode("overwrite").partitionBy("louvain").bucketBy(buckets, "cell_id").sortBy("cell_id")
    writer.option("path", path).saveAsTable(name)


def read_cells_with_expression(spark: SparkSession, matrix: str, sheet: str, wanted: Column) -> DataFrame:
    """Matrix rows of the cells for which ``wanted``, a condition on the sheet's columns, holds, with those columns.

    Only folders of clusters that hold such cells are read: the sheet's filter prunes them while the query runs. Rows of one
    bucket meet in place.
    """
    cells = spark.table(sheet).where(wanted)
    clusters = cells.select("louvain").distinct()  # a handful of numbers
    values = spark.table(matrix).join(F.broadcast(clusters), "louvain", "left_semi")
    own = [c for c in values.columns if c == "cell_id" or c not in cells.columns]
    return values.select(*own).join(cells, "cell_id")


def export_obs(df: DataFrame, path: str) -> None:
    """Cell sheet back to CSV, under its file column names."""
    named = df.withColumnRenamed("cell_id", "index")
    named.select(*[c for c in CELL_COLUMNS if c in named.columns]).write.mode("overwrite").csv(path, header=True)


def write_result(df: DataFrame, root: str, name: str, day: dt.date | None = None) -> str:
    """Result table to CSV inside a folder named after the day and the analysis; returns the path written."""
    path = f"{root.rstrip('/')}/{(day or dt.date.today()).isoformat()}_{name}"
    df.write.mode("overwrite").csv(path, header=True)
    return path


def snapshot(df: DataFrame, path: str) -> DataFrame:
    """Write an intermediate and carry on from the written copy. A path that ``df`` itself reads from is refused."""
    if any(f"/{path.strip('/')}/" in name for name in df.inputFiles()):
        raise ValueError(f"{path} is read by the table to be written")
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)
