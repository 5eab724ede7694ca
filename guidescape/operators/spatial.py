"""Moran's I of every gene over a neighbour graph."""

from __future__ import annotations

from pyspark.ml.feature import StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, functions as F

from guidescape.functions.tails import normal_upper
from guidescape.operators.enrichment import bh_adjust
from guidescape.runtime import checkpointed, hot_keys_of, hot_lookup, total


def _centred(wide: DataFrame) -> DataFrame:
    vectors = wide.withColumn("_raw", array_to_vector("values"))
    scaler = StandardScaler(inputCol="_raw", outputCol="_centred", withMean=True, withStd=False)
    return scaler.fit(vectors).transform(vectors)


def morans_i(wide: DataFrame, genes: DataFrame, edges: DataFrame) -> DataFrame:
    """Statistic, one-sided p and q per gene under the randomisation variance; ``edges`` are directed and binary.

    ``wide`` has (cell_id, values), ``genes`` (pos, gene). A cell's values travel as one array per edge, and products are
    summed per gene before anything is shuffled.
    """
    links = checkpointed(edges.select("src", "dst").distinct())
    z = _centred(wide).select("cell_id", vector_to_array("_centred").alias("z"))
    n = total(wide, F.count(F.lit(1)))
    s0 = total(links, F.count(F.lit(1)))
    pairs = links.groupBy(F.least("src", "dst"), F.greatest("src", "dst")).agg(F.count(F.lit(1)).alias("c"))
    s1 = total(pairs, F.sum(F.col("c") * F.col("c")))
    ends = links.select(F.col("src").alias("v")).unionByName(links.select(F.col("dst").alias("v")))
    s2 = total(ends.groupBy("v").agg(F.count(F.lit(1)).alias("c")), F.sum(F.col("c") * F.col("c")))

    left = z.select(F.col("cell_id").alias("src"), F.col("z").alias("zi"))
    right = z.select(F.col("cell_id").alias("dst"), F.col("z").alias("zj"))
    crossed = (
        hot_lookup(links, right, ["dst"], hot_keys_of(links, ["dst"]))
        .join(left, "src")
        .select(F.posexplode(F.zip_with("zi", "zj", lambda a, b: a * b)).alias("pos", "zz"))
        .groupBy("pos")
        .agg(F.sum("zz").alias("cross"))
    )
    square = F.col("v") * F.col("v")
    moments = (
        z.select(F.posexplode("z").alias("pos", "v"))
        .groupBy("pos")
        .agg(F.sum(square).alias("z2"), F.sum(square * square).alias("z4"))
    )
    rows = crossed.join(moments, "pos").join(genes, "pos")
    for name, value in (("n", n), ("s0", s0), ("s1", s1), ("s2", s2)):
        rows = rows.withColumn(name, value.cast("double"))
    rows = rows.where(F.col("z2") > 0).selectExpr(
        "gene",
        "n / s0 * cross / z2 as morans_i",
        "-1 / (n - 1) as expected",
        "n * z4 / (z2 * z2) as kurt",
        "n",
        "s0",
        "s1",
        "s2",
    )
    rows = rows.withColumn(
        "variance",
        F.expr(
            "(n * ((n * n - 3 * n + 3) * s1 - n * s2 + 3 * s0 * s0)"
            " - kurt * ((n * n - n) * s1 - 2 * n * s2 + 6 * s0 * s0))"
            " / ((n - 1) * (n - 2) * (n - 3) * s0 * s0) - expected * expected"
        ),
    )
    rows = rows.withColumn("morans_test_statistic", (F.col("morans_i") - F.col("expected")) / F.sqrt("variance"))
    tested = rows.select("gene", "morans_i", "morans_test_statistic").withColumn(
        "pval", normal_upper(F.col("morans_test_statistic"))
    )
    return bh_adjust(checkpointed(tested), "pval")


def top_spatial_genes(table: DataFrame, k: int = 3) -> DataFrame:
    return table.orderBy(F.desc("morans_test_statistic"), "qval", "gene").limit(k)
