"""Counting: cluster sizes, guide totals, hits, shares and coverage.

Everything about guides derives from one small table, cells per (cluster, guide); associations are joined to that table
and never to single cells.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from guidescape.functions.labels import CONTROL, is_wild_type
from guidescape.runtime import total


def _count(df: DataFrame, *keys: str, name: str = "n") -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))


def cluster_sizes(cells: DataFrame) -> DataFrame:
    return _count(cells, "louvain")


def cluster_complement(cells: DataFrame) -> DataFrame:
    """Cells in each cluster and cells outside it."""
    sizes = cluster_sizes(cells)
    return sizes.withColumn("n_hyper", total(sizes, F.sum("n")) - F.col("n"))


def cluster_guide_counts(cells: DataFrame) -> DataFrame:
    return _count(cells, "louvain", "guide")


def guide_gene_hits(counts: DataFrame, guide_genes: DataFrame) -> DataFrame:
    """Rows per (cluster, guide, gene) of cells joined to associations, from (cluster, guide) counts."""
    pairs = _count(guide_genes, "guide", "gene", name="_copies")
    return counts.join(pairs, "guide").select(
        "louvain", "guide", "gene", (F.col("n") * F.col("_copies")).alias("n")
    )


def guide_gene_totals(cells: DataFrame, guide_genes: DataFrame) -> DataFrame:
    """Rows per (guide, gene) of cells joined to associations."""
    pairs = _count(guide_genes, "guide", "gene", name="_copies")
    return guide_frequency(cells).join(pairs, "guide").select(
        "guide", "gene", (F.col("n") * F.col("_copies")).alias("n")
    )


def guide_frequency(cells: DataFrame, *extra: str) -> DataFrame:
    """Cells per guide (and per further columns such as the donor)."""
    return _count(cells, *extra, "guide")


def most_frequent_first(counts: DataFrame, *keys: str) -> DataFrame:
    return counts.orderBy(F.desc("n"), *keys)


def control_share(cells: DataFrame, control: str = CONTROL) -> DataFrame:
    """Share of control cells in every cluster; a cluster without control has share 0."""
    flag = F.when(is_wild_type(F.col("guide"), control), 1.0).otherwise(0.0)
    return cells.groupBy("louvain").agg(F.avg(flag).alias("share"))


def guide_coverage(cells: DataFrame, guide_genes: DataFrame, control: str = CONTROL) -> DataFrame:
    """Distinct cells whose guide has associations, and distinct cells that are not control, over all cells."""
    known = guide_genes.select("guide").distinct().withColumn("_known", F.lit(True))
    marked = cells.select("cell_id", "guide").join(known, "guide", "left")
    per_cell = marked.groupBy("cell_id").agg(
        F.max(F.when(F.col("_known"), 1).otherwise(0)).alias("_covered"),
        F.max(F.when(is_wild_type(F.col("guide"), control), 1).otherwise(0)).alias("_control"),
    )
    return per_cell.agg(
        F.avg("_covered").alias("covered"), (1 - F.avg("_control")).alias("not_control")
    )


def absent_guides(scaffold: DataFrame, cells: DataFrame) -> DataFrame:
    """Guides of the axis that no cell carries."""
    return scaffold.join(cells.select("guide").distinct(), "guide", "left_anti").select("guide")


def guide_share(cells: DataFrame) -> DataFrame:
    """Cells per (cluster, guide) over the cells of the cluster."""
    counts = cluster_guide_counts(cells)
    sizes = counts.groupBy("louvain").agg(F.sum("n").alias("cluster_n"))
    return counts.join(sizes, "louvain").withColumn("normalized", F.col("n") / F.col("cluster_n"))


def genes_per_cluster_guide(pairs: DataFrame) -> DataFrame:
    return _count(pairs, "louvain", "guide")


def rows_per_cluster(pairs: DataFrame) -> DataFrame:
    """Rows, distinct guides and distinct genes per cluster."""
    slim = pairs.groupBy("louvain", "guide", "gene").agg(F.count(F.lit(1)).alias("_n"))
    return slim.groupBy("louvain").agg(
        F.sum("_n").alias("n"),
        F.count_distinct("guide").alias("n_guides"),
        F.count_distinct("gene").alias("n_genes"),
    )


def enriched_cell_count(cells: DataFrame, enriched: DataFrame) -> DataFrame:
    """Cells of every cluster whose guide is in the enriched list of that cluster."""
    listed = enriched.select("louvain", "guide").distinct()
    return cluster_guide_counts(cells).join(listed, ["louvain", "guide"], "left_semi").groupBy("louvain").agg(
        F.sum("n").alias("n")
    )


def wild_type_share(cells: DataFrame, control: str = CONTROL) -> DataFrame:
    """Cells per value of the wild-type flag and their share of all cells."""
    counts = cells.groupBy(is_wild_type(F.col("guide"), control).alias("wt")).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", F.col("n") / total(counts, F.sum("n")))
