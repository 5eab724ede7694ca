"""Leading guides and genes per cluster. Ties are always broken by the name, ascending."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from guidescape.operators.counts import cluster_guide_counts, guide_gene_hits


def top_per_cluster(counts: DataFrame, name: str, k: int) -> DataFrame:
    """First ``k`` names of every cluster by count, from an already aggregated table."""
    order = Window.partitionBy("louvain").orderBy(F.desc("n"), name)
    ranked = counts.withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= k).select("louvain", name, "n", "rank")


def top_guides_per_cluster(cells: DataFrame, guide_genes: DataFrame, k: int = 50) -> DataFrame:
    """Guides with associations, by cells in the cluster."""
    known = guide_genes.select("guide").distinct()
    return top_per_cluster(cluster_guide_counts(cells).join(known, "guide", "left_semi"), "guide", k)


def cluster_gene_counts(cells: DataFrame, guide_genes: DataFrame, cluster_genes: DataFrame) -> DataFrame:
    """Rows per (cluster, gene) of the three-way association join, without building the cell-level rows."""
    hits = guide_gene_hits(cluster_guide_counts(cells), guide_genes)
    copies = cluster_genes.groupBy(F.col("cluster").alias("louvain"), "gene").agg(
        F.count(F.lit(1)).alias("_copies")
    )
    return (
        hits.groupBy("louvain", "gene")
        .agg(F.sum("n").alias("n"))
        .join(copies, ["louvain", "gene"])
        .select("louvain", "gene", (F.col("n") * F.col("_copies")).alias("n"))
    )


def top_genes_per_cluster(
    cells: DataFrame, guide_genes: DataFrame, cluster_genes: DataFrame, k: int = 20
) -> DataFrame:
    """Genes associated both with the guide and with the cell's own cluster, by rows."""
    return top_per_cluster(cluster_gene_counts(cells, guide_genes, cluster_genes), "gene", k)


def top_guides_not_in_ref(top: DataFrame, ref: int) -> DataFrame:
    """Top guides of the other clusters that are not among the top guides of cluster ``ref``."""
    reference = top.where(F.col("louvain") == ref).select("guide")
    return top.where(F.col("louvain") != ref).join(reference, "guide", "left_anti").select(
        "louvain", "guide", "n"
    )


def top_guides_total(not_in_ref: DataFrame) -> DataFrame:
    """Counts of each such guide summed over clusters, largest first."""
    totals = not_in_ref.groupBy("guide").agg(F.sum("n").alias("total"))
    return totals.orderBy(F.desc("total"), "guide")


def leaders_in_ref_cluster(cells: DataFrame, totals: DataFrame, ref: int, k: int = 15) -> DataFrame:
    """Cells of cluster ``ref`` for each of the ``k`` leading guides that occur there."""
    leaders = totals.orderBy(F.desc("total"), "guide").limit(k).select("guide")
    counts = cluster_guide_counts(cells.where(F.col("louvain") == ref))
    return counts.join(leaders, "guide", "left_semi").select("guide", "n").orderBy(F.desc("n"), "guide")


def top_guides_between(cells: DataFrame, cluster: int, first: int, last: int) -> DataFrame:
    """Guides of one cluster ranked ``first`` to ``last`` by cells."""
    counts = cluster_guide_counts(cells.where(F.col("louvain") == cluster))
    return top_per_cluster(counts, "guide", last).where(F.col("rank") >= first).select("guide", "n", "rank")
