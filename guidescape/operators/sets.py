"""Joins between cells and association tables, and set comparison between clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from guidescape.runtime import hot_keys_of, hot_lookup


def supra_join(cells: DataFrame, guide_genes: DataFrame, cluster_genes: DataFrame) -> DataFrame:
    """One row per cell and gene associated with both the cell's guide and the cell's cluster.

    The two small association tables meet first. Each (cluster, guide) then owns one array of genes, so every cell takes
    part in one lookup and a heavy guide is split before its rows are multiplied.
    """
    own = cluster_genes.select(F.col("cluster").alias("louvain"), "gene")
    genes = (
        guide_genes.select("guide", "gene")
        .join(own, "gene")
        .groupBy("louvain", "guide")
        .agg(F.collect_list("gene").alias("_genes"))
    )
    slim = cells.select("cell_id", "louvain", "guide")
    keys = ["louvain", "guide"]
    return hot_lookup(slim, genes, keys, hot_keys_of(slim, keys)).select(
        "cell_id", "louvain", "guide", F.explode("_genes").alias("gene")
    )


def unmatched_guides(cells: DataFrame, guide_genes: DataFrame) -> DataFrame:
    """Guides that cells carry but the association table does not know."""
    return cells.select("guide").distinct().join(guide_genes.select("guide").distinct(), "guide", "left_anti")


def not_shared_feats(df: DataFrame, feat: str) -> DataFrame:
    """Features that occur in exactly one cluster, with that cluster.

    Minimum and maximum cluster agree only for such features: one aggregate with map-side combine and no sets of clusters.
    """
    ends = df.groupBy(feat).agg(F.min("louvain").alias("louvain"), F.max("louvain").alias("_last"))
    return ends.where(F.col("louvain") == F.col("_last")).select("louvain", feat)


def associations_of(guide_genes: DataFrame, guides: DataFrame, cluster: int) -> DataFrame:
    """Association rows of the guides listed for one cluster."""
    listed = guides.where(F.col("louvain") == cluster).select("guide").distinct()
    return guide_genes.join(listed, "guide", "left_semi").select("guide", "gene", "fdr")
