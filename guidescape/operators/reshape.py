"""Comma lists, wide and long forms, and profiles over a complete guide axis."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F


def tidy_feats(lists: DataFrame, kind: str) -> DataFrame:
    """One row per (cluster, feature) of a comma list. Null lists keep one null row, empty pieces vanish."""
    piece = F.explode_outer(F.split(F.col(kind), ","))
    rows = lists.select(F.col("cluster").cast("int").alias("louvain"), piece.alias("guide"))
    return rows.where(F.col("guide").isNull() | (F.col("guide") != ""))


def unique_feats_wide(unique: DataFrame, feat: str, clusters: Sequence[int]) -> DataFrame:
    """One column per cluster, features in name order, padded with null to the longest column."""
    order = Window.partitionBy("louvain").orderBy(feat)
    numbered = unique.withColumn("row", F.row_number().over(order))
    wide = numbered.groupBy("row").pivot("louvain", list(clusters)).agg(F.first(feat))
    return wide.select("row", *[F.col(str(c)).alias(f"cluster_{c}") for c in clusters])


def wide_to_long(wide: DataFrame, clusters: Sequence[int], feat: str) -> DataFrame:
    """Back to (cluster, feature) rows, without the padding, ordered by cluster."""
    columns = [f"cluster_{c}" for c in clusters]
    long = wide.unpivot("row", columns, "_column", feat).dropna(subset=[feat])
    number = F.regexp_extract("_column", r"(\d+)$", 1).cast("int")
    return long.select(number.alias("louvain"), feat).orderBy("louvain", feat)


def _axis(scaffold: DataFrame, clusters: Sequence[int]) -> DataFrame:
    """Every guide of the axis once per listed cluster."""
    listed = F.array(*[F.lit(int(c)) for c in clusters])
    return scaffold.select("guide").withColumn("louvain", F.explode(listed))


def cluster_profile_matrix(
    scaffold: DataFrame,
    profile: DataFrame,
    value: str,
    clusters: Sequence[int],
    fill: DataFrame | None = None,
) -> DataFrame:
    """Guide axis × ``cluster_i`` columns; gaps hold 0, or the cluster's own value of ``fill`` (louvain, avg)."""
    cells = _axis(scaffold, clusters).join(profile.select("louvain", "guide", value), ["louvain", "guide"], "left")
    if fill is None:
        filled = F.coalesce(F.col(value), F.lit(0.0))
    else:
        cells = cells.join(fill.select("louvain", F.col("avg").alias("_fill")), "louvain", "left")
        filled = F.coalesce(F.col(value), F.col("_fill"))
    wide = cells.groupBy("guide").pivot("louvain", list(clusters)).agg(F.first(filled))
    return wide.select("guide", *[F.col(str(c)).alias(f"cluster_{c}") for c in clusters])


def _guide_list(guides: DataFrame) -> Column:
    """The guide axis as one array: it holds one short name per designed guide, never one per cell."""
    return guides.agg(F.collect_list("guide").alias("_guides")).scalar()


def stacked_profiles(
    scaffold: DataFrame, group_means: DataFrame, genes: DataFrame, clusters: Sequence[int]
) -> DataFrame:
    """All genes of every (cluster, guide) on the complete axis, long form, zeros where nothing was measured."""
    listed = F.array(*[F.lit(int(c)) for c in clusters])
    complete = (
        genes.select("gene")
        .withColumn("guide", F.explode(_guide_list(scaffold)))
        .withColumn("louvain", F.explode(listed))
    )
    keys = ["louvain", "guide", "gene"]
    joined = complete.join(group_means.select(*keys, "value"), keys, "left")
    return joined.select(*keys, F.coalesce("value", F.lit(0.0)).alias("value"))


def column_mean_fill(scaffold: DataFrame, group_means: DataFrame, cluster: int) -> DataFrame:
    """One cluster on the complete axis; a missing guide takes the gene's mean over the guides present."""
    own = group_means.where(F.col("louvain") == cluster).select("guide", "gene", "value")
    present = own.join(scaffold.select("guide"), "guide", "left_semi")
    missing = scaffold.select("guide").join(own.select("guide").distinct(), "guide", "left_anti")
    means = present.groupBy("gene").agg(F.avg("value").alias("value"))
    filled = means.select(F.explode(_guide_list(missing)).alias("guide"), "gene", "value")
    return present.unionByName(filled)


def expression_long(wide: DataFrame, genes: DataFrame) -> DataFrame:
    """Rows with a ``values`` array to one row per (cell, gene)."""
    keep = [c for c in wide.columns if c != "values"]
    long = wide.select(*keep, F.posexplode("values").alias("pos", "value"))
    return long.join(genes, "pos").select(*keep, "gene", "value")


def expression_wide(long: DataFrame, genes: DataFrame) -> DataFrame:
    """(cell, gene, value) rows to one row per cell whose ``values`` array follows the gene positions."""
    placed = long.join(genes, "gene").groupBy("cell_id").agg(
        F.array_sort(F.collect_list(F.struct("pos", "value"))).alias("_placed")
    )
    return placed.select("cell_id", F.transform("_placed", lambda e: e["value"]).alias("values"))


def powered_profile(profile: DataFrame, cluster: int, shift: int = -1, power: int = 2) -> DataFrame:
    """A derived test profile: one cluster moved by ``shift``, every number raised to ``power``, labels included."""
    own = profile.where(F.col("louvain") == cluster).withColumn("louvain", F.col("louvain") + shift)
    numeric = [n for n, t in own.dtypes if t in ("int", "bigint", "double", "float")]
    return own.select(*[F.pow(c, F.lit(power)).alias(c) if c in numeric else F.col(c) for c in own.columns])
