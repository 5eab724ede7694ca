"""Cleaning labels, lumping rare values, priority ordering."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from guidescape.functions.labels import CONTROL, default_control, parse_guide


def with_guide(df: DataFrame, label: str, control: str = CONTROL) -> DataFrame:
    """Add ``guide``: the parsed label, or the control where the label names no guide."""
    return df.withColumn("guide", default_control(parse_guide(F.col(label)), control))


def lump_other(df: DataFrame, col: str, keep: DataFrame, other: str = "other", out: str = "lumped") -> DataFrame:
    """Keep the values found in ``keep`` and turn all others, null included, into one label."""
    listed = keep.select(F.col(keep.columns[0]).alias(col)).distinct().withColumn("_kept", F.lit(True))
    marked = df.join(listed, col, "left")
    value = F.when(F.col("_kept"), F.col(col)).otherwise(F.lit(other))
    return marked.withColumn(out, value).select(*df.columns, out)


def priority_feature_reorder(
    cells: DataFrame, coords: DataFrame, col: str, priority: Sequence[str], other: str = "other"
) -> DataFrame:
    """Cells with their coordinates, lumped by a priority list and ordered so that listed values come last.

    Rank 0 is everything outside the list, then the list order. Coordinates are matched by cell, not by position.
    """
    listed = F.array(*[F.lit(str(v)) for v in priority])
    text = F.col(col).cast("string")
    rank = F.coalesce(F.array_position(listed, text), F.lit(0)).cast("int")
    return (
        cells.withColumn("priority_rank", rank)
        .withColumn("priority_reorder", F.when(F.col("priority_rank") > 0, text).otherwise(F.lit(other)))
        .join(coords, "cell_id")
        .orderBy("priority_rank", "cell_id")
    )
