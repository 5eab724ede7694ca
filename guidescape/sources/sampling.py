"""Repeatable samples: decided by a seeded hash of the cell, independent of partitioning and retries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from guidescape.operators.ranking import lowest_by_hash, seeded_hash

SEED = 55
STEPS = 1 << 32


def sample_cells(cells: DataFrame, n: int, seed: int = SEED) -> DataFrame:
    """Exactly ``n`` cells (or all, when there are fewer), without replacement."""
    return lowest_by_hash(cells, n, "cell_id", seed)


def sample_fraction(cells: DataFrame, fraction: float, seed: int = SEED) -> DataFrame:
    """About ``fraction`` of the cells; 1 keeps every row."""
    if fraction >= 1:
        return cells
    limit = f"{int(fraction * STEPS):08x}"
    return cells.where(F.substring(seeded_hash("cell_id", seed), 1, 8) < limit)


def marker_subset(expr: DataFrame, cells: DataFrame, markers: Sequence[str], n: int, seed: int = SEED) -> DataFrame:
    """Matrix rows of marker genes in ``n`` sampled cells."""
    chosen = sample_cells(cells.select("cell_id"), n, seed)
    return expr.where(F.col("gene").isin(list(markers))).join(chosen, "cell_id", "left_semi")
