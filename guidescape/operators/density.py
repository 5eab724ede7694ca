"""Density-peak clustering (Rodriguez & Laio 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from guidescape.operators.graph import follow_parents
from guidescape.operators.neighbours import local_density, nearest_denser


def density_rho_delta(points: DataFrame, dc: float) -> DataFrame:
    """Density, distance to the nearest denser cell, and that cell. Densities are compared at ten decimals."""
    rho = local_density(points, dc).withColumn("rho", F.round("rho", 10))
    return nearest_denser(points, rho)


def density_peaks(table: DataFrame, k: int = 9) -> DataFrame:
    """The ``k`` cells with the largest rho·delta become centres; everyone else follows the nearest denser cell."""
    centres = table.orderBy(F.desc(F.col("rho") * F.col("delta")), "cell_id").limit(k).select(
        "cell_id", F.lit(True).alias("_centre")
    )
    own = F.col("_centre") | F.col("parent").isNull()
    pointers = table.join(centres, "cell_id", "left").select(
        "cell_id", F.when(own, F.col("cell_id")).otherwise(F.col("parent")).alias("parent")
    )
    return follow_parents(pointers).withColumnRenamed("parent", "centre")
