"""A cell × gene matrix without its zeros: one row per cell with the positions and values of its other entries.

Operators take the matrix as ``long`` rows, without zeros, together with ``cells`` and ``genes``, and add the implied zeros from
counts: the number of cells of a group, or of genes, stands for all entries that have no row. Nothing is filled in.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F


@dataclass(frozen=True)
class CellMatrix:
    """``rows``: cell_id, columns of the cell, indices array<int> (rising), values array<double>. ``genes``: pos, gene.

    A cell without entries has empty arrays. Null entries of a dense matrix count as zeros.
    """

    rows: DataFrame
    genes: DataFrame

    @staticmethod
    def from_dense(wide: DataFrame, genes: DataFrame) -> CellMatrix:
        """From rows with one value per gene."""
        placed = F.transform("values", lambda v, i: F.struct(i.cast("int").alias("i"), v.cast("double").alias("v")))
        kept = F.filter(placed, lambda e: F.coalesce(e["v"] != 0, F.lit(False)))
        rows = wide.withColumn("_kept", kept)
        rows = rows.withColumns({"indices": F.col("_kept.i"), "values": F.col("_kept.v")}).drop("_kept")
        return CellMatrix(rows, genes)

    @staticmethod
    def from_long(expr: DataFrame, cells: DataFrame, genes: DataFrame) -> CellMatrix:
        """From (cell_id, gene, value) rows; ``cells`` has every cell once. Repeated entries are added up."""
        entries = expr.join(genes, "gene").groupBy("cell_id", "pos").agg(F.sum("value").alias("v")).where("v <> 0")
        held = entries.groupBy("cell_id").agg(  # at most one entry per gene
            F.sort_array(F.collect_list(F.struct(F.col("pos").cast("int").alias("i"), "v"))).alias("_kept")
        )
        rows = cells.join(held, "cell_id", "left")
        empty = {"indices": F.array().cast("array<int>"), "values": F.array().cast("array<double>")}
        found = {"indices": F.col("_kept.i"), "values": F.col("_kept.v")}
        return CellMatrix(rows.withColumns({c: F.coalesce(found[c], empty[c]) for c in found}).drop("_kept"), genes)

    @property
    def cells(self) -> DataFrame:
        return self.rows.drop("indices", "values")

    def long(self) -> DataFrame:
        """cell_id, columns of the cell, gene, value: entries that are not zero."""
        others = [c for c in self.rows.columns if c not in ("indices", "values")]
        entries = self.rows.select(*others, F.explode(F.arrays_zip("indices", "values")).alias("_e"))
        named = self.genes.select(F.col("pos").cast("int").alias("_pos"), "gene")
        return entries.join(named, F.col("_e.indices") == F.col("_pos")).select(
            *others, "gene", F.col("_e.values").alias("value")
        )

    def cell_totals(self) -> DataFrame:
        """Sum over each cell, without leaving its row."""
        return self.rows.select("cell_id", F.aggregate("values", F.lit(0.0), lambda a, v: a + v).alias("total"))
