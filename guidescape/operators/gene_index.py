"""An index of which cells express which gene, for searching gene lists without the matrix.

Cells get numbers, those of a cluster next to each other. The postings of a gene are bitmaps over these numbers, cut into
stretches of 32,768 cells: a row per (gene, cluster, stretch) that holds any cell, whose empty parts compress to almost nothing
on disk. A list's cells are the AND of its genes' bitmaps; how many lie in a cluster is a count of bits, so a search reads the
postings of the listed genes and nothing else.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from guidescape.operators.expression import DETECTION_LIMIT, enrichment_of_counts
from guidescape.runtime import importable

STRETCH = 32_768


@dataclass(frozen=True)
class GeneIndex:
    """``postings``: gene, louvain, stretch, bits. ``cells``: number, cell_id, louvain."""

    postings: DataFrame
    cells: DataFrame


def write_index(expr: DataFrame, cells: DataFrame, folder: str, limit: float = DETECTION_LIMIT) -> GeneIndex:
    """Index the cells that express each gene above ``limit``; ``cells`` (cell_id, louvain) has every cell once."""
    spark = cells.sparkSession
    listed = cells.select("cell_id", "louvain").repartitionByRange("louvain", "cell_id").sortWithinPartitions("louvain", "cell_id")
    numbered = listed.select((F.monotonically_increasing_id() + 1).alias("number"), "cell_id", "louvain")
    numbered.write.parquet(f"{folder}/cells")
    numbered = spark.read.parquet(f"{folder}/cells")
    hits = expr.where(F.col("value") > limit).select("cell_id", "gene").join(numbered, "cell_id")
    postings = hits.groupBy("gene", "louvain", F.bitmap_bucket_number("number").alias("stretch")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("number")).alias("bits")
    )
    # sorted by gene, so that the files' statistics lead to a gene's rows
    postings.repartitionByRange("gene", "stretch").sortWithinPartitions("gene", "stretch").write.option(
        "compression", "zstd"
    ).parquet(f"{folder}/postings")
    return read_index(spark, folder)


def read_index(spark: SparkSession, folder: str) -> GeneIndex:
    return GeneIndex(spark.read.parquet(f"{folder}/postings"), spark.read.parquet(f"{folder}/cells"))


def _matches(index: GeneIndex, gene_lists: DataFrame) -> DataFrame:
    """list_id, louvain, stretch, bits of the cells that express the whole list."""
    wanted = gene_lists.select("list_id", "gene").distinct()
    sizes = wanted.groupBy("list_id").agg(F.count(F.lit(1)).alias("_size"))
    common = (
        index.postings.join(wanted, "gene")
        .groupBy("list_id", "louvain", "stretch")
        .agg(F.bitmap_and_agg("bits").alias("bits"), F.count(F.lit(1)).alias("_found"))
    )
    return common.join(sizes, "list_id").where("_found = _size").select("list_id", "louvain", "stretch", "bits")


def cells_of_lists(index: GeneIndex, gene_lists: DataFrame) -> DataFrame:
    """list_id, cell_id, louvain: cells that express every gene of a list (list_id, gene)."""
    importable(gene_lists.sparkSession)
    found = _matches(index, gene_lists)
    kind = dict(found.dtypes)["list_id"]

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                bits = np.unpackbits(np.frombuffer(row.bits, np.uint8), bitorder="little")
                numbers = (row.stretch - 1) * STRETCH + np.flatnonzero(bits) + 1
                yield pd.DataFrame({"list_id": row.list_id, "number": numbers})

    numbers = found.select("list_id", "stretch", "bits").mapInPandas(unpack, f"list_id {kind}, number long")
    return numbers.join(index.cells, "number").select("list_id", "cell_id", "louvain")


def enriched_clusters(index: GeneIndex, gene_lists: DataFrame) -> DataFrame:
    """Does a cluster hold more of a list's cells than chance? Counts of bits against the clusters' sizes."""
    counts = _matches(index, gene_lists).groupBy("list_id", "louvain").agg(F.sum(F.bitmap_count("bits")).alias("n"))
    return enrichment_of_counts(counts.where("n > 0"), index.cells)
