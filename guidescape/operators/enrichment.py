"""Hypergeometric enrichment, multiple-testing correction and the tables behind its diagnostic plots."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from guidescape.functions.tails import hypergeom_tails
from guidescape.operators.counts import cluster_guide_counts, guide_gene_hits
from guidescape.operators.ranking import probability_bucket, tie_ranks
from guidescape.runtime import checkpointed, hot_keys, hot_lookup, total


def hypergeom_test(cells: DataFrame, guide_genes: DataFrame) -> DataFrame:
    """Over- and under-representation of each (guide, gene) seen in a cluster.

    Cells are read once and collapsed to (cluster, guide) counts before anything is joined; hits, draws, cluster sizes and
    the grand total all derive from those counts. Tails depend on (cluster, hits, draws) only, so they and their correction
    are worked out once per distinct combination and looked up by the pairs. Duplicate association rows count as often as
    they occur.
    """
    counts = checkpointed(cluster_guide_counts(cells))
    sizes = counts.groupBy("louvain").agg(F.sum("n").alias("m"))
    hits = guide_gene_hits(counts, guide_genes)
    draws = hits.groupBy("guide", "gene").agg(F.sum("n").alias("k"))
    tested = checkpointed(hits.join(draws, ["guide", "gene"]))
    combos = (
        tested.groupBy("louvain", "n", "k")
        .agg(F.count(F.lit(1)).alias("_pairs"))
        .join(sizes, "louvain")
        .withColumn("_rest", total(sizes, F.sum("m")) - F.col("m"))
        .withColumn("_tails", hypergeom_tails(F.col("n"), F.col("m"), F.col("_rest"), F.col("k")))
        .select(
            "louvain",
            "n",
            "k",
            "_pairs",
            F.col("_tails.upper").alias("p_value_enrich"),
            F.col("_tails.lower").alias("p_value_deplete"),
        )
    )
    combos = checkpointed(combos)
    sides = combos.unpivot(
        ["louvain", "n", "k", "_pairs"], ["p_value_enrich", "p_value_deplete"], "_side", "_p"
    )
    adjusted = bh_adjust(sides, "_p", ["louvain", "_side"], "_q", "_pairs")

    def pick(value: str, side: str, name: str) -> Column:
        return F.max(F.when(F.col("_side") == f"p_value_{side}", F.col(value))).alias(name)

    tails = adjusted.groupBy("louvain", "n", "k").agg(
        pick("_p", "enrich", "p_value_enrich"),
        pick("_p", "deplete", "p_value_deplete"),
        pick("_q", "enrich", "p_adj_enrich"),
        pick("_q", "deplete", "p_adj_deplete"),
    )
    common = hot_keys(combos, ["louvain", "n", "k"], "_pairs")
    return hot_lookup(tested, tails, ["louvain", "n", "k"], common).select(
        "louvain",
        "guide",
        "gene",
        "n",
        "p_value_enrich",
        "p_value_deplete",
        "p_adj_enrich",
        "p_adj_deplete",
    )


def significant_pairs(final: DataFrame, alpha: float = 0.05, p: str = "p_adj_enrich") -> DataFrame:
    """Tested pairs whose p-value lies below ``alpha``."""
    return final.where(F.col(p) < alpha)


def bh_adjust(
    df: DataFrame, p: str, by: Sequence[str] = (), out: str = "qval", weight: str | None = None
) -> DataFrame:
    """Benjamini–Hochberg adjusted ``p`` within each group; null p-values stay null and are not counted.

    With ``weight`` a row stands for that many tests.
    """
    by = list(by)
    ranked = tie_ranks(df, p, probability_bucket, by, weight).withColumn(
        "_raw", F.col(p) * F.col("group_rows") / (F.col("below") + F.col("ties"))
    )
    lowest = ranked.groupBy(*by, "_bucket").agg(F.min("_raw").alias("_lowest"))
    later = Window.partitionBy(*by).orderBy(F.desc("_bucket")).rowsBetween(Window.unboundedPreceding, -1)
    above = lowest.select(*by, "_bucket", F.min("_lowest").over(later).alias("_above"))
    inside = Window.partitionBy(*by, "_bucket").orderBy(F.desc(p)).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    adjusted = ranked.join(above, [*by, "_bucket"]).select(
        *by,
        p,
        F.least(F.lit(1.0), F.min("_raw").over(inside), F.col("_above")).alias(out),
    )
    common = hot_keys(ranked, [*by, p], "ties")
    return hot_lookup(df, adjusted, [*by, p], common, "left").select(*df.columns, out)


def qq_points(df: DataFrame, p: str) -> DataFrame:
    """Expected and observed −log10 p for every p-value, ranked over the whole table."""
    ranked = tie_ranks(df.select(p), p, probability_bucket)
    # tied values take consecutive ranks; long runs of ties are cut so that no row builds a long array
    run = 4096
    pieces = ranked.withColumn(
        "_piece", F.explode(F.sequence(F.lit(0), F.floor((F.col("ties") - 1) / run).cast("int")))
    ).repartition(p, "_piece")
    ranks = pieces.withColumn(
        "rank",
        F.explode(
            F.sequence(
                F.col("below") + F.col("_piece") * run + 1,
                F.col("below") + F.least((F.col("_piece") + 1) * run, F.col("ties")),
            )
        ),
    )
    n = F.col("group_rows")
    a = F.when(n <= 10, 3 / 8).otherwise(0.5)
    return ranks.select(
        "rank",
        (-F.log10((F.col("rank") - a) / (n + 1 - 2 * a))).alias("expected"),
        (-F.log10(F.col(p))).alias("observed"),
    )


def melt_p_values(df: DataFrame) -> DataFrame:
    """One row per (cluster, p-value column)."""
    columns = ["p_value_enrich", "p_value_deplete", "p_adj_enrich", "p_adj_deplete"]
    return df.unpivot("louvain", columns, "measure", "p")


def facet_histogram(df: DataFrame, value: str, by: Sequence[str], bins: int = 100) -> DataFrame:
    """Counts in equal-width bins between each group's own minimum and maximum."""
    by = list(by)
    distinct = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("_n"))
    ends = distinct.groupBy(*by).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    share = (F.col(value) - F.col("_lo")) / F.nullif(F.col("_hi") - F.col("_lo"), F.lit(0.0))
    bin_no = F.least(F.floor(F.coalesce(share, F.lit(0.0)) * bins).cast("int") + 1, F.lit(bins))
    return (
        distinct.join(ends, by)
        .groupBy(*by, bin_no.alias("bin"))
        .agg(F.sum("_n").alias("n"))
    )
