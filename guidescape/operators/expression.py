"""Aggregating the cell × gene matrix: group means, detection, size factors, dispersion, gene-list search.

``expr`` is long: cell_id, louvain, guide, gene, value. With ``cells`` given, absent (cell, gene) rows count as zeros; with
``genes``, so do genes without any row. Zeros are added from counts, never as rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from guidescape.functions.tails import hypergeom_tails
from guidescape.runtime import checkpointed, salted_lookup, total

# Fixed value: expression above this counts as detected.
DETECTION_LIMIT = 0.0001


def group_weights(cells: DataFrame) -> DataFrame:
    """Cells per (cluster, guide)."""
    return cells.groupBy("louvain", "guide").agg(F.count(F.lit(1)).alias("n"))


def guide_mean_expr(expr: DataFrame, cells: DataFrame | None = None) -> DataFrame:
    """Mean of each gene per (cluster, guide). For a sparse matrix sums are divided by the cells of the group."""
    keys = ["louvain", "guide", "gene"]
    if cells is None:
        return expr.groupBy(*keys).agg(F.avg("value").alias("value"))
    sums = expr.groupBy(*keys).agg(F.sum("value").alias("_sum"))
    return sums.join(group_weights(cells), ["louvain", "guide"]).select(
        *keys, (F.col("_sum") / F.col("n")).alias("value")
    )


def weighted_group_expr(group_means: DataFrame, weights: DataFrame) -> DataFrame:
    """Mean over genes of the group means, times the cells of the group."""
    means = group_means.groupBy("louvain", "guide").agg(F.avg("value").alias("_mean"))
    return means.join(weights, ["louvain", "guide"]).select(
        "louvain", "guide", (F.col("_mean") * F.col("n")).alias("avg_group_exprs")
    )


def cluster_mean_of_means(group_means: DataFrame) -> DataFrame:
    """Unweighted mean over guides, then over genes."""
    genes = group_means.groupBy("louvain", "gene").agg(F.avg("value").alias("_mean"))
    return genes.groupBy("louvain").agg(F.avg("_mean").alias("avg"))


def grand_mean(expr: DataFrame, cells: DataFrame | None = None, genes: DataFrame | None = None) -> DataFrame:
    """Mean of all entries. For a sparse matrix the sum is divided by cells times genes."""
    if cells is None:
        return expr.agg(F.avg("value").alias("avg_tot"))
    if genes is None:
        raise ValueError("the mean of a sparse matrix needs its genes as well as its cells")
    entries = total(cells, F.count(F.lit(1))) * total(genes, F.count(F.lit(1)))
    return expr.agg(F.coalesce(F.sum("value"), F.lit(0.0)).alias("_sum")).select(
        (F.col("_sum") / F.nullif(entries, F.lit(0))).alias("avg_tot")
    )


def numi_counts(cells: DataFrame) -> DataFrame:
    """Molecule counts per (cluster, guide) as whole numbers; summed as decimals, so the order of rows is irrelevant."""
    exact = F.col("numi_cov").cast("decimal(18,4)")
    return cells.groupBy("louvain", "guide").agg(F.sum(exact).cast("long").alias("numi_cov"))


def _hits(expr: DataFrame, by: str, limit: float, name: str, every: DataFrame | None) -> DataFrame:
    if limit < 0 and every is not None:
        raise ValueError("below zero even the entries that a sparse matrix leaves out would be detected")
    hit = F.when(F.col("value") > limit, 1).otherwise(0)
    found = expr.groupBy(by).agg(F.sum(hit).alias(name))
    if every is None:
        return found
    return every.select(by).distinct().join(found, by, "left").select(by, F.coalesce(name, F.lit(0).cast("long")).alias(name))


def genes_detected(expr: DataFrame, limit: float = DETECTION_LIMIT, genes: DataFrame | None = None) -> DataFrame:
    """Cells in which each gene (of ``genes``) is detected."""
    return _hits(expr, "gene", limit, "num_cells_expressed", genes)


def cells_detected(expr: DataFrame, limit: float = DETECTION_LIMIT, cells: DataFrame | None = None) -> DataFrame:
    """Genes detected in each cell (of ``cells``)."""
    return _hits(expr, "cell_id", limit, "num_genes_expressed", cells)


def use_for_ordering(detected: DataFrame, cells: DataFrame, fraction: float = 0.05) -> DataFrame:
    """Flag genes detected in more than a fraction of all cells."""
    n = total(cells, F.count(F.lit(1)))
    return detected.withColumn("use_for_ordering", F.col("num_cells_expressed") > fraction * n)


def retained_share(flagged: DataFrame) -> DataFrame:
    return flagged.agg(F.avg(F.col("use_for_ordering").cast("int")).alias("retained"))


def gene_detection_summary(detected: DataFrame) -> DataFrame:
    """Minimum, quartiles, mean and maximum of cells per gene. One input row per gene."""
    marks = F.percentile("num_cells_expressed", F.array(*[F.lit(x) for x in (0.0, 0.25, 0.5, 0.75, 1.0)]))
    row = detected.agg(marks.alias("q"), F.avg("num_cells_expressed").alias("mean"))
    names = ["min", "q1", "median", "q3", "max"]
    return row.select(*[F.col("q")[i].alias(n) for i, n in enumerate(names)], "mean")


def size_factors(expr: DataFrame) -> DataFrame:
    """Cell total over the geometric mean of all cell totals. A cell without counts has none."""
    totals = checkpointed(expr.groupBy("cell_id").agg(F.sum("value").alias("_total")).where("_total <> 0"))
    centre = total(totals, F.avg(F.log("_total")))
    return totals.select("cell_id", F.exp(F.log("_total") - centre).alias("size_factor"))


def dispersion_table(expr: DataFrame, factors: DataFrame, genes: DataFrame | None = None) -> DataFrame:
    """Per gene: mean, variance and dispersion of size-normalised values.

    Dispersion is the variance left after the counting noise, mean × average(1 / size factor), over the squared mean. Cells are
    those with a size factor; one without a row for a gene has a zero there.
    """
    factors = factors.where("size_factor > 0")
    noise = total(factors, F.avg(1 / F.col("size_factor")))
    cells = total(factors, F.count(F.lit(1)))
    scaled = expr.join(factors, "cell_id").withColumn("_y", F.col("value") / F.col("size_factor"))
    seen = scaled.groupBy("gene").agg(
        F.count("_y").alias("_rows"), F.avg("_y").alias("_mean"), F.var_pop("_y").alias("_var")
    )
    if genes is not None:
        seen = genes.select("gene").distinct().join(seen, "gene", "left").fillna(0, ["_rows", "_mean", "_var"])
    rows, mean = F.col("_rows"), F.col("_mean")
    squares = rows * F.col("_var") + mean * mean * rows * (F.col("_cells") - rows) / F.col("_cells")
    moments = seen.withColumn("_cells", cells).select(
        "gene",
        (mean * rows / F.col("_cells")).alias("mean"),
        (squares / F.nullif(F.col("_cells") - 1, F.lit(0))).alias("variance"),
    )
    excess = F.col("variance") - noise * F.col("mean")
    return moments.withColumn("dispersion", excess / F.nullif(F.col("mean") * F.col("mean"), F.lit(0.0)))


def dispersion_fit(table: DataFrame) -> DataFrame:
    """One-pass least-squares trend dispersion = asymptote + extra / mean."""
    good = table.where((F.col("mean") > 0) & F.col("dispersion").isNotNull())
    inverse = 1 / F.col("mean")
    return good.agg(
        F.regr_intercept("dispersion", inverse).alias("asymptote"),
        F.regr_slope("dispersion", inverse).alias("extra"),
    )


def genelist_cells(expr: DataFrame, gene_lists: DataFrame, limit: float = DETECTION_LIMIT) -> DataFrame:
    """Cells that express every gene of a list; all lists (list_id, gene) are searched in one pass."""
    wanted = gene_lists.select("list_id", "gene").distinct()
    sizes = wanted.groupBy("list_id").agg(F.count(F.lit(1)).alias("_size"))
    expressed = expr.where(F.col("value") > limit).select("cell_id", "louvain", "gene")
    found = (
        salted_lookup(expressed, wanted, ["gene"])
        .groupBy("list_id", "cell_id", "louvain")
        .agg(F.count_distinct("gene").alias("_found"))
    )
    return found.join(sizes, "list_id").where(F.col("_found") == F.col("_size")).select(
        "list_id", "cell_id", "louvain"
    )


def genelist_enrichment(hits: DataFrame, cells: DataFrame) -> DataFrame:
    """Does a cluster hold more of a list's cells than chance? Hypergeometric upper tail per (list, cluster)."""
    return enrichment_of_counts(hits.groupBy("list_id", "louvain").agg(F.count(F.lit(1)).alias("n")), cells)


def enrichment_of_counts(per: DataFrame, cells: DataFrame) -> DataFrame:
    """As ``genelist_enrichment``, from the number ``n`` of a list's cells in a cluster."""
    sizes = cells.groupBy("louvain").agg(F.count(F.lit(1)).alias("m"))
    everything = total(sizes, F.sum("m"))
    drawn = per.groupBy("list_id").agg(F.sum("n").alias("k"))
    rows = per.join(drawn, "list_id").join(sizes, "louvain").withColumn("_rest", everything - F.col("m"))
    tails = hypergeom_tails(F.col("n"), F.col("m"), F.col("_rest"), F.col("k"))
    return rows.select("list_id", "louvain", "n", "k", "m", tails["upper"].alias("p_value"))


def marker_overlay(coords: DataFrame, expr: DataFrame, markers: list[str]) -> DataFrame:
    """Embedding rows with the expression of chosen markers; the marker filter reaches the matrix scan."""
    chosen = expr.where(F.col("gene").isin(markers)).select("cell_id", "gene", "value")
    return coords.join(chosen, "cell_id")
