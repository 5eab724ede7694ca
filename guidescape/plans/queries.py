"""One Spark plan per query name."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass
from functools import partial

from pyspark.sql import DataFrame, SparkSession, functions as F

from guidescape.functions.labels import cluster_guide_key
from guidescape.operators import (
    clean,
    components,
    correlation,
    counts,
    curves,
    density,
    enrichment,
    expression,
    gene_index,
    graph,
    neighbours,
    nested,
    reshape,
    sets,
    spatial,
    topk,
    trajectory,
)
from guidescape.plans.views import CLUSTERS, CONTROL, Views
from guidescape.runtime import checkpointed, ensure_checkpoint_dir
from guidescape.sources import (
    marker_subset,
    read_cells_with_expression,
    sample_cells,
    sample_fraction,
    write_cell_table,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn: Callable[[Views], DataFrame], name: str | None = None) -> Callable[[Views], DataFrame]:
    QUERIES[name or fn.__name__] = lambda spark, folder: fn(Views(spark, folder))
    return fn


def _rounded(df: DataFrame, digits: int, *names: str) -> DataFrame:
    """Round doubles so that both engines agree; adding 0.0 turns −0.0 into 0.0."""
    return df.withColumns({n: F.round(n, digits) + F.lit(0.0) for n in names})


# --- sources and sampling ----------------------------------------------------------------------------------------


@query
def expr_cluster_subset(v: Views) -> DataFrame:
    return _rounded(v.expr.where(F.col("louvain").isin(1, 2)), 6, "value")


@partial(query, name="sample_cells")
def _sample_cells(v: Views) -> DataFrame:
    return sample_cells(v.cells.select("cell_id", "louvain", "guide"), 1000)


@partial(query, name="sample_fraction")
def _sample_fraction(v: Views) -> DataFrame:
    return sample_fraction(v.cells.select("cell_id", "louvain", "guide"), 0.05)


@partial(query, name="marker_subset")
def _marker_subset(v: Views) -> DataFrame:
    return _rounded(marker_subset(v.expr, v.matrix, ["g0", "g1", "g2", "g3"], 200), 6, "value")


# --- labels and reshaping ----------------------------------------------------------------------------------------


@query
def parse_guide(v: Views) -> DataFrame:
    return v.cells.select("cell_id", "guide_cov", "guide")


@query
def wt_share(v: Views) -> DataFrame:
    return _rounded(counts.wild_type_share(v.cells), 8, "share")


@query
def cluster_guide_counts(v: Views) -> DataFrame:
    table = counts.cluster_guide_counts(v.cells)
    return table.select(cluster_guide_key(F.col("louvain"), F.col("guide")).alias("cluster_guide"), "n")


@query
def lump_enriched(v: Views) -> DataFrame:
    enriched = reshape.tidy_feats(v.feature_lists, "enriched").where("louvain = 1").select("guide")
    return clean.lump_other(v.cells.select("cell_id", "guide"), "guide", enriched)


@query
def priority_reorder(v: Views) -> DataFrame:
    coords = components.coordinates(v.matrix)
    out = clean.priority_feature_reorder(v.matrix.select("cell_id", "guide"), coords, "guide", ["G2.1", "G1.1"])
    return _rounded(out, 6, "dim1", "dim2")


@query
def tidy_feats_enriched(v: Views) -> DataFrame:
    return reshape.tidy_feats(v.feature_lists, "enriched")


@query
def tidy_feats_depleted(v: Views) -> DataFrame:
    return reshape.tidy_feats(v.feature_lists, "depleted")


def _unique_enriched(v: Views) -> DataFrame:
    return sets.not_shared_feats(reshape.tidy_feats(v.feature_lists, "enriched"), "guide")


@query
def unique_feats_wide(v: Views) -> DataFrame:
    return reshape.unique_feats_wide(_unique_enriched(v), "guide", CLUSTERS)


@query
def unique_feats_roundtrip(v: Views) -> DataFrame:
    return reshape.wide_to_long(unique_feats_wide(v), CLUSTERS, "guide")


COLUMNS = [f"cluster_{c}" for c in CLUSTERS]


def _numi_profile(v: Views) -> DataFrame:
    return reshape.cluster_profile_matrix(v.scaffold, expression.numi_counts(v.cells), "numi_cov", CLUSTERS)


@query
def profile_zero_fill(v: Views) -> DataFrame:
    return _rounded(_numi_profile(v), 4, *COLUMNS)


@query
def profile_mean_fill(v: Views) -> DataFrame:
    means = expression.guide_mean_expr(v.expr)
    profile = expression.weighted_group_expr(means, expression.group_weights(v.matrix))
    fill = expression.cluster_mean_of_means(means)
    out = reshape.cluster_profile_matrix(v.expr_scaffold, profile, "avg_group_exprs", CLUSTERS, fill)
    return _rounded(out, 6, *COLUMNS)


def _stacked(v: Views) -> DataFrame:
    return reshape.stacked_profiles(v.expr_scaffold, expression.guide_mean_expr(v.expr), v.genes, CLUSTERS)


@query
def profile_stacked(v: Views) -> DataFrame:
    return _rounded(_stacked(v), 6, "value")


@query
def profile_colmean_fill(v: Views) -> DataFrame:
    return _rounded(reshape.column_mean_fill(v.expr_scaffold, expression.guide_mean_expr(v.expr), 1), 6, "value")


@query
def expr_long(v: Views) -> DataFrame:
    return _rounded(reshape.expression_long(v.matrix.select("cell_id", "values"), v.genes), 6, "value")


@query
def profile_squared(v: Views) -> DataFrame:
    return _rounded(reshape.powered_profile(expression.guide_mean_expr(v.expr), 3), 6, "louvain", "value")


# --- counting ----------------------------------------------------------------------------------------------------


@query
def cluster_sizes(v: Views) -> DataFrame:
    return counts.cluster_sizes(v.cells)


@query
def cluster_complement(v: Views) -> DataFrame:
    return counts.cluster_complement(v.cells)


@query
def guide_gene_totals(v: Views) -> DataFrame:
    return counts.guide_gene_totals(v.cells, v.sig)


@query
def guide_gene_hits(v: Views) -> DataFrame:
    return counts.guide_gene_hits(counts.cluster_guide_counts(v.cells), v.sig)


@query
def guide_frequency(v: Views) -> DataFrame:
    return counts.most_frequent_first(counts.guide_frequency(v.cells), "guide")


@query
def donor_guide_frequency(v: Views) -> DataFrame:
    return counts.most_frequent_first(counts.guide_frequency(v.cells, "donor_cov"), "donor_cov", "guide")


@query
def control_share(v: Views) -> DataFrame:
    return _rounded(counts.control_share(v.cells), 8, "share")


@query
def guide_coverage(v: Views) -> DataFrame:
    return _rounded(counts.guide_coverage(v.cells, v.sigpos), 8, "covered", "not_control")


@query
def absent_guides(v: Views) -> DataFrame:
    return counts.absent_guides(v.scaffold, v.cells)


@query
def guide_share(v: Views) -> DataFrame:
    return _rounded(counts.guide_share(v.cells), 8, "normalized")


def _significant(v: Views) -> DataFrame:
    """Pairs over-represented at a nominal 0.05; the tables are random, so few survive the correction."""
    final = _rounded(_tested(v), 9, "p_value_enrich")
    return enrichment.significant_pairs(final, 0.05, "p_value_enrich")


@query
def genes_per_cluster_guide(v: Views) -> DataFrame:
    return counts.genes_per_cluster_guide(counts.guide_gene_hits(counts.cluster_guide_counts(v.cells), v.sigpos))


@query
def rows_per_cluster(v: Views) -> DataFrame:
    return counts.rows_per_cluster(counts.guide_gene_hits(counts.cluster_guide_counts(v.cells), v.sigpos))


@query
def significant_per_cluster(v: Views) -> DataFrame:
    return counts.rows_per_cluster(_significant(v))


@query
def enriched_cell_count(v: Views) -> DataFrame:
    return counts.enriched_cell_count(v.cells, reshape.tidy_feats(v.feature_lists, "enriched"))


@query
def de_genes_per_cluster(v: Views) -> DataFrame:
    return counts.cluster_sizes(v.cluster_sig.withColumnRenamed("cluster", "louvain"))


@query
def top_guides_per_cluster(v: Views) -> DataFrame:
    return topk.top_guides_per_cluster(v.cells, v.sigpos)


@query
def top_genes_per_cluster(v: Views) -> DataFrame:
    return topk.top_genes_per_cluster(v.cells, v.sigpos, v.cluster_sig)


REFERENCE_CLUSTER = 4


def _not_in_ref(v: Views) -> DataFrame:
    top = topk.top_guides_per_cluster(v.cells, v.sigpos)
    return topk.top_guides_not_in_ref(top, REFERENCE_CLUSTER)


@query
def top_guides_not_in_ref(v: Views) -> DataFrame:
    return _not_in_ref(v)


@query
def top_guides_total(v: Views) -> DataFrame:
    return topk.top_guides_total(_not_in_ref(v))


@query
def leaders_in_ref_cluster(v: Views) -> DataFrame:
    return topk.leaders_in_ref_cluster(v.cells, topk.top_guides_total(_not_in_ref(v)), REFERENCE_CLUSTER)


@query
def top_guides_rank_2_4(v: Views) -> DataFrame:
    return topk.top_guides_between(v.cells, 1, 2, 4)


@query
def supra_join(v: Views) -> DataFrame:
    return sets.supra_join(v.cells, v.sigpos, v.cluster_sig)


@query
def unmatched_guides(v: Views) -> DataFrame:
    return sets.unmatched_guides(v.cells, v.sig)


@query
def unique_genes(v: Views) -> DataFrame:
    return sets.not_shared_feats(v.cluster_sig.withColumnRenamed("cluster", "louvain"), "gene")


@query
def unique_guides(v: Views) -> DataFrame:
    return _unique_enriched(v)


@query
def significant_unique_guides(v: Views) -> DataFrame:
    return sets.not_shared_feats(_significant(v), "guide")


@query
def unique_guide_genes(v: Views) -> DataFrame:
    return _rounded(sets.associations_of(v.sigpos, _unique_enriched(v), 1), 8, "fdr")


@query
def enriched_guide_genes(v: Views) -> DataFrame:
    enriched = reshape.tidy_feats(v.feature_lists, "enriched")
    return _rounded(sets.associations_of(v.sigpos, enriched, 0), 8, "fdr")


# --- statistics --------------------------------------------------------------------------------------------------


def _tested(v: Views) -> DataFrame:
    return enrichment.hypergeom_test(v.cells, v.sig)


def _with_log(df: DataFrame, p: str, adjusted: str) -> DataFrame:
    out = df.select("louvain", "guide", "gene", "n", p, adjusted, (-F.log10(p)).alias("neg_log10_p"))
    return _rounded(_rounded(out, 5, p, adjusted), 4, "neg_log10_p")


@query
def hypergeom_enrich(v: Views) -> DataFrame:
    return _with_log(_tested(v), "p_value_enrich", "p_adj_enrich")


@query
def hypergeom_deplete(v: Views) -> DataFrame:
    return _with_log(_tested(v), "p_value_deplete", "p_adj_deplete")


@query
def bh_adjust(v: Views) -> DataFrame:
    p = v.guide_genes.select("guide", "gene", F.split("guide", r"\.")[1].alias("block"), F.col("fdr").alias("p"))
    return _rounded(enrichment.bh_adjust(p, "p", ["block"]), 8, "p", "qval")


@query
def qq_points(v: Views) -> DataFrame:
    out = enrichment.qq_points(_tested(v), "p_value_enrich")
    return _rounded(_rounded(out, 8, "expected"), 4, "observed")


@query
def pvalue_histogram(v: Views) -> DataFrame:
    return enrichment.facet_histogram(enrichment.melt_p_values(_tested(v)), "p", ["louvain", "measure"])


@query
def cluster_corr(v: Views) -> DataFrame:
    return _rounded(correlation.profile_corr(_numi_profile(v), COLUMNS), 6, "r")


def _matrix_long(wide: DataFrame) -> DataFrame:
    return checkpointed(wide).unpivot("guide", COLUMNS, "col", "value").withColumnRenamed("guide", "row")


def _count_profile(v: Views) -> DataFrame:
    return reshape.cluster_profile_matrix(v.scaffold, expression.group_weights(v.cells), "n", CLUSTERS)


@query
def cross_corr(v: Views) -> DataFrame:
    out = correlation.cross_corr(_matrix_long(_numi_profile(v)), _matrix_long(_count_profile(v)))
    return _rounded(out, 6, "r")


def _profile_rows(v: Views) -> DataFrame:
    """Stacked profiles as a matrix: one row per (cluster, guide), genes and the cluster number as columns."""
    row = F.concat_ws("|", F.col("louvain").cast("string"), "guide").alias("row")
    stacked = _stacked(v)
    genes = stacked.select(row, F.col("gene").alias("col"), "value")
    number = stacked.select(row, F.lit("louvain").alias("col"), F.col("louvain").cast("double").alias("value"))
    return genes.unionByName(number.distinct())


@query
def gene_corr(v: Views) -> DataFrame:
    rows = checkpointed(_profile_rows(v))
    return _rounded(correlation.cross_corr(rows, rows), 6, "r")


@query
def corr_pvalues(v: Views) -> DataFrame:
    corr = correlation.profile_corr(_numi_profile(v), COLUMNS)
    out = correlation.corr_pvalues(corr, v.scaffold.count())
    return _rounded(_rounded(out, 6, "r", "p_value"), 4, "t")


def _cluster_genes_long(v: Views, cluster: int) -> DataFrame:
    filled = reshape.column_mean_fill(v.expr_scaffold, expression.guide_mean_expr(v.expr), cluster)
    return checkpointed(filled.select(F.col("guide").alias("row"), F.col("gene").alias("col"), "value"))


@query
def corr_svd(v: Views) -> DataFrame:
    corr = correlation.cross_corr(_cluster_genes_long(v, 0), _cluster_genes_long(v, 1))
    return correlation.singular_values(corr, v.genes.count())


def _gene_halves(v: Views) -> tuple[DataFrame, DataFrame]:
    rows = v.expr.select(F.col("cell_id").alias("row"), F.col("gene").alias("col"), "value")
    half = v.genes.select(F.col("gene").alias("col"), F.col("pos") * 2 < v.genes.count())
    half = half.toDF("col", "_first")  # one row per gene
    sided = rows.join(half, "col")
    return sided.where("_first").drop("_first"), sided.where("not _first").drop("_first")


@query
def cancor(v: Views) -> DataFrame:
    return _rounded(correlation.canonical_correlation(*_gene_halves(v)), 6, "correlation")


@query
def cancor_coefficients(v: Views) -> DataFrame:
    return correlation.canonical_coefficients(*_gene_halves(v))


def _guide_id():
    """Position of a guide on the numeric axis: 0 for the control, then nation and number."""
    nation = F.regexp_extract("guide", r"^N(\d+)\.(\d+)$", 1).cast("int")
    number = F.regexp_extract("guide", r"^N(\d+)\.(\d+)$", 2).cast("int")
    return F.when(F.col("guide") == CONTROL, 0).otherwise(nation * 4 + number + 1)


@query
def guide_density(v: Views) -> DataFrame:
    out = correlation.guide_density(v.cells.withColumn("guide_id", _guide_id()), "guide_id")
    return _rounded(out, 6, "x", "density")


@query
def gene_detection_summary(v: Views) -> DataFrame:
    out = expression.gene_detection_summary(expression.genes_detected(v.expr))
    return _rounded(out, 6, "min", "q1", "median", "q3", "max", "mean")


# --- expression --------------------------------------------------------------------------------------------------


@query
def guide_mean_expr(v: Views) -> DataFrame:
    return _rounded(expression.guide_mean_expr(v.expr), 6, "value")


@query
def guide_mean_expr_sparse(v: Views) -> DataFrame:
    detected = v.expr.where(F.col("value") > expression.DETECTION_LIMIT)
    return _rounded(expression.guide_mean_expr(detected, v.matrix), 6, "value")


@query
def guide_weights(v: Views) -> DataFrame:
    return expression.group_weights(v.matrix)


@query
def weighted_group_expr(v: Views) -> DataFrame:
    out = expression.weighted_group_expr(expression.guide_mean_expr(v.expr), expression.group_weights(v.matrix))
    return _rounded(out, 6, "avg_group_exprs")


@query
def cluster_mean_of_means(v: Views) -> DataFrame:
    return _rounded(expression.cluster_mean_of_means(expression.guide_mean_expr(v.expr)), 6, "avg")


@query
def grand_mean(v: Views) -> DataFrame:
    return _rounded(expression.grand_mean(v.expr), 6, "avg_tot")


@query
def numi_counts(v: Views) -> DataFrame:
    return expression.numi_counts(v.cells)


@query
def genes_detected(v: Views) -> DataFrame:
    return expression.genes_detected(v.expr)


@query
def cells_detected(v: Views) -> DataFrame:
    return expression.cells_detected(v.expr)


# The matrix has no zeros, so the flag is taken at a higher limit to split the genes.
FLAG_LIMIT, FLAG_FRACTION = 0.15, 0.11


def _flagged(v: Views) -> DataFrame:
    return expression.use_for_ordering(expression.genes_detected(v.expr, FLAG_LIMIT), v.matrix, FLAG_FRACTION)


@query
def use_for_ordering(v: Views) -> DataFrame:
    return _flagged(v)


@query
def retained_share(v: Views) -> DataFrame:
    return _rounded(expression.retained_share(_flagged(v)), 8, "retained")


@query
def size_factors(v: Views) -> DataFrame:
    return _rounded(expression.size_factors(v.expr_pos), 6, "size_factor")


def _dispersions(v: Views) -> DataFrame:
    return expression.dispersion_table(v.expr_pos, expression.size_factors(v.expr_pos))


@query
def dispersion_table(v: Views) -> DataFrame:
    return _rounded(_dispersions(v), 6, "mean", "variance", "dispersion")


@query
def dispersion_fit(v: Views) -> DataFrame:
    return _rounded(expression.dispersion_fit(_dispersions(v)), 5, "asymptote", "extra")


@query
def pc_variance(v: Views) -> DataFrame:
    return _rounded(components.pc_variance(v.matrix, 20), 6, "explained")


@query
def pca_embedding(v: Views) -> DataFrame:
    return components.pca_embedding(v.matrix, 20)


@query
def genelist_cells(v: Views) -> DataFrame:
    return expression.genelist_cells(v.expr, v.gene_lists)


@query
def genelist_enrichment(v: Views) -> DataFrame:
    out = expression.genelist_enrichment(expression.genelist_cells(v.expr, v.gene_lists), v.matrix)
    return _rounded(out, 6, "p_value")


@query
def marker_overlay(v: Views) -> DataFrame:
    out = expression.marker_overlay(components.coordinates(v.matrix), v.expr, ["g5", "g6"])
    return _rounded(out, 6, "dim1", "dim2", "value")


# --- graphs and trajectory ---------------------------------------------------------------------------------------

NEIGHBOURS = 3


def _knn(v: Views) -> DataFrame:
    return neighbours.knn(v.matrix, NEIGHBOURS)


@query
def knn_graph(v: Views) -> DataFrame:
    return _rounded(_knn(v), 6, "distance")


@query
def jaccard_graph(v: Views) -> DataFrame:
    return _rounded(graph.jaccard_graph(_knn(v)), 8, "weight")


@query
def communities(v: Views) -> DataFrame:
    return graph.communities(graph.jaccard_graph(_knn(v)), v.matrix)


@query
def community_quality(v: Views) -> DataFrame:
    edges = checkpointed(graph.jaccard_graph(_knn(v)))
    labels = checkpointed(graph.communities(edges, v.matrix))
    return _rounded(graph.community_quality(edges, labels), 8, "modularity")


@query
def modularity(v: Views) -> DataFrame:
    edges = _knn(v).select("src", "dst", F.lit(1.0).alias("weight"))
    labels = v.matrix.select("cell_id", F.col("louvain").alias("community"))
    return _rounded(graph.modularity(edges, labels), 8, "modularity")


@query
def graph_partitions(v: Views) -> DataFrame:
    return graph.graph_partitions(v.matrix, _knn(v))


PEAK_SCALE = 0.6


@query
def density_rho_delta(v: Views) -> DataFrame:
    return _rounded(density.density_rho_delta(v.matrix, PEAK_SCALE), 6, "rho", "delta")


@query
def density_peaks(v: Views) -> DataFrame:
    return density.density_peaks(density.density_rho_delta(v.matrix, PEAK_SCALE))


def _tree(v: Views):
    tree = trajectory.principal_tree(v.matrix, 10)
    placed = trajectory.project_cells(v.matrix, tree)
    typed = placed.join(v.matrix.select("cell_id", "louvain"), "cell_id")
    root = trajectory.root_vertex(typed, "louvain", 0).first()
    return tree, placed, root["vertex"] if root else 0


@query
def pseudotime(v: Views) -> DataFrame:
    tree, placed, root = _tree(v)
    return trajectory.pseudotime(placed, tree, root).select("cell_id", "vertex", "pseudotime")


@query
def trajectory_states(v: Views) -> DataFrame:
    tree, placed, root = _tree(v)
    return trajectory.trajectory_states(placed, tree, root).select("cell_id", "vertex", "state")


@query
def root_vertex(v: Views) -> DataFrame:
    return trajectory.root_vertex(v.matrix.withColumn("vertex", F.col("label")), "guide", CONTROL)


def _moran(v: Views) -> DataFrame:
    return spatial.morans_i(v.matrix, v.genes, _knn(v))


@query
def morans_i(v: Views) -> DataFrame:
    return _rounded(_moran(v), 6, "morans_i", "morans_test_statistic", "pval", "qval")


@query
def morans_top3(v: Views) -> DataFrame:
    out = spatial.top_spatial_genes(_moran(v)).select("gene", "morans_test_statistic")
    return _rounded(out, 6, "morans_test_statistic")


# --- differential tests ------------------------------------------------------------------------------------------


@query
def de_one_factor(v: Views) -> DataFrame:
    return _rounded(nested.de_one_factor(v.expr, "louvain"), 8, "pval", "qval")


@query
def de_inverse_gaussian(v: Views) -> DataFrame:
    return _rounded(nested.de_one_factor(v.expr_pos, "louvain", "inverse_gaussian"), 8, "pval", "qval")


@query
def de_nested(v: Views) -> DataFrame:
    """Cluster against cluster × a third of the cells: ten further means."""
    third = F.concat_ws("-", F.col("louvain").cast("string"), (F.col("cell_id") % 3).cast("string"))
    cells = v.timed.withColumn("third", third)
    reduced, extra = nested.factor_term(cells, "louvain"), nested.factor_term(cells, "third")
    return _rounded(nested.de_nested(v.expr, cells, [reduced], [extra]), 6, "pval", "qval")


@query
def de_nested_additive(v: Views) -> DataFrame:
    cells = v.timed
    louvain, guide = nested.factor_term(cells, "louvain"), nested.factor_term(cells, "guide")
    out = nested.de_nested(v.expr, cells, reduced=[louvain], extra=[guide])
    return _rounded(out, 6, "pval", "qval")


@query
def de_pseudotime(v: Views) -> DataFrame:
    return _rounded(nested.de_pseudotime(v.expr, v.timed, cutoff=None), 6, "pval", "qval")


@query
def branch_test(v: Views) -> DataFrame:
    return _rounded(nested.branch_test(v.expr, v.timed), 6, "pval", "qval")


@query
def ordering_genes(v: Views) -> DataFrame:
    return _rounded(nested.ordering_genes(nested.de_one_factor(v.expr, "louvain")), 8, "qval")


@query
def pseudotime_profile(v: Views) -> DataFrame:
    return _rounded(nested.pseudotime_profile(v.expr, v.timed), 6, "mean", "z")


@query
def gene_groups(v: Views) -> DataFrame:
    return nested.gene_groups(nested.pseudotime_profile(v.expr, v.timed), len(CLUSTERS))


@query
def branch_profile(v: Views) -> DataFrame:
    return _rounded(nested.pseudotime_profile(v.expr, v.timed, by=["branch"]), 6, "mean", "z")


@query
def de_one_factor_guide(v: Views) -> DataFrame:
    return _rounded(nested.de_one_factor(v.expr, "guide"), 6, "pval", "qval")


@query
def de_one_factor_cluster_guide(v: Views) -> DataFrame:
    both = v.expr.withColumn("cluster_guide", cluster_guide_key(F.col("louvain"), F.col("guide")))
    return _rounded(nested.de_one_factor(both, "cluster_guide"), 6, "pval", "qval")


@query
def de_nested_absorbed(v: Views) -> DataFrame:
    """Cluster against cluster and guide together, whose levels are absorbed."""
    cells = v.matrix.select("cell_id", "louvain", cluster_guide_key(F.col("louvain"), F.col("guide")).alias("cluster_guide"))
    louvain = nested.factor_term(cells, "louvain")
    out = nested.de_nested(v.expr, cells, [louvain], [], absorbed="cluster_guide", absorbed_in="full")
    return _rounded(out, 6, "pval", "qval")


# Clusters say little about genes in the fixture: at the usual 0.05 no gene is a marker.
MARKER_ALPHA = 0.99


@query
def cluster_markers(v: Views) -> DataFrame:
    return _rounded(nested.cluster_markers(v.expr, alpha=MARKER_ALPHA), 6, "pval", "qval")


# --- reading and searching what was laid out for it ---------------------------------------------------------------


def _written(v: Views, name: str) -> str:
    return f"{ensure_checkpoint_dir(v.spark)}/{name}-{uuid.uuid4().hex}"


@query
def genelist_cells_indexed(v: Views) -> DataFrame:
    index = gene_index.write_index(v.expr, v.matrix, _written(v, "gene-index"))
    return gene_index.cells_of_lists(index, v.gene_lists)


@query
def marker_list_enrichment(v: Views) -> DataFrame:
    """In which clusters do the cells lie that express all of a cluster's first two markers?"""
    markers = nested.cluster_markers(v.expr, 2, MARKER_ALPHA).select(F.col("louvain").alias("list_id"), "gene")
    index = gene_index.write_index(v.expr, v.matrix, _written(v, "gene-index"))
    return _rounded(gene_index.enriched_clusters(index, checkpointed(markers)), 6, "p_value")


@query
def expression_of_cells(v: Views) -> DataFrame:
    """The matrix joined with the cell sheet, both laid out on disk, for the cells of some guides in two clusters."""
    names = {}
    for name, table in (("matrix", v.expr.select("cell_id", "louvain", "gene", "value")), ("sheet", v.matrix.drop("values"))):
        names[name] = f"{name}_{uuid.uuid4().hex}"
        write_cell_table(table, names[name], _written(v, name), 8)
    wanted = F.col("guide").isin("G1.1", "G2.1") & (F.col("label") % 5 < 2)
    found = read_cells_with_expression(v.spark, names["matrix"], names["sheet"], wanted)
    return _rounded(found.select("cell_id", "louvain", "guide", "gene", "value"), 6, "value")


# --- from the matrix to genes along the tree and at its branches --------------------------------------------------


@dataclass
class _Chain:
    """Components of the cells, their tree, and every cell's place on it."""

    members: DataFrame
    timed: DataFrame


def _chain(v: Views) -> _Chain:
    points = checkpointed(components.pca_embedding(v.matrix, 20))
    tree = trajectory.principal_tree(points, 10)
    placed = checkpointed(trajectory.project_cells(points, tree))
    typed = placed.join(v.matrix.select("cell_id", "guide"), "cell_id")
    first = trajectory.root_vertex(typed, "guide", CONTROL).first()
    root = first["vertex"] if first else 0
    timed = trajectory.pseudotime(placed, tree, root).select("cell_id", "pseudotime")
    return _Chain(checkpointed(trajectory.branch_members(placed, tree, root)), checkpointed(timed))


@query
def trajectory_genes(v: Views) -> DataFrame:
    """Genes that change along the tree's pseudotime at q < 1e-4."""
    return _rounded(nested.de_pseudotime(v.expr, _chain(v).timed), 6, "pval", "qval")


@query
def branch_members(v: Views) -> DataFrame:
    return _chain(v).members


@query
def branch_tests(v: Views) -> DataFrame:
    return _rounded(nested.branch_tests(v.expr, _chain(v).members), 6, "pval", "qval")


@query
def branch_profiles(v: Views) -> DataFrame:
    """Profiles on every side of every branch point, of the genes that differ there at q < 1e-4."""
    members = _chain(v).members
    found = nested.branch_tests(v.expr, members, cutoff=1e-4).select("branch_point", "gene")
    profile = nested.pseudotime_profile(
        v.expr, members, by=["branch_point", "side"], within=["branch_point"], genes=v.genes
    )
    return profile.join(checkpointed(found), ["branch_point", "gene"], "left_semi")


@query
def fitted_curves(v: Views) -> DataFrame:
    """Spline curves along the tree's pseudotime of the genes that change along it."""
    timed = _chain(v).timed
    changing = checkpointed(nested.de_pseudotime(v.expr, timed).select("gene"))
    return curves.fitted_curves(v.expr.join(changing, "gene", "left_semi"), timed)


@query
def gene_tree_groups(v: Views) -> DataFrame:
    """Genes grouped by the tree of their fitted curves along a given pseudotime."""
    return curves.tree_groups(checkpointed(curves.fitted_curves(v.expr, v.timed)), len(CLUSTERS))


# --- the same on a matrix without its zeros ------------------------------------------------------------------------


def _sparse(name: str, *digits):
    def register(fn: Callable[[Views, DataFrame], DataFrame]):
        query(lambda v: _rounded(fn(v, v.sparse.long()), *digits) if digits else fn(v, v.sparse.long()), f"{name}_sparse")
        return fn

    return register


@_sparse("grand_mean", 6, "avg_tot")
def _(v: Views, expr: DataFrame) -> DataFrame:
    return expression.grand_mean(expr, v.matrix, v.genes)


@_sparse("genes_detected")
def _(v: Views, expr: DataFrame) -> DataFrame:
    return expression.genes_detected(expr, genes=v.genes)


@_sparse("cells_detected")
def _(v: Views, expr: DataFrame) -> DataFrame:
    return expression.cells_detected(expr, cells=v.matrix)


@_sparse("gene_detection_summary", 6, "min", "q1", "median", "q3", "max", "mean")
def _(v: Views, expr: DataFrame) -> DataFrame:
    return expression.gene_detection_summary(expression.genes_detected(expr, genes=v.genes))


@_sparse("size_factors", 6, "size_factor")
def _(v: Views, expr: DataFrame) -> DataFrame:
    return expression.size_factors(expr)


@_sparse("dispersion_table", 6, "mean", "variance", "dispersion")
def _(v: Views, expr: DataFrame) -> DataFrame:
    return expression.dispersion_table(expr, expression.size_factors(expr), v.genes)


@_sparse("de_one_factor", 8, "pval", "qval")
def _(v: Views, expr: DataFrame) -> DataFrame:
    return nested.de_one_factor(expr, "louvain", cells=v.matrix, genes=v.genes)


@_sparse("de_nested", 6, "pval", "qval")
def _(v: Views, expr: DataFrame) -> DataFrame:
    third = F.concat_ws("-", F.col("louvain").cast("string"), (F.col("cell_id") % 3).cast("string"))
    cells = v.timed.withColumn("third", third)
    reduced, extra = nested.factor_term(cells, "louvain"), nested.factor_term(cells, "third")
    return nested.de_nested(expr, cells, [reduced], [extra], genes=v.genes)


@_sparse("de_pseudotime", 6, "pval", "qval")
def _(v: Views, expr: DataFrame) -> DataFrame:
    return nested.de_pseudotime(expr, v.timed, cutoff=None, genes=v.genes)


@_sparse("branch_test", 6, "pval", "qval")
def _(v: Views, expr: DataFrame) -> DataFrame:
    return nested.branch_test(expr, v.timed, genes=v.genes)


@_sparse("pseudotime_profile", 6, "mean", "z")
def _(v: Views, expr: DataFrame) -> DataFrame:
    return nested.pseudotime_profile(expr, v.timed, genes=v.genes)


@_sparse("branch_profile", 6, "mean", "z")
def _(v: Views, expr: DataFrame) -> DataFrame:
    return nested.pseudotime_profile(expr, v.timed, by=["branch"], genes=v.genes)
