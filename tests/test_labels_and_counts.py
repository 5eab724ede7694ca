import pytest
from pyspark.sql import functions as F

from guidescape.functions import default_control, parse_guide
from guidescape.operators import clean, counts, reshape, sets, topk


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def test_guide_labels(spark):
    labels = ["ABC.12.x", "0", None, "ABC", "é1.2", "A-1.2"]
    df = spark.createDataFrame([(v,) for v in labels], "label string")
    out = df.select("label", parse_guide(F.col("label")).alias("p"), default_control(parse_guide(F.col("label"))).alias("g"))
    got = {r["label"]: (r["p"], r["g"]) for r in out.collect()}
    assert got["ABC.12.x"] == ("ABC.12", "ABC.12")
    assert got["é1.2"] == ("é1.2", "é1.2")
    for label in ("0", None, "ABC", "A-1.2"):
        assert got[label] == (None, "0")


def test_tidy_feats_edges(spark):
    df = spark.createDataFrame(
        [("0", "A,B,"), ("1", ""), ("2", None), ("3", "A,A"), ("4", "A,,C")], "cluster string, enriched string"
    )
    assert rows(reshape.tidy_feats(df, "enriched"), "louvain", "guide") == sorted(
        [(0, "A"), (0, "B"), (2, None), (3, "A"), (3, "A"), (4, "A"), (4, "C")], key=repr
    )


def test_pairs_are_never_confused_by_concatenation(spark):
    cells = spark.createDataFrame([(1, 0, "A1"), (2, 0, "A12"), (3, 0, "A12")], "cell_id long, louvain int, guide string")
    pairs = spark.createDataFrame([("A1", "2B"), ("A12", "B")], "guide string, gene string")
    got = rows(counts.guide_gene_totals(cells, pairs), "guide", "gene", "n")
    assert got == [("A1", "2B", 1), ("A12", "B", 2)]


def test_duplicate_associations_inflate_counts(spark):
    cells = spark.createDataFrame([(1, 0, "A"), (2, 1, "A")], "cell_id long, louvain int, guide string")
    pairs = spark.createDataFrame([("A", "x"), ("A", "x")], "guide string, gene string")
    hits = counts.guide_gene_hits(counts.cluster_guide_counts(cells), pairs)
    assert rows(hits, "louvain", "n") == [(0, 2), (1, 2)]


def test_control_share_without_control_cells(spark):
    cells = spark.createDataFrame([(0, "0"), (0, "A"), (1, "A")], "louvain int, guide string")
    assert rows(counts.control_share(cells), "louvain", "share") == [(0, 0.5), (1, 0.0)]


def test_coverage_counts_distinct_cells(spark):
    cells = spark.createDataFrame([(1, "A"), (1, "A"), (2, "0"), (3, "B"), (4, "A")], "cell_id long, guide string")
    pairs = spark.createDataFrame([("A", "x"), ("A", "y")], "guide string, gene string")
    out = counts.guide_coverage(cells, pairs).first()
    assert (out["covered"], out["not_control"]) == (0.5, 0.75)


def test_features_of_one_cluster_only(spark):
    df = spark.createDataFrame([(0, "a"), (0, "a"), (0, "b"), (1, "b"), (2, "c")], "louvain int, gene string")
    assert rows(sets.not_shared_feats(df, "gene"), "louvain", "gene") == [(0, "a"), (2, "c")]


def test_wide_features_are_padded_and_come_back(spark):
    df = spark.createDataFrame([(0, "a"), (0, "d"), (2, "c")], "louvain int, guide string")
    wide = reshape.unique_feats_wide(df, "guide", [0, 1, 2])
    assert rows(wide, "row", "cluster_0", "cluster_1", "cluster_2") == [(1, "a", None, "c"), (2, "d", None, None)]
    back = reshape.wide_to_long(wide, [0, 1, 2], "guide")
    assert [tuple(r) for r in back.collect()] == [(0, "a"), (0, "d"), (2, "c")]


def test_supra_join_keeps_duplicates_and_matches_plain_joins(spark):
    cells = spark.createDataFrame(
        [(i, i % 3, "A" if i % 2 else "B") for i in range(30)], "cell_id long, louvain int, guide string"
    )
    pairs = spark.createDataFrame([("A", "x"), ("A", "x"), ("A", "y"), ("B", "y")], "guide string, gene string")
    own = spark.createDataFrame([(0, "x"), (1, "y"), (1, "z"), (2, "x"), (2, "x")], "cluster int, gene string")
    plain = cells.join(pairs, "guide").join(own, "gene").where("louvain = cluster")
    names = ("cell_id", "louvain", "guide", "gene")
    assert rows(sets.supra_join(cells, pairs, own), *names) == rows(plain, *names)
    direct = plain.groupBy("louvain", "gene").count().withColumnRenamed("count", "n")
    assert rows(topk.cluster_gene_counts(cells, pairs, own), "louvain", "gene", "n") == rows(direct, "louvain", "gene", "n")


def test_top_k_breaks_ties_by_name_and_does_not_pad(spark):
    table = spark.createDataFrame([(0, "b", 2), (0, "a", 2), (0, "c", 5), (1, "z", 1)], "louvain int, guide string, n long")
    got = rows(topk.top_per_cluster(table, "guide", 2), "louvain", "guide", "rank")
    assert got == [(0, "a", 2), (0, "c", 1), (1, "z", 1)]


def test_lump_other_treats_null_as_other(spark):
    df = spark.createDataFrame([(1, "A"), (2, None), (3, "B")], "cell_id long, guide string")
    keep = spark.createDataFrame([("A",), ("A",)], "guide string")
    assert rows(clean.lump_other(df, "guide", keep), "cell_id", "lumped") == [(1, "A"), (2, "other"), (3, "other")]


def test_priority_order_puts_listed_values_last(spark):
    cells = spark.createDataFrame([(1, "A"), (2, "B"), (3, "C"), (4, "A")], "cell_id long, guide string")
    coords = spark.createDataFrame([(i, float(i), 0.0) for i in (4, 3, 2, 1)], "cell_id long, dim1 double, dim2 double")
    out = clean.priority_feature_reorder(cells, coords, "guide", ["B", "A"]).collect()
    assert [(r["cell_id"], r["priority_reorder"], r["dim1"]) for r in out] == [
        (3, "other", 3.0),
        (2, "B", 2.0),
        (1, "A", 1.0),
        (4, "A", 4.0),
    ]


@pytest.mark.parametrize("filled", [True, False])
def test_profile_matrix_completes_the_axis(spark, filled):
    axis = spark.createDataFrame([("0",), ("A",), ("B",)], "guide string")
    profile = spark.createDataFrame([(0, "A", 2.0), (1, "A", 3.0), (1, "B", 5.0)], "louvain int, guide string, x double")
    fill = spark.createDataFrame([(0, 7.0), (1, 9.0)], "louvain int, avg double") if filled else None
    out = reshape.cluster_profile_matrix(axis, profile, "x", [0, 1], fill)
    a, b = (7.0, 9.0) if filled else (0.0, 0.0)
    assert rows(out, "guide", "cluster_0", "cluster_1") == [("0", a, b), ("A", 2.0, 3.0), ("B", a, 5.0)]


def test_column_mean_fill(spark):
    axis = spark.createDataFrame([("A",), ("B",), ("C",)], "guide string")
    means = spark.createDataFrame(
        [(0, "A", "g", 1.0), (0, "B", "g", 3.0), (1, "C", "g", 99.0)], "louvain int, guide string, gene string, value double"
    )
    got = rows(reshape.column_mean_fill(axis, means, 0), "guide", "gene", "value")
    assert got == [("A", "g", 1.0), ("B", "g", 3.0), ("C", "g", 2.0)]


def test_matrix_forms_convert_both_ways(spark):
    genes = spark.createDataFrame([(0, "a"), (1, "b")], "pos int, gene string")
    wide = spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0, 4.0])], "cell_id long, values array<double>")
    long = reshape.expression_long(wide, genes)
    assert rows(long, "cell_id", "gene", "value") == [(1, "a", 1.0), (1, "b", 2.0), (2, "a", 3.0), (2, "b", 4.0)]
    assert rows(reshape.expression_wide(long, genes), "cell_id", "values") == rows(wide, "cell_id", "values")
