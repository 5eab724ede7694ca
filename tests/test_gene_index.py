"""The gene index against a scan, markers against single tests, and laid-out tables against plain joins."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from guidescape.operators import expression, gene_index, nested
from guidescape.sources import read_cells_with_expression, write_cell_table


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(41)
    n, genes = 400, 8
    x = np.where(rng.random((n, genes)) < 0.6, rng.random((n, genes)), 0.0)
    x[:, 1] += (np.arange(n) % 4 == 2) * 0.5
    cells = pd.DataFrame({"cell_id": [f"c{i:03d}" for i in range(n)], "louvain": np.arange(n) % 4, "donor": np.arange(n) % 3})
    long = pd.concat([cells.assign(gene=f"g{j}", value=x[:, j]) for j in range(genes)])
    return spark.createDataFrame(long), spark.createDataFrame(cells), x, cells


def test_index_finds_what_a_scan_finds(spark, data, tmp_path):
    expr, cells, *_ = data
    index = gene_index.write_index(expr, cells, str(tmp_path / "index"))
    lists = [(0, "g0"), (0, "g1"), (0, "g1"), (1, "g2"), (1, "g3"), (1, "g4"), (2, "g5"), (2, "unknown"), (3, "g6")]
    lists = spark.createDataFrame(lists, "list_id int, gene string")
    scan = expression.genelist_cells(expr, lists)
    found = gene_index.cells_of_lists(index, lists)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, scan.collect()))
    a = expression.genelist_enrichment(scan, cells).toPandas().sort_values(["list_id", "louvain"]).reset_index(drop=True)
    b = gene_index.enriched_clusters(index, lists).toPandas().sort_values(["list_id", "louvain"]).reset_index(drop=True)
    pd.testing.assert_frame_equal(a, b[a.columns])


def test_search_does_not_read_the_matrix(spark, data, tmp_path):
    expr, cells, *_ = data
    expr.write.parquet(str(tmp_path / "matrix"))
    index = gene_index.write_index(spark.read.parquet(str(tmp_path / "matrix")), cells, str(tmp_path / "index"))
    lists = spark.createDataFrame([(0, "g0"), (0, "g1")], "list_id int, gene string")
    for found in (gene_index.cells_of_lists(index, lists), gene_index.enriched_clusters(index, lists)):
        files = found.inputFiles()
        assert files and not any("/matrix/" in f for f in files)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_more_cells_than_one_stretch(spark, tmp_path):
    cells = spark.range(100_000).select(F.col("id").alias("cell_id"), (F.col("id") % 2).cast("int").alias("louvain"))
    expr = cells.withColumn("gene", F.explode(F.array(F.lit("a"), F.lit("b")))).withColumn(
        "value", F.when((F.col("gene") == "a") | (F.col("cell_id") % 7 == 0), 1.0).otherwise(0.0)
    )
    index = gene_index.write_index(expr, cells, str(tmp_path / "index"))
    lists = spark.createDataFrame([(0, "a"), (0, "b")], "list_id int, gene string")
    found = {r["cell_id"] for r in gene_index.cells_of_lists(index, lists).collect()}
    assert found == set(range(0, 100_000, 7))
    counts = {r["louvain"]: r["n"] for r in gene_index.enriched_clusters(index, lists).collect()}
    assert counts == {0: 7143, 1: 7143}


@pytest.mark.parametrize("zeros", [True, False])
def test_markers_equal_one_test_after_another(data, zeros):
    expr, cells, x, frame = data
    got = nested.cluster_markers(expr, k=8, alpha=2.0) if zeros else nested.cluster_markers(expr.where("value <> 0"), 8, 2.0, cells)
    got = got.toPandas().set_index(["louvain", "gene"])
    for c in range(4):
        inside = frame["louvain"].to_numpy() == c
        sides = expr.withColumn("side", (F.col("louvain") == c).cast("int"))
        want = nested.de_one_factor(sides, "side").toPandas().set_index("gene")
        up = [f"g{j}" for j in range(8) if x[inside, j].mean() > x[~inside, j].mean()]
        assert set(got.loc[c].index) == set(up)
        for g in up:
            assert got.loc[(c, g), "pval"] == pytest.approx(want.loc[g, "pval"], rel=1e-8)
            assert got.loc[(c, g), "qval"] == pytest.approx(want.loc[g, "qval"], rel=1e-8)
    best = nested.cluster_markers(expr, k=1).toPandas()
    assert best[best["louvain"] == 2]["gene"].tolist() == ["g1"]


def test_laid_out_tables_join_in_place_and_prune(spark, data, tmp_path):
    expr, cells, *_ = data
    write_cell_table(expr.select("cell_id", "louvain", "gene", "value"), "t_matrix", str(tmp_path / "m"), 4)
    write_cell_table(cells, "t_sheet", str(tmp_path / "s"), 4)
    wanted = (F.col("donor") == 1) & (F.col("cell_id") < "c050")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        found = read_cells_with_expression(spark, "t_matrix", "t_sheet", wanted)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "dynamicpruning" in plan
        join = plan[plan.index("SortMergeJoin") :]
        assert "Exchange hashpartitioning(cell_id" not in join
        rows = sorted(map(tuple, found.select("cell_id", "louvain", "donor", "gene", "value").collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        spark.sql("drop table t_matrix")
        spark.sql("drop table t_sheet")
    plain = expr.where(wanted).select("cell_id", "louvain", "donor", "gene", "value")
    assert rows == sorted(map(tuple, plain.collect()))
