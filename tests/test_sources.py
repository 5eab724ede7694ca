import datetime as dt

import pytest
from pyspark.sql import functions as F

from guidescape import runtime
from guidescape.operators import components
from guidescape.sources import (
    export_obs,
    marker_subset,
    read_cells,
    read_cluster_genes,
    read_expression,
    read_feature_lists,
    read_guide_genes,
    snapshot,
    write_expression,
    write_result,
)


def test_cell_sheet_round_trip(spark, tmp_path):
    path = tmp_path / "cells.csv"
    path.write_text(
        "index,louvain,guide_cov,donor_cov,well_cov,numi_cov,multiplet_cov,nsnp_cov,percent_mito,n_counts\n"
        "c1,3,ABC.1.x,d1,w1,12.5,sng,20,0.01,100\nc2,0,NA,d2,w1,7,sng,21,0.02,90\n"
    )
    cells = read_cells(spark, str(path))
    assert dict(cells.dtypes)["louvain"] == "int" and dict(cells.dtypes)["nsnp_cov"] == "bigint"
    export_obs(cells, str(tmp_path / "out"))
    again = read_cells(spark, str(tmp_path / "out"))
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, cells.collect()))
    assert {r["guide_cov"] for r in cells.collect()} == {"ABC.1.x", None}


def test_association_files(spark, tmp_path):
    full, short, clusters, lists = (tmp_path / n for n in ("a.txt", "b.txt", "c.txt", "d.txt"))
    full.write_text("gene\tcluster\tfdr\tother\nx\tA.1\t0.03\t1\n")
    short.write_text("cluster\tgene\nA.1\tx\n")
    clusters.write_text("cluster\tgene\n4\tx\n")
    lists.write_text("cluster\tenriched\tdepleted\n1\tA.1,B.2\tC.1\n")
    assert tuple(read_guide_genes(spark, str(full)).first()) == ("A.1", "x", 0.03)
    assert tuple(read_guide_genes(spark, str(short)).first()) == ("A.1", "x", None)
    assert tuple(read_cluster_genes(spark, str(clusters)).first()) == (4, "x")
    assert tuple(read_feature_lists(spark, str(lists)).first()) == (1, "A.1,B.2", "C.1")


def test_matrix_reads_only_wanted_clusters(spark, tmp_path):
    df = spark.range(30).select(
        F.col("id").alias("cell_id"), (F.col("id") % 3).cast("int").alias("louvain"), F.lit("g").alias("gene"), F.rand(1).alias("value")
    )
    write_expression(df, str(tmp_path / "m"))
    part = read_expression(spark, str(tmp_path / "m"), [0, 2])
    assert part.count() == 20
    assert "PartitionFilters: [louvain" in part._jdf.queryExecution().toString().replace("isnotnull(louvain), ", "")


def test_results_and_snapshots(spark, tmp_path):
    df = spark.createDataFrame([(1, "a")], "n int, s string")
    path = write_result(df, str(tmp_path), "p-vals", dt.date(2020, 1, 2))
    assert path.endswith("2020-01-02_p-vals")
    assert spark.read.csv(path, header=True).first()["s"] == "a"
    assert snapshot(df, str(tmp_path / "snap")).first()["n"] == 1


def test_marker_subset(spark):
    cells = spark.range(50).withColumnRenamed("id", "cell_id")
    expr = cells.withColumn("gene", F.explode(F.array(F.lit("a"), F.lit("b"), F.lit("c")))).withColumn("value", F.lit(1.0))
    got = marker_subset(expr, cells, ["a", "c"], 10).toPandas()
    assert len(got) == 20 and set(got["gene"]) == {"a", "c"} and got["cell_id"].nunique() == 10


def test_components_are_centred(spark):
    rows = [(i, [100.0 + i, 50.0 - 2 * i, 7.0]) for i in range(20)]
    df = spark.createDataFrame(rows, "cell_id long, values array<double>")
    shares = [r["explained"] for r in components.pc_variance(df, 2).collect()]
    assert shares[0] == pytest.approx(1.0)
    placed = components.pca_embedding(df, 1).toPandas()["values"].str[0]
    assert placed.mean() == pytest.approx(0.0, abs=1e-9)
    assert placed.std() == pytest.approx((5**0.5) * 5.916079783, rel=1e-6)


def test_salted_lookup_equals_plain_join(spark):
    facts = spark.range(1000).select(F.when(F.col("id") < 700, 0).otherwise(F.col("id") % 9).alias("k"), "id")
    lookup = spark.createDataFrame([(k, f"v{k}") for k in range(7)], "k long, v string")
    for how in ("inner", "left"):
        a = sorted(runtime.salted_lookup(facts, lookup, ["k"], how).select("id", "v").collect())
        b = sorted(facts.join(lookup, "k", how).select("id", "v").collect())
        assert a == b


def test_hot_keys_are_split_and_nothing_is_lost(spark, monkeypatch):
    monkeypatch.setattr(runtime, "ROWS_PER_TASK", 100)
    facts = spark.range(1000).select(F.when(F.col("id") < 700, 0).otherwise(F.col("id") % 9).alias("k"), "id")
    lookup = spark.createDataFrame([(k, f"v{k}") for k in range(7)], "k long, v string")
    hot = runtime.hot_keys_of(facts, ["k"])
    assert [tuple(r) for r in hot.collect()] == [(0, 8)]
    for how in ("inner", "left"):
        a = sorted(runtime.hot_lookup(facts, lookup, ["k"], hot, how).select("id", "v").collect())
        b = sorted(facts.join(lookup, "k", how).select("id", "v").collect())
        assert a == b


def test_checkpoint_folder_of_the_session_wins(spark):
    runtime.ensure_checkpoint_dir(spark)
    before = spark.sparkContext.getCheckpointDir()
    runtime.ensure_checkpoint_dir(spark)
    assert spark.sparkContext.getCheckpointDir() == before
