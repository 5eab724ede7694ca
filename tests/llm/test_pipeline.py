"""The corpus pipeline on the smallest tables: every stage's input, columns and effect."""

import corpus_pipeline
from guidescape.llm import line_dedup, ngram_join, quality, toxicity

FOLDER = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns = docs.dtypes
    held = {"start": docs}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, FOLDER).write.parquet(str(tmp_path / name))
        docs = held[name] = spark.read.parquet(str(tmp_path / name))
    assert all(held[n].dtypes == columns for n in ("quality_rules", "toxicity", "line_dedup", "ngram_join"))
    ids = {n: [r["doc_id"] for r in df.select("doc_id").collect()] for n, df in held.items()}
    passed = {r["doc_id"] for r in quality.apply_policy(quality.ledger(held["start"])).where("kept").collect()}
    assert set(ids["quality_rules"]) == passed
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    toxic = {r["doc_id"] for r in toxicity.toxicity(held["quality_rules"], labels).where("predicted = 1").collect()}
    assert toxic and set(ids["toxicity"]) == passed - toxic
    shorter = line_dedup.line_dedup(held["toxicity"]).collect()
    left = [r["doc_id"] for r in shorter if not r["n_dropped"] or (r["text"] or "").split()]
    assert sorted(ids["line_dedup"]) == sorted(left)
    assert all((r["text"] or "").split() for r in held["packing"].join(held["line_dedup"].select("doc_id", "text"), "doc_id").collect())
    groups = ngram_join.ngram_components(held["line_dedup"], 5, 80).collect()
    assert sorted(ids["ngram_join"]) == sorted(r["doc_id"] for r in groups if r["doc_id"] == r["component_id"])
    assert sorted(ids["packing"]) == sorted(ids["ngram_join"])
