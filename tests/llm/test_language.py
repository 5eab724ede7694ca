"""Language filters: members against plain sets, held-out accuracy, nulls, blanks, long texts, ties, repeats, extra columns."""

from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from guidescape.llm import language

SCHEMA = "doc_id long, text string, lang string, lang_pred string, score string, _p int"
FOLDER = "/root/testdata/sf0.01"


def windows(text):
    """The same n-grams, cut word by word."""
    words = "".join(c if c.isalpha() else " " for c in text.lower()).split()
    return [w[i : i + n] for n in (3, 4) for w in (f"\0{x}\0" for x in words) for i in range(len(w) - n + 1)]


def test_grams_are_those_of_the_words():
    for text in ("Ab cde, FGHI. a", "élan où 中文 x1y", "a", "x" * 50):
        keys, plain = language.grams(text), windows(text)
        assert len(keys) == len(plain)
        assert sorted(Counter(keys.tolist()).values()) == sorted(Counter(plain).values())
    assert len(language.grams(None)) == len(language.grams("12 ,.\n")) == len(language.grams("")) == 0


def test_long_texts_are_read_to_their_end():
    words = " ".join(f"{'abcdefghij'[i % 10]}{'klmnop'[i % 6]}" for i in range(200_000))
    assert len(language.grams(words)) == len(windows(words))
    assert len(language.grams("y" * 700_000)) >= 2 * 700_000 - 20


@pytest.fixture(scope="module")
def corpus(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text", "lang")
    return docs, language.fit(docs)


def test_filter_holds_what_brute_force_says(corpus):
    docs, filters = corpus
    rows = language.learnt_texts(docs).collect()
    share, times, n = defaultdict(Counter), defaultdict(Counter), Counter(r["lang"] for r in rows)
    for r in rows:
        for k in set(language.grams(r["text"]).tolist()):
            share[k][r["lang"]] += 1 / n[r["lang"]]
            times[k][r["lang"]] += 1
    keys = np.array(list(share), np.uint64)
    held = filters.holding(keys)[:, 0]
    wrong = 0
    for k, mask in zip(keys.tolist(), held.tolist()):
        most = max(share[k].values())
        for i, name in enumerate(filters.languages):
            ratio = share[k][name] / most
            member = times[k][name] >= 2 and ratio >= language.HOME
            if member and ratio > language.HOME + 1e-9:
                assert mask >> i & 1
            wrong += bool(mask >> i & 1) and not member
    assert wrong <= len(keys) * filters.chance.max() * len(filters.languages) + 10


def test_false_positives_are_taken_off():
    full = np.zeros((language.SLOTS, 1), np.uint8)
    full[:, 0] = np.where(np.arange(language.SLOTS) % 2 == 0, 2, 0)  # the second language's half-full filter holds nothing real
    keys = language.grams("only a few words of this text and then some more of them " * 200)
    for j in range(language.HASHES):
        full[language.slots(keys, j), 0] |= 1
    filters = language.Filters(["real", "noise"], full)
    n, held = filters.counts("only a few words of this text and then some more of them " * 200)
    assert held[0] > 0.99 * n and held[1] < 0.2 * n


def test_held_out_accuracy(corpus):
    docs, filters = corpus
    found = language.identify(docs, filters).join(docs, "doc_id")
    right = found.groupBy("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")).alias("right"))
    assert all(r["right"] > 0.98 for r in right.collect())


def test_edge_cases(spark):
    rows = [(i, "der kleine hund und die katze", "de", "x", "y", 1) for i in range(8)]
    rows += [(i, "the little dog and that cat", "en", None, None, None) for i in range(8, 16)]
    rows += [rows[0], (None, "the dog and the cat", "en", None, None, None), (None, None, None, None, None, None)]
    rows += [(50, None, "en", None, None, None), (51, "", "de", None, None, None), (52, "12, 13 ...", "de", None, None, None)]
    rows += [(53, "中文 中文", None, None, None, None), (54, "и кот", None, None, None, None)]
    rows += [(55, "the dog " * 100_000, "de", None, None, None), (8, "hund " * 9, "en", None, None, None)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    found = [(r["doc_id"], r["lang_pred"], r["score"]) for r in language.language_id(docs).collect()]
    assert len(found) == len(rows)
    by_id = defaultdict(set)
    for i, lang, score in found:
        assert 0 <= score <= 1
        by_id[i].add(lang)
    assert by_id[0] == {"de"} and by_id[9] == {"en"} and by_id[8] == {"en", "de"}
    assert by_id[50] == by_id[51] == by_id[52] == {"und"} and by_id[None] == {"en", "und"}
    assert by_id[53] == by_id[54] and len(by_id[53]) == 1 and "und" not in by_id[53]
    assert by_id[55] == {"en"}


def test_nothing_to_learn_from(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert language.language_id(empty).collect() == []
    some = spark.createDataFrame([(1, "words without a language", None, None, None, None)], SCHEMA)
    assert [(r["lang_pred"], r["score"]) for r in language.language_id(some).collect()] == [("und", 0.0)]


def test_sample_is_bounded_for_each_language(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("a b").alias("text"), F.lit("en").alias("lang"))
    docs = docs.unionByName(docs.where("doc_id % 3 = 0")).unionByName(docs.withColumn("lang", F.lit("fr")))
    n = {r["lang"]: r["count"] for r in language.learnt_texts(docs, 100).groupBy("lang").count().collect()}
    assert n == {"en": 100, "fr": 100}
