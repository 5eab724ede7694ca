"""N-gram Jaccard self-join of documents as a blocked sparse matrix product.

A document is the set of its distinct 4-word shingles; two documents link when the Jaccard similarity of their sets reaches a
threshold. The document × n-gram matrix is multiplied with its transpose column by column, but only in the columns where a
linked pair must meet: with all n-grams in one global order, linked sets of size x share an n-gram among the first
x - ⌈t·x⌉ + 1 of each. The order puts n-grams by their corpus frequency, estimated in a counting sketch of fixed size over all
documents, so common passages come last and hardly ever form a column. Any order is exact; the sketch only saves work. It has
four million classes: a passage that fewer documents share than a class has n-grams by chance is not told from rare ones.

Two bounds that follow from the sizes discard pairs without losing a link. Inside a column, sets are blocked into 256 classes
by hash; every class where the parities of two sets differ holds an n-gram of one set only, so too many such classes rule the
pair out before it is emitted. Then overlap counts are accumulated per pair over its columns, and pairs whose count plus what
the sizes still allow stays below the required overlap go. The rest are verified on whole sets.

Equal sets are collapsed first. A column with few documents multiplies in full. In a column with many, each round compares all
documents with a few pivots, those with the fewest rare n-grams, and merges what links; only columns that still hold different
components go on, with new pivots. After ``ROUNDS`` rounds the remaining columns multiply in full between different components, so no link is lost.

Null, blank and empty texts have empty sets and link with nothing. What is linked are sets, under numbers of their own, so rows
without an id and texts that share one link like all others; ids only name components. Repeated rows share one answer; a row
without id never names a component, and one linked to none but such rows has a null component. Columns other than doc_id and
text are not read. Sets hold 64-bit hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from guidescape.llm.components import connected
from guidescape.llm.membership import bitmap, passing
from guidescape.llm.text import as_long, shingle_set, word_hashes
from guidescape.runtime import checkpointed, discard_shuffles, importable, release

N = 4
PERCENT = 85
SKETCH = 1 << 22
BLOCK = 1 << 13  # classes that are summed together
SMALL = 16
PIVOTS = 2
ROUNDS = 2
PARITIES = ["p0", "p1", "p2", "p3"]


def _sketch(docs: DataFrame, n: int) -> np.ndarray:
    """Counts of all distinct (document, n-gram) pairs in ``SKETCH`` hash classes, as steps of an eighth of a power of two.

    Every task counts in an array of its own; its blocks are summed over the tasks where the shuffle brings them together.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, waiting, n_waiting = np.zeros(SKETCH, np.uint32), [], 0
        for pdf in batches:
            for text in pdf["text"]:
                waiting.append((shingle_set(word_hashes(text), n) & np.uint64(SKETCH - 1)).astype(np.int32))
                n_waiting += len(waiting[-1])
                if n_waiting > SKETCH:
                    held += np.bincount(np.concatenate(waiting), minlength=SKETCH).astype(np.uint32)
                    waiting, n_waiting = [], 0
        if waiting:
            held += np.bincount(np.concatenate(waiting), minlength=SKETCH).astype(np.uint32)
        # all low bytes before all high ones: nearly all of the latter are zero
        planes = held.view(np.uint8).reshape(-1, BLOCK, 4).transpose(0, 2, 1)
        yield pd.DataFrame({"block": np.arange(len(planes)), "counts": [x.tobytes() for x in planes]})

    def total(key: tuple, parts: pd.DataFrame) -> pd.DataFrame:
        counts = np.zeros(BLOCK, np.int64)
        for raw in parts["counts"]:
            counts += np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, BLOCK).T).view(np.uint32).ravel()
        steps = np.where(counts > 0, 1 + 8 * np.log2(np.maximum(counts, 1)), 0).astype(np.uint8)
        return pd.DataFrame({"block": [key[0]], "steps": [steps.tobytes()]})

    rows = docs.select("text").mapInPandas(count, "block int, counts binary")
    out = np.zeros((SKETCH // BLOCK, BLOCK), np.uint8)
    for row in rows.groupBy("block").applyInPandas(total, "block int, steps binary").toLocalIterator():
        out[row["block"]] = np.frombuffer(row["steps"], np.uint8)
    return out.ravel()


def required(x: Column, y: Column, percent: int) -> Column:
    """The least overlap of linked sets of sizes x and y: 100·o ≥ p·(x + y - o)."""
    return F.ceil(F.lit(percent) * (x + y) / F.lit(100 + percent))


def prefix_length(size: int, percent: int) -> int:
    """Of an ordered set of this size, so many elements hold one in common with every linked set."""
    return size - -(-percent * size // 100) + 1


def _text_key() -> Column:
    return F.unhex(F.md5(F.col("text").cast("binary"))).alias("text_key")


def describe(docs: DataFrame, n: int = N, percent: int = PERCENT) -> DataFrame:
    """doc_id, text_key, size (of its set), set_a and set_b (a 128-bit hash of the set), p0 to p3 (parities of its 256
    blocks), prefix (n-grams of the columns it enters)."""
    sketch = importable(docs.sparkSession).sparkContext.broadcast(_sketch(docs, n))

    def prefixes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            sizes, prints, parities, firsts = [], [], [], []
            for text in pdf["text"]:
                found = shingle_set(word_hashes(text), n)
                sizes.append(len(found))
                prints.append(_fingerprint(found))
                parities.append(_parities(found))
                take = prefix_length(len(found), percent) if len(found) else 0
                seen = sketch.value[found & np.uint64(SKETCH - 1)]
                firsts.append(as_long(found[np.lexsort((found, seen))[:take]]))
            out = pdf[["doc_id", "text_key"]].assign(size=np.array(sizes, np.int64))
            out[["set_a", "set_b"]] = np.array(prints, np.int64).reshape(-1, 2)
            out[PARITIES] = np.array(parities, np.int64).reshape(-1, len(PARITIES))
            yield out.assign(prefix=pd.Series(firsts, dtype=object))

    # The id travels as text: pandas has no 64-bit integers beside nulls.
    rows = docs.select(F.col("doc_id").cast("string"), _text_key(), "text")
    longs = ", ".join(f"{name} long" for name in ["size", "set_a", "set_b", *PARITIES])
    found = rows.mapInPandas(prefixes, f"doc_id string, text_key binary, {longs}, prefix array<long>")
    return found.withColumn("doc_id", F.col("doc_id").cast("long"))


def _fingerprint(found: np.ndarray) -> tuple[int, int]:
    return tuple(np.frombuffer(hashlib.blake2b(found.tobytes(), digest_size=16).digest(), np.int64))


def _parities(found: np.ndarray) -> np.ndarray:
    odd = np.bincount((found >> np.uint64(56)).astype(np.int64), minlength=256) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _verified(pairs: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole sets reach the threshold."""

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            keep, last, held = [], None, None
            for a, s, t in zip(pdf["a"], pdf["s"], pdf["t"]):
                if a != last:
                    last, held = a, shingle_set(word_hashes(s), n)
                other = shingle_set(word_hashes(t), n)
                both = len(np.intersect1d(held, other, assume_unique=True))
                keep.append(100 * both >= percent * (len(held) + len(other) - both))
            yield pdf.loc[np.array(keep, bool), ["a", "b"]]

    def side(end: str, name: str) -> DataFrame:
        met = passing(texts, bitmap(pairs.select(F.col(end).alias("id")), ["id"]), ["id"], "_met").where("_met")
        return met.select(F.col("id").alias(end), F.col("text").alias(name))

    whole = pairs.select("a", "b").join(side("a", "s"), "a").join(side("b", "t"), "b")
    return whole.select("a", "s", "b", "t").mapInPandas(check, "a long, b long")


def _candidates(met: DataFrame, elsewhere: DataFrame, percent: int) -> DataFrame:
    """Pairs from column meetings (a, x, i, b, y, j: ids, set sizes, places of the n-gram), with counts accumulated.

    Common n-grams beyond those counted are either behind the last counted place, where the shorter remainder bounds them,
    or in prefix columns that are not in this product: ``elsewhere`` has their number per document (id, other).
    """
    pairs = met.groupBy("a", "b", "x", "y").agg(
        F.count(F.lit(1)).alias("seen"), F.max("i").alias("i"), F.max("j").alias("j")
    )
    for name in ("a", "b"):
        pairs = pairs.join(elsewhere.select(F.col("id").alias(name), F.col("other").alias(f"{name}_other")), name, "left")
    other = F.coalesce(F.least(*[F.coalesce(f"{name}_other", F.lit(0)) for name in ("a", "b")]), F.lit(0))
    still = F.least(F.col("x") - F.col("i"), F.col("y") - F.col("j")) - 1
    enough = pairs.where(F.col("seen") + other + still >= required(F.col("x"), F.col("y"), percent))
    return enough.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _fits(percent: int) -> Column:
    """What sizes and blocks of both sets allow: linked sets differ in at most (100 - p)/(100 + p) of x + y n-grams."""
    apart = sum((F.bit_count(F.col(f"a_{p}").bitwiseXOR(F.col(f"b_{p}"))) for p in PARITIES), F.lit(0))
    sizes = 100 * F.least("x", "y") >= percent * F.greatest("x", "y")
    return sizes & ((100 + percent) * apart <= (100 - percent) * (F.col("x") + F.col("y")))


def ngram_components(docs: DataFrame, n: int = N, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by links, itself included), set_copies."""
    rows = checkpointed(describe(docs, n, percent))
    key = ["set_a", "set_b"]
    classes = rows.groupBy(*key, "size").agg(
        F.min("doc_id").alias("first"),
        F.count(F.lit(1)).alias("copies"),
        F.min("text_key").alias("text_key"),
        *(F.min(p).alias(p) for p in PARITIES),
    )
    classes = checkpointed(classes.withColumn("id", F.monotonically_increasing_id()))
    entries = rows.where("size > 0").select(*key, "prefix").dropDuplicates(key).join(classes.select(*key, "id", "size"), key)
    entries = entries.select("id", "size", F.posexplode("prefix").alias("at", "gram"))
    widths = entries.groupBy("gram").agg(F.count(F.lit(1)).alias("width")).where("width > 1")
    blocks = classes.select("id", *PARITIES)
    columns = checkpointed(entries.join(widths, "gram").join(blocks, "id"))
    members = checkpointed(columns.groupBy("id").agg(F.count(F.lit(1)).alias("entries")))
    wanted = checkpointed(classes.join(members, "id").select("id", "text_key"))
    keyed = docs.select(_text_key(), "text")
    marked = passing(keyed, bitmap(wanted, ["text_key"]), ["text_key"], "_member").where("_member").drop("_member")
    # a set has one text here, so the text's key is as good as the set's number, and texts are moved once
    texts = checkpointed(marked.dropDuplicates(["text_key"]).join(wanted, "text_key").select("id", "text"))
    everyone = checkpointed(rows.select("doc_id", *key, "size"))
    release(rows, wanted)
    discard_shuffles(docs.sparkSession)

    def side(df: DataFrame, end: str, names: str) -> DataFrame:
        """Columns of a meeting that belong to one end: its id, size, place, component and parities."""
        plain = [F.col(c).alias(name) for c, name in zip(("id", "size", "at", "root"), (end, *names)) if c in df.columns]
        return df.select("gram", *plain, *[F.col(p).alias(f"{end}_{p}") for p in PARITIES])

    small = columns.where(F.col("width") <= SMALL)
    met = side(small, "a", "xip").join(side(small, "b", "yjq"), "gram").where("a < b").where(_fits(percent))
    elsewhere = columns.where(F.col("width") > SMALL).groupBy("id").agg(F.count(F.lit(1)).alias("other"))
    links = checkpointed(_verified(checkpointed(_candidates(met, elsewhere, percent)), texts, n, percent))
    groups = checkpointed(connected(links))
    discard_shuffles(docs.sparkSession)

    open_ = columns.where(F.col("width") > SMALL)
    tried = None
    for step in range(ROUNDS + 1):
        named = open_.select("gram", "id", "size", "at", *PARITIES).join(groups, "id", "left")
        named = named.withColumn("root", F.coalesce("root", "id"))
        mixed = named.groupBy("gram").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi")
        before, open_ = open_, checkpointed(named.join(mixed.select("gram"), "gram", "left_semi"))
        if step:
            release(before)
        if open_.isEmpty():
            break
        pivots = open_
        if step < ROUNDS:
            slot = F.pmod(F.xxhash64("root", F.lit(step)), F.lit(PIVOTS))
            least = F.min(F.struct("at", F.xxhash64("id", F.lit(step)).alias("tie"), "id", "size", "root", *PARITIES))
            pivots = open_.groupBy("gram", slot.alias("slot")).agg(least.alias("least")).select("gram", "least.*")
        met = side(pivots, "a", "xip").join(side(open_, "b", "yjq"), "gram").where("p <> q").where(_fits(percent))
        if step == ROUNDS:
            met = met.where("a < b")
        inside = open_.groupBy("id").agg(F.count(F.lit(1)).alias("here"))
        elsewhere = members.join(inside, "id").select("id", (F.col("entries") - F.col("here")).alias("other"))
        found = _candidates(met, elsewhere, percent)
        if tried is not None:
            found = found.join(tried, ["a", "b"], "left_anti")
        found = checkpointed(found)
        tried = found if tried is None else tried.unionByName(found)
        links = links.unionByName(checkpointed(_verified(found, texts, n, percent)))
        groups = checkpointed(connected(links))
        discard_shuffles(docs.sparkSession)

    named = checkpointed(
        classes.join(groups, "id", "left").select(*key, "first", "copies", F.coalesce("root", "id").alias("root"))
    )
    names = named.groupBy("root").agg(F.min("first").alias("name"))
    named = named.join(names, "root").select(*key, "name", "copies")
    empty = F.col("size") == 0
    return everyone.join(named, key, "left").select(
        "doc_id",
        F.col("size").alias("n_shingles"),
        F.when(empty, F.col("doc_id")).otherwise(F.col("name")).alias("component_id"),
        F.when(empty, F.lit(1)).otherwise(F.col("copies")).cast("long").alias("set_copies"),
    )
