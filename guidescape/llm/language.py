"""Language identification by n-gram filters with one bit per language.

Every slot of a Bloom filter holds a mask, one bit for each learned language, instead of a single bit: reading an n-gram's
slots and joining them with AND returns all languages that contain it in one look-up. Counting each language's bits over a
text's n-grams, less the hits that chance alone gives (the share of filled slots to the power of the number of hashes),
estimates how many of them the language really holds; the language that holds most is the answer.

n-grams are the 3 and 4 characters long ones of lower-cased runs of letters, with the run's two ends as characters of their
own. A language contains those that at least two of its sampled texts have, and whose share of texts is at least ``HOME`` of
that in any other language.

Learning takes at most ``SAMPLE`` ids of each language, in the order of a hash; the filter's size depends on the number of
languages alone. Every text is read whole.

Defined cases: a null text or one without a letter, or nothing learned at all, gives ``und`` and score 0. Texts that no
language's n-grams are found in go to the language with most learnt texts. Ties go to the language with more learnt texts, then
by name. Rows without id are scored but not learnt from; of several texts with one id and language one is learnt from. Repeated
rows give repeated results. Columns of ``docs`` other than doc_id, text and lang are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from guidescape.llm.text import as_long, id_remainder, mix
from guidescape.runtime import checkpointed, importable

MODULUS, HELD_OUT = 4, 2
SAMPLE = 2_000  # texts of a language that are learnt from
SLOTS = 1 << 21  # of the filter, each one bit wide for every language
HASHES = 3
HOME = 0.5
CHUNK = 1 << 18  # characters taken at a time

_STEP = np.uint64(0x9E3779B97F4A7C15)


@lru_cache(1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def _runs(text: str) -> np.ndarray:
    """Code points of the lower-cased text; every stretch of other characters than letters, and both ends, as one 0."""
    raw = text.lower().encode("utf-32-le", "replace")
    codes = np.concatenate([[0], np.frombuffer(raw, np.uint32), [0]]).astype(np.uint64)
    codes[~_letters()[codes]] = 0
    keep = np.ones(len(codes), bool)
    keep[1:] = (codes[1:] != 0) | (codes[:-1] != 0)
    return codes[keep]


def _pieces(text: str) -> Iterator[str]:
    """The text in pieces of bounded size, cut behind a character that is no letter where the window has one."""
    at = 0
    while at < len(text):
        end = min(len(text), at + CHUNK)
        while end < len(text) and end > at + CHUNK // 2 and text[end - 1].isalpha():
            end -= 1
        yield text[at:end]
        at = end


def grams(text: str | None) -> np.ndarray:
    """A 64-bit key for every n-gram of a text, repeats included; empty exactly if it has no letter."""
    found = []
    for piece in _pieces(text or ""):
        c = _runs(piece)
        if len(c) < 3:
            continue
        three = c[:-2] | c[1:-1] << np.uint64(21) | c[2:] << np.uint64(42)
        inner = c[1:-1] != 0
        found.append(mix(three[inner]))
        both = inner[:-1] & inner[1:]
        found.append(mix(mix(three[:-1][both]) * _STEP + c[3:][both]))
    return np.concatenate(found) if found else np.empty(0, np.uint64)


def slots(keys: np.ndarray, j: int) -> np.ndarray:
    """The ``j``-th slot of each key."""
    return ((keys + np.uint64(j) * (mix(keys + _STEP) | np.uint64(1))) & np.uint64(SLOTS - 1)).astype(np.int64)


@dataclass
class Filters:
    languages: list[str]  # with most learnt texts first
    masks: np.ndarray  # uint8, slots × bytes; bit l % 8 of byte l // 8 belongs to language l

    def __post_init__(self):
        bits = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
        self.bits = bits
        filled = np.concatenate([np.bincount(col, minlength=256) @ bits for col in self.masks.T] or [np.empty(0)])
        self.chance = (filled[: len(self.languages)] / len(self.masks)) ** HASHES

    def holding(self, keys: np.ndarray) -> np.ndarray:
        """Mask of the languages that contain each key, and of few others."""
        out = self.masks[slots(keys, 0)]
        for j in range(1, HASHES):
            out &= self.masks[slots(keys, j)]
        return out

    def counts(self, text: str | None) -> tuple[int, np.ndarray]:
        """n-grams of the text, and the estimated number of them that each language holds."""
        keys = grams(text)
        held = self.holding(keys)
        hits = np.concatenate([np.bincount(col, minlength=256) @ self.bits for col in held.T])[: len(self.languages)]
        return len(keys), np.clip((hits - len(keys) * self.chance) / np.maximum(1 - self.chance, 1e-9), 0, len(keys))

    def predict(self, text: str | None) -> tuple[str, float, float]:
        """Language, share of the n-grams that it holds, and how far that share is ahead of the next language's."""
        if not self.languages:
            return "und", 0.0, 0.0
        n, held = self.counts(text)
        if not n:
            return "und", 0.0, 0.0
        best = int(held.argmax())
        rest = np.delete(held, best)
        return self.languages[best], float(held[best] / n), float((held[best] - rest.max(initial=0.0)) / n)


def learnt_texts(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(lang, doc_id, text): at most ``sample`` texts of every language."""
    usable = docs.where(
        F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull()
        & (id_remainder(F.col("doc_id"), MODULUS) != HELD_OUT)
    ).select("lang", "doc_id", "text")
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    ids = usable.select("lang", "doc_id").distinct().withColumn("_place", F.row_number().over(order))
    ids = checkpointed(ids.where(F.col("_place") <= sample).drop("_place"))
    return usable.join(ids, ["lang", "doc_id"]).groupBy("lang", "doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"))


def fit(docs: DataFrame, sample: int = SAMPLE) -> Filters:
    """The filter of all languages among the documents that may be learnt from."""
    spark = importable(docs.sparkSession)
    texts = checkpointed(learnt_texts(docs, sample))
    sizes = texts.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").collect()
    languages = [r["lang"] for r in sizes]
    width = (len(languages) + 7) // 8
    masks = np.zeros((SLOTS, width), np.uint8)
    if not languages:
        return Filters(languages, masks)
    number, total = {name: i for i, name in enumerate(languages)}, [r["n"] for r in sizes]

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for start in range(0, len(pdf), 128):
                for lang, part in pdf.iloc[start : start + 128].groupby("lang", sort=False):
                    found = np.concatenate([np.unique(grams(text)) for text in part["text"]])
                    keys, n = np.unique(found, return_counts=True)
                    yield pd.DataFrame({"l": number[lang], "key": as_long(keys), "share": n / total[number[lang]], "n": n})

    counted = texts.mapInPandas(count, "l int, key long, share double, n long")
    counted = counted.groupBy("key", "l").agg(F.sum("share").alias("share"), F.sum("n").alias("n"))
    held = counted.groupBy("key").agg(F.collect_list(F.struct("l", "share", "n")).alias("all"), F.max("share").alias("most"))
    home = held.select("key", F.explode("all").alias("x"), "most").where(f"x.n >= 2 and x.share >= {HOME} * most")

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            keys, l = pdf["key"].to_numpy(np.int64).view(np.uint64), pdf["l"].to_numpy()
            for j in range(HASHES):
                yield pd.DataFrame({"slot": slots(keys, j), "byte": l // 8, "mask": 1 << (l % 8)})

    bits = home.select("key", F.col("x.l").alias("l")).mapInPandas(place, "slot long, byte int, mask int")
    bits = bits.groupBy("slot", "byte").agg(F.bit_or("mask").alias("mask"))

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        block = np.zeros((4096, width), np.uint8)
        block[pdf["slot"] % 4096, pdf["byte"]] = pdf["mask"]
        return pd.DataFrame({"block": [pdf["slot"].iloc[0] // 4096], "masks": [block.tobytes()]})

    # At most one row for every 4,096 slots: together the filter itself.
    for row in bits.groupBy(F.floor(F.col("slot") / 4096).alias("_b")).applyInPandas(pack, "block long, masks binary").collect():
        masks[row["block"] * 4096 :][:4096] = np.frombuffer(row["masks"], np.uint8).reshape(4096, width)
    return Filters(languages, masks)


def identify(docs: DataFrame, filters: Filters) -> DataFrame:
    """doc_id, held_out, lang_pred, score (share of n-grams held), margin."""
    sent = importable(docs.sparkSession).sparkContext.broadcast(filters)

    @F.pandas_udf("lang_pred string, score double, margin double")
    def predict(texts: pd.Series) -> pd.DataFrame:
        out = [sent.value.predict(text) for text in texts]
        return pd.DataFrame(out, columns=["lang_pred", "score", "margin"])

    held_out = (id_remainder(F.col("doc_id"), MODULUS) == HELD_OUT).alias("held_out")
    rows = docs.select("doc_id", held_out, predict("text").alias("_p"))
    return rows.select("doc_id", "held_out", "_p.lang_pred", "_p.score", "_p.margin")


def language_id(docs: DataFrame) -> DataFrame:
    """Learn from the documents that are not held out, predict all."""
    return identify(docs, fit(docs))
