"""Documents as token ids in coded files, in ascending doc_id order, and the way back.

A file table has one row per chunk (see ``idcodec``): part and chunk (their order is the documents' order), start (place of its
first id in its part), n_ids, the documents' ids and token counts, and the coded payload. Every document ends with one end id.

Null and empty texts are the end id alone. Null doc_ids come first; rows that repeat an id stay next to each other, ordered by a
hash of the text. Other columns are not read. An empty table gives an empty file table.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from guidescape.llm.idcodec import CHUNK, decode_chunks, encode_chunks
from guidescape.llm.text import crc32, encoded
from guidescape.runtime import importable

END = 2
WORDS_HELD = 500_000
ROWS_AT_ONCE = 16
_MARK = "\x7f"
_FILE = "part long, chunk long, start long, n_ids long, doc_ids array<long>, lengths array<long>, payload binary"

_encoders: dict[str, "WordEncoder"] = {}


class WordEncoder:
    """Ids of whole texts from a tokenizer whose tokens never span white space, with the words of this worker remembered.

    Unknown words are encoded many at a time, set apart by a control character that has a token of its own. A special token would
    do the same, but the tokenizer looks for those slowly. Words that hold the character, or may hold a special token, go alone.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        (self.mark,) = self._ids(_MARK)
        self.forget()

    def forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.flat = np.zeros(1 << 16, np.uint32)
        self.ends = np.zeros(1 << 16, np.int64)  # ends[i] to ends[i+1]: ids of word i

    @classmethod
    def at(cls, path: str) -> "WordEncoder":
        if path not in _encoders:
            _encoders[path] = cls(path)
        return _encoders[path]

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _learn(self, words: list[bytes]) -> None:
        alone = (b"<|", _MARK.encode())
        odd = [w for w in words if any(x in w for x in alone)]
        plain = [w for w in words if not any(x in w for x in alone)] if odd else words
        parts = []
        for at in range(0, len(plain), 512):
            text = f" {_MARK} ".join(w.decode() for w in plain[at : at + 512])
            ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
            marks = np.flatnonzero(ids == self.mark)
            lengths = np.diff(np.concatenate([[-1], marks, [len(ids)]])) - 1
            parts.append((ids[ids != self.mark], lengths))
        single = [self._ids(w.decode()) for w in odd]
        parts.append((np.array([i for x in single for i in x], np.uint32), np.array([len(x) for x in single], np.int64)))
        n, used = len(self.known), int(self.ends[len(self.known)])
        ids, lengths = (np.concatenate(x) for x in zip(*parts))
        self.flat = _room(self.flat, used + len(ids))
        self.ends = _room(self.ends, n + len(lengths) + 1)
        self.flat[used : used + len(ids)] = ids
        self.ends[n + 1 : n + 1 + len(lengths)] = used + np.cumsum(lengths)
        for word in [*plain, *odd]:
            self.known[word] = len(self.known)

    def encode(self, text: str | None) -> np.ndarray:
        words = encoded(text).split()
        fresh = [w for w in dict.fromkeys(words) if w not in self.known]
        if fresh:
            if len(self.known) + len(fresh) > WORDS_HELD and self.known:
                self.forget()
                fresh = list(dict.fromkeys(words))
            self._learn(fresh)
        at = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        first, length = self.ends[at], self.ends[at + 1] - self.ends[at]
        done = np.cumsum(length)
        place = np.arange(done[-1] if len(done) else 0) + np.repeat(first - done + length, length)
        return np.append(self.flat[place], np.uint32(END))


def _room(array: np.ndarray, size: int) -> np.ndarray:
    return array if len(array) >= size else np.concatenate([array, np.zeros(max(size, len(array)), array.dtype)])


def encode_files(docs: DataFrame, tokenizer: str) -> DataFrame:
    """The file table of all documents."""

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder, part = WordEncoder.at(tokenizer), TaskContext.get().partitionId()
        chunk = start = 0
        held: list[tuple] = []  # whole documents of the open chunk
        size = 0
        ready: list[tuple] = []

        def rows(of: list[tuple]) -> pd.DataFrame:
            payloads = encode_chunks([c[5] for c in of])
            table = [(*c[:4], c[4], c[6], p) for c, p in zip(of, payloads)]
            return pd.DataFrame(table, columns=["part", "chunk", "start", "n_ids", "doc_ids", "lengths", "payload"])

        def closed() -> tuple:
            ids = np.concatenate([x[1] for x in held])
            return (part, chunk, start, len(ids), [x[0] for x in held], ids, [len(x[1]) for x in held])

        for pdf in batches:
            for doc_id, text in zip(pdf["doc_id"], pdf["text"]):
                held.append((None if doc_id is None else int(doc_id), encoder.encode(text)))
                size += len(held[-1][1])
                if size >= CHUNK:
                    ready.append(closed())
                    chunk, start, held, size = chunk + 1, start + size, [], 0
                    if len(ready) == ROWS_AT_ONCE:
                        yield rows(ready)
                        ready = []
        if held:
            ready.append(closed())
        if ready:
            yield rows(ready)

    importable(docs.sparkSession)
    named = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("tie"))
    ordered = named.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    # The id travels as text: pandas has no 64-bit integers beside nulls.
    return ordered.select(F.col("doc_id").cast("string"), "text").mapInPandas(write, _FILE)


def write_files(docs: DataFrame, path: str, tokenizer: str) -> None:
    encode_files(docs, tokenizer).write.parquet(path)


def decode_files(files: DataFrame):
    """Per document of a file table: part, doc_id, at (place in its part), and its ids as array<long>."""
    return _decoded(files, "ids array<long>", lambda ids: ids.astype(np.int64))


def _decoded(files: DataFrame, field: str, of) -> DataFrame:
    name = field.split()[0]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for first in range(0, len(pdf), ROWS_AT_ONCE):
                some = pdf.iloc[first : first + ROWS_AT_ONCE]
                for row, ids in zip(some.itertuples(), decode_chunks(list(some["payload"]))):
                    ends = np.cumsum(np.asarray(row.lengths, np.int64))
                    starts = ends - row.lengths
                    yield pd.DataFrame(
                        {
                            "part": row.part,
                            "place": np.arange(len(ends)),
                            "chunk": row.chunk,
                            "at": row.start + starts,
                            "n_tokens": ends - starts,
                            name: [of(ids[a:b]) for a, b in zip(starts, ends)],
                        }
                    )

    columns = f"part long, chunk long, place long, at long, n_tokens long, {field}"
    rows = files.select("part", "chunk", "start", "lengths", "payload").mapInPandas(
        lambda batches: (x[["part", "chunk", "place", "at", "n_tokens", name]] for x in read(batches)), columns
    )
    return rows


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """Per document, from the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    files = importable(spark).read.parquet(path)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per part
    parts = files.groupBy("part").agg(F.sum("n_ids").alias("n"))
    offsets = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("skip"))
    names = files.select("part", "chunk", F.posexplode("doc_ids").alias("place", "doc_id"))
    checks = _decoded(files, "ids_crc32 long", lambda ids: crc32(ids.astype("<u4").tobytes()))
    return (
        checks.join(names, ["part", "chunk", "place"])
        .join(offsets, "part")
        .select("doc_id", (F.col("at") + F.col("skip")).alias("start"), "n_tokens", "ids_crc32")
    )
