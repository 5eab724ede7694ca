"""Words of raw texts, as Spark columns and as numpy arrays inside tasks.

A word is a run of characters other than space and U+0009 to U+000D. Lower-casing touches A to Z only.
"""

from __future__ import annotations

import hashlib
import string
import zlib

import numpy as np
from pyspark.sql import Column, functions as F

SPACES = " \t\n\x0b\x0c\r"
NOT_A_WORD = "[\\x20\\x09-\\x0D]+"
A_WORD = "[^\\x20\\x09-\\x0D]"

_LOWER = bytes.maketrans(string.ascii_uppercase.encode(), string.ascii_lowercase.encode())
_IS_SPACE = np.isin(np.arange(256, dtype=np.uint8), np.frombuffer(SPACES.encode(), np.uint8))
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_CHUNK = 1 << 18


def words(text: Column) -> Column:
    """The words of a text as an array; null and blank texts have none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), NOT_A_WORD), "")


def id_remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id written as text, modulo ``modulus``. A null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def encoded(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "replace")


def mix(h: np.ndarray) -> np.ndarray:
    """Spread all bits of 64-bit numbers over all bits (a bijection)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _powers(base: int) -> np.ndarray:
    out = np.full(_CHUNK + 1, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_UP, _DOWN = _powers(_BASE), _powers(_INVERSE)


def _word_bounds(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    data = np.frombuffer(raw, np.uint8)
    space = np.ones(len(data) + 2, np.int8)
    space[1:-1] = _IS_SPACE[data]
    steps = np.diff(space)
    return data, np.flatnonzero(steps == -1), np.flatnonzero(steps == 1)


def _sums(data: np.ndarray) -> np.ndarray:
    """Prefix sums of byte × base^position: differences, scaled back, are polynomial hashes of byte ranges."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _UP[: len(data)], out=out[1:])
    return out


def _ranges(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return mix((sums[ends] - sums[starts]) * _DOWN[starts] + (ends - starts).astype(np.uint64))


def chunks(raw: bytes):
    """Cut bytes at white space into pieces of bounded size; a longer word comes alone."""
    at = 0
    while True:
        while at < len(raw) and raw[at] in SPACES.encode():
            at += 1
        if at >= len(raw):
            return
        end = len(raw)
        if end - at > _CHUNK:
            end = max(raw.rfind(c, at, at + _CHUNK + 1) for c in SPACES.encode())
            if end < 0:
                found = [p for p in (raw.find(c, at) for c in SPACES.encode()) if p >= 0]
                end = min(found, default=len(raw))
        yield raw[at:end]
        at = end


def word_hashes(text: str | None, prefixes: tuple[int, ...] = ()) -> np.ndarray:
    """64-bit hashes of the lower-cased words in order; with ``prefixes``, followed by those of the words' first bytes."""
    parts, heads = [], []
    for piece in chunks(encoded(text).translate(_LOWER)):
        if len(piece) > _CHUNK:
            parts.append(np.frombuffer(hashlib.blake2b(piece, digest_size=8).digest(), np.uint64))
            continue
        data, starts, ends = _word_bounds(piece)
        sums = _sums(data)
        parts.append(_ranges(sums, starts, ends))
        for width in prefixes:
            long = starts[ends - starts >= width]
            heads.append(mix(_ranges(sums, long, long + width) + np.uint64(width)))
    return np.concatenate([*parts, *heads]) if parts else np.empty(0, np.uint64)


def chain(parts: list[np.ndarray]) -> np.ndarray:
    """One hash for each row of aligned hash arrays; the number of arrays counts."""
    out = np.full(len(parts[0]), len(parts), np.uint64)
    for part in parts:
        out = mix(out * np.uint64(_BASE) + part)
    return out


def shingle_set(hashes: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct hashes of all ``n``-word shingles; of fewer words the whole sequence is the one shingle."""
    if not len(hashes):
        return hashes
    n = min(n, len(hashes))
    return np.unique(chain([hashes[i : len(hashes) - n + 1 + i] for i in range(n)]))


def as_long(hashes: np.ndarray) -> np.ndarray:
    return hashes.view(np.int64)


def crc32(data: bytes) -> int:
    return zlib.crc32(data) & 0xFFFFFFFF
