"""Token ids on disk: an adaptive context-mixing range coder over independent, checksummed blocks.

Three predictions are made for every id: the id last seen after the same two ids (order 2), the one last seen after the same id
(order 1), and an adaptive distribution over magnitudes (order 0). A symbol says which of them holds; its probability is the
mean of two adaptive distributions, one selected by the trust in the order-2 prediction and whether order 1 agrees, the other
by the previous symbol. Magnitudes are powers of two, from 256 upwards; one is followed by the id's remaining bits. Every block of ``BLOCK`` ids starts from the same
state and carries the crc32 of its ids, so blocks are coded side by side as the lanes of numpy arrays and can be read alone.

A chunk is a run of whole documents with at least ``CHUNK`` ids (a longer document is a chunk of its own): one row of the
written table. Ids are unsigned 32-bit numbers.
"""

from __future__ import annotations

import struct

import numpy as np

from guidescape.llm.text import crc32

BLOCK = 2048
CHUNK = 1 << 18
MAGIC = b"IDR1"

_HALF = 1 << 14  # each distribution sums to this, the mix of two to twice as much
_TOTAL_BITS = 15
_RATE = 4
_ONE_BITS, _TWO_BITS = 9, 10
_SMALL_BITS = 8
_TRUST = np.array([0, 0, 1, 2, 1, 2, 3, 3], np.int8)  # the trust after a miss and after a hit
_TOP, _BOTTOM = np.uint64(1 << 48), np.uint64(1 << 32)
_U16, _U48 = np.uint64(16), np.uint64(48)


class _Lanes:
    """The model of many blocks at once, one per lane; both directions of the coder drive it the same way.

    Tables are flat, lane by lane, so that a step gathers and scatters whole rows.
    """

    def __init__(self, n: int, classes: int):
        self.symbols = 2 + classes
        steps = np.arange(self.symbols + 1)
        even = (steps * _HALF // self.symbols).astype(np.int16)
        self.trust = np.tile(even, (n * 8, 1))
        self.after = np.tile(even, (n * self.symbols, 1))
        above = steps[None, :] > np.arange(self.symbols)[:, None]
        self.target = (steps + above * (_HALF - self.symbols)).astype(np.int16)
        self.one = np.zeros(n << _ONE_BITS, np.uint32)
        self.two = np.zeros(n << _TWO_BITS, np.uint32)
        self.sure = np.zeros(n << _TWO_BITS, np.int8)
        self.last = np.zeros(n, np.uint32)
        self.before = np.zeros(n, np.uint32)
        self.symbol = np.zeros(n, np.int64)
        self.index = np.arange(n)
        self.at_one, self.at_two = self.index << _ONE_BITS, self.index << _TWO_BITS
        self.at_trust, self.at_after, self.at_row = self.index * 8, self.index * self.symbols, self.index * (self.symbols + 1)

    def predict(self, k: int) -> np.ndarray:
        """Cumulative frequencies of the first ``k`` lanes' next symbols."""
        last = self.last[:k]
        self.slot1 = self.at_one[:k] + (last * np.uint32(0x9E3779B1) >> np.uint32(32 - _ONE_BITS))
        mixed = last * np.uint32(0x9E3779B1) ^ self.before[:k] * np.uint32(0x85EBCA77)
        self.slot2 = self.at_two[:k] + (mixed >> np.uint32(32 - _TWO_BITS))
        self.guess1 = self.one.take(self.slot1)
        self.guess2 = self.two.take(self.slot2)
        self.trusted = self.sure.take(self.slot2)
        self.row_a = self.at_trust[:k] + self.trusted * 2 + (self.guess1 == self.guess2)
        self.row_b = self.at_after[:k] + self.symbol[:k]
        self.a = self.trust.take(self.row_a, axis=0)
        self.b = self.after.take(self.row_b, axis=0)
        return self.a + self.b

    def learn(self, k: int, ids: np.ndarray, symbols: np.ndarray) -> None:
        goal = self.target.take(symbols, axis=0)
        self.trust[self.row_a] = self.a + ((goal - self.a) >> _RATE)
        self.after[self.row_b] = self.b + ((goal - self.b) >> _RATE)
        hit = symbols == 0
        self.two[self.slot2] = np.where(self.trusted == 0, ids, self.guess2)
        self.sure[self.slot2] = _TRUST[self.trusted + 4 * hit]
        self.one[self.slot1] = ids
        self.before[:k] = self.last[:k]
        self.last[:k] = ids
        self.symbol[:k] = symbols


def _magnitudes(ids: np.ndarray) -> np.ndarray:
    """0 for ids of up to 8 bits, 1 for 9 bits, and so on."""
    return np.maximum(np.frexp(ids.astype(np.float64))[1] - _SMALL_BITS, 0).astype(np.int64)


def _classes(largest: int) -> int:
    return max(largest.bit_length() - _SMALL_BITS, 0) + 1


def _extra_bits(magnitudes: np.ndarray) -> np.ndarray:
    """Bits that follow a magnitude: the leading one is implied, but for the first class."""
    return (np.maximum(magnitudes - 1, 0) + _SMALL_BITS).astype(np.uint64)


def _by_length(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lanes from the longest to the shortest, and for every step how many of them still have an id."""
    order = np.argsort(-lengths, kind="stable")
    steps = np.arange(lengths.max(initial=0))
    return order, np.searchsorted(-lengths[order], -steps, side="left")


def encode_blocks(blocks: list[np.ndarray], classes: int) -> list[bytes]:
    """Code blocks of ids within so many magnitudes, each block on its own."""
    if not blocks:
        return []
    lengths = np.array([len(b) for b in blocks])
    order, alive = _by_length(lengths)
    n, width = len(blocks), int(lengths.max())
    ids = np.zeros((width, n), np.uint32)
    for lane, b in enumerate(order):
        ids[: lengths[b], lane] = blocks[b]
    model = _Lanes(n, classes)
    low, span = np.zeros(n, np.uint64), np.full(n, 2**64 - 1, np.uint64)
    out, ends = np.zeros((n, 3 * width + 8), np.uint16), np.zeros(n, np.int64)

    def renew(k: int) -> None:
        lo, sp = low[:k], span[:k]
        while True:
            same = (lo ^ (lo + sp)) < _TOP
            go = np.flatnonzero(same | (sp < _BOTTOM))
            if not len(go):
                return
            stuck = go[~same[go]]
            sp[stuck] = (~lo[stuck] + np.uint64(1)) & (_BOTTOM - np.uint64(1))
            out[go, ends[go]] = lo[go] >> _U48
            ends[go] += 1
            lo[go] <<= _U16
            sp[go] <<= _U16

    for t in range(width):
        k = int(alive[t])
        now = ids[t, :k]
        table = model.predict(k)
        bits = _magnitudes(now)
        symbols = np.where(now == model.guess2, 0, np.where(now == model.guess1, 1, bits + 2))
        flat, at = table.reshape(-1), model.at_row[:k] + symbols
        start = flat.take(at).view(np.uint16)
        part = span[:k] >> np.uint64(_TOTAL_BITS)
        low[:k] += start * part
        span[:k] = (flat.take(at + 1).view(np.uint16) - start) * part
        renew(k)
        extra = np.where(symbols >= 2, _extra_bits(bits), np.uint64(0))
        part = span[:k] >> extra
        low[:k] += (now & ((np.uint64(1) << extra) - np.uint64(1))) * part
        span[:k] = part
        renew(k)
        model.learn(k, now, symbols)
    for _ in range(4):
        out[model.index, ends] = low >> _U48
        ends += 1
        low <<= _U16
    coded = [b""] * n
    for lane, b in enumerate(order):
        coded[b] = out[lane, : ends[lane]].astype(">u2").tobytes()
    return coded


def decode_blocks(coded: list[bytes], lengths: np.ndarray, classes: int) -> list[np.ndarray]:
    if not coded:
        return []
    order, alive = _by_length(lengths)
    n, width = len(coded), int(lengths.max())
    units = [np.frombuffer(coded[b], ">u2") for b in order]
    data = np.zeros((n, max(len(u) for u in units) + 4), np.uint64)
    for lane, u in enumerate(units):
        data[lane, : len(u)] = u
    model = _Lanes(n, classes)
    low, span, code = np.zeros(n, np.uint64), np.full(n, 2**64 - 1, np.uint64), np.zeros(n, np.uint64)
    for i in range(4):
        code = (code << _U16) | data[:, i]
    at_unit = np.full(n, 4)
    ids = np.zeros((width, n), np.uint32)

    def renew(k: int) -> None:
        lo, sp = low[:k], span[:k]
        while True:
            same = (lo ^ (lo + sp)) < _TOP
            go = np.flatnonzero(same | (sp < _BOTTOM))
            if not len(go):
                return
            stuck = go[~same[go]]
            sp[stuck] = (~lo[stuck] + np.uint64(1)) & (_BOTTOM - np.uint64(1))
            code[go] = (code[go] << _U16) | data[go, at_unit[go]]
            at_unit[go] += 1
            lo[go] <<= _U16
            sp[go] <<= _U16

    for t in range(width):
        k = int(alive[t])
        table = model.predict(k)
        part = span[:k] >> np.uint64(_TOTAL_BITS)
        value = np.minimum((code[:k] - low[:k]) // part, np.uint64(2 * _HALF - 1)).astype(np.uint16)
        table = table.view(np.uint16)
        symbols = (table[:, 1:] <= value[:, None]).sum(axis=1)
        flat, at = table.reshape(-1), model.at_row[:k] + symbols
        start = flat.take(at)
        low[:k] += start * part
        span[:k] = (flat.take(at + 1) - start) * part
        renew(k)
        bits = symbols - 2
        extra = np.where(bits >= 0, _extra_bits(bits), np.uint64(0))
        part = span[:k] >> extra
        rest = np.minimum((code[:k] - low[:k]) // part, (np.uint64(1) << extra) - np.uint64(1))
        low[:k] += rest * part
        span[:k] = part
        renew(k)
        literal = np.where(bits > 0, (np.uint64(1) << extra) | rest, rest).astype(np.uint32)
        now = np.where(symbols == 0, model.guess2, np.where(symbols == 1, model.guess1, literal))
        ids[t, :k] = now
        model.learn(k, now, symbols)
    found: list = [None] * n
    for lane, b in enumerate(order):
        found[b] = ids[: lengths[b], lane]
    return found


def encode_chunks(chunks: list[np.ndarray]) -> list[bytes]:
    """Each chunk of ids as bytes: magic, classes, number of ids, then (bytes, crc32) of every block, then the blocks."""
    cut = [[c[i : i + BLOCK] for i in range(0, len(c), BLOCK)] for c in chunks]
    classes = _classes(max((int(c.max()) for c in chunks if len(c)), default=0))
    coded = iter(encode_blocks([b for blocks in cut for b in blocks], classes))
    out = []
    for chunk, blocks in zip(chunks, cut):
        own = [next(coded) for _ in blocks]
        head = struct.pack("<4sBQ", MAGIC, classes, len(chunk))
        table = b"".join(struct.pack("<II", len(c), crc32(b.astype("<u4").tobytes())) for c, b in zip(own, blocks))
        out.append(head + table + b"".join(own))
    return out


def decode_chunks(payloads: list[bytes]) -> list[np.ndarray]:
    coded, lengths, checks, counts, kinds = [], [], [], [], []
    for raw in payloads:
        magic, classes, n = struct.unpack_from("<4sBQ", raw)
        if magic != MAGIC:
            raise ValueError("not a chunk of ids")
        blocks = -(-n // BLOCK)
        table = struct.unpack_from(f"<{2 * blocks}I", raw, 13)
        at = 13 + 8 * blocks
        for b in range(blocks):
            coded.append(raw[at : at + table[2 * b]])
            at += table[2 * b]
            lengths.append(min(BLOCK, n - b * BLOCK))
            kinds.append(classes)
        checks += table[1::2]
        counts.append(blocks)
    found: list = [None] * len(coded)
    for classes in set(kinds):
        mine = [i for i, c in enumerate(kinds) if c == classes]
        decoded = decode_blocks([coded[i] for i in mine], np.array([lengths[i] for i in mine]), classes)
        for i, ids in zip(mine, decoded):
            if crc32(ids.astype("<u4").tobytes()) != checks[i]:
                raise ValueError("a block of ids is damaged")
            found[i] = ids
    out, at = [], 0
    for blocks in counts:
        out.append(np.concatenate([*found[at : at + blocks], np.empty(0, np.uint32)]).astype(np.uint32))
        at += blocks
    return out
