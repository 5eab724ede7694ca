"""N-best segmentation into the pieces of a SentencePiece model, and the way back.

A text's segmentations are the paths of a lattice whose edges are pieces; a path scores the sum of its pieces' scores in the
model. Pieces never reach across the start of a word (a run of ▁ and what follows it), so the lattice is a chain of words and
the N best paths of the whole differ from the best one only in the N - 1 words that lose least by their second-best path.
Forward Viterbi over all new words of a batch at once gives every word's two best scores; for the few words that matter, A*
runs backward from the word's end with the forward scores as its heuristic. They are the exact cost of the rest, so paths leave
the queue in order of their score and no other path is expanded.

Characters without a piece of their own become byte pieces at the lowest score less ten. Null and empty texts have the one
empty segmentation; texts with fewer segmentations than asked for return those they have. Among equal scores, words are varied
from left to right and paths leave the queue in order of their pieces from the end. Rows that repeat are encoded as often as they
occur. Other columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from guidescape.llm.text import crc32, mix
from guidescape.runtime import importable

N = 3
WORDS_HELD = 1_000_000
CELLS = 1 << 16
TEXTS_AT_ONCE = 1000
SPACE = "▁"
_WORD = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
_NONE = -1e18
_BASE = np.uint64(0x9E3779B97F4A7C15)

_models: dict[str, "Pieces"] = {}


class Pieces:
    """The pieces of a model file, and the words of this worker already segmented."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(model.get_piece_size())
        plain = [i for i in ids if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        self.score = {model.id_to_piece(i): (i, model.get_score(i)) for i in plain}
        self.byte = {int(model.id_to_piece(i)[3:5], 16): i for i in ids if model.is_byte(i)}
        self.unknown = min(s for _, s in self.score.values()) - 10.0
        self.longest = max(map(len, self.score))
        self.raw = [b""] * len(ids)
        for piece, (i, _) in self.score.items():
            self.raw[i] = piece.replace(SPACE, " ").encode()
        for value, i in self.byte.items():
            self.raw[i] = bytes([value])
        self.raw_flat = np.frombuffer(b"".join(self.raw), np.uint8)
        self.raw_ends = np.concatenate([[0], np.cumsum([len(x) for x in self.raw])])
        self.tables = []
        for length in range(1, self.longest + 1):
            own = [p for p in self.score if len(p) == length]
            keys = self._hashes(self._points(own, length), length)[:, 0] if own else np.empty(0, np.uint64)
            order = np.argsort(keys)
            low = np.zeros(1 << 16, bool)
            low[keys & np.uint64(0xFFFF)] = True
            found = [self.score[own[i]] for i in order]
            self.tables.append(
                (keys[order], np.array([x[0] for x in found], np.int32), np.array([x[1] for x in found], float), low)
            )
        self.forget()

    @classmethod
    def at(cls, path: str) -> "Pieces":
        if path not in _models:
            _models[path] = cls(path)
        return _models[path]

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.flat = np.zeros(1 << 14, np.uint32)
        self.ends = np.zeros(1 << 12, np.int64)  # ends[i] to ends[i+1]: ids of word i
        self.best, self.gap = np.zeros(1 << 12), np.zeros(1 << 12)
        self.paths: dict[tuple[str, int], list] = {}

    @staticmethod
    def _points(words: list[str], width: int) -> np.ndarray:
        flat = np.frombuffer("".join(w.ljust(width, "\0") for w in words).encode("utf-32-le"), np.uint32)
        return flat.reshape(len(words), width).astype(np.uint64)

    @staticmethod
    def _hashes(points: np.ndarray, length: int) -> np.ndarray:
        out = np.zeros((len(points), points.shape[1] - length + 1), np.uint64)
        for k in range(length):
            out = out * _BASE + points[:, k : k + out.shape[1]] + np.uint64(1)
        return mix(out)

    def _edges(self, points: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Scores and ids of the pieces of one length that start at every place; the score is hopeless where there is none."""
        keys, ids, scores, low = self.tables[length - 1]
        hashed = self._hashes(points, length)
        score, piece = np.full(hashed.shape, _NONE), np.full(hashed.shape, -1, np.int32)
        if len(keys):
            maybe = np.nonzero(low[hashed & np.uint64(0xFFFF)])
            at = np.minimum(np.searchsorted(keys, hashed[maybe]), len(keys) - 1)
            hit = keys[at] == hashed[maybe]
            maybe, at = (maybe[0][hit], maybe[1][hit]), at[hit]
            score[maybe], piece[maybe] = scores[at], ids[at]
        if length == 1:
            score = np.where(piece < 0, self.unknown, score)
        return score, piece

    def _segment(self, words: list[str]) -> None:
        """Forward Viterbi with two scores per place over words of similar length."""
        width = max(map(len, words))
        points = self._points(words, width)
        top = min(self.longest, width)
        edges = [self._edges(points, length) for length in range(1, top + 1)]
        n = len(words)
        first, second = np.full((n, width + 1), _NONE), np.full((n, width + 1), _NONE)
        step = np.zeros((n, width + 1), np.int16)
        first[:, 0] = 0
        for j in range(1, width + 1):
            a, b, s = np.full(n, _NONE), np.full(n, _NONE), np.zeros(n, np.int16)
            for length in range(1, min(top, j) + 1):
                gain = edges[length - 1][0][:, j - length]
                v, v2 = first[:, j - length] + gain, second[:, j - length] + gain
                better = v > a
                b = np.where(better, np.maximum(a, v2), np.maximum(b, v))
                a = np.where(better, v, a)
                s[better] = length
            first[:, j], second[:, j], step[:, j] = a, b, s
        self._store(words, first, second, step, [e[1] for e in edges])

    def _store(self, words: list[str], first, second, step, pieces: list[np.ndarray]) -> None:
        """Follow the best path of every word back from its end, all words at once, and keep it."""
        n, lengths = len(words), np.array([len(w) for w in words])
        every = np.arange(n)
        j, path, lane = lengths.copy(), [], []
        active = every
        while len(active):
            back = step[active, j[active]].astype(np.int64)
            j[active] -= back
            found = np.empty(len(active), np.int64)
            for length in np.unique(back):
                own = back == length
                found[own] = pieces[length - 1][active[own], j[active[own]]]
            for i in np.flatnonzero(found < 0):  # a character without a piece; its bytes go backward too
                char = words[active[i]][j[active[i]]]
                for b in reversed(char.encode("utf-8", "replace")):
                    path.append(np.array([self.byte[b]]))
                    lane.append(active[i : i + 1])
            path.append(found[found >= 0])
            lane.append(active[found >= 0])
            active = active[j[active] > 0]
        path, lane = np.concatenate(path)[::-1], np.concatenate(lane)[::-1]
        order = np.argsort(lane, kind="stable")
        start, used = len(self.known), int(self.ends[len(self.known)])
        self.flat = _room(self.flat, used + len(path))
        self.ends = _room(self.ends, start + n + 1)
        self.best, self.gap = _room(self.best, start + n), _room(self.gap, start + n)
        self.flat[used : used + len(path)] = path[order]
        self.ends[start + 1 : start + n + 1] = used + np.cumsum(np.bincount(lane, minlength=n))
        top, other = first[every, lengths], second[every, lengths]
        self.best[start : start + n] = top
        self.gap[start : start + n] = np.where(other > _NONE / 2, top - other, np.inf)
        self.known.update(zip(words, range(start, start + n)))

    def _with_bytes(self, path: list) -> np.ndarray:
        if any(isinstance(p, str) for p in path):
            path = [i for p in path for i in ([self.byte[b] for b in p.encode()] if isinstance(p, str) else [p])]
        return np.array(path, np.uint32)

    def learn(self, words: list[str]) -> None:
        words = sorted(words, key=len)
        at = 0
        while at < len(words):
            end = at + 1
            while end < len(words) and (end + 1 - at) * len(words[end]) <= CELLS and len(words[end]) <= 2 * len(words[at]) + 4:
                end += 1
            self._segment(words[at:end])
            at = end

    def word_paths(self, word: str, n: int) -> list[tuple[float, np.ndarray]]:
        """The n best (score, ids) of one word by A* from its end, best first."""
        if (word, n) not in self.paths:
            if len(self.paths) > WORDS_HELD:
                self.paths.clear()
            self.paths[word, n] = self._search(word, n)
        return self.paths[word, n]

    def _ending(self, word: str, j: int) -> list[tuple[int, float, object]]:
        """Edges that end at place j: start, score, piece id or unknown character."""
        found = []
        for length in range(1, min(self.longest, j) + 1):
            piece = self.score.get(word[j - length : j])
            if piece:
                found.append((j - length, piece[1], piece[0]))
            elif length == 1:
                found.append((j - 1, self.unknown, word[j - 1]))
        return found

    def _search(self, word: str, n: int) -> list[tuple[float, np.ndarray]]:
        edges = [[], *(self._ending(word, j) for j in range(1, len(word) + 1))]
        forward = [0.0] + [_NONE] * len(word)
        for j in range(1, len(word) + 1):
            forward[j] = max(forward[i] + s for i, s, _ in edges[j])
        queue, made, out = [(-forward[-1], 0, len(word), 0.0, ())], 0, []
        while queue and len(out) < n:
            _, _, j, behind, tail = heapq.heappop(queue)
            if j == 0:
                path = []
                while tail:
                    path.append(tail[0])
                    tail = tail[1]
                out.append((behind, self._with_bytes(path)))
                continue
            for i, s, piece in edges[j]:
                made += 1
                heapq.heappush(queue, (-(forward[i] + s + behind), made, i, s + behind, (piece, tail)))
        return out

    @staticmethod
    def words(text: str | None) -> list[str]:
        return _WORD.findall(SPACE + text.replace(" ", SPACE)) if text else []

    def prepare(self, texts: list[str | None]) -> list[list[str]]:
        """The words of some texts, all of them segmented: many new words at once cost little each."""
        split = [self.words(text) for text in texts]
        every = dict.fromkeys(w for words in split for w in words)
        fresh = [w for w in every if w not in self.known]
        if self.known and len(self.known) + len(fresh) > WORDS_HELD:
            self.forget()
            fresh = list(every)
        if fresh:
            self.learn(fresh)
        return split

    def nbest(self, text: str | None, n: int) -> list[tuple[float, np.ndarray]]:
        """The n best (score, ids) of a whole text, best first."""
        return self.combine(self.prepare([text])[0], n)

    def combine(self, words: list[str], n: int) -> list[tuple[float, np.ndarray]]:
        """The n best (score, ids) of a chain of prepared words."""
        if not words:
            return [(0.0, np.empty(0, np.uint32))]
        at = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        length = self.ends[at + 1] - self.ends[at]
        done = np.cumsum(length)
        ids = self.flat[np.arange(done[-1]) + np.repeat(self.ends[at + 1] - done, length)]
        score, gaps = float(self.best[at].sum()), self.gap[at]
        open_ = np.flatnonzero(np.isfinite(gaps))
        chosen = np.sort(open_[np.argsort(gaps[open_], kind="stable")[: n - 1]])
        variants = [(0.0, ())]
        for place in chosen:
            paths = self.word_paths(words[place], n)
            loss = [paths[0][0] - s for s, _ in paths]
            grown = [(lost + loss[r], (*ranks, r)) for lost, ranks in variants for r in range(len(paths))]
            variants = sorted(grown)[:n]
        out = []
        for lost, ranks in variants:
            own, since = [], 0
            for place, r in zip(chosen, ranks):
                if r:
                    own += [ids[since : done[place] - length[place]], self.word_paths(words[place], n)[r][1]]
                    since = done[place]
            out.append((score - lost, np.concatenate([*own, ids[since:]])))
        return out

    def decode(self, ids: np.ndarray) -> str:
        """The text behind ids; the space that encoding puts in front is taken away."""
        starts, ends = self.raw_ends[ids], self.raw_ends[np.asarray(ids, np.int64) + 1]
        done = np.cumsum(ends - starts)
        place = np.arange(done[-1] if len(done) else 0) + np.repeat(ends - done, ends - starts)
        return self.raw_flat[place].tobytes().decode("utf-8", "replace").removeprefix(" ")


def _room(array: np.ndarray, size: int) -> np.ndarray:
    return array if len(array) >= size else np.concatenate([array, np.zeros(max(size, len(array)), array.dtype)])


def nbest(docs: DataFrame, model: str, n: int = N) -> DataFrame:
    """doc_id, rank (0 is best), score, n_tokens, ids_crc32, round_trip (the ids decode to the text).

    ``Pieces.nbest`` gives the ids themselves.
    """

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pieces = Pieces.at(model)
        for pdf in batches:
            rows = []
            for start in range(0, len(pdf), TEXTS_AT_ONCE):
                part = pdf.iloc[start : start + TEXTS_AT_ONCE]
                for doc_id, text, words in zip(part["doc_id"], part["text"], pieces.prepare(list(part["text"]))):
                    for rank, (score, ids) in enumerate(pieces.combine(words, n)):
                        same = pieces.decode(ids) == (text or "")
                        rows.append((doc_id, rank, score, len(ids), crc32(ids.astype("<u4").tobytes()), same))
            yield pd.DataFrame(rows, columns=["doc_id", "rank", "score", "n_tokens", "ids_crc32", "round_trip"])

    importable(docs.sparkSession)
    fields = "doc_id string, rank int, score double, n_tokens long, ids_crc32 long, round_trip boolean"
    rows = docs.select(F.col("doc_id").cast("string"), "text").mapInPandas(encode, fields)
    return rows.withColumn("doc_id", F.col("doc_id").cast("long"))
