"""SentencePiece encoding and decoding with N-best segmentation.

A text becomes a lattice of vocabulary pieces.  A forward Viterbi pass gives the
best score of every prefix; a backward A* search takes these scores as its exact
heuristic, so paths leave the queue in order of their scores.

No piece of the vocabulary has a word mark after another character, so the
lattice of a text is a chain of the lattices of its words; it also parts at ASCII
characters that occur in no longer piece, such as line ends.  Equal words have
equal lattices, so each distinct word of a stretch of texts is searched once and
the texts are put together from them.  The search's first path and the least loss
left in its queue are all that a text's best segmentation and second score need;
the further segmentations differ from the best only in the n - 1 words of least
loss, where the search goes on to its n-th path.
"""

from __future__ import annotations

import heapq
import math
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import binary_chunks

#: Where the vocabulary lies, by default.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: Text bytes that are put together at once, and bytes of the words' segmentations that a task keeps at hand (about).
CHUNK, KEPT_BYTES = 2 << 20, 80 << 20
#: Score of one byte of a character that the vocabulary lacks.
BYTE_SCORE = -25.0


@dataclass
class Vocabulary:
    """Pieces with ids and scores.

    A unigram model's scores are taken as they are.  A merge model's file has ranks in
    their place (minus the rank of the merge); there a piece of rank r scores
    -ln(r + 2), the log frequency of Zipf's law.
    """

    pieces: list[str]
    ids: dict[str, int]
    scores: dict[str, float]
    byte_ids: dict[int, int]

    @classmethod
    def load(cls, path: str = MODEL) -> Vocabulary:
        """From a SentencePiece model file; control and unknown pieces are not segments."""
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        byte_ids = {int(p[3:5], 16): i for i, p in enumerate(pieces) if model.is_byte(i)}
        plain = {p: i for i, p in enumerate(pieces) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))}
        first = min(plain.values(), default=0)
        if any(MARK in p.lstrip(MARK) for p in plain):
            raise ValueError("a piece has a word mark inside; its lattice does not split at words")
        scores = {p: model.get_score(i) for p, i in plain.items()}
        if all(x == int(x) for x in scores.values()):
            scores = {p: -math.log(i - first + 2) for p, i in plain.items()}
        return cls(pieces, plain, scores, byte_ids)


class Segmenter:
    """N-best segmentations under one vocabulary."""

    def __init__(self, vocabulary: Vocabulary, n: int):
        self.v, self.n = vocabulary, n
        # Every prefix of a piece, so that a search from a place ends where no piece goes on.
        self.open: dict[str, float] = {p[:k]: -math.inf for p in vocabulary.ids for k in range(1, len(p))}
        self.open |= vocabulary.scores
        self.known: dict[bytes, tuple[float, float, bytes]] = {}
        self.kept = 0
        self.searched: dict[bytes, list] = {}

    def edges(self, word: str) -> list[list[tuple[int, float]]]:
        """Of each place, (start, score) of the pieces that end there; a character without a piece is one edge of bytes."""
        out: list[list[tuple[int, float]]] = [[] for _ in range(len(word) + 1)]
        for start, c in enumerate(word):
            if c not in self.v.scores:
                out[start + 1].append((start, BYTE_SCORE * len(c.encode("utf-8", "surrogatepass"))))
            for end in range(start + 1, len(word) + 1):
                score = self.open.get(word[start:end])
                if score is None:
                    break
                if score > -math.inf:
                    out[end].append((start, score))
        return out

    def forward(self, word: str) -> tuple[list[float], list[float], list[int]]:
        """Of each place, the Viterbi score, that of the next best last piece, and the start of the best last piece.

        Ties go to the longer last piece.
        """
        n, known, plain, none = len(word), self.open.get, self.v.scores, -math.inf
        best, second, back = [none] * (n + 1), [none] * (n + 1), [0] * (n + 1)
        best[0] = 0.0
        for start in range(n):
            ahead = best[start]
            if word[start] not in plain:
                end, x = start + 1, ahead + BYTE_SCORE * len(word[start].encode("utf-8", "surrogatepass"))
                if x > best[end]:
                    best[end], second[end], back[end] = x, best[end], start
                elif x > second[end]:
                    second[end] = x
            for end in range(start + 1, n + 1):
                score = known(word[start:end])
                if score is None:
                    break
                x = ahead + score
                if x > best[end]:
                    second[end] = best[end]
                    best[end] = x
                    back[end] = start
                elif x > second[end]:
                    second[end] = x
        return best, second, back

    def best(self, word: str) -> list[tuple[float, tuple[int, ...]]]:
        """The word's up to n best (score, ends of pieces), best first: A* from the end, the forward scores as heuristic."""
        edges, (ahead, _, _) = self.edges(word), self.forward(word)
        found, turn = [], 0
        # A path is its first place and the path behind it.
        queue: list[tuple] = [(-ahead[-1], turn, len(word), 0.0, None)]
        while queue and len(found) < self.n:
            loss, _, end, behind, path = heapq.heappop(queue)
            if not end:
                ends = []
                while path:
                    ends.append(path[0])
                    path = path[1]
                found.append((-loss, tuple(ends)))
                continue
            for start, score in edges[end]:
                turn += 1
                heapq.heappush(queue, (-(ahead[start] + behind + score), turn, start, behind + score, (end, path)))
        return found

    def word(self, word: str) -> tuple[float, float, bytes]:
        """Best score, loss of the second best, and the best ids.

        This is the A* search up to its first path: that path follows the best last
        pieces, and the least loss left in the queue is that of the second path.
        """
        ahead, second, back = self.forward(word)
        ids, loss, end, known = [], math.inf, len(word), self.v.ids.get
        while end:
            loss = min(loss, ahead[end] - second[end])
            got = known(word[back[end] : end])
            if got is None:
                ids += [self.v.byte_ids[b] for b in reversed(word[back[end] : end].encode("utf-8", "surrogatepass"))]
            else:
                ids.append(got)
            end = back[end]
        return ahead[-1], loss, array("i", ids[::-1]).tobytes()

    def ids(self, word: str, ends: tuple[int, ...]) -> list[int]:
        """Ids of a word's segmentation that is given by the ends of its pieces."""
        out, start = [], 0
        for end in ends:
            got = self.v.ids.get(word[start:end])
            out += [self.v.byte_ids[b] for b in word[start:end].encode("utf-8", "surrogatepass")] if got is None else [got]
            start = end
        return out

    def look_up(self, words: list[bytes]) -> list[tuple[float, float, bytes]]:
        """:meth:`word` of each, from those at hand where possible; a word's mark is a blank here."""
        if self.kept > KEPT_BYTES:
            self.known.clear()
            self.kept = 0
        known = self.known
        for w in words:
            if w not in known:
                known[w] = got = self.word(w.decode("utf-8", "surrogatepass").replace(" ", MARK))
                self.kept += 250 + len(w) + len(got[2])
        return [known[w] for w in words]

    def further(self, word: bytes) -> list[tuple[float, tuple[int, ...]]]:
        """:meth:`best` of a word, from those at hand where possible."""
        if len(self.searched) > 20_000:
            self.searched.clear()
        if word not in self.searched:
            found = self.best(word.decode("utf-8", "surrogatepass").replace(" ", MARK))
            if len(word) > 100:
                return found
            self.searched[word] = found
        return self.searched[word]

    def ways(self, words: list[tuple[float, int, bytes]]) -> list[tuple[float, list[tuple[int, bytes, tuple[int, ...]]]]]:
        """The n least (loss, changes) of a text, given (loss, place, word) of its n - 1 words of least loss."""
        out: list[tuple[float, list]] = [(0.0, [])]
        for loss, i, w in words:
            if loss < math.inf:
                found = self.further(w)
                options = [(0.0, None), *((found[0][0] - s, (i, w, ends)) for s, ends in found[1:])]
                out = heapq.nsmallest(self.n, [(x + y, [*changes, c] if c else changes) for x, changes in out for y, c in options], key=lambda z: z[0])
        return out


def _ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places starts[i] to starts[i] + sizes[i], one after the other."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


class Coder:
    """Encodes and decodes stretches of whole texts, given as bytes and offsets."""

    def __init__(self, vocabulary: Vocabulary, n: int):
        self.search = Segmenter(vocabulary, n)
        self.n = n
        longer = {ord(c) for p in vocabulary.ids if len(p) > 1 for c in p if c < "\x80"}
        self.part = np.array([b < 128 and b != 0x20 and b not in longer for b in range(256)])
        back = {i: bytes([b]) for b, i in vocabulary.byte_ids.items()}
        table = [back.get(i, p.replace(MARK, " ").encode()) for i, p in enumerate(vocabulary.pieces)]
        self.size = np.array([len(t) for t in table], np.int64)
        self.start, self.table = np.cumsum(self.size) - self.size, np.frombuffer(b"".join(table), np.uint8)

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes and offsets of the texts of ids: the pieces joined, marks as blanks, the first of which is still there."""
        ends = np.concatenate([[0], np.cumsum(self.size[ids])])
        return self.table[_ragged(self.start[ids], self.size[ids])], ends[offsets]

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[list[float]], np.ndarray, list[list[np.ndarray]]]:
        """Ids with offsets, scores of the n best, round trips, and the ids of the n best but the best where n > 1."""
        marks = np.flatnonzero((data[:-2] == 0xE2) & (data[1:-1] == 0x96) & (data[2:] == 0x81)) if len(data) > 2 else np.empty(0, np.int64)
        original, original_offsets = data, offsets
        if len(marks):
            # A mark that a text holds is a blank to the lattice; the round trip then shows the difference.
            keep = np.ones(len(data), bool)
            keep[marks + 1] = keep[marks + 2] = False
            data = data.copy()
            data[marks] = 0x20
            offsets = np.concatenate([[0], np.cumsum(keep)])[offsets]
            data = data[keep]
        full = np.diff(offsets) > 0
        data = np.insert(data, offsets[:-1][full], 0x20)
        offsets = offsets + np.concatenate([[0], np.cumsum(full)])
        blank, part = data == 0x20, self.part[data]
        first = part | blank
        first[1:] &= part[1:] | ~blank[:-1]
        first[1:] |= part[:-1]
        first[offsets[:-1][full]] = True
        starts = np.flatnonzero(first)
        words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(np.append(starts, len(data)).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()
        which, distinct = words.indices.to_numpy(), words.dictionary.to_pylist()
        found = self.search.look_up(distinct)
        score, loss = (np.array([f[k] for f in found], np.float64) for k in (0, 1))
        sizes = np.array([len(f[2]) // 4 for f in found], np.int64)
        pool = np.frombuffer(b"".join([f[2] for f in found]), np.int32)
        ids = pool[_ragged((np.cumsum(sizes) - sizes)[which], sizes[which])]
        at = np.searchsorted(starts, offsets)
        id_ends = np.concatenate([[0], np.cumsum(sizes[which])])
        id_offsets = id_ends[at]
        scores, others = [[0.0]] * (len(offsets) - 1), [[]] * (len(offsets) - 1)
        rows = np.flatnonzero(full)
        if len(rows):
            total = np.add.reduceat(score[which], at[:-1][rows])
            lost = loss[which]
            for row, best in zip(rows.tolist(), total.tolist(), strict=True):
                a, b = at[row], at[row + 1]
                own = lost[a:b]
                if self.n == 1:
                    scores[row] = [best]
                    continue
                k = min(self.n - 1, len(own))
                near = [int(own.argmin())] if k == 1 else np.argsort(own, kind="stable")[:k].tolist()
                ways = self.search.ways([(own[i], i, distinct[which[a + i]]) for i in near])
                scores[row] = [best - w for w, _ in ways]
                others[row] = [(a, changes) for _, changes in ways[1:]]
        text, text_offsets = self.decode(ids, id_offsets)
        size = np.diff(original_offsets)
        same = np.diff(text_offsets) == np.where(full, size + 1, 0)
        if not (not len(marks) and len(text) == len(data) and np.array_equal(text, data)):
            for row in np.flatnonzero(same & full):
                same[row] = np.array_equal(text[text_offsets[row] + 1 : text_offsets[row + 1]], original[original_offsets[row] : original_offsets[row + 1]])
        return ids, id_offsets, scores, same, [[self._changed(ids, id_ends, id_offsets[r], id_offsets[r + 1], *o) for o in x] for r, x in enumerate(others)]

    def _changed(self, ids: np.ndarray, id_ends: np.ndarray, begin: int, end: int, a: int, changes: list) -> list:
        """A text's further segmentation as the parts of the best that stay and the ids between them."""
        out, at = [], begin
        for i, w, ends in sorted(changes):
            out += [ids[at : id_ends[a + i]], np.array(self.search.ids(w.decode("utf-8", "surrogatepass").replace(" ", MARK), ends), np.int32)]
            at = id_ends[a + i + 1]
        return [*out, ids[at:end]]


def encode(docs: DataFrame, n: int = 2, id_col: str = "doc_id", text_col: str = "text", model: str = MODEL, every: bool = False) -> DataFrame:
    """One row per row of ``docs``: its id, ids array<int>, scores array<double>, round_trip boolean.

    ids is the best segmentation, scores those of the n best (fewer if the lattice has
    fewer), round_trip whether decoding gives the text again.  With ``every``, further
    array<array<int>> has the ids of the n best but the first.  A word mark that the
    text holds itself comes back as a blank, which round_trip shows.  Null and empty
    texts have no ids, one score of 0 and come back as empty.  Repeated rows get equal
    results; an empty table gives an empty one; other columns are not looked at.  The
    driver reads ``model``; executors get its pieces by broadcast.
    """
    loaded = Vocabulary.load(model)
    shared = docs.sparkSession.sparkContext.broadcast((loaded.pieces, loaded.ids, loaded.scores, loaded.byte_ids))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(Vocabulary(*shared.value), n)
        for batch in batches:
            for first, last, data, offsets in binary_chunks(batch.column(1), CHUNK):
                ids, ends, scores, same, further = coder.encode(data, offsets)
                out = {"id": batch.column(0).slice(first, last - first), "ids": pa.ListArray.from_arrays(ends.astype(np.int32), ids), "scores": pa.array(scores, pa.list_(pa.float64())), "round_trip": pa.array(same)}
                if every:
                    out["further"] = pa.array([[np.concatenate(parts) for parts in x] for x in further], pa.list_(pa.list_(pa.int32())))
                yield pa.RecordBatch.from_pydict(out)

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = docs.select(id_col).schema[0].dataType.simpleString()
    schema = f"id {kind}, ids array<int>, scores array<double>, round_trip boolean" + ", further array<array<int>>" * every
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def decode(coded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", model: str = MODEL) -> DataFrame:
    """One row per row of ``coded``: its id and text, from the ids of a segmentation.

    Bytes are joined, marks become blanks and the leading one goes.  Null and empty
    ids give an empty text; bytes that are no UTF-8 come as replacement characters; an
    id that the vocabulary lacks is an error.
    """
    loaded = Vocabulary.load(model)
    shared = coded.sparkSession.sparkContext.broadcast((loaded.pieces, loaded.ids, loaded.scores, loaded.byte_ids))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(Vocabulary(*shared.value), 1)
        for batch in batches:
            for first in range(0, batch.num_rows, 1024):
                part = batch.slice(first, 1024)
                rows = [np.array(x or [], np.int64) for x in part.column(1).to_pylist()]
                ends = np.concatenate([[0], np.cumsum([len(x) for x in rows])]).astype(np.int64)
                ids = np.concatenate(rows)
                if ((ids < 0) | (ids >= len(coder.size))).any():
                    raise ValueError("an id is not in the vocabulary")
                text, at = coder.decode(ids, ends)
                raw = text.tobytes()
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([raw[a:b].removeprefix(b" ").decode("utf-8", "replace") for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], pa.string())], ["id", "text"])

    kind = coded.select(id_col).schema[0].dataType.simpleString()
    return coded.select(F.col(id_col).alias("id"), F.col(ids_col).cast("array<int>").alias("ids")).mapInArrow(run, f"id {kind}, text string").withColumnRenamed("id", id_col)
