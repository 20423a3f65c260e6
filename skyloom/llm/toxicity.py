"""Toxicity: a factorization machine over hashed terms.

A document's terms are its distinct lower-cased words and their leading four and
five letters, each hashed to 32 bits.  The machine adds a weight per term and the
products of learned factors per pair of terms, so an insult beside a group
mention can weigh more than both apart.

The machine is fitted on at most ``TRAIN_ROWS`` labelled rows, those of least
hash with equal room for either label.  A term is chosen if its presence depends
on the label; of the other terms, those are chosen too whose presence together with
another one does, though neither tells anything alone.  All pairs are tested, but for
terms in so few rows that no pair's evidence can come from them.
Presence, not frequency, is what counts, so a word in a text of 20,000 weighs as
in one of 20.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable

#: Bound of the labelled sample, the factors, and the least evidence (log-likelihood ratio) of a term.
TRAIN_ROWS, FACTORS, EVIDENCE = 8_000, 8, 12.0
#: Evidence that a pair needs, of which there are many; terms that a task pairs with the others, and these others at a time.
PAIR_EVIDENCE, BLOCK, SLAB = 40.0, 64, 4_096
#: Passes over the sample, step, and penalty of the fit.
PASSES, STEP, PENALTY = 300, 0.05, 1e-4
THRESHOLD = 0.7

_TERM = re.compile(r"[^\W_]+(?:'[^\W_]+)?")


def terms(text: str | None) -> set[int]:
    """Hashes of the text's terms; empty for no text."""
    out = set()
    add, code = out.add, xxhash.xxh32_intdigest
    for word in set(_TERM.findall((text or "").lower())):
        add(code(word))
        if len(word) > 5:
            add(code(word[:5] + "*"))
        if len(word) > 4:
            add(code(word[:4] + "*"))
    return out


class Machine:
    """Weights and factors of the chosen terms; a score is the logistic of their sum and pair products."""

    def __init__(self, codes: np.ndarray, bias: float, weight: np.ndarray, factor: np.ndarray):
        self.place = {int(c): i for i, c in enumerate(codes)}
        self.bias, self.weight, self.factor = bias, weight, factor

    def score(self, found: set[int]) -> float:
        rows = [self.place[c] for c in found if c in self.place]
        rows.sort()
        v = self.factor[rows]
        z = self.bias + self.weight[rows].sum() + 0.5 * ((v.sum(axis=0) ** 2).sum() - (v**2).sum())
        return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))

    @classmethod
    def fit(cls, codes: np.ndarray, rows: list[list[int]], labels: np.ndarray) -> Machine:
        """Full-batch Adam on the mean logistic loss; without both labels the score is the labels' smoothed mean."""
        m, n = len(codes), len(rows)
        rate = (labels.sum() + 0.5) / (n + 1) if n else 0.5 / 50
        bias = float(np.log(rate / (1 - rate)))
        rng = np.random.Generator(np.random.PCG64(7))
        params = [np.array([bias]), np.zeros(m), rng.normal(0, 0.01, (m, FACTORS))]
        if not m or not n or labels.min() == labels.max():
            return cls(codes[:0], bias, params[1][:0], params[2][:0])
        at = np.concatenate([np.full(len(r), i) for i, r in enumerate(rows)]).astype(np.int64)
        col = np.concatenate([np.asarray(r, np.int64) for r in rows])
        first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        total = lambda x: np.bincount(at, x, n)
        back = lambda x: np.bincount(col, x, m)
        for turn in range(1, PASSES + 1):
            b, w, v = params
            vs = v[col]
            sums = np.stack([total(vs[:, k]) for k in range(FACTORS)], axis=1)
            z = b[0] + total(w[col]) + 0.5 * ((sums**2).sum(axis=1) - total((vs**2).sum(axis=1)))
            miss = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - labels) / n
            pull = miss[at]
            grads = [np.array([miss.sum()]), back(pull) + PENALTY * w, np.stack([back(pull * (sums[at, k] - vs[:, k])) for k in range(FACTORS)], axis=1) + PENALTY * v]
            for i, g in enumerate(grads):
                first[i] = 0.9 * first[i] + 0.1 * g
                second[i] = 0.999 * second[i] + 0.001 * g * g
                params[i] = params[i] - STEP * (first[i] / (1 - 0.9**turn)) / (np.sqrt(second[i] / (1 - 0.999**turn)) + 1e-8)
        return cls(codes, float(params[0][0]), params[1], params[2])


def _evidence_of(pos: Column, neg: Column, n_pos: int, n_neg: int) -> Column:
    """Twice the log-likelihood ratio of a presence depending on the label."""

    def ll(k, n):
        p = F.greatest(F.lit(1e-12), F.least(F.lit(1 - 1e-12), k / n))
        return k * F.log(p) + (n - k) * F.log(1 - p)

    return 2 * (ll(pos, n_pos) + ll(neg, n_neg) - ll(pos + neg, n_pos + n_neg))


class Pairs:
    """Presences of terms in the sample's rows, as bits, and the test of pairs of them.

    ``bits`` has a row for each 64 sample rows, the ``n_pos`` toxic ones first and filled up
    to a whole word, and a column for each term.  A pair is tested by its common presence,
    and by the presence of just one of both.
    """

    def __init__(self, bits: np.ndarray, n_pos: int, n_neg: int):
        self.bits, self.words = bits, -(-n_pos // 64)
        self.alone = [self._sums(np.bitwise_count(x)) for x in (bits[: self.words], bits[self.words :])]
        logs = lambda n: np.array([k * np.log(max(k / n, 1e-12)) + (n - k) * np.log(max(1 - k / n, 1e-12)) for k in range(n + 1)])
        self.ll = [logs(n) for n in (n_pos, n_neg, n_pos + n_neg)]

    @staticmethod
    def _sums(counts: np.ndarray) -> np.ndarray:
        return counts.sum(axis=0, dtype=np.int64)

    def _hits(self, pos: np.ndarray, neg: np.ndarray) -> np.ndarray:
        return 2 * (self.ll[0][pos] + self.ll[1][neg] - self.ll[2][pos + neg]) >= PAIR_EVIDENCE

    def of(self, first: int, last: int) -> np.ndarray:
        """Which terms depend on the label in a pair of one of [first, last) and a later one, as columns."""
        m, hit = self.bits.shape[1], np.zeros(self.bits.shape[1], bool)
        for begin in range(first, m, SLAB):
            part = self.bits[:, begin : begin + SLAB]
            both, ones = np.empty(part.shape[1], np.uint64), np.empty(part.shape[1], np.uint8)
            for i in range(first, min(last, begin + SLAB)):
                common = []
                for rows in (range(self.words), range(self.words, len(part))):
                    count = np.zeros(part.shape[1], np.uint16)
                    for w in rows:
                        count += np.bitwise_count(np.bitwise_and(part[w], self.bits[w, i], out=both), out=ones)
                    common.append(count.astype(np.int64))
                one = [alone[i] + alone[begin : begin + SLAB] - 2 * c for alone, c in zip(self.alone, common, strict=True)]
                found = self._hits(*common) | self._hits(*one)
                found[: max(i + 1 - begin, 0)] = False
                hit[begin : begin + SLAB] |= found
                hit[i] |= found.any()
        return np.flatnonzero(hit)


def in_pairs(rows: DataFrame, terms_: DataFrame, n_pos: int, n_neg: int) -> np.ndarray:
    """Codes of ``terms_`` (code) that depend on the label in a pair; ``rows`` is the sample (id, y, found).

    The sample's presences are one bit a row and term, which goes to all tasks: a
    thousand bytes a term at most, as the sample is bounded.  Tasks pair some terms with all
    later ones.
    """
    spark = rows.sparkSession
    places = rows.select("y", "id", F.explode("found").alias("code")).join(terms_, "code")
    order = {(y, i): k for y in (1, 0) for k, i in enumerate(sorted(r["id"] for r in rows.where(F.col("y") == y).select("id").collect()))}
    shift = -(-n_pos // 64) * 64
    codes = np.array(sorted(r["code"] for r in terms_.select("code").collect()), np.int64)
    bits = np.zeros(((shift + n_neg + 63) // 64, len(codes)), np.uint64)
    for part in places.toArrow().to_batches():
        at = np.array([order[y, i] + (0 if y else shift) for y, i in zip(part.column("y").to_pylist(), part.column("id").to_pylist(), strict=True)], np.int64)
        np.bitwise_or.at(bits, (at // 64, np.searchsorted(codes, part.column("code").to_numpy())), np.uint64(1) << (at % 64).astype(np.uint64))
    work = spark.createDataFrame([(a,) for a in range(0, len(codes), BLOCK)], "a int")
    sent = spark.sparkContext.broadcast(bits)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = Pairs(sent.value, n_pos, n_neg)
        for part in parts:
            for a in part.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(pairs.of(a, min(a + BLOCK, len(codes))))], ["place"])

    found = work.repartition(8 * spark.sparkContext.defaultParallelism, "a").mapInArrow(run, "place long").distinct().collect() if len(codes) else []
    return codes[sorted(r["place"] for r in found)]


def _terms_arrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first in range(0, batch.num_rows, 256):
            part = batch.slice(first, 256)
            found = [sorted(terms(t)) for t in part.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(found, pa.list_(pa.int64()))], ["id", "y", "found"])


def fit(docs: DataFrame, labelled: DataFrame, id_col: str, text_col: str) -> Machine:
    """The machine of ``labelled`` (id, y): at most ``TRAIN_ROWS`` rows, half for each label, are looked at."""
    each = labelled.where("id IS NOT NULL AND y IS NOT NULL").groupBy("id").agg(F.max("y").alias("y"))
    order = (F.xxhash64("id"), F.col("id"))
    chosen = durable(each.where("y = 1").orderBy(*order).limit(TRAIN_ROWS // 2).union(each.where("y = 0").orderBy(*order).limit(TRAIN_ROWS // 2)), "sample")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(chosen), "id").select("id", "y", "text")
    rows = durable(rows.repartition(F.xxhash64("id")).mapInArrow(_terms_arrow, "id long, y int, found array<long>"), "sample-terms")
    n_neg, n_pos = ((rows.where(f"y = {y}").count()) for y in (0, 1))
    if not n_pos or not n_neg:
        return Machine.fit(np.empty(0, np.int64), [[]] * (n_pos + n_neg), np.array([1.0] * n_pos + [0.0] * n_neg))
    counts = rows.select("y", F.explode("found").alias("code")).groupBy("code").agg(F.sum("y").cast("double").alias("pos"), F.sum(1 - F.col("y")).cast("double").alias("neg"))
    counts = durable(counts.withColumn("g", F.round(_evidence_of(F.col("pos"), F.col("neg"), n_pos, n_neg), 6)), "sample-counts")
    # What a term's rows can add to a pair's evidence at most, taken row by row: the logarithm of how rare their label is.
    most = 2 * (F.col("pos") * float(np.log((n_pos + n_neg) / n_pos)) + F.col("neg") * float(np.log((n_pos + n_neg) / n_neg)))
    other = counts.where((F.col("g") < EVIDENCE) & (most >= PAIR_EVIDENCE - EVIDENCE)).select("code")
    alone = [r["code"] for r in counts.where(F.col("g") >= EVIDENCE).select("code").collect()]
    codes = np.array(sorted({*alone, *in_pairs(rows, other, n_pos, n_neg).tolist()}), np.int64)
    known = rows.sparkSession.createDataFrame([(int(c),) for c in codes], "code long")
    listed = rows.select("id", F.explode("found").alias("code")).join(known, "code").groupBy("id").agg(F.sort_array(F.collect_list("code")).alias("found"))
    sample = sorted(rows.select("id", "y").join(listed, "id", "left").collect(), key=lambda r: r["id"])
    return Machine.fit(codes, [np.searchsorted(codes, r["found"] or []).tolist() for r in sample], np.array([r["y"] for r in sample], float))


def toxicity(docs: DataFrame, labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: its id, ``score`` in 0 to 1 and ``predicted`` (1 from 0.7 on).

    ``labelled`` is (id, y).  Null, empty and wordless texts get the score of no terms.
    Equal texts get equal scores.  Without rows of both labels all scores are equal.
    An empty table gives an empty result; other columns are not looked at.
    """
    machine = fit(docs, labelled, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = machine.place.keys()
        for batch in batches:
            score = [machine.score(terms(x.as_py()) & known) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score, pa.float64())], ["id", "score"])

    scored = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "id long, score double")
    return scored.select(F.col("id").alias(id_col), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
