"""Phrase collocations by hierarchical pair naming.

Texts are read once into batches: their distinct words with counts, and the sequence
of the words' places among those, broken between pieces.  A level counts the batches'
distinct units over the corpus, names the frequent ones by ids, joins the ids back to
the batches by unit, and replaces adjacent named units by their pair; these pairs are
the next level's units.  As a phrase is never more frequent than a part of it, no
frequent phrase is missed.

The pair that names a phrase points to its two parents, the phrase without its last
and without its first word.  The counts of all beginnings and ends come down from
them, which gives every cut; and a phrase lies in a longer one only by way of those
that have it as a parent, which gives subsumption.

Counts are added up inside batches and tasks before a shuffle, so a word that is
everywhere is one row a batch.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import binary_chunks, discard, durable, lower

#: Longest phrase, least count of a candidate, rows of the report for each language.
MOST_WORDS, LEAST, REPORTED = 3, 10, 2_000
#: Percent of a phrase's count that a longer one around it needs to stand for it.
SUBSUMED = 50
#: Text bytes of a batch; a longer document is a batch of its own.
BATCH_BYTES = 1 << 24
#: Units that Python hands over at a time.
UNIT_ROWS = 1 << 16

_CLASS = np.zeros(256, np.int8)
_CLASS[[0x20, 0x09]] = 1
_CLASS[[*b".,;:!?", *range(0x0A, 0x0E)]] = 2


def word_sequence(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """Places of the words of lower-cased rows among the distinct ones, -1 between pieces; and the distinct words."""
    data = lower(data)
    kind = _CLASS[data]
    inner = offsets[1:-1]
    inside = np.concatenate([[False], kind == 0, [False]])
    turn = np.flatnonzero(inside[1:] != inside[:-1])
    cut = np.unique(inner[inside[inner] & inside[inner + 1]]) if len(inner) else inner
    starts, ends = np.sort(np.concatenate([turn[::2], cut])), np.sort(np.concatenate([turn[1::2], cut]))
    breaks = np.cumsum(kind == 2, dtype=np.int64)[starts] + np.searchsorted(inner, starts, "right") if len(starts) else starts
    sizes = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
    words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(sizes), pa.py_buffer(data[kind == 0].tobytes())]).dictionary_encode()
    codes = np.insert(words.indices.to_numpy(zero_copy_only=False).astype(np.int32), np.flatnonzero(np.diff(breaks)) + 1, -1)
    return codes, words.dictionary


def _batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, text) rows as batches of one language each: a row for each distinct word, and one for the sequence."""
    for part in parts:
        for lang in pc.unique(part.column(0)).to_pylist():
            texts = part.column(1).filter(pc.equal(part.column(0), lang))
            for _, _, data, offsets in binary_chunks(texts, BATCH_BYTES):
                codes, words = word_sequence(data, offsets)
                if len(words):
                    yield from _rows(lang, {"word": words.cast(pa.string())}, np.bincount(codes[codes >= 0], minlength=len(words)), codes)


def _rows(lang: str, units: dict[str, pa.Array], n: np.ndarray, seq: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    """A batch's units with their places and counts, some at a time, and its sequence: batch, lang, place, unit, n, seq."""
    batch, rows = int.from_bytes(os.urandom(8), "big") >> 1, len(n)
    same = lambda value, k, type_: pa.array([value], type_).take(pa.array(np.zeros(k, np.int64)))
    names = ["batch", "lang", "place", *units, "n", "seq"]
    for first in range(0, rows, UNIT_ROWS):
        k = min(UNIT_ROWS, rows - first)
        place = pa.array(np.arange(first, first + k, dtype=np.int32))
        yield pa.RecordBatch.from_arrays([same(batch, k, pa.int64()), same(lang, k, pa.string()), place, *[u.slice(first, k) for u in units.values()], pa.array(n[first : first + k], pa.int64()), pa.nulls(k, pa.binary())], names)
    if seq is not None:
        yield pa.RecordBatch.from_arrays([pa.array([batch], pa.int64()), pa.array([lang], pa.string()), pa.nulls(1, pa.int32()), *[pa.nulls(1, u.type) for u in units.values()], pa.nulls(1, pa.int64()), pa.array([zstandard.compress(seq.tobytes(), 1)], pa.binary())], names)


def _pairs(parts: Iterator[pa.RecordBatch], last: bool) -> Iterator[pa.RecordBatch]:
    """(lang, seq, ids (place, id)) rows with each two adjacent named units as one, in the same form; without sequence at the ``last`` level."""
    for part in parts:
        for i in range(part.num_rows):
            seq = np.frombuffer(zstandard.decompress(part.column(1)[i].as_py()), np.int32)
            named = part.column(2)[i].values
            v = int(seq.max(initial=0)) + 1
            ids = np.full(v + 1, -1, np.int64)
            ids[named.field("place").to_numpy()] = named.field("id").to_numpy()
            known = ids[seq] >= 0  # -1 takes the last place, which is never named
            at = np.flatnonzero(known[:-1] & known[1:])
            if not len(at):
                continue
            key, code, n = np.unique(seq[at].astype(np.int64) * v + seq[at + 1], return_inverse=True, return_counts=True)
            out = None
            if not last:
                out = np.full(len(seq) - 1, -1, np.int32)
                out[at] = code
            yield from _rows(part.column(0)[i].as_py(), {"left": pa.array(ids[key // v]), "right": pa.array(ids[key % v])}, n, out)


def _counts(batches: DataFrame, keys: list[str]) -> DataFrame:
    """Counts f of all units of the batches by ``keys``."""
    return batches.where("seq IS NULL").groupBy(*keys).agg(F.sum("n").alias("f"))


def _named(units: DataFrame, name: str) -> DataFrame:
    """``units`` written, with a column id that no other unit of its level has."""
    return durable(units.withColumn("id", F.monotonically_increasing_id()), name)


def _renamed(batches: DataFrame, names: DataFrame, keys: list[str], last: bool) -> DataFrame:
    """The next level's batches: ids joined to their units by ``keys``, adjacent named units made pairs."""
    places, known = batches.where("seq IS NULL").select("batch", "place", *keys), names.select(*keys, "id")
    # Every unit is looked up, so the join's size is that of the batches, however many units the corpus makes frequent.
    ids = places.join(known.hint("shuffle_hash"), keys, "left")
    ids = ids.groupBy("batch").agg(F.collect_list(F.when(F.col("id").isNotNull(), F.struct("place", "id"))).alias("ids"))
    rows = batches.where("seq IS NOT NULL").select("batch", "lang", "seq").join(ids, "batch").select("lang", "seq", "ids")
    return durable(rows.mapInArrow(partial(_pairs, last=last), "batch long, lang string, place int, left long, right long, n long, seq binary"), "phrase-pairs", 1)


def _joined(pairs: DataFrame, parts: DataFrame) -> DataFrame:
    """Frequent pairs as phrases: text, last word, and the counts of all beginnings and ends, taken from both parents."""
    left = parts.select(F.col("id").alias("left"), "lang", F.col("phrase").alias("lp"), F.concat("firsts", F.array("f")).alias("firsts"))
    right = parts.select(F.col("id").alias("right"), "last", F.concat("lasts", F.array("f")).alias("lasts"))
    return pairs.join(left, "left").join(right, "right").select("lang", "left", "right", F.concat_ws(" ", "lp", "last").alias("phrase"), "last", "f", "firsts", "lasts")


def _score(a: Column, l: Column, r: Column) -> Column:  # noqa: E741
    """floor(1000000 a a / (l r)) in whole decimals of up to 38 digits; counts are below 10^13."""
    wide = lambda x: x.cast("decimal(13,0)")
    square = (wide(a) * wide(a) * F.lit(1000000).cast("decimal(7,0)")).cast("decimal(35,0)")
    product = wide(l) * wide(r)
    return F.call_function("div", square, product)


def phrases(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", most_words: int = MOST_WORDS, least: int = LEAST) -> DataFrame:
    """All candidates that no longer one stands for: lang, phrase, a, l, r, n, score.

    Candidates are phrases of 2 to ``most_words`` words that occur ``least`` times in their
    language (overlaps included).  l and r are the counts of both parts at the cut of
    lowest score, ties to the earliest cut; n counts the language's words.  Null and empty
    texts have no words, a null language is ``und``, repeated rows count each; an empty
    table gives an empty result; other columns are not looked at.
    """
    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    batches = durable(rows.mapInArrow(_batches, "batch long, lang string, place int, word string, n long, seq binary"), "phrase-words", 8_000)
    words = durable(_counts(batches, ["lang", "word"]), "phrase-counts")
    total = words.groupBy("lang").agg(F.sum("f").alias("n"))
    none = F.array().cast("array<bigint>")
    level = _named(words.where(F.col("f") >= least).select("lang", "word", F.col("word").alias("phrase"), F.col("word").alias("last"), "f", none.alias("firsts"), none.alias("lasts")), "phrase-names")
    levels, keys = [], ["lang", "word"]
    for m in range(2, most_words + 1):
        before, batches = batches, _renamed(batches, level, keys, m == most_words)
        discard(before)
        keys = ["left", "right"]
        level = _named(_joined(_counts(batches, keys).where(F.col("f") >= least), level), "phrase-names")
        levels.append(level)
    kept = None
    for this, longer in zip(levels, [*levels[1:], None], strict=True):
        if longer is not None:
            most = longer.select(F.explode(F.array("left", "right")).alias("id"), F.col("f").alias("around")).groupBy("id").agg(F.max("around").alias("around"))
            this = this.join(most, "id", "left").where(F.coalesce(100 * F.col("around") < SUBSUMED * F.col("f"), F.lit(True)))
        this = this.select("lang", "phrase", "f", "firsts", "lasts")
        kept = this if kept is None else kept.union(this)
    cuts = F.transform("firsts", lambda x, i: F.struct(_score(F.col("f"), x, F.element_at("lasts", F.size("lasts") - i)).alias("score"), i.alias("k"), x.alias("l"), F.element_at("lasts", F.size("lasts") - i).alias("r")))
    kept = kept.withColumn("cut", F.array_min(cuts)).join(F.broadcast(total), "lang")
    return kept.select("lang", "phrase", F.col("f").alias("a"), "cut.l", "cut.r", "n", "cut.score")


def ranked(found: DataFrame, most: int = REPORTED) -> DataFrame:
    """Each language's first phrases by score, then count, then text, with their rank."""
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    out = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)
    return out.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


ORACLE = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
p AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS words FROM d),
i AS (SELECT lang, m, unnest([words[i : i + m - 1] FOR i IN range(1, len(words) - m + 2)]) AS ws FROM p, (VALUES (1), (2), (3)) v(m) WHERE len(words) >= m),
g AS (SELECT lang, m, ws, count(*) AS f FROM i GROUP BY ALL),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM g WHERE m = 1 GROUP BY lang),
c AS (SELECT lang, m, ws, f AS a FROM g WHERE m > 1 AND f >= 10),
t AS (SELECT lang, m, ws, a, k, ws[1 : k] AS head, ws[k + 1 : m] AS rest FROM c, (VALUES (1), (2)) v(k) WHERE k < m),
u AS (SELECT t.lang, t.m, t.ws, a, k, x.f AS l, y.f AS r, (1000000::HUGEINT * a * a) // (x.f::HUGEINT * y.f) AS score
      FROM t JOIN g x ON x.lang = t.lang AND x.ws = head JOIN g y ON y.lang = t.lang AND y.ws = rest),
b AS (SELECT lang, ws, a, arg_min(struct_pack(l := l, r := r, score := score), struct_pack(s := score, k := k)) AS cut FROM u GROUP BY lang, ws, a),
e AS (SELECT lang, ws[1 : m - 1] AS ws, a AS around FROM c WHERE m > 2 UNION ALL SELECT lang, ws[2 : m], a FROM c WHERE m > 2),
o AS (SELECT DISTINCT b.lang, b.ws FROM b JOIN e ON e.lang = b.lang AND e.ws = b.ws WHERE 100 * around >= 50 * a),
s AS (SELECT b.lang, array_to_string(b.ws, ' ') AS phrase, b.a, cut.l AS l, cut.r AS r, n, cut.score::BIGINT AS score FROM b JOIN n ON n.lang = b.lang ANTI JOIN o ON o.lang = b.lang AND o.ws = b.ws),
q AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM s)
SELECT lang, rank, phrase, a, l, r, n, score FROM q WHERE rank <= 2000
"""
