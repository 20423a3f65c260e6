"""Resampling documents towards a target distribution by importance weights of hashed n-grams.

Features are the runs of one to ``N`` words, hashed into ``BUCKETS`` buckets.  A
bucket's gain is the floored log ratio of its smoothed shares in the target texts
and in all documents; a document's weight is the sum of its features' gains.  Adding
Gumbel noise that is hashed from the id and taking the highest scores draws without
replacement in proportion to the weights' exponentials.

A text of more than ``CHUNK_BYTES`` is cut at word boundaries into overlapping chunks,
which are dealt over tasks: each owns the features that start in it and carries the
N - 1 words behind, so that every feature is counted once.  Chunk figures are summed
by document.  No text, however long, is the work of one task alone.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import binary_chunks, durable, lower, numbered

#: Longest run of words, and buckets of their hashes.
N, BUCKETS = 3, 10_000
#: Bytes of text that a chunk owns; a text of no more is one chunk.
CHUNK_BYTES = 1 << 14
#: Words that a document needs to be drawn, share of those documents that is drawn, and the noise's seed.
LEAST_WORDS, PERCENT, SEED = 20, 5, 42
#: Bytes that a run's hash is stepped through together with others; longer runs are hashed one by one.
_STEPPED = 96

_CODES = np.arange(256)
_IS_WORD = ((_CODES >= 0x30) & (_CODES <= 0x39)) | ((_CODES >= 0x61) & (_CODES <= 0x7A)) | (_CODES >= 0x80)


def _crc_table() -> np.ndarray:
    """CRC-32 of each byte, by the reflected polynomial."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
    return table


_TABLE = _crc_table()


def crc32_of(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-32 of each span [start, end) of ``data``: all spans advance together by a byte, longest first."""
    size = ends - starts
    out = np.zeros(len(starts), np.uint32)
    for i in np.flatnonzero(size > _STEPPED):
        out[i] = zlib.crc32(data[starts[i] : ends[i]].tobytes())
    short = np.flatnonzero(size <= _STEPPED)
    short = short[np.argsort(-size[short], kind="stable")]
    at, size = starts[short], size[short]
    state = np.full(len(short), 0xFFFFFFFF, np.uint32)
    for step in range(int(size[0]) if len(size) else 0):
        m = int(np.searchsorted(-size, -step, "left"))
        c = state[:m]
        state[:m] = _TABLE[(c ^ data[at[:m] + step]) & 0xFF] ^ (c >> 8)
    out[short] = state ^ np.uint32(0xFFFFFFFF)
    return out


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words of lower-cased ``data``, and the word index at which each row begins (and the last ends)."""
    inside = np.concatenate([[False], _IS_WORD[data], [False]])
    turn = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = turn[::2], turn[1::2]
    cut = offsets[1:-1]
    cut = np.unique(cut[inside[cut] & inside[cut + 1]]) if len(cut) else cut
    starts, ends = np.sort(np.concatenate([starts, cut])), np.sort(np.concatenate([ends, cut]))
    return starts, ends, np.searchsorted(starts, offsets)


def features(data: np.ndarray, offsets: np.ndarray, own: np.ndarray | None = None) -> tuple[list[np.ndarray], np.ndarray]:
    """The buckets of the runs of 1, 2 ... N words from each word on (-1 where the row has no such run), and the rows' first words.

    Of a row's words only the first ``own`` ones start runs, where that is given and not negative.
    """
    data = lower(data)
    starts, ends, first = words_of(data, offsets)
    size = ends - starts
    # The words once more with one space behind each, so that a run is a span.
    to = np.concatenate([[0], np.cumsum(size + 1)])
    text = np.full(int(to[-1]), 0x20, np.uint8)
    text[np.arange(int(size.sum())) + np.repeat(np.arange(len(size)), size)] = data[_mask(starts, ends, len(data))]
    row_end = np.repeat(first[1:], np.diff(first))
    place = np.arange(len(size))
    starting = np.ones(len(size), bool)
    if own is not None:
        owned = np.where(own < 0, np.diff(first), own)
        starting = place - np.repeat(first[:-1], np.diff(first)) < np.repeat(owned, np.diff(first))
    out = []
    for n in range(1, N + 1):
        bucket = np.full(len(size), -1, np.int32)
        has = np.flatnonzero(starting & (place + n <= row_end))
        bucket[has] = crc32_of(text, to[has], to[has + n] - 1) % BUCKETS
        out.append(bucket)
    return out, first


def _mask(starts: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """Which of n bytes lie in the spans."""
    steps = np.zeros(n + 1, np.int8)
    steps[starts] += 1
    steps[ends] -= 1
    return np.cumsum(steps[:n], dtype=np.int8).astype(bool)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Long texts (id, body) as chunks: id, digest of the text, its number of chunks, words owned, chunk."""
    for batch in batches:
        for row in range(batch.num_rows):
            raw = batch.column(1)[row].as_py()
            data = lower(np.frombuffer(raw, np.uint8))
            starts, ends, _ = words_of(data, np.array([0, len(data)]))
            cuts = np.unique(np.concatenate([[0], np.searchsorted(starts, np.arange(0, len(data), CHUNK_BYTES)), [len(starts)]]))
            cuts = cuts if len(cuts) > 1 else np.array([0, 0])
            parts = [raw[starts[a] : ends[min(b + N - 1, len(starts)) - 1]] if b > a else b"" for a, b in zip(cuts, cuts[1:], strict=False)]
            n, digest = len(parts), hashlib.sha256(raw).digest()
            fixed = [pa.array([batch.column(0)[row].as_py()] * n, pa.int64()), pa.array([digest] * n, pa.binary()), pa.array([n] * n, pa.int32())]
            yield pa.RecordBatch.from_arrays([*fixed, pa.array(np.diff(cuts).astype(np.int32)), pa.array(parts, pa.binary())], ["id", "digest", "n_chunks", "own", "body"])


def chunked(texts: DataFrame) -> DataFrame:
    """(id, digest, n_chunks, own, body) of (id, text): whole texts, and the chunks of those that are longer, dealt by hash.

    Whole texts have no digest and own all words (-1).
    """
    rows = texts.select(F.col("id").cast("long").alias("id"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("body"))
    long = rows.where(F.octet_length("body") > CHUNK_BYTES).mapInArrow(_cut, "id long, digest binary, n_chunks int, own int, body binary")
    whole = rows.where(F.octet_length("body") <= CHUNK_BYTES).select("id", F.lit(None).cast("binary").alias("digest"), F.lit(1).alias("n_chunks"), F.lit(-1).alias("own"), "body")
    return whole.union(long.repartition("digest", F.xxhash64("body")))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    count = np.zeros(BUCKETS, np.int64)
    for batch in batches:
        own = batch.column(0).to_numpy(zero_copy_only=False)
        for first, last, data, offsets in binary_chunks(batch.column(1)):
            for bucket in features(data, offsets, own[first:last])[0]:
                count += np.bincount(bucket[bucket >= 0], minlength=BUCKETS)
    found = np.flatnonzero(count)
    yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), pa.array(count[found])], ["bucket", "n"])


def counts(chunks: DataFrame, name: str) -> DataFrame:
    """(bucket, name): features in each bucket; a task adds up its own first."""
    return chunks.select("own", "body").mapInArrow(_counted, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias(name))


def gains(raw: DataFrame, target: DataFrame) -> list[int]:
    """The gain of every bucket, from the chunks of all documents and of the target's texts; ``BUCKETS`` numbers."""
    both = counts(raw, "s").join(counts(target, "t"), "bucket", "full").na.fill(0, ["s", "t"])
    total = both.agg(F.coalesce(F.sum("s"), F.lit(0)), F.coalesce(F.sum("t"), F.lit(0))).first()
    n_raw, n_target = (F.lit(float(x + BUCKETS)) for x in total)
    ratio = (F.col("t") + 1).cast("double") * n_raw / ((F.col("s") + 1).cast("double") * n_target)
    spine = raw.sparkSession.range(BUCKETS).select(F.col("id").cast("int").alias("bucket"))
    each = spine.join(both, "bucket", "left").na.fill(0, ["s", "t"]).select("bucket", F.floor(1000 * F.log(ratio)).alias("gain"))
    return [g for _, g in sorted(map(tuple, each.collect()))]


def _weighed(gain: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        more = np.append(gain, 0)
        for batch in batches:
            own = batch.column(3).to_numpy(zero_copy_only=False)
            for first, last, data, offsets in binary_chunks(batch.column(4)):
                found, begins = features(data, offsets, own[first:last])
                sums = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[begins])  # noqa: B023, E731
                figures = [sums(found[0] >= 0), sums(sum((b >= 0).astype(np.int64) for b in found)), sums(sum(more[b] for b in found))]
                part = batch.slice(first, last - first)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), *[pa.array(x.astype(np.int64)) for x in figures]], ["id", "digest", "n_chunks", "n_words", "n_features", "weight"])

    return run


def weighed(chunks: DataFrame, gain: list[int]) -> DataFrame:
    """(id, n_words, n_features, weight) of every document, chunks summed by document.

    Equal rows have equal chunks, which stand together; their sums are shared out evenly.
    """
    names = ["n_words", "n_features", "weight"]
    rows = chunks.mapInArrow(_weighed(np.array(gain, np.int64)), "id long, digest binary, n_chunks int, n_words long, n_features long, weight long")
    rows = durable(rows, "chunk-weights")
    sums = rows.where("digest IS NOT NULL").groupBy("id", "digest", "n_chunks").agg(*[F.sum(c).alias(c) for c in names], F.count("*").alias("rows"))
    copies = F.floor(F.col("rows") / F.col("n_chunks")).cast("long")
    long = sums.withColumn("copies", copies).select("id", *[F.expr(f"{c} div copies").alias(c) for c in names], F.explode(F.sequence(F.lit(1).cast("long"), copies)).alias("_")).drop("_")
    return rows.where("digest IS NULL").select("id", *names).union(long)


def noise(key: Column, seed: int = SEED) -> Column:
    """Floored thousandths of Gumbel noise, hashed from the seed and the id; a missing id is an empty one."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text", percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_features, weight, score, rank.

    Of the N documents with ``least_words`` words, floor(percent N / 100) of highest score
    are drawn and ranked from 1, ties by ascending id, missing ids last; others have no
    rank.  Null, empty and wordless texts have no features and weight 0.  Repeated rows and
    ids are documents one by one.  Without target texts or documents all gains come from
    the smoothing alone; an empty table gives an empty result.  Other columns are not looked at.
    """
    chunks = chunked(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")))
    aims = chunked(target.select(F.lit(None).cast("long").alias("id"), F.col(target_text_col).alias("text")))
    rows = weighed(chunks, gains(chunks, aims)).withColumn("score", F.col("weight") + noise(F.col("id"), seed))
    rows = durable(rows, "weights")
    enough = rows.where(F.col("n_words") >= least_words)
    drawn = enough.count() * percent // 100
    order = [F.desc("score"), F.asc_nulls_last("id"), F.col("weight"), F.col("n_features"), F.col("n_words")]
    ranked = numbered(enough, order, "rank").withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    names = [F.col("id").alias("doc_id"), "n_features", "weight", "score", "rank"]
    return ranked.select(*names).union(rows.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long")).select(*names))


ORACLE = r"""
WITH RECURSIVE k(i, step, c) AS (SELECT i, 0, i FROM range(256) t(i) UNION ALL SELECT i, step + 1, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM k WHERE step < 8),
tab AS (SELECT i, c FROM k WHERE step = 8),
texts AS (SELECT 1 AS raw, doc_id AS id, text FROM documents UNION ALL SELECT 0, item_id, text FROM benchmark),
w AS (SELECT raw, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM texts),
f AS (SELECT raw, id, unnest([array_to_string(words[i : i + n - 1], ' ') FOR i IN range(1, len(words) - n + 2)]) AS feature FROM w, (VALUES (1), (2), (3)) v(n) WHERE len(words) >= n),
d AS (SELECT feature, hex(encode(feature)) AS bytes FROM (SELECT DISTINCT feature FROM f)),
r(feature, bytes, pos, c) AS (SELECT feature, bytes, 0, 4294967295 FROM d
  UNION ALL SELECT feature, bytes, pos + 1, xor(tab.c, r.c >> 8) FROM r JOIN tab ON tab.i = xor(r.c & 255, ('0x' || substr(bytes, 2 * pos + 1, 2))::BIGINT) WHERE 2 * pos < len(bytes)),
b AS (SELECT feature, (xor(c, 4294967295) % 10000)::INTEGER AS bucket FROM r WHERE 2 * pos = len(bytes)),
x AS (SELECT raw, id, bucket FROM f JOIN b USING (feature)),
n AS (SELECT bucket, count(*) FILTER (raw = 1) AS s, count(*) FILTER (raw = 0) AS t FROM x GROUP BY bucket),
g AS (SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * (sum(s) OVER () + 10000)::DOUBLE / ((s + 1)::DOUBLE * (sum(t) OVER () + 10000)::DOUBLE)))::BIGINT AS gain FROM n),
m AS (SELECT id, count(*) AS n_features, sum(gain)::BIGINT AS weight FROM x JOIN g USING (bucket) WHERE raw = 1 GROUP BY id),
o AS (SELECT w.id AS doc_id, len(words) >= 20 AS enough, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
             coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || w.id), 1, 8))::BIGINT + 0.5) / 4294967296.0::DOUBLE)))::BIGINT AS score FROM w LEFT JOIN m USING (id) WHERE raw = 1),
q AS (SELECT *, CASE WHEN enough THEN row_number() OVER (PARTITION BY enough ORDER BY score DESC, doc_id) END AS place, 5 * count(*) FILTER (enough) OVER () // 100 AS drawn FROM o)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= drawn THEN place END AS rank FROM q
"""
