"""Exact top-k inner products by a three-phase uniform threshold.

A vector's score is the sum of the partial scores of its ``SLICES`` slices of
components.  Phase 1 scores only the first slice, that of most energy, takes each
local list's k best by it and resolves these; the k-th best of all lists is a
cutoff that no answer can be below.  Phase 2 sends the cutoff back: an entry is
sufficient if its partial score and the most that its remaining slices can add,
by their norms, reach the cutoff.  Phase 3 forms the remaining slices, one after
the other, for sufficient entries only; what has all slices is exact.

Queries meet candidates in packed blocks of bounded size.  A candidate is sent
once for each ``QUERY_BLOCK`` queries and a query once for each block of candidates.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, mix

SLICES = 4
#: Most rows of a block, least rows of a block of candidates, and queries that are multiplied at once.
QUERY_BLOCK, CANDIDATE_BLOCK, LEAST_BLOCK, STEP = 32_768, 65_536, 1024, 64
#: Components must stay below this, so that they are exact in a double.
MOST = 2.0**53
#: Share of sufficient entries up to which they are resolved one by one and not by whole products.
SPARSE = 0.1
_NONE = np.iinfo(np.int64).min


def quantised(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component, as long; null for a vector that is null or has a null or non-finite component.

    A component of ``MOST`` or more after scaling is an error: it would not be exact.
    """
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    step = lambda x: F.when(F.abs(F.lit(scale) * x.cast("double")) < MOST, F.floor(F.lit(scale) * x.cast("double"))).otherwise(F.raise_error(F.lit("a component is too large for exact scores")).cast("long"))
    return F.when(vector.isNotNull() & fine, F.transform(vector, step))


def _packed(blocks: int):
    """Rows (id, v, cutoff) as packed matrices by dimension and block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, cutoff = batch.column(0).to_numpy(zero_copy_only=False), batch.column(2).to_numpy(zero_copy_only=False)
            v = batch.column(1)
            flat = v.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            offsets = np.asarray(v.offsets)
            size, start = np.diff(offsets), offsets[:-1] - offsets[:1]
            block = (mix(ids.astype(np.int64).view(np.uint64)) % np.uint64(blocks)).astype(np.int64)
            rows = []
            for dim, b in np.unique(np.stack([size, block], axis=1), axis=0).tolist():
                own = np.flatnonzero((size == dim) & (block == b))
                values = flat[start[own][:, None] + np.arange(dim)]
                kind = np.min_scalar_type(-int(np.abs(values).max(initial=0)) - 1)
                rows.append((dim, b, ids[own].astype(np.int64).tobytes(), cutoff[own].astype(np.int64).tobytes(), kind.str, values.astype(kind).tobytes()))
            names = ("dim", "block", "ids", "cutoff", "kind", "data")
            columns = zip(*rows, strict=True) if rows else [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.string(), pa.binary()), strict=True)], names)

    return run


_PACKED = "dim int, block int, ids binary, cutoff binary, kind string, data binary"


def _matrix(table: pa.Table, dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, cutoffs, matrix) of packed rows."""
    rows = table.to_pylist()
    take = lambda name: np.concatenate([np.frombuffer(r[name], np.int64) for r in rows])
    ids = take("ids")
    return ids, take("cutoff"), np.concatenate([np.frombuffer(r["data"], r["kind"]).astype(np.int64) for r in rows]).reshape(len(ids), dim)


def _arranged(queries: np.ndarray, candidates: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """Both matrices with the components of most energy first, in a type in which all sums are exact, and the slices."""
    dim = queries.shape[1]
    most = max(int(np.abs(queries).max(initial=0)), 1) * max(int(np.abs(candidates).max(initial=0)), 1) * max(dim, 1)
    kind = np.float64 if most < 2**52 else np.int64 if most < 2**62 else object
    energy = (queries.astype(np.float64) ** 2).sum(axis=0) * (candidates.astype(np.float64) ** 2).sum(axis=0)
    order = np.argsort(-energy, kind="stable")
    cuts = [int(x) for x in np.linspace(0, dim, SLICES + 1)]
    return queries[:, order].astype(kind), candidates[:, order].astype(kind), list(zip(cuts, cuts[1:], strict=False))


def _best(k: int, query: np.ndarray, vec: np.ndarray, score: np.ndarray) -> np.ndarray:
    """Places of each query's k best entries, ties to the smaller vector id."""
    order = np.lexsort((vec, -score, query))
    q = query[order]
    return order[np.arange(len(q)) - np.searchsorted(q, q) < k]


def local_lists(k: int, qid: np.ndarray, queries: np.ndarray, cid: np.ndarray, candidates: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Phase 1: (query place, candidate place, whole score) of each query's k best candidates by the first slice."""
    q, c, slices = _arranged(queries, candidates)
    a, b = slices[0]
    found = []
    for i in range(0, len(q), STEP):
        part = (q[i : i + STEP, a:b] @ c[:, a:b].T).astype(np.float64)
        part[qid[i : i + STEP, None] == cid[None, :]] = -np.inf
        pick = np.argpartition(-part, min(k, len(cid)) - 1, axis=1)[:, : min(k, len(cid))]
        row = np.repeat(np.arange(i, i + len(part)), pick.shape[1])
        pick = pick.ravel()
        own = qid[row] != cid[pick]
        row, pick = row[own], pick[own]
        found.append((row, pick, (q[row] * c[pick]).sum(axis=1)))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def resolved(k: int, qid: np.ndarray, queries: np.ndarray, cutoff: np.ndarray, cid: np.ndarray, candidates: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Phases 2 and 3: (query place, candidate place, score) of the entries that reach their query's cutoff, and how many were resolved.

    A cutoff of the least long lets every entry pass.
    """
    q, c, slices = _arranged(queries, candidates)
    norm = lambda x: np.sqrt(np.stack([(x[:, b:].astype(np.float64) ** 2).sum(axis=1) for _, b in slices], axis=1))
    q_left, c_left = norm(q), norm(c)
    found, n = [], 0
    for i in range(0, len(q), STEP):
        own = q[i : i + STEP]
        limit = np.where(cutoff[i : i + STEP] == _NONE, -np.inf, cutoff[i : i + STEP].astype(np.float64))[:, None]
        # A little more than the bound and less than the cutoff make up for rounding; what passes is exact in the end.
        limit = limit - 1 - np.abs(limit) * 1e-12
        a, b = slices[0]
        score = own[:, a:b] @ c[:, a:b].T
        open_ = score.astype(np.float64) + np.outer(q_left[i : i + STEP, 0], c_left[:, 0]) * (1 + 1e-9) >= limit
        open_ &= qid[i : i + STEP, None] != cid[None, :]
        row, col = np.nonzero(open_)
        got = score[row, col]
        for s, (a, b) in enumerate(slices[1:], 1):
            if len(row) > SPARSE * open_.size:
                got = got + (own[:, a:b] @ c[:, a:b].T)[row, col]
            else:
                got = got + np.einsum("ij,ij->i", own[row, a:b], c[col, a:b]) if own.dtype != object else got + (own[row, a:b] * c[col, a:b]).sum(axis=1)
            n += len(row) if s == 1 else 0
            keep = got.astype(np.float64) + q_left[i + row, s] * c_left[col, s] * (1 + 1e-9) >= limit[row, 0]
            row, col, got = row[keep], col[keep], got[keep]
        found.append((row + i, col, got))
    return *(np.concatenate(x) for x in zip(*found, strict=True)), n


def _meet(k: int, second: bool):
    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        out = [np.empty(0, np.int64)] * 3
        if left.num_rows and right.num_rows:
            qid, cutoff, queries = _matrix(left, key[0].as_py())
            cid, _, candidates = _matrix(right, key[0].as_py())
            row, col, score = resolved(k, qid, queries, cutoff, cid, candidates)[:3] if second else local_lists(k, qid, queries, cid, candidates)
            if score.dtype == object and len(score) and max(abs(int(score.max())), abs(int(score.min()))) >= 2**63:
                raise OverflowError("a score does not fit a long")
            best = _best(k, qid[row], cid[col], score.astype(np.int64))
            out = [qid[row][best], cid[col][best], score[best].astype(np.int64)]
        return pa.table(dict(zip(("query_id", "vec_id", "score"), out, strict=True)))

    return run


def exact_top_k(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score) of each query's k best integer inner products, ties to the smaller vec_id.

    Both tables have ``id`` long and ``v`` array<long>; rows with a null vector or id
    take no part.  Candidates are all rows with another id than the query's and a
    vector of its length; of queries with one id, that of the least vector is asked.
    A query without candidates has no rows.  Components are below 2^53 in size; a
    score that does not fit a long is an error.
    """
    spark = vectors.sparkSession
    held = lambda t: t.where("v IS NOT NULL AND id IS NOT NULL").select(F.col("id").cast("long").alias("id"), F.col("v").cast("array<long>").alias("v"))
    vectors, queries = durable(held(vectors), "vectors"), durable(held(queries).groupBy("id").agg(F.min("v").alias("v")), "queries")
    n = vectors.count()
    c_blocks = max(1, -(-n // CANDIDATE_BLOCK), min(-(-n // LEAST_BLOCK), int(spark.conf.get("spark.sql.shuffle.partitions"))))
    q_blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    dealt = lambda t, own, blocks, other, times: t.select("id", "v", "cutoff").mapInArrow(_packed(blocks), _PACKED).withColumnRenamed("block", own).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(times - 1)))).groupBy("dim", "qb", "cb")
    none = F.lit(_NONE).alias("cutoff")
    right = dealt(vectors.select("*", none), "cb", c_blocks, "qb", q_blocks)
    schema = "query_id long, vec_id long, score long"
    first = dealt(queries.select("*", none), "qb", q_blocks, "cb", c_blocks).cogroup(right).applyInArrow(_meet(k, False), schema)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    safe = first.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).groupBy("query_id").agg(F.when(F.count("*") == k, F.min("score")).alias("cutoff"))
    safe = durable(queries.join(safe, queries.id == safe.query_id, "left").select("id", "v", F.coalesce("cutoff", none).alias("cutoff")), "cutoffs")
    second = dealt(safe, "qb", q_blocks, "cb", c_blocks).cogroup(right).applyInArrow(_meet(k, True), schema)
    return second.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 5
"""
