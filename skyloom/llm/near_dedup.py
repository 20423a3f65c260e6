"""MinHash near-duplicate detection on SetSketch registers.

Every document's set of word shingles is sketched into registers that hold
exponentially spaced, truncated minima.  Bands of equal registers propose pairs,
a joint maximum-likelihood estimate over both sketches drops hopeless ones, and
the rest are verified on the full sets of word tuples.

Copies collapse to their smallest id before any pair is made: their sets have
equal sizes and hashes, and are then compared whole.  A bucket of at most
``PAIR_BUCKET`` sets yields its pairs; a larger one first yields stars around
three of its members.  Wide buckets that still hold several components are then
searched in blocks: a task holds two blocks of bounded size, skips pairs that are
connected already, verifies the rest and returns only the links that connect.
First a few members stand for each component, each in its widest bucket only; then
all members of the buckets that still hold several components are searched.  No
link between components is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import binary_chunks, lower, mix, prefix_sums, span_hash, word_spans
from . import common
from .components import components

#: Tables are written with few rows at a time, as rows hold one or two whole texts.
durable = partial(common.durable, batch_rows=1000)

#: Registers, bands of registers, the registers' base and their truncation.
REGISTERS, BANDS, BASE, TOP = 160, 32, 1.02, 65535
#: Sets in a bucket up to which all its pairs are made at once.
PAIR_BUCKET = 8
#: Members of a block of a wide bucket; a task of the block search holds two.
BLOCK = 512
#: Members that stand for a component in the first search of wide buckets.
STAND_INS = 8
#: Share of all band rows (one in so many) from which on a bucket is hot, so that there are at most as many such buckets.
HOT_SHARE = 10_000
#: Natural-log likelihood by which the wanted similarity must lose before a pair is dropped unseen.
DOUBT = 14.0
#: Ids up to which the verified documents are picked by a broadcast of their ids.
BROADCAST_IDS = 200_000

_seed = np.random.Generator(np.random.PCG64(20240229))
_MUL = (_seed.integers(0, 1 << 32, REGISTERS, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)[:, None]
_ADD = _seed.integers(0, 1 << 32, REGISTERS, dtype=np.uint64).astype(np.uint32)[:, None]
_SHIFT = int(np.log(32.0) / np.log(BASE))


def registers(shingles: np.ndarray) -> np.ndarray:
    """SetSketch registers of a set of 64-bit shingle hashes: floor(1 - log_b of the least exponential), truncated."""
    h = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(REGISTERS, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(h), 512):
        np.minimum(least, (h[None, i : i + 512] * _MUL + _ADD).min(axis=1), out=least)
    x = -np.log1p(-(least + 0.5) / 4294967296.0)
    return np.clip(np.floor(1 - np.log(x) / np.log(BASE)) + _SHIFT, 0, TOP).astype(np.uint16)


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Distinct hashes of the runs of ``size`` words; of the whole sequence if it is shorter."""
    if not len(words):
        return words
    n = max(1, len(words) - size + 1)
    out = np.zeros(n, np.uint64)
    for k in range(min(size, len(words))):
        out = mix(out + words[k : k + n] + np.uint64(k + 1))
    return np.unique(out)


def _sketch(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for first, last, data, offsets in binary_chunks(batch.column(1)):
                starts, ends, at = word_spans(data, offsets)
                words = span_hash(prefix_sums(lower(data)), starts, ends)
                n, one, two, sketches = [], [], [], []
                for i in range(last - first):
                    own = shingle_hashes(words[at[i] : at[i + 1]], size)
                    n.append(len(own))
                    one.append(int(own.sum(dtype=np.uint64).view(np.int64)))
                    two.append(int(np.bitwise_xor.reduce(mix(own + np.uint64(77))).view(np.int64)) if len(own) else 0)
                    sketches.append(registers(own).tobytes() if len(own) else b"")
                yield pa.RecordBatch.from_arrays([ids.slice(first, last - first), pa.array(n, pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64()), pa.array(sketches, pa.binary())], ["id", "n", "k1", "k2", "sketch"])

    return run


def _band_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    width = REGISTERS // BANDS
    for batch in batches:
        if not batch.num_rows:
            continue
        r = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(-1, BANDS, width).astype(np.uint64)
        key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), r.shape[:2]) * np.uint64(0x9E3779B97F4A7C15)
        for k in range(width):
            key = mix(key + r[:, :, k] + np.uint64(1))
        ids, bands = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), BANDS), np.tile(np.arange(BANDS, dtype=np.int32), len(r))
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(bands), pa.array(key.ravel().view(np.int64))], ["id", "band", "key"])


def estimate(d_up: np.ndarray, d_down: np.ndarray, d_same: np.ndarray, u: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Joint maximum-likelihood Jaccard of sketch pairs, and by how much ``least`` loses to it.

    d_up, d_down, d_same count registers that are larger, smaller and equal; u is the
    first set's share of both sizes, and the similarity cannot exceed the ratio of sizes.
    """
    v = 1 - u
    top = np.minimum(u, v) / np.maximum(u, v)
    grid = np.append(np.linspace(0, 1, 81), least)[None, :]
    j = np.minimum(grid, top[:, None])
    p = lambda x: -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)
    up, down = p(u[:, None] - v[:, None] * j), p(v[:, None] - u[:, None] * j)
    same = np.maximum(1 - up - down, 1e-12)
    like = d_up[:, None] * np.log(np.maximum(up, 1e-9)) + d_down[:, None] * np.log(np.maximum(down, 1e-9)) + d_same[:, None] * np.log(same)
    best = like.argmax(axis=1)
    got = j[np.arange(len(u)), best]
    return got, np.where(got >= least, 0.0, like.max(axis=1) - like[:, -1])


def _likely(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            n1, n2 = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.float64) for i in (2, 4))
            a, b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint16).reshape(-1, REGISTERS) for i in (3, 5))
            up, down = (a > b).sum(axis=1), (a < b).sum(axis=1)
            _, loss = estimate(up, down, REGISTERS - up - down, n1 / (n1 + n2), percent / 100)
            keep = pa.array((loss < DOUBT) & (100 * np.minimum(n1, n2) >= percent * np.maximum(n1, n2)))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["u", "v"])

    return run


def shingle_set(text: str | None, size: int) -> set:
    """The full set of a text's shingles, as word tuples."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if len(words) <= size:
        return {tuple(words)} if words else set()
    return set(zip(*(words[k:] for k in range(size)), strict=False))


def _verified(percent: int, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, own = None, set()
        for batch in batches:
            u, v = [], []
            for a, b, s, t in zip(*(batch.column(i) for i in range(4)), strict=True):
                # An id may have several texts.
                if last != (b, t):
                    last, own = (b, t), shingle_set(t.as_py(), size)
                other = shingle_set(s.as_py(), size)
                both = len(own & other)
                if 100 * both >= percent * (len(own) + len(other) - both):
                    u.append(a.as_py())
                    v.append(b.as_py())
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    return run


def _candidates(group: pa.Table, apart: bool, percent: int, first: bool):
    """(place, earlier places) of the pairs of different components in a task's blocks that the estimate does not drop, and the members' components.

    With ``first``, a pair is looked at only in the first band that it shares.
    """
    block, label, n, band = (group.column(x).to_numpy().copy() for x in ("block", "c", "n", "band"))
    r = np.frombuffer(b"".join(group.column("sketch").to_pylist()), np.uint16).reshape(-1, REGISTERS)

    def pairs() -> Iterator[tuple[int, np.ndarray]]:
        for a in range(1, len(label)):
            b = np.flatnonzero((label[:a] != label[a]) & (100 * np.minimum(n[:a], n[a]) >= percent * np.maximum(n[:a], n[a])))
            b = b[block[b] != block[a]] if apart else b
            if first:
                b = b[(r[b] == r[a]).reshape(-1, BANDS, REGISTERS // BANDS).all(axis=2).argmax(axis=1) == band[a]]
            if len(b):
                up, down = (r[a] > r[b]).sum(axis=1), (r[a] < r[b]).sum(axis=1)
                _, loss = estimate(up, down, REGISTERS - up - down, n[a] / (n[a] + n[b]), percent / 100)
                yield a, b[loss < DOUBT]

    return label, pairs


def _connecting(percent: int, size: int, first: bool):
    """Components that are linked by members of a bucket's two blocks (one, if they are the same)."""

    def run(key: tuple, group: pa.Table) -> pa.Table:
        group = group.sort_by("id")
        label, pairs = _candidates(group, key[1].as_py() != key[2].as_py(), percent, first)
        texts, sets, was, u, v = group.column("text"), {}, label.copy(), [], []

        def own(i: int) -> set:
            if i not in sets:
                sets[i] = shingle_set(texts[i].as_py(), size)
            return sets[i]

        for a, b in pairs():
            for i in b:
                if label[i] != label[a]:
                    both = len(own(a) & own(i))
                    if 100 * both >= percent * (len(own(a)) + len(own(i)) - both):
                        u.append(was[a])
                        v.append(was[i])
                        label[label == label[i]] = label[a]
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    return run


def _mixed(placed: DataFrame) -> DataFrame:
    """Rows of the wide buckets that hold several components."""
    keys = durable(placed.groupBy("key").agg(F.min("c").alias("least"), F.max("c").alias("most")).where("least < most").select("key"), "mixed")
    return placed.join(F.broadcast(keys) if keys.count() <= BROADCAST_IDS else keys, "key")


def _standing(placed: DataFrame) -> DataFrame:
    """Each member in its widest bucket only, and of each component there at most ``STAND_INS`` members."""
    one = placed.groupBy("id").agg(F.max(F.struct("members", "key", "band", "c")).alias("x")).select("id", "x.band", "x.key", "x.c")
    turn = F.row_number().over(Window.partitionBy("key", "c").orderBy(F.xxhash64("id"), "id"))
    few = durable(one.withColumn("turn", turn).where(F.col("turn") <= STAND_INS).drop("turn"), "stand-ins")
    return few.join(few.groupBy("key").agg(F.count("*").alias("members")), "key").select("id", "band", "key", "members", "c")


def _searched(rows: DataFrame, docs: DataFrame, sets: DataFrame, percent: int, size: int, first: bool) -> DataFrame:
    """Linked components (u, v) of the rows' buckets, which are searched two blocks at a time, as a written table."""
    blocks = F.greatest(F.lit(1), F.ceil(F.col("members") / BLOCK)).cast("int")
    rows = rows.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.withColumns({"low": F.least("block", "other"), "high": F.greatest("block", "other")}).drop("other", "blocks", "members")
    rows = durable(rows, "open")
    held = _texts(docs, rows.select("id").distinct()).join(sets, "id")
    rows = rows.join(held, "id").select("id", "band", "key", "c", "n", "block", "low", "high", "sketch", "text")
    return durable(rows.groupBy("key", "low", "high").applyInArrow(_connecting(percent, size, first), "u long, v long"), "more")


def _texts(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The documents of ``ids``, which are broadcast only if they are counted to be few."""
    ids = durable(ids, "ids")
    return docs.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "id", "left_semi")


def _equal(size: int):
    """Rows (id, rep, whether own and class text have equal sets); null stands for texts that are equal."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            same = [not a.is_valid or shingle_set(a.as_py(), size) == shingle_set(b.as_py(), size) for a, b in zip(batch.column(2), batch.column(3), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(same, pa.bool_())], ["id", "rep", "same"])

    return run


def _classes(every: DataFrame, docs: DataFrame, size: int, repeated: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``every`` with the representative of each row's class of equal sets, and sketches of those only; (id, rep) of all others; and the ids whose whole sets are not their class's.

    The last are none but for a clash of 128 bits of hash; such rows are sets of their own.
    """
    classes = every.where("id IS NOT NULL AND n > 0").groupBy("n", "k1", "k2").agg(F.min("id").alias("rep"), F.count("*").alias("rows"))
    classes = durable(classes.where("rows > 1").drop("rows"), "classes")
    rows = every.join(F.broadcast(classes) if classes.count() <= BROADCAST_IDS else classes, ["n", "k1", "k2"], "left")
    rows = rows.withColumn("rep", F.when(F.col("id").isNotNull(), F.coalesce("rep", "id")))
    rows = durable(rows.select("id", "n", "rep", F.when(F.col("id") == F.col("rep"), F.col("sketch")).alias("sketch")), "classed")
    copies = _once(rows.where("id <> rep").select("id", "rep"), repeated)
    both = _texts(docs, copies.select("id").union(classes.select(F.col("rep").alias("id"))))
    pairs = copies.join(both.select(F.col("id").alias("rep"), F.col("text").alias("other")), "rep").join(both, "id").where("text IS NOT NULL AND other IS NOT NULL")
    # Equal texts need no sets; texts that differ, in white space or case say, do.
    pairs = pairs.select("id", "rep", *[F.when(F.col("text") != F.col("other"), F.col(x)).alias(x) for x in ("text", "other")])
    same = pairs.mapInArrow(_equal(size), "id long, rep long, same boolean")
    same = same.groupBy("id", "rep").agg(F.max("same").alias("same")) if repeated else same
    return rows, copies, durable(_once(same.where("NOT same").select("id"), repeated), "clashes")


def _once(rows: DataFrame, repeated: bool) -> DataFrame:
    """``rows`` without repeats, as a written table; as they are, if no id is repeated."""
    return durable(rows.distinct(), "once") if repeated else rows


def _links(pairs: DataFrame, sets: DataFrame, docs: DataFrame, percent: int, size: int) -> DataFrame:
    """Those of ``pairs`` (u, v) whose full sets are similar enough, as a written table."""
    one, two = (sets.select(F.col("id").alias(x), F.col("n").alias(f"n_{x}"), F.col("sketch").alias(f"s_{x}")) for x in "uv")
    # No u is in more pairs than its bands' small buckets and centres give, so pairs may be told apart where they meet u.
    likely = pairs.repartition("u").distinct().join(one, "u").join(two, "v").where(f"100 * least(n_u, n_v) >= {percent} * greatest(n_u, n_v)")
    likely = durable(likely.select("u", "v", "n_u", "s_u", "n_v", "s_v").mapInArrow(_likely(percent), "u long, v long"), "likely")
    texts = _texts(docs, likely.select(F.explode(F.array("u", "v")).alias("id")).distinct())
    full = likely.join(texts.select(F.col("id").alias("u"), F.col("text").alias("t_u")), "u").join(texts.select(F.col("id").alias("v"), F.col("text").alias("t_v")), "v")
    return durable(full.select("u", "v", "t_u", "t_v").mapInArrow(_verified(percent, size), "u long, v long"), "links")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: id, n_shingles, component_id, kept.

    Documents are linked if 100 * intersection >= ``percent`` * union of their
    shingle sets.  component_id is the smallest id reachable over links, itself
    included; kept marks that document.  A null or wordless text has an empty set
    and stays alone; a text with fewer words than a shingle has its whole sequence
    as its one shingle.  Rows without id take no part and have no component.  Rows
    of one id are one document, linked by any of their texts, each with its own
    n_shingles.  An empty table gives an empty result; other columns are not looked at.
    """
    whole = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    every = durable(whole.mapInArrow(_sketch(shingle_words), "id long, n long, k1 long, k2 long, sketch binary"), "sketches")
    docs, known = whole.where("id IS NOT NULL"), every.where("id IS NOT NULL")
    # With each id on one row, as usual, no step has repeats to drop, which saves it a shuffle.
    repeated = (known.groupBy("id").count().agg(F.max("count")).first()[0] or 0) > 1
    classed, copies, wrong = _classes(every, docs, shingle_words, repeated)
    clash = not wrong.isEmpty()
    sets = classed.where("n > 0 AND id = rep").select("id", "n", "sketch")
    if clash:
        copies = durable(copies.join(wrong, "id", "left_anti"), "copies")
        sets = sets.union(known.where("n > 0").join(wrong, "id", "left_semi").select("id", "n", "sketch"))
    # A copy is not sketched again, but an id may have another row whose set is no copy.
    sets = _once(sets, repeated)
    banded = sets.select("id", "sketch").mapInArrow(_band_keys, "id long, band int, key long")
    banded = banded.distinct() if repeated else banded
    # One order for all buckets, so that buckets of one group have the same centres and yield the same pairs.
    order = F.xxhash64("id")
    size = banded.groupBy("key").agg(F.count("*").alias("members"), F.min("id").alias("first"), F.min_by("id", order).alias("second"), F.max_by("id", order).alias("third")).where("members > 1")
    size = durable(size, "buckets")
    # Rows of hot buckets are told by a broadcast, which is bounded by HOT_SHARE, so that no task gathers such a bucket.
    hot = (size.agg(F.sum("members")).first()[0] or 0) // HOT_SHARE + 1000
    many = size.where(F.col("members") > hot)
    banded = durable(banded.join(F.broadcast(many), "key").union(banded.join(F.broadcast(many.select("key")), "key", "left_anti").join(size.where(F.col("members") <= hot), "key")), "bands")
    wide = banded.where(f"members > {PAIR_BUCKET}")
    star = wide.select(F.col("id").alias("u"), F.explode(F.array("first", "second", "third")).alias("v")).where("u <> v")
    few = banded.where(f"members <= {PAIR_BUCKET}").select("id", "key")
    pairs = few.alias("x").join(few.alias("y"), F.expr("x.key = y.key AND x.id > y.id")).selectExpr("x.id AS u", "y.id AS v")
    links = _links(star.union(pairs), sets, docs, percent, shingle_words)
    if repeated:
        # Ids with several sets join them.
        turns = copies.select("id", "rep").union(sets.select("id", F.col("id").alias("rep"))).groupBy("id").agg(F.collect_set("rep").alias("reps")).where("size(reps) > 1")
        links = links.union(turns.select(F.explode("reps").alias("u"), F.array_min("reps").alias("v")).where("u <> v"))
    found = durable(components(links), "components")
    if not wide.isEmpty():
        place = lambda found: _mixed(wide.join(found, "id", "left").select("id", "band", "key", "members", F.coalesce("component_id", "id").alias("c")))
        for rows, first in ((lambda: _standing(place(found)), False), (lambda: place(found), True)):
            more = _searched(rows(), docs, sets, percent, shingle_words, first)
            if not more.isEmpty():
                found = durable(components(found.select(F.col("id").alias("u"), F.col("component_id").alias("v")).union(more)), "components")
    out = classed.select("id", "n", "rep")
    if clash:
        out = out.join(wrong.select("id", F.lit(True).alias("wrong")), "id", "left").withColumn("rep", F.when(F.col("wrong"), F.col("id")).otherwise(F.col("rep")))
    out = out.join(found.select(F.col("id").alias("rep"), "component_id"), "rep", "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component_id", "rep"))
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))
