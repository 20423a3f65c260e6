"""Removal of repeated passages by per-shard suffix arrays that are merged by binary search.

Every byte covered by a 50-byte string that also starts in a document of smaller
id goes.  Each 50-byte string has an anchor, the least-hashed gram inside it, so
equal strings have equal anchors; consecutive strings with one anchor form a
segment of at most 80 bytes.

1. The anchors' hashes are compared over all documents; only segments whose
   anchor occurs in several documents can repeat.
2. The texts of those segments go to shards by anchor.  Byte-equal segments of a
   batch travel as one text with the smallest id.
3. A shard builds suffix arrays of at most 2^20 bytes by Larsson-Sadakane
   refinement and takes common prefixes by Kasai's recurrence (a lane per
   segment).  Runs of suffixes with 50 bytes in common are the shard's strings,
   each with its smallest id, in sorted order.
4. Sorted string lists of several suffix arrays are merged by binary search:
   inside a shard that needs more than one array, and between shards for hot
   anchors, whose segments are dealt over many shards.

Hashes only place segments and propose equal ones; every equality that removes a
byte is read off a suffix array or compared byte by byte.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import binary_chunks, durable, mix

#: Bytes of a repeated string, of an anchor; grams of a string, and bytes of the longest segment.
LENGTH, GRAM = 50, 20
GRAMS = LENGTH - GRAM + 1
WIDTH = LENGTH + GRAMS - 1
#: Text bytes for each bucket of documents and for each shard of segments, and segments dealt at once.
BUCKET_BYTES, SHARD_BYTES, FLUSH = 8 << 20, 1 << 20, 1 << 19
#: Shards that travel as one group; text bytes packed at once and for each part of the anchors.  A piece is what one
#: sender has for one receiver, so pieces grow with the square of the input, and these keep them few and large.
GROUP, PACK_BYTES, ANCHOR_BYTES = 16, 32 << 20, 32 << 20
#: Segments of an anchor from which on it is dealt over several shards, at least; and the share of all text bytes
#: (a power of two) that this count grows with, which bounds the number of such anchors.
WIDE, WIDE_SHIFT = 4096, 20
#: Positions of a suffix array: ranks and places are packed into one 64-bit sort key.
ARRAY_BITS = 20
_PLACE_BITS = 24
#: Strings whose anchors are sought at once; a longer text is read in several steps.
_STEP = 1 << 21
_NOBODY = np.iinfo(np.int64).max
_ODD = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F, 0xEB44ACCAB455D165], np.uint64)


def freeze(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed value."""
    parts = [np.ascontiguousarray(a).view(np.uint8).ravel() for a in arrays]
    raw = np.concatenate([np.array([len(p) for p in parts], np.int64).view(np.uint8), *parts])
    return len(raw).to_bytes(8, "little") + pa.compress(raw.tobytes(), codec="zstd", asbytes=True)


def thaw(value: bytes, *types: type) -> list[np.ndarray]:
    """The arrays of :func:`freeze`, given their types."""
    raw = np.frombuffer(pa.decompress(value[8:], int.from_bytes(value[:8], "little"), codec="zstd", asbytes=True), np.uint8)
    sizes = raw[: 8 * len(types)].view(np.int64)
    ends = 8 * len(types) + np.cumsum(sizes)
    return [np.frombuffer(raw[e - s : e].tobytes(), t) for s, e, t in zip(sizes, ends, types, strict=True)]


def thawed(column: pa.ChunkedArray, *types: type) -> list[np.ndarray]:
    """The arrays of all values of a column, joined."""
    rows = [thaw(x, *types) for x in column.to_pylist()]
    return [np.concatenate([r[k] for r in rows]) if rows else np.empty(0, t) for k, t in enumerate(types)]


def _runs(key: np.ndarray) -> np.ndarray:
    """Where sorted keys change."""
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    return new


def _words(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as little-endian integers; zeros follow the end."""
    return np.ndarray((len(data) + WIDTH,), "<u8", np.concatenate([data, np.zeros(WIDTH + 8, np.uint8)]), strides=(1,))


def segments(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """(first string, strings, anchor's distance from it, anchor hash, row) of every segment, in page order.

    A row shorter than a string has none.
    """
    found = []
    size = np.diff(offsets)
    for step in range(0, max(len(data) - LENGTH + 1, 0), _STEP):
        part = data[step : step + _STEP + LENGTH - 1]
        n = len(part) - LENGTH + 1
        w = _words(part)
        m = len(part) - GRAM + 1
        code = w[:m] * _ODD[0]
        code ^= code >> np.uint64(31)
        code += w[8 : m + 8] * _ODD[1]
        code ^= code >> np.uint64(29)
        code += w[GRAM - 8 : m + GRAM - 8]
        code *= _ODD[2]
        code ^= code >> np.uint64(32)
        least = (code & ~np.uint64((1 << _PLACE_BITS) - 1)) | np.arange(m, dtype=np.uint64)
        width = 1
        while width * 2 <= GRAMS:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        anchor = (np.minimum(least[:n], least[GRAMS - width : GRAMS - width + n]) & np.uint64((1 << _PLACE_BITS) - 1)).astype(np.int32)
        valid = np.ones(n + 2, bool)
        valid[0] = valid[-1] = False
        first, last = np.searchsorted(offsets, [step, step + n], "right")
        for row in range(max(first - 1, 0), min(last, len(size))):
            if size[row]:
                valid[max(offsets[row], offsets[row + 1] - LENGTH + 1, step) - step + 1 : max(offsets[row + 1] - step, 0) + 1] = False
        valid[-1] = False
        change = anchor[1:] != anchor[:-1]
        start, stop = valid[1:-1] & ~valid[:-2], valid[1:-1] & ~valid[2:]
        start[1:] |= valid[2:-1] & change
        stop[:-1] |= valid[1:-2] & change
        low, high = np.flatnonzero(start), np.flatnonzero(stop)
        at = anchor[low]
        found.append((low + step, high - low + 1, at - low, code[at]))
    low, n, off, code = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64))
    return low, n, off, code, np.searchsorted(offsets, low, "right") - 1


def _ids(column: pa.Array) -> np.ndarray:
    """Ids of a batch; a null one comes after all others."""
    return column.fill_null(_NOBODY).to_numpy(zero_copy_only=False).astype(np.int64)


def _keys(ids: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A key of each row by its id and whole text, so that repeated ids are told apart and repeated rows are one."""
    raw, code = memoryview(data), xxhash.xxh3_64_intdigest
    text = np.array([code(raw[a:b]) for a, b in zip(offsets.tolist(), offsets[1:].tolist(), strict=False)], np.uint64)
    return mix(text + mix(ids.view(np.uint64)))


def _tag(code: np.ndarray, shards: int) -> np.ndarray:
    """What is left of an anchor's hash: 32 bits besides its shard."""
    s = np.uint64(shards)
    return ((code // s) & np.uint64(0xFFFFFFFF)) * s + code % s


_SENT = "target int, kind tinyint, value binary"


def _sent(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    to, kind, value = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(to, pa.int32()), pa.array(kind, pa.int8()), pa.array(value, pa.binary())], ["target", "kind", "value"])


def _cuts(key: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(value, start, end) of the runs of sorted keys."""
    at = np.append(np.flatnonzero(_runs(key)), len(key))
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        yield int(key[a]), a, b


def _anchors(shards: int, buckets: int):
    """Anchor tags by shard.  A batch sends each anchor once; one of several documents also goes to their buckets (kind 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = []
            for first, last, data, offsets in binary_chunks(batch.column(1)):
                keys = _keys(_ids(batch.column(0).slice(first, last - first)), data, offsets)
                _, _, _, code, row = segments(data, offsets)
                parts.append((_tag(code, shards), keys[row]))
            tag, key = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.empty(0, np.uint64),) * 2
            if not len(tag):
                continue
            order = np.argsort(tag)
            tag, key = tag[order], key[order]
            start = np.flatnonzero(_runs(tag))
            count = np.diff(np.append(start, len(tag)))
            several = np.minimum.reduceat(key, start) != np.maximum.reduceat(key, start)
            rows = []
            # The weight is the count's bits, 0 for an anchor of one document.
            weight = np.where(several, np.frexp(count.astype(np.float64))[1], 0).astype(np.uint8)
            one, shard, bucket = tag[start], tag[start] % np.uint64(shards), key[start] % np.uint64(buckets)
            order = np.lexsort((bucket, shard))
            one, shard, bucket, weight = one[order], shard[order], bucket[order].astype(np.uint32), weight[order]
            for s, a, b in _cuts(shard):
                new = np.append(np.flatnonzero(_runs(bucket[a:b])), b - a)
                rows.append((s, 0, freeze((one[a:b] // np.uint64(shards)).astype(np.uint32), weight[a:b], bucket[a:b][new[:-1]], np.diff(new).astype(np.uint32))))
            known = np.repeat(several, count)
            tag, bucket = tag[known], key[known] % np.uint64(buckets)
            order = np.lexsort((tag, bucket))
            tag, bucket = tag[order], bucket[order]
            keep = _runs(tag) | _runs(bucket)
            tag, bucket = tag[keep], bucket[keep]
            for b, x, y in _cuts(bucket):
                rows.append((b % shards, 1, freeze(np.array([b], np.uint32), tag[x:y])))
            yield _sent(rows)

    return run


def _several(shards: int, wide: int):
    """Tags of anchors that occur in several documents, by bucket (kind 0); and those of hot anchors with their counts (kind 1)."""

    def run(key: tuple, group: pa.Table) -> pa.Table:
        kind = group.column("kind").to_numpy()
        tags, buckets, weights = [], [], []
        rows = []
        for k, value in zip(kind.tolist(), group.column("value").to_pylist(), strict=True):
            if k:
                b, tag = thaw(value, np.uint32, np.uint64)
                rows.append((int(b[0]), 0, freeze(tag)))
                continue
            tag, weight, bucket, count = thaw(value, np.uint32, np.uint8, np.uint32, np.uint32)
            tags.append(tag)
            weights.append(weight)
            buckets.append(np.repeat(bucket, count))
        if tags:
            tag, weight, bucket = np.concatenate(tags), np.concatenate(weights), np.concatenate(buckets)
            order = np.argsort(tag)
            tag, weight, bucket = tag[order].astype(np.uint64) * np.uint64(shards) + np.uint64(key[0].as_py()), weight[order], bucket[order]
            start = np.flatnonzero(_runs(tag))
            count = np.diff(np.append(start, len(tag)))
            total = np.add.reduceat(np.left_shift(np.int64(1), np.minimum(weight, 40).astype(np.int64)), start)
            hot = total >= wide
            if hot.any():
                rows.append((-1, 1, freeze(tag[start[hot]], total[hot])))
            wanted = np.repeat((count > 1) | (np.maximum.reduceat(weight, start) > 0), count)
            tag, bucket = tag[wanted], bucket[wanted]
            order = np.argsort(bucket, kind="stable")
            tag, bucket = tag[order], bucket[order]
            rows += [(b, 0, freeze(tag[x:y])) for b, x, y in _cuts(bucket)]
        return pa.Table.from_batches([_sent(rows)])

    return run


def _packed(buckets: int):
    """Whole documents by bucket, packed: ids, whether they are null, keys, sizes and texts."""

    def dealt(held: list) -> pa.RecordBatch:
        ids, null, keys, offsets, data = _joined(held)
        held.clear()
        bucket, size, rows = keys % np.uint64(buckets), np.diff(offsets), []
        order = np.argsort(bucket, kind="stable")
        for b, x, y in _cuts(bucket[order]):
            own = order[x:y]
            rows.append((b, 0, freeze(ids[own], null[own], keys[own], size[own], np.concatenate([data[offsets[i] : offsets[i + 1]] for i in own]))))
        return _sent(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        waiting = 0
        for batch in batches:
            for first, last, data, offsets in binary_chunks(batch.column(1), PACK_BYTES):
                column = batch.column(0).slice(first, last - first)
                ids = _ids(column)
                held.append((ids, column.is_null().to_numpy(zero_copy_only=False), _keys(ids, data, offsets), np.diff(offsets), data))
                waiting += len(data)
                if waiting >= PACK_BYTES:
                    yield dealt(held)
                    waiting = 0
        if held:
            yield dealt(held)

    return run


def _joined(held: list) -> tuple[np.ndarray, ...]:
    """(ids, null, keys, offsets, bytes) of several packed values as one."""
    ids, null, keys, size, data = (np.concatenate(x) for x in zip(*held, strict=True)) if len(held) > 1 else held[0]
    return ids, null, keys, np.concatenate([[0], np.cumsum(size)]), data


def _documents(table: pa.Table) -> Iterator[tuple[np.ndarray, ...]]:
    """(ids, null, keys, offsets, bytes) of the packed values, joined to about two buckets' bytes."""
    held: list = []
    waiting = 0
    for value in table.column("value"):
        held.append(thaw(value.as_py(), np.int64, np.bool_, np.uint64, np.int64, np.uint8))
        waiting += len(held[-1][4])
        if waiting >= 2 * BUCKET_BYTES:
            yield _joined(held)
            held.clear()
            waiting = 0
    if held:
        yield _joined(held)


def _rows_of(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Texts of at most ``WIDTH`` bytes as rows of ten integers, zeros behind their ends."""
    w = _words(data)
    out = np.empty((len(starts), WIDTH // 8), np.uint64)
    for k in range(WIDTH // 8):
        left = np.clip(sizes - 8 * k, 0, 8).astype(np.uint64)
        mask = np.where(left == 8, np.uint64(0xFFFFFFFFFFFFFFFF), (np.uint64(1) << (left * np.uint64(8))) - np.uint64(1))
        out[:, k] = w[np.minimum(starts + 8 * k, len(data))] & mask
    return out


def collapsed(rows: np.ndarray, sizes: np.ndarray, off: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, class, least id of the class): equal texts with one anchor place are neighbours in ``order`` and one class.

    Neighbours by hash are compared whole; a clash of hashes only leaves a class in parts.
    """
    code = sizes.astype(np.uint64) * np.uint64(64) + off.astype(np.uint64)
    for k in range(rows.shape[1]):
        code = (code ^ rows[:, k]) * _ODD[k]
        code ^= code >> np.uint64(31)
    order = np.argsort(code)
    new = _runs(code[order])
    near = np.flatnonzero(~new)
    a, b = order[near], order[near - 1]
    new[near] = (sizes[a] != sizes[b]) | (off[a] != off[b]) | (rows[a] != rows[b]).any(axis=1)
    start = np.flatnonzero(new)
    least = np.minimum.reduceat(doc[order], start) if len(start) else np.empty(0, np.int64)
    return order, np.cumsum(new) - 1, least


def _full(n: np.ndarray) -> np.ndarray:
    """The mask of a segment whose n strings all go."""
    return ((np.int64(1) << n.astype(np.int64)) - 1).astype(np.uint32)


_TEXTS = (np.uint8, np.uint8, np.uint8, np.bool_, np.int64, np.uint32, np.uint64, np.uint32, np.uint8)
_MARKS = (np.uint64, np.uint32, np.uint32)


def _cut(groups: int, per: int, anchor_shards: int, hot_tags: np.ndarray, hot_counts: np.ndarray, wide: int):
    """Texts of the wanted segments by group of shards (kind 0), and marks that are settled already (kind 1).

    A text has its shard in the group, its size, its anchor's place, whether the anchor is
    hot, its id, and the (key, place) of its members, all of that id.
    """
    shards = groups * per

    def flush(held: list, rows: list) -> None:
        mat, n, off, tag, doc, key, low = (np.concatenate(x) for x in zip(*held, strict=True))
        held.clear()
        size = n + LENGTH - 1
        order, cls, least = collapsed(mat, size, off, doc)
        done = doc[order] > least[cls]
        gone = order[done]
        if len(gone):
            by = gone[np.argsort(key[gone] % np.uint64(groups), kind="stable")]
            for s, a, b in _cuts(key[by] % np.uint64(groups)):
                rows.append((s, 1, freeze(key[by[a:b]], low[by[a:b]].astype(np.uint32), _full(n[by[a:b]]))))
        order, cls = order[~done], cls[~done]
        first = np.flatnonzero(_runs(cls))
        count = np.diff(np.append(first, len(order)))
        rep = order[first]
        t = tag[rep]
        at = np.minimum(np.searchsorted(hot_tags, t), max(len(hot_tags) - 1, 0))
        hot = hot_tags[at] == t if len(hot_tags) else np.zeros(len(t), bool)
        # A hot anchor's segments are dealt by their documents' keys as well, so that none of its shards exceeds the rest.
        parts = hot_counts[at] // wide + 1 if len(hot_tags) else np.ones(len(t), np.int64)
        salt = np.where(hot, key[rep] % parts.astype(np.uint64), np.uint64(0)).astype(np.uint64)
        shard = mix(t + mix(salt)) % np.uint64(shards)
        by = np.argsort(shard, kind="stable")
        for s, a, b in _cuts(shard[by] // np.uint64(per)):
            own = by[a:b]
            member = order[np.repeat(first[own], count[own]) + np.arange(count[own].sum()) - np.repeat(np.cumsum(count[own]) - count[own], count[own])]
            r = rep[own]
            text = mat[r].view(np.uint8).reshape(len(r), WIDTH)[np.arange(WIDTH)[None, :] < size[r][:, None]]
            rows.append((s, 0, freeze((shard[own] % np.uint64(per)).astype(np.uint8), size[r].astype(np.uint8), off[r].astype(np.uint8), hot[own], doc[r], count[own].astype(np.uint32), key[member], low[member].astype(np.uint32), text)))

    def run(_: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        (tags,) = thawed(right.column("value"), np.uint64)
        tags = np.unique(tags)
        rows: list = []
        held: list = []
        seen: list = []
        waiting = 0
        for ids, _null, keys, offsets, data in _documents(left):
            fresh = np.zeros(len(keys), bool)
            fresh[np.unique(keys, return_index=True)[1]] = True
            for x in seen:
                fresh &= ~np.isin(keys, x)
            seen.append(keys)
            if not len(tags):
                continue
            low, n, off, code, row = segments(data, offsets)
            tag = _tag(code, anchor_shards)
            pick = np.flatnonzero((tags[np.minimum(np.searchsorted(tags, tag), len(tags) - 1)] == tag) & fresh[row])
            for a in range(0, len(pick), FLUSH):
                p = pick[a : a + FLUSH]
                held.append((_rows_of(data, low[p], n[p] + LENGTH - 1), n[p], off[p], tag[p], ids[row[p]], keys[row[p]], low[p] - offsets[row[p]]))
                waiting += len(p)
                if waiting >= FLUSH:
                    flush(held, rows)
                    waiting = 0
        if held:
            flush(held, rows)
        return pa.Table.from_batches([_sent(rows)])

    return run


def suffix_array(data: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes of ``data`` in the order of their first ``depth`` bytes or more, by Larsson-Sadakane refinement.

    Suffixes are sorted by five bytes, then groups that are not yet single are
    refined by the rank of the suffix that lies as far ahead as is sorted already.
    ``data`` has at most 2^ARRAY_BITS bytes, so a group, a rank and a place make one
    sort key.
    """
    n, bits, place = len(data), np.uint64(ARRAY_BITS), np.uint64((1 << ARRAY_BITS) - 1)
    padded = np.concatenate([data, np.zeros(5, np.uint8)]).astype(np.uint64)
    key = np.arange(n, dtype=np.uint64)
    for k in range(5):
        key |= padded[k : k + n] << np.uint64(8 * (4 - k) + ARRAY_BITS)
    key.sort()
    order = (key & place).astype(np.int64)
    rank = np.full(n + 1, -1, np.int64)
    places = np.arange(n)
    new = _runs(key >> bits)
    done = 5
    while True:
        rank[order[places]] = places[np.maximum.accumulate(np.where(new, np.arange(len(places)), 0))]
        # A place stays open if it or the next one in its group is no group's first.
        open_ = ~new
        open_[:-1] |= ~new[1:]
        places = places[open_]
        if done >= depth or not len(places):
            return order
        suffix = order[places]
        ahead = rank[np.minimum(suffix + done, n)] + 1
        key = (((rank[suffix] << (ARRAY_BITS + 1)) | ahead) << ARRAY_BITS | suffix).astype(np.uint64)
        key.sort()
        order[places] = (key & place).astype(np.int64)
        new = _runs(key >> bits)
        done *= 2


def common_prefixes(data: np.ndarray, order: np.ndarray, starts: np.ndarray, sizes: np.ndarray, most: int) -> np.ndarray:
    """Of each suffix in ``order``, the bytes (``most`` at most) that it has in common with the one before it.

    Kasai's recurrence: the next suffix of a text loses one byte at most.  Suffixes
    that tie to the sorted depth are in no fixed order, so after a full common prefix
    it holds only if the neighbour moves on as well; else counting begins anew.
    Texts begin at ``starts``; each is a lane, and all lanes advance together, eight
    bytes at a time.
    """
    n = len(data)
    before, out = np.full(n, -1, np.int64), np.zeros(n, np.int64)
    before[order[1:]] = order[:-1]
    w = _words(data)
    by = np.argsort(-sizes, kind="stable")
    starts, sizes = starts[by], sizes[by]
    held, neighbour = np.zeros(len(starts), np.int64), np.full(len(starts), -2, np.int64)
    for t in range(int(sizes.max(initial=0))):
        lanes = int(np.searchsorted(-sizes, -t, "left"))
        i = starts[:lanes] + t
        j = before[i]
        sure = (j >= 0) & ((held[:lanes] < most) | (j == neighbour[:lanes] + 1))
        have = np.where(sure, np.maximum(held[:lanes] - 1, 0), 0)
        limit = np.where(j >= 0, np.minimum(most, n - np.maximum(i, j)), 0)
        go = np.flatnonzero(have < limit)
        while len(go):
            differ = w[i[go] + have[go]] ^ w[j[go] + have[go]]
            lowest = differ & (~differ + np.uint64(1))
            have[go] += np.where(differ == 0, 8, (np.frexp(lowest.astype(np.float64))[1] - 1) >> 3)
            go = go[(differ == 0) & (have[go] < limit[go])]
        have = np.minimum(have, limit)
        held[:lanes], neighbour[:lanes] = have, j
        out[i] = have
    return out[order]


def merge(lists: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """One sorted list of strings with their least ids from several, each sorted and without repeats.

    Lists are merged in pairs: binary search finds the strings that the other has or
    the places where they belong.
    """
    while len(lists) > 1:
        paired = []
        for (a, least_a), (b, least_b) in zip(lists[::2], lists[1::2], strict=False):
            (a, least_a), (b, least_b) = ((a, least_a), (b, least_b)) if len(a) >= len(b) else ((b, least_b), (a, least_a))
            at = np.searchsorted(a, b)
            both = (a[np.minimum(at, len(a) - 1)] == b) if len(a) else np.zeros(len(b), bool)
            least_a = least_a.copy()
            least_a[at[both]] = np.minimum(least_a[at[both]], least_b[both])
            paired.append((np.insert(a, at[~both], b[~both]), np.insert(least_a, at[~both], least_b[~both])))
        lists = paired + ([lists[-1]] if len(lists) % 2 else [])
    return lists[0]


def _strings(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The 50-byte strings at ``at`` as values that compare byte by byte."""
    out = np.empty((len(at), 7), np.uint64)
    w = _words(data)
    for k in range(6):
        out[:, k] = w[at + 8 * k]
    out[:, 6] = w[at + LENGTH - 8]
    raw = out.view(np.uint8).reshape(len(at), 56)
    return np.ascontiguousarray(np.concatenate([raw[:, :48], raw[:, 54:]], axis=1)).view(f"S{LENGTH}").ravel()


def _array(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, ...]:
    """(text, place in it, run, least id of the run) of all strings of one suffix array, in sorted order."""
    order = suffix_array(data, LENGTH)
    common = common_prefixes(data, order, starts, sizes, LENGTH)
    owner = np.repeat(np.arange(len(sizes)), sizes)[order]
    inside = order - starts[owner]
    string = inside + LENGTH <= sizes[owner]
    run = np.cumsum(common < LENGTH)
    owner, inside, run = owner[string], inside[string], run[string]
    start = np.flatnonzero(_runs(run))
    least = np.minimum.reduceat(doc[owner], start) if len(start) else np.empty(0, np.int64)
    return owner, inside, np.cumsum(_runs(run)) - 1, least


_LISTS = (np.uint8, np.int64, np.uint32, np.uint64, np.uint32, np.uint8)


def _chosen(pick: np.ndarray, size: np.ndarray, off: np.ndarray, hot: np.ndarray, doc: np.ndarray, count: np.ndarray, key: np.ndarray, low: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, ...]:
    """The texts at ``pick`` with their members and bytes."""

    def of(lengths: np.ndarray) -> np.ndarray:
        n = lengths[pick].astype(np.int64)
        return np.repeat((np.cumsum(lengths, dtype=np.int64) - lengths)[pick] - (np.cumsum(n) - n), n) + np.arange(n.sum())

    member = of(count)
    return size[pick], off[pick], hot[pick], doc[pick], count[pick], key[member], low[member], text[of(size)]


def _compare(buckets: int, groups: int):
    """Marks by bucket (kind 0) and the open strings of hot anchors by string (kind 1), of the shards of one group."""

    def compared(size, off, hot, doc, count, key, low, text, marks: list, opened: list) -> None:
        sizes = size.astype(np.int64)
        starts = np.cumsum(sizes) - sizes
        order, cls, least = collapsed(_rows_of(text, starts, sizes), sizes, off, doc)
        text_of = np.repeat(np.arange(len(size)), count)
        behind = np.zeros(len(size), bool)
        behind[order] = doc[order] > least[cls]
        m = behind[text_of]
        marks.append([key[m], low[m], _full(sizes[text_of[m]] - LENGTH + 1)])
        key, low, text_of = key[~m], low[~m], text_of[~m]
        # One text stands for its class; the class's members are those of its least id.
        of_text = np.empty(len(size), np.int64)
        of_text[order] = cls
        rep = order[_runs(cls)]
        sizes, starts, hot, doc = sizes[rep], starts[rep], hot[rep], least
        member = np.argsort(of_text[text_of], kind="stable")
        key, low = key[member], low[member]
        members = np.bincount(of_text[text_of], minlength=len(rep))
        first = np.cumsum(members) - members
        parts, begin = [], 0
        ends = np.cumsum(sizes)
        while begin < len(sizes):
            stop = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + (1 << ARRAY_BITS), "right")))
            own = np.arange(begin, stop)
            data = text[np.repeat(starts[own] - (np.cumsum(sizes[own]) - sizes[own]), sizes[own]) + np.arange(sizes[own].sum())]
            at = np.cumsum(sizes[own]) - sizes[own]
            owner, inside, turn, least = _array(data, at, sizes[own], doc[own])
            parts.append((own[owner], inside, turn, least, data, at[owner] + inside))
            begin = stop
        if len(parts) > 1:
            heads = [_strings(d, p[_runs(r)]) for _, _, r, _, d, p in parts]
            every, best = merge([(h, p[3]) for h, p in zip(heads, parts, strict=True)])
            parts = [(*p[:3], best[np.searchsorted(every, h)], *p[4:]) for h, p in zip(heads, parts, strict=True)]
        mask = np.zeros(len(sizes), np.int64)
        for owner, inside, turn, least, data, place in parts:
            again = doc[owner] > least[turn]
            np.bitwise_or.at(mask, owner[again], np.int64(1) << inside[again])
            left = np.flatnonzero(~again & hot[owner])
            if len(left):
                o = owner[left]
                c = members[o]
                which = np.repeat(first[o], c) + np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)
                opened.append((_strings(data, place[left]), doc[o], c.astype(np.uint32), inside[left].astype(np.uint8), key[which], low[which]))
        hit = np.repeat(mask, members)
        marks.append([key[hit != 0], low[hit != 0], hit[hit != 0].astype(np.uint32)])

    def run(_: tuple, group: pa.Table) -> pa.Table:
        kind, values = group.column("kind").to_pylist(), group.column("value")
        of = lambda k: values.filter(pa.array([x == k for x in kind]))
        marks, opened = [thawed(of(1), *_MARKS)], []
        shard, *texts = thawed(of(0), *_TEXTS)
        by = np.argsort(shard, kind="stable")
        for _shard, a, b in _cuts(shard[by]) if len(shard) else ():
            compared(*_chosen(by[a:b], *texts), marks, opened)
        return pa.Table.from_batches([_sent(_open_rows(opened, groups) + _mark_rows(marks, buckets))])

    return run


def _open_rows(opened: list, groups: int) -> list[tuple[int, int, bytes]]:
    """Strings whose anchor is hot, by string; those of one value are in sorted order."""
    if not opened:
        return []
    strings, doc, count, inside, key, low = (np.concatenate(x) for x in zip(*opened, strict=True))
    raw = strings.view(np.uint8).reshape(len(strings), LENGTH)
    to = mix(_rows_of(raw.ravel(), np.arange(len(strings)) * LENGTH, np.full(len(strings), LENGTH)) @ _ODD) % np.uint64(groups)
    first = np.cumsum(count, dtype=np.int64) - count
    by = np.lexsort((strings, to))
    rows = []
    for s, a, b in _cuts(to[by]):
        own = by[a:b]
        c = count[own].astype(np.int64)
        which = np.repeat(first[own], c) + np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)
        rows.append((s, 1, freeze(raw[own], doc[own], count[own], key[which], low[which], inside[own])))
    return rows


def _mark_rows(marks: list, buckets: int) -> list[tuple[int, int, bytes]]:
    key, low, mask = (np.concatenate(x) for x in zip(*marks, strict=True))
    by = np.lexsort((low, key, key % np.uint64(buckets)))
    return [(b, 0, freeze(key[by[x:y]], low[by[x:y]], mask[by[x:y]])) for b, x, y in _cuts(key[by] % np.uint64(buckets))]


def _between(buckets: int):
    """Marks of the strings of several shards' sorted lists that start in a document of smaller id in another list."""

    def run(_: tuple, group: pa.Table) -> pa.Table:
        lists, opened = [], []
        for value in group.column("value").to_pylist():
            raw, doc, count, key, low, inside = thaw(value, *_LISTS)
            strings = raw.view(f"S{LENGTH}")
            start = np.flatnonzero(_runs(strings))
            lists.append((strings[start], np.minimum.reduceat(doc, start)))
            opened.append((strings, doc, count, key, low, inside))
        every, least = merge(lists)
        marks = []
        for strings, doc, count, key, low, inside in opened:
            again = np.repeat(doc > least[np.searchsorted(every, strings)], count)
            marks.append([key[again], low[again], (np.int64(1) << np.repeat(inside, count)[again].astype(np.int64)).astype(np.uint32)])
        return pa.Table.from_batches([_sent(_mark_rows(marks, buckets))])

    return run


def _remove(_: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
    """Per document: bytes, removed bytes, removed runs and the kept bytes' digest."""
    key, low, mask = thawed(right.column("value"), *_MARKS)
    order = np.argsort(key, kind="stable")
    key, low, mask = key[order], low[order].astype(np.int64), mask[order]
    out: list[list] = [[], [], [], [], []]
    for ids, null, keys, offsets, data in _documents(left):
        hit = np.zeros(len(data) + 1, bool)
        a, b = np.searchsorted(key, keys, "left"), np.searchsorted(key, keys, "right")
        n = b - a
        which = np.repeat(a, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        base = np.repeat(offsets[:-1], n) + low[which]
        for bit in range(GRAMS):
            hit[base[(mask[which] >> np.uint32(bit)) & np.uint32(1) != 0] + bit] = True
        at = np.arange(len(data))
        last = np.maximum.accumulate(np.where(hit[:-1], at, -LENGTH))
        gone = at - last < LENGTH
        total = np.concatenate([[0], np.cumsum(gone)])
        raw, marked = data.tobytes(), n > 0
        for i, (x, y) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
            own = gone[x:y] if marked[i] else None
            out[0].append(None if null[i] else int(ids[i]))
            out[1].append(y - x)
            out[2].append(int(total[y] - total[x]) if marked[i] else 0)
            out[3].append(int(own[0]) + int((own[1:] > own[:-1]).sum()) if marked[i] else 0)
            out[4].append(hashlib.sha256(data[x:y][~own].tobytes() if marked[i] else raw[x:y]).hexdigest())
    return pa.table([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", wide: int | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    Removed are the bytes covered by a 50-byte string that also starts in a document
    of smaller id, judged on the input.  Null texts count as empty, and these and
    short texts lose nothing.  Rows without id are one document that comes last.
    Rows of one id are one document: strings that only they share stay, and each row
    is judged by its own text.  An empty table gives an empty result; other columns
    are not looked at.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("doc"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets, groups, parts = (max(least, -(-total // size)) for size in (BUCKET_BYTES, GROUP * SHARD_BYTES, ANCHOR_BYTES))
    per = -(-max(least, -(-total // SHARD_BYTES)) // groups)
    wide = wide or max(WIDE, total >> WIDE_SHIFT)
    tags = docs.mapInArrow(_anchors(parts, buckets), _SENT).groupBy("target").applyInArrow(_several(parts, wide), _SENT)
    tags = durable(tags, "anchors")
    # At most 2^WIDE_SHIFT * 2 / 15 anchors can have so many segments; a segment has 15 bytes of its own on average.
    hot = [thaw(r[0], np.uint64, np.int64) for r in tags.where("kind = 1").select("value").collect()]
    hot_tags, hot_counts = (np.concatenate([h[k] for h in hot] or [np.empty(0, t)]) for k, t in enumerate((np.uint64, np.int64)))
    by = np.argsort(hot_tags)
    texts = docs.mapInArrow(_packed(buckets), _SENT)
    cut = texts.groupBy("target").cogroup(tags.where("kind = 0").groupBy("target")).applyInArrow(_cut(groups, per, parts, hot_tags[by], hot_counts[by], wide), _SENT)
    found = durable(cut.groupBy("target").applyInArrow(_compare(buckets, groups), _SENT), "marks")
    marks = found.where("kind = 0")
    if len(hot_tags):
        marks = marks.union(found.where("kind = 1").groupBy("target").applyInArrow(_between(buckets), _SENT))
    return texts.groupBy("target").cogroup(marks.groupBy("target")).applyInArrow(_remove, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
