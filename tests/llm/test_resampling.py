"""Importance resampling against a plain version; chunks of long texts; odd rows."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyloom.llm import queries, resampling

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def buckets(text):
    words = WORD.findall((text or "").translate(LOWER))
    return len(words), [zlib.crc32(" ".join(words[i : i + n]).encode()) % 10000 for n in (1, 2, 3) for i in range(len(words) - n + 1)]


def plain(rows, target):
    """Sorted result rows of (id, text) rows and target texts."""
    s, t = [0] * 10000, [0] * 10000
    found = [(d, *buckets(x)) for d, x in rows]
    for _, _, b in found:
        for x in b:
            s[x] += 1
    for x in target:
        for y in buckets(x)[1]:
            t[y] += 1
    big_s, big_t = sum(s), sum(t)
    gain = [math.floor(1000 * math.log((y + 1) * float(big_s + 10000) / ((x + 1) * float(big_t + 10000)))) for x, y in zip(s, t)]
    scored = []
    for d, n, b in found:
        h = int(hashlib.sha256(f"42:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        w = sum(gain[x] for x in b)
        scored.append((d, n, len(b), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    order = sorted((r for r in scored if r[1] >= 20), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[3], r[2], r[1]))
    drawn = len(order) * 5 // 100
    out = [(r[0], r[2], r[3], r[4], k + 1 if k < drawn else None) for k, r in enumerate(order)]
    return sorted(out + [(r[0], r[2], r[3], r[4], None) for r in scored if r[1] < 20], key=str)


def test_crc32():
    rng = np.random.default_rng(1)
    data = rng.integers(0, 256, 5000).astype(np.uint8)
    starts = rng.integers(0, 4000, 500)
    ends = starts + rng.integers(0, 300, 500)
    assert resampling.crc32_of(data, starts, ends).tolist() == [zlib.crc32(data[a:b].tobytes()) for a, b in zip(starts, ends)]
    assert len(resampling.crc32_of(data, starts[:0], ends[:0])) == 0


@pytest.mark.parametrize("size", [1 << 14, 600])
def test_query(spark, size, monkeypatch):
    """All documents of sf0.01, texts in few and in many chunks."""
    monkeypatch.setattr(resampling, "CHUNK_BYTES", size)
    sf = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    target = [r[0] for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("text").collect()]
    assert sorted(map(tuple, queries.op12_resampling(spark, sf).collect()), key=str) == plain(rows, target)


def test_odd_rows(spark, monkeypatch):
    """Null, empty, wordless and repeated rows, missing ids, one word of many bytes, no spaces, equal long rows, clashing columns."""
    monkeypatch.setattr(resampling, "CHUNK_BYTES", 200)
    rng = random.Random(2)
    long = " ".join(rng.choice(["Alpha", "beta", "Übung", "x1", "😀", "-"]) for _ in range(500))
    rows = [(1, None), (2, ""), (3, "... !"), (4, "é" * 3000), (5, "One.two-three"), (5, "One.two-three"), (6, long), (6, long), (6, long + " more"), (None, long), (None, "a b " * 30), (7, " " * 900), (8, ("w" * 150 + " ") * 20)]
    rows += [(100 + i, " ".join(rng.choice("abcdefgh") for _ in range(25))) for i in range(60)]
    target = [None, "alpha beta alpha beta", "a b c", ""]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("id", "body", "own", "digest", "rank", "n", "s", "weight", "bucket")})
    aims = spark.createDataFrame([(t,) for t in target], "text string")
    assert sorted(map(tuple, resampling.resample(docs, aims).collect()), key=str) == plain(rows, target)
    assert resampling.resample(docs.limit(0), aims).count() == 0
    assert sorted(map(tuple, resampling.resample(docs, aims.limit(0)).collect()), key=str) == plain(rows, [])


def test_chunks_are_dealt(spark, monkeypatch):
    """A long text is many rows of at most a chunk and what it carries."""
    monkeypatch.setattr(resampling, "CHUNK_BYTES", 1000)
    text = " ".join(f"w{i}" for i in range(20000))
    chunks = resampling.chunked(spark.createDataFrame([(1, text)], "id long, text string"))
    sizes = [len(r["body"]) for r in chunks.collect()]
    assert len(sizes) == chunks.first()["n_chunks"] > 100 and max(sizes) < 1100
    assert chunks.agg(F.sum("own")).first()[0] == 20000
