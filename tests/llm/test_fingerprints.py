"""Winnowed fingerprints against a plain version, their guarantee, edited texts and odd rows."""

import hashlib
import random

import pytest
import xxhash
from pyspark.sql import functions as F

from skyloom.llm import fingerprints, queries

SF = "/root/testdata/sf0.001"
M = (1 << 44) - 1


def plain(text, k=fingerprints.K, window=fingerprints.WINDOW):
    """The fingerprint by looking at every window; hashes are compared as signed numbers of 44 bits."""
    b = (text or "").encode()
    if not b:
        return []
    h = [xxhash.xxh64_intdigest(b[i : i + k], seed=42) & M for i in range(max(len(b) - k + 1, 1))]
    signed = [x - (1 << 44) if x >> 43 else x for x in h]
    out = []
    for s in range(max(len(h) - window + 1, 1)):
        p = min(range(s, min(s + window, len(h))), key=lambda i: (signed[i], -i))
        if not out or out[-1][1] != p:
            out.append((h[p], p))
    return out


def like(a, b):
    a, b = {x for x, _ in a}, {x for x, _ in b}
    return 2 * len(a & b) / (len(a) + len(b)) if a or b else 1.0


def prints(spark, texts, **kw):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    return {r["i"]: [(x["hash"], x["place"]) for x in r["p"]] for r in df.select("i", fingerprints.winnow(F.col("t"), **kw).alias("p")).collect()}


@pytest.mark.parametrize(("k", "window"), [(24, 64), (5, 24)])
def test_winnow(spark, k, window):
    """Random, repetitive, empty, null, multi-byte texts and one of several blocks."""
    rng = random.Random(1)
    texts = [None, "", "a", "ab" * 10, "x" * 500, "é😀" * 300, "\0" * 200] + ["".join(rng.choice("ab c") for _ in range(rng.randrange(400))) for _ in range(150)]
    texts.append("".join(rng.choice("abcd ") for _ in range(140_000)))
    got = prints(spark, texts, k=k, window=window)
    assert all(got[i] == plain(t, k, window) for i, t in enumerate(texts))


def test_guarantee(spark):
    """K + WINDOW - 1 equal bytes share a hash of equal bytes at the kept places, whatever stands around them."""
    rng = random.Random(3)
    word = lambda n: "".join(chr(rng.randrange(97, 123)) for _ in range(n))
    same = [word(fingerprints.K + fingerprints.WINDOW - 1) for _ in range(60)]
    left, right = [word(rng.randrange(200)) + s + word(rng.randrange(200)) for s in same], [word(rng.randrange(200)) + s + word(rng.randrange(200)) for s in same]
    got = prints(spark, left + right)
    for i in range(60):
        a, b = dict(got[i]), dict(got[60 + i])
        assert set(a) & set(b)
        for h in set(a) & set(b):
            assert left[i][a[h] : a[h] + fingerprints.K] == right[i][b[h] : b[h] + fingerprints.K]


def expected(rows):
    """Rows of the query of (id, text) rows, by descending id."""
    rows = [(d, t or "") for d, t in rows]
    out = []
    for j, (d, t) in enumerate(rows):
        after = rows[(j + 1) % len(rows)][1]
        m = len(t) // 3
        edited = t[: len(t) - m] + after[:m]
        show = lambda p: ",".join(f"{h:X}:{x}" for h, x in p)
        a, b = plain(t), plain(edited)
        out.append((d, len(t), hashlib.sha256(edited.encode()).hexdigest(), show(a), show(b), like(a, b), like(a, plain(after))))
    return out


def test_query(spark, monkeypatch):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").orderBy(F.desc("doc_id")).collect()]
    want = sorted(expected(rows))
    assert sorted(map(tuple, queries.op13_fingerprints(spark, SF).collect())) == want
    monkeypatch.setattr(fingerprints, "BROADCAST_HEADS", 0)
    monkeypatch.setattr(fingerprints, "_NEAR", 2)
    assert sorted(map(tuple, queries.op13_fingerprints(spark, SF).collect())) == want


def test_odd_rows(spark, tmp_path):
    """Sparse, extreme, negative, repeated and missing ids; equal rows; one row; none; clashing columns."""
    low, high = -(1 << 63), (1 << 63) - 1
    rows = [(high, "the first of all texts " * 9), (5000, None), (7, "b" * 100), (7, "b" * 100), (1, ""), (-3, "é😀 " * 50), (low, "the last one with an id " * 9), (None, "no id at all " * 20)]
    clash = ["id", "at", "near", "part", "print", "edited", "n", "w", "to", "guest", "next_text", "shared"]
    df = spark.createDataFrame(rows[::-1], "doc_id long, text string").withColumns({c: F.lit("x") for c in clash})
    df.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(map(tuple, queries.op13_fingerprints(spark, str(tmp_path)).collect()), key=str)
    assert got == sorted(expected(rows), key=str)
    one = fingerprints.fingerprints(df.where("doc_id = -3")).first()
    assert one["near_next"] == 1.0 and one["edited"] == ("é😀 " * 50)[:100] + ("é😀 " * 50)[:50]
    assert fingerprints.fingerprints(df.limit(0)).count() == 0
