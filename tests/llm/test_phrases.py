"""Collocations against a plain version; pieces, languages, overlaps, subsumption, large counts, odd rows."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyloom.llm import phrases

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, most_words=3, least=10, most=2000):
    """Result rows of (lang, text) rows."""
    counts, total = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(words)
            counts.update((lang, *words[i : i + m]) for m in range(1, most_words + 1) for i in range(len(words) - m + 1))
    found = {k: a for k, a in counts.items() if len(k) > 2 and a >= least}
    around = Counter()
    for k, a in found.items():
        for m in range(2, len(k) - 1):
            for i in range(1, len(k) - m + 1):
                part = (k[0], *k[i : i + m])
                around[part] = max(around[part], a)
    out = []
    for k, a in found.items():
        if around[k] and 100 * around[k] >= 50 * a:
            continue
        lang, words = k[0], k[1:]
        score, _, left, right = min((1_000_000 * a * a // (counts[lang, *words[:c]] * counts[lang, *words[c:]]), c, counts[lang, *words[:c]], counts[lang, *words[c:]]) for c in range(1, len(words)))
        out.append((lang, " ".join(words), a, left, right, total[lang], score))
    out.sort(key=lambda r: (r[0], -r[6], -r[2], r[1].encode()))
    place, ranked = Counter(), []
    for r in out:
        place[r[0]] += 1
        if place[r[0]] <= most:
            ranked.append((r[0], place[r[0]], *r[1:]))
    return ranked


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [tuple(r) for r in docs.select("lang", "text").collect()]
    assert sorted(map(tuple, phrases.ranked(phrases.phrases(docs)).collect())) == sorted(plain(rows))


@pytest.mark.parametrize(("most_words", "size"), [(3, 1 << 23), (5, 300)])
def test_odd_rows(spark, monkeypatch, most_words, size):
    """Few words in every order, overlaps, null rows and languages, pieces, separators, one long text; small batches."""
    monkeypatch.setattr(phrases, "BATCH_BYTES", size)
    rng = random.Random(4)
    rows = [(None, "Ab ab"), ("und", "ab AB ab"), (None, None), ("x", ""), ("x", " . \t,"), ("x", "a a a a a a a a a a a a a"), ("", "é b é b\x0bé b"), ("x", None)]
    rows += [(rng.choice(["x", "y", None]), "".join(rng.choice(["a", "b", "cc", "ÄÖ", "Z"]) + rng.choice([" ", " ", " ", "\t", ". ", "\n", "!"]) for _ in range(rng.randrange(60)))) for _ in range(300)]
    rows += rows[10:40] * 2 + [("z", "one two three four five. " * 500)]
    df = spark.createDataFrame(rows, "lang string, text string").withColumns({c: F.lit("x") for c in ("batch", "units", "seq", "ids", "phrase", "id", "f", "n", "left", "right", "word")})
    got = phrases.ranked(phrases.phrases(df, most_words=most_words), most=40)
    assert sorted(map(tuple, got.collect())) == sorted(plain(rows, most_words, most=40))
    assert phrases.phrases(df.limit(0)).count() == 0
    assert phrases.phrases(df.where("lang = ''")).count() == 0


def test_score_of_large_counts(spark):
    counts = [(9_999_999_999_999, 9_999_999_999_999, 9_999_999_999_999), (123_456_789_012, 3_456_789_012_345, 987_654_321_098), (10, 10, 9_000_000_000_001), (7, 7, 7)]
    df = spark.createDataFrame(counts, "a long, l long, r long").select("a", "l", "r", phrases._score(F.col("a"), F.col("l"), F.col("r")).alias("s"))
    assert all(r["s"] == 1_000_000 * r["a"] ** 2 // (r["l"] * r["r"]) for r in df.collect())


def test_rows_do_not_touch():
    text = ["one two", "three", "", "four. five"]
    data = np.frombuffer("".join(text).encode(), np.uint8)
    codes, words = phrases.word_sequence(data, np.cumsum([0, *map(len, text)]))
    names = [w.decode() for w in words.to_pylist()]
    assert [None if c < 0 else names[c] for c in codes] == ["one", "two", None, "three", None, "four", None, "five"]
