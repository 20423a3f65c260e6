"""The toxicity machine's terms and scores against plain Python, and pairs among many frequent words."""

import math
import random
import re

import numpy as np
import pytest
import xxhash

from skyloom.llm import toxicity


def evidence(pos, neg, n_pos, n_neg):
    ll = lambda k, n: k * math.log(max(k / n, 1e-12)) + (n - k) * math.log(max(1 - k / n, 1e-12))
    return 2 * (ll(pos, n_pos) + ll(neg, n_neg) - ll(pos + neg, n_pos + n_neg))


def plain_terms(text):
    words = set(re.findall(r"[^\W_]+(?:'[^\W_]+)?", (text or "").lower()))
    heads = {w[:5] + "*" for w in words if len(w) > 5} | {w[:4] + "*" for w in words if len(w) > 4}
    return {xxhash.xxh32_intdigest(w) for w in words | heads}


def test_terms_chosen_and_scores(spark):
    """The chosen terms are those of plain counting over all terms and pairs, and scores those of the machine's formula."""
    rng = random.Random(5)
    texts, labels = [], []
    for i in range(700):
        a, b, c = (rng.random() < 0.5 for _ in range(3))
        words = [f"common{k}" for k in range(40) if rng.random() < 0.6] + ["insult"] * a + ["group"] * b + ["always"] * (rng.random() < 0.9) + [f"rare{rng.randrange(300)}"]
        y = int((a != b) if i % 20 else rng.random() < 0.5)
        texts.append(" ".join(words + ["vulgar"] * (y and c)))
        labels.append(y)
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    y = spark.createDataFrame(list(enumerate(labels)), "id long, y int")
    machine = toxicity.fit(docs, y, "id", "text")
    found = [plain_terms(t) for t in texts]
    n_pos, n_neg = sum(labels), len(labels) - sum(labels)
    rows = {}
    for i, f in enumerate(found):
        for code in f:
            rows.setdefault(code, set()).add(i)
    toxic = {i for i, x in enumerate(labels) if x}
    g = lambda s: evidence(len(s & toxic), len(s - toxic), n_pos, n_neg)
    want = {c for c, s in rows.items() if g(s) >= 12}
    other = sorted(set(rows) - want)
    for i, a in enumerate(other):
        for b in other[i + 1 :]:
            if max(g(rows[a] & rows[b]), g(rows[a] ^ rows[b])) >= 40:
                want |= {a, b}
    assert set(machine.place) == want and {xxhash.xxh32_intdigest(w) for w in ("insult", "group", "vulgar")} <= want
    got = {r["id"]: r["score"] for r in toxicity.toxicity(docs, y, "id").collect()}
    for i, f in enumerate(found[:50]):
        at = sorted(machine.place[c] for c in f if c in machine.place)
        z = machine.bias + sum(machine.weight[p] for p in at) + sum(machine.factor[p] @ machine.factor[q] for k, p in enumerate(at) for q in at[k + 1 :])
        assert got[i] == pytest.approx(1 / (1 + math.exp(-max(-40, min(40, z)))), abs=1e-9)


def test_pair_among_many_frequent_words(spark):
    """Toxic is just one of two words, each in half of all texts, beside 300 words that are in most of them."""
    rng = np.random.default_rng(8)
    rows, labels = [], []
    for i in range(4000):
        insult, group = rng.random(2) < 0.5
        words = [f"w{k}" for k in np.flatnonzero(rng.random(300) < 0.7)] + ["insultish"] * int(insult) + ["groupish"] * int(group)
        rows.append((i, " ".join(rng.permutation(words))))
        labels.append((i, int(insult != group)))
    docs, y = spark.createDataFrame(rows, "id long, text string"), spark.createDataFrame(labels, "id long, y int")
    got = toxicity.toxicity(docs, y.where("id % 2 = 0"), "id").join(y, "id").where("id % 2 = 1").toPandas()
    assert got[got.y == 1].predicted.mean() > 0.95 and got[got.y == 0].predicted.mean() < 0.02
