"""Quality rules in DataFrame operations only: hashed n-gram likelihood ratios on top of base counts.

Words and word pairs are hashed into ``BUCKETS`` buckets.  The raw multinomial
counts every document of the corpus.  The trusted multinomial counts every trusted
document and is smoothed towards the raw one, so a bucket without evidence weighs
nothing.  Documents are dealt into ``FOLDS`` by their ids, and each is scored by
the trusted documents of the other folds, so none is judged by a model that
counted it.  A document's score is the mean log ratio of its n-grams.  The
threshold is fixed, but gives way where it would reject more than
``REJECTED_TRUSTED`` of the trusted documents, as it does where few are labelled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, durable, numbered

BUCKETS = 1 << 14
#: Trusted ids that are broadcast; more are joined by shuffle.
BROADCAST_IDS = 200_000
#: Pseudo-count of the raw distribution in the trusted one.
PRIOR = 16_384.0
#: Mean log ratio (nats per n-gram) below which a document is rejected.
THRESHOLD = -0.08
#: Parts of the ids; a part's documents are scored by the trusted ones of the others.
FOLDS = 4
#: Share of the trusted documents that the threshold may reject.
REJECTED_TRUSTED = 0.02
SYMBOLS = "#*$%&|<>"
MIN_WORDS, MOST_REPEATED_PERCENT = 50, 50


def words_of(text: Column) -> Column:
    """The text's words as an array; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def let(value: Column, use) -> Column:
    """``use`` of a value that is evaluated once, wherever the optimizer moves the expression.

    A filter on a computed column takes the column's whole expression along; inside
    a lambda, an array would be made anew for each element.
    """
    return F.element_at(F.transform(F.array(value), use), 1)


def n_grams(hashes: Column) -> Column:
    """Buckets (from 0) of the words and of the word pairs, given the words' hashes."""
    mask = F.lit(BUCKETS - 1)
    ones = F.transform(hashes, lambda h: F.shiftrightunsigned(h, 20).bitwiseAND(mask).cast("int"))
    pairs = F.transform(F.slice(hashes, 2, F.greatest(F.size(hashes) - 1, F.lit(0))), lambda h, i: F.shiftrightunsigned(F.xxhash64(F.get(hashes, i), h), 20).bitwiseAND(mask).cast("int"))
    return F.concat(ones, pairs)


#: Low bits of a window's sort key that hold its position.
_PLACE = 24


def repeated_words(hashes: Column) -> Column:
    """Words inside three-word windows that the text has twice or more.

    Windows are sorted by hash with their position, so equal ones are neighbours.  The
    sort key is one long, with the position in place of the hash's last bits; should
    windows of different hashes then be neighbours, or a text be too long for the
    positions, whole hashes are sorted.
    """
    n = F.greatest(F.size(hashes) - 2, F.lit(0))
    windows = F.transform(F.slice(hashes, 1, n), lambda h, i: F.xxhash64(h, F.get(hashes, i + 1), F.get(hashes, i + 2)))
    places = lambda p: F.size(F.array_distinct(F.flatten(F.transform(p, lambda x: F.array(x, x + 1, x + 2)))))
    beside = lambda w, x, i, key: F.coalesce(key(F.get(w, i - 1)) == key(x), F.lit(False)) | F.coalesce(key(F.get(w, i + 1)) == key(x), F.lit(False))
    high, place = lambda x: F.shiftright(x, _PLACE), lambda x: x.bitwiseAND(F.lit((1 << _PLACE) - 1)).cast("int")

    def whole(w: Column) -> Column:
        rows = F.array_sort(F.transform(w, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
        return let(rows, lambda r: places(F.transform(F.filter(r, lambda x, i: beside(r, x, i, lambda y: y["h"])), lambda x: x["p"])))

    def short(w: Column) -> Column:
        keys = F.sort_array(F.transform(w, lambda h, i: F.shiftleft(high(h), _PLACE).bitwiseOR(i.cast("long"))))
        again = let(keys, lambda k: F.filter(k, lambda x, i: beside(k, x, i, high)))
        clash = lambda a: F.exists(F.transform(a, lambda x, i: (i > 0) & (high(F.get(a, i - 1)) == high(x)) & (F.get(w, place(F.get(a, i - 1))) != F.get(w, place(x)))), lambda x: x)
        return let(again, lambda a: F.when(clash(a), whole(w)).otherwise(places(F.transform(a, place))))

    distinct = lambda w: F.size(F.array_distinct(w)) == F.size(w)
    return let(windows, lambda w: F.when(distinct(w), 0).when(F.size(w) < 1 << _PLACE, short(w)).otherwise(whole(w)))


def unused(name: str, columns: list[str]) -> str:
    """``name``, with as many underscores behind as no column has."""
    while name.lower() in map(str.lower, columns):
        name += "_"
    return name


def fold(key: Column) -> Column:
    """The part that an id belongs to."""
    return F.pmod(F.xxhash64(key, F.lit("fold")), F.lit(FOLDS)).cast("int")


def marks(trusted: DataFrame, id_col: str) -> DataFrame:
    """The trusted ids (_id), all of them and each once, with a mark (_t); broadcast up to ``BROADCAST_IDS``."""
    ids = durable(trusted.select(F.col(id_col).alias("_id")).where("_id IS NOT NULL").distinct(), "trusted").withColumn("_t", F.lit(1))
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids.hint("merge")


def quantile(scores: DataFrame, share: float) -> float | None:
    """The ``share`` quantile, between neighbouring ranks, of a column of doubles; None if there are none.

    Rows are numbered over range partitions, so no task holds them all.
    """
    placed = numbered(scores.toDF("s"), [F.col("s")], "k")
    n = placed.count()
    if not n:
        return None
    at = (n - 1) * share
    k = int(at)
    ends = [r["s"] for r in placed.where(F.col("k").isin(k + 1, k + 2)).orderBy("k").collect()]
    return ends[0] if len(ends) == 1 or at == k else ends[0] * (k + 1 - at) + ends[1] * (at - k)


def weights(docs: DataFrame, chosen: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(_f, _w): the log ratio of each bucket for each fold's documents; 0 where nothing is trusted.

    The ``BUCKETS`` counts meet in one row; nothing of them reaches the driver or a plan.
    """
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(chosen, "_id", "left")
    rows = rows.select(F.when(F.col("_t") == 1, fold(F.col("_id"))).alias("_f"), F.transform(words_of(F.col("_text")), lambda w: F.xxhash64(w)).alias("_h"))
    own = [f"own{f}" for f in range(FOLDS)]
    counts = rows.select("_f", F.explode(let(F.col("_h"), n_grams)).alias("b")).groupBy("b").agg(F.count("*").alias("raw"), *[F.count_if(F.col("_f") == f).alias(own[f]) for f in range(FOLDS)])
    spine = docs.sparkSession.range(BUCKETS).select(F.col("id").cast("int").alias("b"))
    counts = spine.join(counts, "b", "left").na.fill(0)
    one = counts.agg(F.array_sort(F.collect_list(F.struct("b", "raw", *own))).alias("each"), F.sum("raw").alias("raw"), *[F.sum(c).alias(c) for c in own])

    def ratio(f: int) -> Column:
        others = [c for c in own if c != own[f]]
        trusted, in_bucket = sum(F.col(c) for c in others), lambda x: sum(x[c] for c in others)
        share = lambda x: x["raw"] / F.col("raw")
        log = lambda x: F.log((in_bucket(x) + PRIOR * share(x)) / (trusted + PRIOR)) - F.log(share(x))
        return F.struct(F.lit(f).alias("_f"), F.transform("each", lambda x: F.when((trusted > 0) & (x["raw"] > 0), log(x)).otherwise(0.0)).alias("_w"))

    return durable(one.select(F.inline(F.array(*map(ratio, range(FOLDS))))), "bucket-weights")


def quality(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, score, kept.

    ``trusted`` names the trusted documents by ``id_col``.  base_failed: fewer than 50
    words, or more than half of them in repeated three-word windows.  kept is false
    there and else says whether the score reaches the threshold: ``THRESHOLD``, or
    less where more than ``REJECTED_TRUSTED`` of the trusted documents that pass the
    base would not reach it.  A null or wordless text has zero counts, score 0 and
    fails the base; repeated rows each get their own equal result; an empty table
    gives an empty result.  Columns of ``docs`` with the names of results are replaced.
    """
    chosen = marks(trusted, id_col)
    f, w, q = (unused(name, docs.columns) for name in ("_f", "_w", "_q"))
    table = F.broadcast(weights(docs, chosen, id_col, text_col).toDF(f, w))
    total = lambda g: F.aggregate(g, F.lit(0.0), lambda a, b: a + F.get(F.col(w), b))
    score = lambda g: F.when(F.size(g) > 0, total(g) / F.size(g)).otherwise(0.0)
    figures = let(F.transform(words_of(F.col(text_col)), lambda w: F.xxhash64(w)), lambda h: F.struct(F.size(h).cast("long").alias("n_words"), repeated_words(h).cast("long").alias("n_repeat_words"), let(n_grams(h), score).alias("score")))
    failed = (F.col(f"{q}.n_words") < MIN_WORDS) | (100 * F.col(f"{q}.n_repeat_words") > MOST_REPEATED_PERCENT * F.col(f"{q}.n_words"))
    weighed = lambda rows: rows.withColumn(f, fold(F.col(id_col))).join(table, f).withColumn(q, figures).drop(f, w)
    of_trusted = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(chosen, "_id", "left_semi").toDF(id_col, text_col)
    # written before the rows that fail go: a filter on ``failed`` would be moved below the join and score every document
    own = durable(weighed(of_trusted).select(q).select(F.when(~failed, F.col(f"{q}.score")).alias("s")), "trusted-scores")
    least = quantile(own.where("s IS NOT NULL"), REJECTED_TRUSTED)
    threshold = THRESHOLD if least is None else min(THRESHOLD, least)

    body = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(body, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    out = weighed(docs).withColumns({
        "n_words": F.col(f"{q}.n_words"),
        "word_chars": F.length(F.translate(body, " \t\n\x0b\x0c\r", "")).cast("long"),
        "n_symbols": (F.length(body) - F.length(F.translate(body, SYMBOLS, ""))).cast("long"),
        "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "n_repeat_words": F.col(f"{q}.n_repeat_words"),
        "score": F.col(f"{q}.score"),
        "base_failed": failed,
    })
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("score") >= threshold)).drop(q)
