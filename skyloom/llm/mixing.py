"""Mixing sources to target weights along a time-varying curriculum, in DataFrame operations only.

A source's weight schedule over training progress t in [0, 1] is the line
1 + c (2t - 1), whose integral over the whole run is 1, so a schedule moves a
source's words in time without changing how many there are.  Cumulative demand
is target * (t + c (t^2 - t)); inverting it at a document's word offset within
its source gives the document's training position.

Offsets come from a two-level prefix sum: documents fall into 4096 buckets of
their source by the leading digits of md5(doc_id), bucket totals are summed
first, and the running sum inside a bucket adds the bucket's offset.  No source,
however large, is gathered in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, word_count

#: Weights of the sources in code-point order, repeated; and each weight's slope c.
WEIGHTS = (1, 2, 3)
SLOPES = (-0.5, 0.0, 0.5)
#: Times its size that a source or a document may be taken.
MOST = 3
#: Leading hexadecimal digits of md5(doc_id) that name a bucket.
BUCKET_DIGITS = 3


def sources_table(sizes: DataFrame) -> DataFrame:
    """Per source key: source_size, weight, slope, target, total; targets above MOST times the size are cut and their excess reshared.

    Cutting and resharing until none is above ends where each target is
    min(cap, rate * weight) with one common rate.  In the order of cap / weight the
    cut sources come first, so running sums give the rate in closed form.
    """
    every = Window.orderBy(F.col("source").asc_nulls_last())
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("turn", (F.row_number().over(every) - 1) % len(WEIGHTS))
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), F.col("turn") + 1)
    by = by.withColumns({"weight": pick(WEIGHTS).cast("long"), "slope": pick(SLOPES), "cap": MOST * F.col("source_size")})
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, whole = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    by = by.withColumns({
        "total": F.sum("source_size").over(whole),
        "cut_words": F.coalesce(F.sum("cap").over(before), F.lit(0)),
        "open_weight": F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0)),
    })
    by = by.withColumn("rate", (F.col("total") - F.col("cut_words")) / F.col("open_weight"))
    by = by.withColumn("open_rate", F.when(F.col("cap") > F.col("rate") * F.col("weight"), F.col("rate")))
    by = by.withColumn("common", F.first("open_rate", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    target = F.least(F.col("cap").cast("double"), F.coalesce(F.col("common") * F.col("weight"), F.col("cap").cast("double")))
    return by.select("source", "source_size", "weight", "slope", target.alias("target"), "total")


def _row_hash(docs: DataFrame) -> Column:
    """A hash of all columns that have one, which tells rows of one id apart."""
    return F.xxhash64(*[F.col(f"`{c}`") for c, t in docs.dtypes if "map" not in t and "variant" not in t])


def _planned(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """Per document: size, its source's figures, offset within the source, whole passes and words taken."""
    code = F.md5(F.col(id_col).cast("string"))
    sizes = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size"), code.alias("code"), _row_hash(docs).alias("row"))
    sizes = durable(sizes, "mix-sizes").withColumns({"name": F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n")), "bucket": F.coalesce(F.substring("code", 1, BUCKET_DIGITS), F.lit(""))})
    buckets = sizes.groupBy("name", "source", "bucket").agg(F.sum("size").alias("words"))
    per_source = sources_table(buckets.select("source", F.col("words").alias("size")))
    per_source = per_source.withColumn("name", F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n"))).drop("source")
    ahead = Window.partitionBy("name").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = buckets.withColumn("ahead", F.coalesce(F.sum("words").over(ahead), F.lit(0))).drop("words", "source").join(per_source, "name")
    inside = Window.partitionBy("name", "bucket").orderBy("code", "doc_id", "row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = sizes.drop("source").join(buckets, ["name", "bucket"]).withColumn("offset", F.col("ahead") + F.sum("size").over(inside) - F.col("size"))
    passes = F.when(F.col("source_size") > 0, F.least(F.lit(MOST).cast("long"), F.floor(F.col("target") / F.col("source_size")))).otherwise(0)
    rows = rows.withColumn("passes", passes)
    rest = F.round("target").cast("long") - F.col("passes") * F.col("source_size")
    more = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), rest - F.col("offset")))
    return rows.withColumn("taken", F.when(F.col("passes") >= MOST, MOST * F.col("size")).otherwise(F.col("passes") * F.col("size") + more).cast("long"))


def _position(offset: Column) -> Column:
    """The word position in the mixed stream at which the source's demand reaches ``offset``: its schedule's integral, inverted."""
    share, c = F.least(F.lit(1.0), offset / F.col("target")), F.col("slope")
    progress = F.when(c == 0, share).otherwise((F.sqrt((1 - c) * (1 - c) + 4 * c * share) - (1 - c)) / (2 * c))
    return F.when(F.col("taken") > 0, F.round(progress * F.col("total"), 3))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, position; sorted by position.

    taken sums to the source's rounded target: whole passes over the source, then
    one more pass in md5 order up to the target, whose last document is taken in
    part.  position is the word position in the mixed stream at which the document
    first comes, null if it is not taken.  Null texts have size 0, null sources are
    a source of their own, and an empty table gives an empty result.  Equal inputs
    give equal results, however they are partitioned.
    """
    rows = _planned(docs, id_col, text_col, source_col).withColumn("position", _position(F.col("offset")))
    return rows.select("doc_id", "size", "source_size", "target", "taken", "position").orderBy("position", "doc_id")


def stream(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of ``docs`` as the mix takes them: repeated by pass, whole, range-sorted by training position.

    A document that is taken in part in its last pass comes whole; one that is not
    taken goes, as do all without words.  Rows of one id are taken one by one; equal
    rows each have their turn.  Rows without id are rows like others; a null source is
    a source of its own; an empty table gives an empty one.
    """
    times = F.when(F.col("size") > 0, F.ceil(F.col("taken") / F.col("size"))).otherwise(0)
    plan = _planned(docs, id_col, text_col, source_col).withColumn("times", times).where("times > 0")
    plan = plan.withColumn("pass", F.explode(F.sequence(F.lit(0).cast("long"), F.col("times") - 1)))
    # Both sides are dealt by the same two keys, neither of which is null, so that texts are shuffled once for them.
    key = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    plan = plan.select(F.col("doc_id").alias("_id"), key("doc_id").alias("_key"), F.col("row").alias("_row"), "pass", _position(F.col("offset") + F.col("pass") * F.col("source_size")).alias("position"))
    # Equal rows stand in the plan once each, so one of them is enough on the other side.
    rows = docs.select(_row_hash(docs).alias("_row"), key(id_col).alias("_key"), F.struct(*docs.columns).alias("row")).groupBy("_row", "_key").agg(F.first("row").alias("row"))
    return rows.join(plan, ["_row", "_key"]).orderBy("position", "_id", "_row", "pass").select("row.*")


ORACLE = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, md5(doc_id::VARCHAR) AS code FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS turn, sum(source_size) OVER ()::BIGINT AS total FROM s),
c AS (SELECT *, (turn + 1)::BIGINT AS weight, (turn - 1) * 0.5::DOUBLE AS slope, 3 * source_size AS cap FROM w),
o AS (SELECT *, coalesce(sum(cap) OVER q, 0)::BIGINT AS cut_words, (sum(weight) OVER () - coalesce(sum(weight) OVER q, 0))::BIGINT AS open_weight
      FROM c WINDOW q AS (ORDER BY cap::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
r AS (SELECT *, (total - cut_words)::DOUBLE / open_weight AS rate FROM o),
f AS (SELECT *, (SELECT min_by(rate, cap::DOUBLE / weight) FROM r WHERE cap > rate * weight) AS common FROM r),
t AS (SELECT source, source_size, slope, total, least(cap::DOUBLE, coalesce(common * weight, cap::DOUBLE)) AS target FROM f),
p AS (SELECT d.doc_id, d.size, t.source_size, t.target, t.slope, t.total,
             CASE WHEN t.source_size > 0 THEN least(3, floor(t.target / t.source_size))::BIGINT ELSE 0 END AS passes,
             (sum(d.size) OVER (PARTITION BY d.source ORDER BY d.code, d.doc_id ROWS UNBOUNDED PRECEDING) - d.size)::BIGINT AS off
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
k AS (SELECT *, (CASE WHEN passes >= 3 THEN 3 * size ELSE passes * size + greatest(0, least(size, round(target)::BIGINT - passes * source_size - off)) END)::BIGINT AS taken,
             CASE WHEN target > 0 THEN least(1.0::DOUBLE, off / target) END AS share FROM p)
SELECT doc_id, size, source_size, target, taken,
       CASE WHEN taken > 0 THEN round(CASE WHEN slope = 0 THEN share ELSE (sqrt((1 - slope) * (1 - slope) + 4 * slope * share) - (1 - slope)) / (2 * slope) END * total, 3) END AS position
FROM k
"""
