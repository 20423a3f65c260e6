"""Document fingerprints by winnowing, in DataFrame operations only.

Hashes of all byte ``K``-grams of a text stand in a row; of every ``WINDOW``
consecutive ones the least is chosen, the rightmost where several are least, and
its place is kept.  Two texts that have ``K + WINDOW - 1`` equal bytes in a row
share a chosen hash, whatever stands around them, and none of less than ``K``
equal bytes is shared.  About two of ``WINDOW + 1`` places are chosen.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, numbered
from .quality import let

#: Bytes of a gram; grams of a window, a multiple of ``STRIDE``, three times that at least.
K, WINDOW = 24, 64
#: Grams of a run, whose least hash is found once for all windows around it.
STRIDE = 8
#: Windows that are looked at together, which bounds the memory that a long text needs.
BLOCK = 1 << 16
#: Low bits of a hash that give way to the gram's place in its block.
_PLACE = 20
_MASK = (1 << _PLACE) - 1
#: Neighbouring ids, as a power of two, that one window of the reading order holds.
_NEAR = 9
#: Heads of such windows that are broadcast; more are joined by shuffle.
BROADCAST_HEADS = 200_000


def winnow(text: Column, k: int = K, window: int = WINDOW) -> Column:
    """The fingerprint of a text (or of bytes), array<struct<hash: long, place: int>> by place (in bytes from 0).

    A text of fewer than ``k`` bytes is one gram, one of fewer than ``window`` grams one
    window; null and empty texts have no fingerprint (an empty array).
    """
    if window % STRIDE or window < 3 * STRIDE:
        raise ValueError(f"window must be a multiple of {STRIDE}, three times that at least")
    body = F.coalesce(text.cast("binary"), F.lit(b""))

    def block(b: Column, first: Column, n: Column) -> Column:
        # A gram's turn counts down from _MASK in the low bits, so the least key is the rightmost least hash.
        key = lambda t: F.shiftleft(F.xxhash64(F.substring(b, first - t, F.lit(k))), _PLACE).bitwiseOR(t.cast("long"))
        runs = F.transform(F.sequence(F.lit(_MASK), F.lit(_MASK + 1) - n, F.lit(-STRIDE)), lambda t: F.transform(F.sequence(t, F.greatest(t - (STRIDE - 1), F.lit(_MASK + 1) - n), F.lit(-1)), key))

        def of_windows(r: Column, low: Column) -> Column:
            """The least keys of all windows.  Those that start in a run have the runs between in common, whose least key is mostly that of all of them."""
            across = window // STRIDE

            def each(own: Column, past: Column, j: Column, middle: Column) -> Column:
                least = [F.least(middle, *[F.get(own, F.lit(o)) for o in range(s, STRIDE)], *[F.get(past, F.lit(o)) for o in range(s)]) for s in range(STRIDE)]
                return F.slice(F.array(*least), 1, F.least(F.lit(STRIDE), n - window + 1 - STRIDE * j))

            def start(own: Column, j: Column) -> Column:
                common = F.least(*[F.get(low, j + d) for d in range(1, across)])
                alike = lambda m: (F.get(low, j) > m) & F.coalesce(F.get(low, j + across) > m, F.lit(True))
                return let(common, lambda m: F.when(alike(m), F.array(m)).otherwise(each(own, F.get(r, j + across), j, m)))

            return F.array_distinct(F.flatten(F.transform(F.slice(r, 1, F.floor((n - window) / STRIDE).cast("int") + 1), start)))

        lows = lambda r: F.transform(r, lambda x: F.array_min(x))
        least = let(runs, lambda r: let(lows(r), lambda low: F.when(n <= window, F.array(F.array_min(low))).otherwise(of_windows(r, low))))
        return F.transform(least, lambda x: F.struct(F.shiftrightunsigned(x, _PLACE).alias("hash"), (first - 1 - x.bitwiseAND(F.lit(_MASK).cast("long")).cast("int")).alias("place")))

    def whole(b: Column, grams: Column) -> Column:
        firsts = F.sequence(F.lit(0), F.greatest(grams - window, F.lit(0)), F.lit(BLOCK))
        of = lambda first: let(F.least(F.lit(BLOCK + window - 1), grams - first), lambda n: let(first + (_MASK + 1), lambda f: block(b, f, n)))
        blocks = F.flatten(F.transform(firsts, of))
        return F.when(grams - window >= BLOCK, F.array_distinct(blocks)).otherwise(blocks)

    none = F.array().cast("array<struct<hash: bigint, place: int>>")
    return let(body, lambda b: F.when(F.octet_length(b) == 0, none).otherwise(let(F.greatest(F.octet_length(b) - k + 1, F.lit(1)), lambda grams: whole(b, grams))))


def of_first_windows(fingerprint: Column, n: Column, window: int = WINDOW) -> Column:
    """What the first ``n`` windows have chosen, as if the text ended with them.

    A choice begins with the window that the gram comes into, if its hash is not above the
    choice before it, and else with the window that the latter has left.
    """
    high = lambda x: F.shiftleft(x["hash"], _PLACE)

    def begins(x: Column, i: Column) -> Column:
        before = F.get(fingerprint, i - 1)
        return F.when(i == 0, 0).when(high(x) <= high(before), x["place"] - (window - 1)).otherwise(before["place"] + 1)

    return F.filter(fingerprint, lambda x, i: begins(x, i) < n)


def moved(fingerprint: Column, by: Column) -> Column:
    """The fingerprint with all places so many bytes further on."""
    return F.transform(fingerprint, lambda x: F.struct(x["hash"].alias("hash"), (x["place"] + by).alias("place")))


def joined(left_bytes: Column, left_print: Column, right_bytes: Column, right_print: Column, text: Column, k: int = K, window: int = WINDOW) -> Column:
    """The fingerprint of ``text``, of which the first ``left_bytes`` begin one text and all others, ``right_bytes``, another one, whose prints are known.

    Only windows across the joint are looked at anew; those before it and behind it have
    chosen in their own texts.
    """
    reach = k + window - 2
    own = F.greatest(left_bytes - reach, F.lit(0))
    other = F.greatest(right_bytes - reach, F.lit(0))
    end = F.when(other > 0, left_bytes + reach).otherwise(left_bytes + right_bytes)
    across = F.when((own > 0) & (right_bytes == 0), None).otherwise(F.substring(text.cast("binary"), own + 1, end - own))
    parts = [of_first_windows(left_print, own, window), moved(winnow(across, k, window), own), moved(of_first_windows(right_print, other, window), left_bytes)]
    return F.array_distinct(F.concat(*parts))


def hashes(fingerprint: Column) -> Column:
    """The fingerprint's distinct hashes."""
    return F.array_distinct(F.transform(fingerprint, lambda x: x["hash"]))


def likeness(a: Column, b: Column) -> Column:
    """Twice the common hashes over the hashes of both (sets of :func:`hashes`); 1 if neither has any."""
    both = F.size(a) + F.size(b)
    return F.when(both == 0, 1.0).otherwise(2.0 * F.size(F.array_intersect(a, b)) / both)


def printed(fingerprint: Column) -> Column:
    """The fingerprint as a string: hexadecimal hash, colon and place of each, joined by commas."""
    return F.array_join(F.transform(fingerprint, lambda x: F.concat(F.hex(x["hash"]), F.lit(":"), x["place"].cast("string"))), ",")


def _order(key: Column, text: Column) -> Column:
    """Where a row stands: nulls apart and last, then descending ids, then the text's hash; and the window (part, near) of that order."""
    hash_ = F.xxhash64(text)
    turned = F.when(key.isNull(), hash_).otherwise(F.bitwise_not(key))
    near = F.when(key.isNull(), F.shiftright(hash_, 44)).otherwise(F.shiftright(turned, _NEAR))
    return F.struct(key.isNull().cast("int").alias("part"), near.alias("near"), turned.alias("turned"), hash_.alias("hash"))


def with_next(rows: DataFrame, carried: list[str]) -> DataFrame:
    """``rows`` (id, text and others) with ``carried`` columns of the next row by descending id, named next_<column>.

    After the last row comes the first.  Rows of one id go by their texts' hashes, rows
    without id come last by the same.  Neighbours in id meet in a window of at most 512
    ids; the first row of each window is sent to the one before as well.  Only a window
    of one id that many rows repeat is larger.
    """
    names = rows.columns
    rows = rows.withColumn("at", _order(F.col("id"), F.col("text")))
    heads = rows.select("at.*").groupBy("part", "near").agg(F.min(F.struct("turned", "hash")).alias("head"))
    heads = numbered(heads.select("part", "near", "head.*"), [F.col("part"), F.col("near")], "n")
    n = heads.count()
    before = heads.select((F.col("n") % F.lit(max(n, 1)) + 1).alias("n"), F.struct("part", "near").alias("to"))
    heads = heads.join(before, "n").select(F.struct("part", "near", "turned", "hash").alias("at"), "to")
    rows = rows.join(F.broadcast(heads) if n <= BROADCAST_HEADS else heads, "at", "left")
    own = F.struct(F.lit(0).alias("guest"), F.struct("at.part", "at.near").alias("w"))
    sent = F.when(F.col("to").isNotNull(), F.array(own, F.struct(F.lit(1).alias("guest"), F.col("to").alias("w")))).otherwise(F.array(own))
    order = Window.partitionBy("w").orderBy("guest", "at", "text")
    rows = rows.select(*names, "at", F.inline(sent)).withColumns({f"next_{c}": F.lead(c).over(order) for c in carried})
    return rows.where("guest = 0").drop("at", "guest", "w")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, window: int = WINDOW) -> DataFrame:
    """One row per row of ``docs``: doc_id, text, edited, print, edited_print, near_edited, near_next.

    edited is the text with its last third (rounded down, in code points) replaced by as
    many of the first ones of the next document by descending id; prints are fingerprints.
    Windows on one side of the joint have chosen in their own texts and are not looked at
    again.  Null texts are empty ones, whose likeness to each other is 1 and to others 0.
    Repeated rows and ids are documents one by one, rows without id come last; an only
    document is its own next one.  An empty table gives an empty result; other columns are
    not looked at.
    """
    third = F.floor(F.length("text") / 3).cast("int")
    left, right = F.left(F.col("text"), F.length("text") - third), F.left(F.col("next_text"), third)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = with_next(rows.withColumn("print", winnow(F.col("text"), k, window)), ["text", "print"])
    rows = rows.withColumns({"edited": F.concat(left, right), "left": F.octet_length(left), "right": F.octet_length(right)})
    again = joined(F.col("left"), F.col("print"), F.col("right"), F.col("next_print"), F.col("edited"), k, window)
    figures = lambda own, e: F.struct(e.alias("edited_print"), likeness(own, hashes(e)).alias("near_edited"), likeness(own, hashes(F.col("next_print"))).alias("near_next"))
    rows = rows.withColumn("both", let(hashes(F.col("print")), lambda own: let(again, lambda e: figures(own, e))))
    return rows.select(F.col("id").alias("doc_id"), "text", "edited", "print", "both.*")
