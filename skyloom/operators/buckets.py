"""Square buckets for spatial joins that split where they hold too many points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyloom.operators import graph

#: A full bucket splits into so many by so many; this often at most.
SPLIT, DEPTH = 8, 6
#: Full buckets that are broadcast; more are joined by shuffle.
BROADCAST_BUCKETS = 200_000


class Buckets:
    """The full buckets of a point table, level by level, and what places points and sends boxes by them.

    A level's full buckets are found among the points of the full ones above, so each
    level counts fewer points.  There are at most points / ``most`` of them.  Points of
    a bucket that is full at the last level, as where they coincide, are dealt over parts
    by a hash of the row, and boxes go to all parts.
    """

    def __init__(self, points: DataFrame, x: str, y: str, side: float, most: int):
        if side <= 0 or most < 1:
            raise ValueError("side and most must be positive")
        self.side, self.most, self.full = side, most, []
        rows = points.select(F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y")).where("_x IS NOT NULL AND _y IS NOT NULL")
        for level in range(DEPTH + 1):
            rows = rows.withColumns({"_bx": self._at(F.col("_x"), level), "_by": self._at(F.col("_y"), level)})
            found = graph.written(rows.groupBy("_bx", "_by").agg(F.count("*").alias("_n")).where(F.col("_n") > most))
            n = found.count()
            if not n:
                break
            self.full.append(F.broadcast(found) if n <= BROADCAST_BUCKETS else found)
            rows = rows.join(self.full[-1].select("_bx", "_by"), ["_bx", "_by"], "left_semi").select("_x", "_y")

    def _at(self, value: Column, level: int) -> Column:
        return F.floor(value / (self.side / SPLIT**level))

    def _is_last(self, level: int) -> bool:
        return level == DEPTH

    def placed(self, points: DataFrame, x: str, y: str) -> DataFrame:
        """``points`` with the columns _l, _bx, _by, _part of their bucket."""
        names = [F.col(f"`{c}`") for c, t in points.dtypes if "map" not in t and "variant" not in t]
        out = points.withColumns({"_l": F.lit(0), "_bx": self._at(F.col(x), 0), "_by": self._at(F.col(y), 0), "_part": F.lit(0)})
        for level, full in enumerate(self.full):
            out = out.join(full.withColumn("_l", F.lit(level)), ["_l", "_bx", "_by"], "left")
            if self._is_last(level):
                out = out.withColumn("_part", F.when(F.col("_n").isNotNull(), F.pmod(F.xxhash64(*names), F.ceil(F.col("_n") / self.most)).cast("int")).otherwise(0))
            else:
                down = {"_l": F.lit(level + 1), "_bx": self._at(F.col(x), level + 1), "_by": self._at(F.col(y), level + 1)}
                out = out.withColumns({c: F.when(F.col("_n").isNotNull(), v).otherwise(F.col(c)) for c, v in down.items()})
            out = out.drop("_n")
        return out

    def sent(self, boxes: DataFrame, x0: Column, y0: Column, x1: Column, y1: Column) -> DataFrame:
        """``boxes`` once for every bucket that their bounds meet, with _l, _bx, _by, _part; full buckets give way to the ones below."""
        out = boxes.withColumns({"_x0": x0, "_y0": y0, "_x1": x1, "_y1": y1, "_l": F.lit(0), "_part": F.lit(0)})
        span = lambda a, b, level: F.sequence(self._at(F.col(a), level), self._at(F.col(b), level))
        out = out.withColumn("_bx", F.explode(span("_x0", "_x1", 0))).withColumn("_by", F.explode(span("_y0", "_y1", 0)))
        for level, full in enumerate(self.full):
            out = out.join(full.withColumn("_l", F.lit(level)), ["_l", "_bx", "_by"], "left")
            if self._is_last(level):
                out = out.withColumn("_part", F.explode(F.when(F.col("_n").isNotNull(), F.sequence(F.lit(0), F.ceil(F.col("_n") / self.most).cast("int") - 1)).otherwise(F.array(F.lit(0)))))
            else:
                below = lambda b, a, z: F.sequence(F.greatest(F.col(b) * SPLIT, self._at(F.col(a), level + 1)), F.least(F.col(b) * SPLIT + SPLIT - 1, self._at(F.col(z), level + 1)))  # noqa: B023, E731
                own = lambda b: F.array(F.col(b))
                hit = F.col("_n").isNotNull()
                out = out.withColumns({"_xs": F.when(hit, below("_bx", "_x0", "_x1")).otherwise(own("_bx")), "_ys": F.when(hit, below("_by", "_y0", "_y1")).otherwise(own("_by")), "_l": F.when(hit, level + 1).otherwise(F.col("_l"))})
                out = out.drop("_bx", "_by").withColumn("_bx", F.explode("_xs")).withColumn("_by", F.explode("_ys")).drop("_xs", "_ys")
            out = out.drop("_n")
        return out.drop("_x0", "_y0", "_x1", "_y1")


KEYS = ["_l", "_bx", "_by", "_part"]
