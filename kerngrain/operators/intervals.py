"""Joins of points with intervals of any length, without a row for each step of an interval.

An interval goes to the level of its length: levels are powers of sixteen, and an interval touches at most two buckets of its own level
(up to sixteen at the highest). A point looks once at each level that there is. Both meet by an equi-join on the keys, the level and the
bucket, so that an interval of a year costs two rows and a million short ones a row or two each; what a bucket holds beside is sorted out
by the bounds. Levels are at most sixteen, and only their numbers come to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_BITS, _HIGHEST = 4, 15


def points_in(points: DataFrame, spans: DataFrame, keys: list[str], at: str, begin: str, end: str) -> DataFrame:
    """Points with each interval of the same keys that holds them, both ends included. Columns but the keys must differ in name.

    Null ends are without end; intervals without a begin, or that end before it, hold nothing, nor do points without a time.
    """
    last = F.coalesce(F.col(end), F.lit(2**63 - 1))
    length = F.greatest(last - F.greatest(F.col(begin), F.lit(0)), F.lit(0))
    level = F.least(F.ceil(F.length(F.bin(length)) / _BITS), F.lit(_HIGHEST)).cast("int")
    some = spans.where(F.col(begin).isNotNull() & (last >= F.col(begin))).withColumn("level_", level)
    some = some.withColumn("bucket_", F.explode(F.expr(f"sequence(shiftright({begin}, level_ * {_BITS}), shiftright(coalesce({end}, {2**63 - 1}), level_ * {_BITS}))")))
    levels = [r.level_ for r in some.select("level_").distinct().collect()]
    rows = points.where(F.col(at).isNotNull()).withColumn("level_", F.explode(F.array(*map(F.lit, levels)).cast("array<int>")))
    rows = rows.withColumn("bucket_", F.expr(f"shiftright({at}, level_ * {_BITS})"))
    return rows.join(some, [*keys, "level_", "bucket_"]).where((F.col(at) >= F.col(begin)) & (F.col(at) <= last)).drop("level_", "bucket_")
