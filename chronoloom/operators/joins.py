"""As-of, nearest and point-in-interval joins without nested loops: one ordered pass over both sides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def as_of(left: DataFrame, right: DataFrame, key: str, t: str, right_t: str, value: Column, name: str, forward: bool = False) -> DataFrame:
    """Adds `value` of the right row with the latest `right_t` <= t (or the earliest >= t) as `name`.

    Rows of both sides are merged in time order within the key, so each is shuffled once. Among
    equal times the later (`forward`: earlier) row by value order counts.
    """
    marks = right.select(key, F.col(right_t).alias("__t"), F.lit(0).alias("__side"), value.alias("__v")).filter("__t IS NOT NULL")
    rows = left.withColumn("__t", F.col(t)).withColumn("__side", F.lit(1)).unionByName(marks, allowMissingColumns=True)
    if forward:
        order = W.partitionBy(key).orderBy(F.desc("__t"), "__side", F.desc("__v"))
    else:
        order = W.partitionBy(key).orderBy("__t", "__side", "__v")
    seen = F.last("__v", ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, 0))
    return rows.withColumn(name, seen).filter("__side = 1").select(*left.columns, name)


def within(points: DataFrame, intervals: DataFrame, t: str, name: str, bucket: int = 60_000) -> DataFrame:
    """Adds the flag `name`: some interval of the recording holds t, both ends included."""
    cover = intervals.withColumn("__b", F.explode(F.expr(f"sequence(start_ms DIV {bucket}, greatest(start_ms, end_ms) DIV {bucket})"))).select(
        "media_id", "__b", F.col("start_ms").alias("__s"), F.col("end_ms").alias("__e")
    )
    marked = points.withColumn("__n", F.monotonically_increasing_id()).withColumn("__b", F.expr(f"{t} DIV {bucket}"))
    hit = marked.join(cover, ["media_id", "__b"], "left").withColumn("__hit", F.coalesce(F.col(t).between(F.col("__s"), F.col("__e")), F.lit(False)))
    keys = list(points.columns)
    return hit.groupBy("__n", *keys).agg(F.max("__hit").alias(name)).select(*keys, name)
