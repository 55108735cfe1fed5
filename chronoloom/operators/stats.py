"""Statistics whose definitions differ from the built-in ones, and model metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronoloom.sources.views import settled


def nearest_percentiles(df: DataFrame, keys: list[str], **wanted: tuple[Column, int]) -> DataFrame:
    """(*keys, one column for each name): the value at place round(q/100 (n-1)), halves to even, of a key's sorted values.

    wanted: name=(values, q). Nulls don't count; of no values the result is null. Rows become
    counts of distinct values before they move, so a key with very many rows is no heavier than
    its distinct values, and running counts over these give the place.
    """
    each = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(q).alias("q"), values.alias("v")) for name, (values, q) in wanted.items()])
    counted = df.select(*keys, F.inline(each)).groupBy(*keys, "name", "q", "v").agg(F.count("v").alias("n"))
    upto = W.partitionBy(*keys, "name").orderBy(F.col("v").asc_nulls_first())
    placed = (
        counted.withColumn("to", F.sum("n").over(upto.rowsBetween(W.unboundedPreceding, W.currentRow)))
        .withColumn("all", F.sum("n").over(W.partitionBy(*keys, "name")))
        .withColumn("place", F.bround(F.col("q") * (F.col("all") - 1) / 100))
    )
    there = (F.col("place") >= F.col("to") - F.col("n")) & (F.col("place") < F.col("to"))
    return placed.groupBy(*keys).agg(*[F.max(F.when((F.col("name") == name) & there, F.col("v"))).alias(name) for name in wanted])


def with_columns_of(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join on equal keys, null equal to null."""
    named = right.select(*[F.col(k).alias(f"__{k}") for k in keys], *[c for c in right.columns if c not in keys])
    on = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    return left.join(named, on).drop(*[f"__{k}" for k in keys])


def or_default(value: Column, default: int) -> Column:
    """A default for a missing value and for 0."""
    return F.coalesce(F.nullif(value, F.lit(0)), F.lit(default))


def first_mode(df: DataFrame, keys: list[str], value: str, order: str, weight: Column | None = None) -> DataFrame:
    """(*keys, value): the value with the most rows (or weight) in each key, the first seen on ties."""
    counted = df.groupBy(*keys, value).agg(F.sum(F.lit(1) if weight is None else weight).alias("__n"), F.min(order).alias("__first"))
    return counted.groupBy(*keys).agg(F.max_by(value, F.struct("__n", (-F.col("__first")).alias("f"))).alias(value))


def f1(predicted: Column, actual: Column) -> Column:
    """F1 in ten-thousandths, rounded down; null without any positive. An aggregate."""
    hit, either = F.count_if(predicted & actual), F.count_if(predicted) + F.count_if(actual)
    return F.when(either > 0, F.floor(2 * hit * 10000 / either)).cast("bigint")


def auc(df: DataFrame, keys: list[str], score: str, y: str) -> DataFrame:
    """Area under the curve in each key from average ranks (ties count half), in ten-thousandths; null with one class."""
    order = W.partitionBy(*keys).orderBy(score)
    ties = W.partitionBy(*keys, score)
    ranked = df.withColumn("__r2", 2 * F.rank().over(order) + F.count("*").over(ties) - 1)
    pos, n = F.sum(y), F.count("*")
    twice = F.sum(F.when(F.col(y) == 1, F.col("__r2"))) - pos * (pos + 1)
    return ranked.groupBy(*keys).agg(F.when((pos > 0) & (pos < n), F.floor(twice * 10000 / (2 * pos * (n - pos)))).cast("bigint").alias("auc"))


def holdout(df: DataFrame, order: list[str], every: int = 4) -> DataFrame:
    """Adds `part`: each `every`th row in order is for the test. Rows are numbered in ranges that run in parallel."""
    ranges = settled(df.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()))
    before = W.orderBy("__range").rowsBetween(W.unboundedPreceding, -1)  # one row a range
    offsets = ranges.groupBy("__range").agg(F.count("*").alias("__n")).withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0)))
    number = F.row_number().over(W.partitionBy("__range").orderBy(*order)) - 1 + F.col("__before")
    part = F.when(number % every == every - 1, "test").otherwise("train")
    return ranges.join(offsets.drop("__n"), "__range").withColumn("part", part).drop("__range", "__before")


def score_windows(spans: DataFrame, size: int, overlap: int) -> DataFrame:
    """Windows of `size` that overlap by `overlap` over each span; the last is cut at the end."""
    starts = F.expr(f"sequence(span_start, greatest(span_start, span_end - 1), {size - overlap})")
    each = spans.withColumn("win_start", F.explode(starts)).withColumn("win_end", F.least(F.col("win_start") + size, F.col("span_end")))
    whole = F.max(F.col("win_end")).over(W.partitionBy("media_id").orderBy("win_start").rowsBetween(W.unboundedPreceding, -1))
    return each.withColumn("__done", F.coalesce(whole, F.lit(-1))).filter(F.col("__done") < F.col("span_end")).select("media_id", "win_start", "win_end")
