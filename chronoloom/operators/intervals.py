"""Interval algebra over recordings: merge, complement, overlap, coverage, keep ranges, kept time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

MIN_GAP_MS = 700
MERGE_GAP_MS = 50
PAUSE_MERGE_MS, PAUSE_LEAST_MS = 120, 100
EPSILON_MS, PAD_BEFORE_MS, PAD_AFTER_MS = 50, 80, 120


def islands(df: DataFrame, keys: list[str], gap: int, strict: bool, start: str = "start_ms", end: str = "end_ms") -> DataFrame:
    """Adds `island`, counted from 1 in each key: a row joins the island before it when the gap to the
    latest end so far is below `gap` (`strict`) or at most `gap`."""
    order = W.partitionBy(*keys).orderBy(start, end)
    latest = F.max(end).over(order.rowsBetween(W.unboundedPreceding, -1))
    apart = F.col(start) - latest
    new = latest.isNull() | ((apart >= gap) if strict else (apart > gap))
    return df.withColumn("__new", new.cast("int")).withColumn("island", F.sum("__new").over(order.rowsBetween(W.unboundedPreceding, 0))).drop("__new")


def merge_ranges(df: DataFrame, keys: list[str], gap: int = MERGE_GAP_MS, strict: bool = False) -> DataFrame:
    """Merged intervals of each key: (*keys, start_ms, end_ms)."""
    grouped = islands(df, keys, gap, strict).groupBy(*keys, "island")
    return grouped.agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms")).drop("island")


def speech_intervals(words: DataFrame, keys: list[str], gap: int = MIN_GAP_MS) -> DataFrame:
    """Words of positive length, merged while they are less than `gap` apart."""
    return merge_ranges(words.filter("end_ms > start_ms"), keys, gap, strict=True)


def silent_gaps(intervals: DataFrame, spans: DataFrame, least: int = MIN_GAP_MS) -> DataFrame:
    """What is left of (media_id, span_start, span_end) outside the intervals, in pieces of at least `least`."""
    inside = intervals.join(spans, "media_id").filter("end_ms > span_start AND start_ms < span_end")
    order = W.partitionBy("media_id").orderBy("start_ms", "end_ms")
    cursor = F.greatest(F.col("span_start"), F.max("end_ms").over(order.rowsBetween(W.unboundedPreceding, -1)))
    before = inside.select("media_id", cursor.alias("gap_start"), F.col("start_ms").alias("gap_end"))
    ends = inside.groupBy("media_id").agg(F.max("end_ms").alias("last"))
    tail = spans.join(ends, "media_id", "left").select(
        "media_id", F.greatest("span_start", "last").alias("gap_start"), F.col("span_end").alias("gap_end")
    )
    return before.unionByName(tail).filter(F.col("gap_end") - F.col("gap_start") >= least)


def segment_pauses(segments: DataFrame, spans: DataFrame, least: int) -> DataFrame:
    """From each segment's end to the next one's start, the last one's to the recording's end."""
    after = F.lead("start_ms").over(W.partitionBy("media_id").orderBy("start_ms", "segment_id"))
    pauses = segments.withColumn("next", after).join(spans.select("media_id", "span_end"), "media_id")
    end = F.least(F.coalesce("next", "span_end"), F.col("span_end"))
    return pauses.select("media_id", F.greatest(F.lit(0), F.col("end_ms")).alias("start_ms"), end.alias("end_ms"), F.lit("transcript").alias("source")).filter(
        F.col("end_ms") - F.col("start_ms") >= least
    )


def merge_pauses(pauses: DataFrame, gap: int = PAUSE_MERGE_MS, least: int = PAUSE_LEAST_MS) -> DataFrame:
    """Pauses merged up to `gap` apart, with their sources joined by +; those under `least` go."""
    merged = (
        islands(pauses, ["media_id"], gap, strict=False)
        .groupBy("media_id", "island")
        .agg(
            F.min("start_ms").alias("start_ms"),
            F.max("end_ms").alias("end_ms"),
            F.array_join(F.array_sort(F.collect_set("source")), "+").alias("source"),
        )
    )
    return merged.drop("island").withColumn("duration_ms", F.col("end_ms") - F.col("start_ms")).filter(F.col("duration_ms") >= least)


def overlap_ms(pieces: DataFrame, ranges: DataFrame, id_col: str, bucket: int = 60_000) -> DataFrame:
    """Adds covered_ms and coverage: how much of each piece (media_id, id, start_ms, end_ms) the ranges cover.

    Both sides are cut into buckets of time, so the join is by equality and stays even.
    """
    def cut(df: DataFrame, mark: str) -> DataFrame:
        first, last = F.expr(f"start_ms DIV {bucket}"), F.expr(f"greatest(end_ms - 1, start_ms) DIV {bucket}")
        return df.withColumn(mark, F.explode(F.sequence(first, last)))

    a = cut(pieces.filter("end_ms >= start_ms"), "b")
    r = cut(ranges.filter("end_ms > start_ms").select("media_id", "start_ms", "end_ms"), "b").select(
        "media_id", "b", F.col("start_ms").alias("__s"), F.col("end_ms").alias("__e")
    )
    low = F.greatest("start_ms", "__s", F.col("b") * bucket)
    high = F.least("end_ms", "__e", (F.col("b") + 1) * bucket)
    found = a.join(r, ["media_id", "b"]).groupBy("media_id", id_col).agg(F.sum(F.greatest(F.lit(0).cast("bigint"), high - low)).alias("covered_ms"))
    return pieces.join(found, ["media_id", id_col], "left").withColumn("covered_ms", F.coalesce("covered_ms", F.lit(0))).withColumn(
        "coverage", F.coalesce(F.try_divide("covered_ms", F.col("end_ms") - F.col("start_ms")), F.lit(0.0))
    )


def removed_part(start: Column, end: Column, keep: Column) -> tuple[Column, Column]:
    """The middle of a pause that goes, when `keep` ms of it stay: 45 % before, the rest after, with paddings."""
    p = end - start
    k = F.least(p, F.greatest(keep, F.least(p, F.lit(200))))
    before = F.least(k, F.greatest(F.lit(PAD_BEFORE_MS), F.expr("0") + F.floor(k * 45 / 100).cast("bigint")))
    after = F.least(p - before, F.greatest(F.lit(PAD_AFTER_MS), k - before))
    return start + before, end - after


def keep_ranges(decisions: DataFrame, spans: DataFrame) -> DataFrame:
    """Recordings without the removed middles of their pauses: (media_id, start_ms, end_ms) that stay.

    `decisions`: media_id, start_ms, end_ms, action, keep_ms.
    """
    low, high = removed_part(F.col("start_ms"), F.col("end_ms"), F.col("keep_ms"))
    removed = (
        decisions.filter((F.col("action") != "keep") & (F.col("end_ms") - F.col("start_ms") > 100))
        .select("media_id", low.alias("cut_start"), high.alias("cut_end"))
        .filter(F.col("cut_end") - F.col("cut_start") > EPSILON_MS)
    )
    order = W.partitionBy("media_id").orderBy("cut_start", "cut_end")
    cursor = F.coalesce(F.max("cut_end").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0).cast("bigint"))
    kept = removed.select("media_id", cursor.alias("start_ms"), F.col("cut_start").alias("end_ms"))
    last = removed.groupBy("media_id").agg(F.max("cut_end").alias("cut_end"))
    tail = spans.join(last, "media_id", "left").select("media_id", F.coalesce("cut_end", F.lit(0).cast("bigint")).alias("start_ms"), F.col("span_end").alias("end_ms"))
    return kept.unionByName(tail).filter(F.col("end_ms") - F.col("start_ms") > EPSILON_MS)


def kept_positions(points: DataFrame, ranges: DataFrame) -> DataFrame:
    """Adds kept_ms to (media_id, t_ms): its place in the kept ranges played one after the other.

    A time between two ranges counts as the end of the earlier one. One pass over both, in time order.
    """
    order = W.partitionBy("media_id").orderBy("start_ms")
    at = ranges.withColumn("__before", F.coalesce(F.sum(F.col("end_ms") - F.col("start_ms")).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    marks = at.select("media_id", F.col("start_ms").alias("__t"), F.lit(0).alias("__kind"), F.struct("start_ms", "end_ms", "__before").alias("__range"))
    both = points.withColumn("__t", F.col("t_ms")).withColumn("__kind", F.lit(1)).unionByName(marks, allowMissingColumns=True)
    last = F.last("__range", ignorenulls=True).over(W.partitionBy("media_id").orderBy("__t", "__kind").rowsBetween(W.unboundedPreceding, 0))
    placed = both.withColumn("__last", last).filter("__kind = 1")
    kept = F.col("__last.__before") + F.least(F.col("t_ms"), F.col("__last.end_ms")) - F.col("__last.start_ms")
    return placed.withColumn("kept_ms", F.coalesce(kept, F.lit(0)).cast("bigint")).select(*points.columns, "kept_ms")
