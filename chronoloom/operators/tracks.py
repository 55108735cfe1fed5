"""Ordered choices among intervals, and one-to-one matching of points."""

from __future__ import annotations

from bisect import bisect_left, bisect_right

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronoloom.operators.groups import in_groups

TOUCH = 1e-3


def islands(df: DataFrame, starts: Column, keys: list[str], order: list[str]) -> DataFrame:
    """Adds `__island`, the number of rows so far in the key that `starts` marks."""
    return df.withColumn("__island", F.sum(F.when(starts, 1).otherwise(0)).over(W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)))


def touching(df: DataFrame, start: str, end: str, gap: float, order: list[str]) -> DataFrame:
    """Adds `__island`: rows of different numbers in a recording are at least `gap` apart, so each can be judged without the others."""
    before = F.max(end).over(W.partitionBy("media_id").orderBy(*order).rowsBetween(W.unboundedPreceding, -1))
    marked = df.withColumn("__before", before)
    apart = F.col("__before").isNull() | ((F.col(start) >= F.col("__before") + gap) & (F.col(start) - gap >= F.col("__before")) & (F.col(start) - F.col("__before") >= gap))
    return islands(marked, apart, ["media_id"], order).drop("__before")


def merge_tracks(clips: DataFrame, touch: float = TOUCH) -> DataFrame:
    """(media_id, track, start, end) of the largest track, and of the others, by size, what overlaps no chosen clip of an earlier track.

    Only clips that hang together by overlaps are judged in one group, however long the recording is.
    """
    names = clips.columns
    sizes = clips.groupBy("media_id", "track").agg(F.count("*").alias("__size"))
    sized = clips.join(sizes, ["media_id", "track"])

    start, end, track, size = (names.index(c) if c in names else len(names) for c in ("start", "end", "track", "__size"))

    def choose(rows: list[tuple]) -> list[tuple]:
        by_track: dict[tuple, list[tuple]] = {}
        for r in rows:
            if r[start] is not None and r[start] == r[start]:
                by_track.setdefault((-r[size], r[track]), []).append(r[: len(names)])
        if len(by_track) < 2:
            return [r for own in by_track.values() for r in own]
        low, high, kept = np.zeros(0), np.zeros(0), []
        for _, own in sorted(by_track.items()):
            begins, ends = (np.array([r[k] for r in own], float) for k in (start, end))
            order = np.argsort(low, kind="stable")
            reach = np.concatenate(([-np.inf], np.maximum.accumulate(high[order])))  # of the chosen clips that begin before a time
            new = begins >= reach[np.searchsorted(low[order] + touch, ends, "left")] - touch
            kept += [r for r, free in zip(own, new, strict=True) if free]
            low, high = np.concatenate((low, begins[new])), np.concatenate((high, ends[new]))
        return kept

    grouped = touching(sized.select(*names, "__size"), "start", "end", -touch, ["start", "end", "track"])
    return in_groups(grouped, ["media_id", "__island"], ["start", "end"], choose, clips.schema)


def matched_points(predicted: DataFrame, reference: DataFrame, tolerance: float) -> DataFrame:
    """One-to-one pairs of times (media_id, t) within the tolerance, nearest first; equal times are one.

    Points are cut where none follows within the tolerance; pairs never reach over such a gap.
    """
    sides = predicted.select("media_id", "t", F.lit(True).alias("found")).distinct().union(reference.select("media_id", "t", F.lit(False)).distinct())
    order = W.partitionBy("media_id").orderBy("t", "found")
    marked = sides.filter("t IS NOT NULL").withColumn("__gap", F.col("t") - F.lag("t").over(order))
    cut = islands(marked, F.col("__gap") > tolerance, ["media_id"], ["t", "found"])

    def greedy(rows: list[tuple]) -> list[tuple]:
        p, r = ([t for _, _, t, found in rows if found == side] for side in (True, False))
        near = [(abs(x - y), y, x) for x in p for y in r[bisect_left(r, x - 2 * tolerance) : bisect_right(r, x + 2 * tolerance)] if abs(x - y) <= tolerance]
        seen_p, seen_r, kept = set(), set(), []
        for _, y, x in sorted(near):
            if x not in seen_p and y not in seen_r:
                seen_p.add(x)
                seen_r.add(y)
                kept.append((rows[0][0], x, y))
        return kept

    return in_groups(cut.select("media_id", "__island", "t", "found"), ["media_id", "__island"], ["t"], greedy, "media_id long, predicted double, reference double")
