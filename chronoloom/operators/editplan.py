"""What of a recording stays: retakes and the weakest phrases go until it is short enough, then zooms are chosen.

Phrases are rows (media_id, i, start_ms, end_ms, score, ends) with i in order of time; times are whole milliseconds. The plan
is one chain of decisions, from the weakest phrase to the strongest, but each of them changes the length of the cut by what
is known of the phrase and its two neighbours. So the changes are computed for every phrase as if no limit held, and the
limit is found in their running sum: windows over short rows, no loop and no phrase compared with all others.
"""

from __future__ import annotations

import bisect

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronoloom.operators.groups import in_groups
from chronoloom.operators.intervals import kept_positions, merge_ranges

#: Ms on each side of a cut, of a pause between two kept phrases, and the share of it before the cut in hundredths.
PAD_MS, PAUSE_MS, BEFORE_SHARE = 120, 300, 45
#: A phrase right before a kept one of this score stays, if it's nearer than so many ms and its sentence goes on.
STRONG, NEAR_MS = 0.8, 700
#: Tolerated excess over the target; least probability of a retake and of a zoom; ranges this near (ms) are one.
TOLERANCE, RETAKE, ZOOM_FLOOR, JOIN_MS = 0.05, 0.5, 0.2, 1


def _bounds(phrases: DataFrame) -> DataFrame:
    """Phrases with where their range begins and ends beside a kept neighbour (joined) and beside a removed one or none (cut).

    A column pause_ms, if there is one, predicts the pause that stays behind a phrase; null is the default.
    """
    order = W.partitionBy("media_id").orderBy("i")
    after = F.lead("start_ms").over(order) - F.col("end_ms")
    default = F.least(after, F.lit(PAUSE_MS))
    pause = default
    if "pause_ms" in phrases.columns:
        pause = F.when(F.col("pause_ms").isNull(), default).otherwise(F.greatest(F.lit(0), F.least(after, F.round("pause_ms").cast("bigint"))))
    marked = phrases.withColumn("after", after).withColumn("pause", F.when(after.isNotNull(), pause))
    before = F.col("start_ms") - F.coalesce(F.lag("end_ms").over(order), F.lit(0))
    hundredths = lambda x: F.bround(x / 100).cast("bigint")
    return (
        marked.withColumn("start_joined", hundredths(F.col("start_ms") * 100 - (100 - BEFORE_SHARE) * F.lag("pause").over(order)))
        .withColumn("start_cut", F.greatest(F.lit(0).cast("bigint"), F.col("start_ms") - F.least(F.lit(PAD_MS), before)))
        .withColumn("end_joined", hundredths(F.col("end_ms") * 100 + BEFORE_SHARE * F.col("pause")))
        .withColumn("end_cut", F.col("end_ms") + F.coalesce(F.least(F.lit(PAD_MS), F.col("after")), F.lit(PAD_MS)))
    )


def _ranges(bounded: DataFrame) -> DataFrame:
    """Ranges (media_id, start_ms, end_ms) of the rows that are kept."""
    order = W.partitionBy("media_id").orderBy("i")
    left, right = (F.coalesce(f("kept").over(order), F.lit(False)) for f in (F.lag, F.lead))
    low, high = F.when(left, F.col("start_joined")).otherwise(F.col("start_cut")), F.when(right, F.col("end_joined")).otherwise(F.col("end_cut"))
    rows = bounded.select("media_id", "kept", low.alias("start_ms"), high.alias("end_ms")).filter("kept").drop("kept")
    return merge_ranges(rows, ["media_id"], JOIN_MS)


def decided(phrases: DataFrame, retakes: DataFrame, target_ms: int) -> DataFrame:
    """Phrases with kept and reason (retake, weak or null).

    retakes: media_id, first, probability; the first of a likely pair goes. Then phrases go by rising score, ties by i,
    until the ranges last at most target and tolerance. A phrase whose sentence goes on right into a strong kept phrase stays.
    """
    gone = retakes.filter(F.col("probability") >= RETAKE).select("media_id", F.col("first").alias("i"), F.lit(True).alias("gone")).distinct()
    marked = _bounds(phrases).join(gone, ["media_id", "i"], "left").withColumn("gone", F.coalesce("gone", F.lit(False)))
    first_total = _ranges(marked.withColumn("kept", ~F.col("gone"))).groupBy("media_id").agg(F.sum(F.col("end_ms") - F.col("start_ms")).alias("total"))
    time, turn = W.partitionBy("media_id").orderBy("i"), W.partitionBy("media_id").orderBy("score", "i")
    of = lambda f, c: f(c).over(time)
    placed = marked.withColumn("turn", F.row_number().over(turn))
    # a phrase hangs on a strong one that is still there; it can go only after that one, so decisions run along the chain
    hangs = (of(F.lead, "score") >= STRONG) & (F.col("after") < NEAR_MS) & ~F.col("ends") & ~of(F.lead, "gone")
    hung = placed.withColumn("hangs", F.coalesce(hangs, F.lit(False)))
    free = ~F.col("gone") & (~F.col("hangs") | (of(F.lead, "turn") < F.col("turn")))
    chained = hung.withColumn("free", free.cast("int")).withColumn("new", F.when(of(F.lag, "hangs"), 0).otherwise(1))
    chained = chained.withColumn("chain", F.sum("new").over(time.rowsBetween(W.unboundedPreceding, 0)))
    rest = W.partitionBy("media_id", "chain").orderBy("i").rowsBetween(W.currentRow, W.unboundedFollowing)
    going = chained.withColumn("goes", F.min("free").over(rest) == 1)
    there = lambda f: F.coalesce(~of(f, "gone") & ~(of(f, "goes") & (of(f, "turn") < F.col("turn"))), F.lit(False))
    beside = going.withColumn("left", there(F.lag)).withColumn("right", there(F.lead))
    near = lambda gap: F.when(gap <= JOIN_MS, gap).otherwise(F.lit(0))
    start, end = F.when(F.col("left"), F.col("start_joined")).otherwise(F.col("start_cut")), F.when(F.col("right"), F.col("end_joined")).otherwise(F.col("end_cut"))
    change = start - end
    change += F.when(F.col("left"), of(F.lag, "end_cut") - of(F.lag, "end_joined") - near(F.col("start_joined") - of(F.lag, "end_joined"))).otherwise(0)
    change += F.when(F.col("right"), of(F.lead, "start_joined") - of(F.lead, "start_cut") - near(of(F.lead, "start_joined") - F.col("end_joined"))).otherwise(0)
    change += F.when(F.col("left") & F.col("right"), near(of(F.lead, "start_cut") - of(F.lag, "end_cut"))).otherwise(0)
    changed = beside.withColumn("change", F.when(F.col("goes"), change).otherwise(F.lit(0))).join(first_total, "media_id", "left")
    left = F.coalesce("total", F.lit(0)) + F.coalesce(F.sum("change").over(turn.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    least = changed.withColumn("lasts", left).withColumn("shortest", F.min("lasts").over(turn.rowsBetween(W.unboundedPreceding, 0)))
    weak = F.col("goes") & (F.col("shortest") > target_ms * (1 + TOLERANCE))
    reason = F.when(F.col("gone"), "retake").when(weak, "weak")
    return least.select(*phrases.columns, reason.alias("reason")).withColumn("kept", F.col("reason").isNull())


def planned_ranges(plan: DataFrame) -> DataFrame:
    """The ranges (media_id, start_ms, end_ms) to keep of phrases with `kept`."""
    return _ranges(_bounds(plan))


def removal_markers(plan: DataFrame, ranges: DataFrame) -> DataFrame:
    """(media_id, t_ms, reason): a marker where each run of removed phrases was, in the time of the edited recording."""
    order = W.partitionBy("media_id").orderBy("i")
    first = plan.withColumn("before", F.coalesce(F.lag("kept").over(order), F.lit(True))).filter("NOT kept AND before")
    return kept_positions(first.select("media_id", F.col("start_ms").alias("t_ms"), "reason"), ranges).select("media_id", F.col("kept_ms").alias("t_ms"), "reason")


def chosen_zooms(plan: DataFrame, ranges: DataFrame, per_minute: float, least_gap_ms: int, shortest_ms: int, longest_ms: int, floor: float = ZOOM_FLOOR) -> DataFrame:
    """(media_id, i, start_ms, end_ms): zooms by falling probability, ties by i, as many as the rate allows.

    plan: kept phrases have a column probability. A zoom ends with its phrase and begins within it. In the edited recording
    no zoom begins nearer than `least_gap_ms` to the begin of a likelier one. What is near enough to matter hangs together
    in stretches that are judged one by one, each a few numbers a phrase; the rate cuts a recording's choices afterwards.
    """
    length = F.greatest(F.lit(shortest_ms), F.least(F.lit(longest_ms), F.col("end_ms") - F.col("start_ms")))
    begin = F.greatest("start_ms", F.col("end_ms") - length)
    rows = plan.filter("kept").filter(F.col("probability") >= floor).select("media_id", "i", "probability", "end_ms", begin.alias("t_ms"))
    placed = kept_positions(rows, ranges)
    time = W.partitionBy("media_id").orderBy("kept_ms", "i")
    apart = F.col("kept_ms") - F.lag("kept_ms").over(time) >= least_gap_ms
    marked = placed.withColumn("new", F.when(F.coalesce(apart, F.lit(True)), 1).otherwise(0)).withColumn("stretch", F.sum("new").over(time.rowsBetween(W.unboundedPreceding, 0)))

    def choose(rows: list[tuple]) -> list[tuple]:
        taken: list[int] = []
        kept: list[tuple] = []
        for r in sorted(rows, key=lambda r: (-r[4], r[1])):
            k = bisect.bisect_left(taken, r[5])
            if all(abs(r[5] - other) >= least_gap_ms for other in taken[max(0, k - 1) : k + 1]):
                taken.insert(k, r[5])
                kept.append(r[:5])
        return kept

    numbered = marked.select("media_id", "i", "t_ms", "end_ms", F.col("probability").cast("double"), "kept_ms", "stretch")
    free = in_groups(numbered, ["media_id", "stretch"], ["kept_ms", "i"], choose, "media_id long, i long, t_ms long, end_ms long, probability double")
    quota = ranges.groupBy("media_id").agg(F.bround(F.sum(F.col("end_ms") - F.col("start_ms")) * F.lit(per_minute) / 60_000).alias("quota"))
    best = W.partitionBy("media_id").orderBy(F.desc("probability"), "i")
    return free.join(quota, "media_id").withColumn("place", F.row_number().over(best)).filter("place <= quota").select("media_id", "i", F.col("t_ms").alias("start_ms"), "end_ms")
