"""Cut candidates: silent gaps joined with shot cuts, silences and sentence ends, scored and thinned; clips."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronoloom.functions.text import ends_sentence
from chronoloom.operators.groups import in_groups
from chronoloom.operators.joins import as_of, within

MERGE_MS, EDGE_MS = 3000, 1000


def raw_candidates(gaps: DataFrame, cuts: DataFrame, silences: DataFrame, film_words: DataFrame, spans: DataFrame, edge: int = EDGE_MS) -> DataFrame:
    """A candidate per silent gap: at the cut in it nearest to its middle, else at the middle.

    Scores are thousandths: the gap up to 4 s, 3 for a cut, 1.5 for silence there, 1.5 after a
    sentence; 10 at most.
    """
    middle = F.expr("(gap_start + gap_end) DIV 2")
    numbered = gaps.withColumn("mid", middle)
    spread = numbered.withColumn("b", F.explode(F.expr("sequence(gap_start DIV 60000, gap_end DIV 60000)")))
    inside = spread.join(cuts.withColumn("b", F.expr("t_ms DIV 60000")), ["media_id", "b"]).filter("t_ms BETWEEN gap_start AND gap_end")
    nearest = inside.groupBy("media_id", "gap_start", "gap_end").agg(F.min(F.struct(F.abs(2 * F.col("t_ms") - F.col("gap_start") - F.col("gap_end")).alias("d"), "t_ms")).alias("cut"))
    placed = (
        numbered.join(nearest, ["media_id", "gap_start", "gap_end"], "left")
        .withColumn("t_ms", F.coalesce("cut.t_ms", "mid"))
        .withColumn("has_cut", F.col("cut").isNotNull())
        .join(spans, "media_id")
        .filter((F.col("t_ms") - F.col("span_start") >= edge) & (F.col("span_end") - F.col("t_ms") >= edge))
        .select("media_id", "gap_start", "gap_end", "t_ms", "has_cut")
    )
    spoken = as_of(placed, film_words, "media_id", "t_ms", "end_ms", F.struct("i", "word"), "before")
    quiet = within(spoken.select("media_id", "gap_start", "gap_end", "t_ms", "has_cut", ends_sentence(F.col("before.word")).alias("after_sentence")), silences, "t_ms", "silent")
    return quiet.withColumn("after_sentence", F.coalesce("after_sentence", F.lit(False))).withColumn(
        "score", F.least(F.lit(10000), F.least(F.col("gap_end") - F.col("gap_start"), F.lit(4000)) + 3000 * F.col("has_cut").cast("int") + 1500 * F.col("silent").cast("int") + 1500 * F.col("after_sentence").cast("int")).cast("bigint")
    )


def thinned(candidates: DataFrame, apart: int = MERGE_MS) -> DataFrame:
    """Of candidates less than `apart` after the one kept, one with a larger score takes its place; others go.

    A fold in time order over one array a recording, as the kept time moves. Adds n, from 1.
    """
    rows = candidates.groupBy("media_id").agg(F.array_sort(F.collect_list(F.struct("t_ms", "score"))).alias("rows"))
    none = F.expr("CAST(array() AS array<struct<t_ms: bigint, score: bigint>>)")

    def add(kept: Column, r: Column) -> Column:
        last = F.get(kept, F.size(kept) - 1)
        return (
            F.when((F.size(kept) == 0) | (r["t_ms"] - last["t_ms"] >= apart), F.concat(kept, F.array(r)))
            .when(r["score"] > last["score"], F.concat(F.slice(kept, F.lit(1), F.size(kept) - 1), F.array(r)))
            .otherwise(kept)
        )

    folded = rows.select("media_id", F.posexplode(F.aggregate("rows", none, add)).alias("n", "r"))
    return folded.select("media_id", (F.col("n") + 1).cast("bigint").alias("n"), "r.t_ms", "r.score")


def clips_from(boundaries: DataFrame) -> DataFrame:
    """Consecutive boundaries (media_id, t_ms) as numbered clips."""
    order = W.partitionBy("media_id").orderBy("t_ms")
    return (
        boundaries.select("media_id", F.row_number().over(order).cast("bigint").alias("n"), F.col("t_ms").alias("start_ms"), F.lead("t_ms").over(order).alias("end_ms"))
        .filter("end_ms IS NOT NULL")
    )


def best_boundaries(t: list[float], score: list[float], least: float, target: float, most: float, weight: float = 4.0) -> list[int] | None:
    """Indexes of the chosen points: the path of most score, each step's length held against the target.

    t and score: points in time order, the first and last are ends. The last step may be shorter
    than `least`, if there is no other way. None if there is no way at all.
    """
    for last_least in dict.fromkeys((least, 0.0)):
        best, back = [float("-inf")] * len(t), [-1] * len(t)
        best[0] = 0.0
        low = 0
        for j in range(1, len(t)):
            while t[j] - t[low] > most + 1e-9:
                low += 1
            shortest = last_least if j == len(t) - 1 else least
            for i in range(low, j):
                step = t[j] - t[i]
                if step < shortest - 1e-9:
                    break
                got = best[i] + score[j] - weight * abs(step - target) / target
                if got > best[j]:
                    best[j], back[j] = got, i
        if best[-1] > float("-inf"):
            path = [len(t) - 1]
            while path[-1]:
                path.append(back[path[-1]])
            return path[::-1]
    return None


def grid_points(start: float, end: float, candidates: list[tuple[float, float]], step: float = 1.0, near: float = 0.5, penalty: float = -20.0) -> list[tuple[float, float]]:
    """Ends, candidates with their score over the median, and an emergency point each second away from them."""
    inside = sorted((t, s) for t, s in candidates if start < t < end)
    median = float(pd.Series([s for _, s in inside]).median()) if inside else 0.0
    times = [t for t, _ in inside]
    points = [(start, 0.0), (end, 0.0), *((t, s - median) for t, s in inside)]
    at, k = start + step, 0
    while at < end:
        while k < len(times) and times[k] < at - near:
            k += 1
        if not (k < len(times) and times[k] <= at + near):
            points.append((at, penalty))
        at += step
    return sorted(points)


def clip_boundaries(candidates: DataFrame, spans: DataFrame, least: float = 70, target: float = 150, most: float = 240) -> DataFrame:
    """(media_id, t_ms): the boundaries of each recording's clips; none where no way exists. Scores are thousandths."""

    def solve(rows: list[tuple]) -> list[tuple]:
        points = grid_points(rows[0][1] / 1000, rows[0][2] / 1000, [(t / 1000, score / 1000) for _, _, _, t, score in rows if t is not None])
        path = best_boundaries([t for t, _ in points], [x for _, x in points], least, target, most) or []
        return [(rows[0][0], round(points[i][0] * 1000)) for i in path]

    rows = spans.select("media_id", "span_start", "span_end").join(candidates.select("media_id", "t_ms", "score"), "media_id", "left")
    return in_groups(rows, ["media_id"], ["t_ms"], solve, "media_id long, t_ms long")


def top_clips(clips: DataFrame, n: int) -> DataFrame:
    """The n best of each recording (no score counts as -1, ties by number), in the recording's order."""
    best = W.partitionBy("media_id").orderBy(F.coalesce("score", F.lit(-1)).desc(), "n")
    return clips.withColumn("__r", F.row_number().over(best)).filter(F.col("__r") <= n).drop("__r")
