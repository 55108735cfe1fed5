"""Pauses: what was said around them, their type, and what an edit keeps of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoloom.functions.text import MID_IDEA_WORDS, remove_punctuation
from chronoloom.operators.joins import as_of

REACH_MS = 200
#: Milliseconds of a pause kept at most, by mode and type (fixed values).
KEPT_MS = {
    "conservative": {"dead_silence": 300, "breathing_pause": 500, "dramatic_pause": 900, "mid_idea_pause": 600, "between_ideas": 500},
    "balanced": {"dead_silence": 250, "breathing_pause": 400, "dramatic_pause": 750, "mid_idea_pause": 500, "between_ideas": 350},
    "aggressive": {"dead_silence": 150, "breathing_pause": 300, "dramatic_pause": 600, "mid_idea_pause": 400, "between_ideas": 250},
}


def with_context(pauses: DataFrame, segments: DataFrame) -> DataFrame:
    """Adds the texts before (ending 0.2 s into the pause at most) and after (beginning 0.2 s before its end at least)."""
    near = pauses.withColumn("__a", F.col("start_ms") + REACH_MS).withColumn("__b", F.col("end_ms") - REACH_MS)
    told = as_of(near, segments, "media_id", "__a", "end_ms", F.struct((-F.col("segment_id")).alias("o"), "text"), "__before")
    told = as_of(told, segments, "media_id", "__b", "start_ms", F.struct("segment_id", "text"), "__after", forward=True)
    return told.withColumn("text_before", F.coalesce("__before.text", F.lit(""))).withColumn("text_after", F.coalesce("__after.text", F.lit(""))).drop("__a", "__b", "__before", "__after")


def classified(pauses: DataFrame) -> DataFrame:
    """Adds pause_type, by the words around and the length."""
    last = F.element_at(F.concat(F.array(F.lit("")), F.filter(F.split(F.lower(remove_punctuation(F.col("text_before"))), r"\s+"), lambda w: w != "")), -1)
    both = (F.trim("text_before") != "") & (F.trim("text_after") != "")
    d = F.col("end_ms") - F.col("start_ms")
    kind = (
        F.when(last.isin(MID_IDEA_WORDS), "mid_idea_pause")
        .when(d < 1200, "breathing_pause")
        .when((d <= 2200) & both, "dramatic_pause")
        .when((d <= 2800) & both, "between_ideas")
        .otherwise("dead_silence")
    )
    return pauses.withColumn("pause_type", kind)


def settings(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(m, t, k) for m, by in KEPT_MS.items() for t, k in by.items()], "mode string, pause_type string, limit_ms long")


def decided(pauses: DataFrame, mode: str) -> DataFrame:
    """Adds action and keep_ms for an edit mode. The settings are 5 rows a mode."""
    d = F.col("end_ms") - F.col("start_ms")
    limits = F.broadcast(settings(pauses.sparkSession).filter(F.col("mode") == mode))
    gone = (F.lit(mode) == "aggressive") & (F.col("pause_type") == "dead_silence") & (d >= 4000)
    return (
        pauses.join(limits, "pause_type")
        .withColumn("keep_ms", F.when(gone, 0).otherwise(F.least(d, "limit_ms")).cast("bigint"))
        .withColumn("action", F.when(gone, "remove").when(d <= F.col("keep_ms") + 50, "keep").otherwise("compress"))
        .drop("limit_ms")
    )
