"""Decisions on jobs, scores and analyses, as column expressions and small joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Share of the judge in a candidate's score, in hundredths (a fixed value).
JUDGE_SHARE = 60
#: Exit codes of native crashes and words of errors that point to the graphics device (fixed values).
CRASHES = (3221226505, 3221225477)
DEVICE_WORDS = ("cublas64_12.dll", "cudnn", "cuda", "ctranslate2", "device not found", "failed to load library")
#: What plain lines of a recogniser's log say (fixed values).
SAVED, LANGUAGE, SEGMENTS = r"(?i)salvo em:\s*(.+)$", r"(?i)idioma detectado:\s*([a-zA-Z-]+)", r"(?i)([0-9]+)\s+segmentos\s+processados"


def candidate_score(rule: Column, judge: Column) -> Column:
    """In thousandths, from thousandths of tenths: the rule alone, or 40 % of it and 60 % of the judge's score."""
    return F.coalesce(F.floor(((100 - JUDGE_SHARE) * rule + JUDGE_SHARE * judge) / 100 + 0.5).cast("bigint"), rule)


def transcript_lines(segments: DataFrame, candidates: DataFrame) -> DataFrame:
    """(media_id, n, line): what was said, by track, and candidates between it, in order of time; at equal times speech comes first.

    segments: media_id, segment_id, track, start_ms, text; candidates: media_id, id, t_ms.
    """
    from chronoloom.functions.text import short_clock

    at = lambda ms: F.concat(F.lit("["), short_clock(ms), F.lit("] "))
    said = segments.select(
        "media_id", F.col("start_ms").alias("t"), F.lit(0).alias("kind"), F.col("segment_id").alias("id"), F.concat(at(F.col("start_ms")), F.upper("track"), F.lit(": "), "text").alias("line")
    )
    marks = candidates.select("media_id", F.col("t_ms").alias("t"), F.lit(1).alias("kind"), "id", F.concat(at(F.col("t_ms")), F.lit("[C"), "id", F.lit("]")).alias("line"))
    order = W.partitionBy("media_id").orderBy("t", "kind", "id")
    return said.unionByName(marks).select("media_id", (F.row_number().over(order) - 1).cast("bigint").alias("n"), "line")


def device_failure(text: Column, code: Column) -> Column:
    """Whether an error looks like the graphics device's: a crash code, or one of its words."""
    low = F.lower(F.coalesce(text, F.lit("")))
    words = [low.contains(w) for w in DEVICE_WORDS]
    return F.coalesce(code.isin(*CRASHES), F.lit(False)) | F.array_contains(F.array(*words), True)


def retry_on_cpu(on_cpu: Column, retried: Column, text: Column, code: Column) -> Column:
    return ~on_cpu & ~retried & device_failure(text, code)


def log_facts(line: Column) -> list[Column]:
    """What a plain log line tells: output_path, language, segments, status; null where it says nothing."""
    found = lambda pattern: F.nullif(F.regexp_extract(line, pattern, 1), F.lit(""))
    low = F.lower(line)
    status = F.when(low.contains("transcrevendo"), "processing").when(low.contains("carregando modelo") | low.contains("modelo carregado"), "preparing")
    return [F.trim(found(SAVED)).alias("output_path"), found(LANGUAGE).alias("language"), F.nullif(found(SEGMENTS).cast("bigint"), F.lit(0)).alias("segments"), status.alias("status")]


def refresh_action(durations: list[Column], wanted: list[Column], with_titles: Column, untitled: Column) -> Column:
    """What a renewed analysis needs: new durations ask for new clips, missing titles for titles; else null."""
    changed = F.lit(False)
    for a, b in zip(durations, wanted, strict=True):
        changed = changed | ~a.eqNullSafe(b)
    return F.when(changed, "resegment").when(with_titles & untitled, "titles")


def tracks_problem(film: Column, mic: Column) -> Column:
    return F.when((film < 1) | (mic < 1), "tracks begin at 1").when(film == mic, F.concat(F.lit("film and mic are both track "), film.cast("string")))


def profile_status(videos: DataFrame, profiles: DataFrame, least: int) -> DataFrame:
    """(profile, videos, remaining, active): a profile is used if it has a model and `least` videos."""
    n = videos.groupBy("profile").agg(F.count("*").alias("videos"))
    joined = profiles.join(n, "profile", "left").withColumn("videos", F.coalesce("videos", F.lit(0).cast("bigint")))
    return joined.select("profile", "videos", F.greatest(F.lit(0).cast("bigint"), least - F.col("videos")).alias("remaining"), (F.col("trained") & (F.col("videos") >= least)).alias("active"))


def queue_order(jobs: DataFrame) -> DataFrame:
    """Of (queue, job, queued_at, cancelled, minutes) those that still wait, one at a time in a queue, first come first served: place 0 runs.

    starts_at: the minutes of those before it.
    """
    order = W.partitionBy("queue").orderBy("queued_at", "job")
    waiting = jobs.filter("NOT cancelled")
    before = F.coalesce(F.sum("minutes").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return waiting.select("queue", "job", (F.row_number().over(order) - 1).cast("bigint").alias("place"), before.cast("bigint").alias("starts_at"))


def timing_samples(cards: DataFrame) -> DataFrame:
    """How a user's cards (media_id, card, start_ms, end_ms, speech_start, speech_end, text) sit on the speech they show.

    lead_in_ms before it, hold_ms after it; speech_gap_ms (0 at least) and user_gap_ms to the next
    card, where both have speech; words and length of the card.
    """
    order = W.partitionBy("media_id").orderBy("card")
    gap = F.greatest(F.lead("speech_start").over(order) - F.col("speech_end"), F.lit(0))
    both = F.lead("speech_start").over(order).isNotNull() & F.col("speech_end").isNotNull()
    return cards.select(
        "media_id", "card", (F.col("speech_start") - F.col("start_ms")).alias("lead_in_ms"), (F.col("end_ms") - F.col("speech_end")).alias("hold_ms"),
        F.when(both, gap).alias("speech_gap_ms"), F.when(both, F.lead("start_ms").over(order) - F.col("end_ms")).alias("user_gap_ms"),
        F.size(F.filter(F.split("text", r"\s+"), lambda w: F.regexp_replace(w, r"[^\p{L}\p{N}_]", "") != "")).cast("bigint").alias("card_words"),
        F.greatest(F.col("end_ms") - F.col("start_ms"), F.lit(0)).alias("card_ms"),
    )
