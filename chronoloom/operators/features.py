"""Feature rows of phrases, pairs, pauses and zooms, and the examples that edits give."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronoloom.functions.text import MID_IDEA_WORDS, ends_sentence
from chronoloom.operators.intervals import overlap_ms

NEUTRAL, MAX_SINCE_ZOOM_MS, KEEP_PERCENT, MIN_PAUSE_MS = 5, 120_000, 50, 100


def _order():
    return W.partitionBy("media_id").orderBy("phrase")


def phrase_features(phrases: DataFrame) -> DataFrame:
    """(media_id, phrase, first, last, start_ms, end_ms, text, score) with length, rate, place, marks and neighbours.

    Rates are words a minute, places thousandths of the recording.
    """
    d = F.col("end_ms") - F.col("start_ms")
    whole = W.partitionBy("media_id")
    words = F.col("last") - F.col("first") + 1
    mean = F.avg("score").over(_order().rowsBetween(-1, 1))
    return phrases.select(
        "media_id", "phrase", d.alias("duration_ms"), F.when(d > 0, F.floor(words * 60000 / d)).otherwise(0).cast("bigint").alias("words_per_minute"),
        F.coalesce("score", F.lit(NEUTRAL)).cast("bigint").alias("score"), F.floor(F.coalesce(mean, F.lit(NEUTRAL)) * 100).cast("bigint").alias("score_around"),
        F.floor(F.col("start_ms") * 1000 / F.max("end_ms").over(whole)).cast("bigint").alias("place"),
        F.col("text").contains("!").cast("int").alias("exclaims"), F.col("text").contains("?").cast("int").alias("asks"),
        F.coalesce(F.col("start_ms") - F.lag("end_ms").over(_order()), F.lit(0)).alias("gap_before"),
        F.coalesce(F.lead("start_ms").over(_order()) - F.col("end_ms"), F.lit(0)).alias("gap_after"),
    )


def pause_features(phrases: DataFrame) -> DataFrame:
    """What stands around the pause after each phrase."""
    last = F.lower(F.regexp_replace(F.element_at(F.split("text", " "), -1), r"[^\p{L}\p{N}_]", ""))
    return phrases.select(
        "media_id", "phrase", (F.lead("start_ms").over(_order()) - F.col("end_ms")).alias("pause_ms"), ends_sentence(F.col("text")).cast("int").alias("sentence_ends"),
        last.isin(MID_IDEA_WORDS).cast("int").alias("connector_before"), F.coalesce(F.lead("score").over(_order()), F.lit(NEUTRAL)).cast("bigint").alias("score_after"),
    ).filter(F.col("pause_ms") >= MIN_PAUSE_MS)


def phrase_examples(phrases: DataFrame, kept: DataFrame) -> DataFrame:
    """Adds covered_ms and y: whether kept ranges cover at least half of the phrase."""
    covered = overlap_ms(phrases, kept, "phrase").drop("coverage")
    length = F.col("end_ms") - F.col("start_ms")
    return covered.withColumn("y", ((length > 0) & (F.col("covered_ms") * 100 >= length * KEEP_PERCENT)).cast("int"))


def zoom_examples(phrases: DataFrame, zooms: DataFrame) -> DataFrame:
    """(media_id, phrase, zoom_ms, y, since_zoom_ms): zoomed when zooms cover the lesser of 40 % and half a second; time since the last zoomed phrase's end, capped."""
    covered = overlap_ms(phrases, zooms, "phrase")
    length = F.col("end_ms") - F.col("start_ms")
    zoomed = (F.col("covered_ms") > 0) & (F.col("covered_ms") * 10 >= F.least(length * 4, F.lit(5000)))
    marked = covered.withColumn("y", zoomed.cast("int"))
    last = F.last(F.when(F.col("y") == 1, F.col("end_ms")), ignorenulls=True).over(_order().rowsBetween(W.unboundedPreceding, -1))
    since = F.least(F.coalesce(F.col("start_ms") - last, F.lit(MAX_SINCE_ZOOM_MS)), F.lit(MAX_SINCE_ZOOM_MS))
    return marked.select("media_id", "phrase", F.col("covered_ms").alias("zoom_ms"), "y", since.cast("bigint").alias("since_zoom_ms"))


def split_at_zooms(ranges: DataFrame, zooms: DataFrame, least: int = 10, bucket: int = 60_000) -> DataFrame:
    """Ranges (media_id, start_ms, end_ms) cut at the borders of zooms: pieces with `zoomed`; those of `least` or less go."""
    covered = lambda s, e: F.explode(F.expr(f"sequence({s} DIV {bucket}, greatest({s}, {e}) DIV {bucket})"))
    edges = zooms.select("media_id", F.explode(F.array("start_ms", "end_ms")).alias("t")).distinct().withColumn("__b", F.expr(f"t DIV {bucket}"))
    spread = ranges.select("media_id", "start_ms", "end_ms").withColumn("__b", covered("start_ms", "end_ms"))
    inner = spread.join(edges, ["media_id", "__b"]).filter("t > start_ms AND t < end_ms").select("media_id", "start_ms", "end_ms", "t")
    points = inner.union(ranges.select("media_id", "start_ms", "end_ms", F.col("start_ms").alias("t"))).union(ranges.select("media_id", "start_ms", "end_ms", F.col("end_ms").alias("t"))).distinct()
    order = W.partitionBy("media_id", "start_ms", "end_ms").orderBy("t")
    pieces = points.select("media_id", F.col("t").alias("from_ms"), F.lead("t").over(order).alias("to_ms")).filter(F.col("to_ms") - F.col("from_ms") > least)
    # a zoom that holds a piece covers the bucket in which the piece begins
    near = zooms.select("media_id", F.col("start_ms").alias("__s"), F.col("end_ms").alias("__e")).withColumn("__b", covered("__s", "__e"))
    hit = pieces.withColumn("__b", F.expr(f"from_ms DIV {bucket}")).join(near, ["media_id", "__b"], "left")
    inside = F.coalesce((F.col("from_ms") >= F.col("__s")) & (F.col("to_ms") <= F.col("__e")), F.lit(False))
    return hit.groupBy("media_id", "from_ms", "to_ms").agg(F.max(inside).alias("zoomed"))


def zoom_keyframes(zooms: DataFrame, entry_ms: int = 400, creep: float = 0.1, least_ms: int = 500) -> DataFrame:
    """(media_id, start_ms, end_ms, level) to three keyframes each: begin, end of the entry, last; none for a short zoom."""
    def at(t: Column, v: Column) -> Column:
        return F.struct(t.cast("bigint").alias("t_ms"), F.round(v, 4).alias("scale"))

    frames = F.array(at(F.col("start_ms"), F.lit(1.0)), at(F.col("start_ms") + entry_ms, F.col("level")), at(F.col("end_ms"), F.col("level") * (1 + creep)))
    return zooms.filter(F.col("end_ms") - F.col("start_ms") >= least_ms).select("media_id", F.explode(frames).alias("k")).select("media_id", "k.*")


def review_rows(groups: DataFrame) -> DataFrame:
    """(media_id, group, sentence_id, text, line) to one row a sentence with its parts in order; a recording with a part of no sentence has none."""
    whole = groups.groupBy("media_id").agg(F.count_if(F.col("sentence_id").isNull()).alias("__bad")).filter("__bad = 0").select("media_id")
    parts = F.array_sort(F.collect_list(F.struct("group", "text", "line")))
    return groups.join(whole, "media_id", "left_semi").groupBy("media_id", "sentence_id").agg(parts.alias("parts"))


def review_groups(reviews: DataFrame) -> DataFrame:
    """The inverse of `review_rows`."""
    return reviews.select("media_id", "sentence_id", F.explode("parts").alias("p")).select("media_id", "p.group", "sentence_id", "p.text", "p.line")
