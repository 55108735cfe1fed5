"""Segmentation of speech: phrases, blocks, cards, sentences, and features of the gaps between words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronoloom.functions.text import OPENER_WORDS, WEAK_TRAILING_WORDS, ends_sentence, normalize_token

PHRASE_PAUSE_MS, BLOCK_GAP_MS, MAX_GROUP_MS, RATE_WORDS = 350, 3000, 7000, 5


def ordered_text(order: str, word: str, sep: str = " ") -> Column:
    """A group's words joined in order."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(word).alias("w")))), lambda x: x["w"]), sep)


def phrase_numbers(words: DataFrame, pause: int = PHRASE_PAUSE_MS) -> DataFrame:
    """Adds `phrase`, from 0: one ends at a sentence's end, or before a gap of more than `pause`."""
    order = W.partitionBy("media_id").orderBy("i")
    new = ends_sentence(F.lag("word").over(order)) | (F.col("start_ms") - F.lag("end_ms").over(order) > pause)
    return words.withColumn("__new", F.coalesce(new.cast("int"), F.lit(0))).withColumn(
        "phrase", F.sum("__new").over(order.rowsBetween(W.unboundedPreceding, 0))
    ).drop("__new")


def phrases(words: DataFrame, pause: int = PHRASE_PAUSE_MS) -> DataFrame:
    return phrase_numbers(words, pause).groupBy("media_id", "phrase").agg(
        F.min("i").alias("first"), F.max("i").alias("last"), F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), ordered_text("i", "word").alias("text")
    )


def blocks(cards: DataFrame, gap: int = BLOCK_GAP_MS) -> DataFrame:
    """Runs of cards (media_id, i, start_ms, end_ms) at most `gap` apart: first and last card and span."""
    order = W.partitionBy("media_id").orderBy("i")
    new = F.coalesce((F.col("start_ms") - F.lag("end_ms").over(order) > gap).cast("int"), F.lit(0))
    marked = cards.withColumn("__new", new).withColumn("block", F.sum("__new").over(order.rowsBetween(W.unboundedPreceding, 0)))
    return marked.groupBy("media_id", "block").agg(
        F.min("i").alias("first"), F.max("i").alias("last"), F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.count("*").alias("cards")
    )


def gap_features(words: DataFrame) -> DataFrame:
    """For each word but the last of a recording, what is known of the gap after it."""
    order = W.partitionBy("media_id").orderBy("i")
    recent = order.rowsBetween(1 - RATE_WORDS, 0)
    span = F.col("end_ms") - F.min("start_ms").over(recent)
    weak = normalize_token(F.col("word")).isin(WEAK_TRAILING_WORDS)
    return (
        words.withColumn("pause_ms", F.lead("start_ms").over(order) - F.col("end_ms"))
        .withColumn("weak", weak.cast("int"))
        .withColumn("mark", F.when(ends_sentence(F.col("word")), 2).when(F.col("word").rlike("[,;:]$"), 1).otherwise(0))
        .withColumn("opens_next", normalize_token(F.lead("word").over(order)).isin(OPENER_WORDS).cast("int"))
        .withColumn("segment_ends", F.col("segment_end").cast("int"))
        .withColumn("words_per_minute", F.when(span > 0, F.floor(F.count("*").over(recent) * 60000 / span)).otherwise(0).cast("bigint"))
        .filter("pause_ms IS NOT NULL")
        .select("media_id", "i", "pause_ms", "weak", "mark", "opens_next", "segment_ends", "words_per_minute")
    )


def grouped_in_order(df: DataFrame, key: str, row: list[str], step, name: str = "group") -> DataFrame:
    """Numbers the rows of each key by a fold: `step(first, previous, row)` says whether a row begins a group.

    `row`: the columns of a row, its order first. The fold runs over one sorted array a key.
    """
    kind = F.struct(*row)
    rows = df.groupBy(key).agg(F.array_sort(F.collect_list(kind)).alias("rows"))
    numbered = F.transform("rows", lambda r: F.struct(F.lit(0).alias("n"), r.alias("r"), r.alias("first")))
    one = F.get(numbered, 0)

    def add(done: Column, r: Column) -> Column:
        last = F.get(done, F.size(done) - 1)
        new = step(last["first"], last["r"], r)
        return F.concat(done, F.array(F.when(new, F.struct((last["n"] + 1).alias("n"), r.alias("r"), r.alias("first"))).otherwise(F.struct(last["n"].alias("n"), r.alias("r"), last["first"].alias("first")))))

    folded = rows.select(key, F.aggregate(F.slice("rows", 2, F.greatest(F.size("rows") - 1, F.lit(0))), F.array(one), add).alias("rows"))
    return folded.select(key, F.explode("rows").alias("x")).select(key, F.col("x.n").alias(name), "x.r.*")


def sentence_groups(cards: DataFrame, most: int = MAX_GROUP_MS) -> DataFrame:
    """Cards (media_id, i, segment_id, start_ms, end_ms, text) to groups of one segment that last `most` at most."""
    step = lambda first, prev, r: (r["segment_id"] != prev["segment_id"]) | (r["end_ms"] - first["start_ms"] > most)
    numbered = grouped_in_order(cards, "media_id", ["i", "segment_id", "start_ms", "end_ms", "text"], step)
    return numbered.groupBy("media_id", "group").agg(
        F.min("i").alias("first"), F.max("i").alias("last"), F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), ordered_text("i", "text").alias("text")
    )
