"""Timed words, cards, cuts and intervals, derived from the supplied tables by fixed integer rules.

Times are milliseconds in BIGINT. A conversation is a recording, its turns are segments, its roles
are tracks; a user's events are a recording too.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Where checkpoints go on a single machine when no setting names a shared folder.
LOCAL_DIR = "/tmp/checkpoints"
BLANKS = r"[ \t\n\r\f\x0B]+"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def timed_words(texts: DataFrame) -> DataFrame:
    """(media_id, segment_id, track, text) to one row per word with times that follow from the letters.

    A word lasts 120 ms and 40 ms a letter; after it come 900 ms at a sentence's end, 250 ms at
    a soft stop, else up to 240 ms.
    """
    tokens = texts.select(
        "media_id", "segment_id", "track", F.posexplode(F.filter(F.split("text", BLANKS), lambda x: x != "")).alias("pos", "word")
    ).withColumn("size", F.length("word"))
    gap = F.when(F.col("word").rlike("[.?!]$"), 900).when(F.col("word").rlike("[,;:]$"), 250).otherwise(F.col("size") * 37 % 5 * 60)
    timed = tokens.withColumn("dur", (120 + 40 * F.col("size")).cast("bigint")).withColumn("gap", gap.cast("bigint"))
    order = W.partitionBy("media_id").orderBy("segment_id", "pos")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    return timed.select(
        "media_id",
        "track",
        "segment_id",
        (F.row_number().over(order) - 1).cast("bigint").alias("i"),
        "word",
        F.coalesce(F.sum(F.col("dur") + F.col("gap")).over(before), F.lit(0)).cast("bigint").alias("start_ms"),
        "dur",
        (F.lead("segment_id").over(order).isNull() | (F.lead("segment_id").over(order) != F.col("segment_id"))).alias("segment_end"),
    ).select("media_id", "track", "segment_id", "i", "word", "start_ms", (F.col("start_ms") + F.col("dur")).alias("end_ms"), "segment_end")


def words(spark: SparkSession, folder: str) -> DataFrame:
    talk = table(spark, folder, "conversations")
    return timed_words(
        talk.select(
            F.col("conv_id").alias("media_id"),
            F.col("turn").alias("segment_id"),
            F.when(F.col("role") == "user", "mic").otherwise("film").alias("track"),
            "text",
        )
    )


def shared_folder(spark: SparkSession) -> str:
    """`spark.checkpoint.dir`, which all executors share; without that setting a local master uses its own folder."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return named or f"file://{LOCAL_DIR}"


def settled(df: DataFrame) -> DataFrame:
    """`df` computed once, as a checkpoint in the shared folder; it keeps its partitioning and order."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint()


def words_once(spark: SparkSession, folder: str) -> DataFrame:
    """`words` for queries that use them several times: one scan and one exchange on media_id in all."""
    return settled(words(spark, folder))


def segments(timed: DataFrame) -> DataFrame:
    """Recognised segments: their words' text, in order, and span."""
    return timed.groupBy("media_id", "segment_id").agg(
        F.min("track").alias("track"),
        F.min("start_ms").alias("start_ms"),
        F.max("end_ms").alias("end_ms"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "word"))), lambda x: x["word"]), " ").alias("text"),
        F.count("*").alias("n_words"),
    )


def spans(timed: DataFrame) -> DataFrame:
    """Recordings: from 0 to the last word's end and 1.5 s."""
    return timed.groupBy("media_id").agg(F.lit(0).cast("bigint").alias("span_start"), (F.max("end_ms") + 1500).alias("span_end"))


def shot_cuts(timed: DataFrame) -> DataFrame:
    """A picture cut after each segment, 0 to 899 ms behind its last word."""
    return timed.filter("segment_end").select("media_id", (F.col("end_ms") + F.col("segment_id") * 137 % 900).alias("t_ms"))


def silences(timed: DataFrame, least_ms: int = 400) -> DataFrame:
    """Stretches of at least `least_ms` between one word's end and the next one's start."""
    after = F.lead("start_ms").over(W.partitionBy("media_id").orderBy("i"))
    return (
        timed.select("media_id", F.col("end_ms").alias("start_ms"), after.alias("end_ms")).filter(F.col("end_ms") - F.col("start_ms") >= least_ms)
    )


def event_points(spark: SparkSession, folder: str) -> DataFrame:
    """Events as points of a recording per user: media_id, event_id, t_ms, kind, value."""
    t = F.expr("timestampdiff(MILLISECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)")
    return table(spark, folder, "events").select(
        F.col("user_id").alias("media_id"), "event_id", t.alias("t_ms"), F.col("event_type").alias("kind"), "value", "props"
    )


def event_intervals(points: DataFrame, kind: str) -> DataFrame:
    """Events of a kind as intervals as long as their value in seconds, in whole ms."""
    end = F.col("t_ms") + F.floor(F.col("value") * 1000).cast("bigint")
    return points.filter(F.col("kind") == kind).select("media_id", "event_id", F.col("t_ms").alias("start_ms"), end.alias("end_ms"))


#: The same views for DuckDB, as the beginning of a WITH clause.
WORDS_SQL = r"""
tok AS (
  SELECT media_id, segment_id, track, unnest(range(len(ws))) AS pos, unnest(ws) AS word
  FROM (SELECT conv_id AS media_id, turn AS segment_id, CASE WHEN role = 'user' THEN 'mic' ELSE 'film' END AS track,
               list_filter(string_split_regex(text, '[ \t\n\r\f\x0B]+'), lambda x: x <> '') AS ws FROM conversations)
), tim AS (
  SELECT *, 120 + 40 * length(word) AS dur,
         CASE WHEN regexp_matches(word, '[.?!]$') THEN 900 WHEN regexp_matches(word, '[,;:]$') THEN 250 ELSE length(word) * 37 % 5 * 60 END AS gap FROM tok
), words AS (
  SELECT media_id, track, segment_id, row_number() OVER o - 1 AS i, word,
         coalesce(sum(dur + gap) OVER (PARTITION BY media_id ORDER BY segment_id, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start_ms,
         dur + coalesce(sum(dur + gap) OVER (PARTITION BY media_id ORDER BY segment_id, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS end_ms,
         coalesce(lead(segment_id) OVER o <> segment_id, true) AS segment_end
  FROM tim WINDOW o AS (PARTITION BY media_id ORDER BY segment_id, pos)
), spans AS (
  SELECT media_id, 0::BIGINT AS span_start, max(end_ms) + 1500 AS span_end FROM words GROUP BY media_id
), cuts AS (
  SELECT media_id, end_ms + segment_id * 137 % 900 AS t_ms FROM words WHERE segment_end
), silences AS (
  SELECT media_id, start_ms, end_ms FROM (
    SELECT media_id, end_ms AS start_ms, lead(start_ms) OVER (PARTITION BY media_id ORDER BY i) AS end_ms FROM words) WHERE end_ms - start_ms >= 400
), segs AS (
  SELECT media_id, segment_id, min(track) AS track, min(start_ms) AS start_ms, max(end_ms) AS end_ms, string_agg(word, ' ' ORDER BY i) AS text, count(*) AS n_words
  FROM words GROUP BY media_id, segment_id
)"""

EVENTS_SQL = """
points AS (
  SELECT user_id AS media_id, event_id, epoch_us(ts) // 1000 AS t_ms, event_type AS kind, value, props FROM events
)"""
