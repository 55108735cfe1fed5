"""Queries on features, examples and texts for people."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoloom.functions import display as D
from chronoloom.functions import text as X
from chronoloom.operators import features as FE
from chronoloom.operators import sessions as S
from chronoloom.plans.editing import CONTEXT, KEPT, PAUSES, keeps_of
from chronoloom.plans.speech import PHRASES
from chronoloom.sources import views as V
from chronoloom.sources.views import WORDS_SQL

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


SCORED = "scored AS (SELECT *, CASE WHEN phrase % 6 <> 5 THEN phrase * 7 % 11 END AS score FROM phrases)"
ZOOMS = "zooms AS (SELECT media_id, start_ms + 100 AS start_ms, least(end_ms, start_ms + 1300) AS end_ms FROM phrases WHERE phrase % 4 = 1 AND end_ms - start_ms > 200)"


def scored(words: DataFrame) -> DataFrame:
    """Phrases with a score by rule, in the model's place; some have none."""
    return S.phrases(words).withColumn("score", F.when(F.col("phrase") % 6 != 5, F.col("phrase") * 7 % 11))


def zooms_of(words: DataFrame) -> DataFrame:
    some = S.phrases(words).filter("phrase % 4 = 1 AND end_ms - start_ms > 200")
    return some.select("media_id", (F.col("start_ms") + 100).alias("start_ms"), F.least("end_ms", F.col("start_ms") + 1300).alias("end_ms"))


@query(f"""WITH {WORDS_SQL}, {PHRASES}, {SCORED}
SELECT media_id, phrase, end_ms - start_ms AS duration_ms, CASE WHEN end_ms > start_ms THEN (last - first + 1) * 60000 // (end_ms - start_ms) ELSE 0 END AS words_per_minute,
       coalesce(score, 5)::BIGINT AS score, floor(coalesce(avg(score) OVER (o ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), 5) * 100)::BIGINT AS score_around,
       start_ms * 1000 // max(end_ms) OVER (PARTITION BY media_id) AS place, contains(text, '!')::INT AS exclaims, contains(text, '?')::INT AS asks,
       coalesce(start_ms - lag(end_ms) OVER o, 0) AS gap_before, coalesce(lead(start_ms) OVER o - end_ms, 0) AS gap_after
FROM scored WINDOW o AS (PARTITION BY media_id ORDER BY phrase)""")
def phrase_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return FE.phrase_features(scored(V.words_once(spark, sf_dir)))


@query(rf"""WITH {WORDS_SQL}, {PHRASES}, {SCORED}
SELECT * FROM (SELECT media_id, phrase, lead(start_ms) OVER o - end_ms AS pause_ms, regexp_matches(text, '[.?!…]$')::INT AS sentence_ends,
       (lower(regexp_replace(string_split(text, ' ')[-1], '[^\pL\pN_]', '', 'g')) IN ({', '.join(f"'{w}'" for w in X.MID_IDEA_WORDS)}))::INT AS connector_before,
       coalesce(lead(score) OVER o, 5)::BIGINT AS score_after FROM scored WINDOW o AS (PARTITION BY media_id ORDER BY phrase)) WHERE pause_ms >= 100""")
def pause_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return FE.pause_features(scored(V.words_once(spark, sf_dir)))


@query(f"""WITH {WORDS_SQL}, {PHRASES}, {PAUSES}, {CONTEXT}, {KEPT}, c AS (
  SELECT p.media_id, p.phrase, p.end_ms - p.start_ms AS d, sum(CASE WHEN k.start_ms IS NULL THEN 0 ELSE greatest(0, least(p.end_ms, k.end_ms) - greatest(p.start_ms, k.start_ms)) END)::BIGINT AS covered_ms
  FROM phrases p LEFT JOIN keeps k ON k.media_id = p.media_id AND k.start_ms < p.end_ms AND k.end_ms > p.start_ms GROUP BY ALL
)
SELECT media_id, phrase, covered_ms, (d > 0 AND covered_ms * 100 >= d * 50)::INT AS y FROM c""")
def phrase_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = V.words_once(spark, sf_dir)
    return FE.phrase_examples(S.phrases(words), keeps_of(words)).select("media_id", "phrase", "covered_ms", "y")


@query(f"""WITH {WORDS_SQL}, {PHRASES}, {ZOOMS}, c AS (
  SELECT p.media_id, p.phrase, p.start_ms, p.end_ms, sum(CASE WHEN z.start_ms IS NULL THEN 0 ELSE greatest(0, least(p.end_ms, z.end_ms) - greatest(p.start_ms, z.start_ms)) END)::BIGINT AS zoom_ms
  FROM phrases p LEFT JOIN zooms z ON z.media_id = p.media_id AND z.start_ms < p.end_ms AND z.end_ms > p.start_ms GROUP BY ALL
), y AS (
  SELECT *, (zoom_ms > 0 AND zoom_ms * 10 >= least((end_ms - start_ms) * 4, 5000))::INT AS y FROM c
)
SELECT media_id, phrase, zoom_ms, y, least(coalesce(start_ms - last_value(CASE WHEN y = 1 THEN end_ms END IGNORE NULLS)
       OVER (PARTITION BY media_id ORDER BY phrase ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 120000), 120000)::BIGINT AS since_zoom_ms FROM y""")
def zoom_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = V.words_once(spark, sf_dir)
    return FE.zoom_examples(S.phrases(words), zooms_of(words))


@query(f"""WITH {WORDS_SQL}, {PHRASES}, {PAUSES}, {CONTEXT}, {KEPT}, {ZOOMS}, e AS (
  SELECT media_id, start_ms AS t FROM zooms UNION SELECT media_id, end_ms FROM zooms
), p AS (
  SELECT k.media_id, k.start_ms, k.end_ms, t FROM keeps k JOIN e ON e.media_id = k.media_id AND t > k.start_ms AND t < k.end_ms
  UNION SELECT media_id, start_ms, end_ms, start_ms FROM keeps UNION SELECT media_id, start_ms, end_ms, end_ms FROM keeps
), s AS (
  SELECT media_id, t AS from_ms, lead(t) OVER (PARTITION BY media_id, start_ms, end_ms ORDER BY t) AS to_ms FROM p
)
SELECT DISTINCT media_id, from_ms, to_ms, EXISTS (SELECT 1 FROM zooms z WHERE z.media_id = s.media_id AND from_ms >= z.start_ms AND to_ms <= z.end_ms) AS zoomed FROM s WHERE to_ms - from_ms > 10""")
def zoomed_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = V.words_once(spark, sf_dir)
    return FE.split_at_zooms(keeps_of(words), zooms_of(words))


@query(f"""WITH {WORDS_SQL}, {PHRASES}, {ZOOMS}, z AS (SELECT *, 1.1 + media_id % 5 / 10 AS level FROM zooms WHERE end_ms - start_ms >= 500)
SELECT media_id, start_ms AS t_ms, 1.0::DOUBLE AS scale FROM z UNION ALL SELECT media_id, start_ms + 400, round(level, 4)::DOUBLE FROM z UNION ALL SELECT media_id, end_ms, round(level * 1.1, 4)::DOUBLE FROM z""")
def zoom_keyframes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return FE.zoom_keyframes(zooms_of(V.words_once(spark, sf_dir)).withColumn("level", 1.1 + F.col("media_id") % 5 / 10))


@query("""SELECT p_partkey, CASE WHEN d < 0 THEN '--' WHEN d < 60 THEN format('{:.1f}', floor(d * 10) / 10) || 's' WHEN floor(d + 0.5) < 3600 THEN (floor(d + 0.5)::BIGINT // 60) || 'm ' || (floor(d + 0.5)::BIGINT % 60) || 's'
            ELSE (floor(d + 0.5)::BIGINT // 3600) || 'h ' || (floor(d + 0.5)::BIGINT // 60 % 60) || 'm' END AS duration
FROM (SELECT *, (p_partkey * p_size / 8.0)::DOUBLE - 10 AS d FROM part)""")
def durations_shown(spark: SparkSession, sf_dir: str) -> DataFrame:
    seconds = (F.col("p_partkey") * F.col("p_size") / 8.0).cast("double") - 10
    return V.table(spark, sf_dir, "part").select("p_partkey", D.duration(seconds).alias("duration"))


@query("""SELECT p_partkey, (p_size || CASE WHEN p_size = 1 THEN ' file' ELSE ' files' END) AS files, (p_size * 2) || '%' AS share,
       trim(string_split(string_split(p_name || ' (' || p_brand || ')', ' (')[1], ':')[1]) AS reason FROM part""")
def counts_shown(spark: SparkSession, sf_dir: str) -> DataFrame:
    reason = D.reason_key(F.concat(F.col("p_name"), F.lit(" ("), F.col("p_brand"), F.lit(")")))
    return V.table(spark, sf_dir, "part").select("p_partkey", D.counted(F.col("p_size"), "file", "files").alias("files"), D.percent(F.col("p_size") / 50).alias("share"), reason.alias("reason"))


@query("""SELECT p_partkey, replace(p_name, ' ', '_') AS stem, substr(sha1(lower('/v/' || p_name || '.mp4')), 1, 12) AS video_id FROM part""")
def file_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat(F.lit("/v/"), F.col("p_name"), F.lit(".mp4"))
    return V.table(spark, sf_dir, "part").select("p_partkey", D.short_stem(path).alias("stem"), D.video_id(path).alias("video_id"))


@query("""SELECT p_partkey, p_name || '，' || p_type || '。' AS line, CASE WHEN p_retailprice < 1000 THEN 'low_confidence' END AS flag FROM part""")
def caption_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = D.full_width(F.concat(F.col("p_name"), F.lit(","), F.col("p_type"), F.lit(".")))
    return V.table(spark, sf_dir, "part").select("p_partkey", line.alias("line"), D.confidence_flag(F.col("p_retailprice"), 1000.0).alias("flag"))


@query("""SELECT p_partkey, greatest(10, p_size) AS least_s, greatest(10, p_size, 30) AS target_s, greatest(10, p_size, 30, 25) AS most_s FROM part""")
def ordered_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    low, target, most = D.ordered_durations(F.col("p_size"), F.lit(30), F.lit(25))
    return V.table(spark, sf_dir, "part").select("p_partkey", low.alias("least_s"), target.alias("target_s"), most.alias("most_s"))


@query("""SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'English' WHEN 1 THEN 'xx' WHEN 2 THEN 'Português' ELSE NULL END AS language, p_size % 3 = 0 AS is_clock,
       p_name || CASE WHEN p_size % 2 = 0 THEN '' ELSE '…' END AS line FROM part""")
def labels_shown(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = F.when(F.col("p_size") % 4 == 0, "EN").when(F.col("p_size") % 4 == 1, "xx").when(F.col("p_size") % 4 == 2, "pt")
    clock = F.when(F.col("p_size") % 3 == 0, "1:02:03.5").when(F.col("p_size") % 3 == 1, "1:75")
    text = F.concat(F.lit("  "), F.col("p_name"), F.when(F.col("p_size") % 2 == 0, "\nsecond line").otherwise(F.lit("…")))
    return V.table(spark, sf_dir, "part").select("p_partkey", D.language(code).alias("language"), D.is_clock(clock).alias("is_clock"), D.first_line(text).alias("line"))
