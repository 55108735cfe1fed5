"""Queries on pauses, keep ranges, sentences, documents for players and editors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronoloom.functions import text as X
from chronoloom.operators import intervals as I
from chronoloom.operators import pauses as P
from chronoloom.operators import sessions as S
from chronoloom.plans.speech import PHRASES
from chronoloom.sources import views as V
from chronoloom.sources.views import EVENTS_SQL, WORDS_SQL

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


PAUSES = f"""
tp AS (
  SELECT media_id, end_ms AS start_ms, least(coalesce(lead(start_ms) OVER (PARTITION BY media_id ORDER BY start_ms, segment_id), span_end), span_end) AS end_ms, 'transcript' AS source
  FROM segs JOIN spans USING (media_id)
), allp AS (
  SELECT media_id, start_ms, end_ms, source FROM tp WHERE end_ms - start_ms >= 200 UNION ALL SELECT media_id, start_ms, end_ms, 'audio' FROM silences
), ip AS (
  SELECT *, CASE WHEN start_ms - max(end_ms) OVER (PARTITION BY media_id ORDER BY start_ms, end_ms ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) <= 120 THEN 0 ELSE 1 END AS b FROM allp
), gp AS (
  SELECT *, sum(b) OVER (PARTITION BY media_id ORDER BY start_ms, end_ms) AS g FROM ip
), pause AS (
  SELECT media_id, min(start_ms) AS start_ms, max(end_ms) AS end_ms, string_agg(DISTINCT source, '+' ORDER BY source) AS source, max(end_ms) - min(start_ms) AS duration_ms
  FROM gp GROUP BY media_id, g HAVING max(end_ms) - min(start_ms) >= 100
)"""

CONTEXT = rf"""
ctx AS (
  SELECT p.*, coalesce((SELECT arg_max(text, (s.end_ms, -s.segment_id)) FROM segs s WHERE s.media_id = p.media_id AND s.end_ms <= p.start_ms + 200), '') AS text_before,
         coalesce((SELECT arg_min(text, (s.start_ms, s.segment_id)) FROM segs s WHERE s.media_id = p.media_id AND s.start_ms >= p.end_ms - 200), '') AS text_after FROM pause p
), typed AS (
  SELECT *, CASE WHEN list_filter(string_split_regex(lower(regexp_replace(text_before, '[^\pL\pN_\s]', '', 'g')), '\s+'), lambda w: w <> '')[-1]
                      IN ({', '.join(f"'{w}'" for w in X.MID_IDEA_WORDS)}) THEN 'mid_idea_pause'
              WHEN duration_ms < 1200 THEN 'breathing_pause' WHEN duration_ms <= 2200 AND text_before <> '' AND text_after <> '' THEN 'dramatic_pause'
              WHEN duration_ms <= 2800 AND text_before <> '' AND text_after <> '' THEN 'between_ideas' ELSE 'dead_silence' END AS pause_type FROM ctx
), lim AS (
  SELECT * FROM (VALUES {', '.join(f"('{m}', '{t}', {k})" for m, by in P.KEPT_MS.items() for t, k in by.items())}) v(mode, pause_type, limit_ms)
), dec AS (
  SELECT typed.*, mode, CASE WHEN mode = 'aggressive' AND pause_type = 'dead_silence' AND duration_ms >= 4000 THEN 0 ELSE least(duration_ms, limit_ms) END AS keep_ms FROM typed JOIN lim USING (pause_type)
), decided AS (
  SELECT *, CASE WHEN mode = 'aggressive' AND pause_type = 'dead_silence' AND duration_ms >= 4000 THEN 'remove' WHEN duration_ms <= keep_ms + 50 THEN 'keep' ELSE 'compress' END AS action FROM dec
)"""

KEPT = """
cut0 AS (
  SELECT media_id, start_ms, end_ms, end_ms - start_ms AS p, least(end_ms - start_ms, greatest(keep_ms, least(end_ms - start_ms, 200))) AS k FROM decided WHERE mode = 'balanced' AND action <> 'keep' AND end_ms - start_ms > 100
), cut1 AS (
  SELECT *, least(k, greatest(80, k * 45 // 100)) AS before FROM cut0
), cut2 AS (
  SELECT media_id, start_ms + before AS cut_start, end_ms - least(p - before, greatest(120, k - before)) AS cut_end FROM cut1
), cut3 AS (
  SELECT * FROM cut2 WHERE cut_end - cut_start > 50
), kept AS (
  SELECT media_id, coalesce(max(cut_end) OVER (PARTITION BY media_id ORDER BY cut_start, cut_end ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start_ms, cut_start AS end_ms FROM cut3
  UNION ALL SELECT s.media_id, coalesce(max(cut_end), 0), any_value(span_end) FROM spans s LEFT JOIN cut3 USING (media_id) GROUP BY s.media_id
), keeps AS (
  SELECT * FROM kept WHERE end_ms - start_ms > 50
)"""


def pauses_of(words: DataFrame, segments: DataFrame | None = None) -> DataFrame:
    segs = V.segments(words) if segments is None else segments
    heard = V.silences(words).withColumn("source", F.lit("audio"))
    return I.merge_pauses(I.segment_pauses(segs, V.spans(words), 200).unionByName(heard))


def in_context(words: DataFrame) -> DataFrame:
    """Pauses with the texts around them; segments and pauses, which both sides of the joins use, are computed once."""
    segs = V.settled(V.segments(words))
    return P.with_context(V.settled(pauses_of(words, segs)), segs)


def decisions_of(words: DataFrame, mode: str) -> DataFrame:
    return P.decided(P.classified(in_context(words)), mode)


def keeps_of(words: DataFrame) -> DataFrame:
    return I.keep_ranges(V.settled(decisions_of(words, "balanced")), V.spans(words))


@query(f"WITH {WORDS_SQL}, {PAUSES} SELECT * FROM pause")
def pause_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pauses_of(V.words_once(spark, sf_dir))


@query(f"WITH {WORDS_SQL}, {PAUSES}, {CONTEXT} SELECT media_id, start_ms, end_ms, text_before, text_after FROM ctx")
def pause_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = V.words_once(spark, sf_dir)
    return in_context(words).select("media_id", "start_ms", "end_ms", "text_before", "text_after")


@query(f"WITH {WORDS_SQL}, {PAUSES}, {CONTEXT} SELECT media_id, start_ms, end_ms, mode, pause_type, keep_ms, action FROM decided")
def pause_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = V.words_once(spark, sf_dir)
    typed = P.classified(in_context(words))
    each = [P.decided(typed, m) for m in P.KEPT_MS]
    return each[0].union(each[1]).union(each[2]).select("media_id", "start_ms", "end_ms", "mode", "pause_type", "keep_ms", "action")


@query(f"WITH {WORDS_SQL}, {PAUSES}, {CONTEXT}, {KEPT} SELECT * FROM keeps")
def keep_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keeps_of(V.words_once(spark, sf_dir))


@query(f"""WITH {WORDS_SQL}, {PAUSES}, {CONTEXT}, {KEPT}
SELECT s.media_id, span_end AS before_ms, sum(end_ms - start_ms)::BIGINT AS after_ms, (span_end - sum(end_ms - start_ms))::BIGINT AS removed_ms, count(*) AS pieces,
       substr(sha1(s.media_id || '|balanced|' || sum(end_ms - start_ms)::BIGINT), 1, 16) AS export_id
FROM spans s JOIN keeps USING (media_id) GROUP BY s.media_id, span_end""")
def edited_duration(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = V.words_once(spark, sf_dir)
    length = F.sum(F.col("end_ms") - F.col("start_ms"))
    return (
        V.spans(words).join(keeps_of(words), "media_id").groupBy("media_id", F.col("span_end").alias("before_ms"))
        .agg(length.alias("after_ms"), F.count("*").alias("pieces"))
        .withColumn("removed_ms", F.col("before_ms") - F.col("after_ms"))
        .withColumn("export_id", X.short_hash(F.col("media_id").cast("string"), F.lit("balanced"), F.col("after_ms").cast("string"), size=16))
    )


@query(f"""WITH {WORDS_SQL}, {PAUSES}, {CONTEXT}, {KEPT}, k AS (
  SELECT *, coalesce(sum(end_ms - start_ms) OVER (PARTITION BY media_id ORDER BY start_ms ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM keeps
)
SELECT w.media_id, w.i, w.start_ms AS t_ms, coalesce(k.before + least(w.start_ms, k.end_ms) - k.start_ms, 0)::BIGINT AS kept_ms
FROM words w ASOF LEFT JOIN k ON w.media_id = k.media_id AND w.start_ms >= k.start_ms""")
def kept_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = V.words_once(spark, sf_dir)
    return I.kept_positions(words.select("media_id", "i", F.col("start_ms").alias("t_ms")), keeps_of(words))


@query(f"""WITH RECURSIVE {WORDS_SQL}, {PHRASES}, ord AS (
  SELECT p.media_id, phrase, text, p.start_ms, p.end_ms, w.segment_id FROM phrases p JOIN words w ON w.media_id = p.media_id AND w.i = p.first
), f AS (
  SELECT media_id, phrase, start_ms AS first_ms, segment_id, 0 AS g FROM ord WHERE phrase = 0
  UNION ALL
  SELECT o.media_id, o.phrase, CASE WHEN o.segment_id <> f.segment_id OR o.end_ms - first_ms > 7000 THEN o.start_ms ELSE first_ms END, o.segment_id,
         CASE WHEN o.segment_id <> f.segment_id OR o.end_ms - first_ms > 7000 THEN g + 1 ELSE g END
  FROM f JOIN ord o ON o.media_id = f.media_id AND o.phrase = f.phrase + 1
)
SELECT media_id, g AS "group", min(phrase) AS first, max(phrase) AS last, min(start_ms) AS start_ms, max(end_ms) AS end_ms, string_agg(text, ' ' ORDER BY phrase) AS text
FROM f JOIN ord USING (media_id, phrase) GROUP BY media_id, g""")
def sentence_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.sentence_groups(phrase_cards(V.words(spark, sf_dir)))


def phrase_cards(words: DataFrame) -> DataFrame:
    """Phrases as cards, with the segment of their first word."""
    first = words.select("media_id", F.col("i").alias("first"), "segment_id")
    return S.phrases(words).join(first, ["media_id", "first"]).select("media_id", F.col("phrase").alias("i"), "segment_id", "start_ms", "end_ms", "text")


@query(f"""WITH RECURSIVE {WORDS_SQL}, t AS (
  SELECT media_id, segment_id, list_filter(string_split_regex(text, '[ \\t\\n\\r\\f\\x0B]+'), lambda w: w <> '') AS ws FROM segs
), f AS (
  SELECT media_id, segment_id, 0 AS k, []::VARCHAR[] AS done, '' AS line FROM t
  UNION ALL
  SELECT f.media_id, f.segment_id, k + 1, CASE WHEN line = '' OR length(line) + 1 + length(ws[k + 1]) <= 42 THEN done ELSE list_append(done, line) END,
         CASE WHEN line = '' THEN ws[k + 1] WHEN length(line) + 1 + length(ws[k + 1]) <= 42 THEN line || ' ' || ws[k + 1] ELSE ws[k + 1] END
  FROM f JOIN t USING (media_id, segment_id) WHERE k < len(ws)
)
SELECT media_id, segment_id, array_to_string(CASE WHEN line = '' THEN done ELSE list_append(done, line) END, chr(10)) AS lines, len(done) + (line <> '')::INT AS n_lines
FROM f JOIN t USING (media_id, segment_id) WHERE k = len(ws)""")
def wrapped_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = V.segments(V.words(spark, sf_dir)).withColumn("ls", X.wrapped_lines(F.col("text")))
    return lines.select("media_id", "segment_id", F.array_join("ls", "\n").alias("lines"), F.size("ls").alias("n_lines"))


SRT_LINE = "format('{{:02d}}:{{:02d}}:{{:02d}},{{:03d}}', {0} // 3600000, {0} // 60000 % 60, {0} // 1000 % 60, {0} % 1000)"
ASS_LINE = "format('{{:d}}:{{:02d}}:{{:02d}}.{{:02d}}', {0} // 3600000, {0} // 60000 % 60, {0} // 1000 % 60, {0} % 1000 // 10)"


@query(f"""WITH {WORDS_SQL}, {PHRASES}
SELECT media_id, string_agg((phrase + 1)::BIGINT || chr(10) || {SRT_LINE.format('start_ms')} || ' --> ' || {SRT_LINE.format('end_ms')} || chr(10) || text || chr(10) || chr(10), '' ORDER BY phrase) AS document
FROM phrases GROUP BY media_id""")
def srt_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    from chronoloom.sources.captions import srt_documents

    return srt_documents(S.phrases(V.words(spark, sf_dir)).withColumn("n", F.col("phrase") + 1))


@query(f"""WITH {WORDS_SQL}, {PHRASES}
SELECT media_id, string_agg('Dialogue: 0,' || {ASS_LINE.format('start_ms')} || ',' || {ASS_LINE.format('end_ms')} || ',Default,,0,0,0,,' ||
       replace(replace(text, '{{', '\\{{'), '}}', '\\}}'), chr(10) ORDER BY phrase) AS dialogue, count(*) AS lines
FROM phrases GROUP BY media_id""")
def ass_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    from chronoloom.sources.captions import ass_dialogues

    return ass_dialogues(S.phrases(V.words(spark, sf_dir)).withColumn("n", F.col("phrase") + 1))


@query(f"""WITH {EVENTS_SQL}, iv AS (
  SELECT media_id, t_ms AS start_ms, t_ms + floor(value * 1000)::BIGINT AS end_ms FROM points WHERE kind = 'view'
), b AS (
  SELECT *, CASE WHEN start_ms - max(end_ms) OVER (PARTITION BY media_id ORDER BY start_ms, end_ms ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) <= 1800000 THEN 0 ELSE 1 END AS b FROM iv
)
SELECT media_id, min(start_ms) AS start_ms, max(end_ms) AS end_ms FROM (SELECT *, sum(b) OVER (PARTITION BY media_id ORDER BY start_ms, end_ms) AS g FROM b) GROUP BY media_id, g""")
def merged_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    views = V.event_intervals(V.event_points(spark, sf_dir), "view")
    return I.merge_ranges(views, ["media_id"], 1_800_000)


@query(f"""WITH {WORDS_SQL}, {PHRASES}, k AS (SELECT *, phrase % 5 <> 2 AND phrase % 7 <> 3 AS keep FROM phrases), r AS (
  SELECT *, coalesce(lag(keep) OVER (PARTITION BY media_id ORDER BY phrase), true) AS before FROM k
)
SELECT media_id, row_number() OVER (PARTITION BY media_id ORDER BY phrase) AS n, start_ms AS t_ms, left(text, 40) AS name FROM r WHERE NOT keep AND before""")
def marker_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A marker at the first phrase of each run of removed ones."""
    order = W.partitionBy("media_id").orderBy("phrase")
    marked = S.phrases(V.words(spark, sf_dir)).withColumn("keep", (F.col("phrase") % 5 != 2) & (F.col("phrase") % 7 != 3))
    first = marked.withColumn("before", F.coalesce(F.lag("keep").over(order), F.lit(True))).filter("NOT keep AND before")
    return first.select("media_id", F.row_number().over(order).cast("bigint").alias("n"), F.col("start_ms").alias("t_ms"), F.substring("text", 1, 40).alias("name"))


@query(f"""WITH {WORDS_SQL}, {PHRASES}
SELECT media_id, (row_number() OVER (PARTITION BY media_id ORDER BY phrase) - 1)::INTEGER AS pos, {SRT_LINE.format('start_ms')} AS start, {SRT_LINE.format('end_ms')} AS "end", text FROM phrases""")
def srt_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with line ends of three kinds, read back."""
    from chronoloom.sources.captions import srt_documents, srt_entries

    written = srt_documents(S.phrases(V.words(spark, sf_dir)).withColumn("n", F.col("phrase") + 1))
    ends = F.when(F.col("media_id") % 3 == 0, "\r\n").when(F.col("media_id") % 3 == 1, "\r").otherwise("\n")
    texts = written.select(F.col("media_id").cast("string").alias("path"), F.replace("document", F.lit("\n"), ends).alias("value"))
    return srt_entries(texts).select(F.col("path").cast("bigint").alias("media_id"), "pos", "start", "end", "text")
