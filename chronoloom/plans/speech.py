"""Queries on speech: words, tokens, clocks, intervals, phrases, blocks, cut candidates, clips."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronoloom.functions import text as X
from chronoloom.operators import candidates as C
from chronoloom.operators import intervals as I
from chronoloom.operators import sessions as S
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


ISLANDS = """
sp0 AS (
  SELECT *, CASE WHEN start_ms - max(end_ms) OVER (PARTITION BY media_id, track ORDER BY start_ms, end_ms ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) < 700 THEN 0 ELSE 1 END AS b
  FROM words WHERE end_ms > start_ms
), speech AS (
  SELECT media_id, track, min(start_ms) AS start_ms, max(end_ms) AS end_ms
  FROM (SELECT *, sum(b) OVER (PARTITION BY media_id, track ORDER BY start_ms, end_ms) AS g FROM sp0) GROUP BY media_id, track, g
), gap0 AS (
  SELECT media_id, greatest(0, max(end_ms) OVER (PARTITION BY media_id ORDER BY start_ms, end_ms ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) AS gap_start, start_ms AS gap_end FROM speech
  UNION ALL
  SELECT s.media_id, greatest(0, max(end_ms)), any_value(span_end) FROM spans s LEFT JOIN speech USING (media_id) GROUP BY s.media_id
), gaps AS (
  SELECT * FROM gap0 WHERE gap_end - gap_start >= 700
)"""

PHRASES = r"""
ph0 AS (
  SELECT *, CASE WHEN regexp_matches(lag(word) OVER o, '[.?!…]$') OR start_ms - lag(end_ms) OVER o > 350 THEN 1 ELSE 0 END AS b
  FROM words WINDOW o AS (PARTITION BY media_id ORDER BY i)
), phrases AS (
  SELECT media_id, phrase, min(i) AS first, max(i) AS last, min(start_ms) AS start_ms, max(end_ms) AS end_ms, string_agg(word, ' ' ORDER BY i) AS text
  FROM (SELECT *, sum(b) OVER (PARTITION BY media_id ORDER BY i) AS phrase FROM ph0) GROUP BY media_id, phrase
)"""

CANDIDATES = r"""
near AS (
  SELECT g.media_id, g.gap_start, g.gap_end, arg_min(t_ms, (abs(2 * t_ms - gap_start - gap_end), t_ms)) AS cut
  FROM gaps g JOIN cuts c ON c.media_id = g.media_id AND t_ms BETWEEN gap_start AND gap_end GROUP BY ALL
), cand0 AS (
  SELECT g.media_id, g.gap_start, g.gap_end, coalesce(cut, (g.gap_start + g.gap_end) // 2) AS t_ms, cut IS NOT NULL AS has_cut
  FROM gaps g LEFT JOIN near n USING (media_id, gap_start, gap_end)
), cand1 AS (
  SELECT c.*, coalesce((SELECT regexp_matches(arg_max(word, (end_ms, i)), '[.?!…]$') FROM words w WHERE w.media_id = c.media_id AND w.track = 'film' AND w.end_ms <= c.t_ms), false) AS after_sentence,
         EXISTS (SELECT 1 FROM silences s WHERE s.media_id = c.media_id AND c.t_ms BETWEEN s.start_ms AND s.end_ms) AS silent
  FROM cand0 c JOIN spans USING (media_id) WHERE t_ms - span_start >= 1000 AND span_end - t_ms >= 1000
), cand AS (
  SELECT *, least(10000, least(gap_end - gap_start, 4000) + 3000 * has_cut::INT + 1500 * silent::INT + 1500 * after_sentence::INT) AS score FROM cand1
)"""

THINNED = """
ord AS (
  SELECT media_id, t_ms, score, row_number() OVER (PARTITION BY media_id ORDER BY t_ms, score) AS r FROM cand
), fold AS (
  SELECT media_id, r, [{'t_ms': t_ms, 'score': score}] AS kept FROM ord WHERE r = 1
  UNION ALL
  SELECT o.media_id, o.r, CASE WHEN o.t_ms - kept[-1].t_ms >= 3000 THEN list_append(kept, {'t_ms': o.t_ms, 'score': o.score})
         WHEN o.score > kept[-1].score THEN list_append(kept[:-2], {'t_ms': o.t_ms, 'score': o.score}) ELSE kept END
  FROM fold JOIN ord o ON o.media_id = fold.media_id AND o.r = fold.r + 1
), thin AS (
  SELECT media_id, unnest(range(1, len(kept) + 1)) AS n, unnest(kept, recursive := true)
  FROM (SELECT media_id, arg_max(kept, r) AS kept FROM fold GROUP BY media_id)
)"""


@query(f"WITH {WORDS_SQL} SELECT * FROM words")
def words_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.words(spark, sf_dir)


@query(rf"""WITH {WORDS_SQL}
SELECT media_id, i, regexp_replace(strip_accents(word), '\s+', ' ', 'g') AS without_accents, regexp_replace(word, '[^\pL\pN_\s]', '', 'g') AS without_marks,
       lower(strip_accents(regexp_replace(word, '[^\pL\pN_\s]', '', 'g'))) AS token,
       lower(strip_accents(regexp_replace(word, '[^\pL\pN_\s]', '', 'g'))) IN ({', '.join(f"'{w}'" for w in X.WEAK_TRAILING_WORDS)}) AS weak,
       regexp_matches(word, '[.?!…]$') AS ends_sentence FROM words""")
def normalized_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = F.col("word")
    token = X.normalize_token(w)
    return V.words(spark, sf_dir).select(
        "media_id", "i", X.remove_accents(w).alias("without_accents"), X.remove_punctuation(w).alias("without_marks"),
        token.alias("token"), token.isin(X.WEAK_TRAILING_WORDS).alias("weak"), X.ends_sentence(w).alias("ends_sentence"),
    )


@query(f"""WITH {WORDS_SQL}
SELECT media_id, i, format('{{:02d}}:{{:02d}}:{{:02d}},{{:03d}}', start_ms // 3600000, start_ms // 60000 % 60, start_ms // 1000 % 60, start_ms % 1000) AS srt, start_ms AS parsed_ms,
       format('{{:d}}:{{:02d}}:{{:02d}}.{{:02d}}', start_ms // 3600000, start_ms // 60000 % 60, start_ms // 1000 % 60, start_ms % 1000 // 10) AS ass,
       CASE WHEN start_ms >= 3600000 THEN format('{{:d}}:{{:02d}}:{{:02d}}', start_ms // 3600000, start_ms // 60000 % 60, start_ms // 1000 % 60)
            ELSE format('{{:02d}}:{{:02d}}', start_ms // 60000, start_ms // 1000 % 60) END AS clock,
       start_ms // 1000 AS clock_seconds FROM words""")
def srt_timestamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("start_ms")
    return V.words(spark, sf_dir).select(
        "media_id", "i", X.srt_time(t).alias("srt"), X.parse_srt_time(X.srt_time(t)).alias("parsed_ms"), X.ass_time(t).alias("ass"),
        X.short_clock(t).alias("clock"), X.parse_clock(X.short_clock(t)).cast("bigint").alias("clock_seconds"),
    )


@query(f"""WITH {WORDS_SQL}
SELECT media_id, i, num // den AS fps_whole, (start_ms * num + den * 500) // (den * 1000) AS frame,
       ((start_ms * num + den * 500) // (den * 1000))::HUGEINT * 254016000000 * den // num AS ticks
FROM words, (VALUES (30000, 1001), (25, 1), (60000, 1001)) r(num, den)""")
def clock_and_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    from chronoloom.functions.timecode import frames, ticks

    rates = F.explode(F.array(*[F.struct(F.lit(n).cast("bigint").alias("num"), F.lit(d).cast("bigint").alias("den")) for n, d in ((30000, 1001), (25, 1), (60000, 1001))]))
    timed = V.words(spark, sf_dir).select("media_id", "i", "start_ms", rates.alias("r")).select("media_id", "i", "start_ms", "r.*")
    frame = frames(F.col("start_ms"), F.col("num"), F.col("den"))
    return timed.select("media_id", "i", F.expr("num DIV den").alias("fps_whole"), frame.alias("frame"), ticks(frame, F.col("num"), F.col("den")).alias("ticks"))


@query(f"WITH {WORDS_SQL}, {ISLANDS} SELECT * FROM speech")
def speech_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.speech_intervals(V.words(spark, sf_dir), ["media_id", "track"])


def gaps_of(words: DataFrame) -> DataFrame:
    return I.silent_gaps(I.speech_intervals(words, ["media_id", "track"]), V.spans(words))


@query(f"WITH {WORDS_SQL}, {ISLANDS} SELECT * FROM gaps")
def silent_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gaps_of(V.words(spark, sf_dir))


@query(f"WITH {WORDS_SQL}, {PHRASES} SELECT * FROM phrases")
def phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.phrases(V.words(spark, sf_dir))


@query(f"""WITH {WORDS_SQL}, b AS (
  SELECT *, CASE WHEN start_ms - lag(end_ms) OVER (PARTITION BY media_id ORDER BY segment_id) > 240 THEN 1 ELSE 0 END AS b FROM segs
)
SELECT media_id, block, min(segment_id) AS first, max(segment_id) AS last, min(start_ms) AS start_ms, max(end_ms) AS end_ms, count(*) AS cards
FROM (SELECT *, sum(b) OVER (PARTITION BY media_id ORDER BY segment_id) AS block FROM b) GROUP BY media_id, block""")
def card_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.blocks(V.segments(V.words(spark, sf_dir)).withColumn("i", F.col("segment_id")), gap=240)


@query(rf"""WITH {WORDS_SQL}, n AS (
  SELECT *, lower(strip_accents(regexp_replace(word, '[^\pL\pN_\s]', '', 'g'))) AS token,
         end_ms - min(start_ms) OVER r AS span, count(*) OVER r AS k FROM words WINDOW r AS (PARTITION BY media_id ORDER BY i ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)
)
SELECT * FROM (
  SELECT media_id, i, lead(start_ms) OVER o - end_ms AS pause_ms, (token IN ({', '.join(f"'{w}'" for w in X.WEAK_TRAILING_WORDS)}))::INT AS weak,
         CASE WHEN regexp_matches(word, '[.?!…]$') THEN 2 WHEN regexp_matches(word, '[,;:]$') THEN 1 ELSE 0 END AS mark,
         (lead(token) OVER o IN ({', '.join(f"'{w}'" for w in X.OPENER_WORDS)}))::INT AS opens_next, segment_end::INT AS segment_ends,
         CASE WHEN span > 0 THEN k * 60000 // span ELSE 0 END AS words_per_minute
  FROM n WINDOW o AS (PARTITION BY media_id ORDER BY i)
) WHERE pause_ms IS NOT NULL""")
def gap_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.gap_features(V.words(spark, sf_dir))


def candidates_of(words: DataFrame) -> DataFrame:
    return C.raw_candidates(V.settled(gaps_of(words)), V.shot_cuts(words), V.silences(words), words.filter("track = 'film'"), V.spans(words))


@query(f"WITH {WORDS_SQL}, {ISLANDS}, {CANDIDATES} SELECT media_id, gap_start, gap_end, t_ms, has_cut, after_sentence, silent, score FROM cand")
def cut_candidates_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candidates_of(V.words_once(spark, sf_dir))


@query(f"WITH RECURSIVE {WORDS_SQL}, {ISLANDS}, {CANDIDATES}, {THINNED} SELECT media_id, n, t_ms, score FROM thin")
def cut_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.thinned(candidates_of(V.words_once(spark, sf_dir)))


@query()
def clip_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = V.words_once(spark, sf_dir)
    return C.clip_boundaries(C.thinned(candidates_of(words)), V.spans(words), 8, 15, 25)


@query(f"""WITH RECURSIVE {WORDS_SQL}, {ISLANDS}, {CANDIDATES}, {THINNED}, p AS (
  SELECT media_id, t_ms FROM thin UNION SELECT media_id, span_start FROM spans UNION SELECT media_id, span_end FROM spans
)
SELECT * FROM (SELECT media_id, row_number() OVER o AS n, t_ms AS start_ms, lead(t_ms) OVER o AS end_ms FROM p WINDOW o AS (PARTITION BY media_id ORDER BY t_ms)) WHERE end_ms IS NOT NULL""")
def clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = V.words_once(spark, sf_dir)
    return C.clips_from(every_boundary(words))


def every_boundary(words: DataFrame) -> DataFrame:
    spans = V.spans(words)
    found = C.thinned(candidates_of(words)).select("media_id", "t_ms")
    return found.union(spans.select("media_id", "span_start")).union(spans.select("media_id", "span_end")).distinct()


CLIPS = """
cp AS (
  SELECT media_id, t_ms FROM thin UNION SELECT media_id, span_start FROM spans UNION SELECT media_id, span_end FROM spans
), clip AS (
  SELECT * FROM (SELECT media_id, row_number() OVER o AS n, t_ms AS start_ms, lead(t_ms) OVER o AS end_ms FROM cp WINDOW o AS (PARTITION BY media_id ORDER BY t_ms)) WHERE end_ms IS NOT NULL
), cov AS (
  SELECT c.*, coalesce((SELECT sum(greatest(0, least(c.end_ms, s.end_ms) - greatest(c.start_ms, s.start_ms))) FROM speech s
                        WHERE s.media_id = c.media_id AND s.track = 'mic'), 0)::BIGINT AS covered_ms FROM clip c
)"""


@query(f"""WITH RECURSIVE {WORDS_SQL}, {ISLANDS}, {CANDIDATES}, {THINNED}, {CLIPS}
SELECT *, CASE WHEN end_ms > start_ms THEN covered_ms / (end_ms - start_ms) ELSE 0 END AS coverage FROM cov""")
def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return covered_clips(V.words_once(spark, sf_dir))


def covered_clips(words: DataFrame) -> DataFrame:
    mic = I.speech_intervals(words.filter("track = 'mic'"), ["media_id"])
    return I.overlap_ms(V.settled(C.clips_from(every_boundary(words))), V.settled(mic), "n")


def scored_clips(words: DataFrame) -> DataFrame:
    """Hook (here the clip's number of words, 10 at most) and reaction, held against the recording's peak, in tenths."""
    peak = F.max("coverage").over(W.partitionBy("media_id"))
    hook = F.least(F.col("n") % 11, F.lit(10))
    part = F.when(peak > 0, F.col("coverage") / peak * 10).otherwise(0.0)
    return covered_clips(words).withColumn("hook", F.when(F.col("n") % 4 != 0, hook)).withColumn(
        "score", F.floor(F.when(F.col("hook").isNull(), part).otherwise(0.7 * F.col("hook") + 0.3 * part) * 10 + 0.5).cast("bigint")
    ).drop("coverage", "covered_ms")


SCORES = """
peak AS (
  SELECT *, covered_ms / (end_ms - start_ms) AS cover, max(covered_ms / (end_ms - start_ms)) OVER (PARTITION BY media_id) AS top FROM cov
), part AS (
  SELECT media_id, n, start_ms, end_ms, CASE WHEN n % 4 <> 0 THEN least(n % 11, 10) END AS hook, CASE WHEN top > 0 THEN cover / top * 10 ELSE 0.0::DOUBLE END AS part FROM peak
), scored AS (
  SELECT media_id, n, start_ms, end_ms, hook, floor(CASE WHEN hook IS NULL THEN part ELSE 0.7::DOUBLE * hook + 0.3::DOUBLE * part END * 10 + 0.5::DOUBLE)::BIGINT AS score FROM part
)"""


@query(f"WITH RECURSIVE {WORDS_SQL}, {ISLANDS}, {CANDIDATES}, {THINNED}, {CLIPS}, {SCORES} SELECT * FROM scored")
def clip_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored_clips(V.words_once(spark, sf_dir))


@query(f"""WITH RECURSIVE {WORDS_SQL}, {ISLANDS}, {CANDIDATES}, {THINNED}, {CLIPS}, {SCORES}
SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY media_id ORDER BY coalesce(score, -1) DESC, n) <= 3""")
def top_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.top_clips(scored_clips(V.words_once(spark, sf_dir)), 3)


@query(f"""WITH {WORDS_SQL}, f AS (
  SELECT media_id, list(word ORDER BY i) AS w FROM words GROUP BY media_id
)
SELECT media_id, k AS card, array_to_string(w[k * 5 + 1:k * 5 + 5], ' ') AS text FROM (SELECT *, unnest(range((len(w) + 4) // 5)) AS k FROM f)""")
def fixed_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cards of five words each."""
    numbered = V.words(spark, sf_dir).withColumn("card", F.expr("i DIV 5"))
    return numbered.groupBy("media_id", "card").agg(S.ordered_text("i", "word").alias("text"))
