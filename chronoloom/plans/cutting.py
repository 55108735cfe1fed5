"""Queries on what stays of a recording: removals, ranges, markers, zooms. Their SQL decides phrase by phrase, in a loop."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoloom.operators import editplan as E
from chronoloom.operators import sessions as S
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


#: Length that recordings are cut to, and the rate, distance and lengths of zooms.
TARGET_MS = 40_000
ZOOMS = {"per_minute": 9.0, "least_gap_ms": 3000, "shortest_ms": 600, "longest_ms": 1300}


def scored(words: DataFrame) -> DataFrame:
    """Phrases with score and probability by rule, in the models' place; every fourth has a predicted pause."""
    n = F.col("phrase")
    return S.phrases(words).select(
        "media_id", n.alias("i"), "start_ms", "end_ms", (n * 37 % 100 / 100).alias("score"), F.col("text").rlike("[.?!…]$").alias("ends"),
        F.when(n % 4 == 1, (n * 71 % 600).cast("double")).alias("pause_ms"), (n * 53 % 90 / 100 + 0.1).alias("probability"),
    )


def plan_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    phrases = V.settled(scored(V.words(spark, sf_dir)))
    n = F.col("i")
    retakes = phrases.filter(n % 9 == 5).select("media_id", n.alias("first"), (n % 4 / 4 + 0.25).alias("probability"))
    return V.settled(E.decided(phrases, retakes, TARGET_MS))


#: Phrases as lists of a recording, then one removal a round for as long as the ranges, made anew each time, are too long.
PLAN = f"""
p AS (
  SELECT media_id, phrase::INTEGER AS i, start_ms, end_ms, (phrase * 37 % 100 / 100)::DOUBLE AS score, regexp_matches(text, '[.?!…]$') AS ends,
         phrase % 9 = 5 AND phrase % 4 / 4 + 0.25 >= 0.5 AS gone, CASE WHEN phrase % 4 = 1 THEN (phrase * 71 % 600)::BIGINT END AS predicted,
         (phrase * 53 % 90 / 100 + 0.1)::DOUBLE AS probability FROM phrases
), p2 AS (
  SELECT *, CASE WHEN predicted IS NULL THEN least(after, 300) ELSE greatest(0, least(after, predicted)) END AS pause
  FROM (SELECT *, lead(start_ms) OVER (PARTITION BY media_id ORDER BY i) - end_ms AS after FROM p)
), ls AS (
  SELECT media_id, list(start_ms ORDER BY i) AS starts, list(end_ms ORDER BY i) AS ends_, list(pause ORDER BY i) AS pauses, list(score ORDER BY i) AS scores, list(ends ORDER BY i) AS stops,
         list(NOT gone ORDER BY i) AS keep, list(i + 1 ORDER BY score, i) AS turns, count(*)::INTEGER AS size FROM p2 GROUP BY media_id
), step AS (
  SELECT media_id, 0 AS done, keep FROM ls
  UNION ALL
  SELECT media_id, done + 1, CASE WHEN keep[j] AND NOT coalesce(keep[j + 1] AND scores[j + 1] >= 0.8 AND starts[j + 1] - ends_[j] < 700 AND NOT stops[j], false)
                                THEN list_transform(keep, lambda k, x: k AND x <> j) ELSE keep END
  FROM (
    SELECT s.media_id, done, s.keep, starts, ends_, scores, stops, turns[done + 1] AS j, list_filter(range(1, size + 1), lambda x: s.keep[x]) AS ks,
           list_transform(ks, lambda x: CASE WHEN x > 1 AND s.keep[x - 1] THEN round_even((starts[x] * 100 - 55 * pauses[x - 1]) / 100, 0)::BIGINT ELSE greatest(0, starts[x] - least(120, starts[x] - CASE WHEN x > 1 THEN ends_[x - 1] ELSE 0 END)) END) AS lows,
           list_transform(ks, lambda x: CASE WHEN x < size AND s.keep[x + 1] THEN round_even((ends_[x] * 100 + 45 * pauses[x]) / 100, 0)::BIGINT ELSE ends_[x] + CASE WHEN x < size THEN least(120, starts[x + 1] - ends_[x]) ELSE 120 END END) AS highs,
           list_sum(list_transform(range(1, len(ks) + 1), lambda t: highs[t] - lows[t] + CASE WHEN t < len(ks) AND lows[t + 1] - highs[t] <= 1 THEN lows[t + 1] - highs[t] ELSE 0 END)) AS lasts
    FROM step s JOIN ls USING (media_id) WHERE done < size
  ) WHERE lasts > {TARGET_MS} * 1.05
), final AS (
  SELECT media_id, arg_max(keep, done) AS keep FROM step GROUP BY media_id
), d AS (
  SELECT p2.*, keep[i + 1] AS kept, CASE WHEN gone THEN 'retake' WHEN NOT keep[i + 1] THEN 'weak' END AS reason FROM p2 JOIN final USING (media_id)
), bd AS (
  SELECT media_id, i, kept, CASE WHEN lag(kept) OVER o THEN round_even((start_ms * 100 - 55 * lag(pause) OVER o) / 100, 0)::BIGINT ELSE greatest(0, start_ms - least(120, start_ms - coalesce(lag(end_ms) OVER o, 0))) END AS low,
         CASE WHEN lead(kept) OVER o THEN round_even((end_ms * 100 + 45 * pause) / 100, 0)::BIGINT ELSE end_ms + coalesce(least(120, after), 120) END AS high FROM d WINDOW o AS (PARTITION BY media_id ORDER BY i)
), mg AS (
  SELECT *, CASE WHEN low - max(high) OVER (PARTITION BY media_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) <= 1 THEN 0 ELSE 1 END AS new FROM bd WHERE kept
), rg AS (
  SELECT media_id, min(low) AS start_ms, max(high) AS end_ms FROM (SELECT *, sum(new) OVER (PARTITION BY media_id ORDER BY i) AS g FROM mg) GROUP BY media_id, g
), rb AS (
  SELECT *, coalesce(sum(end_ms - start_ms) OVER (PARTITION BY media_id ORDER BY start_ms ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM rg
)"""


@query(f"WITH RECURSIVE {WORDS_SQL}, {PHRASES}, {PLAN} SELECT media_id, i::BIGINT AS i, kept, reason FROM d")
def edit_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which phrases stay, and why the others go."""
    return plan_of(spark, sf_dir).select("media_id", "i", "kept", "reason")


@query(f"WITH RECURSIVE {WORDS_SQL}, {PHRASES}, {PLAN} SELECT media_id, start_ms, end_ms FROM rg")
def edit_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.planned_ranges(plan_of(spark, sf_dir))


@query(f"""WITH RECURSIVE {WORDS_SQL}, {PHRASES}, {PLAN}, m AS (
  SELECT media_id, start_ms, reason FROM (SELECT *, coalesce(lag(kept) OVER (PARTITION BY media_id ORDER BY i), true) AS bef FROM d) WHERE NOT kept AND bef
)
SELECT m.media_id, coalesce(max(before + least(m.start_ms, rb.end_ms) - rb.start_ms), 0)::BIGINT AS t_ms, reason FROM m LEFT JOIN rb ON rb.media_id = m.media_id AND rb.start_ms <= m.start_ms
GROUP BY m.media_id, m.start_ms, reason""")
def removal_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = plan_of(spark, sf_dir)
    return E.removal_markers(plan, E.planned_ranges(plan))


@query(f"""WITH RECURSIVE {WORDS_SQL}, {PHRASES}, {PLAN}, z0 AS (
  SELECT media_id, i, probability, end_ms, greatest(start_ms, end_ms - greatest({ZOOMS['shortest_ms']}, least({ZOOMS['longest_ms']}, end_ms - start_ms))) AS begin FROM d WHERE kept AND probability >= 0.2
), z1 AS (
  SELECT z0.media_id, z0.i, z0.end_ms, z0.begin, any_value(probability) AS probability, coalesce(max(before + least(begin, rb.end_ms) - rb.start_ms), 0)::BIGINT AS pos
  FROM z0 LEFT JOIN rb ON rb.media_id = z0.media_id AND rb.start_ms <= z0.begin GROUP BY ALL
), z2 AS (
  SELECT *, row_number() OVER (PARTITION BY media_id ORDER BY probability DESC, i) AS place FROM z1
), q AS (
  SELECT media_id, round_even(sum(end_ms - start_ms)::BIGINT * {ZOOMS['per_minute']} / 60000, 0) AS quota FROM rg GROUP BY media_id
), ch AS (
  SELECT media_id, 0::BIGINT AS place, []::BIGINT[] AS taken, []::BIGINT[] AS chosen FROM q
  UNION ALL
  SELECT c.media_id, z2.place, CASE WHEN ok THEN list_append(taken, pos) ELSE taken END, CASE WHEN ok THEN list_append(chosen, i::BIGINT) ELSE chosen END
  FROM ch c JOIN q USING (media_id) JOIN z2 ON z2.media_id = c.media_id AND z2.place = c.place + 1,
       LATERAL (SELECT len(list_filter(taken, lambda t: abs(pos - t) < {ZOOMS['least_gap_ms']})) = 0 AS ok) WHERE len(taken) < quota
)
SELECT z1.media_id, z1.i::BIGINT AS i, begin AS start_ms, end_ms FROM z1 JOIN (SELECT media_id, arg_max(chosen, place) AS chosen FROM ch GROUP BY media_id) f USING (media_id) WHERE list_contains(chosen, z1.i::BIGINT)""")
def zoom_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = plan_of(spark, sf_dir)
    return E.chosen_zooms(plan, E.planned_ranges(plan), **ZOOMS)
