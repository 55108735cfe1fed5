"""Queries on cards cut as a user cuts them: examples, learning, decisions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronoloom.functions import text as X
from chronoloom.operators import models, stats
from chronoloom.operators import sessions as S
from chronoloom.operators import style as T
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


#: Limits of a card.
LIMITS = {"min_words": 1, "max_words": 14, "max_card_ms": 8000}


def user_cards(words: DataFrame) -> DataFrame:
    """An alignment with cards of a user who ends them at marks, at pauses from 180 ms on behind words of five letters or more, and
    now and then for no reason. Every thirteenth word wasn't matched and every twenty-ninth was cut.
    """
    order = W.partitionBy("media_id").orderBy("i")
    ends = F.col("word").rlike(r"[.?!,]$") | (F.col("i") % 19 == 3) | ((F.lead("start_ms").over(order) - F.col("end_ms") >= 180) & (F.length("word") > 4))
    carded = words.withColumn("ends", ends).withColumn("of", F.coalesce(F.sum(F.when(F.col("ends"), 1).otherwise(0)).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    matched = carded.withColumn("card", F.when(F.col("i") % 13 != 5, F.col("of")))
    label = F.when(F.col("i") % 17 != 3, (F.lead("card").over(order) != F.col("card")).cast("int"))
    return matched.select("media_id", "i", "card", label.alias("label"), (F.col("i") % 29 == 7).alias("cut"))


TOKEN = r"lower(strip_accents(regexp_replace({}, '[^\pL\pN_\s]', '', 'g')))"
quoted = lambda words: ", ".join(f"'{w}'" for w in sorted(words))


@query(rf"""WITH {WORDS_SQL}, e AS (
  SELECT *, regexp_matches(word, '[.?!,]$') OR i % 19 = 3 OR coalesce(lead(start_ms) OVER o - end_ms >= 180 AND length(word) > 4, false) AS ends, lead(start_ms) OVER o - end_ms AS pause, lead(word) OVER o AS following
  FROM words WINDOW o AS (PARTITION BY media_id ORDER BY i)
), c AS (
  SELECT *, CASE WHEN i % 13 <> 5 THEN coalesce(sum(ends::INT) OVER (PARTITION BY media_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) END AS card FROM e
), l AS (
  SELECT *, CASE WHEN i % 17 <> 3 THEN (lead(card) OVER o <> card)::INT END AS label, lead(card) OVER o <> last_value(card IGNORE NULLS) OVER (PARTITION BY media_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS moves
  FROM c WINDOW o AS (PARTITION BY media_id ORDER BY i)
), s AS (
  SELECT l.*, coalesce((SELECT max(m.i) + 1 FROM l m WHERE m.media_id = l.media_id AND m.i < l.i AND m.moves), 0) AS began FROM l
), x AS (
  SELECT s.media_id, s.i, s.label, s.pause, s.word, s.following, s.segment_end, s.end_ms, count(*) AS n, min(w.start_ms) AS began_ms, sum(length(w.word)) + count(*) - 1 AS chars, bool_or(w.i % 29 = 7) AS crossed
  FROM s JOIN words w ON w.media_id = s.media_id AND w.i BETWEEN s.began AND s.i WHERE s.label IS NOT NULL GROUP BY ALL
), r AS (
  SELECT x.*, (SELECT count(*) * 1000 / (x.end_ms - min(w.start_ms)) FROM words w WHERE w.media_id = x.media_id AND w.i BETWEEN x.i - 4 AND x.i) AS rate FROM x WHERE NOT crossed
)
SELECT media_id, i, greatest(0, pause)::DOUBLE AS pause_ms, n::DOUBLE AS card_words, (end_ms - began_ms)::DOUBLE AS card_ms, chars::DOUBLE AS card_chars, ({TOKEN.format('word')} IN ({quoted(X.WEAK_TRAILING_WORDS)}))::INT::DOUBLE AS weak,
       CASE WHEN regexp_matches(word, '[.?!…]$') THEN 2 WHEN regexp_matches(word, '[,;:]$') THEN 1 ELSE 0 END::DOUBLE AS mark, ({TOKEN.format('following')} IN ({quoted(S.OPENER_WORDS)}))::INT::DOUBLE AS opens_next,
       segment_end::INT::DOUBLE AS segment_ends, rate AS words_per_second, label::DOUBLE AS y FROM r""")
def gap_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training rows from corrected cards, a column a feature."""
    words = V.words_once(spark, sf_dir)
    found = T.gap_examples(words, user_cards(words))
    return found.select("media_id", "i", *[F.get("x", F.lit(k)).alias(name) for k, name in enumerate(T.FEATURES)], "y")


@query()
def tree_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cards cut by a tree that learnt from three of four recordings: F1 of their ends against the user's, by part."""
    words = V.words_once(spark, sf_dir)
    examples = V.settled(T.gap_examples(words, user_cards(words)))
    model = models.train_classifier(examples.filter("media_id % 4 <> 3"), 6, 15)
    ends = T.card_ends(V.settled(T.decisions(words, model, **LIMITS)), LIMITS["max_words"])
    judged = examples.join(ends.withColumn("ends", F.lit(True)), ["media_id", "i"], "left").withColumn("part", F.when(F.col("media_id") % 4 == 3, "test").otherwise("train"))
    return judged.groupBy("part").agg(stats.f1(F.coalesce("ends", F.lit(False)), F.col("y") == 1).alias("f1"), F.count("*").alias("rows"))


@query()
def styled_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All recordings cut into cards by the tree."""
    words = V.words_once(spark, sf_dir)
    examples = V.settled(T.gap_examples(words, user_cards(words)).filter("media_id % 4 <> 3").select("x", "y"))
    model = models.train_classifier(examples, 6, 15)
    return T.styled_cards(words, T.card_ends(V.settled(T.decisions(words, model, **LIMITS)), LIMITS["max_words"]))
