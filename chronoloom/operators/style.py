"""Cutting words into cards as a user does: examples from corrected cards, a tree, and its decisions along a recording.

Whether a card ends after a word depends on where it began, so decisions follow one another. But a card has at most
`max_words` words: a recording's state is the number of words in the open card, and each word is a map from the state before to the
one after. Maps of a stretch are composed without knowing its entry, the stretches' maps in turn give the entries, and
then every stretch is walked for itself. So a recording of any length is dealt over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronoloom.functions.text import WEAK_TRAILING_WORDS, ends_sentence, normalize_token
from chronoloom.operators.models import probabilities
from chronoloom.operators.sessions import OPENER_WORDS, RATE_WORDS

FEATURES = ("pause_ms", "card_words", "card_ms", "card_chars", "weak", "mark", "opens_next", "segment_ends", "words_per_second")
#: Chance from which a card ends; words of a stretch.
THRESHOLD, STRETCH = 0.5, 256


def gap_rows(words: DataFrame) -> DataFrame:
    """Words (media_id, i, word, start_ms, end_ms, segment_end) with what is known of the gap after each, whatever card it is in;
    chars: letters of all words so far. A recording's last word has no gap."""
    order = W.partitionBy("media_id").orderBy("i")
    recent = order.rowsBetween(1 - RATE_WORDS, 0)
    text = F.regexp_replace("word", r"^\s+|\s+$", "")
    span = F.col("end_ms") - F.first("start_ms").over(recent)
    mark = F.when(ends_sentence(text), 2).when(text.rlike("[,;:]$"), 1).otherwise(0)
    rows = words.select(
        "media_id", "i", "start_ms", "end_ms",
        F.greatest(F.lit(0).cast("bigint"), F.lead("start_ms").over(order) - F.col("end_ms")).alias("pause_ms"), F.lead("i").over(order).isNotNull().alias("followed"),
        normalize_token(text).isin(WEAK_TRAILING_WORDS).cast("int").alias("weak"), mark.alias("mark"),
        F.coalesce(normalize_token(F.lead("word").over(order)).isin(OPENER_WORDS), F.lit(False)).cast("int").alias("opens_next"),
        F.coalesce("segment_end", F.lit(False)).cast("int").alias("segment_ends"),
        F.when(span > 0, F.count("*").over(recent) * 1000 / span).otherwise(F.lit(0.0)).alias("words_per_second"),
        F.sum(F.length(text)).over(order.rowsBetween(W.unboundedPreceding, 0)).alias("chars"), F.length(text).alias("own_chars"),
    )
    return rows.withColumn("place", (F.row_number().over(order) - 1).cast("bigint"))


def features(count: Column, card_start_ms: Column, chars_before: Column) -> Column:
    """`FEATURES` of a gap row as an array, for a card of so many words that began there."""
    chars = F.col("chars") - chars_before + count - 1
    values = (F.col("pause_ms"), count, F.greatest(F.lit(0), F.col("end_ms") - card_start_ms), chars, F.col("weak"), F.col("mark"), F.col("opens_next"), F.col("segment_ends"), F.col("words_per_second"))
    return F.array(*[v.cast("double") for v in values])


def gap_examples(words: DataFrame, alignment: DataFrame) -> DataFrame:
    """(media_id, i, x, y): a training row for each labelled gap, with the user's card so far as its state.

    alignment: media_id, i, card (of the corrected cards, null where the word isn't matched), label (of the gap after the
    word, or null), cut (the word was taken out). A card begins where the matched card changes, also at gaps without a label. Gaps of cards in
    which something was cut teach nothing, as their words and times aren't the user's.
    """
    order = W.partitionBy("media_id").orderBy("i")
    rows = gap_rows(words).join(alignment.select("media_id", "i", "card", "label", "cut"), ["media_id", "i"])
    now, after = F.last("card", ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, 0)), F.lead("card").over(order)
    changed = rows.withColumn("changes", F.coalesce(after != now, F.lit(False)))  # null where either isn't known
    began = F.lag("changes", 1, False).over(order)
    numbered = changed.withColumn("open", F.sum(F.when(began, 1).otherwise(0)).over(order.rowsBetween(W.unboundedPreceding, 0)))
    card = W.partitionBy("media_id", "open").orderBy("i").rowsBetween(W.unboundedPreceding, 0)
    known = numbered.select("*", F.count("*").over(card).alias("n"), F.first("start_ms").over(card).alias("began_ms"), F.first(F.col("chars") - F.col("own_chars")).over(card).alias("before"), F.max(F.coalesce("cut", F.lit(False))).over(card).alias("crossed"))
    x = features(F.col("n"), F.col("began_ms"), F.col("before"))
    return known.filter("label IS NOT NULL AND NOT crossed AND followed").select("media_id", "i", x.alias("x"), F.col("label").cast("double").alias("y"))


def decisions(words: DataFrame, model, min_words: int, max_words: int, max_card_ms: int, threshold: float = THRESHOLD) -> DataFrame:
    """(media_id, place, i, next): for each gap the state after it by the state before, `next[n]` for a card of n + 1 words: 1 if the
    card ends, else a word more."""
    order = W.partitionBy("media_id").orderBy("i")
    rows = gap_rows(words)
    before = F.col("chars") - F.col("own_chars")
    cards = [F.struct(F.lag("start_ms", c - 1, 0).over(order).alias("began_ms"), F.lag(before, c - 1, 0).over(order).alias("before")).alias(f"card_{c}") for c in range(1, max_words + 1)]
    rows, nexts = rows.select("*", *cards).filter("followed"), []
    for c in range(1, max_words + 1):  # a column a state: a gap stays one row, which is neither multiplied nor gathered again
        card = F.col(f"card_{c}")
        rows = probabilities(model, rows.withColumn("x", features(F.lit(c), card["began_ms"], card["before"])))
        if c < min_words:
            ends = F.lit(False)
        elif c >= max_words:
            ends = F.lit(True)
        else:
            ends = (F.col("end_ms") - card["began_ms"] >= max_card_ms) | (F.col("probability") >= threshold)
        rows = rows.withColumn(f"next_{c}", F.when(ends, 1).otherwise(min(c + 1, max_words)).cast("smallint")).drop("x", "probability", f"card_{c}")
        nexts.append(f"next_{c}")
    known = F.slice(F.array(*nexts), 1, F.least(F.col("place") + 1, F.lit(max_words)).cast("int"))
    return rows.select("media_id", "place", "i", known.alias("next"))


def card_ends(steps: DataFrame, max_words: int, stretch: int = STRETCH) -> DataFrame:
    """(media_id, i): the last word of each card but the recording's last one, from `decisions`."""
    entry = F.array(*[F.lit(n) for n in range(1, max_words + 1)])
    go = lambda n, s: F.coalesce(F.get(s["next"], n - 1), F.lit(1))  # noqa: E731  a state that can't be there has no entry in the map
    parts = steps.groupBy("media_id", F.expr(f"place DIV {stretch}").alias("part")).agg(F.array_sort(F.collect_list(F.struct("place", "i", "next"))).alias("steps"))
    maps = parts.select("media_id", "part", F.aggregate("steps", entry, lambda at, s: F.transform(at, lambda n: go(n, s))).alias("map"))
    chained = maps.groupBy("media_id").agg(F.array_sort(F.collect_list(F.struct("part", "map"))).alias("maps"))
    none = F.struct(F.lit(1).alias("n"), F.expr("CAST(array() AS array<struct<part: bigint, n: int>>)").alias("entries"))
    walked = F.aggregate("maps", none, lambda a, m: F.struct(F.get(m["map"], a["n"] - 1).alias("n"), F.concat(a["entries"], F.array(F.struct(m["part"].alias("part"), a["n"].alias("n")))).alias("entries")))
    entries = chained.select("media_id", F.explode(walked["entries"]).alias("e")).select("media_id", "e.part", F.col("e.n").alias("entered"))
    begin = F.struct(F.col("entered").alias("n"), F.expr("CAST(array() AS array<bigint>)").alias("ends"))

    def walk(a: Column, s: Column) -> Column:
        n = go(a["n"], s)
        return F.struct(n.alias("n"), F.when(n == 1, F.concat(a["ends"], F.array(s["i"]))).otherwise(a["ends"]).alias("ends"))

    found = parts.join(entries, ["media_id", "part"]).select("media_id", F.aggregate("steps", begin, walk)["ends"].alias("ends"))
    return found.select("media_id", F.explode("ends").alias("i"))


def styled_cards(words: DataFrame, ends: DataFrame) -> DataFrame:
    """(media_id, card, first, last, start_ms, end_ms, text) of words and the last words of cards."""
    order = W.partitionBy("media_id").orderBy("i")
    marked = words.join(ends.withColumn("ends", F.lit(True)), ["media_id", "i"], "left")
    numbered = marked.withColumn("card", F.coalesce(F.sum(F.when(F.col("ends"), 1).otherwise(0)).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).cast("bigint"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "word"))), lambda w: w["word"]), " ")
    return numbered.groupBy("media_id", "card").agg(F.min("i").alias("first"), F.max("i").alias("last"), F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), text.alias("text"))
