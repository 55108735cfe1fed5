"""Validation of translated groups and names: each broken rule is a row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronoloom.operators import glossary_rules as G

#: Characters a line may have, and ms a group must last.
MAX_LINE, MIN_GROUP_MS = 20, 1200
#: Words of negation in the source's language, and marks that have no place in a line of the target (fixed values).
NEGATIONS = r"n[aã]o|nunca|nem|nenhum|nenhuma|ningu[eé]m|nada|jamais|sem|falt(?:ou|a|ava|ar|aram)"
MARKS = ",.;:!?\"'()"
#: The target language whose lines have no letters a to z.
CHINESE = "zh"


def group_violations(groups: DataFrame, cards: DataFrame, characters: DataFrame | None = None, target: str = CHINESE) -> DataFrame:
    """(media_id, rule, detail): a row for each broken rule of translated groups.

    groups: media_id, group, cards array<bigint>, start_ms, end_ms, line, flag; cards: media_id, card, text;
    characters: media_id, name, variants, rendering, gender. Rules of a recording: every card is in a group (missing), in one
    only (repeated) and known (unknown); if so, cards ascend over all groups (order: the first group that goes back). Rules of a
    group: it lasts `MIN_GROUP_MS` (short) and has no flag (flag). For Chinese also: no Latin letters (script) or marks (marks), at
    most `MAX_LINE` characters (long), and with a glossary the rules on pronouns, marriage, swapped characters and spellings
    (pronoun, marriage_subject, marriage_object, swap, spelling). A group's source is its cards' texts.
    """
    used = groups.select("media_id", "group", F.posexplode("cards").alias("pos", "card"))
    counted = used.groupBy("media_id", "card").agg(F.count("*").alias("times"))
    known = cards.select("media_id", "card").distinct().withColumn("known", F.lit(True))
    met = known.join(counted, ["media_id", "card"], "full")
    broken = F.when(F.col("times").isNull(), "missing").when(F.col("known").isNull(), "unknown").when(F.col("times") > 1, "repeated")
    coverage = met.select("media_id", broken.alias("rule"), F.col("card").cast("string").alias("detail")).filter("rule IS NOT NULL")
    order = W.partitionBy("media_id").orderBy("group", "pos")
    back = used.withColumn("back", F.lag("card").over(order) > F.col("card")).filter("back").groupBy("media_id").agg(F.min("group").cast("string").alias("detail"))
    uncovered = coverage.select("media_id").distinct()
    order_rows = back.join(uncovered, "media_id", "left_anti").select("media_id", F.lit("order").alias("rule"), "detail")

    line, group = F.col("line"), F.col("group").cast("string")
    rule = lambda name, breaks, detail=group: F.when(breaks, F.struct(F.lit(name).alias("rule"), detail.alias("detail")))
    rules = [
        rule("short", F.col("end_ms") - F.col("start_ms") < MIN_GROUP_MS),
        rule("flag", F.coalesce("flag", F.lit("")) != "", F.concat_ws(": ", group, "flag")),
    ]
    checked = groups
    if target == CHINESE:
        rules += [rule("script", F.lower(line).rlike("[a-z]")), rule("marks", line.rlike("[" + MARKS + "]")), rule("long", F.length(line) > MAX_LINE)]
        if characters is not None:
            texts = used.join(cards.select("media_id", "card", "text"), ["media_id", "card"], "left")
            each = F.transform(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("text", F.lit("")).alias("text")))), lambda x: x["text"])
            sources = texts.groupBy("media_id", "group").agg(F.array_join(each, " ").alias("source"))
            checked = G.with_glossary(groups.join(sources, ["media_id", "group"], "left"), characters).withColumn("source", F.coalesce("source", F.lit("")))
            source, glossary = F.col("source"), F.coalesce("glossary", F.array().cast("array<struct<name:string,variants:array<string>,rendering:string,gender:string>>"))
            swap, spelled = G.swapped_characters(source, line, glossary), G.spelling_variants(line, glossary)
            found = [("pronoun", F.when(source != "", G.gender_errors(source, line, glossary))), ("marriage_subject", G.marriage_subject_error(line, glossary))]
            found += [("marriage_object", G.marriage_object_error(line, glossary)), ("swap", F.when(source != "", F.array_join(swap["missing"], "|")))]
            found += [("spelling", F.when(F.size(spelled) > 0, F.array_join(spelled, "|")))]
            rules += [rule(name, what.isNotNull(), F.concat_ws(": ", group, what)) for name, what in found]
    of_groups = checked.select("media_id", F.explode(F.filter(F.array(*rules), lambda r: r.isNotNull())).alias("r")).select("media_id", "r.*")
    return coverage.unionByName(order_rows).unionByName(of_groups)


def negation(text: Column) -> Column:
    """The first word of negation, in lower case; null if there's none. Words are whole: accents count as letters."""
    return F.nullif(F.lower(F.regexp_extract(text, rf"(?iu)(?<![\p{{L}}\p{{N}}_])({NEGATIONS})(?![\p{{L}}\p{{N}}_])", 1)), F.lit(""))


def negation_mismatch(source: Column, back: Column) -> Column:
    """Of a text and its translation back into the same language: null where both negate or neither does; else which one does, by which word."""
    a, b = negation(source), negation(back)
    return F.when(a.isNotNull() & b.isNull(), F.concat(F.lit("source: "), a)).when(a.isNull() & b.isNotNull(), F.concat(F.lit("target: "), b))


def mentions(text: Column, name: Column) -> Column:
    """Whether a name is a whole word of the text, in any case."""
    return F.rlike(F.lower(text), F.concat(F.lit(r"(^|[^\p{L}\p{N}_])\Q"), F.lower(name), F.lit(r"\E($|[^\p{L}\p{N}_])")))


def names_normalised(text: Column, variants: list[tuple[str, str]]) -> Column:
    """Each variant of a name replaced by the name, longest first."""
    for variant, name in sorted(variants, key=lambda v: -len(v[0])):
        text = F.replace(text, F.lit(variant), F.lit(name))
    return text


def candidate_names(words: DataFrame, least: int = 2, stop: tuple[str, ...] = ()) -> DataFrame:
    """(name, times): capitalised words, not all capitals, seen `least` times and at least once inside a segment."""
    bare = F.regexp_replace("word", r"[^\p{L}\p{N}_]", "")
    named = words.withColumn("name", bare).filter(F.col("name").rlike(r"^\p{Lu}") & (F.length("name") > 1) & (F.col("name") != F.upper("name")) & ~F.col("name").isin(*stop or ("",)))
    return named.groupBy("name").agg(F.count("*").alias("times"), F.max("pos").alias("latest")).filter((F.col("times") >= least) & (F.col("latest") > 0)).drop("latest")
