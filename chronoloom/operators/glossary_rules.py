"""Rules on names, pronouns and verbs of translated lines, by a glossary of the recording.

A glossary is a column: an array of (name, variants, rendering, gender: male, female or other). It
has the characters of one recording, some tens at most, so each rule is an expression over the row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Pronouns of the target and of the source, and verbs that say who marries whom (fixed values).
SHE, HE = "她", "他"
SOURCE_SHE, SOURCE_HE = r"(?i)\b(ela|dela|nela)\b", r"(?i)\b(ele|dele|nele)\b"
TO_HUSBAND, TO_WIFE, MARRY = "嫁给", "娶", "结婚"
#: Words between subject and verb that don't count, and particles behind the verb (fixed values).
LINKS, PARTICLES = "(试图|想要|想|要|会|去|已经|又|再|就|也|都)*", "[了过]*"
#: Prepositions that make the name behind them an object (fixed values).
PREPOSITIONS = "com|de|do|da|dos|das|pra|pro|para|no|na|nos|nas|ao|aos|à|às|em|sobre|contra"
#: Characters that lengthen or vary a rendered name (fixed values).
SUFFIXES = "尔多德斯拉娜诺罗托索莫雷"
#: Signs of gender around a name (fixed values).
MALE_SIGNS, FEMALE_SIGNS = r"(?i)\b(o|ele|dele|rejeitado|sozinho|irmao|filho|tio)\b", r"(?i)\b(a|ela|dela|rejeitada|sozinha|irma|filha|tia)\b"


def with_glossary(lines: DataFrame, characters: DataFrame) -> DataFrame:
    """Lines with their recording's characters (media_id, name, variants, rendering, gender) as the column `glossary`."""
    each = F.struct("name", "variants", "rendering", "gender")
    return lines.join(characters.groupBy("media_id").agg(F.array_sort(F.collect_list(each)).alias("glossary")), "media_id", "left")


def _word(name: Column, before: str = "") -> Column:
    return F.concat(F.lit(rf"(?iU)\b{before}\Q"), name, F.lit(r"\E\b"))


def _names(c: Column) -> Column:
    return F.filter(F.concat(F.array(c["name"]), F.coalesce(c["variants"], F.array().cast("array<string>"))), lambda n: F.coalesce(n, F.lit("")) != "")


def mentioned(c: Column, text: Column) -> Column:
    return F.exists(_names(c), lambda n: F.regexp_count(text, _word(n)) > 0)


def is_subject(c: Column, text: Column) -> Column:
    """Whether some mention of the character has no preposition before it."""
    before = rf"(?:{PREPOSITIONS})\s+(?:[oa]s?\s+)?"
    return F.exists(_names(c), lambda n: F.regexp_count(text, _word(n)) > F.regexp_count(text, _word(n, before)))


def _of(glossary: Column, gender: str) -> Column:
    return F.filter(glossary, lambda c: c["gender"] == gender)


def _any_rendering(characters: Column) -> Column:
    """A pattern of the characters' renderings; one that matches nothing if there are none."""
    quoted = F.transform(F.filter(characters, lambda c: F.coalesce(c["rendering"], F.lit("")) != ""), lambda c: F.concat(F.lit(r"\Q"), c["rendering"], F.lit(r"\E")))
    return F.when(F.size(quoted) > 0, F.array_join(quoted, "|")).otherwise("(?!)")


def gender_errors(source: Column, line: Column, glossary: Column) -> Column:
    """Names of the subjects whose gender the line's pronoun contradicts; null if none.

    Only where all named subjects are of one gender and the source has no pronoun of the other.
    """
    subjects = F.filter(glossary, lambda c: is_subject(c, source))
    males, females = _of(subjects, "male"), _of(subjects, "female")
    names = lambda cs: F.array_join(F.transform(cs, lambda c: c["name"]), ", ")
    return F.when(line.contains(SHE) & (F.size(males) > 0) & (F.size(females) == 0) & ~source.rlike(SOURCE_SHE), names(males)).when(
        line.contains(HE) & (F.size(females) > 0) & (F.size(males) == 0) & ~source.rlike(SOURCE_HE), names(females)
    )


def marriage_subject_error(line: Column, glossary: Column) -> Column:
    """The verb that its subject's gender excludes: a man's name or pronoun right before the one, a woman's before the other."""
    before = lambda pronoun, gender: F.concat(F.lit(f"({pronoun}|"), _any_rendering(_of(glossary, gender)), F.lit(f"){LINKS}"))
    return F.when(F.regexp_count(line, F.concat(before(HE, "male"), F.lit(TO_HUSBAND))) > 0, TO_HUSBAND).when(
        F.regexp_count(line, F.concat(before(SHE, "female"), F.lit(TO_WIFE))) > 0, TO_WIFE
    )


def marriage_object_error(line: Column, glossary: Column) -> Column:
    """The verb whose object has the wrong gender: one takes a husband, the other a wife."""
    after = lambda verb, gender: F.concat(F.lit(f"{verb}{PARTICLES}("), _any_rendering(_of(glossary, gender)), F.lit(")"))
    return F.when(F.regexp_count(line, after("嫁给?", "female")) > 0, TO_HUSBAND).when(F.regexp_count(line, after(TO_WIFE, "male")) > 0, TO_WIFE)


def swapped_characters(source: Column, line: Column, glossary: Column) -> Column:
    """(missing, intruders): names that the source has and the line lacks, renderings the other way round; null unless both occur."""
    rendered = F.filter(glossary, lambda c: F.coalesce(c["rendering"], F.lit("")) != "")
    missing = F.filter(rendered, lambda c: mentioned(c, source) & ~line.contains(c["rendering"]))
    intruders = F.filter(rendered, lambda c: ~mentioned(c, source) & line.contains(c["rendering"]))
    found = F.struct(F.transform(missing, lambda c: c["name"]).alias("missing"), F.transform(intruders, lambda c: c["rendering"]).alias("intruders"))
    return F.when((F.size(missing) > 0) & (F.size(intruders) > 0), found)


def spelling_variants(line: Column, glossary: Column) -> Column:
    """Spellings in the line that stray from a rendering: longer by one of the suffixes, or with another one as last character of three or more."""

    def strays(c: Column) -> Column:
        stem = F.substring(c["rendering"], F.lit(1), F.length(c["rendering"]) - 1)
        longer = F.regexp_extract_all(line, F.concat(F.lit(r"(\Q"), c["rendering"], F.lit(rf"\E[{SUFFIXES}])")), F.lit(1))
        other = F.regexp_extract_all(line, F.concat(F.lit(r"(\Q"), stem, F.lit(rf"\E[{SUFFIXES}])")), F.lit(1))
        varied = F.when(F.length(c["rendering"]) >= 3, F.filter(other, lambda x: x != c["rendering"])).otherwise(F.array().cast("array<string>"))
        listed = F.filter(F.coalesce(c["variants"], F.array().cast("array<string>")), lambda v: (v != "") & (v != c["rendering"]) & line.contains(v))
        return F.concat(longer, varied, listed)

    known = F.filter(glossary, lambda c: F.coalesce(c["rendering"], F.lit("")) != "")
    return F.array_sort(F.array_distinct(F.flatten(F.transform(known, strays))))


def fixed_gender(source: Column, line: Column, glossary: Column) -> Column:
    """The line with the pronoun of the only character that the source names, and with a verb of marriage that takes no side."""
    named = F.filter(glossary, lambda c: c["gender"].isin("male", "female") & (F.regexp_count(source, _word(c["name"])) > 0))
    gender = F.get(named, F.lit(0))["gender"]
    his = F.when((gender == "male") & line.contains(SHE) & ~line.contains(HE), F.translate(line, SHE, HE))
    hers = F.when((gender == "female") & line.contains(HE) & ~line.contains(SHE), F.translate(line, HE, SHE))
    right = F.coalesce(his, hers, line)
    return F.when(F.size(named) == 1, F.replace(F.replace(right, F.lit(TO_HUSBAND), F.lit(MARRY)), F.lit(TO_WIFE), F.lit(MARRY))).otherwise(line)


def inferred_gender(lines: DataFrame, names: DataFrame) -> DataFrame:
    """(media_id, name) with the gender that most signs in its recording's lines (media_id, text) with that name speak for.

    An index of the lines' words finds the lines that have a name's first word; only in those a name of several words, or
    with other marks, is looked for as a whole. So the work is a join on (recording, word), never lines by names.
    """
    other = r"[^\p{L}\p{N}_]+"
    word = F.explode(F.array_distinct(F.split(F.lower("text"), other))).alias("word")
    male, female = F.regexp_count("text", F.lit(MALE_SIGNS)), F.regexp_count("text", F.lit(FEMALE_SIGNS))
    said = lines.select("media_id", "text", male.alias("male"), female.alias("female"), word)
    wanted = names.select("media_id", "name").distinct().withColumn("word", F.get(F.filter(F.split(F.lower("name"), other), lambda w: w != ""), F.lit(0)))
    single = F.col("word") == F.lower("name")
    met = wanted.join(said, ["media_id", "word"]).filter(single | (F.regexp_count("text", _word(F.col("name"))) > 0))
    sums = met.groupBy("media_id", "name").agg(F.sum("male").alias("male"), F.sum("female").alias("female"))
    counted = wanted.drop("word").join(sums, ["media_id", "name"], "left").fillna(0, ["male", "female"])
    gender = F.when(F.col("male") > F.col("female"), "male").when(F.col("female") > F.col("male"), "female").otherwise("unknown")
    return counted.withColumn("gender", gender)
