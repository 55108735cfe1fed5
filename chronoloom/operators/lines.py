"""Translated lines fitted to their cards: packed at marks into few short parts, and the sentence's cards dealt to the parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Marks behind which a line may be cut, and those that go from a part's ends (fixed values).
CUT_MARKS, END_MARKS = "，。？！；", "，。；"
#: Words that open a line; the same one twice in a row reads badly (fixed values).
CONNECTIVES = ("结果", "然后", "接着", "于是", "后来", "但是", "不过", "而且", "所以")


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, f"^[{END_MARKS}]+|[{END_MARKS}]+$", "")


def opening_connective(line: Column) -> Column:
    """The connective that a line begins with, or null."""
    return F.nullif(F.regexp_extract(line, f"^({'|'.join(CONNECTIVES)})", 1), F.lit(""))


def without_connective(line: Column) -> Column:
    """The line without its opening connective and the marks behind it; a line that is nothing else stays."""
    rest = F.regexp_replace(line, f"^(?:{'|'.join(CONNECTIVES)})[{END_MARKS}]*", "")
    return F.when(rest != "", rest).otherwise(line)


def line_parts(line: Column, width: int) -> Column:
    """A line packed into as few parts as fit in `width` characters, cut behind marks; marks at a part's ends go and don't count.

    Null if a piece between marks is too long, or nothing is left.
    """
    chunks = F.regexp_extract_all(line, F.lit(f"([^{CUT_MARKS}]*[{CUT_MARKS}]|[^{CUT_MARKS}]+)"), F.lit(1))
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("line"))

    def add(s: Column, c: Column) -> Column:
        fits = F.length(stripped(F.concat(s["line"], c))) <= width
        longer = F.struct(s["done"].alias("done"), F.concat(s["line"], c).alias("line"))
        done = F.when(s["line"] != "", F.concat(s["done"], F.array(stripped(s["line"])))).otherwise(s["done"])
        return F.when(fits, longer).otherwise(F.struct(done.alias("done"), c.alias("line")))

    def end(s: Column) -> Column:
        last = stripped(s["line"])
        return F.when(last != "", F.concat(s["done"], F.array(last))).otherwise(s["done"])

    packed = F.aggregate(chunks, start, add, end)
    return F.when(~F.exists(chunks, lambda c: F.length(stripped(c)) > width) & (F.size(packed) > 0), packed)


def card_cuts(cards: Column, sizes: Column) -> Column:
    """The first cards (0-based) of the parts after the first, by the parts' sizes, as an array; null if there are too few cards or no time.

    cards: an array of structs with start_ms and end_ms. A part's share of the characters is its share of the sentence's time; a cut is at
    the card that begins nearest to where the shares before end, the earlier one of two; each part gets a card at least.
    """
    n, parts = F.size(cards), F.size(sizes)
    chars = F.aggregate(sizes, F.lit(0).cast("bigint"), lambda a, x: a + x)
    first = F.get(cards, F.lit(0))["start_ms"]
    time = F.get(cards, n - 1)["end_ms"] - first
    start = F.struct(F.lit(0).cast("bigint").alias("said"), F.lit(0).alias("cut"), F.expr("CAST(array() AS array<int>)").alias("cuts"))

    def add(s: Column, size: Column) -> Column:
        said = s["said"] + size
        highest = n - (parts - F.size(s["cuts"]) - 1)
        away = lambda k: F.abs((F.get(cards, k)["start_ms"] - first) * chars - time * said)
        cut = F.array_min(F.transform(F.sequence(s["cut"] + 1, highest), lambda k: F.struct(away(k).alias("away"), k.alias("k"))))["k"]
        return F.struct(said.alias("said"), cut.alias("cut"), F.concat(s["cuts"], F.array(cut)).alias("cuts"))

    cuts = F.aggregate(F.slice(sizes, F.lit(1), F.greatest(parts - 1, F.lit(0))), start, add, lambda s: s["cuts"])
    return F.when((n >= parts) & (chars > 0) & (time > 0), cuts)


def fitted_lines(sentences: DataFrame, width: int, least_ms: int) -> DataFrame:
    """Sentences with `parts`: an array of (line, first, last, start_ms, end_ms), first and last numbers of cards; null if the line doesn't fit.

    sentences: line, cards (array of card, start_ms, end_ms, in order). One part takes all cards, whatever its time; of several each
    lasts `least_ms` or none is given, so that the line is asked for again.
    """
    made = sentences.withColumn("__lines", line_parts(F.col("line"), width))
    cuts = F.when(F.size("__lines") == 1, F.expr("CAST(array() AS array<int>)")).otherwise(card_cuts(F.col("cards"), F.transform("__lines", F.length)))
    dealt = made.withColumn("__edges", F.concat(F.array(F.lit(0)), cuts, F.array(F.size("cards"))))
    card = lambda k: F.get(F.col("cards"), k)

    def part(line: Column, k: Column) -> Column:
        a, b = card(F.get("__edges", k)), card(F.get(F.col("__edges"), k + 1) - 1)
        return F.struct(line.alias("line"), a["card"].alias("first"), b["card"].alias("last"), a["start_ms"].alias("start_ms"), b["end_ms"].alias("end_ms"))

    parts = F.transform("__lines", part)
    short = F.exists("parts", lambda p: p["end_ms"] - p["start_ms"] < least_ms)
    found = dealt.withColumn("parts", F.when(F.col("__edges").isNotNull() & (F.size("cards") > 0), parts))
    return found.withColumn("parts", F.when((F.size("parts") == 1) | ~short, F.col("parts"))).drop("__lines", "__edges")
