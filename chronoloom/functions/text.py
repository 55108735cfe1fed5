"""Text expressions: normalisation, clocks, wrapping, keys."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Function words that must not end a card (fixed values).
WEAK_TRAILING_WORDS = "a com da de do e em me o para pra que se te um uma".split()
#: Words after which a thought goes on (fixed values).
MID_IDEA_WORDS = "ai aí com de e entao então mas para porque pra quando que se tipo".split()
#: Words that open a sentence (fixed values).
OPENER_WORDS = "ai e entao mas porque so".split()
SENTENCE_END = "[.?!…]$"

ACCENTED = "ÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝàáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
UNACCENTED = "".join(unicodedata.normalize("NFKD", c)[0] for c in ACCENTED)


def remove_accents(x: Column) -> Column:
    """Latin letters without their accents."""
    return F.translate(x, ACCENTED, UNACCENTED)


def remove_all_accents(x: Column) -> Column:
    """Compatibility forms resolved and every combining mark dropped, in any script."""

    def plain(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c)))

    return F.pandas_udf(plain, "string")(x)


def remove_punctuation(x: Column) -> Column:
    return F.regexp_replace(x, r"[^\p{L}\p{N}_\s]", "")


def squeeze(x: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(x, r"[ \t\n\r\f\x0B]+", " "), "^ | $", "")


def clean_text(x: Column, punctuation: bool = True, accents: bool = True) -> Column:
    if punctuation:
        x = remove_punctuation(x)
    return squeeze(remove_accents(x) if accents else x)


def normalize_token(x: Column) -> Column:
    """The key by which words are compared: no punctuation, no accents, lower case."""
    return F.lower(squeeze(remove_accents(remove_punctuation(x))))


def ends_sentence(x: Column) -> Column:
    return F.regexp_replace(x, r"\s+$", "").rlike(SENTENCE_END)


def srt_time(ms: Column) -> Column:
    """HH:MM:SS,mmm; times below 0 count as 0."""
    m = F.greatest(ms, F.lit(0)).cast("bigint")
    return F.format_string("%02d:%02d:%02d,%03d", F.floor(m / 3600000), F.floor(m / 60000) % 60, F.floor(m / 1000) % 60, m % 1000)


def parse_srt_time(x: Column) -> Column:
    """Milliseconds of H:MM:SS,mmm or H:MM:SS.m; null where there is no such time."""
    pattern = r"(\d+):(\d{1,2}):(\d{1,2})(?:[,.](\d{1,3}))?"
    part = lambda i: F.regexp_extract(x, pattern, i)
    whole = (part(1).cast("bigint") * 3600 + part(2).cast("bigint") * 60 + part(3).cast("bigint")) * 1000
    return F.when(x.rlike(pattern), whole + F.rpad(part(4), 3, "0").cast("bigint"))


def ass_time(ms: Column) -> Column:
    """h:mm:ss.cc, cut off, not rounded."""
    m = F.greatest(ms, F.lit(0)).cast("bigint")
    return F.format_string("%d:%02d:%02d.%02d", F.floor(m / 3600000), F.floor(m / 60000) % 60, F.floor(m / 1000) % 60, F.floor(m % 1000 / 10))


def parse_clock(x: Column) -> Column:
    """Seconds of s, m:s or h:m:s."""
    return F.aggregate(F.split(x, ":"), F.lit(0.0), lambda a, p: a * 60 + p.cast("double"))


def short_clock(ms: Column) -> Column:
    """mm:ss, from an hour on h:mm:ss."""
    s = F.floor(F.greatest(ms, F.lit(0)) / 1000)
    return F.when(s >= 3600, F.format_string("%d:%02d:%02d", F.floor(s / 3600), F.floor(s / 60) % 60, s % 60)).otherwise(
        F.format_string("%02d:%02d", F.floor(s / 60), s % 60)
    )


def wrapped_lines(x: Column, width: int = 42) -> Column:
    """Lines filled word by word up to `width` characters; a longer word has a line of its own."""
    words = F.filter(F.split(x, r"[ \t\n\r\f\x0B]+"), lambda w: w != "")
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("line"))

    def add(s: Column, w: Column) -> Column:
        fits = F.length(s["line"]) + 1 + F.length(w) <= width
        return (
            F.when(s["line"] == "", F.struct(s["done"].alias("done"), w.alias("line")))
            .when(fits, F.struct(s["done"].alias("done"), F.concat_ws(" ", s["line"], w).alias("line")))
            .otherwise(F.struct(F.concat(s["done"], F.array(s["line"])).alias("done"), w.alias("line")))
        )

    return F.aggregate(words, start, add, lambda s: F.when(s["line"] == "", s["done"]).otherwise(F.concat(s["done"], F.array(s["line"]))))


def short_hash(*parts: Column, size: int = 12) -> Column:
    return F.substring(F.sha1(F.concat_ws("|", *parts).cast("binary")), 1, size)


def natural_key(x: Column) -> Column:
    """A name's key for sorting with numbers by size."""
    return F.array_join(
        F.transform(F.regexp_extract_all(x, F.lit(r"(\d+|\D+)"), F.lit(1)), lambda p: F.when(p.rlike(r"^\d+$"), F.lpad(p, 12, "0")).otherwise(F.lower(p))), ""
    )


def file_name(x: Column) -> Column:
    return F.element_at(F.split(x, r"[/\\]"), -1)


def escape_ass(x: Column) -> Column:
    return F.replace(F.replace(F.replace(x, F.lit("{"), F.lit(r"\{")), F.lit("}"), F.lit(r"\}")), F.lit("\n"), F.lit(r"\N"))


def file_url(x: Column) -> Column:
    """file:// address of a path, percent-encoded but for its slashes."""
    return F.concat(F.lit("file://localhost/"), F.replace(F.replace(F.url_encode(F.regexp_replace(x, r"\\", "/")), F.lit("+"), F.lit("%20")), F.lit("%2F"), F.lit("/")))
