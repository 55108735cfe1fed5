"""Short texts for people, names for files, ids: as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from chronoloom.functions.text import remove_accents, short_hash

#: Names of languages by code (fixed values).
LANGUAGES = {"pt": "Português", "en": "English", "zh": "中文", "es": "Español", "fr": "Français", "de": "Deutsch", "it": "Italiano", "ja": "日本語", "ko": "한국어", "ru": "Русский"}
#: Latin signs and the full-width ones that take their place (fixed values).
LATIN_SIGNS, FULL_SIGNS = ",.;?!:", "，。；？！："
DROPPED_SIGNS = "\"'()"


def duration(seconds: Column) -> Column:
    """12.3s, 2m 5s, 3h 12m; -- for none or one below 0."""
    s = F.floor(seconds + 0.5)
    return (
        F.when(seconds.isNull() | (seconds < 0), "--")
        .when(seconds < 60, F.format_string("%.1fs", F.floor(seconds * 10) / 10))
        .when(s < 3600, F.concat(F.floor(s / 60), F.lit("m "), s % 60, F.lit("s")))
        .otherwise(F.concat(F.floor(s / 3600), F.lit("h "), F.floor(s / 60) % 60, F.lit("m")))
    )


def percent(ratio: Column) -> Column:
    return F.coalesce(F.concat(F.floor(ratio * 100 + 0.5), F.lit("%")), F.lit("--"))


def counted(n: Column, one: str, many: str) -> Column:
    return F.concat(n, F.lit(" "), F.when(n == 1, one).otherwise(many))


def first_line(text: Column, most: int = 140) -> Column:
    line = F.trim(F.substring_index(F.coalesce(text, F.lit("")), "\n", 1))
    return F.when(F.length(line) > most, F.concat(F.substring(line, 1, most - 1), F.lit("…"))).otherwise(line)


def reason_key(reason: Column) -> Column:
    """A reason without its details: what stands before a bracket or colon."""
    return F.trim(F.split_part(F.split_part(reason, F.lit(" ("), F.lit(1)), F.lit(":"), F.lit(1)))


def language(code: Column) -> Column:
    names = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    return F.coalesce(F.element_at(names, F.lower(code)), code)


def is_clock(text: Column) -> Column:
    return F.coalesce(text.rlike(r"^(\d+:)?([0-5]?\d:)?[0-5]?\d(\.\d+)?$"), F.lit(False))


def short_stem(path: Column, most: int = 60, default: str = "video") -> Column:
    """A file's name without folder and ending, of plain letters, digits, - and _."""
    stem = F.regexp_replace(F.element_at(F.split(path, r"[/\\]"), -1), r"\.[^.]*$", "")
    plain = F.regexp_replace(F.regexp_replace(remove_accents(stem), r"\s+", "_"), r"[^A-Za-z0-9_-]", "")
    return F.coalesce(F.nullif(F.substring(F.regexp_replace(plain, r"^_+|_+$", ""), 1, most), F.lit("")), F.lit(default))


def video_id(path: Column) -> Column:
    return short_hash(F.lower(path))


def source_id(path: Column, form: Column) -> Column:
    return short_hash(F.lower(F.regexp_replace(path, r"\\", "/")), form)


def full_width(text: Column) -> Column:
    """Latin punctuation made full-width; quotes and brackets go."""
    return F.translate(text, LATIN_SIGNS + DROPPED_SIGNS, FULL_SIGNS)


def confidence_flag(avg_logprob: Column, least: float = -0.6) -> Column:
    return F.when(avg_logprob < least, "low_confidence")


def ordered_durations(least: Column, target: Column, most: Column, floor: int = 10) -> tuple[Column, Column, Column]:
    """Lengths in seconds brought into order, none under `floor`."""
    low = F.greatest(F.lit(floor), least)
    middle = F.greatest(low, target)
    return low, middle, F.greatest(middle, most)


def layer_style(height: Column, portrait: Column, layer: Column) -> tuple[Column, Column]:
    """Font size and bottom margin of a caption layer, from a video's height; each layer stands above the one before."""
    size = F.floor(height * F.when(portrait, 0.0365).otherwise(0.04) + 0.5)
    margin = F.floor(height * F.when(portrait, 0.2).otherwise(0.05) + 0.5) + F.floor(layer * size * 1.6 + 0.5)
    return size, F.when(portrait, margin - 5).otherwise(margin)


def parsed_ranges(text: Column) -> Column:
    """`1:00-2:30,90-100` as an array of (start, end) in seconds; an error if one ends before it starts."""
    from chronoloom.functions.text import parse_clock

    def one(part: Column) -> Column:
        start, end = parse_clock(F.trim(F.split_part(part, F.lit("-"), F.lit(1)))), parse_clock(F.trim(F.split_part(part, F.lit("-"), F.lit(2))))
        return F.when(start < end, F.struct(start.alias("start"), end.alias("end"))).otherwise(F.raise_error(F.concat(F.lit("not a range: "), part)))

    return F.transform(F.split(text, ","), one)
