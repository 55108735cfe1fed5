"""Captions: SRT reading in two strictnesses, SRT and ASS writing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoloom.functions.text import ass_time, escape_ass, parse_srt_time, srt_time


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, value): whole files."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")


def srt_entries(texts: DataFrame) -> DataFrame:
    """Strict reading of (path, value), with any line ends: blocks set off by blank lines, number, times, text; times stay text.

    Blocks of one line go. A time line without an arrow has null as its end.
    """
    bare = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    unix = F.regexp_replace("value", "\r\n?", "\n")
    blocks = texts.select("path", F.posexplode(F.filter(F.split(bare(unix), "\n\n"), lambda b: bare(b) != "")).alias("pos", "block"))
    lines = blocks.withColumn("ls", F.split(bare(F.col("block")), "\n")).filter(F.size("ls") >= 2)
    times = F.split(F.get("ls", 1), "-->")
    return lines.select(
        "path", "pos", bare(F.get(times, 0)).alias("start"), bare(F.get(times, 1)).alias("end"),
        F.array_join(F.slice("ls", F.lit(3), F.size("ls")), "\n").alias("text"),
    )


def srt_cards(texts: DataFrame) -> DataFrame:
    """Tolerant reading of (path, value): marks of byte order, any line ends, blanks in blank lines, tags; empty cards go."""
    plain = F.regexp_replace(F.regexp_replace("value", "^﻿", ""), "\r\n?", "\n")
    blocks = texts.select("path", F.posexplode(F.split(plain, r"\n[ \t]*\n")).alias("pos", "block"))
    lines = blocks.withColumn("ls", F.split("block", "\n")).withColumn("at", F.array_position(F.transform("ls", lambda x: x.contains("-->")), True).cast("int")).filter("at > 0")
    times = F.split(F.get("ls", F.col("at") - 1), "-->")
    rest = F.array_join(F.slice("ls", F.col("at") + 1, F.size("ls")), "\n")
    text = F.regexp_replace(F.regexp_replace(rest, "<[^>]+>", ""), r"^\s+|\s+$", "")
    return lines.select("path", "pos", parse_srt_time(F.get(times, 0)).alias("start_ms"), parse_srt_time(F.get(times, 1)).alias("end_ms"), text.alias("text")).filter("text <> ''")


def srt_documents(cards: DataFrame) -> DataFrame:
    """(media_id, n, start_ms, end_ms, text) to one SRT document a recording; a blank line after each block."""
    block = F.concat(F.col("n").cast("string"), F.lit("\n"), srt_time(F.col("start_ms")), F.lit(" --> "), srt_time(F.col("end_ms")), F.lit("\n"), F.col("text"), F.lit("\n\n"))
    rows = F.array_sort(F.collect_list(F.struct("n", block.alias("b"))))
    return cards.groupBy("media_id").agg(F.array_join(F.transform(rows, lambda x: x["b"]), "").alias("document"))


def ass_dialogues(cards: DataFrame) -> DataFrame:
    line = F.concat(F.lit("Dialogue: 0,"), ass_time(F.col("start_ms")), F.lit(","), ass_time(F.col("end_ms")), F.lit(",Default,,0,0,0,,"), escape_ass(F.col("text")))
    rows = F.array_sort(F.collect_list(F.struct("n", line.alias("b"))))
    return cards.groupBy("media_id").agg(F.array_join(F.transform(rows, lambda x: x["b"]), "\n").alias("dialogue"), F.count("*").alias("lines"))


def ass_header(font_size: int, margin: int, width: int, height: int) -> str:
    """The head of an ASS document for a video's size."""
    style = "Name, Fontname, Fontsize, PrimaryColour, OutlineColour, Bold, BorderStyle, Outline, Shadow, Alignment, MarginL, MarginR, MarginV"
    return "\n".join([
        "[Script Info]", "ScriptType: v4.00+", f"PlayResX: {width}", f"PlayResY: {height}", "", "[V4+ Styles]", f"Format: {style}",
        f"Style: Default,Arial,{font_size},&H00FFFFFF,&H00000000,1,1,2,0,2,10,10,{margin}", "", "[Events]",
        "Format: Layer, Start, End, Style, Name, MarginL, MarginR, MarginV, Effect, Text",
    ])


def write_documents(documents: DataFrame, path: str, column: str = "document") -> None:
    """One text file a row, in folders by recording."""
    documents.select("media_id", F.col(column).alias("value")).write.mode("overwrite").partitionBy("media_id").text(path)
