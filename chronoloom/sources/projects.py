"""Editing projects and media facts: gzip XML projects as tables, probe JSON, detector logs, WAV loudness, xmeml timelines."""

from __future__ import annotations

import gzip
import io
import re
import wave
import xml.etree.ElementTree as ET
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoloom.functions.timecode import TICKS_PER_SECOND

PROBE = "format struct<duration: string>, streams array<struct<codec_type: string, width: int, height: int, avg_frame_rate: string, tags: map<string,string>>>"


def fraction(x: Column) -> Column:
    """A rate such as 60000/1001 as a number; without a denominator it's 1."""
    parts = F.split(x, "/")
    return F.try_divide(F.get(parts, 0).cast("double"), F.coalesce(F.nullif(F.get(parts, 1), F.lit("")).cast("double"), F.lit(1.0)))


def media(probes: DataFrame) -> DataFrame:
    """(path, value: probe JSON) to media: duration, rate and size of the first picture stream, number of sound streams."""
    p = F.from_json("value", PROBE)
    rows = probes.select("path", p.alias("p")).withColumn("v", F.get(F.filter("p.streams", lambda s: s["codec_type"] == "video"), 0))
    return rows.select(
        "path", F.col("p.format.duration").cast("double").alias("duration"), fraction(F.col("v.avg_frame_rate")).alias("fps"), "v.width", "v.height",
        F.size(F.filter("p.streams", lambda s: s["codec_type"] == "audio")).alias("audio_streams"),
    )


def audio_streams(probes: DataFrame) -> DataFrame:
    """The sound streams of probe JSON with their titles."""
    rows = probes.select("path", F.posexplode(F.filter(F.from_json("value", PROBE)["streams"], lambda s: s["codec_type"] == "audio")).alias("n", "s"))
    return rows.select("path", "n", F.coalesce(F.col("s.tags")["title"], F.col("s.tags")["handler_name"], F.lit("")).alias("title"))


def scene_times(logs: DataFrame, offset: float = 0.0) -> DataFrame:
    """(path, value: detector log) to the times of picture changes."""
    found = F.regexp_extract_all("value", F.lit(r"pts_time:\s*(-?\d+(?:\.\d+)?)"), F.lit(1))
    return logs.select("path", F.explode(found).alias("t")).select("path", F.round(F.col("t").cast("double") + offset, 3).alias("t"))


def log_silences(logs: DataFrame, end: float, offset: float = 0.0) -> DataFrame:
    """(path, value: detector log) to silences: starts and ends pair in order, a start below 0 is 0, an open one lasts to `end`."""
    marks = F.regexp_extract_all("value", F.lit(r"silence_(?:start|end):\s*-?\d+(?:\.\d+)?"), F.lit(0))
    none = F.struct(F.lit(None).cast("double").alias("open"), F.expr("CAST(array() AS array<struct<start: double, end: double>>)").alias("done"))

    def add(s: Column, m: Column) -> Column:
        t = F.greatest(F.regexp_extract(m, r"(-?\d+(?:\.\d+)?)$", 1).cast("double"), F.lit(0.0)) + offset
        closed = F.concat(s["done"], F.array(F.struct(s["open"].alias("start"), t.alias("end"))))
        return (
            F.when(m.contains("start"), F.struct(t.alias("open"), s["done"].alias("done")))
            .when(s["open"].isNotNull(), F.struct(F.lit(None).cast("double").alias("open"), closed.alias("done")))
            .otherwise(s)
        )

    tail = lambda s: F.when(s["open"].isNotNull(), F.concat(s["done"], F.array(F.struct(s["open"].alias("start"), F.lit(end).alias("end"))))).otherwise(s["done"])
    return logs.select("path", F.explode(F.aggregate(marks, none, add, tail)).alias("s")).select("path", "s.*").filter("end > start")


def loudness_of_wavs(files: DataFrame, window: float = 0.1, floor: float = -90.0) -> DataFrame:
    """(path, content: 16-bit WAV) to (path, bucket, db); an incomplete last window goes."""

    def levels(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                with wave.open(io.BytesIO(content)) as w:
                    size = int(w.getframerate() * window)
                    x = np.frombuffer(w.readframes(w.getnframes()), np.int16).astype(np.float64)
                n = len(x) // size
                rms = np.sqrt((x[: n * size].reshape(n, size) ** 2).mean(axis=1)) / 32768
                db = np.round(np.maximum(20 * np.log10(np.maximum(rms, 1e-12)), floor), 2)
                yield pd.DataFrame({"path": path, "bucket": np.arange(n), "db": db})

    return files.select("path", "content").mapInPandas(levels, "path string, bucket long, db double")


def project_objects(files: DataFrame) -> DataFrame:
    """(path, content: project, gzip or plain XML) to its objects (path, id, uid, tag, xml) or an error."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    text = gzip.decompress(content) if content[:2] == b"\x1f\x8b" else content
                    rows = [(path, e.get("ObjectID"), e.get("ObjectUID"), e.tag, ET.tostring(e, "unicode"), None) for e in ET.fromstring(text) if e.get("ObjectID") or e.get("ObjectUID")]
                except (OSError, EOFError, zlib.error, ET.ParseError) as problem:
                    rows = [(path, None, None, None, None, f"{type(problem).__name__}: {problem}")]
                yield pd.DataFrame(rows, columns=["path", "id", "uid", "tag", "xml", "error"])

    return files.select("path", "content").mapInPandas(parse, "path string, id string, uid string, tag string, xml string, error string")


#: A node of a project: its object (child of the root, from 0), its number in order of the document, the tags from the object down to it.
NODE = "path string, object long, node long, tag string, xpath string, id string, uid string, ref string, uref string, hash string, text string, error string"
#: Nodes given out at once.
NODES_AT_ONCE = 20_000


def _nodes(content: bytes) -> Iterator[tuple]:
    """(object, node, tag, xpath, id, uid, ref, uref, hash, text) of each element below the root; an object is forgotten when it ends."""
    stream = io.BytesIO(content)
    open_: list[tuple[int, str]] = []
    object_, number, root = -1, 0, None
    for event, e in ET.iterparse(gzip.GzipFile(fileobj=stream) if content[:2] == b"\x1f\x8b" else stream, ("start", "end")):
        if event == "start":
            root = e if root is None else root
            if len(open_) == 1:
                object_ += 1
            open_.append((number, "/".join([*filter(None, [open_[-1][1]]), e.tag]) if len(open_) > 1 else ""))
            number += 1
            continue
        node, xpath = open_.pop()
        if open_:
            yield object_, node, e.tag, xpath, *(e.get(k) for k in ("ObjectID", "ObjectUID", "ObjectRef", "ObjectURef", "BinaryHash")), e.text
        if len(open_) == 1:
            root.clear()


def project_nodes(files: DataFrame) -> DataFrame:
    """(path, content: project, gzip or plain XML) to its nodes (`NODE`), in pieces as they are read; a file that can't be read to its
    end has a row with an error besides, and what came before it doesn't count."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [c.split()[0] for c in NODE.split(", ")]
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                rows: list[tuple] = []
                try:
                    for row in _nodes(content):
                        rows.append((path, *row, None))
                        if len(rows) == NODES_AT_ONCE:
                            yield pd.DataFrame(rows, columns=columns)
                            rows = []
                except (OSError, EOFError, zlib.error, ET.ParseError) as problem:
                    rows = [(path, *[None] * 10, f"{type(problem).__name__}: {problem}")]
                if rows:
                    yield pd.DataFrame(rows, columns=columns)

    return files.filter("content IS NOT NULL").select("path", "content").mapInPandas(parse, NODE)


def seconds_of(ticks: Column) -> Column:
    return F.coalesce(ticks.cast("decimal(38,0)"), F.lit(0)).cast("double") / TICKS_PER_SECOND


#: Bytes of the longest text that counts by the format's own rule (a fixed value); who wants whole texts gives none.
LONGEST_TEXT = 2000
BLANK = re.compile(r"[ \t\n\r\f\v]+")


def text_at(raw: bytes, at: int) -> str | None:
    """The printable text that stands at a place behind its length in 4 bytes and before a zero, if one does."""
    size = int.from_bytes(raw[at : at + 4], "little")
    body, end = raw[at + 4 : at + 4 + size], raw[at + 4 + size : at + 5 + size]
    if not 1 <= size <= LONGEST_TEXT or end != b"\0":
        return None
    try:
        text = body.decode("utf-8")
    except UnicodeDecodeError:
        return None
    return text if all(c.isprintable() or c in "\r\n\t" for c in text) else None


def length_prefixed_strings(raw: bytes) -> list[str]:
    """Texts in a binary blob, in order; every place is tried, so one may stand inside another."""
    return [text for at in range(len(raw) - 4) if (text := text_at(raw, at)) is not None]


def blob_text(raw: bytes) -> str:
    """The text of a text layer's blob: its last one, in one line; the ones before name fonts."""
    found = length_prefixed_strings(raw)
    return " ".join(found[-1].split()) if found else ""


def whole_blob_text(raw: bytes) -> str | None:
    """The text of a text layer's blob, of any length and with any characters, in one line: what stands behind its length at the end of the blob
    (the last such place: what comes before it, as the end of a font's name, can look like a length, too).

    None if there's no text there, or none in UTF-8: the one before it, a font's name, isn't taken for it.
    """
    if not raw:
        return ""
    end = len(raw.rstrip(b"\0"))
    data = np.frombuffer(raw, np.uint8)[: max(end - 1, 4)].astype(np.int64)
    sizes = data[:-3] | data[1:-2] << 8 | data[2:-1] << 16 | data[3:] << 24
    places = np.flatnonzero((sizes == end - 4 - np.arange(len(sizes))) & (sizes > 0)) if end < len(raw) else []
    try:
        return BLANK.sub(" ", raw[places[-1] + 4 : end].decode("utf-8")).strip(" ") if len(places) else None
    except UnicodeDecodeError:
        return None


def xmeml(clips: DataFrame, timebase: int, ntsc: bool, gap: float = 10.0) -> DataFrame:
    """(media_id, n, start, end, title, score, path) to one xmeml timeline a recording: clips `gap` s apart, a marker each."""

    def write(frame: pd.DataFrame) -> pd.DataFrame:
        fps = timebase * 1000 / 1001 if ntsc else timebase
        root = ET.Element("xmeml", version="4")
        sequence = ET.SubElement(root, "sequence", id="sequence-1")
        ET.SubElement(sequence, "name").text = str(frame["media_id"].iloc[0])
        rate = ET.SubElement(sequence, "rate")
        ET.SubElement(rate, "timebase").text, ET.SubElement(rate, "ntsc").text = str(timebase), "TRUE" if ntsc else "FALSE"
        track = ET.SubElement(ET.SubElement(ET.SubElement(sequence, "media"), "video"), "track")
        at, seen = 0.0, set()
        for c in frame.sort_values("n").itertuples(index=False):
            first, length = round(at * fps), round((c.end - c.start) * fps)
            item = ET.SubElement(track, "clipitem", id=f"clipitem-{c.n}")
            for tag, value in (("name", c.title), ("start", first), ("end", first + length), ("in", round(c.start * fps)), ("out", round(c.start * fps) + length)):
                ET.SubElement(item, tag).text = str(value)
            source = ET.SubElement(item, "file", id=f"file-{c.path}")
            if c.path not in seen:  # the first mention defines the file
                ET.SubElement(source, "pathurl").text = f"file://localhost/{c.path}"
                seen.add(c.path)
            marker = ET.SubElement(sequence, "marker")
            ET.SubElement(marker, "name").text, ET.SubElement(marker, "in").text = f"{c.n:02d} - {c.title}", str(first)
            ET.SubElement(marker, "comment").text = "" if pd.isna(c.score) else f"score {c.score:g}/10"
            at += c.end - c.start + gap
        ET.indent(root)
        return pd.DataFrame({"media_id": [frame["media_id"].iloc[0]], "document": ['<?xml version="1.0" encoding="UTF-8"?>\n<!DOCTYPE xmeml>\n' + ET.tostring(root, "unicode")]})

    return clips.groupBy("media_id").applyInPandas(write, "media_id long, document string")


def binary_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")
