"""Editing projects: objects that refer to each other, resolved by joins, to captions and edits of their sequences.

A project is a table of XML nodes (`sources.projects.project_nodes`). Objects name others by id or unique id; `edges`
resolves all references of all projects in one join, and each step from an object to the next one is a join with the edges of
that step's element alone. Nothing is looked up object by object, and a project of any size is dealt over all tasks.
"""

from __future__ import annotations

import base64
import binascii

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronoloom.operators.tracks import merge_tracks
from chronoloom.sources.projects import blob_text, seconds_of, whole_blob_text

#: Names of objects, elements and components in a project (fixed values).
TEXT, MOTION, SCALE_PARAMETER = "AE.ADBE Text", "AE.ADBE Motion", "2"
EXPORT = "ExportSettings.Info.SaveAsFile"
VIDEO_TYPES = ("mp4", "mov", "mkv", "avi", "webm")
LONG_PATH = r"^\\\\\?\\"


def read(nodes: DataFrame) -> DataFrame:
    """The nodes of projects that could be read as a whole."""
    broken = nodes.filter("error IS NOT NULL").select("path").distinct()
    return nodes.filter("error IS NULL").drop("error").join(broken, "path", "left_anti")


def ends_with(path: str) -> Column:
    return (F.col("xpath") == path) | F.col("xpath").endswith("/" + path)


def edges(nodes: DataFrame) -> DataFrame:
    """(path, object, node, xpath, target, target_tag): every reference that some object answers to; of objects of one id the last counts."""
    roots = nodes.filter("xpath = ''")
    named = roots.filter("id IS NOT NULL").select("path", F.concat(F.lit("#"), "id").alias("key"), "object", "tag")
    named = named.union(roots.filter("uid IS NOT NULL").select("path", F.concat(F.lit("@"), "uid"), "object", "tag"))
    known = named.groupBy("path", "key").agg(F.max(F.struct("object", "tag")).alias("o")).select("path", "key", F.col("o.object").alias("target"), F.col("o.tag").alias("target_tag"))
    key = F.coalesce(F.concat(F.lit("#"), "ref"), F.concat(F.lit("@"), "uref"))
    return nodes.select("path", "object", "node", "xpath", key.alias("key")).filter("key IS NOT NULL").join(known, ["path", "key"]).drop("key")


def step(rows: DataFrame, links: DataFrame, at: Column | str, to: str, tag: str | None = None) -> DataFrame:
    """Rows (path, object, ...) on to the objects that the elements at a place refer to: `object` is the next one, `to` the element's number."""
    some = links.filter(at if isinstance(at, Column) else F.col("xpath") == at)
    some = some.filter(F.col("target_tag") == tag) if tag else some
    return rows.join(some.select("path", "object", F.col("node").alias(to), "target"), ["path", "object"]).drop("object").withColumnRenamed("target", "object")


def first_text(nodes: DataFrame, at: Column | str, name: str) -> DataFrame:
    """(path, object, name): the text of an object's first element at a place."""
    some = nodes.filter(at if isinstance(at, Column) else F.col("xpath") == at)
    return some.groupBy("path", "object").agg(F.min_by(F.coalesce("text", F.lit("")), "node").alias(name))


def blobs(nodes: DataFrame, at: str, name: str, whole: bool = False) -> DataFrame:
    """(path, object, name): the text in the binary blob of an object's first element at a place; a blob that is empty has the contents
    of the project's first one with its hash. Whole texts have any length; null is one that can't be read."""
    body = F.nullif(F.regexp_replace(F.coalesce("text", F.lit("")), r"^\s+|\s+$", ""), F.lit(""))
    stored = nodes.filter("hash IS NOT NULL").withColumn("body", body).filter("body IS NOT NULL").groupBy("path", "hash").agg(F.min_by("body", "node").alias("stored"))
    own = nodes.filter(F.col("xpath") == at).withColumn("body", body).groupBy("path", "object").agg(F.min_by(F.struct("body", "hash"), "node").alias("b")).select("path", "object", "b.*")

    @F.pandas_udf("string")
    def decoded(column: pd.Series) -> pd.Series:
        def text(value: str | None) -> str | None:
            try:
                return (whole_blob_text if whole else blob_text)(base64.b64decode(value)) if value else ""
            except binascii.Error:
                return None if whole else ""

        return column.map(text)

    return own.join(stored, ["path", "hash"], "left").select("path", "object", decoded(F.coalesce("body", "stored")).alias(name))


def sequences(nodes: DataFrame) -> DataFrame:
    """(path, sequence, name)."""
    names = first_text(nodes, "Name", "name")
    roots = nodes.filter("xpath = '' AND tag = 'Sequence'").select("path", "object")
    return roots.join(names, ["path", "object"], "left").select("path", F.col("object").alias("sequence"), F.coalesce("name", F.lit("")).alias("name"))


def track_items(nodes: DataFrame, links: DataFrame, group: str, item: str) -> DataFrame:
    """(path, sequence, track, item, start, end) of the items on tracks of a kind; tracks are numbered from 1 in the sequence's order."""
    begin = sequences(nodes).select("path", "sequence", F.col("sequence").alias("object"))
    groups = step(begin, links, "TrackGroups/TrackGroup/Second", "g", group)
    tracks = step(groups, links, "TrackGroup/Tracks/Track", "t")
    numbered = tracks.withColumn("track", F.row_number().over(W.partitionBy("path", "sequence").orderBy("g", "t")))
    items = step(numbered, links, ends_with("ClipItems/TrackItems/TrackItem"), "place", item)
    for name, tag in (("start", "Start"), ("end", "End")):
        times = first_text(nodes, ends_with(f"ClipTrackItem/TrackItem/{tag}"), name)
        items = items.join(times, ["path", "object"], "left").withColumn(name, seconds_of(F.nullif(name, F.lit(""))))
    return items.select("path", "sequence", "track", "place", F.col("object").alias("item"), "start", "end")


def components(nodes: DataFrame, links: DataFrame, match: str) -> DataFrame:
    """(path, item, c, object): the components of a kind in an item's chain, in order of c."""
    items = nodes.filter("xpath = ''").select("path", "object", F.col("object").alias("item"))
    chains = step(items, links, "ClipTrackItem/ComponentOwner/Components", "chain")
    found = step(chains, links, "ComponentChain/Components/Component", "c")
    kind = first_text(nodes, "MatchName", "match").filter(F.col("match") == match)
    return found.join(kind, ["path", "object"]).select("path", "item", "c", "object")


def graphic_texts(nodes: DataFrame, links: DataFrame, whole: bool = False) -> DataFrame:
    """(path, item, text) of items with text layers: each layer's first text parameter, in order; null if one can't be read."""
    params = step(components(nodes, links, TEXT), links, "Component/Params/Param", "p", "ArbVideoComponentParam")
    first = params.groupBy("path", "item", "c").agg(F.min_by("object", "p").alias("object"))
    texts = first.join(blobs(nodes, "StartKeyframeValue", "text", whole), ["path", "object"]).filter("text IS NULL OR text <> ''")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("c", "text"))), lambda x: x["text"]), " ")
    return texts.groupBy("path", "item").agg(F.when(~F.bool_or(F.col("text").isNull()), joined).alias("text"))


def caption_texts(nodes: DataFrame, links: DataFrame, whole: bool = False) -> DataFrame:
    """(path, item, text) of items on caption tracks; null is a text that can't be read."""
    items = nodes.filter("xpath = ''").select("path", "object", F.col("object").alias("item"))
    blocks = step(items, links, "BlockVector/BlockVectorItem", "b").groupBy("path", "item").agg(F.min_by("object", "b").alias("object"))
    return blocks.join(blobs(nodes, "FormattedTextData", "text", whole), ["path", "object"]).filter("text IS NULL OR text <> ''").select("path", "item", "text")


def exports(nodes: DataFrame) -> DataFrame:
    """(path, sequence, file, first, last): a sequence's last export to a video file, in its seconds; last is null if it isn't said."""
    said = F.from_json("text", "OutPath string, InPoint string, OutPoint string")
    found = nodes.filter(ends_with(EXPORT)).select("path", F.col("object").alias("sequence"), "node", said.alias("s"))
    video = F.lower(F.regexp_extract("s.OutPath", r"\.([^./\\]+)$", 1)).isin(*VIDEO_TYPES)
    last = found.filter(video).groupBy("path", "sequence").agg(F.max_by("s", "node").alias("s"))
    ticks = lambda c: F.nullif(F.nullif(F.col(f"s.{c}"), F.lit("")), F.lit("0"))
    return last.select(
        "path", "sequence", F.col("s.OutPath").alias("file"), F.greatest(F.lit(0.0), seconds_of(ticks("InPoint"))).alias("first"),
        F.when(ticks("OutPoint").isNotNull(), seconds_of(ticks("OutPoint"))).alias("last"),
    )


def caption_clips(nodes: DataFrame, whole: bool = False) -> DataFrame:
    """(path, sequence, track, start, end, text): a sequence's captions. The track with most texts is theirs; of others comes what lies
    over none of them. Text graphics count; only a sequence without them has its caption tracks read."""
    links = edges(nodes)

    def merged(group: str, item: str, texts: DataFrame) -> DataFrame:
        clips = track_items(nodes, links, group, item).join(texts, ["path", "item"])
        keyed = clips.select(F.concat_ws(":", "sequence", "path").alias("media_id"), "path", "sequence", "track", "start", "end", "text")
        return merge_tracks(keyed).drop("media_id")

    graphics = merged("VideoTrackGroup", "VideoClipTrackItem", graphic_texts(nodes, links, whole))
    captions = merged("DataTrackGroup", "CaptionDataClipTrackItem", caption_texts(nodes, links, whole))
    return graphics.unionByName(captions.join(graphics.select("path", "sequence").distinct(), ["path", "sequence"], "left_anti"))


def project_cards(nodes: DataFrame, whole: bool = False) -> DataFrame:
    """(path, sequence, name, track, start, end, text, final_start, final_end): captions in the sequence's time and in that of its last
    export, null if the export leaves them out. Times are rounded to milliseconds. By the format's own rule texts have up to 2,000 bytes;
    `whole` ones have any length, and null is one that can't be read."""
    nodes = read(nodes)
    found = caption_clips(nodes, whole).join(sequences(nodes), ["path", "sequence"]).join(exports(nodes), ["path", "sequence"], "left")
    first, last = F.coalesce("first", F.lit(0.0)), F.col("last")
    inside = (F.col("end") > first) & (last.isNull() | (F.col("start") < last))
    final_start, final_end = F.greatest("start", first) - first, F.least("end", F.coalesce("last", "end")) - first
    return found.select(
        "path", "sequence", "name", "track", F.round("start", 3).alias("start"), F.round("end", 3).alias("end"), "text",
        F.when(inside, F.round(final_start, 3)).alias("final_start"), F.when(inside, F.round(final_end, 3)).alias("final_end"),
    )


def imported_subtitles(nodes: DataFrame) -> DataFrame:
    """(path, name, file): SRT files that a project has imported, the first of each name."""
    file = F.regexp_replace(F.coalesce("text", F.lit("")), LONG_PATH, "")
    found = read(nodes).filter((F.col("xpath") == "FilePath") | F.col("xpath").endswith("/FilePath")).withColumn("file", file).filter(F.lower("file").endswith(".srt"))
    return found.withColumn("name", F.regexp_extract("file", r"([^/\\]*)\.[^.]*$", 1)).groupBy("path", "name").agg(F.min_by("file", F.struct("object", "node")).alias("file"))


def keyframe_values(start: Column, frames: Column) -> Column:
    """The values of a parameter: its first one, then those of its key frames, written `time,value,...;...`; what isn't a number goes."""
    chunks = F.concat(F.array(F.coalesce(start, F.lit(""))), F.split(F.coalesce(frames, F.lit("")), ";"))
    return F.filter(F.transform(chunks, lambda c: F.get(F.split(c, ","), F.lit(1)).try_cast("double")), lambda v: v.isNotNull())


def scales(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(path, item, scale): the largest value of the first scale parameter of an item's motion."""
    params = step(components(nodes, links, MOTION), links, "Component/Params/Param", "p")
    kind = first_text(nodes, "ParameterID", "number").filter(F.col("number") == SCALE_PARAMETER)
    first = params.join(kind, ["path", "object"]).groupBy("path", "item").agg(F.min_by("object", F.struct("c", "p")).alias("object"))
    values = first.join(first_text(nodes, "StartKeyframe", "v"), ["path", "object"], "left").join(first_text(nodes, "Keyframes", "f"), ["path", "object"], "left")
    return values.select("path", "item", F.array_max(keyframe_values(F.col("v"), F.col("f"))).alias("scale"))


def clip_sources(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(path, item, source, source_in, source_out): the video file an item shows, and from where to where."""
    items = nodes.filter("xpath = ''").select("path", "object", F.col("object").alias("item"))
    clips = step(step(items, links, "ClipTrackItem/SubClip", "a"), links, "Clip", "b").withColumn("clip", F.col("object"))
    media = step(step(clips, links, "Clip/Source", "d"), links, "MediaSource/Media", "e")
    named = media.join(first_text(nodes, "ActualMediaFilePath", "actual"), ["path", "object"], "left").join(first_text(nodes, "FilePath", "file"), ["path", "object"], "left")
    source = F.regexp_replace(F.coalesce(F.nullif("actual", F.lit("")), "file", F.lit("")), LONG_PATH, "")
    found = named.select("path", "item", source.alias("source"), F.col("clip").alias("object")).filter(F.lower(F.regexp_extract("source", r"\.([^./\\]+)$", 1)).isin(*VIDEO_TYPES))
    for name, tag in (("source_in", "InPoint"), ("source_out", "OutPoint")):
        found = found.join(first_text(nodes, f"Clip/{tag}", name), ["path", "object"], "left").withColumn(name, seconds_of(F.nullif(name, F.lit(""))))
    return found.drop("object")


def video_edits(nodes: DataFrame) -> DataFrame:
    """(path, sequence, name, vertical, duration, track, start, end, source, source_in, source_out, scale): the pieces of recordings on a
    sequence's video tracks, without text graphics; duration: the end of the last item on a video or sound track."""
    nodes = read(nodes)
    links = edges(nodes)
    items = track_items(nodes, links, "VideoTrackGroup", "VideoClipTrackItem")
    sound = track_items(nodes, links, "AudioTrackGroup", "AudioClipTrackItem")
    ends = items.select("path", "sequence", "end").union(sound.select("path", "sequence", "end")).groupBy("path", "sequence").agg(F.round(F.max("end"), 3).alias("duration"))
    begin = sequences(nodes)
    groups = step(begin.select("path", "sequence", F.col("sequence").alias("object")), links, "TrackGroups/TrackGroup/Second", "g", "VideoTrackGroup")
    frames = groups.groupBy("path", "sequence").agg(F.min_by("object", "g").alias("object")).join(first_text(nodes, "FrameRect", "r"), ["path", "object"], "left")
    sides = F.split(F.coalesce("r", F.lit("")), ",")
    vertical = frames.select("path", "sequence", F.coalesce((F.size(sides) == 4) & (F.get(sides, 3).cast("int") > F.get(sides, 2).cast("int")), F.lit(False)).alias("vertical"))
    shown = items.join(graphic_texts(nodes, links).select("path", "item"), ["path", "item"], "left_anti").join(clip_sources(nodes, links), ["path", "item"])
    edits = shown.join(scales(nodes, links), ["path", "item"], "left").join(begin, ["path", "sequence"]).join(vertical, ["path", "sequence"], "left").join(ends, ["path", "sequence"])
    times = [F.round(c, 3).alias(c) for c in ("start", "end")]
    return edits.select("path", "sequence", "name", F.coalesce("vertical", F.lit(False)).alias("vertical"), "duration", "track", *times, "source", *[F.round(c, 3).alias(c) for c in ("source_in", "source_out")], "scale")
