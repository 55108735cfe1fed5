"""Queries on editing projects: files written from the conversations, read back and resolved."""

from __future__ import annotations

import base64
import gzip
import json
from hashlib import md5
from xml.sax.saxutils import escape, quoteattr

from pyspark.sql import DataFrame, SparkSession

from chronoloom.functions.timecode import TICKS_PER_SECOND
from chronoloom.operators import projects as P
from chronoloom.operators.groups import in_groups
from chronoloom.sources import views as V
from chronoloom.sources.projects import project_nodes
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


#: Ticks of a millisecond.
TICK = TICKS_PER_SECOND // 1000
FONT = "Arial"


class ProjectFile:
    """A project as its format has it: objects below the root, which name each other by id."""

    def __init__(self):
        self.objects: list[str] = []
        self.blobs: set[str] = set()

    def add(self, tag: str, name: str, body: str, by: str = "ObjectID") -> str:
        self.objects.append(f"<{tag} {by}={quoteattr(name)}>{body}</{tag}>")
        return name

    @staticmethod
    def refs(tag: str, names: list[str], by: str = "ObjectRef") -> str:
        return "".join(f'<{tag} Index="{i}" {by}={quoteattr(x)}/>' for i, x in enumerate(names))

    def blob(self, tag: str, text: str) -> str:
        """A text layer's blob; only the first of a hash has contents."""
        name = md5(text.encode()).hexdigest()
        if name in self.blobs:
            return f'<{tag} Encoding="base64" BinaryHash="{name}"></{tag}>'
        self.blobs.add(name)
        raw = b"\x0c\0\0\0\0\0\x06\0"
        for part in (FONT, text):
            data = part.encode()
            raw += len(data).to_bytes(4, "little") + data + b"\0" * (4 - len(data) % 4)
        return f'<{tag} Encoding="base64" BinaryHash="{name}">\n{base64.b64encode(raw).decode()}\n</{tag}>'

    def item(self, tag: str, name: str, start: int, end: int, inside: str, behind: str = "", wrapper: str = "") -> str:
        times = (f"<Start>{start * TICK}</Start>" if start else "") + f"<End>{end * TICK}</End>"  # what is 0 isn't written
        body = f"<ClipTrackItem>{inside}<TrackItem>{times}</TrackItem></ClipTrackItem>"
        return self.add(tag, name, (f"<{wrapper}>{body}</{wrapper}>" if wrapper else body) + behind)

    def graphic(self, n: int, start: int, end: int, text: str) -> str:
        param = self.add("ArbVideoComponentParam", f"p{n}", "<Name>Text</Name>" + self.blob("StartKeyframeValue", text))
        plain = self.add("VideoComponentParam", f"q{n}", "<StartKeyframe>0,1,0</StartKeyframe>")
        layer = self.add("VideoFilterComponent", f"x{n}", f"<Component><Params>{self.refs('Param', [plain, param])}</Params></Component><MatchName>{P.TEXT}</MatchName>")
        motion = self.add("VideoFilterComponent", f"m{n}", f"<MatchName>{P.MOTION}</MatchName>")
        chain = self.add("VideoComponentChain", f"c{n}", f"<ComponentChain><Components>{self.refs('Component', [motion, layer])}</Components></ComponentChain>")
        return self.item("VideoClipTrackItem", f"i{n}", start, end, f'<ComponentOwner><Components ObjectRef="{chain}"/></ComponentOwner>')

    def caption(self, n: int, start: int, end: int, text: str) -> str:
        block = self.add("Block", f"b{n}", self.blob("FormattedTextData", text))
        vector = f"<BlockVector>{self.refs('BlockVectorItem', [block])}</BlockVector>"
        return self.item("CaptionDataClipTrackItem", f"i{n}", start, end, "", vector, "DataClipTrackItem")

    def recording(self, n: int, start: int, end: int, file: str, source_in: int, values: list[float]) -> str:
        media = self.add("Media", f"media-{n}", f"<FilePath>x</FilePath><ActualMediaFilePath>{escape(file)}</ActualMediaFilePath>", "ObjectUID")
        source = self.add("VideoMediaSource", f"s{n}", f"<MediaSource>{self.refs('Media', [media], 'ObjectURef')}</MediaSource>")
        points = f"<OutPoint>{(source_in + end - start) * TICK}</OutPoint>" + (f"<InPoint>{source_in * TICK}</InPoint>" if source_in else "")
        clip = self.add("VideoClip", f"v{n}", f'<Clip><Source ObjectRef="{source}"/>{points}</Clip>')
        sub = self.add("SubClip", f"u{n}", f'<Clip ObjectRef="{clip}"/>')
        inside = f'<SubClip ObjectRef="{sub}"/>'
        if values:
            frames = "".join(f"{k * TICK},{v},0,0;" for k, v in enumerate(values[1:]))
            scale = self.add("VideoComponentParam", f"k{n}", f"<ParameterID>{P.SCALE_PARAMETER}</ParameterID><StartKeyframe>-9,{values[0]},0</StartKeyframe><Keyframes>{frames}</Keyframes>")
            even = self.add("VideoComponentParam", f"e{n}", "<ParameterID>4</ParameterID><StartKeyframe>-9,true,0</StartKeyframe>")
            motion = self.add("VideoFilterComponent", f"f{n}", f"<Component><Params>{self.refs('Param', [even, scale])}</Params></Component><MatchName>{P.MOTION}</MatchName>")
            chain = self.add("VideoComponentChain", f"h{n}", f"<ComponentChain><Components>{self.refs('Component', [motion])}</Components></ComponentChain>")
            inside += f'<ComponentOwner><Components ObjectRef="{chain}"/></ComponentOwner>'
        return self.item("VideoClipTrackItem", f"r{n}", start, end, inside)

    def sound(self, n: str, start: int, end: int) -> str:
        return self.item("AudioClipTrackItem", f"a{n}", start, end, "")

    def sequence(self, name: str, groups: list[tuple[str, list[list[str]], str]], export: dict | None = None) -> None:
        """groups: kind (Video, Data or Audio), the items of each track, what else the group has."""
        found = []
        for g, (kind, tracks, more) in enumerate(groups):
            names = []
            for t, items in enumerate(tracks):
                listed = f"<ClipTrack><ClipItems><TrackItems>{self.refs('TrackItem', items)}</TrackItems></ClipItems></ClipTrack>"
                names.append(self.add(f"{kind}ClipTrack", f"{name}-{g}-{t}", f"<Data>{listed}</Data>" if kind == "Data" else listed, "ObjectUID"))
            found.append(self.add(f"{kind}TrackGroup", f"{name}-{g}", f"<TrackGroup><Tracks>{self.refs('Track', names, 'ObjectURef')}</Tracks></TrackGroup>{more}"))
        said = f"<Node><Properties><{P.EXPORT}>{escape(json.dumps(export))}</{P.EXPORT}></Properties></Node>" if export else ""
        listed = "".join(f'<TrackGroup Index="{i}"><First>x</First><Second ObjectRef={quoteattr(x)}/></TrackGroup>' for i, x in enumerate(found))
        self.add("Sequence", f"seq-{name}", f"{said}<Name>{escape(name)}</Name><TrackGroups>{listed}</TrackGroups>", "ObjectUID")

    def bytes(self) -> bytes:
        return gzip.compress(f'<?xml version="1.0" encoding="UTF-8"?><PremiereData Version="3">{"".join(self.objects)}</PremiereData>'.encode(), mtime=0)


def project_of(media: int, rows: list[tuple[int, str, int, int, str]]) -> bytes:
    """A recording's segments (number, track, start, end, text) as a project.

    Segments are captions on a track of their role, every fifth with the same text; on the film's track every third begins
    400 ms early. A fourth of the projects has caption tracks instead of graphics. Under them lies the recording, zoomed
    by segment, and sound that is a second longer. Two of three were exported, without the first five seconds.
    """
    file = ProjectFile()
    shown = [(n, track, max(0, start - 400) if track == "film" and n % 3 == 0 else start, end, f"again {media}" if n % 5 == 4 else text) for n, track, start, end, text in rows]
    make, kind = (file.caption, "Data") if media % 4 == 3 else (file.graphic, "Video")
    tracks = [[make(n, start, end, text) for n, track, start, end, text in shown if track == which] for which in ("mic", "film")]
    pieces = [file.recording(n, start, end, f"/rec/{media}.MP4", start // 2, [100.0, 100.0 + n % 3 * 20, 90.0][: n % 4]) for n, _, start, end, _ in rows]
    last = max(end for _, _, _, end, _ in rows)
    groups = [("Video", [pieces] if kind == "Data" else [*tracks, pieces], "<FrameRect>0,0,1080,1920</FrameRect>" if media % 2 else "")]
    groups += [("Data", tracks, "")] if kind == "Data" else []
    groups.append(("Audio", [[file.sound("0", 0, last + 1000)]], ""))
    export = {"OutPath": f"/out/{media}.mp4", "InPoint": str(5000 * TICK)} | ({"OutPoint": str((last - 2000) * TICK)} if media % 2 else {})
    file.sequence(f"conv {media}", groups, None if media % 3 == 0 else export)
    return file.bytes()


def project_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    segments = V.segments(V.words(spark, sf_dir)).select("media_id", "segment_id", "track", "start_ms", "end_ms", "text")
    write = lambda rows: [(str(rows[0][0]), project_of(rows[0][0], [r[1:] for r in rows]))]
    files = in_groups(segments, ["media_id"], ["segment_id"], write, "path string, content binary")
    return V.settled(project_nodes(V.settled(files)))


#: The objects of the projects and who names whom; what a text layer holds, empty where an earlier one has the same.
GRAPH = """
sg AS (
  SELECT media_id, segment_id AS n, CASE WHEN track = 'mic' THEN 1 ELSE 2 END AS tr, CASE WHEN track = 'film' AND segment_id % 3 = 0 THEN greatest(0, start_ms - 400) ELSE start_ms END AS s, end_ms AS e,
         CASE WHEN segment_id % 5 = 4 THEN 'again ' || media_id ELSE text END AS text, media_id % 4 = 3 AS data FROM segs
), link AS (
  SELECT DISTINCT media_id, 'sequence' AS obj, 'Second' AS place, 0::BIGINT AS ord, 'group' AS target FROM sg
  UNION ALL SELECT DISTINCT media_id, 'group', 'Track', tr, 'track' || tr FROM sg
  UNION ALL SELECT media_id, 'track' || tr, 'TrackItem', n, 'item' || n FROM sg
  UNION ALL SELECT media_id, 'item' || n, 'Components', 0, 'chain' || n FROM sg WHERE NOT data
  UNION ALL SELECT media_id, 'chain' || n, 'Component', 1, 'layer' || n FROM sg WHERE NOT data
  UNION ALL SELECT media_id, 'layer' || n, 'Param', 1, 'text' || n FROM sg WHERE NOT data
  UNION ALL SELECT media_id, 'item' || n, 'Block', 0, 'text' || n FROM sg WHERE data
), held AS (
  SELECT media_id, 'text' || n AS obj, md5(text) AS hash, CASE WHEN row_number() OVER (PARTITION BY media_id, text ORDER BY tr, n) = 1 THEN text END AS body FROM sg
), reach AS (
  SELECT DISTINCT media_id, 'sequence' AS obj, 0::BIGINT AS tr, '' AS item FROM sg
  UNION ALL
  SELECT r.media_id, l.target, CASE WHEN l.place = 'Track' THEN l.ord ELSE r.tr END, CASE WHEN l.place = 'TrackItem' THEN l.target ELSE r.item END FROM reach r JOIN link l ON l.media_id = r.media_id AND l.obj = r.obj
), texts AS (
  SELECT r.media_id, r.tr, r.item, f.body AS text
  FROM reach r JOIN held h USING (media_id, obj) JOIN held f ON f.media_id = h.media_id AND f.hash = h.hash AND f.body IS NOT NULL
), clips AS (
  SELECT t.*, s / 1000 AS start, e / 1000 AS "end", count(*) OVER (PARTITION BY t.media_id, t.tr) AS size FROM texts t JOIN sg ON sg.media_id = t.media_id AND t.item = 'item' || n
), chosen AS (
  SELECT * FROM clips c WHERE NOT EXISTS (SELECT 1 FROM clips o WHERE o.media_id = c.media_id AND (-o.size, o.tr) < (-c.size, c.tr) AND o.start < c."end" - 0.001 AND c.start < o."end" - 0.001)
)"""


@query(f"""WITH RECURSIVE {WORDS_SQL}, {GRAPH}, x AS (
  SELECT media_id, CASE WHEN media_id % 3 > 0 THEN 5.0 ELSE 0 END AS first, CASE WHEN media_id % 3 > 0 AND media_id % 2 = 1 THEN (max(end_ms) - 2000) / 1000 END AS last FROM segs GROUP BY media_id
)
SELECT media_id::VARCHAR AS path, 'conv ' || media_id AS name, tr::INTEGER AS track, start, "end", text,
       CASE WHEN "end" > first AND (last IS NULL OR start < last) THEN round(greatest(start, first) - first, 3) END AS final_start,
       CASE WHEN "end" > first AND (last IS NULL OR start < last) THEN round(least("end", coalesce(last, "end")) - first, 3) END AS final_end
FROM chosen JOIN x USING (media_id)""")
def project_captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captions of the sequences of all projects, in the sequence's and in the export's time."""
    return P.project_cards(project_table(spark, sf_dir), whole=True).drop("sequence")


@query(f"""WITH {WORDS_SQL}, l AS (SELECT media_id, max(end_ms) + 1000 AS last FROM segs GROUP BY media_id)
SELECT media_id::VARCHAR AS path, 'conv ' || media_id AS name, media_id % 2 = 1 AS vertical, last / 1000 AS duration, (CASE WHEN media_id % 4 = 3 THEN 1 ELSE 3 END)::INTEGER AS track,
       start_ms / 1000 AS start, end_ms / 1000 AS "end", '/rec/' || media_id || '.MP4' AS source, (start_ms // 2) / 1000 AS source_in, (start_ms // 2 + end_ms - start_ms) / 1000 AS source_out,
       list_max(([100.0::DOUBLE, 100 + segment_id % 3 * 20, 90])[1:segment_id % 4]) AS scale
FROM segs JOIN l USING (media_id)""")
def project_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of recordings in the sequences of all projects, with their zoom."""
    return P.video_edits(project_table(spark, sf_dir)).drop("sequence")
