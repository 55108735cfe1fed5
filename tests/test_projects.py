"""Projects as graphs of objects: references, repeated blobs, tracks, exports, edits; files that can't be read."""

import base64
import gzip
import re

import pytest
from pyspark.sql import functions as F

from chronoloom.operators import projects as P
from chronoloom.plans import projects as queries
from chronoloom.plans.projects import FONT, ProjectFile
from chronoloom.sources.projects import NODE, project_nodes, whole_blob_text
from tests.conftest import spark_rows

TICKS = 254_016_000


def nodes_of(spark, **files):
    rows = [(name, bytearray(f.bytes() if isinstance(f, ProjectFile) else f)) for name, f in files.items()]
    return project_nodes(spark.createDataFrame(rows, "path string, content binary"))


def cards(nodes, *columns):
    return sorted(tuple(r) for r in P.project_cards(nodes).select(*columns).collect())


def test_nodes_keep_places_and_names(spark):
    xml = b'<R><A ObjectID="1"><B ObjectRef="2">x<C/></B><B ObjectURef="u"/></A><A ObjectUID="u" ObjectID="2"><D BinaryHash="h"> y </D></A></R>'
    got = sorted(tuple(r) for r in nodes_of(spark, p=xml).select("object", "node", "tag", "xpath", "id", "uid", "ref", "uref", "hash", "text").collect())
    assert got == sorted([
        (0, 1, "A", "", "1", None, None, None, None, None), (0, 2, "B", "B", None, None, "2", None, None, "x"), (0, 3, "C", "B/C", None, None, None, None, None, None),
        (0, 4, "B", "B", None, None, None, "u", None, None), (1, 5, "A", "", "2", "u", None, None, None, None), (1, 6, "D", "D", None, None, None, None, "h", " y "),
    ])
    assert [c.split()[0] for c in NODE.split(", ")] == nodes_of(spark, p=xml).columns


def test_references_take_the_last_object_of_an_id(spark):
    xml = b'<R><A ObjectID="1"/><S ObjectID="9"><X ObjectRef="1"/><X ObjectRef="404"/><X ObjectURef="1"/></S><B ObjectID="1"/><C ObjectUID="1"/></R>'
    got = sorted((r.xpath, r.target, r.target_tag) for r in P.edges(P.read(nodes_of(spark, p=xml))).collect())
    assert got == [("X", 2, "B"), ("X", 3, "C")]


def test_graphics_of_a_sequence(spark):
    f = ProjectFile()
    first = [f.graphic(1, 0, 1500, "Bom dia,"), f.graphic(2, 1500, 3000, "a  todos\nhoje"), f.graphic(3, 9000, 9500, "Bom dia,")]
    title = [f.graphic(4, 1000, 2000, "Title over a caption"), f.graphic(5, 4000, 5000, "goes on")]
    plain = f.recording(6, 0, 9500, "/a.mp4", 0, [])
    f.sequence("One", [("Video", [[plain], title, first], ""), ("Data", [[f.caption(7, 0, 9000, "not read")]], "")])
    got = cards(nodes_of(spark, p=f), "name", "track", "start", "end", "text")
    assert got == [("One", 2, 4.0, 5.0, "goes on"), ("One", 3, 0.0, 1.5, "Bom dia,"), ("One", 3, 1.5, 3.0, "a todos hoje"), ("One", 3, 9.0, 9.5, "Bom dia,")]


def test_layers_of_a_graphic_join_and_style_samples_do_not_count(spark):
    f = ProjectFile()
    f.graphic(1, 0, 1000, "one")
    f.graphic(2, 0, 1000, "two")
    sample = f.add("ArbVideoComponentParam", "style", f.blob("StartKeyframeValue", "Aa"))
    f.add("StyleProjectItem", "s", f"<Component><Params>{f.refs('Param', [sample])}</Params></Component><MatchName>{P.TEXT}</MatchName>", "ObjectUID")
    both = f.add("VideoComponentChain", "both", f"<ComponentChain><Components>{f.refs('Component', ['x2', 'm1', 'x1', 'nowhere'])}</Components></ComponentChain>")
    item = f.item("VideoClipTrackItem", "item", 100, 200, f'<ComponentOwner><Components ObjectRef="{both}"/></ComponentOwner>')
    f.sequence("S", [("Video", [[item]], "")])
    assert cards(nodes_of(spark, p=f), "start", "text") == [(0.1, "two one")]


def test_caption_tracks_count_without_graphics(spark):
    f = ProjectFile()
    f.sequence("S", [("Video", [[f.recording(1, 0, 5000, "/a.mov", 0, [])]], ""), ("Data", [[f.caption(2, 0, 1000, "hi"), f.caption(3, 2000, 2500, "hi")]], "")])
    assert cards(nodes_of(spark, p=f), "track", "start", "end", "text") == [(1, 0.0, 1.0, "hi"), (1, 2.0, 2.5, "hi")]


def test_the_last_video_export_gives_the_final_time(spark):
    f = ProjectFile()
    items = [f.graphic(k, k * 2000, k * 2000 + 1500, f"t{k}") for k in range(5)]
    f.sequence("S", [("Video", [items], "")], {"OutPath": "/x/final.MP4", "InPoint": str(2500 * TICKS), "OutPoint": str(6500 * TICKS)})
    f.objects[-1] = f.objects[-1].replace("<Name>", f'<{P.EXPORT}>{{"OutPath": "/x/sound.mp3", "InPoint": 1}}</{P.EXPORT}><{P.EXPORT}>broken</{P.EXPORT}><Name>')
    got = cards(nodes_of(spark, p=f), "text", "final_start", "final_end")
    assert got == [("t0", None, None), ("t1", 0.0, 1.0), ("t2", 1.5, 3.0), ("t3", 3.5, 4.0), ("t4", None, None)]
    g = ProjectFile()
    g.sequence("S", [("Video", [[g.graphic(1, 1000, 2000, "t")]], "")], {"OutPath": "final.mkv", "InPoint": "-5"})
    assert cards(nodes_of(spark, p=g), "text", "final_start", "final_end") == [("t", 1.0, 2.0)]


def test_projects_do_not_mix(spark):
    made = {}
    for name in "ab":
        f = ProjectFile()
        f.sequence("S", [("Video", [[f.graphic(1, 0, 1000, f"text of {name}")]], "")])
        made[name] = f
    made["a"].objects = [x.replace("</StartKeyframeValue>", "</StartKeyframeValue>") for x in made["a"].objects]
    assert cards(nodes_of(spark, **made), "path", "text") == [("a", "text of a"), ("b", "text of b")]


@pytest.mark.parametrize("content", [b"", b"not xml", b"\x1f\x8bbroken", b"<R><A ObjectID='1'></R>"])
def test_files_that_cannot_be_read(spark, content):
    f = ProjectFile()
    f.sequence("S", [("Video", [[f.graphic(1, 0, 1000, "fine")]], "")])
    nodes = nodes_of(spark, good=f, bad=content, cut=f.bytes()[:-40])
    assert {r.path for r in nodes.filter("error IS NOT NULL").collect()} == {"bad", "cut"}
    assert cards(nodes, "path", "text") == [("good", "fine")]
    assert P.video_edits(nodes).count() == 0


def test_empty_and_null_files(spark):
    df = spark.createDataFrame([("p", None)], "path string, content binary")
    assert project_nodes(df).count() == 0 and P.project_cards(project_nodes(df)).count() == 0


def test_long_texts_of_a_blob_do_not_count(spark):
    f = ProjectFile()
    f.sequence("S", [("Video", [[f.graphic(1, 0, 1000, "x" * 2000), f.graphic(2, 1000, 2000, "x" * 2001)]], "")])
    assert [t for (t,) in cards(nodes_of(spark, p=f), "text")] == [FONT, "x" * 2000]


def test_edits_of_a_sequence(spark):
    f = ProjectFile()
    pieces = [f.recording(1, 0, 2000, "/rec/a.mp4", 500, [100.0]), f.recording(2, 2000, 3000, "\\\\?\\C:\\rec\\b.MOV", 0, [100.0, 130.0, 110.0]), f.recording(3, 3000, 4000, "/still.png", 0, [])]
    f.sequence("Tall", [("Video", [pieces, [f.graphic(4, 0, 9000, "text")]], "<FrameRect>0,0,1080,1920</FrameRect>"), ("Audio", [[f.sound("1", 0, 12_000)]], "")])
    f.sequence("Empty", [("Video", [[]], "")])
    nodes = nodes_of(spark, p=f)
    got = sorted(tuple(r) for r in P.video_edits(nodes).select("name", "vertical", "duration", "track", "start", "end", "source", "source_in", "source_out", "scale").collect())
    assert got == [("Tall", True, 12.0, 1, 0.0, 2.0, "/rec/a.mp4", 0.5, 2.5, 100.0), ("Tall", True, 12.0, 1, 2.0, 3.0, "C:\\rec\\b.MOV", 0.0, 1.0, 130.0)]


def test_keyframes(spark):
    df = spark.createDataFrame([("-9,100,0", None), ("-9,true,0", "1,50,0;2,x;;3,60.5,1"), (None, ""), ("7", "8")], "a string, b string")
    assert [r.v for r in df.select(P.keyframe_values(F.col("a"), F.col("b")).alias("v")).collect()] == [[100.0], [50.0, 60.5], [], []]


def test_imported_subtitles(spark):
    xml = b"<R><M ObjectUID='1'><FilePath>\\\\?\\C:\\a\\One.srt</FilePath></M><M ObjectUID='2'><FilePath>/b/One.SRT</FilePath></M><M ObjectUID='3'><X><FilePath>/c/two.srt</FilePath></X></M><M ObjectUID='4'><FilePath>/c/x.mp4</FilePath></M></R>"
    got = sorted((r.name, r.file) for r in P.imported_subtitles(nodes_of(spark, p=gzip.compress(xml))).collect())
    assert got == [("One", "C:\\a\\One.srt"), ("two", "/c/two.srt")]


def test_whole_texts_of_any_length_and_characters_and_none_for_what_cannot_be_read(spark):
    f = ProjectFile()
    assert all(whole_blob_text(base64.b64decode(ProjectFile().blob("A", "y" * n).split("\n")[1])) == "y" * n for n in range(1, 3000))
    texts = ["x" * 2000, "x" * 2001, "é" * 70_000, "no break​here", "a b \u0085", "\U0001f469‍\U0001f469", "z"]
    items = [f.graphic(k, 1000 * k, 1000 * k + 900, t) for k, t in enumerate(texts)]
    both = f.add("VideoComponentChain", "both", f"<ComponentChain><Components>{f.refs('Component', ['x0', 'x6'])}</Components></ComponentChain>")
    items.append(f.item("VideoClipTrackItem", "item", 8000, 8900, f'<ComponentOwner><Components ObjectRef="{both}"/></ComponentOwner>'))
    bad = base64.b64encode(b"\x0c\0\0\0\0\0\x06\0\5\0\0\0Arial\0\0\0\2\0\0\0\xff\xfe\0\0").decode()
    f.objects = [x if 'ObjectID="p6"' not in x else re.sub(r">\n.*\n<", f">{bad}<", x) for x in f.objects]
    f.sequence("S", [("Video", [items], "")])
    got = [tuple(r) for r in P.project_cards(nodes_of(spark, p=f), whole=True).orderBy("start").select("start", "text").collect()]
    assert got == [(float(k), t) for k, t in enumerate(texts[:6])] + [(6.0, None), (8.0, None)]


def test_the_query_shows_whole_texts(spark, duck, tmp_path):
    text = " ".join(["palavra"] * 300) + " zero​width"
    spark.createDataFrame([(m, t, "user", text if t else "curto") for m in (0, 3) for t in range(2)], "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = spark_rows(queries.project_captions(spark, str(tmp_path)))
    assert got == duck(queries.SQL["project_captions"], str(tmp_path)) and {r[got[0].index("text")] for r in got[1]} == {"curto", text}
