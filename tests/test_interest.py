"""Scores kept by content in versions: what is asked, what is committed, what a broken write leaves."""

import json

import pytest
from pyspark.sql import functions as F

from chronoloom.operators import interest as I
from chronoloom.operators.hooks import stub
from chronoloom.sources.versions import VersionedTable

PHRASES = "media_id long, phrase long, start_ms long, end_ms long, text string"


def phrases(spark, texts):
    """Recordings of phrases of a second each."""
    return spark.createDataFrame([(m, k, k * 1000, k * 1000 + 900, t) for m, ts in texts.items() for k, t in enumerate(ts)], PHRASES)


@pytest.fixture
def kept(spark, tmp_path):
    return VersionedTable(spark, f"file://{tmp_path}/scores", I.KEPT)


def scored(df, kept, model="m", ask=stub):
    return {(r.media_id, r.phrase): (r.score, r.asked, r.unanswered) for r in I.interest(df, kept, model, ask, 4000, 1000).collect()}


def test_only_changed_windows_are_asked_again(spark, kept):
    texts = {1: [f"a{k}" for k in range(8)], 2: ["b0", "b1"]}
    first = scored(phrases(spark, texts), kept)
    assert {v[1] > 0 for v in first.values()} == {True} and kept.versions() == [1]
    assert scored(phrases(spark, texts), kept) == {k: (s, 0, 0) for k, (s, _, _) in first.items()} and kept.versions() == [1]
    texts[1][7] = "changed"
    again = scored(phrases(spark, texts), kept)
    assert {k for k, v in again.items() if v[1]} == {(1, 6), (1, 7)} and kept.versions() == [1, 2]  # the last window: from 6 s on
    texts[3] = texts[2]  # the same content in another recording isn't asked
    assert scored(phrases(spark, texts), kept)[3, 0] == (again[2, 0][0], 0, 0) and kept.versions() == [1, 2]
    assert scored(phrases(spark, {2: texts[2]}), kept, "other model")[2, 0][1] == 1 and kept.versions() == [1, 2, 3]


def test_what_isnt_answered_is_neutral_and_asked_again(spark, kept):
    df = phrases(spark, {1: ["a", "b"], 2: ["c"]})

    def half(prompt, t):
        return stub(prompt, t) if " c" in prompt else "no"

    got = scored(df, kept, ask=half)
    assert got[1, 0] == (I.NEUTRAL, 1, 1) and got[2, 0][2] == 0
    later = scored(df, kept)
    assert later[1, 0][1:] == (1, 0) and later[2, 0][1:] == (0, 0)


def test_notes(spark):
    ids = [f"F{k}" for k in range(10)]
    answer = lambda notes: json.dumps({"scores": notes})
    assert I.valid_notes(answer({i: 3 for i in ids} | {"Z": 1}), ids) == {i: 3.0 for i in ids}
    assert len(I.valid_notes(answer({i: 2.5 for i in ids} | {"F0": True}), ids)) == 9
    for bad in (answer({i: 3 for i in ids[:8]}), answer({i: 11 for i in ids}), "[]", "words", '{"notes": 1}'):
        with pytest.raises(ValueError):
            I.valid_notes(bad, ids)


def test_a_broken_write_leaves_the_last_version(spark, kept):
    rows = spark.createDataFrame([("h", "m", 0, 1.0)], I.KEPT)
    assert kept.read().count() == 0 and kept.versions() == []
    assert kept.write(rows) == 1
    with pytest.raises(Exception, match="broken"):
        kept.write(rows.withColumn("hash", F.when(F.raise_error(F.lit("broken")).isNull(), "x")))
    assert kept.versions() == [1] and [r.hash for r in kept.read().collect()] == ["h"]
    assert kept.write(kept.read().union(rows)) == 3 and kept.read().count() == 2 and kept.read(1).count() == 1
    with pytest.raises(ValueError):
        kept.read(2)


def test_contents_of_two_recordings_are_asked_as_the_first_window_has_them(spark, duck, tmp_path):
    """The second half of an even recording is all of an odd one that comes later, with other numbers of phrases."""
    from chronoloom.plans.metrics import SQL, Q
    from tests.conftest import spark_rows

    texts = {n: " ".join(f"{n}{'abcdefghij'[k // 10]}{'abcdefghij'[k % 10]}x." for k in range(30)) for n in ("q", "r", "s", "t", "u", "v")}
    talk = [(2, k, "user", t) for k, t in enumerate(texts.values())]
    words_ms = [120 + 40 * len(w) + 900 for t in texts.values() for w in t.split()]
    skipped = next(n for n in range(1, len(words_ms)) if sum(words_ms[:n]) >= 27_000)  # the second window begins at this word
    rest = [w for t in texts.values() for w in t.split()][skipped:]
    lasts = next(n for n in range(1, len(rest)) if sum(words_ms[:skipped + n]) >= 57_000)
    talk += [(5, 0, "user", " ".join(rest[:lasts]))]
    spark.createDataFrame(talk, "conv_id long, turn int, role string, text string").coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    assert spark_rows(Q["interest_scores"](spark, str(tmp_path))) == duck(SQL["interest_scores"], str(tmp_path))
