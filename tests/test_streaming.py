"""Task events folded as a stream: rules of the fold, many batches, going on after a stop."""

import random

import pytest

from chronoloom.streaming import tasks as T

EVENTS = (
    "task long, event_id long, event string, status string, stage string, message string, progress double, output_path string, language string, "
    "processed long, total long, lang string, error string, code long"
)
COLUMNS = [c.split()[0] for c in EVENTS.split(", ")]


def event(n, kind, task=1, **more):
    return tuple(({"task": task, "event_id": n, "event": kind} | more).get(c) for c in COLUMNS)


def plain(events):
    """States by task, event by event."""
    states = {}
    for row in sorted(events, key=lambda r: r[1]):
        e = dict(zip(COLUMNS, row, strict=True))
        states[e["task"]] = T.folded(states.get(e["task"], T.EMPTY), e)
    return states


@pytest.mark.parametrize(
    ("events", "want"),
    [
        ([event(1, "status", status="processing", stage="a", progress=10.0), event(2, "status", status="processing", stage="b")], {"status": "processing", "stage": "b", "progress": 10.0}),
        ([event(1, "log", processed=3, output_path="/o"), event(2, "log")], {"status": "queued", "processed": 3, "output_path": "/o"}),
        ([event(1, "translation-done", lang="zh", output_path="/z", message="m"), event(2, "translation-error", lang="en", message="no"), event(3, "translation-done", lang="zh", output_path="/y")],
         {"translated": '{"zh": "/y"}', "failed": '{"en": "no"}', "output_path": None, "message": "no"}),
        ([event(1, "done", message="fine"), event(2, "exit", code=1)], {"status": "completed", "message": "fine"}),
        ([event(1, "error", message="bad"), event(2, "exit", code=0)], {"status": "error", "error": "bad"}),
        ([event(1, "error"), event(2, "exit", code=0)], {"status": "error", "error": None}),
        ([event(1, "exit", code=0)], {"status": "completed", "message": T.DONE}),
        ([event(1, "exit", code=9)], {"status": "error", "error": "exit code 9"}),
        ([event(1, "cancel"), event(2, "done", message="fine"), event(3, "exit", code=0)], {"status": "cancelled", "message": T.CANCELLED}),
    ],
)
def test_rules_of_the_fold(events, want):
    state = plain(events)[1]
    assert {k: state[k] for k in want} == want and state["events"] == len(events)


def some_events(seed, n):
    rng = random.Random(seed)
    text = lambda: rng.choice([None, "a", "é", ""])
    kinds = ["status", "log", "translation-done", "translation-error", "done", "error", "cancel", "exit"]
    return [
        event(k, rng.choices(kinds, [9, 5, 3, 3, 1, 1, 0.2, 1])[0], rng.randrange(6), status=rng.choice(["processing", "preparing"]), stage=text(), message=text(), progress=rng.choice([None, 5.0, 99.5]),
              output_path=text(), processed=rng.choice([None, k]), total=rng.choice([None, 7]), lang=rng.choice(["zh", "en", None]), error=text(), code=rng.choice([None, 0, 3]))
        for k in range(n)
    ]


def test_batches_and_a_restart_give_the_plain_states(spark, tmp_path):
    events = some_events(3, 240)
    source, path, checkpoint = (str(tmp_path / x) for x in ("events", "states", "checkpoint"))
    for k in range(4):  # a batch each, and the stream is started anew
        spark.createDataFrame(events[60 * k : 60 * k + 60], EVENTS).coalesce(1).write.mode("append").parquet(source)
        T.fold_to_table(spark.readStream.schema(EVENTS).parquet(source), path, checkpoint)
    T.fold_to_table(spark.readStream.schema(EVENTS).parquet(source), path, checkpoint)  # nothing new
    rows = {r.task: r.asDict() for r in T.latest_states(spark, path).collect()}
    want = plain(events)
    assert set(rows) == set(want)
    for task, state in want.items():
        import json

        got = rows[task]
        assert got | {"translated": None, "failed": None} == {"task": task} | state | {"translated": None, "failed": None}
        assert got["translated"] == json.loads(state["translated"]) and got["failed"] == json.loads(state["failed"])


def test_lines_become_events(spark):
    lines = ['{"event": "status", "status": "processing", "progress": 12.5, "processedSegments": 3}', "plain words", '{"no": 1}', '{"event": "translation-done", "targetLang": "zh", "outputPath": "/z"}', ""]
    got = T.parsed_lines(spark.createDataFrame([(x,) for x in lines], "value string")).collect()
    assert [(r.event, r.status, r.progress, r.processed, r.lang, r.output_path) for r in got] == [
        ("status", "processing", 12.5, 3, None, None), ("log", None, None, None, None, None), ("log", None, None, None, None, None), ("translation-done", None, None, None, "zh", "/z"), ("log", None, None, None, None, None),
    ]
    assert got[1].message == "plain words"


def test_maps_as_text(spark):
    df = spark.createDataFrame([({"zh": "b", "en": "a"},), ({},)], "m map<string,string>")
    assert [r.t for r in df.select(T.pairs(df.m).alias("t")).collect()] == ["en=a;zh=b", ""]
