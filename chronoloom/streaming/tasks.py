"""Job events as a stream, folded into one state per task and kept in a written table."""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: What is known of a task: of its last event, its outputs by language (JSON), and how it was asked to end or ended.
STATE = (
    "status string, stage string, message string, progress double, output_path string, language string, processed long, total long, "
    "translated string, failed string, ended string, error string, cancelled boolean, events long, last_event long"
)
EVENT = "event string, status string, stage string, message string, progress double, outputPath string, detectedLanguage string, processedSegments long, totalSegments long, targetLang string, error string, code long"
#: What a job says that ends well without a word (a fixed value).
DONE, CANCELLED = "Transcricao concluida.", "Processo cancelado pelo usuario."
NAMES = [c.split()[0] for c in STATE.split(", ")]


def parsed_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """JSON lines as events; a line that is no object with an `event` counts as a message of the log."""
    e = F.from_json(column, EVENT)
    parsed = lines.select("*", e.alias("e"))
    return parsed.select(
        *lines.columns, F.coalesce("e.event", F.lit("log")).alias("event"), "e.status", "e.stage", F.coalesce("e.message", column).alias("message"), "e.progress",
        F.col("e.outputPath").alias("output_path"), F.col("e.detectedLanguage").alias("language"), F.col("e.processedSegments").alias("processed"),
        F.col("e.totalSegments").alias("total"), F.col("e.targetLang").alias("lang"), "e.error", "e.code",
    )


def known(value: Any) -> Any:
    """None for what pandas holds as missing."""
    return None if value is None or (not isinstance(value, str) and pd.isna(value)) else value


def folded(state: dict[str, Any], e: dict[str, Any]) -> dict[str, Any]:
    """A task's state after one more event.

    Events on a translation only add to the outputs or failures by language. All others bring what they know of segments, output and
    language, and what isn't said stays. Status events set status and stage; done and error are kept until the job exits. Then a cancelled job
    is cancelled; else its last done or error event counts, else an exit code of 0, else the exit is an error.
    """
    s = dict(state)
    s["events"], s["last_event"] = s["events"] + 1, int(e["event_id"])
    s["message"] = e["message"] if e["message"] is not None else s["message"]
    kind = e["event"]
    if kind in ("translation-done", "translation-error"):
        place, value = ("translated", e["output_path"] or "") if kind == "translation-done" else ("failed", e["error"] if e["error"] is not None else e["message"])
        s[place] = json.dumps(json.loads(s[place]) | {e["lang"] or "": value}, ensure_ascii=False, sort_keys=True)
        s["stage"] = e["stage"] if e["stage"] is not None else s["stage"]
        return s
    for c in ("output_path", "language", "processed", "total"):
        s[c] = e[c] if e[c] is not None else s[c]
    if kind == "status":
        s["status"], s["stage"] = e["status"], e["stage"]
        s["progress"] = e["progress"] if e["progress"] is not None else s["progress"]
    elif kind in ("done", "error"):
        s["ended"], s["error"] = kind, (e["error"] if e["error"] is not None else e["message"]) if kind == "error" else None
    elif kind == "cancel":
        s["cancelled"] = True
    elif kind == "exit":
        if s["cancelled"]:
            s["status"], s["message"] = "cancelled", CANCELLED
        elif s["ended"] == "done" or s["ended"] is None and e["code"] == 0:
            s["status"], s["message"] = "completed", s["message"] or DONE
        else:
            s["status"], s["error"] = "error", s["error"] if s["ended"] else f"exit code {e['code']}"
    return s


EMPTY = dict.fromkeys(NAMES) | {"status": "queued", "translated": "{}", "failed": "{}", "cancelled": False, "events": 0, "last_event": -1}


def _fold(key: tuple[Any, ...], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    now = dict(zip(NAMES, state.get, strict=True)) if state.exists else EMPTY
    now = {c: known(v) for c, v in now.items()}
    for row in pd.concat(list(batches)).sort_values("event_id").to_dict("records"):
        e = {c: known(v) for c, v in row.items()}
        now = folded(now, e | {c: int(e[c]) for c in ("processed", "total", "code") if e[c] is not None})
    state.update(tuple(now[c] for c in NAMES))
    yield pd.DataFrame({"task": [key[0]]} | {c: pd.Series([now[c]], dtype=object) for c in NAMES})


def task_states(events: DataFrame) -> DataFrame:
    """A stream of events (task, event_id, event, and the columns of `parsed_lines`) to each task's state after each batch.

    Events of a batch are taken in order of event_id, batches as they arrive; none is late, so there is no watermark, and state lasts.
    """
    return events.groupBy("task").applyInPandasWithState(_fold, f"task long, {STATE}", STATE, "update", GroupStateTimeout.NoTimeout)


def fold_to_table(events: DataFrame, path: str, checkpoint: str) -> None:
    """Folds what the stream has by now; each batch's changed states go to a folder of `path` named by the batch.

    The driver gets no rows. A batch that is run again after a failure replaces its own folder, so each counts once; another call with the
    same checkpoint goes on where this one ended.
    """

    def write(states: DataFrame, batch: int) -> None:
        states.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    query = task_states(events).writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()


def latest_states(spark: SparkSession, path: str) -> DataFrame:
    """The last state of each task in a table of `fold_to_table`, outputs and failures as maps."""
    rows = spark.read.schema(f"task long, {STATE}, batch long").parquet(path)
    last = rows.groupBy("task").agg(F.max_by(F.struct(*NAMES), "batch").alias("s")).select("task", "s.*")
    as_map = lambda c: F.from_json(c, "map<string,string>").alias(c)
    return last.select("task", *[as_map(c) if c in ("translated", "failed") else F.col(c) for c in NAMES])


def pairs(outputs: Column) -> Column:
    """A map as text, in order of its keys: `key=value;...`."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(outputs)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
