"""How interesting phrases are, by an outside model asked window by window, and never twice for the same content."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoloom.functions.text import short_clock
from chronoloom.operators.hooks import ATTEMPTS, Ask, json_in, stub
from chronoloom.operators.stats import score_windows
from chronoloom.sources.versions import VersionedTable

#: A window and its overlap (ms), the score of what isn't answered, and the share of a window's phrases that an answer must have.
WINDOW_MS, OVERLAP_MS, NEUTRAL, LEAST_ANSWERED = 300_000, 30_000, 5.0, 0.9
#: Scores kept by content: of a window's hash, a model and a place in the window.
KEPT = "hash string, model string, place int, score double"


def content_hash(texts: Column) -> Column:
    """SHA-1 of texts, a line each."""
    return F.sha1(F.array_join(texts, "\n").cast("binary"))


def valid_notes(answer: str, ids: list[str], least: float = LEAST_ANSWERED) -> dict[str, float]:
    """The scores of an answer that are numbers from 0 to 10 of ids asked for; an error if too few are."""
    notes = json_in(answer)
    notes = notes.get("scores") if isinstance(notes, dict) else None
    if not isinstance(notes, dict):
        raise ValueError("an answer without scores")
    valid = {k: float(v) for k, v in notes.items() if k in ids and type(v) in (int, float) and 0 <= v <= 10}
    if len(valid) < len(ids) * least:
        raise ValueError(f"{len(valid)} of {len(ids)} scores are valid")
    return valid


def windows_of(phrases: DataFrame, size: int = WINDOW_MS, overlap: int = OVERLAP_MS) -> DataFrame:
    """(media_id, win_start, hash, phrases) of phrases (media_id, phrase, start_ms, end_ms, text): those that begin in each window."""
    step = size - overlap
    spans = phrases.groupBy("media_id").agg(F.lit(0).cast("bigint").alias("span_start"), F.max("end_ms").alias("span_end"))
    windows = score_windows(spans, size, overlap).withColumn("b", F.expr(f"win_start DIV {step}"))
    reach = -(-size // step)  # windows that may hold a phrase, by steps before its own
    near = phrases.withColumn("b", F.explode(F.array(*[F.expr(f"start_ms DIV {step} - {k}") for k in range(reach)])))
    seen = near.join(windows, ["media_id", "b"]).filter("start_ms >= win_start AND start_ms < win_end")
    rows = F.array_sort(F.collect_list(F.struct("phrase", "start_ms", "text")))
    return seen.groupBy("media_id", "win_start").agg(rows.alias("phrases")).withColumn("hash", content_hash(F.transform("phrases", lambda p: p["text"])))


def asked(windows: DataFrame, model: str, ask: Ask = stub) -> DataFrame:
    """(hash, model, place, score) of windows (hash, phrases); three attempts each. A window without a valid answer gives nothing."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for w in batch.itertuples(index=False):
                ids = [f"F{p['phrase']}" for p in w.phrases]
                lines = [f"[{i}] {c} {p['text']}" for i, c, p in zip(ids, w.clocks, w.phrases, strict=True)]
                for t in ATTEMPTS:
                    try:
                        notes = valid_notes(ask("\n".join([*lines, json.dumps(ids)]), t), ids)
                    except ValueError:
                        continue
                    rows += [(w.hash, model, k, notes.get(i, NEUTRAL)) for k, i in enumerate(ids)]
                    break
            yield pd.DataFrame(rows, columns=["hash", "model", "place", "score"])

    clocked = windows.select("hash", "phrases", F.transform("phrases", lambda p: short_clock(p["start_ms"])).alias("clocks"))
    return clocked.mapInPandas(run, KEPT)


def first_of_content(windows: DataFrame) -> DataFrame:
    """(hash, phrases) of the first window of each content, by media_id and begin."""
    return windows.groupBy("hash").agg(F.min_by("phrases", F.struct("media_id", "win_start")).alias("phrases"))


def keep_scores(contents: DataFrame, kept: VersionedTable, model: str, ask: Ask = stub) -> None:
    """Asks about contents (hash, phrases) that this model hasn't scored before and commits the answers as a new version, if there are such."""
    open_ = contents.join(kept.read().filter(F.col("model") == model).select("hash").distinct(), "hash", "left_anti")
    if not open_.isEmpty():
        kept.write(kept.read().unionByName(asked(open_, model, ask)))


def interest(phrases: DataFrame, kept: VersionedTable, model: str, ask: Ask = stub, size: int = WINDOW_MS, overlap: int = OVERLAP_MS) -> DataFrame:
    """(media_id, phrase, score, asked, unanswered): the mean of a phrase's scores over the windows that saw it.

    Windows whose content this model has scored before are read from `kept`; the others are asked once per content, and what
    they answer is committed as a new version. asked: windows of the phrase that were asked now; unanswered: those without a valid answer, which
    count as `NEUTRAL`, aren't kept and so are asked again next time.
    """
    windows = windows_of(phrases, size, overlap)
    before = kept.versions()
    keep_scores(first_of_content(windows), kept, model, ask)
    scores = kept.read().filter(F.col("model") == model)
    old = kept.read(before[-1]).filter(F.col("model") == model).select("hash").distinct() if before else scores.select("hash").limit(0)
    seen = windows.join(old.withColumn("old", F.lit(True)), "hash", "left").select("media_id", "hash", "old", F.posexplode("phrases").alias("place", "p"))
    found = seen.join(scores.select("hash", "place", "score"), ["hash", "place"], "left")
    mean = F.avg(F.coalesce("score", F.lit(NEUTRAL)))
    return found.groupBy("media_id", F.col("p.phrase").alias("phrase")).agg(mean.alias("score"), F.count_if(F.col("old").isNull()).alias("asked"), F.count_if(F.col("score").isNull()).alias("unanswered"))
