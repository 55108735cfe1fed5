"""Places for outside models (speech, translation, judging): a row scorer with retries, and a stub that needs nothing."""

from __future__ import annotations

import contextlib
import hashlib
import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Temperatures of the attempts (fixed values).
ATTEMPTS = (0.0, 0.4, 0.7)
Ask = Callable[[str, float], str]


def stub(prompt: str, temperature: float) -> str:
    """A score from 0 to 10 for each id named in the prompt's last line, by a hash."""
    ids = json.loads(prompt.rsplit("\n", 1)[-1])
    return json.dumps({"scores": {i: hashlib.md5(str(i).encode()).digest()[0] % 11 for i in ids}})


def json_in(answer: str):
    """The JSON value of an answer, which may stand in a code fence or between other words; a ValueError without any."""
    bare = re.sub(r"^```[a-zA-Z]*\s*|\s*```$", "", answer.strip())
    spans = [bare, bare[min((i for i in map(bare.find, "{[") if i >= 0), default=0) : max(map(bare.rfind, "}]")) + 1]]
    for text in spans:
        with contextlib.suppress(json.JSONDecodeError):
            return json.loads(text)
    raise ValueError(f"no JSON in {answer[:200]!r}")


def valid_scores(answer: str, ids: list[str]) -> dict[str, int]:
    """The scores of an answer; an error says what's wrong with it."""
    scores = json_in(answer)["scores"]
    if unknown := set(scores) - set(ids):
        raise ValueError(f"unknown ids {sorted(unknown)}")
    if missing := set(ids) - set(scores):
        raise ValueError(f"no score for {sorted(missing)}")
    if bad := [i for i, s in scores.items() if type(s) is not int or not 0 <= s <= 10]:
        raise ValueError(f"not whole scores from 0 to 10: {bad}")
    return scores


def judged(windows: DataFrame, ask: Ask = stub) -> DataFrame:
    """(media_id, window, ids array<string>, text) to (media_id, id, score, failed): three attempts a window, each told of the last error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for w in batch.itertuples(index=False):
                ids, problem, scores = list(w.ids), "", None
                for t in ATTEMPTS:
                    try:
                        scores = valid_scores(ask(f"{w.text}\n{problem}\n{json.dumps(ids)}", t), ids)
                        break
                    except (ValueError, KeyError, TypeError) as e:
                        problem = f"Your last answer was wrong: {e}"
                rows += [(w.media_id, w.window, i, None if scores is None else float(scores[i]), scores is None) for i in ids]
            yield pd.DataFrame(rows, columns=["media_id", "window", "id", "score", "failed"])

    return windows.mapInPandas(run, "media_id long, window long, id string, score double, failed boolean")


def mean_scores(scores: DataFrame, neutral: float | None = None) -> DataFrame:
    """The mean of an id's scores over the windows that saw it; without any, `neutral`."""
    mean = F.avg("score")
    return scores.groupBy("media_id", "id").agg((F.coalesce(mean, F.lit(neutral)) if neutral is not None else mean).alias("score"), F.count_if("failed").alias("failures"))
