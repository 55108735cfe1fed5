"""Cards and sentences by look-ahead rules that fold over a recording's words."""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronoloom.functions.text import WEAK_TRAILING_WORDS
from chronoloom.operators.align import token
from chronoloom.operators.groups import in_groups

WEAK = frozenset(WEAK_TRAILING_WORDS)
#: Words with which a sentence goes on (fixed values).
CONTINUATION = frozenset("ao aos com da das de do dos em na nas no nos para pela pelo por pra pro que sem à às".split())
#: Words at a card's end after which its sentence goes on, besides those (fixed values).
DANGLING = CONTINUATION | frozenset(
    "a aquela aquele as e essa esse esta este foi já mais mas meu minha muito não o os ou se seu sua toda todo tá tão um uma vai é".split()
)
HARD_STOPS, SOFT_STOPS = (".", "?", "!", "…"), (",", ";", ":")


@dataclass(frozen=True)
class Rule:
    """How many words a card takes and how long it stays; seconds."""

    target: int = 3
    least: int = 1
    most: int = 5
    most_fast: int = 6
    least_s: float = 0.45
    most_s: float = 2.0
    ideal_low: float = 0.8
    ideal_high: float = 1.4


SHORT = Rule()
LONG = Rule(8, 3, 14, 18, 1.0, 7.0, 2.5, 5.0)


def cost(rule: Rule, count: int, limit: int, left: int, seconds: float, weak: bool) -> float:
    total = 10.0 * abs(count - rule.target)
    if weak and left > count:
        total += 80
    if left - count == 1 and count < limit:
        total += 45
    if seconds > 0:
        if seconds < rule.least_s:
            total += 30 * (rule.least_s - seconds)
        if rule.ideal_low <= seconds <= rule.ideal_high:
            total -= 6
        elif seconds < rule.ideal_low:
            total += 8 * (rule.ideal_low - seconds)
        elif seconds <= rule.most_s:
            total += 8 * (seconds - rule.ideal_high)
        else:
            total += 40 + 60 * (seconds - rule.most_s)
    return total + 6 * max(0, count - rule.most)


@lru_cache(maxsize=100_000)
def is_weak(word: str) -> bool:
    return token(word) in WEAK


def group_sizes(words: list[tuple[str, float, float]], rule: Rule = SHORT) -> list[int]:
    """Sizes of the cards of a segment's words (word, start, end)."""
    sizes, at = [], 0
    while at < len(words):
        left = len(words) - at
        span = lambda k: max(0.0, words[at + k - 1][2] - words[at][1])  # noqa: B023, E731
        limit = min(rule.most, left)
        fast = min(rule.most_fast, left)
        if fast > limit and 0 < span(fast) <= rule.most_s:
            limit = fast
        weak = lambda k: is_weak(words[at + k - 1][0])  # noqa: B023, E731
        best = min(range(min(rule.least, limit), limit + 1), key=lambda k: (cost(rule, k, limit, left, span(k), weak(k)), k))  # noqa: B023
        while weak(best) and best < limit and best < left:
            best += 1
        if left - best == 1 and best < limit:
            best += 1
        sizes.append(best)
        at += best
    return sizes


def cards(words: DataFrame, rule: Rule = SHORT) -> DataFrame:
    """(media_id, segment_id, i, word, start_ms, end_ms) to cards; one group a recording's segment."""

    def cut(rows: list[tuple]) -> list[tuple]:
        out, at = [], 0
        for n, size in enumerate(group_sizes([(word, start / 1000, end / 1000) for _, _, _, word, start, end in rows], rule)):
            part = rows[at : at + size]
            out.append((*part[0][:2], n, part[0][2], part[-1][2], min(r[4] for r in part), max(r[5] for r in part), " ".join(r[3] for r in part)))
            at += size
        return out

    schema = "media_id long, segment_id long, card long, first long, last long, start_ms long, end_ms long, text string"
    return in_groups(words.select("media_id", "segment_id", "i", "word", "start_ms", "end_ms"), ["media_id", "segment_id"], ["i"], cut, schema)


def sentence_buckets(rows: list[tuple[str, float, float]], soft: int = 5, most: int = 14, hard: int = 24, most_s: float = 6.0, least_s: float = 1.2) -> list[list[int]]:
    """Cards (text, start, end) grouped to sentences: lists of their numbers.

    One pass with running counts, then one that joins sentences of under `least_s` to their neighbour of fewer words.
    """
    texts = [text.strip() for text, _, _ in rows]
    goes_on = [t.split(" ")[0].lower() in CONTINUATION for t in texts[1:]] + [False]
    dangles = [t.split(" ")[-1].lower() in DANGLING for t in texts]
    before = [0]  # words before each card
    for text, _, _ in rows:
        before.append(before[-1] + len(text.split()))
    cuts, first, comma = [], 0, -1  # first cards of the sentences after the first; where the open one begins; its last comma
    for n, (_, _, end) in enumerate(rows):
        said = before[n + 1] - before[first]
        if texts[n].endswith(HARD_STOPS) or texts[n].endswith(SOFT_STOPS) and said >= soft and not goes_on[n]:
            first, comma = n + 1, -1
        elif texts[n].endswith(SOFT_STOPS):
            comma = n
            continue
        elif said >= most or end - rows[first][1] >= most_s:
            if first <= comma < n:
                first = comma + 1
            elif not (goes_on[n] or dangles[n]) or said >= hard:
                first = n + 1
            comma = -1
        if first and (not cuts or cuts[-1] != first):
            cuts.append(first)
    edges = [0, *[c for c in cuts if c < len(rows)], len(rows)]
    waiting = [(a, b) for a, b in zip(edges, edges[1:], strict=False) if a < b][::-1]
    done: list[tuple[int, int]] = []
    while waiting:
        a, b = waiting.pop()
        if rows[b - 1][2] - rows[a][1] >= least_s or not (done or waiting):
            done.append((a, b))
            continue
        sides = [before[d] - before[c] for c, d in (*done[-1:], *waiting[-1:])]
        if done and (len(sides) == 1 or sides[0] <= sides[1]):
            done[-1] = (done[-1][0], b)
        else:
            waiting[-1] = (a, waiting[-1][1])
    return [list(range(a, b)) for a, b in done]


def sentences(cards_: DataFrame) -> DataFrame:
    """(media_id, i, start_ms, end_ms, text) to sentences, one group a recording."""

    def group(cards: list[tuple]) -> list[tuple]:
        rows = [(text, start / 1000, end / 1000) for _, _, start, end, text in cards]
        return [(*cards[b[0]][:1], n, cards[b[0]][1], cards[b[-1]][1], cards[b[0]][2], cards[b[-1]][3], " ".join(rows[k][0] for k in b)) for n, b in enumerate(sentence_buckets(rows))]

    schema = "media_id long, sentence long, first long, last long, start_ms long, end_ms long, text string"
    return in_groups(cards_.select("media_id", "i", "start_ms", "end_ms", "text"), ["media_id"], ["i"], group, schema)


def apply_timing(cards_: DataFrame, lead: int, hold: int, glue: int, least: int) -> DataFrame:
    """Cards (media_id, i, start_ms, end_ms) brought forward, held, glued over small gaps; they never overlap.

    A card never begins before an earlier one. One that is followed within `glue` ends where the next is
    brought forward to, else it's held; it lasts at least `least`, unless the next one begins.
    """
    order = W.partitionBy("media_id").orderBy("i")
    ahead = cards_.withColumn("__raw", F.greatest(F.lit(0), F.col("start_ms") - lead)).withColumn("__gap", F.lead("start_ms").over(order) - F.col("end_ms"))
    begun = ahead.withColumn("__next", F.lead("__raw").over(order)).withColumn("__begin", F.max("__raw").over(order.rowsBetween(W.unboundedPreceding, W.currentRow)))
    held = F.when(F.col("__gap").between(0, glue), F.col("__next")).otherwise(F.col("end_ms") + hold)
    ends = begun.withColumn("__end", F.greatest(held, F.col("__begin") + least)).withColumn("__next", F.lead("__begin").over(order))
    end = F.when(F.col("__next").isNull(), F.col("__end")).otherwise(F.greatest(F.least("__end", "__next"), "__begin"))
    return ends.withColumn("start_ms", F.col("__begin")).withColumn("end_ms", end).select(*[F.col(f.name).cast(f.dataType) for f in cards_.schema])
