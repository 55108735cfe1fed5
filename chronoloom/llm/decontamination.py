"""Benchmark decontamination: an FM-index per training shard, searched for benchmark windows.

A benchmark item gives its windows of `WINDOW` consecutive words, or all its words as one window
if it has fewer. The distinct (window, item) pairs are read in blocks of at most `MAX_PAIRS`, so
what is broadcast has a bound; a larger benchmark takes more passes.

A task gathers its documents into training shards of about `SHARD_WORDS` words. Words become
numbers; a word that no window has can't be in an occurrence, so each run of such words, and
the end of a document, becomes one separator. The shard's suffix array is made by sorting with
doubled prefixes (separators are distinct, so suffixes differ within a run), and gives the
Burrows-Wheeler transform, kept as a wavelet matrix with rank counts, and a sample of its
positions. Backward search runs for all windows at once; occurrences are located by walking
back to a sampled position; their spans are merged in each document.

A document is in one shard, whole; documents don't move, nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import give_back, require, table, written

WINDOW = 10
SHARD_WORDS = 1 << 20
SAMPLE = 16
MAX_PAIRS = 200_000

#: Bytes of words: 0-9, a-z (A-Z made so) and all of 0x80 and above; others part words.
WORD_BYTES = bytes(b if 0x30 <= b < 0x3A or 0x61 <= b < 0x7B or b >= 0x80 else b + 32 if 0x41 <= b < 0x5B else 32 for b in range(256))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(data: bytes) -> list[bytes]:
    return data.translate(WORD_BYTES).split()


def words(text: Column) -> Column:
    lowered = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    return F.regexp_extract_all(lowered, F.lit(r"([^\x00-\x2F\x3A-\x60\x7B-\x7F]+)"), F.lit(1))


def windows(items: DataFrame, id_col: str = "item_id", text_col: str = "text", size: int = WINDOW) -> DataFrame:
    """Distinct (window, item): words joined by blanks, item id as text."""
    each = items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"), words(F.col(text_col)).alias("w")).filter(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - size + 1, F.lit(1)))
    return each.select("item", F.explode(F.transform(starts, lambda i: F.array_join(F.slice("w", i, F.lit(size)), " "))).alias("window")).distinct()


class FmIndex:
    """Of a sequence of numbers whose zeros are distinct separators; the last is a zero."""

    def __init__(self, text: np.ndarray, letters: int):
        self.bits = max(1, int(letters).bit_length())
        order = suffix_array(text)
        before = text[order - 1]  # of the first position the last symbol, a separator
        counts = np.bincount(text, minlength=letters + 2)
        self.less = np.concatenate(([0], np.cumsum(counts)))[: letters + 2].astype(np.int64)
        marked = (order % SAMPLE == 0) | (before == 0)
        self.marks = np.concatenate(([0], np.cumsum(marked))).astype(np.int32)
        self.places = order[marked].astype(np.int32)
        self.ones, self.zeros = [], []
        level = before.astype(np.int32)
        for b in reversed(range(self.bits)):
            bit = (level >> b & 1).astype(bool)
            self.ones.append(np.concatenate(([0], np.cumsum(bit, dtype=np.int32))).astype(np.int32))
            self.zeros.append(int(len(bit) - self.ones[-1][-1]))
            level = np.concatenate((level[~bit], level[bit]))
        symbols = np.arange(letters + 1)
        self.first = self._down(symbols, np.zeros(letters + 1, np.int64))
        self.length = len(text)

    def _down(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        for ones, zeros, b in zip(self.ones, self.zeros, reversed(range(self.bits)), strict=True):
            n = ones[at]
            at = np.where(symbols >> b & 1, zeros + n, at - n)
        return at

    def rank(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each place of the transform."""
        return self._down(symbols, at) - self.first[symbols]

    def back(self, at: np.ndarray) -> np.ndarray:
        """The rows of the suffixes that begin one symbol earlier."""
        symbols, low = np.zeros(len(at), np.int64), at
        for ones, zeros in zip(self.ones, self.zeros, strict=True):
            n = ones[low]
            bit = ones[low + 1] > n
            symbols = symbols << 1 | bit
            low = np.where(bit, zeros + n, low - n)
        return self.less[symbols] + low - self.first[symbols]

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows [low, high) of each pattern's occurrences. `patterns`: a row each, aligned to the right."""
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.length, np.int64)
        for step in range(patterns.shape[1]):
            on = np.flatnonzero((lengths > step) & (low < high))
            if not len(on):
                break
            c = patterns[on, -1 - step]
            low[on] = self.less[c] + self.rank(c, low[on])
            high[on] = self.less[c] + self.rank(c, high[on])
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The position of each row's suffix in the sequence."""
        out, steps = np.empty(len(rows), np.int64), np.zeros(len(rows), np.int64)
        open_, at = np.arange(len(rows)), rows
        while len(open_):
            n = self.marks[at]
            here = self.marks[at + 1] > n
            out[open_[here]] = self.places[n[here]] + steps[open_[here]]
            open_, at = open_[~here], at[~here]
            steps[open_] += 1
            at = self.back(at)
        return out


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Order of the suffixes; zeros rank by place, below all other symbols."""
    zero = text == 0
    n_zero = int(zero.sum())
    rank = np.where(zero, np.cumsum(zero) - 1, text.astype(np.int64) + n_zero)
    span, depth = int(rank.max()) + 1, 1
    key = rank
    while depth < min(4, len(text)) and float(span) ** (depth + 1) < 2.0**62:
        shifted = np.zeros_like(rank)
        shifted[: len(rank) - depth] = rank[depth:]
        key = key * span + shifted
        depth += 1
    order = np.argsort(key)
    rank, loose = _ranked(key[order], np.arange(len(text)))
    ranks = np.empty(len(text), np.int64)
    ranks[order] = rank
    while len(loose):
        some = order[loose]
        key = ranks[some] * len(text) + ranks[some + depth]
        sort = np.argsort(key)
        order[loose] = some = some[sort]
        rank, still = _ranked(key[sort], loose)
        ranks[some] = rank
        loose, depth = still, depth * 2
    return order


def _ranked(keys: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each sorted key's rank, the place of the first equal one; the places of keys that aren't alone."""
    new = np.concatenate(([True], keys[1:] != keys[:-1]))
    rank = np.maximum.accumulate(np.where(new, places, 0))
    alone = new & np.concatenate((new[1:], [True]))
    return rank, places[~alone]


class Matcher:
    """Windows as numbers; `search` finds them in a shard of documents."""

    def __init__(self, pairs: list[tuple[str, str]]):
        self.items: list[list[str]] = []
        number: dict[bytes, int] = {}
        split: list[list[int]] = []
        seen: dict[str, int] = {}
        for window, item in pairs:
            if window not in seen:
                seen[window] = len(split)
                split.append([number.setdefault(w, len(number) + 1) for w in window.encode().split(b" ")])
                self.items.append([])
            self.items[seen[window]].append(item)
        self.number = number
        self.lengths = np.array([len(s) for s in split], np.int64)
        self.patterns = np.zeros((len(split), int(self.lengths.max(initial=1))), np.int64)
        for i, s in enumerate(split):
            self.patterns[i, -len(s) :] = s

    def numbers(self, data: bytes) -> np.ndarray:
        found = words_of(data)
        return np.fromiter(map(self.number.get, found, repeat(0)), np.int32, len(found))

    def search(self, docs: list[np.ndarray]) -> tuple[list[int], list[list[tuple[int, int]]], list[list[str]]]:
        """For each document: words hit, merged spans [first, end) and items."""
        ends = np.cumsum([len(d) + 1 for d in docs])
        starts = np.concatenate(([0], ends[:-1]))
        every = np.zeros(int(ends[-1]), np.int32)
        for s, d in zip(starts, docs, strict=True):
            every[s : s + len(d)] = d
        keep = every != 0
        keep[1:] |= keep[:-1]
        keep[-1] = True
        place = np.flatnonzero(keep)
        hits, spans, items = [0] * len(docs), [[] for _ in docs], [[] for _ in docs]
        if not len(self.lengths) or len(place) < 2:
            return hits, spans, items
        index = FmIndex(every[place], len(self.number))
        low, high = index.search(self.patterns, self.lengths)
        count = np.maximum(high - low, 0)
        which = np.repeat(np.arange(len(count)), count)
        if not len(which):
            return hits, spans, items
        rows = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count) + low[which]
        first = place[index.locate(rows)]
        change = np.zeros(len(every) + 1, np.int32)
        np.add.at(change, first, 1)
        np.add.at(change, first + self.lengths[which], -1)
        covered = (np.cumsum(change) > 0).astype(np.int8)
        edges = np.flatnonzero(np.diff(covered, prepend=0, append=0))
        begin, end = edges[::2], edges[1::2]
        of = np.searchsorted(ends, begin, side="right")
        for d, b, e in zip(of.tolist(), (begin - starts[of]).tolist(), (end - starts[of]).tolist(), strict=True):
            hits[d] += e - b
            spans[d].append((b, e))
        pairs = np.unique(np.searchsorted(ends, first, side="right") * len(self.lengths) + which)
        found: dict[int, set[str]] = {}
        for d, w in zip((pairs // len(self.lengths)).tolist(), (pairs % len(self.lengths)).tolist(), strict=True):
            found.setdefault(d, set()).update(self.items[w])
        for d, names in found.items():
            items[d] = sorted(names)
        return hits, spans, items


def _passes(pairs: DataFrame, max_pairs: int) -> Iterator[tuple]:
    """The (window, item) pairs in broadcast blocks of about `max_pairs` at most, one at a time, and whether it's the last.

    The broadcast before is destroyed when the next one is asked for, so what uses it must have been written by then.
    """
    blocks = max(1, -(-pairs.count() // max_pairs))
    pairs = written(pairs, "benchmark-windows") if blocks > 1 else pairs
    for b in range(blocks):
        block = pairs.filter(F.pmod(F.xxhash64("window", "item"), F.lit(blocks)) == b).collect()
        shared = pairs.sparkSession.sparkContext.broadcast(sorted((r.window, r.item) for r in block))
        del block
        yield shared, b + 1 == blocks
        if b + 1 < blocks:
            shared.destroy()


def _shards(batches: Iterator[pa.RecordBatch], text_col: str, matcher: Matcher, shard_words: int) -> Iterator[tuple[list[pa.RecordBatch], list[np.ndarray]]]:
    """Rows, as parts of batches, and their words' numbers, shard by shard. A shard ends after the row that fills it."""
    rows, docs, size = [], [], 0
    for batch in batches:
        first = 0
        for i, text in enumerate(batch.column(batch.schema.get_field_index(text_col))):
            docs.append(matcher.numbers((text.as_py() or "").encode()))
            size += len(docs[-1]) + 1
            if size >= shard_words:
                yield [*rows, batch.slice(first, i + 1 - first)], docs
                rows, docs, size, first = [], [], 0, i + 1
        if first < batch.num_rows:
            rows.append(batch.slice(first))
    if docs:
        yield rows, docs


SPANS = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))


def _searcher(shared, shard_words: int, last: bool):
    """(id, text, spans, items) with what this pass finds added; the last pass leaves the text out."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(shared.value)
        for rows, docs in _shards(batches, "text", matcher, shard_words):
            _, spans, items = matcher.search(docs)
            at = 0
            for batch in rows:
                some = range(at, at + batch.num_rows)
                at += batch.num_rows
                old_spans, old_items = batch.column("spans").to_pylist(), batch.column("items").to_pylist()
                made = [
                    pa.array([len(docs[i]) for i in some], pa.int64()),
                    pa.array([joined_spans([*((s["first"], s["end"]) for s in old or []), *spans[i]]) for i, old in zip(some, old_spans, strict=True)], SPANS),
                    pa.array([sorted({*(old or []), *items[i]}) for i, old in zip(some, old_items, strict=True)], pa.list_(pa.string())),
                ]
                text = pa.nulls(batch.num_rows, pa.string()) if last else batch.column("text")
                yield pa.RecordBatch.from_arrays([batch.column("id"), text, *made], ["id", "text", "n_words", "spans", "items"])
        give_back()

    return search


def joined_spans(spans: list[tuple[int, int]]) -> list[dict[str, int]]:
    """Spans in order, without overlaps; spans that touch become one."""
    out: list[dict[str, int]] = []
    for first, end in sorted(spans):
        if out and first <= out[-1]["end"]:
            out[-1]["end"] = max(out[-1]["end"], end)
        else:
            out.append({"first": first, "end": end})
    return out


FOUND = "id {id}, text string, n_words long, spans array<struct<first: long, end: long>>, items array<string>"


def find_contamination(
    df: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    shard_words: int = SHARD_WORDS,
    max_pairs: int = MAX_PAIRS,
) -> DataFrame:
    """One row per row of `df`: id, n_words, n_hit, spans, items.

    spans: merged [first, end) in words of the text; n_hit: words inside; items: ids, as text and
    in its order, of the benchmark items that have a window in the text. Null and empty texts
    have no words. Items without words match nothing; a null item id is the empty text. Rows
    that repeat an id count each. Other columns don't matter. An empty benchmark finds nothing;
    an empty table gives an empty result.
    """
    require(df, id_col, text_col)
    require(benchmark, item_col, item_text_col)
    schema = FOUND.format(id=df.schema[id_col].dataType.simpleString())
    none = [F.lit(None).cast(t).alias(n) for n, t in (("spans", "array<struct<first: long, end: long>>"), ("items", "array<string>"))]
    found = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), *none)
    for block, last in _passes(windows(benchmark, item_col, item_text_col, window), max_pairs):
        found = found.select("id", "text", "spans", "items").mapInArrow(_searcher(block, shard_words, last), schema)
        found = found if last else written(found, "searched")
    hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["first"])
    return found.select(F.col("id").alias(id_col), "n_words", hit.alias("n_hit"), "spans", "items")


def _sieve(shared, shard_words: int, text_col: str):
    def sieve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(shared.value)
        for rows, docs in _shards(batches, text_col, matcher, shard_words):
            clean, at = np.array(matcher.search(docs)[0]) == 0, 0
            for batch in rows:
                yield batch.filter(pa.array(clean[at : at + batch.num_rows]))
                at += batch.num_rows
        give_back()

    return sieve


def remove_contaminated(
    df: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    shard_words: int = SHARD_WORDS,
    max_pairs: int = MAX_PAIRS,
) -> DataFrame:
    """The rows of `df` without a benchmark window in their text; columns stay as they are.

    Rows pass through the search in their own task, so texts aren't shuffled; a task holds one
    shard's rows. Null and empty texts stay; rows that repeat an id are judged each by its text. An empty
    benchmark leaves all rows, an empty table gives an empty result. A benchmark of several blocks is
    searched block by block, and what a block leaves is written before the next one is sent out.
    """
    require(df, text_col)
    for block, last in _passes(windows(benchmark, item_col, item_text_col, window), max_pairs):
        df = df.mapInArrow(_sieve(block, shard_words, text_col), df.schema)
        df = df if last else written(df, "sieved")
    return df


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_contamination(docs, table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


OP4_SQL = f"""
WITH b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') AS w FROM benchmark
), i AS (
  SELECT DISTINCT item_id, least(len(w), {WINDOW}) AS n, array_to_string(w[s:s + least(len(w), {WINDOW}) - 1], ' ') AS gram
  FROM (SELECT *, unnest(range(1, greatest(len(w) - {WINDOW} + 1, 1) + 1)) AS s FROM b WHERE len(w) > 0)
), d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') AS w FROM documents
), g AS (
  SELECT doc_id, s, n, array_to_string(w[s:s + n - 1], ' ') AS gram
  FROM (SELECT d.*, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, (SELECT DISTINCT n FROM i) WHERE len(w) >= n)
), h AS (
  SELECT g.doc_id, g.s, g.n, i.item_id FROM g JOIN i USING (n, gram)
), t AS (
  SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(s, s + n)) AS p FROM h) GROUP BY doc_id
), u AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM h) GROUP BY doc_id
)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN t USING (doc_id) LEFT JOIN u USING (doc_id)
"""
