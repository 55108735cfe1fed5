"""SimHash near-dedup: 64-bit fingerprints, multi-index hashing, connected components.

1. One pass over the texts makes a fingerprint per row. Equal fingerprints are one node, so copies cost
   nothing further; texts are read once and never move.
2. Two fingerprints within `RADIUS` = 3 bits differ in at most one bit of one of their two halves. Each
   half is a segment with a table of the fingerprints by the half's value. Probes enumerate the
   segment's Hamming ball of radius 1, of which the members with one more bit set are enough: of a pair that
   differs in a bit, the one without it finds the other. About 34 keys a fingerprint.
3. Probes and table entries of a key meet in a cell, which compares complete fingerprints and gives no
   pairs but a star for each of its connected groups, so a cell never gives more rows than it has.
4. Keys near a value that more than `HEAVY` fingerprints share are dense: near copies in great number. Their entries are
   told apart by the other half, again by multi-index hashing: it differs in at most one bit of one of its two quarters.
   A cell of a dense key holds fingerprints that agree but for two bits in 48 places, 2^16 x 33 x 17 at the
   very most; of those more than 3 bits apart at most some thousands can exist, so comparing them stays short.
5. Stars' connected components, and the smallest id of each.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import give_back, require, table, written
from .near_dedup import components

SHINGLE, RADIUS, SEED = 3, 3, 42
BITS, HALF, QUARTER = 64, 32, 16
#: Fingerprints with the same half from which on keys near it are dense. Other keys have at most 33 times as many entries.
HEAVY = 64
#: Bytes of a text whose words are held at once.
PIECE = 1 << 20
_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def pieces(text: bytes) -> Iterator[list[bytes]]:
    """The words in order, as many at a time as `PIECE` bytes have; a word isn't cut."""
    at = 0
    while at < len(text):
        space = _SPACE.search(text, at + PIECE)
        end = space.start() if space else len(text)
        yield text[at:end].lower().split()  # bytes: only ASCII letters and white space count
        at = end


def fingerprint(text: bytes) -> int:
    """Bit i is set if more than half of the shingles' hashes, repeats counted, have it set; 0 without words."""
    total, counts, tail = 0, np.zeros(BITS, np.int64), []
    for words in pieces(text):
        words = tail + words
        shingles = [xxhash.xxh64_intdigest(b" ".join(s), SEED) for s in zip(*(words[i:] for i in range(SHINGLE)), strict=False)]
        if shingles:
            total += len(shingles)
            counts += _set_bits(np.array(shingles, np.uint64))
        tail = words[1 - SHINGLE :]
    if not total and tail:
        return xxhash.xxh64_intdigest(b" ".join(tail), SEED)
    return int.from_bytes(np.packbits(2 * counts > total, bitorder="little").tobytes(), "little")


def _set_bits(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit set."""
    found = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        raw = hashes[at : at + (1 << 14)].astype("<u8").view(np.uint8).reshape(-1, BITS // 8)
        found += np.unpackbits(raw, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return found


def _printer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = [fingerprint(t.as_py() or b"") for t in batch.column("text")]
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(np.array(prints, np.uint64).view(np.int64))], ["id", "fp"])
    give_back()


def with_fingerprints(df: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id, fp): the fingerprint as a signed 64-bit number, for every row; a null text has no words."""
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(_printer, f"id {df.schema[id_col].dataType.simpleString()}, fp long")


def ball(value: Column, bits: int) -> Column:
    """The value, and it with each one of its unset bits set."""
    more = F.transform(F.array(*[F.lit(1 << i).cast("bigint") for i in range(bits)]), lambda b: value.bitwiseOR(b))
    return F.concat(F.array(value), F.filter(more, lambda x: x != value))


def part(value: Column, bits: int, which: int) -> Column:
    """The low (0) or the next (1) `bits` bits."""
    return F.shiftrightunsigned(value, bits * which).bitwiseAND(F.lit((1 << bits) - 1).cast("bigint"))


def segment_keys(value: Column, bits: int) -> Column:
    """Keys of both segments of `bits` bits: their values' balls, told apart by a bit above them."""
    upper = F.transform(ball(part(value, bits, 1), bits), lambda x: x + F.lit(1 << bits).cast("bigint"))
    return F.concat(ball(part(value, bits, 0), bits), upper)


def stars(prints: np.ndarray) -> list[tuple[int, int]]:
    """(fingerprint, centre of its group) for groups that links connect; all pairs are compared or already connected."""
    left, found = np.unique(prints.view(np.uint64)), []
    while len(left) > 1:
        queue = [left[0]]
        centre, left = int(left[:1].view(np.int64)[0]), left[1:]
        while queue and len(left):
            near = np.bitwise_count(left ^ queue.pop()) <= RADIUS
            if near.any():
                queue.extend(left[near])
                found.extend((x, centre) for x in left[near].view(np.int64).tolist())
                left = left[~near]
    return found


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        links: list[tuple[int, int]] = []
        prints, ends = batch.column("fps").flatten().to_numpy(), np.cumsum(batch.column("n").to_numpy())
        for start, end in zip(np.concatenate(([0], ends[:-1])), ends, strict=True):
            links += stars(prints[start:end])
        if links:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*links, strict=True)], ["a", "b"])


def cells(rows: DataFrame) -> DataFrame:
    """Rows (key, fp, own) to stars (a, b) of each key's fingerprints; keys without a table entry have nothing to find."""
    met = rows.groupBy("key").agg(F.collect_list("fp").alias("fps"), F.count("*").alias("n"), F.max("own").alias("entry"))
    return met.filter("n > 1 AND entry").select("fps", "n").mapInArrow(_compared, "a long, b long")


def links(prints: DataFrame, heavy: int = HEAVY) -> DataFrame:
    """Distinct fingerprints (fp) to links (a, b), a forest over each key's cell."""
    fp, mask = F.col("fp"), F.lit((1 << HALF) - 1)
    values = prints.select(F.explode(F.array(*[part(fp, HALF, s) + F.lit(s << HALF) for s in (0, 1)])).alias("value"))
    crowded = values.groupBy("value").agg(F.count("*").alias("n")).filter(F.col("n") > heavy)
    near = F.transform(ball(F.col("value").bitwiseAND(mask), HALF), lambda x: x + F.col("value") - F.col("value").bitwiseAND(mask))
    dense = written(crowded.select(F.explode(near).alias("key")).distinct(), "dense-keys")
    low = F.shiftright("key", HALF) == 0
    keyed = prints.select("fp", F.explode(segment_keys(fp, HALF)).alias("key"))
    segment, other = (F.when(low, part(fp, HALF, i)).otherwise(part(fp, HALF, 1 - i)) for i in (0, 1))
    keyed = keyed.withColumn("own", segment == F.col("key").bitwiseAND(mask))
    if dense.isEmpty():
        return written(cells(keyed), "links")
    thin = cells(keyed.join(dense, "key", "left_anti"))
    again = keyed.join(dense, "key", "left_semi").select("fp", "key", "own", F.explode(segment_keys(other, QUARTER)).alias("inner"))
    refined = again.select("fp", "own", (F.shiftleft("key", QUARTER + 1) + F.col("inner")).alias("key"))
    return written(thin.union(cells(refined)), "links")


def simhash_components(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", heavy: int = HEAVY) -> DataFrame:
    """One row per row of `df`: id, fingerprint (16 lower-case hex digits), component_id (the smallest id reachable over links).

    Fingerprints link at `RADIUS` or fewer differing bits. A row without words, also a null text, has fingerprint zero and
    links like any other. Rows that repeat an id are nodes by their texts. A null id is never the smallest; a component of
    null ids alone has a null component_id. An empty table gives an empty result. Other columns don't matter.
    """
    require(df, text_col, id_col)
    signed = written(with_fingerprints(df, text_col, id_col), "fingerprints")
    prints = written(signed.groupBy("fp").agg(F.min("id").alias("least")), "distinct-fingerprints")
    found = components(links(prints.select("fp"), heavy)).select(F.col("a").alias("fp"), F.col("b").alias("centre"))
    named = written(prints.join(found, "fp", "left").withColumn("centre", F.coalesce("centre", "fp")), "fingerprint-centres")
    least = named.groupBy("centre").agg(F.min("least").alias("component_id"))
    known = written(named.join(least, "centre").select("fp", "component_id"), "fingerprint-components")
    return signed.join(known, "fp").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(table(spark, sf_dir, "documents"))
