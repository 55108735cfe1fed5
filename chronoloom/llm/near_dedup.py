"""Near-duplicate classes: consistent weighted sampling over TF-IDF shingles, banded and verified.

Words are lower-cased runs of digits, letters and signs above ASCII. Shingles are five words (all
of a shorter text). A shingle's weight is (1 + ln tf) * idf; idf rises from 1 to 1 + `IDF_SPAN` as
the share of documents with the shingle falls from 1 to `RARE`. It depends on shares alone, so it
is alike in corpora of any size, and it's bounded, as otherwise what the members of a large group
of copies share would weigh next to nothing and the group would fall apart. df is counted over all
documents in `IDF_BUCKETS` hashed buckets, a table of fixed size; what falls in a bucket by chance is
some 500 shingles a document over 262,144 buckets, a share well below `RARE` at any corpus size.

1. One pass counts df, another draws `BANDS * ROWS` samples per text by improved consistent
   weighted sampling (Ioffe 2010): two texts share a sample with a chance equal to their weighted
   Jaccard similarity. As many are drawn by plain min-hashing, for the similarity of the sets.
   A band's key is made of `ROWS` samples of one measure. Texts of equal words are one node.
2. Nodes that share a band key form a bucket; of buckets with the same nodes one is kept.
   A bucket is dealt into blocks of at most about `MEMBERS` nodes and `BLOCK_BYTES` of text. In a
   block all pairs are compared exactly, on whole texts: shared weights are summed shingle by
   shingle, for shingles of many members as a product of matrices. A weighted or plain Jaccard
   similarity of `THRESHOLD` or more is a link. A block gives no pairs but a star for each of
   its connected groups, so rows never outnumber the block's nodes.
3. Links' connected components are found by alternating large and small stars.
4. Texts of buckets of several blocks, if they are in several components, are joined exactly over what is rare among them
   (`similarity_join`), as a template may bring any number of texts into a bucket without a link: they are
   never compared all with all.

So every two texts that share a band are compared or already connected, whatever the size of
their bucket; two texts at 0.8 in a measure share one of its 16 bands with a chance of 0.99999.
Only the df table (2 MB) reaches the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import give_back, require, table, written
from .decontamination import WORD_BYTES
from .similarity_join import refined_blocks

SHINGLE, THRESHOLD = 5, 0.8
BANDS, ROWS = 16, 3
IDF_BUCKETS, IDF_BLOCK, IDF_SPAN, RARE = 1 << 18, 1 << 12, 1.0, 0.01
#: Nodes, and bytes of their texts, that are compared in one block.
MEMBERS, BLOCK_BYTES = 2048, 8 << 20
#: Shingles of a block in one product of matrices, and pairs that are counted at once.
SLAB, PAIRS = 4096, 1 << 21
#: Rows of a block whose similarities are worked out at once.
STRIP = 256
#: Weighted similarities this close to the threshold are computed again in double precision.
CLOSE = 1e-4
SEED = 29
#: Ready-drawn variables of the sampling; a hash of shingle and sample number chooses among them.
DRAWS = 1 << 13
#: Bytes of a text hashed at once; texts are cut between words.
PIECE = 1 << 16

_RNG = np.random.default_rng(SEED)


def _odd(n: int) -> np.ndarray:
    return _RNG.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


_R = _RNG.gamma(2.0, 1.0, DRAWS).astype(np.float32)
_BETA = _RNG.random(DRAWS).astype(np.float32)
_AT_0 = (np.log(_RNG.gamma(2.0, 1.0, DRAWS)) - _R * (1 - _BETA)).astype(np.float32)
_PER_R = (1 / _R).astype(np.float32)
_MULTIPLIERS = _odd(BANDS * ROWS)
_PLACES = _odd(SHINGLE)
_SHIFT = np.uint64(64 - DRAWS.bit_length() + 1)
_LETTERS = _odd(256)
_LETTERS[32] = 0
with np.errstate(over="ignore"):
    _BASE = np.uint64(0x9E3779B97F4A7C15)
    _POWERS = np.multiply.accumulate(np.concatenate((np.ones(1, np.uint64), np.full(PIECE, _BASE, np.uint64))))
    _UNPOWERS = np.multiply.accumulate(np.concatenate((np.ones(1, np.uint64), np.full(PIECE, np.uint64(pow(int(_BASE), -1, 1 << 64)), np.uint64))))


def mixed(x: np.ndarray) -> np.ndarray:
    """Each bit of the result depends on all of x (SplitMix64's finish)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(text: bytes) -> np.ndarray:
    """64-bit hashes of the words in order: polynomials in the letters."""
    plain = text.translate(WORD_BYTES)
    if len(plain) <= PIECE:
        return _hashed(plain)
    parts, at = [], 0
    while at < len(plain):
        end = min(len(plain), at + PIECE)
        if end < len(plain):
            end = plain.rfind(b" ", at, end)
            if end <= at:  # a word of more than a piece, or none before it
                end = plain.find(b" ", at + 1)
                end = len(plain) if end < 0 else end
        parts.append(_hashed(plain[at:end]) if end - at <= PIECE else _long_word(plain[at:end].strip()))
        at = end
    return np.concatenate(parts)


def _long_word(word: bytes) -> np.ndarray:
    """The same polynomial of one word of any length, piece by piece."""
    total = 0
    for i in range(0, len(word), PIECE):
        total += int(_hashed(word[i : i + PIECE])[0]) * pow(int(_BASE), i, 1 << 64)
    return np.array([total % (1 << 64)], np.uint64)


def _hashed(plain: bytes) -> np.ndarray:
    letters = np.frombuffer(plain, np.uint8)
    inside = letters != 32
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.zeros(0, np.uint64)
    terms = _LETTERS.take(letters)
    terms *= _POWERS[: len(terms)]
    return np.add.reduceat(terms, starts) * _UNPOWERS[starts]


def shingles(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of word hashes as 64-bit hashes, sorted, and how often each occurs."""
    if not len(words):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    size = min(SHINGLE, len(words))
    n = len(words) - size + 1
    total = words[:n] * _PLACES[0]
    for i in range(1, size):
        total += words[i : i + n] * _PLACES[i]
    keys = np.sort(mixed(total))
    new = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[new], np.diff(np.append(new, n))


class Idf:
    def __init__(self, counts: np.ndarray, docs: int):
        share = np.maximum(counts, 1) / max(docs, 1)
        self.weights = (1 + IDF_SPAN * np.clip(np.log(share) / np.log(RARE), 0, 1)).astype(np.float32)

    def vector(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys, tf = shingles(words)
        return keys, (1 + np.log(tf)).astype(np.float32) * self.weights[bucket(keys)]


def bucket(keys: np.ndarray) -> np.ndarray:
    return (keys >> np.uint64(64 - IDF_BUCKETS.bit_length() + 1)).view(np.int64)


def both_samples(keys: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Samples of the weighted shingles, then of the plain ones."""
    return np.concatenate((samples(keys, weights), plain_samples(keys)))


def plain_samples(keys: np.ndarray) -> np.ndarray:
    """The least of the shingles, hashed, under each of as many orders."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    spread = mixed(keys + _BASE)
    for i in range(0, len(keys), 1024):
        np.minimum(least, (spread[None, i : i + 1024] * _MULTIPLIERS[:, None]).min(axis=1), out=least)
    return mixed(least)


def samples(keys: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """One weighted sample (a shingle and its level, hashed) for each of the draws."""
    k = BANDS * ROWS
    best, sample, rows = np.full(k, np.inf, np.float32), np.zeros(k, np.uint64), np.arange(k)
    for i in range(0, len(keys), 512):
        part, ln_w = keys[i : i + 512], np.log(weights[i : i + 512])
        at = ((part[None, :] * _MULTIPLIERS[:, None]) >> _SHIFT).view(np.int64)
        level = np.take(_PER_R, at, mode="clip")
        level *= ln_w[None, :]
        level += np.take(_BETA, at, mode="clip")
        np.floor(level, out=level)
        ln_a = np.take(_R, at, mode="clip")
        ln_a *= level
        np.subtract(np.take(_AT_0, at, mode="clip"), ln_a, out=ln_a)
        j = ln_a.argmin(axis=1)
        low = ln_a[rows, j]
        better = low < best
        best = np.where(better, low, best)
        sample = np.where(better, mixed(part[j] + level[rows, j].astype(np.int64).view(np.uint64)), sample)
    return sample


def band_keys(sample: np.ndarray) -> list[int]:
    bands = np.arange(len(sample) // ROWS, dtype=np.uint64)
    for column in sample.reshape(-1, ROWS).T:
        bands = mixed(bands * _BASE + column)
    return bands.view(np.int64).tolist()


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard (the smaller weights over the larger ones) or that of the plain sets, whichever is more."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    low = float(np.minimum(a[1][i], b[1][j]).sum(dtype=np.float64))
    total = float(a[1].sum(dtype=np.float64) + b[1].sum(dtype=np.float64)) - low
    plain = len(i) / max(1, len(a[0]) + len(b[0]) - len(i))
    return max(low / total if total > 0 else 0.0, plain)


def lowered(text: Column) -> Column:
    return F.lower(F.coalesce(text, F.lit(""))).cast("binary")


def learn_idf(texts: DataFrame) -> Idf:
    """Document frequencies of all rows of (text: binary), as one table of fixed size."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals, docs = np.zeros(IDF_BUCKETS, np.int64), 0
        for batch in batches:
            docs += batch.num_rows
            for text in batch.column("text"):
                np.add.at(totals, bucket(shingles(word_hashes(text.as_py()))[0]), 1)
        blocks = totals.reshape(-1, IDF_BLOCK)
        used = [b for b in range(len(blocks)) if blocks[b].any()]
        give_back()
        if docs:
            counts = [np.array([docs]).tobytes(), *(blocks[b].tobytes() for b in used)]
            yield pa.RecordBatch.from_arrays([pa.array([-1, *used], pa.int32()), pa.array(counts, pa.binary())], ["block", "counts"])

    def add(batch: pd.DataFrame) -> pd.DataFrame:
        total = np.sum([np.frombuffer(c, np.int64) for c in batch["counts"]], axis=0)
        return pd.DataFrame({"block": batch["block"][:1], "counts": [total.astype(np.int64).tobytes()]})

    parts = texts.mapInArrow(count, "block int, counts binary").withColumn("part", F.spark_partition_id() % 256)
    some = parts.groupBy("block", "part").applyInPandas(lambda b: add(b), "block int, counts binary")
    rows = {r.block: np.frombuffer(r.counts, np.int64) for r in some.groupBy("block").applyInPandas(lambda b: add(b), "block int, counts binary").collect()}
    counts = np.concatenate([rows.get(b, np.zeros(IDF_BLOCK, np.int64)) for b in range(IDF_BUCKETS // IDF_BLOCK)])
    return Idf(counts, int(rows[-1][0]) if -1 in rows else 0)


def _signer(shared):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf = shared.value
        for batch in batches:
            nodes, bands, sizes = [], [], []
            for text in batch.column("text"):
                data = text.as_py()
                words = word_hashes(data)
                sizes.append(len(data))
                nodes.append(xxhash.xxh3_128_digest(words.tobytes()) if len(words) else None)
                bands.append(band_keys(both_samples(*idf.vector(words))) if len(words) else [])
            made = [pa.array(nodes, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(sizes, pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("raw"), *made], ["id", "raw", "node", "bands", "bytes"])
        give_back()

    return sign


def features(words: np.ndarray, idf: Idf) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each occurrence of a shingle as a number, its share of the weight, and whether it's the first.

    Two texts with tf and tf' occurrences have the first min(tf, tf') in common, whose shares add
    up to the smaller weight, as ln tf is the sum of ln(i / (i - 1)).
    """
    if not len(words):
        return np.zeros(0, np.uint64), np.zeros(0, np.float32), np.zeros(0, bool)
    keys, tf = shingles(words)
    each = np.repeat(keys, tf)
    level = np.arange(1, len(each) + 1) - np.repeat(np.cumsum(tf) - tf, tf)
    first = level == 1
    share = np.where(first, 1.0, np.log(level / np.maximum(level - 1, 1))).astype(np.float32)
    return np.where(first, each, mixed(each + level.astype(np.uint64) * _BASE)), share * idf.weights[bucket(each)], first


def text_features(text: bytes, idf: Idf) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return features(word_hashes(text), idf)


def shared_sums(who: np.ndarray, starts: np.ndarray, counts: np.ndarray, weights: np.ndarray, n: int) -> np.ndarray:
    """n x n sums of the weights that two have in common, above the diagonal.

    `who`: members column by column, ascending; each column begins at `starts` and has `counts`.
    """
    total = np.zeros((n, n), np.float32)
    dense = counts > max(4, n // 8)
    columns = np.flatnonzero(dense)
    for i in range(0, len(columns), SLAB):
        some = columns[i : i + SLAB]
        k = counts[some]
        at = np.repeat(starts[some] - np.cumsum(k) + k, k) + np.arange(k.sum())
        there = np.zeros((n, len(some)), np.float32)
        there[who[at], np.repeat(np.arange(len(some)), k)] = 1
        total += (there * weights[some]) @ there.T
    flat = total.reshape(-1)
    for k in np.unique(counts[~dense & (counts > 1)]).tolist():
        columns = np.flatnonzero(~dense & (counts == k))
        x, y = np.triu_indices(k, 1)
        step = max(1, PAIRS // len(x))
        for i in range(0, len(columns), step):
            some = columns[i : i + step]
            members = who[starts[some][:, None] + np.arange(k)].astype(np.int64)
            codes = (members[:, x] * n + members[:, y]).ravel()
            each = np.repeat(weights[some], len(x))
            if len(codes) * 8 > n * n:
                flat += np.bincount(codes, each, n * n).astype(np.float32)
            else:
                np.add.at(flat, codes, each)
    return np.triu(total, 1)


def linked_groups(words: list[np.ndarray], idf: Idf, threshold: float) -> list[list[int]]:
    """Groups of two or more texts, given by their words' hashes, that links connect; all pairs are compared."""
    n = len(words)
    if n == 2:
        return [[0, 1]] if similarity(idf.vector(words[0]), idf.vector(words[1])) >= threshold else []
    parts = [features(w, idf) for w in words]
    sizes = np.array([len(p[0]) for p in parts])
    who = np.repeat(np.arange(n), sizes)
    keys, weights, first = (np.concatenate([p[i] for p in parts]) for i in range(3))
    weight, plain = np.bincount(who, weights, n), np.bincount(who, first, n)
    order = np.argsort(keys, kind="stable")
    keys, who, weights, first = keys[order], who[order], weights[order], first[order]
    starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    counts = np.diff(np.append(starts, len(keys)))
    low = shared_sums(who, starts, counts, weights[starts], n)
    level_1 = first[starts]
    both = shared_sums(who, starts[level_1], counts[level_1], np.ones(int(level_1.sum()), np.float32), n)
    links = np.zeros((n, n), bool)
    for i in range(0, n, STRIP):
        x, y = low[i : i + STRIP].astype(np.float64), both[i : i + STRIP].astype(np.float64)
        weighted = x / np.maximum(weight[i : i + STRIP, None] + weight[None, :] - x, 1e-30)
        found = y / np.maximum(plain[i : i + STRIP, None] + plain[None, :] - y, 1) >= threshold
        found |= weighted >= threshold + CLOSE
        for j, k in np.argwhere((np.abs(weighted - threshold) < CLOSE) & ~found).tolist():
            found[j, k] = similarity(idf.vector(words[i + j]), idf.vector(words[k])) >= threshold
        links[i : i + STRIP] = found
    links |= links.T
    groups, left = [], links.any(axis=1)
    while left.any():
        frontier = group = np.flatnonzero(left)[:1]
        left[frontier] = False
        while len(frontier):
            frontier = np.flatnonzero(links[frontier].any(axis=0) & left)
            left[frontier] = False
            group = np.concatenate((group, frontier))
        groups.append(group.tolist())
    return groups


def _linker(shared, threshold: float):
    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (block, node, text), those of a block together, to a star (a, b) for each of its groups."""
        idf, block, texts = shared.value, None, {}

        def stars() -> Iterator[pa.RecordBatch]:
            nodes = list(texts)
            for group in linked_groups([texts[x] for x in nodes], idf, threshold) if len(nodes) > 1 else []:
                b, *rest = sorted(nodes[i] for i in group)
                yield pa.RecordBatch.from_arrays([pa.array(rest, pa.binary()), pa.array([b] * len(rest), pa.binary())], ["a", "b"])

        for batch in batches:
            for name, node, text in zip(batch.column("block"), batch.column("node"), batch.column("text"), strict=True):
                if block is None or name.as_py() != block:
                    yield from stars()
                    block, texts = name.as_py(), {}
                texts[node.as_py()] = word_hashes(text.as_py())
        yield from stars()
        give_back()

    return link


def _kept(df: DataFrame, label: str) -> DataFrame:
    """A written table of the rounds, whose rows are few and short: some files a core."""
    return written(df.coalesce(4 * df.sparkSession.sparkContext.defaultParallelism), label)


def components(edges: DataFrame) -> DataFrame:
    """Edges (a, b) to one edge (a, b) from each node to the smallest node it's connected to, without those of the smallest."""

    def large(e: DataFrame) -> DataFrame:
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select("b", "a"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        return both.join(least, "u").filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()

    def small(e: DataFrame) -> DataFrame:
        down = e.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        return down.join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).union(least).filter("a <> b").distinct()

    edges = _kept(edges.filter("a <> b").distinct(), "edges")
    while True:
        edges = _kept(small(_kept(large(edges), "stars")), "edges")
        # done when each node has one edge and no centre has any
        ends = edges.select("a", F.lit(1).alias("n")).union(edges.select("b", F.lit(0)).distinct())
        if ends.groupBy("a").agg(F.sum("n").alias("n"), F.count("*").alias("k")).filter("k > 1").isEmpty():
            return edges


def near_duplicates(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of `df`: id, class_id (smallest id of its class), class_size, kept (whether it's that id).

    A row without words (null, empty, signs only) is a class of its own. Rows that repeat an id
    are separate rows, but which is kept goes by the id; a null id comes last in its class.
    Other columns don't matter. An empty table gives an empty result.
    """
    return _classified(df, text_col, id_col, threshold).drop("__raw")


def raw_hash(text: Column) -> Column:
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def _classified(df: DataFrame, text_col: str, id_col: str, threshold: float) -> DataFrame:
    """`near_duplicates` with the hash of each row's text, `__raw`."""
    require(df, text_col, id_col)
    spark = df.sparkSession
    rows = df.select(F.col(id_col).alias("id"), raw_hash(F.col(text_col)).alias("raw"), lowered(F.col(text_col)).alias("text"))
    kind = df.schema[id_col].dataType.simpleString()
    shared = spark.sparkContext.broadcast(learn_idf(rows.select("text")))
    signed = written(rows.mapInArrow(_signer(shared), f"id {kind}, raw binary, node binary, bands array<long>, bytes long"), "signatures")
    nodes = written(
        signed.filter("node IS NOT NULL")
        .groupBy("node")
        .agg(F.min(F.struct("id", "raw")).alias("at"), F.first("bands").alias("bands"), F.max("bytes").alias("bytes"))
        .select("node", "at.*", "bands", "bytes"),
        "nodes",
    )
    every = nodes.select("node", "bytes", F.explode("bands").alias("key"))
    alike = F.bit_xor(F.xxhash64("node")).alias("alike")
    buckets = every.groupBy("key").agg(F.count("*").alias("n"), F.sum("bytes").alias("size"), alike).filter("n > 1")
    distinct = buckets.groupBy("n", "size", "alike").agg(F.min("key").alias("key"))
    parts = F.greatest(F.ceil(F.col("n") / MEMBERS), F.ceil(F.col("size") / BLOCK_BYTES)).alias("parts")
    members = written(every.join(distinct.select("key", parts), "key").select("key", "node", "bytes", "parts"), "members")
    chosen = nodes.join(members.select("node").distinct(), "node", "left_semi").select("node", F.col("id").alias("__id"), F.col("raw").alias("__raw"))
    at = F.col("id").eqNullSafe(F.col("__id")) & (F.col("raw") == F.col("__raw"))
    texts = rows.join(chosen, at).select("node", "text").dropDuplicates(["node"])
    wide = members.filter("parts > 1")
    several = not wide.isEmpty()
    if several:
        texts = written(texts, "candidate-texts")

    def linked(blocks: DataFrame) -> DataFrame:
        """Rows (block, node) to the stars of the linked groups of each block."""
        dealt = blocks.join(texts, "node").select("block", "node", "text").repartition("block").sortWithinPartitions("block")
        return written(dealt.mapInArrow(_linker(shared, threshold), "a binary, b binary"), "links")

    stars = components(linked(members.select(F.xxhash64("key", F.pmod(F.xxhash64("node"), F.col("parts"))).alias("block"), "node")))
    if several:
        found = stars.select(F.col("a").alias("node"), F.col("b").alias("component"))
        nodes = wide.select("node").distinct().join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
        blocks = refined_blocks(written(nodes, "wide-nodes"), texts, text_features, shared, threshold, MEMBERS, BLOCK_BYTES)
        stars = components(stars.union(linked(blocks)))
    found = stars.select(F.col("a").alias("node"), F.col("b").alias("component"))
    placed = written(signed.select("id", "raw", "node").join(found, "node", "left").select("id", "raw", F.coalesce("component", "node").alias("class")), "placed")
    classes = placed.filter("class IS NOT NULL").groupBy("class").agg(F.min("id").alias("class_id"), F.count("*").alias("class_size"))
    alone = placed.filter("class IS NULL").select("id", "raw", F.col("id").alias("class_id"), F.lit(1).cast("bigint").alias("class_size"))
    out = placed.join(classes, "class").select("id", "raw", "class_id", "class_size").unionByName(alone)
    return out.select(F.col("id").alias(id_col), "class_id", "class_size", F.col("id").eqNullSafe(F.col("class_id")).alias("kept"), F.col("raw").alias("__raw"))


def keep_one_of_each(df: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The rows of `df` that are kept; columns stay as they are. Of rows that repeat an id, those go whose own text is a copy."""
    gone = _classified(df, text_col, id_col, THRESHOLD).filter("NOT kept").select(F.col(id_col).alias("__id"), "__raw").distinct()
    dropped = written(gone, "dropped").hint("merge")  # rows with their texts move once, whatever the size of this table
    return df.join(dropped, F.col(id_col).eqNullSafe(F.col("__id")) & (raw_hash(F.col(text_col)) == F.col("__raw")), "left_anti").select(*df.columns)


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
