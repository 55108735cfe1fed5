"""Exact similarity join of many texts that share bands but mostly aren't alike: which of them must be compared.

Texts of one template share their bands, so a bucket may hold any share of all texts without a single link. All its pairs
would be quadratic; here texts meet over what is rare among them instead.

1. A text's features (shingles with their occurrences) are counted over all texts of wide buckets, and put in order of
   rising count. Two texts that reach the threshold have a common feature in both their prefixes: were the first common one
   behind the prefix of one of them, what follows there would be too little (prefix filtering; Chaudhuri et al. 2006).
2. Texts with a feature in their prefixes form a group. Of a pair, the group of its first common feature is enough, so in a
   group nothing before its feature counts as common: with r features from there on, a pair's similarity is at most
   min(r, r') / (n + n' - min(r, r')) (positional filtering; Xiao et al. 2008). The same holds for weights.
3. Groups that lie in one component have nothing to find. Small ones are one block. Large ones are dealt into cells by n and
   r / n; only cells whose bound reaches the threshold meet, and of those only texts outside the group's main component
   with all others.

Either measure's bound lets a pair pass, so no link is lost. Work and rows are linear in the features, but for texts that could
be linked by all that is said here and aren't, and share one rare feature in large numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import give_back, written

#: Bounds are compared with a little to spare for sums in other orders.
SPARE = 1e-4
#: Cells: sizes within this factor, and so many steps of the share behind the feature.
SIZE_STEP, SHARE_STEPS = 1.05, 40


def _features(features, shared):
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (node, text) to (node, bytes, features, weights, first), lists of equal length."""
        idf = shared.value
        for batch in batches:
            for node, text in zip(batch.column("node"), batch.column("text"), strict=True):
                keys, weights, first = features(text.as_py(), idf)
                lists = [pa.array([x.tolist()], pa.list_(t)) for x, t in ((keys.view(np.int64), pa.int64()), (weights, pa.float32()), (first, pa.bool_()))]
                yield pa.RecordBatch.from_arrays([pa.array([node.as_py()], pa.binary()), pa.array([len(text.as_py())], pa.int64()), *lists], ["node", "bytes", "features", "weights", "first"])
        give_back()

    return each


def prefix(counts: np.ndarray, keys: np.ndarray, weights: np.ndarray, first: np.ndarray, threshold: float) -> tuple[np.ndarray, ...]:
    """Features of the prefix that others have, too: their keys, and what stands from each of them on (number of first
    occurrences, weight); then the text's number and weight."""
    order = np.lexsort((keys, counts))
    counts, keys, weights, first = counts[order], keys[order], weights[order].astype(np.float64), first[order]
    left, weight = np.cumsum(first[::-1])[::-1], np.cumsum(weights[::-1])[::-1]
    n, total = int(left[0]), float(weight[0])
    inside = (left >= threshold * n - SPARE) & first | (weight >= threshold * total - SPARE)
    inside &= counts > 1
    return keys[inside], left[inside], weight[inside], n, total


def _prefixes(threshold: float):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                one = batch.slice(i, 1)
                rows = one.column("f").flatten()
                found, left, weight, n, total = prefix(*(rows.field(c).to_numpy(zero_copy_only=False) for c in ("n", "key", "weight", "first")), threshold)
                k = len(found)
                columns = [pa.array(found, pa.int64()), pa.repeat(one.column("node")[0], k), pa.repeat(one.column("bytes")[0], k)]
                columns += [pa.array(np.full(k, n), pa.int64()), pa.array(left, pa.int64()), pa.array(np.full(k, total)), pa.array(weight)]
                yield pa.RecordBatch.from_arrays(columns, ["key", "node", "bytes", "n", "left", "total", "weight"])

    return cut


def meets(a: dict[str, Column], b: dict[str, Column], threshold: float) -> Column:
    """Whether the bound of two cells (n and total: the least, left and weight: the most) lets a pair reach the threshold."""

    def reaches(size: str, rest: str) -> Column:
        common = F.least(a[rest], b[rest])
        return common >= (threshold - SPARE) * (a[size] + b[size] - common)

    return reaches("n", "left") | reaches("total", "weight")


def refined_blocks(nodes: DataFrame, texts: DataFrame, features, shared, threshold: float, members: int, block_bytes: int) -> DataFrame:
    """Nodes (node, component) with their texts (node, text) to blocks (block, node) that hold every pair that may be linked
    and is in two components.

    features(text, shared value) gives a text's features, weights and which of them are first occurrences.
    """
    each = written(texts.join(nodes.select("node"), "node", "left_semi").mapInArrow(_features(features, shared), "node binary, bytes long, features array<long>, weights array<float>, first array<boolean>"), "wide-features")
    counts = written(each.select(F.explode("features").alias("key")).groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"), "feature-counts")
    rows = each.select("node", "bytes", F.explode(F.arrays_zip(F.col("features").alias("key"), F.col("weights").alias("weight"), "first")).alias("f")).select("node", "bytes", "f.*")
    counted = rows.join(counts, "key", "left").groupBy("node", "bytes").agg(F.collect_list(F.struct(F.coalesce("n", F.lit(1)).alias("n"), "key", "weight", "first")).alias("f"))
    cut = counted.mapInArrow(_prefixes(threshold), "key long, node binary, bytes long, n long, left long, total double, weight double")
    met = written(cut.join(nodes, "node"), "prefixes")

    sums = [F.count("*").alias("size"), F.sum("bytes").alias("bytes"), F.bit_xor(F.xxhash64("node")).alias("alike"), F.min("component").alias("least"), F.max("component").alias("most")]
    open_ = written(met.groupBy("key").agg(*sums).filter("size > 1 AND least <> most"), "open-groups")
    large = (F.col("size") > members) | (F.col("bytes") > block_bytes)
    small = open_.filter(~large).groupBy("size", "bytes", "alike").agg(F.min("key").alias("key"))  # groups of the same nodes are one
    blocks = met.join(small.select("key"), "key").select(F.xxhash64("key").alias("block"), "node")
    if open_.filter(large).isEmpty():
        return blocks

    cell = F.concat_ws(":", F.floor(F.ln("n") / np.log(SIZE_STEP)), F.floor(F.col("left") * SHARE_STEPS / F.col("n")), F.floor(F.col("weight") * SHARE_STEPS / F.col("total")))
    dealt = written(met.join(open_.filter(large).select("key"), "key").withColumn("cell", cell), "large-groups")
    main = dealt.groupBy("key", "component").agg(F.count("*").alias("c")).groupBy("key").agg(F.max(F.struct("c", "component"))["component"].alias("main"))
    dealt = dealt.join(main, "key").withColumn("outside", F.col("component") != F.col("main"))
    parts = lambda which: F.greatest(F.ceil(F.sum(which.cast("int")) * 2 / members), F.ceil(F.sum(F.when(which, F.col("bytes")).otherwise(0)) * 2 / block_bytes))
    bounds = [F.min("n").alias("n"), F.max("left").alias("left"), F.min("total").alias("total"), F.max("weight").alias("weight")]
    cells = written(dealt.groupBy("key", "cell").agg(*bounds, parts(F.col("outside")).alias("i"), parts(F.lit(True)).alias("j")), "cells")
    a, b = cells.filter("i > 0").alias("a"), cells.alias("b")
    of = lambda side: {c: F.col(f"{side}.{c}") for c in ("n", "left", "total", "weight")}
    pairs = a.join(b, (F.col("a.key") == F.col("b.key")) & meets(of("a"), of("b"), threshold)).select(
        F.col("a.key").alias("key"), F.col("a.cell").alias("from"), F.col("b.cell").alias("to"), F.col("a.i").alias("i"), F.col("b.j").alias("j")
    )
    pairs = written(pairs, "cell-pairs")
    hashed = F.xxhash64("node")
    mine = dealt.filter("outside").select("key", "node", F.col("cell").alias("from")).join(pairs, ["key", "from"])
    mine = mine.select("key", "from", "to", "node", F.pmod(hashed, "i").alias("i"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("j") - 1)).alias("j"))
    other = dealt.select("key", "node", F.col("cell").alias("to")).join(pairs, ["key", "to"])
    other = other.select("key", "from", "to", "node", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("i") - 1)).alias("i"), F.pmod(hashed, "j").alias("j"))
    crossed = mine.unionByName(other).select(F.xxhash64("key", "from", "to", "i", "j").alias("block"), "node").distinct()
    return blocks.union(crossed)
