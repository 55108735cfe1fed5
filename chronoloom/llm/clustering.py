"""Centroid clustering by Delta Lloyd: exact integer k-means that works on what has changed.

1. Vectors of the right shape become whole numbers and are packed into blocks of `BLOCK`, one row each, in a
   table bucketed by block.
2. Assignments (owner and distance of each vector, 12 bytes) are a table of the same buckets, so each round
   joins it with the vectors without a shuffle. A vector whose owner has moved is compared with all
   centroids, any other only with those that have moved: its distance to its owner still holds.
3. A block gives out signed transfers: for each cluster the count and the sums of vectors that came, less
   those that went. Sums over all vectors are kept; a round adds the transfers' sums to them, and gets the
   new centroids by exact division. Where no centroid moves, further rounds change nothing and are left out.

The driver holds k centroids and k sums, at most `MAX_CLUSTERS` of each. Every round's assignments are
written in the shared folder, so a lost executor costs the tasks of one round at most.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import require, shared_dir, table, written

CLUSTERS, ROUNDS, DIMENSION, SCALE, SEED = 8, 10, 64, 1024, 3
BLOCK = 1024
MAX_CLUSTERS = 4096
#: Whole numbers up to this: squared distances of up to 128 components then fit in 64 bits.
LARGEST = 1 << 27
IN_PARTITION = 33
TRANSFERS = "array<struct<cluster:int,n:bigint,sums:array<bigint>>>"


def whole_vectors(df: DataFrame, vector_col: str, dimension: int, scale: int) -> DataFrame:
    """`df` with `whole`, floor(scale * x) of each component; rows of another length, or with a null or non-finite component, go."""
    x = F.transform(F.col(vector_col), lambda v: v.cast("double"))
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return df.filter(F.coalesce((F.size(x) == dimension) & fine, F.lit(False))).withColumn("whole", F.transform(x, lambda v: F.floor(v * scale)))


def _packed(dimension: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << IN_PARTITION
        for batch in batches:
            numbers = batch.column("whole").flatten().to_numpy().reshape(-1, dimension)
            if numbers.size and np.abs(numbers).max() >= LARGEST:
                raise ValueError(f"a component times the scale is {LARGEST} or more")
            for at in range(0, len(numbers), BLOCK):
                ids = batch.column("id").slice(at, BLOCK)
                lists = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
                raw = numbers[at : at + BLOCK].astype("<i4").tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), lists, pa.array([raw], pa.binary())], ["block", "ids", "numbers"])
                block += 1

    return pack


def nearest(numbers: np.ndarray, centroids: np.ndarray, among: np.ndarray, owner: np.ndarray, distance: np.ndarray) -> None:
    """Updates owner and distance by the centroids named in `among`, in ascending order; of equal distances the smaller number wins."""
    for c in among:
        away = numbers - centroids[c]
        found = np.einsum("ij,ij->i", away, away)
        better = (found < distance) | ((found == distance) & (c < owner))
        owner[better], distance[better] = c, found[better]


def reassigned(numbers: np.ndarray, centroids: np.ndarray, moved: np.ndarray, owner: np.ndarray, distance: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Owner and distance after the centroids flagged in `moved` have moved; a vector without an owner has -1."""
    owner, distance = owner.copy(), distance.copy()
    anew = (owner < 0) | moved[owner]
    own, far = np.full(int(anew.sum()), len(centroids), np.int32), np.full(int(anew.sum()), np.iinfo(np.int64).max)
    nearest(numbers[anew], centroids, np.arange(len(centroids)), own, far)
    still = ~anew
    kept, at = owner[still], distance[still]
    nearest(numbers[still], centroids, np.flatnonzero(moved), kept, at)
    owner[anew], distance[anew], owner[still], distance[still] = own, far, kept, at
    return owner, distance


def transfers(numbers: np.ndarray, before: np.ndarray, after: np.ndarray) -> list[dict]:
    """For each cluster that vectors left or joined: its change of count and of sums."""
    gone = before != after
    numbers, before, after = numbers[gone], before[gone], after[gone]
    out = []
    for c in np.union1d(before, after):
        if c >= 0:
            came, left = after == c, before == c
            sums = numbers[came].sum(axis=0) - numbers[left].sum(axis=0)
            out.append({"cluster": int(c), "n": int(came.sum()) - int(left.sum()), "sums": sums.tolist()})
    return out


def _round(centroids: np.ndarray, moved: np.ndarray):
    dimension = centroids.shape[1]

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("cluster", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.int64()))]))
        for batch in batches:
            for block, raw, owners, distances in zip(*(batch.column(c) for c in ("block", "numbers", "owners", "distances")), strict=True):
                numbers = np.frombuffer(raw.as_py(), "<i4").reshape(-1, dimension).astype(np.int64)
                before = np.frombuffer(owners.as_py(), "<i4") if owners.is_valid else np.full(len(numbers), -1, np.int32)
                at = np.frombuffer(distances.as_py(), "<i8") if distances.is_valid else np.zeros(len(numbers), np.int64)
                owner, distance = reassigned(numbers, centroids, moved, before, at)
                columns = [[block.as_py()], [owner.astype("<i4").tobytes()], [distance.astype("<i8").tobytes()], [transfers(numbers, before, owner)]]
                kinds = (pa.int64(), pa.binary(), pa.binary(), kind)
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, kinds, strict=True)], ["block", "owners", "distances", "transfers"])

    return step


def _unpacked():
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                one = batch.slice(i, 1)
                owner, distance = np.frombuffer(one.column("owners")[0].as_py(), "<i4"), np.frombuffer(one.column("distances")[0].as_py(), "<i8")
                yield pa.RecordBatch.from_arrays([one.column("ids").flatten(), pa.array(owner), pa.array(distance)], ["id", "cluster", "distance"])

    return rows


class Bucketed:
    """A table in the shared folder, bucketed by block; tables of as many buckets are joined without a shuffle."""

    def __init__(self, df: DataFrame, label: str, buckets: int):
        self.spark, self.name = df.sparkSession, f"{label}_{uuid.uuid4().hex}"
        self.path = f"{shared_dir(self.spark)}/{self.name}"
        df.write.bucketBy(buckets, "block").sortBy("block").option("path", self.path).format("parquet").saveAsTable(self.name)

    @property
    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE {self.name}")
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def delta_lloyd(
    df: DataFrame,
    vector_col: str = "embedding",
    id_col: str = "vec_id",
    clusters: int = CLUSTERS,
    rounds: int = ROUNDS,
    dimension: int = DIMENSION,
    scale: int = SCALE,
    seed: int = SEED,
) -> DataFrame:
    """One row per vector with exactly `dimension` components, none null or non-finite: id, cluster, distance,
    cluster_inertia, inertia, centroid (whole numbers).

    Components become floor(scale * x); one of 2^27 or more is an error. Centroids start as the vectors with the smallest
    SHA-256 of `seed:id` (a null id counts as empty text), ties by components; with fewer vectors there are fewer clusters. Each
    round assigns, then replaces a centroid that has vectors by the floor of their mean; after the last round vectors are
    assigned once more. Of equally near centroids the smaller number wins. Equal vectors and repeated ids are rows
    each. Without vectors the result is empty. Other columns don't matter, whatever their names.
    """
    require(df, vector_col, id_col)
    if not 0 < clusters <= MAX_CLUSTERS or not 0 < dimension <= 128:
        raise ValueError(f"1 to {MAX_CLUSTERS} clusters and 1 to 128 components")
    spark = df.sparkSession
    kind = df.schema[id_col].dataType.simpleString()
    whole = whole_vectors(df.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector")), "vector", dimension, scale).select("id", "whole")
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = whole.mapInArrow(_packed(dimension), f"block long, ids array<{kind}>, numbers binary")
    vectors = Bucketed(blocks.repartition(buckets, "block"), "vectors", buckets)
    drawn = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))).cast("binary"), 256)
    first = [r.whole for r in whole.withColumn("drawn", drawn).orderBy("drawn", "whole").limit(clusters).collect()]
    centroids = np.array(first, np.int64).reshape(-1, dimension)
    k = len(centroids)
    counts, sums = [0] * k, [[0] * dimension for _ in range(k)]
    moved, assigned = np.ones(k, bool), None
    for n in range(rounds + 1):
        known = vectors.rows.select("block", "numbers")
        before = known.join(assigned.rows.select("block", "owners", "distances"), "block") if assigned else known.selectExpr(
            "*", "CAST(NULL AS BINARY) AS owners", "CAST(NULL AS BINARY) AS distances"
        )
        schema = f"block long, owners binary, distances binary, transfers {TRANSFERS}"
        now = Bucketed(before.mapInArrow(_round(centroids, moved), schema), "assigned", buckets)
        if assigned:
            assigned.drop()
        assigned = now
        if n == rounds:
            break
        moves = assigned.rows.select(F.explode("transfers").alias("t")).select("t.*")
        totals = [F.sum(F.col("sums")[i].cast("decimal(38,0)")).alias(f"s{i}") for i in range(dimension)]
        for row in moves.groupBy("cluster").agg(F.sum("n").alias("n"), *totals).collect():  # a row a cluster
            counts[row.cluster] += row.n
            sums[row.cluster] = [a + int(row[f"s{i}"]) for i, a in enumerate(sums[row.cluster])]
        new = np.array([[s // counts[c] for s in sums[c]] if counts[c] else centroids[c] for c in range(k)], np.int64).reshape(-1, dimension)
        moved = (new != centroids).any(axis=1)
        centroids = new
        if not moved.any():
            break
    both = vectors.rows.select("block", "ids").join(assigned.rows.select("block", "owners", "distances"), "block")
    rows = written(both.mapInArrow(_unpacked(), f"id {kind}, cluster int, distance long"), "clusters")
    parts = {r.cluster: int(r.d) for r in rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}
    assigned.drop()
    vectors.drop()
    number = F.col("cluster") + 1
    of = F.element_at(F.array(*[F.lit(parts.get(c, 0)).cast("bigint") for c in range(max(k, 1))]), number)
    where = F.element_at(F.from_json(F.lit(str(centroids.tolist() or [[]])), "array<array<bigint>>"), number)
    return rows.select(
        F.col("id").alias(id_col),
        "cluster",
        "distance",
        of.alias("cluster_inertia"),
        F.lit(sum(parts.values())).cast("bigint").alias("inertia"),
        where.alias("centroid"),
    )


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = delta_lloyd(table(spark, sf_dir, "embeddings"))
    return found.withColumn("centroid_sha256", F.sha2(F.array_join(F.col("centroid").cast("array<string>"), ",").cast("binary"), 256)).drop("centroid")


def _rounds_sql() -> str:
    """Each round as two tables: assignments a0, a1, ... by centroids c0, c1, ..."""
    parts = []
    for n in range(ROUNDS + 1):
        parts.append(f"""a{n} AS MATERIALIZED (
  SELECT vec_id, min(o) AS o FROM (SELECT v.vec_id, {{'d': sum((v.x - c.x) * (v.x - c.x))::BIGINT, 'k': c.k}} AS o FROM v JOIN c{n} c USING (j) GROUP BY v.vec_id, c.k) GROUP BY vec_id
)""")
        if n < ROUNDS:
            parts.append(f"""c{n + 1} AS MATERIALIZED (
  SELECT c.k, c.j, coalesce(m.x, c.x) AS x FROM c{n} c LEFT JOIN (
    SELECT o.k AS k, j, (sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*) AS x FROM a{n} JOIN v USING (vec_id) GROUP BY o.k, j
  ) m USING (k, j)
)""")
    return ",\n".join(parts)


#: DuckDB; ids must be unique.
OP13_SQL = f"""
WITH kept AS MATERIALIZED (
  SELECT vec_id, embedding FROM embeddings WHERE len(embedding) = {DIMENSION} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {DIMENSION}
), v AS MATERIALIZED (
  SELECT vec_id, unnest(range({DIMENSION})) AS j, unnest(list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT)) AS x FROM kept
), first AS (
  SELECT vec_id, row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id::VARCHAR)) - 1 AS k FROM kept QUALIFY k < {CLUSTERS}
), c0 AS MATERIALIZED (
  SELECT k, j, x FROM first JOIN v USING (vec_id)
), {_rounds_sql()}
SELECT vec_id, o.k::INTEGER AS cluster, o.d AS distance, (sum(o.d) OVER (PARTITION BY o.k))::BIGINT AS cluster_inertia, (sum(o.d) OVER ())::BIGINT AS inertia, h AS centroid_sha256
FROM a{ROUNDS} JOIN (SELECT k, sha256(string_agg(x::VARCHAR, ',' ORDER BY j)) AS h FROM c{ROUNDS} GROUP BY k) s ON s.k = o.k
"""
