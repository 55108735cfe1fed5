"""Sharding by a permutation-filled lookup table.

Every shard walks its own permutation of a prime number of slots; the shards take turns and
each turn claims the next free slot of the walk. A document's key hashes to a slot, the slot
names the shard. The table is made once on the driver, has `table_size` rows (at most
`MAX_TABLE`), and reaches the rows as a broadcast join, so placement is one hash lookup and
no row is shuffled. Removing a shard moves few documents besides those it held.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import require, seeded, seeded_number

#: The most slots a table may have: 12 bytes a row, so the broadcast is of 13 MB at most.
MAX_TABLE = 1 << 20


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def walk(name: str, size: int) -> tuple[int, int]:
    """First slot and step of a shard's permutation."""
    digest = hashlib.md5(name.encode()).hexdigest()
    return int(digest[:8], 16) % size, int(digest[8:16], 16) % (size - 1) + 1


def fill(names: list[str], size: int) -> list[int]:
    """For each slot the index of the shard that claimed it."""
    if not names or len(set(names)) < len(names):
        raise ValueError("shard names must be given and differ")
    if not _is_prime(size) or not len(names) <= size <= MAX_TABLE:
        raise ValueError(f"table size must be a prime of at least {len(names)} and at most {MAX_TABLE}")
    owner, at = [-1] * size, []
    walks = [walk(n, size) for n in names]
    at = [first for first, _ in walks]
    left = size
    while left:
        for i, (_, step) in enumerate(walks):
            while owner[at[i]] >= 0:
                at[i] = (at[i] + step) % size
            owner[at[i]] = i
            left -= 1
            if not left:
                break
    return owner


def lookup_table(spark: SparkSession, names: list[str], size: int) -> DataFrame:
    """(slot, shard): the filled table as rows, made from one literal."""
    owners = F.from_json(F.lit(json.dumps(fill(names, size))), "array<int>")
    return spark.range(1).select(F.posexplode(owners).alias("slot", "shard"))


def assign_shards(
    df: DataFrame,
    key: str = "doc_id",
    n_shards: int = 32,
    table_size: int = 4099,
    names: list[str] | None = None,
    seed: int = 0,
) -> DataFrame:
    """`df` with `slot` and `shard` (0-based index into `names`), one row for each input row.

    Equal keys go to one shard; a null key counts as the empty string. Columns of `df` called
    slot or shard are replaced. An empty table gives an empty result. Texts are not read.
    """
    require(df, key)
    names = names or [f"shard-{i:05d}" for i in range(n_shards)]
    kept = df.drop("slot", "shard") if key not in ("slot", "shard") else df.withColumnRenamed(key, key := "__key")
    slots = lookup_table(df.sparkSession, names, table_size)
    placed = kept.withColumn("slot", (seeded_number(seeded(key, seed)) % table_size).cast("int"))
    return placed.join(F.broadcast(slots), "slot", "left").select(*kept.columns, "slot", "shard")


#: 32 shards; a prime over 100 times as large keeps the shards' shares within 1 % of each other.
N_SHARDS, TABLE_SIZE = 32, 4099


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id")
    return assign_shards(docs, "doc_id", N_SHARDS, TABLE_SIZE)


#: DuckDB: the same table, filled one claim at a time; then the same placement.
OP3_SQL = f"""
WITH RECURSIVE shards AS (
  SELECT i, ('0x' || substr(h, 1, 8))::BIGINT % {TABLE_SIZE} AS first, ('0x' || substr(h, 9, 8))::BIGINT % {TABLE_SIZE - 1} + 1 AS step
  FROM (SELECT i, md5('shard-' || lpad(i::VARCHAR, 5, '0')) AS h FROM range({N_SHARDS}) t(i))
), fill(slot, shard, n) USING KEY (slot) AS (
  SELECT first, i, 0::BIGINT FROM shards WHERE i = 0
  UNION
  SELECT slot, shard, n FROM (
    SELECT (first + j * step) % {TABLE_SIZE} AS slot, s.i AS shard, x.n, row_number() OVER (ORDER BY j) AS o
    FROM (SELECT max(n) + 1 AS n FROM fill) x JOIN shards s ON s.i = x.n % {N_SHARDS}, range({TABLE_SIZE}) r(j)
    WHERE x.n < {TABLE_SIZE} AND NOT EXISTS (SELECT 1 FROM recurring.fill f WHERE f.slot = (first + j * step) % {TABLE_SIZE})
  ) WHERE o = 1
)
SELECT d.doc_id, d.slot::INTEGER AS slot, fill.shard::INTEGER AS shard
FROM (SELECT doc_id, ('0x' || substr(md5('0:' || coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT % {TABLE_SIZE} AS slot FROM documents) d
JOIN fill ON fill.slot = d.slot
"""
