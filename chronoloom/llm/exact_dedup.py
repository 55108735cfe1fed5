"""Exact dedup: group by a 128-bit content hash, compare bytes inside the groups.

1. A first pass over the texts makes one small row per document (hash, size) and counts each
   hash. Only these small rows move, pre-aggregated in each task.
2. A second pass joins the texts with the hashes of several documents. A text of another hash
   is settled. The texts of the others, a small share, are kept in a written table.
3. There the rows are grouped by hash *and bytes*, so two texts that share a hash by accident
   come apart. Each group keeps one row; members find it again by a join.

A group may hold any share of all rows: grouping pre-aggregates in each task and both joins
have one row per key on one side, a written table, so adaptive execution splits a hot key on
the other.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import require, table, written

#: Space, tab, newline, vertical tab, form feed, carriage return.
SPACES = r"[\x20\x09-\x0D]+"


def without_spaces(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, "")


def content_hash(norm: Column) -> Column:
    return F.unhex(F.md5(norm.cast("binary")))


def exact_dedup(
    df: DataFrame,
    text_col: str = "text",
    id_col: str = "doc_id",
    normalise: Callable[[Column], Column] = without_spaces,
    hashed: Callable[[Column], Column] = content_hash,
) -> DataFrame:
    """One row per row of `df`: id, keep_id, group_size, kept, text_sha256 (of the normalised text).

    Of rows with equal normalised texts, the one with the most code points in the original
    text stays, then the one with the smallest id. A null text counts as empty, so null and
    empty texts are one group. Ids must be unique; a null id is an id of its own that comes
    last among ties. Rows that repeat an id and text are both kept or both dropped. Other
    columns, whatever their names, don't matter. An empty table gives an empty result.
    `hashed` can be any hash; a weak one costs time but no rightness.
    """
    require(df, text_col, id_col)
    norm = normalise(F.col(text_col))
    rows = df.select(
        F.col(id_col).alias("id"),
        F.length(F.coalesce(F.col(text_col), F.lit(""))).cast("bigint").alias("size"),
        norm.alias("norm"),
    ).withColumn("hash", hashed(F.col("norm")))
    shared = written(rows.groupBy("hash").agg(F.count("*").alias("n")).filter("n > 1"), "exact-dedup-hashes")
    joined = rows.withColumn("text_sha256", F.sha2(F.col("norm").cast("binary"), 256)).join(shared, "hash", "left")
    marked = written(
        joined.select("id", "size", "hash", "text_sha256", F.when(F.col("n") > 1, F.col("norm")).alias("norm")),
        "exact-dedup",
    )
    single, several = marked.filter("norm IS NULL"), marked.filter("norm IS NOT NULL")
    groups = several.groupBy("hash", "norm").agg(
        F.min(F.struct((-F.col("size")).alias("less"), F.col("id").isNull().alias("unknown"), "id")).alias("best"),
        F.count("*").alias("group_size"),
    )
    members = several.join(written(groups, "exact-dedup-groups"), ["hash", "norm"]).select(
        "id", F.col("best.id").alias("keep_id"), "group_size", "text_sha256"
    )
    alone = single.select("id", F.col("id").alias("keep_id"), F.lit(1).cast("bigint").alias("group_size"), "text_sha256")
    return alone.unionByName(members).select(
        F.col("id").alias(id_col),
        F.col("keep_id").alias("keep_id"),
        "group_size",
        F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
        "text_sha256",
    )


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


OP5_SQL = r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS size, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
  FROM documents
), k AS (
  SELECT doc_id, first_value(doc_id) OVER (PARTITION BY norm ORDER BY size DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY norm) AS group_size, sha256(norm) AS text_sha256
  FROM n
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM k
"""
