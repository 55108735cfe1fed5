"""Libraries of taught items as tables: insert-only merges, upserts, what is pending, pairs of exports and files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def insert_only(stored: DataFrame, new: DataFrame, keys: list[str], unless_blank: str | None = None) -> DataFrame:
    """Stored rows and those new ones whose key isn't there; new rows with a blank rendering don't count."""
    rows = new if unless_blank is None else new.filter(F.coalesce(F.trim(unless_blank), F.lit("")) != "")
    return stored.unionByName(rows.dropDuplicates(keys).join(stored, keys, "left_anti"))


def upsert(stored: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """New rows, and the stored ones whose key they don't have."""
    return stored.join(new, keys, "left_anti").unionByName(new)


def remove(stored: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return stored.join(gone, keys, "left_anti")


def pending(items: DataFrame, known: DataFrame, files: DataFrame, key: str) -> DataFrame:
    """(key, status): `taught` with the same hash, `missing` without a file, else `pending`."""
    both = items.join(known.withColumnRenamed("hash", "__hash"), key, "left").join(files.select(key, F.lit(True).alias("__file")), key, "left")
    status = F.when(F.col("__hash") == F.col("hash"), "taught").when(F.col("__file").isNull(), "missing").otherwise("pending")
    return both.select(key, status.alias("status"))


def unique_exports(exports: DataFrame, keys: list[str], modified: str, tie: str) -> DataFrame:
    """The earliest version of each export."""
    order = W.partitionBy(*keys).orderBy(modified, tie)
    return exports.withColumn("__r", F.row_number().over(order)).filter("__r = 1").drop("__r")


def pair_exports(exports: DataFrame, files: DataFrame, tolerance: int) -> DataFrame:
    """(export_id, name, file_id, reason): each export with the file of its name whose duration is within the tolerance.

    The exported range goes before the whole sequence, then the nearest duration, then the
    smaller id. A file that several exports claim goes to none.
    """
    near = lambda d: F.abs(F.col(d) - F.col("file_ms"))
    width = max(1, tolerance)
    cell = lambda c: F.floor(F.col(c) / width)
    around = lambda c: F.coalesce(F.sequence(cell(c) - 1, cell(c) + 1), F.array().cast("array<bigint>"))
    cells = F.array_union(around("range_ms"), around("whole_ms"))
    named = exports.withColumn("__cell", F.explode(cells)).join(files.withColumn("__cell", cell("file_ms")), ["name", "__cell"])
    rank = F.when(near("range_ms") <= tolerance, 0).when(near("whole_ms") <= tolerance, 1)
    best = (
        named.withColumn("rank", rank)
        .filter("rank IS NOT NULL")
        .groupBy("export_id")
        .agg(F.min(F.struct("rank", F.when(F.col("rank") == 0, near("range_ms")).otherwise(near("whole_ms")).alias("d"), "file_id")).alias("m"))
        .select("export_id", "m.file_id")
    )
    claims = best.groupBy("file_id").agg(F.count("*").alias("claims"))
    names = files.select("name").distinct().withColumn("named", F.lit(True))
    joined = exports.join(best.join(claims, "file_id"), "export_id", "left").join(names, "name", "left")
    reason = (
        F.when(F.col("named").isNull(), "no file of this name").when(F.col("file_id").isNull(), "no file of this length").when(F.col("claims") > 1, "claimed more than once")
    )
    return joined.select("export_id", "name", F.when(F.col("claims") == 1, F.col("file_id")).alias("file_id"), reason.alias("reason"))


def latest_state(events: DataFrame, key: str, order: list[str], always: list[str], kept: list[str]) -> DataFrame:
    """One row a key: `always` from the last event, `kept` from the last one that has a value."""
    by = F.struct(*order)
    last = lambda c: F.max_by(c, by)
    known = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), by))
    return events.groupBy(key).agg(*[last(c).alias(c) for c in always], *[known(c).alias(c) for c in kept], F.count("*").alias("events"))


def outcome(cancelled: Column, done: Column, error: Column, code: Column) -> Column:
    """How a job ended: cancelled before done before error before the exit code."""
    return F.when(cancelled, "cancelled").when(done, "completed").when(error, "failed").when(code == 0, "completed").otherwise("failed")
