"""Helpers shared by the training-text operators: tables, shared storage, column checks."""

from __future__ import annotations

import contextlib
import ctypes
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Where intermediate tables go when no cluster setting names a shared folder (single-machine runs only).
LOCAL_DIR = "/tmp/checkpoints"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: `spark.checkpoint.dir`, or a local one for a local master."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"file://{LOCAL_DIR}"


def written(df: DataFrame, label: str) -> DataFrame:
    """`df` as a Parquet table in the shared folder: lineage ends here, a lost executor costs nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def give_back() -> None:
    """Returns memory that a Python worker no longer uses to the system; idle workers stay for a minute."""
    with contextlib.suppress(OSError, AttributeError):  # only this C library has it
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def require(df: DataFrame, *columns: str) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; there are {df.columns}")


def fold(column: str | Column) -> Column:
    """crc32 of the id as text, modulo 3; remainder 1 is held out."""
    c = F.col(column) if isinstance(column, str) else column
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % 3


def seeded(column: str | Column, seed: int) -> Column:
    """32 hex digits that order rows at random, but alike in every run."""
    c = F.col(column) if isinstance(column, str) else column
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(c.cast("string"), F.lit(""))).cast("binary"))


def seeded_number(hexed: Column) -> Column:
    """The first 60 bits of such digits as a number of 0 or more."""
    return F.conv(F.substring(hexed, 1, 15), 16, 10).cast("bigint")
