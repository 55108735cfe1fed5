"""Python over very many small groups, without a frame of pandas for each."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def in_groups(rows: DataFrame, keys: list[str], order: list[str], run: Callable[[list[tuple]], Iterable[tuple]], schema: str | StructType) -> DataFrame:
    """What `run` makes of each key's rows: they come in `order`, as tuples of the columns of `rows`; it gives tuples of `schema`.

    As `groupBy(*keys).applyInPandas`, but a task goes over its groups in one stream of sorted rows, so a group costs no more than its rows do. Rows are
    dealt by the first key: the other keys number parts of it.
    """
    key = itemgetter(*[rows.columns.index(k) for k in keys])
    types = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given = to_arrow_schema(types)
        batch_of = lambda out: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), given, strict=True)], schema=given)
        held, of = [], None
        for batch in batches:
            out = []
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if held and key(row) != of:
                    out += run(held)
                    held = []
                if not held:
                    of = key(row)
                held.append(row)
            if out:
                yield batch_of(out)
        if held and (out := list(run(held))):
            yield batch_of(out)

    return rows.repartition(keys[0]).sortWithinPartitions(*keys, *order).mapInArrow(go, types)
