"""Scans that depend on order: a small state goes from row to row of each group."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def fold_rows(df: DataFrame, group: list[str], order: list[Column], start: Callable[[], object], step: Callable[[object, dict], tuple[object, tuple]], out: str) -> DataFrame:
    """df with the columns named in out (DDL): step(state, row) gives the next state and their values, row after row of each group in the order given.

    A group's rows pass through one task as a stream, since each depends on the one before; the task holds a batch of rows and
    one state, whatever the group's length. Null groups are one group. The order should be total: rows that tie may come in
    any order. Columns of df named like one of out are replaced.
    """
    made = StructType.fromDDL(out)
    df = df.drop(*made.names)
    schema = StructType([*df.schema.fields, *made.fields])
    kinds = [f.type for f in to_arrow_schema(made)]
    dealt = df.repartition(*[F.col(g) for g in group]).sortWithinPartitions(*[F.col(g) for g in group], *order)

    def run(batches):
        last, state = None, None
        for batch in batches:
            values = []
            for row in batch.to_pylist():
                key = tuple(row[g] for g in group)
                if last is None or key != last:
                    last, state = key, start()
                state, value = step(state, row)
                values.append(value)
            columns = [pa.array([v[i] for v in values], k) for i, k in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, *made.names])

    return dealt.mapInArrow(run, schema)
