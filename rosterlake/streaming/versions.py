"""A table of versions that a stream appends to exactly once: batches, each committed by one rename, and bases that gather them."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators import upserts


class VersionStore:
    """Numbered versions of keys under a folder that driver and executors share.

    A batch is written to a folder of its own and counts once its mark is renamed into the log, which a file system like
    HDFS does as one step. A batch that comes again after a crash before that step is written anew, from the same state, and
    one that comes after it is passed over; so each batch stands in the table once. Readers see whole batches only.
    """

    def __init__(self, spark: SparkSession, path: str, key: str, order: list[str], version: str = "version_number") -> None:
        self.spark, self.path, self.key, self.order, self.version = spark, path.rstrip("/"), key, order, version

    def _fs(self, path: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), where

    def _log(self) -> list[str]:
        fs, where = self._fs(f"{self.path}/log")
        return [x.getPath().getName() for x in fs.listStatus(where)] if fs.exists(where) else []

    def committed(self) -> tuple[int | None, list[int]]:
        """(the last batch that the newest base holds, the batches after it)."""
        marks = [re.fullmatch(r"(base|batch)-(\d+)", x) for x in self._log()]
        base = max((int(m[2]) for m in marks if m and m[1] == "base"), default=None)
        return base, sorted(int(m[2]) for m in marks if m and m[1] == "batch" and (base is None or int(m[2]) > base))

    def _commit(self, name: str, schema: StructType) -> None:
        """The mark holds the schema, so that a batch without rows, and so perhaps without files, can be read."""
        fs, mark = self._fs(f"{self.path}/log/{name}")
        _, made = self._fs(f"{self.path}/ready/{name}")
        fs.mkdirs(mark.getParent())
        fs.mkdirs(made.getParent())
        out = fs.create(made, True)
        out.write(bytearray(schema.json().encode()))
        out.close()
        if not fs.rename(made, mark):
            raise RuntimeError(f"{name} is committed already")

    def _data(self, name: str) -> DataFrame:
        """A committed batch or base."""
        schema = StructType.fromJson(json.loads(self.spark.read.text(f"{self.path}/log/{name}", wholetext=True).first()[0]))
        return self.spark.read.schema(schema).parquet(f"{self.path}/data/{name}")

    def stored(self) -> DataFrame | None:
        """All committed versions, without saying which are current; None before the first batch."""
        base, batches = self.committed()
        tables = [self._data(f"batch-{b}") for b in batches]
        if base is not None:
            tables.insert(0, self._data(f"base-{base}").drop("is_current"))
        return reduce(DataFrame.unionByName, tables) if tables else None

    def read(self) -> DataFrame:
        """All committed versions with is_current: the last one of each key."""
        every = self.stored()
        if every is None:
            raise ValueError("no batch has been committed")
        return upserts.flag_current(every, self.key, self.version)

    def current(self) -> DataFrame:
        """The last version of each key: of the newest base its current rows alone are read, and the batches after it."""
        base, batches = self.committed()
        if base is None:
            return self.read().filter("is_current").drop("is_current")
        rows = reduce(DataFrame.unionByName, [self._data(f"batch-{b}") for b in batches], self._data(f"base-{base}").filter("is_current").drop("is_current"))
        return upserts.flag_current(rows, self.key, self.version).filter("is_current").drop("is_current")

    def append(self, batch: DataFrame, batch_id: int) -> None:
        """Number the batch's rows after the versions that their keys have, in the order given, and commit them as this batch."""
        base, batches = self.committed()
        if batch_id in batches or base is not None and batch_id <= base:
            return
        self._commit(f"batch-{batch_id}", self._write(batch, batch_id))

    def _write(self, batch: DataFrame, batch_id: int) -> StructType:
        old = self.stored()
        if old is None:
            place = F.row_number().over(Window.partitionBy(self.key).orderBy(*self.order))
            made = batch.withColumn(self.version, place.cast("int"))
        else:
            made = upserts.number_versions(batch, old, self.key, self.version, self.order)
        made.write.mode("overwrite").parquet(f"{self.path}/data/batch-{batch_id}")
        return made.schema

    def gather(self) -> None:
        """Put all committed batches into one base, its rows by whether they are current, so that readers of current rows read no others."""
        base, batches = self.committed()
        if not batches:
            return
        name = f"base-{batches[-1]}"
        rows = self.read()
        rows.write.mode("overwrite").partitionBy("is_current").parquet(f"{self.path}/data/{name}")
        self._commit(name, rows.schema)

    def sink(self, parse: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
        """For foreachBatch: parse runs inside the batch, on its rows alone."""
        return lambda batch, batch_id: self.append(parse(batch), batch_id)
