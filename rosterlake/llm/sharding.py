"""Sharding by histogram sort: exact counts below candidate boundaries are refined until the splitters meet a tolerance.

Each row has one 64-bit key: the upper bits hash its text, the lower bits its id, so equal texts lie together in key order
and a text that holds a third of all rows can still be cut. Each round, every task counts rows and bytes between the current
boundaries; bins that hold a wanted splitter, or more rows than one task should sort, are cut finer. When every shard's
splitter is within tolerance, the histogram already says where each bin starts in its shard, and the rows move once, bin by
bin, to be numbered. The driver holds bins, never rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, fresh, saved

LAW = "bytes"
MOST_BINS = 1 << 16
_TEXT_BITS = ~((1 << 20) - 1)


def key_column(text, *ids):
    """Equal texts share the upper 44 bits; the ids decide the lower 20."""
    low = F.xxhash64(*ids).bitwiseAND(F.lit((1 << 20) - 1))
    return F.xxhash64(text).bitwiseAND(F.lit(_TEXT_BITS)).bitwiseOR(low)


def count_bins(keys: DataFrame, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows, bytes) of keys(key, size) in each bin [edges[i], edges[i+1])."""
    bins = len(edges) - 1

    def tally(batches):
        rows, size = np.zeros(bins, np.int64), np.zeros(bins, np.int64)
        for batch in batches:
            at = np.searchsorted(edges, batch.column(0).to_numpy(), side="right") - 1
            rows += np.bincount(at, minlength=bins)
            np.add.at(size, at, batch.column(1).to_numpy())
        some = np.flatnonzero(rows)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(rows[some]), pa.array(size[some])], names=["bin", "n", "b"])

    got = keys.mapInArrow(tally, "bin long, n long, b long").groupBy("bin").agg(F.sum("n").alias("n"), F.sum("b").alias("b")).toPandas()  # at most one row a bin
    rows, size = np.zeros(bins, np.int64), np.zeros(bins, np.int64)
    rows[got["bin"]], size[got["bin"]] = got["n"], got["b"]
    return rows, size


def _cut(edges: np.ndarray, bins: set[int], ways: int) -> np.ndarray:
    """edges with each of these bins cut evenly; a bin of one key stays."""
    new = [edges]
    for i in bins:
        low, high = int(edges[i]), int(edges[i + 1])
        steps = min(ways, high - low)
        if steps > 1:
            new.append(np.array([low + (high - low) * j // steps for j in range(1, steps)], dtype=np.int64))
    return np.unique(np.concatenate(new))


def find_splitters(keys: DataFrame, shards: int, tolerance: float, bin_rows: int, ways: int = 64) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(edges, shard of each bin, first slot of each bin) over keys(key, size)."""
    low, high = -(1 << 63), (1 << 63) - 1
    edges = np.array([low + (high - low) * j // 256 for j in range(256)] + [high], dtype=np.int64)
    while True:
        rows, size = count_bins(keys, edges)
        below = np.concatenate([[0], np.cumsum(size)])
        total = int(below[-1])
        wanted = [total * s / shards for s in range(1, shards)]
        slack = tolerance * total / shards
        # The number of bins, which the driver holds and every task knows, stays bounded whatever the number of rows.
        heavy = set(np.flatnonzero(rows > max(bin_rows, int(rows.sum()) // MOST_BINS)).tolist())
        open_ = set()
        for w in wanted:
            i = int(np.clip(np.searchsorted(below, w, side="right") - 1, 0, len(rows) - 1))
            if min(w - below[i], below[i + 1] - w) > slack:
                open_.add(i)
        finer = np.union1d(_cut(edges, heavy, 8), _cut(edges, open_, ways))
        if len(finer) == len(edges):
            break
        edges = finer
    # Each splitter is the nearest boundary; among boundaries within the slack, one between two texts is preferred.
    splits = []
    for w in wanted:
        near = np.flatnonzero(np.abs(below - w) <= slack)
        between = [i for i in near.tolist() if 0 < i < len(rows) and edges[i] & ((1 << 20) - 1) == 0]
        splits.append(min(between or [int(np.argmin(np.abs(below - w)))], key=lambda i: (abs(below[i] - w), i)))
    splits = np.maximum.accumulate(np.array(splits, dtype=np.int64)) if splits else np.empty(0, np.int64)
    shard = np.searchsorted(splits, np.arange(len(rows)), side="right")
    before = np.concatenate([[0], np.cumsum(rows)])[:-1]
    first = before - np.array([before[np.searchsorted(shard, s)] for s in shard], dtype=np.int64) if len(rows) else before
    return edges, shard, first


def shard_documents(
    docs: DataFrame,
    *,
    shards: int = 16,
    text: str = "text",
    key: str = "doc_id",
    tolerance: float = 0.002,
    bin_rows: int = 50_000,
    keep: list[str] | None = None,
) -> DataFrame:
    """The kept columns of docs (all by default) with size, shard, slot and law added, under the law `bytes`.

    size is the text's UTF-8 bytes plus 1 (1 for null). Every shard's bytes come within tolerance of an equal share, up to
    the size of one document; slots run gapless from 0 in each shard, in key order. Equal texts stay together except where a
    splitter must fall inside their group. Repeated rows get a slot each; which of two equal rows comes first does not
    matter to any column. An empty table gives an empty result; clashing names take a leading underscore.
    """
    keep = docs.columns if keep is None else keep
    size, shard, slot, law, place, place_bin, b, s, f = (fresh(c, [*keep, *docs.columns]) for c in ("size", "shard", "slot", "law", "_key", "_bin", "_b", "_s", "_f"))
    rows = docs.select(
        *[F.col(c) for c in keep],
        (F.coalesce(F.octet_length(F.col(text)), F.lit(0)) + 1).cast("long").alias(size),
        key_column(F.col(text), F.col(key)).alias(place),
    )
    keys = saved(rows.select(F.col(place).alias("key"), F.col(size).alias("size")), "shard-keys")
    edges, owner, first = find_splitters(keys, shards, tolerance, bin_rows)
    discard(keys)
    by_bin = pd.DataFrame({b: np.arange(len(owner)), s: owner.astype(np.int32), f: first})

    @F.pandas_udf("long")
    def bin_of(k: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(edges, k.to_numpy(), side="right") - 1)

    placed = rows.withColumn(place_bin, bin_of(F.col(place)))
    known = F.broadcast(docs.sparkSession.createDataFrame(by_bin, f"{b} long, {s} int, {f} long"))  # one row a bin, see MOST_BINS
    numbered = placed.withColumn(slot, F.row_number().over(Window.partitionBy(place_bin).orderBy(place, key, size)))
    out = numbered.join(known, F.col(place_bin) == F.col(b), "left")
    return out.select(*[F.col(c) for c in keep], F.col(size), F.col(s).alias(shard), (F.col(f) + F.col(slot) - 1).alias(slot), F.lit(LAW).alias(law))


def write_shards(docs: DataFrame, path: str, **options) -> None:
    """Write docs as one folder per shard, rows in slot order within each file."""
    out = shard_documents(docs, **options)
    shard = fresh("shard", docs.columns)
    out.repartition(F.col(shard), F.floor(F.col(fresh("slot", docs.columns)) / 100_000)).sortWithinPartitions(shard, fresh("slot", docs.columns)).write.partitionBy(shard).parquet(path)
