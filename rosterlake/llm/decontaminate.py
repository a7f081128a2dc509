"""Benchmark decontamination: test n-grams as a broadcast hash set, token windows of whole training texts scanned against it.

Words are the runs of letters and digits of any script, A-Z folded. The windows of the test items are hashed once; each
task hashes the windows of its documents by array operations, looks them up, and compares the words themselves before a hit
counts. Documents are not shuffled. The set's size is counted before it is sent; test items beyond max_set_bytes are sent in
blocks, each scanned against all documents, and the blocks' hits are merged per document.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words as W
from .common import fold_ascii, fresh, saved, text_batches

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def item_windows(items: DataFrame, item: str, text: str, n: int) -> DataFrame:
    """(item, window): the distinct n-word windows of each item as one string; a shorter item is one window."""
    found = F.regexp_extract_all(fold_ascii(F.col(text).cast("string")), F.lit(WORD), F.lit(0))
    base = items.select(F.col(item).cast("string").alias("item"), found.alias("w")).filter("item IS NOT NULL AND size(w) > 0")
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - n + 1))
    return base.select("item", F.explode(F.transform(starts, lambda i: F.array_join(F.slice("w", i, n), " "))).alias("window")).distinct()


class WindowSet:
    """Windows by length: sorted hashes, with the words and the items of each."""

    def __init__(self, rows: list[tuple[str, str]]) -> None:
        owners: dict[bytes, list[str]] = {}
        for item, window in rows:
            owners.setdefault(window.encode(), []).append(item)
        by_length: dict[int, list[tuple[int, bytes]]] = {}
        for window in owners:
            data = np.frombuffer(window, np.uint8)
            _, _, h, _ = W.scan(data, np.array([0, len(data)]), W.LETTERS)
            by_length.setdefault(len(h), []).append((int(W.runs(h, len(h))[0]), window))
        self.owners = owners
        self.tables = {}
        for k, found in by_length.items():
            where: dict[int, list[bytes]] = {}
            for h, window in found:
                where.setdefault(h, []).append(window)
            self.tables[k] = (np.array(sorted(where), dtype=np.uint64), where)

    def hits(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, hashes: np.ndarray, first: np.ndarray):
        """(first word, number of words, window) of every verified occurrence that lies within one row."""
        for k, (known, where) in self.tables.items():
            got = W.runs(hashes, k)
            if not len(got):
                continue
            near = np.minimum(np.searchsorted(known, got), len(known) - 1)
            for i in np.flatnonzero(known[near] == got).tolist():
                row = int(np.searchsorted(first, i, side="right")) - 1
                if i + k > first[row + 1]:
                    continue
                words = b" ".join(data[a:b].tobytes().lower() for a, b in zip(start[i : i + k], end[i : i + k]))
                for window in where[int(got[i])]:
                    if window == words:
                        yield row, i, k, window


def _scan_block(docs: DataFrame, text_at: int, names: list[str], schema: T.StructType, found) -> DataFrame:
    """docs without its text, with the number of words, the spans hit (first and last word, first and last byte) and the items found."""

    def search(batches):
        windows = found.value
        for batch in batches:
            column = batch.column(text_at)
            n_words, spans, items = np.zeros(batch.num_rows, np.int64), [[] for _ in range(batch.num_rows)], [set() for _ in range(batch.num_rows)]
            for a, b in W.slices(column):
                data, at = W.text_bytes(column.slice(a, b - a))
                start, end, hashes, first = W.scan(data, at, W.LETTERS)
                n_words[a:b] = np.diff(first)
                for row, i, k, window in windows.hits(data, start, end, hashes, first):
                    items[a + row].update(windows.owners[window])
                    spans[a + row].append({"word": i - int(first[row]), "words": k, "byte": int(start[i] - at[row]), "end": int(end[i + k - 1] - at[row])})
            for own in spans:
                own.sort(key=lambda s: (s["word"], s["words"]))
            kept = [i for i in range(batch.num_columns) if i != text_at]
            added = [pa.array(n_words), pa.array(spans, _SPANS), pa.array([sorted(x) for x in items], pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in kept), *added], names=[*(batch.schema.names[i] for i in kept), *names])

    return docs.mapInArrow(search, schema)


_SPANS = pa.list_(pa.struct([("word", pa.int64()), ("words", pa.int64()), ("byte", pa.int64()), ("end", pa.int64())]))
_SPAN_TYPE = "array<struct<word:bigint,words:bigint,byte:bigint,end:bigint>>"


def _covered(spans: Column) -> Column:
    """Words inside any of the spans, which are sorted by their first word."""
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("to"))

    def step(acc, s):
        stop = s["word"] + s["words"]
        return F.struct((acc["n"] + F.greatest(F.lit(0), stop - F.greatest(acc["to"], s["word"]))).alias("n"), F.greatest(acc["to"], stop).alias("to"))

    return F.aggregate(spans, zero, step, lambda acc: acc["n"])


def find_contamination(
    docs: DataFrame,
    items: DataFrame,
    *,
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    n: int = 10,
    keep: list[str] | None = None,
    max_set_bytes: int = 64 << 20,
) -> DataFrame:
    """The kept columns of docs (all by default), one row per row of docs, with n_words, n_hit, spans, items and contaminated.

    spans are the occurrences found, by word and by UTF-8 byte, in order; items the distinct item ids as text, sorted.
    A null text has no words and no hits; items without an id or without words have no window; an id that stands in
    several rows of items is one item. An empty items table leaves every document clean. Result names that clash with a
    kept column take a leading underscore.
    """
    keep = docs.columns if keep is None else keep
    spark = docs.sparkSession
    text_batches(spark)
    windows = saved(item_windows(items, item, item_text, n), "windows")
    size = windows.agg(F.coalesce(F.sum(F.octet_length("window") * 2 + F.octet_length("item") + 400), F.lit(0)).alias("b")).first()["b"]
    blocks = max(1, -(-size // max_set_bytes))
    names = [fresh(c, keep) for c in ("n_words", "spans", "items")]
    own_text, row, all_spans, all_items = (fresh(c, [*keep, *names]) for c in ("_text", "_row", "_s", "_i"))
    slim = docs.select(*[F.col(c) for c in keep], F.col(text).cast("string").alias(own_text))
    schema = slim.drop(own_text).schema.add(names[0], "long").add(names[1], T.ArrayType(T.StructType([T.StructField(x, T.LongType()) for x in ("word", "words", "byte", "end")]))).add(names[2], T.ArrayType(T.StringType()))
    out = None
    if blocks > 1:  # rows need a name under which the blocks' hits meet again
        slim = saved(slim.withColumn(row, F.monotonically_increasing_id()).select(row, *keep, own_text), "decontaminate-rows")
        schema = T.StructType([T.StructField(row, T.LongType()), *schema.fields])
    parts = []
    for b in range(blocks):
        own = windows if blocks == 1 else windows.filter(F.pmod(F.xxhash64("window"), F.lit(blocks)) == b)
        sent = spark.sparkContext.broadcast(WindowSet([(r["item"], r["window"]) for r in own.collect()]))  # at most max_set_bytes
        parts.append(_scan_block(slim, len(slim.columns) - 1, names, schema, sent))
    if blocks == 1:
        out = parts[0]
    else:
        hits = reduce(DataFrame.unionByName, [p.filter(F.size(names[1]) > 0).select(row, names[1], names[2]) for p in parts])
        merged = hits.groupBy(row).agg(F.array_sort(F.flatten(F.collect_list(names[1]))).alias(all_spans), F.array_sort(F.array_distinct(F.flatten(F.collect_list(names[2])))).alias(all_items))
        out = parts[0].drop(names[1], names[2]).join(merged, row, "left")
        out = out.withColumns({names[1]: F.coalesce(all_spans, F.array().cast(_SPAN_TYPE)), names[2]: F.coalesce(all_items, F.array().cast("array<string>"))}).drop(row, all_spans, all_items)
    hit = fresh("n_hit", keep)
    return out.withColumn(hit, _covered(F.col(names[1]))).withColumn(fresh("contaminated", keep), F.size(names[1]) > 0)


def cut_spans(text: Column, spans: Column) -> Column:
    """text without the bytes that its spans cover."""
    whole = text.cast("binary")
    zero = F.struct(F.lit(b"").alias("kept"), F.lit(0).cast("long").alias("to"))

    def step(acc, s):
        gap = F.greatest(F.lit(0), s["byte"] - acc["to"])
        piece = F.substring(whole, (acc["to"] + 1).cast("int"), gap.cast("int"))
        return F.struct(F.concat(acc["kept"], piece).alias("kept"), F.greatest(acc["to"], s["end"]).alias("to"))

    return F.aggregate(spans, zero, step, lambda acc: F.concat(acc["kept"], F.substring(whole, (acc["to"] + 1).cast("int"), F.octet_length(text)))).cast("string")


def remove_contamination(docs: DataFrame, items: DataFrame, *, how: str = "documents", text: str = "text", **options) -> DataFrame:
    """docs without contaminated rows (how="documents"), or with the words hit cut from their texts (how="spans")."""
    if how not in {"documents", "spans"}:
        raise ValueError("how is documents or spans")
    columns = docs.columns
    marked = find_contamination(docs, items, text=text, **options)
    spans, flag = fresh("spans", columns), fresh("contaminated", columns)
    if how == "documents":
        return marked.filter(~F.col(flag)).select(*columns)
    return marked.withColumn(text, F.when(F.col(flag), cut_spans(F.col(text), F.col(spans))).otherwise(F.col(text))).select(*columns)


def ids_digest(ids: Column) -> Column:
    """Lower-case hex SHA-256 of the sorted ids, comma-joined."""
    return F.sha2(F.array_join(F.array_sort(ids), ","), 256)


EMPTY_DIGEST = hashlib.sha256(b"").hexdigest()
