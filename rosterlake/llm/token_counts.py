"""Token counts by separator scan of flat token files.

A token file is nothing but fixed-width big-endian token ids, each document followed by the end-of-document id; no index
says where documents begin. Spark's text reader cuts files of any size into splits at the separator's last byte, wherever it
stands; each task searches its split for the separator by array operations, in blocks, without knowing yet at which byte of
a token the split begins. A prefix sum over the splits' lengths says so, and drops what only looks like the separator across
two tokens; a prefix scan over the few numbers per block then joins what block and split borders cut.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import words as W
from .byte_bpe import RANKS, send_codec
from .common import saved, text_batches, work_path

#: The vocabulary's end-of-document id (a fixed value of the public tokenizer).
END_ID = 50256
_KIND = ">u2"
_WIDTH = 2


def write_token_files(docs: DataFrame, path: str, *, text: str = "text", key: str | None = None, ranks_path: str = RANKS, end_id: int = END_ID) -> None:
    """Flat files of token ids under path/kind=tokens, one per partition of docs, in row order, written by Spark's text writer.

    The writer puts bytes down as they are and ends each row with the line separator; that is the last byte of the
    end-of-document id, whose other byte ends the row. So the id's last byte must be ASCII. Null texts count as empty. With
    key, the same tasks write path/kind=keys: the keys as text, in hexadecimal, null as a hyphen, in the order of the
    documents of the token file of that number. The driver reads the file of ranks and sends it to the tasks.
    """
    spark = docs.sparkSession
    text_batches(spark)
    head, tail = end_id.to_bytes(_WIDTH, "big")[:-1], end_id & 0xFF
    if not 0 < tail < 128 or chr(tail).lower() in "0123456789abcdef-":
        raise ValueError("the last byte of the end-of-document id must be ASCII, not 0, no hexadecimal digit and no hyphen")

    codec = send_codec(spark, ranks_path)

    def encode(batches):
        for batch in batches:
            texts = batch.column(0)
            for a in range(0, len(texts), 256):
                own = [codec.value.encode(t).astype(_KIND).tobytes() + head for t in texts.slice(a, 256).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(["tokens"] * len(own)), pa.array(own, pa.binary())], names=["kind", "b"])
                if batch.num_columns > 1:
                    keys = ["-" if k is None else k.encode().hex() for k in batch.column(1).slice(a, 256).to_pylist()]
                    yield pa.RecordBatch.from_arrays([pa.array(["keys"] * len(keys)), pa.array([k.encode() for k in keys], pa.binary())], names=["kind", "b"])

    columns = [F.col(text).cast("string").alias("t"), *([F.col(key).cast("string").alias("k")] if key else [])]
    rows = docs.select(*columns).mapInArrow(encode, "kind string, b binary").select("kind", F.col("b").cast("string").alias("value"))
    # Both kinds of file stay open in a task, so rows are written as they come, without a sort.
    name = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(name)
    spark.conf.set(name, max(2, int(before)))
    try:
        rows.write.partitionBy("kind").option("lineSep", chr(tail)).option("compression", "none").text(path)
    finally:
        spark.conf.set(name, before)


def _split_bases(blocks: DataFrame) -> DataFrame:
    """blocks(file, split, bytes, n, ...) summed by split, with base (bytes of the file before it) and n0 (the sum of n before it)."""
    order = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    sums = blocks.groupBy("file", "split").agg(F.sum("bytes").alias("_b"), F.sum("n").alias("_n"))  # one row a reader split
    return sums.select("file", "split", F.coalesce(F.sum("_b").over(order), F.lit(0)).alias("base"), F.coalesce(F.sum("_n").over(order), F.lit(0)).alias("n0"))


def _read_pieces(spark: SparkSession, path: str, tail: int) -> DataFrame:
    raw = spark.read.option("lineSep", chr(tail)).text(path)
    meta = [F.col(f"_metadata.{a}").alias(b) for a, b in (("file_path", "file"), ("file_block_start", "split"), ("file_size", "file_bytes"))]
    return raw.select(*meta, F.col("value").cast("binary").alias("value"))


def _runs(batch: pa.RecordBatch):
    """Ranges of a batch's rows of one (file, split)."""
    files, splits = np.asarray(batch.column(0).dictionary_encode().indices), batch.column(1).to_numpy()
    edges = [0, *(np.flatnonzero((files[1:] != files[:-1]) | (splits[1:] != splits[:-1])) + 1).tolist(), len(splits)]
    return zip(edges, edges[1:])


def scan_token_files(spark: SparkSession, path: str, *, end_id: int = END_ID, block_bytes: int = 1 << 21) -> DataFrame:
    """(file, doc_no, start, n_tokens) for each document of the token files under path; the end id itself is not counted.

    Documents are numbered from 0 in file order; start counts tokens from the file's beginning. Two separators in a row
    enclose an empty document. Tokens after the last separator, or a file without one, are an unfinished document and are
    counted as one more. Empty files and folders give no rows. Files may have any size; one whose length is no multiple of
    a token's raises an error.
    """
    head, tail = divmod(end_id, 256)
    kind = pa.schema([("file", pa.string()), ("split", pa.int64()), ("file_bytes", pa.int64()), ("block", pa.int64()), ("at", pa.int64()), ("bytes", pa.int64()), ("n", pa.int64()), ("marks", pa.list_(pa.int64()))])

    def search(batches):
        """Blocks of each split: where the separator's bytes stand together, by the place of the second in the split."""
        place, at, block, held, size = None, 0, 0, [], 0

        def out():
            row = [*place, block, at, size, 0, np.concatenate(held) if held else np.empty(0, np.int64)]
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, kind)], schema=kind)

        for batch in batches:
            if not batch.num_rows:
                continue
            data, ends = W.text_bytes(batch.column(3))
            length = np.diff(ends)
            last = np.zeros(len(length), np.int64)
            last[length > 0] = data[ends[1:][length > 0] - 1]
            for a, b in _runs(batch):
                here = tuple(batch.column(i)[a].as_py() for i in range(3))
                if here != place:
                    if place and size:
                        yield out()
                    place, at, block, held, size = here, 0, 0, [], 0
                stops = at + size + np.cumsum(length[a:b] + 1)
                held.append(stops[last[a:b] == head] - 1)
                size = int(stops[-1]) - at
                if size >= block_bytes:
                    yield out()
                    at, block, held, size = at + size, block + 1, [], 0
        if place and size:
            yield out()

    found = saved(_read_pieces(spark, path, tail).mapInArrow(search, "file string, split long, file_bytes long, block long, at long, bytes long, n long, marks array<long>"), "token-blocks")
    placed = found.join(_split_bases(found).drop("n0"), ["file", "split"])
    # The last piece of a file may lack its separator; then the sums count one byte more than there is.
    begin = F.col("base") + F.col("at")
    stop = F.least(begin + F.col("bytes"), F.col("file_bytes"))
    true = F.filter(F.transform("marks", lambda m: m + F.col("base")), lambda m: (m % _WIDTH == _WIDTH - 1) & (m < F.col("file_bytes")))
    ends = F.transform(true, lambda m: (m - (_WIDTH - 1)) / _WIDTH).cast("array<long>")  # tokens before each separator
    whole = F.when(F.col("file_bytes") % _WIDTH == 0, F.col("file_bytes")).otherwise(F.raise_error(F.concat("file", F.lit(" does not hold whole token ids"))).cast("long"))
    blocks = placed.select("file", "split", "block", whole.alias("file_bytes"), (stop >= F.col("file_bytes")).alias("last"), ends.alias("ends"))
    # Prefix scan, one row a block: separators before it, and where the document open at its start began.
    order = Window.partitionBy("file").orderBy("split", "block").rowsBetween(Window.unboundedPreceding, -1)
    opened = F.coalesce(F.max(F.element_at("ends", -1) + 1).over(order), F.lit(0))
    scanned = blocks.withColumn("ends", F.when(F.size("ends") > 0, F.col("ends"))).withColumn("doc0", F.coalesce(F.sum(F.coalesce(F.size("ends"), F.lit(0))).over(order), F.lit(0))).withColumn("open", opened)
    own = F.transform(F.coalesce("ends", F.array().cast("array<long>")), lambda e, i: F.struct((F.col("doc0") + i).alias("doc_no"), F.when(i == 0, F.col("open")).otherwise(F.get("ends", i - 1) + 1).alias("start"), e.alias("stop")))
    tokens = (F.col("file_bytes") / _WIDTH).cast("long")
    begun = F.coalesce(F.element_at("ends", -1) + 1, F.col("open"))
    rest = F.when(F.col("last") & (tokens > begun), F.array(F.struct((F.col("doc0") + F.coalesce(F.size("ends"), F.lit(0))).alias("doc_no"), begun.alias("start"), tokens.alias("stop"))))
    every = F.concat(own, F.coalesce(rest, F.array().cast("array<struct<doc_no:bigint,start:bigint,stop:bigint>>")))
    return scanned.select("file", F.explode(every).alias("d")).select("file", F.col("d.doc_no").cast("long").alias("doc_no"), F.col("d.start").cast("long").alias("start"), (F.col("d.stop") - F.col("d.start")).cast("long").alias("n_tokens"))


def _read_keys(spark: SparkSession, path: str, tail: int) -> DataFrame:
    """(file, doc_no, key as text): the lines of the key files, numbered from 0 in file order."""
    kind = pa.schema([("file", pa.string()), ("split", pa.int64()), ("at", pa.int64()), ("bytes", pa.int64()), ("n", pa.int64()), ("key", pa.string())])

    def number(batches):
        place, at = None, 0
        for batch in batches:
            for a, b in _runs(batch) if batch.num_rows else ():
                part = batch.slice(a, b - a)
                here = (part.column(0)[0].as_py(), part.column(1)[0].as_py())
                if here != place:
                    place, at = here, 0
                values = part.column(3).to_pylist()
                keys = [None if v == b"-" else bytes.fromhex(v.decode()).decode() for v in values]
                own = [part.column(0), part.column(1), pa.array(np.arange(at, at + len(keys))), pa.array([len(v) + 1 for v in values], pa.int64()), pa.array(np.ones(len(keys), np.int64)), pa.array(keys, pa.string())]
                at += len(keys)
                yield pa.RecordBatch.from_arrays(own, schema=kind)

    lines = saved(_read_pieces(spark, path, tail).mapInArrow(number, "file string, split long, at long, bytes long, n long, key string"), "token-keys")
    return lines.join(_split_bases(lines), ["file", "split"]).select("file", (F.col("n0") + F.col("at")).alias("doc_no"), "key")


def count_tokens(docs: DataFrame, *, text: str = "text", key: str = "doc_id", ranks_path: str = RANKS, end_id: int = END_ID, path: str | None = None) -> DataFrame:
    """Write docs as token files, scan them, and return (key, file_no, doc_no, start, n_tokens) for every row of docs.

    The token files carry no ids: the n-th document of a file is the n-th key of the key file that the same task wrote, so
    docs is read once and may come in any order. Counts per file guard the match. Repeated rows and ids keep a result row
    each; null and empty texts have 0 tokens; an empty table gives an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    path = path or work_path(spark, "tokens")
    write_token_files(docs, path, text=text, key=key, ranks_path=ranks_path, end_id=end_id)
    empty = spark.createDataFrame([], f"{key} {docs.schema[key].dataType.simpleString()}, file_no int, doc_no long, start long, n_tokens long")
    if docs.isEmpty():
        return empty
    file_no = F.regexp_extract("file", r"part-(\d+)[^/]*$", 1).cast("int").alias("file_no")
    found = saved(scan_token_files(spark, f"{path}/kind=tokens", end_id=end_id).select(file_no, "doc_no", "start", "n_tokens"), "token-counts")
    rows = saved(_read_keys(spark, f"{path}/kind=keys", end_id & 0xFF).select(file_no, "doc_no", "key"), "token-rows")
    counts = lambda df, name: df.groupBy("file_no").agg(F.count(F.lit(1)).alias(name))
    if not counts(rows, "a").join(counts(found, "b"), "file_no", "full").filter("NOT a <=> b").isEmpty():
        raise RuntimeError("token files and key files do not match")
    return rows.join(found, ["file_no", "doc_no"]).select(F.col("key").cast(docs.schema[key].dataType).alias(key), "file_no", "doc_no", "start", "n_tokens")
