"""WARC archives: written with revisit records for repeated payloads, read back by boundary-chain verification.

Writing: a Bloom filter over the digests that stand more than once decides which rows meet their group in a join; the
payloads of all others are written where they are read.

Reading: Spark's text reader, with the record magic as its line separator, cuts archives of any size at every place where
the magic stands, inside payloads too. Each task turns its pieces into candidate records: where the candidate starts and,
by its own Content-Length, where its successor must start. Within a reader split these links form a forest, whose intervals
the task numbers; a chain leaves the split at one of few places. Pointer jumping from each file's start over those few
places tells at which candidate the chain enters each split, and the candidates whose interval holds that one are the
records. The others are magic inside payloads, and their pieces go back to the record that holds them. Starts are byte
counts in each reader split, made absolute by a prefix sum over splits.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, join_hot, saved, text_batches
from .url_filter import Cascade

MAGIC = "WARC/1.1\r\n"
END = "\r\n\r\n"
MIN_REVISIT = 1000
FILTER_BYTES = 16 << 20  # most bytes of the filter over repeated digests; with more of them it only lets more rows through to the join
_DATE = "2024-01-01T00:00:00Z"


def plan_records(pages: DataFrame, *, key: str = "page_id", url: str = "url", html: str = "html", min_revisit: int = MIN_REVISIT) -> DataFrame:
    """(page_id, url, payload, payload_bytes, digest, refers_to): refers_to names the record that holds the same payload.

    Of records with equal payloads of at least min_revisit bytes the one with the largest id holds it. A null payload is
    empty. Rows that tie for the largest id all hold it; where no row of the group has an id, none refers to another.
    """
    payload = F.coalesce(F.col(html).cast("string"), F.lit(""))
    rows = pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn("digest", F.sha1(F.col("payload").cast("binary")))
    slim = rows.filter(F.col("payload_bytes") >= min_revisit).select("digest", "payload_bytes", "page_id")
    groups = saved(slim.groupBy("digest", "payload_bytes").agg(F.max("page_id").alias("first"), F.count(F.lit(1)).alias("_n")).filter("_n > 1"), "warc-groups")
    found = groups.agg(F.count(F.lit(1)).alias("keys"), F.coalesce(F.sum("_n"), F.lit(0)).alias("rows")).first()
    names = ["page_id", "url", "payload", "payload_bytes", "digest"]
    alone = rows.select(*names, F.lit(None).cast("long").alias("refers_to"))
    if not found["keys"]:
        return alone
    repeated = Cascade()
    repeated.add(groups.select(F.col("digest").alias("key")), found["keys"], max(1 / 1024, 0.5 ** (FILTER_BYTES * 8 * 0.69 / found["keys"])))
    maybe = (F.col("payload_bytes") >= min_revisit) & repeated.passes(F.col("digest"), 0)
    joined = join_hot(rows.filter(maybe), groups, ["digest", "payload_bytes"], "_n", found["rows"], how="left")
    joined = joined.select(*names, F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to"))
    return alone.filter(~maybe).unionByName(joined)


def _line(text):
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x00-\x20\x7F]", "%20")


def record_text(magic: str = MAGIC):
    """The record of a planned row, without the two line ends that close it."""
    uuid = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("none")), F.lit(">"))
    revisit = F.col("refers_to").isNotNull()
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("payload_bytes"), F.lit("\r\n\r\n"))
    block = F.concat(http, F.when(revisit, F.lit("")).otherwise(F.col("payload")))
    head = F.concat(
        F.lit(magic), F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response"),
        F.lit("\r\nWARC-Record-ID: "), uuid(F.col("page_id")), F.lit(f"\r\nWARC-Date: {_DATE}\r\nWARC-Target-URI: "), _line(F.col("url")),
        F.lit("\r\nWARC-Payload-Digest: sha1:"), F.col("digest"),
        F.when(revisit, F.concat(F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: "), uuid(F.col("refers_to")))).otherwise(""),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "), F.octet_length(block), F.lit("\r\n\r\n"),
    )
    return F.concat(head, block)


def write_warc(pages: DataFrame, path: str, **options) -> None:
    """Write pages as WARC files, one per partition; the text writer's line separator closes each record."""
    plan_records(pages, **options).select(record_text().alias("value")).write.option("lineSep", END).option("compression", "none").text(path)


_KIND = pa.schema([
    ("file", pa.string()), ("split", pa.int64()), ("at", pa.int64()), ("size", pa.int64()), ("succ", pa.int64()), ("page_id", pa.int64()), ("payload_bytes", pa.int64()),
    ("digest", pa.string()), ("stated", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()),
])
_PLACED = pa.schema([*_KIND, ("opens", pa.int64()), ("closes", pa.int64()), ("leaves", pa.int64())])
_CANDIDATE = "file string, split long, at long, size long, succ long, page_id long, payload_bytes long, digest string, stated string, record_type string, refers_to long, opens long, closes long, leaves long"


def _page(value: bytes | None) -> int | None:
    text = (value or b"").removeprefix(b"<urn:page:").removesuffix(b">")
    return int(text) if text.removeprefix(b"-").isdigit() else None


def parse_record(data: bytes) -> dict | None:
    """Fields of a record that follows the magic, or None for what is no record header; whole if data ends where it must."""
    head, gap, rest = data.partition(b"\r\n\r\n")
    fields = {}
    for line in head.split(b"\r\n") if gap else ():
        name, colon, value = line.partition(b":")
        if not colon:
            return None
        fields[name.strip().lower()] = value.strip()
    length = fields.get(b"content-length", b"")
    if not length.isdigit() or b"warc-type" not in fields:
        return None
    total = len(head) + 4 + int(length) + len(END)
    out = {"total": total, "whole": len(data) == total, "page_id": _page(fields.get(b"warc-record-id")), "refers_to": _page(fields.get(b"warc-refers-to")), "record_type": fields[b"warc-type"].decode("utf-8", "replace")}
    out["stated"] = fields.get(b"warc-payload-digest", b"").removeprefix(b"sha1:").decode("utf-8", "replace")
    if out["whole"] or len(data) > total:
        block = rest[: int(length)]
        http, gap, payload = block.partition(b"\r\n\r\n")
        stated = [int(x[15:]) for x in http.lower().split(b"\r\n") if x.startswith(b"content-length:") and x[15:].strip().isdigit()]
        if out["record_type"] == "revisit":
            out["digest"], out["payload_bytes"] = out["stated"], stated[0] if stated else None
        else:
            out["digest"], out["payload_bytes"] = hashlib.sha1(payload).hexdigest(), len(payload)
    return out


def forest(at: np.ndarray, succ: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(opens, closes, leaves) of a split's candidates, by rising at; succ is -1 where there is none.

    The chain from candidate x runs through candidate y exactly when opens[y] <= opens[x] < closes[y]. leaves is the place
    beyond the split that the chain reaches, -1 where it breaks off before.
    """
    n, end = len(at), int(at[-1]) if len(at) else 0
    nearest = np.searchsorted(at, succ)
    inside = (succ >= 0) & (nearest < n) & (at[np.minimum(nearest, n - 1)] == succ) if n else np.zeros(0, bool)
    parent = np.where(inside, nearest, -1)
    leaves, size = np.where(succ > end, succ, -1), np.ones(n, np.int64)
    # A successor stands later, so one pass each way settles all.
    for i in range(n - 1, -1, -1):
        if parent[i] >= 0:
            leaves[i] = leaves[parent[i]]
    for i in range(n):
        if parent[i] >= 0:
            size[parent[i]] += size[i]
    opens, free, roots = np.zeros(n, np.int64), np.zeros(n, np.int64), 0
    for i in range(n - 1, -1, -1):
        if parent[i] >= 0:
            opens[i], free[parent[i]] = free[parent[i]], free[parent[i]] + size[i]
        else:
            opens[i], roots = roots, roots + size[i]
        free[i] = opens[i] + 1
    return opens, opens + size, leaves


def _candidates(magic: bytes):
    names = [f.name for f in _KIND]

    def settled(parts: list[pa.RecordBatch]):
        """One split's pieces with their intervals; its first piece in a file, before any magic, is a candidate without successor."""
        whole = pa.Table.from_batches(parts, schema=_KIND).combine_chunks()
        succ = whole.column("succ").fill_null(-1).to_numpy()
        opens, closes, leaves = forest(whole.column("at").to_numpy(), succ)
        out = pa.Table.from_arrays([*whole.columns, pa.array(opens), pa.array(closes), pa.array(leaves, mask=leaves < 0)], schema=_PLACED)
        yield from out.to_batches(max_chunksize=4096)

    def scan(batches):
        place, at, held = None, 0, []
        for batch in batches:
            rows = {n: [] for n in names}
            files, splits, values = batch.column(0), batch.column(1), batch.column(2).cast(pa.binary())

            def cut():
                if rows["file"]:
                    held.append(pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(rows.values(), _KIND)], schema=_KIND))
                    for v in rows.values():
                        v.clear()

            for i in range(batch.num_rows):
                here = (files[i].as_py(), splits[i].as_py())
                if here != place:
                    cut()
                    if held:
                        yield from settled(held)
                    place, at, held = here, 0, []
                data = values[i].as_py()
                got = parse_record(data) or {}
                size = len(data) + len(magic)
                row = {"file": here[0], "split": here[1], "at": at, "size": size, "succ": at + got["total"] + len(magic) if got else None}
                for name in names:
                    rows[name].append(row[name] if name in row else got.get(name))
                at += size
            cut()
        if held:
            yield from settled(held)

    return scan


def pieces(spark: SparkSession, path: str, magic: str = MAGIC) -> DataFrame:
    """What stands between magics: (file, split, value). A file's first piece is what comes before its first magic."""
    raw = spark.read.option("lineSep", magic).text(path)
    return raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), "value")


def reachable(starts: DataFrame, jumps: DataFrame) -> DataFrame:
    """(no, at) of the places that the chain from each start reaches, by pointer jumping over jumps(no, at, to).

    Each round joins the marks with pointers of twice the reach, so the rounds grow with the logarithm of the splits of a
    file. A chain that leaves the places given ends there.
    """
    marked, jump = saved(starts.select("no", "at"), "warc-marked"), saved(jumps.select("no", "at", "to"), "warc-jump")
    n = marked.count()
    while True:
        new = marked.join(jump, ["no", "at"]).select("no", F.col("to").alias("at"))
        wider = saved(marked.unionByName(new).distinct(), "warc-marked")
        count = wider.count()
        discard(marked)
        marked = wider
        if count == n:
            discard(jump)
            return marked
        n = count
        farther = jump.join(jump.select("no", F.col("at").alias("to"), F.col("to").alias("far")), ["no", "to"]).select("no", "at", F.col("far").alias("to"))
        jump, old = saved(farther, "warc-jump"), jump
        discard(old)


def read_warc(spark: SparkSession, path: str, magic: str = MAGIC) -> DataFrame:
    """(file, start, page_id, record_type, payload_bytes, payload_digest, stated_digest, refers_to, holds) of the records under path.

    payload_digest is computed from the payload read; a revisit, which has none, repeats the digest and length it states,
    and holds says whether the record it refers to was found with just these (null for other records). Magic inside a
    payload, even a whole record, is no record of its own. Bytes that no record covers are passed over; what follows a
    broken record is lost to the chain, as it is to any reader that trusts Content-Length. Empty archives give no rows.
    """
    text_batches(spark)
    raw = saved(pieces(spark, path, magic).mapInArrow(_candidates(magic.encode()), _CANDIDATE), "warc-candidates")
    splits = raw.groupBy("file", "split").agg(F.sum("size").alias("length"))
    order = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    # A piece starts after its magic; the first piece of a file has none before it and is no candidate.
    base = F.coalesce(F.sum("length").over(order), F.lit(0)) - len(magic)
    splits = saved(splits.select("file", "split", "length", base.alias("base"), F.xxhash64("file").alias("no")), "warc-splits")  # one row a reader split
    placed = raw.join(splits, ["file", "split"]).withColumn("rel", F.col("at")).withColumn("at", F.col("at") + F.col("base")).withColumn("succ", F.col("succ") + F.col("base")).withColumn("leaves", F.col("leaves") + F.col("base")).filter("at >= 0")

    starts = placed.groupBy("no").agg(F.min("at").alias("at"))
    doors = starts.unionByName(placed.filter("leaves IS NOT NULL").select("no", F.col("leaves").alias("at"))).distinct()
    entries = saved(placed.select("no", "split", "at", "opens", "leaves").join(doors, ["no", "at"]), "warc-entries")  # the few places where a chain may enter a split
    reached = reachable(starts, entries.filter("leaves IS NOT NULL").select("no", "at", F.col("leaves").alias("to")))
    entered = entries.join(reached, ["no", "at"]).select("no", "split", F.col("opens").alias("entry"))  # one row a split at most
    found = placed.join(entered, ["no", "split"]).filter("opens <= entry AND entry < closes AND succ IS NOT NULL").drop("entry")
    short = saved(found.filter("digest IS NULL"), "warc-short")
    records = found.filter("digest IS NOT NULL")
    if not short.isEmpty():
        records = records.unionByName(_stitched(spark, path, magic, placed, splits, short))
    out = records.select("file", F.col("at").alias("start"), "page_id", "record_type", "payload_bytes", F.col("digest").alias("payload_digest"), F.col("stated").alias("stated_digest"), "refers_to")

    # What revisits state is compared once for each record they refer to, however many they are.
    stated = ["refers_to", "payload_bytes", "payload_digest"]
    claims = out.filter("record_type = 'revisit'").groupBy(*stated).agg(F.count(F.lit(1)).alias("n"))
    origin = out.filter("record_type <> 'revisit'").select(F.col("page_id").alias("refers_to"), "payload_bytes", "payload_digest").distinct()
    false = saved(claims.join(origin, stated, "left_anti"), "warc-false")
    holds = F.when(F.col("record_type") == "revisit", F.lit(True))
    if false.isEmpty():
        return out.withColumn("holds", holds)
    known = F.struct(*stated)
    bad = false.select(known.alias("bad")).distinct()
    return out.join(bad, known.eqNullSafe(F.col("bad")), "left").withColumn("holds", F.when(F.col("bad").isNotNull(), F.lit(False)).otherwise(holds)).drop("bad")


def _stitched(spark: SparkSession, path: str, magic: str, placed: DataFrame, splits: DataFrame, short: DataFrame) -> DataFrame:
    """Records cut by magic in their payloads, put together from their pieces (one record at a time).

    Within a split the last short record that began covers a piece, or that which reaches in from an earlier split; so no
    more than one split's pieces are ordered in one task.
    """
    marks = short.select("file", "split", "at", F.col("at").alias("own"), F.col("succ").alias("own_end"))
    later = splits.select("file", F.col("split").alias("into"), "base")
    carried = marks.join(later, "file").filter("into > split AND base < own_end").select("file", F.col("into").alias("split"), F.struct(F.col("own"), F.col("own_end")).alias("mark"))
    carried = carried.groupBy("file", "split").agg(F.max("mark").alias("mark")).select("file", "split", F.lit(-1).cast("long").alias("rel"), F.lit(-1).cast("long").alias("at"), F.col("mark.own").alias("own"), F.col("mark.own_end").alias("own_end"))
    begun = placed.select("file", "split", "rel", "at").join(marks, ["file", "split", "at"], "left")
    order = Window.partitionBy("file", "split").orderBy("rel").rowsBetween(Window.unboundedPreceding, 0)
    owners = begun.unionByName(carried)
    owners = owners.withColumn("own_end", F.last("own_end", True).over(order)).withColumn("own", F.last("own", True).over(order)).filter("rel >= 0 AND at < own_end")

    shape = pa.schema([("file", pa.string()), ("split", pa.int64()), ("at", pa.int64()), ("value", pa.binary())])

    def number(batches):
        place, at = None, 0
        for batch in batches:
            keys, splits, values = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary())
            starts = []
            for i, here in enumerate(zip(keys, splits)):
                if here != place:
                    place, at = here, 0
                starts.append(at)
                at += len(values[i].as_py()) + len(magic)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(splits, pa.int64()), pa.array(starts, pa.int64()), values], schema=shape)

    with_value = pieces(spark, path, magic).mapInArrow(number, "file string, split long, at long, value binary")
    # A piece is found again by its place in its reader split.
    key = owners.select("file", "split", "rel", "at", "own")
    parts = with_value.withColumnRenamed("at", "rel").join(key, ["file", "split", "rel"])
    whole = parts.groupBy("file", "own").agg(F.array_sort(F.collect_list(F.struct("at", "value"))).alias("p"))

    def parse(frames):
        import pandas as pd

        for pdf in frames:
            out = []
            for file, own, p in zip(pdf["file"], pdf["own"], pdf["p"]):
                got = parse_record(magic.encode().join(bytes(x["value"]) for x in p))
                out.append((file, own, got.get("payload_bytes"), got.get("digest")))
            yield pd.DataFrame(out, columns=["file", "at", "payload_bytes", "digest"]).astype({"payload_bytes": "Int64"})

    read = whole.mapInPandas(parse, "file string, at long, payload_bytes long, digest string")
    return short.drop("payload_bytes", "digest").join(read, ["file", "at"]).select(short.columns)
