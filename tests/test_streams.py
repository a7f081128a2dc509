"""Stream jobs against their batch twins: out-of-order files, restarts, crashes between write and commit, entries that expire."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from rosterlake.streaming import ingest, status
from rosterlake.streaming.versions import VersionStore

START = datetime.datetime(2024, 1, 1)


def files(spark, folder, rows, schema, sizes):
    a = 0
    for n in sizes:
        spark.createDataFrame(rows[a : a + n], schema).coalesce(1).write.mode("append").parquet(folder)
        a += n


def to_the_end(stream, folder, checkpoint):
    stream.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()


def test_status_machine_takes_files_out_of_order_and_restarts(spark, tmp_path):
    rng = random.Random(5)
    schema = "event_id long, ts timestamp, doc string, status string"
    rows = [(i, START + datetime.timedelta(seconds=60 * i), f"d{rng.randrange(6)}", rng.choice(["pending", "processing", "processing", "completed", "failed", None])) for i in range(300)]
    mixed = sorted(rows, key=lambda r: (r[0] // 40, rng.random()))  # disorder of 40 minutes at most
    flush = [(10_000, START + datetime.timedelta(days=3), "last", "pending")]
    source, out, checkpoint = (str(tmp_path / x) for x in ("in", "out", "checkpoint"))
    files(spark, source, mixed[:150], schema, [30] * 5)
    read = lambda: ingest.read_files(spark, source, spark.createDataFrame([], schema).schema, 1)
    to_the_end(status.transitions(read(), "doc", "ts", "status"), out, checkpoint)
    part = spark.read.parquet(out).count()
    assert 0 < part < 150
    files(spark, source, mixed[150:] + flush, schema, [50, 50, 50, 1])
    to_the_end(status.transitions(read(), "doc", "ts", "status"), out, checkpoint)
    got = sorted(map(tuple, spark.read.parquet(out).filter("doc <> 'last'").select("doc", "event_id", "ts", "status", "accepted", "state", "failures").collect()))
    want = sorted(map(tuple, status.transitions_of_table(spark.createDataFrame(rows, schema), "doc", "ts", "status").collect()))
    assert got == want and len({r[4] for r in want}) == 2 and max(r[6] for r in want) >= 1


@pytest.mark.parametrize("path, want", [
    (["pending", "processing", "completed", "processing"], [True, True, True, False]),
    (["processing", "pending", "pending", "failed"], [False, True, False, False]),
    (["pending"] + ["processing", "failed"] * 4, [True] * 7 + [False] * 2),
])
def test_moves(path, want):
    state, got = (None, 0), []
    for name in path:
        state, accepted = status.move(state, name)
        got.append(accepted)
    assert got == want


def test_entries_expire_without_new_input_of_their_key(spark, tmp_path):
    schema = "event_id long, ts timestamp, kind string, owner long"
    rng = random.Random(6)
    rows = [(i, START + datetime.timedelta(minutes=7 * i), rng.choice(["view", "click", "other"]), 1 if i == 0 else 2 + rng.randrange(3)) for i in range(120)]
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    files(spark, source, rows, schema, [20] * 6)
    minutes = F.when(F.col("kind") == "view", 60).when(F.col("kind") == "click", 1440).otherwise(30)
    stream = status.expirations(ingest.read_files(spark, source, spark.createDataFrame([], schema).schema, 1), "owner", "event_id", "kind", "ts", minutes)
    to_the_end(stream, out, str(tmp_path / "checkpoint"))
    gone = {r.event_id: r.expires_at for r in spark.read.parquet(out).collect()}
    alive = {r.event_id for r in ingest.unexpired(spark.createDataFrame(rows, schema), "ts", minutes, rows[-1][1]).collect()}
    assert set(gone) | alive == {r[0] for r in rows} and not set(gone) & alive
    life = {"view": 60, "click": 1440, "other": 30}
    assert all(gone[i] == ts + datetime.timedelta(minutes=life[kind]) for i, ts, kind, _ in rows if i in gone) and 0 in gone | dict.fromkeys(alive)


def test_a_batch_that_comes_again_after_a_crash_stands_once(spark, tmp_path, monkeypatch):
    schema = "doc string, at long, text string"
    rows = [(f"d{i % 4}", i, f"text {i}") for i in range(40)]
    source = str(tmp_path / "in")
    files(spark, source, rows, schema, [10] * 4)
    parse = lambda df: df.select("doc", "at", F.length("text").alias("n"))

    def run(name, crash_at=None):
        store = VersionStore(spark, str(tmp_path / name), "doc", ["at"])
        real, tries = VersionStore._commit, []

        def commit(self, mark, schema):
            if mark == crash_at and not tries:
                tries.append(mark)
                raise OSError("lost between write and commit")
            real(self, mark, schema)

        monkeypatch.setattr(VersionStore, "_commit", commit)
        stream = lambda: ingest.ingest(ingest.read_files(spark, source, spark.createDataFrame([], schema).schema, 1), str(tmp_path / f"{name}-checkpoint"), store.sink(parse))
        if crash_at:
            with pytest.raises(Exception, match="lost between"):
                stream().awaitTermination()
        stream().awaitTermination()
        monkeypatch.undo()
        return store

    whole, broken = run("whole"), run("broken", "batch-2")
    rows_of = lambda df: sorted(map(tuple, df.select("doc", "at", "n", "version_number", *[c for c in df.columns if c == "is_current"]).collect()))
    assert rows_of(broken.read()) == rows_of(whole.read()) and broken.read().count() == 40
    again = spark.createDataFrame([("d0", 99, 1)], "doc string, at long, n int")
    broken.append(again, 2)  # committed already
    assert broken.read().count() == 40
    current = rows_of(broken.current())
    broken.gather()
    assert rows_of(broken.read()) == rows_of(whole.read()) and rows_of(broken.current()) == current and broken.committed() == (3, [])
    broken.append(again, 4)
    assert [tuple(r) for r in broken.read().filter("doc = 'd0' AND is_current").select("at", "version_number").collect()] == [(99, 11)]
    assert {r.doc: r["at"] for r in broken.current().collect()}["d0"] == 99


def test_memo_computes_what_it_lacks_and_what_has_expired(spark, tmp_path):
    from rosterlake.functions.embedding import hashed_vectors
    from rosterlake.sources.memo import Memo

    memo = Memo(spark, str(tmp_path / "memo"), "vector array<double>", 60)
    texts = spark.createDataFrame([(1, "one two two"), (2, "one two two"), (3, ""), (4, None), (5, "A b a")], "k long, text string")
    vectors = lambda t: hashed_vectors(t, "text_hash", "text")
    assert memo.fill(texts, "text", vectors, START) == 3
    assert memo.fill(texts, "text", vectors, START + datetime.timedelta(minutes=59)) == 0
    more = texts.unionByName(spark.createDataFrame([(6, "new")], "k long, text string"))
    assert memo.fill(more, "text", vectors, START + datetime.timedelta(minutes=59)) == 1
    assert memo.fill(more, "text", vectors, START + datetime.timedelta(minutes=61)) == 3
    got = {r.k: r.vector for r in memo.through(more, "text", vectors, START + datetime.timedelta(minutes=62)).collect()}
    assert len(got) == 6 and got[1] == got[2] and got[3] == got[4] == [0.0] * 64
    assert all(abs(sum(x * x for x in got[k]) - 1) < 1e-12 for k in (1, 5, 6))


def test_suppressed_lines_are_not_tested(spark):
    from rosterlake.operators import lines

    flags = [0, 1, 0, 1, 0, 0, 1, 0]  # the fourth is suppressed by the second
    df = spark.createDataFrame([(d, i, "x" if f else "") for d in (1, 2, None) for i, f in enumerate(flags)], "doc long, line_no long, line string").repartition(3)
    got = lines.suppress_forward(df, "doc", F.col("line") == "x").collect()
    assert sorted((str(r.doc), r.line_no) for r in got) == sorted((str(d), i) for d in (1, 2, None) for i in (0, 4, 5))
