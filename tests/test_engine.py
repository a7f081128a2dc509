import datetime
import random

import pytest
from pyspark.sql import functions as F

from rosterlake.functions import columns as C
from rosterlake.operators import intervals, lines, ranking, skills, upserts
from rosterlake.sources.tables import by_key, landing_zone, page
from rosterlake.streaming import ingest


def one(spark, column, **values):
    names = list(values)
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{n} {'string' if isinstance(v, str) or v is None else 'array<string>' if isinstance(v, list) else 'double' if isinstance(v, float) else 'int'}" for n, v in values.items()))
    return row.select(column(*[F.col(n) for n in names]).alias("x")).first()["x"]


def matches(spark, a, b):
    mk = lambda t: skills.terms(spark.createDataFrame([(t,)], "t string"), "t")
    return skills.combined_join(mk(a), mk(b), skills.alias_table(spark)).count() > 0


@pytest.mark.parametrize("a, b, same", [
    ("JS", "JavaScript", True), ("React.js", "react", True), ("Java", "JavaScript", False), ("rest apis", "REST API", True), ("C++", "C#", True), ("mysql", "oracle", True), ("go", "golang", False), ("postgresql", "postgresqls", True),
])
def test_skill_pairs(spark, a, b, same):
    assert matches(spark, a, b) is same


def test_fuzzy_keeps_every_pair(spark):
    import difflib
    import itertools

    words = ["thering", "theringe", "therings", "theirng", "ering", "kubernetes", "kubernets", "kuberntes", "aaaa", "aaab", "abab", "baba"]
    t = skills.terms(spark.createDataFrame([(w,) for w in words], "w string"), "w")
    got = {(r.l, r.r) for r in skills.fuzzy_join(t, t).collect()}
    want = {(a, b) for a, b in itertools.product(words, words) if difflib.SequenceMatcher(None, a, b).ratio() >= 0.85}
    assert got == want


def test_experience_gap(spark):
    rows = [(5, 0, 70.0), (5, 5, 100.0), (6, 5, 95.0), (9, 5, 90.0), (14, 5, 85.0), (4, 5, 80.0), (3, 5, 60.0), (2, 5, 40.0), (0, 5, 20.0), (None, None, 70.0)]
    df = spark.createDataFrame(rows, "h int, w int, want double")
    assert [r.got for r in df.select(C.experience_score(F.col("h"), F.col("w")).alias("got")).collect()] == [r[2] for r in rows]


def test_skill_score(spark):
    df = spark.createDataFrame([(0, 0, 0, 0, 5), (5, 5, 0, 0, 5), (5, 5, 3, 3, 50), (5, 5, 0, 3, 8)], "mr int, r int, mn int, n int, d int")
    assert [x.s for x in df.select(C.skill_score(*[F.col(c) for c in ("mr", "r", "mn", "n", "d")]).alias("s")).collect()] == [50.0, 70.0, 100.0, 76.0]


def test_percentile(spark):
    df = spark.createDataFrame([(1, 10.0), (1, 20.0), (1, 20.0), (1, 40.0)], "j int, s double")
    assert sorted(r.p for r in df.select(ranking.percentile("s", "j").alias("p")).collect()) == [0.0, 25.0, 25.0, 75.0]


def test_ranges(spark):
    d = datetime.date
    rows = [("a", d(2020, 1, 1), d(2020, 6, 1)), ("a", d(2020, 2, 1), d(2020, 3, 1)), ("a", d(2020, 6, 1), d(2020, 7, 1)), ("a", d(2021, 1, 1), None), ("a", d(2022, 1, 1), d(2021, 1, 1)), ("b", d(2020, 1, 1), d(2020, 1, 1))]
    df = spark.createDataFrame(rows, "o string, s date, e date")
    got = {(r.o, r.s, r.e) for r in intervals.merge_ranges(df, "o", "s", "e", "2021-03-01").collect()}
    assert got == {("a", d(2020, 1, 1), d(2020, 7, 1)), ("a", d(2021, 1, 1), d(2021, 3, 1)), ("b", d(2020, 1, 1), d(2020, 1, 1))}
    assert intervals.merge_ranges(df.filter("o = 'x'"), "o", "s", "e").count() == 0


@pytest.mark.parametrize("text, want", [("2020-01", "2020-01-01"), ("January 2020", "2020-01-01"), ("Jan 2020", "2020-01-01"), ("01/2020", "2020-01-01"), ("2020", "2020-01-01"), ("present", "2024-05-06"), ("circa 2019", "2019-01-01"), ("", None), ("15/03/2021", "2021-03-15")])
def test_dates(spark, text, want):
    got = one(spark, lambda t: C.parse_date(t, F.to_date(F.lit("2024-05-06"))).cast("string"), t=text)
    assert got == want


def test_date_range_keeps_months(spark):
    got = one(spark, C.date_range, t="Engineer, Jan 2021 - Dec 2021")
    assert (got["start"], got["end"]) == ("Jan 2021", "Dec 2021")


@pytest.mark.parametrize("text, years", [("5+ years of experience", 5), ("at least 3 years", 3), ("40 years of experience", None), ("experience: 7 yrs", 7), ("none", None)])
def test_stated_years(spark, text, years):
    assert one(spark, C.stated_years, t=text) == years


def test_contacts_and_links(spark):
    assert one(spark, C.first_email, t="mail a.b+c@mail.example.com or x@y.org") == "a.b+c@mail.example.com"
    assert one(spark, lambda t: C.phone_digits(C.first_phone(t)), t="call (123) 456-7890 now") == "1234567890"
    assert one(spark, C.normalize_url, t="example.com/x") == "https://example.com/x"
    assert one(spark, C.normalize_url, t="unknown") is None
    assert one(spark, C.link_kind, t="https://GitHub.com/x") == "github"
    assert one(spark, C.split_skills, t="sql; python ;x; go") == ["sql", "python", "go"]


def test_validity_routes(spark):
    good = "Software engineer experience education university skills python a@b.com 555-123-4567 " + "worked on projects with tools " * 8
    df = C.with_validity(spark.createDataFrame([(1, good), (2, "short"), (3, None)], "id int, t string"), "t")
    got = {r.id: (r.is_valid, r.reasons) for r in df.collect()}
    assert got[1] == (True, []) and got[2] == (False, ["text_too_short"]) and got[3] == (False, ["text_too_short"])


def test_upsert_twice_is_once(spark):
    base = spark.createDataFrame([(1, "a", ["x"]), (2, "b", ["y"])], "k int, v string, w array<string>")
    patch = spark.createDataFrame([(2, None, None), (3, "c", ["z"])], "k int, v string, w array<string>")
    once = upserts.upsert(base, patch, ["k"], replace=("w",))
    rows = lambda df: sorted((r.k, r.v, r.w) for r in df.collect())
    assert rows(once) == [(1, "a", ["x"]), (2, "b", None), (3, "c", ["z"])]
    assert rows(upserts.upsert(once, patch, ["k"], replace=("w",))) == rows(once)


def test_versions(spark):
    new = spark.createDataFrame([("r", 1), ("r", 2), ("q", 1)], "k string, o int")
    old = spark.createDataFrame([("r", 4)], "k string, v int")
    got = upserts.number_versions(new, old, "k", "v", ["o"])
    assert sorted((r.k, r.v) for r in got.collect()) == [("q", 1), ("r", 5), ("r", 6)]
    assert upserts.flag_current(got, "k", "v").filter("is_current").count() == 2


def test_layout(spark):
    blocks = spark.createDataFrame([(1, 0, float(x), float(20 * i), 612.0, "w" * 20) for i in range(12) for x in (40, 320)], "d int, page int, `left` double, top double, page_width double, text string")
    assert [r.split for r in lines.column_split(blocks, "d").collect()] == [180.0]
    assert lines.column_split(blocks.filter("left = 40"), "d").count() == 0
    assert lines.vertical_groups(blocks, "d").count() == 12


def test_landing_zone_and_pages(spark, tmp_path):
    (tmp_path / "a.txt").write_text("hello")
    (tmp_path / "b.txt").write_text("x" * 100)
    (tmp_path / "c.exe").write_text("no")
    (tmp_path / "txt").write_text("a name without an ending")
    for folder, name in (("one", "a.TXT"), ("two", "a.txt"), ("three", "a.txt")):  # names repeat, endings in capitals count
        (tmp_path / folder).mkdir()
        (tmp_path / folder / name).write_text("y" * (99 if folder == "three" else 3))
    good, bad = landing_zone(spark, str(tmp_path), largest=50)
    place = lambda r: r.path.split(tmp_path.name + "/")[1]
    assert sorted((place(r), r.raw_text) for r in good.collect()) == [("a.txt", "hello"), ("one/a.TXT", "yyy"), ("two/a.txt", "yyy")]
    assert sorted((place(r), r.reason) for r in bad.collect()) == [("b.txt", "too large"), ("c.exe", "kind"), ("three/a.txt", "too large"), ("txt", "kind")]
    assert "content" not in bad._jdf.queryExecution().executedPlan().toString()
    df = spark.range(30)
    assert [r.id for r in page(df, [F.desc("id")], 5, 3).collect()] == [24, 23, 22] and by_key(df, "id", 7).count() == 1
    with pytest.raises(ValueError):
        page(df, [F.col("id")], 0, 0)


def test_stream_equals_batch(spark, tmp_path):
    src = str(tmp_path / "in")
    rows = [(i, datetime.datetime(2024, 1, 1, 0, i % 50), i % 3, "error" if i % 4 == 0 else "view") for i in range(60)]
    df = spark.createDataFrame(rows, "event_id long, ts timestamp, user_id int, event_type string")
    df.orderBy(F.desc("ts")).unionByName(df.limit(10)).repartition(3).write.parquet(src)
    out = str(tmp_path / "out")
    stream = ingest.drop_repeats(ingest.read_files(spark, src, df.schema, 100), "event_id", "ts", "2 hours")
    ingest.ingest(stream, str(tmp_path / "ck"), lambda batch, n: batch.write.mode("overwrite").parquet(f"{out}/{n}")).awaitTermination()
    got = spark.read.option("recursiveFileLookup", "true").parquet(out)
    assert got.count() == 60
    twin = lambda x: sorted(map(tuple, ingest.attempts(x, "user_id", F.col("event_type") == "error", 3).collect()))
    assert twin(got) == twin(df)


def vocabulary(n, seed=1):
    rng = random.Random(seed)
    words = []
    while len(words) < n:
        word = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(3, 16)))
        words.append(word)
        if rng.random() < 0.2:  # a near one
            i = rng.randrange(len(word))
            words.append(word[:i] + rng.choice(["", "x", word[i] + "y"]) + word[i + 1 :])
    return sorted(set(words[:n]))


def test_fuzzy_join_loses_no_pair(spark):
    import difflib

    words = vocabulary(2000)
    t = skills.terms(spark.createDataFrame([(w,) for w in words], "w string"), "w")
    want = set()
    for b in words:
        matcher = difflib.SequenceMatcher(None, "", b)
        for a in words:
            if a != b and min(len(a), len(b)) >= 4 and 2 * min(len(a), len(b)) >= 0.85 * (len(a) + len(b)):
                matcher.set_seq1(a)
                if matcher.quick_ratio() >= 0.85 and difflib.SequenceMatcher(None, a, b).ratio() >= 0.85:
                    want.add((a, b))
    assert {(r.l, r.r) for r in skills.fuzzy_join(t, t).filter("l <> r").collect()} == want and len(want) > 300


def test_fuzzy_join_verifies_about_as_many_pairs_as_there_are_terms(spark):
    verified = {}
    for n in (1000, 10_000):
        t = skills.terms(spark.createDataFrame([(w,) for w in vocabulary(n)], "w string"), "w")
        verified[n] = skills.fuzzy_candidates(t, t).filter("l <> r").count()
    assert 0 < verified[10_000] < 20 * verified[1000]


def test_queries_run_on_small_tables(spark, sf):
    import __spark_entry__ as entry

    names = [n for n in entry.queries() if not n.startswith("op") and n != "pipeline"]
    assert len(names) > 45 and entry.entry(spark).count() > 0
    for name in names[::4]:
        assert entry.queries()[name](spark, sf).count() >= 0
