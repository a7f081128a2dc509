"""The ten operators against brute force on small tables, with nulls, ties, repeats, empty tables and clashing names."""

import hashlib
import json
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from rosterlake.llm import byte_bpe, chat_tools, decontaminate, minhash, mixing, quality, sharding, token_counts, url_filter, vector_dedup, warc
from rosterlake.llm.common import running_totals, work_path
from rosterlake.llm.components import connected_components

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORDS = [f"w{i}" for i in range(400)]
CODEC = byte_bpe.Codec.read(byte_bpe.RANKS)


def load_ranks():
    return byte_bpe.load_encoding(CODEC.ranks)


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(3)
    base = prose(rng, 120)
    rows = [(i, prose(rng, rng.choice([1, 3, 30, 90])), "en", f"s{i % 4}", i) for i in range(60)]
    for i in range(60, 90):  # near copies
        words = base.split()
        for _ in range(rng.randint(0, 14)):
            words[rng.randrange(len(words))] = rng.choice(WORDS)
        rows.append((i, " ".join(words), "en", "s0", i))
    rows += [(90, None, "en", "s1", 0), (91, "", None, None, 0), (92, "  \n ", "en", "s2", 0), (93, "É" * 5 + " x " * 5000, "fr", "s0", 0), (5, "repeated id", "en", "s1", 0), (None, base, "en", "s0", 0), (7, rows[7][1], "en", "s3", 7)]
    rows += [(200 + i, base, "en", "s0", 0) for i in range(40)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).cache()


def clash(df):
    """df with further columns named like an operator's own."""
    for name in ("size", "shard", "slot", "law", "_key", "_text", "n_words", "spans", "items", "score", "host", "path", "rule", "verdict", "kept", "id", "text_"):
        if name not in df.columns:
            df = df.withColumn(name, F.lit("own"))
    return df


# --- 1 ---------------------------------------------------------------------------------------------------------


def test_url_filter(spark):
    urls = ["http://a.example.net/es/1?ref=1", "http://A.EXAMPLE.net/de/1?ref=1", "x://example.com/en/2", "x://www.example.com/en/2", "x://b.www.example.com/en/", "x://notexample.com/en/", None, "no scheme", "x://", "http://q.org/x?a=1&ref=2#f", "http://q.org/x", "http://q.org/X"]
    urls += [f"http://h{i}.org/p{i}" + ("?ref=1" if i % 7 == 0 else "") for i in range(300)]
    pages = clash(spark.createDataFrame(list(enumerate(urls)) * 2, "page_id long, url string"))
    listed = url_filter.referral_keys(pages)
    keys = {r.key for r in listed.collect()}
    for size in (16 << 20, 64):
        got = url_filter.judge_urls(pages, listed, max_level_bytes=size)
        assert len({c.lower() for c in got.columns}) == len(got.columns) and got.count() == 2 * len(urls)
        rows = {r.page_id: r for r in got.collect()}
        for i, url in enumerate(urls):
            m = re.match(r"^.*?://([^/?#]*)([^?#]*)", url or "", re.S)
            host, path = (m[1].translate(FOLD), m[2]) if m else ("", "")
            fits = [(len(h + p), h + p, v) for v, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
            want = max(fits)[1:] if fits else (None, "block" if host + path in keys else "allow")
            assert (rows[i].host, rows[i].path, rows[i].rule, rows[i].verdict) == (host, path, *want)
    empty = listed.filter("key = 'none'")
    assert url_filter.judge_urls(pages, empty).filter("rule IS NULL AND verdict = 'block'").count() == 0
    assert url_filter.judge_urls(pages.limit(0), listed).count() == 0


# --- 2 ---------------------------------------------------------------------------------------------------------


def test_statistics_do_not_depend_on_neighbours(docs):
    import pyarrow as pa

    texts = [r.text for r in docs.collect()]
    whole = quality.statistics(pa.array(texts))
    for i, t in enumerate(texts):
        assert np.allclose(whole[i], quality.statistics(pa.array([t], pa.string()))[0])
    assert np.isfinite(whole).all()


def test_quality_learns_held_out(spark):
    rng = random.Random(5)
    rows = [(i, prose(rng, 40) + "." if i % 3 else " ".join(w + "$$$" for w in prose(rng, 40).split()), int(i % 3 > 0)) for i in range(600)]
    docs = clash(spark.createDataFrame([r[:2] for r in rows] + [(9001, None), (9002, ""), (None, "x")], "doc_id long, text string"))
    labels = spark.createDataFrame([(a, c, 0) for a, _, c in rows] + [(1, None, 0), (None, 1, 0), (2, 7, 0)], "doc_id long, quality int, toxic int")
    got = quality.score_quality(docs, labels).collect()
    assert len(got) == 603 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    truth = {a: c for a, _, c in rows}
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert all(zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in held) and np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.97
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(r.predicted for r in got)
    none = quality.score_quality(docs, labels.limit(0)).collect()
    assert {r.score for r in none} == {0.5}
    assert quality.score_quality(docs.limit(0), labels).count() == 0


def test_quality_equals_a_fit_in_one_place(spark, monkeypatch):
    """Features, ridge solution, calibration and decisions, computed once more without Spark."""
    monkeypatch.setattr(quality, "TASK_ROWS", 50)
    monkeypatch.setattr(quality, "FAN_IN", 2)
    rng = random.Random(9)
    rows = [(i, prose(rng, rng.randint(1, 60)) + rng.choice(["", "!!", " $ % &", "."]), rng.randint(0, 1)) for i in range(900)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string").repartition(6)
    labels = spark.createDataFrame([(a, c) for a, _, c in rows if a % 5], "doc_id long, quality int")
    import pyarrow as pa

    stats = quality.statistics(pa.array([r[1] for r in rows]))
    part = np.array([zlib.crc32(str(r[0]).encode()) % 4 for r in rows])
    marked, y = np.array([r[0] % 5 > 0 for r in rows]), np.array([float(r[2]) for r in rows])
    fit, held = marked & (part < 2), marked & (part == 3)
    mean, scale = np.round(stats[fit].mean(axis=0), 9), np.round(np.maximum(stats[fit].std(axis=0), 1e-3), 9)
    draw = np.random.default_rng(17)
    ways, phases = draw.normal(size=(stats.shape[1], 192)) * np.sqrt(2 * 0.08), draw.uniform(0, 2 * np.pi, 192)
    x = np.clip((stats - mean) / scale, -4, 4)
    phi = np.round(np.hstack([np.cos(x @ ways + phases), np.ones((len(x), 1)), x / 4]) * 4096) / 4096
    weights = np.linalg.solve(phi[fit].T @ phi[fit] + 1e-3 * fit.sum() * np.eye(phi.shape[1]), phi[fit].T @ y[fit])
    raw = phi @ weights
    bins = np.minimum(511, ((np.clip(raw, -0.5, 1.5) + 0.5) / 2 * 512).astype(int))
    at = sorted(set(bins[held].tolist()))
    blocks = [[[b], y[held & (bins == b)].sum(), (held & (bins == b)).sum()] for b in at]
    while any(p[1] / p[2] >= q[1] / q[2] for p, q in zip(blocks, blocks[1:])):
        k = next(k for k, (p, q) in enumerate(zip(blocks, blocks[1:])) if p[1] / p[2] >= q[1] / q[2])
        blocks[k : k + 2] = [[blocks[k][0] + blocks[k + 1][0], blocks[k][1] + blocks[k + 1][1], blocks[k][2] + blocks[k + 1][2]]]
    count = {b: (held & (bins == b)).sum() for b in at}
    knots = [sum(((b + 0.5) / 256 - 0.5) * count[b] for b in p[0]) / p[2] for p in blocks]
    want = np.clip(np.interp(raw, knots, [p[1] / p[2] for p in blocks]), 0, 1)
    got = {r.doc_id: r for r in quality.score_quality(docs, labels).collect()}
    assert len({round(v, 3) for v in want}) > 3 and np.allclose([got[r[0]].score for r in rows], want, atol=1e-6)
    assert sorted(r.doc_id for r in quality.keep_good(docs, labels, threshold=0.5).collect()) == sorted(i for i, r in got.items() if r.score >= 0.5)


def test_isotonic_is_monotone():
    knots, values = quality.isotonic(np.arange(6.0), np.array([1.0, 0, 3, 1, 4, 4]), np.array([4.0] * 6))
    assert (np.diff(values) > 0).all() and (np.diff(knots) > 0).all()


# --- 3 ---------------------------------------------------------------------------------------------------------


def test_chat_links(spark):
    calls = spark.createDataFrame([("a", 1, "x", "answer", '{"words":3,"text":"q"}', ["y"]), ("a", 2, "y", "answer", "[]", None), ("a", 3, "z", "answer", "bad", ["x"]), ("a", 4, "p", "answer", "1", ["q"]), ("a", 5, "q", "no", None, ["p", "gone"]), ("a", 0, "w", "answer", "1", [None]), (None, 1, "x", "answer", "1", []), ("a", 9, None, "answer", "1", []), ("a", 7, "x", "answer", "{}", [])], "conv string, turn int, call_id string, name string, arguments string, after array<string>")
    results = spark.createDataFrame([("a", 9, "x", "late"), ("a", 8, "x", "ok"), ("a", 9, "o", None), ("a", 1, None, "lost")], "conv string, turn int, call_id string, content string")
    got = {(r.conv, r.call_id): r for r in chat_tools.link_tools(calls, results, chat_tools.TURN_SCHEMAS).collect()}
    assert {k[1]: r.position for k, r in got.items() if k[0] == "a"} == {"w": 0, "y": 1, "x": 2, "z": 3, "p": None, "q": None, "o": None}
    x = got["a", "x"]
    assert (x.status, x.n_calls, x.n_results, x.errors) == ("linked", 2, 2, []) and x.json == '{"call":{"arguments":{"text":"q","words":3},"id":"x","name":"answer","position":2},"result":{"content":"ok","turn":8}}'
    assert got["a", "z"].errors == ["$: no JSON"] and got["a", "q"].status == "cycle" and got["a", "o"].status == "orphan" and got["", "x"].status == "unanswered"
    assert all(json.loads(r.json) is not None for r in got.values())
    assert chat_tools.link_tools(calls.limit(0), results.limit(0), {}).count() == 0


def test_chat_arguments_that_no_parser_likes(spark):
    odd = {"long": "9" * 400, "longer": "9" * 5000, "lone": '{"text":"\\ud800","words":1}', "nan": '{"text":"a","words":NaN}', "inf": "[Infinity]", "wide": "1e999", "deep": "[" * 100_000, "nest": "[" * 900 + "]" * 900, "key": '{"\\udfff":1}'}
    calls = spark.createDataFrame([("a", i, k, "answer" if k != "long" else "any", v, None) for i, (k, v) in enumerate(odd.items())], "conv string, turn int, call_id string, name string, arguments string, after array<string>")
    results = spark.createDataFrame([], "conv string, turn int, call_id string, content string")
    got = {r.call_id: r for r in chat_tools.link_tools(calls, results, {**chat_tools.TURN_SCHEMAS, "any": {"type": "integer", "minimum": 3}}).collect()}
    assert got["long"].errors == [] and got["lone"].errors == [] and got["lone"].json.count("\\ud800") == 1
    assert all(got[k].errors == ["$: no JSON"] for k in ("longer", "nan", "inf", "wide", "deep")) and "\\udfff: not known" in got["key"].errors[-1]
    strict = lambda t: json.loads(t, parse_constant=lambda c: 1 / 0)
    assert all(strict(r.json)["call"]["id"] == k for k, r in got.items())


@pytest.mark.parametrize("most", [100_000, 0])
def test_late_dependencies(spark, monkeypatch, most):
    monkeypatch.setattr(chat_tools, "GROUP_EDGES", most)
    rng, n = random.Random(6), 12
    rows = [(f"c{k}", i, f"t{i}", [f"t{rng.randrange(n)}" for _ in range(rng.choice([0, 0, 1, 2]))]) for k in range(8) for i in range(n)] + [("chain", i, f"t{i}", [f"t{i + 1}"]) for i in range(6 if most == 0 else 3000)]
    calls = spark.createDataFrame(rows, "conv string, turn long, call_id string, after array<string>")
    got = {(r.conv, r.call_id): r.level for r in chat_tools.dependency_levels(calls).collect()}
    assert len(got) == len(rows)
    for conv in {r[0] for r in rows}:
        own = {r[2]: r for r in rows if r[0] == conv}
        late = {c for c, r in own.items() if any(d in own and own[d][1] >= r[1] for d in r[3])}
        while more := {c for c, r in own.items() if c not in late and any(d in late for d in r[3])}:
            late |= more
        level = {}
        while fits := {c for c in late if c not in level and all(d in level for d in own[c][3] if d in late)}:
            level |= {c: 1 + max([level[d] for d in own[c][3] if d in late], default=0) for c in fits}
        assert {c: got[conv, c] for c in own} == {c: level.get(c) if c in late else 0 for c in own}


def test_turns_of_other_roles_are_no_calls(spark):
    turns = spark.createDataFrame([(1, 0, "system", "s"), (1, 1, "user", "q"), (1, 2, "assistant", "a"), (1, None, "user", "x"), (1, 3, None, "y"), (1, 4, "tool", "z")], "conv_id long, turn int, role string, text string")
    calls, results = chat_tools.turns_as_tools(turns)
    assert [r.call_id for r in calls.collect()] == ["call-1"] and [r.call_id for r in results.collect()] == ["call-1"]


# --- 4 ---------------------------------------------------------------------------------------------------------


def windows(text, n=10):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(FOLD))
    return w, [tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))] if w else []


@pytest.mark.parametrize("block", [64 << 20, 3000])
def test_decontamination(spark, docs, block):
    texts = [r.text for r in docs.collect() if r.text and len(r.text) > 300]
    items = [(1, " ".join(texts[0].split()[5:17]).upper() + "!"), (2, " ".join(texts[1].split()[:11])), (3, "X"), (4, None), (None, "w1"), (5, ""), (6, "never seen anywhere at all in any of these documents ever"), (1, "repeated id"), (10, "w7-w8")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    own = {}
    for i, t in items:
        if i is not None:
            for g in windows(t)[1]:
                own.setdefault(g, set()).add(str(i))
    lengths = {len(g) for g in own}
    source = clash(docs)
    got = decontaminate.find_contamination(source, bench, max_set_bytes=block)
    assert len({c.lower() for c in got.columns}) == len(got.columns)
    n = len(source.columns)
    seen = 0
    for r in got.collect():
        w, _ = windows(r["text"])
        hit, ids = set(), set()
        for k in lengths:
            for i in range(len(w) - k + 1):
                if tuple(w[i : i + k]) in own:
                    hit.update(range(i, i + k))
                    ids |= own[tuple(w[i : i + k])]
        values = dict(zip(got.columns[n:], r[n:]))
        assert (values["_n_words"], values["n_hit"], values["_items"], values["contaminated"]) == (len(w), len(hit), sorted(ids), bool(hit))
        seen += bool(hit)
    assert seen and decontaminate.remove_contamination(docs, bench, max_set_bytes=block).count() == docs.count() - seen
    cut = decontaminate.remove_contamination(docs, bench, how="spans", max_set_bytes=block)
    assert cut.columns == docs.columns and cut.count() == docs.count()
    assert decontaminate.find_contamination(docs, bench.limit(0)).filter("contaminated").count() == 0


# --- 5 ---------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("bin_rows", [50_000, 5])
def test_sharding(spark, docs, bin_rows):
    source = clash(docs)
    got = sharding.shard_documents(source, shards=4, bin_rows=bin_rows)
    rows = [dict(zip(got.columns, r)) for r in got.collect()]
    assert len(rows) == docs.count() and len({c.lower() for c in got.columns}) == len(got.columns)
    by = {}
    for r in rows:
        assert r["_size"] == len((r["text"] or "").encode()) + 1
        by.setdefault(r["_shard"], []).append(r)
    for own in by.values():
        assert sorted(r["_slot"] for r in own) == list(range(len(own)))
    total, largest = sum(r["_size"] for r in rows), max(r["_size"] for r in rows)
    assert all(abs(sum(r["_size"] for r in own) - total / 4) <= largest + 0.01 * total for own in by.values())
    assert sharding.shard_documents(docs.limit(0)).count() == 0


def test_sharding_splits_a_hot_text(spark):
    df = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot text").otherwise(F.concat(F.lit("text "), "id")).alias("text"))
    size = [r.b for r in sharding.shard_documents(df, bin_rows=200).groupBy("shard").agg(F.sum("size").alias("b")).collect()]
    assert len(size) == 16 and max(size) < 1.03 * min(size)


# --- 6 ---------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("split", ["128m", "3k"])
def test_warc_round_trip(spark, split):
    fake = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:99999>\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    rows = [(1, "u", "abc WARC/1.1\r\n def " + "x" * 2000), (2, "u", None), (3, "u\r\nx", fake * 3), (4, "u", "z" * 1500), (5, "u", "z" * 1500), (6, None, "WARC/1.1\r\n" * 5), (7, "a", ""), (None, "b", "z" * 1500), (8, "é", "é" * 700), (9, "é", "é" * 700), (10, "c", "z" * 999), (11, "c", "z" * 999), (5, "again", "z" * 1500)]
    rows += [(100 + i, f"p{i}", f"<html>{i}" + "y" * (i * 37 % 900)) for i in range(60)]
    pages = clash(spark.createDataFrame(rows, "page_id long, url string, html string")).coalesce(2)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        path = work_path(spark, "t-warc")
        warc.write_warc(pages, path)
        got = warc.read_warc(spark, path).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    want = []
    for i, _, h in rows:
        data = (h or "").encode()
        first = max([a for a, _, b in rows if b == h and a is not None], default=None) if len(data) >= 1000 else None
        refers = first if first != i else None
        want.append((i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if refers is not None else "response", refers))
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=key) == sorted(want, key=key)
    assert all(r.payload_digest == r.stated_digest for r in got)


# --- 7 ---------------------------------------------------------------------------------------------------------


def brute_mix(rows, weights=(5.0, 2.0, 1.0), cap=3):
    sizes = {}
    for i, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[k % 3] for k, s in enumerate(names)}
    total, full, targets = sum(sizes.values()), set(), {}
    while True:
        rest = total - sum(cap * sizes[s] for s in full)
        weight = sum(w[s] for s in names if s not in full)
        targets = {s: cap * sizes[s] if s in full else rest * w[s] / weight for s in names}
        over = {s for s in names if s not in full and targets[s] > cap * sizes[s]}
        if not over:
            return sizes, targets
        full |= over


def test_mixing(spark, docs):
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    sizes, targets = brute_mix(rows)
    got = mixing.mix_sources(clash(docs)).collect()
    assert len(got) == len(rows) and abs(sum(targets.values()) - sum(sizes.values())) < 1e-6
    for s in sizes:
        own = [r for r in got if r.source == s]
        assert all(abs(r.target - targets[s]) < 1e-6 and r.source_size == sizes[s] and 0 <= r.taken <= 3 * r.size for r in own)
        assert abs(sum(r.taken for r in own) - targets[s]) <= max(r.size for r in own) / 2 + 1e-6
    again = {(r.doc_id, r.source, r.size): r.taken for r in mixing.mix_sources(docs.repartition(7)).collect()}
    assert again == {(r.doc_id, r.source, r.size): r.taken for r in got}
    mixed = mixing.mix_documents(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r.copies for r in got)
    assert mixing.mix_sources(docs.limit(0)).count() == 0


def test_running_totals(spark):
    df = spark.createDataFrame([(g, i, (i * 7) % 5) for g in ("a", "b", None) for i in range(50 if g == "a" else 3)], "g string, i int, n long")
    got = sorted(((r.g or "~", r.i, r.before, r["rank"]) for r in running_totals(df, "g", ["i"], "n", "t").collect()))
    for g in ("a", "b", "~"):
        total = 0
        for k, (_, i, before, rank) in enumerate(x for x in got if x[0] == g):
            assert (before, rank) == (total, k)
            total += (i * 7) % 5


# --- 8 ---------------------------------------------------------------------------------------------------------


def test_token_counts(spark, docs):
    encoding = load_ranks()
    got = token_counts.count_tokens(clash(docs)).collect()
    want = sorted((r.doc_id or -1, len(encoding.encode_ordinary(r.text or ""))) for r in docs.collect())
    assert sorted((r.doc_id or -1, r.n_tokens) for r in got) == want
    assert token_counts.count_tokens(docs.limit(0)).count() == 0


@pytest.mark.parametrize("unit, n", [(" ", 1_000_000), ("\n", 1_000_000), ("\u2003", 300_000), ("a", 1_000_000), ("1", 1_000_000), ("!\n", 500_000), ("word ", 300_000)])
def test_long_texts_are_encoded_whole(unit, n):
    ids = lambda t: CODEC.encode(t)
    encoding = load_ranks()
    assert encoding.decode(ids(f"x{unit * n}y").tolist()) == f"x{unit * n}y"
    if unit.strip():
        assert ids(f"x{unit * n}y").tolist() == encoding.encode_ordinary(f"x{unit * n}y")
    for text in (f"{unit * 20_000}", f"x{unit * 20_000}", f"{unit * 20_000}y z", f"a b {unit * 5000}\n{unit * 3000}'s 1{unit * 9000}"):
        assert ids(text).tolist() == encoding.encode_ordinary(text)


def test_parts_of_texts_encode_alike(monkeypatch):
    encoding, rng = load_ranks(), random.Random(1)
    monkeypatch.setattr(byte_bpe, "_PART", 40)
    for _ in range(60):
        text = "".join(rng.choice(["a", "é", "1", " ", "  ", "\n", "\u2003", "'s", "!", "Wort"]) for _ in range(2000))
        assert CODEC.encode(text).tolist() == encoding.encode_ordinary(text)


def test_token_counts_of_rows_without_order(spark):
    df = spark.range(3000).select(F.concat(F.lit("k"), "id").alias("doc_id"), F.repeat(F.lit("x "), (F.col("id") % 17).cast("int")).alias("text")).orderBy(F.rand()).repartition(5)
    got = token_counts.count_tokens(df).collect()
    encoding = load_ranks()
    want = {f"k{i}": len(encoding.encode_ordinary("x " * (i % 17))) for i in range(3000)}
    assert len(got) == 3000 and {r.doc_id: r.n_tokens for r in got} == want


@pytest.mark.parametrize("block, split", [(1, "128m"), (2, "128m"), (7, "3b"), (1000, "5b"), (1 << 21, "128m")])
def test_separator_scan(spark, tmp_path, block, split):
    end = token_counts.END_ID
    (tmp_path / "part-0.txt").write_bytes(np.array([end, 1, 2, end, end, 3, 4, 5], ">u2").tobytes())
    (tmp_path / "part-1.txt").write_bytes(np.array([9, end], ">u2").tobytes())
    (tmp_path / "part-2.txt").write_bytes(np.array([4, 4, 4], ">u2").tobytes())
    (tmp_path / "part-3.txt").write_bytes(b"")
    across = [0x10C4, 0x5001, end, 0x50C4, 0x5050, 0x50, 0xC4, end]  # the separator's bytes across two tokens
    (tmp_path / "part-4.txt").write_bytes(np.array(across, ">u2").tobytes())
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", "1b")
    try:
        got = sorted((r.file[-5], r.doc_no, r.start, r.n_tokens) for r in token_counts.scan_token_files(spark, str(tmp_path), block_bytes=block).collect())
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert got == [("0", 0, 0, 0), ("0", 1, 1, 2), ("0", 2, 4, 0), ("0", 3, 5, 3), ("1", 0, 0, 1), ("2", 0, 0, 3), ("4", 0, 0, 2), ("4", 1, 3, 4)]
    (tmp_path / "part-5.txt").write_bytes(b"odd")
    with pytest.raises(Exception, match="whole token ids"):
        token_counts.scan_token_files(spark, str(tmp_path)).collect()


# --- 9 ---------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("hot", [64, 8])
def test_vectors(spark, monkeypatch, hot):
    monkeypatch.setattr(vector_dedup, "HOT", hot)
    monkeypatch.setattr(vector_dedup, "BLOCK", 16)
    rng = np.random.default_rng(1)
    base = rng.normal(size=(40, 32))
    near = base[0] + rng.normal(size=(60, 32)) * 0.12
    few = base[1] + rng.normal(size=(5, 32)) * 0.25
    v = [list(map(float, x)) for x in np.concatenate([base, near, few, base[:3], base[3:5] * 2])]
    v += [None, [], [0.0] * 32, [float("nan")] * 32, [None] + [1.0] * 31, v[0][:16], [1e300] * 32, [1e-300] * 32]
    rows = [(i, x, i % 3) for i, x in enumerate(v)]
    got = {r.vec_id: r for r in vector_dedup.similar_vectors(spark.createDataFrame([(*r, "own") for r in rows], "vec_id long, embedding array<double>, label int, n_links string"), miss=1e-6).collect()}
    good = {i: vector_dedup.unit(np.array([x]))[0] for i, x, _ in rows if x and None not in x and np.isfinite(x).all() and any(x)}
    links = {i: {j for j in good if j != i and len(good[i]) == len(good[j]) and good[i] @ good[j] >= 0.9} if i in good else set() for i, _, _ in rows}
    comp = {i: i for i in links}
    for _ in links:
        comp = {i: min([comp[i], *(comp[j] for j in links[i])]) for i in links}
    assert len(got) == len(rows)
    assert {i: (r.n_links, r.component_id, r.kept) for i, r in got.items()} == {i: (len(links[i]), comp[i], comp[i] == i) for i in links}
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert vector_dedup.similar_vectors(empty).count() == 0
    assert vector_dedup.drop_near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), miss=1e-6).count() == sum(comp[i] == i for i in comp)


def test_estimates_are_unbiased():
    rng = np.random.default_rng(2)
    plan = vector_dedup.plan_for(1000, 0.9, 1e-3)
    a = vector_dedup.unit(rng.normal(size=(3000, 64)))
    b = vector_dedup.unit(a + 0.1 * rng.normal(size=a.shape))
    code, factor = vector_dedup.codes(a, plan)
    turned = b @ vector_dedup.rotations(64, plan.rotations(64), plan.seed)[:, : code.shape[1]]
    true = np.einsum("ij,ij->i", a, b)
    bound = vector_dedup.upper_bounds(code, factor, turned, plan)
    guess = bound - plan.width * np.sqrt(1 - factor**2) / factor / np.sqrt(code.shape[1] - 1)
    assert abs((guess - true).mean()) < 0.01 and (bound >= true).all()


# --- 10 --------------------------------------------------------------------------------------------------------


def shingle_set(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(FOLD))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} - {()}


@pytest.mark.parametrize("k, small, block", [(2, 12, 2048), (5, 12, 2048), (2, 2, 8)])
def test_minhash(spark, docs, monkeypatch, k, small, block):
    monkeypatch.setattr(minhash, "_SMALL", small)
    monkeypatch.setattr(minhash, "_BLOCK", block)
    monkeypatch.setattr(minhash, "_TEXTS", block)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    sets = [(i, shingle_set(t, k)) for i, t in rows]
    comp = {i: i for i, _ in sets if i is not None}

    def root(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for a, (i, x) in enumerate(sets):
        for j, y in sets[:a]:
            if None not in (i, j) and x and y and 100 * len(x & y) >= 80 * len(x | y):
                p, q = root(i), root(j)
                comp[max(p, q)] = min(p, q)
    got = minhash.similar_groups(clash(docs), k=k).collect()
    want = sorted((str(i), len(s), str(root(i) if i is not None else None), i is None or root(i) == i) for i, s in sets)
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.kept) for r in got) == want
    assert minhash.similar_groups(docs.limit(0), k=k).count() == 0


def test_registers_estimate_similarity():
    rng = np.random.default_rng(4)
    for share in (0.5, 0.8, 0.95):
        errors = []
        for _ in range(60):
            u = np.sort(rng.integers(0, 1 << 63, 400, dtype=np.uint64) * np.uint64(2))
            cut = rng.random(400)
            a, b = u[cut < (1 + share) / 2], u[cut >= (1 - share) / 2]
            true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
            regs = minhash.registers([a, b])
            errors.append(float(minhash.estimate(regs[:1], regs[1:])[0]) - true)
        assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.05


def test_components(spark):
    e = spark.createDataFrame([(5, 4), (4, 3), (3, 2), (2, 1), (9, 8), (8, 10), (9, 8), (7, 7)], "a long, b long")
    assert {r.id: r.component for r in connected_components(e).collect()} == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 8: 8, 9: 8, 10: 8}
    assert connected_components(e.limit(0)).count() == 0
