"""Conversation repair, periodic runs and byte-level BPE against brute force written from their contracts."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from rosterlake.llm import byte_bpe, conversation_repair, periodic_runs
from rosterlake.llm import queries as Q

FAR = (10**9, "~", ())


def cheapest(rows):
    """(cost, audit, lines) of rows (role, text, fault) by a search over rows from the last to the first with whole edit strings."""
    best = {"": (0, "", ()), "s": FAR, "p": (0, "", ()), "o": FAR}
    step = {"": {"s": "s", "u": "o"}, "s": {"u": "o"}, "p": {"u": "o"}, "o": {"a": "p"}}
    names = {"u": "user", "a": "assistant"}

    def inserted(own):
        for _ in range(4):
            for state in own:
                for role, then in step[state].items():
                    if role != "s":
                        cost, audit, lines = own[then]
                        own[state] = min(own[state], (cost + 5, "I" + audit, (f"{names[role]}:", *lines)))
        return own

    best = inserted(best)
    for role, text, fault in reversed(rows):
        own = {}
        for state in best:
            cost, audit, lines = best[state]
            own[state] = (cost + 2, "D" + audit, lines)
            for want, then in step[state].items() if fault not in ("blank", "duplicate") else ():
                cost, audit, lines = best[then]
                cost += 5 * (fault == "truncated")
                if role[:1] == want:
                    own[state] = min(own[state], (cost, "K" + audit, (f"{role}:{text}", *lines)))
                elif want != "s":
                    own[state] = min(own[state], (cost + 1, "R" + audit, (f"{names[want]}:{text}", *lines)))
        best = inserted(own)
    return best[""]


def report(rows):
    """What op11 returns for one conversation's damaged rows (turn, role, text) in order."""
    seen, faults = set(), []
    for _, role, text in rows:
        body = re.sub(r"[ \t-\r]", "", text)
        faults.append("blank" if not body else "duplicate" if (role, text) in seen else "" if body[-1] in ".!?" else "truncated")
        seen.add((role, text))
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    cost, audit, lines = cheapest([(r, x, f) for (_, r, x), f in zip(rows, faults)])
    return gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()


def conversations(rng):
    rows = []
    for conv in [*range(40), None]:
        for turn in range(rng.choice([1, 2, 5, 9, 40])):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None])
            text = rng.choice(["Yes.", "no", "  ", "", "Again!", None, f"Some {turn}?", f"more {turn}\n", "x. \n"])
            rows.append((conv, None if rng.random() < 0.05 else turn * rng.choice([1, 1, 1, 2]), role, text))
    return rows + rows[:5]


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        spaced = lambda v: " " if v is None else v
        kind, role, text = zlib.crc32(f"{spaced(conv)}:{spaced(turn)}".encode()) % 20, spaced(role), spaced(text)
        if kind:
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return sorted(out, key=lambda r: (r[0] is None, r[0] or 0, r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))


@pytest.mark.parametrize("block", [1, 3, conversation_repair.BLOCK])
def test_conversation_repair(spark, block):
    rows = conversations(random.Random(block))
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"rank": F.lit("own"), "block": F.lit(1)}).repartition(3)
    blocks = conversation_repair.repaired_blocks(conversation_repair.with_planted_faults(df), block=block).cache()
    got = {r[0]: tuple(r)[1:] for r in conversation_repair.reports(blocks).collect()}
    by = {}
    for conv, *row in damaged(rows):
        by.setdefault(conv, []).append(tuple(row))
    assert got == {conv: report(own) for conv, own in by.items()}
    turns = {}
    for r in sorted(conversation_repair.repaired_turns(blocks).collect(), key=lambda r: (r.block, r.place)):
        turns.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
    assert all(hashlib.sha256("\n".join(turns.get(conv, [])).encode()).hexdigest() == own[-1] for conv, own in got.items())
    assert any(b.n_blocks > 1 for b in blocks.collect())


def test_every_conversation_has_a_report(spark):
    lost = next(c for c in range(10_000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    left = next(c for c in range(10_000, 20_000) if zlib.crc32(f"{c}: ".encode()) % 20 > 4)
    turns = spark.createDataFrame([(lost, 0, "user", "Hi."), (left, None, None, None)], "conv_id long, turn long, role string, text string")
    got = {r[0]: tuple(r)[1:] for r in conversation_repair.repair_reports(conversation_repair.with_planted_faults(turns), turns).collect()}
    nothing = hashlib.sha256(b"").hexdigest()
    assert got[lost] == (0, 0, 0, 0, 0, 0, "", nothing) and got[left][:2] == (0, 1)
    assert conversation_repair.repair_reports(turns.limit(0), turns.limit(0)).collect() == []


def test_long_repairs_by_blocks():
    rng = random.Random(4)
    marks = "".join(rng.choice("xuuaaUAso") for _ in range(200))
    rows = [({"s": "system", "u": "user", "a": "assistant"}.get(m.lower(), "tool"), "", "blank" if m == "x" else "truncated" if m.isupper() else "") for m in marks]
    assert conversation_repair.repair_whole(marks)[:2] == cheapest(rows)[:2]
    for n in (0, 1, 2, 3, 6, 7):
        ways = {t for p in conversation_repair._NEXT for q in conversation_repair._NEXT[p] if (t := conversation_repair.target(p, q, n)) is not None}
        assert all(len(t) == n and re.fullmatch("s?(ua)*u?|a(ua)*u?", t) for t in ways)


def all_runs(words, least=6, times=4):
    """Every run, each period tried at every place."""
    out, n = [], len(words)
    for p in range(1, n // times + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and words[j] == words[j + p]:
                j += 1
            length = j - i + p
            if j > i and length >= max(least, times * p) and not any(all(words[x] == words[x + q] for x in range(i, i + length - q)) for q in range(1, p)):
                out.append((i, length, p))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_runs_of_numbers():
    rng = random.Random(7)
    for _ in range(1500):
        n = rng.randint(0, 60)
        codes = [rng.randrange(rng.choice([1, 2, 3])) for _ in range(n)]
        if n and rng.random() < 0.6:
            a, p = rng.randrange(n), rng.randint(1, 9)
            codes = [codes[i] if i < a else codes[a + (i - a) % p] if a + (i - a) % p < n else 0 for i in range(n)]
        for least, times in ((6, 4), (2, 2), (9, 3)):
            assert periodic_runs.runs_of(np.array(codes, np.int64), least, times) == all_runs(codes, least, times)
    assert periodic_runs.runs_of(np.zeros(200_000, np.int64)) == [(0, 200_000, 1)]


def test_periodic_runs(spark, tmp_path):
    rng = random.Random(8)
    texts = [(i, "".join(rng.choice(["a", "É"]) + rng.choice([" ", "\n", "  ", "\t"]) for _ in range(rng.choice([0, 3, 40, 200])))) for i in range(120)]
    texts += [(i, " ".join(str(rng.random()) for _ in range(rng.choice([1, 30, 90])))) for i in range(120, 240)] + [(500, None), (501, " \n "), (None, "a " * 20), (None, None), (3, texts[3][1]), (502, "w " * 50_000)]
    df = spark.createDataFrame(texts, "doc_id long, text string").withColumns({"runs": F.lit("own"), "_w": F.lit(1)})
    df.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    want = []
    for key, text in texts:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        n = len(words)
        if key is not None and n and (h := zlib.crc32(str(key).encode())) % 10 == 0:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        runs = [(0, n, 1)] if n > 10_000 else all_runs(words)
        gone = {i for s, length, p in runs for i in range(s + p, s + length)}
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
        digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
        want.append((key, len(runs), *best, None if best[0] is None else 1000 * best[1] // best[2], digest("".join(f"{s},{n},{p}\n" for s, n, p in runs)), digest(" ".join(w for i, w in enumerate(words) if i not in gone))))
    got = [tuple(r) for r in Q.queries()["op12_periodic_runs"](spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert sum(r[1] > 0 for r in want) > 10


def test_byte_bpe(spark, tmp_path):
    import public_tokenizers

    rng = random.Random(9)
    pieces = ["Wort", " the", "1", "  ", "\n", "'s", "é", "漢字", "。", "🎉", "<|endoftext|>", "\x00", "!"]
    texts = [(i, "".join(rng.choice(pieces) for _ in range(rng.choice([0, 5, 300, 3000])))) for i in range(60)] + [(60, None), (61, ""), (None, "x"), (None, "x"), (62, "漢字漢字、" * 120_000)]
    spark.createDataFrame(texts, "doc_id long, text string").withColumn("ids", F.lit("own")).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        encoding = byte_bpe.load_encoding(f.read(), public_tokenizers.PATTERN)
    want = []
    for key, text in texts:
        ids = encoding.encode_ordinary(text or "")
        want.append((key, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert sorted(map(tuple, Q.queries()["op13_byte_bpe"](spark, str(tmp_path)).collect()), key=str) == sorted(want, key=str)


def test_codec_cuts_where_no_match_reaches_across(monkeypatch):
    codec, rng = byte_bpe.Codec.read(byte_bpe.RANKS), random.Random(1)
    encoding = byte_bpe.load_encoding(codec.ranks)
    monkeypatch.setattr(byte_bpe, "_PART", 30)
    pieces = ["a", "é", "ж", "غ", "ก", "か", "漢", "한", "1", "²", "٣", " ", "  ", "\n", " ", "'s", "'", "!", "、", "。", "Wort", "🎉", "́", "\x1c", "ª"]
    for _ in range(300):
        text = "".join(rng.choice(pieces) for _ in range(1200))
        assert codec.encode(text).tolist() == encoding.encode_ordinary(text) and codec.decode(codec.encode(text)) == text.encode()
    monkeypatch.setattr(byte_bpe, "_DECODED", 7)
    assert codec.decode(codec.encode("漢字 and more words in a row")) == "漢字 and more words in a row".encode()
    with pytest.raises(ValueError, match="no token"):
        codec.decode(np.array([999_999], "<u4"))


def test_ids_that_are_no_text(spark):
    df = spark.createDataFrame([(1, np.array([128, 200], "<u4").tobytes()), (2, None), (3, b"")], "k long, ids binary")
    got = {r.k: r.bytes for r in byte_bpe.decode_ids(df).collect()}
    codec = byte_bpe.Codec.read(byte_bpe.RANKS)
    assert got[1] == codec.decode(np.array([128, 200])) and got[2] is None and got[3] == b""
