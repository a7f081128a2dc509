"""Repair of conversations whose turns should alternate: the cheapest edits that give roles s?(ua)+ or nothing, with an audit.

The roles that a repaired conversation may have are one string for each feasible length. A conversation's turns are aligned to
each of them by the Wagner-Fischer recurrence, computed from the end, so that a walk from the start finds the first of the
cheapest edit strings in ASCII order. The best cost so far bounds how many turns can be inserted and deleted: lengths beyond
are left out, and of the others only that band around the diagonal is computed (Ukkonen). The audits of equally cheap lengths
are compared.

Long conversations are cut into blocks of turns. A block is aligned for each role that may come next at its start and at its
end; a pass over the blocks' costs from the last to the first, and one back, pick the states at the borders. Edit strings of
the same turns that do not end with an insertion never begin one another, so comparing block by block is comparing the whole.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, running_totals, saved

#: Edits, in the order in which ties are decided, and what they cost; an undeleted truncated turn costs TRUNCATED more.
DELETE, INSERT, REROLE, TRUNCATED = 2, 5, 1, 5
#: Turns that are aligned at once.
BLOCK = 32
_BLANK = " \t\n\x0b\x0c\r"

#: What has been written: nothing, a system turn, whole pairs (a user turn may come), an open pair (the assistant's turn must come).
NOTHING, SYSTEM, PAIRS, OPEN = range(4)
_NEXT = {NOTHING: (NOTHING, SYSTEM, PAIRS, OPEN), SYSTEM: (SYSTEM, PAIRS, OPEN), PAIRS: (PAIRS, OPEN), OPEN: (PAIRS, OPEN)}
_FAR = 1 << 40


def target(begin: int, end: int, n: int) -> str | None:
    """The only string of n role initials that leads from one state to another, if any."""
    if n == 0 or end in (NOTHING, SYSTEM):
        return ("" if begin == end else None) if n == 0 else "s" if (begin, end, n) == (NOTHING, SYSTEM, 1) else None
    head = "a" if begin == OPEN else "u"
    last = "a" if end == PAIRS else "u"
    if (head == last) == (n % 2 == 1):
        return (("au" if head == "a" else "ua") * n)[:n]
    return "s" + ("ua" * n)[: n - 1] if begin == NOTHING and n > 1 else None


def align(turns: str, want: str, inserts: int, deletes: int, tail: bool) -> tuple[int, str] | None:
    """(cost, edits) of making turns into want with at most so many insertions and deletions; the first edits in ASCII order.

    A turn is a letter: x must go, s, u, a and o (any other role) may stay, in capitals where truncated. Where not tail, no
    insertion may come last.
    """
    n, m = len(turns), len(want)
    table: list[list[int]] = [[]] * (n + 1)
    lows = [max(0, i - deletes) for i in range(n + 2)]

    def at(i: int, j: int) -> int:
        k = j - lows[i]
        return table[i][k] if 0 <= k < len(table[i]) else _FAR

    for i in range(n, -1, -1):
        low, high = lows[i], min(m, i + inserts)
        row = [_FAR] * max(0, high - low + 1)
        if i < n:
            below, off, turn = table[i + 1], lows[i + 1], turns[i]
            plain, extra = turn.lower(), TRUNCATED if turn.isupper() else 0
        best = _FAR  # of the cell to the right
        for j in range(high, low - 1, -1):
            role = want[j] if j < m else ""
            cost = 0 if i == n and j == m else best + INSERT if role and role != "s" and (tail or i < n) else _FAR
            if i < n:
                k = j - off
                if 0 <= k < len(below):
                    cost = min(cost, below[k] + DELETE)
                if role and turn != "x" and 0 <= k + 1 < len(below) and (plain == role or role != "s"):
                    cost = min(cost, below[k + 1] + extra + (plain != role))
            row[j - low] = best = min(cost, _FAR)
        table[i] = row
    total = at(0, 0)
    if total >= _FAR:
        return None
    i = j = 0
    edits = []
    while i < n or j < m:
        cost = at(i, j)
        if i < n and at(i + 1, j) + DELETE == cost:
            edits.append("D")
            i += 1
        elif j < m and want[j] != "s" and (tail or i < n) and at(i, j + 1) + INSERT == cost:
            edits.append("I")
            j += 1
        else:
            edits.append("K" if turns[i].lower() == want[j] else "R")
            i, j = i + 1, j + 1
    return total, "".join(edits)


def _incumbent(turns: str, begin: int, end: int, tail: bool) -> int | None:
    """The cost of some edits that lead from begin to end: all turns deleted, or each one kept or given the next role. None if there are none."""
    n = len(turns)
    if end == SYSTEM and begin == NOTHING:
        return DELETE * (n - 1) + TRUNCATED if "s" in turns.lower() else None
    found = [DELETE * n + INSERT * (0 if begin == end else {PAIRS: 1 if begin == OPEN else 2, OPEN: 1}[end])]
    for start in ("", "insert", "delete"):
        state, cost = begin, 0
        if start == "insert":
            state, cost = (PAIRS if begin == OPEN else OPEN), INSERT
        for turn in turns:
            if turn == "x" or turn.isupper() or start == "delete":
                start, cost = start if turn == "x" or turn.isupper() else "", cost + DELETE
            elif turn == "s" and state == NOTHING:
                state = SYSTEM
            else:
                cost += turn != ("a" if state == OPEN else "u")
                state = PAIRS if state == OPEN else OPEN
        if state == OPEN and end == PAIRS and tail:
            state, cost = PAIRS, cost + INSERT
        if state == end:
            found.append(cost)
    return min(found)


@lru_cache(maxsize=1 << 16)
def repair(turns: str, begin: int, end: int, tail: bool) -> tuple[int, str] | None:
    """(cost, edits) of the cheapest edits of turns from one state to another over all feasible lengths, ties by the first in ASCII order."""
    most = _incumbent(turns, begin, end, tail)
    if most is None:
        return None
    n, gone = len(turns), turns.count("x")

    def least(m: int) -> int:
        inserts = max(0, m - (n - gone))
        return DELETE * (n - m + inserts) + INSERT * inserts

    best = None
    for m in sorted(range(max(0, n - most // DELETE), n - gone + max(0, most - DELETE * gone) // INSERT + 1), key=least):
        want = target(begin, end, m)
        if want is None or least(m) > most:
            continue
        inserts = (most - DELETE * (n - m)) // (DELETE + INSERT)  # with n - m + inserts deletions they cost no more than most
        got = align(turns, want, inserts, n - m + inserts, tail)
        if got and (best is None or got < best):
            best, most = got, min(most, got[0])
    return best


def repair_whole(turns: str) -> tuple[int, str, int]:
    """(cost, edits, final state) for a whole conversation."""
    return min((*got, end) for end in (NOTHING, PAIRS) if (got := repair(turns, NOTHING, end, True)))


def _roles(edits: str, begin: int, end: int) -> str:
    """The role initial that each edit writes, - for a deletion."""
    want = iter(target(begin, end, sum(e != "D" for e in edits)))
    return "".join("-" if e == "D" else next(want) for e in edits)


def _edit_udf():
    def edit(turns: pd.Series, begin: pd.Series, end: pd.Series, tail: pd.Series) -> pd.DataFrame:
        out = []
        for t, p, q, last in zip(turns, begin, end, tail):
            cost, edits, q = repair_whole(t) if q < 0 else (*repair(t, int(p), int(q), bool(last)), int(q))
            out.append((cost, edits, _roles(edits, int(p), q)))
        return pd.DataFrame(out, columns=["cost", "edits", "roles"]).astype({"cost": "int64", "edits": "str", "roles": "str"})

    return F.pandas_udf(edit, "cost long, edits string, roles string")


def _cost_udf():
    def costs(turns: pd.Series, first: pd.Series, tail: pd.Series) -> pd.Series:
        """Sixteen costs and sixteen places, one for each pair of states, -1 where there is no way; places order the edits of a state."""
        out = []
        for t, head, last in zip(turns, first, tail):
            cost, place = [-1] * 16, [-1] * 16
            for p in (NOTHING,) if head else _NEXT:
                got = {q: r for q in _NEXT[p] if (q in (NOTHING, PAIRS) or not last) and (r := repair(t, p, q, bool(last)))}
                for k, q in enumerate(sorted(got, key=lambda q: got[q][1])):
                    cost[4 * p + q], place[4 * p + q] = got[q][0], k
            out.append(cost + place)
        return pd.Series(out)

    return F.pandas_udf(costs, "array<long>")


def _same(value: str):
    return lambda x: x == value


def _streamed(df: DataFrame, group: str, order: Column, work, schema) -> DataFrame:
    """work over the batches of each task, which hold a group's rows one after the other in the order given."""
    return df.repartition(F.col(group)).sortWithinPartitions(F.col(group), order).mapInArrow(work, schema)


def _borders(blocks: DataFrame, conv: str) -> DataFrame:
    """(conv, block, begin, end): the states at the borders of each block of blocks(conv, block, costs).

    A row a block, not a row a turn, goes through one task for a conversation, and a task keeps four numbers.
    """
    key = blocks.schema[conv]
    kind = T.StructType([key, T.StructField("block", T.LongType()), T.StructField("then", T.ArrayType(T.LongType()))])
    last = T.StructType([key, T.StructField("block", T.LongType()), T.StructField("begin", T.LongType()), T.StructField("end", T.LongType())])

    def backward(batches):
        before, ahead = object(), None
        for batch in batches:
            out = []
            for name, costs in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                if name != before:  # the last block: nothing comes after it
                    before, ahead = name, [0, None, 0, None]
                then, now = [-1] * 4, [None] * 4
                for p in range(4):
                    ways = [(costs[4 * p + q] + ahead[q], costs[16 + 4 * p + q], q) for q in range(4) if costs[4 * p + q] >= 0 and ahead[q] is not None]
                    if ways:
                        now[p], _, then[p] = min(ways)
                ahead = now
                out.append(then)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.list_(pa.int64()))], names=[conv, "block", "then"])

    def forward(batches):
        before, state = object(), NOTHING
        for batch in batches:
            begin, end = [], []
            for name, then in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                if name != before:
                    before, state = name, NOTHING
                begin.append(state)
                state = then[state]
                end.append(state)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(begin, pa.int64()), pa.array(end, pa.int64())], names=[conv, "block", "begin", "end"])

    ways = saved(_streamed(blocks.select(conv, "block", "costs"), conv, F.desc("block"), backward, kind), "conversation-ways")
    return _streamed(ways, conv, F.asc("block"), forward, last)


def repaired_blocks(turns: DataFrame, *, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", block: int = BLOCK) -> DataFrame:
    """(conv, block, n_blocks, faults, cost, edits, turns): a row for each block of at most so many turns of a conversation.

    edits has a letter for each edit: D deleted, I inserted, K kept, R given another role. turns is an array of (role, text), the
    repaired turns. faults is a struct of what report needs: numbers of blank, duplicate, truncated and illegal turns, the
    numbers of turns and the initials at the block's ends.

    A conversation's rows are ordered by turn, nulls first, ties by role and text. Null roles and texts count as one blank;
    null conversations are one. A role counts by its first character. blank: nothing but white space; duplicate: role and text
    stood earlier; truncated: does not end with . ! or ?. Repeated rows are duplicates; an empty table gives an empty result;
    other columns are ignored. Conversations may be of any length.
    """
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = turns.select(F.col(conv).alias("_conv"), F.col(turn).cast("long").alias("_turn"), spaced(role).alias("_role"), spaced(text).alias("_text"))
    rows = rows.withColumns({"_some": F.col("_turn").isNotNull().cast("int"), "_number": F.coalesce("_turn", F.lit(0).cast("long")), "_each": F.lit(1).cast("long")})
    deal = [F.col("_some"), F.col("_number"), F.substring("_role", 1, 8), F.substring("_text", 1, 16)]
    placed = running_totals(rows, "_conv", ["_some", "_number", "_role", "_text"], "_each", "conversation-rows", split=deal, count="_rows").drop("before", "_some", "_number", "_each")
    tail = F.right(F.rtrim(F.col("_text"), F.lit(_BLANK)), F.lit(1))
    placed = placed.withColumns({"_tail": tail, "_key": F.unhex(F.sha2(F.concat(F.length("_role").cast("string"), F.lit(":"), "_role", "_text").cast("binary"), 256))})
    # Where a role and text stand more than once, the place of the first; the others join nothing.
    firsts = placed.filter("_tail <> ''").groupBy(F.col("_conv").alias("_c"), F.col("_key").alias("_k")).agg(F.min("rank").alias("_first"), F.count(F.lit(1)).alias("_n")).filter("_n > 1").drop("_n")
    known = placed.join(firsts, F.col("_conv").eqNullSafe(F.col("_c")) & (F.col("_key") == F.col("_k")), "left")
    fault = F.when(F.col("_tail") == "", "blank").when(F.col("rank") > F.col("_first"), "duplicate").when(~F.col("_tail").isin(".", "!", "?"), "truncated").otherwise("")
    initial = F.substring("_role", 1, 1)
    mark = F.when(initial.isin("s", "u", "a"), initial).otherwise("o")
    mark = F.when(F.col("fault").isin("blank", "duplicate"), "x").when(F.col("fault") == "truncated", F.upper(mark)).otherwise(mark)
    row = F.struct("rank", F.col("_turn").alias("turn"), F.col("_role").alias("role"), F.col("_text").alias("text"), "fault", initial.alias("initial"), mark.alias("mark"))
    size = F.lit(block).cast("long")
    grouped = known.withColumn("fault", fault).groupBy("_conv", F.floor(F.col("rank") / size).alias("block")).agg(F.array_sort(F.collect_list(row)).alias("rows"), F.ceil(F.first("_rows") / size).alias("n_blocks"))
    field = lambda name: F.transform("rows", lambda r: r[name])
    some = F.filter(field("turn"), lambda t: t.isNotNull())
    pairs = F.transform(F.sequence(F.lit(0), F.size("rows") - 1), lambda i: F.when(i > 0, F.concat(F.get("rows", i - 1)["initial"], F.get("rows", i)["initial"])))
    counts = {name: F.size(F.filter(field("fault"), _same(name))).cast("long") for name in ("blank", "duplicate", "truncated")}
    counts |= {"illegal": F.size(F.filter(pairs, lambda p: p.isNotNull() & ~p.isin("su", "ua", "au"))).cast("long"), "numbers": F.size(F.array_distinct(some)).cast("long"), "low": F.array_min(some), "high": F.array_max(some)}
    counts |= {"left": F.element_at("rows", 1)["initial"], "right": F.element_at("rows", -1)["initial"]}
    faults = F.struct(*[c.alias(n) for n, c in counts.items()])
    blocks = saved(grouped.select("_conv", "block", "n_blocks", faults.alias("faults"), F.array_join(field("mark"), "").alias("marks"), F.transform("rows", lambda r: F.struct(r["role"].alias("role"), r["text"].alias("text"))).alias("rows")), "conversation-blocks")
    is_last = F.col("block") == F.col("n_blocks") - 1
    long = blocks.filter("n_blocks > 1")
    costs = long.select("_conv", "block", _cost_udf()("marks", F.col("block") == 0, is_last).alias("costs"))
    borders = _borders(costs, "_conv").withColumnsRenamed({"_conv": "_c", "block": "_b"})
    long = long.join(borders, F.col("_conv").eqNullSafe(F.col("_c")) & (F.col("block") == F.col("_b"))).drop("_c", "_b")
    short = blocks.filter("n_blocks = 1").withColumns({"begin": F.lit(NOTHING).cast("long"), "end": F.lit(-1).cast("long")})
    done = short.unionByName(long).withColumn("done", _edit_udf()("marks", "begin", "end", is_last))
    letter = lambda name, k: F.substring(F.col("done")[name], k, F.lit(1))
    used = lambda k: F.length(F.translate(F.substring(F.col("done")["edits"], F.lit(1), k - 1), "I", ""))  # noqa: E731  turns before the k-th edit
    every = F.transform(F.sequence(F.lit(1), F.length("done.edits")), lambda k: F.struct(letter("edits", k).alias("edit"), letter("roles", k).alias("initial"), F.get("rows", used(k)).alias("row")))
    every = F.when(F.length("done.edits") > 0, F.filter(every, lambda e: e["edit"] != "D"))
    named = lambda e: F.when(e["edit"] == "K", e["row"]["role"]).otherwise(F.when(e["initial"] == "u", "user").otherwise("assistant"))
    made = F.transform(every, lambda e: F.struct(named(e).alias("role"), F.when(e["edit"] == "I", "").otherwise(e["row"]["text"]).alias("text")))
    return done.select(F.col("_conv").alias(conv), "block", "n_blocks", "faults", F.col("done.cost").alias("cost"), F.col("done.edits").alias("edits"), F.coalesce(made, F.array().cast("array<struct<role:string,text:string>>")).alias("turns"))


def repaired_turns(blocks: DataFrame, conv: str = "conv_id") -> DataFrame:
    """(conv, block, place, role, text): the repaired turns of repaired_blocks, in the order of block and place."""
    return blocks.select(conv, "block", F.posexplode("turns").alias("place", "t")).select(conv, "block", "place", "t.role", "t.text")


_COUNTS = ["blank", "duplicate", "truncated", "illegal", "cost"]


def reports(blocks: DataFrame, conv: str = "conv_id") -> DataFrame:
    """(conv, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) for each conversation of repaired_blocks.

    gaps: turn numbers missing between the smallest and the largest; illegal: neighbours whose roles' initials are not su, ua or
    au; audit: all edits; repaired_sha256: of the repaired turns as `role:text`, a line each. A digest and an audit are made in
    order, so the blocks of one conversation pass through one task one by one, which keeps no more than the audit.
    """
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")
    f = F.col("faults")
    gaps = F.coalesce(f["high"] - f["low"] + 1 - f["numbers"], F.lit(0).cast("long"))
    short = blocks.filter("n_blocks = 1").select(conv, gaps.alias("gaps"), *[f[c].alias(c) for c in _COUNTS[:-1]], "cost", F.col("edits").alias("audit"), F.sha2(lines.cast("binary"), 256).alias("repaired_sha256"))
    many = blocks.filter("n_blocks > 1").select(conv, "block", *[f[c].alias(c) for c in (*_COUNTS[:-1], "numbers", "low", "high", "left", "right")], "cost", "edits", F.when(F.size("turns") > 0, lines.cast("binary")).alias("lines"))

    def join(batches):
        def out():
            count["illegal"] += broken
            gaps = high - low + 1 - numbers if low is not None else 0
            values = [name, gaps, *(count[c] for c in _COUNTS), "".join(edits), digest.hexdigest()]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], names=names)

        names = [conv, "gaps", *_COUNTS, "audit", "repaired_sha256"]
        name = before = object()
        for batch in batches:
            kinds = [batch.schema.field(0).type, *[pa.int64()] * (1 + len(_COUNTS)), pa.string(), pa.string()]
            for k in range(batch.num_rows):
                row = {c: batch.column(i)[k].as_py() for i, c in enumerate(batch.schema.names)}
                if name is before or row[conv] != name:
                    if name is not before:
                        yield out()
                    name, count, numbers, low, high, right, broken, edits, digest, begun = row[conv], dict.fromkeys(_COUNTS, 0), 0, None, None, None, 0, [], hashlib.sha256(), False
                for c in _COUNTS:
                    count[c] += row[c]
                broken += right is not None and right + row["left"] not in ("su", "ua", "au")
                numbers += row["numbers"] - (row["low"] is not None and row["low"] == high)
                low, high, right = row["low"] if low is None else low, high if row["high"] is None else row["high"], row["right"]
                edits.append(row["edits"])
                if row["lines"] is not None:
                    digest.update(b"\n" + row["lines"] if begun else row["lines"])
                    begun = True
        if name is not before:
            yield out()

    return short.unionByName(_streamed(many, conv, F.asc("block"), join, short.schema))


def with_planted_faults(turns: DataFrame, *, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Damaged turns, by the CRC-32 of `conv:turn` modulo 20: 0 drops the row, 1 empties its text, 2 takes . ! and ? from it, 3 repeats the row,
    4 gives it the role user. Nulls count as one blank in the CRC, and roles and texts that are null become one."""
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(spaced(conv), F.lit(":"), spaced(turn)).cast("binary")) % 20
    rows = turns.select(conv, turn, spaced(role).alias(role), spaced(text).alias(text), kind.alias("_k")).filter("_k <> 0")
    rows = rows.withColumn(text, F.when(F.col("_k") == 1, "").when(F.col("_k") == 2, F.translate(text, ".!?", "")).otherwise(F.col(text)))
    rows = rows.withColumn(role, F.when(F.col("_k") == 4, "user").otherwise(F.col(role)))
    return rows.withColumn("_copy", F.explode(F.when(F.col("_k") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("_k", "_copy")


def repair_reports(turns: DataFrame, every: DataFrame, *, conv: str = "conv_id") -> DataFrame:
    """reports of turns, for every distinct conversation of every; one without turns has zeros, an empty audit and the digest of nothing."""
    blocks = saved(repaired_blocks(turns, conv=conv), "conversation-repairs")
    own = reports(blocks, conv).withColumnRenamed(conv, "_c")
    empty = hashlib.sha256(b"").hexdigest()
    joined = every.select(conv).distinct().join(own.withColumn("_own", F.lit(True)), F.col(conv).eqNullSafe(F.col("_c")), "left")
    filled = {c: F.coalesce(c, F.lit(0).cast("long")) for c in ["gaps", *_COUNTS]} | {"audit": F.coalesce("audit", F.lit("")), "repaired_sha256": F.coalesce("repaired_sha256", F.lit(empty))}
    return joined.select(conv, *[v.alias(c) for c, v in filled.items()])
