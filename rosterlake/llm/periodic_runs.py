"""Maximal periodic runs of words, by uniting suffix classes in the order of falling LCP.

Two suffixes of a text are in one class at level l if they share their first l words. From the longest common prefix down,
neighbours in the sorted suffixes are united as in Kruskal's algorithm, and each class keeps its positions in order. When two
positions i < j become neighbours in such an order at level l, the words of [i, j + l) repeat with period j - i, and no
smaller one if j - i <= l, as a smaller one would put a position of the class between them. Each run is met that way at its
own start and one period further.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_batches

RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


def sorted_suffixes(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(suffixes of codes in order, LCP of each with the next one), by doubling prefixes; codes are numbers from 0."""
    n = len(codes)
    rank = np.unique(codes, return_inverse=True)[1].astype(np.int64)
    ranks, step = [rank.astype(np.int32)], 1
    while True:
        after = np.zeros(n, np.int64)
        after[: max(0, n - step)] = rank[step:] + 1
        pair = rank * (n + 1) + after
        order = np.argsort(pair, kind="stable")
        own = pair[order]
        place = np.cumsum(np.concatenate([[0], own[1:] != own[:-1]]))
        if place[-1] == n - 1:
            break
        rank = np.empty(n, np.int64)
        rank[order] = place
        ranks.append(rank.astype(np.int32))  # equal where the first 2 * step words are
        step *= 2
    a, b = order[:-1].copy(), order[1:].copy()
    lcp = np.zeros(n - 1, np.int64)
    for k in range(len(ranks) - 1, -1, -1):
        inside = np.flatnonzero((a + (1 << k) <= n) & (b + (1 << k) <= n))
        same = inside[ranks[k][a[inside]] == ranks[k][b[inside]]]
        for x in (lcp, a, b):
            x[same] += 1 << k
    return order, lcp


def _level(least: int, times: int) -> int:
    """What a run's start and the place one period on share at least: the run's length less its period."""
    return min(max(least, times * p) - p for p in range(1, least // times + 2))


def runs_of(codes: np.ndarray, least: int = 6, times: int = 4) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of length >= max(least, times * period), by start, then period. times is 2 or more.

    A run is a stretch with smallest period p (codes p apart are equal) that no neighbour extends keeping the period.
    """
    n, level = len(codes), _level(least, times)
    if n < least:
        return []
    order, lcp = sorted_suffixes(codes)
    edges = np.flatnonzero(lcp >= level)
    edges = edges[np.argsort(-lcp[edges], kind="stable")]
    if not len(edges):
        return []
    head = list(range(n))  # union-find over places in the sorted suffixes

    def find(x: int) -> int:
        while head[x] != x:
            head[x] = x = head[head[x]]
        return x

    held: dict[int, list[int]] = {}
    out, codes = [], codes.tolist()

    def seed(i: int, j: int, shared: int) -> None:
        period = j - i
        length = shared + period
        if length >= times * period and length >= least and (i == 0 or codes[i - 1] != codes[j - 1]):
            out.append((i, length, period))

    for edge, shared, left, right in zip(edges.tolist(), lcp[edges].tolist(), order[edges].tolist(), order[edges + 1].tolist()):
        a, b = find(edge), find(edge + 1)
        big, small = held.pop(a, None) or [left], held.pop(b, None) or [right]
        if len(big) < len(small):
            big, small = small, big
        places = [bisect_left(big, x) for x in small]
        last = -1
        for k, (x, at) in enumerate(zip(small, places)):
            before = big[at - 1] if at else -1
            if before > last:  # else its neighbour before is of its own class, as it was
                seed(before, x, shared)
            if at < len(big) and (k + 1 == len(small) or big[at] < small[k + 1]):
                seed(x, big[at], shared)
            last = x
        if places[0] == len(big):
            big += small
        elif len(small) * 8 > len(big):
            big = sorted(big + small)  # two ordered runs: one merge
        else:
            for x, at in zip(reversed(small), reversed(places)):
                big.insert(at, x)
        head[b] = a
        held[a] = big
    out.sort(key=lambda run: (run[0], run[2]))
    return out


def _staying(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of n words no run holds after its first period."""
    edge = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        edge[start + period] += 1
        edge[start + length] -= 1
    return np.cumsum(edge[:-1]) == 0


def _runs_of_words(words: list[bytes], least: int, times: int) -> list[tuple[int, int, int]]:
    """runs_of for words. Where no stretch of as many words as a run must share with itself occurs twice there is none."""
    n, level = len(words), _level(least, times)
    if n < least or len(set(zip(*(words[j:] for j in range(level))))) == n - level + 1:
        return []
    number: dict[bytes, int] = {}
    return runs_of(np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n), least, times)


def find_runs(docs: DataFrame, *, text: str = "text", keep: list[str] | None = None, runs: str = "runs", collapsed: str = "collapsed", least: int = 6, times: int = 4) -> DataFrame:
    """docs with runs (array of start, length and period, by start, then period) and collapsed (the words that stay, joined by one blank).

    Words are [^\\x20\\x09-\\x0D]+ of the whole text, numbered from 0, and compared as they stand. A word goes if any run
    holds it after that run's first period. Runs are as of runs_of. keep names the columns that stay (all by default; columns
    named like the two new ones are replaced). Null and empty texts have no words, no runs and an empty collapsed text; repeated
    rows stay; an empty table gives an empty result. A text is worked on by itself, in memory that follows its number of words.
    """
    text_batches(docs.sparkSession)
    names = [c for c in (docs.columns if keep is None else keep) if c.lower() not in (runs.lower(), collapsed.lower())]
    kept = docs.select(*[F.col(f"`{c}`") for c in names])
    rows = docs.select(*[F.col(f"`{c}`") for c in names], F.col(text).cast("string").alias(collapsed))
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def search(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 64):
                part = batch.slice(a, 64)
                found, texts = [], []
                for t in part.column(part.num_columns - 1):
                    words = (t.as_py() or "").encode().split()  # separates at exactly the six bytes named above
                    own = _runs_of_words(words, least, times)
                    if own:
                        stay = _staying(len(words), own)
                        words = [words[i] for i in np.flatnonzero(stay).tolist()]
                    found.append([{"start": s, "length": n, "period": p} for s, n, p in own])
                    texts.append(b" ".join(words).decode())
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(found, kind), pa.array(texts, pa.string())], names=[*names, runs, collapsed])

    return rows.mapInArrow(search, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema), f"`{runs}` {RUNS}", f"`{collapsed}` string"]))


def longest_run(runs: Column) -> Column:
    """The run of greatest length, ties by the smallest start, then period; null if there is none."""
    key = F.transform(runs, lambda r: F.struct((-r["length"]).alias("n"), r["start"].alias("start"), r["period"].alias("period")))
    best = F.array_min(key)
    return F.when(best.isNotNull(), F.struct(best["start"].alias("start"), (-best["n"]).alias("length"), best["period"].alias("period")))


def runs_digest(runs: Column) -> Column:
    """SHA-256, in lower-case hexadecimal, of a line `start,length,period` for each run."""
    lines = F.transform(runs, lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    return F.sha2(F.array_join(lines, "").cast("binary"), 256)


def with_planted_runs(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs where some texts repeat: with h the CRC-32 of the key's digits, g = floor(h / 10) and n words, if h % 10 = 0 and n > 0 each word
    i >= a becomes word a + (i - a) % p, where a = g % n and p = 1 + floor((n - a) / (3 + g % 8)). Null keys and texts stay as they are."""
    h = F.crc32(F.col(key).cast("string").cast("binary"))
    words = F.regexp_extract_all(F.col(text), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    marked = docs.withColumn("_w", F.when(h % 10 == 0, words)).withColumn("_g", F.floor(h / 10)).withColumn("_n", F.size("_w").cast("long"))
    marked = marked.withColumn("_a", F.when(F.col("_n") > 0, F.col("_g") % F.col("_n")))
    marked = marked.withColumn("_p", F.floor((F.col("_n") - F.col("_a")) / (F.col("_g") % 8 + 3)) + 1)
    tail = F.transform(F.sequence(F.lit(0).cast("long"), F.col("_n") - F.col("_a") - 1), lambda i: F.element_at("_w", (F.col("_a") + i % F.col("_p") + 1).cast("int")))
    damaged = F.array_join(F.concat(F.slice("_w", F.lit(1), F.col("_a").cast("int")), tail), " ")
    return marked.withColumn(text, F.when(F.col("_a").isNotNull(), damaged).otherwise(F.col(text))).drop("_w", "_g", "_n", "_a", "_p")
