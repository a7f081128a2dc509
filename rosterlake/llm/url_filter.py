"""URL filters: host/path rules first, then exact membership in a list of keys by a Bloom filter cascade.

Level 0 encodes the listed keys; level 1 the unlisted keys of the corpus that level 0 lets through by mistake; level 2 the
listed keys that level 1 lets through, and so on until no key is left. A key belongs to the list exactly when the first
level that rejects it is odd. Because the cascade was built over every key of the corpus, that answer is exact there, and
the only thing a row meets is a few bit arrays: rows of the corpus are never joined or shuffled to be judged.

All of it is DataFrame functions. A level's bits are a one-row table read by a scalar subquery. Its size is known before
it is built; a list too long for max_level_bytes is cut by key hash into blocks, each with a cascade of its own. Rows and keys
are then dealt to the blocks once, and each block reads its own.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, fold_ascii, fresh, saved

#: (verdict, host, path), as the contract of the query fixes them.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
MAX_LEVELS = 64


def url_host(url: Column) -> Column:
    """What stands after the first :// up to /, ?, # or the end, A-Z lower-cased; empty for null or without ://."""
    return F.coalesce(fold_ascii(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def url_path(url: Column) -> Column:
    """What follows the host up to ?, # or the end; empty for null or without ://."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_columns(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, both null where none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, name, start in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1], r[2])):
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(start)
        rule, verdict = F.when(fits, F.lit(name + start)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def _bits(n: int, rate: float) -> tuple[int, int]:
    """(bits, hashes) of a Bloom filter of n keys with this rate of false positives."""
    hashes = max(1, round(-math.log2(rate)))
    return max(64, 64 * math.ceil(n * hashes / math.log(2) / 64)), hashes


def _places(key: Column, level: int, bits: int, hashes: int) -> list[Column]:
    one = F.pmod(F.xxhash64(key, F.lit(2 * level)), F.lit(bits))
    two = F.pmod(F.xxhash64(key, F.lit(2 * level + 1)), F.lit(bits))
    return [F.pmod(one + two * j, F.lit(bits)) for j in range(hashes)]


class Cascade:
    """The levels built: one-row tables of 64-bit words, with their numbers of bits and hashes."""

    def __init__(self) -> None:
        self.levels: list[tuple[DataFrame, int, int]] = []

    def passes(self, key: Column, level: int) -> Column:
        words, bits, hashes = self.levels[level]
        array = words.select("words").scalar()
        tests = [F.getbit(F.get(array, F.shiftright(p, 6).cast("int")), F.pmod(p, F.lit(64)).cast("int")) == 1 for p in _places(key, level, bits, hashes)]
        return reduce(lambda a, b: a & b, tests)

    def listed(self, key: Column) -> Column:
        """Whether a key of the corpus is on the list."""
        out = F.lit(len(self.levels) % 2 == 1)
        for level in reversed(range(len(self.levels))):
            out = F.when(~self.passes(key, level), F.lit(level % 2 == 1)).otherwise(out)
        return out

    def add(self, keys: DataFrame, n: int, rate: float) -> None:
        bits, hashes = _bits(n, rate)
        level, one = len(self.levels), F.lit(1).cast("long")
        set_bits = keys.select(F.explode(F.array(*_places(F.col("key"), level, bits, hashes))).alias("p"))
        words = set_bits.groupBy(F.shiftright("p", 6).alias("at")).agg(F.bit_or(F.call_function("shiftleft", one, F.pmod("p", F.lit(64)).cast("int"))).alias("w"))
        blank = keys.sparkSession.range(bits // 64).select(F.col("id").alias("at"), F.lit(0).cast("long").alias("w"))
        whole = words.unionByName(blank).groupBy("at").agg(F.bit_or("w").alias("w"))
        # One row of a size fixed by bits, which the caller has checked.
        row = whole.agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "w"))), lambda x: x["w"]).alias("words"))
        self.levels.append((saved(row, f"url-level-{level}"), bits, hashes))


def build_cascade(keys: DataFrame, rate: float = 1 / 16) -> Cascade:
    """keys(key, listed): every key of the corpus once. Each level is built from the keys that the earlier ones mistake."""
    cascade = Cascade()
    counts = {r["listed"]: r["n"] for r in keys.groupBy("listed").agg(F.count(F.lit(1)).alias("n")).collect()}
    todo, n, other = keys.filter("listed"), counts.get(True, 0), keys.filter("NOT listed")
    while n:
        if len(cascade.levels) == MAX_LEVELS:
            raise ValueError("keys that no hash tells apart")
        # The first level faces the whole corpus: its rate leaves about as many mistakes as there are listed keys.
        first = min(rate, n / (2 * counts.get(False, 0) + 1)) if not cascade.levels else rate
        cascade.add(todo, n, first)
        mistaken = saved(other.filter(cascade.passes(F.col("key"), len(cascade.levels) - 1)).select("key"), "url-mistaken")
        n, other, todo = mistaken.count(), todo, mistaken
    return cascade


def judge_urls(
    pages: DataFrame,
    listed: DataFrame,
    *,
    url: str = "url",
    rules=RULES,
    rate: float = 1 / 16,
    max_level_bytes: int = 16 << 20,
) -> DataFrame:
    """pages with host, path, rule and verdict (allow or block) added; an input column of such a name is replaced.

    listed(key): host followed by path, the keys to block; nulls and repeats in it count for nothing. A rule's verdict goes
    before the list's. A null url, or one without ://, has an empty host and path and is judged as the key ''. Repeated
    rows are judged alike; an empty list blocks nothing; empty pages give an empty result.
    """
    own = [c for c in pages.columns if c.lower() not in {"host", "path", "rule", "verdict"}]
    rows = pages.withColumns({(h := fresh("host", own)): url_host(F.col(url)), (p := fresh("path", own)): url_path(F.col(url))})
    rule, by_rule = rule_columns(F.col(h), F.col(p), rules)
    key = F.concat(F.col(h), F.col(p))

    marks = listed.select(F.col("key").cast("string").alias("key")).filter("key IS NOT NULL").select("key", F.lit(True).alias("listed"))
    universe = rows.select(key.alias("key"), F.lit(False).alias("listed")).unionByName(marks)
    keys = saved(universe.groupBy("key").agg(F.max("listed").alias("listed")), "url-keys")
    n = keys.filter("listed").count()
    bits, _ = _bits(max(n, 1), 1 / (2 * max(keys.count(), 1)))  # an upper bound for any level
    blocks = max(1, math.ceil(bits / 8 / max_level_bytes))

    def block(k: Column) -> Column:
        return F.pmod(F.xxhash64(k, F.lit(-1)), F.lit(blocks))

    mark = fresh("_block", [*own, h, p])
    if blocks > 1:
        rows = saved(rows.withColumn(mark, block(key)), "url-rows", by=mark)
        dealt, keys = keys, saved(keys.withColumn(mark, block(F.col("key"))), "url-keys", by=mark)
        discard(dealt)
    done = []
    for b in range(blocks):
        part, own_keys = (rows, keys) if blocks == 1 else (rows.filter(F.col(mark) == b), keys.filter(F.col(mark) == b).drop(mark))
        cascade = build_cascade(own_keys, rate)
        out = part.select(
            *[F.col(c) for c in own], F.col(h).alias("host"), F.col(p).alias("path"), rule.alias("rule"),
            F.coalesce(by_rule, F.when(cascade.listed(key), "block").otherwise("allow")).alias("verdict"),
        )
        done.append(out if blocks == 1 else saved(out, "url-block"))
    if blocks == 1:
        return done[0]
    discard(keys)
    discard(rows)
    return reduce(DataFrame.unionByName, done)


def referral_keys(pages: DataFrame, url: str = "url") -> DataFrame:
    """A block list drawn from the corpus: keys that some page's url reaches with a ref= parameter in its query."""
    marked = F.regexp_like(F.regexp_extract(F.col(url), r"\?([^#]*)", 1), F.lit(r"(^|&)ref="))
    return pages.filter(F.col(url).contains("://") & marked).select(F.concat(url_host(F.col(url)), url_path(F.col(url))).alias("key"))
