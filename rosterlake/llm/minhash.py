"""MinHash near-dedup on HyperMinHash registers: bands of registers find candidates, estimates and full sets confirm them.

One 64-bit hash per shingle: its first 8 bits choose one of 256 buckets, and the bucket keeps of its smallest hash the number
of leading zeros and the 10 bits that follow. Empty buckets borrow from others, each by a fixed random order of its own, so
small sets have independent registers too. 42 bands of 6 registers miss a pair at similarity 0.8 about three times in a
million. Candidates meet on band keys; the share of equal registers, corrected for collisions by chance, drops those far
below the threshold (with more room for small sets, whose estimates stray further, and never for tiny ones), and the full
shingle sets decide the rest: first by their hashes, then, for what passes, by the words themselves.

Work stays linear in the group: within a band, rows are compared with one pivot, and only what the links found so far leave
unconnected is compared further, until no two rows of a band that could be linked remain untested and apart. Rows with
equal sets are one class from the start; sets are equal when their sizes and 192 bits of digests from two independent hashes
of their words are.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .common import discard, fresh, join_hot, saved, text_batches
from .components import connected_components

BUCKETS, ROWS, BANDS = 256, 6, 42
_ZERO_BITS, _MANTISSA = 6, 10
_EMPTY = np.uint16(0xFFFF)
_U = np.uint64
_SMALL = 12  # a band group of so many rows is compared in full by a join when links leave it in parts
_BLOCK = 2048  # sketches of a larger group that one task compares with as many others
_TINY, _MORE = 16, 0.08  # sets of so few shingles are always compared; slack that sets of up to BUCKETS shingles have besides
_TEXTS = 512  # texts of a component that one task compares with as many others


def _orders() -> np.ndarray:
    """Column i: the order in which bucket i asks the others when it is empty."""
    rng = np.random.default_rng(29)
    return np.stack([rng.permutation(BUCKETS) for _ in range(BUCKETS)], axis=1)


_ORDERS = _orders()
_EDGES = (np.arange(BUCKETS, dtype=_U) << _U(56)).astype(_U)
_SEEDS = W.mix(np.arange(1, BANDS + 1, dtype=_U) * _U(0xA24BAED4963EE407))


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """HyperMinHash registers of sorted hash sets, one row each: leading zeros (6 bits), then mantissa (10 bits); smaller hashes first."""
    least = np.zeros((len(sets), BUCKETS), dtype=_U)
    full = np.zeros((len(sets), BUCKETS), dtype=bool)
    for i, own in enumerate(sets):
        if len(own):
            at = np.searchsorted(own, _EDGES)
            full[i] = np.diff(np.append(at, len(own))) > 0
            least[i, full[i]] = own[at[full[i]]]
    rest = (least << _U(8)) >> _U(8)  # 56 bits
    # Leading zeros among 56 bits from the float exponent, exact after one correction.
    width = np.where(rest > 0, np.floor(np.log2(np.maximum(rest, 1).astype(np.float64))).astype(np.int64) + 1, 0)
    width = np.where((width > 0) & ((rest >> np.maximum(width - 1, 0).astype(_U)) == 0), width - 1, width)
    zeros = 56 - width
    below = np.maximum(width - 1, 0).astype(_U)
    tail = rest & ((_U(1) << below) - _U(1))
    mantissa = np.where(below >= _MANTISSA, tail >> (np.maximum(below, _MANTISSA) - _U(_MANTISSA)), tail << (_U(_MANTISSA) - np.minimum(below, _MANTISSA)))
    out = ((np.minimum(zeros, 62).astype(_U) << _U(_MANTISSA)) | mantissa).astype(np.uint16)
    out[~full] = _EMPTY
    known = out.copy()
    some = full.any(axis=1)
    row, column = np.nonzero(~full & some[:, None])
    for step in range(BUCKETS):
        if not len(row):
            break
        got = known[row, _ORDERS[step, column]]
        fits = got != _EMPTY
        out[row[fits], column[fits]] = got[fits]
        row, column = row[~fits], column[~fits]
    return out


def band_keys(regs: np.ndarray) -> np.ndarray:
    """One 64-bit key per band."""
    parts = regs[:, : BANDS * ROWS].reshape(len(regs), BANDS, ROWS).astype(_U)
    out = np.broadcast_to(_SEEDS, (len(regs), BANDS)).copy()
    for j in range(ROWS):
        out = W.mix(out ^ (parts[:, :, j] + _U(j << 20)))
    return out


def chance(zeros: int = 1 << _ZERO_BITS) -> float:
    """Probability that registers of two different hashes agree: equal leading zeros and equal mantissa."""
    p = 0.5 ** np.arange(1, zeros)
    return float(np.sum(p * p) / (1 << _MANTISSA))


def estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Jaccard similarity from registers, without the agreements that chance alone makes."""
    agree = (a == b).mean(axis=1)
    c = chance()
    return np.clip((agree - c) / (1 - c), 0.0, 1.0)


def floors(n: np.ndarray, m: np.ndarray, percent: int, slack: float) -> np.ndarray:
    """Estimates below these drop pairs of sets of n and m shingles: none where both are tiny, and more slack where buckets often hide a shingle."""
    size = np.maximum(n, m)
    return np.where(size <= _TINY, -np.inf, percent / 100 - slack - np.where(size <= BUCKETS, _MORE, 0.0))


_SET = ["n", "s1", "s2", "s3"]  # what tells sets apart


def _sketch(docs: DataFrame, k: int) -> DataFrame:
    """(id, n, s1, s2, s3, regs) from docs(id, text): set size, digests of the set (s3 from a second hash of the words), registers."""
    shape = pa.schema([("id", pa.int64()), *((c, pa.int64()) for c in _SET), ("regs", pa.binary())])

    def work(batches):
        for batch in batches:
            texts = batch.column(1)
            for a, b in W.slices(texts):
                data, at = W.text_bytes(texts.slice(a, b - a))
                _, _, h, first = W.scan(data, at, W.BLANKS)
                sets = list(W.shingles(h, first, k))
                again = W.shingles(W.scan(data, at, W.BLANKS, 1)[2], first, k)
                digests = [[np.bitwise_xor.reduce(s), np.add.reduce(W.mix(s)), np.add.reduce(W.mix(t))] if len(s) else [0, 0, 0] for s, t in zip(sets, again)]
                cols = np.array(digests, dtype=_U).reshape(-1, 3).T.view(np.int64)
                regs = registers(sets)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array([len(s) for s in sets], pa.int64()), *(pa.array(c) for c in cols), pa.array([r.tobytes() for r in regs], pa.binary())], schema=shape)

    return docs.mapInArrow(work, "id long, n long, s1 long, s2 long, s3 long, regs binary")


def _band_rows(sketches: DataFrame) -> DataFrame:
    """(key, id), one row for each band of each sketch."""

    def work(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 2048):
                part = batch.slice(a, 2048)
                regs = np.frombuffer(b"".join(part.column(1).to_pylist()), dtype=np.uint16).reshape(part.num_rows, BUCKETS)
                keys = band_keys(regs).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.repeat(part.column(0).to_numpy(), BANDS))], names=["key", "id"])

    return sketches.select("id", "regs").mapInArrow(work, "key long, id long")


def _linked(x: str | None, y: str | None, k: int, percent: int) -> bool:
    """Whether the sets of two texts are similar, by the words themselves."""
    a, b = W.exact_shingles(x or "", k), W.exact_shingles(y or "", k)
    common = len(a & b)
    return bool(common) and 100 * common >= percent * (len(a) + len(b) - common)


def _verify(pairs: DataFrame, texts: DataFrame, k: int, percent: int, slack: float) -> DataFrame:
    """The pairs (a, b) whose full sets have 100 * intersection >= percent * union; texts(id, text, n, regs)."""
    left = texts.select(F.col("id").alias("a"), F.col("text").alias("ta"), F.col("regs").alias("ra"), F.col("n").alias("na"))
    right = texts.select(F.col("id").alias("b"), F.col("text").alias("tb"), F.col("regs").alias("rb"), F.col("n").alias("nb"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "ra", "rb", "ta", "tb", "na", "nb")

    def work(batches):
        for batch in batches:
            ra, rb = (np.frombuffer(b"".join(batch.column(i).to_pylist()), dtype=np.uint16).reshape(batch.num_rows, BUCKETS) for i in (2, 3))
            near = np.flatnonzero(estimate(ra, rb) >= floors(batch.column(6).to_numpy(), batch.column(7).to_numpy(), percent, slack))
            kept = []
            for start in range(0, len(near), 128):
                rows = near[start : start + 128]
                sides = []
                for c in (4, 5):
                    texts_ = batch.column(c).take(pa.array(rows))
                    sets = []
                    for a, b in W.slices(texts_):
                        data, at = W.text_bytes(texts_.slice(a, b - a))
                        _, _, h, first = W.scan(data, at, W.BLANKS)
                        sets += W.shingles(h, first, k)
                    sides.append(sets)
                for row, x, y in zip(rows, *sides):
                    common = len(np.intersect1d(x, y, assume_unique=True))
                    if common and 100 * common >= percent * (len(x) + len(y) - common) and _linked(batch.column(4)[row].as_py(), batch.column(5)[row].as_py(), k, percent):
                        kept.append(row)
            yield batch.select(["a", "b"]).take(pa.array(kept, pa.int64()))

    return both.mapInArrow(work, "a long, b long")


def _block_pairs(apart: DataFrame, sketches: DataFrame, percent: int, slack: float) -> DataFrame:
    """(a, b) of the pairs in apart(key, id, comp, size) whose components differ and whose registers leave them a chance.

    A group is compared block by block on its registers, and only what may be similar comes out: each pair once, from the
    first band that both share.
    """
    blocks = F.ceil(F.col("size") / _BLOCK).cast("int")
    own = F.pmod(F.xxhash64("id", F.lit(5)), blocks).cast("int")
    rows = apart.withColumn("blocks", blocks).withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("key", "id", "comp", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")).join(sketches, "id")

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        regs = np.frombuffer(b"".join(pdf["regs"]), dtype=np.uint16).reshape(len(pdf), BUCKETS)
        ids, comp, n, side = (pdf[c].to_numpy() for c in ("id", "comp", "n", "own"))
        i, j, key = int(pdf["i"].iloc[0]), int(pdf["j"].iloc[0]), np.int64(pdf["key"].iloc[0])
        names, counts = np.unique(comp, return_counts=True)
        main = comp == names[np.argmax(counts)]
        index = np.arange(len(ids))
        found = []
        # Rows of the main component meet only rows outside it, so the work is the rest times the group.
        for x in np.flatnonzero(~main):
            others = (comp != comp[x]) & ((side != side[x]) if i != j else True) & (main | (index > x))
            others &= percent * np.maximum(n, n[x]) <= 100 * np.minimum(n, n[x])
            y = np.flatnonzero(others)
            y = y[estimate(regs[y], regs[x][None]) >= floors(n[y], n[x], percent, slack)]
            if len(y):
                found.append(np.stack([np.full(len(y), x), y]))
        if not found:
            return pd.DataFrame({"a": np.empty(0, np.int64), "b": np.empty(0, np.int64)})
        x, y = np.concatenate(found, axis=1)
        keys = band_keys(regs).view(np.int64)
        first = np.concatenate([np.take_along_axis(keys[p], (keys[p] == keys[q]).argmax(axis=1)[:, None], 1)[:, 0] == key for p, q in ((x[c : c + 4096], y[c : c + 4096]) for c in range(0, len(x), 4096))])
        a, b = ids[x[first]], ids[y[first]]
        return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    return rows.groupBy("key", "i", "j").applyInPandas(compare, "a long, b long")


def _main_links(rest: DataFrame, comp: DataFrame, texts: DataFrame, k: int, percent: int, slack: float) -> DataFrame:
    """(a, b): a link, if there is one, between each row of rest(id, main) and the members of component main.

    A component meets the rows around it once, however many bands they share, in blocks of bounded size; what comes out is
    at most one verified link for each row and block.
    """
    outside = saved(rest.distinct(), "outside")
    inside = saved(comp.select("id", F.col("comp").alias("main")).distinct().join(outside.select("main").distinct(), "main", "left_semi").select("id", "main"), "inside")
    count = lambda df, name: df.groupBy("main").agg(F.ceil(F.count(F.lit(1)) / _TEXTS).cast("int").alias(name))
    sizes = count(inside, "bi").join(count(outside, "bo"), "main")
    place = lambda n: F.pmod(F.xxhash64("id", F.lit(6)), F.col(n)).cast("int")
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = inside.join(sizes, "main").select("id", "main", F.lit(True).alias("member"), place("bi").alias("i"), spread("bo").alias("j"))
    right = outside.join(sizes, "main").select("id", "main", F.lit(False).alias("member"), spread("bi").alias("i"), place("bo").alias("j"))
    rows = left.unionByName(right).join(texts, "id").select("id", "main", "member", "i", "j", "n", "regs", "text")

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        regs = np.frombuffer(b"".join(pdf["regs"]), dtype=np.uint16).reshape(len(pdf), BUCKETS)
        ids, n, member, texts_ = pdf["id"].to_numpy(), pdf["n"].to_numpy(), pdf["member"].to_numpy(bool), pdf["text"].tolist()
        known: dict[int, np.ndarray] = {}

        def own(i: int) -> np.ndarray:
            if i not in known:
                data = np.frombuffer((texts_[i] or "").encode(), np.uint8)
                _, _, h, first = W.scan(data, np.array([0, len(data)]), W.BLANKS)
                known[i] = next(W.shingles(h, first, k))
            return known[i]

        inner, out = np.flatnonzero(member), []
        for x in np.flatnonzero(~member):
            y = inner[percent * np.maximum(n[inner], n[x]) <= 100 * np.minimum(n[inner], n[x])]
            guess = estimate(regs[y], regs[x][None])
            y, guess = (v[guess >= floors(n[y], n[x], percent, slack)] for v in (y, guess))
            for z in y[np.argsort(-guess, kind="stable")]:  # the likeliest first, all in the end
                common = len(np.intersect1d(own(x), own(z), assume_unique=True))
                if 100 * common >= percent * (n[x] + n[z] - common) and _linked(texts_[x], texts_[z], k, percent):
                    out.append(sorted((ids[x], ids[z])))
                    break
        return pd.DataFrame(np.array(out, dtype=np.int64).reshape(-1, 2), columns=["a", "b"])

    return rows.groupBy("main", "i", "j").applyInPandas(compare, "a long, b long")


def _pairs(left, right) -> list:
    return [F.least(left, right).alias("a"), F.greatest(left, right).alias("b")]


def similar_groups(docs: DataFrame, *, key: str = "doc_id", text: str = "text", k: int = 5, percent: int = 80, slack: float = 0.12, rounds: int = 1) -> DataFrame:
    """(key, n_shingles, component_id, kept): groups of documents tied by links of at least percent similarity.

    A document's set is its distinct k-word shingles (blank-separated words, A-Z folded); with fewer words the whole
    sequence is its one shingle; without words, or with a null text, the set is empty and links with nothing.
    component_id is the smallest key of the group, kept says that the document is it. Rows that share a key are rows of one
    group, each with its own n_shingles, and all those with the smallest key are kept. Rows without a key link with nothing and have no
    component; they are kept. Equal sets link by definition. An empty table gives an empty result; other columns are ignored.
    """
    text_batches(docs.sparkSession)
    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    sketches = saved(_sketch(rows, k), "sketches")
    # Equal sets are one class, named by its smallest key; a class of very many rows is one row from here on.
    classes = saved(sketches.filter("n > 0 AND id IS NOT NULL").groupBy(*_SET).agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("_n")), "set-classes")
    total = sketches.count()
    named = join_hot(sketches.select("id", *_SET), classes, _SET, "_n", total, how="left")
    members = saved(named.select("id", "n", F.coalesce("rep", "id").alias("rep")), "set-members")
    repeated = members.filter("id IS NOT NULL").groupBy("id").agg(F.min("rep").alias("r0"), F.max("rep").alias("r1")).filter("r0 <> r1")
    # A key with different texts ties their classes together.
    tied = members.join(repeated, "id", "left_semi").select(F.col("id").alias("a"), F.col("rep").alias("b")).filter("a <> b").distinct()

    leaders = sketches.join(classes.select(*_SET, F.col("rep").alias("id")), [*_SET, "id"], "left_semi").dropDuplicates(_SET)
    bands = _band_rows(leaders)
    groups = bands.groupBy("key").agg(F.min("id").alias("pivot"), F.max("id").alias("other"), F.count(F.lit(1)).alias("size")).filter("pivot < other").drop("other")
    banded = saved(bands.join(groups, "key"), "bands")
    wanted = banded.select("id").distinct()
    own_text = rows.filter("id IS NOT NULL").join(wanted, "id", "left_semi")
    texts = saved(own_text.join(leaders.select("id", "n", "regs"), "id"), "candidate-texts")

    tested = saved(banded.filter("id <> pivot").select(F.col("pivot").alias("a"), F.col("id").alias("b")).distinct(), "tested")
    links = saved(_verify(tested, texts, k, percent, slack).distinct(), "links")
    every = [tied, links]
    labels, turn = saved(connected_components(reduce(DataFrame.unionByName, every)), "components"), 0
    while True:
        last = turn >= rounds
        comp = saved(banded.join(labels, "id", "left").select("key", "id", "size", F.coalesce("component", "id").alias("comp")), "band-components")
        apart = comp.groupBy("key").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1")).filter("c0 < c1").select("key")
        apart = comp.join(apart, "key", "left_semi")
        # Small groups in full; large ones against a pivot that each group draws, in the last round block by block.
        small, large = apart.filter(F.col("size") <= _SMALL), apart.filter(F.col("size") > _SMALL)
        pairs = small.alias("x").join(small.alias("y"), (F.col("x.key") == F.col("y.key")) & (F.col("x.comp") < F.col("y.comp"))).select(*_pairs(F.col("x.id"), F.col("y.id")))
        if last:
            mains = large.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("c")).groupBy("key").agg(F.max_by("comp", F.struct("c", "comp")).alias("main"))
            rest = saved(large.join(mains, "key").filter("comp <> main"), "band-rest")
            every.append(saved(_main_links(rest.select("id", "main"), comp, texts, k, percent, slack), "links"))
            sizes = rest.groupBy("key").agg(F.count(F.lit(1)).alias("size"))
            pairs = pairs.unionByName(_block_pairs(rest.drop("size", "main").join(sizes, "key"), texts.select("id", "n", "regs"), percent, slack))
        else:
            drawn = large.groupBy("key").agg(F.min_by(F.struct("id", "comp"), F.xxhash64("key", "id", F.lit(turn))).alias("p"))
            pairs = pairs.unionByName(large.join(drawn, "key").filter("comp <> p.comp").select(*_pairs(F.col("id"), F.col("p.id"))))
        new = saved(pairs.distinct().join(tested, ["a", "b"], "left_anti"), "tested")
        discard(comp)
        if last or not new.isEmpty():
            every.append(saved(_verify(new, texts, k, percent, slack).distinct(), "links"))
            tested = tested.unionByName(new)
            labels = saved(connected_components(reduce(DataFrame.unionByName, every)), "components")
            turn += 1
        else:
            turn = rounds
        if last:
            break
    sizes = classes.groupBy("rep").agg(F.sum("_n").alias("_n"))
    labelled = labels.select(F.col("id").alias("rep"), "component").join(sizes, "rep", "left").fillna(1, "_n")
    out = join_hot(members, labelled, ["rep"], "_n", total, how="left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", F.when(F.col("n") > 0, F.col("rep")).otherwise(F.col("id"))))
    return out.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"))


def drop_near_texts(docs: DataFrame, *, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """docs with one document of each group of near texts, whatever keys they share: the one with the smallest key, then digest of its text.

    Rows that agree in key and text are one. Rows without a key are kept. Columns as in docs.
    """
    row = fresh("_row", docs.columns)
    named = saved(docs.withColumn(row, F.monotonically_increasing_id()), "near-rows")
    known = named.filter(F.col(key).isNotNull())
    groups = similar_groups(known, key=row, text=text, **options).select(F.col(row).alias("r"), "n_shingles", "component_id")
    places = known.select(F.col(row).alias("r"), F.col(key).cast("long").alias("k"), F.sha2(F.coalesce(F.col(text).cast("string"), F.lit("")), 256).alias("d"))
    # Texts without shingles are near to nothing; only their repeats under one key are one.
    empty = F.col("n_shingles") == 0
    group = [F.when(~empty, F.col("component_id")).alias("g"), F.when(empty, F.col("k")).alias("e"), F.when(empty, F.col("d")).alias("f")]
    stay = groups.join(places, "r").groupBy(*group).agg(F.min(F.struct("k", "d", "r")).alias("first")).select(F.col("first.r").alias("r"))
    gone = places.join(stay, "r", "left_anti").select(F.col("r").alias(row))
    return named.join(gone, row, "left_anti").select(*docs.columns)
