"""Embedding near-dedup with randomised-rotation binary codes.

A vector's code is the signs of its coordinates under random rotations. Signs along independent random directions agree for
near vectors more often than for others, so bands of them serve as meeting points: bits and bands follow from the number of
vectors and from the miss rate allowed at the threshold, and the work grows with a power of about 1.2. The directions of
bands are not those of a rotation: signs under orthogonal directions agree all together less often than the plan takes them
to. For the pairs that meet, the stored correction
factor (the inner product of a vector with its own code) turns code and partner into an unbiased estimate of the inner
product with a known error; only pairs whose upper confidence bound reaches the threshold are recomputed in double
precision. A band that very many vectors share is compared in blocks that count links where they stand and hand on a
spanning forest instead of the pairs. A pair counts in the first band it meets in, so no list of pairs has to be merged.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .common import discard, fresh, join_hot, saved
from .components import connected_components

_U = np.uint64
HOT = 64  # vectors that share a band beyond this are compared in blocks
BLOCK = 1024
LIFTS = 4  # rotations in the code that estimates use
MISS = 1e-6  # probability that a pair right at the threshold meets in no band
STRIDE = 64  # bands whose signs are taken at once


@dataclass(frozen=True)
class Plan:
    """Bits a band, bands, and how many standard errors a confidence bound is wide."""

    bits: int
    bands: int
    threshold: float
    width: float = 5.0
    seed: int = 41

    def rotations(self, dim: int) -> int:
        return LIFTS


def plan_for(n: int, threshold: float, miss: float) -> Plan:
    """Bits so that unrelated vectors rarely share a band, and bands enough to miss a pair at the threshold with probability miss."""
    bits = min(40, max(10, math.ceil(math.log2(max(n, 2))) + 2))
    agree = (1 - math.acos(threshold) / math.pi) ** bits
    return Plan(bits, math.ceil(math.log(miss) / math.log1p(-agree)), threshold)


_spins: dict[tuple[int, int, int], np.ndarray] = {}


def rotations(dim: int, count: int, seed: int) -> np.ndarray:
    """count random rotations side by side, dim x (count * dim)."""
    if (dim, count, seed) not in _spins:
        rng = np.random.default_rng(seed)
        _spins[dim, count, seed] = np.concatenate([np.linalg.qr(rng.normal(size=(dim, dim)))[0] for _ in range(count)], axis=1)
    return _spins[dim, count, seed]


_ways: dict[tuple[int, int, int], np.ndarray] = {}


def directions(dim: int, count: int, seed: int) -> np.ndarray:
    """count independent random directions side by side, dim x count."""
    if (dim, count, seed) not in _ways:
        _ways[dim, count, seed] = np.random.default_rng([seed, dim]).normal(size=(dim, count))
    return _ways[dim, count, seed]


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1, first by their largest entry so that squares neither overflow nor vanish."""
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def band_keys(units: np.ndarray, plan: Plan) -> np.ndarray:
    """One 64-bit key per band: hashes of the band's sign bits, its number and the dimension."""
    dim, bits = units.shape[1], plan.bits
    ways, weights = directions(dim, plan.bands * bits, plan.seed), 2.0 ** np.arange(bits)  # 40 bits at most, exact in a double
    out = np.empty((len(units), plan.bands), dtype=_U)
    for start in range(0, plan.bands, STRIDE):
        stop = min(start + STRIDE, plan.bands)
        signs = (units @ ways[:, start * bits : stop * bits] >= 0).reshape(len(units), stop - start, bits)
        out[:, start:stop] = (signs @ weights).astype(_U) ^ W.mix(np.arange(start, stop, dtype=_U) * _U(4096) + _U(dim + 1))
        out[:, start:stop] = W.mix(out[:, start:stop])
    return out


def codes(units: np.ndarray, plan: Plan) -> tuple[np.ndarray, np.ndarray]:
    """(code as +1/-1 of LIFTS rotations, correction factor: inner product of the vector with its unit code)."""
    turned = units @ rotations(units.shape[1], plan.rotations(units.shape[1]), plan.seed)[:, : LIFTS * units.shape[1]]
    factor = np.abs(turned).sum(axis=1) / LIFTS / math.sqrt(units.shape[1])
    return np.where(turned >= 0, 1.0, -1.0).astype(np.float32), factor


def upper_bounds(code: np.ndarray, factor: np.ndarray, others: np.ndarray, plan: Plan) -> np.ndarray:
    """Upper confidence bound of each coded row's inner product with the other side's row (others already rotated)."""
    m = code.shape[1]
    guess = np.einsum("ij,ij->i", code, others) / (LIFTS * math.sqrt(m / LIFTS) * factor)
    return guess + plan.width * np.sqrt(np.maximum(0, 1 - factor**2)) / factor / math.sqrt(m - 1)


def _read(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(b, dtype=np.float64) for b in column.to_pylist()]


def _by_dim(rows: list[np.ndarray]):
    sizes = np.array([len(r) for r in rows])
    for dim in np.unique(sizes):
        at = np.flatnonzero(sizes == dim)
        yield at, np.stack([rows[i] for i in at])


def _classes(vectors: DataFrame, key: str, embedding: str) -> tuple[DataFrame, DataFrame]:
    """(rows: id, h1, h2, null for vectors that link with nothing; reps: rep, n, unit vector as bytes)."""
    slim = vectors.select(F.col(key).cast("long").alias("id"), F.col(embedding).cast("array<double>").alias("v"))

    def check(batches):
        for batch in batches:
            vectors = batch.column(1)
            length = vectors.value_lengths().fill_null(0).to_numpy()
            offsets = np.asarray(vectors.offsets)[:-1]
            known = np.asarray(vectors.values.is_valid())
            value = np.asarray(vectors.values.fill_null(0.0))
            kept, h1, h2 = ([None] * batch.num_rows for _ in range(3))
            for dim in np.unique(length[length > 0]):
                at = np.flatnonzero(length == dim)
                place = offsets[at, None] + np.arange(dim)
                v = value[place]
                good = known[place].all(axis=1) & np.isfinite(v).all(axis=1) & v.any(axis=1)
                at, v = at[good], v[good] + 0.0  # one zero only
                bits = W.mix(v.view(_U))
                a, b = (W.mix((bits * W.mix(np.arange(1, dim + 1, dtype=_U) * _U(salt))).sum(axis=1) + _U(dim)).view(np.int64).tolist() for salt in (0xD1342543DE82EF95, 0xE7037ED1A0B428DB))
                for i, u, x, y in zip(at.tolist(), unit(v) if len(v) else v, a, b):
                    kept[i], h1[i], h2[i] = u.tobytes(), x, y
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(kept, pa.binary())], names=["id", "h1", "h2", "u"])

    rows = saved(slim.mapInArrow(check, "id long, h1 long, h2 long, u binary"), "vectors")
    known = rows.filter("h1 IS NOT NULL AND id IS NOT NULL")
    reps = known.groupBy("h1", "h2").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n"), F.min("u").alias("u"))
    return rows, saved(reps, "vector-classes")


def _blocks(hot: DataFrame, reps: DataFrame, plan: Plan) -> DataFrame:
    """(a, b, n): b null and n the links of a counted in a block, or a link a-b of the block's forest.

    hot(key, band, id, size). Each block pair of a band is one bounded group.
    """
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("id", F.lit(3)), blocks).cast("int")
    rows = hot.withColumn("blocks", blocks).withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("key", "band", "id", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")).join(reps.select(F.col("rep").alias("id"), "n", "u"), "id")

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        i, j, band = int(pdf["i"].iloc[0]), int(pdf["j"].iloc[0]), int(pdf["band"].iloc[0])
        units = np.stack([np.frombuffer(b, dtype=np.float64) for b in pdf["u"]])
        ids, n, side = pdf["id"].to_numpy(), pdf["n"].to_numpy(), pdf["own"].to_numpy()
        left, right = np.flatnonzero(side == i), np.flatnonzero(side == j)
        if not len(left) or not len(right):
            return pd.DataFrame({"a": [], "b": [], "n": []}).astype({"a": "int64", "b": "Int64", "n": "int64"})
        code, factor = codes(units, plan)
        turned = (units @ rotations(units.shape[1], plan.rotations(units.shape[1]), plan.seed)[:, : code.shape[1]]).astype(np.float32)
        keys = band_keys(units, plan)
        m = code.shape[1]
        counts, label = np.zeros(len(ids), np.int64), np.arange(len(ids))
        links = []
        for a in range(0, len(left), 128):
            some = left[a : a + 128]
            guess = code[some] @ turned[right].T / (LIFTS * math.sqrt(m / LIFTS) * factor[some, None])
            bound = guess + (plan.width * np.sqrt(np.maximum(0, 1 - factor[some] ** 2)) / factor[some] / math.sqrt(m - 1))[:, None]
            p, q = np.nonzero(bound + 1e-4 >= plan.threshold)
            p, q = some[p], right[q]
            if i == j:
                p, q = p[p < q], q[p < q]
            for c in range(0, len(p), 8192):
                x, y = p[c : c + 8192], q[c : c + 8192]
                near = np.einsum("ij,ij->i", units[x], units[y]) >= plan.threshold
                x, y = x[near], y[near]
                first = (keys[x] == keys[y]).argmax(axis=1) == band
                links.append((x[first], y[first]))
        x, y = (np.concatenate([l[s] for l in links]) if links else np.empty(0, int) for s in (0, 1))
        np.add.at(counts, x, n[y])
        np.add.at(counts, y, n[x])
        while len(x):
            low = np.minimum(label[x], label[y])
            before = label.copy()
            np.minimum.at(label, x, low)
            np.minimum.at(label, y, low)
            label = label[label]
            if (label == before).all():
                break
        some, tied = np.flatnonzero(counts), np.flatnonzero(label != np.arange(len(ids)))
        return pd.DataFrame({
            "a": np.concatenate([ids[some], ids[tied]]),
            "b": pd.array([None] * len(some) + ids[label[tied]].tolist(), dtype="Int64"),
            "n": np.concatenate([counts[some], np.zeros(len(tied), np.int64)]),
        })

    return rows.groupBy("key", "i", "j").applyInPandas(compare, "a long, b long, n long")


def _cold_links(cold: DataFrame, reps: DataFrame, plan: Plan) -> DataFrame:
    """(a, b) of linked representatives that meet first in a band that few share. cold(key, band, id)."""
    met = cold.alias("x").join(cold.alias("y"), (F.col("x.key") == F.col("y.key")) & (F.col("x.id") < F.col("y.id")))
    pairs = met.groupBy(F.col("x.id").alias("a"), F.col("y.id").alias("b")).agg(F.min("x.band").alias("band"))

    def squeeze(batches):
        for batch in batches:
            rows = _read(batch.column(1))
            out = [None] * len(rows), [None] * len(rows), np.zeros(len(rows))
            for at, v in _by_dim(rows):
                code, factor = codes(unit(v), plan)
                packed = np.packbits(code > 0, axis=1)
                small = v.astype(np.float32)
                for k, i in enumerate(at):
                    out[0][i], out[1][i], out[2][i] = packed[k].tobytes(), small[k].astype(np.float16).tobytes(), factor[k]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out[0], pa.binary()), pa.array(out[1], pa.binary()), pa.array(out[2])], names=["id", "code", "half", "factor"])

    # Codes are what most pairs need; they are far smaller than the vectors.
    small = saved(reps.select(F.col("rep").alias("id"), "u").mapInArrow(squeeze, "id long, code binary, half binary, factor double"), "vector-codes")
    sides = pairs.join(small.select(F.col("id").alias("a"), "code", "factor"), "a").join(small.select(F.col("id").alias("b"), "half"), "b").select("a", "b", "band", "code", "factor", "half")

    def guess(batches):
        for batch in batches:
            half = [np.frombuffer(b, dtype=np.float16).astype(np.float32) for b in batch.column(5).to_pylist()]
            packed = batch.column(3).to_pylist()
            factor, keep = batch.column(4).to_numpy(), np.zeros(batch.num_rows, bool)
            for at, y in _by_dim(half) if half else ():
                same = np.array([len(packed[i]) * 8 - 7 <= y.shape[1] * LIFTS <= len(packed[i]) * 8 for i in at])
                at, y = at[same], y[same]
                if len(at):
                    code = np.unpackbits(np.frombuffer(b"".join(packed[i] for i in at), np.uint8).reshape(len(at), -1), axis=1)[:, : y.shape[1] * LIFTS] * np.float32(2) - 1
                    turned = y @ rotations(y.shape[1], plan.rotations(y.shape[1]), plan.seed)[:, : code.shape[1]].astype(np.float32)
                    keep[at] = upper_bounds(code, factor[at], turned, plan) + 0.01 >= plan.threshold  # 0.01 for the half floats
            yield batch.select(["a", "b", "band"]).take(pa.array(np.flatnonzero(keep)))

    near = saved(sides.mapInArrow(guess, "a long, b long, band int"), "vector-pairs")
    full = reps.select(F.col("rep").alias("id"), "u")
    exact = near.join(full.select(F.col("id").alias("a"), F.col("u").alias("ua")), "a").join(full.select(F.col("id").alias("b"), F.col("u").alias("ub")), "b").select("a", "b", "band", "ua", "ub")

    def confirm(batches):
        for batch in batches:
            x, y, band = _read(batch.column(3)), _read(batch.column(4)), batch.column(2).to_numpy()
            keep = np.zeros(batch.num_rows, bool)
            for at, p in _by_dim(x) if x else ():
                same = np.array([len(y[i]) == p.shape[1] for i in at])
                at, p = at[same], p[same]
                for c in range(0, len(at), 512):
                    some, a = at[c : c + 512], p[c : c + 512]
                    b = np.stack([y[i] for i in some])
                    first = (band_keys(a, plan) == band_keys(b, plan)).argmax(axis=1)
                    keep[some] = (np.einsum("ij,ij->i", a, b) >= plan.threshold) & (first == band[some])
            yield batch.select(["a", "b"]).take(pa.array(np.flatnonzero(keep)))

    return exact.mapInArrow(confirm, "a long, b long")


def similar_vectors(vectors: DataFrame, *, key: str = "vec_id", embedding: str = "embedding", threshold: float = 0.9, miss: float = MISS) -> DataFrame:
    """(key, n_links, component_id, kept) for every row of vectors.

    n_links counts the other rows linked directly: cosine, in double precision, at least the threshold. A pair right at the
    threshold is missed with probability miss, nearer ones far less often; no pair below it is linked. Vectors that are null,
    empty, zero or hold null or non-finite entries link with nothing, nor do vectors of different length with each other;
    they keep their own key as component. Equal vectors are one class whose copies all link. Rows that share a key are separate rows in
    counts and one in components. Rows without a key link with nothing, have no component and are kept. An empty table gives
    an empty result; other columns are ignored.
    """
    rows, reps = _classes(vectors, key, embedding)
    n_rows, plan = rows.count(), plan_for(reps.count(), threshold, miss)

    def spread(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 1024):
                part = batch.slice(a, 1024)
                ids = part.column(0).to_numpy()
                for at, v in _by_dim(_read(part.column(1))):
                    keys = band_keys(v, plan).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.tile(np.arange(plan.bands, dtype=np.int32), len(at))), pa.array(np.repeat(ids[at], plan.bands))], names=["key", "band", "id"])

    bands = reps.select("rep", "u").mapInArrow(spread, "key long, band int, id long")
    sizes = bands.groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    shared = saved(bands.join(sizes, "key"), "vector-bands")
    cold = saved(_cold_links(shared.filter(F.col("size") <= HOT).select("key", "band", "id"), reps, plan), "vector-links")
    hot = saved(_blocks(shared.filter(F.col("size") > HOT), reps, plan), "vector-blocks")
    discard(shared)

    weight = reps.select(F.col("rep").alias("other"), F.col("n").alias("w"))
    both = cold.select(F.col("a").alias("rep"), F.col("b").alias("other")).unionByName(cold.select(F.col("b").alias("rep"), F.col("a").alias("other")))
    counts = both.join(weight, "other").select("rep", F.col("w").alias("n")).unionByName(hot.filter("b IS NULL").select(F.col("a").alias("rep"), "n"))
    counts = counts.groupBy("rep").agg(F.sum("n").alias("links"))
    classes = reps.select("h1", "h2", "rep", "n", F.col("n").alias("_n"))
    members = join_hot(rows.filter("id IS NOT NULL"), classes, ["h1", "h2"], "_n", n_rows, how="left").select("id", "rep", "n")
    tied = members.filter("rep IS NOT NULL AND rep <> id").select(F.col("rep").alias("a"), F.col("id").alias("b")).distinct()
    labels = connected_components(cold.unionByName(hot.filter("b IS NOT NULL").select("a", "b")).unionByName(tied))
    out = members.join(labels, "id", "left")
    sizes = reps.groupBy("rep").agg(F.sum("n").alias("_n"))
    out = join_hot(out, counts.join(sizes, "rep"), ["rep"], "_n", n_rows, how="left")
    links = F.coalesce("links", F.lit(0)) + F.coalesce(F.col("n") - 1, F.lit(0))
    component = F.coalesce("component", "id")
    found = out.select(F.col("id").alias(key), links.cast("long").alias("n_links"), component.alias("component_id"), (component == F.col("id")).alias("kept"))
    return found.unionByName(rows.filter("id IS NULL").select(F.col("id").alias(key), F.lit(0).cast("long").alias("n_links"), F.lit(None).cast("long").alias("component_id"), F.lit(True).alias("kept")))


def drop_near_vectors(vectors: DataFrame, *, key: str = "vec_id", **options) -> DataFrame:
    """vectors with one row of each component: that of the smallest key. Columns as in vectors."""
    gone = similar_vectors(vectors, key=key, **options).filter("NOT kept").select(F.col(key).alias(fresh("_gone", vectors.columns))).distinct()
    return vectors.join(gone, F.col(key).cast("long") == gone[gone.columns[0]], "left_anti")
