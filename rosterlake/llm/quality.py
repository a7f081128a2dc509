"""Quality classifier: ridge regression on random Fourier features of document statistics, with isotonic calibration.

Beside the cosines the fit has the standardised statistics themselves and a constant as features: a linear trend that the
kernel part then need not spend its cosines on.

Every whole text becomes a short vector of statistics (shares of byte classes, word and line shapes). Random cosines of the
standardised vector approximate a Gaussian kernel, so a linear fit on them is a kernel fit whose work is one pass: each
partition adds up its own normal equations, the small sums are added over partitions, and the driver solves one system of
fixed size. A second pass bins the scores of rows that took no part in that fit; a monotone fit to the bins turns scores
into probabilities. Texts never leave their tasks; the driver sees sums whose size depends on features and bins alone.
"""

from __future__ import annotations

import math
import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words as W
from .common import fresh, saved, text_batches

STATISTICS = (
    "log_bytes", "log_words", "letters", "capitals", "digits", "blanks", "other_bytes", "sentence_marks", "quotes",
    "symbols", "bars", "exclamations", "line_ends", "word_length", "word_spread", "long_words", "symbol_words", "capital_words", "repeated_words", "alternating_words",
)
_GRID = 4096.0  # features are rounded to multiples of 1/4096, so that their sums are exact in any order of adding up (to 5e8 rows)
TASK_ROWS = 20_000  # labelled rows that one task sums at least, where there are so many
FAN_IN = 1024  # tasks whose sums one group adds up
MOST_LABELS = 200_000  # labels that keep_good learns from, about


def _classes() -> np.ndarray:
    out = np.zeros((8, 256), dtype=np.int32)
    out[0, [*range(65, 91), *range(97, 123)]] = 1
    out[1, range(65, 91)] = 1
    out[2, range(48, 58)] = 1
    out[3, [32, *range(9, 14)]] = 1
    out[4, range(128, 256)] = 1
    out[5, [ord(c) for c in ".,;:?-()"]] = 1
    out[6, [ord(c) for c in "'\""]] = 1
    out[7, [ord(c) for c in "#$%&*@^~=+<>[]{}\\/_`"]] = 1
    return out


_CLASSES = _classes()
_SMALL = _CLASSES.astype(np.uint8)  # slower to look up, but a byte for each byte of a long text


def statistics(column: pa.Array) -> np.ndarray:
    """One row of STATISTICS for each text; a null or an empty text gives zeros."""
    out = np.zeros((len(column), len(STATISTICS)))
    for a, b in W.slices(column):
        data, at = W.text_bytes(column.slice(a, b - a))
        size = np.diff(at)
        start, end, word, first = W.scan(data, at, W.BLANKS)
        n_words = np.diff(first)

        def per_row(flags: np.ndarray, edges: np.ndarray = at) -> np.ndarray:
            if len(edges) == 2:  # one long text: no running sums
                return np.array([float(np.count_nonzero(flags[edges[0] : edges[1]]))])
            sums = np.zeros(len(flags) + 1, np.int32)  # a slice of several texts is small
            np.cumsum(flags, dtype=np.int32, out=sums[1:])
            return np.diff(sums[edges]).astype(float)

        def per_word(flags: np.ndarray, least: int) -> np.ndarray:
            """Words with at least so many of the bytes flagged; bytes between words never are."""
            if not len(start):
                return np.zeros(0, bool)
            if len(at) == 2:
                return np.add.reduceat(flags, start, dtype=np.int32) >= least
            sums = np.zeros(len(flags) + 1, np.int32)
            np.cumsum(flags, dtype=np.int32, out=sums[1:])
            return sums[end] - sums[start] >= least

        # Shares lean towards 0, and means towards a usual value, where a text is too short to tell.
        some, some_words = size + 20, n_words + 4
        classes = _SMALL if len(at) == 2 else _CLASSES
        counts = [per_row(classes[i][data]) for i in range(8)]
        bar, mark, line = (per_row(data == c) for c in b"|!\n")
        length = (end - start).astype(float)
        mean = (per_row_float(length, first) + 4 * 5) / some_words
        spread = np.sqrt(np.maximum(0, per_row_float(length**2, first) / some_words - mean**2))
        odd_words, cap_words = per_row(per_word(classes[7][data] | (data == 33), 1), first), per_row(per_word(classes[1][data], 2), first)
        again = []
        for back in (1, 2):
            same = np.zeros(len(word), bool)
            same[back:] = word[back:] == word[:-back]
            edge = (first[:-1, None] + np.arange(back)).ravel()
            same[edge[edge < len(word)]] = False  # the first words of a row have none before them
            again.append(per_row(same, first) if len(word) else np.zeros(len(size)))
        out[a:b] = np.stack([
            np.log1p(size) / 4, np.log1p(n_words) / 4, *(c / some for c in counts[:5]), counts[5] / some_words, counts[6] / some_words,
            counts[7] / some_words, bar / some_words, mark / some_words, line / some_words, mean / 10, spread / 10,
            per_row(length > 20, first) / some_words, odd_words / some_words, cap_words / some_words, *(x / some_words for x in again),
        ], axis=1)
    return out


def per_row_float(values: np.ndarray, edges: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0.0], np.cumsum(values)])[edges])


@dataclass(frozen=True)
class Model:
    mean: np.ndarray
    scale: np.ndarray
    directions: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    knots: np.ndarray  # raw scores, rising
    values: np.ndarray  # probabilities at the knots, not falling

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return features((stats - self.mean) / self.scale, self.directions, self.phases) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(stats), self.knots, self.values), 0.0, 1.0)


def features(x: np.ndarray, directions: np.ndarray, phases: np.ndarray) -> np.ndarray:
    """Random cosines (their products approximate a Gaussian kernel), a constant, and x itself, all on a fixed grid."""
    waves = np.cos(np.clip(x, -4, 4) @ directions + phases)
    return np.round(np.concatenate([waves, np.ones((len(x), 1)), np.clip(x, -4, 4) / 4], axis=1) * _GRID) / _GRID


def isotonic(x: np.ndarray, positives: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators over bins in rising x: (knots, values), each pool at its mean x."""
    pools: list[list[float]] = []
    for at, good, n in zip(x, positives, counts):
        pools.append([at * n, good, n])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            last = pools.pop()
            pools[-1] = [p + q for p, q in zip(pools[-1], last)]
    return np.array([p[0] / p[2] for p in pools]), np.array([p[1] / p[2] for p in pools])


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()) if len(column) else np.zeros((0, len(STATISTICS)))


def fit(train: DataFrame, *, waves: int = 192, gamma: float = 0.08, ridge: float = 1e-3, bins: int = 512, seed: int = 17) -> Model | None:
    """Fit on train(stats array<double>, label int, part int): rows with part 0 fit the weights, part 1 the calibration.

    None where one of the two parts has no labelled row.
    """
    k = len(STATISTICS)
    moments = train.filter("part = 0").select(F.posexplode("stats").alias("i", "x")).groupBy("i").agg(F.count("x").alias("n"), F.avg("x").alias("m"), F.stddev_pop("x").alias("s"))
    rows = {r["i"]: r for r in moments.collect()}  # one row for each statistic
    if not rows:
        return None
    # Rounded, so that the order in which partitions add up cannot reach the features.
    mean = np.round([rows[i]["m"] for i in range(k)], 9)
    scale = np.round([max(rows[i]["s"] or 0.0, 1e-3) for i in range(k)], 9)
    rng = np.random.default_rng(seed)
    directions, phases = rng.normal(size=(k, waves)) * math.sqrt(2 * gamma), rng.uniform(0, 2 * np.pi, waves)
    width = waves + 1 + k

    def equations(frames):
        total = np.zeros((width, width + 1))
        for pdf in frames:
            phi = features((_matrix(pdf["stats"]) - mean) / scale, directions, phases)
            total += phi.T @ np.concatenate([phi, pdf["label"].to_numpy(float)[:, None]], axis=1)
        if total.any():
            yield pd.DataFrame({"i": np.arange(width), "v": list(total), "part": zlib.crc32(total.tobytes())})

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"i": pdf["i"].iloc[:1], "v": [np.sum(np.stack(pdf["v"].to_numpy()), axis=0)]})

    # A task sums TASK_ROWS rows or more, far more than its sums take; sums of very many tasks are added up in two rounds.
    fitted = train.filter("part = 0").select("stats", "label")
    tasks = max(1, rows[0]["n"] // TASK_ROWS)
    sums = fitted.coalesce(tasks).mapInPandas(equations, "i int, v array<double>, part long")
    if tasks > FAN_IN:
        sums = sums.groupBy("i", F.pmod("part", F.lit(math.isqrt(tasks)))).applyInPandas(lambda key, pdf: add(pdf), "i int, v array<double>")
    sums = sums.select("i", "v").groupBy("i").applyInPandas(add, "i int, v array<double>")
    whole = np.stack([np.asarray(r["v"]) for r in sums.orderBy("i").collect()])  # width rows
    n = whole[waves, waves]
    weights = np.linalg.solve(whole[:, :width] + ridge * n * np.eye(width), whole[:, width])
    draft = Model(mean, scale, directions, phases, weights, np.array([0.0, 1.0]), np.array([0.0, 1.0]))

    def binned(frames):
        for pdf in frames:
            raw = np.clip(draft.raw(_matrix(pdf["stats"])), -0.5, 1.5)
            yield pd.DataFrame({"bin": np.minimum(bins - 1, ((raw + 0.5) / 2 * bins).astype(int)), "label": pdf["label"]})

    tally = train.filter("part = 1").select("stats", "label").mapInPandas(binned, "bin int, label int").groupBy("bin").agg(F.sum("label").alias("good"), F.count("label").alias("n")).orderBy("bin").collect()
    if not tally:
        return None
    at = (np.array([r["bin"] for r in tally]) + 0.5) / bins * 2 - 0.5
    knots, values = isotonic(at, np.array([float(r["good"]) for r in tally]), np.array([float(r["n"]) for r in tally]))
    return Model(mean, scale, directions, phases, weights, knots, values)


def text_statistics(docs: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """The columns kept and stats, one pass over the texts."""
    text_batches(docs.sparkSession)
    slim = docs.select(*[F.col(c) for c in keep], F.col(text).cast("string").alias("_text"))
    schema = slim.drop("_text").schema.add("stats", T.ArrayType(T.DoubleType()))
    at = len(keep)

    def measure(batches):
        for batch in batches:
            stats = statistics(batch.column(at))
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(stats) + 1) * stats.shape[1], pa.int32()), pa.array(stats.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], flat], names=[*batch.schema.names[:at], "stats"])

    return slim.mapInArrow(measure, schema)


def _remainder(key):
    return F.coalesce(F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(4)), F.lit(0))


def fit_labelled(stats: DataFrame, labels: DataFrame, key: str, label: str, **options) -> tuple[Model | None, float]:
    """(model, mean label) from stats(key, stats, ...) and labels; rows with remainder 2 are held out of both."""
    marks = labels.select(F.col(key).alias("_key"), F.col(label).cast("int").alias("label")).filter("label IN (0, 1) AND _key IS NOT NULL")
    part = F.when(_remainder(F.col(key)) == 3, 1).otherwise(0).alias("part")
    rows = stats.filter(_remainder(F.col(key)) != 2).select(F.col(key).alias("_key"), "stats", part)
    train = saved(rows.join(marks, "_key").select("stats", "label", "part"), "quality-training")
    model = fit(train, **options)
    return model, 0.5 if model else train.agg(F.coalesce(F.avg("label"), F.lit(0.5)).alias("m")).first()["m"]


def score_quality(
    docs: DataFrame,
    labels: DataFrame,
    *,
    key: str = "doc_id",
    text: str = "text",
    label: str = "quality",
    threshold: float = 0.7,
    keep: list[str] | None = None,
    **options,
) -> DataFrame:
    """The kept columns (key unless given) with held_out, score and predicted.

    Learns from the labelled rows whose crc32(key as text) modulo 4 is not 2; of these, remainder 3 calibrates. All of them
    count: the sums have a fixed size, so no sample is drawn. Labels that are null or neither 0 nor 1 are no labels; a key
    labelled twice counts for each label given. Null and empty texts are scored by their all-zero statistics. With no
    labelled row in one of the two parts every score is the mean label (0.5 with none at all). Repeated rows are scored
    alike; an empty table gives an empty result. Columns keep may name anything; clashing names are kept apart.
    """
    keep = keep or [key]
    if key not in keep:
        raise ValueError("keep must hold the key")
    stats = saved(text_statistics(docs, text, keep), "quality-statistics")
    model, mean = fit_labelled(stats, labels, key, label, **options)
    remainder = _remainder(F.col(key))
    names = [fresh(c, keep) for c in ("held_out", "score", "predicted")]
    schema = stats.drop("stats").schema.add(names[1], "double")
    at = len(keep)

    def score(batches):
        for batch in batches:
            flat = np.asarray(batch.column(at).flatten()).reshape(batch.num_rows, len(STATISTICS))
            got = model.score(flat) if model is not None else np.full(batch.num_rows, mean)
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], pa.array(np.round(got, 9))], names=[*batch.schema.names[:at], names[1]])

    out = stats.mapInArrow(score, schema)
    return out.select(*[F.col(c) for c in keep], (remainder == 2).alias(names[0]), F.col(names[1]), (F.col(names[1]) >= threshold).cast("int").alias(names[2]))


def keep_good(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "quality", threshold: float = 0.7, **options) -> DataFrame:
    """docs without the rows whose score is below threshold.

    The model learns from labelled documents alone; with more than MOST_LABELS labels from about so many of them, the same at
    every run, chosen by a hash of their keys. Only these are measured before all documents are judged; no text is shuffled.
    """
    marks = labels.filter(F.col(key).isNotNull() & F.col(label).cast("int").isin(0, 1))
    n = marks.count()
    some = marks if n <= MOST_LABELS else marks.filter(F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit(9)), F.lit(n)) < MOST_LABELS)
    chosen = some.select(F.col(key).alias("_marked")).distinct()  # bounded as said, so it can be sent to all
    learned = docs.join(F.broadcast(chosen), F.col(key) == F.col("_marked"), "left_semi")
    model, mean = fit_labelled(saved(text_statistics(learned, text, [key]), "quality-statistics"), some, key, label, **options)
    at = docs.columns.index(text)

    def judge(batches):
        for batch in batches:
            for a, b in W.slices(batch.column(at).cast(pa.string())):
                part = batch.slice(a, b - a)
                stats = statistics(part.column(at).cast(pa.string()))
                good = np.round(model.score(stats), 9) >= threshold if model is not None else np.full(len(stats), mean >= threshold)
                yield part.filter(pa.array(good))

    return docs.mapInArrow(judge, docs.schema)
