"""A quality classifier: random Fourier features, ridge regression, isotonic calibration.

Every document's statistics (shares of kinds of characters, word and line
shapes and repetition) are standardised and mapped to random Fourier features,
which approximate a Gaussian kernel.  Ridge weights solve the normal equations,
whose sums are formed per partition and added up row by row of the matrix.
Isotonic regression on other labelled rows turns raw scores into probabilities.

Defined cases: a null or empty text has statistics of zero and is scored like
any other; long texts are read in pieces; repeated rows each give a row, and
each is learned from if its id is labelled; a document labelled twice counts as
good if at least half its labels say so; null labels and ids are not learned
from; without labels every score is 0.5; other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textops
from .shared import small_batches, written

_KINDS = 13


def _kinds() -> np.ndarray:
    kind = np.full(256, 9)  # other ASCII signs
    for i, chars in enumerate([range(97, 123), range(65, 91), range(48, 58), b" \t", b"\n\r", b".", b",", b"!?", b"|"]):
        kind[list(chars)] = i
    kind[list(b"#$%&*@^~<>{}[]\\/_=+")] = 10
    kind[128:192] = 11
    kind[192:] = 12
    return kind


_LINE = np.ones(256, bool)
_LINE[[10, 13]] = False
_KIND = _kinds()
#: Lines; of a long text, one of many MB counts as several.
LINES = textops.Splitter(_LINE, fold_case=False, most=8 << 20)
N_STATISTICS = _KINDS + 9


def statistics(texts: pa.Array) -> np.ndarray:
    """One row of N_STATISTICS numbers for each whole text."""
    n = len(texts)
    counts, sums = np.zeros((n, _KINDS)), np.zeros((n, 4))
    distinct, lines = np.zeros(n), np.zeros((n, 2))
    seen = Seen()
    for s in textops.slices(texts, textops.SPACED):
        m, length = len(s.rows), (s.end - s.start).astype(float)
        owner = np.repeat(np.arange(m), np.diff(s.bounds))
        counts[s.rows] += np.bincount(owner * _KINDS + _KIND[s.data], minlength=m * _KINDS).reshape(m, _KINDS)
        ending = _KIND[s.data[np.maximum(s.end - 1, 0)]]
        sums[s.rows] += np.column_stack([np.diff(s.first), *(np.bincount(s.doc, w, m) for w in (length, length**2, (ending >= 7) & (ending <= 10)))])
        distinct[s.rows] += seen.distinct(s)
    for s in textops.slices(texts, LINES):
        lines[s.rows] += np.column_stack([np.diff(s.first), seen.distinct(s)])
    chars = np.maximum(counts.sum(axis=1) - counts[:, 11], 1)  # a character of several bytes counts once
    words, many, n_lines = sums[:, 0], np.maximum(sums[:, 0], 1), lines[:, 0]
    mean = sums[:, 1] / many
    spread = np.sqrt(np.maximum(sums[:, 2] / many - mean**2, 0))
    own = np.maximum(n_lines, 1)
    return np.column_stack([counts / chars[:, None], np.log1p(chars), np.log1p(words), mean, spread, distinct / many, sums[:, 3] / many, np.log1p(n_lines), lines[:, 1] / own, words / own / 100])


class Seen:
    """Counts distinct words (or lines) by document; of a long one, over its pieces."""

    def __init__(self):
        self.held: list[np.ndarray] = []

    def distinct(self, s: textops.Slice) -> np.ndarray:
        if s.part:
            self.held.append(np.unique(s.hash))
            if len(self.held) == 16 or not s.more:
                self.held = [np.unique(np.concatenate(self.held))]
            return np.array([0.0 if s.more else len(self.held.pop())])
        order = np.lexsort((s.hash, s.doc))
        doc, h = s.doc[order], s.hash[order]
        new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])]) if len(doc) else np.zeros(0, bool)
        return np.bincount(doc[new], minlength=len(s.rows))


def described(documents: DataFrame) -> DataFrame:
    """(doc_id, stats) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = statistics(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * N_STATISTICS), pa.array(x.ravel()))], ["doc_id", "stats"])

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id long, stats array<double>")


@dataclass
class Model:
    centre: np.ndarray
    scale: np.ndarray
    directions: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    knots: np.ndarray  # raw scores, ascending
    levels: np.ndarray  # probabilities at the knots, ascending

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.centre) / self.scale, -6, 6)
        return np.hstack([np.sqrt(2 / len(self.phases)) * np.cos(z @ self.directions + self.phases), np.ones((len(x), 1))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights

    def probability(self, x: np.ndarray) -> np.ndarray:
        return np.interp(self.raw(x), self.knots, self.levels)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, N_STATISTICS)


def normal_equations(rows: DataFrame, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Sums of z z' and z y over all rows (stats, good): per partition, then by row of the matrix."""
    size = len(model.phases) + 1
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, any_rows = np.zeros((size, size + 1)), False
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                piece = batch.slice(at, 4096)
                z = shared.value.features(_matrix(piece.column(0)))
                a[:, :size] += z.T @ z
                a[:, size] += z.T @ piece.column(1).to_numpy(zero_copy_only=False)
                any_rows = True
        if any_rows:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(size)), pa.array([r.tobytes() for r in a], pa.binary())], ["i", "sums"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                total[i] = total.get(i, 0) + np.frombuffer(raw)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array([x.tobytes() for x in total.values()], pa.binary())], ["i", "sums"])

    parts = rows.select("stats", "good").mapInArrow(sums, "i long, sums binary")
    a = np.zeros((size, size + 1))
    for r in parts.repartition("i").mapInArrow(add, "i long, sums binary").collect():  # one row for each row of the matrix
        a[r.i] += np.frombuffer(r.sums)
    return a[:, :size], a[:, size]


def isotonic(scores: np.ndarray, good: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators over bins (ascending score, sum of labels, rows); knots at the pools' mean scores."""
    pools: list[list[float]] = []
    for s, y, w in zip(scores.tolist(), good.tolist(), n.tolist(), strict=True):
        pools.append([s * w, y, w])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last, strict=True)]
    x = np.array([a / w for a, _, w in pools])
    # One good and one bad row more in each pool keep probabilities off 0 and 1.
    y = np.array([(b + 1) / (w + 2) for _, b, w in pools])
    return x, np.maximum.accumulate(y)


def fit(stats: DataFrame, labels: DataFrame, held_out: Column, features: int = 256, ridge: float = 1e-3, bins: int = 2000, seed: int = 7) -> Model:
    """Learns from all labelled rows that are not held out: half fit the ridge weights, half the calibration."""
    known = labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("double").alias("good"))
    rows = written(stats.filter(~held_out).join(known, "doc_id").select("doc_id", "stats", "good"), "quality-rows")
    fitting = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0
    r = rows.agg(F.count("*").alias("n"), *[f(F.col("stats")[i]).alias(f"{k}{i}") for i in range(N_STATISTICS) for k, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    rng = np.random.Generator(np.random.PCG64(seed))
    directions = rng.normal(size=(N_STATISTICS, features)) / np.sqrt(N_STATISTICS)
    model = Model(np.zeros(N_STATISTICS), np.ones(N_STATISTICS), directions, rng.uniform(0, 2 * np.pi, features), np.zeros(features + 1), np.array([0.0, 1.0]), np.array([0.5, 0.5]))
    if not r.n:
        return model
    model.centre = np.array([r[f"m{i}"] for i in range(N_STATISTICS)])
    model.scale = np.maximum([r[f"s{i}"] for i in range(N_STATISTICS)], 1e-6)
    a, b = normal_equations(rows.filter(fitting), model)
    n = max(a[-1, -1], 1.0)
    model.weights = np.linalg.solve(a / n + ridge * np.eye(len(a)), b / n)
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.floor(np.clip(shared.value.raw(_matrix(batch.column(0))), -1, 2) * bins)
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int64)), batch.column(1)], ["bin", "good"])

    sums = rows.filter(~fitting).select("stats", "good").mapInArrow(binned, "bin long, good double").groupBy("bin").agg(F.sum("good").alias("good"), F.count("*").alias("n")).orderBy("bin").collect()
    if sums:
        model.knots, model.levels = isotonic(np.array([(s.bin + 0.5) / bins for s in sums]), np.array([s.good for s in sums]), np.array([s.n for s in sums], float))
    return model


def score(stats: DataFrame, model: Model, held_out: Column) -> DataFrame:
    shared = stats.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = shared.value.probability(_matrix(batch.column(2)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return stats.select("doc_id", held_out.alias("held_out"), "stats").mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def classify(documents: DataFrame, labels: DataFrame, folds: int = 3, fold: int = 1) -> DataFrame:
    """Scores of all documents; labels of documents whose crc32(doc_id) mod ``folds`` is ``fold`` are not learned from."""
    small_batches(documents.sparkSession)
    held_out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(folds)) == fold, F.lit(False))
    stats = written(described(documents), "quality-statistics")
    return score(stats, fit(stats, labels, held_out), held_out)
