"""Toxicity by cumulative-link ordinal regression.

Severity has grades 0 (not toxic) to ``GRADES - 1``.  One weight vector is
shared by all thresholds: P(grade > k) = sigmoid(w.x - theta_k), with ordered
theta.  x is sparse: log(1 + count) of the words, and beginnings of words, of a
learned vocabulary.  The
result is the expected grade, the sum of these probabilities.

Grades come from labels alone, never from a text: ``graded`` makes them of the
labels at hand, in the order fine (0), of low quality (1), toxic (2); callers
with finer labels give their own.  A text is toxic where the expected grade
reaches the middle of the scale.

Fitting uses at most ``sample`` labelled documents (those with the smallest hash
of their id) and ``size`` features, so that the driver holds a bounded matrix;
scoring covers all rows and whole texts, long ones in pieces.

Defined cases: a null or empty text has no words and so the grade of the prior;
repeated rows each give a row (a document labelled twice has the higher grade;
rows that share a labelled id are one document in the fit); without labels or without toxic ones nothing is toxic; null ids
are scored but not learned from; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops
from .shared import small_batches

GRADES, TOXIC = 3, 2
#: The expected grade from which a text is toxic.
MIDDLE = (GRADES - 1) / 2
#: Lengths in bytes of the word beginnings that are features, so that inflected words share weights.
BEGINNINGS = (4, 5, 6)
SCORES = "doc_id long, p_toxic double, expected_severity double, grade int, toxic boolean"


@dataclass
class Model:
    words: np.ndarray  # sorted hashes of the vocabulary
    weights: np.ndarray
    theta: np.ndarray  # ascending

    def above(self, z: np.ndarray) -> np.ndarray:
        """P(grade > k) for each row and threshold."""
        return 1 / (1 + np.exp(np.clip(self.theta[None, :] - z[:, None], -40, 40)))


def graded(labels: DataFrame) -> DataFrame:
    """(doc_id, grade) from (doc_id, toxic, quality): 2 if toxic, else 1 if of low quality, else 0."""
    low = F.col("quality") == 0 if "quality" in labels.columns else F.lit(False)
    return labels.filter("toxic is not null").select("doc_id", F.when(F.col("toxic") != 0, 2).when(low, 1).otherwise(0).alias("grade"))


def features(s: textops.Slice) -> tuple[np.ndarray, np.ndarray]:
    """All feature occurrences of a slice, as (document, hash): words, and the beginnings of longer words."""
    docs, hashes = [s.doc], [s.hash]
    for size in BEGINNINGS:
        at, h = s.beginnings(size)
        docs.append(s.doc[at])
        hashes.append(h)
    return np.concatenate(docs), np.concatenate(hashes)


def _summed(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys, back = np.unique(key, return_inverse=True)
    return keys, np.bincount(back, n, len(keys)).astype(np.int64)


def feature_counts(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Distinct features of each text: row, feature, count; those of a long text come together from its pieces."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    for s in textops.slices(texts, textops.ALNUM_FOLDED):
        doc, word = features(s)
        if s.part:
            held.append(np.unique(word, return_counts=True))
            if len(held) == 16 or not s.more:
                held = [_summed(*(np.concatenate(x) for x in zip(*held, strict=True)))]
            if not s.more:
                word, n = held.pop()
                yield np.full(len(word), s.rows[0]), word, n
            continue
        order = np.lexsort((word, doc))
        doc, word = doc[order], word[order]
        new = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (word[1:] != word[:-1])])) if len(doc) else np.zeros(0, np.int64)
        yield s.rows[doc[new]], word[new], np.diff(np.append(new, len(doc)))


def logits(texts: pa.Array, m: Model) -> np.ndarray:
    """w.x of every whole text."""
    z, size = np.zeros(len(texts)), len(m.words)
    total = np.zeros(size)
    for s in textops.slices(texts, textops.ALNUM_FOLDED) if size else ():
        doc, word = features(s)
        key = np.minimum(np.searchsorted(m.words, word), size - 1)
        hit = np.flatnonzero(m.words[key] == word)
        if s.part:
            total += np.bincount(key[hit], minlength=size)
            if not s.more:
                z[s.rows[0]] = np.log1p(total) @ m.weights
                total[:] = 0
            continue
        pair, n = np.unique(doc[hit] * size + key[hit], return_counts=True)
        z[s.rows] = np.bincount(pair // size, np.log1p(n) * m.weights[pair % size], len(s.rows))
    return z


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        grade = batch.column(2).to_numpy(zero_copy_only=False)
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        for row, word, n in feature_counts(batch.column(1)):
            yield pa.RecordBatch.from_arrays([pa.array(ids[row]), pa.array(grade[row]), pa.array(word.view(np.int64)), pa.array(n.astype(np.int32))], ["doc_id", "grade", "word", "n"])


def vocabulary(words: DataFrame, size: int, min_docs: int, least_z: float = 5.0) -> DataFrame:
    """The features that toxic texts hold far more often than chance (a z-score and a share), over all sampled rows.

    Features that speak against toxicity are left out: they come with length, and long texts would drown what is in them.
    """
    words = words.withColumn("toxic", (F.col("grade") >= TOXIC).cast("int"))
    totals = words.groupBy("doc_id").agg(F.first("toxic").alias("toxic")).agg(F.count("*").alias("docs"), F.avg("toxic").alias("share")).first()
    share = float(totals.share or 0.0)
    per_word = words.groupBy("word").agg(F.count("*").alias("docs"), F.sum("toxic").alias("toxic")).filter(F.col("docs") >= min_docs)
    z = (F.col("toxic") - F.col("docs") * share) / F.sqrt(F.col("docs") * max(share * (1 - share), 1e-9))
    return per_word.select("word", z.alias("z"), (F.col("toxic") / F.col("docs")).alias("lift")).filter((F.col("z") >= least_z) & (F.col("lift") >= min(0.5, 4 * share))).select("word", "z").orderBy(F.desc("z"), "word").limit(size)


def fit_ordinal(row: np.ndarray, col: np.ndarray, value: np.ndarray, grade: np.ndarray, size: int, steps: int = 300, ridge: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ordered thresholds, by Adam on the mean log likelihood; x is given as triplets."""
    n, k = len(grade), GRADES - 1
    share = np.clip([(grade > j).mean() if n else 0.0 for j in range(k)], 1e-4, 1 - 1e-4)
    theta = np.sort(np.log((1 - share) / share))
    # theta_0, then the logarithms of the gaps keep the order.
    p = np.concatenate([np.zeros(size), [theta[0]], np.log(np.maximum(np.diff(theta), 0.1))])
    m, v = np.zeros_like(p), np.zeros_like(p)
    if not n:
        return p[:size], theta
    onehot = np.arange(GRADES)[None, :] == grade[:, None]
    for t in range(1, steps + 1):
        gaps = np.exp(p[size + 1 :])
        theta = p[size] + np.concatenate([[0], np.cumsum(gaps)])
        z = np.bincount(row, value * p[col], n)
        s = 1 / (1 + np.exp(np.clip(theta[None, :] - z[:, None], -40, 40)))
        ds = s * (1 - s)
        full = np.hstack([np.ones((n, 1)), s, np.zeros((n, 1))])
        prob = np.maximum(full[:, :-1] - full[:, 1:], 1e-12)
        inner = np.hstack([np.zeros((n, 1)), ds, np.zeros((n, 1))])
        at = 1 / (prob * onehot).sum(axis=1)
        dz = ((inner[:, :-1] - inner[:, 1:]) * onehot).sum(axis=1) * at
        dtheta = np.array([((-ds[:, j]) * (onehot[:, j + 1].astype(float) - onehot[:, j]) * at).sum() for j in range(k)])
        g = np.empty_like(p)
        g[:size] = -np.bincount(col, value * dz[row], size) / n + ridge * p[:size]
        back = np.cumsum(dtheta[::-1])[::-1]
        g[size] = -back[0] / n
        g[size + 1 :] = -back[1:] * gaps / n
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        p -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return p[:size], p[size] + np.concatenate([[0], np.cumsum(np.exp(p[size + 1 :]))])


def fit(documents: DataFrame, labels: DataFrame, sample: int = 20_000, size: int = 1024, min_docs: int = 8) -> Model:
    """Learns from at most ``sample`` labelled rows of (doc_id, grade), grades being 0 to GRADES - 1, or of what ``graded`` takes, with at most ``size`` features.

    So the driver holds at most ``sample`` x ``size`` triplets.
    """
    spark = documents.sparkSession
    small_batches(spark)
    labels = labels if "grade" in labels.columns else graded(labels)
    known = labels.filter("doc_id is not null and grade is not null").groupBy("doc_id").agg(F.max(F.col("grade").cast("int")).alias("grade"))
    some = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    # At most ``sample`` pairs of numbers are broadcast.
    rows = documents.select("doc_id", "text").join(F.broadcast(some), "doc_id").select("doc_id", "text", "grade").mapInArrow(_words, "doc_id long, grade int, word long, n int")
    rows = rows.persist()
    try:
        top = vocabulary(rows, size, min_docs)
        words = np.sort(np.array([r.word for r in top.collect()], np.int64).view(np.uint64))
        if not len(words):
            return Model(words, np.zeros(0), np.array([6.0, 8.0]))
        given = rows.groupBy("doc_id").agg(F.first("grade").alias("grade")).toArrow()
        chosen = rows.join(F.broadcast(spark.createDataFrame(pa.table({"word": words.view(np.int64)}))), "word").groupBy("doc_id", "word").agg(F.sum("n").alias("n")).toArrow()
    finally:
        rows.unpersist()
    order = np.argsort(given["doc_id"].to_numpy())
    ids, grade = given["doc_id"].to_numpy()[order], np.clip(given["grade"].to_numpy()[order], 0, GRADES - 1)
    row = np.searchsorted(ids, chosen["doc_id"].to_numpy())
    col = np.searchsorted(words, chosen["word"].to_numpy().view(np.uint64))
    value = np.log1p(chosen["n"].to_numpy())
    order = np.lexsort((col, row))  # sums in one order on every run
    weights, theta = fit_ordinal(row[order], col[order], value[order], grade, len(words))
    return Model(words, weights, theta)


def severity(texts: pa.Array, m: Model) -> tuple[np.ndarray, np.ndarray]:
    """P(grade >= TOXIC) and the expected grade of every whole text."""
    above = m.above(logits(texts, m))
    return above[:, TOXIC - 1], above.sum(axis=1)


def score(documents: DataFrame, model: Model, threshold: float = MIDDLE) -> DataFrame:
    """SCORES for every document; ``grade`` is the expected grade, rounded, but 0 where the text is not toxic."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            p, expected = severity(batch.column(1), m)
            grade = np.where(expected >= threshold, np.maximum(np.rint(expected), 1), 0).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(p), pa.array(expected), pa.array(grade), pa.array(expected >= threshold)], [c.split()[0] for c in SCORES.split(", ")])

    return documents.select("doc_id", "text").mapInArrow(run, SCORES)


def clean(documents: DataFrame, model: Model, threshold: float = MIDDLE) -> DataFrame:
    """The documents that are not toxic, with all their columns."""
    shared = documents.sparkSession.sparkContext.broadcast(model)
    at = documents.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(severity(batch.column(at), shared.value)[1] < threshold))

    return documents.mapInArrow(keep, documents.schema)
