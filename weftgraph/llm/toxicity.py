"""Toxicity grades by cumulative-link ordinal regression on sparse text features.

Features are hashed words and their first four and five letters (which catch the inflected forms of a
stem). Document frequencies by label over all labelled documents choose the features that go with
toxicity; the proportional-odds model shares their weights across the ordered thresholds:
P(grade <= k) = sigmoid(threshold_k - weights . features). The expected severity is the sum of
P(grade > k). Grades are observed: they come from the labels alone, never from the text.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.llm import text_kernel as K
from weftgraph.llm.storage import lean_batches, materialise, release

BITS = 18
BINS = 3 << BITS
#: Up to so many labels (about 16 MB) are broadcast to the documents; beyond it both sides are shuffled.
BROADCAST_LABELS = 500_000


class Model(NamedTuple):
    weights: np.ndarray  # [BINS], 0 for features that aren't used
    thresholds: np.ndarray  # ascending, one less than the grades


def _features(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, bin) of each feature of each word, with repetitions."""
    w = K.words(buf, offsets, K.NOT_LETTER)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(w.ptr))
    n = w.end - w.start
    bins, texts = [(w.hash >> np.uint64(64 - BITS)).astype(np.int64)], [text]
    low = lambda at: buf[at].astype(np.uint64) | np.uint64(32)
    for kind, size in ((1, 4), (2, 5)):
        long = n >= size
        h = np.zeros(long.sum(), np.uint64)
        for k in range(size):
            h = h << np.uint64(8) | low(w.start[long] + k)
        bins.append((K.mix(h) >> np.uint64(64 - BITS)).astype(np.int64) + (kind << BITS))
        texts.append(text[long])
    return np.concatenate(texts), np.concatenate(bins)


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Clean and toxic documents of each feature, and of all together in bin -1."""
    total, docs = np.zeros((2, BINS), np.int64), np.zeros(2, np.int64)
    for batch in batches:
        toxic = batch.column(0).to_numpy(zero_copy_only=False) > 0
        docs += [(~toxic).sum(), toxic.sum()]
        for i, j, buf, offsets in K.chunks(batch.column(1)):
            text, bins = _features(buf, offsets)
            text, bins = np.divmod(np.unique(text * BINS + bins), BINS)
            bad = toxic[i:j][text]
            total[0] += np.bincount(bins[~bad], minlength=BINS)
            total[1] += np.bincount(bins[bad], minlength=BINS)
    at = np.flatnonzero(total.any(0))
    rows = [np.append(-1, at).astype(np.int32), np.append(docs[0], total[0, at]), np.append(docs[1], total[1, at])]
    yield pa.record_batch([pa.array(x) for x in rows], ["bin", "clean", "bad"])


def _rows(used: np.ndarray):
    """The used features that each text has."""
    number = np.full(BINS, -1)
    number[used] = np.arange(len(used))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list[int]] = [[] for _ in range(batch.num_rows)]
            for i, _, buf, offsets in K.chunks(batch.column(1)):
                text, bins = _features(buf, offsets)
                hit = number[bins] >= 0
                text, feature = np.divmod(np.unique(text[hit] * len(used) + number[bins[hit]]), max(1, len(used)))
                for t, f in zip(text.tolist(), feature.tolist(), strict=True):
                    out[i + t].append(f)
            yield pa.record_batch([batch.column(0), pa.array(out, pa.list_(pa.int32()))], ["grade", "features"])

    return run


def fit_cumulative(rows: list[list[int]], grades: np.ndarray, n_features: int, n_grades: int, l2: float = 1e-4, steps: int = 400) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ascending thresholds of the proportional-odds model, by Adam on the mean log-likelihood with
    ``l2 / 2`` times the squared weights taken off. Thresholds are a first one plus positive steps, so their order holds throughout."""
    row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    col = np.fromiter((f for r in rows for f in r), np.int64, len(row))
    theta = np.zeros(n_features + n_grades - 1)
    share = np.clip([(grades <= k).mean() for k in range(n_grades - 1)], 1e-3, 1 - 1e-3)
    start = np.log(share / (1 - share))
    theta[n_features] = start[0]
    theta[n_features + 1 :] = np.log(np.maximum(np.diff(start), 0.1))
    sig = lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40)))
    m, v, n = np.zeros_like(theta), np.zeros_like(theta), len(rows)
    for t in range(1, steps + 1):
        w, gaps = theta[:n_features], np.exp(theta[n_features + 1 :])
        cuts = theta[n_features] + np.append(0, np.cumsum(gaps))
        z = np.bincount(row, w[col], n)
        edge = np.concatenate([[-np.inf], cuts, [np.inf]])
        hi, lo = sig(edge[grades + 1] - z), sig(edge[grades] - z)
        p = np.maximum(hi - lo, 1e-12)
        d_hi, d_lo = hi * (1 - hi) / p, lo * (1 - lo) / p
        d_z = d_hi - d_lo  # of the negative log-likelihood
        grad = np.zeros_like(theta)
        grad[:n_features] = np.bincount(col, d_z[row], n_features) / n + l2 * w
        d_cut = np.array([(d_lo[grades == k + 1].sum() - d_hi[grades == k].sum()) / n for k in range(n_grades - 1)])
        tail = np.cumsum(d_cut[::-1])[::-1]
        grad[n_features] = tail[0]
        grad[n_features + 1 :] = tail[1:] * gaps
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        theta -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
    return theta[:n_features], theta[n_features] + np.append(0, np.cumsum(np.exp(theta[n_features + 1 :])))


def observed_grade(labels: DataFrame) -> Column:
    """0 for a document that isn't toxic; else its label ``severity`` (1 and up), where there is one, or 1 for a toxic
    document whose label ``quality`` is good or missing and 2 for one of poor quality."""
    level = F.lit(1)
    if "quality" in labels.columns:
        level = level + F.coalesce(F.col("quality") == 0, F.lit(False)).cast("int")
    if "severity" in labels.columns:
        level = F.when(F.col("severity").isNull(), level).otherwise(F.greatest(F.col("severity").cast("int"), F.lit(1)))
    return F.when(F.col("toxic") > 0, level).otherwise(0).cast("int")


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = 20_000, max_features: int = 4096, min_gain: float = 4.0) -> Model:
    """Fit on docs (doc_id, text) with labels (doc_id, toxic [, quality, severity]); rows with a null toxic label, id or text
    are left out. Of several labels of a document the highest grade counts; a document's rows count each.

    Feature statistics cover all labelled documents. The ``max_features`` features most tied to toxicity, of those that
    two toxic documents have and that chance explains with less than exp(-min_gain), are the model's; their weights are
    shrunk, and the regression sees about ``sample_rows`` documents. Grades are ``observed_grade``. Without toxic
    documents, clean ones or features, all is clean.
    """
    lean_batches(docs.sparkSession)
    marks = labels.where("toxic is not null and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), observed_grade(labels).alias("grade"))
    marks = marks.groupBy("doc_id").agg(F.max("grade").alias("grade"))
    marks = F.broadcast(marks) if marks.count() <= BROADCAST_LABELS else marks
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    both = texts.join(marks, "doc_id").select("grade", "text", "doc_id")
    weights, nothing = np.zeros(BINS, np.float32), np.array([20.0])
    found = both.select("grade", "text").mapInArrow(_frequencies, "bin int, clean long, bad long")
    found = materialise(found.groupBy("bin").agg(F.sum("clean").alias("clean"), F.sum("bad").alias("bad")).where("bad > 1 or bin < 0"), "frequencies")
    total = found.where("bin < 0").first()
    if total is None or not total["bad"] or not total["clean"]:
        return Model(weights, nothing)
    # log-likelihood ratio of the feature's own share of toxic documents against the overall one
    n, rate = F.col("bad") + F.col("clean"), total["bad"] / (total["bad"] + total["clean"])
    part = lambda c, p: F.when(c > 0, c * F.log(c / n / p)).otherwise(0.0)
    gain = part(F.col("bad"), rate) + part(F.col("clean"), 1 - rate)
    strong = found.where("bin >= 0").where((gain > min_gain) & (F.col("bad") > 2 * rate * n)).orderBy(gain.desc(), "bin").limit(max_features)  # the model's size
    used = np.array([r["bin"] for r in strong.collect()], np.int64)
    release(found)
    if not len(used):
        return Model(weights, nothing)
    share = min(1.0, sample_rows / (total["bad"] + total["clean"]))
    rows = both.where(F.pmod(F.xxhash64(F.lit("toxicity"), "doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1)
    rows = rows.select("grade", "text").mapInArrow(_rows(used), "grade int, features array<int>").collect()
    present, grades = np.unique([r["grade"] for r in rows], return_inverse=True)  # grades that nothing has get no threshold
    if len(present) < 2 or present[0]:
        return Model(weights, nothing)
    weights[used], cuts = fit_cumulative([r["features"] for r in rows], grades, len(used), len(present))
    return Model(weights, cuts)


def _score(model: Model, cutoff: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        active = model.weights != 0
        for batch in batches:
            z = np.zeros(batch.num_rows)
            for i, j, buf, offsets in K.chunks(batch.column(1)):
                text, bins = _features(buf, offsets)
                hit = active[bins]
                text, bins = np.divmod(np.unique(text[hit] * BINS + bins[hit]), BINS)
                z[i:j] = np.bincount(text, model.weights[bins], j - i)
            above = 1 / (1 + np.exp(np.clip(model.thresholds[None, :] - z[:, None], -40, 40)))
            each = -np.diff(np.concatenate([above, np.zeros((len(z), 1))], 1), axis=1)  # of the grades from 1 on
            grade = np.where(above[:, 0] >= cutoff, 1 + each.argmax(1), 0)
            yield pa.record_batch(
                [batch.column(0), pa.array(above.sum(1)), pa.array(grade.astype(np.int32)), pa.array(above[:, 0])],
                ["doc_id", "expected_severity", "grade", "toxic_probability"],
            )

    return run


def grade(docs: DataFrame, model: Model, cutoff: float = 0.4) -> DataFrame:
    """doc_id, expected_severity, grade, toxic_probability, toxic: a row for each row of ``docs``.

    toxic says whether a grade above 0 has a probability of at least ``cutoff``; grade is then the most probable one above
    0 (the lower of equals), else 0. Null and empty texts have no features and get the model's base rate; rows that
    repeat are graded each; other columns are ignored.
    """
    lean_batches(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = texts.mapInArrow(_score(model, cutoff), "doc_id long, expected_severity double, grade int, toxic_probability double")
    return out.withColumn("toxic", F.col("grade") > 0)
