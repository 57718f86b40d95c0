"""Byte n-gram indicators and linear models over them, trained in numpy on the driver.

Training reads a bounded sample: at most ``per_class`` labelled documents of each class, drawn by
a hash of doc_id. Their distinct n-gram buckets come to the driver (never their texts). Scoring
covers every whole text: each n-gram is looked up in the table of selected buckets, and a
document's distinct hits are summed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditloom.llm._common import doc_columns, mixed, slices, small_batches, utf8

#: Most rows of a class that are asked for, whatever the number of classes.
_DRAW_MARGIN = 1.1
#: Parts of the training rows; each is scored for calibration by a model of the others.
FOLDS = 3


def in_fold(modulus: int, remainder: int):
    """Whether a document is held out; a null doc_id is not."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % modulus == remainder, F.lit(False))


# ---------------------------------------------------------------- n-grams


@dataclass(frozen=True)
class Grams:
    """Byte n-grams of some orders, hashed to 2**bits buckets.

    ``letters``: lower-case the text and turn ASCII characters other than letters into blanks.
    """

    orders: tuple[int, ...]
    bits: int
    letters: bool

    def text_bytes(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        data, offsets = utf8(pc.utf8_lower(text) if self.letters else text)
        return (_LETTERS[data] if self.letters else data), offsets

    def buckets(self, text: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each order: (document number, bucket) of every n-gram within a document."""
        data, offsets = self.text_bytes(text)
        if not len(data):
            return
        document = np.repeat(np.arange(len(offsets) - 1, dtype=np.int32), np.diff(offsets))
        code = np.zeros(len(data), dtype=np.uint64)
        for n in range(1, max(self.orders) + 1):
            code = (code[: len(data) - n + 1] << np.uint64(8)) | data[n - 1 :] if n > 1 else data.astype(np.uint64)
            if n not in self.orders or not len(code):
                continue
            inside = document[: len(code)] == document[n - 1 :]
            if self.letters:  # those that start with two blanks repeat others
                inside[: len(code) - 1] &= (data[: len(code) - 1] != 32) | (data[1 : len(code)] != 32)
            kept = code[inside] + (np.uint64(n) << np.uint64(57))
            yield document[: len(code)][inside], (mixed(kept) >> np.uint64(64 - self.bits)).astype(np.int32)


_LETTERS = np.array([b if b >= 128 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256)], dtype=np.uint8)


# ---------------------------------------------------------------- training rows


def label_sample(labels: DataFrame, per_class: int) -> tuple[DataFrame, dict]:
    """At most about ``per_class`` rows of each label of (doc_id, label), and the count of each.

    A document labelled in two ways is left out. The sample is the same at every run.
    """
    agreed = labels.where("doc_id is not null and label is not null").groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("other")).where("label = other").drop("other")
    counts = {r.label: r.n for r in agreed.groupBy("label").agg(F.count("*").alias("n")).collect()}
    part = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    shares = [F.when(F.col("label") == value, F.lit(min(1.0, _DRAW_MARGIN * per_class / n))) for value, n in counts.items()]
    return agreed.where(part < F.coalesce(*shares, F.lit(0.0))), counts


def sampled_buckets(docs: DataFrame, sample: DataFrame, grams: Grams, counted: bool = False) -> tuple[list, list[np.ndarray], list[np.ndarray]]:
    """(labels, buckets, counts) of the sampled documents, brought to the driver in a fixed order.

    Of rows with the same doc_id the least text counts; null texts are left out.
    """
    small_batches(docs.sparkSession)
    label_type = dict(sample.dtypes)["label"]

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                pairs = list(grams.buckets(part.column(1))) or [(np.zeros(0, dtype=np.int64),) * 2]
                number, bucket = (np.concatenate(x) for x in zip(*pairs, strict=True))
                key, count = np.unique(number.astype(np.int64) << 32 | bucket, return_counts=True)
                ends = pa.array(np.searchsorted(key >> 32, np.arange(part.num_rows + 1)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(ends, pa.array(x.astype(np.int32))) for x in (key & 0xFFFFFFFF, count)[: 1 + counted]]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), *lists], names=["doc_id", "label", "buckets", "counts"][: 3 + counted])

    rows = doc_columns(docs, "doc_id", "text").where("text is not null").join(F.broadcast(sample), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("label").alias("label"))
    got = rows.mapInArrow(read, f"doc_id long, label {label_type}, buckets array<int>" + ", counts array<int>" * counted).toArrow()
    found = []
    for batch in got.to_batches():  # views of the received buffers, no copies
        columns = [[np.asarray(x.values) for x in batch.column(c)] for c in range(2, 3 + counted)]
        found += zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), *columns, strict=True)
    found.sort(key=lambda r: r[0])
    return [r[1] for r in found], [r[2] for r in found], [r[3] for r in found] if counted else []


def calibration_part(n: int) -> np.ndarray:
    """True for the fifth of the training rows that is kept for calibration."""
    return np.random.default_rng(5).permutation(n) % 5 == 0


# ---------------------------------------------------------------- models


@dataclass
class Rows:
    """Sparse rows: indptr, columns and values."""

    at: np.ndarray
    columns: np.ndarray
    values: np.ndarray
    width: int

    def dot(self, w: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0.0], np.cumsum(self.values * w[self.columns])])
        return total[self.at[1:]] - total[self.at[:-1]]

    def transposed_dot(self, e: np.ndarray) -> np.ndarray:
        return np.bincount(self.columns, weights=self.values * np.repeat(e, np.diff(self.at)), minlength=self.width)


def select_buckets(lists: list[np.ndarray], y: np.ndarray, bits: int, most: int, least_rows: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, log-count ratios): the ``most`` buckets whose naive Bayes ratio is surest."""
    counts = np.zeros((2, 1 << bits), dtype=np.int32)
    for x, t in zip(lists, y, strict=True):
        counts[t][x] += 1  # the buckets of a document are distinct
    seen = np.flatnonzero(counts.sum(axis=0) >= least_rows)
    smooth = counts[:, seen] + 1.0
    n = [float((y == c).sum()) + 2.0 for c in (0, 1)]
    ratio = np.log(smooth[1] / n[1]) - np.log(smooth[0] / n[0])
    sure = np.abs(ratio) / np.sqrt(1 / smooth[0] + 1 / smooth[1])
    best = np.sort(np.argsort(-sure, kind="stable")[:most])
    best = best[sure[best] > 0]
    return seen[best], ratio[best]


def to_rows(lists: list[np.ndarray], table: np.ndarray, ratio: np.ndarray) -> Rows:
    found = [np.unique(c[c >= 0]) for c in (table[x].astype(np.int64) for x in lists)]
    columns = np.concatenate([*found, np.zeros(0, dtype=np.int64)])
    return Rows(np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int64), columns, ratio[columns], len(ratio))


def bucket_table(buckets: np.ndarray, bits: int) -> np.ndarray:
    table = np.full(1 << bits, -1, dtype=np.int16 if len(buckets) < 1 << 15 else np.int32)
    table[buckets] = np.arange(len(buckets))
    return table


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def fit_logistic(x: Rows, y: np.ndarray, l2: float = 1e-4, steps: int = 200, rate: float = 0.05) -> tuple[np.ndarray, float]:
    """L2 logistic regression on class-balanced log loss by full-batch Adam steps."""
    weight = np.where(y == 1, len(y) / 2 / max(1, (y == 1).sum()), len(y) / 2 / max(1, (y == 0).sum())) / len(y)
    w, b = np.zeros(x.width), 0.0
    m, v = np.zeros(x.width + 1), np.zeros(x.width + 1)
    for t in range(1, steps + 1):
        e = weight * (sigmoid(x.dot(w) + b) - y)
        g = np.append(x.transposed_dot(e) + l2 * w, e.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
        w, b = w - step[:-1], b - step[-1]
    return w, b


def fit_hinge_dual(x: Rows, y: np.ndarray, c: float = 0.05, epochs: int = 40, tolerance: float = 1e-3) -> tuple[np.ndarray, float]:
    """A linear hinge-loss model by dual coordinate descent; the bias is a feature of value one."""
    sign = np.where(y == 1, 1.0, -1.0)
    cost = c * np.where(y == 1, len(y) / 2 / max(1, (y == 1).sum()), len(y) / 2 / max(1, (y == 0).sum()))
    w, b, alpha = np.zeros(x.width), 0.0, np.zeros(len(y))
    rows = [(x.columns[a:e], x.values[a:e]) for a, e in zip(x.at, x.at[1:], strict=False)]
    norm = np.array([v @ v + 1.0 for _, v in rows])
    random = np.random.default_rng(7)
    for _ in range(epochs):
        worst = 0.0
        for i in random.permutation(len(y)):
            columns, values = rows[i]
            g = sign[i] * (values @ w[columns] + b) - 1
            projected = min(g, 0.0) if alpha[i] <= 0 else max(g, 0.0) if alpha[i] >= cost[i] else g
            if projected:
                worst = max(worst, abs(projected))
                new = min(max(alpha[i] - g / norm[i], 0.0), cost[i])
                step, alpha[i] = (new - alpha[i]) * sign[i], new
                w[columns] += step * values
                b += step
        if worst < tolerance:
            break
    return w, b


def fit_platt(z: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """(a, b) of sigmoid(a z + b), by Newton steps with Platt's smoothed targets."""
    pos, neg = (y == 1).sum(), (y == 0).sum()
    target = np.where(y == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    scale = max(1e-9, float(np.abs(z).mean()))
    u, a, b = z / scale, 1.0, 0.0
    for _ in range(100):
        p = sigmoid(a * u + b)
        e, h = weight * (p - target), weight * p * (1 - p) + 1e-12
        g = np.array([(e * u).sum() + 1e-3 * a, e.sum()])
        hess = np.array([[(h * u * u).sum() + 1e-3, (h * u).sum()], [(h * u).sum(), h.sum() + 1e-6]])
        step = np.linalg.solve(hess, g)
        step *= min(1.0, 2.0 / max(1e-12, np.abs(step).max()))
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return a / scale, b


@dataclass
class IndicatorModel:
    """sum of the weights of a document's distinct n-grams, calibrated to a probability."""

    grams: Grams
    table: np.ndarray
    weights: np.ndarray
    bias: float
    a: float = 1.0
    b: float = 0.0

    def decision(self, text: pa.Array) -> np.ndarray:
        keys, width = [np.zeros(0, dtype=np.int64)], max(1, len(self.weights))
        for number, bucket in self.grams.buckets(text):
            column = self.table[bucket]
            hit = column >= 0
            found = number[hit].astype(np.int64) * width + column[hit]
            keys.append(np.unique(found))
        key = np.unique(np.concatenate(keys))
        return np.bincount(key // width, weights=self.weights[key % width] if len(self.weights) else None, minlength=len(text))[: len(text)] + self.bias

    def scores(self, text: pa.Array) -> np.ndarray:
        return sigmoid(self.a * self.decision(text) + self.b)


def fit_indicators(docs: DataFrame, labels: DataFrame, grams: Grams, fit: Callable, per_class: int, most: int) -> IndicatorModel:
    """Select, scale by log-count ratios, fit, and calibrate on left-out decision values. ``labels`` has (doc_id, label 0/1).

    Without rows of both labels the score is the share of label 1 (0 without any row).
    """
    sample, counts = label_sample(labels.where("label in (0, 1)"), per_class)
    found, lists, _ = sampled_buckets(docs, sample, grams)
    y = np.array(found, dtype=np.int64)
    if len(set(found)) < 2:
        share = float(y.mean()) if len(y) else 0.0
        flat = float(np.log(max(share, 1e-9) / max(1 - share, 1e-9)))
        return IndicatorModel(grams, np.full(1 << grams.bits, -1, dtype=np.int16), np.zeros(0), flat)
    buckets, ratio = select_buckets(lists, y, grams.bits, most)
    table = bucket_table(buckets, grams.bits)
    w, b = fit(to_rows(lists, table, ratio), y)
    model = IndicatorModel(grams, table, (w * ratio).astype(np.float64), b)
    z = _left_out_decisions(lists, y, grams, fit, most)
    weight = np.where(y == 1, counts[1] / (y == 1).sum(), counts[0] / (y == 0).sum())
    model.a, model.b = fit_platt(z, y, weight / weight.mean())
    return model


def _left_out_decisions(lists: list[np.ndarray], y: np.ndarray, grams: Grams, fit: Callable, most: int) -> np.ndarray:
    """The decision value of each training row by a model that has not seen it."""
    fold = np.empty(len(y), dtype=np.int64)
    for label in (0, 1):
        own = np.flatnonzero(y == label)
        fold[np.random.default_rng(5).permutation(own)] = np.arange(len(own)) % FOLDS
    z = np.zeros(len(y))
    for k in range(FOLDS):
        out = fold == k
        seen = [x for x, o in zip(lists, out, strict=True) if not o]
        if len(set(y[~out])) < 2 or not out.any():
            continue
        buckets, ratio = select_buckets(seen, y[~out], grams.bits, most)
        table = bucket_table(buckets, grams.bits)
        w, b = fit(to_rows(seen, table, ratio), y[~out])
        z[out] = to_rows([x for x, o in zip(lists, out, strict=True) if o], table, ratio).dot(w) + b
    return z


def score_documents(docs: DataFrame, model: IndicatorModel, held_out, threshold: float) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row; the model goes to executors as a broadcast."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                s = np.round(shared.value.scores(part.column(1)), 6)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    rows = doc_columns(docs, "doc_id", "text").select("doc_id", "text", held_out.alias("held_out"))
    return rows.mapInArrow(score, "doc_id long, held_out boolean, score double, predicted int")


def keep_documents(docs: DataFrame, decide: Callable[[pa.Array], np.ndarray]) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose text ``decide`` says true for."""
    small_batches(docs.sparkSession)
    at = docs.columns.index("text")

    def keep(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                yield part.filter(pa.array(decide(part.column(at))))

    return docs.mapInArrow(keep, docs.schema)
