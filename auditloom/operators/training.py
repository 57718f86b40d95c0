"""Training and evaluation: standardise, weigh classes, fit, confusion matrix, AUC, cross-validation, ablation."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditloom.operators.features import FEATURES
from auditloom.operators.ranking import numbered_within
from auditloom.operators.scoring import LogisticModel
from auditloom.sources.storage import stored

#: Full-batch gradient steps and their size.
EPOCHS, RATE = 3000, 0.5

#: Features that the ablation silences, those that rest on words of one language.
LEXICON = ("injection_markers", "concealment", "cross_tool", "urgency", "directive", "imperative_density", "hidden_recipient", "redaction_language", "conceal_x_exfil", "cred_x_exfil", "fs_x_exfil", "cross_x_urgency", "recipient_x_exfil")


def feature_stats(rows: DataFrame, names=FEATURES) -> DataFrame:
    """(feature, mean, std): population deviation, 1 where it is 0. One aggregate pass."""
    row = rows.agg(F.array(*(F.struct(F.lit(n).alias("feature"), F.avg(n).alias("mean"), F.stddev_pop(n).alias("std")) for n in names)).alias("s"))
    return row.select(F.explode("s").alias("s")).select("s.feature", F.coalesce("s.mean", F.lit(0.0)).alias("mean"), F.when(F.coalesce("s.std", F.lit(0.0)) == 0, 1.0).otherwise(F.col("s.std")).alias("std"))


def class_weights(rows: DataFrame) -> DataFrame:
    """(label, n, weight) with n_all / (2 n)."""
    counts = rows.groupBy("label").agg(F.count("*").alias("n"))
    return counts.select("label", "n", (F.sum("n").over(Window.partitionBy()) / (2 * F.col("n"))).alias("weight"))


def train(rows: DataFrame, l2: float = 1e-3, names=FEATURES, threshold: float = 0.5, steps: int = 200) -> LogisticModel:
    """Class-balanced L2 logistic regression on (label, features), fitted on the cluster.

    The columns are standardised beforehand and the solver is told not to, so the penalty is on
    the standardised weights and the bias is free of it.
    """
    stats = {r.feature: (r.mean, r.std) for r in feature_stats(rows, names).collect()}  # a row for each feature
    weights = {r.label: r.weight for r in class_weights(rows).collect()}  # a row for each label
    if set(weights) != {0, 1}:
        raise ValueError("training needs rows of both labels")
    scaled = F.array(*((F.col(n) - F.lit(stats[n][0])) / F.lit(stats[n][1]) for n in names))
    ready = rows.select(F.col("label").cast("double").alias("label"), array_to_vector(scaled).alias("features"), F.when(F.col("label") == 1, F.lit(weights[1])).otherwise(F.lit(weights[0])).alias("weight"))
    fitted = LogisticRegression(regParam=l2, elasticNetParam=0.0, standardization=False, weightCol="weight", maxIter=steps, tol=1e-9).fit(ready)
    return LogisticModel(list(map(float, fitted.coefficients)), float(fitted.intercept), [stats[n][0] for n in names], [stats[n][1] for n in names], list(names), threshold)


def confusion(rows: DataFrame, score: Column, threshold: float = 0.5, by: tuple[str, ...] = ()) -> DataFrame:
    """tp, fp, tn, fn and the rates from them, rounded to 4 digits, for rows with label 0/1."""
    hit, real = score >= threshold, F.col("label") == 1
    count = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0)).cast("long")
    cells = rows.groupBy(*by).agg(count(hit & real).alias("tp"), count(hit & ~real).alias("fp"), count(~hit & ~real).alias("tn"), count(~hit & real).alias("fn"))
    share = lambda a, b: F.round(F.when(b > 0, a / b).otherwise(F.lit(0.0)), 4)
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    return cells.select(*by, tp, fp, tn, fn, share(tp, tp + fp).alias("precision"), share(tp, tp + fn).alias("recall"), share(2 * tp, 2 * tp + fp + fn).alias("f1"), share(tp + tn, tp + fp + tn + fn).alias("accuracy"))


def score_ranges(rows: DataFrame, score: Column) -> DataFrame:
    """(s, p, n, part): each distinct score with its positives and negatives, and its range of scores.

    The ranges are dealt by a range sort of the distinct scores, not by their width, so scores that
    crowd together are split as well; a score that many rows share is one row. Null scores are left
    out. The rows are stored, as ranges hold for this run's partitions alone.
    """
    by_score = rows.groupBy(score.alias("s")).agg(F.sum((F.col("label") == 1).cast("long")).alias("p"), F.sum((F.col("label") != 1).cast("long")).alias("n"))
    return stored(by_score.where("s is not null").repartitionByRange("s").withColumn("part", F.spark_partition_id()), "scores")


def roc_auc(rows: DataFrame, score: Column) -> DataFrame:
    """(auc, n_pos, n_neg) by counts for each distinct score; ties count half.

    The negatives below a score are those of lower ranges, a prefix sum over one row for each range,
    and those below it in its own.
    """
    ranges = score_ranges(rows, score)
    ends = ranges.groupBy("part").agg(F.sum("n").alias("rn"))
    below = ends.select("part", F.coalesce(F.sum("rn").over(Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inside = Window.partitionBy("part").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    ranked = ranges.join(F.broadcast(below), "part").withColumn("lower", F.col("before") + F.coalesce(F.sum("n").over(inside), F.lit(0)))
    total = ranked.agg(F.sum(F.col("p") * (F.col("lower") + F.col("n") / 2)).alias("u"), F.sum("p").alias("n_pos"), F.sum("n").alias("n_neg"))
    return total.select(F.when((F.col("n_pos") > 0) & (F.col("n_neg") > 0), F.col("u") / (F.col("n_pos") * F.col("n_neg"))).otherwise(F.lit(0.0)).alias("auc"), F.coalesce("n_pos", F.lit(0)).alias("n_pos"), F.coalesce("n_neg", F.lit(0)).alias("n_neg"))


def folds(rows: DataFrame, key: str, k: int, seed: int = 0) -> DataFrame:
    """``rows`` with a fold from 0 to k - 1: dealt round within each label, in the order of a seeded digest of ``key``.

    The sizes of a label's folds differ by one at most.
    """
    dealt = rows.withColumn("_order", F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}"))))
    return numbered_within(dealt, "label", F.col("_order"), F.col(key)).withColumn("fold", (F.col("number") % k).cast("int")).drop("_order", "number")


# ---------------------------------------------------------------- full-batch gradient descent


def _gradients(rows: DataFrame, slopes: np.ndarray, shifts: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """For each model the sums of the weighted errors times each feature, and of the errors alone.

    ``rows`` are (label, fold, x); model m is not trained on the rows of fold m. A partition returns
    a row of sums for each model.
    """
    number, width = slopes.shape

    def add(batches):
        total = np.zeros((number, width + 1))
        for batch in batches:
            if not batch.num_rows:
                continue
            label, fold = (batch.column(c).to_numpy().astype(np.int64) for c in (0, 1))
            x = batch.column(2).flatten().to_numpy().reshape(-1, width)
            z = x @ slopes.T + shifts
            e = np.exp(-np.abs(z))
            error = (np.where(z >= 0, 1 / (1 + e), e / (1 + e)) - label[:, None]) * weights[:, label].T * (fold[:, None] != np.arange(number))
            total += np.concatenate([error.T @ x, error.sum(axis=0)[:, None]], axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(range(number), type=pa.int32()), pa.array(list(total), type=pa.list_(pa.float64()))], names=["m", "sums"])

    cells = rows.select("label", "fold", "x").mapInArrow(add, "m int, sums array<double>").select("m", F.posexplode("sums").alias("i", "v"))
    found = np.zeros((number, width + 1))
    for r in cells.groupBy("m", "i").agg(F.sum("v").alias("v")).collect():  # a cell for each model and feature
        found[r.m, r.i] = r.v
    return found


def _moments(rows: DataFrame, k: int) -> tuple[np.ndarray, ...]:
    """(rows, positives, means, population deviations, 1 where they are 0) for each model, from the moments of the folds."""
    spread = Summarizer.metrics("mean", "variance").summary(array_to_vector("x")).alias("s")
    by_fold = rows.groupBy("fold").agg(F.count("*").alias("n"), F.sum(F.col("label").cast("long")).alias("pos"), spread).collect()  # a row for each fold
    out = []
    for m in range(k):
        own = [r for r in by_fold if r.fold != m]
        n, pos = sum(r.n for r in own), sum(r.pos for r in own)
        if not n:
            raise ValueError("training needs rows of both labels")
        mean = sum(r.n * r.s.mean.toArray() for r in own) / n
        squares = sum((r.n - 1) * r.s.variance.toArray() + r.n * (r.s.mean.toArray() - mean) ** 2 for r in own)
        out.append((n, pos, mean, np.sqrt(np.maximum(squares, 0) / n)))
    n, pos, mean, std = (np.array(x, dtype=float) for x in zip(*out, strict=True))
    return n, pos, mean, np.where(std == 0, 1.0, std)


def descend_all(rows: DataFrame, k: int, l2: float = 1e-3, names=FEATURES, threshold: float = 0.5, epochs: int = EPOCHS, rate: float = RATE) -> list[LogisticModel]:
    """k class-balanced models by full-batch gradient steps from zero, together; model m is not trained on fold m.

    A step is one aggregate over the stored rows: the weighted mean gradient, the penalty on the
    standardised weights, none on the bias. For one model of all rows give them a fold of -1.
    """
    rows = stored(rows.select(F.col("label").cast("int").alias("label"), F.col("fold").cast("int").alias("fold"), F.array(*(F.col(n).cast("double") for n in names)).alias("x")), "training")
    n, pos, mean, std = _moments(rows, k)
    if (pos <= 0).any() or (pos >= n).any():
        raise ValueError("training needs rows of both labels")
    by_label = np.stack([n / (2 * (n - pos)), n / (2 * pos)], axis=1)
    w, b = np.zeros((k, len(names))), np.zeros(k)
    for _ in range(epochs):
        sums = _gradients(rows, w / std, b - (w * mean / std).sum(axis=1), by_label)
        errors = sums[:, -1]
        w, b = w - rate * ((sums[:, :-1] - mean * errors[:, None]) / std / n[:, None] + l2 * w), b - rate * errors / n
    return [LogisticModel(list(map(float, w[m])), float(b[m]), list(map(float, mean[m])), list(map(float, std[m])), list(names), threshold) for m in range(k)]


def descend(rows: DataFrame, l2: float = 1e-3, names=FEATURES, threshold: float = 0.5, epochs: int = EPOCHS, rate: float = RATE) -> LogisticModel:
    """One model of all rows by full-batch gradient steps (``descend_all``)."""
    return descend_all(rows.withColumn("fold", F.lit(-1)), 1, l2, names, threshold, epochs, rate)[0]


def _fold_models(parts: DataFrame, k: int, l2: float, names, epochs: int | None, rate: float) -> list[LogisticModel]:
    if epochs is None:
        return [train(parts.where(F.col("fold") != fold), l2, names) for fold in range(k)]
    return descend_all(parts, k, l2, names, epochs=epochs, rate=rate)


def _of_fold(models: list[LogisticModel], column) -> Column:
    """A column of the model that was not trained on a row's fold."""
    found = F.lit(None)
    for m, model in enumerate(models):
        found = F.when(F.col("fold") == m, column(model)).otherwise(found)
    return found


def out_of_fold(rows: DataFrame, key: str, k: int = 5, l2: float = 1e-3, silenced=LEXICON, epochs: int | None = None, rate: float = RATE) -> tuple[DataFrame, list[LogisticModel]]:
    """``rows`` with fold, ``p`` and ``p_without`` (of models without the ``silenced`` features), and the models behind ``p``.

    Every score is of a model that has not seen the row.
    """
    parts = stored(folds(rows, key, k), "folds")
    whole = _fold_models(parts, k, l2, FEATURES, epochs, rate)
    reduced = _fold_models(parts, k, l2, [n for n in FEATURES if n not in silenced], epochs, rate)
    return parts.withColumns({"p": _of_fold(whole, LogisticModel.probability), "p_without": _of_fold(reduced, LogisticModel.probability)}), whole


def attributions(scored: DataFrame, models: list[LogisticModel], by: str = "lang") -> DataFrame:
    """(``by``, feature, label, mean): the mean contribution of each feature to the out-of-fold decision."""
    parts = _of_fold(models, lambda m: F.array(*m.contributions().values()))
    names = F.array(*map(F.lit, models[0].features))
    found = scored.select(by, "label", F.posexplode(parts).alias("i", "value")).groupBy(by, "i", "label").agg(F.avg("value").alias("mean"))
    return found.select(by, F.element_at(names, F.col("i") + 1).alias("feature"), "label", "mean")


def cross_validate(rows: DataFrame, key: str, k: int = 5, l2: float = 1e-3, names=FEATURES, by: tuple[str, ...] = (), epochs: int | None = None, rate: float = RATE) -> DataFrame:
    """The pooled confusion matrix of k models, each on the rows it was not trained on.

    ``epochs``: so many gradient steps for each model, all together, instead of the solver.
    """
    parts = stored(folds(rows, key, k), "folds")
    return confusion(parts.withColumn("p", _of_fold(_fold_models(parts, k, l2, names, epochs, rate), LogisticModel.probability)), F.col("p"), by=by)


def ablation(rows: DataFrame, key: str, silenced=LEXICON, by: tuple[str, ...] = ("lang",), epochs: int | None = None, rate: float = RATE) -> DataFrame:
    """Cross-validated rates with all features and without ``silenced`` ones."""
    scored, _ = out_of_fold(rows, key, silenced=silenced, epochs=epochs, rate=rate)
    parts = [confusion(scored, F.col(p), by=by).withColumn("features", F.lit(name)) for name, p in (("all", "p"), ("without_lexicon", "p_without"))]
    return parts[0].unionByName(parts[1])
