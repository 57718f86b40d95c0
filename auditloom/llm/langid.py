"""Language ID: averaged hashed subword embeddings with a linear softmax.

A text is the average of the embeddings of its letter n-grams; a linear layer and a softmax give
the languages. Both are trained by stochastic gradient descent in numpy. As everything after the
average is linear, scoring needs only the product of the two tables: a row of logits for each
bucket. N-grams that no training text has take no part in the average.

The score of a prediction is its softmax probability, after a temperature, times the probability
that the text is in a known language at all; it is rejected where that is under a bound. The second
probability rests on two averages over all n-grams of a text, seen in training or not: how many are
among the predicted language's most frequent ones (its function words and endings), by a logistic
function, and how far its logit leads the next, which lowers the probability where the lead is
small. Neither asks for a known vocabulary. Both are fitted on models that lack one language each:
texts of that language are what to reject, thinned texts of the others what to keep. A thinned text
is three fifths n-grams of the language that the model lacks, and so stands for a text of a known
language whose words are mostly new. Temperature and function come from a fifth of the training
rows that no descent sees.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditloom.llm._common import doc_columns, slices, small_batches
from auditloom.llm.linear import Grams, calibration_part, in_fold, keep_documents, label_sample, sampled_buckets, sigmoid

GRAMS = Grams(orders=(2, 3, 4), bits=22, letters=True)
#: Buckets of embeddings: the upper bits of an n-gram's hash. All its bits tell whether it was seen.
EMBEDDED_BITS = 16
HELD_OUT = (4, 2)  #: modulus and remainder of crc32(doc_id)
UNKNOWN = "und"
#: Bound of the training sample (documents of each language), embedding width, passes.
PER_LANGUAGE, WIDTH, EPOCHS = 600, 16, 12
#: Most frequent n-grams of a language that tell how typical of it a text is.
TYPICAL = 200
#: Share of a thinned text that is of its own language. Share of the thinned texts whose lead is not held to be small.
OWN_SHARE, LED = 0.4, 0.995
#: Bound of the score: below it the prediction is likelier wrong, or the language unknown, than right.
REJECT_BELOW = 0.5
#: So many n-grams of an average known text count beside a text's own, as a few words say little.
PRIOR_GRAMS = 3.0
_ASCII_LETTER = re.compile("[A-Za-z]")


@dataclass
class LanguageModel:
    languages: list[str]
    logits: np.ndarray  #: for each embedded bucket and language
    bias: np.ndarray
    seen: np.ndarray  #: whether training has the n-grams of a bucket
    typical: np.ndarray  #: for each bucket its row in ``shares``; row 0 is of all that are typical of no language
    shares: np.ndarray  #: for each typical bucket and language 1 over the average share of typical n-grams, or 0
    temperature: float = 1.0
    known: tuple[float, float] = (0.0, 20.0)  #: weight of the typical share, constant
    lead: float = 0.0  #: a lead under this is small
    usual: tuple[float, float] = (1.0, 0.0)  #: both of an average known text
    reject_below: float = REJECT_BELOW

    def averages(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(mean logits over the seen n-grams with the bias, number of n-grams, share of seen ones, typical shares) of each text.

        Each text's sums are over its own n-grams alone, so equal texts have equal results.
        """
        width = len(self.languages)
        total, known, count = np.zeros((len(text), 2 * width)), np.zeros(len(text)), np.zeros(len(text))
        for number, bucket in GRAMS.buckets(text):
            count += np.bincount(number, minlength=len(text))
            hit = self.seen[bucket]
            number, bucket = number[hit], bucket[hit]
            known += np.bincount(number, minlength=len(text))
            add_by_text(total[:, :width], number, self.logits, bucket >> (GRAMS.bits - EMBEDDED_BITS))
            row = self.typical[bucket]
            add_by_text(total[:, width:], number[row > 0], self.shares, row[row > 0])
        return total[:, :width] / np.maximum(known, 1)[:, None] + self.bias, count, known / np.maximum(count, 1), total[:, width:] / np.maximum(count, 1)[:, None]

    def known_probability(self, z: np.ndarray, count: np.ndarray, share: np.ndarray, typical: np.ndarray) -> np.ndarray:
        """The probability that a text is in a language of the model."""
        found = signals(z, share, typical, count, self.usual)
        led = np.clip(found[:, 1] / self.lead, 0, 1) if self.lead > 0 else 1.0
        return sigmoid(self.known[0] * found[:, 0] + self.known[1]) * led

    def predict(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(language, score, rejected, share of seen n-grams); ``und`` with score 0 where there is no letter."""
        letters = np.array([has_letter(x) for x in text.to_pylist()], dtype=bool)
        if not self.languages:
            return np.full(len(text), UNKNOWN, dtype=object), np.zeros(len(text)), np.ones(len(text), dtype=bool), np.zeros(len(text))
        z, count, share, typical = self.averages(text)
        p = softmax(z / self.temperature)
        score = np.where(letters, p.max(axis=1, initial=0) * self.known_probability(z, count, share, typical), 0.0)
        return np.where(letters, np.array(self.languages, dtype=object)[p.argmax(axis=1)], UNKNOWN), score, ~letters | (score < self.reject_below), share


def add_by_text(total: np.ndarray, number: np.ndarray, table: np.ndarray, rows: np.ndarray) -> None:
    """Add to each text's row of ``total`` the sum of its n-grams' rows of ``table``."""
    own = np.flatnonzero(np.r_[True, number[1:] != number[:-1]]) if len(number) else np.zeros(0, dtype=np.int64)
    if len(own):
        total[number[own]] += np.add.reduceat(table[rows].astype(np.float64), own, axis=0)


def signals(z: np.ndarray, share: np.ndarray, typical: np.ndarray, count: np.ndarray, usual: tuple[float, float]) -> np.ndarray:
    """(typical share of the predicted language, its lead over the next one over all n-grams) of each text."""
    best = z.argmax(axis=1)
    lead = np.diff(np.sort(z, axis=1)[:, -2:], axis=1)[:, 0] if z.shape[1] > 1 else np.zeros(len(z))
    found = np.stack([typical[np.arange(len(z)), best], lead * share], axis=1)
    return (found * count[:, None] + PRIOR_GRAMS * np.array(usual)) / (count[:, None] + PRIOR_GRAMS)


def has_letter(text: str | None) -> bool:
    return bool(text) and (_ASCII_LETTER.search(text) is not None or any(map(str.isalpha, text)))


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def embedded(buckets: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(embedded buckets, counts) of a text's buckets."""
    rows, at = np.unique(buckets >> (GRAMS.bits - EMBEDDED_BITS), return_inverse=True)
    return rows, np.bincount(at, weights=counts, minlength=len(rows))


def seen_in(buckets: list[np.ndarray]) -> np.ndarray:
    seen = np.zeros(1 << GRAMS.bits, dtype=bool)
    for x in buckets:
        seen[x] = True
    return seen


def typical_grams(buckets: list[np.ndarray], counts: list[np.ndarray], y: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row of each bucket, for each row and language 1 over the average share, or 0) of the languages' most frequent n-grams."""
    chosen, average = [], []
    for language in range(k):
        part = np.zeros(1 << GRAMS.bits)
        for x, c, t in zip(buckets, counts, y, strict=True):
            if t == language and len(x):
                part[x] += c / c.sum()
        top = np.sort(np.argpartition(-part, TYPICAL)[:TYPICAL])
        chosen.append(top[part[top] > 0])
        average.append(part[chosen[-1]].sum() / max(1, (y == language).sum()))
    rows = np.unique(np.concatenate(chosen))
    table = np.zeros(1 << GRAMS.bits, dtype=np.int16 if len(rows) < 1 << 15 else np.int32)
    table[rows] = np.arange(1, len(rows) + 1)
    shares = np.zeros((len(rows) + 1, k))
    for language, (top, mean) in enumerate(zip(chosen, average, strict=True)):
        shares[table[top], language] = 1 / mean if mean else 0.0
    return table, shares


def learned(buckets: list[np.ndarray], counts: list[np.ndarray], found: list, languages: list) -> LanguageModel:
    """A model of some languages from their rows, not calibrated yet."""
    rows = [i for i, t in enumerate(found) if t in languages]
    y = np.array([languages.index(found[i]) for i in rows])
    take = lambda items: [items[i] for i in rows]
    own = [embedded(x, c) for x, c in zip(take(buckets), take(counts), strict=True)]
    logits, bias = descend([x for x, _ in own], [c for _, c in own], y, len(languages))
    return LanguageModel(languages, logits, bias, seen_in(take(buckets)), *typical_grams(take(buckets), take(counts), y, len(languages)))


def row_averages(model: LanguageModel, rows: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, ...]:
    """``LanguageModel.averages`` of rows of (buckets, counts)."""
    z, count, share, typical = [], [], [], []
    for bucket, weight in rows:
        hit = model.seen[bucket]
        x, w = bucket[hit], weight[hit]
        z.append(w @ model.logits[x >> (GRAMS.bits - EMBEDDED_BITS)].astype(float) / max(1e-9, w.sum()) + model.bias)
        count.append(weight.sum())
        share.append(w.sum() / max(1e-9, weight.sum()))
        typical.append(w @ model.shares[model.typical[x]] / max(1e-9, weight.sum()))
    return np.stack(z), np.array(count), np.array(share), np.stack(typical)


def thinned(row: tuple, other: tuple) -> tuple[np.ndarray, np.ndarray]:
    """A row of which OWN_SHARE is left, the rest n-grams of another row."""
    size = row[1].sum()
    return np.concatenate([row[0], other[0]]), np.concatenate([row[1] * OWN_SHARE, other[1] * ((1 - OWN_SHARE) * size / max(1, other[1].sum()))])


def calibrate(model: LanguageModel, buckets: list[np.ndarray], counts: list[np.ndarray], found: list, aside: np.ndarray) -> None:
    """Set temperature and known-language function from the rows ``aside`` (see the module)."""
    random = np.random.default_rng(7)
    rows = list(zip(buckets, counts, strict=True))
    held = [i for i in np.flatnonzero(aside) if counts[i].sum()]
    if not held:
        return
    z, count, share, typical = row_averages(model, [rows[i] for i in held])
    whole = signals(z, share, typical, count, model.usual)
    model.usual = tuple(map(float, whole.mean(axis=0)))
    scored = [(z, np.array([model.languages.index(found[i]) for i in held]))]
    kept, rejected = [], [np.zeros((len(held), 2))]  # nothing at all is known of the latter
    train = [[x for x, a in zip(items, aside, strict=True) if not a] for items in (buckets, counts, found)]
    for lacking in model.languages if len(model.languages) > 1 else []:
        rest = [x for x in model.languages if x != lacking]
        foreign, own = [i for i in held if found[i] == lacking], [i for i in held if found[i] != lacking]
        if not foreign or not own:
            continue
        reduced = learned(*train, rest)
        mixed = row_averages(reduced, [thinned(rows[i], rows[random.choice(foreign)]) for i in own])
        alone = row_averages(reduced, [rows[i] for i in foreign])
        for into, (z, count, share, typical) in ((kept, mixed), (rejected, alone)):
            into.append(signals(z, share, typical, count, model.usual))
        scored.append((mixed[0], np.array([rest.index(found[i]) for i in own])))
    model.known = fit_known(np.concatenate(kept or [whole])[:, 0], np.concatenate(rejected)[:, 0])
    model.lead = float(np.quantile(np.concatenate(kept)[:, 1], 1 - LED)) if len(model.languages) > 2 and kept else 0.0

    def loss(temperature: float) -> float:
        """Log loss; no prediction is held to be surer than the number of rows allows."""
        total = 0.0
        for z, right in scored:
            p = np.log(softmax(z / temperature) + 1e-300)
            sure, at = (len(right) + 1) / (len(right) + z.shape[1]), p[np.arange(len(right)), right]
            total -= (sure * at + (1 - sure) / max(1, z.shape[1] - 1) * (p.sum(axis=1) - at)).sum()
        return total

    model.temperature = float(min(np.geomspace(0.05, 20, 80), key=loss))


def fit_known(kept: np.ndarray, rejected: np.ndarray, l2: float = 1e-4) -> tuple[float, float]:
    """Weight and constant of a class-balanced logistic function of one signal, by Newton steps that only ever descend."""
    a = np.column_stack([np.concatenate([kept, rejected]), np.ones(len(kept) + len(rejected))])
    t, weight = (np.concatenate([np.full(len(kept), x), np.full(len(rejected), y)]) for x, y in ((1.0, 0.0), (0.5 / len(kept), 0.5 / len(rejected))))
    loss = lambda w: (weight * np.logaddexp(0, np.where(t > 0, -1, 1) * (a @ w))).sum() + l2 / 2 * w[0] ** 2
    w, penalty = np.zeros(2), np.diag([l2, 1e-9])
    for _ in range(100):
        p = sigmoid(a @ w)
        step = np.linalg.solve((a * (weight * p * (1 - p))[:, None]).T @ a + penalty + 1e-12 * np.eye(2), a.T @ (weight * (p - t)) + penalty @ w)
        while loss(w - step) > loss(w) and np.abs(step).max() > 1e-12:
            step = step / 2
        w = w - step
    return float(w[0]), float(w[1])


def descend(buckets: list[np.ndarray], counts: list[np.ndarray], y: np.ndarray, k: int, epochs: int = EPOCHS, rate: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """(logits for each bucket, bias) after ``epochs`` passes of stochastic gradient descent."""
    random = np.random.default_rng(11)
    embedding = random.normal(0, 1 / WIDTH, (1 << EMBEDDED_BITS, WIDTH))
    layer, bias = random.normal(0, 1 / np.sqrt(WIDTH), (WIDTH, k)), np.zeros(k)
    shares = [c / c.sum() if len(c) else c for c in counts]
    steps, t = epochs * len(y), 0
    for _ in range(epochs):
        for i in random.permutation(len(y)):
            now = rate * (1 - t / steps)
            t += 1
            rows, share = buckets[i], shares[i]
            hidden = share @ embedding[rows]
            z = hidden @ layer + bias
            error = np.exp(z - z.max())
            error /= error.sum()
            error[y[i]] -= 1
            back = layer @ error
            layer -= now * np.outer(hidden, error)
            bias -= 0.1 * now * error
            embedding[rows] -= (now * 20) * np.outer(share, back)
    return (embedding @ layer).astype(np.float32), bias


def fit_languages(docs: DataFrame) -> LanguageModel:
    """Learn from text and lang of documents outside the held-out fold (bound: PER_LANGUAGE)."""
    labels = doc_columns(docs, "doc_id", "lang").where(~in_fold(*HELD_OUT)).select("doc_id", F.col("lang").alias("label"))
    sample, _ = label_sample(labels, PER_LANGUAGE)
    found, buckets, counts = sampled_buckets(docs, sample, GRAMS, counted=True)
    languages = sorted(set(found))
    if not languages:
        return LanguageModel([], np.zeros((1 << EMBEDDED_BITS, 0), dtype=np.float32), np.zeros(0), *(np.zeros(1 << GRAMS.bits, dtype=t) for t in (bool, np.int16)), np.zeros((1, 0)))
    aside = calibration_part(len(found)) & (len(found) >= 50)
    take = lambda items: [x for x, a in zip(items, aside, strict=True) if not a]
    model = learned(take(buckets), take(counts), take(found), sorted(set(take(found))))
    calibrate(model, *(list(c) for c in (buckets, counts, found)), aside & np.isin(found, model.languages))
    return model


def predict_languages(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, rejected, seen_share) of every whole text.

    ``und`` with score 0, rejected, where the text is null or has no letter. A prediction whose
    score is under the model's bound is rejected too, but keeps its language; of short texts more is
    forgiven. Rows with null doc_id are predicted, never learned from; repeated rows each get a row; without any
    labelled row all are ``und``; an empty table gives no rows.
    """
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(fit_languages(docs))
    small_batches(spark)

    def predict(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                language, score, rejected, share = model.value.predict(part.column(1))
                columns = [part.column(0), part.column(2), pa.array(language, type=pa.string()), pa.array(np.round(score, 6)), pa.array(rejected), pa.array(np.round(share, 6))]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "held_out", "lang_pred", "score", "rejected", "seen_share"])

    rows = doc_columns(docs, "doc_id", "text").select("doc_id", "text", in_fold(*HELD_OUT).alias("held_out"))
    return rows.mapInArrow(predict, "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean, seen_share double")


def keep_known(docs: DataFrame) -> DataFrame:
    """The documents, with all their columns, whose language is not rejected.

    Null texts and those without a letter go; repeated rows are each judged alike; an empty table
    gives no rows; where no row has a language to learn from, all go.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit_languages(docs))
    return keep_documents(docs, lambda text: ~model.value.predict(text)[2])
