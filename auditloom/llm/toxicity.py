"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios."""

from __future__ import annotations

from pyspark.sql import DataFrame

from auditloom.llm._common import doc_columns
from auditloom.llm.linear import Grams, IndicatorModel, fit_indicators, fit_logistic, in_fold, score_documents

GRAMS = Grams(orders=(4, 5, 6), bits=22, letters=True)
HELD_OUT = (3, 1)  #: modulus and remainder of crc32(doc_id)
THRESHOLD = 0.7
#: Bound of the training sample (documents of each label) and of the features kept.
PER_CLASS, FEATURES = 1200, 1024


def fit_toxicity(docs: DataFrame, labels: DataFrame) -> IndicatorModel:
    """Learn from labelled documents outside the held-out fold, at most PER_CLASS of each label.

    The n-grams are of letters, lower-cased and with word ends; each present one counts once, at
    its log-count ratio; a logistic model weighs them, calibrated by cross-fitting.
    """
    marked = labels.where(~in_fold(*HELD_OUT)).selectExpr("cast(doc_id as bigint) doc_id", "cast(toxic as int) label")
    return fit_indicators(docs, marked, GRAMS, fit_logistic, PER_CLASS, FEATURES)


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every whole text.

    Null and empty texts get the score of a text without n-grams; rows with null doc_id are
    scored and count as not held out; repeated rows each get a row; labels that are null, other
    than 0 or 1 or contradictory are not learned from; an empty table gives no rows.
    """
    return score_documents(doc_columns(docs, "doc_id", "text"), fit_toxicity(docs, labels), in_fold(*HELD_OUT), threshold)
