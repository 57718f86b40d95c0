"""Quality classifier: naive Bayes support vectors over character n-gram indicators."""

from __future__ import annotations

from pyspark.sql import DataFrame

from auditloom.llm._common import doc_columns
from auditloom.llm.linear import Grams, IndicatorModel, fit_hinge_dual, fit_indicators, in_fold, keep_documents, score_documents

GRAMS = Grams(orders=(1, 2, 3), bits=20, letters=False)
HELD_OUT = (5, 0)  #: modulus and remainder of crc32(doc_id)
THRESHOLD = 0.3
#: Bound of the training sample (documents of each label) and of the features kept.
PER_CLASS, FEATURES = 1500, 2048


def fit_quality(docs: DataFrame, labels: DataFrame) -> IndicatorModel:
    """Learn from labelled documents outside the held-out fold, at most PER_CLASS of each label.

    Indicators of one to three bytes of the text as it is, scaled by class log-count ratios; a
    hinge-loss model fitted by dual coordinate descent; Platt's sigmoid on cross-fitted decision values.
    """
    marked = labels.where(~in_fold(*HELD_OUT)).selectExpr("cast(doc_id as bigint) doc_id", "cast(quality as int) label")
    return fit_indicators(docs, marked, GRAMS, fit_hinge_dual, PER_CLASS, FEATURES)


def quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every whole text.

    Null and empty texts get the score of a text without n-grams; rows with null doc_id are
    scored and count as not held out; repeated rows each get a row; labels that are null, other
    than 0 or 1 or contradictory are not learned from; an empty table gives no rows.
    """
    return score_documents(doc_columns(docs, "doc_id", "text"), fit_quality(docs, labels), in_fold(*HELD_OUT), threshold)


def keep_quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents, with all their columns, that the classifier does not reject."""
    model = docs.sparkSession.sparkContext.broadcast(fit_quality(docs, labels))
    return keep_documents(docs, lambda text: model.value.scores(text) >= threshold)
