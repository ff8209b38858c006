"""Score sources of a text and their order of preference."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions.core import is_blank, py_round
from textloom.operators.metrics import uniformity_score


def _is_fake(label: Column) -> Column:
    return F.upper(F.coalesce(label, F.lit(""))) == "FAKE"


def normalize_prediction(predictions: Column) -> Column:
    """First {label, score}: 100 * score for FAKE, 100 * (1 - score) for any other label; empty gives 0."""
    first = F.get(predictions, F.lit(0))
    score = F.coalesce(first["score"], F.lit(0.0))
    value = F.when(_is_fake(first["label"]), score * 100.0).otherwise((F.lit(1.0) - score) * 100.0)
    return F.when(F.coalesce(F.size(predictions), F.lit(0)) <= 0, F.lit(0.0)).otherwise(py_round(value, 2))


def pick_label(predictions: Column) -> Column:
    """100 * score of the first FAKE entry of a prediction list, 0 if there is none."""
    fake = F.get(F.filter(predictions, lambda p: _is_fake(p["label"])), F.lit(0))
    return F.when(predictions.isNotNull(), py_round(F.coalesce(fake["score"], F.lit(0.0)) * 100.0, 2))


def resolve_score(
    df: DataFrame, text: str = "text", model_score: str | None = None, service_score: str | None = None
) -> DataFrame:
    """Add ``score`` and ``from_fallback``.

    A model score wins (a blank text scores 0 there), then a service score; where
    neither exists the uniformity score is used and flagged.
    """
    none = F.lit(None).cast("double")
    model = F.col(model_score) if model_score else none
    service = F.col(service_score) if service_score else none
    model = F.when(model.isNotNull() & is_blank(F.col(text)), F.lit(0.0)).otherwise(model)
    external = F.coalesce(model, service)
    return df.withColumns(
        {
            "score": F.when(external.isNotNull(), external).otherwise(uniformity_score(F.col(text))),
            "from_fallback": external.isNull(),
        }
    )
