"""Scoring a stream: features and a linear model are stateless expressions, so a stream takes the same plan."""

from __future__ import annotations

from pyspark.sql import DataFrame

from certus.functions.uncertainty import with_features
from certus.operators import models, validate


def score_stream(records: DataFrame, model: models.Linear, threshold: float) -> DataFrame:
    """Predictions of a streaming table of records; records that can't be scored are left out."""
    valid, _ = validate.prepare(records)
    ready = validate.aligned(with_features(valid), list(model.features))
    return models.predictions(ready.withColumn("probability", model.probability()), threshold)
