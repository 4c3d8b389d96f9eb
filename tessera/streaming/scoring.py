"""Fitted models on streams: serving is a projection, so a streaming table is scored as a static one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def score_stream(stream: DataFrame, model) -> DataFrame:
    """The stream with margin and prediction."""
    return model.predict(model.decision_function(stream))


def windowed_decisions(scored: DataFrame, time: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """How many rows of each window got which decision; state is dropped once the watermark has passed."""
    return scored.withWatermark(time, late).groupBy(F.window(time, width), "prediction").agg(F.count(F.lit(1)).alias("n"), F.avg("margin").alias("mean_margin"))
