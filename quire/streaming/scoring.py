"""Release decisions on a stream of cases. Scoring is stateless, so the batch operators serve as they are."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.operators.scoring import evaluate


def score_stream(cases: DataFrame, **options) -> DataFrame:
    """Routes of a streaming ``cases(question, answer, contexts, ...)``."""
    return evaluate(cases, **options)


def route_counts(scored: DataFrame, time: str, every: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """Cases by window and route; windows close when the watermark passes them."""
    return scored.withWatermark(time, late).groupBy(F.window(time, every), "route").agg(F.count(F.lit(1)).alias("cases"))
