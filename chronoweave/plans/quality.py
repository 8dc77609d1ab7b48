"""From spans to a quality report: pool, make dense, scale, score, summarise."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import sequences


def quality_report(spans: DataFrame, sample: str, channel: str, start: str, stop: str, value: str, channels: list[str], *, duration: float, bins: int = 50) -> DataFrame:
    """(status, n, mean, median, p10, p90, least, largest) of the samples' agreement scores; channels: those of confidence, activity and quality."""
    pooled = sequences.overlap_pool(spans, [sample, channel], start, stop, value, duration=duration, bins=bins)
    wide = sequences.support(pooled, sample, channel, *channels)
    return sequences.finite_summary(sequences.agreement(wide, sample, tuple(F.col(c) for c in channels)), "score", ["status"])
