"""Intervals and frames in time: validity at stored precision, clean-up, order and gaps.

Row-wise rules are column expressions; the two that look back use one window over a sample.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .sequences import finite


def clip_interval(start: Column, stop: Column, duration: Column) -> tuple[Column, Column]:
    """Both ends within [0, duration], in ascending order; an end that is NaN stays so, and in its place."""
    top = F.greatest(duration, F.lit(0.0))
    a, b = (F.when(F.isnan(c), c).otherwise(F.least(F.greatest(c, F.lit(0.0)), top)) for c in (start, stop))
    turned = ~F.isnan(a) & ~F.isnan(b) & (b < a)
    return F.when(turned, b).otherwise(a), F.when(turned, a).otherwise(b)


def stored_interval(start: Column, stop: Column, duration: Column, least: float = 0.0) -> Column:
    """struct(start, stop) as single precision stores them, null where they are not finite, empty, out of range or shorter than least."""
    a, b, top = (c.cast("float").cast("double") for c in (start, stop, F.greatest(duration, F.lit(0.0))))
    valid = finite(a) & finite(b) & (a >= 0) & (b <= top) & (b > a) & (b - a >= least)
    return F.when(valid, F.struct(a.alias("start"), b.alias("stop")))


def clean_chunks(chunks: DataFrame, start: str, stop: str, duration: float, shift: float = 0.0, default: float = 0.05) -> DataFrame:
    """Recogniser chunks on the clip's own time: shifted, missing or reversed ends replaced, those outside dropped, the rest clamped.

    A chunk without a start is dropped. Other columns stay as they are.
    """
    a = F.col(start) - shift
    short = F.least(F.lit(duration), a + default)
    b = F.coalesce(F.col(stop) - shift, short)
    rows = chunks.withColumns({start: a, stop: F.when(b <= a, short).otherwise(b)})
    rows = rows.where((F.col(stop) > 0) & (F.col(start) < duration))
    return rows.withColumns({start: F.greatest(F.lit(0.0), start), stop: F.least(F.lit(duration), stop)})


def usable(valid: Column, start: Column, stop: Column) -> Column:
    """Whether a word's time can be used: marked valid, with both ends."""
    return F.coalesce(valid, F.lit(False)) & start.isNotNull() & stop.isNotNull()


def frame_spans(frames: DataFrame, index: str, duration: Column, rate: float) -> DataFrame:
    """Adds centre, start and stop of frames of a rate within the duration; frames beyond it or without a span are dropped."""
    centre = (F.col(index) + 0.5) / rate
    half = 0.5 / rate
    rows = frames.withColumns({"centre": centre, "start": F.greatest(centre - half, F.lit(0.0)), "stop": F.least(centre + half, duration)})
    return rows.where((F.col("centre") < duration) & (F.col("stop") > F.col("start")))


def order_violations(rows: DataFrame, by: list[str], order: list[str], start: str, stop: str) -> DataFrame:
    """(by..., n, backward, reversed): rows that start before the row ahead of them, and rows that end before they start."""
    before = F.lag(start).over(Window.partitionBy(*by).orderBy(*order))
    return rows.withColumn("_b", before).groupBy(*by).agg(F.count("*").alias("n"), F.count_if(F.col(start) < F.col("_b")).alias("backward"), F.count_if(F.col(stop) < F.col(start)).alias("reversed"))


def continued(rows: DataFrame, by: list[str], order: list[str], place: str, gap: float) -> DataFrame:
    """Adds track, from 0: a row continues the track of the row ahead unless more than gap lies between them."""
    w = Window.partitionBy(*by).orderBy(*order)
    rows = rows.withColumn("_new", F.coalesce((F.col(place) - F.lag(place).over(w) > gap).cast("int"), F.lit(0)))
    return rows.withColumn("track", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")
