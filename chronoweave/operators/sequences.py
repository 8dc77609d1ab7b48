"""Span sequences on a common grid: pooling, masks, masked statistics, runs, agreement.

Long form throughout: one row a (sample, channel, bin). Everything is built-in expressions, so a plan is a scan,
one exchange by sample and generated code; sparse bins become dense only where a mask asks for them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TINY = 1e-12


def finite(c: Column | str) -> Column:
    """Neither null, nor NaN, nor infinite."""
    c = (F.col(c) if isinstance(c, str) else c).cast("double")
    return F.coalesce(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), F.lit(False))


def grid_edges(k: Column, duration: float, bins: int) -> tuple[Column, Column]:
    """[k D / K, (k + 1) D / K)."""
    width = max(duration, 0.0) / bins
    return k * F.lit(width), (k + 1) * F.lit(width)


def overlap_pool(spans: DataFrame, by: list[str], start: str, stop: str, value: str, quality: Column | None = None, *, duration: float, bins: int) -> DataFrame:
    """(by..., bin, value, weight): values averaged by the share of each span that falls into each bin.

    A span reaches only the bins between its ends, so it is exploded to these: an equi-aggregation, not an
    interval join. Spans that are null, empty or reversed, and spans, values and qualities that aren't finite, weigh nothing.
    """
    width = duration / bins
    s, e, q = F.col(start), F.col(stop), quality if quality is not None else F.lit(1.0)
    first = F.greatest(F.floor(s / width), F.lit(0))
    last = F.least(F.ceil(e / width) - 1, F.lit(bins - 1))
    valid = (e > s) & (e > 0) & (s < duration) & finite(s) & finite(e) & finite(q) & finite(value)
    each = spans.where(valid).withColumn("bin", F.explode(F.sequence(first, last)))
    low, high = F.col("bin") * width, (F.col("bin") + 1) * width
    each = each.withColumn("_w", q * F.greatest(F.least(e, high) - F.greatest(s, low), F.lit(0.0)) / F.greatest(e - s, F.lit(TINY))).where("_w > 0")
    pooled = each.groupBy(*by, F.col("bin").cast("int").alias("bin")).agg(F.sum(F.col("_w") * F.col(value)).alias("_x"), F.sum("_w").alias("weight"))
    return pooled.select(*by, "bin", (F.col("_x") / F.col("weight")).alias("value"), "weight")


def dense(pooled: DataFrame, samples: DataFrame, channels: list[str], sample: str, channel: str, bins: int) -> DataFrame:
    """Every (sample, channel, bin) with its mask; bins without support have value and weight 0.

    The frame is larger than what it is made from, and by that it would pass for small enough to be broadcast: the join is one of sorted sides.
    """
    frame = samples.select(sample).distinct().withColumn(channel, F.explode(F.array(*[F.lit(c) for c in channels]))).withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    joined = frame.hint("merge").join(pooled, [sample, channel, "bin"], "left")
    return joined.select(sample, channel, "bin", F.col("weight").isNotNull().alias("mask"), F.coalesce("value", F.lit(0.0)).alias("value"), F.coalesce("weight", F.lit(0.0)).alias("weight"))


def masked_zscore(pooled: DataFrame, channel: str, value: str, eps: float = 1e-6) -> DataFrame:
    """Adds z: (value - mean) / population deviation over the valid rows of a channel; a deviation up to eps counts as 1."""
    stats = pooled.groupBy(channel).agg(F.avg(value).alias("_m"), F.stddev_pop(value).alias("_s"))
    scaled = F.when(F.col("_s") > eps, F.col("_s")).otherwise(1.0)
    return pooled.join(stats, channel).withColumn("z", (F.col(value) - F.col("_m")) / scaled).drop("_m", "_s")


def fit_normalization(vectors: DataFrame, vector: str, train: Column, eps: float = 1e-6) -> DataFrame:
    """(dim, mean, std, n) of the training rows' finite coordinates."""
    each = vectors.where(train).select(F.posexplode(vector).alias("dim", "x")).where(finite("x"))
    stats = each.groupBy("dim").agg(F.avg(F.col("x").cast("double")).alias("mean"), F.stddev_pop(F.col("x").cast("double")).alias("_s"), F.count("*").alias("n"))
    return stats.select("dim", "mean", F.when(F.col("_s") > eps, F.col("_s")).otherwise(1.0).alias("std"), "n")


def transform_normalization(vectors: DataFrame, key: str, vector: str, stats: DataFrame) -> DataFrame:
    """(key, dim, z) of all rows by fitted statistics: one row a dimension, so the join's small side stays small. What isn't finite becomes 0."""
    each = vectors.select(key, F.posexplode(vector).alias("dim", "x"))
    z = (F.col("x").cast("double") - F.col("mean")) / F.col("std")
    return each.join(stats, "dim").select(key, "dim", F.when(finite("x"), z).otherwise(0.0).alias("z"))


def unit_interval(rows: DataFrame, by: list[str], value: str, low: float = 0.1, high: float = 0.9) -> DataFrame:
    """Adds unit: value between the two quantiles of its group, clipped to [0, 1]; a degenerate group is 1."""
    q = rows.groupBy(*by).agg(F.percentile(value, F.array(F.lit(low), F.lit(high))).alias("_q"))
    lo, hi = F.col("_q")[0], F.col("_q")[1]
    unit = F.when(hi <= lo + 1e-8, 1.0).otherwise(F.least(F.greatest((F.col(value) - lo) / F.nullif(hi - lo, F.lit(0.0)), F.lit(0.0)), F.lit(1.0)))
    return rows.join(q, by).withColumn("unit", unit).drop("_q")


def runs(rows: DataFrame, by: list[str], position: str, keep: Column) -> DataFrame:
    """(by..., start, stop): maximal stretches of consecutive positions that hold keep; stop is exclusive."""
    order = Window.partitionBy(*by).orderBy(position)
    kept = rows.where(keep).withColumn("_island", F.col(position) - F.row_number().over(order))
    return kept.groupBy(*by, "_island").agg(F.min(position).alias("start"), (F.max(position) + 1).alias("stop")).drop("_island")


def sequence_statistics(rows: DataFrame, by: list[str], position: str, value: str) -> DataFrame:
    """mean, deviation (variance at least 1e-8), max, first, last and mean step between neighbouring valid positions."""
    order = Window.partitionBy(*by).orderBy(position)
    step = F.when(F.col(position) - F.lag(position).over(order) == 1, F.col(value) - F.lag(value).over(order))
    return rows.withColumn("_d", step).groupBy(*by).agg(
        F.avg(value).alias("mean"), F.sqrt(F.greatest(F.var_pop(value), F.lit(1e-8))).alias("std"), F.max(value).alias("max"),
        F.min_by(value, position).alias("first"), F.max_by(value, position).alias("last"), F.coalesce(F.avg("_d"), F.lit(0.0)).alias("mean_step"), F.count("*").alias("n"),
    )


def support(pooled: DataFrame, sample: str, channel: str, confidence: str, activity: str, quality: str) -> DataFrame:
    """(sample, bin, confidence, activity, quality): how far the three channels of these names support each bin, from 0 to 1.

    The first and the third by their weight; the second half by its value between the sample's own 10th and 90th percentile, half by its weight.
    """
    clipped = F.least(F.greatest(F.col("weight"), F.lit(0.0)), F.lit(1.0))
    second = unit_interval(pooled.where(F.col(channel) == activity).withColumn("_level", F.greatest("value", F.lit(0.0))), [sample], "_level")
    parts = pooled.where(F.col(channel).isin(confidence, quality)).select(sample, "bin", channel, clipped.alias("_s"))
    parts = parts.unionByName(second.select(sample, "bin", channel, (0.5 * F.col("unit") + 0.5 * clipped).alias("_s")))
    return parts.groupBy(sample, "bin").agg(*[F.coalesce(F.max(F.when(F.col(channel) == c, F.col("_s"))), F.lit(0.0)).alias(c) for c in (confidence, activity, quality)])


def agreement(bins: DataFrame, sample: str, channels: tuple[Column, ...], joint_needed: int = 3) -> DataFrame:
    """Fuzzy Jaccard agreement of channel activities: sum of minima over sum of maxima, joint bins and status of each sample."""
    low, high = F.least(*channels), F.greatest(*channels)
    sums = bins.groupBy(sample).agg(F.sum(low).alias("_i"), F.sum(high).alias("_u"), F.count_if(low > 1e-8).alias("joint_bins"), F.count_if(high > 1e-8).alias("_any"))
    score = F.when(F.col("_any") > 0, F.least(F.greatest(F.col("_i") / (F.col("_u") + 1e-8), F.lit(0.0)), F.lit(1.0)))
    status = F.when(F.col("_any") == 0, "no_modality_support").when(F.col("joint_bins") >= joint_needed, "ok").otherwise("insufficient_joint_support")
    return sums.select(sample, score.alias("score"), "joint_bins", status.alias("status"))


def finite_summary(rows: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """count, mean, median, 10th and 90th percentile, least and largest of finite values."""
    rows = rows.where(finite(value))
    q = F.percentile(value, F.array(F.lit(0.5), F.lit(0.1), F.lit(0.9)))
    out = rows.groupBy(*(by or [])).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), q.alias("_q"), F.min(value).alias("least"), F.max(value).alias("largest"))
    return out.select(*(by or []), "n", "mean", F.col("_q")[0].alias("median"), F.col("_q")[1].alias("p10"), F.col("_q")[2].alias("p90"), "least", "largest")


def as_of(left: DataFrame, right: DataFrame, by: list[str], time: str, value: str, *, forward: bool = False) -> DataFrame:
    """left with the value of the last right row at or before its time (forward: the first at or after).

    Union and a running last value: one sort by (by, time), no interval join.
    """
    both = left.withColumn("_v", F.lit(None).cast(right.schema[value].dataType)).withColumn("_left", F.lit(1)).unionByName(
        right.select(*by, time, F.col(value).alias("_v")).withColumn("_left", F.lit(0)), allowMissingColumns=True)
    keys = [F.col(time).desc() if forward else F.col(time).asc(), F.col("_left").asc()]
    order = Window.partitionBy(*by).orderBy(*keys).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return both.withColumn(value, F.last("_v", ignorenulls=True).over(order)).where("_left = 1").drop("_v", "_left")
