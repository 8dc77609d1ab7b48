"""Training objectives as aggregates over tables of logits, probabilities and values: one pass, or one join of two views of the same samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _sum(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)


def log_softmax(logits: Column, temperature: float = 1.0) -> Column:
    """Logarithms of the class probabilities of an array of logits."""
    scaled = F.transform(logits, lambda v: v.cast("double") / temperature)
    top = F.array_max(scaled)
    rest = top + F.log(_sum(F.transform(scaled, lambda v: F.exp(v - top))))
    return F.transform(scaled, lambda v: v - rest)


def softmax(logits: Column, temperature: float = 1.0) -> Column:
    return F.transform(log_softmax(logits, temperature), F.exp)


def huber(value: Column, target: Column, delta: float = 1.0) -> Column:
    gap = F.abs(value - target)
    return F.when(gap <= delta, 0.5 * gap * gap).otherwise(delta * (gap - 0.5 * delta))


def supervised(rows: DataFrame, logits: str, intensity: str, label: str, target: str, by: Sequence[str] = (), *, weights: Sequence[float] | None = None, smoothing: float = 0.0, focus: float = 0.0, neutral: str | None = None, regression: float = 1.0, consistency: float = 0.05, neutral_share: float = 0.0) -> DataFrame:
    """(by..., n, total, cross_entropy, huber, consistency, neutral) of labelled rows.

    Cross entropy is smoothed and weighted by class: without focus its sum over that of the weights, with focus the mean of (1 - exp(-ce)) ** focus times weight times ce, ce
    unweighted. Consistency is the square of p(last) - p(first) - intensity / 3. Neutral is the binary cross entropy of a logit for class 1. Rows without a label,
    logits, intensity or target are left out.
    """
    size = F.size(logits)
    own = F.array(*[F.lit(float(w)) for w in weights]) if weights else F.array_repeat(F.lit(1.0), size)
    logs = log_softmax(F.col(logits))
    share = F.lit(float(smoothing)) / size
    rows = rows.where(F.col(label).isNotNull() & F.col(logits).isNotNull() & F.col(intensity).isNotNull() & F.col(target).isNotNull()).withColumns({"_l": logs, "_w": own})
    picked, weight = F.get("_l", F.col(label)), F.get("_w", F.col(label))
    if focus > 0:
        plain = -(1 - smoothing) * picked - share * _sum(F.col("_l"))
        entropy, over = F.pow(1 - F.exp(-plain), F.lit(float(focus))) * plain * weight, F.lit(1.0)
    else:
        entropy, over = -(1 - smoothing) * weight * picked - share * _sum(F.zip_with("_l", "_w", lambda a, b: a * b)), weight
    lean = F.exp(F.element_at("_l", -1)) - F.exp(F.get("_l", F.lit(0))) - F.col(intensity) / 3
    x = F.col(neutral) if neutral else F.lit(0.0)
    aside = F.greatest(x, F.lit(0.0)) - F.when(F.col(label) == 1, x).otherwise(0.0) + F.log1p(F.exp(-F.abs(x))) if neutral and neutral_share > 0 else F.lit(0.0)
    sums = rows.groupBy(*by).agg(F.count("*").alias("n"), (F.sum(entropy) / F.sum(over)).alias("cross_entropy"), F.avg(huber(F.col(intensity), F.col(target))).alias("huber"), F.avg(lean * lean).alias("consistency"), F.avg(aside).alias("neutral"))
    total = F.col("cross_entropy") + regression * F.col("huber") + consistency * F.col("consistency") + neutral_share * F.col("neutral")
    return sums.select(*by, "n", total.alias("total"), "cross_entropy", "huber", "consistency", "neutral")


def distillation(teacher: DataFrame, student: DataFrame, key: str, logits: str, intensity: str, *, temperature: float = 2.0, regression: float = 0.0, gated: bool = True, threshold: float = 0.70, scale: float = 0.30) -> DataFrame:
    """One row (n, total, kl, huber, confidence, gate): how far a student's view of samples is from the teacher's, samples joined by key.

    A sample counts by how sure the teacher is: (largest probability - threshold) / scale, cut to [0, 1]; ungated, each counts as one. The divergence is of softened probabilities,
    times the square of the temperature. Samples of one side alone are left out.
    """
    t = max(float(temperature), 1e-3)
    left = teacher.select(F.col(key).alias("_k"), F.col(logits).alias("_a"), F.col(intensity).alias("_x"))
    both = left.join(student.select(F.col(key).alias("_k"), F.col(logits).alias("_b"), F.col(intensity).alias("_y")), "_k")
    sure = F.array_max(softmax(F.col("_a")))
    gate = F.least(F.greatest((sure - threshold) / max(float(scale), 1e-6), F.lit(0.0)), F.lit(1.0)) if gated else F.lit(1.0)
    both = both.withColumns({"_p": log_softmax(F.col("_a"), t), "_q": log_softmax(F.col("_b"), t), "_c": sure, "_g": gate})
    kl = _sum(F.zip_with("_p", "_q", lambda p, q: F.exp(p) * (p - q))) * t * t
    norm = F.greatest(F.sum("_g"), F.lit(1e-6))
    sums = both.agg(F.count("*").alias("n"), (F.sum(kl * F.col("_g")) / norm).alias("kl"), (F.sum(huber(F.col("_y"), F.col("_x")) * F.col("_g")) / norm).alias("huber"), F.avg("_c").alias("confidence"), F.avg("_g").alias("gate"))
    return sums.select("n", (F.col("kl") + regression * F.col("huber")).alias("total"), "kl", "huber", "confidence", "gate")


def representation(native: DataFrame, masked: DataFrame, key: str, vector: str, chosen: Column | None = None) -> DataFrame:
    """One row (n, loss): mean squared difference of the coordinates of two views of the chosen samples, 0 without any."""
    both = native.select(F.col(key).alias("_k"), F.col(vector).alias("_a"), (chosen if chosen is not None else F.lit(True)).alias("_c")).where("_c").join(masked.select(F.col(key).alias("_k"), F.col(vector).alias("_b")), "_k")
    gap = _sum(F.zip_with("_a", "_b", lambda a, b: (a.cast("double") - b.cast("double")) * (a.cast("double") - b.cast("double"))))
    return both.agg(F.count("*").alias("n"), F.coalesce(F.try_divide(F.sum(gap), F.sum(F.size("_a"))), F.lit(0.0)).alias("loss"))


def reconstruction(rows: DataFrame, made: str, wanted: str, missing: str, channel: str | None = None) -> DataFrame:
    """One row (n, loss): mean squared error of the numbers in steps that were taken away (missing: a flag a step), over all rows and channels; 0 without any. made and wanted are steps of vectors."""
    own = rows.where(F.col(channel).isNotNull()) if channel else rows
    square = F.zip_with(made, wanted, lambda a, b: _sum(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))))
    error = _sum(F.zip_with(square, missing, lambda s, m: F.when(m, s).otherwise(0.0)))
    count = F.aggregate(F.zip_with(wanted, missing, lambda v, m: F.when(m, F.size(v)).otherwise(0)), F.lit(0), lambda a, v: a + v)
    return own.agg(F.sum(count).alias("n"), F.coalesce(F.try_divide(F.sum(error), F.sum(count)), F.lit(0.0)).alias("loss"))


def auxiliary(rows: DataFrame, logits: str, label: str, available: str | None = None) -> DataFrame:
    """One row (n, loss): mean cross entropy of each channel's own logits (an array a channel), over the channels that a sample has; 0 without any."""
    each = F.transform(logits, lambda x: -F.get(log_softmax(x), F.col(label)))
    flags = F.col(available) if available else F.transform(logits, lambda x: F.lit(True))
    error = _sum(F.zip_with(each, flags, lambda e, a: F.when(a, e).otherwise(0.0)))
    count = F.aggregate(flags, F.lit(0), lambda s, a: s + a.cast("int"))
    return rows.agg(F.sum(count).alias("n"), (F.coalesce(F.sum(error), F.lit(0.0)) / F.greatest(F.coalesce(F.sum(count), F.lit(0)), F.lit(1))).alias("loss"))
