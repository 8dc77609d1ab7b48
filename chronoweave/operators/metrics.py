"""Classification and regression metrics, and the scores that rank scenarios, as grouped aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .sequences import finite

CLASSES = (0, 1, 2)


def confusion(rows: DataFrame, true: str, predicted: str, by: list[str] | None = None) -> DataFrame:
    """Dense counts of all class pairs (out-of-range classes ignored): one conditional count a cell, in one aggregation."""
    by = by or []
    cells = [F.count_if((F.col(true) == t) & (F.col(predicted) == p)).alias(f"_{t}_{p}") for t in CLASSES for p in CLASSES]
    wide = rows.groupBy(*by).agg(*cells)
    flat = F.explode(F.array(*[F.struct(F.lit(t).alias("true_class"), F.lit(p).alias("predicted_class"), F.col(f"_{t}_{p}").alias("count")) for t in CLASSES for p in CLASSES]))
    return wide.select(*by, flat.alias("c")).select(*by, "c.*")


def pearson(x: str, y: str) -> Column:
    """Correlation of the pairs that are finite, null for under two of them or no variance."""
    both = finite(x) & finite(y)
    a, b = F.when(both, F.col(x)), F.when(both, F.col(y))
    return F.when(F.count_if(both) >= 2, F.try_divide(F.covar_pop(a, b), F.nullif(F.stddev_pop(a) * F.stddev_pop(b), F.lit(0.0))))


def classification(rows: DataFrame, true: str, predicted: str, value: str, estimate: str, by: list[str] | None = None) -> DataFrame:
    """n, accuracy, macro and weighted F1, F1 of each class, mean absolute error, correlation and composite score."""
    t, p = F.col(true), F.col(predicted)
    sums = []
    for c in CLASSES:
        sums += [F.count_if((t == c) & (p == c)).alias(f"_tp{c}"), F.count_if(t == c).alias(f"_s{c}"), F.count_if(p == c).alias(f"_p{c}")]
    wide = rows.groupBy(*(by or [])).agg(F.count("*").alias("n"), F.avg((t == p).cast("int")).alias("accuracy"), F.avg(F.abs(F.col(value) - F.col(estimate))).alias("mae"), pearson(value, estimate).alias("pearson"), *sums)
    f1 = [F.coalesce(F.try_divide(2.0 * F.col(f"_tp{c}"), F.col(f"_s{c}") + F.col(f"_p{c}")), F.lit(0.0)) for c in CLASSES]
    wide = wide.withColumns({f"f1_{c}": f1[c] for c in CLASSES})
    macro = (F.col("f1_0") + F.col("f1_1") + F.col("f1_2")) / 3
    weighted = sum((F.col(f"f1_{c}") * F.col(f"_s{c}") for c in CLASSES), F.lit(0.0)) / F.greatest(F.col("n"), F.lit(1))
    wide = wide.withColumn("macro_f1", macro).withColumn("weighted_f1", weighted)
    composite = (F.col("accuracy") + F.col("macro_f1") + (1 - F.col("mae") / 6) + (F.col("pearson") + 1) / 2) / 4
    return wide.select(*(by or []), "n", "accuracy", "macro_f1", "weighted_f1", "mae", "pearson", "f1_0", "f1_1", "f1_2", composite.alias("composite"))


def priority(metrics: DataFrame) -> DataFrame:
    """One row: 0.45 complete macro F1 + 0.30 mean masked macro F1 + 0.15 complete neutral F1 + 0.10 least macro F1 at the largest fraction."""
    top = metrics.agg(F.max("fraction").alias("_top"))
    joined = metrics.crossJoin(F.broadcast(top))  # one row
    complete, masked = F.col("scenario") == "complete", F.col("scenario") != "complete"
    parts = joined.agg(
        F.max(F.when(complete, F.col("macro_f1"))).alias("complete_f1"), F.avg(F.when(masked, F.col("macro_f1"))).alias("masked_f1"),
        F.max(F.when(complete, F.col("f1_1"))).alias("neutral_f1"), F.min(F.when(masked & (F.col("fraction") == F.col("_top")), F.col("macro_f1"))).alias("stress_f1"),
    )
    return parts.withColumn("priority", 0.45 * F.col("complete_f1") + 0.30 * F.col("masked_f1") + 0.15 * F.col("neutral_f1") + 0.10 * F.col("stress_f1"))


def class_weights(rows: DataFrame, label: str, classes: tuple[int, ...], mode: str) -> DataFrame:
    """(class, n, weight): inverse, square-root inverse or effective-number weights, divided by their mean."""
    counts = rows.agg(*[F.greatest(F.count_if(F.col(label) == c), F.lit(1)).alias(f"_{c}") for c in classes])
    each = counts.select(F.explode(F.array(*[F.struct(F.lit(c).alias("class"), F.col(f"_{c}").alias("n")) for c in classes])).alias("x")).select("x.*")
    n = F.col("n").cast("double")
    raw = {"inverse": 1 / n, "sqrt_inverse": 1 / F.sqrt(n), "effective": (1 - 0.9999) / (1 - F.pow(F.lit(0.9999), n))}[mode]
    total = each.agg(F.avg(raw).alias("_mean"))
    return each.crossJoin(F.broadcast(total)).select("class", "n", (raw / F.col("_mean")).alias("weight"))  # one row
