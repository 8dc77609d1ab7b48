"""The rules that a table of aligned samples has to keep, each as what breaks it: one pass over the samples, one row a rule."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.selection import first_errors
from ..operators.sequences import finite


def _flat(c: Column, depth: int) -> Column:
    return F.flatten(c) if depth == 2 else c


def shape_breaks(c: Column, shape: Sequence[int]) -> Column:
    """Whether an array of one or two dimensions is null or not of this shape."""
    wrong = F.size(c) != shape[0]
    return F.coalesce(wrong | F.exists(c, lambda v: F.coalesce(F.size(v) != shape[1], F.lit(True))) if len(shape) == 2 else wrong, F.lit(True))


def value_breaks(c: Column, depth: int, bad: str) -> Column:
    """Whether any number in an array is bad: not finite, no flag, or negative. What has no values breaks nothing."""
    test = {"finite": lambda x: ~finite(x), "flag": lambda x: ~F.coalesce(x.cast("double").isin(0.0, 1.0), F.lit(False)), "negative": lambda x: x.cast("double") < 0}[bad]
    return F.coalesce(F.exists(_flat(c, depth), test), F.lit(False))


def sample_rules(dims: dict[str, int], bins: int, auxiliary: dict[str, int]) -> dict[str, tuple[list[str], Column]]:
    """Rule -> (the columns it needs, what breaks it) for each sample."""
    c, out = F.col, {}
    for name, dim in dims.items():
        out[f"{name}_shape"] = ([name], shape_breaks(c(name), (bins, dim)))
        out[f"{name}_finite"] = ([name], value_breaks(c(name), 2, "finite"))
        out[f"{name}_mask_shape"] = ([f"{name}_mask"], shape_breaks(c(f"{name}_mask"), (bins,)))
        out[f"{name}_mask_flags"] = ([f"{name}_mask"], value_breaks(c(f"{name}_mask"), 1, "flag"))
    for name, bad in (("text_reliable_mask", ("flag",)), ("text_low_confidence_mask", ("flag",)), ("text_confidence", ("finite",)), ("vision_quality_aligned", ("finite", "negative")), ("vision_weight_sum", ("finite", "negative"))):
        out[f"{name}_shape"] = ([name], shape_breaks(c(name), (bins,)))
        for b in bad:
            out[f"{name}_{b}"] = ([name], value_breaks(c(name), 1, b))
    for name, dim in auxiliary.items():
        shape = (bins, dim) if dim > 1 else (bins,)
        out[f"{name}_shape"] = ([name], shape_breaks(c(name), shape))
        out[f"{name}_finite"] = ([name], value_breaks(c(name), len(shape), "finite"))
    grid, first, last = c("time_grid"), F.get(F.get("time_grid", F.lit(0)), F.lit(0)), F.get(F.element_at("time_grid", -1), F.lit(1))
    near = F.exists(F.sequence(F.lit(1), F.greatest(F.size(grid) - 1, F.lit(1))), lambda i: F.coalesce(F.get(F.get(grid, i), F.lit(0)) < F.get(F.get(grid, i - 1), F.lit(0)), F.lit(False)))
    rules = {
        "grid_shape": shape_breaks(grid, (bins, 2)), "grid_finite": value_breaks(grid, 2, "finite"),
        "grid_reversed": F.coalesce(F.exists(grid, lambda v: F.coalesce(F.get(v, F.lit(1)) < F.get(v, F.lit(0)), F.lit(False))), F.lit(False)), "grid_order": F.coalesce(near, F.lit(False)), "grid_start": F.coalesce(F.abs(first) > 1e-6, F.lit(False)),
    }
    out |= {name: (["time_grid"], broken) for name, broken in rules.items()}
    out["grid_range"] = (["time_grid", "duration_alignment"], F.coalesce((first < -1e-6) | (last > c("duration_alignment") + 1e-4), F.lit(False)))
    for name in ("duration", "duration_alignment"):
        out[f"{name}_finite"] = ([name], ~finite(c(name)))
    out["semantic_flag"] = (["text_semantic_available"], ~F.coalesce(c("text_semantic_available").isin(0, 1), F.lit(False)))
    out["score_range"] = (["alignment_score"], c("alignment_score").isNotNull() & ~F.coalesce(finite(c("alignment_score")) & c("alignment_score").between(0, 1), F.lit(False)))
    out["joint_support_range"] = (["joint_support_bins"], ~F.coalesce(c("joint_support_bins").between(0, bins), F.lit(False)))
    out["alignment_status"] = (["alignment_status"], c("alignment_status").isNull())
    out["incomplete"] = (["status"], ~c("status").eqNullSafe(F.lit("complete")))
    out["no_failure_reason"] = (["status", "failure_reason"], ~c("status").eqNullSafe(F.lit("complete")) & (F.coalesce(c("failure_reason"), F.lit("")) == ""))
    return out


def validate_samples(samples: DataFrame, key: str, dims: dict[str, int], bins: int, auxiliary: dict[str, int], *, expected: int | None = None, manifest: DataFrame | None = None, strict: bool = True, most: int = 10) -> DataFrame:
    """(rule, severity, errors, examples) of every rule that is broken; a table without a fault gives no rows.

    errors counts samples (of a missing column or a wrong number of samples: 1, or by how many it is off), examples are the smallest keys, joined by commas. Incomplete
    samples are errors if strict, else warnings. manifest (key) has to name each sample once, and no other.
    """
    spark = samples.sparkSession
    rules = sample_rules(dims, bins, auxiliary)
    there = set(samples.columns)
    gone = sorted({n for needed, _ in rules.values() for n in needed if n not in there})
    live = {name: broken for name, (needed, broken) in rules.items() if there.issuperset(needed)}
    names = F.array_compact(F.array(*[F.when(F.coalesce(broken, F.lit(False)), name) for name, broken in live.items()]))
    broken = samples.select(F.col(key).cast("string").alias("k"), F.explode(names).alias("rule"))
    each = samples.groupBy(F.col(key).cast("string").alias("k")).agg(F.count("*").alias("n"))
    broken = broken.union(each.where("n > 1 OR k IS NULL").select("k", F.lit("unique_key").alias("rule")))
    if manifest is not None:
        listed = manifest.groupBy(F.col(key).cast("string").alias("k")).agg(F.count("*").alias("m"))
        broken = broken.union(each.join(listed, "k", "full").where("NOT coalesce(n, 0) <=> coalesce(m, 0)").select("k", F.lit("manifest").alias("rule")))
    found = first_errors(broken, "rule", "k", most).withColumnRenamed("keys", "examples")
    alone = [(f"missing_{n}", 1, "") for n in gone] + [("deprecated_text_bert", 1, "")] * ("text_bert" in there)
    whole = spark.createDataFrame(alone, "rule string, errors long, examples string")
    if expected is not None:
        whole = whole.union(each.agg(F.abs(F.coalesce(F.sum("n"), F.lit(0)) - expected).alias("errors")).where("errors > 0").select(F.lit("sample_count"), "errors", F.lit("")))
    severity = F.when((F.col("rule") == "incomplete") & F.lit(not strict), "warning").otherwise("error")
    return found.unionByName(whole).select("rule", severity.alias("severity"), "errors", "examples")
