"""Choosing between candidates: summaries that describe them and rules that pick one. Grouped aggregates throughout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .sequences import finite


def candidate_summary(samples: DataFrame, records: DataFrame, heard: DataFrame, by: list[str], match: Column, valid: Column, word: Column) -> DataFrame:
    """One row a sample: what a candidate's records (match, valid) and recognised words (word) are like.

    words counts the recognised words, lexical those with a letter or digit; records, fallbacks and their ratio, invalid times, exact and edited
    matches, all matches. A sample without records or words has zeros, so a first try that heard nothing is there to be tried again.
    """
    fallback = match == "fallback"
    made = records.groupBy(*by).agg(
        F.count("*").alias("records"),
        F.count_if(fallback).alias("fallbacks"),
        F.count_if(~F.coalesce(valid, F.lit(False))).alias("invalid"),
        F.count_if(match == "exact").alias("exact"),
        F.count_if(match.isin("edit_distance", "equivalent_compound")).alias("edited"),
    )
    said = heard.groupBy(*by).agg(F.count("*").alias("words"), F.count_if(word.rlike("[A-Za-z0-9]")).alias("lexical"))
    out = samples.select(*by).distinct().join(made, by, "left").join(said, by, "left").fillna(0, ["records", "fallbacks", "invalid", "exact", "edited", "words", "lexical"])
    return out.withColumns({"ratio": F.col("fallbacks") / F.greatest("records", F.lit(1)), "matched": F.col("records") - F.col("fallbacks")})


def retry_gate(first: DataFrame, second: DataFrame, by: list[str], threshold: float = 0.5) -> DataFrame:
    """(by..., retried, retry_wins) of two candidate_summary() frames.

    A second try is asked for if the first falls back too often or heard no lexical word. It wins only if it falls back less,
    has no more invalid times and no fewer matches. Without a second candidate the first stays.
    """
    names = ("fallbacks", "invalid", "matched")
    rows = first.join(second.select(*by, *[F.col(c).alias(f"_{c}") for c in names]), by, "left")
    asked = (F.col("ratio") >= threshold) | (F.col("lexical") == 0)
    better = (F.col("_fallbacks") < F.col("fallbacks")) & (F.col("_invalid") <= F.col("invalid")) & (F.col("_matched") >= F.col("matched"))
    return rows.select(*by, asked.alias("retried"), (asked & F.coalesce(better, F.lit(False))).alias("retry_wins"))


def histogram_text(rows: DataFrame, by: list[str], key: str) -> DataFrame:
    """(by..., histogram): key:count pairs in the order of the keys, joined by semicolons."""
    each = rows.groupBy(*by, key).agg(F.count("*").alias("n"))
    pairs = F.transform(F.array_sort(F.collect_list(F.struct(key, "n"))), lambda p: F.concat_ws(":", p[key], p["n"]))
    return each.groupBy(*by).agg(F.array_join(pairs, ";").alias("histogram"))


def selection_score(metrics: DataFrame, by: list[str]) -> DataFrame:
    """(by..., score): mean composite score; where none is defined, the mean of accuracy, macro F1 and 1 - MAE / 6."""
    composite = F.avg(F.when(finite("composite"), F.col("composite")))
    terms = F.coalesce("accuracy", F.lit(0.0)) + F.coalesce("macro_f1", F.lit(0.0)) + 1 - F.coalesce("mae", F.lit(6.0)) / 6
    return metrics.groupBy(*by).agg(F.coalesce(composite, F.avg(terms / 3)).alias("score"))


def seed_rows(metrics: DataFrame, seed: str, scenario: str, order: str) -> DataFrame:
    """One row of each seed: the complete scenario, else the first by order."""
    rank = F.struct(F.col(scenario) != "complete", order)
    return metrics.groupBy(seed).agg(F.min_by(F.struct(*[c for c in metrics.columns if c != seed]), rank).alias("_r")).select(seed, "_r.*")


def best(rows: DataFrame, score: str, order: str) -> DataFrame:
    """The row of the largest score, the first by order among equals; none of no rows."""
    return rows.orderBy(F.desc_nulls_last(score), F.asc(order)).limit(1)


def best_track(detections: DataFrame, by: list[str], track: str, frame: str, confidence: str) -> DataFrame:
    """(by..., track, n, confidence, first): the longest track; then the most confident; then the one that starts last."""
    each = detections.groupBy(*by, track).agg(F.count("*").alias("n"), F.avg(confidence).alias("confidence"), F.min(frame).alias("first"))
    return each.groupBy(*by).agg(F.max_by(F.struct(track, "n", "confidence", "first"), F.struct("n", "confidence", "first")).alias("_r")).select(*by, "_r.*")


def running_means(batches: DataFrame, by: list[str], size: str, losses: list[str]) -> DataFrame:
    """Losses of batches averaged by their sample counts; no samples give 0."""
    return batches.groupBy(*by).agg(*[(F.sum(F.col(c) * F.col(size)) / F.greatest(F.sum(size), F.lit(1))).alias(c) for c in losses])


def column_means(rows: DataFrame) -> DataFrame:
    """(column, mean) of all numeric columns, in one aggregation."""
    names = [f.name for f in rows.schema.fields if f.dataType.typeName() in ("byte", "short", "integer", "long", "float", "double", "decimal")]
    one = rows.agg(*[F.avg(F.col(f"`{n}`")).cast("double").alias(f"_{i}") for i, n in enumerate(names)])
    return one.select(F.explode(F.array(*[F.struct(F.lit(n).alias("column"), F.col(f"_{i}").alias("mean")) for i, n in enumerate(names)])).alias("m")).select("m.*")


def requested(rows: DataFrame, key: str, ids: list, fallback: str, order: str) -> DataFrame:
    """The rows of the asked ids with their place in the request; unknown ids drop out. If none is known, the row with the largest fallback, the first by order among equals.

    Whether any is known is asked first, so the fallback is looked for only where it is needed. No rows give none.
    """
    spark, kind = rows.sparkSession, rows.schema[key].dataType.simpleString()
    wanted = list(dict.fromkeys(ids))
    if not wanted or rows.where(F.col(key).isin(wanted)).isEmpty():
        return best(rows, fallback, order).withColumn("place", F.lit(0).cast("bigint"))
    asked = spark.createDataFrame([(x, i) for i, x in enumerate(wanted)], f"`{key}` {kind}, place bigint")
    return rows.join(F.broadcast(asked), key).select(*rows.columns, "place")  # as many rows as were asked for


def first_errors(rows: DataFrame, rule: str, key: str, most: int = 10) -> DataFrame:
    """(rule, errors, keys): how many rows break a rule, and the smallest keys of them, at most so many, joined by commas."""
    shown = rows.withColumn("_p", F.row_number().over(Window.partitionBy(rule).orderBy(key))).where(F.col("_p") <= most)
    keys = shown.groupBy(rule).agg(F.array_join(F.array_sort(F.collect_list(key)).cast("array<string>"), ",").alias("keys"))
    return rows.groupBy(rule).agg(F.count("*").alias("errors")).join(keys, rule)


def violations(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """(rule, violations) of row-wise rules, given by what breaks them, in one pass."""
    one = rows.agg(*[F.count_if(F.coalesce(c, F.lit(False))).alias(n) for n, c in rules.items()])
    return one.select(F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.col(n).alias("violations")) for n in rules])).alias("v")).select("v.*")


def prediction_audit(expected: DataFrame, predicted: DataFrame, key: str, scores: list[str]) -> DataFrame:
    """One row: expected and predicted ids, missing, unexpected and repeated ones, rows with a score that is not finite, coverage."""
    each = predicted.groupBy(key).agg(F.count("*").alias("_n"), F.sum((~F.forall(F.array(*scores), finite)).cast("int")).alias("_bad"))
    rows = expected.select(key).distinct().withColumn("_e", F.lit(1)).join(each, key, "full")
    known = F.col("_e").isNotNull()
    out = rows.agg(F.count_if(known).alias("expected"), F.coalesce(F.sum("_n"), F.lit(0)).alias("predicted"), F.count_if(F.col("_n").isNull()).alias("missing"), F.count_if(~known).alias("unexpected"), F.count_if(F.col("_n") > 1).alias("repeated"), F.coalesce(F.sum("_bad"), F.lit(0)).alias("not_finite"))
    return out.withColumn("coverage", (F.col("expected") - F.col("missing")) / F.greatest("expected", F.lit(1)))


def only(rows: DataFrame, key: str, value: object) -> DataFrame:
    """The rows of one key; ValueError if there are none."""
    found = rows.where(F.col(key) == value)
    if found.isEmpty():
        raise ValueError(f"no row has {key} {value}")
    return found


def within(value: Column, low: float, high: float, tolerance: float = 1e-4) -> Column:
    """Whether a value lies between two bounds, give or take the tolerance; null and NaN don't."""
    return F.coalesce(finite(value) & (value >= low - tolerance) & (value <= high + tolerance), F.lit(False))
