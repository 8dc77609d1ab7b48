"""Predictions of unlabelled samples as one sink: a prediction table, an audit table and a manifest."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import natural_key
from ..operators import evaluation as E
from ..operators.sequences import finite
from .runs import Files

CLASSES = ("Negative", "Neutral", "Positive")


def in_file_order(samples: DataFrame, file: str, row: str) -> DataFrame:
    """Adds row_index: the place of a row among all, files in natural order, rows by their place in the file. Offsets are sums over the files' sizes, one row a file; no sort of the rows."""
    sizes = samples.groupBy(file).agg(F.count("*").alias("_n"))
    before = Window.partitionBy(F.lit(0)).orderBy(natural_key(F.col(file)), file).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(file, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_at"))
    inside = Window.partitionBy(file).orderBy(row)
    return samples.withColumn("_i", F.row_number().over(inside) - 1).join(offsets, file).withColumn("row_index", F.col("_at") + F.col("_i")).drop("_i", "_at")


def prediction_tables(samples: DataFrame, scorer: E.Scorer, channels: list[str], *, key: str = "id", file: str = "source_file", row: str = "source_row", how: str = "id_source", features: str = "features", masks: str = "masks") -> tuple[DataFrame, DataFrame]:
    """(row_index, id, predicted_annotation, prob_..., predicted_intensity) and the audit (row_index, id, source_file, id_source, a coverage a channel, all_unavailable, max_probability, nonfinite_output).

    Samples are scored once; keys may repeat. Numbers that aren't finite are null (NA in the files).
    """
    rows = in_file_order(samples, file, row)
    scored = E.predict(rows, scorer, len(channels), key="row_index", features=features, masks=masks)
    both = rows.select("row_index", F.col(key).cast("string").alias("id"), F.col(file).alias("source_file"), F.col(how).alias("id_source")).join(scored, "row_index")
    known = lambda c: F.when(finite(c), c)
    name = F.element_at(F.array(*[F.lit(c) for c in CLASSES]), F.col("predicted") + 1)
    made = both.select("row_index", "id", name.alias("predicted_annotation"), *[known(F.col("probabilities")[i]).alias(f"prob_{c.lower()}") for i, c in enumerate(CLASSES)], known(F.col("intensity")).alias("predicted_intensity"))
    whole = F.forall("probabilities", finite) & finite("intensity")
    audit = both.select("row_index", "id", "source_file", "id_source", *[F.col("coverage")[i].alias(f"{c}_coverage") for i, c in enumerate(channels)], F.col("unavailable").alias("all_unavailable"), F.when(whole, F.array_max("probabilities")).alias("max_probability"), (~whole).alias("nonfinite_output"))
    return made, audit


def manifest_of(made: DataFrame, audit: DataFrame, file_hashes: DataFrame | None = None, extra: dict | None = None) -> dict:
    """What the tables are like: counts and, of input files (file, found), their hashes. Ids stay in the tables."""
    n = audit.agg(F.count("*").alias("n"), F.count_distinct("id").alias("ids"), F.count_if("all_unavailable").alias("gone"), F.count_if("nonfinite_output").alias("odd"), F.count_distinct("source_file").alias("files")).first()
    classes = {r["predicted_annotation"]: r["count"] for r in made.groupBy("predicted_annotation").count().toLocalIterator()}
    out = {"sample_count": n["n"], "id_coverage": n["n"] == n["ids"], "input_file_count": n["files"], "input_order": "natural filename order", "all_unavailable_count": n["gone"], "nonfinite_output_count": n["odd"], "predicted_counts": dict(sorted(classes.items()))}
    if file_hashes is not None:
        out["input_file_sha256"] = {r["file"]: r["found"] for r in file_hashes.orderBy("file").toLocalIterator()}
    return out | {"label_metrics": "not computed: the samples have no labels"} | (extra or {})


def write_predictions(samples: DataFrame, scorer: E.Scorer, channels: list[str], folder: str, *, file_hashes: DataFrame | None = None, extra: dict | None = None, **columns: str) -> dict:
    """Write predictions and audit as CSV (NA for what is null), and inference_manifest.json last, so that a folder with a manifest is whole. Gives the manifest."""
    spark = samples.sparkSession
    made, audit = prediction_tables(samples, scorer, channels, **columns)
    for frame, name in ((made, "predictions"), (audit, "audit")):
        frame.write.option("header", "true").option("nullValue", "NA").mode("error").csv(f"{folder}/{name}")
    kept = [spark.read.option("header", "true").option("nullValue", "NA").schema(f.schema).csv(f"{folder}/{n}") for f, n in ((made, "predictions"), (audit, "audit"))]
    found = manifest_of(*kept, file_hashes, extra)
    Files(spark, folder).put("inference_manifest.json", json.dumps(found, ensure_ascii=False, indent=2))
    return found


def unwrapped(rows: DataFrame, envelope: str = "test") -> DataFrame:
    """What an envelope holds, if the rows have one: the fields of a struct column of that name, else the rows as they are."""
    kinds = dict(rows.dtypes)
    return rows.select(f"`{envelope}`.*") if kinds.get(envelope, "").startswith("struct<") else rows

