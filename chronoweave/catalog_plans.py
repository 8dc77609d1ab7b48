"""Registered queries of losses between views, artifact rules and the prediction sink, with the SQL of those that SQL can state.

Logits are numbers of the embeddings; a masked view of a sample lacks some of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog import CHANNELS, query, r6, read
from .catalog_models import centroid_scorer, samples
from .catalog_records import transcripts
from .operators import losses
from .plans import artifact, prediction, reports
from .plans.folders import shared_folder

VIEWS = """WITH e1 AS (SELECT vec_id, CAST(embedding[1] AS DOUBLE) * 8 AS a1, CAST(embedding[2] AS DOUBLE) * 8 AS a2, CAST(embedding[3] AS DOUBLE) * 8 AS a3, CAST(embedding[4] AS DOUBLE) * 5 AS y, CAST(embedding[5] AS DOUBLE) * 5 AS t, CAST(embedding[6] AS DOUBLE) * 5 AS aside, label % 3 AS k FROM embeddings),
v AS (SELECT *, ln(exp(a1) + exp(a2) + exp(a3)) AS z FROM e1),
m AS (SELECT *, CASE WHEN vec_id % 3 = 0 THEN 0.0 ELSE a1 END AS b1, CASE WHEN vec_id % 3 = 1 THEN 0.0 ELSE a2 END AS b2, CASE WHEN vec_id % 3 = 2 THEN 0.0 ELSE a3 END AS b3, y * 0.5 AS yb FROM v)
"""


def views(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two views of every vector: (vec_id, logits, y, t, aside, k), and one that lacks a logit and half of y."""
    at = lambda i, f: F.col("embedding")[i].cast("double") * f
    rows = read(spark, sf_dir, "embeddings").select("vec_id", F.array(at(0, 8), at(1, 8), at(2, 8)).alias("logits"), at(3, 5).alias("y"), at(4, 5).alias("t"), at(5, 5).alias("aside"), (F.col("label") % 3).alias("k"))
    part = F.transform("logits", lambda x, i: F.when(i == F.col("vec_id") % 3, 0.0).otherwise(x))
    return rows, rows.withColumns({"logits": part, "y": F.col("y") * 0.5})


@query(VIEWS + """, w AS (SELECT *, CASE k WHEN 0 THEN a1 WHEN 1 THEN a2 ELSE a3 END - z AS picked, CASE k WHEN 0 THEN 0.5 WHEN 1 THEN 1.0 ELSE 2.0 END AS w, (0.5 * (a1 - z) + (a2 - z) + 2.0 * (a3 - z)) AS every, (exp(a3 - z) - exp(a1 - z) - y / 3) AS lean FROM v)
SELECT k % 2 = 0 AS even, CAST(count(*) AS BIGINT) AS n, round(sum(-0.9 * w * picked - 0.1 / 3 * every) / sum(w), 6) AS cross_entropy, round(avg(CASE WHEN abs(y - t) <= 1 THEN 0.5 * (y - t) * (y - t) ELSE abs(y - t) - 0.5 END), 6) AS huber, round(avg(lean * lean), 6) AS consistency,
round(avg(greatest(aside, 0) - CASE WHEN k = 1 THEN aside ELSE 0 END + ln(1 + exp(-abs(aside)))), 6) AS neutral FROM w GROUP BY 1""")
def loss_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The supervised terms of the whole view, smoothed and weighted by class, for two groups of classes."""
    rows = views(spark, sf_dir)[0].withColumn("even", F.col("k") % 2 == 0)
    found = losses.supervised(rows, "logits", "y", "k", "t", ["even"], weights=[0.5, 1.0, 2.0], smoothing=0.1, neutral="aside", neutral_share=0.2)
    return found.select("even", "n", *[r6(c).alias(c) for c in ("cross_entropy", "huber", "consistency", "neutral")])


SOFT = ", ".join(f"{x}{i} / 2 - ln({' + '.join(f'exp({x}{j} / 2)' for j in (1, 2, 3))}) AS {'p' if x == 'a' else 'q'}{i}" for x in "ab" for i in (1, 2, 3))


@query(VIEWS + f""", d AS (SELECT *, {SOFT}, exp(greatest(a1, a2, a3) - z) AS sure FROM m), g AS (SELECT *, least(greatest((sure - 0.4) / 0.3, 0), 1) AS gate, 4 * ({" + ".join(f"exp(p{i}) * (p{i} - q{i})" for i in (1, 2, 3))}) AS kl, CASE WHEN abs(yb - y) <= 1 THEN 0.5 * (yb - y) * (yb - y) ELSE abs(yb - y) - 0.5 END AS hub FROM d)
SELECT CAST(count(*) AS BIGINT) AS n, round(sum(kl * gate) / greatest(sum(gate), 1e-6), 6) AS kl, round(sum(hub * gate) / greatest(sum(gate), 1e-6), 6) AS huber, round(avg(sure), 6) AS confidence, round(avg(gate), 6) AS gate FROM g""")
def distillation_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the masked view is from the whole one of the same vectors."""
    found = losses.distillation(*views(spark, sf_dir), "vec_id", "logits", "y", threshold=0.4)
    return found.select("n", *[r6(c).alias(c) for c in ("kl", "huber", "confidence", "gate")])


@query(VIEWS + """SELECT 'representation' AS loss, CAST(count(*) AS BIGINT) AS n, round(sum((a1 - b1) ** 2 + (a2 - b2) ** 2 + (a3 - b3) ** 2) / (3 * count(*)), 6) AS value FROM m WHERE vec_id % 2 = 0
UNION ALL SELECT 'reconstruction', CAST(count(*) AS BIGINT), round(avg((y - CASE vec_id % 3 WHEN 0 THEN a1 WHEN 1 THEN a2 ELSE a3 END) ** 2), 6) FROM m
UNION ALL SELECT 'auxiliary', CAST(sum(1 + CAST(vec_id % 4 = 0 AS BIGINT)) AS BIGINT), round(sum(z - CASE k WHEN 0 THEN a1 WHEN 1 THEN a2 ELSE a3 END + CASE WHEN vec_id % 4 = 0 THEN ln(exp(b1) + exp(b2) + exp(b3)) - CASE k WHEN 0 THEN b1 WHEN 1 THEN b2 ELSE b3 END ELSE 0 END) / sum(1 + CAST(vec_id % 4 = 0 AS BIGINT)), 6) FROM m""")
def view_losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Representation, reconstruction and auxiliary losses: coordinates of both views, the number that the masked one lacks, and each view's own classes."""
    whole, part = views(spark, sf_dir)
    same = losses.representation(whole, part, "vec_id", "logits", F.col("vec_id") % 2 == 0)
    steps = whole.select(F.transform("logits", lambda x: F.array(F.col("y"))).alias("made"), F.transform("logits", lambda x: F.array(x)).alias("wanted"), F.transform("logits", lambda x, i: i == F.col("vec_id") % 3).alias("gone"))
    both = whole.select("vec_id", "k", F.col("logits").alias("a")).join(part.select("vec_id", F.col("logits").alias("b")), "vec_id")
    own = losses.auxiliary(both.select("k", F.array("a", "b").alias("x"), F.array(F.lit(True), F.col("vec_id") % 4 == 0).alias("has")), "x", "k", "has")
    rows = same.withColumn("name", F.lit("representation")).unionByName(losses.reconstruction(steps, "made", "wanted", "gone").withColumn("name", F.lit("reconstruction"))).unionByName(own.withColumn("name", F.lit("auxiliary")))
    return rows.select(F.col("name").alias("loss"), F.col("n").cast("long").alias("n"), r6("loss").alias("value"))


BREAKS = {"audio_finite": 5, "text_mask_flags": 7, "grid_reversed": 11, "score_range": 6, "joint_support_range": 13, "incomplete": 9, "no_failure_reason": 18, "duration_finite": 17, "text_confidence_finite": 4}


@query("WITH u AS (SELECT DISTINCT user_id FROM events), r AS (SELECT * FROM (VALUES " + ", ".join(f"('{k}', {v})" for k, v in BREAKS.items()) + ") r(rule, m)), b AS (SELECT rule, user_id, row_number() OVER (PARTITION BY rule ORDER BY CAST(user_id AS VARCHAR)) AS n FROM u, r WHERE user_id % m = 0) SELECT rule, CAST(count(*) AS BIGINT) AS errors, string_agg(CAST(user_id AS VARCHAR), ',' ORDER BY CAST(user_id AS VARCHAR)) FILTER (WHERE n <= 10) AS examples FROM b GROUP BY 1")
def artifact_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules that a table of users' aligned samples breaks, after faults were put into every so-manieth user."""
    every = lambda rule: F.col("user_id") % BREAKS[rule] == 0
    bins = lambda x: F.array_repeat(F.lit(x), 50)
    rows = read(spark, sf_dir, "events").select("user_id").distinct()
    line = F.sequence(F.lit(0), F.lit(49))
    grid = F.transform(line, lambda i: F.array(i.cast("double"), F.when(every("grid_reversed") & (i == 20), 19.5).otherwise(i + 1.0)))
    rows = rows.select(
        "user_id", F.array_repeat(F.array(F.lit(0.0), F.lit(1.0)), 50).alias("text"), F.transform(line, lambda i: F.array(F.when(every("audio_finite") & (i == 7), float("nan")).otherwise(1.0))).alias("audio"),
        F.transform(line, lambda i: F.when(every("text_mask_flags") & (i == 3), 2).otherwise(1)).alias("text_mask"), bins(1).alias("audio_mask"), bins(0).alias("text_reliable_mask"), bins(0).alias("text_low_confidence_mask"),
        F.transform(line, lambda i: F.when(every("text_confidence_finite") & (i == 49), float("inf")).otherwise(0.5)).alias("text_confidence"), bins(0.0).alias("vision_quality_aligned"), bins(1.0).alias("vision_weight_sum"), F.array_repeat(F.array_repeat(F.lit(0.1), 7), 50).alias("probs"), grid.alias("time_grid"),
        F.when(every("duration_finite"), float("nan")).otherwise(50.0).alias("duration"), F.lit(50.0).alias("duration_alignment"), F.lit(1).alias("text_semantic_available"), F.when(every("score_range"), -0.5).alias("alignment_score"), F.when(every("joint_support_range"), 51).otherwise(3).alias("joint_support_bins"), F.lit("ok").alias("alignment_status"),
        F.when(every("incomplete"), "failed").otherwise("complete").alias("status"), F.when(every("incomplete") & ~every("no_failure_reason"), "lost").otherwise("").alias("failure_reason"),
    )
    return artifact.validate_samples(rows, "user_id", {"text": 2, "audio": 1}, 50, {"probs": 7}).select("rule", "errors", "examples")


@query("SELECT CAST(count(*) AS BIGINT) AS predictions, CAST(count(DISTINCT user_id) AS BIGINT) AS ids, CAST(count(*) AS BIGINT) - 1 AS last_index, CAST(count(DISTINCT user_id % 12) AS BIGINT) AS files, TRUE AS ordered FROM (SELECT DISTINCT user_id FROM events WHERE event_type IN ('click', 'view', 'purchase') AND user_id IN (SELECT user_id FROM events WHERE event_type NOT IN ('click', 'view', 'purchase')))")
def prediction_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions of all users, in a dozen files, written and read back: rows, ids, files, and whether files come in natural order."""
    rows = samples(spark, sf_dir).select("user_id", "features", "masks", F.concat(F.lit("part"), F.col("user_id") % 12, F.lit(".parquet")).alias("source_file"), F.col("user_id").alias("source_row"), F.lit("input_id_field").alias("id_source"))
    folder = shared_folder(spark, "predictions")
    found = prediction.write_predictions(rows, centroid_scorer(spark, sf_dir), CHANNELS, folder, key="user_id")
    audit = spark.read.option("header", "true").option("inferSchema", "true").csv(f"{folder}/audit")
    spans = audit.groupBy("source_file").agg(F.min("row_index").alias("a"), F.max("row_index").alias("b"), F.count("*").alias("n")).withColumn("number", F.regexp_extract("source_file", "[0-9]+", 0).cast("int"))
    later = spans.alias("x").join(spans.alias("y"), F.col("x.number") < F.col("y.number")).agg(F.coalesce(F.bool_and(F.col("x.b") < F.col("y.a")), F.lit(True)).alias("ordered"))  # a dozen files
    whole = audit.agg(F.count("*").alias("predictions"), F.count_distinct("id").alias("ids"), F.max("row_index").cast("long").alias("last_index"))
    return whole.crossJoin(F.broadcast(later)).select("predictions", "ids", "last_index", F.lit(found["input_file_count"]).cast("long").alias("files"), "ordered")  # one row each


def reviewed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Conversations as texts, their assistants' words as a first attempt, and the users' own, a little late, as a second."""
    texts, heard = transcripts(spark, sf_dir)
    own = texts.select("conv_id", F.posexplode(F.split("text", r"\s+")).alias("index", "word")).where("index % 5 <> 4")
    own = own.select("conv_id", F.col("index").cast("long").alias("index"), "word", (F.col("index") * 0.5).alias("start"), (F.col("index") * 0.5 + 0.4).alias("stop"), F.lit(0.8).alias("confidence"))
    texts = texts.withColumnsRenamed({"conv_id": "id"})
    return reports.attempts(texts, heard.withColumnRenamed("conv_id", "id"), own.withColumnRenamed("conv_id", "id"))[1], texts


@query()
def text_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit of all conversations' texts after two attempts."""
    stats, texts = reviewed(spark, sf_dir)
    return reports.text_audit(texts, stats).withColumn("fallback_ratio", r6("fallback_ratio"))
