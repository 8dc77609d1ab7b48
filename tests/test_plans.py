"""Losses by hand, artifact rules, the prediction sink."""

import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoweave.operators import evaluation as E
from chronoweave.operators import losses, models
from chronoweave.plans import artifact, prediction


def soft(x, t=1.0):
    e = [math.exp(v / t - max(x) / t) for v in x]
    return [v / sum(e) for v in e]


def near(row, want):
    assert all(abs(a - b) < 1e-9 for a, b in zip(row, want, strict=True)), (row, want)


@pytest.fixture(scope="module")
def views(spark):
    r = random.Random(5)
    rows = [(i, [r.gauss(0, 2) for _ in range(3)], r.gauss(0, 2), r.randrange(3), r.gauss(0, 2), r.gauss(0, 1)) for i in range(60)]
    schema = "id long, logits array<double>, y double, label int, target double, aside double"
    return rows, spark.createDataFrame(rows, schema).repartition(3)


@pytest.mark.parametrize(("smoothing", "focus", "weights", "neutral"), [(0.0, 0.0, None, 0.0), (0.1, 0.0, [0.5, 1.0, 2.0], 0.3), (0.1, 2.0, [0.5, 1.0, 2.0], 0.0), (0.0, 1.5, None, 0.2)])
def test_supervised(views, smoothing, focus, weights, neutral):
    rows, frame = views
    got = losses.supervised(frame, "logits", "y", "label", "target", weights=weights, smoothing=smoothing, focus=focus, neutral="aside", regression=0.7, consistency=0.2, neutral_share=neutral).first()
    w = weights or [1.0] * 3
    entropy = []
    for _, x, _, k, _, _ in rows:
        logs = [math.log(p) for p in soft(x)]
        if focus:
            ce = -(1 - smoothing) * logs[k] - smoothing / 3 * sum(logs)
            entropy.append((1 - math.exp(-ce)) ** focus * ce * w[k])
        else:
            entropy.append(-(1 - smoothing) * w[k] * logs[k] - smoothing / 3 * sum(a * b for a, b in zip(w, logs, strict=True)))
    ce = sum(entropy) / (len(rows) if focus else sum(w[r[3]] for r in rows))
    hub = np.mean([0.5 * d * d if d <= 1 else d - 0.5 for d in (abs(r[2] - r[4]) for r in rows)])
    lean = np.mean([(soft(r[1])[2] - soft(r[1])[0] - r[2] / 3) ** 2 for r in rows])
    bce = np.mean([-math.log(1 / (1 + math.exp(-r[5]))) if r[3] == 1 else -math.log(1 - 1 / (1 + math.exp(-r[5]))) for r in rows]) if neutral else 0.0
    near(got, (60, ce + 0.7 * hub + 0.2 * lean + neutral * bce, ce, hub, lean, bce))


@pytest.mark.parametrize("gated", [True, False])
def test_distillation_between_two_views(spark, views, gated):
    rows, frame = views
    r = random.Random(6)
    other = {i: ([r.gauss(0, 2) for _ in range(3)], r.gauss(0, 2)) for i in range(10, 80)}
    student = spark.createDataFrame([(i, *v) for i, v in other.items()], "id long, logits array<double>, y double")
    got = losses.distillation(frame, student, "id", "logits", "y", temperature=3.0, regression=0.4, gated=gated, threshold=0.5).first()
    both = [(x, y, *other[i]) for i, x, y, *_ in rows if i in other]
    gate = [min(max((max(soft(x)) - 0.5) / 0.3, 0), 1) if gated else 1.0 for x, *_ in both]
    kl = sum(g * 9 * sum(p * math.log(p / q) for p, q in zip(soft(x, 3.0), soft(z, 3.0), strict=True)) for g, (x, _, z, _) in zip(gate, both, strict=True)) / max(sum(gate), 1e-6)
    hub = sum(g * (0.5 * (y - v) ** 2 if abs(y - v) <= 1 else abs(y - v) - 0.5) for g, (_, y, _, v) in zip(gate, both, strict=True)) / max(sum(gate), 1e-6)
    near(got, (50, kl + 0.4 * hub, kl, hub, np.mean([max(soft(x)) for x, *_ in both]), np.mean(gate)))


def test_other_losses(spark):
    native = spark.createDataFrame([(1, [1.0, 2.0]), (2, [0.0, 0.0]), (3, [9.0, 9.0])], "id int, v array<double>")
    masked = spark.createDataFrame([(1, [1.5, 0.0]), (2, [1.0, 0.0]), (4, [1.0, 1.0])], "id int, v array<double>")
    near(losses.representation(native, masked, "id", "v").first(), (2, (0.25 + 4 + 1) / 4))
    near(losses.representation(native, masked, "id", "v", F.col("id") == 2).first(), (1, 0.5))
    near(losses.representation(native, masked, "id", "v", F.col("id") > 9).first(), (0, 0.0))
    steps = spark.createDataFrame([([[1.0, 2.0], [3.0, 4.0]], [[0.0, 0.0], [1.0, 1.0]], [False, True]), ([[5.0]], [[2.0]], [True]), ([[5.0]], [[2.0]], [False])], "made array<array<double>>, wanted array<array<double>>, gone array<boolean>")
    near(losses.reconstruction(steps, "made", "wanted", "gone").first(), (3, (4 + 9 + 9) / 3))
    near(losses.reconstruction(steps.where("size(gone) > 5"), "made", "wanted", "gone").first()[1:], (0.0,))
    own = spark.createDataFrame([([[1.0, 0.0, 0.0], [0.0, 2.0, 0.0]], 1, [True, False]), ([[0.0, 0.0, 0.0], [0.0, 2.0, 1.0]], 2, [True, True])], "x array<array<double>>, k int, a array<boolean>")
    e = [-math.log(soft([1, 0, 0])[1]), -math.log(soft([0, 2, 0])[1]), math.log(3), -math.log(soft([0, 2, 1])[2])]
    near(losses.auxiliary(own, "x", "k", "a").first(), (3, (e[0] + e[2] + e[3]) / 3))
    near(losses.auxiliary(own, "x", "k").first(), (4, sum(e) / 4))


DIMS, BINS = {"text": 2, "audio": 1}, 3
SCHEMA = "id string, text array<array<double>>, audio array<array<double>>, text_mask array<int>, audio_mask array<int>, text_reliable_mask array<int>, text_low_confidence_mask array<int>, text_confidence array<double>, vision_quality_aligned array<double>, vision_weight_sum array<double>, probs array<array<double>>, time_grid array<array<double>>, duration double, duration_alignment double, text_semantic_available int, alignment_score double, joint_support_bins int, alignment_status string, status string, failure_reason string"


def sample(name, **changes):
    row = {"id": name, "text": [[0.0, 1.0]] * 3, "audio": [[1.0]] * 3, "text_mask": [1, 0, 1], "audio_mask": [1, 1, 1], "text_reliable_mask": [0] * 3, "text_low_confidence_mask": [0] * 3, "text_confidence": [0.5] * 3, "vision_quality_aligned": [0.0] * 3, "vision_weight_sum": [1.0] * 3, "probs": [[0.1] * 7] * 3, "time_grid": [[0.0, 1.0], [1.0, 2.0], [2.0, 3.0]], "duration": 3.0, "duration_alignment": 3.0, "text_semantic_available": 1, "alignment_score": None, "joint_support_bins": 0, "alignment_status": "ok", "status": "complete", "failure_reason": ""}
    assert set(changes) <= set(row)
    return tuple((row | changes).values())


NAN, INF = float("nan"), float("inf")
BROKEN = {
    "text_shape": {"text": [[0.0]] * 3}, "audio_shape": {"audio": [[1.0]] * 2}, "text_finite": {"text": [[0.0, NAN], [0.0, 1.0], [0.0, 1.0]]}, "text_mask_flags": {"text_mask": [1, 2, 0]}, "audio_mask_shape": {"audio_mask": None},
    "text_reliable_mask_flag": {"text_reliable_mask": [0, -1, 0]}, "text_low_confidence_mask_shape": {"text_low_confidence_mask": [0]}, "text_confidence_finite": {"text_confidence": [0.0, None, 1.0]}, "vision_quality_aligned_negative": {"vision_quality_aligned": [0.0, -0.1, 0.0]}, "vision_weight_sum_finite": {"vision_weight_sum": [INF, 0.0, 0.0]},
    "probs_shape": {"probs": [[0.1] * 6] * 3}, "probs_finite": {"probs": [[0.1] * 6 + [NAN]] * 3}, "grid_shape": {"time_grid": [[0.0, 1.0]]}, "grid_reversed": {"time_grid": [[0.0, 1.0], [1.0, 0.5], [2.0, 3.0]]}, "grid_order": {"time_grid": [[0.0, 1.0], [2.5, 2.6], [2.0, 3.0]]}, "grid_start": {"time_grid": [[0.5, 1.0], [1.0, 2.0], [2.0, 3.0]]}, "grid_range": {"duration_alignment": 2.9},
    "duration_finite": {"duration": NAN}, "semantic_flag": {"text_semantic_available": 2}, "score_range": {"alignment_score": 1.5}, "joint_support_range": {"joint_support_bins": 4}, "alignment_status": {"alignment_status": None}, "incomplete": {"status": "failed", "failure_reason": "why"},
}


def test_each_rule_is_broken_alone(spark):
    rows = [sample("good"), sample("edge", time_grid=[[1e-7, 1.0], [1.0, 2.0], [2.0, 3.00009]], alignment_score=1.0, joint_support_bins=3)] + [sample(f"bad-{name}", **change) for name, change in BROKEN.items()]
    found = {r.rule: (r.severity, r.errors, r.examples) for r in artifact.validate_samples(spark.createDataFrame(rows, SCHEMA).repartition(3), "id", DIMS, BINS, {"probs": 7}).collect()}
    extra = {"grid_range": 1}
    for name in BROKEN:
        assert found.pop(name) == ("error", 1, f"bad-{name}"), name
    assert not found, (found, extra)


def test_rules_of_the_whole_table(spark):
    frame = spark.createDataFrame([sample("a"), sample("b"), sample("b"), sample(None), sample("c", status=None)], SCHEMA)
    listed = spark.createDataFrame([("a",), ("b",), ("c",), ("d",), ("c",)], "id string")
    got = {r.rule: (r.severity, r.errors, r.examples) for r in artifact.validate_samples(frame.drop("probs").withColumn("text_bert", F.lit(1)), "id", DIMS, BINS, {"probs": 7}, expected=7, manifest=listed, strict=False).collect()}
    assert got["unique_key"][1] == 2 and got["sample_count"] == ("error", 2, "") and got["missing_probs"] == ("error", 1, "") and got["deprecated_text_bert"] == ("error", 1, "")
    assert got["incomplete"] == ("warning", 1, "c") and got["no_failure_reason"] == ("error", 1, "c") and got["manifest"][1] == 4
    assert set(got) == {"unique_key", "sample_count", "missing_probs", "deprecated_text_bert", "incomplete", "no_failure_reason", "manifest"}
    assert artifact.validate_samples(frame.where("id = 'a'"), "id", DIMS, BINS, {"probs": 7}, expected=1).count() == 0
    assert [tuple(r) for r in artifact.validate_samples(frame.limit(0), "id", DIMS, BINS, {"probs": 7}, expected=3).collect()] == [("sample_count", "error", 3, "")]


def odd_scorer():
    """A scorer whose intensity is no number for some samples; a local class, so that it travels with the task."""

    class Odd:
        def prepare(self, features):
            return features

        def predict(self, prepared, masks):
            p, y, g = models.NearestCentroid([[0.0] * 4, [1.0] * 4, [2.0] * 4], [-1.0, 0.0, 1.0]).predict(prepared, masks)
            return p, np.where(prepared[0][:, 0, 0] > 90, np.nan, y), g

    return Odd()


def test_predictions_audit_and_manifest(spark, tmp_path):
    rows = [("x", f"part{n}.pq", i, "input_id_field", [[[float(v)]], [[1.0]]], [[True], [v != 3]]) for n, i, v in ((10, 0, 0), (2, 1, 1), (2, 0, 2), (1, 0, 99))] + [("lone", "part10.pq", 1, "file_stem", [[[5.0]], [[1.0]]], [[False], [False]])]
    frame = spark.createDataFrame(rows, "id string, source_file string, source_row int, id_source string, features array<array<array<double>>>, masks array<array<boolean>>").repartition(3)
    found = prediction.write_predictions(frame, odd_scorer(), ["text", "audio"], f"file://{tmp_path}/out", extra={"feature_version": "v"})
    made = {int(r["row_index"]): r for r in spark.read.option("header", True).csv(f"file://{tmp_path}/out/predictions").collect()}
    audit = {int(r["row_index"]): r for r in spark.read.option("header", True).csv(f"file://{tmp_path}/out/audit").collect()}
    assert [audit[i]["source_file"] for i in range(5)] == ["part1.pq", "part2.pq", "part2.pq", "part10.pq", "part10.pq"]
    assert made[0]["predicted_intensity"] == "NA" and audit[0]["nonfinite_output"] == "true" and audit[0]["max_probability"] == "NA" and made[0]["predicted_annotation"] == "Positive"
    assert audit[4]["all_unavailable"] == "true" and audit[4]["text_coverage"] == "0.0" and audit[4]["id"] == "lone" and audit[1]["audio_coverage"] == "1.0"
    p = E.predict(frame.where("source_file = 'part2.pq' AND source_row = 1"), odd_scorer(), 2, key="source_row").first()
    assert abs(float(made[2]["prob_neutral"]) - p.probabilities[1]) < 1e-12
    kept = json.loads((tmp_path / "out" / "inference_manifest.json").read_text())
    assert kept == found and kept["sample_count"] == 5 and not kept["id_coverage"] and kept["all_unavailable_count"] == 1 and kept["nonfinite_output_count"] == 1 and kept["input_file_count"] == 3 and kept["feature_version"] == "v"
    with pytest.raises(Exception, match="(?i)exists"):
        prediction.write_predictions(frame, odd_scorer(), ["text", "audio"], f"file://{tmp_path}/out")


def test_envelopes(spark):
    inner = spark.createDataFrame([(1, "a")], "id int, text string")
    assert prediction.unwrapped(inner.select(F.struct("id", "text").alias("test"))).columns == ["id", "text"]
    assert prediction.unwrapped(inner).columns == ["id", "text"] and prediction.unwrapped(inner.withColumnRenamed("text", "test")).columns == ["id", "test"]


def test_texts_after_two_attempts(spark):
    from chronoweave.plans import reports

    samples = spark.createDataFrame([(1, "one two three four", 8.0), (2, "one two", 4.0), (3, "alpha beta", 4.0), (4, "fine words here", 6.0), (5, None, 2.0), (6, "lost in space", 3.0)], "id int, text string, duration double")
    schema = "id int, index int, word string, start double, stop double, confidence double"
    first = spark.createDataFrame([(1, 0, "one", 0.0, 1.0, 0.9), (2, 0, "...", 0.0, 1.0, 0.9), (3, 0, "gamma", 0.0, 1.0, 0.9), (4, 0, "fine", 0.0, 1.0, 0.9), (4, 1, "words", 1.0, 2.0, 0.9), (4, 2, "here", 2.0, 3.0, 0.9)], schema)
    second = spark.createDataFrame([(1, 0, "one", 0.0, 1.0, 0.9), (1, 1, "two", 1.0, 2.0, 0.9), (1, 2, "three", 2.0, 3.0, 0.9), (2, 0, "nothing", 0.0, 1.0, 0.5), (4, 0, "other", 0.0, 1.0, 0.9), (6, 0, "lost", 0.0, 1.0, 0.9), (6, 1, "in", 1.0, 1.5, 0.9), (6, 2, "spice", 1.5, 3.0, 0.9)], schema)
    records, stats = reports.attempts(samples, first, second)
    stats = stats.cache()
    got = {r.id: (r.word_count, r.asr_word_count, r.fallback_count, r.asr_retry_used, r.asr_retry_selected, r.review_status) for r in stats.collect()}
    assert got == {
        1: (4, 3, 1, 1, 1, "normal"), 2: (2, 1, 2, 1, 0, reports.EMPTY), 3: (2, 1, 2, 1, 0, reports.MISMATCH), 4: (3, 3, 0, 0, 0, "normal"), 5: (0, 0, 0, 1, 0, "normal"), 6: (3, 3, 0, 1, 1, "normal"),
    }
    assert {(r.id, r.n): r.word for r in records.collect()}[6, 2] == "space" and records.count() == 14
    audit = {r.id: r for r in reports.text_audit(samples.union(spark.createDataFrame([(9, "gone", 1.0)], samples.schema)), stats).collect()}
    assert audit[2].manual_review_required == 1 and audit[2].conclusion.startswith("ASR为空") and audit[1].manual_review_required == 0 and audit[9].review_status == reports.LACKING and audit[9].word_count == 0
    review = {r.id: r for r in reports.text_review(samples, stats, first).collect()}
    assert json.loads(review[4].asr_words)[1] == {"text": "words", "start": 1.0, "end": 2.0} and review[5].asr_words == "[]" and review[5].raw_text == "" and review[1].asr_selected_profile == reports.SECOND
    bins = spark.createDataFrame([(1, "audio", True), (1, "audio", False), (1, "vision", True), (4, "audio", True)], "id int, channel string, mask boolean")
    frames = spark.createDataFrame([(1, "audio", True), (1, "audio", False), (4, "vision", False)], "id int, channel string, valid boolean")
    rows = {r.id: r for r in reports.effective_lengths(stats, bins, ["audio", "vision"], frames, 50).collect()}
    assert (rows[1].audio_raw_valid_ratio, rows[1].audio_aligned_valid_bins, rows[1].vision_aligned_valid_ratio, rows[1].text_raw_valid_ratio) == (0.5, 1, 0.02, 0.75) and rows[4].vision_raw_frames == 1 and rows[5].audio_raw_valid_ratio == 0.0
