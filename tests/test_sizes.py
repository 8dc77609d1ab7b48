"""Steps that once failed on larger tables."""

import random
import re

import numpy as np
from pyspark.sql import functions as F

from chronoweave import catalog_models
from chronoweave.operators import evaluation, models, sequences
from chronoweave.sources import media


def test_a_dense_frame_is_not_broadcast(spark):
    pooled = spark.createDataFrame([(1, "a", 0, 2.0, 1.0), (2, "b", 1, 3.0, 0.5)], "u long, c string, bin int, value double, weight double")
    frame = sequences.dense(pooled, spark.createDataFrame([(1,), (2,), (2,)], "u long"), ["a", "b"], "u", "c", 3)
    kept = sequences.runs(frame, ["u", "c"], "bin", F.col("mask"))
    assert sorted(map(tuple, kept.collect())) == [(1, "a", 0, 1), (2, "b", 1, 2)]
    assert frame.count() == 12
    assert "BroadcastHashJoin" not in kept._jdf.queryExecution().executedPlan().toString()


def test_labels_at_a_bound_do_not_depend_on_the_order_of_sums(spark, tmp_path):
    r, rows = random.Random(3), []
    for user in range(200):
        cents, n = (4580, 5360)[user % 2], 31
        values = [r.randint(0, 2 * cents) for _ in range(n - 1)]
        values.append(cents * n - sum(values))
        rows += [(user, "error", v / 100) for v in values]
    rows += [(900, "error", float("nan")), (901, "error", 45.79), (902, "error", 53.61), (903, "error", 1e30), (904, "error", None), (905, "click", 1.0)]
    spark.createDataFrame(rows, "user_id long, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    got = {x.user_id: x.label for x in catalog_models.labelled(spark, str(tmp_path)).collect()}
    assert {got[u] for u in range(200)} == {1}
    assert [got.get(u) for u in range(900, 906)] == [2, 0, 2, 2, 1, None]


def test_models_predict_few_samples_at_once(spark):
    class FewAtOnce:
        """A scorer that refuses many samples at once."""

        def prepare(self, features):
            return features

        def predict(self, prepared, masks):
            if len(masks) > 256:
                raise ValueError(f"{len(masks)} samples at once")
            return np.tile([0.2, 0.8], (len(masks), 1)), prepared[0][:, 0, 0], models.even_gates(masks)

    rows = spark.range(0, 700, 1, 1).selectExpr("id", "array(array(array(double(id)), array(0D))) AS features", "array(array(id % 2 = 0, true)) AS masks")
    got = {r.id: (r.intensity, r.coverage) for r in evaluation.predict(rows, FewAtOnce(), 1).collect()}
    assert got == {i: (float(i), [1.0 if i % 2 == 0 else 0.5]) for i in range(700)}


def test_images_are_numbered_by_range(spark, tmp_path):
    images = [b"\xff\xd8" + bytes([65 + i % 20]) * (1000 + i) + b"\xff\xd9" for i in range(200)]
    (tmp_path / "a.bin").write_bytes(b"".join(b"x" + i for i in images) + b"rest\xff\xd8cut")
    (tmp_path / "b.bin").write_bytes(b"".join(images[:3]))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        frames = media.jpeg_frames(spark, str(tmp_path))
        got = sorted((r.path.rsplit("/", 1)[1], r.frame, bytes(r.jpeg)) for r in frames.collect())
        assert got == [("a.bin", i, x) for i, x in enumerate(images)] + [("b.bin", i, x) for i, x in enumerate(images[:3])]
        plan = frames._jdf.queryExecution().optimizedPlan().toString()
        assert re.search(r"row_number\(\) windowspecdefinition\(path#\w+, block#\w+, place#", plan)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
