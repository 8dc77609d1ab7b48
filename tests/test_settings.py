"""Configurations with parents, strict JSON, normalisation kept and read back."""

import json

import numpy as np
import pytest

from chronoweave.operators import sequences
from chronoweave.plans.runs import config_hash
from chronoweave.sources import settings


def test_children_override_their_parents(spark, tmp_path):
    for name, value in {"a.json": {"x": 1, "deep": {"p": 1, "q": 2}, "seeds": [1]}, "b.json": {"base_config": "a.json", "x": 2, "deep": {"p": 9}}, "c.json": {"base_config": "b.json", "y": None}, "r.json": {"base_config": "r.json"}, "l.json": [1]}.items():
        (tmp_path / name).write_text(json.dumps(value))
    assert settings.load_config(spark, f"file://{tmp_path}", "c.json") == {"x": 2, "deep": {"p": 9}, "seeds": [1], "y": None}
    for bad in ("r.json", "l.json"):
        with pytest.raises(ValueError):
            settings.load_config(spark, f"file://{tmp_path}", bad)
    found = settings.save_config(spark, f"file://{tmp_path}", "out.json", {"b": 1, "a": (2, 3)})
    assert found == config_hash({"a": [2, 3], "b": 1}) and json.loads((tmp_path / "out.json").read_text())["config_hash"] == found
    with pytest.raises(FileExistsError):
        settings.save_config(spark, f"file://{tmp_path}", "out.json", {})


def test_json_has_no_nan():
    got = json.loads(settings.dump({1: float("nan"), "a": np.float32(0.5), "b": np.array([1.0, np.inf]), "c": (1, {2}), "d": np.int64(7), "e": np.bool_(True)}))
    assert got == {"1": None, "a": 0.5, "b": [1.0, None], "c": [1, [2]], "d": 7, "e": True}


def test_normalisation_kept_and_read(spark, tmp_path):
    rows = spark.createDataFrame([(i, [float(i), 3.0, float(i * i)]) for i in range(9)], "id int, v array<double>")
    stats = sequences.fit_normalization(rows, "v", rows["id"] < 6)
    settings.save_normalization(stats, f"file://{tmp_path}/n", {"split": "train", "dims": (3,)})
    kept, facts = settings.load_normalization(spark, f"file://{tmp_path}/n", {"dims": [3]})
    assert facts["split"] == "train" and sorted(map(tuple, kept.collect())) == sorted(map(tuple, stats.select("dim", "mean", "std", "n").collect()))
    want = sequences.transform_normalization(rows, "id", "v", stats)
    assert sequences.transform_normalization(rows, "id", "v", kept).exceptAll(want).count() == 0
    with pytest.raises(ValueError, match="other split"):
        settings.load_normalization(spark, f"file://{tmp_path}/n", {"split": "valid"})
    settings.save_normalization(stats.withColumn("std", stats["std"] * 0), f"file://{tmp_path}/zero", {})
    with pytest.raises(ValueError, match="no statistics"):
        settings.load_normalization(spark, f"file://{tmp_path}/zero")
