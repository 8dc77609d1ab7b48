"""Scoring under many masks, models, gradients, training that is gone on with, and staged runs."""

import json
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoweave.operators import evaluation as E
from chronoweave.operators import models, scenarios, training
from chronoweave.plans.runs import Run, run_stages

CHANNELS, STEPS, DIMS = ["text", "audio", "vision"], 10, (3, 2, 1)
SCHEMA = "id string, features array<array<array<double>>>, masks array<array<boolean>>, label int, target double"


def some(n, seed=0, share=0.7):
    rng = np.random.default_rng(seed)
    out = []
    for i in range(n):
        masks = rng.random((3, STEPS)) < share
        if i % 7 == 3:
            masks[i % 3] = False
        if i == 5:
            masks[:] = False
        features = [rng.normal(0, 1, (STEPS, d)) for d in DIMS]
        label = int(rng.integers(0, 3))
        features[0][:, 0] += label
        out.append((f"s{i}", [x.tolist() for x in features], masks.tolist(), label, float(label - 1 + rng.normal(0, 0.1))))
    return out


def of(rows):
    return [np.array([r[1][c] for r in rows]) for c in range(3)], np.array([r[2] for r in rows]), np.array([r[3] for r in rows]), np.array([r[4] for r in rows])


def masked_by_hand(masks, key, s):
    """A sample's masks under a scenario, step by step."""
    out = [list(m) for m in masks]
    if s.position == "whole":
        c = s.group[0]
        if any(any(m) for i, m in enumerate(masks) if i != c):
            out[c] = [False] * STEPS
        return out
    for offset, c in enumerate(s.group):
        free = [t for t in range(STEPS) if masks[c][t]]
        m = len(free)
        if m <= 1 or s.fraction <= 0:
            continue
        count = min(m - 1, max(1, math.ceil(m * s.fraction)))
        begin = {"front": 0, "middle": (m - count) // 2, "back": m - count}[s.position]
        start, stop = free[begin], free[begin + count - 1] + 1
        if s.relation == "stagger":
            shift = offset * E.draw(s.name, key, c, over=STEPS // len(s.group) + 1)
            start, stop = min(STEPS, start + shift), min(STEPS, stop + shift)
        for t in range(start, stop):
            out[c][t] = False
        if not any(out[c]):
            out[c][free[0]] = True
    return out


def test_grids_have_the_known_sizes():
    full = {"validation_missing_fractions": [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.8], "random_seeds": [2026]}
    made = E.configured(full, CHANNELS, "full")
    assert len(made) == 695 and len({s.effect for s in made}) == 401 and len({s.name for s in made}) == 695
    assert len(E.configured({}, CHANNELS, "compact")) == 10
    assert len(E.configured({"selection_missing_fractions": [0.2], "selection_missing_positions": ["front", "middle", "back"]}, CHANNELS, "selection")) == 14
    assert "text+vision__40__back__stagger__s42" in {s.name for s in made} and made[-1].name == "text__whole__single__s2026"
    with pytest.raises(ValueError, match="sideways"):
        E.grid(CHANNELS, [0.1], ["sideways"], [[0]], ["overlap"], [1])


def test_masks_under_every_scenario():
    rows = some(40)
    own = E.Masks(of(rows)[1], [r[0] for r in rows])
    for s in E.configured({"validation_missing_fractions": [0.1, 0.6, 1.0, 0.0]}, CHANNELS, "full"):
        want = [masked_by_hand(r[2], r[0], s) for r in rows]
        assert own.under(s).tolist() == want, s.name


@pytest.mark.parametrize("relation", ["overlap", "stagger"])
def test_long_rows_under_a_scenario(spark, relation):
    rows = some(30)
    s = E.Scenario("x__40", (0, 2), 0.4, "back", relation, 1)
    bins = spark.createDataFrame([(r[0], c, t) for r in rows for c in range(3) for t in range(STEPS) if r[2][c][t]], "id string, c int, t int")
    kept = Counter((r.id, r.c) for r in scenarios.under(bins, "id", "c", "t", s, STEPS).where("kept").collect())
    for r in rows:
        assert [kept[r[0], c] for c in range(3)] == [sum(m) for m in masked_by_hand(r[2], r[0], s)]


def test_one_pass_equals_scenario_by_scenario(spark):
    rows = some(60)
    features, masks, label, target = of(rows)
    scorer = models.ConcatMLP(models.drawn(models.ConcatMLP.shapes(DIMS, 8), 3))
    listed = E.configured({"validation_missing_fractions": [0.2, 0.6]}, CHANNELS, "full")
    frame = spark.createDataFrame(rows, SCHEMA).repartition(3)
    sums = E.evaluate(frame, scorer, listed, 3).cache()
    got = {r.scenario: r for r in E.metrics(sums).collect()}
    cells = {(r.scenario, r.true_class, r.predicted_class): r["count"] for r in E.confusion(sums).collect()}
    audit = {(r.scenario, r.channel): r for r in E.mask_audit(sums, 3).collect()}
    assert len(got) == len(listed) and len(cells) == 9 * len(listed)
    for s in listed[::7] + listed[-1:]:
        now = np.array([masked_by_hand(r[2], r[0], s) for r in rows])
        p, y, gates = scorer.predict(features, now)
        k = p.argmax(axis=1)
        r = got[s.name]
        assert r.n == len(rows) and abs(r.accuracy - (k == label).mean()) < 1e-12 and abs(r.mae - np.abs(y - target).mean()) < 1e-12
        assert abs(r.pearson - np.corrcoef(y, target)[0, 1]) < 1e-9 and r.unavailable == 1
        f1 = [2 * ((k == c) & (label == c)).sum() / max((k == c).sum() + (label == c).sum(), 1) for c in range(3)]
        assert abs(r.macro_f1 - np.mean(f1)) < 1e-12 and abs(r.gate1 - gates[:, :, 1].mean()) < 1e-12
        assert all(cells[s.name, a, b] == ((label == a) & (k == b)).sum() for a in range(3) for b in range(3))
        for c in range(3):
            gone = masks[:, c] & ~now[:, c]
            a = audit[s.name, c]
            runs = [max((len(x) for x in "".join("1" if g else " " for g in row).split()), default=0) for row in gone]
            hit = [row for row in gone if row.any()]
            assert (a.original, a.observed, a.touched) == (masks[:, c].sum(), now[:, c].sum(), len(hit))
            assert a.start_min == (min(int(np.flatnonzero(h)[0]) for h in hit) if hit else None) and a.stop_max == (max(int(np.flatnonzero(h)[-1]) + 1 for h in hit) if hit else None)
            assert abs(a.longest_mean - np.mean(runs) / STEPS) < 1e-12 and abs(a.missing_max - (gone.sum(1) / np.maximum(masks[:, c].sum(1), 1)).max()) < 1e-12
    assert E.evaluate(frame.limit(0), scorer, listed[:3], 3).count() == 0
    ragged = spark.createDataFrame([rows[0], ("x", [[[0.0] * 3] * 4] * 3, [[True] * 4] * 3, 0, 0.0)], SCHEMA).coalesce(1)
    with pytest.raises(Exception, match="shapes"):
        E.evaluate(ragged, scorer, listed[:1], 3).collect()


def test_samples_from_long_rows(spark):
    rows = spark.createDataFrame([("a", "x", 0, 1.0, 2.0), ("a", "y", 2, 3.0, None), ("a", "x", 9, 5.0, 5.0), ("a", "z", 1, 5.0, 5.0), ("b", "y", 1, 4.0, 6.0), ("c", "z", 1, 4.0, 6.0)], "id string, c string, t int, v double, w double")
    got = {r.id: (r.features, r.masks) for r in E.pack_samples(rows, "id", "c", "t", ["v", "w"], ["x", "y"], 3).collect()}
    off = [0.0, 0.0]
    assert got == {"a": ([[[1.0, 2.0], off, off], [off, off, [3.0, None]]], [[True, False, False], [False, False, True]]), "b": ([[off, off, off], [off, [4.0, 6.0], off]], [[False] * 3, [False, True, False]])}


def test_constant_predictions_have_no_correlation(spark):
    scorer = models.NearestCentroid([[0.0] * 9] * 3, [0.5] * 3)
    frame = spark.createDataFrame(some(20), SCHEMA)
    r = E.metrics(E.evaluate(frame, scorer, [E.COMPLETE], 3)).first()
    assert r.pearson is None and r.composite is None and r.mae > 0


def late_fusion_by_hand(w, features, masks):
    """One sample through the late fusion, number by number."""
    def line(name, x):
        return [sum(a * b for a, b in zip(row, x, strict=True)) + bias for row, bias in zip(w[f"{name}.weight"].tolist(), w[f"{name}.bias"].tolist(), strict=True)]

    def norm(name, x):
        mean = sum(x) / len(x)
        var = sum((v - mean) ** 2 for v in x) / len(x)
        return [(v - mean) / math.sqrt(var + 1e-5) * g + b for v, g, b in zip(x, w[f"{name}.weight"].tolist(), w[f"{name}.bias"].tolist(), strict=True)]

    def act(x):
        return [0.5 * v * (1 + math.erf(v / math.sqrt(2))) for v in x]

    experts, facts, trust, votes = [], [], [], []
    for c in range(3):
        steps = [act(norm(f"project_norm{c}", line(f"project{c}", x))) for x in features[c]]
        on = [t for t in range(STEPS) if masks[c][t]]
        gap = best = 0
        for t in range(STEPS):
            gap = 0 if masks[c][t] else gap + 1
            best = max(best, gap)
        fact = [len(on) / STEPS, best / STEPS, float(bool(on))]
        hidden, stats = len(steps[0]), []
        for kind in range(6):
            for d in range(hidden):
                x = [steps[t][d] for t in on]
                mean = sum(x) / max(len(x), 1)
                pairs = [t for t in range(1, STEPS) if masks[c][t] and masks[c][t - 1]]
                stats.append([mean, max(x, default=0), math.sqrt(max(sum((v - mean) ** 2 for v in x) / max(len(x), 1), 1e-8)), x[0] if x else 0, x[-1] if x else 0, sum(steps[t][d] - steps[t - 1][d] for t in pairs) / max(len(pairs), 1)][kind])
        e = [v * fact[2] for v in act(line(f"expert_b{c}", act(line(f"expert_a{c}", norm(f"expert_norm{c}", stats + fact)))))]
        experts.append(e)
        facts.append(fact)
        trust.append(line(f"trust_b{c}", act(line(f"trust_a{c}", norm(f"trust_norm{c}", e + fact))))[0] if on else None)
        votes.append([v * fact[2] for v in line(f"expert_class{c}", e)])
    known = [t for t in trust if t is not None]
    share = [math.exp(t - max(known)) if t is not None else 0.0 for t in trust] if known else [0.0] * 3
    share = [x / max(sum(share), 1e-8) for x in share]
    fused = [sum(share[c] * experts[c][d] for c in range(3)) for d in range(len(experts[0]))]
    h = sum(experts, []) + fused + sum(votes, []) + sum(facts, [])
    h = act(line("joint_b", act(line("joint_a", norm("joint_norm", h)))))
    neutral = 1 / (1 + math.exp(-line("neutral", h)[0]))
    a, b = (math.exp(v) for v in line("polar", h))
    value = 3 * math.tanh(line("value_b", act(line("value_a", norm("value_norm", h))))[0])
    return [(1 - neutral) * a / (a + b), neutral, (1 - neutral) * b / (a + b)], value, share


def test_late_fusion_by_hand(spark):
    rows = some(12)
    w = models.weights_of(models.weight_table(spark, models.drawn(models.LateFusion.shapes(DIMS, 4, 6), 9)))
    frame = spark.createDataFrame(rows, SCHEMA).repartition(2)
    got = {r.id: r for r in E.predict(frame, models.LateFusion(w, 3), 3).collect()}
    for r in rows:
        p, value, share = late_fusion_by_hand(w, r[1], r[2])
        assert np.allclose(got[r[0]].probabilities, p, atol=1e-9) and abs(got[r[0]].intensity - value) < 1e-9
        assert got[r[0]].predicted == int(np.argmax(p)) and got[r[0]].unavailable == (not np.any(r[2]))
        each = [[share[c] * r[2][c][t] for c in range(3)] for t in range(STEPS)]
        gates = np.mean([[v / max(sum(x), 1e-8) for v in x] for x in each], axis=0)
        assert np.allclose(got[r[0]].gates, gates, atol=1e-9)


def test_weights_are_checked(spark, monkeypatch):
    table = models.weight_table(spark, {"a": np.zeros((2, 3)), "b": np.ones(4)})
    assert {k: v.tolist() for k, v in models.weights_of(table).items()} == {"a": [[0.0] * 3] * 2, "b": [1.0] * 4}
    with pytest.raises(ValueError, match="named"):
        models.weights_of(table.union(table))
    monkeypatch.setattr(models, "MOST_BYTES", 50)
    with pytest.raises(ValueError, match="bytes"):
        models.weights_of(table)


def test_error_function():
    x = np.concatenate((np.linspace(-7, 7, 4001), [0.0, 1e-9, -6.0, 6.0]))
    assert np.abs(models.erf(x) - [math.erf(v) for v in x]).max() < 1e-12


def test_gradient_is_the_slope_of_the_loss(spark):
    rows = some(25, 4)
    frame = spark.createDataFrame(rows, SCHEMA).repartition(3).selectExpr("id AS k", "features AS f", "masks AS m", "label AS l", "target AS t")
    w = models.drawn(models.ConcatMLP.shapes(DIMS, 5), 1)
    s = training.Settings(hidden=5, smoothing=0.1, consistency=0.3, regression=0.7, augment=False)
    weigh = np.array([0.5, 1.0, 2.0])
    got, found = training.step_gradient(frame, w, weigh, s, ("none", 0.0, 0.0), 1, 1)
    features, masks, label, target = of(rows)

    def loss(x):
        kept = models.ConcatMLP(training.shaped(x, w)).forward(models.masked_means(features, masks))
        entropy, huber, gap, *_ = training.losses(kept[4], kept[5], label, target, weigh, s.smoothing)
        return entropy.sum() / weigh[label].sum() + s.regression * huber.mean() + s.consistency * gap.mean()

    x = training.flat(w)
    for i in random.Random(0).sample(range(len(x)), 40):
        step = np.zeros(len(x))
        step[i] = 1e-5
        assert abs((loss(x + step) - loss(x - step)) / 2e-5 - got[i]) < 1e-7
    assert abs(found["cross_entropy"] + 0.7 * found["huber"] + 0.3 * found["consistency"] - loss(x)) < 1e-9
    empty, none = training.step_gradient(frame.limit(0), w, weigh, s, ("none", 0.0, 0.0), 1, 1)
    assert none["n"] == 0 and not empty.any()


def test_tree_sum_keeps_order_and_all_parts(spark):
    parts = spark.range(0, 200, 1, 7).selectExpr("id AS pid", "id AS x")
    as_bytes = F.udf(lambda x: np.array([x, 1.0], "<f8").tobytes(), "binary")
    assert training.tree_sum(parts.select("pid", as_bytes("x").alias("v")), 200).tolist() == [199 * 100, 200]


def test_an_adamw_step_by_hand():
    state = training.State({"a": np.array([1.0, -2.0])}, np.zeros(2), np.zeros(2), {})
    x, m, v = np.array([1.0, -2.0]), np.zeros(2), np.zeros(2)
    for n, g in enumerate((np.array([0.3, -0.4]), np.array([3.0, 4.0])), 1):
        training.adamw(state, g, 0.1, 0.01, 1.0)
        g = g * min(1, 1 / (np.linalg.norm(g) + 1e-6))
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        x = x - 0.1 * 0.01 * x - 0.1 * (m / (1 - 0.9**n)) / (np.sqrt(v / (1 - 0.999**n)) + 1e-8)
        assert np.allclose(state.weights["a"], x, atol=1e-14)


def test_training_that_is_gone_on_with(spark, tmp_path):
    rows = some(90, 8, 0.9)
    frame = spark.createDataFrame(rows, SCHEMA)
    learn, hold = frame.where("pmod(xxhash64(id), 4) > 0"), frame.where("pmod(xxhash64(id), 4) = 0")
    s = training.Settings(epochs=4, parts=2, rate=0.05, hidden=6, curriculum=True, cosine=True)
    kinds = {"seed": 3, "scenarios": E.configured({}, CHANNELS, "compact")}
    whole = training.train(learn, hold, DIMS, f"file://{tmp_path}/whole", s, **kinds)
    assert [h["epoch"] for h in whole.history] == [1, 2, 3, 4] and whole.history[-1]["loss"] < whole.history[0]["loss"]
    part = training.train(learn, hold, DIMS, f"file://{tmp_path}/part", s, halt=lambda e: e == 2, **kinds)
    assert part.epoch == 2
    rest = training.train(learn, hold, DIMS, f"file://{tmp_path}/part", s, **kinds)
    assert rest.history == whole.history and rest.best_epoch == whole.best_epoch
    assert all((rest.weights[k] == whole.weights[k]).all() and (rest.best[k] == whole.best[k]).all() for k in whole.weights)
    for other in ({"seed": 4}, {"limit": 5}):
        with pytest.raises(RuntimeError, match=next(iter(other))):
            training.train(learn, hold, DIMS, f"file://{tmp_path}/part", s, **{**kinds, **other})
    with pytest.raises(RuntimeError, match="config_hash"):
        training.train(learn, hold, DIMS, f"file://{tmp_path}/part", training.Settings(epochs=5, parts=2, hidden=6), **kinds)


def test_patience_ends_a_training(spark, tmp_path):
    frame = spark.createDataFrame(some(20), SCHEMA)
    s = training.Settings(epochs=9, parts=1, rate=0.0, decay=0.0, hidden=3, patience=2, augment=False)
    done = training.train(frame, frame, DIMS, f"file://{tmp_path}/t", s, seed=1)
    assert done.epoch == 3 and done.best_epoch == 1 and done.stale == 2


def test_phases_of_a_curriculum():
    s = training.Settings(epochs=100, curriculum=True, shares=(0.4, 0.8, 0.6), fractions=(0.3, 0.5, 0.2))
    assert training.phase(s, 30) == ("warmup", 0.4, 0.3) and training.phase(s, 71) == ("transfer", 0.6, 0.2)
    name, share, fraction = training.phase(s, 50)
    assert name == "robust" and abs(share - 0.6) < 1e-12 and abs(fraction - 0.4) < 1e-12
    assert training.phase(training.Settings(augment=False), 1)[1] == 0.0


def test_blocks_of_ten_thousand_samples(spark):
    steps = 20
    rows = spark.range(10_000).select(F.concat(F.lit("id-"), "id").alias("id"), F.explode(F.sequence(F.lit(0), F.lit(2))).alias("c")).select("*", F.explode(F.sequence(F.lit(0), F.lit(steps - 1))).alias("t"))
    rows = rows.where("NOT (c = 2 AND pmod(xxhash64(id), 50) = 0 AND t > 0)")  # some have one bin there
    found = scenarios.drop_blocks(rows, "id", "c", "t", 7, 0.75, 0.6)
    each = found.groupBy("id", "c").agg(F.sort_array(F.collect_list(F.when(~F.col("kept"), F.col("t")))).alias("gone"), F.count("*").alias("m")).collect()
    lost = {}
    for r in each:
        assert len(r.gone) < r.m
        lost.setdefault(r.id, {})[r.c] = r.gone
    hit = {k: [c for c, g in v.items() if g] for k, v in lost.items() if any(v.values())}
    assert abs(len(hit) / 10_000 - 0.75) < 0.02
    counts = Counter(len(c) for c in hit.values())
    assert all(abs(counts[n] / len(hit) - p) < 0.025 for n, p in ((1, 0.55), (2, 0.35), (3, 0.10)))
    runs = Counter(1 + sum(b != a + 1 for a, b in zip(g, g[1:], strict=False)) for v in lost.values() for g in v.values() if g)
    assert set(runs) == {1, 2, 3} and runs[1] > runs[2] > runs[3]
    starts = Counter(g[0] for v in lost.values() for g in v.values() if g)
    assert max(starts.values()) / min(starts[t] for t in range(8)) < 8  # all places occur
    masks = np.ones((200, 3, steps), bool)
    keys = [f"id-{i}" for i in range(200)]
    few = {r.id for r in rows.where("c = 2").groupBy("id").count().where("count = 1").collect()}
    for i, k in enumerate(keys):
        masks[i, 2, 1:] &= k not in few
    kept = scenarios.block_flags(masks, keys, 7, 0.75, 0.6)
    for i, k in enumerate(keys):
        assert [sorted(np.flatnonzero(masks[i, c] & ~kept[i, c]).tolist()) for c in range(3)] == [lost[k][c] for c in range(3)]
    again = scenarios.drop_blocks(rows, "id", "c", "t", 8, 0.75, 0.6)
    other = found.where("NOT kept").select("id", "c", "t").intersect(again.where("NOT kept").select("id", "c", "t")).count()
    assert other < 0.6 * found.where("NOT kept").count()  # another seed draws apart


def test_points_without_replacement(spark):
    rows = spark.range(4000).select(F.concat(F.lit("x"), "id").alias("id"), F.explode(F.sequence(F.lit(0), F.lit(2))).alias("c")).select("*", F.explode(F.expr("sequence(0, CASE WHEN c = 1 THEN 0 ELSE 9 END)")).alias("t"))
    found = scenarios.drop_points(rows, "id", "c", "t", 3, 0.75, 0.25).groupBy("id", "c").agg(F.count_if(~F.col("kept")).alias("lost"), F.count("*").alias("m")).collect()
    assert {(r.m, r.lost) for r in found} == {(1, 0), (10, 0), (10, 3)}
    hit = {r.id for r in found if r.lost}
    both = Counter(r.id for r in found if r.lost)
    assert abs(len(hit) / 4000 - 0.75 * (1 / 3 * 2 / 3 + 2 / 3)) < 0.03 and set(both.values()) == {1, 2}
    places = Counter(r.t for r in scenarios.drop_points(rows, "id", "c", "t", 3, 0.75, 0.25).where("NOT kept").collect())
    assert max(places.values()) < 1.25 * min(places.values())


def test_stages_are_made_once(spark, tmp_path):
    made = []

    def stage(name, fails=()):
        def make(before):
            made.append(name)
            if made.count(name) in fails:
                raise OSError(f"{name} is lost")
            return spark.range(3).selectExpr("id", f"'{name}' AS name") if before is None else before.selectExpr("id + 1 AS id", f"'{name}' AS name")
        return make

    folder = f"file://{tmp_path}/run"
    stages = {"a": stage("a"), "b": stage("b", (1, 2)), "c": stage("c")}
    for _ in range(2):
        with pytest.raises(OSError, match="b is lost"):
            run_stages(spark, folder, stages, {"x": 1, "y": [2]}, seed=5)
    status = {r.stage: r for r in Run(spark, folder, {"y": [2], "x": 1}, seed=5, stages=["a", "b", "c"]).status().collect()}
    assert {k: (r.status, r.attempts) for k, r in status.items()} == {"a": ("DONE", 1), "b": ("FAILED", 2)} and "b is lost" in status["b"].error
    assert sorted(r.id for r in run_stages(spark, folder, stages, {"x": 1, "y": [2]}, seed=5).collect()) == [2, 3, 4]
    assert made == ["a", "b", "b", "b", "c"]
    run_stages(spark, folder, stages, {"x": 1, "y": [2]}, seed=5)
    assert made == ["a", "b", "b", "b", "c"]
    for other in ({"config": {"x": 2, "y": [2]}}, {"seed": 6}, {"limit": 10}):
        with pytest.raises(RuntimeError, match="another run"):
            run_stages(spark, folder, stages, **{"config": {"x": 1, "y": [2]}, "seed": 5, **other})
    with pytest.raises(RuntimeError, match="stages"):
        run_stages(spark, folder, {"a": stage("a")}, {"x": 1, "y": [2]}, seed=5)


def test_a_driver_that_died_leaves_no_table_that_counts(spark, tmp_path):
    folder = f"file://{tmp_path}/run"
    run = Run(spark, folder, {})
    run.files.put("a/RUNNING-1", json.dumps({"attempt": 1}))  # died in the middle, with part of its table written
    spark.range(9).write.parquet(f"{folder}/a/attempt-1")
    assert [(r.stage, r.status) for r in run.status().collect()] == [("a", "RUNNING")]
    assert run.stage("a", lambda: spark.range(2)).count() == 2 and run.done("a")["attempt"] == 2
    assert not run.files.put("a/DONE", "{}") and run.done("a")["attempt"] == 2


def gated_fusion_by_hand(w, features, masks, heads, fusion):
    """One sample through the gated fusion, step by step."""
    def line(name, x):
        return [sum(a * b for a, b in zip(row, x, strict=True)) + bias for row, bias in zip(w[f"{name}.weight"].tolist(), w[f"{name}.bias"].tolist(), strict=True)]

    def norm(name, x):
        mean = sum(x) / len(x)
        var = sum((v - mean) ** 2 for v in x) / len(x)
        return [(v - mean) / math.sqrt(var + 1e-5) * g + b for v, g, b in zip(x, w[f"{name}.weight"].tolist(), w[f"{name}.bias"].tolist(), strict=True)]

    def act(x):
        return [0.5 * v * (1 + math.erf(v / math.sqrt(2))) for v in x]

    def soft(x):
        e = [math.exp(v - max(x)) for v in x]
        return [v / sum(e) for v in e]

    def add(*xs):
        return [sum(v) for v in zip(*xs, strict=True)]

    coverage, gap = [], []
    for m in masks:
        now = best = 0
        for v in m:
            now = 0 if v else now + 1
            best = max(best, now)
        coverage.append(sum(m) / STEPS)
        gap.append(best / STEPS)
    fused, gates = [], []
    for t in range(STEPS):
        hidden = [add(act(norm(f"project_norm{c}", line(f"project{c}", features[c][t] if masks[c][t] else [0.0] * DIMS[c]))), w["position.weight"][t].tolist(), w["channel.weight"][c].tolist()) for c in range(3)]
        on = [c for c in range(3) if masks[c][t]]
        if fusion == "dynamic":
            score = {c: line(f"gate{c}", hidden[c] + [1.0, coverage[c], 1 - gap[c]])[0] for c in on}
            top = math.fsum(math.exp(v - max(score.values())) for v in score.values()) if on else 1.0
            g = [math.exp(score[c] - max(score.values())) / top if c in score else 0.0 for c in range(3)]
        else:
            g = [1 / len(on) if c in on else 0.0 for c in range(3)]
        gates.append(g)
        x = sum(hidden, []) if fusion == "concat" else [sum(g[c] * hidden[c][d] for c in range(3)) for d in range(len(hidden[0]))]
        code = sum(1 << c for c in on)
        fused.append(act(norm("fuse_norm", line("fuse", x + w["state.weight"][code].tolist()))))
    open_ = [t for t in range(STEPS) if any(m[t] for m in masks)]
    width = len(fused[0])
    if open_:
        each = width // heads
        for k in range(2):
            q = [line(f"attend{k}", x) for x in fused]
            out = []
            for t in range(STEPS):
                mixed = []
                for h in range(heads):
                    a = slice(h * each, (h + 1) * each)
                    share = soft([sum(x * y for x, y in zip(q[t][a], q[u][width : 2 * width][a], strict=True)) / math.sqrt(each) for u in open_])
                    mixed += [sum(p * q[u][2 * width :][a][d] for p, u in zip(share, open_, strict=True)) for d in range(each)]
                x = norm(f"attend_norm{k}", add(fused[t], line(f"mix{k}", mixed)))
                out.append(norm(f"inner_norm{k}", add(x, line(f"inner_b{k}", act(line(f"inner_a{k}", x))))))
            fused = out
        share = soft([line("pool", fused[t])[0] for t in open_])
        pooled = [sum(p * fused[t][d] for p, t in zip(share, open_, strict=True)) for d in range(width)]
    else:
        pooled = w["fallback.weight"][0].tolist()
    head = pooled + coverage + gap
    logits, value = (line(f"{n}_b", act(line(f"{n}_a", norm(f"{n}_norm", head)))) for n in ("class", "value"))
    return soft(logits), 3 * math.tanh(value[0]), np.mean(gates, axis=0)


@pytest.mark.parametrize("fusion", ["dynamic", "mean", "concat"])
def test_gated_fusion_by_hand(spark, fusion):
    config = {"type": "dynamic_gate", "input_dims": DIMS, "max_length": STEPS, "projection_dim": 8, "attention_heads": 2, "feedforward_dim": 6, "fusion": fusion}
    model = models.build(config, seed=4)
    rows = some(10)
    got = {r.id: r for r in E.predict(spark.createDataFrame(rows, SCHEMA).repartition(2), model, 3).collect()}
    for r in rows:
        p, value, gates = gated_fusion_by_hand(model.w, r[1], r[2], 2, fusion)
        assert np.allclose(got[r[0]].probabilities, p, atol=1e-9) and abs(got[r[0]].intensity - value) < 1e-9 and np.allclose(got[r[0]].gates, gates, atol=1e-9)


def test_models_by_name():
    assert isinstance(models.build({"type": "V2", "input_dims": DIMS, "hidden_dim": 4, "expert_dim": 6}), models.LateFusion)
    mlp = models.build({"type": "concat_mlp", "input_dims": DIMS, "hidden_dim": 4})
    assert isinstance(models.build({"type": "concat_mlp", "input_dims": DIMS, "hidden_dim": 4}, mlp.w), models.ConcatMLP)
    for bad in ({"type": "other"}, {"type": "dynamic_gate", "projection_dim": 6, "attention_heads": 4}, {"fusion": "sum"}):
        with pytest.raises(ValueError):
            models.build({"input_dims": DIMS, **bad})
    with pytest.raises(ValueError, match="fit"):
        models.build({"type": "concat_mlp", "input_dims": DIMS, "hidden_dim": 5}, mlp.w)


def test_ablations_are_runs_of_their_own(spark, tmp_path):
    rows = some(60, 8, 0.9)
    frame = spark.createDataFrame(rows, SCHEMA)
    learn, hold = frame.where("pmod(xxhash64(id), 4) > 0"), frame.where("pmod(xxhash64(id), 4) = 0")
    s = training.Settings(epochs=2, parts=1, rate=0.05, hidden=4)
    kinds = {"seed": 3, "scenarios": [E.COMPLETE], "variants": {"plain": {"augment": False}}, "channels": CHANNELS[:1]}
    got = training.ablations(learn, hold, DIMS, f"file://{tmp_path}/a", s, **kinds).collect()
    assert [r.variant for r in got] == ["base", "plain", "text_only"] and all(0 <= r.accuracy <= 1 for r in got)
    before = sorted(p.name for p in (tmp_path / "a").rglob("RUNNING-*"))
    assert training.ablations(learn, hold, DIMS, f"file://{tmp_path}/a", s, **kinds).collect() == got and sorted(p.name for p in (tmp_path / "a").rglob("RUNNING-*")) == before
    one = training.single_channel(frame, 0).first()
    assert one.features[0] == rows[0][1][0] and not np.any(one.features[1]) and not np.any(one.masks[1:]) and one.masks[0] == rows[0][2][0]
