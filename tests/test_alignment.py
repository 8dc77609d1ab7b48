"""Alignment, fallback times, pooling and metrics on inputs off the fixtures, against brute force and by hand."""

import math
import random
from functools import cache

from chronoweave.operators import alignment, metrics, sequences

INF, NAN = float("inf"), float("nan")


def distance(a, b):
    @cache
    def d(i, j):
        if not i or not j:
            return i + j
        return min(d(i - 1, j) + 1, d(i, j - 1) + 1, d(i - 1, j - 1) + (a[i - 1] != b[j - 1]))

    return d(len(a), len(b))


def gain(t, s, ratio):
    """What a match of some target and source words gains, or None."""
    a, b = "".join(t), "".join(s)
    if not a or not b:
        return None
    if len(t) + len(s) == 3:
        return 2.65 if a == b else None
    share = distance(a, b) / max(len(a), len(b))
    return 3.0 if share == 0 else 1.25 - share if share <= ratio else None


def best_sum(target, source, ratio):
    @cache
    def best(i, j):
        if i == len(target) and j == len(source):
            return 0.0
        found = []
        if i < len(target):
            found.append(best(i + 1, j) - 0.75)
        if j < len(source):
            found.append(best(i, j + 1) - 0.15)
        for a, b in ((1, 1), (1, 2), (2, 1)):
            if i + a <= len(target) and j + b <= len(source):
                g = gain(target[i : i + a], source[j : j + b], ratio)
                if g is not None:
                    found.append(best(i + a, j + b) + g)
        return max(found)

    return best(0, 0)


def test_alignments_are_the_best_there_are():
    r = random.Random(3)
    for _ in range(400):
        target, source = ([r.choice(["ab", "c", "abc", "abd", "abcd", "", "xyz", "d", "donot"]) for _ in range(r.randint(0, 7))] for _ in range(2))
        path = alignment.best_path(target, source, 0.34)
        total, i, j = 0.0, 0, 0
        for a, b, c, d, kind in path:
            assert a >= i and c >= j
            total += gain(target[a:b], source[c:d], 0.34) - 0.75 * (a - i) - 0.15 * (c - j)
            assert kind == ("equivalent_compound" if b - a + d - c == 3 else "exact" if target[a] == source[c] else "edit_distance")
            i, j = b, d
        total -= 0.75 * (len(target) - i) + 0.15 * (len(source) - j)
        assert abs(total - best_sum(tuple(target), tuple(source), 0.34)) < 1e-9
    assert alignment.best_path([], [], 0.34) == [] and alignment.best_path(["a"], [], 0.34) == []


def test_contractions_match_what_they_stand_for(spark):
    rows = spark.createDataFrame([(1, ["I'm", "can’t", "do", "not"], ["i", "am", "cannot", "don't"])], "id long, t array<string>, s array<string>")
    got = [tuple(r)[1:] for r in alignment.align(rows, "id", "t", "s", 0.34).orderBy("target_from").collect()]
    assert got == [(0, 1, 0, 2, "equivalent_compound"), (1, 2, 2, 3, "exact"), (2, 4, 3, 4, "equivalent_compound")]


def test_fallback_lies_between_the_nearest_matches(spark):
    rows = spark.createDataFrame([(1, 0, 0.0, 9.0, True), (1, 1, 1.0, 2.0, True), (1, 2, None, None, False), (1, 3, 5.0, 6.0, True), (2, 0, None, None, False), (3, 0, 0.0, 4.0, True), (3, 1, None, None, False), (3, 2, 4.001, 5.0, True)], "s long, n long, a double, b double, m boolean")
    got = {(r.s, r.n): (r.start, r.stop) for r in alignment.fallback(rows, "s", ["n"], "a", "b", "m", 10.0).collect()}
    assert got == {(1, 2): (2.0, 5.0), (2, 0): (0.0, 10.0), (3, 1): (None, None)}


def test_what_is_not_finite_weighs_nothing(spark):
    good = [(0.0, 2.0, 4.0), (1.0, 3.0, 8.0)]
    bad = [(0.0, INF, 1.0), (NAN, 2.0, 1.0), (0.0, NAN, 1.0), (-INF, 1.0, 1.0), (0.0, 2.0, INF), (0.0, 2.0, NAN), (2.0, 1.0, 5.0), (1.0, 1.0, 5.0), (None, 1.0, 5.0), (0.0, 1.0, None)]
    pooled = [sorted(map(tuple, sequences.overlap_pool(spark.createDataFrame([(1, *x) for x in part], "k long, s double, e double, v double"), ["k"], "s", "e", "v", duration=4.0, bins=4).collect())) for part in (good, good + bad)]
    assert pooled[0] == pooled[1] and [round(x[2], 6) for x in pooled[0]] == [4.0, 6.0, 8.0]
    vectors = spark.createDataFrame([(0, [1.0, INF]), (1, [3.0, 5.0]), (2, [NAN, 7.0]), (3, [5.0, None])], "id long, x array<double>")
    stats = sequences.fit_normalization(vectors, "x", vectors["id"] >= 0)
    assert {r.dim: (r.mean, r.n) for r in stats.collect()} == {0: (3.0, 3), 1: (6.0, 2)}
    z = {(r.id, r.dim): r.z for r in sequences.transform_normalization(vectors, "id", "x", stats).collect()}
    assert z[0, 1] == z[2, 0] == z[3, 1] == 0.0 and all(math.isfinite(v) for v in z.values())
    pairs = spark.createDataFrame([(1.0, 2.0), (2.0, 4.0), (3.0, 6.0), (NAN, 1.0), (INF, 0.0), (None, 1.0)], "x double, y double")
    assert abs(pairs.agg(metrics.pearson("x", "y").alias("r")).first().r - 1.0) < 1e-12
    assert pairs.limit(1).agg(metrics.pearson("x", "y").alias("r")).first().r is None


def test_tracks_follow_overlapping_boxes(spark):
    rows = [(1, 0, 0, 0.9, 0.0, 0.0, 2.0, 2.0), (1, 0, 1, 0.8, 5.0, 5.0, 7.0, 7.0), (1, 1, 2, 0.9, 5.1, 5.0, 7.0, 7.0), (1, 1, 3, 0.5, 0.1, 0.0, 2.0, 2.0), (1, 9, 4, 0.9, 0.0, 0.0, 2.0, 2.0)]
    got = {r.n: r.track for r in alignment.tracks(spark.createDataFrame(rows, "s long, f int, n long, c double, x0 double, y0 double, x1 double, y1 double"), "s", "f", "n", "c", 0.3, 5).collect()}
    assert got == {0: 0, 1: 1, 2: 1, 3: 0, 4: 2}
