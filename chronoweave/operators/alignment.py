"""Sequence alignment, fallback times, boxes and tracks, batch scoring."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import EQUIVALENTS, match_key
from ..shipping import ship

# What an alignment gains by equal words, by a word that equals two joined, by a near word (less the edit ratio), and by skipping.
EXACT, COMPOUND, NEAR, SKIP_TARGET, SKIP_SOURCE = 3.0, 2.65, 1.25, -0.75, -0.15
#: Gains that differ by less are equal.
TIE = 1e-9
#: Moves into a cell, in order of preference among equals: target and source words they use up, and the kind of match.
MOVES = ((2, 1, "equivalent_compound"), (1, 2, "equivalent_compound"), (1, 1, "edit_distance"), (1, 0, ""), (0, 1, ""))


#: Cells of distance rows that are held at once.
CELLS = 1 << 20


def letters_of(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of words as a padded matrix, their lengths, and which letters they have as 64 bits (letters of one remainder share a bit)."""
    sizes = np.array([len(w) for w in words], np.int64)
    letters = np.zeros((len(words), int(sizes.max(initial=0))), np.int32)
    for i, w in enumerate(words):
        letters[i, : len(w)] = [ord(c) for c in w]
    own = np.where(np.arange(letters.shape[1]) < sizes[:, None], np.uint64(1) << (letters % 64).astype(np.uint64), np.uint64(0))
    return letters, sizes, np.bitwise_or.reduce(own, axis=1, initial=np.uint64(0))


def edit_ratios(words: list[str], others: list[str], ratio: float = 1.0) -> np.ndarray:
    """Edit distance by the longer length of every pair; pairs beyond ratio may count as 1.

    An edit removes at most one letter that the other word lacks, so lengths and letters rule out most pairs; a row of distances at a time, for all
    pairs that are left at once.
    """
    (left, n, own), (right, m, other) = letters_of(words), letters_of(others)
    longest = np.maximum(np.maximum(n[:, None], m[None, :]), 1)
    lacking = np.maximum(np.bitwise_count(own[:, None] & ~other[None, :]), np.bitwise_count(other[None, :] & ~own[:, None]))
    at, by = np.nonzero(np.maximum(lacking, np.abs(n[:, None] - m[None, :])) / longest <= ratio)
    order = np.argsort(-n[at], kind="stable")  # those with letters left to read come first
    at, by = at[order], by[order]
    out = np.ones(longest.shape)
    step = max(1, CELLS // (right.shape[1] + 1))
    for i in range(0, len(at), step):
        a, b = at[i : i + step], by[i : i + step]
        width = int(m[b].max())
        steps, letters = np.arange(width + 1), right[b, :width]
        row = np.tile(steps, (len(a), 1))
        for c in range(int(n[a[0]])):
            live = int(np.searchsorted(-n[a], -c, "left"))
            before = row[:live]
            kept = np.minimum(before[:, 1:] + 1, before[:, :-1] + (letters[:live] != left[a[:live], c, None]))
            least = np.concatenate((before[:, :1] + 1, kept), axis=1) - steps
            row[:live] = np.minimum.accumulate(least, axis=1) + steps  # insertions run along the row
        out[a, b] = row[np.arange(len(a)), m[b]] / longest[a, b]
    return out


def gains(target: list[str], source: list[str], ratio: float) -> list[np.ndarray]:
    """What the moves of MOVES that match words gain where they start: minus infinity where they don't match."""
    number = {k: i for i, k in enumerate(dict.fromkeys([*target, *source]))}
    pairs = [[a + b for a, b in zip(x, x[1:], strict=False)] for x in (target, source)]
    code = lambda x: np.array([number.get(k, -1) if k else -1 for k in x], np.int64)
    t, s, tt, ss = code(target), code(source), code(pairs[0]), code(pairs[1])
    same = lambda x, y: (x[:, None] == y[None, :]) & (x >= 0)[:, None]
    two_one, one_two = (np.where(same(*x), COMPOUND, -np.inf) for x in ((tt, s), (t, ss)))
    left, right = list(dict.fromkeys(k for k in target if k)), list(dict.fromkeys(k for k in source if k))
    one_one = np.full((len(target), len(source)), -np.inf)
    if left and right:
        share = edit_ratios(left, right, ratio)
        rows, columns = {k: i for i, k in enumerate(left)}, {k: i for i, k in enumerate(right)}
        at, by = np.array([rows.get(k, -1) for k in target]), np.array([columns.get(k, -1) for k in source])
        there = np.ix_(at >= 0, by >= 0)
        r = share[np.ix_(at[at >= 0], by[by >= 0])]
        one_one[there] = np.where(r == 0, EXACT, np.where(r <= ratio, NEAR - r, -np.inf))
    return [two_one, one_two, one_one]


def best_path(target: list[str], source: list[str], ratio: float) -> list[tuple[int, int, int, int, str]]:
    """Matches (target from, to, source from, to, kind) of the best monotonic alignment of two lists of keys.

    Each row of the table of best sums comes from the two rows above it, all its cells at once; skipping along the row is a running maximum.
    """
    n, m = len(target), len(source)
    two_one, one_two, one_one = gains(target, source, ratio)
    some = [np.isfinite(g).any(axis=1) for g in (two_one, one_two, one_one)]  # rows in which anything matches
    tilt = SKIP_SOURCE * np.arange(m + 1)
    move = np.zeros((n + 1, m + 1), np.int8)
    above = before = np.full(m + 1, -np.inf)
    for i in range(n + 1):
        row = np.full(m + 1, -np.inf)
        row[0] = 0.0 if i == 0 else -np.inf
        offers = []
        if i > 1 and some[0][i - 2]:
            offers.append((0, 1, before[:-1] + two_one[i - 2]))
        if i:
            if some[1][i - 1]:
                offers.append((1, 2, above[:-2] + one_two[i - 1]))
            if some[2][i - 1]:
                offers.append((2, 1, above[:-1] + one_one[i - 1]))
            offers.append((3, 0, above + SKIP_TARGET))
        for kind, begin, sums in offers:
            better = sums > row[begin:] + TIE
            np.copyto(row[begin:], sums, where=better)
            np.copyto(move[i, begin:], kind, where=better, casting="unsafe")
        along = np.maximum.accumulate(row - tilt) + tilt
        better = along > row + TIE
        np.copyto(row, along, where=better)
        np.copyto(move[i], 4, where=better, casting="unsafe")
        above, before = row, above
    out, i, j = [], n, m
    while i or j:
        a, b, kind = MOVES[move[i, j]]
        if kind:
            out.append((i - a, i, j - b, j, "exact" if a == b and target[i - 1] == source[j - 1] else kind))
        i, j = i - a, j - b
    return out[::-1]


def align(rows: DataFrame, key: str, target: str, source: str, ratio: float) -> DataFrame:
    """(key, target_from, target_to, source_from, source_to, kind): the best monotonic alignment of two token arrays of a row.

    Tokens are compared by their match keys, contractions by what they stand for. A row's table has the product of its two lengths, so rows are dealt
    over all shuffle partitions: few bytes make much work.
    """
    ship(rows.sparkSession)
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.select(key, target, source).repartition(parts, F.xxhash64(key))  # by the key itself, Spark would leave rows as the join before has gathered them
    keys = dealt.select(key, *[F.transform(c, lambda w: match_key(w, EQUIVALENTS)).alias(c) for c in (target, source)])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for k, t, s in zip(b[key], b[target], b[source], strict=True):
                out += [(k, *x) for x in best_path(list(t), list(s), ratio)]
            yield pd.DataFrame(out, columns=[key, "target_from", "target_to", "source_from", "source_to", "kind"])

    return keys.mapInPandas(run, f"{key} {rows.schema[key].dataType.simpleString()}, target_from int, target_to int, source_from int, source_to int, kind string")


def fallback(rows: DataFrame, sample: str, order: list[str], start: str, stop: str, matched: str, duration: Column | float, least: float = 0.01) -> DataFrame:
    """Unmatched rows with a share of the time between the nearest matched rows before and after them, by their place among all of the sample's
    unmatched rows. Shares under ``least`` seconds in single precision are null."""
    line, end = Window.partitionBy(sample).orderBy(*order), duration if isinstance(duration, Column) else F.lit(duration)
    left = F.last(F.when(F.col(matched), F.least(F.col(stop), end)), ignorenulls=True).over(line.rowsBetween(Window.unboundedPreceding, -1))
    right = F.first(F.when(F.col(matched), F.col(start)), ignorenulls=True).over(line.rowsBetween(1, Window.unboundedFollowing))
    own = Window.partitionBy(sample, matched)
    rows = rows.withColumn("_l", F.coalesce(left, F.lit(0.0))).withColumn("_r", F.greatest(F.coalesce(right, end), "_l"))
    rows = rows.withColumn("_k", F.row_number().over(own.orderBy(*order)) - 1).withColumn("_g", F.count("*").over(own)).where(~F.col(matched))
    width = F.col("_r") - F.col("_l")
    rows = rows.withColumn("_a", F.col("_l") + width * F.col("_k") / F.col("_g")).withColumn("_b", F.col("_l") + width * (F.col("_k") + 1) / F.col("_g"))
    valid = F.col("_b").cast("float").cast("double") - F.col("_a").cast("float").cast("double") >= least
    return rows.withColumn("start", F.when(valid, F.col("_a"))).withColumn("stop", F.when(valid, F.col("_b"))).drop("_l", "_r", "_k", "_g", "_a", "_b")


def iou(a: list[Column], b: list[Column]) -> Column:
    """Intersection over union of two boxes (x0, y0, x1, y1)."""
    inter = F.greatest(F.least(a[2], b[2]) - F.greatest(a[0], b[0]), F.lit(0.0)) * F.greatest(F.least(a[3], b[3]) - F.greatest(a[1], b[1]), F.lit(0.0))
    area = lambda x: F.greatest(x[2] - x[0], F.lit(0.0)) * F.greatest(x[3] - x[1], F.lit(0.0))
    return inter / F.greatest(area(a) + area(b) - inter, F.lit(1e-12))


def tracks(rows: DataFrame, sample: str, frame: str, key: str, confidence: str, threshold: float, gap: int) -> DataFrame:
    """(sample, key, track): detections joined greedily, most confident first, to the open track of the best overlap.

    A track takes one detection of a frame, but one that begins there is open to the frame's other detections. Among equal overlaps the older track wins; boxes
    without an area overlap nothing.
    """

    def overlap(p: tuple, q: tuple) -> float:
        w, h = min(p[2], q[2]) - max(p[0], q[0]), min(p[3], q[3]) - max(p[1], q[1])
        inter = max(w, 0.0) * max(h, 0.0)
        area = [max(b[2] - b[0], 0.0) * max(b[3] - b[1], 0.0) for b in (p, q)]
        return inter / max(sum(area) - inter, 1e-12)

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values([frame, confidence, key], ascending=[True, False, True], kind="stable")
        open_: dict[int, tuple[int, tuple]] = {}
        out, current, taken, made = [], None, set(), 0
        for r in group.to_dict("records"):
            if r[frame] != current:
                current, taken = r[frame], set()
                open_ = {n: t for n, t in open_.items() if current - t[0] <= gap}  # tracks that are out of reach are done with
            box = (r["x0"], r["y0"], r["x1"], r["y1"])
            near = [(overlap(box, b), -n) for n, (f, b) in open_.items() if n not in taken]
            best = max(near, default=(0.0, 0))
            if best[0] > 0 and best[0] >= threshold:
                n = -best[1]
                taken.add(n)
            else:
                n, made = made, made + 1
            open_[n] = (r[frame], box)
            out.append((r[sample], r[key], n))
        return pd.DataFrame(out, columns=[sample, key, "track"])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    return rows.groupBy(sample).applyInPandas(run, f"{sample} {kinds[sample]}, {key} {kinds[key]}, track int")


def score_batches(rows: DataFrame, key: str, vector: str, weights: list[float]) -> DataFrame:
    """(key, score): a linear model's logistic scores, a matrix product a batch; the place to plug another model in."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        w = np.array(weights)
        for b in batches:
            x = np.stack(b[vector].to_list()).astype(np.float64) if len(b) else np.zeros((0, len(w)))
            yield pd.DataFrame({key: b[key], "score": 1 / (1 + np.exp(-(x @ w)))})

    return rows.select(key, vector).mapInPandas(run, f"{key} {rows.schema[key].dataType.simpleString()}, score double")
