"""Scoring samples under many masks in one pass: scenario grids, the masks they make, metrics of each.

A sample is a row: features (channels x steps x dims), masks (channels x steps), label and target. All scenarios of a sample are
scored where it is, in an Arrow batch, and a task gives one row of sums for each distinct scenario: confusion counts, error sums,
moments for the correlation, gates, statistics of the masks. What is shuffled is tasks x scenarios x some dozens of numbers, whatever
the samples' size. Scenarios that differ in their seed alone, but draw nothing, are scored once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass
from itertools import product
from typing import Protocol

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shipping import ship


class Scorer(Protocol):
    """A model: prepare() does what masks don't change, once a batch; predict() gives class probabilities [n, classes], an
    intensity [n] and the weight of each channel at each step [n, steps, channels]."""

    def prepare(self, features: list[np.ndarray]) -> object: ...

    def predict(self, prepared: object, masks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]: ...


@dataclass(frozen=True)
class Scenario:
    """Which channels (by number) miss what share of their steps, where, and how the gaps of several channels lie to one another."""

    name: str
    group: tuple[int, ...] = ()
    fraction: float = 0.0
    position: str = "none"
    relation: str = "none"
    seed: int | None = None

    @property
    def draws(self) -> bool:
        return self.relation == "stagger"

    @property
    def effect(self) -> tuple:
        """Equal for scenarios that make equal masks of any sample."""
        return self.group, self.fraction, self.position, self.relation, self.name if self.draws else None


COMPLETE = Scenario("complete")
#: Samples that a model predicts at once: attention holds a number for each pair of a sample's steps.
ROWS = 256


def subsets(channels: int) -> list[tuple[int, ...]]:
    """All non-empty subsets of the channels, small ones first."""
    found = [tuple(c for c in range(channels) if n >> c & 1) for n in range(1, 1 << channels)]
    return sorted(found, key=lambda g: (len(g), g))


def grid(channels: Sequence[str], fractions: Iterable[float], positions: Iterable[str], groups: Iterable[Sequence[int]], relations: Iterable[str], seeds: Iterable[int]) -> list[Scenario]:
    """The complete view, and each seed, fraction, position, group and relation; a group of one has relation single."""
    out, relations = [COMPLETE], tuple(relations)
    for seed, fraction, position, group in product(seeds, fractions, positions, [tuple(g) for g in groups]):
        if position not in ("front", "middle", "back"):
            raise ValueError(f"unknown position {position}")
        for relation in relations if len(group) > 1 else ("single",):
            name = f"{'+'.join(channels[c] for c in group)}__{round(fraction * 100):02d}__{position}__{relation}__s{seed}"
            out.append(Scenario(name, group, float(fraction), position, relation, int(seed)))
    return out


def whole(channels: Sequence[str], channel: int, seed: int) -> Scenario:
    """One channel missing altogether, where a sample has another."""
    return Scenario(f"{channels[channel]}__whole__single__s{seed}", (channel,), 1.0, "whole", "single", seed)


def configured(config: dict, channels: Sequence[str], kind: str) -> list[Scenario]:
    """The grids of a configuration: selection (to choose a model), full (to report) or compact, each with the whole first channel missing."""
    seeds = [int(s) for s in config.get("random_seeds", [2026])]
    one, every = [[c] for c in range(len(channels))], [list(range(len(channels)))]
    if kind == "compact":
        found = grid(channels, (0.2, 0.4), ("middle",), one + every, ("overlap",), seeds[:1])
    elif kind == "selection":
        found = grid(channels, config.get("selection_missing_fractions", [0.2]), config.get("selection_missing_positions", ["middle"]), config.get("selection_missing_groups", one + every), config.get("selection_relation_modes", ["overlap"]), seeds[:1])
    elif kind == "full":
        found = grid(channels, config.get("validation_missing_fractions", [0.1, 0.2, 0.4, 0.6]), config.get("validation_missing_positions", ["front", "middle", "back"]), config.get("validation_missing_groups", subsets(len(channels))), config.get("validation_relation_modes", ["overlap", "stagger"]), config.get("validation_mask_seeds", [2026, 42, 3407]))
    else:
        raise ValueError(f"unknown kind of grid {kind}")
    return [*found, whole(channels, 0, seeds[0])]


def draw(*parts: object, over: int) -> int:
    """A whole number in [0, over) that depends on the parts alone: 60 bits of their MD5, as scenarios.draw() in Spark and any SQL engine takes them."""
    return int(hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()[:15], 16) % over


class Masks:
    """A batch of masks [n, channels, steps], and what scenarios make of them."""

    def __init__(self, masks: np.ndarray, keys: Sequence) -> None:
        self.original, self.keys = masks, keys
        self.order = np.argsort(~masks, axis=2, kind="stable")  # available steps first
        self.count = masks.sum(axis=2)
        self.steps = np.arange(masks.shape[2])

    def under(self, scenario: Scenario) -> np.ndarray:
        """The masks under a scenario. A selected channel keeps a step if it had one, so no sample goes blank."""
        out, steps = self.original.copy(), len(self.steps)
        if scenario.position == "whole":
            c = scenario.group[0]
            others = np.delete(self.original, c, axis=1).any(axis=(1, 2))
            out[others, c] = False
            return out
        n = np.arange(len(out))
        for offset, c in enumerate(scenario.group):
            m = self.count[:, c]
            gap = np.where((m <= 1) | (scenario.fraction <= 0), 0, np.minimum(m - 1, np.maximum(1, np.ceil(m * scenario.fraction).astype(np.int64))))
            begin = {"front": np.zeros_like(m), "middle": (m - gap) // 2, "back": m - gap}[scenario.position]
            start = self.order[n, c, np.minimum(begin, steps - 1)]
            stop = self.order[n, c, np.clip(begin + gap - 1, 0, steps - 1)] + 1
            if scenario.draws and offset and len(scenario.group) > 1:
                most = steps // len(scenario.group) + 1
                shift = offset * np.array([draw(scenario.name, k, c, over=max(1, most)) for k in self.keys], np.int64)
                start, stop = np.minimum(steps, start + shift), np.minimum(steps, stop + shift)
            inside = (self.steps >= start[:, None]) & (self.steps < stop[:, None]) & (gap > 0)[:, None]
            out[:, c] &= ~inside
            lost = (m > 0) & ~out[:, c].any(axis=1)
            out[lost, c, self.order[lost, c, 0]] = True
        return out


def longest_runs(flags: np.ndarray) -> np.ndarray:
    """The longest stretch of true flags along the last axis."""
    now = most = np.zeros(flags.shape[:-1], np.int64)
    for t in range(flags.shape[-1]):
        now = np.where(flags[..., t], now + 1, 0)
        most = np.maximum(most, now)
    return most


def arrays(batch: pa.RecordBatch, features: str, masks: str) -> tuple[list[np.ndarray], np.ndarray]:
    """The features of each channel [n, steps, dims] and the masks [n, channels, steps] of a batch. ValueError if samples differ in shape."""
    n = batch.num_rows

    def block(values: pa.Array, name: str) -> np.ndarray:
        shape = []
        while pa.types.is_list(values.type) or pa.types.is_large_list(values.type):
            sizes = np.unique(pc.list_value_length(values).to_numpy(zero_copy_only=False)) if len(values) else np.array([0])
            if len(sizes) != 1 or np.isnan(sizes[0]) or values.null_count:
                raise ValueError(f"{name} has rows of different shapes, or null ones")
            shape.append(int(sizes[0]))
            values = values.flatten()
        return values.to_numpy(zero_copy_only=False).reshape(n, *shape)

    held = batch.column(masks)
    flags = block(held, masks).astype(bool)
    column = batch.column(features)
    parts = [block(pc.list_element(column, c), features).astype(np.float64) for c in range(flags.shape[1])] if n else []
    for x in parts:
        if x.shape[1] != flags.shape[2]:
            raise ValueError(f"{features} has {x.shape[1]} steps, {masks} {flags.shape[2]}")
    return parts, flags


def columns(classes: int, channels: int) -> dict[str, str]:
    """Names of a scenario's sums, and how tasks' values are joined."""
    out = {f"c{t}_{p}": "sum" for t in range(classes) for p in range(classes)}
    out |= dict.fromkeys(("n", "right", "absolute", "pairs", "t", "p", "tt", "pp", "tp", "unavailable", "steps"), "sum")
    for c in range(channels):
        out |= {f"{k}{c}": "sum" for k in ("gate", "original", "observed", "missing", "longest", "touched")}
        out |= {f"{k}{c}": "max" for k in ("missing_max", "longest_max", "start_max", "stop_max")}
        out |= {f"{k}{c}": "min" for k in ("start_min", "stop_min")}
    return out


def sums_of(own: Masks, masks: np.ndarray, label: np.ndarray, target: np.ndarray, scored: tuple[np.ndarray, np.ndarray, np.ndarray]) -> dict[str, float]:
    """A scenario's sums over one batch."""
    probability, intensity, gates = scored
    classes, (n, channels, steps) = probability.shape[1], masks.shape
    predicted = probability.argmax(axis=1)
    known = (label >= 0) & (label < classes)
    cells = np.bincount(label[known] * classes + predicted[known], minlength=classes * classes).reshape(classes, classes)
    both = np.isfinite(target) & np.isfinite(intensity)
    t, p = target[both], intensity[both]
    out: dict[str, float] = {f"c{a}_{b}": int(cells[a, b]) for a in range(classes) for b in range(classes)}
    out |= {"n": n, "right": int((label == predicted).sum()), "absolute": float(np.abs(target - intensity).sum()), "pairs": len(t), "t": float(t.sum()), "p": float(p.sum())}
    out |= {"tt": float((t * t).sum()), "pp": float((p * p).sum()), "tp": float((t * p).sum()), "unavailable": int((~masks.any(axis=(1, 2))).sum()), "steps": n * steps}
    for c in range(channels):
        had, gone = own.count[:, c], own.original[:, c] & ~masks[:, c]
        lost, run = gone.sum(axis=1), longest_runs(gone)
        share = lost / np.maximum(had, 1)
        hit = np.flatnonzero(lost)
        first, last = gone[hit].argmax(axis=1), steps - gone[hit][:, ::-1].argmax(axis=1)
        out |= {f"gate{c}": float(gates[:, :, c].sum()), f"original{c}": int(had.sum()), f"observed{c}": int((had - lost).sum()), f"missing{c}": float(share.sum()), f"longest{c}": float(run.sum() / steps), f"touched{c}": len(hit)}
        out |= {f"missing_max{c}": float(share.max(initial=0)), f"longest_max{c}": float(run.max(initial=0) / steps)}
        out |= {f"start_min{c}": float(first.min()), f"start_max{c}": float(first.max()), f"stop_min{c}": float(last.min()), f"stop_max{c}": float(last.max())} if len(hit) else {}
    return out


JOIN = {"sum": lambda a, b: a + b, "max": max, "min": min}


def evaluate(samples: DataFrame, scorer: Scorer, scenarios: Sequence[Scenario], channels: int, classes: int = 3, *, key: str = "id", features: str = "features", masks: str = "masks", label: str = "label", target: str = "target") -> DataFrame:
    """The sums of every scenario over all samples: one row a scenario, in the given order by its column place.

    Labels and targets are needed; labels outside the classes count as wrong and in no cell; targets that aren't finite leave the
    correlation. Repeated rows count each. No samples: no rows. Samples of different shapes are refused.
    """
    ship(samples.sparkSession)
    effects = list(dict.fromkeys(s.effect for s in scenarios))
    distinct = [next(s for s in scenarios if s.effect == e) for e in effects]
    names = columns(classes, channels)
    rows = samples.select(F.col(key).cast("string").alias("k"), F.col(features).alias("f"), F.col(masks).alias("m"), F.col(label).cast("long").alias("l"), F.col(target).cast("double").alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict[str, float]] = [{} for _ in distinct]
        for b in batches:
            if not b.num_rows:
                continue
            if b.column("l").null_count:
                raise ValueError("samples to be evaluated need labels")
            parts, flags = arrays(b, "f", "m")
            own, prepared = Masks(flags, ["null" if k is None else k for k in b.column("k").to_pylist()]), scorer.prepare(parts)
            truth, wanted = b.column("l").to_numpy(zero_copy_only=False), b.column("t").cast(pa.float64()).to_numpy(zero_copy_only=False).astype(float)
            for place, s in enumerate(distinct):
                now = own.under(s)
                new = sums_of(own, now, truth, wanted, scorer.predict(prepared, now))
                for name, value in new.items():
                    held[place][name] = JOIN[names[name]](held[place][name], value) if name in held[place] else value
        out = [{"effect": place, **{c: float(v) for c, v in own.items()}} for place, own in enumerate(held) if own]
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    schema = pa.schema([("effect", pa.int32()), *[(c, pa.float64()) for c in names]])
    parts = rows.mapInArrow(run, "effect int, " + ", ".join(f"{c} double" for c in names))
    joined = parts.groupBy("effect").agg(*[getattr(F, how)(c).alias(c) for c, how in names.items()])
    listed = [(i, effects.index(s.effect), s.name, "+".join(str(c) for c in s.group), s.fraction, s.position, s.relation, s.seed) for i, s in enumerate(scenarios)]
    frame = samples.sparkSession.createDataFrame(listed, "place int, effect int, scenario string, grp string, fraction double, position string, relation string, seed long")
    return frame.join(joined, "effect").drop("effect")  # as many rows as scenarios on either side


def metrics(sums: DataFrame, classes: int = 3) -> DataFrame:
    """(scenario, grp, fraction, position, relation, seed, n, accuracy, macro_f1, weighted_f1, mae, pearson, f1_0 .., composite, unavailable, gate0 ..) of evaluate()'s rows."""
    every = range(classes)
    cell = lambda t, p: F.col(f"c{t}_{p}")
    total = lambda cs: sum(cs[1:], cs[0])
    f1, support = [], []
    for c in every:
        true, made = total([cell(c, p) for p in every]), total([cell(t, c) for t in every])
        support.append(true)
        f1.append(F.coalesce(F.try_divide(2 * cell(c, c), true + made), F.lit(0.0)))
    macro = total(f1) / classes
    weighted = total([a * b for a, b in zip(f1, support, strict=True)]) / F.greatest(total(support), F.lit(1.0))
    count = F.col("pairs")
    spread = [F.greatest(F.col(x * 2) - F.col(x) * F.col(x) / count, F.lit(0.0)) for x in "tp"]
    level = [F.when(s <= 1e-12 * F.col(x * 2), 0.0).otherwise(s) for x, s in zip("tp", spread, strict=True)]  # what is left of equal values is rounding
    pearson = F.when(count >= 2, F.try_divide(F.col("tp") - F.col("t") * F.col("p") / count, F.nullif(F.sqrt(level[0] * level[1]), F.lit(0.0))))
    rows = sums.withColumns({"accuracy": F.col("right") / F.col("n"), "macro_f1": macro, "weighted_f1": weighted, "mae": F.col("absolute") / F.col("n"), "pearson": pearson, **{f"f1_{c}": f1[c] for c in every}})
    composite = (F.col("accuracy") + F.col("macro_f1") + (1 - F.col("mae") / 6) + (F.col("pearson") + 1) / 2) / 4
    gates = [(F.col(c) / F.col("steps")).alias(c) for c in sums.columns if c.startswith("gate")]
    return rows.select("place", "scenario", "grp", "fraction", "position", "relation", "seed", F.col("n").cast("long").alias("n"), "accuracy", "macro_f1", "weighted_f1", "mae", "pearson", *[f"f1_{c}" for c in every], composite.alias("composite"), F.col("unavailable").cast("long").alias("unavailable"), *gates)


def confusion(sums: DataFrame, classes: int = 3) -> DataFrame:
    """(scenario, true_class, predicted_class, count): all cells of all scenarios."""
    cells = F.array(*[F.struct(F.lit(t).alias("true_class"), F.lit(p).alias("predicted_class"), F.col(f"c{t}_{p}").cast("long").alias("count")) for t in range(classes) for p in range(classes)])
    return sums.select("scenario", F.explode(cells).alias("c")).select("scenario", "c.*")


def mask_audit(sums: DataFrame, channels: int) -> DataFrame:
    """(scenario, channel, original, observed, touched, start_min, start_max, stop_min, stop_max, missing shares and longest runs) of every scenario and channel."""

    def one(c: int) -> Column:
        whole_numbers = [F.col(f"{k}{c}").cast("long").alias(k) for k in ("original", "observed", "touched", "start_min", "start_max", "stop_min", "stop_max")]
        means = [(F.col(f"{k}{c}") / F.col("n")).alias(f"{k}_mean") for k in ("missing", "longest")]
        return F.struct(F.lit(c).alias("channel"), *whole_numbers, *means, *[F.col(f"{k}_max{c}").alias(f"{k}_max") for k in ("missing", "longest")])

    return sums.select("scenario", F.explode(F.array(*[one(c) for c in range(channels)])).alias("a")).select("scenario", "a.*")


def predict(samples: DataFrame, scorer: Scorer, channels: int, *, key: str = "id", features: str = "features", masks: str = "masks") -> DataFrame:
    """(key, probabilities, intensity, predicted, gates, coverage, unavailable) of each sample under its own masks; labels aren't needed."""
    ship(samples.sparkSession)
    kind = samples.schema[key].dataType.simpleString()
    rows = samples.select(F.col(key), F.col(features).alias("f"), F.col(masks).alias("m"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in (whole.slice(i, ROWS) for i in range(0, whole.num_rows, ROWS)):
                parts, flags = arrays(b, "f", "m")
                probability, intensity, gates = scorer.predict(scorer.prepare(parts), flags)
                lists = [pa.array(list(x), pa.list_(pa.float64())) for x in (probability, gates.mean(axis=1), flags.mean(axis=2))]
                columns_ = [b.column(0), lists[0], pa.array(intensity), pa.array(probability.argmax(axis=1).astype(np.int32)), lists[1], lists[2], pa.array(~flags.any(axis=(1, 2)))]
                yield pa.RecordBatch.from_arrays(columns_, [key, "probabilities", "intensity", "predicted", "gates", "coverage", "unavailable"])

    return rows.mapInArrow(run, f"`{key}` {kind}, probabilities array<double>, intensity double, predicted int, gates array<double>, coverage array<double>, unavailable boolean")


def pack_samples(bins: DataFrame, sample: str, channel: str, bin_: str, values: Sequence[str], channels: Sequence[str], steps: int) -> DataFrame:
    """(sample, features, masks) of long rows, one a sample, channel and step; absent steps are masked zeros. A sample has channels x steps rows at most."""
    found = F.map_from_entries(F.collect_list(F.struct(F.concat_ws("|", channel, bin_), F.array(*[F.col(v).cast("double") for v in values]))))
    each = bins.where(F.col(channel).isin(*channels) & F.col(bin_).between(0, steps - 1)).groupBy(sample).agg(found.alias("_m"))
    zeros = F.array(*[F.lit(0.0) for _ in values])
    line = F.sequence(F.lit(0), F.lit(steps - 1))

    def each_step(c: str, of: Callable[[Column], Column]) -> Column:
        return F.transform(line, lambda b: of(F.element_at("_m", F.concat_ws("|", F.lit(c), b.cast("string")))))

    features = F.array(*[each_step(c, lambda v: F.coalesce(v, zeros)) for c in channels])
    masks = F.array(*[each_step(c, lambda v: v.isNotNull()) for c in channels])
    return each.select(sample, features.alias("features"), masks.alias("masks"))
