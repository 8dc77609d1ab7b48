"""Training a scorer on samples that stay where they are: gradients by partition, sums by a tree, AdamW on the driver.

A step is one pass over one part of the samples. Each task adds up gradients of its samples; partial sums are added in groups of FAN
until FAN are left, always in order of partitions, so a step gives the same numbers every time. The driver
holds the weights and their moments, which the model bounds, never samples. The state after each epoch is a stage of a Run: a run that is
begun again goes on from the last whole epoch, and one with another configuration, seed or limit is refused.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import asdict, dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.runs import Run
from ..shipping import ship
from . import evaluation as E
from . import metrics as M
from .models import ConcatMLP, Weights, drawn, masked_means, softmax
from .scenarios import block_flags

#: Partial sums that are added up together.
FAN = 32


@dataclass(frozen=True)
class Settings:
    """What a training is told. Fractions of the curriculum count epochs; rates and shares are those of its three phases."""

    epochs: int = 100
    patience: int = 12
    parts: int = 4
    rate: float = 3e-4
    least_rate: float = 1e-6
    cosine: bool = False
    decay: float = 1e-4
    clip: float = 1.0
    regression: float = 1.0
    consistency: float = 0.05
    smoothing: float = 0.0
    hidden: int = 256
    augment: bool = True
    curriculum: bool = False
    warmup: float = 0.30
    transfer: float = 0.70
    shares: tuple[float, float, float] = (0.40, 0.75, 0.75)
    fractions: tuple[float, float, float] = (0.30, 0.60, 0.60)


def phase(s: Settings, epoch: int) -> tuple[str, float, float]:
    """(name, share of samples, largest fraction) of an epoch's masking: fixed, or warm-up, a straight ramp and a steady end."""
    if not s.augment:
        return "none", 0.0, 0.0
    if not s.curriculum:
        return "fixed", s.shares[1], s.fractions[1]
    first, last = round(s.epochs * s.warmup), max(round(s.epochs * s.warmup), round(s.epochs * s.transfer))
    if epoch <= first:
        return "warmup", s.shares[0], s.fractions[0]
    if epoch <= last:
        ramp = min(1.0, (epoch - first) / max(last - first, 1))
        return "robust", *(a + ramp * (b - a) for a, b in ((s.shares[0], s.shares[1]), (s.fractions[0], s.fractions[1])))
    return "transfer", s.shares[2], s.fractions[2]


def losses(logits: np.ndarray, intensity: np.ndarray, label: np.ndarray, target: np.ndarray, class_weights: np.ndarray, smoothing: float = 0.0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Weighted cross entropy, Huber and consistency loss of each sample; slopes: of cross entropy by logits, of consistency by
    logits, of (Huber, consistency) by intensity."""
    p, n = softmax(logits), np.arange(len(label))
    classes = logits.shape[1]
    wanted = np.full_like(p, smoothing / classes) * class_weights
    wanted[n, label] += (1 - smoothing) * class_weights[label]
    entropy = -(wanted * np.log(np.maximum(p, 1e-300))).sum(axis=1)
    d_entropy = p * wanted.sum(axis=1, keepdims=True) - wanted
    error = intensity - target
    huber = np.where(np.abs(error) <= 1, 0.5 * error * error, np.abs(error) - 0.5)
    gap = p[:, -1] - p[:, 0] - intensity / 3
    turn = np.zeros_like(p)
    turn[:, -1], turn[:, 0] = 1, -1
    d_gap = p * (turn - (p * turn).sum(axis=1, keepdims=True))
    return entropy, huber, gap * gap, d_entropy, 2 * gap[:, None] * d_gap, np.stack([np.clip(error, -1, 1), -2 * gap / 3], axis=1)


def flat(w: Weights) -> np.ndarray:
    return np.concatenate([w[k].reshape(-1) for k in sorted(w)])


def shaped(x: np.ndarray, like: Weights) -> Weights:
    out, at = {}, 0
    for k in sorted(like):
        out[k] = x[at : at + like[k].size].reshape(like[k].shape)
        at += like[k].size
    return out


def tree_sum(parts: DataFrame, tasks: int) -> np.ndarray:
    """The sum of all vectors (pid, v as float64 bytes), added in order of pid, FAN at a time; at most FAN of them come to the driver."""

    def add(group: pa.Table) -> pa.Table:
        ordered = group.sort_by("pid")
        total = np.sum([np.frombuffer(x.as_buffer(), "<f8") for x in ordered["v"]], axis=0)
        return pa.table({"pid": pa.array([ordered["pid"][0].as_py() // FAN], pa.int64()), "v": pa.array([total.tobytes()], pa.binary())})

    while tasks > FAN:
        parts = parts.groupBy((F.col("pid") / FAN).cast("long").alias("g")).applyInArrow(add, "pid bigint, v binary")
        tasks = -(-tasks // FAN)
    return np.sum([np.frombuffer(bytes(r["v"]), "<f8") for r in sorted(parts.collect(), key=lambda r: r["pid"])], axis=0)


def step_gradient(samples: DataFrame, weights: Weights, class_weights: np.ndarray, s: Settings, masking: tuple[str, float, float], seed: int, epoch: int) -> tuple[np.ndarray, dict[str, float]]:
    """Gradient of the mean loss over samples (k, f, m, l, t), as one vector, and the losses: cross entropy by the sum of class weights, the others by the number of samples."""
    size = flat(weights).size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, model = np.zeros(2 * size + 5), ConcatMLP(weights)
        for b in batches:
            if not b.num_rows:
                continue
            parts, flags = E.arrays(b, "f", "m")
            if masking[1] > 0:
                flags = block_flags(flags, ["null" if k is None else k for k in b.column("k").to_pylist()], f"{seed}|{epoch}", masking[1], masking[2])
            label, target = b.column("l").to_numpy(zero_copy_only=False).astype(np.int64), b.column("t").to_numpy(zero_copy_only=False).astype(float)
            kept = model.forward(masked_means(parts, flags))
            entropy, huber, gap, d_entropy, d_gap, d_value = losses(kept[4], kept[5], label, target, class_weights, s.smoothing)
            none = np.zeros(len(label))
            total[:size] += flat(model.gradient(kept, d_entropy, none))
            total[size : 2 * size] += flat(model.gradient(kept, s.consistency * d_gap, s.regression * d_value[:, 0] + s.consistency * d_value[:, 1]))
            total[2 * size :] += [entropy.sum(), huber.sum(), gap.sum(), class_weights[label].sum(), len(label)]
        if total[-1]:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([total.tobytes()], pa.binary())], ["pid", "v"])

    total = tree_sum(samples.mapInArrow(run, "pid bigint, v binary"), samples.rdd.getNumPartitions())
    if np.ndim(total) == 0:
        return np.zeros(size), {"cross_entropy": 0.0, "huber": 0.0, "consistency": 0.0, "n": 0.0}
    entropy, huber, gap, weight, n = total[2 * size :]
    found = {"cross_entropy": float(entropy / weight), "huber": float(huber / n), "consistency": float(gap / n), "n": float(n)}
    return total[:size] / weight + total[size : 2 * size] / n, found


def class_weights(samples: DataFrame, label: str, classes: int, mode: str) -> np.ndarray:
    """Weights of the classes by metrics.class_weights(), ones for mode none."""
    if mode == "none":
        return np.ones(classes)
    rows = M.class_weights(samples, label, tuple(range(classes)), mode).collect()  # one row a class
    return np.array([r["weight"] for r in sorted(rows, key=lambda r: r["class"])])


def priority(rows: list[dict]) -> float:
    """What chooses an epoch: 0.45 macro F1 of the complete view, 0.30 of the masked ones' mean, 0.15 the complete neutral F1, 0.10 the least macro F1 at the largest fraction."""
    if not rows:
        return -math.inf
    complete = [r for r in rows if r["scenario"] == "complete"] or rows[:1]
    masked = [r for r in rows if r["scenario"] != "complete"] or complete
    top = max(r["fraction"] for r in masked)
    mean = lambda name, of: float(np.mean([r[name] for r in of]))
    least = min(r["macro_f1"] for r in masked if abs(r["fraction"] - top) <= 1e-8)
    return 0.45 * mean("macro_f1", complete) + 0.30 * mean("macro_f1", masked) + 0.15 * mean("f1_1", complete) + 0.10 * least


@dataclass
class State:
    """All that an epoch leaves behind."""

    weights: Weights
    first: np.ndarray
    second: np.ndarray
    best: Weights
    steps: int = 0
    epoch: int = 0
    best_epoch: int = 0
    best_score: float = -math.inf
    stale: int = 0
    history: list[dict] = field(default_factory=list)

    def table(self, spark: SparkSession) -> DataFrame:
        facts = json.dumps({k: getattr(self, k) for k in ("steps", "epoch", "best_epoch", "best_score", "stale", "history")})
        rows = [("facts", None, None, None, facts)]
        for kind, held in (("weights", self.weights), ("best", self.best), ("moments", {"first": self.first, "second": self.second})):
            rows += [(kind, name, list(map(int, x.shape)), bytearray(x.astype("<f8").tobytes()), None) for name, x in held.items()]
        return spark.createDataFrame(rows, "kind string, name string, shape array<int>, v binary, facts string").coalesce(1)

    @staticmethod
    def of(table: DataFrame) -> State:
        held: dict[str, Weights] = {"weights": {}, "best": {}, "moments": {}}
        facts = {}
        for r in table.toLocalIterator():
            if r["kind"] == "facts":
                facts = json.loads(r["facts"])
            else:
                held[r["kind"]][r["name"]] = np.frombuffer(bytes(r["v"]), "<f8").reshape(r["shape"]).copy()
        return State(held["weights"], held["moments"]["first"], held["moments"]["second"], held["best"], **facts)


def adamw(state: State, gradient: np.ndarray, rate: float, decay: float, clip: float, betas: tuple[float, float] = (0.9, 0.999), eps: float = 1e-8) -> None:
    """One step: the gradient cut to a length of clip, weights shrunk by rate x decay, moments corrected for their start at 0."""
    length = float(np.sqrt((gradient * gradient).sum()))
    gradient = gradient * min(1.0, clip / (length + 1e-6)) if clip > 0 else gradient
    state.steps += 1
    state.first = betas[0] * state.first + (1 - betas[0]) * gradient
    state.second = betas[1] * state.second + (1 - betas[1]) * gradient * gradient
    up, down = state.first / (1 - betas[0] ** state.steps), state.second / (1 - betas[1] ** state.steps)
    x = flat(state.weights)
    state.weights = shaped(x - rate * decay * x - rate * up / (np.sqrt(down) + eps), state.weights)


def parted(run: Run, samples: DataFrame, parts: int, key: str, features: str, masks: str, label: str, target: str) -> list[DataFrame]:
    """Samples as (k, f, m, l, t), a stage of the run in folders by hash of the key, so that a step reads its own part alone."""
    rows = samples.select(F.col(key).cast("string").alias("k"), F.col(features).alias("f"), F.col(masks).alias("m"), F.col(label).cast("int").alias("l"), F.col(target).cast("double").alias("t"))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("k"), F.lit(parts)).cast("int"))
    whole = run.stage("parts", lambda: rows, ["part"], rows.schema)
    return [whole.where(F.col("part") == p).drop("part") for p in range(parts)]


def train(train_samples: DataFrame, valid_samples: DataFrame, dims: Sequence[int], folder: str, s: Settings, *, seed: int, scenarios: Sequence[E.Scenario] = (E.COMPLETE,), classes: int = 3, class_mode: str = "sqrt_inverse", limit: int | None = None, key: str = "id", features: str = "features", masks: str = "masks", label: str = "label", target: str = "target", halt: Callable[[int], bool] = lambda epoch: False) -> State:
    """Train a ConcatMLP, with its state in folder; the result's best weights are those of the epoch of the highest priority() over the scenarios.

    Runs end after the last epoch, or when as many epochs as the patience brought no score that is better by over 1e-8. A folder that holds
    a begun run is gone on with; halt(epoch) ends this driver's part after an epoch. Without training samples nothing is learned.
    """
    spark = train_samples.sparkSession
    ship(spark)
    config = {"settings": asdict(s), "dims": list(dims), "classes": classes, "class_mode": class_mode, "scenarios": [sc.name for sc in scenarios]}
    run = Run(spark, folder, config, seed=seed, limit=limit)
    parts = parted(run, train_samples, s.parts, key, features, masks, label, target)
    weigh = class_weights(train_samples, label, classes, class_mode)
    done = 0
    while run.done(f"epoch-{done + 1:05d}"):
        done += 1
    if done:
        state = State.of(run.stage(f"epoch-{done:05d}", lambda: None))
    else:
        start = drawn(ConcatMLP.shapes(dims, s.hidden, classes), seed)
        state = State(start, np.zeros(flat(start).size), np.zeros(flat(start).size), start)
    while state.epoch < s.epochs and state.stale < s.patience:
        epoch = state.epoch + 1

        def one_epoch(epoch: int = epoch) -> DataFrame:
            rate = s.least_rate + (s.rate - s.least_rate) * (1 + math.cos(math.pi * (epoch - 1) / s.epochs)) / 2 if s.cosine else s.rate
            masking, sums, seen = phase(s, epoch), dict.fromkeys(("cross_entropy", "huber", "consistency"), 0.0), 0.0
            for p in sorted(range(s.parts), key=lambda p: E.draw(seed, epoch, p, over=1 << 59)):
                gradient, found = step_gradient(parts[p], state.weights, weigh, s, masking, seed, epoch)
                if found["n"]:
                    adamw(state, gradient, rate, s.decay, s.clip)
                    seen += found["n"]
                    for name in sums:
                        sums[name] += found[name] * found["n"]
            rows = [r.asDict() for r in E.metrics(E.evaluate(valid_samples, ConcatMLP(state.weights), scenarios, len(dims), classes, key=key, features=features, masks=masks, label=label, target=target), classes).orderBy("place").collect()]  # one row a scenario
            score = priority(rows)
            better = score > state.best_score + 1e-8
            state.epoch, state.stale = epoch, 0 if better else state.stale + 1
            if better:
                state.best, state.best_epoch, state.best_score = state.weights, epoch, score
            mean = {name: x / max(seen, 1.0) for name, x in sums.items()}
            state.history.append({"epoch": epoch, "phase": masking[0], "rate": rate, **mean, "loss": mean["cross_entropy"] + s.regression * mean["huber"] + s.consistency * mean["consistency"], "score": score, "better": better})
            return state.table(spark)

        run.stage(f"epoch-{epoch:05d}", one_epoch)
        if halt(epoch):
            break
    return state


def single_channel(samples: DataFrame, channel: int, features: str = "features", masks: str = "masks") -> DataFrame:
    """The samples with the features and masks of all channels but one blanked."""
    blank = F.transform(features, lambda x, c: F.when(c == channel, x).otherwise(F.transform(x, lambda v: F.transform(v, lambda y: F.when(F.lit(False), y).otherwise(F.lit(0))))))
    closed = F.transform(masks, lambda m, c: F.when(c == channel, m).otherwise(F.transform(m, lambda x: F.lit(False))))
    return samples.withColumns({features: blank, masks: closed})


def ablations(train_samples: DataFrame, valid_samples: DataFrame, dims: Sequence[int], folder: str, s: Settings, *, seed: int, scenarios: Sequence[E.Scenario], variants: dict[str, dict], channels: Sequence[str] = (), **columns: str) -> DataFrame:
    """(variant, best_epoch, score, accuracy, macro_f1, mae) of trainings that differ from the settings in what each variant names, and of each channel alone.

    Every training is a run of its own below folder, so a call that is made again trains only what isn't done. Accuracy, macro F1 and mean absolute error are those of the best epoch's
    weights on the complete view.
    """
    spark = train_samples.sparkSession
    planned: list[tuple[str, Settings, int | None]] = [(name, replace(s, **other), None) for name, other in {"base": {}, **variants}.items()]
    planned += [(f"{name}_only", s, c) for c, name in enumerate(channels)]
    rows = []
    for name, settings, channel in planned:
        own = [x if channel is None else single_channel(x, channel, columns.get("features", "features"), columns.get("masks", "masks")) for x in (train_samples, valid_samples)]
        state = train(*own, dims, f"{folder}/{name}", settings, seed=seed, scenarios=scenarios, **columns)
        r = E.metrics(E.evaluate(own[1], ConcatMLP(state.best), [E.COMPLETE], len(dims), **columns)).first()  # one row
        rows.append((name, state.best_epoch, float(state.best_score), r["accuracy"], r["macro_f1"], r["mae"]))
    return spark.createDataFrame(rows, "variant string, best_epoch int, score double, accuracy double, macro_f1 double, mae double")
