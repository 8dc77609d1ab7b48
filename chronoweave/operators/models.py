"""Models over masked sequences in numpy, as scorers for evaluation.evaluate() and evaluation.predict().

Weights are a table (name, shape, values): executors get them with the task, so their size is checked. A model never sees what a mask hides.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession

#: Bytes of weights that tasks are given at most.
MOST_BYTES = 256 << 20
_STEP = 1 / 512
_GRID = np.arange(-6 * 512, 6 * 512 + 2) * _STEP
_ERF = np.array([math.erf(x) for x in _GRID])
_SLOPE = 2 / math.sqrt(math.pi) * np.exp(-_GRID * _GRID)


def erf(x: np.ndarray) -> np.ndarray:
    """The error function to twelve digits: cubic pieces between exact values and slopes."""
    inside = np.clip(x, -6, 6)
    at = np.minimum(((inside + 6) / _STEP).astype(np.int64), len(_GRID) - 2)
    u = (inside - _GRID[at]) / _STEP
    a, b, c, d = _ERF[at], _ERF[at + 1], _SLOPE[at] * _STEP, _SLOPE[at + 1] * _STEP
    return a + u * (c + u * (3 * (b - a) - 2 * c - d + u * (2 * (a - b) + c + d)))


def gelu(x: np.ndarray) -> np.ndarray:
    return 0.5 * x * (1 + erf(x / math.sqrt(2)))


def gelu_slope(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + erf(x / math.sqrt(2))) + x * np.exp(-0.5 * x * x) / math.sqrt(2 * math.pi)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def normed(x: np.ndarray, eps: float = 1e-5) -> tuple[np.ndarray, np.ndarray]:
    """Rows less their mean over their deviation, and one over the deviation."""
    centred = x - x.mean(axis=-1, keepdims=True)
    scale = 1 / np.sqrt((centred * centred).mean(axis=-1, keepdims=True) + eps)
    return centred * scale, scale


Weights = dict[str, np.ndarray]


def layer(w: Weights, name: str, x: np.ndarray) -> np.ndarray:
    return x @ w[f"{name}.weight"].T + w[f"{name}.bias"]


def layer_norm(w: Weights, name: str, x: np.ndarray) -> np.ndarray:
    return normed(x)[0] * w[f"{name}.weight"] + w[f"{name}.bias"]


def weight_table(spark: SparkSession, weights: Weights) -> DataFrame:
    """(name, shape, values) of a model's weights."""
    rows = [(k, list(map(int, v.shape)), v.reshape(-1).astype(float).tolist()) for k, v in sorted(weights.items())]
    return spark.createDataFrame(rows, "name string, shape array<int>, values array<double>")


def weights_of(table: DataFrame) -> Weights:
    """The weights of a table; ValueError if they are more than tasks should be given, or a name comes twice."""
    size = table.selectExpr("sum(size(values)) * 8").first()[0] or 0
    if size > MOST_BYTES:
        raise ValueError(f"{size} bytes of weights, at most {MOST_BYTES}")
    out: Weights = {}
    for r in table.toLocalIterator():
        if r["name"] in out:
            raise ValueError(f"two weights are named {r['name']}")
        out[r["name"]] = np.array(r["values"], np.float64).reshape(r["shape"])
    return out


def drawn(shapes: dict[str, tuple[int, ...]], seed: int) -> Weights:
    """Starting weights: matrices and biases uniform within one over the root of their inputs, gains 1, offsets 0."""
    rng, out = np.random.default_rng(seed), {}
    for name, shape in shapes.items():
        if "norm" in name:
            out[name] = np.ones(shape) if name.endswith("weight") else np.zeros(shape)
        else:
            inputs = shape[-1] if len(shape) > 1 else shapes[name.replace("bias", "weight")][-1]
            out[name] = rng.uniform(-1, 1, shape) / math.sqrt(inputs)
    return out


def linear(name: str, out: int, into: int) -> dict[str, tuple[int, ...]]:
    return {f"{name}.weight": (out, into), f"{name}.bias": (out,)}


def masked_means(features: Sequence[np.ndarray], masks: np.ndarray) -> np.ndarray:
    """Mean of each channel's steps that count (zeros if none does), then each channel's share of steps that count."""
    kept = masks.astype(np.float64)
    means = [np.einsum("nt,ntd->nd", kept[:, c], np.where(masks[:, c, :, None], x, 0.0)) / np.maximum(kept[:, c].sum(axis=1, keepdims=True), 1) for c, x in enumerate(features)]
    return np.concatenate([*means, kept.mean(axis=2)], axis=1)


def even_gates(masks: np.ndarray) -> np.ndarray:
    """Equal weights for the channels that a step has."""
    kept = masks.transpose(0, 2, 1).astype(np.float64)
    return kept / np.maximum(kept.sum(axis=2, keepdims=True), 1)


class NearestCentroid:
    """Classes by the nearest centroid of masked means and coverages; probabilities fall with squared distance, the intensity is the classes' mean target."""

    def __init__(self, centroids: np.ndarray, targets: np.ndarray) -> None:
        self.centroids, self.targets = np.asarray(centroids, float), np.asarray(targets, float)

    def prepare(self, features: list[np.ndarray]) -> list[np.ndarray]:
        return features

    def predict(self, prepared: list[np.ndarray], masks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        x = masked_means(prepared, masks)
        p = softmax(-((x[:, None, :] - self.centroids[None]) ** 2).sum(axis=2))
        return p, p @ self.targets, even_gates(masks)


class ConcatMLP:
    """Masked means and coverages of all channels, normalised, one hidden layer, a head for classes and one for the intensity."""

    def __init__(self, weights: Weights) -> None:
        self.w = weights

    @staticmethod
    def shapes(dims: Sequence[int], hidden: int, classes: int = 3) -> dict[str, tuple[int, ...]]:
        into = sum(dims) + len(dims)
        return {"norm.weight": (into,), "norm.bias": (into,), **linear("hidden", hidden, into), **linear("class", classes, hidden), **linear("value", 1, hidden)}

    def prepare(self, features: list[np.ndarray]) -> list[np.ndarray]:
        return features

    def forward(self, x: np.ndarray) -> tuple[np.ndarray, ...]:
        unit, scale = normed(x)
        before = layer(self.w, "hidden", unit * self.w["norm.weight"] + self.w["norm.bias"])
        h = gelu(before)
        return unit, scale, before, h, layer(self.w, "class", h), 3 * np.tanh(layer(self.w, "value", h)[:, 0])

    def predict(self, prepared: list[np.ndarray], masks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        *_, logits, intensity = self.forward(masked_means(prepared, masks))
        return softmax(logits), intensity, even_gates(masks)

    def gradient(self, kept: tuple[np.ndarray, ...], d_logits: np.ndarray, d_intensity: np.ndarray) -> Weights:
        """Gradient of a sum over samples from its slopes by logits and intensity; kept is what forward() gave."""
        unit, scale, before, h, _, intensity = kept
        d_value = (d_intensity * (3 - intensity * intensity / 3))[:, None]
        out = {"class.weight": d_logits.T @ h, "class.bias": d_logits.sum(axis=0), "value.weight": d_value.T @ h, "value.bias": d_value.sum(axis=0)}
        d = (d_logits @ self.w["class.weight"] + d_value @ self.w["value.weight"]) * gelu_slope(before)
        into = unit * self.w["norm.weight"] + self.w["norm.bias"]
        out |= {"hidden.weight": d.T @ into, "hidden.bias": d.sum(axis=0)}
        d = d @ self.w["hidden.weight"]
        out |= {"norm.weight": (d * unit).sum(axis=0), "norm.bias": d.sum(axis=0)}
        return out


class LateFusion:
    """Experts on masked statistics of each channel, fused by how far each can be relied on, with a direct or a two-stage class head.

    Each step is projected; a channel's statistics are mean, maximum, deviation, first, last and mean step between neighbours over the steps that
    count, with its coverage, longest gap and whether it has any. Channels without a step give nothing to the fusion.
    """

    NAMES = ("coverage", "longest", "any")

    def __init__(self, weights: Weights, channels: int, two_stage: bool = True) -> None:
        self.w, self.channels, self.two_stage = weights, channels, two_stage

    @staticmethod
    def shapes(dims: Sequence[int], hidden: int, expert: int, classes: int = 3) -> dict[str, tuple[int, ...]]:
        out: dict[str, tuple[int, ...]] = {}

        def norm(name: str, n: int) -> None:
            out.update({f"{name}.weight": (n,), f"{name}.bias": (n,)})

        facts, half, joint = 6 * hidden + 3, max(expert // 2, 16), max(expert, 128)
        for c, d in enumerate(dims):
            out |= linear(f"project{c}", hidden, d)
            norm(f"project_norm{c}", hidden)
            norm(f"expert_norm{c}", facts)
            out |= linear(f"expert_a{c}", expert, facts) | linear(f"expert_b{c}", expert, expert)
            norm(f"trust_norm{c}", expert + 3)
            out |= linear(f"trust_a{c}", half, expert + 3) | linear(f"trust_b{c}", 1, half) | linear(f"expert_class{c}", classes, expert)
        n = len(dims)
        into = expert * (n + 1) + classes * n + 3 * n
        norm("joint_norm", into)
        out |= linear("joint_a", joint, into) | linear("joint_b", joint, joint) | linear("class", classes, joint) | linear("neutral", 1, joint) | linear("polar", 2, joint)
        norm("value_norm", joint)
        return out | linear("value_a", max(joint // 2, 32), joint) | linear("value_b", 1, max(joint // 2, 32))

    def prepare(self, features: list[np.ndarray]) -> list[np.ndarray]:
        """Projected steps: masks only choose among them, so all scenarios share them."""
        return [gelu(layer_norm(self.w, f"project_norm{c}", layer(self.w, f"project{c}", np.nan_to_num(x)))) for c, x in enumerate(features)]

    @staticmethod
    def statistics(x: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Six statistics of each dimension, and coverage, longest gap and whether there is any step."""
        n, steps = mask.shape
        on = mask[:, :, None]
        count, some = np.maximum(mask.sum(axis=1, keepdims=True), 1), mask.any(axis=1)
        mean = np.where(on, x, 0).sum(axis=1) / count
        std = np.sqrt(np.maximum(np.where(on, (x - mean[:, None]) ** 2, 0).sum(axis=1) / count, 1e-8))
        top = np.where(some[:, None], np.where(on, x, -np.inf).max(axis=1, initial=-1e4), 0)
        row = np.arange(n)
        first, last = (np.where(some[:, None], x[row, at], 0) for at in (mask.argmax(axis=1), steps - 1 - mask[:, ::-1].argmax(axis=1)))
        pair = mask[:, 1:] & mask[:, :-1]
        move = np.where(pair[:, :, None], x[:, 1:] - x[:, :-1], 0).sum(axis=1) / np.maximum(pair.sum(axis=1, keepdims=True), 1)
        now = most = np.zeros(n)
        for t in range(steps):
            now = np.where(mask[:, t], 0, now + 1)
            most = np.maximum(most, now)
        return np.concatenate([mean, top, std, first, last, move], axis=1), np.stack([mask.mean(axis=1), most / max(steps, 1), some], axis=1).astype(float)

    def predict(self, prepared: list[np.ndarray], masks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        w, experts, facts, trust, votes = self.w, [], [], [], []
        for c, x in enumerate(prepared):
            stats, fact = self.statistics(x, masks[:, c])
            some = fact[:, 2:]
            h = layer_norm(w, f"expert_norm{c}", np.concatenate([stats, fact], axis=1))
            e = gelu(layer(w, f"expert_b{c}", gelu(layer(w, f"expert_a{c}", h)))) * some
            h = gelu(layer(w, f"trust_a{c}", layer_norm(w, f"trust_norm{c}", np.concatenate([e, fact], axis=1))))
            trust.append(np.where(some > 0, layer(w, f"trust_b{c}", h), -1e4))
            votes.append(layer(w, f"expert_class{c}", e) * some)
            experts.append(e)
            facts.append(fact)
        some = np.stack([f[:, 2] for f in facts], axis=1)
        share = softmax(np.concatenate(trust, axis=1)) * some
        share = share / np.maximum(share.sum(axis=1, keepdims=True), 1e-8)
        fused = sum(e * share[:, c : c + 1] for c, e in enumerate(experts))
        h = layer_norm(w, "joint_norm", np.concatenate([*experts, fused, *votes, *facts], axis=1))
        h = gelu(layer(w, "joint_b", gelu(layer(w, "joint_a", h))))
        if self.two_stage:
            neutral, polar = sigmoid(layer(w, "neutral", h)), softmax(layer(w, "polar", h))
            p = np.concatenate([(1 - neutral) * polar[:, :1], neutral, (1 - neutral) * polar[:, 1:]], axis=1)
        else:
            p = softmax(layer(w, "class", h))
        value = layer(w, "value_b", gelu(layer(w, "value_a", layer_norm(w, "value_norm", h))))[:, 0]
        gates = share[:, None, :] * masks.transpose(0, 2, 1)
        return p, 3 * np.tanh(value), gates / np.maximum(gates.sum(axis=2, keepdims=True), 1e-8)


class GatedFusion:
    """Channels projected step by step, fused by gates, followed by self-attention over time and a pooled head.

    A gate weighs a channel's projected step with whether it is there, the channel's coverage and one less its longest gap; fusion is dynamic (softmax of the gates), mean
    or concat. A code of which channels a step has goes with the fused step. Steps without any channel are no keys of attention and no part of the pool; a sample without any step has the learned
    fallback state.
    """

    def __init__(self, weights: Weights, channels: int, heads: int, layers: int, fusion: str = "dynamic", covered: bool = True) -> None:
        if fusion not in ("dynamic", "mean", "concat"):
            raise ValueError(f"unknown fusion {fusion}")
        self.w, self.channels, self.heads, self.layers, self.fusion, self.covered = weights, channels, heads, layers, fusion, covered

    @staticmethod
    def shapes(dims: Sequence[int], steps: int, width: int, layers: int, inner: int, classes: int = 3, fusion: str = "dynamic", covered: bool = True) -> dict[str, tuple[int, ...]]:
        out: dict[str, tuple[int, ...]] = {"position.weight": (steps, width), "channel.weight": (len(dims), width), "state.weight": (1 << len(dims), width // 4), "fallback.weight": (1, width)}

        def norm(name: str, n: int) -> None:
            out.update({f"{name}.weight": (n,), f"{name}.bias": (n,)})

        for c, d in enumerate(dims):
            out |= linear(f"project{c}", width, d) | linear(f"gate{c}", 1, width + 3)
            norm(f"project_norm{c}", width)
        out |= linear("fuse", width, (width * len(dims) if fusion == "concat" else width) + width // 4)
        norm("fuse_norm", width)
        for k in range(layers):
            out |= linear(f"attend{k}", 3 * width, width) | linear(f"mix{k}", width, width) | linear(f"inner_a{k}", inner, width) | linear(f"inner_b{k}", width, inner)
            norm(f"attend_norm{k}", width)
            norm(f"inner_norm{k}", width)
        head = width + (2 * len(dims) if covered else 0)
        out |= linear("pool", 1, width)
        for name, n in (("class", classes), ("value", 1)):
            norm(f"{name}_norm", head)
            out |= linear(f"{name}_a", width // 2, head) | linear(f"{name}_b", n, width // 2)
        return out

    def prepare(self, features: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Each channel's projected steps, and what the projection makes of a step that is hidden."""
        out = []
        for c, x in enumerate(features):
            place = self.w["position.weight"][: x.shape[1]] + self.w["channel.weight"][c]
            step = lambda v, c=c: gelu(layer_norm(self.w, f"project_norm{c}", layer(self.w, f"project{c}", v)))
            out.append((step(np.nan_to_num(x)) + place, step(np.zeros((1, x.shape[2]))) + place))
        return out

    def attention(self, x: np.ndarray, open_: np.ndarray, k: int) -> np.ndarray:
        """One layer: attention among open steps, then the inner layer, each added to its input and normalised."""
        n, steps, width = x.shape
        q, key, value = (part.reshape(n, steps, self.heads, -1).transpose(0, 2, 1, 3) for part in np.split(layer(self.w, f"attend{k}", x), 3, axis=2))
        scores = q @ key.transpose(0, 1, 3, 2) / math.sqrt(width // self.heads)
        share = softmax(np.where(open_[:, None, None, :], scores, -np.inf))
        x = layer_norm(self.w, f"attend_norm{k}", x + layer(self.w, f"mix{k}", (share @ value).transpose(0, 2, 1, 3).reshape(n, steps, width)))
        return layer_norm(self.w, f"inner_norm{k}", x + layer(self.w, f"inner_b{k}", gelu(layer(self.w, f"inner_a{k}", x))))

    def predict(self, prepared: list[tuple[np.ndarray, np.ndarray]], masks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n, channels, steps = masks.shape
        now = gap = np.zeros((n, channels))
        for t in range(steps):
            now = np.where(masks[:, :, t], 0, now + 1)
            gap = np.maximum(gap, now)
        coverage, gap = masks.mean(axis=2), gap / max(steps, 1)
        hidden = [np.where(masks[:, c, :, None], x, blank) for c, (x, blank) in enumerate(prepared)]
        there = masks.transpose(0, 2, 1)
        if self.fusion == "dynamic":
            facts = [np.stack([masks[:, c], np.repeat(coverage[:, c : c + 1], steps, 1), np.repeat(1 - gap[:, c : c + 1], steps, 1)], axis=2) for c in range(channels)]
            scores = np.concatenate([layer(self.w, f"gate{c}", np.concatenate([h, facts[c]], axis=2)) for c, h in enumerate(hidden)], axis=2)
            scores = np.where(there, scores, -1e4)
            gates = np.exp(scores - scores.max(axis=2, keepdims=True)) * there
            gates = gates / np.maximum(gates.sum(axis=2, keepdims=True), 1e-8)
        else:
            gates = even_gates(masks)
        fused = np.concatenate(hidden, axis=2) if self.fusion == "concat" else sum(h * gates[:, :, c : c + 1] for c, h in enumerate(hidden))
        code = (masks * (1 << np.arange(channels))[None, :, None]).sum(axis=1)
        fused = gelu(layer_norm(self.w, "fuse_norm", layer(self.w, "fuse", np.concatenate([fused, self.w["state.weight"][code]], axis=2))))
        some = masks.any(axis=1)
        none = ~some.any(axis=1)
        open_ = some.copy()
        open_[none, 0] = True  # a key that no result depends on
        fused[none] = 0.0
        for k in range(self.layers):
            fused = self.attention(fused, open_, k)
        share = softmax(np.where(open_, layer(self.w, "pool", fused)[:, :, 0], -1e4))
        pooled = (fused * share[:, :, None]).sum(axis=1)
        pooled[none] = self.w["fallback.weight"][0]
        head = np.concatenate([pooled, coverage, gap], axis=1) if self.covered else pooled
        logits, value = (layer(self.w, f"{name}_b", gelu(layer(self.w, f"{name}_a", layer_norm(self.w, f"{name}_norm", head)))) for name in ("class", "value"))
        return softmax(logits), 3 * np.tanh(value[:, 0]), gates


def build(config: dict, weights: Weights | None = None, seed: int = 0) -> ConcatMLP | LateFusion | GatedFusion:
    """The model that a configuration names (type: dynamic_gate, late_fusion_v2 or concat_mlp), with given weights or drawn ones. ValueError for other types, and for weights of other shapes."""
    kind, dims = str(config.get("type", config.get("model_type", "dynamic_gate"))).lower(), tuple(config["input_dims"])
    steps, width, layers = int(config.get("max_length", 50)), int(config.get("projection_dim", 128)), int(config.get("transformer_layers", 2))
    if kind in ("late_fusion_v2", "late_fusion", "v2"):
        shapes = LateFusion.shapes(dims, int(config.get("hidden_dim", 96)), int(config.get("expert_dim", 128)))
        make = lambda w: LateFusion(w, len(dims), config.get("classifier_mode", "two_stage") == "two_stage")
    elif kind == "concat_mlp":
        shapes, make = ConcatMLP.shapes(dims, int(config.get("hidden_dim", 256))), ConcatMLP
    elif kind == "dynamic_gate":
        fusion, covered = {"attention": "dynamic", "fixed": "mean"}.get(str(config.get("fusion", "dynamic")), str(config.get("fusion", "dynamic"))), bool(config.get("use_coverage_features", True))
        heads = int(config.get("attention_heads", 4))
        if width % heads:
            raise ValueError("the projection's width must be a multiple of the heads")
        shapes = GatedFusion.shapes(dims, steps, width, layers, int(config.get("feedforward_dim", 256)), fusion=fusion, covered=covered)
        make = lambda w: GatedFusion(w, len(dims), heads, layers, fusion, covered)
    else:
        raise ValueError(f"unknown type of model {kind}")
    weights = drawn(shapes, seed) if weights is None else weights
    if {k: tuple(v.shape) for k, v in weights.items()} != shapes:
        raise ValueError("the weights don't fit the configuration")
    return make(weights)
