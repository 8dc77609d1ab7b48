"""Toxicity: a convolutional text classifier over hashed word embeddings, trained in numpy.

Words (runs of letters, digits and non-ASCII bytes, ASCII case folded) are hashed to BUCKETS
embeddings, and so are their first PREFIX bytes; a word is the sum of the two, so that what is learnt
of a word carries over to words that begin alike. For each filter width, filters slide over the words of a text; each filter's largest
response in the text is a feature, and a logistic layer weighs the features. Scoring needs no matrix
product: for each width and place the filters are applied to the whole embedding table once, so a text is
gathers, sums and maxima over its words, whatever its length.

Training. The fit sees at most FIT labelled texts (a documented bound; chosen by hash of the text's
key, so it is the same on every run), in full. Embeddings start from the words' smoothed log-odds in these texts,
so that rare labels suffice; all weights then train by gradient steps through the maxima (Adam).
A monotone logistic map fitted on texts left out of training calibrates scores, and a threshold is chosen
for each language on the same texts, where it has enough of them. The score itself never depends on
language, source, key or label.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import FOLD, encode, mix, returning, ship, slices, span_hashes, table

BUCKETS, DIM, FILTERS, WIDTHS = 1 << 16, 8, 8, (1, 2, 3)
#: Labelled texts that a fit sees at most, and their bytes at most (whole texts; see ``sample``).
FIT, FIT_BYTES = 6000, 24 << 20
#: Bytes of a word's beginning that has an embedding too.
PREFIX = 6
EPOCHS, RATE, BATCH = 6, 0.02, 128
#: Score that counts as toxic, and texts a language needs for a threshold of its own.
THRESHOLD, ENOUGH = 0.3, 40

IN_WORD = np.zeros(256, bool)
IN_WORD[48:58] = IN_WORD[65:91] = IN_WORD[97:123] = True
IN_WORD[128:] = True


def word_ids(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all words and of their beginnings (n, 2), and where each text's begin (one more at the end)."""
    data, offsets = encode(texts)
    inside = IN_WORD[data]
    edge = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).view(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return np.zeros((0, 2), np.int32), np.zeros(len(offsets), np.int64)
    folded = FOLD[data]
    both = [span_hashes(folded, starts, ends), mix(span_hashes(folded, starts, np.minimum(ends, starts + PREFIX)) + np.uint64(1))]
    return (np.stack(both, axis=1) >> np.uint64(64 - 16)).astype(np.int32), np.searchsorted(starts, offsets)


@dataclass
class Model:
    embed: np.ndarray  # (BUCKETS, DIM)
    filters: list[np.ndarray]  # for each width w: (w, DIM, FILTERS)
    bias: np.ndarray  # (widths * FILTERS,)
    out: np.ndarray
    shift: float
    scale: float = 1.0  # calibration: sigmoid(scale * logit + offset)
    offset: float = 0.0
    thresholds: dict[str, float] | None = None

    def tables(self) -> list[list[np.ndarray]]:
        """Filter responses of every bucket, for each width and place."""
        return [[self.embed @ f[j] for j in range(len(f))] for f in self.filters]

    def tables_of(self, ids: np.ndarray) -> list[list[np.ndarray]]:
        """The same for the buckets in ids alone; other rows are zero."""
        used, out = np.unique(ids), []
        for f in self.filters:
            places = [np.zeros((BUCKETS, FILTERS), np.float32) for _ in f]
            for j, full in enumerate(places):
                full[used] = self.embed[used] @ f[j]
            out.append(places)
        return out

    def features(self, ids: np.ndarray, begin: np.ndarray, tables: list[list[np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        """Largest rectified response of each filter in each text, and the word at which it begins (-1: none)."""
        n = len(begin) - 1
        best, where = np.zeros((n, len(self.bias)), np.float32), np.full((n, len(self.bias)), -1, np.int64)
        for t, places in enumerate(tables):
            w = len(places)
            for i in range(n):
                a, b = begin[i], begin[i + 1] - w + 1
                if b <= a:
                    continue
                own = slice(t * FILTERS, (t + 1) * FILTERS)
                response = sum(places[j][ids[a + j : b + j, side]] for j in range(w) for side in (0, 1))
                at = response.argmax(axis=0)
                value = response[at, np.arange(FILTERS)] + self.bias[own]
                best[i, own] = np.maximum(value, 0)
                where[i, own] = np.where(value > 0, at + a, -1)
        return best, where

    def logits(self, texts: list, tables: list[list[np.ndarray]] | None = None) -> np.ndarray:
        tables = tables or self.tables()
        sizes = np.array([len(t or "") + 16 for t in texts], np.int64)
        parts = []
        for a, b in slices(len(texts), sizes, 2 << 20):
            ids, begin = word_ids(texts[a:b])
            parts.append(self.maxima(ids, begin, tables) @ self.out + self.shift)
        return np.concatenate(parts) if parts else np.zeros(0, np.float32)

    def maxima(self, ids: np.ndarray, begin: np.ndarray, tables: list[list[np.ndarray]]) -> np.ndarray:
        """As features(), without places, all texts at once."""
        n, sizes = len(begin) - 1, np.diff(begin)
        best = np.zeros((n, len(self.bias)), np.float32)
        for t, places in enumerate(tables):
            w = len(places)
            own, live = slice(t * FILTERS, (t + 1) * FILTERS), np.flatnonzero(sizes >= w)
            if not len(live):
                continue
            response = places[0][ids[: len(ids) - w + 1, 0]]
            for j, side in ((j, side) for j in range(w) for side in (0, 1) if j or side):
                response += places[j][ids[j : len(ids) - w + 1 + j, side]]
            if w > 1:  # windows that run into the next text don't count
                last = begin[1:][sizes > 0]
                for j in range(1, w):
                    over = last - j
                    response[over[(over >= 0) & (over < len(response))]] = -np.inf
            top = np.maximum.reduceat(response, np.minimum(begin[live], len(response) - 1), axis=0)
            best[live, own] = np.maximum(top + self.bias[own], 0)
        return best

    def scores(self, texts: list, tables: list[list[np.ndarray]] | None = None) -> np.ndarray:
        z = self.logits(texts, tables).astype(np.float64) * self.scale + self.offset
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def start(ids: np.ndarray, begin: np.ndarray, y: np.ndarray, seed: int = 5) -> Model:
    """A model whose first embedding coordinate is the words' log-odds and whose first filters pass it on."""
    rng = np.random.default_rng(seed)
    df = np.ones((2, BUCKETS)) * 0.5
    for i, label in enumerate(y):
        df[label, np.unique(ids[begin[i] : begin[i + 1]])] += 1
    n = np.bincount(y, minlength=2) + 1.0
    odds = np.log(df[1] / n[1]) - np.log(df[0] / n[0])
    support = df.sum(axis=0) - 1
    embed = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
    embed[:, 0] = np.where(support > 1, np.clip(odds, -4, 4), 0) / 2
    filters = [rng.normal(0, 0.1, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
    for f in filters:
        f[:, 0, : FILTERS // 2] += 1.0 / len(f)
    return Model(embed, filters, np.full(len(WIDTHS) * FILTERS, -0.2, np.float32), np.full(len(WIDTHS) * FILTERS, 0.1, np.float32), -1.0)


def fit(texts: list, labels: list[int], languages: list, seed: int = 5) -> Model:
    """Train on four fifths of the texts, calibrate and choose thresholds on the rest.

    Without texts, or with one label only, all scores are the smoothed share of label 1.
    """
    y = np.array(labels, np.int64)
    rate = (y.sum() + 0.5) / (len(y) + 1)
    parts = [word_ids(texts[a:b]) for a, b in slices(len(texts), np.array([len(t or "") + 16 for t in texts], np.int64), 2 << 20)]
    words = [ids[c[i] : c[i + 1]] for ids, c in parts for i in range(len(c) - 1)]
    if len(set(labels)) < 2:
        model = start(np.zeros((0, 2), np.int32), np.zeros(1, np.int64), np.zeros(0, np.int64))
        model.out[:] = 0
        model.shift, model.thresholds = float(np.log(rate / (1 - rate))), {}
        return model
    held = np.arange(len(y)) % 5 == 4
    if len(set(y[held])) < 2 or len(set(y[~held])) < 2:
        held[:] = False
    train, check = np.flatnonzero(~held), np.flatnonzero(held) if held.any() else np.arange(len(y))
    edges = lambda rows: np.concatenate(([0], np.cumsum([len(words[i]) for i in rows])))
    join = lambda rows: np.concatenate([words[i] for i in rows]) if len(rows) else np.zeros((0, 2), np.int32)
    model = start(join(train), edges(train), y[train], seed)
    rng, state = np.random.default_rng(seed), {}
    weight = np.where(y == 1, 0.5 / rate, 0.5 / (1 - rate))
    step = 0

    def adam(name: str, value: np.ndarray, slope: np.ndarray, rows: np.ndarray | None = None) -> None:
        m, v = state.setdefault(name, (np.zeros_like(value), np.zeros_like(value)))
        at = slice(None) if rows is None else rows
        m[at] = 0.9 * m[at] + 0.1 * slope
        v[at] = 0.99 * v[at] + 0.01 * slope**2
        value[at] -= RATE * (m[at] / (1 - 0.9**step)) / (np.sqrt(v[at] / (1 - 0.99**step)) + 1e-6)

    shift = np.array([model.shift], np.float32)
    for _ in range(EPOCHS):
        order = rng.permutation(train)
        for a in range(0, len(order), BATCH):
            rows, step = order[a : a + BATCH], step + 1
            own, cuts = join(rows), edges(rows)
            best, where = model.features(own, cuts, model.tables_of(own))
            z = best @ model.out + shift[0]
            g = ((1 / (1 + np.exp(-z)) - y[rows]) * weight[rows] / len(rows)).astype(np.float32)
            back = g[:, None] * model.out * (where >= 0)
            touched: list[np.ndarray] = []
            slopes: list[np.ndarray] = []
            for t, f in enumerate(model.filters):
                cols = slice(t * FILTERS, (t + 1) * FILTERS)
                at, d = where[:, cols], back[:, cols]
                text, filt = np.nonzero(at >= 0)
                first, amount = at[text, filt], d[text, filt]
                slope = np.zeros_like(f)
                for j in range(len(f)):
                    word = own[first + j]
                    np.add.at(slope[j].T, filt, amount[:, None] * (model.embed[word[:, 0]] + model.embed[word[:, 1]]))
                    touched += [word[:, 0], word[:, 1]]
                    slopes += [amount[:, None] * f[j][:, filt].T] * 2
                adam(f"f{t}", f, slope + 1e-4 * f)
            adam("bias", model.bias, back.sum(axis=0))
            adam("out", model.out, best.T @ g + 1e-4 * model.out)
            adam("shift", shift, np.array([g.sum()], np.float32))
            word, to = np.unique(np.concatenate(touched), return_inverse=True)
            if len(word):
                total = np.zeros((len(word), DIM), np.float32)
                np.add.at(total, to, np.concatenate(slopes))
                adam("embed", model.embed, total, word)
    model.shift = float(shift[0])
    calibrate(model, [texts[i] for i in check], y[check], [languages[i] for i in check])
    return model


def calibrate(model: Model, texts: list, y: np.ndarray, languages: list) -> None:
    """Scale and offset of the logistic map by Newton steps, then a threshold for each language of the best F1."""
    z = model.logits(texts).astype(np.float64)
    z = np.clip(z, -30, 30)
    a, b = 1.0, 0.0
    target = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / ((y == 0).sum() + 2))
    for _ in range(50):
        p = 1 / (1 + np.exp(-(a * z + b)))
        s = p * (1 - p) + 1e-9
        g = np.array([((p - target) * z).sum() + 1e-3 * a, (p - target).sum()])
        h = np.array([[(s * z * z).sum() + 1e-3, (s * z).sum()], [(s * z).sum(), s.sum() + 1e-3]])
        move = np.linalg.solve(h, g)
        a, b = a - np.clip(move[0], -1, 1), b - np.clip(move[1], -3, 3)
    model.scale, model.offset = float(max(a, 1e-3)), float(b)
    p = 1 / (1 + np.exp(-(model.scale * z + model.offset)))
    model.thresholds = {}
    for lang in sorted({x for x in languages if x is not None}):
        own = np.array([x == lang for x in languages])
        if own.sum() >= ENOUGH and 0 < y[own].sum() < own.sum():
            tries = np.linspace(0.05, 0.95, 19)
            f1 = [2 * ((p[own] >= t) & (y[own] == 1)).sum() / max(1, ((p[own] >= t).sum() + (y[own] == 1).sum())) for t in tries]
            top = np.flatnonzero(np.array(f1) >= max(f1) - 1e-12)
            model.thresholds[lang] = float(tries[top[len(top) // 2]])


def learnable(key: str, fold: int = 4, held: int = 2) -> Column:
    """Whether a row's label may be learnt: crc32 of the key as text mod fold is not held. Null keys count as empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % fold != held


def sample(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, language: str, most: int = FIT, most_bytes: int = FIT_BYTES) -> DataFrame:
    """(k, y, t, l): keys, labels, texts and languages for a fit: rows that may be learnt from, at most ``most`` of each label, in an order
    of hash, as far as ``most_bytes`` go. Rows without a label are left out; a key with several labels counts as its largest."""
    known = labels.where(F.col(label).isin(0, 1) & learnable(key)).groupBy(F.col(key).alias("lk")).agg(F.max(label).cast("int").alias("y"))
    order = F.xxhash64("lk", F.lit("fit"))
    chosen = None
    for y in (1, 0):
        part = known.where(F.col("y") == y).orderBy(order, "lk").limit(most)
        chosen = part if chosen is None else chosen.union(part)
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t"), F.col(language).cast("string").alias("l"))
    rows = rows.join(F.broadcast(chosen), rows["k"] == chosen["lk"]).select("k", "y", "t", "l", F.octet_length("t").alias("b"))
    sizes = sorted(((zlib.crc32(f"fit{r.k}".encode()), r.k, r.b or 0) for r in rows.select("k", "b").collect()), key=str)
    total, keep = 0, set()
    for _, k, b in sizes:
        if b <= most_bytes // 4 and total + b <= most_bytes:
            keep.add(k)
            total += b
    wanted = docs.sparkSession.createDataFrame([(k,) for k in sorted(keep)], "w bigint")
    return rows.join(F.broadcast(wanted), F.col("k") == F.col("w")).select("k", "y", "t", "l")


def score(docs: DataFrame, model: Model, text: str = "text", language: str = "lang", as_: tuple[str, str, str] = ("score", "predicted", "toxic_by_language")) -> DataFrame:
    """All columns of docs, with the score, whether it reaches THRESHOLD (int), and whether it reaches its language's threshold (boolean).

    Null and empty texts have the score of no words. Columns that carry the new names are replaced.
    """
    spark = docs.sparkSession
    ship(spark)
    docs = docs.drop(*as_)
    at, names = docs.columns.index(text), docs.columns
    spoken = names.index(language) if language in names else None
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = model.tables()
        for b in batches:
            s = model.scores(b.column(at).to_pylist(), tables)
            langs = b.column(spoken).to_pylist() if spoken is not None else [None] * len(s)
            limits = np.array([model.thresholds.get(x, THRESHOLD) for x in langs], np.float64)
            added = [pa.array(s, pa.float64()), pa.array((s >= THRESHOLD).astype(np.int32)), pa.array(s >= limits)]
            yield pa.RecordBatch.from_arrays([*b.columns, *added], [*names, *as_])

    return docs.mapInArrow(returning(run), f"{schema}, `{as_[0]}` double, `{as_[1]}` int, `{as_[2]}` boolean")


def train(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> Model:
    """Fit in one task, whose input is bounded by FIT and FIT_BYTES; the driver gets the model alone."""
    ship(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for b in batches for r in b.to_pylist()]
        rows.sort(key=lambda r: (zlib.crc32(f"fit{r['k']}".encode()), r["k"], r["t"] or "", r["l"] or ""))
        model = fit([r["t"] for r in rows], [r["y"] for r in rows], [r["l"] for r in rows])
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], ["model"])

    found = sample(docs, labels, "doc_id", "text", "toxic", "lang").repartition(1).mapInArrow(run, "model binary").collect()
    return pickle.loads(found[0]["model"]) if found else fit([], [], [])


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores of all documents, by a model fitted to the rows whose labels may be learnt."""
    docs = table(spark, sf_dir, "documents")
    model = train(spark, docs, table(spark, sf_dir, "labels"))
    scored = score(docs.select("doc_id", "text", "lang"), model)
    return scored.select("doc_id", (~learnable("doc_id")).alias("held_out"), "score", "predicted", "toxic_by_language")
