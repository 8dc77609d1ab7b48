"""Language-model scores by a weighted backoff automaton over word n-grams.

Model: n-grams of one to three words, each order smoothed by the one below it. With counts c over the training
texts and p the model of the order below,

    P(w | h) = (c(hw) + STRENGTH p(w | h')) / (c(h) + STRENGTH),   h' = h without its first word,

and below all orders the unigrams: the unknown word has the share of training tokens that were new words seen
once (Good-Turing), known words the rest in proportion to their counts. The weights out of any history sum to one.

Automaton: a state is a history of two words, of one word (or the start of a text), or the empty one (root).
An arc for each n-gram hw that was seen leaves state h with weight log P(w | h) and leads to the longest history
that ends hw. Where a word has no arc, the failure arc of the state, of weight log(STRENGTH / (c(h) + STRENGTH)), leads to
h' and the word is tried there; the root has an arc for every word. One traversal from left to right carries
the state and adds up weights; all texts of a block move at once, a word a step.

No table of n-grams is gathered anywhere. Documents are dealt to blocks of about ``BLOCK`` bytes. Each
block sends its sorted distinct n-gram hashes with their training counts to shards by hash range; a
shard adds up counts and sends back, for each block, the totals in the block's own order; the block,
which has the same texts, builds the automaton of its own n-grams and runs it. A frequent n-gram is one
entry a block, however often it occurs. Words are told apart by 64-bit hashes, longer n-grams by as many bits as keep the share that
collides under one in ten thousand at the corpus's size (``gram_bits``).
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import encode, give_back, mix, ship, stash, table, word_hashes

BLOCK, SHARD = 4 << 20, 4 << 20
#: Weight of the lower order: as if so many words had been seen after each history of one and of two words.
STRENGTH = (100.0, 50.0)
START, END = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)


def learns(keys: list, fold: int = 10) -> np.ndarray:
    """Whether rows are for training: crc32 of the key as text mod fold is not 0. Null keys count as empty text: held out."""
    return np.array([zlib.crc32(b"" if k is None else str(k).encode()) % fold != 0 for k in keys], bool)


def gram_bits(size: int) -> int:
    """Bits that tell n-grams of a corpus of so many bytes apart."""
    return int(np.clip(int(size).bit_length() + 13, 48, 64))


def tokens(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each token, every text ending with END, and where each text's begin (one more at the end)."""
    data, offsets = encode(texts)
    words, starts = word_hashes(data)
    of = np.searchsorted(offsets, starts, "right") - 1
    count = np.bincount(of, minlength=len(texts))
    begin = np.concatenate(([0], np.cumsum(count + 1))).astype(np.int64)
    out = np.full(len(words) + len(texts), END, np.uint64)
    out[np.arange(len(words)) + of] = words
    return out, begin


def grams(word: np.ndarray, begin: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the two-word and three-word n-grams that end at each token (the first two-word one begins with START),
    and at which tokens a three-word one ends."""
    before = np.empty_like(word)
    before[1:] = word[:-1]
    before[begin[:-1]] = START
    shift = np.uint64(64 - bits)
    two = mix(before * np.uint64(0x9E3779B97F4A7C15) + word)
    long = np.ones(len(word), bool)
    long[begin[:-1]] = False
    long = np.flatnonzero(long)
    three = mix(two[long - 1] * np.uint64(0xD1342543DE82EF95) + word[long])
    return two >> shift, three >> shift, long


def tally(keys: np.ndarray, train: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and their training counts."""
    distinct, where = np.unique(keys, return_inverse=True)
    return distinct, np.bincount(where[train], minlength=len(distinct))


def pack(values: np.ndarray, width: int) -> bytes:
    """Unsigned integers as byte planes, which compress where high bytes are zero."""
    return np.ascontiguousarray(values.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T).tobytes()


def unpack(blob: bytes, width: int) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(blob, np.uint8).reshape(width, -1).T).reshape(-1).view(f"<u{width}").astype(np.uint64)


def shard_slices(keys: np.ndarray, shards: int, bits: int = 64) -> list[tuple[int, int, int]]:
    """(shard, start, stop) of the shards that sorted keys fall into: shards are equal ranges of the upper 32 of their bits."""
    shard = ((keys >> np.uint64(bits - 32)) * np.uint64(shards)) >> np.uint64(32)
    edge = np.flatnonzero(np.concatenate(([True], shard[1:] != shard[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return list(zip(shard[edge].tolist(), edge.tolist(), [*edge[1:].tolist(), len(keys)], strict=True)) if len(keys) else []


SENT = pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("kind", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())])
BACK = pa.schema([("block", pa.int32()), ("shard", pa.int32()), ("kind", pa.int32()), ("counts", pa.binary()), ("total", pa.int64()), ("known", pa.int64()), ("once", pa.int64())])


def score_texts(docs: DataFrame, key: str = "doc_id", text: str = "text", fold: int = 10, strength: tuple[float, float] = STRENGTH, block: int = BLOCK) -> tuple[DataFrame, int]:
    """(k, held_out, n_tokens, n_known, base_score, score) of each row, and the number of training tokens.

    Keys may be of any type; null keys are held out. Null text counts as empty: its one token is the end.
    Repeated rows each count and are scored. Texts of any length are scored whole. Without any training tokens the
    base is the uniform log10(0.1 / 0.1) = 0 of the one unknown token, and so is the model's. An empty table gives
    an empty result. Other columns are ignored.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    size = rows.agg(F.sum(F.octet_length("t") + 8)).first()[0] or 0
    bits = gram_bits(size)
    blocks, shards = max(1, -(-size // block)), max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // SHARD))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("k", "t"), F.lit(blocks)).cast("int"))

    def send(group: pa.Table) -> pa.Table:
        give_back()
        word, begin = tokens(group["t"].to_pylist())
        train = np.repeat(learns(group["k"].to_pylist(), fold), np.diff(begin))
        two, three, long = grams(word, begin, bits)
        out, number = [], group["block"][0].as_py()
        for kind, (keys, own) in enumerate(((word, train), (two, train), (three, train[long]))):
            distinct, counts = tally(keys, own)
            for s, i, j in shard_slices(distinct, shards, bits if kind else 64):
                out.append({"shard": s, "block": number, "kind": kind, "keys": pack(np.diff(distinct[i:j], prepend=np.uint64(0)), 8), "counts": pack(counts[i:j], 4)})
        return pa.Table.from_pylist(out, schema=SENT)

    def add_up(group: pa.Table) -> pa.Table:
        give_back()
        out = []
        for kind in (0, 1, 2):
            own = group.filter(pc.field("kind") == kind).to_pylist()
            if not own:
                continue
            keys = [np.cumsum(unpack(r["keys"], 8), dtype=np.uint64) for r in own]
            distinct, where = np.unique(np.concatenate(keys), return_inverse=True)
            counts = np.concatenate([unpack(r["counts"], 4) for r in own]).astype(np.float64)
            total = np.bincount(where, counts, len(distinct)).astype(np.int64)
            del counts
            at = 0
            for r, k in zip(own, keys, strict=True):
                out.append({"block": r["block"], "shard": r["shard"], "kind": kind, "counts": pack(total[where[at : at + len(k)]], 8), "total": None, "known": None, "once": None})
                at += len(k)
            if kind == 0:
                out.append({"block": -1, "shard": own[0]["shard"], "kind": -1, "counts": b"", "total": int(total.sum()), "known": int((total > 0).sum()), "once": int((total == 1).sum())})
        return pa.Table.from_pylist(out, schema=BACK)

    sent = rows.groupBy("block").applyInArrow(send, "shard int, block int, kind int, keys binary, counts binary")
    back = stash(sent.groupBy("shard").applyInArrow(add_up, "block int, shard int, kind int, counts binary, total bigint, known bigint, once bigint"), "ngram-counts")
    total, known, once = (int(x or 0) for x in back.where("block = -1").agg(F.sum("total"), F.sum("known"), F.sum("once")).first())

    def score(group: pa.Table, counts: pa.Table) -> pa.Table:
        give_back()
        word, begin = tokens(group["t"].to_pylist())
        ordered = sorted(counts.to_pylist(), key=lambda r: (r["kind"], r["shard"]))
        found = [np.concatenate([np.zeros(0), *[unpack(r["counts"], 8) for r in ordered if r["kind"] == kind]]) for kind in (0, 1, 2)]
        del ordered
        automaton = Automaton(word, begin, bits, found, total, once, strength)
        c = found[0][automaton.word_of]
        base, of = np.log10((c + 0.1) / (total + 0.1 * (known + 1))), np.repeat(np.arange(len(begin) - 1), np.diff(begin))
        n = len(begin) - 1
        sums = [np.bincount(of, x, n) for x in (c > 0, base)]
        held = ~learns(group["k"].to_pylist(), fold)
        columns = (group["k"], pa.array(held), pa.array(np.diff(begin)), pa.array(sums[0].astype(np.int64)), pa.array(sums[1]), pa.array(automaton.run()))
        return pa.Table.from_arrays(list(columns), ["k", "held_out", "n_tokens", "n_known", "base_score", "score"])

    kind = rows.schema["k"].dataType.simpleString()
    answers = back.where("block >= 0").select("block", "shard", "kind", "counts")
    scored = rows.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(score, f"k {kind}, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double")
    return scored, total


class Automaton:
    """States, arcs and failure arcs of the n-grams of some texts, and the texts.

    States: 0 is the root, 1 + w the history of word w, then the start of a text, then histories of two words.
    An arc's key is its state times the number of words, plus its word; keys are sorted.
    """

    def __init__(self, word: np.ndarray, begin: np.ndarray, bits: int, counts: list[np.ndarray], total: int, once: int, strength: tuple[float, float] = STRENGTH) -> None:
        """counts: training counts of the distinct words, two-word and three-word n-grams, each in order of its hashes."""
        self.begin = begin
        two, three, long = grams(word, begin, bits)
        words, first, self.word_of = np.unique(word, return_index=True, return_inverse=True)
        _, first2, two_of = np.unique(two, return_index=True, return_inverse=True)
        _, first3 = np.unique(three, return_index=True)
        del two, three
        self.word_of, two_of = self.word_of.astype(np.int32), two_of.astype(np.int32)
        c1, c2, c3 = counts
        n, start = len(words), len(words) + 1
        self.words = max(n, 1)
        ends = int(np.searchsorted(words, END))
        texts = c1[ends] if ends < n and words[ends] == END else 0.0  # as many texts start as end
        unknown = (once + 1) / (total + 2) if total else 1.0
        p1 = np.where(c1 > 0, (1 - unknown) * c1 / max(total, 1), unknown)
        opens = np.zeros(len(word), bool)
        opens[begin[:-1]] = True
        # two-word n-grams: the state before them, their word, their probability
        prior = np.where(opens[first2], start, 1 + self.word_of[first2 - 1])
        second = self.word_of[first2]
        seen_before = np.concatenate(([0.0], c1, [texts]))[prior]
        p2 = (c2 + strength[0] * p1[second]) / (seen_before + strength[0])
        # three-word n-grams: the two-word history, their word, the two-word n-gram they end with
        place = long[first3]
        history, last, ending = two_of[place - 1], self.word_of[place], two_of[place]
        p3 = (c3 + strength[1] * p2[ending]) / (c2[history] + strength[1])
        state2 = start + 1 + np.arange(len(c2))
        live2, live3 = c2 > 0, c3 > 0
        keys = np.concatenate((np.arange(n), prior[live2] * self.words + second[live2], state2[history[live3]] * self.words + last[live3]))
        weights = np.log10(np.concatenate((p1, p2[live2], p3[live3])))
        targets = np.concatenate((np.where(c1 > 0, 1 + np.arange(n), 0), state2[live2], state2[ending[live3]]))
        order = np.argsort(keys)
        self.keys, self.weights, self.targets = keys[order], weights[order], targets[order]
        del keys, weights, targets, order
        own = np.concatenate(([0.0], c1, [texts]))
        self.fail = np.concatenate((np.zeros(start + 1, np.int64), 1 + second))
        self.fail_weight = np.log10(np.concatenate((strength[0] / (own + strength[0]), strength[1] / (c2 + strength[1]))))
        self.fail_weight[0] = 0.0
        self.start = start if texts else 0

    def run(self) -> np.ndarray:
        """Log10 probability of each text."""
        sizes = np.diff(self.begin)
        order = np.argsort(-sizes, kind="stable")
        at, out = self.begin[:-1][order], np.zeros(len(order))
        state = np.full(len(order), self.start, np.int64)
        live = np.searchsorted(-sizes[order], -np.arange(1, int(sizes.max(initial=0)) + 1), "right").tolist()  # texts of so many tokens or more
        for step, n in enumerate(live):
            out[:n] += self.advance(state[:n], self.word_of[at[:n] + step])
        back = np.empty(len(order))
        back[order] = out
        return back

    def advance(self, state: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Take the arc of each word from its state, by way of failure arcs; state is changed to where they lead."""
        asked = state * self.words + word
        arc = np.searchsorted(self.keys, asked)
        np.minimum(arc, len(self.keys) - 1, out=arc)
        gained = self.weights[arc]
        lost = np.flatnonzero(self.keys[arc] != asked)
        if len(lost):
            gained[lost] = 0.0
        where, target = lost, self.targets[arc]
        while len(where):
            held = state[where]
            gained[where] += self.fail_weight[held]
            state[where] = held = self.fail[held]
            asked = held * self.words + word[where]
            arc = np.minimum(np.searchsorted(self.keys, asked), len(self.keys) - 1)
            hit = self.keys[arc] == asked
            done = where[hit]
            gained[done] += self.weights[arc[hit]]
            target[done] = self.targets[arc[hit]]
            where = where[~hit]
        state[:] = target
        return gained


def op10_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and model scores of every document."""
    scored, total = score_texts(table(spark, sf_dir, "documents"))
    return scored.select(F.col("k").alias("doc_id"), "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")
