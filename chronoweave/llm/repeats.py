"""Removal of repeated byte strings by threshold-bounded interval expansion on a Burrows-Wheeler transform.

A byte goes if some string of WINDOW bytes that covers it also starts earlier. Strings are found in
three passes over documents dealt to blocks, none of which holds more than its share of the corpus:

1. Anchors. Each window's anchor is the least hash among its GRAM-byte strings; equal windows have equal
   anchors. Consecutive windows with one place of an anchor form a segment. Blocks send their anchor hashes with
   their counts to shards, which answer whether an anchor occurs again anywhere, or very often.
2. Segments whose anchor occurs again go, with their bytes, to the shard of that anchor, once for each
   content and block (later ones in a block are repeats as they stand). Segments of very frequent
   anchors go as single windows, each under its own hash, so that no frequent passage gathers in a task.
3. Each shard sorts its segments' suffixes by their first WINDOW symbols (prefix doubling), and
   from that transform expands intervals breadth-first by backward extension: strings of length 1, 2, ...
   fix the common-prefix values 0, 1, ... in increasing order, and expansion stops at WINDOW. Rows
   whose value is still open share WINDOW bytes with the row above: they form groups of equal windows.
   All but a group's earliest window are repeats. Blocks then cut the covered bytes out of their texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mix, ship, span_hashes, stash, table
from .lm import pack, shard_slices, unpack

WINDOW, GRAM = 100, 24
BLOCK, SHARD = 16 << 20, 16 << 20
#: Symbols of one transform, as a power of two (a single anchor's segments may exceed them).
BATCH_BITS = 20
#: Different contents from which on an anchor's windows go one by one.
HOT = 8000
FIRST_KEY = -(1 << 63)


def grams(data: np.ndarray) -> np.ndarray:
    """Hash of every GRAM-byte string."""
    h = data.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1)
    h ^= h >> np.uint64(29)
    have, level = 1, 0
    factors = [np.uint64(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)]
    while have < GRAM:
        step = min(have, GRAM - have)
        h = h[: len(h) - step] * factors[level] + h[step:]
        h ^= h >> np.uint64(31)
        have, level = have + step, level + 1
    return h


def anchors(data: np.ndarray, chunk: int = 1 << 18) -> tuple[np.ndarray, np.ndarray]:
    """Anchor of every window of data, and whether its first string is the anchor."""
    count = max(len(data) - WINDOW + 1, 0)
    out, leads = np.empty(count, np.uint64), np.empty(count, bool)
    for i in range(0, count, chunk):
        v = g = grams(data[i : min(i + chunk, count) + WINDOW - 1])
        have, want = 1, WINDOW - GRAM + 1
        while have < want:
            step = min(have, want - have)
            v = np.minimum(v[: len(v) - step], v[step:])
            have += step
        out[i : i + chunk] = v
        leads[i : i + chunk] = g[: len(v)] == v
    return out, leads


class Texts:
    """The texts of a block in (key, text) order, their bytes end to end, and their segments.

    pos: where a row's bytes start in its key's own space; rows that share a key follow one another.
    """

    def __init__(self, keys: list, texts: list) -> None:
        raw = sorted((FIRST_KEY if k is None else k, (t or "").encode("utf-8", "surrogatepass"), k is None) for k, t in zip(keys, texts, strict=True))
        self.keys, self.raw, self.null = [r[0] for r in raw], [r[1] for r in raw], [r[2] for r in raw]
        self.offsets = np.concatenate(([0], np.cumsum([len(r) for r in self.raw]))).astype(np.int64)
        self.data = np.frombuffer(b"".join(self.raw), np.uint8)
        self.pos = np.zeros(len(raw), np.int64)
        for i in range(1, len(raw)):
            if self.keys[i] == self.keys[i - 1]:
                self.pos[i] = self.pos[i - 1] + len(self.raw[i - 1])

    def segments(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Row, first window (in data), number of windows and anchor of each segment, in order."""
        value, leads = anchors(self.data)
        n = len(value)
        if not n:
            return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
        valid = np.ones(n, bool)
        new = np.ones(n, bool)
        new[1:] = (value[1:] != value[:-1]) | leads[:-1]  # a segment has its anchor once, so its windows differ
        for a, b in zip(self.offsets[:-1].tolist(), self.offsets[1:].tolist(), strict=True):
            valid[max(b - WINDOW + 1, a) : b] = False
            if a < n:
                new[a] = True
        starts = np.flatnonzero(new & valid)
        stops = np.flatnonzero(np.concatenate((new[1:] | ~valid[1:], [True])) & valid) + 1
        return np.searchsorted(self.offsets, starts, "right") - 1, starts, stops - starts, value[starts]


def suffix_order(symbols: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Suffixes by their first WINDOW + 1 symbols or more, equal ones by place; ends of segments differ from each other.

    symbols: 0 ends a segment; left: symbols before that end.
    """
    n = len(symbols)
    bits = max(1, int(n - 1).bit_length())
    place = np.arange(n, dtype=np.uint64)
    key, have = np.zeros(n, np.uint64), 4
    for j in range(have):
        part = np.zeros(n, np.uint64)
        part[: n - j] = symbols[j:]
        part[left < j] = 0
        key = (key << np.uint64(9)) | part
    while True:
        ordered = np.sort((key << np.uint64(bits)) | place)
        order = (ordered & np.uint64((1 << bits) - 1)).astype(np.int64)
        ordered >>= np.uint64(bits)
        fresh = np.ones(n, bool)
        fresh[1:] = (ordered[1:] != ordered[:-1]) | (left[order[1:]] < have) | (left[order[:-1]] < have)
        if have > WINDOW or fresh.all():
            return order
        rank = np.empty(n, np.uint64)
        rank[order] = np.cumsum(fresh).astype(np.uint64)
        after = np.zeros(n, np.uint64)
        inside = np.flatnonzero(left >= have)
        after[inside] = rank[inside + have]
        key, have = (rank << np.uint64(bits + 1)) | after, 2 * have


def open_rows(symbols: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Rows of the suffix order that share WINDOW symbols or more with the row above.

    Breadth-first interval expansion: strings of length l + 1 come from those of length l by backward
    extension; each new interval fixes the common prefix below it as l; what is fixed isn't expanded again.
    """
    n = len(symbols)
    bwt = symbols[order - 1]  # the first suffix is preceded by the last symbol, an end
    by_symbol = np.argsort(bwt, kind="stable")
    back = np.empty(n, np.int64)
    back[by_symbol] = np.arange(n)  # row of the suffix that is one symbol longer
    fixed = np.zeros(n + 1, bool)
    fixed[0] = fixed[n] = True
    ends = int((symbols == 0).sum())
    first = np.flatnonzero(np.bincount(symbols[symbols > 0], minlength=1)) if n > ends else np.zeros(0, np.int64)
    sizes = np.bincount(symbols, minlength=1)
    right = np.concatenate((np.arange(ends), ends + np.cumsum(sizes[first]) - 1))
    left = np.concatenate((np.arange(ends), right[ends:] - sizes[first] + 1))
    for length in range(WINDOW):  # the value that intervals of strings of length + 1 fix
        new = ~fixed[right + 1]
        left, right = left[new], right[new]
        fixed[right + 1] = True
        if length == WINDOW - 1 or not len(left):
            break
        one = left == right
        rows = left[one]
        rows = back[rows[bwt[rows] > 0]]
        many_l, many_r = left[~one], right[~one]
        width = many_r - many_l + 1
        of = np.repeat(np.arange(len(width)), width)
        inner = np.arange(len(of)) - np.repeat(np.cumsum(width) - width, width) + many_l[of]
        keep = bwt[inner] > 0
        of, inner = of[keep], inner[keep]
        key = np.sort((of.astype(np.uint64) << np.uint64(32)) | back[inner].astype(np.uint64))
        target = (key & np.uint64(0xFFFFFFFF)).astype(np.int64)
        parent, symbol = key >> np.uint64(32), symbols[order[target]] if len(target) else np.zeros(0, symbols.dtype)
        split = np.ones(len(key) + 1, bool)
        split[1:-1] = (parent[1:] != parent[:-1]) | (symbol[1:] != symbol[:-1])
        at = np.flatnonzero(split)
        left = np.concatenate((rows, target[at[:-1]] if len(target) else target))
        right = np.concatenate((rows, target[at[1:] - 1] if len(target) else target))
    return ~fixed[:n]


def repeats_of(contents: list[bytes], keys: np.ndarray, starts: np.ndarray) -> list[np.ndarray]:
    """For each segment (distinct contents at their first places), which of its windows also start earlier in another."""
    sizes = np.array([len(c) for c in contents], np.int64)
    begin = np.concatenate(([0], np.cumsum(sizes + 1)))
    raw = np.frombuffer(b"\0".join(contents) + b"\0", np.uint8)
    symbols = raw.astype(np.int64) + 1
    symbols[begin[1:] - 1] = 0
    of = np.repeat(np.arange(len(contents)), sizes + 1)
    offset = np.arange(len(symbols)) - begin[of]
    left = sizes[of] - offset
    order = suffix_order(symbols, left)
    group = np.flatnonzero(~open_rows(symbols, order))
    ranks = np.unique(keys, return_inverse=True)[1].astype(np.int64)
    when = (ranks[of] << 40) + starts[of] + offset
    least = np.minimum.reduceat(when[order], group)
    again = np.empty(len(symbols), bool)
    again[order] = when[order] > np.repeat(least, np.diff(np.concatenate((group, [len(order)]))))
    again &= left >= WINDOW
    return [again[begin[i] : begin[i] + max(0, sizes[i] - WINDOW + 1)] for i in range(len(contents))]


def transforms(anchor: np.ndarray, lengths: np.ndarray) -> Iterator[np.ndarray]:
    """Which segments (by number, in order of their anchors) go into each transform. The one content of an anchor needs none: its windows differ."""
    edges = np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1]))) if len(anchor) else np.zeros(0, np.int64)
    total, batch = 0, []
    for a, b in zip(edges.tolist(), [*edges[1:].tolist(), len(anchor)], strict=False):
        if b - a == 1:
            continue
        amount = int(lengths[a:b].sum())
        if batch and total + amount > 1 << BATCH_BITS:
            yield np.concatenate(batch)
            total, batch = 0, []
        batch.append(np.arange(a, b))
        total += amount
    if batch:
        yield np.concatenate(batch)


def runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and stops of the true stretches."""
    edge = np.flatnonzero(np.diff(np.concatenate(([False], flags, [False])).view(np.int8)))
    return edge[::2], edge[1::2]


ASKED = pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())])
TOLD = pa.schema([("block", pa.int32()), ("shard", pa.int32()), ("state", pa.binary())])
SEGMENT = pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("anchor", pa.int64()), ("key", pa.int64()), ("pos", pa.int64()), ("size", pa.int32()), ("bytes", pa.binary())])
FOUND = pa.schema([("block", pa.int32()), ("key", pa.int64()), ("pos", pa.int64()), ("size", pa.int32())])
CLEAN = pa.schema([("k", pa.int64()), ("n_bytes", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))), ("kept", pa.binary())])


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", block: int = BLOCK, hot: int = HOT) -> DataFrame:
    """(k, n_bytes, spans, kept) of each row: the removed byte ranges of its text and the bytes that stay.

    Null text counts as empty; texts under WINDOW bytes stay whole. Null keys count as smaller than all
    others. Rows that share a key count as parts of one document in order of their bytes, though no
    string runs from one into the next: of repeated rows the first stays. An empty table gives an empty result.
    Other columns are ignored.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col(key).cast("long").alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    size = rows.agg(F.sum(F.octet_length("t") + 8)).first()[0] or 0
    blocks, shards = max(1, -(-size // block)), max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // SHARD))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("k"), F.lit(blocks)).cast("int"))

    def ask(group: pa.Table) -> pa.Table:
        texts = Texts(group["k"].to_pylist(), group["t"].to_pylist())
        _, first, length, anchor = texts.segments()
        content = span_hashes(texts.data, first, first + length + WINDOW - 1)
        spread = mix(anchor)  # anchors are least hashes: spread them
        distinct, where, counts = np.unique(spread, return_inverse=True, return_counts=True)
        fresh = np.bincount(where[np.unique(content, return_index=True)[1]], minlength=len(distinct))  # different contents
        number = group["block"][0].as_py()
        seen = np.minimum(counts, 2) + 2 * (fresh - 1)  # odd: once
        out = [{"shard": s, "block": number, "keys": pack(np.diff(distinct[a:b], prepend=np.uint64(0)), 8), "counts": pack(seen[a:b], 4)} for s, a, b in shard_slices(distinct, shards)]
        return pa.Table.from_pylist(out, schema=ASKED)

    def tell(group: pa.Table) -> pa.Table:
        asked = group.to_pylist()
        keys = [np.cumsum(unpack(r["keys"], 8), dtype=np.uint64) for r in asked]
        distinct, where = np.unique(np.concatenate(keys), return_inverse=True)
        seen = np.concatenate([unpack(r["counts"], 4) for r in asked]).astype(np.int64)
        often = np.bincount(where, 2 - seen % 2, len(distinct)) > 1
        many = np.bincount(where, (seen + 1) // 2, len(distinct)) > hot
        state = (often.astype(np.uint8) + (often & many))[where].astype(np.uint8)
        cuts = np.cumsum([0, *map(len, keys)])
        return pa.Table.from_pylist([{"block": r["block"], "shard": r["shard"], "state": state[a:b].tobytes()} for r, a, b in zip(asked, cuts[:-1], cuts[1:], strict=True)], schema=TOLD)

    told = stash(rows.groupBy("block").applyInArrow(ask, "shard int, block int, keys binary, counts binary").groupBy("shard").applyInArrow(tell, "block int, shard int, state binary"), "anchors")

    def cut_out(group: pa.Table, states: pa.Table) -> pa.Table:
        texts = Texts(group["k"].to_pylist(), group["t"].to_pylist())
        row, first, size_, anchor = texts.segments()
        spread = mix(anchor)
        distinct, where = np.unique(spread, return_inverse=True)
        state = np.frombuffer(b"".join(r["state"] for r in sorted(states.to_pylist(), key=lambda r: r["shard"])), np.uint8)[where] if len(distinct) else np.zeros(0, np.uint8)
        # windows of crowded anchors go one by one, each under its own hash
        crowd = np.flatnonzero(state == 2)
        of = np.repeat(crowd, size_[crowd])
        single = first[of] + np.arange(len(of)) - np.repeat(np.cumsum(size_[crowd]) - size_[crowd], size_[crowd])
        plain = np.flatnonzero(state == 1)
        begin = np.concatenate((first[plain], single))
        count = np.concatenate((size_[plain], np.ones(len(single), np.int64)))
        own = np.concatenate((row[plain], row[of]))
        content = span_hashes(texts.data, begin, begin + count + WINDOW - 1)
        label = np.concatenate((spread[plain], mix(content[len(plain) :])))
        order = np.argsort(begin, kind="stable")
        begin, count, own, content, label = (x[order] for x in (begin, count, own, content, label))
        fresh = np.zeros(len(begin), bool)
        fresh[np.unique(content, return_index=True)[1]] = True  # the first of each content in the block
        whole = texts.data.tobytes()
        pieces = [whole[a:b] if f else None for a, b, f in zip(begin.tolist(), (begin + count + WINDOW - 1).tolist(), fresh.tolist(), strict=True)]
        shard = ((label >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)
        keys = np.array(texts.keys, np.int64)[own] if len(own) else np.zeros(0, np.int64)
        columns = (shard.astype(np.int32), np.full(len(own), group["block"][0].as_py(), np.int32), label.view(np.int64), keys, texts.pos[own] + begin - texts.offsets[own], count.astype(np.int32))
        return pa.Table.from_arrays([*[pa.array(c) for c in columns], pa.array(pieces, pa.binary())], schema=SEGMENT)

    cut = rows.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(cut_out, "shard int, block int, anchor bigint, key bigint, pos bigint, size int, bytes binary")
    cut = stash(cut, "segments")

    def expand(group: pa.Table) -> pa.Table:
        group = group.sort_by([("anchor", "ascending"), ("key", "ascending"), ("pos", "ascending")])
        anchor, keys, pos, sizes = (group[c].to_numpy() for c in ("anchor", "key", "pos", "size"))
        contents, number = group["bytes"].to_pylist(), group["block"].to_numpy()
        first_of: dict[bytes, int] = {}
        first = np.array([first_of.setdefault(c, i) == i for i, c in enumerate(contents)], bool)
        first_of.clear()
        out: list[tuple[np.ndarray, ...]] = [(number[~first], keys[~first], pos[~first], sizes[~first])]
        members = np.flatnonzero(first)
        for batch in transforms(anchor[members], sizes[members] + WINDOW):
            out += found(members[batch].tolist(), contents, keys, pos, number)
        return pa.Table.from_arrays([pa.array(np.concatenate([o[j] for o in out]), t) for j, t in enumerate((pa.int32(), pa.int64(), pa.int64(), pa.int32()))], schema=FOUND)

    def found(batch: list[int], contents: list[bytes], keys: np.ndarray, pos: np.ndarray, number: np.ndarray) -> list[tuple[np.ndarray, ...]]:
        out = []
        for i, flags in zip(batch, repeats_of([contents[i] for i in batch], keys[batch], pos[batch]), strict=True):
            if flags.any():
                a, b = runs(flags)
                out.append((np.full(len(a), number[i]), np.full(len(a), keys[i]), pos[i] + a, b - a))
        return out

    sent = cut.where("bytes is not null").groupBy("shard").applyInArrow(expand, "block int, key bigint, pos bigint, size int")
    local = cut.where("bytes is null").select("block", "key", "pos", "size")
    again = sent.union(local)

    def clean(group: pa.Table, repeats: pa.Table) -> pa.Table:
        texts = Texts(group["k"].to_pylist(), group["t"].to_pylist())
        order = np.lexsort((repeats["pos"].to_numpy(), repeats["key"].to_numpy())) if repeats.num_rows else np.zeros(0, np.int64)
        rk, rp, rs = (repeats[c].to_numpy()[order] for c in ("key", "pos", "size"))
        lo, hi = np.searchsorted(rk, texts.keys, "left"), np.searchsorted(rk, texts.keys, "right")
        out = []
        for i, raw in enumerate(texts.raw):
            a = rp[lo[i] : hi[i]] - texts.pos[i]
            inside = (a >= 0) & (a < len(raw))
            delta = np.zeros(len(raw) + 1, np.int64)
            np.add.at(delta, a[inside], 1)
            np.add.at(delta, a[inside] + rs[lo[i] : hi[i]][inside] + WINDOW - 1, -1)
            gone = np.cumsum(delta)[:-1] > 0
            spans = [{"start": int(x), "stop": int(y)} for x, y in zip(*runs(gone), strict=True)]
            out.append({"k": None if texts.null[i] else texts.keys[i], "n_bytes": len(raw), "spans": spans, "kept": np.frombuffer(raw, np.uint8)[~gone].tobytes()})
        return pa.Table.from_pylist(out, schema=CLEAN)

    return rows.groupBy("block").cogroup(again.groupBy("block")).applyInArrow(clean, "k bigint, n_bytes bigint, spans array<struct<start:bigint,stop:bigint>>, kept binary")


def op8_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stays of every document when repeated 100-byte strings are removed."""
    found = remove_repeats(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["stop"] - x["start"])
    return found.select(F.col("k").alias("doc_id"), "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
