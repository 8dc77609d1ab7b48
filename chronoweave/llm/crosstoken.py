"""Cross-tokenizer alignment: which tokens of two vocabularies cover the same bytes.

The texts of a slice of an Arrow batch are one byte string, each with a space before it, and documents are offsets in it. Token
ends of both vocabularies are prefix sums of their byte lengths; each side's ends are counted once by ``bincount``, and bytes
where both end are cuts. Prefix sums of the cuts number the groups between them; their differences at the documents' offsets, and those
of prefix sums over groups, give each document's numbers of groups and links. Documents end where both sides end, so no
group crosses one.

Corpus-wide counts: slices are blocks, written once to the shared folder with their distinct (A, B) pairs. Blocks send pairs
and the number of their documents that hold each to shards by the pair's hash; a shard adds up and answers each block in
the block's own order, so a frequent pair is one entry a block. The largest count of each A id is an aggregate of at most the vocabulary's
size. Pairs are exact: a pair's number is a x |B| + b.

Both tokenizers treat what stands between two single spaces alike wherever it stands (no entry of either crosses the edge of
a visible character and a space), so each distinct stretch is encoded once for a worker.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mix, ship, slices, stash, table, tokenizer_path
from .lm import pack, unpack
from .tokenfile import REMEMBER, cut, learn

#: Characters of a block, bytes of text a shard stands for.
BLOCK, SHARD = 2 << 20, 8 << 20
#: Links of a group beyond which equal ids of a side are merged before pairs are made.
WIDE = 1024


def byte_values() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable Latin-1 is itself, the others follow from U+0100 in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabularies:
    """Both tokenizers of a worker, the bytes of their entries, and what they make of stretches seen before."""

    def __init__(self, a_path: str, b_path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        import sentencepiece
        from tokenizers import Tokenizer

        self.path, self.a, self.b = a_path, Tokenizer.from_file(a_path), sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.a.encode_special_tokens = True  # their strings in a text are ordinary text
        value = byte_values()
        entries = self.a.get_vocab(with_added_tokens=True)
        self.a_bytes = [b""] * (max(entries.values(), default=0) + 1)
        for token, i in entries.items():
            self.a_bytes[i] = bytes(value[c] for c in token) if all(c in value for c in token) else token.encode()
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i in range(len(self.b)) for p in [self.b.id_to_piece(i)]]
        if any("▁" in p.lstrip("▁") for p in map(self.b.id_to_piece, range(len(self.b)))):
            raise ValueError("the second vocabulary has entries that cross a word's end")
        self.a_size, self.b_size = (np.array([len(x) for x in side], np.int64) for side in (self.a_bytes, self.b_bytes))
        self.a_memo: dict[str, bytes] = {}
        self.b_memo: dict[str, bytes] = {}
        self.odd: set[str] = set()

    def same(self, text: str, a: bytes, b: bytes) -> bool:
        raw = text.encode()
        return all(b"".join([side[i] for i in np.frombuffer(ids, "<u4")]) == raw for side, ids in ((self.a_bytes, a), (self.b_bytes, b)))

    def study(self, pieces: set[str]) -> None:
        """Encode stretches; those that a side doesn't give back byte by byte are odd."""
        if not pieces:
            return
        learn({p for p in pieces if p not in self.a_memo}, self.a_memo, self.a, f"{self.path} of special tokens as text")
        alone = [p for p in pieces if p]
        for p, ids in zip(alone, self.b.encode([p[1:] for p in alone], num_threads=1), strict=True):  # this side adds the space
            self.b_memo[p] = np.array(ids, "<u4").tobytes()
        self.b_memo.setdefault("", b"")
        for p in alone:
            if not self.same(p, self.a_memo[p], self.b_memo[p]):
                self.odd.add(p)

    def encode_all(self, texts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """A ids, B ids of all texts, their numbers of A and B tokens, and their bytes (0 where a text has no tokens)."""
        if len(self.a_memo) > REMEMBER:
            for kept in (self.a_memo, self.b_memo, self.odd):
                kept.clear()
        spaced = [f" {t}" if t else "" for t in texts]
        pieces = [cut(t) for t in spaced]
        self.study({p for own in pieces for p in own if p not in self.b_memo})
        pairs = []
        for t, own in zip(spaced, pieces, strict=True):
            a, b = b"".join([self.a_memo[p] for p in own]), b"".join([self.b_memo[p] for p in own])
            odd = self.odd and not self.odd.isdisjoint(own) and not self.same(t, a, b)
            pairs.append((b"", b"") if odd else (a, b))
        a, b = (np.frombuffer(b"".join([p[side] for p in pairs]), "<u4").astype(np.int64) for side in (0, 1))
        n_a, n_b = (np.array([len(p[side]) // 4 for p in pairs], np.int64) for side in (0, 1))
        sizes = np.array([len(t.encode()) if p[0] else 0 for t, p in zip(spaced, pairs, strict=True)], np.int64)
        return a, b, n_a, n_b, sizes


_held: dict[tuple[str, str], Vocabularies] = {}


def vocabularies(a_path: str, b_path: str) -> Vocabularies:
    if (a_path, b_path) not in _held:
        _held.clear()
        _held[a_path, b_path] = Vocabularies(a_path, b_path)
    return _held[a_path, b_path]


def edges(counts: np.ndarray) -> np.ndarray:
    """Where runs of so many begin, and the end of the last."""
    return np.concatenate(([0], np.cumsum(counts))).astype(np.int64)


def ramp(counts: np.ndarray) -> np.ndarray:
    """0, 1, ... within each run."""
    return np.arange(int(counts.sum())) - np.repeat(edges(counts)[:-1], counts)


class Alignment:
    """Groups and links of the texts of one slice."""

    def __init__(self, own: Vocabularies, texts: list) -> None:
        self.a, self.b, self.n_a, self.n_b, sizes = own.encode_all(texts)
        self.bytes = edges(sizes)
        ends_a, ends_b = np.cumsum(own.a_size[self.a]), np.cumsum(own.b_size[self.b])
        length = int(self.bytes[-1]) + 1
        both = (np.bincount(ends_a, minlength=length) > 0) & (np.bincount(ends_b, minlength=length) > 0)
        cuts = np.cumsum(both)  # at a byte offset: cuts up to it
        self.group_a, self.group_b = ((cuts - both)[e] for e in (ends_a, ends_b))
        self.stops = np.flatnonzero(both)
        groups = len(self.stops)
        self.size_a, self.size_b = np.bincount(self.group_a, minlength=groups), np.bincount(self.group_b, minlength=groups)
        self.first = cuts[self.bytes]  # groups before each document, and all
        self.n_groups = np.diff(self.first)
        self.n_links = np.diff(edges(self.size_a * self.size_b)[self.first])

    def rendered(self) -> list[bytes]:
        """``a1,a2|b1;a3|b2,b3`` of each document."""
        n, m = len(self.a), len(self.b)
        upto_a, upto_b = np.cumsum(self.size_a), edges(self.size_b)
        at_a, at_b = np.arange(n) + upto_b[self.group_a], np.arange(m) + upto_a[self.group_b]
        ids, sign = np.zeros(n + m, np.int64), np.full(n + m, ord(","), np.uint8)
        ids[at_a], ids[at_b] = self.a, self.b
        if n:
            sign[at_a[upto_a - 1]] = ord("|")
            sign[at_b[np.cumsum(self.size_b) - 1]] = ord(";")
        digits = 1 + sum((ids >= 10**k).astype(np.int64) for k in range(1, 7))
        stop = np.cumsum(digits + 1)
        out = np.zeros(int(stop[-1]) if n else 0, np.uint8)
        out[stop - 1] = sign
        left, place = ids, 2
        live = np.arange(n + m)
        while len(live):
            out[stop[live] - place] = 48 + left % 10
            more = digits[live] >= place
            live, left, place = live[more], (left // 10)[more], place + 1
        tokens = edges(self.n_a + self.n_b)
        begin = np.concatenate(([0], stop))[tokens]
        data = out.tobytes()
        return [data[i : max(j - 1, i)] for i, j in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True)]

    def links(self, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Document, pair number and occurrences of each document's distinct pairs, in order of document and pair."""
        product = self.size_a * self.size_b
        doc = np.repeat(np.arange(len(self.n_a)), self.n_groups)
        begin_a, begin_b = edges(self.size_a)[:-1], edges(self.size_b)[:-1]
        span = np.int64(len_pairs := int(self.a.max(initial=0) + 1) * width)
        if len(self.n_a) * len_pairs >= 1 << 62:
            raise ValueError("too many documents in a slice")
        narrow = np.flatnonzero(product <= WIDE)
        count = product[narrow]
        nth, across = ramp(count), np.repeat(self.size_b[narrow], count)
        i, j = np.repeat(begin_a[narrow], count) + nth // np.maximum(across, 1), np.repeat(begin_b[narrow], count) + nth % np.maximum(across, 1)
        keys = np.repeat(doc[narrow], count) * span + self.a[i] * width + self.b[j]
        distinct, times = np.unique(keys, return_counts=True)
        for g in np.flatnonzero(product > WIDE).tolist():  # a long stretch without a common end: each id of a side once, with its number
            a, n = np.unique(self.a[begin_a[g] : begin_a[g] + self.size_a[g]], return_counts=True)
            b, m = np.unique(self.b[begin_b[g] : begin_b[g] + self.size_b[g]], return_counts=True)
            more = (doc[g] * span + a[:, None] * width + b[None, :]).reshape(-1)
            joined, where = np.unique(np.concatenate((distinct, more)), return_inverse=True)
            total = np.zeros(len(joined), np.int64)
            np.add.at(total, where, np.concatenate((times, (n[:, None] * m[None, :]).reshape(-1))))
            distinct, times = joined, total
        return distinct // span, distinct % span, times


ROWS = "block bigint, facts binary, shas array<string>, pairs binary, docs binary, lists binary, sizes binary"


def block_rows(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """A row for each block of docs (k, t): its keys, facts and digests, distinct pairs with their numbers of documents, and each document's
    pairs by their place among them."""
    kind = docs.schema["k"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, number = vocabularies(a_path, b_path), TaskContext.get().partitionId() << 32
        width = len(own.b_bytes)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for i, j in slices(len(texts), np.array([len(t or "") + 16 for t in texts], np.int64), BLOCK):
                x = Alignment(own, texts[i:j])
                doc, pair, times = x.links(width)
                distinct, place, held = np.unique(pair, return_inverse=True, return_counts=True)
                sizes = np.bincount(doc, minlength=j - i)
                step = np.diff(place, prepend=0)
                first = edges(sizes)[:-1][sizes > 0]
                step[first] = place[first]
                shas = [hashlib.sha256(g).hexdigest() if g else "" for g in x.rendered()]
                facts = np.concatenate((x.n_a, x.n_b, x.n_groups, x.n_links))
                row = [
                    pa.array([number], pa.int64()),
                    pa.ListArray.from_arrays(pa.array([0, j - i], pa.int32()), batch.column(0).slice(i, j - i)),
                    pa.array([pack(facts, 8)], pa.binary()),
                    pa.array([shas], pa.list_(pa.string())),
                    pa.array([pack(np.diff(distinct, prepend=0), 8)], pa.binary()),
                    pa.array([pack(held, 4)], pa.binary()),
                    pa.array([zstandard.compress(pack(step, 4) + pack(times, 8))], pa.binary()),
                    pa.array([pack(sizes, 4)], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(row, ["block", "keys", "facts", "shas", "pairs", "docs", "lists", "sizes"])
                number += 1

    return docs.mapInArrow(run, ROWS.replace("facts", f"keys array<{kind}>, facts", 1))


def pairs_of(blob: bytes) -> np.ndarray:
    return np.cumsum(unpack(blob, 8).astype(np.int64))


def dealt(pairs: np.ndarray, shards: int) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """The order of pairs by shard, and (shard, start, stop) in it."""
    shard = (mix(pairs.astype(np.uint64) + np.uint64(1)) % np.uint64(shards)).astype(np.int64)
    order = np.argsort(shard, kind="stable")
    counts = np.bincount(shard, minlength=shards)
    at = edges(counts)
    return order, [(s, int(at[s]), int(at[s + 1])) for s in np.flatnonzero(counts).tolist()]


SENT = pa.schema([("block", pa.int64()), ("shard", pa.int64()), ("pairs", pa.binary()), ("counts", pa.binary())])


def corpus_counts(blocks: DataFrame, shards: int, width: int) -> tuple[DataFrame, np.ndarray]:
    """(block, shard, counts): in how many documents each of a block's pairs stands, in dealt() order; and each A id's largest count."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                pairs, held = pairs_of(row["pairs"]), unpack(row["docs"], 4)
                order, parts = dealt(pairs, shards)
                out = [{"block": row["block"], "shard": s, "pairs": pack(np.diff(pairs[order[i:j]], prepend=0), 8), "counts": pack(held[order[i:j]], 4)} for s, i, j in parts]
                yield pa.RecordBatch.from_pylist(out, schema=SENT)

    def add_up(group: pa.Table) -> pa.Table:
        rows = group.to_pylist()
        pairs = [pairs_of(r["pairs"]) for r in rows]
        distinct, where = np.unique(np.concatenate(pairs), return_inverse=True)
        total = np.zeros(len(distinct), np.int64)
        np.add.at(total, where, np.concatenate([unpack(r["counts"], 4).astype(np.int64) for r in rows]))
        at, out = 0, []
        for r, own in zip(rows, pairs, strict=True):
            out.append({"block": r["block"], "shard": r["shard"], "pairs": b"", "counts": pack(total[where[at : at + len(own)]], 8)})
            at += len(own)
        ids, first = np.unique(distinct // width, return_index=True)
        out.append({"block": -1, "shard": rows[0]["shard"], "pairs": pack(ids, 8), "counts": pack(np.maximum.reduceat(total, first), 8)})
        return pa.Table.from_pylist(out, schema=SENT)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(unpack(row[c], 8).astype(np.int64)) for c in ("pairs", "counts")], ["a", "most"])

    schema = "block bigint, shard bigint, pairs binary, counts binary"
    sent = blocks.select("block", "pairs", "docs").mapInArrow(send, schema)
    back = stash(sent.groupBy("shard").applyInArrow(add_up, schema), "pair-counts")
    most = back.where("block = -1").select("pairs", "counts").mapInArrow(spread, "a bigint, most bigint").groupBy("a").agg(F.max("most").alias("most")).toPandas()
    best = np.zeros(int(most["a"].max()) + 1 if len(most) else 1, np.int64)
    best[most["a"].to_numpy(np.int64)] = most["most"].to_numpy(np.int64)
    return back.where("block >= 0").select("block", "shard", "counts"), best


def align_corpus(docs: DataFrame, key: str = "doc_id", text: str = "text", a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """(k, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of each row.

    a_path is a byte-level file of the tokenizers library, b_path a sentencepiece model that adds a space and has byte entries.
    Null and empty texts, and texts that either side doesn't give back byte by byte, have no tokens: zeros and an empty digest. Keys may
    be of any type, also null; repeated rows each count as a document. Texts of any length are aligned whole; a long stretch without
    a common end is one group, whose pairs are made from its distinct ids. An empty table gives an empty result. Other columns are ignored.
    """
    spark = docs.sparkSession
    ship(spark)
    a_path, b_path = a_path or tokenizer_path("byte_bpe_50k.json"), b_path or tokenizer_path("piece_bpe_32k.model")
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t"))
    kind = rows.schema["k"].dataType.simpleString()
    size = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    blocks = stash(block_rows(rows, a_path, b_path), "token-blocks")
    width = len(vocabularies(a_path, b_path).b_bytes)
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // SHARD))
    back, best = corpus_counts(blocks, shards, width)
    names = ["k", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]

    def finish(own: pa.Table, answers: pa.Table) -> pa.Table:
        row = own.to_pylist()[0] if own.num_rows else None
        if row is None:
            raise ValueError("counts came back for a block that isn't there")
        keys = pc.list_flatten(own["keys"])
        pairs, sizes = pairs_of(row["pairs"]), unpack(row["sizes"], 4).astype(np.int64)
        order, _ = dealt(pairs, shards)
        found = [unpack(r["counts"], 8) for r in sorted(answers.to_pylist(), key=lambda r: r["shard"])]
        total = np.zeros(len(pairs), np.int64)
        total[order] = np.concatenate([np.zeros(0, np.uint64), *found]).astype(np.int64)
        data, n = zstandard.decompress(row["lists"]), int(sizes.sum())
        step, times = unpack(data[: 4 * n], 4).astype(np.int64), unpack(data[4 * n :], 8).astype(np.int64)
        run = edges(step)[1:]
        begin = edges(sizes)[:-1]
        before = np.concatenate(([0], run))[begin]
        place = run - np.repeat(before, sizes)
        top = total == best[pairs // width]
        sums = [np.diff(edges(x)[edges(sizes)]) for x in (times * top[place], times * total[place])]
        facts = unpack(row["facts"], 8).astype(np.int64).reshape(4, -1)
        return pa.Table.from_arrays([keys, *[pa.array(f) for f in (*facts, *sums)], pa.array(row["shas"], pa.string())], names)

    own = blocks.select("block", "keys", "facts", "shas", "pairs", "lists", "sizes")
    schema = f"k {kind}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string"
    return own.groupBy("block").cogroup(back.groupBy("block")).applyInArrow(finish, schema)


GROUP = pa.struct([("a", pa.list_(pa.int32())), ("b", pa.list_(pa.int32())), ("start", pa.int64()), ("stop", pa.int64())])


def token_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """(k, groups): each row's groups in order, with the ids of both sides and the bytes they cover, counted from the added space; cases as for
    align_corpus(), without tokens an empty array."""
    ship(docs.sparkSession)
    a_path, b_path = a_path or tokenizer_path("byte_bpe_50k.json"), b_path or tokenizer_path("piece_bpe_32k.model")
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = vocabularies(a_path, b_path)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for i, j in slices(len(texts), np.array([len(t or "") + 16 for t in texts], np.int64), BLOCK):
                x = Alignment(own, texts[i:j])
                at_a, at_b, begin = edges(x.size_a), edges(x.size_b), np.repeat(x.bytes[:-1], x.n_groups)
                start = np.concatenate(([0], x.stops[:-1])) if len(x.stops) else x.stops
                fields = [pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids, pa.int32())) for at, ids in ((at_a, x.a), (at_b, x.b))]
                groups = pa.StructArray.from_arrays([*fields, pa.array(start - begin), pa.array(x.stops - begin)], fields=list(GROUP))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.ListArray.from_arrays(pa.array(x.first, pa.int32()), groups)], ["k", "groups"])

    return rows.mapInArrow(run, f"k {rows.schema['k'].dataType.simpleString()}, groups array<struct<a:array<int>,b:array<int>,start:bigint,stop:bigint>>")


def op11_crosstoken(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups, links and their corpus-wide counts of every document under both vocabularies."""
    return align_corpus(table(spark, sf_dir, "documents")).withColumnRenamed("k", "doc_id")
