"""Token ids as canonical length-limited Huffman blocks, and the way back.

Files are Parquet tables in a shared folder, so that any executor can write them, a lost one
costs a retry, and any reader opens them. One row is one block:

    part, block       order of blocks: partition of the sorted table, then block in it
    n_tokens          ids in the block
    payload           the code bits, most significant first, zero-padded to a byte
    checkpoints       uint32 bit offset of every STRIDE-th id (little-endian): decoding starts at any
    docs              (doc, continued, n) of each document, or piece of one, in the block

The code comes from the global id counts by package-merge, at most LIMIT bits a code; only the
lengths are kept (``codebook``), since canonical codes follow from them. A block decodes on its own:
all its checkpoints advance together, one table look-up of LIMIT bits for each id.
"""

from __future__ import annotations

import os
import zlib
from array import array
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import give_back, returning, scratch, settings, ship, slices, stash, table, tokenizer_path, trim

LIMIT, STRIDE, BLOCK = 18, 64, 1 << 16
#: Chunks of text whose ids a worker remembers at most; beyond, it forgets all and starts anew.
REMEMBER = 600_000
#: Pieces that the library gets as one text.
TOGETHER = 500
#: Bytes of text that are cut at once, and that a worker has at once; one text may be longer.
AT_ONCE = 4 << 20
#: Between JVM and worker, batches are no larger, whatever the texts' lengths.
BATCHES = {"spark.sql.execution.arrow.maxBytesPerBatch": str(AT_ONCE)}

#: All white space but the space.
OTHER_SPACE = [c for c in map(chr, range(0x3001)) if c.isspace() and c != " "]

_tokenizers: dict[str, object] = {}
_sizes: dict[str, np.ndarray] = {}


def tokenize(texts: list, path: str) -> Iterator[np.ndarray]:
    """Ids of each text by the tokenizers library, without special tokens; null counts as empty.

    Byte-level pre-tokens never cross certain places (``piece_starts``): texts are cut there, all of a slice at once, and each
    distinct piece is encoded once. Strings of special tokens in a text get their ids, as by the library's default.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Tokenizer

    if path not in _tokenizers:
        _tokenizers[path] = Tokenizer.from_file(path)
    known = _known.setdefault(path, Known())
    for i, j in slices(len(texts), np.array([len(t or "") + 16 for t in texts], np.int64), AT_ONCE):
        raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts[i:j]]
        ends = np.cumsum([len(r) for r in raw])
        if not ends[-1]:
            yield from [np.zeros(0, "<u4")] * len(raw)
            continue
        data = b"".join(raw)
        starts = piece_starts(np.frombuffer(data, np.uint8), ends)
        offsets = pa.py_buffer(np.append(starts, len(data)).astype("<i4"))
        distinct = pa.Array.from_buffers(pa.binary(), len(starts), [None, offsets, pa.py_buffer(data)]).dictionary_encode()
        if len(known.place) > REMEMBER:
            known.clear()
        places = known.places(distinct.dictionary.to_pylist(), _tokenizers[path], path)[distinct.indices.to_numpy()]
        ids, till = known.spelled(places)
        cuts = till[np.searchsorted(starts, ends)].tolist()
        for x, y in zip([0, *cuts[:-1]], cuts, strict=True):
            yield ids[x:y]


#: Bytes that are not white space, and those that end a letter: ASCII ones. As str.isspace() has it, which has more than the tokenizer's.
VISIBLE, LETTER = np.ones(256, bool), np.zeros(256, bool)
VISIBLE[[*range(9, 14), *range(28, 33)]] = False
LETTER[[*range(65, 91), *range(97, 123)]] = True
#: First bytes of two-byte characters that are all letters (0xC3 apart from two signs).
LETTERS = np.zeros(256, bool)
LETTERS[[*range(0xC3, 0xC9), 0xD0]] = True


def piece_starts(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Where the pieces of the texts that end at ``ends`` start in their joined UTF-8 bytes. The tokenizer encodes pieces independently of one another.

    A text is cut before each space, and around each line feed, that stands alone between two visible characters, and between a letter and a
    full stop or comma. Empty texts have no pieces.
    """
    visible = VISIBLE[data]
    for lead, width in ((0xC2, 2), (0xE1, 3), (0xE2, 3), (0xE3, 3)):
        at = np.flatnonzero(data == lead)
        if len(at):
            code = (lead << 16) | (data[at + 1].astype(np.int64) << 8) | (data[at + 2] if width == 3 else 0)
            at = at[np.isin(code, WIDE)]
            for n in range(width):
                visible[at + n] = False
    begin = np.zeros(len(data) + 1, bool)
    begin[0], begin[ends] = True, True
    before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
    before[1:], after[:-1] = visible[:-1], visible[1:]
    before &= ~begin[:-1]
    after &= ~begin[1:]
    alone = before & after
    feeds = np.flatnonzero(alone & (data == 10))
    letter = np.zeros(len(data), bool)
    letter[1:] = LETTER[data[:-1]]
    letter[2:] |= LETTERS[data[:-2]] & ~((data[:-2] == 0xC3) & ((data[1:-1] == 0x97) | (data[1:-1] == 0xB7)))
    begin[:-1] |= alone & (data == 32) | letter & ((data == 44) | (data == 46))
    begin[feeds] = True
    begin[feeds + 1] = True
    return np.flatnonzero(begin[:-1])


#: White space of several bytes, as numbers of three bytes.
WIDE = [int.from_bytes(c.encode().ljust(3, b"\0")) for c in OTHER_SPACE if ord(c) > 127]


class Known:
    """Pieces that a worker has seen, and their ids, one after another in one array."""

    def __init__(self) -> None:
        self.clear()

    def clear(self) -> None:
        self.place: dict[bytes, int] = {}
        self.count = 0
        self.ids, self.ends = np.zeros(1 << 16, "<u4"), np.zeros(1 << 16, np.int64)  # ends[0] is 0: piece n lies from ends[n] to ends[n + 1]

    def places(self, pieces: list[bytes], tokenizer: object, path: str) -> np.ndarray:
        """Numbers of distinct pieces; those that are new are encoded."""
        found = list(map(self.place.get, pieces))
        new = [n for n, x in enumerate(found) if x is None]
        if new:
            texts = [pieces[n].decode("utf-8", "surrogatepass") for n in new]
            plain = [t[0] == " " and len(t) > 1 and not t[1].isspace() and not t[-1].isspace() for t in texts]
            spaced = [n for n, x in zip(new, plain, strict=True) if x]
            ids = in_a_row([t for t, x in zip(texts, plain, strict=True) if x], tokenizer)
            cuts = dealt(ids, np.array([len(pieces[n]) for n in spaced], np.int64), tokenizer, path)
            if cuts is None:
                ids, cuts, spaced, plain = np.zeros(0, "<u4"), np.zeros(0, np.int64), [], [False] * len(new)
            learnt: dict[str, bytes] = {}
            others = [t for t, x in zip(texts, plain, strict=True) if not x]
            learn(set(others), learnt, tokenizer, path)
            self.add(ids, cuts)
            self.add(np.frombuffer(b"".join([learnt[t] for t in others]), "<u4"), np.cumsum([len(learnt[t]) >> 2 for t in others], dtype=np.int64))
            for number, n in enumerate([*spaced, *[n for n, x in zip(new, plain, strict=True) if not x]], len(self.place)):
                found[n] = self.place[pieces[n]] = number
        return np.array(found, np.int64)

    def add(self, ids: np.ndarray, ends: np.ndarray) -> None:
        """More pieces: their ids in a row, and where each one's end."""
        at, n = int(self.ends[self.count]), self.count + len(ends)
        while len(self.ends) <= n:
            self.ends = np.append(self.ends, np.zeros_like(self.ends))
        while len(self.ids) < at + len(ids):
            self.ids = np.append(self.ids, np.zeros_like(self.ids))
        self.ids[at : at + len(ids)] = ids
        self.ends[self.count + 1 : n + 1] = at + ends
        self.count = n

    def spelled(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of pieces in a row, and where each piece's begin in them (and the last one's end)."""
        first = self.ends[places]
        till = np.concatenate(([0], np.cumsum(self.ends[places + 1] - first)))
        return self.ids[np.repeat(first - till[:-1], np.diff(till)) + np.arange(till[-1])], till


_known: dict[str, Known] = {}


def sizes_of(tokenizer: object, path: str) -> np.ndarray:
    """Bytes that each id stands for: a byte-level vocabulary writes one character a byte. Special tokens count as their text's bytes."""
    if path not in _sizes:
        out = np.zeros(tokenizer.get_vocab_size() + 1, np.int64)
        for token, number in tokenizer.get_vocab(with_added_tokens=False).items():
            out[number] = len(token)
        for number, token in tokenizer.get_added_tokens_decoder().items():
            out[number] = len(token.content.encode())
        _sizes[path] = out
    return _sizes[path]


def learn(pieces: set[str], memo: dict[str, bytes], tokenizer: object, path: str) -> None:
    """Encode pieces and remember them; what they are made of is encoded once.

    Pieces of a space and visible characters come out the same one after another as on their own, so these are encoded as one text,
    and its ids are dealt to the pieces by the bytes they stand for.
    """
    plain = {p for p in pieces if p and p[-1] not in ".," and "\n" not in p}
    made = {p: finer(p) for p in pieces if p not in plain}
    plain.update(q for parts in made.values() for q in parts if q not in memo)
    spaced = [q for q in plain if len(q) > 1 and q[0] == " " and not q[1].isspace() and not q[-1].isspace() and "\0" not in q]
    ids = in_a_row(spaced, tokenizer)
    cuts = dealt(ids, np.array([len(q.encode("utf-8", "surrogatepass")) for q in spaced], np.int64), tokenizer, path)
    if len(spaced) and cuts is not None:
        data, at = ids.tobytes(), [0, *cuts.tolist()]
        memo.update((q, data[4 * a : 4 * b]) for q, a, b in zip(spaced, at[:-1], at[1:], strict=True))
        plain.difference_update(spaced)
    alone = list(plain)
    for q, e in zip(alone, tokenizer.encode_batch_fast(alone, add_special_tokens=False) if alone else [], strict=True):
        memo[q] = array("I", e.ids).tobytes()
    for p, parts in made.items():
        if len(parts) > 1:
            memo[p] = b"".join([memo[q] for q in parts])


def in_a_row(spaced: list[str], tokenizer: object) -> np.ndarray:
    """Ids of pieces of a space and visible characters, one after another. Some hundred pieces at a time: the library is slower on longer texts."""
    joined = ["".join(spaced[i : i + TOGETHER]) for i in range(0, len(spaced), TOGETHER)]
    return np.concatenate([np.zeros(0, "<u4"), *[np.array(e.ids, "<u4") for e in tokenizer.encode_batch_fast(joined, add_special_tokens=False)]]) if joined else np.zeros(0, "<u4")


def dealt(ids: np.ndarray, sizes: np.ndarray, tokenizer: object, path: str) -> np.ndarray | None:
    """Where the ids of each of the pieces end, by their bytes; nothing if the ids don't stand for as many bytes."""
    ends = np.cumsum(sizes_of(tokenizer, path)[ids])
    if (int(ends[-1]) if len(ends) else 0) != int(sizes.sum()):
        return None
    return np.searchsorted(ends, np.cumsum(sizes), "right")


def finer(piece: str) -> list[str]:
    """A piece cut further where pre-tokens surely end: around a line feed between visible characters, and
    before the full stops and commas after a word of letters alone. Other pieces, the empty one too, stay whole."""
    out = []
    for n, line in enumerate(lines if len(lines := piece.split("\n")) == 1 or all(x and not x[-1].isspace() and (i == 0 or not x[0].isspace()) for i, x in enumerate(lines)) else [piece]):
        if n:
            out.append("\n")
        word = line.rstrip(".,")
        if len(word) < len(line) and word.removeprefix(" ").isalpha():
            out += [word, line[len(word) :]]
        else:
            out.append(line)
    return out


def cut(text: str) -> list[str]:
    """Pieces of a text that the tokenizer encodes independently of one another: cut before each space that stands
    alone between two visible characters. Their concatenation is the text; an empty text has none."""
    if "\0" not in text and "  " not in text and not any(f"{c} " in text or f" {c}" in text for c in OTHER_SPACE if c in text):
        out = text[:-1].replace(" ", "\0 ").split("\0") if text else []
        return [*out[:-1], out[-1] + text[-1]] if text else []  # a space at the end stands between no two
    parts = text.split(" ")
    out = parts[:1] if parts[0] or len(parts) > 1 else []
    for p in parts[1:]:
        if p and not p[0].isspace() and out[-1] and not out[-1][-1].isspace():
            out.append(f" {p}")
        else:
            out[-1] += f" {p}"
    return out


def code_lengths(ids: np.ndarray, counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Lengths of an optimal prefix code of at most limit bits, by package-merge. One id gets length 1."""
    n = len(ids)
    if n <= 1:
        return np.ones(n, np.uint8)
    if n > 1 << limit:
        raise ValueError(f"{n} ids don't fit in codes of {limit} bits")
    order = np.lexsort((ids, counts))
    leaf = counts[order].astype(np.float64)
    levels = []
    weights = leaf
    for _ in range(limit - 1):
        half = len(weights) // 2
        packs = weights[: 2 * half : 2] + weights[1 : 2 * half : 2]
        merged = np.concatenate((leaf, packs))
        rank = np.argsort(merged, kind="stable")
        levels.append(rank < n)
        weights = merged[rank]
    lengths, take = np.zeros(n, np.int64), 2 * n - 2
    for is_leaf in [*reversed(levels), np.ones(n, bool)]:
        chosen = is_leaf[:take]
        leaves = int(chosen.sum())
        lengths[:leaves] += 1
        take = 2 * (len(chosen) - leaves)
    out = np.zeros(n, np.uint8)
    out[order] = lengths
    return out


def canonical(ids: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids in code order, with their codes and lengths."""
    order = np.lexsort((ids, lengths))
    ids, lengths = ids[order], lengths[order].astype(np.int64)
    steps = np.concatenate(([0], (np.int64(1) << (LIMIT - lengths))[:-1])) if len(ids) else np.zeros(0, np.int64)
    return ids, (np.cumsum(steps) >> (LIMIT - lengths)).astype(np.uint64), lengths


class Codec:
    """Encoder and decoder of one codebook: {ids: uint32 bytes, lengths: uint8 bytes}."""

    def __init__(self, ids: bytes, lengths: bytes) -> None:
        self.ids, self.codes, self.lengths = canonical(np.frombuffer(ids, "<u4"), np.frombuffer(lengths, np.uint8))
        top = int(self.ids.max()) + 1 if len(self.ids) else 0
        self.code_of, self.length_of = np.zeros(top, np.uint64), np.zeros(top, np.int64)
        self.code_of[self.ids], self.length_of[self.ids] = self.codes, self.lengths
        spans = np.int64(1) << (LIMIT - self.lengths)
        fill = (1 << LIMIT) - int(spans.sum())
        symbol = np.concatenate((np.repeat(self.ids, spans), np.zeros(fill, np.uint32)))
        width = np.concatenate((np.repeat(self.lengths, spans), np.ones(fill, np.int64)))
        self.entry = (symbol.astype(np.uint64) << np.uint64(5) | width.astype(np.uint64)).astype(np.uint32 if top <= 1 << 27 else np.uint64)  # id and length: one look-up

    def encode(self, ids: np.ndarray) -> tuple[bytes, bytes]:
        """Code bits and checkpoints of a block."""
        if not len(ids):
            return b"", b""
        lengths = self.length_of[ids]
        ends = np.cumsum(lengths)
        at = ends - lengths
        word, shift = at >> 5, (64 - lengths - (at & 31)).astype(np.uint64)
        value = self.code_of[ids] << shift
        words = np.zeros(int(ends[-1] >> 5) + 2, np.uint64)
        first = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
        words[word[first]] += np.add.reduceat(value >> np.uint64(32), first)
        words[word[first] + 1] += np.add.reduceat(value & np.uint64(0xFFFFFFFF), first)
        data = words.astype(">u4").tobytes()[: -(-int(ends[-1]) // 8)]
        return data, at[::STRIDE].astype("<u4").tobytes()

    def decode(self, payload: bytes, checkpoints: bytes, count: int) -> np.ndarray:
        """The ids of a block; all checkpoints advance together."""
        at = np.frombuffer(checkpoints, "<u4").astype(np.int64)
        data = np.concatenate((np.frombuffer(payload, np.uint8), np.zeros(8, np.uint8)))
        window = np.ndarray((len(data) - 3,), ">u4", data, strides=(1,)).astype(np.uint32)
        out = np.zeros((len(at), STRIDE), np.uint32)
        last = len(window) - 1
        for j in range(STRIDE):
            peek = (window[np.minimum(at >> 3, last)] >> (32 - LIMIT - (at & 7)).astype(np.uint32)) & np.uint32((1 << LIMIT) - 1)
            entry = self.entry[peek]
            out[:, j] = entry >> 5
            at += (entry & 31).astype(np.int64)
        return out.reshape(-1)[:count]


def vocabulary(path: str) -> int:
    """One more than the largest id."""
    from tokenizers import Tokenizer

    return max(Tokenizer.from_file(path).get_vocab().values(), default=0) + 1


def token_rows(docs: DataFrame, key: str, text: str, path: str, end: int, width: int, to: str) -> None:
    """Write (k, ids, task counts) of all rows: ids as little-endian integers of width bytes, one extra row of counts for each task."""
    spark = docs.sparkSession
    ship(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        tally = np.zeros(0, np.int64)
        for number, b in enumerate(whole.slice(i, j - i) for whole in batches for i, j in slices(whole.num_rows, text_bytes(whole.column(1)), AT_ONCE)):
            keys, blobs, sizes = b.column(0), [], []
            for ids in tokenize(b.column(1).to_pylist(), path):
                ids = np.append(ids, np.uint32(end)).astype(f"<u{width}")
                blobs.append(ids.tobytes())
                sizes.append(len(ids))
            got = np.bincount(np.frombuffer(b"".join(blobs), f"<u{width}"))
            if len(got) > len(tally):
                tally = np.concatenate((tally, np.zeros(len(got) - len(tally), np.int64)))
            tally[: len(got)] += got
            yield pa.RecordBatch.from_arrays([keys, pa.array(sizes, pa.int64()), pa.array(blobs, pa.binary()), pa.nulls(len(keys), pa.binary())], ["k", "n", "ids", "tally"])
            if number % 4 == 3:  # pages that are given back cost time when they are taken again
                trim()
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([None], pa.int64()), pa.array([None], pa.binary()), pa.array([tally.astype("<i8").tobytes()], pa.binary())], ["k", "n", "ids", "tally"])

    rows = docs.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t"))
    with settings(spark, BATCHES):
        rows.mapInArrow(returning(run), "k bigint, n bigint, ids binary, tally binary").write.option("compression", "zstd").parquet(to)


def text_bytes(texts: pa.Array) -> np.ndarray:
    """Bytes of each text, and some more for the text itself; null has none."""
    return pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 16


def global_counts(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Ids and their counts over all rows. Size on the driver: the vocabulary, however large the corpus."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for blob in b.column(0).to_pylist():
                tally = np.frombuffer(blob, "<i8")
                seen = np.flatnonzero(tally)
                yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(tally[seen], pa.int64())], ["id", "n"])

    sums = rows.where("tally is not null").select("tally").mapInArrow(spread, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n"))
    found = sums.toPandas().sort_values("id")
    return found["id"].to_numpy(np.uint32), found["n"].to_numpy(np.int64)


def encode_corpus(docs: DataFrame, folder: str, key: str = "doc_id", text: str = "text", path: str | None = None, end: int = 0, block: int = BLOCK) -> None:
    """Write the token file of docs to folder: ``blocks`` and ``codebook``, documents in ascending key order.

    Null keys come first; rows with equal keys follow one another in order of their ids; every row is
    kept. Null and empty texts are the end id alone. An empty table gives a file of no blocks. A text of any
    length is cut into as many blocks as it takes. Other columns are ignored.
    """
    spark = docs.sparkSession
    path = path or tokenizer_path("byte_bpe_50k.json")
    width = 2 if max(vocabulary(path), end + 1) <= 1 << 16 else 4
    token_rows(docs, key, text, path, end, width, f"{folder}/ids")
    rows = spark.read.parquet(f"{folder}/ids")
    ids, counts = global_counts(rows)
    lengths = code_lengths(ids, counts)
    book = (ids.astype("<u4").tobytes(), lengths.tobytes())
    spark.createDataFrame([book], "ids binary, lengths binary").coalesce(1).write.parquet(f"{folder}/codebook")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        codec, held, docs_, number = Codec(*book), [], [], 0
        size, part = 0, 0

        def flush() -> pa.RecordBatch:
            nonlocal held, docs_, size, number
            whole = np.concatenate(held)
            payload, marks = codec.encode(whole)
            made = pa.RecordBatch.from_pylist([{"part": part, "block": number, "n_tokens": len(whole), "payload": payload, "checkpoints": marks, "docs": docs_}], schema=SCHEMA)
            held, docs_, size, number = [], [], 0, number + 1
            return made

        for b in batches:
            part = b.column(2)[0].as_py() if b.num_rows else part
            for k, blob in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                got, begin = np.frombuffer(blob.as_buffer(), f"<u{width}"), 0
                while begin < len(got):
                    piece = got[begin : begin + block - size]
                    held.append(piece)
                    docs_.append({"doc": k, "continued": begin > 0, "n": len(piece)})
                    begin, size = begin + len(piece), size + len(piece)
                    if size >= block:
                        yield flush()
        if held:
            yield flush()

    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    ordered = rows.where("tally is null").repartitionByRange(parts, F.col("k").asc_nulls_first()).sortWithinPartitions(F.col("k").asc_nulls_first(), "ids")
    with settings(spark, BATCHES):
        ordered.select("k", "ids", F.spark_partition_id().alias("p")).mapInArrow(returning(run), "part int, block int, n_tokens bigint, payload binary, checkpoints binary, docs array<struct<doc:bigint,continued:boolean,n:bigint>>").write.option("compression", "none").parquet(f"{folder}/blocks")


SCHEMA = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("n_tokens", pa.int64()), ("payload", pa.binary()), ("checkpoints", pa.binary()), ("docs", pa.list_(pa.struct([("doc", pa.int64()), ("continued", pa.bool_()), ("n", pa.int64())])))])


def decode_corpus(spark: SparkSession, folder: str) -> DataFrame:
    """(part, block, place, doc, continued, n, ids) of every document, or piece of one, from the files."""
    return decode_as(spark, folder, lambda pieces: pieces, f"{PLACES}, ids binary")


def decode_as(spark: SparkSession, folder: str, made: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """What ``made`` makes of the PIECES of every block, in the worker that decodes it."""
    ship(spark)
    book = spark.read.parquet(f"{folder}/codebook").first()
    book = (bytes(book["ids"]), bytes(book["lengths"]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        codec = Codec(*book)
        for b in batches:
            yield from map(made, decoded(b, codec))

    return spark.read.parquet(f"{folder}/blocks").mapInArrow(returning(run), schema)


def decoded(blocks: pa.RecordBatch, codec: Codec) -> Iterator[pa.RecordBatch]:
    """PIECES of each of the blocks."""
    docs = blocks.column("docs")
    ends, fields = docs.offsets.to_pylist(), [docs.values.field(c) for c in ("doc", "continued", "n")]
    for i, row in enumerate(blocks.select(["part", "block", "n_tokens", "payload", "checkpoints"]).to_pylist()):
        ids = codec.decode(row["payload"], row["checkpoints"], row["n_tokens"]).astype("<u4")
        doc, continued, n = (x.slice(ends[i], ends[i + 1] - ends[i]) for x in fields)
        many, at = len(n), np.concatenate(([0], 4 * np.cumsum(n.to_numpy())))
        blobs = pa.Array.from_buffers(pa.binary(), many, [None, pa.py_buffer(at.astype("<i4")), pa.py_buffer(ids)])
        places = [np.full(many, row["part"], np.int32), np.full(many, row["block"], np.int32), np.arange(many, dtype=np.int32)]
        yield pa.RecordBatch.from_arrays([*map(pa.array, places), doc, continued, n, blobs], schema=PIECES)


PLACES = "part int, block int, place int, doc bigint, continued boolean, n bigint"
PIECES = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("place", pa.int32()), ("doc", pa.int64()), ("continued", pa.bool_()), ("n", pa.int64()), ("ids", pa.binary())])


def digests(spark: SparkSession, folder: str) -> DataFrame:
    """(doc, start, n_tokens, ids_crc32) of every document, in the file's order, read back from the files.

    Documents start where the blocks before theirs end: offsets of partitions (few) and of blocks within
    a partition are prefix sums of the blocks' own counts. The CRC of a document of many pieces is combined
    from them in order, by grouping its pieces.
    """
    blocks = spark.read.parquet(f"{folder}/blocks").select("part", "block", "n_tokens")
    parts = blocks.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    parts = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))
    inside = Window.partitionBy("part").orderBy("block")
    starts = blocks.withColumn("own", F.sum("n_tokens").over(inside) - F.col("n_tokens")).join(parts, "part").select("part", "block", (F.col("own") + F.col("base")).alias("at"))

    def checked(b: pa.RecordBatch) -> pa.RecordBatch:
        crc = [zlib.crc32(x.as_buffer()) for x in b.column("ids")]
        return pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(crc, pa.int64())], [*b.schema.names[:-1], "crc"])

    pieces = decode_as(spark, folder, checked, f"{PLACES}, crc bigint")
    before = Window.partitionBy("part", "block").orderBy("place")
    pieces = pieces.withColumn("skip", F.sum("n").over(before) - F.col("n")).join(starts, ["part", "block"]).withColumn("start", F.col("at") + F.col("skip"))
    # a document is its first piece and the continued ones after it in the partition
    heads = Window.partitionBy("part").orderBy("block", "place")
    pieces = pieces.withColumn("head", F.sum((~F.col("continued")).cast("int")).over(heads))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            crcs = []
            for group in b.column(3).to_pylist():
                crc = 0
                for x in group:
                    crc = crc_combine(crc, x["crc"], 4 * x["n"])
                crcs.append(crc)
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(crcs, pa.int64())], ["doc", "start", "n_tokens", "ids_crc32"])

    with settings(spark, BATCHES):
        counted = stash(pieces.withColumn("pieces", F.count("*").over(Window.partitionBy("part", "head"))), "pieces")
    whole = counted.where("pieces = 1").select("doc", "start", F.col("n").alias("n_tokens"), F.col("crc").alias("ids_crc32"))
    parts = counted.where("pieces > 1").groupBy("part", "head").agg(F.min("doc").alias("doc"), F.min("start").alias("start"), F.sum("n").alias("n_tokens"), F.sort_array(F.collect_list(F.struct("start", "n", "crc"))).alias("x"))
    split = parts.select("doc", "start", "n_tokens", "x").mapInArrow(join, "doc bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
    return whole.union(split)


def _times(m: tuple[int, ...], v: int) -> int:
    """A matrix over GF(2), as columns, times a vector."""
    out = 0
    for column in m:
        if v & 1:
            out ^= column
        v >>= 1
    return out


@cache
def zeros(power: int) -> tuple[int, ...]:
    """The matrix that appends 2^power zero bits to what a CRC was taken of."""
    if power == 0:
        return (0xEDB88320, *[1 << i for i in range(31)])
    half = zeros(power - 1)
    return tuple(_times(half, c) for c in half)


def crc_combine(left: int, right: int, size: int) -> int:
    """CRC-32 of two byte strings in a row, from theirs and the second's size."""
    bits, power = 8 * size, 0
    while bits:
        if bits & 1:
            left = _times(zeros(power), left)
        bits, power = bits >> 1, power + 1
    return left ^ right


def op9_tokenfile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode all documents to the token file and return what the files hold of each."""
    folder = scratch(spark, "tokens")
    encode_corpus(table(spark, sf_dir, "documents"), folder)
    return digests(spark, folder).withColumnRenamed("doc", "doc_id")
