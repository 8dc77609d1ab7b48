"""Near-duplicate removal: every pair of similarity SHARE or more on five-word shingles is found.

Covering locality-sensitive hashing goes first: SimHash fingerprints of the five-word shingles, linked within two bits
by structured masks (``simhash.links``), name the pairs that are nearly equal, and whole shingle sets confirm them. SimHash alone
can't be enough: a pair at similarity 0.8 differs in ten bits or so. So an exact join finds the rest.

Two sets of shingles with that Jaccard similarity share one among the first n - ceil(SHARE n) + 1 of each, in any
fixed order of all shingles (prefix filter). So each text is marked with the start of its set, frequent shingles
of a sample of texts last, then by hash, and texts that share a mark are candidates; sizes and places rule out
pairs that can't reach SHARE. A pair counts only if its whole sets reach it; connected pairs form a group, of
which the smallest key stays.

Not all pairs of a large group are needed to connect it. After the fingerprints' links, each text is compared, in rounds while
these add links, with one text of each of its marks, about one hub to DEAL of them: that is linear. Of marks that the same texts share, the first stands for all. Last, all candidate pairs that the links don't connect
already are compared, with the texts of a frequent mark dealt in salted parts. The last step leaves nothing out; it is
quadratic only in texts that share a mark and aren't connected.

Candidates are compared by sketches first: a set's numbers of hashes by range bound what two sets can share, in about a tenth of the
sets' bytes. Only pairs that they allow are compared by their whole sets.

Exact copies are one text from the start: they are grouped by hash with map-side aggregation, so a group of any
size costs a row a task. (Texts count as equal if two independent 64-bit hashes agree.)
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import UNBROADCAST, discard, encode, fresh, mix, returning, settings, ship, slices, stash, tallied, word_hashes
from .graph import components
from .simhash import links as near_fingerprints
from .simhash import majority

SHARE, SHINGLE = 0.8, 5
#: Texts that are sampled for frequent shingles; those in FREQUENT or more of them come last, at most LISTED of them.
SAMPLE, FREQUENT, LISTED = 20_000, 3, 100_000
#: Texts of one mark that a part of the last step holds.
PART = 1000
#: Hub rounds go on while one pair of WORTH is a link, and up to TURNS of them while they add links and over CROSSING pairs a row are open.
WORTH, TURNS, CROSSING = 20, 5, 2
#: Texts of one mark that share a hub, about.
DEAL = 8


def shingles(words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all stretches of width words, repeats included; fewer words: of them all; none: nothing."""
    width = min(width, len(words))
    out = np.zeros(len(words) - width + 1 if width else 0, np.uint64)
    for j in range(width):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + words[j : j + len(out)] + np.uint64(j + 1))
    return out


def start_of_set(s: np.ndarray, hot: np.ndarray, counts: np.ndarray, share: float) -> np.ndarray:
    """The first shingles of a sorted set, as many as the prefix filter needs, those of hot last by their counts."""
    if not len(s):
        return np.zeros(1, np.uint64)  # sets without shingles are equal
    need = len(s) - math.ceil(share * len(s) - 1e-6) + 1
    if len(hot):
        at = np.minimum(np.searchsorted(hot, s), len(hot) - 1)
        rank = np.where(hot[at] == s, counts[at], 0)
        s = s[np.argsort(rank, kind="stable")]
    return s[:need]


def word_lists(texts: list) -> Iterator[np.ndarray]:
    for i, j in slices(len(texts), np.array([len(t or "") + 16 for t in texts], np.int64), 2 << 20):
        data, offsets = encode(texts[i:j])
        words, starts = word_hashes(data)
        cuts = np.searchsorted(starts, offsets)
        for n in range(j - i):
            yield words[cuts[n] : cuts[n + 1]]


def frequent(nodes: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of the shingles that stand in many texts of a sample, and in how many. They only order the marks."""
    every = max(1, -(-nodes.count() // SAMPLE))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for w in word_lists(b.column(0).to_pylist()):
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(shingles(w, SHINGLE)).view(np.int64))], ["s"])

    found = nodes.where(F.pmod("node", F.lit(every)) == 0).select("t").mapInArrow(run, "s bigint")
    most = found.groupBy("s").agg(F.count("*").alias("n")).where(F.col("n") >= FREQUENT).orderBy(F.desc("n"), "s").limit(LISTED).toArrow()
    hot, counts = most.column("s").to_numpy().view(np.uint64), most.column("n").to_numpy()
    order = np.argsort(hot)
    return hot[order], counts[order]


def marks(nodes: DataFrame, share: float) -> DataFrame:
    """(node, t) -> (node, s, i, n, fp): a row for each mark s, its place i among the text's, the size n of the text's set and its SimHash fingerprint."""
    ship(nodes.sparkSession)
    hot, counts = frequent(nodes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j in slices(b.num_rows, np.full(b.num_rows, 1), 256):
                part, sizes, prints = [], [], []
                for words in word_lists(b.column(1).slice(i, j - i).to_pylist()):
                    every = shingles(words, SHINGLE)
                    own = np.unique(every)
                    prints.append(majority(every) if len(every) else 0)
                    part.append(start_of_set(own, hot, counts, share))
                    sizes.append(len(own))
                many = np.array([len(x) for x in part])
                node = np.repeat(b.column(0).slice(i, j - i).to_numpy(), many)
                place = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(np.concatenate(part).view(np.int64)), pa.array(place.astype(np.int32)), pa.array(np.repeat(sizes, many).astype(np.int32)), pa.array(np.repeat(np.array(prints, np.uint64).view(np.int64), many))], ["node", "s", "i", "n", "fp"])

    return nodes.mapInArrow(returning(run), "node bigint, s bigint, i int, n int, fp bigint")


def shingle_sets(texts: DataFrame) -> DataFrame:
    """(node, t) -> (node, s): sorted distinct shingle hashes as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            blobs = [np.unique(shingles(w, SHINGLE)).tobytes() for w in word_lists(b.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(blobs, pa.binary())], ["node", "s"])

    return texts.mapInArrow(returning(run), "node bigint, s binary")


def sketch(s: np.ndarray) -> bytes:
    """How many of a set's hashes fall into each of equal ranges: as many ranges as hashes or up to twice as many, a byte each."""
    bits = max(3, int(len(s) - 1).bit_length()) if len(s) else 3
    return np.minimum(np.bincount((s >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits), 255).astype(np.uint8).tobytes()


def sketches(nodes: DataFrame) -> DataFrame:
    """(node, t) -> (node, z): sketches of the shingle sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([sketch(np.unique(shingles(w, SHINGLE))) for w in word_lists(b.column(1).to_pylist())], pa.binary())], ["node", "z"])

    return nodes.mapInArrow(returning(run), "node bigint, z binary")


def may_be_similar(left: np.ndarray, right: np.ndarray, share: float) -> bool:
    """Whether two sketches allow the similarity: sets share at most the lesser number of each range."""
    if max(left.max(), right.max()) == 255:  # not counted further
        return True
    left, right = (x.reshape(min(len(left), len(right)), -1).sum(axis=1, dtype=np.int64) for x in (left, right))
    both = int(np.minimum(left, right).sum())
    return both >= share * (int(left.sum()) + int(right.sum()) - both)


def close(pairs: DataFrame, drawn: DataFrame, share: float) -> DataFrame:
    """The pairs (a, b) whose sketches allow the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = [may_be_similar(*(np.frombuffer(x.as_buffer(), np.uint8) for x in two), share) for two in zip(b.column(2), b.column(3), strict=True)]
            yield b.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    held = pairs.join(drawn.select(F.col("node").alias("a"), F.col("z").alias("y")), "a").join(drawn.withColumnRenamed("node", "b"), "b")
    return held.select("a", "b", "y", "z").mapInArrow(returning(run), "a bigint, b bigint")


def similar(pairs: DataFrame, share: float) -> DataFrame:
    """(a, b, s, z) -> (a, b) whose sets s and z have the Jaccard similarity; two empty sets are equal."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for s, z in zip(b.column(2), b.column(3), strict=True):
                left, right = np.frombuffer(s.as_buffer(), np.uint64), np.frombuffer(z.as_buffer(), np.uint64)
                both = len(np.intersect1d(left, right, assume_unique=True))
                keep.append(both >= share * (len(left) + len(right) - both))
            yield b.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return pairs.mapInArrow(returning(run), "a bigint, b bigint")


def shared(marked: DataFrame) -> DataFrame:
    """The marks that several texts have."""
    sizes = marked.groupBy("s").agg(F.count("*").alias("m")).where("m > 1")
    return marked.join(sizes, "s").select("node", "s", "i", "n")


def print_pairs(marked: DataFrame) -> DataFrame:
    """marks() rows -> distinct (a, b): pairs that connect the texts whose fingerprints are equal or linked within two bits."""
    prints = stash(marked.where("i = 0").select("node", "fp"), "fingerprints")
    first = prints.groupBy("fp").agg(F.min("node").alias("least"))
    near = near_fingerprints(first.select("fp"))
    ends = near.join(first.select(F.col("fp").alias("a"), F.col("least").alias("x")), "a").join(first.select(F.col("fp").alias("b"), F.col("least").alias("y")), "b")
    pairs = prints.join(first, "fp").where("node <> least").select(F.col("node").alias("x"), F.col("least").alias("y")).union(ends.select("x", "y"))
    return pairs.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct()


def open_rows(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """shared() rows -> (s, node, i, n, root, m, p) of the marks whose texts aren't all of one component; m, p: texts and parts of a mark.

    Of marks that exactly the same texts have, only the first in the order of all shingles stays: there, each of their pairs can reach the most.
    """
    rows = rows.join(roots, "node", "left").select("node", "s", "i", "n", F.coalesce("root", "node").alias("root"))
    alike = [F.bit_xor(F.xxhash64("node", F.lit(x))).alias(f"h{x}") for x in range(2)]
    mixed = rows.groupBy("s").agg(F.count("*").alias("m"), F.min("root").alias("x"), F.max("root").alias("y"), F.sum("i").alias("at"), *alike).where("x <> y")
    first = mixed.groupBy("m", "h0", "h1").agg(F.min_by("s", F.struct("at", "s")).alias("s"))
    return rows.join(first.select("s", "m", F.ceil(F.col("m") / PART).cast("int").alias("p")), "s")


def crossing(rows: DataFrame) -> int:
    """open_rows() -> how many pairs of one mark and two components there are, those of several marks repeated."""
    own = rows.groupBy("s", "root").agg(F.count("*").alias("c"))
    each = own.groupBy("s").agg((F.sum("c") * F.sum("c") - F.sum(F.col("c") * F.col("c"))).alias("x"))
    return (each.agg(F.sum("x")).first()[0] or 0) // 2


def may_reach(left: str, right: str, share: float) -> Column:
    """Whether two texts of one mark are of different components and can reach share, by size and by what follows their first shared mark."""
    n, m, i, j = F.col(f"{left}.n"), F.col(f"{right}.n"), F.col(f"{left}.i"), F.col(f"{right}.i")
    sizes = F.least(n, m) >= F.greatest(n, m) * F.lit(share) - F.lit(1e-6)
    places = F.least(n - i, m - j) >= (n + m) * F.lit(share / (1 + share)) - F.lit(1e-6)
    return (F.col(f"{left}.root") != F.col(f"{right}.root")) & sizes & places


def hub_pairs(rows: DataFrame, turn: int, share: float) -> DataFrame:
    """open_rows() -> distinct (a, b): each text with one text of each of its marks, another one each turn.

    The texts of a large mark are dealt to several hubs, so that no single text has to be like most of them. Marks of much the same texts deal them
    alike, so that their pairs are the same.
    """
    deals = F.pow(F.lit(2), F.floor(F.log2(F.greatest(F.col("m") / DEAL, F.lit(1.0))))).cast("long")
    dealt = rows.withColumn("deal", F.pmod(F.xxhash64("node", F.lit(turn)), deals))
    hubs = dealt.groupBy("s", "deal").agg(F.min_by(F.struct("node", "root", "n", "i"), F.xxhash64(F.lit(turn), "node")).alias("r"))
    pairs = dealt.alias("l").join(hubs, ["s", "deal"]).where(may_reach("l", "r", share))
    return pairs.select(F.greatest("l.node", "r.node").alias("a"), F.least("l.node", "r.node").alias("b")).distinct()


def open_pairs(rows: DataFrame, share: float) -> DataFrame:
    """open_rows() -> distinct (a, b): all pairs that can reach share and aren't of one component."""
    left = rows.withColumn("part", F.pmod(F.xxhash64("node"), "p").cast("int")).alias("l")
    right = rows.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("p") - 1))).alias("r")
    on = (F.col("l.s") == F.col("r.s")) & (F.col("l.part") == F.col("r.part")) & (F.col("l.node") > F.col("r.node")) & may_reach("l", "r", share)
    return left.join(right, on).select(F.col("l.node").alias("a"), F.col("r.node").alias("b")).distinct()


def verified(pairs: DataFrame, nodes: DataFrame, drawn: DataFrame, share: float) -> DataFrame:
    """The pairs whose whole sets have the similarity. Most that haven't are ruled out by their sketches, so that few sets are sent."""
    pairs = stash(close(pairs, drawn, share), "close")
    asked = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    sets = stash(shingle_sets(nodes.join(asked, "node", "left_semi")), "shingles")
    held = pairs.join(sets.withColumnRenamed("node", "a"), "a").join(sets.select(F.col("node").alias("b"), F.col("s").alias("z")), "b")
    links = stash(similar(held.select("a", "b", "s", "z"), share), "links")
    discard(sets, pairs)
    return links


def grouped_texts(nodes: DataFrame, share: float) -> DataFrame:
    """(node, t) -> (node, root) of the texts that are like others: root is the smallest node of the group."""
    marked = stash(marks(nodes, share), "marks")
    drawn = stash(sketches(nodes), "sketches")
    asked = stash(print_pairs(marked), "candidates")
    links = verified(asked, nodes, drawn, share)
    rows = stash(shared(marked), "shared")
    discard(asked, marked)  # what is read no more goes, so that only one round's tables are there at a time
    left, turn, more = stash(open_rows(rows, components(links)), "open"), 0, True
    while more:
        asked, (many,) = tallied(hub_pairs(left, turn, share), "candidates", F.count(F.lit(1)))
        found = verified(asked, nodes, drawn, share)
        new, turn = found.count(), turn + 1
        more = new * WORTH > many
        discard(asked)
        if new:
            links, before = links.union(found), left
            left = stash(open_rows(rows, components(links)), "open")
            discard(before)
            more = more or turn < TURNS and crossing(left) > CROSSING * left.count()
    asked = stash(open_pairs(left, share), "candidates")
    discard(left, rows)
    rest = verified(asked, nodes, drawn, share)
    discard(asked, drawn)
    return components(links.union(rest))


def deduplicate(docs: DataFrame, key: str = "doc_id", text: str = "text", share: float = SHARE) -> DataFrame:
    """The rows of docs that stay: one of each group of exact and near copies, that with the smallest key.

    Null text counts as empty; texts without words are near copies of each other. Null keys count as larger
    than all others. Of repeated rows one stays. An empty table stays empty. All columns are kept, whatever their names.
    """
    names, whole = docs.columns, F.coalesce(F.col(text), F.lit(""))
    h, g, k = fresh(docs, "h", "g", "k")
    marked = docs.withColumns({h: F.xxhash64(whole), g: F.xxhash64(whole, F.lit(1))})
    first = marked.groupBy(h, g).agg(F.min(key).alias(k))
    texts = marked.join(first, [h, g]).where(F.col(key).eqNullSafe(F.col(k))).dropDuplicates([h, g]).drop(k, g)
    with settings(docs.sparkSession, UNBROADCAST):
        texts = stash(texts, "texts")
        nodes = texts.select(F.col(h).alias("node"), F.coalesce(F.col(text), F.lit("")).alias("t"))
        roots = grouped_texts(nodes, share)
    grouped = texts.select(F.col(h).alias("node"), F.col(key).alias("k")).join(roots, "node")
    stays = grouped.groupBy("root").agg(F.min_by("node", F.struct(F.col("k").isNull(), "k", "node")).alias("kept"))
    gone = grouped.join(stays, "root").where("node <> kept").select(F.col("node").alias(h))
    return texts.join(gone, h, "left_anti").select(*names)
