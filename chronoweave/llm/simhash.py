"""SimHash near-duplicate classes through covering locality-sensitive hashing.

Covering hashing (radius r): every bit position gets a random non-zero vector of r+1 bits; the
mask of table v (each non-zero v of r+1 bits) keeps the positions whose vector has odd inner
product with v. Any r differing positions span at most r dimensions, so some v is orthogonal to
all of them: the two fingerprints agree on that mask. Hence no pair within the radius is lost.

Work is on distinct fingerprints. Buckets of up to ``hot`` members compare their members
pairwise; larger ones use an exact detour of bounded fan-out (radius 2): each member offers
itself and its 64 one-bit neighbours as keys; members that share a key are within two bits of
one another, a key has at most 65 members, and all link to its smallest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ship, stash, table
from .graph import components

BITS = 64


def simhash(text: str | None, width: int = 3) -> int:
    """64-bit SimHash of word shingles with repeats; no words: 0; a bit is set if it is in over half the hashes."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined, ends = b" ".join(words), np.cumsum([len(w) + 1 for w in words]).tolist()
    if len(words) <= width:
        hashes = [xxhash.xxh64_intdigest(joined, 42)]
    else:
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[i : j - 1], 42) for i, j in zip([0, *ends], ends[width - 1 :], strict=False)]
    return majority(np.array(hashes, np.uint64))


def majority(hashes: np.ndarray) -> int:
    counts = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), 1 << 15):  # bounded memory for very long texts
        part = hashes[i : i + (1 << 15)]
        counts += np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, key: str, text: str = "text", width: int = 3) -> DataFrame:
    """(key, fp long) of each row; null text counts as empty."""
    ship(docs.sparkSession)
    rows = docs.select(key, text)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([simhash(t, width) for t in b.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64())], [key, "fp"])

    return rows.mapInArrow(run, f"`{key}` {rows.schema[key].dataType.simpleString()}, fp bigint")


def covering_masks(radius: int, bits: int = BITS, seed: int = 7) -> list[int]:
    """The 2^(r+1) - 1 masks, as signed 64-bit integers. Position vectors are balanced over the non-zero vectors."""
    vectors = np.arange(bits) % (2 ** (radius + 1) - 1) + 1
    np.random.default_rng(seed).shuffle(vectors)
    masks = []
    for v in range(1, 2 ** (radius + 1)):
        keep = [(int(x) & v).bit_count() & 1 for x in vectors]
        m = sum(k << i for i, k in enumerate(keep))
        masks.append(m - (1 << 64) if m >> 63 else m)
    return masks


def links(nodes: DataFrame, radius: int = 2, hot: int = 16) -> DataFrame:
    """Distinct (fp) -> links (a, b) that connect exactly the fingerprints within radius (transitively, for hot buckets)."""
    masks = covering_masks(radius)
    keyed = nodes.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in masks])).alias("t", "k"))
    sizes = keyed.groupBy("t", "k").count().where("count > 1")
    keyed = stash(keyed.join(sizes, ["t", "k"]), "buckets")
    cold = keyed.where(F.col("count") <= hot).select("t", "k", "fp")
    a, b = cold.withColumnRenamed("fp", "a"), cold.withColumnRenamed("fp", "b")
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius
    pairs = a.join(b, ["t", "k"]).where((F.col("a") > F.col("b")) & near).select("a", "b")
    crowd = keyed.where(F.col("count") > hot).select("fp").distinct()
    if radius != 2:
        raise ValueError("the exact detour for crowded buckets is for radius 2")
    flips = F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(1 << i if i < 63 else -(1 << 63))) for i in range(BITS)])
    offered = crowd.select("fp", F.explode(flips).alias("z"))
    hubs = offered.groupBy("z").agg(F.min("fp").alias("b"), F.count("*").alias("n")).where("n > 1").drop("n")
    stars = offered.join(hubs, "z").select(F.col("fp").alias("a"), "b").where("a <> b")
    return pairs.union(stars).distinct()


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 3, radius: int = 2) -> DataFrame:
    """(key, fp, component) of each row: component is the smallest key reachable over links within radius.

    Null text: empty; no words: fingerprint 0, linked like any other. Repeated rows share their
    class. A null key keeps its row; it is smallest only in classes that have no other key.
    An empty table gives an empty result. Columns other than key and text are ignored.
    """
    own = stash(fingerprints(docs, key, text, width).withColumnRenamed(key, "__k"), "fingerprints")
    nodes = own.groupBy("fp").agg(F.min("__k").alias("least"))
    roots = components(links(nodes.select("fp"), radius)).withColumnRenamed("node", "fp")
    rooted = nodes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component"))
    classes = rooted.join(least, "root").select("fp", "component")
    return own.join(classes, "fp").select(F.col("__k").alias(key), "fp", "component")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and class of every document (3-word shingles, two bits)."""
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id"))
