"""What the operators share: reading tables, shared scratch tables, shipping the package, text classes.

Text classes are ASCII-only by contract: lower-casing touches A-Z alone and words are
runs without the six ASCII white-space characters, so results do not depend on a locale
or a Unicode version.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship as ship

#: Runs without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: A-Z and their lower-case forms, for translate().
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bytes of ASCII white space.
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Byte values with A-Z mapped to a-z.
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32

#: Whether a query's shuffle files go as soon as it has ended.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: No join is turned into a broadcast: in loops of many small joins, each is one more job and one more table in the driver's memory.
UNBROADCAST = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, else, in a session on one machine alone, a local one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        if found.isDefined():
            return found.get()
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='chronoweave-')}"
        spark.sparkContext.setCheckpointDir(folder)
        return spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return folder


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write a frame to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark, path = df.sparkSession, scratch(df.sparkSession, name)
    before = spark.conf.get(CLEAN_UP, "false")
    spark.conf.set(CLEAN_UP, "true")  # the written table replaces the shuffle files; a failed job writes none
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEAN_UP, before)
    return spark.read.schema(df.schema).parquet(path)


def tallied(df: DataFrame, name: str, *sums: Column) -> tuple[DataFrame, tuple]:
    """stash(), and aggregates of what is written, taken while it is: no job of their own."""
    seen = Observation()
    out = stash(df.observe(seen, *[c.alias(f"c{i}") for i, c in enumerate(sums)]), name)
    return out, tuple(seen.get[f"c{i}"] for i in range(len(sums)))


@contextlib.contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Settings of the session for a while; then what was set before, or wasn't, holds again."""
    before = {k: spark.conf.get(k, None) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def discard(*stashed: DataFrame) -> None:
    """Delete the files of frames that stash() gave. For their owner, once all that was built on them is written."""
    for df in stashed:
        files = df.inputFiles()
        if files:
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(files[0].rsplit("/", 1)[0])
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names that no column of df has, whatever its columns are called."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        name = f"__{n}"
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def give_back() -> None:
    """Return to the system what earlier tasks of a reused worker have freed."""
    gc.collect()
    trim()


def trim() -> None:
    """Return freed memory to the system, without a search for cycles: cheap enough to come between batches."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every C library has it
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def returning(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, which gives back what it has freed when it ends: idle workers stay beside the stages that follow."""

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return own


def encode(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts, one zero space (0x20) after each, and the offsets at which they start (one more at the end)."""
    raw = [b"" if t is None else t.encode("utf-8", "surrogatepass") for t in texts]
    offsets = np.zeros(len(raw) + 1, np.int64)
    np.cumsum([len(r) + 1 for r in raw], out=offsets[1:])
    return np.frombuffer(b" ".join(raw) + b" ", np.uint8), offsets


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash and start of each word of ASCII-folded bytes, all vectorised.

    The hash is a polynomial over the word's bytes modulo 2^64, finished by a mixer; words are
    equal iff length and bytes are, up to 64-bit collisions.
    """
    space = SPACE[data]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], space, [True])).view(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return np.zeros(0, np.uint64), starts
    return span_hashes(FOLD[data], starts, ends), starts


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[start:end] for non-empty spans, by a mixed polynomial over 8-byte lanes."""
    lengths = ends - starts
    value = np.full(len(starts), 0x9E3779B97F4A7C15, np.uint64) ^ lengths.astype(np.uint64)
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    lanes = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    at, live = starts.copy(), np.arange(len(starts))
    while len(live):
        left = ends[live] - at[live]
        lane = lanes[at[live]]
        short = np.minimum(left, 8).astype(np.uint64)
        lane = np.where(short == 8, lane, lane & ((np.uint64(1) << (short % np.uint64(8) * np.uint64(8))) - np.uint64(1)))
        value[live] = mix(value[live] * np.uint64(0xD6E8FEB86659FD93) + lane)
        at[live] += 8
        live = live[left > 8]
    return value


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of 64-bit hashes."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def slices(count: int, weights: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of rows whose weights sum to about limit; at least one row each."""
    total = np.cumsum(weights)
    i = 0
    while i < count:
        base = total[i - 1] if i else 0
        j = max(i + 1, int(np.searchsorted(total, base + limit, "right")))
        yield i, min(j, count)
        i = j


def tokenizer_path(name: str) -> str:
    """Path of a public vocabulary file; a parameter of the operators that use one."""
    import public_tokenizers

    return os.fspath(public_tokenizers.path(name))
