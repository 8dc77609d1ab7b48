"""URL filter: rules as sorted arrays of 64-bit digests, memory-mapped, probed by binary search, confirmed by their strings.

A rule is a host and the beginning of a path, and fits the host and all its subdomains. Rules are sorted by XXH64 of host and path and
kept in one file of arrays: digests, offsets, strings, verdicts. A second array holds the digests of the rules' hosts, with the
lengths of the paths that rules of that host have. For a batch of URLs, every suffix of a host that begins at a label is probed
in the hosts' array, all at once; only for those that are there, beginnings of the path of the lengths that the host has are
probed among the rules. A hit counts if the stored string is the asked one, and equal digests follow one another, so collisions
cost a step and change nothing. The longest rule wins; of equally long ones that with the longer host.

Spark writes the files' content from the rules' table, in shards by hash of at most SHARD_BYTES of strings; the driver hands on one shard at
a time as a file of the application, each executor maps its copy, and the workers of an executor share its pages. Every shard is
a pass over (url) alone, without an exchange, and passes keep the best rule so far: a list of any size takes more passes, not more memory.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, fresh, ship, stash, table

SEED, BITS = 42, 64
#: Between a rule's host and its path.
CUT = b"\0"
#: Bytes of a shard's strings, about.
SHARD_BYTES = 64 << 20


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Lower-cased host, after the first ``://`` up to ``/``, ``?``, ``#`` or the end, and the path from there up to ``?``, ``#`` or the end."""
    cut = F.instr(url, "://")
    there = F.coalesce(cut > 0, F.lit(False))
    tail = F.substring(url, cut + 3, F.length(url))
    host = F.regexp_extract(tail, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(tail, F.length(host) + 1, F.length(tail)), r"^[^?#]*", 0)
    return F.when(there, ascii_lower(host)).otherwise(""), F.when(there, path).otherwise("")


def digest(text: bytes, bits: int = BITS) -> int:
    return xxhash.xxh64_intdigest(text, SEED) >> (64 - bits)


SHARD = pa.schema([(c, pa.binary()) for c in ("digest", "offset", "text", "block", "hosts", "host_offset", "host_text", "length_offset", "lengths")])


def shard(rules: list[tuple[str, str, str]], bits: int = BITS) -> dict[str, bytes]:
    """The arrays of some rules (host, path, verdict): equal rules once, blocking if any of them blocks."""
    kept: dict[tuple[bytes, bytes], bool] = {}
    for host, path, verdict in rules:
        key = (host.encode(), path.encode())
        kept[key] = kept.get(key, False) or verdict == "block"
    ordered = sorted((digest(h + CUT + p, bits), h, p, b) for (h, p), b in kept.items())
    lengths: dict[bytes, set[int]] = {}
    for _, h, p, _ in ordered:
        lengths.setdefault(h, set()).add(len(p))
    hosts = sorted((digest(h, bits), h) for h in lengths)
    ends = lambda xs: np.concatenate(([0], np.cumsum([len(x) for x in xs]))).astype("<i8").tobytes()
    return {
        "digest": np.array([r[0] for r in ordered], "<u8").tobytes(), "offset": ends([r[1] + CUT + r[2] for r in ordered]), "text": b"".join(r[1] + CUT + r[2] for r in ordered),
        "block": np.array([r[3] for r in ordered], np.uint8).tobytes(),
        "hosts": np.array([h[0] for h in hosts], "<u8").tobytes(), "host_offset": ends([h[1] for h in hosts]), "host_text": b"".join(h[1] for h in hosts),
        "length_offset": ends([lengths[h[1]] for h in hosts]), "lengths": np.array([x for h in hosts for x in sorted(lengths[h[1]])], "<i4").tobytes(),
    }


KINDS = {"digest": "<u8", "offset": "<i8", "text": "u1", "block": "u1", "hosts": "<u8", "host_offset": "<i8", "host_text": "u1", "length_offset": "<i8", "lengths": "<i4"}


def write_shard(arrays: dict[str, bytes], path: Path) -> None:
    """All arrays one after another, each from a multiple of 8, their sizes first."""
    with path.open("wb") as f:
        f.write(np.array([len(arrays[c]) for c in KINDS], "<i8").tobytes())
        for c in KINDS:
            f.write(arrays[c] + bytes(-len(arrays[c]) % 8))


class Rules:
    """A shard's file, memory-mapped."""

    def __init__(self, path: str, bits: int = BITS) -> None:
        data, self.bits = np.memmap(path, np.uint8, "r"), bits
        sizes = data[: 8 * len(KINDS)].view("<i8").tolist()
        at = 8 * len(KINDS)
        for (name, kind), size in zip(KINDS.items(), sizes, strict=True):
            setattr(self, name, data[at : at + size].view(kind))
            at += size + -size % 8

    @staticmethod
    def probe(digests: np.ndarray, offset: np.ndarray, text: np.ndarray, asked: list[bytes], bits: int) -> np.ndarray:
        """The place of each asked string, -1 where it isn't: all digests by one binary search, then the strings of equal digests."""
        keys = np.array([digest(a, bits) for a in asked], np.uint64)
        at = np.searchsorted(digests, keys)
        out = np.full(len(asked), -1, np.int64)
        live = np.flatnonzero(at < len(digests))
        while len(live := live[(at[live] < len(digests))]) and len(live := live[digests[at[live]] == keys[live]]):
            same = np.array([text[offset[a] : offset[a + 1]].tobytes() == asked[i] for i, a in zip(live.tolist(), at[live].tolist(), strict=True)], bool)
            out[live[same]] = at[live[same]]
            live = live[~same]  # another string of this digest: the next may be it
            at[live] += 1
        return out

    def match(self, hosts: list[bytes], paths: list[bytes]) -> list[tuple[int, int, str, bool] | None]:
        """(length, host's length, rule, whether it blocks) of the longest rule that fits each URL."""
        found: list[tuple[int, int, str, bool] | None] = [None] * len(hosts)
        numbered: dict[bytes, int] = {}
        suffixes: list[list[int]] = []
        for h in hosts:
            cuts = [0, *[i + 1 for i, c in enumerate(h) if c == 46]]
            suffixes.append([numbered.setdefault(h[c:], len(numbered)) for c in cuts] if h else [])
        names = list(numbered)
        known = self.probe(self.hosts, self.host_offset, self.host_text, names, self.bits).tolist()
        of, asked = [], []
        for n, own in enumerate(suffixes):
            for s in own:
                if (at := known[s]) >= 0:
                    for size in self.lengths[self.length_offset[at] : self.length_offset[at + 1]].tolist():
                        if size <= len(paths[n]):
                            of.append(n)
                            asked.append(names[s] + CUT + paths[n][:size])
        place = self.probe(self.digest, self.offset, self.text, asked, self.bits).tolist()
        for n, a, at in zip(of, asked, place, strict=True):
            if at >= 0:
                host, path = a.split(CUT, 1)
                if found[n] is None or (len(a) - 1, len(host)) > found[n][:2]:
                    found[n] = (len(a) - 1, len(host), (host + path).decode(), bool(self.block[at]))
        return found


_mapped: dict[str, Rules] = {}


def mapped(name: str, bits: int) -> Rules:
    if name not in _mapped:
        _mapped[name] = Rules(SparkFiles.get(name), bits)
    return _mapped[name]


def shard_files(rules: DataFrame, host: str, path: str, verdict: str, bits: int) -> list[str]:
    """Names of the application's files of all rules, in shards by hash. Rules without a host, or with another verdict than allow or block, are refused."""
    spark = rules.sparkSession
    rows = rules.select(ascii_lower(F.col(host)).alias("h"), F.coalesce(F.col(path), F.lit("")).alias("p"), F.col(verdict).alias("v"))
    facts = rows.agg(F.sum(F.octet_length("h") + F.octet_length("p") + 32), F.count_if(F.coalesce(F.col("h"), F.lit("")) == ""), F.count_if(~F.coalesce(F.col("v").isin("allow", "block"), F.lit(False)))).first()
    if facts[1] or facts[2]:
        raise ValueError(f"{facts[1]} rules have no host, {facts[2]} another verdict than allow or block")
    count = max(1, -(-(facts[0] or 0) // SHARD_BYTES))

    def build(group: pa.Table) -> pa.Table:
        made = shard(list(zip(*(group[c].to_pylist() for c in ("h", "p", "v")), strict=True)), bits)
        return pa.Table.from_pylist([made], schema=SHARD)

    parts = rows.distinct().withColumn("s", F.pmod(F.xxhash64("h", "p"), F.lit(count)))
    built = stash(parts.groupBy("s").applyInArrow(build, ", ".join(f"{c} binary" for c in SHARD.names)), "url-rules")
    names, folder = [], tempfile.mkdtemp(prefix="url-rules-")  # the driver's own: it serves the executors until the application ends
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    for row in built.toLocalIterator():
        names.append(f"url-rules-{uuid.uuid4().hex}")
        write_shard({c: bytes(row[c]) for c in KINDS}, Path(folder, names[-1]))
        spark.sparkContext.addFile(os.path.join(folder, names[-1]))
    return names


def judge(pages: DataFrame, rules: DataFrame, url: str = "url", host: str = "host", path: str = "path", verdict: str = "verdict", default: str = "allow", bits: int = BITS) -> DataFrame:
    """pages with host, path, rule (the longest that fits, as host and path, else null) and verdict (the rule's, else the default).

    Columns of pages with these names are replaced. Null URLs and those without ``://`` have an empty host and path, which no rule fits.
    Lengths count bytes. Hosts are compared with A-Z folded, ports and user names count as part of them, paths byte by byte. Repeated rules count once; a rule that
    both allows and blocks blocks. Repeated rows are judged each. Empty tables: no rows, or the default for all.
    """
    spark = pages.sparkSession
    ship(spark)
    files = shard_files(rules, host, path, verdict, bits)
    others = [c for c in pages.columns if c.lower() not in ("host", "path", "rule", "verdict")]
    h, p = host_and_path(F.col(url))
    size, host_size, best = fresh(pages, "size", "host_size", "block")
    rows = pages.select(*[F.col(f"`{c}`") for c in others], h.alias("host"), p.alias("path"))
    rows = rows.select("*", F.lit(None).cast("string").alias("rule"), F.lit(0).alias(size), F.lit(0).alias(host_size), F.lit(None).cast("boolean").alias(best))
    names, schema = rows.columns, rows.schema

    def probe(file: str):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = mapped(file, bits)
            for b in batches:
                hosts, paths = ([x.encode() for x in b.column(c).to_pylist()] for c in ("host", "path"))
                so_far = list(zip(*(b.column(c).to_pylist() for c in (size, host_size, "rule", best)), strict=True))
                new = own.match(hosts, paths)
                won = [n if n is not None and n[:2] > o[:2] else o for n, o in zip(new, so_far, strict=True)]
                out = dict(zip(names, b.columns, strict=True))
                for i, c in enumerate((size, host_size, "rule", best)):
                    out[c] = pa.array([w[i] for w in won], out[c].type)
                yield pa.RecordBatch.from_arrays([out[c] for c in names], names)

        return run

    for file in files:
        rows = rows.mapInArrow(probe(file), schema)
    decided = F.when(F.col(best), "block").when(F.col("rule").isNotNull(), "allow").otherwise(default)
    return rows.withColumn("verdict", decided).drop(size, host_size, best)


#: The rules of op12: (host, path, verdict).
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]

SQL = r"""
WITH tail AS (
    SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS t FROM pages),
parts AS (
    SELECT page_id, translate(regexp_extract(t, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
           regexp_extract(substr(t, length(regexp_extract(t, '^[^/?#]*')) + 1), '^[^?#]*') AS path
    FROM tail),
rules(h, p, v) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
fit AS (
    SELECT page_id, host, path, h, p, v, row_number() OVER (PARTITION BY page_id ORDER BY length(h || p) DESC NULLS LAST, length(h) DESC) AS n
    FROM parts LEFT JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p))
SELECT page_id, host, path, h || p AS rule, coalesce(v, 'allow') AS verdict FROM fit WHERE n = 1
"""


def op12_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's URL under the rules; what none fits is allowed."""
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return judge(table(spark, sf_dir, "pages").select("page_id", "url"), rules).select("page_id", "host", "path", "rule", "verdict")
