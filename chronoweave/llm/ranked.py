"""Ranked lexical search: the best documents of each query by branch and bound over trees of maxima.

The index is a table of segments, each of some thousands of documents in order of their keys, with the postings of the terms asked for.
In a segment every term has a tree over ranges of documents: a leaf entry is the term's impact on one document, an entry above it
the largest of FAN ranges below, and entries exist only where the term occurs. A query's bound on a range is the sum of
its terms' entries there. The search opens ranges in order of their bounds, BATCH of them at once, until no open
range can better the k best documents found; among equal bounds it opens the earlier range first, and skips only
those whose documents all lose the tie. A task carries its best documents from one segment to the next,
so later segments are cut sooner. Tasks give at most k documents a query, merged by two windows.

Scores are integers and exact: impact = w ((10^9 tf) div (1000 tf + 12 m)), w = floor(1000 ln((2N + 2) / (2 df + 1))), m = 75 + (25 n N) div L.
Terms are told apart by 64-bit hashes. The queries go to every task, so they come in shards of at most SHARD_BYTES of
text, one pass over the texts for each; none is left out.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

from .common import ship, slices, stash, table
from .decontaminate import words_of
from .lm import pack, unpack

FAN, BATCH = 8, 16
SHARD_BYTES = 32 << 20
#: Postings and documents of a segment, about; characters that are cut into words at once.
POSTINGS, DOCUMENTS, SLICE = 2_000_000, 1 << 15, 4 << 20
#: Parts of a query's candidates that are ranked apart before all of them are.
SALTS = 64


def press(values: np.ndarray, width: int) -> bytes:
    return zstandard.compress(pack(values, width))


def unpress(blob: bytes, width: int) -> np.ndarray:
    return unpack(zstandard.decompress(blob), width).astype(np.int64)


class Queries:
    """Texts as bags of terms: their distinct terms in order of hashes, each query's terms and how often it has them."""

    def __init__(self, texts: list) -> None:
        hashes, begin = words_of(texts)
        self.terms, of = np.unique(hashes, return_inverse=True)
        self.bags = [np.unique(of[i:j], return_counts=True) for i, j in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True)]


class Tree:
    """A segment's postings with their ranges: entries of all levels, leaves first, each with its range, maximum and the entries below."""

    def __init__(self, term: np.ndarray, doc: np.ndarray, impact: np.ndarray, documents: int) -> None:
        """Postings in order of term and document."""
        nodes, values, below, lead = [doc], [impact], [np.zeros((len(doc), 2), np.int64)], [doc]
        base, width, reach = 0, max(documents, 1), 1
        at, node, value = 0, doc, impact
        while width > 1:
            base, width, reach = base + width, -(-width // FAN), reach * FAN
            node = node // FAN
            first = np.flatnonzero(np.concatenate(([True], (term[1:] != term[:-1]) | (node[1:] != node[:-1])))) if len(node) else np.zeros(0, np.int64)
            last = np.append(first[1:], len(node))[: len(first)]
            below.append(np.stack((first, last), 1) + at)
            at += len(node)
            value = np.maximum.reduceat(value, first) if len(first) else value
            term, node = term[first], node[first]
            nodes.append(node + base)
            values.append(value)
            lead.append(node * reach)
        self.documents = documents
        self.node, self.value, self.below, self.lead = (np.concatenate(x) for x in (nodes, values, below, lead))
        self.root_terms, self.root = term, at  # the last level has one entry a term

    def search(self, terms: np.ndarray, times: np.ndarray, k: int, floor: int) -> list[tuple[int, int]]:
        """The k best (score, document) with score > 0 and >= floor, earlier documents first among equals."""
        where = np.searchsorted(self.root_terms, terms)
        there = np.flatnonzero((where < len(self.root_terms)) & (self.root_terms[np.minimum(where, max(len(self.root_terms) - 1, 0))] == terms)) if len(self.root_terms) else where[:0]
        if not len(there):
            return []
        entries = where[there] + self.root
        if self.documents <= 1:
            score = int((self.value[entries] * times[there]).sum())
            return [(score, 0)] if score > 0 and score >= floor else []
        bound = int((self.value[entries] * times[there]).sum())
        open_: list[tuple] = [(-bound, 0, 0, entries, times[there])]
        best: list[tuple[int, int]] = []  # (-score, document), sorted
        made, least, tied = 1, max(floor, 1), None  # a range is of use from this bound on; at the bound, up to this document
        while open_:
            taken, weights = [], []
            while open_ and len(taken) < BATCH:
                high, lead = -open_[0][0], open_[0][1]
                if high < least or tied is not None and high == least and lead > tied:
                    open_.clear()  # the others come after it
                    break
                _, _, _, e, w = heapq.heappop(open_)
                taken.append(e)
                weights.append(w)
            if not taken:
                break
            e, w = np.concatenate(taken), np.concatenate(weights)
            first, last = self.below[e, 0], self.below[e, 1]
            count = last - first
            child = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first, count)
            w = np.repeat(w, count)
            order = np.argsort(self.node[child], kind="stable")
            child, w = child[order], w[order]
            node = self.node[child]
            begin = np.flatnonzero(np.concatenate(([True], node[1:] != node[:-1])))
            bounds = np.add.reduceat(self.value[child] * w, begin)
            lead, end = self.lead[child[begin]], np.append(begin[1:], len(child))
            kept = bounds >= least
            if tied is not None:
                kept &= (bounds > least) | (lead <= tied)
            leaf = node[begin] < self.documents
            ready = np.flatnonzero(kept & leaf)
            if len(ready):
                best = sorted(best + list(zip((-bounds[ready]).tolist(), lead[ready].tolist(), strict=True)))[:k]
                if len(best) == k:
                    least, tied = -best[-1][0], best[-1][1]
            for n in np.flatnonzero(kept & ~leaf).tolist():
                heapq.heappush(open_, (-int(bounds[n]), int(lead[n]), made, child[begin[n] : end[n]], w[begin[n] : end[n]]))
                made += 1
        return [(-s, d) for s, d in best]


SEGMENT = "terms binary, df binary, docs binary, tf binary, n binary, counted bigint, words bigint"
NAMES = ["keys", "terms", "df", "docs", "tf", "n", "counted", "words"]


def segments(docs: DataFrame, asked: np.ndarray) -> DataFrame:
    """The index of docs (k, t): a row for each segment, with the postings of the asked terms, the documents that have terms and all their terms."""
    kind = docs.schema["k"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def flush() -> pa.RecordBatch:
            keys = pa.concat_arrays([h[0] for h in held])
            n = np.concatenate([h[1] for h in held])
            begin = np.concatenate(([0], np.cumsum([len(h[1]) for h in held])))
            term, doc, tf = (np.concatenate([h[c] + (begin[i] if c == 3 else 0) for i, h in enumerate(held)]) for c in (2, 3, 4))
            rank = pc.sort_indices(keys, sort_keys=[("", "ascending")], null_placement="at_end")
            place = np.empty(len(n), np.int64)
            place[rank.to_numpy()] = np.arange(len(n))
            doc = place[doc]
            order = np.lexsort((doc, term))
            term, doc, tf = term[order], doc[order], tf[order]
            terms, first, df = np.unique(term, return_index=True, return_counts=True)
            step = np.diff(doc, prepend=0)
            step[first] = doc[first]
            sorted_n = n[rank.to_numpy()]
            row = [pa.ListArray.from_arrays(pa.array([0, len(n)], pa.int32()), keys.take(rank))]
            row += [pa.array([x], pa.binary()) for x in (press(np.diff(terms, prepend=0), 8), press(df, 4), press(step, 4), press(tf, 8), press(sorted_n, 8))]
            row += [pa.array([int((n > 0).sum())], pa.int64()), pa.array([int(n.sum())], pa.int64())]
            return pa.RecordBatch.from_arrays(row, NAMES)

        for batch in batches:
            texts = batch.column(1).to_pylist()
            for i, j in slices(len(texts), np.array([len(t or "") + 16 for t in texts], np.int64), SLICE):
                hashes, begin = words_of(texts[i:j])
                at = np.minimum(np.searchsorted(asked, hashes), max(len(asked) - 1, 0))
                hit = np.flatnonzero(asked[at] == hashes) if len(asked) else np.zeros(0, np.int64)
                doc = np.searchsorted(begin, hit, "right") - 1
                pairs, tf = np.unique(doc * max(len(asked), 1) + at[hit], return_counts=True)
                held.append((batch.column(0).slice(i, j - i), np.diff(begin), pairs % max(len(asked), 1), pairs // max(len(asked), 1), tf))
                size += len(pairs)
                if size >= POSTINGS or sum(len(h[1]) for h in held) >= DOCUMENTS:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    return docs.mapInArrow(run, f"keys array<{kind}>, {SEGMENT}")


def document_counts(index: DataFrame) -> dict[int, int]:
    """In how many documents each asked term stands. On the driver: the terms of one shard of queries."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(np.cumsum(unpress(row["terms"], 8))), pa.array(unpress(row["df"], 4))], ["term", "df"])

    sums = index.select("terms", "df").mapInArrow(spread, "term bigint, df bigint").groupBy("term").agg(F.sum("df").alias("df"))
    return {r["term"]: r["df"] for r in sums.toLocalIterator()}


def ranked(docs: DataFrame, items: DataFrame, k: int = 20, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """(item, rank, doc, score): the k best documents of each item with a score above 0, from rank 1; equal scores by ascending key, null keys last.

    Null and empty texts have no terms: such documents count nowhere and are never found, such items find nothing. Repeated rows
    are documents, and items, of their own. Keys may be of any type that sorts. Texts of any length count whole. Empty tables on either
    side give an empty result. Other columns are ignored. 25 n N has to stay below 2^63.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t"))
    asked = items.select(F.col(item).alias("i"), F.coalesce(F.col(item_text), F.lit("")).alias("t"))
    size = asked.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    count = max(1, -(-size // SHARD_BYTES))
    out = None
    for s in range(count):
        own = [tuple(r) for r in asked.where(F.pmod(F.xxhash64("i", "t"), F.lit(count)) == s).toLocalIterator()]
        part = search_all(rows, [i for i, _ in own], Queries([t for _, t in own]), k, asked.schema["i"].dataType)
        out = part if out is None else out.union(part)
    return out


def search_all(rows: DataFrame, names: list, queries: Queries, k: int, item_kind: DataType) -> DataFrame:
    """ranked() for one shard of queries."""
    item_type = to_arrow_type(item_kind)
    index = stash(segments(rows, queries.terms), "segments")
    total = index.agg(F.sum("counted"), F.sum("words")).first()
    documents, words = int(total[0] or 0), int(total[1] or 0)
    df = document_counts(index)
    weight = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * df.get(t, 0) + 1))) for t in range(len(queries.terms))], np.int64)
    bags = queries.bags
    kind = rows.schema["k"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list[tuple]] = [[] for _ in bags]
        key_type = None
        for b in batches:
            key_type = b.column(0).type.value_type
            for place in range(b.num_rows):
                row = {c: b.column(c)[place].as_py() for c in NAMES[1:]}
                keys = b.column(0)[place].values
                terms, held, tf, n = np.cumsum(unpress(row["terms"], 8)), unpress(row["df"], 4), unpress(row["tf"], 8), unpress(row["n"], 8)
                doc = np.cumsum(unpress(row["docs"], 4))
                first = np.cumsum(held) - held
                doc -= np.repeat(np.concatenate(([0], doc))[first], held)
                m = 75 + 25 * n * documents // max(words, 1)
                term = np.repeat(terms, held)
                impact = weight[term] * (1_000_000_000 * tf // (1000 * tf + 12 * m[doc]))
                live = np.flatnonzero(impact)
                tree = Tree(term[live], doc[live], impact[live], len(n))
                for q, (asked, times) in enumerate(bags):
                    floor = best[q][-1][0] if len(best[q]) == k else 1
                    found = tree.search(asked, times, k, floor)
                    if found:
                        whole = best[q] + [(s, keys[d].as_py()) for s, d in found]
                        best[q] = sorted(whole, key=lambda x: (-x[0], x[1] is None, x[1] if x[1] is not None else 0))[:k]
        flat = [(q, names[q], x[1], x[0]) for q, own in enumerate(best) for x in own]
        if flat:
            q, i, d, s = zip(*flat, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(q, pa.int32()), pa.array(i, item_type), pa.array(d, key_type), pa.array(s, pa.int64())], ["q", "item", "doc", "score"])

    found = index.mapInArrow(run, f"q int, item {item_kind.simpleString()}, doc {kind}, score bigint").withColumn("salt", F.spark_partition_id() % SALTS)
    order = [F.desc("score"), F.asc_nulls_last("doc")]
    few = found.withColumn("rank", F.row_number().over(Window.partitionBy("q", "salt").orderBy(*order))).where(F.col("rank") <= k)
    whole = few.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(*order))).where(F.col("rank") <= k)
    return whole.select("item", "rank", "doc", "score")


SQL = r"""
WITH d AS MATERIALIZED (
    SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w
    FROM documents),
i AS MATERIALIZED (
    SELECT row_number() OVER () AS q, item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM benchmark),
total AS (SELECT count(*) AS n, CAST(sum(len(w)) AS BIGINT) AS l FROM d WHERE len(w) > 0),
size AS (SELECT r, doc_id, 75 + (25 * CAST(len(w) AS BIGINT) * n) // l AS m FROM d, total WHERE len(w) > 0),
tf AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(w) AS term FROM d) GROUP BY r, term),
weight AS (SELECT term, CAST(floor(1000 * ln((2 * n + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, total GROUP BY term, n),
score AS (
    SELECT q, item_id, r, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score
    FROM i JOIN tf USING (term) JOIN weight USING (term) JOIN size USING (r) GROUP BY q, item_id, r, doc_id),
placed AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id) AS rank FROM score WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM placed WHERE rank <= 20
"""


def op13_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty best documents of every benchmark item."""
    found = ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(F.col("item").alias("item_id"), F.col("rank").cast("int").alias("rank"), F.col("doc").alias("doc_id"), "score")
