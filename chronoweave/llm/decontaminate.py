"""Benchmark decontamination: BM25 over an inverted index of test items, searched by block-max WAND.

Items are the documents of the index, training passages its queries: every passage of every text asks for
all items above a threshold. An item's impacts are BM25 weights divided by their sum over the item, so the
score of a passage is the weighted share of the item that it holds, and one threshold suits all items.
A passage is a stretch of twice the longest item, every item length: whatever a text holds of an item
lies within one passage. The commonest terms together hold at most half the threshold of any item,
so a passage needs the rest from rarer ones. Blocks are aligned in item order: for every passage and block, the block
maxima of the passage's rare terms bound what any item of the block can score, for many passages at once. Only
blocks whose bound reaches the threshold are searched, by WAND: the pivot is the first item that the lists'
bounds allow, cursors skip to it, and only then an item is scored.

Retrieved pairs are verified word by word: an item counts as leaked if SHARE of its five-word shingles stand in
the passage (fewer words: one shingle of them all), or that share of its question's and of its answer's. An item's answer is its last
sentence, its question what comes before; an item of one sentence is all question.

The index goes to every executor, so its size is bounded: items come in shards of at most SHARD_BYTES of text,
one pass over the texts for each (one for usual benchmarks); no item is left out.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import FOLD, encode, mix, returning, ship, slices, span_hashes, table
from .toxicity import IN_WORD

K1, B = 1.2, 0.75
THRESHOLD, SHARE, SHINGLE = 0.5, 0.8, 5
#: Items of a block, aligned in item order for all lists.
ALIGNED = 4
SHARD_BYTES = 32 << 20
SENTENCE_END = re.compile(r"[.!?]['\")\]]*\s+(?=\S)")


def words_of(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words (letters, digits, non-ASCII; ASCII case folded), and where each text's begin, one more at the end."""
    data, offsets = encode(texts)
    edge = np.flatnonzero(np.diff(np.concatenate(([False], IN_WORD[data], [False])).view(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    hashes = span_hashes(FOLD[data], starts, ends) if len(starts) else np.zeros(0, np.uint64)
    return hashes, np.searchsorted(starts, offsets)


def shingles(words: np.ndarray, width: int) -> np.ndarray:
    """Distinct hashes of the stretches of width words."""
    out = np.zeros(max(len(words) - width + 1, 0), np.uint64)
    for j in range(width):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + words[j : j + len(out)] + np.uint64(j + 1))
    return np.unique(out)


def question_and_answer(text: str) -> tuple[str, str]:
    cuts = [m.end() for m in SENTENCE_END.finditer(text.strip())]
    return (text.strip()[: cuts[-1]], text.strip()[cuts[-1] :]) if cuts else (text.strip(), "")


class Index:
    """Inverted index of items: (id, text) pairs; items without words are never found."""

    def __init__(self, items: list[tuple], threshold: float = THRESHOLD) -> None:
        items = [(i, t) for i, t in items if len(words_of([t])[0])]
        self.ids = [i for i, _ in items]
        hashes, begin = words_of([t for _, t in items])
        self.longest = int(np.diff(begin).max()) if items else 1
        self.whole, self.question, self.answer = [], [], []
        for n, (_, text) in enumerate(items):
            for kept, words in zip((self.whole, self.question, self.answer), (hashes[begin[n] : begin[n + 1]], *(words_of([part])[0] for part in question_and_answer(text))), strict=True):
                width = min(SHINGLE, len(words))  # a part of fewer words is one shingle of them all
                kept.append((width, shingles(words, width) if width else words))
        item = np.repeat(np.arange(len(items)), np.diff(begin))
        self.terms, of = np.unique(hashes, return_inverse=True)
        pairs, tf = np.unique(of.astype(np.int64) * max(len(items), 1) + item, return_counts=True)
        term, self.item = (pairs // max(len(items), 1)).astype(np.int64), (pairs % max(len(items), 1)).astype(np.int64)
        length = np.diff(begin)
        df = np.bincount(term, minlength=len(self.terms))
        idf = np.log(1 + (len(items) - df + 0.5) / (df + 0.5))
        weight = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[self.item] / max(length.mean(), 1) if len(items) else 1))
        own = np.bincount(self.item, weight, len(items))
        self.impact = weight / own[self.item] if len(items) else weight
        self.start = np.concatenate(([0], np.cumsum(df))).astype(np.int64)
        # the commonest terms that together hold at most half the threshold of any item: a match needs others too
        self.rare = np.ones(len(self.terms), bool)
        common, shares = np.zeros(len(items)), np.zeros(len(items))
        for t in np.lexsort((np.arange(len(df)), -df)).tolist():
            own = slice(self.start[t], self.start[t + 1])
            common[self.item[own]] += self.impact[own]
            if common[self.item[own]].max() > threshold / 2:
                break
            self.rare[t] = False
            shares = common.copy()
        # item-aligned blocks: each rare list's largest impact in every block it touches, and the common terms' part
        blocks = -(-len(items) // ALIGNED)
        block, first = np.unique(term * max(blocks, 1) + self.item // ALIGNED, return_index=True)
        top = np.maximum.reduceat(self.impact, first) if len(first) else self.impact
        of_term = block // max(blocks, 1)
        self.block, self.block_max = block % max(blocks, 1), top
        self.block_start = np.searchsorted(of_term, np.arange(len(self.terms) + 1))
        self.block_slack = np.zeros(blocks)
        np.maximum.at(self.block_slack, np.arange(len(items)) // ALIGNED, shares)

    def lookup(self, hashes: np.ndarray) -> np.ndarray:
        """Term number of each word, -1 where the index hasn't it."""
        if not len(self.terms):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.terms, hashes), len(self.terms) - 1)
        return np.where(self.terms[at] == hashes, at, -1)

    def passages(self, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text, first and last word (exclusive) of the passages of texts whose words begin there."""
        sizes = np.diff(begin)
        step = self.longest
        count = np.where(sizes > 0, np.maximum(-(-(sizes - step) // step), 1), 0)
        text = np.repeat(np.arange(len(sizes)), count)
        nth = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
        first = begin[:-1][text] + nth * step
        return text, first, np.minimum(first + 2 * step, begin[1:][text])

    def promising(self, terms: np.ndarray, first: np.ndarray, last: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
        """(passage, block) pairs whose block bound reaches the threshold: block maxima of the passage's distinct rare terms
        and the common terms' part."""
        rare = np.flatnonzero((terms >= 0) & self.rare[terms])
        a, b = np.searchsorted(rare, first), np.searchsorted(rare, last)
        blocks, pairs = len(self.block_slack), [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        lists = self.block_start[1:] - self.block_start[:-1]
        load = np.concatenate(([0], np.cumsum(lists[terms[rare]])))
        for i, j in slices(len(first), load[b] - load[a] + blocks, 1 << 21):
            held = b[i:j] - a[i:j]
            of = np.repeat(np.arange(j - i), held)
            at = np.arange(len(of)) - np.repeat(np.cumsum(held) - held, held) + a[i:j][of]
            once = np.unique(of * len(self.terms) + terms[rare[at]])
            of, term = once // len(self.terms), once % len(self.terms)
            n = lists[term]
            entry = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.block_start[term], n)
            bound = np.bincount(np.repeat(of, n) * blocks + self.block[entry], self.block_max[entry], (j - i) * blocks).reshape(j - i, blocks) + self.block_slack
            passage, block = np.nonzero(bound + 1e-9 >= threshold)
            pairs.append((passage + i, block))
        return np.concatenate([p for p, _ in pairs]), np.concatenate([q for _, q in pairs])

    def search(self, terms: np.ndarray, low: int, high: int, threshold: float) -> list[tuple[int, float]]:
        """All (item, score) with low <= item < high and score >= threshold for distinct term numbers, by WAND in item order."""
        lists = []  # current item, term, cursor, end
        for t in terms.tolist():
            a, b = self.start[t], self.start[t + 1]
            c, e = (int(x) for x in a + np.searchsorted(self.item[a:b], (low, high)))
            if c < e:
                lists.append((int(self.item[c]), t, c, e, float(self.impact[c:e].max())))
        found, eps = [], 1e-9
        while lists:
            lists.sort()
            total, pivot = 0.0, -1
            for n, entry in enumerate(lists):
                total += entry[4]
                if total + eps >= threshold:
                    pivot = n
                    break
            if pivot < 0:
                return found
            item = lists[pivot][0]
            to = item
            if lists[0][0] == item:
                score, to = sum(float(self.impact[c]) for i, _, c, _, _ in lists if i == item), item + 1
                if score + eps >= threshold:
                    found.append((item, score))
            moved = []
            for entry in lists:
                i, t, c, e, most = entry
                if i < to:
                    c += int(np.searchsorted(self.item[c:e], to))
                    if c == e:
                        continue
                    entry = (int(self.item[c]), t, c, e, most)
                moved.append(entry)
            lists = moved
        return found

    def leaks(self, hashes: np.ndarray, begin: np.ndarray, threshold: float, share: float) -> list[tuple]:
        """(text, item id, first word of the passage, score, overlap, question, answer) of all leaked items of texts, the best passage of each."""
        if not len(self.terms) or not len(hashes):
            return []
        terms = self.lookup(hashes)
        text, first, last = self.passages(begin)
        best: dict[tuple[int, int], tuple] = {}
        there: dict[int, np.ndarray] = {}
        current = -1
        for p, block in zip(*(x.tolist() for x in self.promising(terms, first, last, threshold)), strict=True):
            if p != current:
                own = terms[first[p] : last[p]]
                query, there, current = np.unique(own[own >= 0]), {}, p
            for item, score in self.search(query, block * ALIGNED, (block + 1) * ALIGNED, threshold):
                held: list[float | None] = []
                for width, part in (self.whole[item], self.question[item], self.answer[item]):
                    if width and width not in there:
                        there[width] = shingles(hashes[first[p] : last[p]], width)
                    held.append(float(np.isin(part, there[width], assume_unique=True).mean()) if width else None)
                if held[0] >= share or held[1] is not None and held[1] >= share and (held[2] is None or held[2] >= share):
                    key = (int(text[p]), item)
                    row = (key[0], self.ids[item], int(first[p] - begin[key[0]]), float(score), *held)
                    if key not in best or row[4] > best[key][4]:
                        best[key] = row
        return [best[k] for k in sorted(best)]


def indexes(items: DataFrame, item: str, text: str, threshold: float) -> Iterator[Index]:
    """Indexes of all items, in shards of at most about SHARD_BYTES of text. Items without text are left out."""
    rows = items.select(F.col(item).cast("long").alias("i"), F.col(text).alias("t")).where("t is not null")
    size = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    count = max(1, -(-size // SHARD_BYTES))
    for s in range(count):
        yield Index(sorted(tuple(r) for r in rows.where(F.pmod(F.xxhash64("i", "t"), F.lit(count)) == s).toLocalIterator()), threshold)


LEAK = "doc bigint, item bigint, first_word bigint, score double, overlap double, question double, answer double"


def leaks(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", threshold: float = THRESHOLD, share: float = SHARE) -> DataFrame:
    """(doc, item, first_word, score, overlap, question, answer): the items that each text leaks.

    Null and empty texts leak nothing; items without words are never leaked; repeated rows and
    items count each; null keys are kept; empty tables on either side give an empty result. Other columns are
    ignored.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t"))
    out = None
    for index in indexes(items, item, item_text, threshold):
        part = rows.mapInArrow(returning(search_with(index, threshold, share)), LEAK)
        out = part if out is None else out.union(part)
    return out


def search_with(index: Index, threshold: float, share: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The search of one index, for mapInArrow."""
    names = ["doc", "item", "first_word", "score", "overlap", "question", "answer"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), *[pa.float64()] * 4]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            found = []
            for i, j in slices(len(texts), np.array([len(t or "") + 16 for t in texts], np.int64), 2 << 20):
                hashes, begin = words_of(texts[i:j])
                found += [(keys[i + n], *x) for n, *x in index.leaks(hashes, begin, threshold, share)]
            columns = list(zip(*found, strict=True)) or [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names)

    return run


def clean(docs: DataFrame, items: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", threshold: float = THRESHOLD, share: float = SHARE) -> DataFrame:
    """The rows of docs whose text leaks no item, with all their columns; cases as for leaks()."""
    ship(docs.sparkSession)
    at, names = docs.columns.index(text), docs.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)

    def without(index: Index) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        find = search_with(index, threshold, share)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                numbered = pa.RecordBatch.from_arrays([pa.array(range(b.num_rows), pa.int64()), b.column(at)], ["k", "t"])
                gone = {n for r in find(iter([numbered])) for n in r.column(0).to_pylist()}
                yield pa.RecordBatch.from_arrays(b.columns, names).filter(pa.array([n not in gone for n in range(b.num_rows)], pa.bool_()))

        return run

    for index in indexes(items, item, item_text, threshold):
        docs = docs.mapInArrow(returning(without(index)), schema)
    return docs


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair of a document and a benchmark item that it leaks."""
    found = leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.withColumnsRenamed({"doc": "doc_id", "item": "item_id"})
