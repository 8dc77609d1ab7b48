"""Personal data: patterns for what has a form, information theory for what gives it away.

Base spans are e-mail addresses, IP addresses, card numbers (Luhn) and phone numbers. Two kinds of spans come from the corpus:

* Identifiers (kind id): terms with digits whose information content is close to the largest there is, -log p >= SINGLE log N for N
  different texts. Such a term singles its document out: account numbers, keys, tokens. p counts the term's
  different surroundings, so that copies and near copies of a text don't make a term common.
* Disclosing terms (kind term). Protected entities are each base value, each base kind, and identifiers as a kind. A term
  discloses an entity if knowing the term tells most of what the entity would: of N different texts, with n(e) that hold the
  entity, n(t) with the term, and n(t, e) with the term and the entity (for values: the term within NEAR words of it),

      PMI(t, e) / IC(e) = log(N n(t, e) / (n(t) n(e))) / log(N / n(e)) >= ALPHA

  provided the term has SUPPORT or more different surroundings beside the entity. Exact copies of a text count once in all four
  numbers. A disclosing term is marked wherever it stands, in all texts. ``redact`` generalises values to their kind and terms to their length.

Counts cover all texts. Pairs are counted by grouped aggregation, their terms' texts by a pass that lets through
the terms of a filter of fixed size (a Bloom filter, whatever the number of terms) and joins these exactly.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, mix, ship, slices, stash, table
from .decontaminate import words_of

KINDS = ("email", "ip", "card", "phone")
ALPHA, SUPPORT, NEAR = 0.9, 3, 8
#: Share of the largest information content from which a term with digits, of LONG characters or more, is an identifier.
SINGLE, LONG = 0.8, 8
#: Words on either side that make the surroundings of an identifier.
AROUND = 3
#: Bits of the filter that lets wanted terms through.
FILTER = 1 << 25

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
ANY = re.compile(r"[0-9@]")
DIGIT = re.compile(r"[0-9]")
TERM = re.compile("[A-Za-z0-9\u0080-\U0010ffff]+")
CANDIDATE = re.compile("(?<![A-Za-z0-9\u0080-\U0010ffff])(?=[A-Za-z\u0080-\U0010ffff]*+[0-9])[A-Za-z0-9\u0080-\U0010ffff]{%d,}+" % LONG)


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping addresses, in time linear in the text: the local part is the run before each @."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            out.append((start, domain.end()))
            free = domain.end()
        else:
            free = max(free, at + 1)  # runs don't cross an @
        at = text.find("@", free)
    return out


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, stop) of the base kinds, by kind as listed, then start."""
    if not ANY.search(text):
        return []
    out = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    if not DIGIT.search(text):
        return out
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(DIGIT.findall(m[0])) <= 15]
    return out


def value_of(text: str, kind: str, start: int, stop: int) -> str:
    """An entity's value, without what spellings differ in."""
    value = text[start:stop]
    return f"{kind}:{value.lower()}" if kind in ("email", "ip") else f"{kind}:{''.join(DIGIT.findall(value))}"


def contexts(text: str, spans: list[tuple[str, int, int]], terms: list[tuple[int, int]]) -> list[tuple[str, list[int]]]:
    """(value, numbers of terms) for each base span: up to NEAR terms on either side, outside all spans."""
    covered = [False] * len(terms)
    starts, stops = [a for a, _ in terms], [b for _, b in terms]
    for _, a, b in spans:
        for n in range(bisect_left(stops, a + 1), bisect_left(starts, b)):
            covered[n] = True
    out = []
    for kind, start, stop in spans:
        low, high = bisect_left(stops, start + 1), bisect_left(starts, stop)
        near = [n for n in (*range(max(low - NEAR, 0), low), *range(high, min(high + NEAR, len(terms)))) if not covered[n]]
        out.append((value_of(text, kind, start, stop), near))
    return out


def hashes(strings: list[str]) -> np.ndarray:
    """64-bit hash of each string by its words; of a single word, the same as in any text."""
    words, begin = words_of(strings)
    out = np.zeros(len(strings), np.uint64)
    for n, (a, b) in enumerate(zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True)):
        for w in words[a:b].tolist():
            out[n] = np.uint64((int(out[n]) * 0x9E3779B97F4A7C15 + w) & 0xFFFFFFFFFFFFFFFF)
    return out.view(np.int64)


def surroundings(words: np.ndarray, width: int) -> np.ndarray:
    """Hash of the words on either side of each word."""
    out = np.zeros(len(words), np.uint64)
    padded = np.concatenate((np.zeros(width, np.uint64), words, np.zeros(width, np.uint64)))
    for j in (*range(width), *range(width + 1, 2 * width + 1)):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + padded[j : j + len(words)] + np.uint64(j + 1))
    return out


def identifiers(text: str, spans: list[tuple[str, int, int]]) -> list[tuple[int, int]]:
    """Places of terms that may be identifiers, outside base spans."""
    if not DIGIT.search(text):
        return []
    found = [m.span() for m in CANDIDATE.finditer(text)]
    if not found or not spans:
        return found
    edges = sorted((a, b) for _, a, b in spans)
    starts, furthest, top = [a for a, _ in edges], [], 0
    for _, b in edges:
        top = max(top, b)
        furthest.append(top)
    return [(a, b) for a, b in found if not (n := bisect_left(starts, b)) or furthest[n - 1] <= a]


FOUND = "k {key}, h bigint, spans array<struct<kind:string,start:int,stop:int>>, near array<struct<e:bigint,t:bigint,c:bigint>>, ids array<struct<t:bigint,c:bigint,start:int,stop:int>>"


def find(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(k, h, spans, near, ids) of each row: base spans, the terms near them, and terms that may be identifiers; h identifies the text."""
    rows = docs.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t")).select("k", F.xxhash64("t").alias("h"), "t")
    kind = rows.schema["k"].dataType.simpleString()
    place = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("stop", pa.int32())])
    item = pa.struct([("e", pa.int64()), ("t", pa.int64()), ("c", pa.int64())])
    single = pa.struct([("t", pa.int64()), ("c", pa.int64()), ("start", pa.int32()), ("stop", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spans, near, ids = [], [], []
            for text_ in b.column(2).to_pylist():
                own = base_spans(text_)
                spans.append([{"kind": k, "start": a, "stop": z} for k, a, z in own])
                found = identifiers(text_, own)
                items: list[dict] = []
                singles: list[dict] = []
                if own or found:
                    terms = [m.span() for m in TERM.finditer(text_)]
                    words = words_of([text_])[0]
                    for value, places in contexts(text_, own, terms):
                        if places:
                            e, c = hashes([value.replace("@", " at ")])[0], np.bitwise_xor.reduce(mix(words[places] + np.arange(len(places), dtype=np.uint64)))
                            items += [{"e": int(e), "t": int(t), "c": int(c.view(np.int64))} for t in words[places].view(np.int64)]
                    if found:
                        around, starts = surroundings(words, AROUND).view(np.int64), [a for a, _ in terms]
                        for a, z in found:
                            n = bisect_left(starts, a)
                            singles.append({"t": int(words[n].view(np.int64)), "c": int(around[n]), "start": a, "stop": z})
                near.append(items)
                ids.append(singles)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(spans, pa.list_(place)), pa.array(near, pa.list_(item)), pa.array(ids, pa.list_(single))], ["k", "h", "spans", "near", "ids"])

    return rows.mapInArrow(run, FOUND.format(key=kind))


def terms_beside(docs: DataFrame, text: str) -> DataFrame:
    """(h, t, c): the different terms of each text that has a base span or a term that may be an identifier, and the surroundings of their first places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for h, text_ in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if ANY.search(text_) and (base_spans(text_) or CANDIDATE.search(text_)):
                    words = words_of([text_])[0]
                    terms, first = np.unique(words, return_index=True)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(terms), h, np.int64)), pa.array(terms.view(np.int64)), pa.array(surroundings(words, 1)[first].view(np.int64))], ["h", "t", "c"])

    whole = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.xxhash64(whole).alias("h"), whole.alias("t")).mapInArrow(run, "h bigint, t bigint, c bigint").dropDuplicates(["h", "t"])


def letting_through(wanted: DataFrame) -> np.ndarray:
    """A filter of FILTER bits in 64-bit words that all terms t of wanted pass, and of other terms the fewer the fewer are wanted."""
    bits = [F.col("t").bitwiseAND(F.lit(FILTER - 1)), F.shiftrightunsigned("t", 30).bitwiseAND(F.lit(FILTER - 1))]
    places = wanted.select(F.explode(F.array(*bits)).alias("p"))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("p", F.lit(64)).cast("int"))
    words = places.groupBy(F.shiftright("p", 6).alias("w")).agg(F.bit_or(one).alias("b")).toArrow()
    out = np.zeros(FILTER // 64, np.uint64)
    out[words.column("w").to_numpy()] = words.column("b").to_numpy().view(np.uint64)
    return out


def passes(words: np.ndarray, through: np.ndarray) -> np.ndarray:
    out = np.ones(len(words), bool)
    for p in (words & np.uint64(FILTER - 1), (words >> np.uint64(30)) & np.uint64(FILTER - 1)):
        out &= (through[p >> np.uint64(6)] >> (p & np.uint64(63))) & np.uint64(1) == 1
    return out


def term_frequency(docs: DataFrame, text: str, wanted: DataFrame, copied: DataFrame) -> DataFrame:
    """(t) of wanted terms -> (t, n): in how many different texts they stand, these and the few others that the filter lets through.

    copied has the hashes (t) of texts that stand in several rows: only their terms are told apart by text, all others are counted where they are.
    """
    through, several = letting_through(wanted), letting_through(copied)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, ids = b.column(0).to_pylist(), b.column(1).to_numpy()
            for i, j in slices(len(texts), np.array([len(t or "") + 16 for t in texts], np.int64), 2 << 20):
                words, begin = words_of(texts[i:j])
                hit = np.flatnonzero(passes(words, through))
                of = np.searchsorted(begin, hit, "right") - 1
                terms, at = np.unique(words[hit], return_inverse=True)
                once = np.unique(of * max(len(terms), 1) + at)
                of, at = once // max(len(terms), 1), once % max(len(terms), 1)
                own = passes(ids[i:j].view(np.uint64), several)[of]
                counts = np.bincount(at[~own], minlength=len(terms))
                seen = np.flatnonzero(counts)
                t = np.concatenate((terms[seen], terms[at[own]])).view(np.int64)
                h = pa.array(np.concatenate((np.zeros(len(seen), np.int64), ids[i:j][of[own]])), mask=np.arange(len(t)) < len(seen))
                yield pa.RecordBatch.from_arrays([pa.array(t), h, pa.array(np.concatenate((counts[seen], np.ones(int(own.sum()), np.int64))))], ["t", "h", "n"])

    found = docs.select(text, F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("h")).mapInArrow(run, "t bigint, h bigint, n bigint")
    each = found.groupBy("t", "h").agg(F.sum("n").alias("n")).select("t", F.when(F.col("h").isNull(), F.col("n")).otherwise(1).alias("n"))
    return each.groupBy("t").agg(F.sum("n").alias("n"))


def term_places(docs: DataFrame, key: str, text: str, telling: DataFrame) -> DataFrame:
    """(k, h, kind, start, stop) of every place of a telling term (t), outside base spans."""
    through = letting_through(telling)
    rows = docs.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t")).select("k", F.xxhash64("t").alias("h"), "t")
    schema = f"k {rows.schema['k'].dataType.simpleString()}, h bigint, t bigint, start int, stop int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(2).to_pylist()
            for i, j in slices(len(texts), np.array([len(t) + 16 for t in texts], np.int64), 2 << 20):
                words, begin = words_of(texts[i:j])
                hit = passes(words, through)
                rows_, found = [], []
                for n in np.unique(np.searchsorted(begin, np.flatnonzero(hit), "right") - 1).tolist():
                    terms = [m.span() for m in TERM.finditer(texts[i + n])]
                    spans = base_spans(texts[i + n])
                    starts, stops, free = [a for a, _ in terms], [z for _, z in terms], hit[begin[n] : begin[n + 1]].copy()
                    for _, a, z in spans:
                        free[bisect_left(stops, a + 1) : bisect_left(starts, z)] = False
                    for m in np.flatnonzero(free).tolist():
                        rows_.append(i + n)
                        found.append((int(words[begin[n] + m].view(np.int64)), *terms[m]))
                columns = list(zip(*found, strict=True)) or [[], [], []]
                taken = pa.array(rows_, pa.int64())
                yield pa.RecordBatch.from_arrays([b.column(0).take(taken), b.column(1).take(taken), pa.array(list(columns[0]), pa.int64()), *[pa.array(list(c), pa.int32()) for c in columns[1:]]], ["k", "h", "t", "start", "stop"])

    return rows.mapInArrow(run, schema).join(telling, "t", "left_semi").select("k", "h", F.lit("term").alias("kind"), "start", "stop")


def sanitise(docs: DataFrame, key: str = "doc_id", text: str = "text", alpha: float = ALPHA, support: int = SUPPORT, single: float = SINGLE) -> DataFrame:
    """(k, h, spans) of each row: base, identifier and term spans as (kind, start, stop), by kind as listed, then id, then term, then start.

    Positions are code points, stops exclusive. Null text counts as empty. Repeated rows each have their
    row, with equal spans; keys may be of any type, null ones are kept; texts of any length are searched whole; an empty table gives an
    empty result. Other columns are ignored.
    """
    spark = docs.sparkSession
    ship(spark)
    found = stash(find(docs, key, text), "spans")
    n = max(found.select("h").distinct().count(), 1)

    # identifiers: terms with digits in next to no surroundings
    places = found.where(F.size("ids") > 0).select("k", "h", F.explode("ids").alias("x")).select("k", "h", "x.*")
    rare = places.groupBy("t").agg(F.count_distinct("c").alias("n")).where(F.col("n") <= float(n) ** (1 - single)).select("t")
    singles = stash(places.join(rare, "t", "left_semi"), "identifiers")

    # entities of each different text: kinds (negative numbers) for whole texts, values for the words near them
    kinds = found.where(F.size("spans") > 0).select("h", F.explode(F.array_distinct(F.transform("spans", lambda x: x["kind"]))).alias("kind"))
    number = F.coalesce(*[F.when(F.col("kind") == k, F.lit(-1 - i)) for i, k in enumerate(KINDS)]).cast("long")
    held = stash(kinds.select("h", number.alias("e")).union(singles.select("h", F.lit(-1 - len(KINDS)).cast("long").alias("e"))).distinct(), "entities")
    near = found.where(F.size("near") > 0).select("h", F.explode("near").alias("x")).select("h", "x.*")
    counted = [F.count_distinct("h").alias("together"), F.count_distinct("c").alias("contexts")]
    by_value = near.groupBy("e", "t").agg(*counted)
    by_kind = terms_beside(docs, text).join(held, "h").groupBy("e", "t").agg(F.count("*").alias("together"), F.count_distinct("c").alias("contexts"))
    pairs = stash(by_value.union(by_kind).where(F.col("contexts") >= support), "pairs")
    entities = near.groupBy("e").agg(F.count_distinct("h").alias("n_e")).union(held.groupBy("e").agg(F.count("*").alias("n_e")))
    copied = stash(found.groupBy(F.col("h").alias("t")).count().where("count > 1").select("t"), "copied")
    frequency = term_frequency(docs, text, stash(pairs.select("t").distinct(), "asked"), copied)
    known = pairs.join(entities, "e").join(frequency, "t")
    pmi = F.log(F.lit(float(n)) * F.col("together") / (F.col("n") * F.col("n_e")))
    ic = F.log(F.lit(float(n)) / F.col("n_e"))
    telling = stash(known.where((F.col("n_e") < n) & (pmi >= alpha * ic)).select("t").distinct(), "telling")

    own = singles.select("k", "h", F.lit("id").alias("kind"), "start", "stop")
    marked = own.union(term_places(docs, key, text, telling.join(singles.select("t"), "t", "left_anti")))
    added = marked.groupBy("k", "h").agg(F.array_sort(F.collect_set(F.struct("kind", "start", "stop"))).alias("added")).select(F.col("k").alias("k2"), F.col("h").alias("h2"), "added")
    joined = found.join(added, F.col("k").eqNullSafe(F.col("k2")) & (F.col("h") == F.col("h2")), "left")
    none = F.array().cast("array<struct<kind:string,start:int,stop:int>>")
    return joined.select("k", "h", F.concat("spans", F.coalesce("added", none)).alias("spans"))


def redacted(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with values replaced by their kind and terms by as many x; of overlapping spans the first, then longest, counts."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], "x" * (b - a) if kind == "term" else f"[{kind.upper()}]"]
            at = b
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, spans: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with the text redacted by the spans that sanitise() found; all columns are kept, whatever their names, null texts become empty."""
    ship(docs.sparkSession)
    k, h, s = fresh(docs, "k", "h", "s")
    whole = F.coalesce(F.col(text), F.lit(""))
    own = spans.groupBy(F.col("k").alias(k), F.col("h").alias(h)).agg(F.first("spans").alias(s))
    joined = docs.join(own, F.col(key).eqNullSafe(F.col(k)) & (F.xxhash64(whole) == F.col(h)), "left")
    replace = F.udf(lambda t, x: redacted(t or "", [tuple(y) for y in x or []]), "string", useArrow=True)
    return joined.withColumn(text, replace(text, s)).select(*docs.columns)


def listed(spans: str, kinds: tuple[str, ...]) -> Column:
    """kind:start:end of the spans of some kinds, comma-joined."""
    of = F.filter(spans, lambda s: s["kind"].isin(*kinds))
    return F.array_join(F.transform(of, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")


def op3_privacy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document, identifiers, and the terms that disclose them."""
    found = sanitise(table(spark, sf_dir, "documents"))
    return found.select(F.col("k").alias("doc_id"), *[_count(kind) for kind in KINDS], F.sha2(listed("spans", KINDS), 256).alias("base_sha256"), listed("spans", (*KINDS, "id", "term")).alias("spans"), _count("id"), _count("term"), F.size("spans").cast("long").alias("n_spans"))


def _count(kind: str) -> Column:
    return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
