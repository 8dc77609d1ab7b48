"""Document fingerprints by consistent weighted sampling, in DataFrame functions only.

A text's terms are its words (lower case), weighted by how often they occur. Sample k of
a weighted term: with r and c from Gamma(2, 1) and b uniform, all drawn from the hash of the term
and k, let t = floor(ln w / r + b) and ln a = ln c - r (t + 1 - b); the term with the least a,
together with its t, is the sample. Two texts agree in sample k with probability equal to
their generalised Jaccard similarity, so the share of equal samples estimates it.

A sample is one long: ln a as fixed point above, 32 bits of the hash of (term, t) below; the
minimum of longs is map-side combinable and stays in generated code.

Neighbours in id order come without a global sort in one task: ids are dealt to ranges bounded
by quantiles, a window looks ahead within its range, and one row per range, its first text, is
joined to the range before. Words are counted where the range already is: no second exchange.
"""

from __future__ import annotations

from bisect import bisect_left

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stash, table

SAMPLES = 32
TERM = r"[\x20\x09-\x0D]+"


def sample(term: Column, log_weight: Column, k: int) -> Column:
    """Sample k of a term (64-bit hash) with a positive weight of this logarithm, as one long whose order is that of a."""
    x, y = F.xxhash64(term, F.lit(2 * k)), F.xxhash64(term, F.lit(2 * k + 1))
    low = F.lit((1 << 32) - 1)
    unit = lambda v: (v.cast("double") + 0.5) * F.lit(2.0**-32)
    r = -F.ln(unit(F.shiftrightunsigned(x, 32)) * unit(x.bitwiseAND(low)))
    y2 = F.xxhash64(y, F.lit(k))
    ln_c = F.ln(-F.ln(unit(F.shiftrightunsigned(y, 32)) * unit(y.bitwiseAND(low))))
    b = unit(F.shiftrightunsigned(y2, 32))
    t = F.floor(log_weight / r + b)
    ln_a = ln_c - r * (t + 1 - b)
    fixed = F.floor((ln_a + 900.0) * F.lit(2.0**20)).cast("long")
    return F.shiftleft(F.greatest(fixed, F.lit(0)), 32).bitwiseOR(F.xxhash64(term, t, F.lit(k)).bitwiseAND(low))


def ranged(docs: DataFrame, key: str, text: str, per_range: int = 700, range_bytes: int = 2 << 20, most: int = 10_000) -> tuple[DataFrame, int, int]:
    """docs with range, and its first and last number: dense numbers that rise with key; null keys are in range -1.

    A range has about per_range rows and range_bytes of text, whichever is less, so that tasks of a few ranges are even and
    their words fit in memory. Bounds are quantiles, at most ``most`` of them on the driver; a row finds its range among the
    few bounds in its own one of equal-width cells. Beyond most ranges' worth of rows, ranges grow and
    their sorts spill.
    """
    n, known, least, top, size = docs.agg(F.count("*"), F.count(key), F.min(key), F.max(key), F.sum(F.octet_length(text))).first()
    first = -1 if known < n else 0
    parts = int(min(most, max(-(-known // per_range), -(-(size or 0) // range_bytes))))
    cuts: list[int] = []
    if parts > 1:
        probabilities = [i / parts for i in range(1, parts)]
        cuts = sorted({int(c) for c in docs.where(F.col(key).isNotNull()).approxQuantile(key, probabilities, 0.2 / parts)} - {least})
    if not cuts:
        return docs.withColumn("range", F.when(F.col(key).isNull(), -1).otherwise(0)), first, 0 if known else -1
    width = (top - least) // parts + 1
    starts = [bisect_left(cuts, least + c * width) for c in range(parts + 1)] + [len(cuts)]
    cell = F.floor((F.col(key) - least) / width).cast("int")
    bound, start = F.array(*[F.lit(c) for c in cuts]).cast("array<bigint>"), F.array(*[F.lit(c) for c in starts])
    begin = F.get(start, cell)
    here = F.slice(bound, begin + 1, F.get(start, cell + 1) - begin)
    return docs.withColumn("range", F.when(F.col(key).isNull(), -1).otherwise(begin + F.size(F.filter(here, lambda c: c <= F.col(key))))), first, len(cuts)


def following(firsts: DataFrame, value: str, first: int, last: int) -> DataFrame:
    """(range, value of its first row) -> (range, after): the value of the next range's first row, the first's for the last."""
    turned = F.when(F.col("range") == first, last).otherwise(F.col("range") - 1)
    return firsts.select(turned.alias("range"), F.col(value).alias("after"))


def fingerprint_pairs(docs: DataFrame, key: str = "doc_id", text: str = "text", samples: int = SAMPLES) -> DataFrame:
    """One row per row of docs: k (the key), n_chars, edited_sha256, sig, edited_sig, next_sig (arrays of longs).

    The edited text is the text with its last half (rounded down) replaced by the first as many code
    points of the next row's text, or all of them, in order of key, then text; null keys come first; the
    last row is followed by the first. Null text counts as empty. A text without words has the
    signature of no terms, -1 throughout, which agrees with itself alone. Repeated rows each count; keys are cast
    to long; an empty table gives an empty result. Other columns are ignored.
    """
    rows, first, last = ranged(docs.select(F.col(key).cast("long").alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t")), "k", "t")
    order = Window.partitionBy("range").orderBy(F.col("k").asc_nulls_first(), "t")
    least = rows.groupBy("range").agg(F.min("k").alias("m"))
    heads = rows.join(least.withColumnRenamed("range", "r"), (F.col("range") == F.col("r")) & F.col("k").eqNullSafe(F.col("m")))
    heads = stash(following(heads.groupBy("range").agg(F.min("t").alias("head")), "head", first, last), "heads")
    placed = rows.withColumn("place", F.row_number().over(order)).withColumn("next", F.lead("t").over(order))
    placed = placed.join(heads, "range").withColumn("next", F.coalesce("next", "after"))
    half = F.floor(F.length("t") / 2).cast("int")
    edited = F.concat(F.substring("t", F.lit(1), F.length("t") - half), F.substring("next", F.lit(1), half))
    placed = placed.select("range", "place", "k", "t", edited.alias("e"))

    sides = placed.select("range", "place", F.posexplode(F.array("t", "e")).alias("side", "x"))
    words = sides.select("range", "place", "side", F.explode(F.split(F.lower("x"), TERM)).alias("w")).where("w <> ''")
    counts = words.groupBy("range", "place", F.xxhash64("w").alias("h")).agg(F.count_if(F.col("side") == 0).alias("a"), F.count_if(F.col("side") == 1).alias("b"))
    counts = counts.select("range", "place", "h", *[F.when(F.col(c) > 0, F.ln(c)).alias(c) for c in "ab"])
    mins = [F.min(F.when(F.col(c).isNotNull(), sample(F.col("h"), F.col(c), k))).alias(f"{c}{k}") for c in "ab" for k in range(samples)]
    signed = counts.groupBy("range", "place").agg(*mins)
    signature = {c: F.array(*[F.coalesce(f"{c}{k}", F.lit(-1).cast("long")) for k in range(samples)]) for c in "ab"}
    none = F.array_repeat(F.lit(-1).cast("long"), samples)

    facts = placed.select("range", "place", "k", F.length("t").cast("long").alias("n_chars"), F.sha2("e", 256).alias("edited_sha256"))
    both = facts.join(signed.select("range", "place", signature["a"].alias("sig"), signature["b"].alias("edited_sig")), ["range", "place"], "left")
    both = stash(both.withColumns({c: F.coalesce(c, none) for c in ("sig", "edited_sig")}), "signatures")
    after = following(both.where("place = 1"), "sig", first, last)
    ahead = Window.partitionBy("range").orderBy("place")
    return both.withColumn("next_sig", F.lead("sig").over(ahead)).join(after, "range").withColumn("next_sig", F.coalesce("next_sig", "after")).drop("after", "range", "place")


def likeness(left: str, right: str, samples: int = SAMPLES) -> Column:
    """Share of equal samples: an estimate of the generalised Jaccard similarity of the word counts."""
    return F.aggregate(F.zip_with(left, right, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x) / F.lit(float(samples))


def printed(sig: str) -> Column:
    """A signature as text: 8 hex digits of (term, t) for each sample."""
    return F.array_join(F.transform(sig, lambda v: F.lpad(F.lower(F.hex(v.bitwiseAND(F.lit((1 << 32) - 1)))), 8, "0")), "")


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and its edited text, and how alike they and the next document's are."""
    found = fingerprint_pairs(table(spark, sf_dir, "documents"))
    return found.select(F.col("k").alias("doc_id"), "n_chars", "edited_sha256", printed("sig").alias("fingerprint"), printed("edited_sig").alias("edited_fingerprint"), likeness("sig", "edited_sig").alias("near_edited"), likeness("sig", "next_sig").alias("near_next"))
