"""Times for the words of given texts, taken from a recogniser's words: tokens, alignment, confidence, fallback times.

Every token gives exactly one row. Only the alignment itself runs in Python (``alignment.align``); the rest is joins and windows by sample.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.compat import compatible, tables
from ..functions.text import TOKEN, normalize_token, tokenize
from ..shipping import ship
from . import alignment
from .intervals import clip_interval, stored_interval

# The most that a kind of match is trusted (an exact one always fully), the name of its source, and the other words of status below.
TRUST = {"equivalent_compound": 0.85, "edit_distance": 0.65}
SOURCES = {"exact": "asr_exact", "equivalent_compound": "asr_equivalent", "edit_distance": "asr_edit"}


def tokens(samples: DataFrame, key: str, text: str) -> DataFrame:
    """(key, n, word, normalized, start_char, end_char) of the tokens of a text's compatibility form, from n = 0.

    Places are those of the given text: code points, ends exclusive. A token that begins or ends within a character that stands for several
    takes all of that character.
    """
    ship(samples.sparkSession)
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = samples.select(key, whole.alias("_t"), compatible(whole).alias("_c"))
    alike = F.length("_c") == F.length("_t")  # characters that stand for several make a text longer
    plain = rows.where(alike).select(key, F.regexp_extract_all("_c", F.lit(TOKEN), F.lit(0)).alias("_w"), F.split("_c", TOKEN, -1).alias("_gaps"))
    plain = plain.select(key, F.inline(F.transform("_w", lambda w, i: F.struct(i.alias("n"), w.alias("word"), F.length(F.get("_gaps", i)).alias("_gap")))))
    ahead = F.sum(F.col("_gap") + F.length("word")).over(Window.partitionBy(key).orderBy("n").rowsBetween(Window.unboundedPreceding, 0))
    plain = plain.withColumn("end_char", ahead.cast("int")).select(key, "n", "word", (F.col("end_char") - F.length("word")).alias("start_char"), "end_char")
    kind = samples.schema[key].dataType.simpleString()
    odd = rows.where(~alike).mapInArrow(placed, f"`{key}` {kind}, n int, word string, start_char int, end_char int")
    return plain.unionByName(odd).select(key, "n", "word", normalize_token(F.col("word")).alias("normalized"), "start_char", "end_char")


def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tokens of texts (key, text, compatibility form) in which some characters stand for several."""
    _, many = tables()
    for b in batches:
        out: list[tuple] = []
        for k, raw, form in zip(*(b.column(c).to_pylist() for c in range(3)), strict=True):
            ends = np.cumsum([len(many.get(c, "-")) for c in raw])
            for n, m in enumerate(re.finditer(TOKEN, form)):
                first, last = (int(x) for x in np.searchsorted(ends, (m.start(), m.end() - 1), "right"))
                out.append((k, n, m[0], first, last + 1))
        columns = list(zip(*out, strict=True)) or [[]] * 5
        kinds = [b.column(0).type, pa.int32(), pa.string(), pa.int32(), pa.int32()]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)], [b.schema.names[0], "n", "word", "start_char", "end_char"])


def recognised(words: DataFrame, samples: DataFrame, key: str, duration: str) -> DataFrame:
    """(key, s, index, word, start, stop, confidence): words (key, index, word, start, stop, confidence) that have a time and a name, numbered from s = 0.

    Times are clamped to the sample's duration, infinite ones too. A word with a time that is NaN is matched like others, but gives no time. No confidence, or 0,
    counts as 1.
    """
    rows = words.where("start is not null and stop is not null").join(samples.select(key, F.col(duration).alias("_d")), key)
    a, b = clip_interval(F.col("start"), F.col("stop"), F.col("_d"))
    trust = F.when(F.coalesce("confidence", F.lit(0.0)) == 0, 1.0).otherwise(F.least(F.greatest("confidence", F.lit(0.0)), F.lit(1.0)))
    rows = rows.select(key, "index", F.trim("word").alias("word"), a.alias("start"), b.alias("stop"), trust.alias("confidence"))
    rows = rows.where((F.isnan("start") | F.isnan("stop") | (F.col("stop") > F.col("start"))) & (normalize_token(F.col("word")) != ""))
    return rows.withColumn("s", F.row_number().over(Window.partitionBy(key).orderBy("index")) - 1)


def matches(samples: DataFrame, source: DataFrame, key: str, text: str, ratio: float) -> DataFrame:
    """(key, n, kind, start, stop, confidence, indices) of tokens that match words of recognised()."""
    lists = source.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("s", "word"))), lambda x: x["word"]).alias("_source"))  # a clip's words
    both = samples.select(key, tokenize(F.coalesce(F.col(text), F.lit(""))).alias("_target")).join(lists, key)
    found = alignment.align(both, key, "_target", "_source", ratio)
    used = found.withColumn("s", F.explode(F.sequence("source_from", F.col("source_to") - 1))).join(source, [key, "s"])
    # of two words for one, a first one whose time is NaN spoils it, a second one is passed over
    times = [F.when(F.isnan(F.min_by(c, "s")), F.lit(float("nan"))).otherwise(f(F.when(~F.isnan(c), F.col(c)))).alias(c) for f, c in ((F.min, "start"), (F.max, "stop"))]
    timed = used.groupBy(key, "target_from", "target_to", "kind").agg(*times, F.min("confidence").alias("confidence"), F.array_sort(F.collect_list("index")).alias("indices"))
    return timed.select(key, F.explode(F.sequence("target_from", F.col("target_to") - 1)).alias("n"), "kind", "start", "stop", "confidence", "indices")


def align_text_words(samples: DataFrame, words: DataFrame, key: str = "id", text: str = "text", duration: str = "duration", *, ratio: float = 0.34, trust: float = 0.20, least: float = 0.01) -> DataFrame:
    """One row a token of samples (key, text, duration): the token's place, time, confidence, match type and where its time comes from.

    Matched tokens take the time of their words, as stored in single precision. Tokens without a match, or with an empty time, share the time
    between the valid matches around them, by their place among the sample's open tokens; shares under least seconds are invalid.
    Null and empty texts give no rows; a sample without words gets fallback times alone.
    """
    source = recognised(words, samples, key, duration)
    target = tokens(samples, key, text).join(samples.select(key, F.col(duration).cast("double").alias("_d")), key)
    rows = target.join(matches(samples, source, key, text, ratio).withColumnsRenamed({"start": "_s", "stop": "_e"}), [key, "n"], "left")
    rows = rows.withColumn("_t", stored_interval(F.col("_s"), F.col("_e"), F.col("_d")))
    rows = rows.withColumns({"_ok": F.col("_t").isNotNull(), "_s": F.col("_t.start"), "_e": F.col("_t.stop")})
    shared = alignment.fallback(rows, key, ["n"], "_s", "_e", "_ok", F.col("_d"), 0.0)
    a, b = clip_interval(F.col("start"), F.col("stop"), F.col("_d"))
    shared = shared.withColumn("_t", F.when(F.col("start").isNotNull(), stored_interval(a, b, F.col("_d"), least))).drop("start", "stop")
    whole = rows.where("_ok").unionByName(shared)

    def name(kinds: dict, other: Column) -> Column:
        out = other
        for k, v in kinds.items():
            out = F.when(F.col("kind") == k, v).otherwise(out)
        return out

    fell, valid = ~F.col("_ok"), F.col("_t").isNotNull()
    confidence = F.when(fell, trust).when(F.col("kind") == "exact", 1.0).otherwise(F.least("confidence", name(TRUST, F.lit(1.0))))
    return whole.select(
        key, "n", "word", "normalized", "start_char", "end_char", F.col("_t.start").alias("start"), F.col("_t.stop").alias("stop"), confidence.alias("confidence"),
        F.when(fell, F.when(valid, "boundary_or_uniform_fallback").otherwise("invalid_fallback")).otherwise(F.col("kind")).alias("match_type"), fell.alias("fallback"),
        F.coalesce("indices", F.array().cast("array<long>")).alias("source_indices"), valid.alias("time_valid"),
        F.when(~valid, "invalid").when(fell, "fallback_boundary_or_uniform").otherwise(name(SOURCES, F.lit(None))).alias("timestamp_source"),
        F.when(valid, "").otherwise("fallback_interval_below_0.01s_or_float32_collapse").alias("invalid_reason"),
    )
