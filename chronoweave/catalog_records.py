"""More registered queries: interval rules, candidate selection, step features and record checks, each with its SQL.

Importing this module adds them to ``catalog.queries()``. The fixtures stand in as in ``catalog``; in conversations, a user's turn is a
first candidate transcript and the assistant's a second one, with the match type of a word by its length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog import BINS, CHANNELS, DENSE, DURATION, EV, METRICS, boxes, dense, long, measured, pooled, query, r6, read, spans
from .functions import text as T
from .operators import features, intervals, selection, sequences, words

# ---- intervals -------------------------------------------------------------------------------------------------------


@query(EV + ", f AS (SELECT user_id, event_id, CAST(CAST(s0 - 3600 AS FLOAT) AS DOUBLE) AS a, CAST(CAST(e0 AS FLOAT) AS DOUBLE) AS b FROM ev) SELECT user_id, event_id, a AS start, b AS stop FROM f WHERE a >= 0 AND b <= CAST(CAST(2592000.0 AS FLOAT) AS DOUBLE) AND b > a AND b - a >= 4000")
def stored_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spans(spark, sf_dir).withColumn("t", intervals.stored_interval(F.col("s0") - 3600, F.col("e0"), F.lit(DURATION), 4000.0))
    return rows.where("t is not null").select("user_id", "event_id", "t.start", "t.stop")


@query(EV + ", c AS (SELECT user_id, event_id, s0 - 3600 AS a, CASE WHEN event_type <> 'view' THEN e0 - 3600 END AS b FROM ev), d AS (SELECT user_id, event_id, a, coalesce(b, least(2505600.0, a + 0.05)) AS b FROM c), x AS (SELECT user_id, event_id, a, CASE WHEN b <= a THEN least(2505600.0, a + 0.05) ELSE b END AS b FROM d) SELECT user_id, event_id, round(greatest(0.0, a), 6) AS start, round(least(2505600.0, b), 6) AS stop FROM x WHERE b > 0 AND a < 2505600.0")
def clean_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spans(spark, sf_dir).withColumn("e0", F.when(F.col("event_type") != "view", F.col("e0")))
    rows = intervals.clean_chunks(rows, "s0", "e0", 2_505_600.0, 3600.0)
    return rows.select("user_id", "event_id", r6("s0").alias("start"), r6("e0").alias("stop"))


@query(EV + "SELECT user_id, CAST(count(*) AS BIGINT) AS n, round(sum(greatest(least(greatest(s0 - 60, 0.0), 2592000.0), least(greatest(e0 - 30000, 0.0), 2592000.0)) - least(least(greatest(s0 - 60, 0.0), 2592000.0), least(greatest(e0 - 30000, 0.0), 2592000.0))), 3) AS total FROM ev WHERE e0 > s0 AND event_type <> 'purchase' GROUP BY 1")
def usable_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = intervals.clip_interval(F.col("s0") - 60, F.col("e0") - 30000, F.lit(DURATION))
    rows = spans(spark, sf_dir).withColumn("valid", (F.col("e0") > F.col("s0")) & (F.col("event_type") != "purchase"))
    return rows.where(intervals.usable(F.col("valid"), F.col("s0"), F.col("e0"))).groupBy("user_id").agg(F.count("*").alias("n"), F.round(F.sum(b - a), 3).alias("total"))


@query("WITH e AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS k, count(*) OVER (PARTITION BY user_id) * 0.41 AS d FROM events), f AS (SELECT user_id, k, (k + 0.5) / CAST(2.0 AS DOUBLE) AS c, CAST(d AS DOUBLE) AS d FROM e) SELECT user_id, CAST(k AS BIGINT) AS frame, round(c, 6) AS centre, round(greatest(c - 0.25, 0.0), 6) AS start, round(least(c + 0.25, d), 6) AS stop FROM f WHERE c < d AND least(c + 0.25, d) > greatest(c - 0.25, 0.0)")
def retained_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n"))
    rows = rows.select("user_id", (F.col("n") * 0.41).alias("d"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("frame"))
    kept = intervals.frame_spans(rows, "frame", F.col("d"), 2.0)
    return kept.select("user_id", "frame", *[r6(c).alias(c) for c in ("centre", "start", "stop")])


@query(EV + ", o AS (SELECT user_id, s0, e0, lag(s0) OVER (PARTITION BY user_id ORDER BY event_id) AS b FROM ev) SELECT user_id, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (WHERE s0 < b) AS BIGINT) AS backward, CAST(count(*) FILTER (WHERE e0 < s0) AS BIGINT) AS reversed FROM o GROUP BY 1")
def grid_order_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.order_violations(spans(spark, sf_dir), ["user_id"], ["event_id"], "s0", "e0")


@query(EV + ", g AS (SELECT user_id, s0, event_id, coalesce(CAST(s0 - lag(s0) OVER w > 43200 AS INTEGER), 0) AS x FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY s0, event_id)), t AS (SELECT user_id, s0, sum(x) OVER (PARTITION BY user_id ORDER BY s0, event_id ROWS UNBOUNDED PRECEDING) AS track FROM g) SELECT user_id, CAST(track AS BIGINT) AS track, CAST(count(*) AS BIGINT) AS n, round(min(s0), 3) AS start, round(max(s0), 3) AS stop FROM t GROUP BY 1, 2")
def gap_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = intervals.continued(spans(spark, sf_dir), ["user_id"], ["s0", "event_id"], "s0", 43_200.0)
    return rows.groupBy("user_id", long("track").alias("track")).agg(F.count("*").alias("n"), F.round(F.min("s0"), 3).alias("start"), F.round(F.max("s0"), 3).alias("stop"))


# ---- candidates ------------------------------------------------------------------------------------------------------

CAND = """WITH w AS (SELECT conv_id, role, turn, unnest(string_split(text, ' ')) AS w FROM conversations),
m AS (SELECT *, CASE WHEN length(w) <= 3 THEN 'fallback' WHEN length(w) <= 5 THEN 'exact' WHEN length(w) = 6 THEN 'edit_distance' WHEN length(w) = 7 THEN 'equivalent_compound' ELSE 'fallback' END AS t FROM w WHERE turn > 0),
sm AS (SELECT DISTINCT conv_id, r.role FROM conversations, (SELECT unnest(['user', 'assistant']) AS role) r),
rc AS (SELECT conv_id, role, count(*) AS records, count(*) FILTER (WHERE t = 'fallback') AS fallbacks, count(*) FILTER (WHERE length(w) > 10) AS invalid, count(*) FILTER (WHERE t = 'exact') AS exact, count(*) FILTER (WHERE t IN ('edit_distance', 'equivalent_compound')) AS edited FROM m GROUP BY 1, 2),
hd AS (SELECT conv_id, role, count(*) AS words, count(*) FILTER (WHERE regexp_matches(w, '[A-Za-z0-9]')) AS lexical FROM w WHERE turn % 3 <> 0 GROUP BY 1, 2),
cs AS (SELECT conv_id, role, coalesce(records, 0) AS records, coalesce(fallbacks, 0) AS fallbacks, coalesce(invalid, 0) AS invalid, coalesce(exact, 0) AS exact, coalesce(edited, 0) AS edited, coalesce(words, 0) AS words, coalesce(lexical, 0) AS lexical FROM sm LEFT JOIN rc USING (conv_id, role) LEFT JOIN hd USING (conv_id, role))
"""


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of the later turns as records, those of two turns in three as what a recogniser heard; conversations without either have zeros."""
    conv = read(spark, sf_dir, "conversations")
    samples = conv.select("conv_id").distinct().withColumn("role", F.explode(F.array(F.lit("user"), F.lit("assistant"))))
    words = conv.select("conv_id", "role", "turn", F.explode(F.split("text", " ")).alias("w"))
    size = F.length("w")
    match = F.when(size <= 3, "fallback").when(size <= 5, "exact").when(size == 6, "edit_distance").when(size == 7, "equivalent_compound").otherwise("fallback")
    return selection.candidate_summary(samples, words.where("turn > 0"), words.where("turn % 3 <> 0"), ["conv_id", "role"], match, size <= 10, F.col("w"))


@query(CAND + "SELECT conv_id, role, records, words, lexical, fallbacks, invalid, exact, edited, round(fallbacks / greatest(records, 1), 6) AS ratio, records - fallbacks AS matched FROM cs")
def candidate_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candidates(spark, sf_dir).withColumn("ratio", r6("ratio"))


@query(CAND + "SELECT a.conv_id, a.fallbacks / greatest(a.records, 1) >= 0.5 OR a.lexical = 0 AS retried, (a.fallbacks / greatest(a.records, 1) >= 0.5 OR a.lexical = 0) AND coalesce(b.fallbacks < a.fallbacks AND b.invalid <= a.invalid AND b.records - b.fallbacks >= a.records - a.fallbacks, FALSE) AS retry_wins FROM (SELECT * FROM cs WHERE role = 'user') a LEFT JOIN (SELECT * FROM cs WHERE role = 'assistant') b USING (conv_id)")
def retry_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = candidates(spark, sf_dir)
    return selection.retry_gate(each.where("role = 'user'").drop("role"), each.where("role = 'assistant'").drop("role"), ["conv_id"])


@query("SELECT user_id, string_agg(event_type || ':' || n, ';' ORDER BY event_type) AS histogram FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL) GROUP BY 1")
def source_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.histogram_text(read(spark, sf_dir, "events"), ["user_id"], "event_type")


@query(METRICS + "SELECT scenario = 'complete' AS complete, round(coalesce(avg(CASE WHEN scenario <> 'complete' THEN composite END), avg((accuracy + macro_f1 + 1 - mae / 6) / 3)), 6) AS score FROM mt GROUP BY 1")
def selection_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = measured(spark, sf_dir).withColumn("complete", F.col("scenario") == "complete").withColumn("composite", F.when(~F.col("complete"), F.col("composite")))
    return selection.selection_score(rows, ["complete"]).select("complete", r6("score").alias("score"))


SEEDS = METRICS + ", sd AS (SELECT CAST(round(fraction * 10) AS BIGINT) % 3 AS seed, * FROM mt), pk AS (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY scenario <> 'complete', scenario) AS r FROM sd)"


def seeded(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = measured(spark, sf_dir).withColumn("seed", long(F.round(F.col("fraction") * 10)) % 3)
    return selection.seed_rows(rows.select("seed", "scenario", "accuracy", "macro_f1", "composite"), "seed", "scenario", "scenario")


@query(SEEDS + "SELECT seed, scenario, round(accuracy, 6) AS accuracy, round(macro_f1, 6) AS macro_f1 FROM pk WHERE r = 1")
def seed_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seeded(spark, sf_dir).select("seed", "scenario", r6("accuracy").alias("accuracy"), r6("macro_f1").alias("macro_f1"))


@query(SEEDS + "SELECT seed, round(composite, 6) AS composite FROM pk WHERE r = 1 ORDER BY pk.composite DESC, seed LIMIT 1")
def best_seed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.best(seeded(spark, sf_dir).select("seed", "composite"), "composite", "seed").select("seed", r6("composite").alias("composite"))


@query("WITH t AS (SELECT label, vec_id % 11 AS track, count(*) AS n, avg(abs(CAST(embedding[1] AS DOUBLE))) AS confidence, min(vec_id) AS first FROM embeddings GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY n DESC, confidence DESC, first DESC) AS r FROM t) SELECT label, CAST(track AS BIGINT) AS track, CAST(n AS BIGINT) AS n, round(confidence, 6) AS confidence, first FROM r WHERE r = 1")
def best_track(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings").select("label", long(F.col("vec_id") % 11).alias("track"), "vec_id", F.abs(F.col("embedding")[0].cast("double")).alias("confidence"))
    return selection.best_track(rows, ["label"], "track", "vec_id", "confidence").withColumn("confidence", r6("confidence"))


@query("WITH b AS (SELECT event_type, user_id, count(*) AS n, avg(value) AS total, avg(value * value) AS squared FROM events GROUP BY ALL) SELECT event_type, round(sum(total * n) / greatest(sum(n), 1), 6) AS total, round(sum(squared * n) / greatest(sum(n), 1), 4) AS squared FROM b GROUP BY 1")
def running_losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    batches = read(spark, sf_dir, "events").groupBy("event_type", "user_id").agg(F.count("*").alias("n"), F.avg("value").alias("total"), F.avg(F.col("value") * F.col("value")).alias("squared"))
    return selection.running_means(batches, ["event_type"], "n", ["total", "squared"]).select("event_type", r6("total").alias("total"), F.round("squared", 4).alias("squared"))


LENGTHS = DENSE + ", l AS (SELECT user_id, count(*) AS bins, sum(CAST(mask AS INTEGER)) AS effective, sum(CAST(mask AS INTEGER)) / greatest(count(*), 1) AS ratio, sum(CAST(mask AND event_type = 'view' AS INTEGER)) / greatest(sum(CAST(mask AS INTEGER)), 1) AS view_share FROM dn GROUP BY 1)"


@query(LENGTHS + " SELECT 'bins' AS \"column\", round(avg(bins), 6) AS mean FROM l UNION ALL SELECT 'effective', round(avg(effective), 6) FROM l UNION ALL SELECT 'ratio', round(avg(ratio), 6) FROM l UNION ALL SELECT 'view_share', round(avg(view_share), 6) FROM l")
def effective_length_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    on = F.count_if("mask")
    each = dense(spark, sf_dir).groupBy("user_id").agg(F.count("*").alias("bins"), on.alias("effective"), (on / F.greatest(F.count("*"), F.lit(1))).alias("ratio"), (F.count_if(F.col("mask") & (F.col("event_type") == "view")) / F.greatest(on, F.lit(1))).alias("view_share"))
    return selection.column_means(each.drop("user_id")).select("column", r6("mean").alias("mean"))


@query("SELECT doc_id, lang, CAST(place AS BIGINT) AS place FROM documents JOIN (VALUES (97, 0), (5, 1), (-1, 2), (41, 3)) q(id, place) ON doc_id = id")
def requested_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "documents").select("doc_id", "lang")
    return selection.requested(rows, "doc_id", [97, 5, -1, 41, 5], "lang", "doc_id")


@query("SELECT doc_id, n_chars, CAST(0 AS BIGINT) AS place FROM documents ORDER BY n_chars DESC, doc_id LIMIT 1")
def requested_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No asked id is known: the longest document, the first of equally long ones."""
    return selection.requested(read(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id", [-1, -2], "n_chars", "doc_id")


@query("SELECT event_type, CAST(count(*) AS BIGINT) AS errors, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY event_id) FILTER (WHERE r <= 10) AS keys FROM (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS r FROM events WHERE value > 20) GROUP BY 1")
def first_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.first_errors(read(spark, sf_dir, "events").where("value > 20").select("event_type", "event_id"), "event_type", "event_id")


def transcripts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Users' turns as texts; the assistants' tokens as recognised words: 0.4 s each, every seventh without a time."""
    conv = read(spark, sf_dir, "conversations")
    join = lambda role: conv.where(F.col("role") == role).groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), " ").alias("text"))
    heard = join("assistant").select("conv_id", F.posexplode(T.tokenize(F.col("text"))).alias("index", "word"))
    start = F.when(F.col("index") % 7 != 6, F.col("index") * 0.4)
    heard = heard.select("conv_id", long("index").alias("index"), "word", start.alias("start"), (start + 0.4).alias("stop"), F.lit(0.9).alias("confidence"))
    samples = join("user").withColumn("duration", F.size(T.tokenize(F.col("text"))) * 0.5)
    return samples, heard


@query()
def align_text_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples, heard = transcripts(spark, sf_dir)
    rows = words.align_text_words(samples, heard, "conv_id")
    return rows.select("conv_id", "n", "word", "start_char", "end_char", r6("start").alias("start"), r6("stop").alias("stop"), "confidence", "match_type", "timestamp_source")


# ---- step features ---------------------------------------------------------------------------------------------------

STEPS = """WITH r AS (SELECT vec_id, [CAST(CASE WHEN (i + vec_id) % 9 < 4 THEN 0 ELSE v END AS DOUBLE) FOR v, i IN embedding] AS e FROM embeddings),
st AS (SELECT vec_id, [e[4 * k + 1 : 4 * k + 4] FOR k IN range(16)] AS steps FROM r),
sn AS (SELECT *, [list_bool_or([x <> 0 FOR x IN s]) FOR s IN steps] AS seen, vec_id % 4 AS k, vec_id % 3 = 0 AS att FROM st),
mk AS (SELECT vec_id, steps, [CASE WHEN att AND k > 1 THEN i <= 11 ELSE CASE k WHEN 0 THEN i % 2 = 1 WHEN 1 THEN s AND i - 1 < least(vec_id % 21, 16) ELSE s END AND (NOT att OR i <= 11) END FOR s, i IN seen] AS mask,
CASE WHEN att AND k > 1 THEN 'text_bert_attention_mask' ELSE CASE k WHEN 0 THEN 'explicit_mask' WHEN 1 THEN 'explicit_length' ELSE 'zero_row_heuristic' END || CASE WHEN att THEN '+text_bert_attention_mask' ELSE '' END END AS source FROM sn)
"""


def stepped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, steps, mask, source): vectors as 16 steps of 4 values, with zeros, explicit masks, lengths and attention rows by vec_id."""
    v = F.col("vec_id")
    e = F.transform("embedding", lambda x, i: F.when((i + 1 + v) % 9 < 4, 0.0).otherwise(x.cast("double")))
    index = F.sequence(F.lit(0), F.lit(15))
    rows = read(spark, sf_dir, "embeddings").select("vec_id", F.transform(index, lambda k: F.slice(e, k * 4 + 1, 4)).alias("steps"))
    explicit = F.when(v % 4 == 0, F.transform(index, lambda i: i % 2 == 0))
    length = F.when(v % 4 == 1, (v % 21).cast("int"))
    attention = F.when(v % 3 == 0, F.transform(index, lambda i: F.when(i < 11, 1.0).otherwise(0.0)))
    rows = rows.withColumn("m", features.resolve_mask(F.col("steps"), explicit, length, attention))
    return rows.select("vec_id", "steps", F.col("m.mask").alias("mask"), F.col("m.source").alias("source"))


def total(steps: Column) -> Column:
    return F.aggregate(F.flatten(steps), F.lit(0.0), lambda a, x: a + x)


@query(STEPS + "SELECT vec_id, source, array_to_string([CAST(CAST(m AS INTEGER) AS VARCHAR) FOR m IN mask], '') AS mask, round(coalesce(list_sum([CASE WHEN m THEN list_sum(steps[i]) ELSE 0 END FOR m, i IN mask]), 0), 6) AS kept FROM mk")
def resolved_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    bits = F.array_join(F.transform("mask", lambda m: m.cast("int").cast("string")), "")
    return stepped(spark, sf_dir).select("vec_id", "source", bits.alias("mask"), r6(total(features.masked(F.col("steps"), F.col("mask")))).alias("kept"))


@query(STEPS + ", u AS (SELECT vec_id, unnest(steps) AS s, unnest(mask) AS m FROM mk) SELECT vec_id, round(count(*) FILTER (WHERE m) / 16, 6) AS coverage, " + ", ".join(f"round(coalesce(sum(s[{d + 1}]) FILTER (WHERE m), 0) / greatest(count(*) FILTER (WHERE m), 1), 6) AS mean_{d}" for d in range(4)) + " FROM u GROUP BY 1")
def masked_step_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stepped(spark, sf_dir).select("vec_id", features.coverage(F.col("mask")).alias("coverage"), features.masked_mean(F.col("steps"), F.col("mask"), 4).alias("mean"))
    return rows.select("vec_id", r6("coverage").alias("coverage"), *[r6(F.col("mean")[d]).alias(f"mean_{d}") for d in range(4)])


@query(DENSE + "SELECT user_id, event_type, CAST(sum(CAST(mask AND event_type = 'view' AS INTEGER)) AS BIGINT) AS n, round(sum(CASE WHEN event_type = 'view' THEN value ELSE 0 END), 6) AS total FROM dn GROUP BY 1, 2")
def restricted_channel(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = features.restrict(dense(spark, sf_dir), "event_type", "view", "mask", "value")
    return rows.groupBy("user_id", "event_type").agg(F.count_if("mask").alias("n"), r6(F.sum("value")).alias("total"))


@query(DENSE + "SELECT user_id, string_agg(CAST(CAST(mask AS INTEGER) AS VARCHAR), '' ORDER BY CASE event_type WHEN 'click' THEN 0 WHEN 'view' THEN 1 ELSE 2 END, bin) AS bits FROM dn GROUP BY 1")
def stacked_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    stacked = features.stack_masks(dense(spark, sf_dir), "user_id", "event_type", "bin", "mask", CHANNELS, BINS)
    return stacked.select("user_id", F.array_join(F.transform(F.flatten("masks"), lambda m: m.cast("int").cast("string")), "").alias("bits"))


@query(DENSE + "SELECT user_id, event_type, bin, mask FROM dn")
def unstacked_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    stacked = features.stack_masks(dense(spark, sf_dir), "user_id", "event_type", "bin", "mask", CHANNELS, BINS)
    return features.unstack_masks(stacked, "user_id", "event_type", "bin", "mask", CHANNELS)


@query("WITH t AS (SELECT vec_id // 3 AS word, unnest(range(len(embedding))) AS dim, unnest(embedding) AS x FROM embeddings WHERE vec_id % 7 <> 0) SELECT CAST(word AS BIGINT) AS word, CAST(dim AS INTEGER) AS dim, round(avg(CAST(x AS DOUBLE)), 6) AS mean FROM t GROUP BY 1, 2")
def pooled_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings").select(F.when(F.col("vec_id") % 7 != 0, long(F.floor(F.col("vec_id") / 3))).alias("word"), "embedding")
    return features.pool_words(rows, "word", "embedding").select("word", "dim", r6("mean").alias("mean"))


@query(EV + ", fl AS (SELECT user_id, event_type, CAST(bin AS INTEGER) AS bin, sum(w * CASE WHEN value >= 20 THEN 1.0 ELSE 0.0 END) / sum(w) AS flag FROM wt WHERE w > 0 GROUP BY ALL) SELECT user_id, event_type, bin, round(least(greatest(weight, 0.0), 1.0), 9) < 0.5 AS low, round(flag, 9) >= 0.5 AS trusted FROM pool JOIN fl USING (user_id, event_type, bin)")
def reliable_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    flags = spans(spark, sf_dir).where("value is not null").withColumn("flag", (F.col("value") >= 20).cast("double"))
    share = sequences.overlap_pool(flags, ["user_id", "event_type"], "s0", "e0", "flag", duration=DURATION, bins=BINS)
    return features.reliability(share, "weight", "value").select("user_id", "event_type", "bin", "low", "trusted")


# ---- checks, names, geometry -----------------------------------------------------------------------------------------


@query("""WITH o AS (SELECT count(*) - count(DISTINCT doc_id) AS d FROM documents) SELECT 'repeated_id' AS rule, CAST(d AS BIGINT) AS violations FROM o
UNION ALL SELECT 'wrong_length', CAST(count(*) FILTER (WHERE len(embedding) <> 64) AS BIGINT) FROM embeddings UNION ALL SELECT 'unknown_class', CAST(count(*) FILTER (WHERE label < 0 OR label >= 3) AS BIGINT) FROM embeddings
UNION ALL SELECT 'out_of_range', CAST(count(*) FILTER (WHERE list_max(embedding) > 0.3) AS BIGINT) FROM embeddings""")
def split_constraints(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = read(spark, sf_dir, "documents").groupBy("doc_id").agg(F.count("*").alias("n")).agg(F.lit("repeated_id").alias("rule"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("violations"))
    broken = {"wrong_length": F.size("embedding") != 64, "unknown_class": (F.col("label") < 0) | (F.col("label") >= 3), "out_of_range": F.array_max("embedding") > 0.3}
    return ids.union(selection.violations(read(spark, sf_dir, "embeddings"), broken))


@query("SELECT user_id, len([x FOR x IN ['click', 'purchase', 'view'] IF NOT list_contains(t, x)]) = 0 AS complete FROM (SELECT user_id, list(DISTINCT event_type) AS t FROM events GROUP BY 1)")
def required_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    has = read(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_set("event_type").alias("t"))  # event types are few
    return has.select("user_id", (F.size(F.array_except(F.array(*[F.lit(c) for c in CHANNELS]), "t")) == 0).alias("complete"))


@query("SELECT l_linestatus, CAST(count(*) FILTER (WHERE l_returnflag = 'N') AS BIGINT) AS neutral, CAST(count(*) FILTER (WHERE l_returnflag = 'N' AND abs(l_discount) > 1e-6) AS BIGINT) AS not_zero FROM lineitem GROUP BY 1")
def neutral_zero(spark: SparkSession, sf_dir: str) -> DataFrame:
    neutral = F.col("l_returnflag") == "N"
    return read(spark, sf_dir, "lineitem").groupBy("l_linestatus").agg(F.count_if(neutral).alias("neutral"), F.count_if(neutral & (F.abs("l_discount") > 1e-6)).alias("not_zero"))


@query("WITH p AS (SELECT vec_id + vec_id % 2 AS id, CASE WHEN vec_id % 10 = 0 THEN 'NaN'::DOUBLE ELSE CAST(embedding[1] AS DOUBLE) END AS s FROM embeddings WHERE vec_id % 5 <> 1), e AS (SELECT DISTINCT vec_id AS id FROM embeddings), g AS (SELECT id, count(*) AS n, sum(CAST(isnan(s) AS INTEGER)) AS bad FROM p GROUP BY 1), j AS (SELECT e.id AS e, g.n, g.bad FROM e FULL JOIN g USING (id)) SELECT CAST(count(e) AS BIGINT) AS expected, CAST(coalesce(sum(n), 0) AS BIGINT) AS predicted, CAST(count(*) FILTER (WHERE n IS NULL) AS BIGINT) AS missing, CAST(count(*) FILTER (WHERE e IS NULL) AS BIGINT) AS unexpected, CAST(count(*) FILTER (WHERE n > 1) AS BIGINT) AS repeated, CAST(coalesce(sum(bad), 0) AS BIGINT) AS not_finite, round((count(e) - count(*) FILTER (WHERE n IS NULL)) / greatest(count(e), 1), 6) AS coverage FROM j")
def prediction_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, v = read(spark, sf_dir, "embeddings"), F.col("vec_id")
    score = F.when(v % 10 == 0, float("nan")).otherwise(F.col("embedding")[0].cast("double"))
    made = rows.where(v % 5 != 1).select((v + v % 2).alias("vec_id"), score.alias("s"))
    return selection.prediction_audit(rows, made, "vec_id", ["s"]).withColumn("coverage", r6("coverage"))


@query("SELECT doc_id, regexp_replace(source || ' / ' || lang || '!', '[^A-Za-z0-9._-]+', '_', 'g') AS name, regexp_full_match(coalesce(CASE WHEN doc_id % 3 = 0 THEN source || '/' WHEN doc_id % 5 = 0 THEN source || chr(10) ELSE source || lang END, ''), '[\\p{L}\\p{N}._-]+') AS valid, CASE WHEN doc_id % 7 = 0 THEN 0.0 ELSE round(CAST(doc_id * 1000 AS DOUBLE) / (doc_id % 7), 6) END AS rate FROM documents")
def safe_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    run = F.when(F.col("doc_id") % 3 == 0, F.concat("source", F.lit("/"))).when(F.col("doc_id") % 5 == 0, F.concat("source", F.lit("\n"))).otherwise(F.concat("source", "lang"))
    rate = T.fraction(F.concat_ws("/", F.col("doc_id") * 1000, F.col("doc_id") % 7))
    return rows.select("doc_id", T.safe_name(F.concat("source", F.lit(" / "), "lang", F.lit("!"))).alias("name"), T.valid_run_id(run).alias("valid"), r6(rate).alias("rate"))


SAID = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in T.CONCLUSIONS.items())
RATIOS = "WITH r AS (SELECT user_id, CAST(count(*) FILTER (WHERE event_type NOT IN ('click', 'view')) AS DOUBLE) / count(*) AS ratio, count(*) FILTER (WHERE value < 1) AS bad FROM events GROUP BY 1), s AS (SELECT user_id, ratio, CASE WHEN ratio >= 0.63 THEN 'asr_text_mismatch_manual_review' WHEN ratio >= 0.6 THEN 'high_fallback_manual_review' WHEN bad > 2 THEN 'partial_invalid_timestamp_manual_review' ELSE 'normal' END AS status FROM r) "


@query(RATIOS + f"SELECT user_id, status, CASE status {SAID} ELSE '{T.ORDINARY}' END AS conclusion, ratio >= 0.58 - 1e-4 AND ratio <= 0.62 + 1e-4 AS in_range FROM s")
def review_conclusions(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = read(spark, sf_dir, "events").groupBy("user_id").agg((F.count_if(~F.col("event_type").isin("click", "view")).cast("double") / F.count("*")).alias("ratio"), F.count_if(F.col("value") < 1).alias("bad"))
    status = F.when(F.col("ratio") >= 0.63, "asr_text_mismatch_manual_review").when(F.col("ratio") >= 0.6, "high_fallback_manual_review").when(F.col("bad") > 2, "partial_invalid_timestamp_manual_review").otherwise("normal")
    return r.select("user_id", status.alias("status"), T.conclusion(status).alias("conclusion"), selection.within(F.col("ratio"), 0.58, 0.62).alias("in_range"))


@query("SELECT event_id, event_type FROM events WHERE user_id = (SELECT min(user_id) FROM events)")
def one_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = read(spark, sf_dir, "events")
    return selection.only(ev, "user_id", ev.agg(F.min("user_id")).first()[0]).select("event_id", "event_type")


CROP = """WITH e AS (SELECT vec_id, CAST(embedding[1] AS DOUBLE) + 0.5 AS a, CAST(embedding[2] AS DOUBLE) + 0.5 AS b, CAST(embedding[3] AS DOUBLE) + 0.5 AS c, CAST(embedding[4] AS DOUBLE) + 0.5 AS d FROM embeddings),
x AS (SELECT vec_id, least(a, c) AS x0, least(b, d) AS y0, greatest(a, c) AS x1, greatest(b, d) AS y1 FROM e),
s AS (SELECT *, (x0 * 640 + x1 * 640) / 2 AS cx, (y0 * 480 + y1 * 480) / 2 AS cy, greatest(x1 * 640 - x0 * 640, y1 * 480 - y0 * 480) * CAST(1.2 AS DOUBLE) AS size FROM x),
r AS (SELECT vec_id, size, CAST(greatest(0, round_even(cx - size / 2, 0)) AS INTEGER) AS l, CAST(greatest(0, round_even(cy - size / 2, 0)) AS INTEGER) AS t, CAST(least(640, round_even(cx + size / 2, 0)) AS INTEGER) AS r, CAST(least(480, round_even(cy + size / 2, 0)) AS INTEGER) AS b, least(greatest(0.9 * sqrt((x1 - x0) * (y1 - y0)), 0), 1) AS q FROM s)
"""


@query(CROP + 'SELECT vec_id, l AS "left", t AS top, r AS "right", b AS bottom, round(q, 6) AS quality FROM r WHERE size > 1 AND r > l AND b > t')
def crop_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ("x0", "y0", "x1", "y1")
    rows = boxes(spark, sf_dir).select("vec_id", *[(F.col(c) + 0.5).alias(c) for c in names])
    box = [F.col(c) for c in names]
    rows = rows.select("vec_id", T.crop_box(box, 640, 480, 0.2).alias("b"), r6(T.detection_quality(box, F.lit(0.9))).alias("quality"))
    return rows.where("b is not null").select("vec_id", "b.*", "quality")
