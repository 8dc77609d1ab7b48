"""Registered queries of the engine's own operators, each with the SQL that states what it returns.

Fixtures stand in for span sequences: an event is a span from its time to the user's next event, at most six hours
long; users are samples, event types are channels, January 2024 is the duration. Floats are rounded to six digits
on both sides, since the two engines add up in different orders.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import text as T
from .operators import alignment, evaluation, metrics, scenarios, sequences

FLAGSHIP = "trimodal_alignment_score"
DURATION, BINS, REACH = 2_592_000.0, 50, 21_600.0
CHANNELS = ["click", "view", "purchase"]

_queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_sql: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Register a query under its function's name, with its SQL."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        _queries[f.__name__] = f
        if sql:
            _sql[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def r6(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def long(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("long")


# ---- spans, pooling, masks -------------------------------------------------------------------------------------------


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id, event_type, event_id, s0, e0, value): events as spans in seconds from the start of the month."""
    ev = read(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "ts", "value")
    ev = ev.withColumn("s0", F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', ts)") / 1e6)
    following = F.lead("s0").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return ev.withColumn("e0", F.least(following, F.col("s0") + REACH, F.lit(DURATION))).drop("ts")


def pooled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.overlap_pool(spans(spark, sf_dir), ["user_id", "event_type"], "s0", "e0", "value", duration=DURATION, bins=BINS)


EV = """WITH ev0 AS (SELECT user_id, event_type, event_id, value, (epoch_us(ts) - 1704067200000000) / 1e6 AS s0, ts FROM events),
ev AS (SELECT user_id, event_type, event_id, value, s0, least(lead(s0) OVER (PARTITION BY user_id ORDER BY ts, event_id), s0 + 21600.0, 2592000.0) AS e0 FROM ev0),
ex AS (SELECT *, unnest(range(greatest(CAST(floor(s0 / 51840.0) AS BIGINT), 0), least(CAST(ceil(e0 / 51840.0) AS BIGINT) - 1, 49) + 1)) AS bin FROM ev WHERE e0 > s0 AND e0 > 0 AND s0 < 2592000.0 AND value IS NOT NULL),
wt AS (SELECT *, greatest(least(e0, (bin + 1) * 51840.0) - greatest(s0, bin * 51840.0), 0.0) / greatest(e0 - s0, 1e-12) AS w FROM ex),
pool AS (SELECT user_id, event_type, CAST(bin AS INTEGER) AS bin, sum(w * value) / sum(w) AS value, sum(w) AS weight FROM wt WHERE w > 0 GROUP BY ALL)
"""


@query(EV + "SELECT user_id, event_type, bin, round(value, 6) AS value, round(weight, 6) AS weight FROM pool")
def overlap_pool_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pooled(spark, sf_dir).select("user_id", "event_type", "bin", r6("value").alias("value"), r6("weight").alias("weight"))


DENSE = EV + """, frame AS (SELECT u.user_id, c.event_type, CAST(b.bin AS INTEGER) AS bin FROM (SELECT DISTINCT user_id FROM events) u, (SELECT unnest(['click', 'view', 'purchase']) AS event_type) c, (SELECT unnest(range(50)) AS bin) b),
dn AS (SELECT f.user_id, f.event_type, f.bin, p.weight IS NOT NULL AS mask, coalesce(p.value, 0.0) AS value, coalesce(p.weight, 0.0) AS weight FROM frame f LEFT JOIN pool p USING (user_id, event_type, bin))
"""


def dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.dense(pooled(spark, sf_dir), read(spark, sf_dir, "events"), CHANNELS, "user_id", "event_type", BINS)


@query(DENSE + "SELECT user_id, event_type, bin, mask, round(value, 6) AS value, round(weight, 6) AS weight FROM dn")
def availability_mask_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dense(spark, sf_dir).select("user_id", "event_type", F.col("bin").cast("int").alias("bin"), "mask", r6("value").alias("value"), r6("weight").alias("weight"))


@query(DENSE + "SELECT user_id, event_type, round(avg(CAST(mask AS INTEGER)), 6) AS coverage, CAST(sum(CAST(mask AS INTEGER)) AS BIGINT) AS valid_bins FROM dn GROUP BY ALL")
def coverage_by_modality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dense(spark, sf_dir).groupBy("user_id", "event_type").agg(r6(F.avg(F.col("mask").cast("int"))).alias("coverage"), F.count_if("mask").alias("valid_bins"))


@query(EV + ", st AS (SELECT event_type, avg(value) AS m, stddev_pop(value) AS s FROM pool GROUP BY 1) SELECT user_id, event_type, bin, round((value - m) / CASE WHEN s > 1e-6 THEN s ELSE 1.0 END, 6) AS z FROM pool JOIN st USING (event_type)")
def zscore_masked_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.masked_zscore(pooled(spark, sf_dir), "event_type", "value").select("user_id", "event_type", "bin", r6("z").alias("z"))


NORM = """WITH x AS (SELECT vec_id, unnest(range(len(embedding))) AS dim, unnest(embedding) AS x FROM embeddings),
st AS (SELECT dim, avg(CAST(x AS DOUBLE)) AS mean, stddev_pop(CAST(x AS DOUBLE)) AS s, count(*) AS n FROM x WHERE vec_id % 5 <> 0 GROUP BY 1),
fit AS (SELECT dim, mean, CASE WHEN s > 1e-6 THEN s ELSE 1.0 END AS std, n FROM st)
"""


def fitted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.fit_normalization(read(spark, sf_dir, "embeddings"), "embedding", F.col("vec_id") % 5 != 0)


@query(NORM + "SELECT CAST(dim AS INTEGER) AS dim, round(mean, 6) AS mean, round(std, 6) AS std, CAST(n AS BIGINT) AS n FROM fit")
def fit_norm_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fitted(spark, sf_dir).select("dim", r6("mean").alias("mean"), r6("std").alias("std"), "n")


@query(NORM + "SELECT vec_id, CAST(dim AS INTEGER) AS dim, round((CAST(x AS DOUBLE) - mean) / std, 6) AS z FROM x JOIN fit USING (dim)")
def transform_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.transform_normalization(read(spark, sf_dir, "embeddings"), "vec_id", "embedding", fitted(spark, sf_dir)).select("vec_id", "dim", r6("z").alias("z"))


@query("WITH n AS (SELECT vec_id, label, sqrt(list_sum([CAST(v AS DOUBLE) * CAST(v AS DOUBLE) FOR v IN embedding])) AS norm FROM embeddings) SELECT vec_id, label, round(norm, 6) AS norm, round(norm / max(norm) OVER (PARTITION BY label), 6) AS scaled FROM n")
def l2_norm_scaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, v: a + v.cast("double") * v.cast("double")))
    rows = read(spark, sf_dir, "embeddings").select("vec_id", "label", norm.alias("norm"))
    top = rows.groupBy("label").agg(F.max("norm").alias("top"))
    return rows.join(top, "label").select("vec_id", "label", r6("norm").alias("norm"), r6(F.try_divide("norm", "top")).alias("scaled"))


UNIT = ", qs AS (SELECT user_id, event_type, quantile_cont(weight, 0.1) AS lo, quantile_cont(weight, 0.9) AS hi FROM pool GROUP BY ALL), un AS (SELECT user_id, event_type, bin, weight, CASE WHEN hi <= lo + 1e-8 THEN 1.0 ELSE least(greatest((weight - lo) / nullif(hi - lo, 0), 0.0), 1.0) END AS unit FROM pool JOIN qs USING (user_id, event_type))"


@query(EV + UNIT + " SELECT user_id, event_type, bin, round(unit, 6) AS unit FROM un")
def unit_interval_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.unit_interval(pooled(spark, sf_dir), ["user_id", "event_type"], "weight").select("user_id", "event_type", "bin", r6("unit").alias("unit"))


TRI = EV + """, qs AS (SELECT user_id, quantile_cont(greatest(value, 0.0), 0.1) AS lo, quantile_cont(greatest(value, 0.0), 0.9) AS hi FROM pool WHERE event_type = 'view' GROUP BY 1),
sp AS (SELECT user_id, bin, event_type, CASE WHEN event_type = 'view' THEN 0.5 * CASE WHEN hi <= lo + 1e-8 THEN 1.0 ELSE least(greatest((greatest(value, 0.0) - lo) / nullif(hi - lo, 0), 0.0), 1.0) END + 0.5 * least(greatest(weight, 0.0), 1.0) ELSE least(greatest(weight, 0.0), 1.0) END AS s FROM pool LEFT JOIN qs USING (user_id) WHERE event_type IN ('click', 'view', 'purchase')),
tri AS (SELECT user_id, bin, coalesce(max(CASE WHEN event_type = 'click' THEN s END), 0.0) AS a, coalesce(max(CASE WHEN event_type = 'view' THEN s END), 0.0) AS b, coalesce(max(CASE WHEN event_type = 'purchase' THEN s END), 0.0) AS c FROM sp GROUP BY ALL),
sm AS (SELECT user_id, sum(least(a, b, c)) AS i, sum(greatest(a, b, c)) AS u, count(*) FILTER (WHERE least(a, b, c) > 1e-8) AS joint, count(*) FILTER (WHERE greatest(a, b, c) > 1e-8) AS any_bins FROM tri GROUP BY 1),
score AS (SELECT user_id, CASE WHEN any_bins > 0 THEN least(greatest(i / (u + 1e-8), 0.0), 1.0) END AS score, joint AS joint_bins, CASE WHEN any_bins = 0 THEN 'no_modality_support' WHEN joint >= 3 THEN 'ok' ELSE 'insufficient_joint_support' END AS status FROM sm)
"""


def agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks stand for text confidence, views for speech activity (value: loudness, weight: voiced), purchases for face quality."""
    return sequences.agreement(sequences.support(pooled(spark, sf_dir), "user_id", "event_type", "click", "view", "purchase"), "user_id", tuple(F.col(c) for c in CHANNELS))


@query(TRI + "SELECT user_id, round(score, 6) AS score, CAST(joint_bins AS BIGINT) AS joint_bins, status FROM score")
def trimodal_alignment_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agreement(spark, sf_dir).select("user_id", r6("score").alias("score"), long("joint_bins").alias("joint_bins"), "status")


@query(TRI + "SELECT status, CAST(count(*) AS BIGINT) AS n, round(avg(score), 6) AS mean, round(quantile_cont(score, 0.5), 6) AS median, round(quantile_cont(score, 0.1), 6) AS p10, round(quantile_cont(score, 0.9), 6) AS p90, round(min(score), 6) AS least, round(max(score), 6) AS largest FROM score WHERE score IS NOT NULL GROUP BY 1")
def alignment_quality_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = sequences.finite_summary(agreement(spark, sf_dir), "score", ["status"])
    return s.select("status", "n", *[r6(c).alias(c) for c in ("mean", "median", "p10", "p90", "least", "largest")])


RUNS = DENSE + """, isl AS (SELECT user_id, event_type, bin, mask, bin - row_number() OVER (PARTITION BY user_id, event_type, mask ORDER BY bin) AS k FROM dn),
rn AS (SELECT user_id, event_type, mask, CAST(min(bin) AS BIGINT) AS start, CAST(max(bin) + 1 AS BIGINT) AS stop FROM isl GROUP BY user_id, event_type, mask, k)
"""


@query(RUNS + "SELECT user_id, event_type, round(max(stop - start) / 50.0, 6) AS longest_missing FROM rn WHERE NOT mask GROUP BY ALL")
def longest_missing_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = sequences.runs(dense(spark, sf_dir), ["user_id", "event_type"], "bin", ~F.col("mask"))
    return r.groupBy("user_id", "event_type").agg(r6(F.max(F.col("stop") - F.col("start")) / float(BINS)).alias("longest_missing"))


@query(RUNS + "SELECT user_id, event_type, start, stop FROM rn WHERE mask")
def contiguous_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = sequences.runs(dense(spark, sf_dir), ["user_id", "event_type"], "bin", F.col("mask"))
    return r.select("user_id", "event_type", long("start").alias("start"), long("stop").alias("stop"))


@query(EV + ", d AS (SELECT *, CASE WHEN bin - lag(bin) OVER w = 1 THEN value - lag(value) OVER w END AS step FROM pool WINDOW w AS (PARTITION BY user_id, event_type ORDER BY bin)) SELECT user_id, event_type, round(avg(value), 6) AS mean, round(sqrt(greatest(var_pop(value), 1e-8)), 6) AS std, round(max(value), 6) AS max, round(min_by(value, bin), 6) AS first, round(max_by(value, bin), 6) AS last, round(coalesce(avg(step), 0.0), 6) AS mean_step, CAST(count(*) AS BIGINT) AS n FROM d GROUP BY ALL")
def masked_sequence_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = sequences.sequence_statistics(pooled(spark, sf_dir), ["user_id", "event_type"], "bin", "value")
    return s.select("user_id", "event_type", *[r6(c).alias(c) for c in ("mean", "std", "max", "first", "last", "mean_step")], "n")


@query(DENSE + ", st AS (SELECT user_id, bin, sum(CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN 2 ELSE 4 END * CAST(mask AS INTEGER)) AS state FROM dn GROUP BY ALL) SELECT CAST(state AS BIGINT) AS state, CAST(count(*) AS BIGINT) AS n FROM st GROUP BY 1")
def state_code_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = F.sum(F.when(F.col("mask"), F.when(F.col("event_type") == "click", 1).when(F.col("event_type") == "view", 2).otherwise(4)).otherwise(0))
    return dense(spark, sf_dir).groupBy("user_id", "bin").agg(code.alias("state")).groupBy(long("state").alias("state")).agg(F.count("*").alias("n"))


@query(DENSE + ", g AS (SELECT *, max(CASE WHEN mask THEN value END) OVER (PARTITION BY user_id, bin) AS top FROM dn), e AS (SELECT user_id, event_type, bin, value, CASE WHEN mask THEN exp((value - top) / 100.0) ELSE 0.0 END AS x FROM g), f AS (SELECT *, x / greatest(sum(x) OVER (PARTITION BY user_id, bin), 1e-8) AS gate FROM e) SELECT event_type, round(avg(gate), 6) AS gate_mean, round(sum(gate * value), 3) AS fused FROM f GROUP BY 1")
def gate_softmax_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id", "bin")
    rows = dense(spark, sf_dir).withColumn("top", F.max(F.when(F.col("mask"), F.col("value"))).over(w))
    rows = rows.withColumn("x", F.when(F.col("mask"), F.exp((F.col("value") - F.col("top")) / 100.0)).otherwise(0.0))
    rows = rows.withColumn("gate", F.col("x") / F.greatest(F.sum("x").over(w), F.lit(1e-8)))
    return rows.groupBy("event_type").agg(r6(F.avg("gate")).alias("gate_mean"), F.round(F.sum(F.col("gate") * F.col("value")), 3).alias("fused"))


# ---- scenarios -------------------------------------------------------------------------------------------------------


MASKS = EV + """, sc AS (SELECT unnest([0.1, 0.3, 0.5]) AS fraction), ps AS (SELECT unnest(['front', 'middle', 'back']) AS position),
rk AS (SELECT user_id, event_type, bin, count(*) OVER (PARTITION BY user_id, event_type) AS m, row_number() OVER (PARTITION BY user_id, event_type ORDER BY bin) - 1 AS r FROM pool),
ct AS (SELECT *, CASE WHEN m <= 1 THEN 0 ELSE least(m - 1, greatest(1, CAST(ceil(m * CAST(fraction AS DOUBLE)) AS BIGINT))) END AS c FROM rk, sc, ps),
km AS (SELECT CAST(fraction AS DOUBLE) AS fraction, position, user_id, event_type, bin, NOT (r >= CASE position WHEN 'front' THEN 0 WHEN 'middle' THEN (m - c) // 2 ELSE m - c END AND r < CASE position WHEN 'front' THEN 0 WHEN 'middle' THEN (m - c) // 2 ELSE m - c END + c) AS kept FROM ct)
"""


def blanked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scenarios.blank_intervals(pooled(spark, sf_dir), ["user_id", "event_type"], "bin", [0.1, 0.3, 0.5], ["front", "middle", "back"])


@query(MASKS + "SELECT fraction, position, user_id, event_type, bin, kept FROM km")
def scenario_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blanked(spark, sf_dir).select("fraction", "position", "user_id", "event_type", "bin", "kept")


@query(MASKS + ", s AS (SELECT fraction, position, user_id, event_type, count(*) AS o, count(*) FILTER (WHERE kept) AS k FROM km GROUP BY ALL) SELECT fraction, position, event_type, CAST(sum(o) AS BIGINT) AS original, CAST(sum(k) AS BIGINT) AS observed, round(avg((o - k) / greatest(o, 1)), 6) AS mean_missing, round(max((o - k) / greatest(o, 1)), 6) AS max_missing FROM s GROUP BY ALL")
def scenario_mask_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scenarios.mask_statistics(blanked(spark, sf_dir), ["fraction", "position"], "user_id", "event_type", "kept")
    return s.select("fraction", "position", "event_type", "original", "observed", r6("mean_missing").alias("mean_missing"), r6("max_missing").alias("max_missing"))


@query(MASKS + ", s AS (SELECT fraction, position, user_id, event_type, min(bin) AS a, max(bin) + 1 AS b FROM km WHERE NOT kept GROUP BY ALL) SELECT fraction, position, event_type, CAST(count(*) AS BIGINT) AS samples, CAST(min(a) AS BIGINT) AS first_min, CAST(max(a) AS BIGINT) AS first_max, CAST(min(b) AS BIGINT) AS last_min, CAST(max(b) AS BIGINT) AS last_max FROM s GROUP BY ALL")
def scenario_mask_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = blanked(spark, sf_dir).where(~F.col("kept")).groupBy("fraction", "position", "user_id", "event_type").agg(F.min("bin").alias("a"), (F.max("bin") + 1).alias("b"))
    return each.groupBy("fraction", "position", "event_type").agg(F.count("*").alias("samples"), *[long(f(c)).alias(n) for f, c, n in ((F.min, "a", "first_min"), (F.max, "a", "first_max"), (F.min, "b", "last_min"), (F.max, "b", "last_max"))])


def numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pooled bins of the three channels, with channel numbers 0, 1, 2."""
    rows = pooled(spark, sf_dir).where(F.col("event_type").isin(*CHANNELS))
    return rows.withColumn("no", F.when(F.col("event_type") == "click", 0).when(F.col("event_type") == "view", 1).otherwise(2)).select("user_id", "no", "bin")


NUMBERED = EV + ", nb AS (SELECT user_id, CASE event_type WHEN 'click' THEN 0 WHEN 'view' THEN 1 ELSE 2 END AS no, bin FROM pool WHERE event_type IN ('click', 'view', 'purchase'))"


def _hash(*parts: str) -> str:
    """SQL of scenarios.hashed(): names are columns, words in quotes and numbers stand for themselves."""
    return "CAST('0x' || substr(md5(" + " || '|' || ".join(f"CAST({p} AS VARCHAR)" for p in parts) + "), 1, 15) AS BIGINT)"


def _ranked(seed: int) -> str:
    return NUMBERED + f""", rd AS (SELECT *, count(*) OVER (PARTITION BY user_id, no) AS m, row_number() OVER (PARTITION BY user_id, no ORDER BY bin) - 1 AS r, {_hash(str(seed), "'channel'", "user_id", "no")} % {1 << 59} AS d FROM nb),
rk AS (SELECT *, dense_rank() OVER (PARTITION BY user_id ORDER BY d, no) AS p FROM rd), rn AS (SELECT *, max(p) OVER (PARTITION BY user_id) AS n, {_hash(str(seed), "'sample'", "user_id")} % 1000000 AS h FROM rk)"""


STAGGER = evaluation.Scenario("click+view+purchase__40__middle__stagger__s42", (0, 1, 2), 0.4, "middle", "stagger", 42)


@query(NUMBERED + f""", rk AS (SELECT *, count(*) OVER (PARTITION BY user_id, no) AS m, row_number() OVER (PARTITION BY user_id, no ORDER BY bin) - 1 AS r FROM nb),
ct AS (SELECT *, CASE WHEN m <= 1 THEN 0 ELSE least(m - 1, greatest(1, CAST(ceil(m * CAST(0.4 AS DOUBLE)) AS BIGINT))) END AS c, no * ({_hash(f"'{STAGGER.name}'", "user_id", "no")} % 17) AS shift FROM rk),
ab AS (SELECT user_id, no, any_value(shift) AS shift, min(bin) FILTER (WHERE r = (m - c) // 2) AS a, min(bin) FILTER (WHERE r = (m - c) // 2 + c - 1) AS b FROM ct GROUP BY ALL),
gn AS (SELECT user_id, no, bin, r, c > 0 AND bin >= a + ab.shift AND bin < b + 1 + ab.shift AS gone FROM ct JOIN ab USING (user_id, no))
SELECT user_id, no, bin, coalesce(NOT gone, true) OR (r = 0 AND count(*) FILTER (WHERE NOT coalesce(gone, false)) OVER (PARTITION BY user_id, no) = 0) AS kept FROM gn""")
def stagger_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scenarios.under(numbered(spark, sf_dir), "user_id", "no", "bin", STAGGER, BINS).select("user_id", "no", "bin", F.coalesce("kept", F.lit(True)).alias("kept"))


@query(_ranked(21) + " SELECT user_id, no, bin, NOT (p = 1 AND n > 1 AND h < 300000) AS kept FROM rn")
def modality_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scenarios.drop_channel(numbered(spark, sf_dir), "user_id", "no", "bin", 21, 0.30).select("user_id", "no", "bin", "kept")


@query(_ranked(31) + f""", pt AS (SELECT *, row_number() OVER (PARTITION BY user_id, no ORDER BY {_hash("31", "'point'", "user_id", "no", "bin")} % {1 << 59}, bin) AS q FROM rn)
SELECT user_id, no, bin, NOT (h < 750000 AND p <= 1 + {_hash("31", "'count'", "user_id")} % n AND q <= least(m - 1, greatest(1, CAST(ceil(m * CAST(0.25 AS DOUBLE)) AS BIGINT)))) AS kept FROM pt""")
def random_point_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scenarios.drop_points(numbered(spark, sf_dir), "user_id", "no", "bin", 31, 0.75, 0.25).select("user_id", "no", "bin", "kept")


@query(_ranked(41) + f""", sg AS (SELECT *, greatest(1, CAST(ceil(m * least(1.0, greatest(CAST(0.6 AS DOUBLE), 1.0 / m))) AS BIGINT)) AS longest, 1 + {_hash("41", "'segments'", "user_id", "no")} % 3 AS segments, {_hash("41", "'count'", "user_id")} % 1000000 AS u FROM rn),
ln AS (SELECT *, {", ".join(f"least(m - 1, 1 + {_hash('41', chr(39) + 'length' + chr(39), 'user_id', 'no', str(k))} % longest) AS l{k}" for k in range(3))} FROM sg),
st AS (SELECT *, {", ".join(f"{_hash('41', chr(39) + 'start' + chr(39), 'user_id', 'no', str(k))} % (m - l{k} + 1) AS s{k}" for k in range(3))} FROM ln),
gn AS (SELECT *, h < 750000 AND p <= least(1 + CAST(u >= 550000 AS BIGINT) + CAST(u >= 900000 AS BIGINT), n) AND m > 1 AND ({" OR ".join(f"({k} < segments AND r >= s{k} AND r < s{k} + l{k})" for k in range(3))}) AS gone FROM st)
SELECT user_id, no, bin, NOT gone OR (count(*) FILTER (WHERE NOT gone) OVER (PARTITION BY user_id, no) = 0 AND r = {_hash("41", "'keep'", "user_id", "no")} % m) AS kept FROM gn""")
def contiguous_block_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scenarios.drop_blocks(numbered(spark, sf_dir), "user_id", "no", "bin", 41, 0.75, 0.6).select("user_id", "no", "bin", "kept")


@query(DENSE + ", o AS (SELECT *, max(CAST(mask AND event_type <> 'click' AS INTEGER)) OVER (PARTITION BY user_id) AS other FROM dn) SELECT user_id, CAST(sum(CAST(mask AND NOT (event_type = 'click' AND other = 1) AS INTEGER)) AS BIGINT) AS left_bins FROM o GROUP BY 1")
def text_whole_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    other = F.max((F.col("mask") & (F.col("event_type") != "click")).cast("int")).over(Window.partitionBy("user_id"))
    rows = dense(spark, sf_dir).withColumn("other", other)
    return rows.groupBy("user_id").agg(F.count_if(F.col("mask") & ~((F.col("event_type") == "click") & (F.col("other") == 1))).alias("left_bins"))


# ---- metrics ---------------------------------------------------------------------------------------------------------

CLASSED = """WITH cl AS (SELECT CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS t, CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END AS p, l_quantity / 10.0 AS y, l_extendedprice / 10000.0 AS yh, CASE WHEN l_linenumber = 1 THEN 'complete' ELSE 'masked_' || l_linenumber END AS scenario, CAST(l_linenumber AS DOUBLE) / 10 AS fraction FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
"""


def classed(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag", "l_quantity", "l_extendedprice", "l_linenumber")
    rows = li.join(read(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), li["l_orderkey"] == F.col("o_orderkey"))
    scenario = F.when(F.col("l_linenumber") == 1, "complete").otherwise(F.concat(F.lit("masked_"), F.col("l_linenumber")))
    return rows.select(
        F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2).alias("t"), F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2).alias("p"),
        (F.col("l_quantity") / 10.0).alias("y"), (F.col("l_extendedprice") / 10000.0).alias("yh"), scenario.alias("scenario"), (F.col("l_linenumber").cast("double") / 10).alias("fraction"),
    )


METRICS = CLASSED + """, ag AS (SELECT scenario, fraction, count(*) AS n, avg(CAST(t = p AS INTEGER)) AS accuracy, avg(abs(y - yh)) AS mae, covar_pop(y, yh) / nullif(stddev_pop(y) * stddev_pop(yh), 0) AS pearson, """ + ", ".join(f"count(*) FILTER (WHERE t = {c} AND p = {c}) AS tp{c}, count(*) FILTER (WHERE t = {c}) AS s{c}, count(*) FILTER (WHERE p = {c}) AS p{c}" for c in (0, 1, 2)) + """ FROM cl GROUP BY ALL),
f1 AS (SELECT *, coalesce(2.0 * tp0 / nullif(s0 + p0, 0), 0) AS f0, coalesce(2.0 * tp1 / nullif(s1 + p1, 0), 0) AS f1, coalesce(2.0 * tp2 / nullif(s2 + p2, 0), 0) AS f2 FROM ag),
mt AS (SELECT scenario, fraction, n, accuracy, (f0 + f1 + f2) / 3 AS macro_f1, (f0 * s0 + f1 * s1 + f2 * s2) / greatest(n, 1) AS weighted_f1, mae, pearson, f0 AS f1_0, f1 AS f1_1, f2 AS f1_2, (accuracy + (f0 + f1 + f2) / 3 + (1 - mae / 6) + (pearson + 1) / 2) / 4 AS composite FROM f1)
"""
NUMBERS = ("accuracy", "macro_f1", "weighted_f1", "mae", "pearson", "f1_0", "f1_1", "f1_2", "composite")


def measured(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.classification(classed(spark, sf_dir), "t", "p", "y", "yh", ["scenario", "fraction"])


@query(CLASSED + ", k AS (SELECT unnest([0, 1, 2]) AS c), cr AS (SELECT a.c AS t, b.c AS p, s.scenario FROM k a, k b, (SELECT DISTINCT scenario FROM cl) s) SELECT cr.scenario, CAST(cr.t AS INTEGER) AS true_class, CAST(cr.p AS INTEGER) AS predicted_class, CAST(count(cl.t) AS BIGINT) AS count FROM cr LEFT JOIN cl ON cr.t = cl.t AND cr.p = cl.p AND cr.scenario = cl.scenario GROUP BY ALL")
def confusion_matrix_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.confusion(classed(spark, sf_dir), "t", "p", ["scenario"])


@query(METRICS + "SELECT scenario, CAST(n AS BIGINT) AS n, " + ", ".join(f"round({c}, 6) AS {c}" for c in NUMBERS) + " FROM mt")
def classification_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measured(spark, sf_dir).select("scenario", "n", *[r6(c).alias(c) for c in NUMBERS])


@query("SELECT l_linestatus, round(covar_pop(l_quantity, l_extendedprice) / nullif(stddev_pop(l_quantity) * stddev_pop(l_extendedprice), 0), 6) AS r, round(covar_pop(l_quantity, 1.0) / nullif(stddev_pop(l_quantity) * 0.0, 0), 6) AS r_constant FROM lineitem GROUP BY 1")
def pearson_guarded(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem").select("l_linestatus", "l_quantity", "l_extendedprice", F.lit(1.0).alias("one"))
    return rows.groupBy("l_linestatus").agg(r6(metrics.pearson("l_quantity", "l_extendedprice")).alias("r"), r6(metrics.pearson("l_quantity", "one")).alias("r_constant"))


@query(METRICS + "SELECT round(max(macro_f1) FILTER (WHERE scenario = 'complete'), 6) AS complete_f1, round(avg(macro_f1) FILTER (WHERE scenario <> 'complete'), 6) AS masked_f1, round(max(f1_1) FILTER (WHERE scenario = 'complete'), 6) AS neutral_f1, round(min(macro_f1) FILTER (WHERE scenario <> 'complete' AND fraction = (SELECT max(fraction) FROM mt)), 6) AS stress_f1, round(0.45 * max(macro_f1) FILTER (WHERE scenario = 'complete') + 0.30 * avg(macro_f1) FILTER (WHERE scenario <> 'complete') + 0.15 * max(f1_1) FILTER (WHERE scenario = 'complete') + 0.10 * min(macro_f1) FILTER (WHERE scenario <> 'complete' AND fraction = (SELECT max(fraction) FROM mt)), 6) AS priority FROM mt")
def composite_and_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.priority(measured(spark, sf_dir)).select(*[r6(c).alias(c) for c in ("complete_f1", "masked_f1", "neutral_f1", "stress_f1", "priority")])


@query(METRICS + "SELECT m.scenario, round(m.accuracy - c.accuracy, 6) AS d_accuracy, round(m.macro_f1 - c.macro_f1, 6) AS d_macro_f1, round(m.mae - c.mae, 6) AS d_mae FROM mt m, (SELECT * FROM mt WHERE scenario = 'complete') c WHERE m.scenario <> 'complete'")
def missing_impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = measured(spark, sf_dir)
    base = m.where("scenario = 'complete'").select(*[F.col(c).alias(f"c_{c}") for c in ("accuracy", "macro_f1", "mae")])
    rows = m.where("scenario <> 'complete'").crossJoin(F.broadcast(base))  # one row
    return rows.select("scenario", *[r6(F.col(c) - F.col(f"c_{c}")).alias(f"d_{c}") for c in ("accuracy", "macro_f1", "mae")])


@query("SELECT CAST(max_by(o_orderstatus, n * 10 - k) AS VARCHAR) AS majority, round(sum(total) / sum(n), 6) AS mean FROM (SELECT o_orderstatus, count(*) AS n, sum(o_totalprice) AS total, CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END AS k FROM orders GROUP BY 1)")
def majority_mean_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2)
    each = read(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("total")).withColumn("k", k)
    return each.agg(F.max_by("o_orderstatus", F.col("n") * 10 - F.col("k")).alias("majority"), r6(F.sum("total") / F.sum("n")).alias("mean"))


@query("WITH c AS (SELECT k AS class, greatest(count(l_returnflag), 1) AS n FROM (SELECT unnest([0, 1, 2]) AS k) LEFT JOIN lineitem ON CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END = k GROUP BY 1) SELECT 'sqrt_inverse' AS mode, CAST(class AS INTEGER) AS class, CAST(n AS BIGINT) AS n, round((1 / sqrt(n)) / avg(1 / sqrt(n)) OVER (), 6) AS weight FROM c UNION ALL SELECT 'inverse', CAST(class AS INTEGER), CAST(n AS BIGINT), round((1.0 / n) / avg(1.0 / n) OVER (), 6) FROM c UNION ALL SELECT 'effective', CAST(class AS INTEGER), CAST(n AS BIGINT), round(((1 - 0.9999) / (1 - pow(0.9999, n))) / avg((1 - 0.9999) / (1 - pow(0.9999, n))) OVER (), 6) FROM c")
def class_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem").select(F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2).alias("t"))
    out = [metrics.class_weights(rows, "t", (0, 1, 2), m).select(F.lit(m).alias("mode"), "class", "n", r6("weight").alias("weight")) for m in ("sqrt_inverse", "inverse", "effective")]
    return out[0].union(out[1]).union(out[2])


@query("WITH c AS (SELECT toxic, lang, count(*) AS n, min(doc_id) AS f FROM documents JOIN labels USING (doc_id) GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY toxic ORDER BY n DESC, f) AS k FROM c) SELECT toxic, lang AS mode, CAST(n AS BIGINT) AS n FROM r WHERE k = 1")
def label_mode_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = read(spark, sf_dir, "documents").select("doc_id", "lang").join(read(spark, sf_dir, "labels").select("doc_id", "toxic"), "doc_id").groupBy("toxic", "lang").agg(F.count("*").alias("n"), F.min("doc_id").alias("f"))
    top = F.max_by(F.struct("lang", "n"), F.struct("n", -F.col("f")))
    return each.groupBy("toxic").agg(top.alias("x")).select("toxic", F.col("x.lang").alias("mode"), F.col("x.n").alias("n"))


# ---- text ------------------------------------------------------------------------------------------------------------

TOKENS = "regexp_extract_all(text, '[A-Za-z0-9]+(?:[''’\\-][A-Za-z0-9]+)*')"
KEY = "replace(regexp_replace(translate(lower(trim(w)), '‘’‐‑–—', '''''----'), '[^a-z0-9'']+', '', 'g'), '''', '')"
SAME = "CASE {k} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in T.EQUIVALENTS.items()) + " ELSE {k} END"


@query(f"WITH t AS (SELECT conv_id, turn, unnest({TOKENS}) AS w FROM conversations) SELECT regexp_replace(translate(lower(trim(w)), '‘’‐‑–—', '''''----'), '[^a-z0-9'']+', '', 'g') AS token, CAST(count(*) AS BIGINT) AS n FROM t GROUP BY 1")
def normalize_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = read(spark, sf_dir, "conversations").select(F.explode(T.tokenize(F.col("text"))).alias("w"))
    return words.groupBy(T.normalize_token(F.col("w")).alias("token")).agg(F.count("*").alias("n"))


@query(f"WITH t AS (SELECT unnest({TOKENS}) AS w FROM documents), k AS (SELECT {KEY} AS k FROM t) SELECT {SAME.format(k='k')} AS key, CAST(count(*) AS BIGINT) AS n FROM k GROUP BY 1")
def match_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = read(spark, sf_dir, "documents").select(F.explode(T.tokenize(F.col("text"))).alias("w")).groupBy("w").agg(F.count("*").alias("n"))  # each spelling is normalised once
    return words.groupBy(T.match_key(F.col("w"), T.EQUIVALENTS).alias("key")).agg(F.sum("n").alias("n"))


@query(f"WITH t AS (SELECT conv_id, role, unnest({TOKENS}) AS w FROM conversations), p AS (SELECT conv_id, role, {KEY} AS k FROM t), k AS (SELECT DISTINCT conv_id, role, {SAME.format(k='k')} AS k FROM p), u AS (SELECT conv_id, k FROM k WHERE role = 'user' AND k <> ''), a AS (SELECT conv_id, k FROM k WHERE role = 'assistant' AND k <> '') SELECT u.conv_id, CAST(count(*) FILTER (WHERE levenshtein(u.k, a.k) / greatest(length(u.k), length(a.k), 1) <= 0.34) AS BIGINT) AS similar, CAST(count(*) FILTER (WHERE u.k = a.k) AS BIGINT) AS equal FROM u JOIN a USING (conv_id) GROUP BY 1")
def edit_similarity_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = read(spark, sf_dir, "conversations").select("conv_id", "role", F.explode(T.tokenize(F.col("text"))).alias("w"))
    keys = words.select("conv_id", "role", T.match_key(F.col("w"), T.EQUIVALENTS).alias("k")).where("k <> ''").distinct().withColumn("size", F.length("k"))
    # words of lengths that differ by more than the ratio can't be similar: each word looks only for the lengths that can
    reach = F.sequence(F.ceil(F.col("size") * 0.66 - 1e-9).cast("int"), F.floor(F.col("size") / 0.66 + 1e-9).cast("int"))
    u = keys.where("role = 'user'").select("conv_id", F.col("k").alias("uk"), F.explode(reach).alias("size"))
    a = keys.where("role = 'assistant'").select("conv_id", "size", F.col("k").alias("ak"))
    found = u.join(a, ["conv_id", "size"]).groupBy("conv_id").agg(F.count_if(T.similar_enough(F.col("uk"), F.col("ak"), 0.34)).alias("similar"), F.count_if(F.col("uk") == F.col("ak")).alias("equal"))
    both = keys.groupBy("conv_id").agg(F.count_if(F.col("role") == "user").alias("x"), F.count_if(F.col("role") == "assistant").alias("y")).where("x > 0 and y > 0").select("conv_id")
    return both.join(found, "conv_id", "left").select("conv_id", F.coalesce("similar", F.lit(0)).alias("similar"), F.coalesce("equal", F.lit(0)).alias("equal"))


@query()
def monotonic_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    conv = read(spark, sf_dir, "conversations")
    turns = [conv.where(F.col("role") == r).groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), " ").alias(r)) for r in ("user", "assistant")]
    both = turns[0].join(turns[1], "conv_id").select("conv_id", T.tokenize(F.col("user")).alias("target"), T.tokenize(F.col("assistant")).alias("source"))
    return alignment.align(both, "conv_id", "target", "source", 0.34)


@query(f"WITH t AS (SELECT conv_id, turn, unnest({TOKENS}) AS w, unnest(range(len({TOKENS}))) AS pos, len({TOKENS}) AS n FROM conversations) SELECT CAST(least(9, pos * 10 // n) AS BIGINT) AS pos_bin, CAST(least(9, turn) AS BIGINT) AS turn_bin, round(avg(length(w)), 6) AS mean_length, CAST(count(*) AS BIGINT) AS n FROM t GROUP BY ALL")
def word_position_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = read(spark, sf_dir, "conversations").select("turn", T.tokenize(F.col("text")).alias("all"))
    words = words.select("turn", F.inline(F.transform("all", lambda w, i: F.struct(i.alias("pos"), F.size("all").alias("k"), w.alias("w")))))  # a count beside an explode is taken anew for each word
    bins = words.select(long(F.least(F.lit(9), F.floor(F.col("pos") * 10 / F.col("k")))).alias("pos_bin"), long(F.least(F.lit(9), "turn")).alias("turn_bin"), "w")
    return bins.groupBy("pos_bin", "turn_bin").agg(r6(F.avg(F.length("w"))).alias("mean_length"), F.count("*").alias("n"))


@query("WITH c AS (SELECT user_id, event_id, ts FROM events WHERE event_type = 'purchase'), v AS (SELECT user_id, ts, value FROM events WHERE event_type = 'view') SELECT c.user_id, c.event_id, round(b.value, 6) AS before, round(f.value, 6) AS after FROM c ASOF LEFT JOIN v b ON c.user_id = b.user_id AND c.ts >= b.ts ASOF LEFT JOIN v f ON c.user_id = f.user_id AND c.ts <= f.ts")
def token_char_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = read(spark, sf_dir, "events")
    c, v = ev.where("event_type = 'purchase'").select("user_id", "event_id", "ts"), ev.where("event_type = 'view'").select("user_id", "ts", "value")
    before = sequences.as_of(c, v, ["user_id"], "ts", "value").withColumnRenamed("value", "before")
    both = sequences.as_of(before, v, ["user_id"], "ts", "value", forward=True)
    return both.select("user_id", "event_id", r6("before").alias("before"), r6("value").alias("after"))


@query(EV + ", m AS (SELECT *, event_type IN ('click', 'view') AS matched FROM ev), p AS (SELECT user_id, event_id, s0, matched, last_value(CASE WHEN matched THEN least(e0, 2592000.0) END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY s0, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS l, first_value(CASE WHEN matched THEN s0 END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY s0, event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS r, row_number() OVER (PARTITION BY user_id, matched ORDER BY s0, event_id) - 1 AS k, count(*) OVER (PARTITION BY user_id, matched) AS g FROM m), f AS (SELECT user_id, event_id, coalesce(l, 0.0) AS l, greatest(coalesce(r, 2592000.0), coalesce(l, 0.0)) AS r, k, g FROM p WHERE NOT matched) SELECT user_id, event_id, CASE WHEN v THEN round(x, 4) END AS start, CASE WHEN v THEN round(y, 4) END AS stop FROM (SELECT *, CAST(CAST(y AS FLOAT) AS DOUBLE) - CAST(CAST(x AS FLOAT) AS DOUBLE) >= 0.01 AS v FROM (SELECT user_id, event_id, l + (r - l) * k / g AS x, l + (r - l) * (k + 1) / g AS y FROM f))")
def fallback_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spans(spark, sf_dir).withColumn("matched", F.col("event_type").isin("click", "view"))
    return alignment.fallback(rows, "user_id", ["s0", "event_id"], "s0", "e0", "matched", DURATION).select("user_id", "event_id", F.round("start", 4).alias("start"), F.round("stop", 4).alias("stop"))


# ---- rules, audits, sources ------------------------------------------------------------------------------------------


@query("WITH l AS (SELECT l_orderkey, sum(l_extendedprice) AS total, count(*) AS n, max(l_tax) AS tax FROM lineitem GROUP BY 1), j AS (SELECT o_orderkey, o_totalprice, total, n, tax, CASE WHEN total > 0 THEN o_totalprice - total ELSE 0 END AS gap FROM orders LEFT JOIN l ON o_orderkey = l_orderkey) SELECT o_orderkey, round(gap, 4) AS gap, concat_ws(';', CASE WHEN abs(gap) > 1000 THEN 'gap' END, CASE WHEN total IS NULL THEN 'no_lines' END, CASE WHEN tax > 0.07 THEN 'tax' END, CASE WHEN n > 6 THEN 'many' END) AS issues FROM j")
def endpoint_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sum("l_extendedprice").alias("total"), F.count("*").alias("n"), F.max("l_tax").alias("tax"))
    rows = read(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    gap = F.when(F.col("total") > 0, F.col("o_totalprice") - F.col("total")).otherwise(0)
    issues = F.concat_ws(";", F.when(F.abs(gap) > 1000, "gap"), F.when(F.col("total").isNull(), "no_lines"), F.when(F.col("tax") > 0.07, "tax"), F.when(F.col("n") > 6, "many"))
    return rows.select("o_orderkey", F.round(gap, 4).alias("gap"), issues.alias("issues"))


@query("WITH r AS (SELECT user_id, count(*) AS n, avg(CAST(event_type NOT IN ('click', 'view') AS INTEGER)) AS ratio, count(*) FILTER (WHERE value < 1) AS bad FROM events GROUP BY 1) SELECT user_id, round(ratio, 6) AS ratio, CASE WHEN ratio >= 0.999999 THEN 'empty_or_mismatch' WHEN ratio >= 0.5 THEN 'high_fallback' WHEN bad > 0 THEN 'partial' ELSE 'normal' END AS status FROM r")
def review_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = read(spark, sf_dir, "events").groupBy("user_id").agg(F.avg((~F.col("event_type").isin("click", "view")).cast("int")).alias("ratio"), F.count_if(F.col("value") < 1).alias("bad"))
    status = F.when(F.col("ratio") >= 0.999999, "empty_or_mismatch").when(F.col("ratio") >= 0.5, "high_fallback").when(F.col("bad") > 0, "partial").otherwise("normal")
    return r.select("user_id", r6("ratio").alias("ratio"), status.alias("status"))


@query(DENSE + ", c AS (SELECT user_id, event_type, avg(CAST(mask AS INTEGER)) AS v FROM dn GROUP BY ALL), s AS (SELECT event_type, CASE WHEN v = 0 THEN 'missing' WHEN v < 0.2 THEN 'degraded' ELSE 'ok' END AS status FROM c) SELECT event_type, status, CAST(count(*) AS BIGINT) AS n FROM s GROUP BY ALL")
def modality_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = dense(spark, sf_dir).groupBy("user_id", "event_type").agg(F.avg(F.col("mask").cast("int")).alias("v"))
    status = F.when(F.col("v") == 0, "missing").when(F.col("v") < 0.2, "degraded").otherwise("ok")
    return v.groupBy("event_type", status.alias("status")).agg(F.count("*").alias("n"))


@query("WITH l AS (SELECT l_orderkey, sum(l_discount) AS d, sum(l_tax) AS t FROM lineitem GROUP BY 1) SELECT o_orderkey, round(CASE WHEN d > 0 THEN d WHEN t > 0 THEN t WHEN o_totalprice > 0 THEN o_totalprice END, 6) AS duration, CASE WHEN d > 0 THEN 'discount' WHEN t > 0 THEN 'tax' WHEN o_totalprice > 0 THEN 'price' ELSE 'none' END AS chosen FROM orders LEFT JOIN l ON o_orderkey = l_orderkey")
def duration_precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sum("l_discount").alias("d"), F.sum("l_tax").alias("t"))
    rows = read(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    value, name = T.first_positive(("discount", F.col("d")), ("tax", F.col("t")), ("price", F.col("o_totalprice")))
    return rows.select("o_orderkey", r6(value).alias("duration"), name.alias("chosen"))


@query("WITH l AS (SELECT l_orderkey, round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) AS total FROM lineitem GROUP BY 1), j AS (SELECT coalesce(o_orderkey, l_orderkey) AS k, CAST(round(o_totalprice, 2) AS DOUBLE) AS a, total AS b FROM orders FULL JOIN l ON o_orderkey = l_orderkey) SELECT CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (WHERE NOT coalesce(abs(a - b) <= 1e-5, a IS NULL AND b IS NULL)) AS BIGINT) AS different, CAST(count(*) FILTER (WHERE a IS NULL OR b IS NULL) AS BIGINT) AS unmatched, round(max(abs(a - b)), 2) AS largest_gap FROM j")
def cross_table_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax"))), 2).alias("b"))
    rows = read(spark, sf_dir, "orders").select("o_orderkey", F.round("o_totalprice", 2).alias("a")).join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "full")
    same = T.cell_equal(F.col("a"), F.col("b"))
    return rows.agg(F.count("*").alias("n"), F.count_if(~same).alias("different"), F.count_if(F.col("a").isNull() | F.col("b").isNull()).alias("unmatched"), F.round(F.max(F.abs(F.col("a") - F.col("b"))), 2).alias("largest_gap"))


@query(EV + "SELECT 'non_positive' AS rule, CAST(count(*) FILTER (WHERE e0 <= s0) AS BIGINT) AS violations FROM ev UNION ALL SELECT 'out_of_range', CAST(count(*) FILTER (WHERE s0 < -1e-6 OR e0 > 2592000.0 + 1e-4) AS BIGINT) FROM ev UNION ALL SELECT 'duplicate_id', CAST(count(*) - count(DISTINCT event_id) AS BIGINT) FROM ev UNION ALL SELECT 'wrong_length', CAST(count(*) FILTER (WHERE len(embedding) <> 64) AS BIGINT) FROM embeddings UNION ALL SELECT 'missing_channel', CAST(count(*) AS BIGINT) FROM (SELECT unnest(['click', 'view', 'purchase']) AS c EXCEPT SELECT event_type FROM events)")
def artifact_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = spans(spark, sf_dir).agg(F.count_if(F.col("e0") <= F.col("s0")).alias("non_positive"), F.count_if((F.col("s0") < -1e-6) | (F.col("e0") > DURATION + 1e-4)).alias("out_of_range"), (F.count("*") - F.count_distinct("event_id")).alias("duplicate_id"))
    s = s.select(F.expr("stack(3, 'non_positive', non_positive, 'out_of_range', out_of_range, 'duplicate_id', duplicate_id) AS (rule, violations)"))
    v = read(spark, sf_dir, "embeddings").agg(F.lit("wrong_length").alias("rule"), F.count_if(F.size("embedding") != 64).alias("violations"))
    needed = spark.range(1).select(F.explode(F.array(*[F.lit(c) for c in CHANNELS])).alias("event_type"))
    missing = needed.join(read(spark, sf_dir, "events").select("event_type").distinct(), "event_type", "left_anti").agg(F.lit("missing_channel").alias("rule"), F.count("*").alias("violations"))
    return s.union(v).union(missing)


@query("WITH s AS (SELECT lang AS split, source AS id FROM documents GROUP BY ALL) SELECT a.split AS left_split, b.split AS right_split, CAST(count(*) AS BIGINT) AS shared FROM s a JOIN s b ON a.id = b.id AND a.split < b.split GROUP BY ALL")
def split_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = read(spark, sf_dir, "documents").select("lang", "source").distinct()
    a, b = s.select(F.col("lang").alias("left_split"), "source"), s.select(F.col("lang").alias("right_split"), "source")
    return a.join(b, "source").where("left_split < right_split").groupBy("left_split", "right_split").agg(F.count("*").alias("shared"))


@query("SELECT doc_id, lang, quality, coalesce(CASE toxic WHEN 1 THEN 'Negative' WHEN 0 THEN 'Positive' END, 'unlabelled') AS annotation FROM documents LEFT JOIN labels USING (doc_id)")
def label_left_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "documents").select("doc_id", "lang").join(read(spark, sf_dir, "labels"), "doc_id", "left")
    return rows.select("doc_id", "lang", "quality", F.coalesce(F.when(F.col("toxic") == 1, "Negative").when(F.col("toxic") == 0, "Positive"), F.lit("unlabelled")).alias("annotation"))


@query("SELECT doc_id, source, quality, toxic, (SELECT CAST(count(*) AS BIGINT) FROM labels ANTI JOIN documents USING (doc_id)) AS unmatched FROM labels JOIN documents USING (doc_id)")
def label_total_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels, docs = read(spark, sf_dir, "labels"), read(spark, sf_dir, "documents").select("doc_id", "source")
    missing = labels.join(docs, "doc_id", "left_anti").agg(F.count("*").alias("unmatched"))
    return labels.join(docs, "doc_id").crossJoin(F.broadcast(missing)).select("doc_id", "source", "quality", "toxic", "unmatched")  # one row


@query("SELECT source, CAST(row_number() OVER (ORDER BY regexp_extract(source, '^[^0-9]*') NULLS FIRST, CAST(nullif(regexp_extract(source, '[0-9]+$'), '') AS HUGEINT) NULLS FIRST) AS BIGINT) AS place, CAST(n AS BIGINT) AS n FROM (SELECT source, count(*) AS n FROM documents GROUP BY 1)")
def natural_sort_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n"))
    return rows.select("source", long(F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(T.natural_key(F.col("source"))))).alias("place"), "n")


@query("SELECT lang, doc_id, CAST(r AS BIGINT) AS place FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS r FROM documents) WHERE r <= 5")
def limit_per_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "documents").select("lang", "doc_id").withColumn("place", long(F.row_number().over(Window.partitionBy("lang").orderBy("doc_id"))))
    return rows.where("place <= 5")


@query("WITH r AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS r, count(*) OVER (PARTITION BY user_id) AS n FROM events) SELECT user_id, event_id, CAST(r AS BIGINT) AS place FROM r WHERE r IN (SELECT unnest([0])) OR r = n - 1 OR r = CAST(round_even((n - 1) / 3.0, 0) AS BIGINT) OR r = CAST(round_even(2 * (n - 1) / 3.0, 0) AS BIGINT)")
def evenly_spaced_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    order, every = Window.partitionBy("user_id").orderBy("ts", "event_id"), Window.partitionBy("user_id")
    rows = read(spark, sf_dir, "events").select("user_id", "event_id", "ts").withColumn("place", long(F.row_number().over(order) - 1)).withColumn("n", F.count("*").over(every))
    hit = F.lit(False)
    for i in range(4):
        hit = hit | (F.col("place") == F.rint(i * (F.col("n") - 1) / 3.0).cast("long"))
    return rows.where(hit).select("user_id", "event_id", "place")


@query("SELECT vec_id, CAST(list_position(embedding, list_max(embedding)) - 1 AS BIGINT) AS top, round(CAST(list_max(embedding) AS DOUBLE), 6) AS value FROM embeddings")
def argmax_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = F.array_max("embedding")
    return read(spark, sf_dir, "embeddings").select("vec_id", (F.array_position("embedding", top) - 1).cast("long").alias("top"), r6(top.cast("double")).alias("value"))


@query("WITH u AS (SELECT user_id, avg(value) AS q, count(*) AS n FROM events GROUP BY 1), m AS (SELECT quantile_cont(q, 0.5) AS mq, quantile_cont(n, 0.5) AS mn FROM u), d AS (SELECT user_id, abs(q - mq) + 0.5 * abs(n - mn) / greatest(mn, 1) AS d FROM u, m) SELECT user_id, round(d, 6) AS distance FROM d ORDER BY d, user_id LIMIT 1")
def typical_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = read(spark, sf_dir, "events").groupBy("user_id").agg(F.avg("value").alias("q"), F.count("*").alias("n"))
    m = u.agg(F.percentile("q", 0.5).alias("mq"), F.percentile("n", 0.5).alias("mn"))
    d = F.abs(F.col("q") - F.col("mq")) + 0.5 * F.abs(F.col("n") - F.col("mn")) / F.greatest("mn", F.lit(1.0))
    rows = u.crossJoin(F.broadcast(m)).withColumn("d", d)  # one row
    return rows.agg(F.min_by(F.struct("user_id", "d"), F.struct("d", "user_id")).alias("x")).select("x.user_id", r6("x.d").alias("distance"))


@query("WITH x AS (SELECT unnest(embedding) AS x FROM embeddings) SELECT CAST(least(19, greatest(0, floor((CAST(x AS DOUBLE) + 0.5) * 20))) AS BIGINT) AS bucket, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (WHERE x < 0) AS BIGINT) AS negative, CAST(count(*) FILTER (WHERE x = 0) AS BIGINT) AS zero, CAST(count(*) FILTER (WHERE x > 0) AS BIGINT) AS positive FROM x GROUP BY 1")
def histogram_signs(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = read(spark, sf_dir, "embeddings").select(F.explode("embedding").alias("x"))
    bucket = long(F.least(F.lit(19), F.greatest(F.lit(0), F.floor((F.col("x").cast("double") + 0.5) * 20))))
    return x.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"), F.count_if(F.col("x") < 0).alias("negative"), F.count_if(F.col("x") == 0).alias("zero"), F.count_if(F.col("x") > 0).alias("positive"))


@query("SELECT s_suppkey AS key, s_name AS name, s_nationkey AS nation, CAST(NULL AS VARCHAR) AS segment FROM supplier UNION ALL SELECT c_custkey, c_name, c_nationkey, c_mktsegment FROM customer")
def union_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = read(spark, sf_dir, "supplier").selectExpr("s_suppkey AS key", "s_name AS name", "s_nationkey AS nation")
    c = read(spark, sf_dir, "customer").selectExpr("c_custkey AS key", "c_name AS name", "c_nationkey AS nation", "c_mktsegment AS segment")
    return s.unionByName(c, allowMissingColumns=True)


@query("SELECT n_nationkey AS nation FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000")
def required_except(spark: SparkSession, sf_dir: str) -> DataFrame:
    has = read(spark, sf_dir, "supplier").where("s_acctbal > 5000").select(F.col("s_nationkey").alias("nation"))
    return read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("nation")).distinct().join(has, "nation", "left_anti")


BOX = "least(embedding[1], embedding[3]) AS x0, least(embedding[2], embedding[4]) AS y0, greatest(embedding[1], embedding[3]) AS x1, greatest(embedding[2], embedding[4]) AS y1"


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = [F.col("embedding")[i].cast("double") for i in range(4)]
    return read(spark, sf_dir, "embeddings").select("vec_id", "label", F.least(e[0], e[2]).alias("x0"), F.least(e[1], e[3]).alias("y0"), F.greatest(e[0], e[2]).alias("x1"), F.greatest(e[1], e[3]).alias("y1"))


@query(f"WITH d AS (SELECT vec_id, label, [CAST(v AS DOUBLE) FOR v IN embedding] AS embedding FROM embeddings), b AS (SELECT vec_id, label, {BOX} FROM d), n AS (SELECT *, lead(vec_id) OVER w AS other, lead(x0) OVER w AS a0, lead(y0) OVER w AS b0, lead(x1) OVER w AS a1, lead(y1) OVER w AS b1 FROM b WINDOW w AS (PARTITION BY label ORDER BY vec_id)), i AS (SELECT *, greatest(least(x1, a1) - greatest(x0, a0), 0.0) * greatest(least(y1, b1) - greatest(y0, b0), 0.0) AS inter FROM n WHERE other IS NOT NULL) SELECT vec_id, other, round(inter / greatest((x1 - x0) * (y1 - y0) + (a1 - a0) * (b1 - b0) - inter, 1e-12), 6) AS iou FROM i")
def box_iou_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("label").orderBy("vec_id")
    rows = boxes(spark, sf_dir).withColumns({f"n_{c}": F.lead(c).over(w) for c in ("vec_id", "x0", "y0", "x1", "y1")}).where("n_vec_id is not null")
    return rows.select("vec_id", F.col("n_vec_id").alias("other"), r6(alignment.iou([F.col(c) for c in ("x0", "y0", "x1", "y1")], [F.col(f"n_{c}") for c in ("x0", "y0", "x1", "y1")])).alias("iou"))


@query()
def greedy_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = boxes(spark, sf_dir).withColumn("frame", (F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) / 3).cast("int"))
    return alignment.tracks(rows.withColumn("confidence", F.abs("x1")), "label", "frame", "vec_id", "confidence", 0.1, 5)


@query("SELECT doc_id, sha256(text) AS content_hash, lower(concat_ws('/', source, lang)) AS name FROM documents")
def content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("content_hash"), F.lower(F.concat_ws("/", "source", "lang")).alias("name"))


@query("SELECT event_type, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS total, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY 1")
def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.from_json("props", "k bigint")["k"]
    return read(spark, sf_dir, "events").groupBy("event_type").agg(F.sum(k).alias("total"), F.count("*").alias("n"))


@query("SELECT vec_id, CAST(label AS BIGINT) AS label, round(1 / (1 + exp(-list_sum([CAST(v AS DOUBLE) FOR v IN embedding]))), 6) AS score FROM embeddings")
def score_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.score_batches(read(spark, sf_dir, "embeddings"), "vec_id", "embedding", [1.0] * 64).join(read(spark, sf_dir, "embeddings").select("vec_id", long("label").alias("label")), "vec_id").select("vec_id", "label", r6("score").alias("score"))
