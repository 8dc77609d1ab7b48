"""Registered queries of scoring under many masks, models, training and resumable runs, with the SQL of those that SQL can state.

Users are samples with three channels on 50 bins; what they are asked for comes from their other events.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .catalog import BINS, CHANNELS, EV, _hash, long, pooled, query, r6, read
from .operators import evaluation, models, training
from .plans.folders import shared_folder
from .plans.runs import run_stages

SEEDS, FRACTIONS, POSITIONS = [2026, 42, 3407], [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.8], ["front", "middle", "back"]
FULL = {"validation_missing_fractions": FRACTIONS, "validation_missing_positions": POSITIONS, "validation_mask_seeds": SEEDS, "random_seeds": SEEDS}


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id, label, target) from the mean value of a user's events of other types.

    Decimals add up to the same mean in any order: one that is a class's bound stays it. Values that aren't decimals of this size are added as they are.
    """
    exact = F.col("value").try_cast("decimal(24,8)")
    mean = F.when(F.count("value") == F.count_if(exact.cast("double") == F.col("value")), F.avg(exact).cast("double")).otherwise(F.avg("value"))
    other = read(spark, sf_dir, "events").where(~F.col("event_type").isin(*CHANNELS)).groupBy("user_id").agg(mean.alias("y"))
    label = F.when(F.col("y") < 45.8, 0).when(F.col("y") > 53.6, 2).otherwise(1)
    return other.select("user_id", label.alias("label"), F.least(F.greatest((F.col("y") - 50.0) / 10.0, F.lit(-3.0)), F.lit(3.0)).alias("target"))


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id, features, masks, label, target)."""
    bins = pooled(spark, sf_dir).withColumn("v", F.col("value") / 50.0)
    packed = evaluation.pack_samples(bins, "user_id", "event_type", "bin", ["v"], CHANNELS, BINS)
    return packed.join(labelled(spark, sf_dir), "user_id")


def centroid_scorer(spark: SparkSession, sf_dir: str) -> models.NearestCentroid:
    """Class means of the complete view: one row a class."""
    bins = pooled(spark, sf_dir).where(F.col("event_type").isin(*CHANNELS))
    each = bins.groupBy("user_id").agg(*[F.coalesce(F.avg(F.when(F.col("event_type") == c, F.col("value") / 50.0)), F.lit(0.0)).alias(f"x{i}") for i, c in enumerate(CHANNELS)], *[(F.count_if(F.col("event_type") == c) / BINS).alias(f"x{i + 3}") for i, c in enumerate(CHANNELS)])
    rows = each.join(labelled(spark, sf_dir), "user_id").groupBy("label").agg(*[F.avg(f"x{i}").alias(f"x{i}") for i in range(6)], F.avg("target").alias("target")).orderBy("label").collect()
    return models.NearestCentroid([[r[f"x{i}"] for i in range(6)] for r in rows], [r["target"] for r in rows])


def full_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    scenarios = evaluation.configured(FULL, CHANNELS, "full")
    return evaluation.evaluate(samples(spark, sf_dir), centroid_scorer(spark, sf_dir), scenarios, 3, key="user_id")


GROUPS = ", ".join(f"('{'+'.join(CHANNELS[c] for c in g)}', {list(g)})" for g in evaluation.subsets(3))
SCENARIOS = EV + f""", lb0 AS (SELECT user_id, avg(value) AS y FROM events WHERE event_type NOT IN ('click', 'view', 'purchase') GROUP BY 1),
lb AS (SELECT user_id, CASE WHEN y < 45.8 THEN 0 WHEN y > 53.6 THEN 2 ELSE 1 END AS label, least(greatest((y - 50.0) / 10.0, -3.0), 3.0) AS target FROM lb0),
ft AS (SELECT user_id, CASE event_type WHEN 'click' THEN 0 WHEN 'view' THEN 1 ELSE 2 END AS no, bin, value / 50.0 AS v FROM pool WHERE event_type IN ('click', 'view', 'purchase') AND user_id IN (SELECT user_id FROM lb)),
av AS (SELECT user_id, no, count(*) AS m, list(bin ORDER BY bin) AS bs, list(v ORDER BY bin) AS vs FROM ft GROUP BY ALL),
gr(grp, nos) AS (VALUES {GROUPS}),
gd AS (SELECT grp, nos, CAST(f.f AS DOUBLE) AS fraction, p.p AS position, CASE WHEN len(nos) = 1 THEN 'single' ELSE r.r END AS relation, s.s AS seed FROM gr, (SELECT unnest({FRACTIONS}) AS f) f, (SELECT unnest({POSITIONS}) AS p) p, (SELECT unnest(['overlap', 'stagger']) AS r) r, (SELECT unnest({SEEDS}) AS s) s),
sn AS (SELECT DISTINCT *, concat_ws('__', grp, lpad(CAST(CAST(round_even(fraction * 100, 0) AS INTEGER) AS VARCHAR), 2, '0'), position, relation, 's' || seed) AS scenario FROM gd),
se AS (SELECT *, CASE WHEN relation = 'stagger' THEN scenario ELSE concat_ws('|', grp, fraction, position, relation) END AS effect FROM sn),
ef AS (SELECT effect, any_value(nos) AS nos, any_value(fraction) AS fraction, any_value(position) AS position, any_value(relation) AS relation FROM se GROUP BY 1),
mb AS (SELECT effect, fraction, position, relation, len(nos) AS size, unnest(nos) AS no, unnest(range(len(nos))) AS off FROM ef),
ct AS (SELECT mb.*, user_id, m, bs, vs, CASE WHEN m <= 1 THEN 0 ELSE least(m - 1, greatest(1, CAST(ceil(m * fraction) AS BIGINT))) END AS c,
       CASE WHEN relation = 'stagger' THEN off * ({_hash("effect", "user_id", "no")} % (50 // size + 1)) ELSE 0 END AS shift FROM mb JOIN av USING (no)),
bg AS (SELECT *, CASE position WHEN 'front' THEN 0 WHEN 'middle' THEN (m - c) // 2 ELSE m - c END AS b FROM ct),
kp AS (SELECT *, CASE WHEN c = 0 THEN range(1, m + 1) ELSE list_filter(range(1, m + 1), lambda i: bs[i] < bs[b + 1] + shift OR bs[i] >= bs[b + c] + 1 + shift) END AS k0 FROM bg),
kk AS (SELECT effect, user_id, no, m, bs, vs, CASE WHEN len(k0) = 0 THEN [1] ELSE k0 END AS ks FROM kp),
wh AS (SELECT 'whole' AS effect, user_id, 0 AS no, m, bs, vs, [] AS ks FROM av a WHERE no = 0 AND EXISTS (SELECT 1 FROM av o WHERE o.user_id = a.user_id AND o.no > 0)),
ms AS (SELECT * FROM kk UNION ALL SELECT * FROM wh),
st AS (SELECT effect, user_id, no, coalesce(list_sum([vs[i] for i in ks]) / nullif(len(ks), 0), 0) AS mean, len(ks) / 50.0 AS cov FROM ms),
base AS (SELECT user_id, no, list_sum(vs) / m AS mean, m / 50.0 AS cov FROM av),
es AS (SELECT effect FROM ef UNION ALL SELECT 'whole' UNION ALL SELECT 'complete'),
us AS (SELECT DISTINCT user_id FROM av),
xs AS (SELECT es.effect, us.user_id, {", ".join(f"coalesce(max(CASE WHEN b.no = {c} THEN coalesce(s.mean, b.mean) END), 0) AS x{c}, coalesce(max(CASE WHEN b.no = {c} THEN coalesce(s.cov, b.cov) END), 0) AS x{c + 3}" for c in range(3))}
       FROM es CROSS JOIN us JOIN base b USING (user_id) LEFT JOIN st s ON s.effect = es.effect AND s.user_id = us.user_id AND s.no = b.no GROUP BY ALL),
ce AS (SELECT label, {", ".join(f"avg(x{i}) AS c{i}" for i in range(6))}, avg(target) AS t FROM xs JOIN lb USING (user_id) WHERE effect = 'complete' GROUP BY 1),
ds AS (SELECT effect, user_id, ce.label AS k, ce.t, exp(-({" + ".join(f"(x{i} - c{i}) * (x{i} - c{i})" for i in range(6))})) AS w FROM xs, ce),
pr AS (SELECT effect, user_id, arg_max(k, w) AS p, sum(w * t) / sum(w) AS yh FROM ds GROUP BY ALL),
cl AS (SELECT effect, label AS t, p, target AS y, yh FROM pr JOIN lb USING (user_id)),
nm AS (SELECT scenario, grp, fraction, position, relation, CAST(seed AS BIGINT) AS seed, effect FROM se UNION ALL SELECT 'complete', '', 0.0, 'none', 'none', NULL, 'complete' UNION ALL SELECT 'click__whole__single__s2026', 'click', 1.0, 'whole', 'single', 2026, 'whole')
"""
SCENARIO_METRICS = SCENARIOS + """, ag AS (SELECT effect, count(*) AS n, avg(CAST(t = p AS INTEGER)) AS accuracy, avg(abs(y - yh)) AS mae, covar_pop(y, yh) / nullif(stddev_pop(y) * stddev_pop(yh), 0) AS pearson, """ + ", ".join(f"count(*) FILTER (WHERE t = {c} AND p = {c}) AS tp{c}, count(*) FILTER (WHERE t = {c}) AS s{c}, count(*) FILTER (WHERE p = {c}) AS p{c}" for c in (0, 1, 2)) + """ FROM cl GROUP BY ALL),
f1 AS (SELECT *, coalesce(2.0 * tp0 / nullif(s0 + p0, 0), 0) AS f0, coalesce(2.0 * tp1 / nullif(s1 + p1, 0), 0) AS f1, coalesce(2.0 * tp2 / nullif(s2 + p2, 0), 0) AS f2 FROM ag)
SELECT scenario, grp AS missing, fraction, position, relation, seed, CAST(n AS BIGINT) AS n, round(accuracy, 6) AS accuracy, round((f0 + f1 + f2) / 3, 6) AS macro_f1, round((f0 * s0 + f1 * s1 + f2 * s2) / greatest(n, 1), 6) AS weighted_f1, round(mae, 6) AS mae, round(pearson, 6) AS pearson,
       round((accuracy + (f0 + f1 + f2) / 3 + (1 - mae / 6) + (pearson + 1) / 2) / 4, 6) AS composite FROM nm JOIN f1 USING (effect)"""


@query(SCENARIO_METRICS)
def scenario_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of all users under the full grid of scenarios."""
    found = evaluation.metrics(full_sums(spark, sf_dir))
    names = F.when(F.col("grp") == "", "").otherwise(F.array_join(F.transform(F.split("grp", r"\+"), lambda c: F.element_at(F.array(*[F.lit(x) for x in CHANNELS]), c.cast("int") + 1)), "+"))
    return found.select("scenario", names.alias("missing"), "fraction", "position", "relation", "seed", "n", *[r6(c).alias(c) for c in ("accuracy", "macro_f1", "weighted_f1", "mae", "pearson", "composite")])


@query(SCENARIOS + " SELECT scenario, CAST(a.a AS INTEGER) AS true_class, CAST(b.b AS INTEGER) AS predicted_class, CAST(count(*) FILTER (WHERE t = a.a AND p = b.b) AS BIGINT) AS count FROM nm JOIN cl USING (effect), (SELECT unnest([0, 1, 2]) AS a) a, (SELECT unnest([0, 1, 2]) AS b) b GROUP BY ALL")
def scenario_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.confusion(full_sums(spark, sf_dir))


@query(SCENARIOS + """, gn AS (SELECT effect, user_id, no, m, list_filter(range(1, m + 1), lambda i: NOT list_contains(ks, i)) AS gs, bs FROM ms),
gb AS (SELECT *, [bs[i] for i in gs] AS lost FROM gn),
rl AS (SELECT effect, user_id, no, bin - row_number() OVER (PARTITION BY effect, user_id, no ORDER BY bin) AS island FROM (SELECT effect, user_id, no, unnest(lost) AS bin FROM gb)),
rn AS (SELECT effect, user_id, no, max(n) AS run FROM (SELECT effect, user_id, no, island, count(*) AS n FROM rl GROUP BY ALL) GROUP BY ALL),
pu AS (SELECT es.effect, us.user_id, c.c AS no, coalesce(av.m, 0) AS m, coalesce(len(g.lost), 0) AS lost, list_min(g.lost) AS a, list_max(g.lost) + 1 AS b, coalesce(rn.run, 0) AS run
       FROM es CROSS JOIN us CROSS JOIN (SELECT unnest([0, 1, 2]) AS c) c LEFT JOIN av ON av.user_id = us.user_id AND av.no = c.c LEFT JOIN gb g ON g.effect = es.effect AND g.user_id = us.user_id AND g.no = c.c LEFT JOIN rn ON rn.effect = es.effect AND rn.user_id = us.user_id AND rn.no = c.c)
SELECT scenario, CAST(no AS INTEGER) AS channel, CAST(sum(m) AS BIGINT) AS original, CAST(sum(m - lost) AS BIGINT) AS observed, CAST(count(*) FILTER (WHERE lost > 0) AS BIGINT) AS touched, CAST(min(a) AS BIGINT) AS start_min, CAST(max(a) AS BIGINT) AS start_max, CAST(min(b) AS BIGINT) AS stop_min, CAST(max(b) AS BIGINT) AS stop_max,
       round(avg(lost / greatest(m, 1)), 6) AS missing_mean, round(max(lost / greatest(m, 1)), 6) AS missing_max, round(avg(run / 50.0), 6) AS longest_mean, round(max(run / 50.0), 6) AS longest_max FROM nm JOIN pu USING (effect) GROUP BY ALL""")
def scenario_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = evaluation.mask_audit(full_sums(spark, sf_dir), 3)
    return rows.withColumns({c: r6(c) for c in ("missing_mean", "missing_max", "longest_mean", "longest_max")})


@query(SCENARIOS + ", hv AS (SELECT user_id, list(no) AS nos FROM av GROUP BY 1) SELECT scenario, seed, fraction, position, grp, relation, (SELECT CAST(count(*) AS BIGINT) FROM hv WHERE list_has_any(hv.nos, (SELECT any_value(nos) FROM gr WHERE gr.grp = nm.grp))) AS affected FROM nm")
def scenario_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every scenario of the full grid, with the users that have one of its channels. Users are counted by their channels first: eight sets at most."""
    listed = [(s.name, s.seed, s.fraction, s.position, "+".join(CHANNELS[c] for c in s.group), s.relation, [CHANNELS[c] for c in s.group]) for s in evaluation.configured(FULL, CHANNELS, "full")]
    frame = spark.createDataFrame(listed, "scenario string, seed long, fraction double, position string, grp string, relation string, members array<string>")
    users = samples(spark, sf_dir).select(F.filter(F.array(*[F.when(F.exists(F.col("masks")[i], lambda m: m), c) for i, c in enumerate(CHANNELS)]), lambda x: x.isNotNull()).alias("has")).groupBy("has").agg(F.count("*").alias("n"))
    counted = frame.crossJoin(F.broadcast(users)).groupBy("scenario").agg(F.sum(F.when(F.arrays_overlap("members", "has"), F.col("n")).otherwise(0)).alias("affected"))  # scenarios x at most eight sets
    return frame.drop("members").join(counted, "scenario").select("scenario", "seed", "fraction", "position", "grp", "relation", "affected")


SCHEDULE = training.Settings(epochs=30, curriculum=True)


@query(EV + f""", us AS (SELECT DISTINCT user_id FROM events), ep AS (SELECT e, CASE WHEN e <= 9 THEN 'warmup' WHEN e <= 21 THEN 'robust' ELSE 'transfer' END AS phase, CASE WHEN e <= 9 THEN 0.40::DOUBLE WHEN e <= 21 THEN 0.40::DOUBLE + (e - 9) / 12.0::DOUBLE * (0.75::DOUBLE - 0.40::DOUBLE) ELSE 0.75::DOUBLE END AS share, CASE WHEN e <= 9 THEN 0.30::DOUBLE WHEN e <= 21 THEN 0.30::DOUBLE + (e - 9) / 12.0::DOUBLE * (0.60::DOUBLE - 0.30::DOUBLE) ELSE 0.60::DOUBLE END AS most FROM range(1, 31) r(e))
SELECT CAST(e AS INTEGER) AS epoch, phase, round(share, 6) AS share, round(most, 6) AS most, CAST(count(*) FILTER (WHERE {_hash("7", "e", "'sample'", "user_id")} % 1000000 < round_even(share * 1000000, 0)) AS BIGINT) AS masked FROM ep, us GROUP BY ALL""")
def curriculum_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each epoch, its phase, share and largest fraction of masking, and how many users its draws hit."""
    from .operators.scenarios import draw

    epochs = spark.createDataFrame([(e, *training.phase(SCHEDULE, e), round(training.phase(SCHEDULE, e)[1] * 1_000_000)) for e in range(1, SCHEDULE.epochs + 1)], "epoch int, phase string, share double, most double, bar int")
    rows = read(spark, sf_dir, "events").select("user_id").distinct().crossJoin(F.broadcast(epochs))  # thirty rows
    hit = draw(7, F.col("epoch"), F.lit("sample"), "user_id", over=1_000_000) < F.col("bar")
    return rows.groupBy("epoch", "phase", "share", "most").agg(F.count_if(hit).alias("masked")).select("epoch", "phase", r6("share").alias("share"), r6("most").alias("most"), "masked")


@query("""WITH s AS (SELECT event_type AS run, CAST(date_diff('day', TIMESTAMP '2024-01-01', date_trunc('day', ts)) + 1 AS BIGINT) AS epoch, round(avg(value), 9) AS score FROM events GROUP BY ALL), b AS (SELECT *, max(score) OVER (PARTITION BY run ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM s),
g AS (SELECT *, before IS NULL OR score > before + 1e-8 AS better FROM b), c AS (SELECT *, max(CASE WHEN better THEN epoch END) OVER (PARTITION BY run ORDER BY epoch) AS best FROM g) SELECT run, epoch, better, best AS best_epoch, epoch - best AS waited, epoch - best >= 12 AS stopped FROM c""")
def early_stop_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which epoch of each run is the best so far, and when a patience of twelve is used up; days stand for epochs, mean values for scores."""
    day = F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")) + 1
    rows = read(spark, sf_dir, "events").groupBy(F.col("event_type").alias("run"), long(day).alias("epoch")).agg(F.round(F.avg("value"), 9).alias("score"))
    order = Window.partitionBy("run").orderBy("epoch")
    before = F.max("score").over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("better", before.isNull() | (F.col("score") > before + 1e-8)).withColumn("best_epoch", F.max(F.when(F.col("better"), F.col("epoch"))).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    waited = F.col("epoch") - F.col("best_epoch")
    return rows.select("run", "epoch", "better", "best_epoch", waited.alias("waited"), (waited >= 12).alias("stopped"))


@query()
def late_fusion_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class probabilities, intensities and mean gates of all users by the late fusion of drawn weights, read back from their table."""
    weights = models.weights_of(models.weight_table(spark, models.drawn(models.LateFusion.shapes([1, 1, 1], 8, 16), 5)))
    return evaluation.predict(samples(spark, sf_dir), models.LateFusion(weights, 3), 3, key="user_id")


def vector_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as samples: 64 numbers are three channels of four steps, of 8, 4 and 4 numbers each; ten labels are three classes."""
    cut = lambda start, width: F.array(*[F.slice("embedding", start + 1 + width * t, width) for t in range(4)])
    label = F.col("label") % 3
    rows = read(spark, sf_dir, "embeddings").where(F.size("embedding") == 64)
    return rows.select("vec_id", F.array(cut(0, 8), cut(32, 4), cut(48, 4)).alias("features"), F.array_repeat(F.array_repeat(F.lit(True), 4), 3).alias("masks"), label.alias("label"), ((label - 1) * 1.5).cast("double").alias("target"))


@query()
def train_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Epochs of a training on the embeddings, four fifths of them, scored on the rest under the compact grid."""
    rows = vector_samples(spark, sf_dir)
    held = F.pmod(F.xxhash64("vec_id"), F.lit(5)) == 0
    settings = training.Settings(epochs=5, parts=2, rate=0.01, hidden=32, curriculum=True)
    state = training.train(rows.where(~held), rows.where(held), [8, 4, 4], shared_folder(spark, "training"), settings, seed=11, scenarios=evaluation.configured({}, ["a", "b", "c"], "compact"), key="vec_id")
    return spark.createDataFrame([(h["epoch"], h["phase"], h["loss"], h["score"], h["better"]) for h in state.history], "epoch int, phase string, loss double, score double, better boolean")


@query(EV + ", cv AS (SELECT user_id, event_type, count(*) / 50.0 AS share FROM pool GROUP BY ALL) SELECT event_type, CAST(count(*) AS BIGINT) AS users, round(avg(share), 6) AS coverage FROM cv GROUP BY 1")
def staged_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coverage by channel in three stages, each kept: the second fails the first time, and the run that is begun again makes only what is left."""
    folder, tries = shared_folder(spark, "run"), []

    def shares(before: DataFrame) -> DataFrame:
        tries.append(1)
        if len(tries) == 1:
            raise OSError("the first attempt is lost")
        return before.groupBy("user_id", "event_type").agg((F.count("*") / BINS).alias("share"))

    stages = {
        "pool": lambda _: pooled(spark, sf_dir),
        "shares": shares,
        "summary": lambda before: before.groupBy("event_type").agg(F.count("*").alias("users"), r6(F.avg("share")).alias("coverage")),
    }
    try:
        run_stages(spark, folder, stages, {"bins": BINS}, seed=1)
    except OSError:
        return run_stages(spark, folder, stages, {"bins": BINS}, seed=1)
    raise AssertionError("the first attempt was to fail")


@query()
def gated_fusion_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same of the gated fusion with attention over time."""
    model = models.build({"type": "dynamic_gate", "input_dims": [1, 1, 1], "max_length": BINS, "projection_dim": 8, "attention_heads": 2, "feedforward_dim": 16}, seed=6)
    return evaluation.predict(samples(spark, sf_dir), model, 3, key="user_id")
