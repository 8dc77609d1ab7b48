"""Mixing sources to target weights with a low-discrepancy schedule, in DataFrame functions only.

1. Targets. Sources share all tokens by weight; a share stops at ``epochs`` times its source's
   size and the excess is dealt again by weight (water-filling, closed form over one row a source).
2. Schedule. The mix is a line of slots, as many as blocks of ``block`` tokens make up all tokens. Slot i draws
   its source from the point frac((i + 1) * golden ratio) through the cumulative targets. How many slots a source
   gets, and which, comes from these points alone: they are spread so evenly that a source is within a few blocks of its target.
   Slots are ranked within a source in schedule order by a two-level prefix count (chunks of slots, then within a chunk).
3. Blocks. Documents of a source are shuffled by hash and laid end to end, again and again up to
   ``epochs`` times; the stream is cut into blocks of ``block`` tokens. Slot with rank r takes
   block r of its source. The join key (source, r) spreads a hot source over all tasks, and prefix sums run
   over hash buckets of about ``bucket`` documents.

A document is taken as far as the blocks that slots took cover it, and it stands in the mix where the first of these slots does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, fresh, stash, table

WEIGHTS = (5.0, 2.0, 1.0)
#: Fractional part of the golden ratio, as a 32-bit fixed-point step (odd, so that all points differ).
GOLDEN = 2654435769
BLOCK = 16
#: Bits of the hash that shuffles documents.
HASH_BITS = 60


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, epochs: int = 3) -> DataFrame:
    """(s, size) per document -> (s, no, source_size, docs, weight, cap, target): one row a source, null last in order."""
    each = sizes.groupBy("s").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs"))
    order = Window.orderBy(F.col("s").asc_nulls_last())
    each = each.withColumn("no", F.row_number().over(order) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("no") % len(weights) + 1).cast("int"))
    each = each.withColumn("weight", weight).withColumn("cap", (F.col("source_size") * epochs).cast("double"))
    fill = Window.orderBy(F.col("cap") / F.col("weight"), "no")
    everything = F.sum("source_size").over(Window.partitionBy()).cast("double")
    before = F.coalesce(F.sum("cap").over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    heavy = F.sum("weight").over(fill.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    each = each.withColumn("level", (everything - before) / heavy).withColumn("fits", F.col("level") * F.col("weight") <= F.col("cap"))
    level = F.first(F.when(F.col("fits"), F.col("level")), ignorenulls=True).over(fill.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return each.withColumn("target", F.least("cap", F.coalesce(level * F.col("weight"), "cap"))).drop("level", "fits")


def schedule(goals: DataFrame, spark: SparkSession, block: int, step: int = GOLDEN) -> DataFrame:
    """Source goals (no, goal) -> slots (no, id, r): which source each slot draws, and its rank among that source's slots.

    The points of the slots are multiples of step modulo 2^32. Sources without a goal get no slot.
    """
    total = goals.agg(F.sum("goal")).first()[0] or 0
    slots = -(-int(total) // block)
    line = Window.orderBy("no")
    shares = goals.withColumn("hi", F.sum("goal").over(line) / F.lit(float(total or 1)))
    shares = shares.withColumn("lo", F.lag("hi", 1, 0.0).over(line))
    cells = 1024
    first, last = F.floor(F.col("lo") * cells), F.floor(F.least(F.col("hi"), F.lit(1 - 1e-12)) * cells)
    steps = shares.where("goal > 0").select("no", "lo", "hi", F.explode(F.sequence(first, last)).alias("cell"))
    point = F.pmod((F.col("id") + 1) * F.lit(step), F.lit(1 << 32)) / F.lit(float(1 << 32))
    chunk = 4096
    drawn = spark.range(slots).select("id", point.alias("u")).withColumn("cell", F.floor(F.col("u") * cells))
    drawn = drawn.join(steps, "cell").where("u >= lo and u < hi").select("no", "id", F.floor(F.col("id") / chunk).alias("part"))
    parts = drawn.groupBy("no", "part").count()
    parts = parts.select("no", "part", (F.sum("count").over(Window.partitionBy("no").orderBy("part")) - F.col("count")).alias("before"))
    rank = F.row_number().over(Window.partitionBy("no", "part").orderBy("id")) - 1
    return drawn.withColumn("own", rank).join(parts, ["no", "part"]).select("no", "id", (F.col("own") + F.col("before")).alias("r"))


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[float, ...] = WEIGHTS, epochs: int = 3, block: int = BLOCK, bucket: int = 2000, step: int = GOLDEN) -> DataFrame:
    """(key, source, size, source_size, target, taken, first_slot, weight) of each row: how many tokens the mix takes of it, and
    the slot that takes the first of them (null: none).

    Null and empty texts have size 0 and are taken 0 times; a null source is a source of its own,
    last in order; repeated rows count each for itself (an occurrence number keeps them apart); null
    keys are kept; an empty table gives an empty result. Other columns are ignored.
    """
    spark = docs.sparkSession
    sizes = docs.select(F.col(key).alias("k"), F.col(source).alias("s"), size_of(F.col(text)).alias("size"))
    sizes = stash(sizes, "sizes")
    goals = targets(sizes, weights, epochs).withColumn("goal", F.round("target").cast("long")).withColumn("buckets", F.ceil(F.col("docs") / bucket))
    goals = stash(goals, "goals")
    slots = stash(schedule(goals, spark, block, step), "schedule")
    drawn = slots.groupBy("no").agg((F.count("*") * block).alias("reach"))
    goals = goals.join(drawn, "no", "left").withColumn("reach", F.coalesce("reach", F.lit(0)))

    same = F.col("s").eqNullSafe(F.col("gs"))
    named = goals.withColumnRenamed("s", "gs")
    few = goals.count() <= 100_000
    # a place in a source's shuffle is a hash; buckets are equal ranges of hashes
    shuffle = F.conv(F.substring(F.md5(F.concat_ws("|", F.col("k").cast("string"), "s").cast("binary")), 1, HASH_BITS // 4), 16, 10).cast("long")
    bucket_of = F.floor(F.col("h") / F.lit(float(1 << HASH_BITS)) * F.col("buckets")).cast("long")
    placed = sizes.join(F.broadcast(named) if few else named, same).withColumn("h", shuffle).withColumn("b", bucket_of)
    bases = placed.groupBy("no", "b").agg(F.sum("size").alias("held"))
    bases = bases.select("no", "b", (F.sum("held").over(Window.partitionBy("no").orderBy("b")) - F.col("held")).alias("base"))
    inside = Window.partitionBy("no", "b").orderBy("h", "k", "size")
    run = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = placed.withColumn("own", F.sum("size").over(run) - F.col("size")).withColumn("n", F.row_number().over(inside))
    laid = placed.join(bases, ["no", "b"]).withColumn("at", F.col("own") + F.col("base"))
    laid = stash(laid.select("k", "s", "no", "b", "n", "size", "source_size", "target", "reach", "weight", "at"), "laid")

    lap = laid.where("size > 0 and reach > 0").withColumn("lap", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1)))).withColumn("x", F.col("at") + F.col("lap") * F.col("source_size")).where("x < reach")
    lap = lap.select("no", "b", "n", "x", F.least(F.col("x") + F.col("size"), "reach").alias("y"))
    pieces = lap.withColumn("r", F.explode(F.sequence(F.floor(F.col("x") / block), F.floor((F.col("y") - 1) / block))))
    pieces = pieces.withColumn("words", F.least("y", (F.col("r") + 1) * block) - F.greatest("x", F.col("r") * block))
    # neither side may be broadcast: sizes are guessed from laid's file, which doesn't show how many pieces a row gives
    took = pieces.join(slots.hint("merge"), ["no", "r"]).groupBy("no", "b", "n").agg(F.sum("words").alias("taken"), F.min("id").alias("first_slot"))
    out = laid.join(took, ["no", "b", "n"], "left")
    return out.select(F.col("k").alias(key), F.col("s").alias(source), "size", "source_size", "target", F.coalesce("taken", F.lit(0).cast("long")).alias("taken"), "first_slot", "weight")


def repeat(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", epochs: int = 3) -> DataFrame:
    """The rows of docs as often as the mix takes them, 0 to epochs times, with all their columns.

    A text that the mix cuts counts as whole from half its tokens on. Rows that share a key are taken alike;
    rows of size 0 are not taken; columns may have any names; cases otherwise as for mix().
    """
    k, n, i = fresh(docs, "k", "n", "i")
    times = mix(docs, key, text, source, epochs=epochs).groupBy(F.col(key).alias(k)).agg(F.round(F.try_divide(F.sum("taken"), F.sum("size"))).cast("int").alias(n))
    taken = docs.join(times.where(F.col(n) > 0).hint("merge"), F.col(key).eqNullSafe(F.col(k)))
    return taken.withColumn(i, F.explode(F.sequence(F.lit(1), n))).select(*docs.columns)


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words the mix takes of every document, and from which slot on."""
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "first_slot")


#: The same in SQL: targets by water-filling, slots drawn by golden-ratio points, ranked, and joined with blocks.
SQL = f"""
WITH sz AS (SELECT doc_id AS k, source AS s, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size FROM documents),
src AS (SELECT s, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY s ASC NULLS LAST) - 1 AS no FROM sz GROUP BY s),
wt AS (SELECT *, CAST(CASE no % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END AS DOUBLE) AS w, CAST(source_size * 3 AS DOUBLE) AS cap FROM src),
lv AS (SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE) - coalesce(sum(cap) OVER (ORDER BY cap / w, no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0)) / sum(w) OVER (ORDER BY cap / w, no ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM wt),
ft AS (SELECT arg_min(level, cap / w) FILTER (WHERE level * w <= cap) AS level FROM lv),
gl AS (SELECT s, no, source_size, CAST(least(cap, coalesce(ft.level * w, cap)) AS DOUBLE) AS target, CAST(round(least(cap, coalesce(ft.level * w, cap))) AS BIGINT) AS goal FROM lv, ft),
hi AS (SELECT *, CAST(sum(goal) OVER (ORDER BY no) AS DOUBLE) / greatest(CAST(sum(goal) OVER () AS DOUBLE), 1.0) AS hi FROM gl),
sh AS (SELECT *, lag(hi, 1, 0.0) OVER (ORDER BY no) AS lo FROM hi),
pt AS (SELECT id, CAST(((id + 1) * {GOLDEN}) % 4294967296 AS DOUBLE) / 4294967296.0 AS u FROM (SELECT unnest(range(CAST(ceil((SELECT sum(goal) FROM gl) / {BLOCK}.0) AS BIGINT))) AS id)),
dr AS (SELECT no, id, row_number() OVER (PARTITION BY no ORDER BY id) - 1 AS r FROM pt JOIN sh ON u >= lo AND u < hi AND goal > 0),
rc AS (SELECT no, count(*) * {BLOCK} AS reach FROM dr GROUP BY no),
pl AS (SELECT sz.k, sz.size, sh.no, sh.source_size, sh.target, coalesce(rc.reach, 0) AS reach, CAST('0x' || substr(md5(concat_ws('|', CAST(sz.k AS VARCHAR), sz.s)), 1, {HASH_BITS // 4}) AS BIGINT) AS h FROM sz JOIN sh ON sz.s IS NOT DISTINCT FROM sh.s LEFT JOIN rc ON rc.no = sh.no),
ld AS (SELECT *, sum(size) OVER (PARTITION BY no ORDER BY h, k, size ROWS UNBOUNDED PRECEDING) - size AS pos FROM pl),
lp AS (SELECT k, no, size, reach, pos + lap * source_size AS x FROM ld, (SELECT unnest([0, 1, 2]) AS lap) WHERE pos + lap * source_size < reach AND size > 0),
tk AS (SELECT lp.k, sum(least(x + size, lp.reach) - x) AS taken, min(dr.id) AS first_slot FROM lp JOIN dr ON dr.no = lp.no AND dr.r = CAST(floor(x / {BLOCK}) AS BIGINT) GROUP BY lp.k)
SELECT k AS doc_id, size, source_size, target, CAST(coalesce(taken, 0) AS BIGINT) AS taken, CAST(first_slot AS BIGINT) AS first_slot FROM ld LEFT JOIN tk USING (k)
"""
