"""Missing-data scenarios: parameter grids, blanked intervals, random masks, their statistics.

Draws are hashes of (seed, scenario, sample, channel), so they need no state and no order of evaluation.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .evaluation import Scenario


def grid(spark: SparkSession, seeds: list[int], fractions: list[float], positions: list[str], groups: list[list[str]], relations: list[str]) -> DataFrame:
    """Scenarios: complete, and each seed, fraction, position, group and relation; a group of one has relation single."""
    frame = spark.range(1)
    for name, values in (("seed", seeds), ("fraction", fractions), ("position", positions), ("grp", ["+".join(g) for g in groups]), ("relation", relations)):
        frame = frame.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    alone = ~F.col("grp").contains("+")
    frame = frame.withColumn("relation", F.when(alone, "single").otherwise(F.col("relation"))).drop("id").distinct()
    name = F.concat_ws("__", "grp", F.lpad(F.rint(F.col("fraction") * 100).cast("int").cast("string"), 2, "0"), "position", "relation", F.concat(F.lit("s"), F.col("seed")))
    listed = frame.select(name.alias("scenario"), F.col("seed").cast("long").alias("seed"), "fraction", "position", "grp", "relation")
    complete = spark.range(1).select(F.lit("complete").alias("scenario"), F.lit(None).cast("long").alias("seed"), F.lit(0.0).alias("fraction"), F.lit("none").alias("position"), F.lit("").alias("grp"), F.lit("none").alias("relation"))
    return complete.union(listed)


def blank_intervals(rows: DataFrame, by: list[str], bin_: str, fractions: list[float], positions: list[str]) -> DataFrame:
    """The rows under each fraction and position, with kept: False between the first and last of the c = min(m - 1, max(1, ceil(m f))) available bins at the position.

    Ranks and counts don't depend on the scenario: they are found once, and rows multiply after the windows.
    """
    line = Window.partitionBy(*by)
    rows = rows.withColumns({"_m": F.count("*").over(line), "_r": F.row_number().over(line.orderBy(bin_)) - 1})
    every = F.array(*[F.struct(F.lit(f).alias("fraction"), F.lit(p).alias("position")) for f in fractions for p in positions])
    rows = rows.select("*", F.explode(every).alias("_s")).select("*", "_s.*")
    m, f, p = F.col("_m"), F.col("fraction"), F.col("position")
    count = F.when((m <= 1) | (f <= 0), 0).otherwise(F.least(m - 1, F.greatest(F.lit(1), F.ceil(m * f))))
    begin = F.when(p == "front", 0).when(p == "middle", F.floor((m - count) / 2)).otherwise(m - count)
    return rows.withColumn("kept", ~((F.col("_r") >= begin) & (F.col("_r") < begin + count))).drop("_m", "_r", "_s")


def hashed(*parts: Column | str | int) -> Column:
    """60 bits of the MD5 of the parts joined by bars, null as the word: a number that any SQL engine finds again. Names are columns."""
    texts = [F.lit(str(p)) if isinstance(p, int) else F.coalesce((F.col(p) if isinstance(p, str) else p).cast("string"), F.lit("null")) for p in parts]
    return F.conv(F.substring(F.md5(F.concat_ws("|", *texts).cast("binary")), 1, 15), 16, 10).cast("long")


def draw(*parts: Column | str | int, over: int | Column) -> Column:
    """A whole number in [0, over) that depends on the parts alone."""
    return F.pmod(hashed(*parts), over if isinstance(over, Column) else F.lit(over))


def ranked(rows: DataFrame, sample: str, channel: str, bin_: str, seed: int) -> DataFrame:
    """Adds _m, the channel's bins, _r, the bin's place among them, _n, the sample's channels, and _p, the channel's place in a drawn order from 1.

    All windows are within a sample, so one exchange by it serves them.
    """
    line, own = Window.partitionBy(sample, channel), Window.partitionBy(sample)
    rows = rows.withColumn("_d", draw(seed, F.lit("channel"), sample, channel, over=1 << 59))
    return rows.withColumns({
        "_m": F.count("*").over(line), "_r": F.row_number().over(line.orderBy(bin_)) - 1,
        "_n": F.size(F.collect_set(channel).over(own)), "_p": F.dense_rank().over(own.orderBy("_d", channel)),
    })


def hit(seed: int, sample: str, share: float) -> Column:
    """Whether a sample is among the drawn share."""
    return draw(seed, F.lit("sample"), sample, over=1_000_000) < round(share * 1_000_000)


def drop_channel(rows: DataFrame, sample: str, channel: str, bin_: str, seed: int, share: float) -> DataFrame:
    """Adds kept: a share of the samples with two or more channels lose one of them, drawn by hash."""
    rows = ranked(rows, sample, channel, bin_, seed)
    return rows.withColumn("kept", ~(hit(seed, sample, share) & (F.col("_n") > 1) & (F.col("_p") == 1))).drop("_d", "_m", "_r", "_n", "_p")


def drop_points(rows: DataFrame, sample: str, channel: str, bin_: str, seed: int, share: float, fraction: float) -> DataFrame:
    """Adds kept: a share of the samples lose points of 1 to all of their channels, max(1, ceil(m fraction)) of m bins without replacement; one bin stays."""
    rows = ranked(rows, sample, channel, bin_, seed)
    chosen = hit(seed, sample, share) & (F.col("_p") <= 1 + draw(seed, F.lit("count"), sample, over=F.col("_n")))
    order = Window.partitionBy(sample, channel).orderBy(draw(seed, F.lit("point"), sample, channel, bin_, over=1 << 59), bin_)
    lost = F.least(F.col("_m") - 1, F.greatest(F.lit(1), F.ceil(F.col("_m") * fraction)))
    return rows.withColumn("kept", ~(chosen & (F.row_number().over(order) <= lost))).drop("_d", "_m", "_r", "_n", "_p")


def drop_blocks(rows: DataFrame, sample: str, channel: str, bin_: str, seed: int, share: float, most: float, counts: tuple[float, ...] = (0.55, 0.35, 0.10)) -> DataFrame:
    """Adds kept: a share of the samples lose 1 to 3 blocks of available bins in each of 1, 2 or 3 channels (drawn by counts); a channel keeps a bin.

    A block is up to ceil(m most) of a channel's m bins long, never all of them, and may overlap another.
    """
    rows = ranked(rows, sample, channel, bin_, seed)
    m, r, u = F.col("_m"), F.col("_r"), draw(seed, F.lit("count"), sample, over=1_000_000)
    wanted = F.lit(1)
    for n in range(1, len(counts)):
        wanted = wanted + (u >= round(sum(counts[:n]) * 1_000_000)).cast("int")
    longest = F.greatest(F.lit(1), F.ceil(m * F.least(F.lit(1.0), F.greatest(F.lit(most), 1 / m))))
    segments, inside = 1 + draw(seed, F.lit("segments"), sample, channel, over=3), F.lit(False)
    for k in range(3):
        length = F.least(m - 1, 1 + draw(seed, F.lit("length"), sample, channel, k, over=longest))
        start = draw(seed, F.lit("start"), sample, channel, k, over=m - length + 1)
        inside = inside | ((F.lit(k) < segments) & (r >= start) & (r < start + length))
    gone = hit(seed, sample, share) & (F.col("_p") <= F.least(wanted, F.col("_n"))) & (m > 1) & inside
    rows = rows.withColumn("_gone", gone)
    left = F.count_if(~F.col("_gone")).over(Window.partitionBy(sample, channel))
    again = (left == 0) & (r == draw(seed, F.lit("keep"), sample, channel, over=m))
    return rows.withColumn("kept", ~F.col("_gone") | again).drop("_d", "_m", "_r", "_n", "_p", "_gone")


def block_flags(masks: np.ndarray, keys: Sequence[str], seed: object, share: float, most: float, counts: tuple[float, ...] = (0.55, 0.35, 0.10)) -> np.ndarray:
    """What drop_blocks() leaves of masks [n, channels, steps], by the same draws, for code that has samples in arrays."""
    out = masks.copy()
    number = lambda *parts: int(hashlib.md5("|".join(map(str, (seed, *parts))).encode()).hexdigest()[:15], 16)
    for n, key in enumerate(keys):
        if number("sample", key) % 1_000_000 >= round(share * 1_000_000):
            continue
        u = number("count", key) % 1_000_000
        wanted = 1 + sum(u >= round(sum(counts[:i]) * 1_000_000) for i in range(1, len(counts)))
        channels = sorted(np.flatnonzero(masks[n].any(axis=1)).tolist(), key=lambda c: (number("channel", key, c) % (1 << 59), c))
        for c in channels[:wanted]:
            free = np.flatnonzero(masks[n, c])
            m = len(free)
            if m <= 1:
                continue
            longest = max(1, math.ceil(m * min(1.0, max(most, 1 / m))))
            for k in range(1 + number("segments", key, c) % 3):
                length = min(m - 1, 1 + number("length", key, c, k) % longest)
                start = number("start", key, c, k) % (m - length + 1)
                out[n, c, free[start : start + length]] = False
            if not out[n, c].any():
                out[n, c, free[number("keep", key, c) % m]] = True
    return out


def under(rows: DataFrame, sample: str, channel: str, bin_: str, scenario: Scenario, bins: int) -> DataFrame:
    """Adds kept: what a scenario of evaluation.grid() leaves of long rows of available bins, channels by number.

    The blanked stretch runs over bins, from the first to the last available one at the position; a staggered channel's is moved by its place in the group
    times a shift drawn for it. A channel keeps its first bin if it would lose all.
    """
    line = Window.partitionBy(sample, channel)
    rows = rows.withColumns({"_m": F.count("*").over(line), "_r": F.row_number().over(line.orderBy(bin_)) - 1})
    m = F.col("_m")
    count = F.when((m <= 1) | F.lit(scenario.fraction <= 0), 0).otherwise(F.least(m - 1, F.greatest(F.lit(1), F.ceil(m * F.lit(scenario.fraction)))))
    begin = {"front": F.lit(0), "middle": F.floor((m - count) / 2), "back": m - count}[scenario.position]
    place = F.coalesce(*[F.when(F.col(channel) == c, i) for i, c in enumerate(scenario.group)])
    shift = place * draw(F.lit(scenario.name), sample, channel, over=bins // len(scenario.group) + 1) if scenario.draws else F.lit(0)
    rows = rows.withColumns({"_a": F.min(F.when(F.col("_r") == begin, F.col(bin_))).over(line) + shift, "_b": F.min(F.when(F.col("_r") == begin + count - 1, F.col(bin_))).over(line) + 1 + shift})
    inside = F.col(channel).isin(*scenario.group) & (count > 0) & (F.col(bin_) >= F.col("_a")) & (F.col(bin_) < F.col("_b"))
    rows = rows.withColumn("_gone", inside)
    again = (F.count_if(~F.col("_gone")).over(line) == 0) & (F.col("_r") == 0)
    return rows.withColumn("kept", ~F.col("_gone") | again).drop("_m", "_r", "_a", "_b", "_gone")


def mask_statistics(rows: DataFrame, scenario: list[str], sample: str, channel: str, kept: str) -> DataFrame:
    """For each scenario and channel: bins, bins kept, mean and largest missing share of a sample."""
    each = rows.groupBy(*scenario, sample, channel).agg(F.count("*").alias("_o"), F.count_if(F.col(kept)).alias("_k"))
    share = (F.col("_o") - F.col("_k")) / F.greatest(F.col("_o"), F.lit(1))
    return each.groupBy(*scenario, channel).agg(F.sum("_o").alias("original"), F.sum("_k").alias("observed"), F.avg(share).alias("mean_missing"), F.max(share).alias("max_missing"))
