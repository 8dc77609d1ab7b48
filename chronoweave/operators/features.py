"""Feature sequences as arrays of steps: which steps count, what is masked, what is pooled.

A sample's steps stay in its row (array of vectors), so masks are higher-order functions and need no exchange.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .sequences import finite


def observed_steps(steps: Column) -> Column:
    """A flag for each step: all of its values finite, at least one not zero."""
    return F.transform(steps, lambda v: F.forall(v, finite) & F.exists(v, lambda x: F.abs(x) > 0))


def resolve_mask(steps: Column, explicit: Column, length: Column, attention: Column) -> Column:
    """struct(mask, source) of a sample, by precedence.

    An explicit mask holds as it is. A length admits the steps before it that are observed, since no length makes a zero vector
    an observation. Else the observed steps count. An attention row (1: a token) narrows the first two and replaces the third.
    Null steps give source missing_field and an empty mask; null explicit, length or attention are absent.
    """
    seen = observed_steps(steps)
    counted = F.transform(seen, lambda v, i: v & (i < F.least(F.greatest(length, F.lit(0)), F.size(steps))))
    base = F.when(explicit.isNotNull(), explicit).when(length.isNotNull(), counted).otherwise(seen)
    name = F.when(explicit.isNotNull(), "explicit_mask").when(length.isNotNull(), "explicit_length").otherwise("zero_row_heuristic")
    heard = F.transform(attention, lambda x: F.abs(x - 1) <= 1e-5)
    given = explicit.isNotNull() | length.isNotNull()
    mask = F.when(attention.isNull(), base).when(given, F.zip_with(base, heard, lambda x, y: x & y)).otherwise(heard)
    source = F.when(attention.isNull(), name).when(given, F.concat(name, F.lit("+text_bert_attention_mask"))).otherwise("text_bert_attention_mask")
    empty = F.array().cast("array<boolean>")
    return F.when(steps.isNull(), F.struct(empty.alias("mask"), F.lit("missing_field").alias("source"))).otherwise(F.struct(mask.alias("mask"), source.alias("source")))


def masked(steps: Column, mask: Column) -> Column:
    """The steps, zero where the mask is not set, whatever stood there. A mask of another length than the steps is an error; null steps or mask give null."""
    zero = lambda v: F.transform(v, lambda x: F.when(F.lit(False), x).otherwise(F.lit(0)))
    out = F.zip_with(steps, mask, lambda v, m: F.when(m, v).otherwise(zero(v)))
    return F.when(F.size(steps) == F.size(mask), out).when(steps.isNotNull() & mask.isNotNull(), F.raise_error(F.lit("a mask needs one flag for each step")))


def masked_mean(steps: Column, mask: Column, dims: int) -> Column:
    """Mean vector of the steps that count, zeros if none does."""
    kept = F.filter(F.arrays_zip(steps.alias("v"), mask.alias("m")), lambda p: p["m"])
    n = F.greatest(F.size(kept), F.lit(1))
    return F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda d: F.aggregate(kept, F.lit(0.0), lambda a, p: a + F.get(p["v"], d).cast("double")) / n)


def coverage(mask: Column) -> Column:
    """Share of the steps that count."""
    return F.size(F.filter(mask, lambda m: m)) / F.greatest(F.size(mask), F.lit(1))


def restrict(rows: DataFrame, channel: str, keep: str, mask: str, value: str) -> DataFrame:
    """Long rows with the features and masks of all channels but one blanked."""
    kept = F.col(channel) == keep
    return rows.withColumns({value: F.when(kept, F.col(value)).otherwise(0.0), mask: F.when(kept, F.col(mask)).otherwise(False)})


def stack_masks(rows: DataFrame, sample: str, channel: str, bin_: str, mask: str, channels: list[str], bins: int) -> DataFrame:
    """(sample, masks): array of the channels' masks in the given order, each of bins flags; absent bins are False. A sample has channels x bins rows at most."""
    on = F.collect_set(F.when(F.col(mask), F.struct(F.col(channel).alias("c"), F.col(bin_).cast("int").alias("b"))))
    def flags(name: str) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda b: F.array_contains("_on", F.struct(F.lit(name).alias("c"), b.cast("int").alias("b"))))

    return rows.groupBy(sample).agg(on.alias("_on")).select(sample, F.array(*[flags(c) for c in channels]).alias("masks"))


def unstack_masks(stacked: DataFrame, sample: str, channel: str, bin_: str, mask: str, channels: list[str]) -> DataFrame:
    """The long rows of stack_masks()."""
    each = stacked.select(sample, F.posexplode("masks").alias("_c", "_m")).select(sample, F.element_at(F.array(*[F.lit(c) for c in channels]), F.col("_c") + 1).alias(channel), "_m")
    return each.select(sample, channel, F.posexplode("_m").alias(bin_, mask))


def pool_words(tokens: DataFrame, word: str, vector: str) -> DataFrame:
    """(word, dim, mean): vectors of sub-tokens averaged by word; sub-tokens without a word are left out."""
    each = tokens.where(F.col(word).isNotNull()).select(word, F.posexplode(vector).alias("dim", "x"))
    return each.groupBy(word, "dim").agg(F.avg(F.col("x").cast("double")).alias("mean"))


def reliability(pooled: DataFrame, confidence: str, reliable: str, threshold: float = 0.5) -> DataFrame:
    """Adds low and trusted to bins that have support: confidence under the threshold; pooled share of reliable words at least a half."""
    unit = F.least(F.greatest(F.col(confidence), F.lit(0.0)), F.lit(1.0))
    return pooled.withColumns({"low": F.round(unit, 9) < threshold, "trusted": F.round(F.col(reliable), 9) >= 0.5})
