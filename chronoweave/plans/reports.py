"""Texts from two attempts of a recogniser to their reports: which attempt stands, how far its times can be relied on, what has to be looked at by hand.

Everything is joins and grouped sums by sample; a sample without records or words is in every report.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import conclusion
from ..operators import selection
from ..operators.words import align_text_words
from .folders import kept

# Names of attempts and of review statuses.
FIRST, SECOND = "baseline", "retry_beam3_temperature0.2_context0.5"
EMPTY, MISMATCH, HIGH, PARTIAL, NORMAL = "asr_empty_or_nonlexical_manual_review", "asr_text_mismatch_manual_review", "high_fallback_manual_review", "partial_invalid_timestamp_manual_review", "normal"
LACKING = "processing_failed_manual_review"


def review_status(ratio: Column, lexical: Column, invalid: Column) -> Column:
    """What a text's share of fallback times, recognised lexical words and invalid times ask for."""
    whole = F.when(lexical == 0, EMPTY).otherwise(MISMATCH)
    return F.when(ratio >= 0.999999, whole).when(ratio >= 0.5, HIGH).when(invalid > 0, PARTIAL).otherwise(NORMAL)


def attempts(samples: DataFrame, first: DataFrame, second: DataFrame, key: str = "id", text: str = "text", duration: str = "duration", threshold: float = 0.5, confident: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """(records, statistics) of samples (key, text, duration) after two attempts' words (key, index, word, start, stop, confidence).

    The second attempt is asked for where the first falls back at the threshold or heard no lexical word, and stands only where it falls back less without being worse. Only what is
    asked for is aligned a second time. Statistics: one row a sample, of the attempt that stands. Records and summaries are written to the shared folder on the way.
    """
    def summary(of: DataFrame, records: DataFrame, words: DataFrame) -> DataFrame:
        return kept(selection.candidate_summary(of, records, words, [key], F.when(F.col("fallback"), "fallback").otherwise(F.col("match_type")), F.col("time_valid"), F.col("word")), "summary")

    records = kept(align_text_words(samples, first, key, text, duration), "records")
    before = summary(samples, records, first)
    asked = before.where((F.col("ratio") >= threshold) | (F.col("lexical") == 0)).select(key)
    tried = samples.join(asked, key, "left_semi")
    words = second.join(asked, key, "left_semi")
    again = kept(align_text_words(tried, words, key, text, duration), "records")
    after = summary(tried, again, words)
    gate = selection.retry_gate(before, after, [key], threshold)
    won, lost = gate.where("retry_wins").select(key), gate.where("NOT retry_wins").select(key)
    standing = records.join(lost, key, "left_semi").unionByName(again.join(won, key, "left_semi"))
    chosen = before.join(lost, key, "left_semi").unionByName(after.join(won, key, "left_semi"))
    sure = F.col("time_valid") & ~F.col("fallback") & (F.col("confidence") >= confident)
    flags = standing.groupBy(key).agg(F.count_if("time_valid").alias("timestamp_valid"), F.count_if(sure).alias("reliable"))
    stats = chosen.join(flags, key, "left").fillna(0, ["timestamp_valid", "reliable"]).join(gate, key)
    return standing, stats.select(
        key, F.col("records").alias("word_count"), F.col("words").alias("asr_word_count"), F.col("lexical").alias("lexical_asr_word_count"), F.col("fallbacks").alias("fallback_count"), F.col("ratio").alias("fallback_ratio"), F.col("invalid").alias("invalid_timestamp_count"),
        "timestamp_valid", "reliable", "matched", review_status(F.col("ratio"), F.col("lexical"), F.col("invalid")).alias("review_status"),
        F.col("retried").cast("int").alias("asr_retry_used"), F.col("retry_wins").cast("int").alias("asr_retry_selected"), F.when(F.col("retry_wins"), SECOND).otherwise(FIRST).alias("asr_selected_profile"), (1 + F.col("retried").cast("int")).alias("asr_attempt_count"),
    )


#: Columns of the two text reports.
COUNTS = ("asr_word_count", "lexical_asr_word_count", "fallback_count", "fallback_ratio", "invalid_timestamp_count", "review_status")
RETRY = ("asr_retry_used", "asr_retry_selected", "asr_selected_profile", "asr_attempt_count")


def failed_rows(samples: DataFrame, stats: DataFrame, key: str = "id") -> DataFrame:
    """Statistics with a row for every sample: what has none counts as failed, with zeros and its own status."""
    numbers = [c for c, kind in stats.dtypes if kind in ("bigint", "int", "double") and c != key]
    whole = samples.select(key).distinct().join(stats, key, "left")
    return whole.fillna(0, numbers).fillna({"review_status": LACKING, "asr_selected_profile": ""})


def text_review(samples: DataFrame, stats: DataFrame, words: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    """(key, raw_text, counts, retries, asr_words): one row a sample, its recognised words as JSON in their order (a clip's words are one row)."""
    heard = words.groupBy(key).agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("index", "word", "start", "stop"))), lambda w: F.struct(w["word"].alias("text"), w["start"].alias("start"), w["stop"].alias("end")))).alias("asr_words"))
    rows = failed_rows(samples, stats, key).join(samples.select(key, F.coalesce(F.col(text), F.lit("")).alias("raw_text")), key).join(heard, key, "left")
    return rows.select(key, "raw_text", *COUNTS, *RETRY, F.coalesce("asr_words", F.lit("[]")).alias("asr_words"))


def text_audit(samples: DataFrame, stats: DataFrame, key: str = "id") -> DataFrame:
    """(key, word_count, counts, manual_review_required, retries, conclusion): one row a sample."""
    rows = failed_rows(samples, stats, key)
    return rows.select(key, "word_count", *COUNTS, (F.col("review_status") != NORMAL).cast("int").alias("manual_review_required"), *RETRY, conclusion(F.col("review_status")).alias("conclusion"))


def effective_lengths(stats: DataFrame, bins: DataFrame, channels: list[str], frames: DataFrame, steps: int, key: str = "id") -> DataFrame:
    """(key, words and their valid and reliable shares, and for each channel its raw and valid frames, valid bins and their shares) of text statistics, aligned bins (key, channel, mask) and raw frames (key, channel, valid)."""
    share = lambda a, b: (a / F.greatest(b, F.lit(1)))
    aligned = bins.groupBy(key).agg(*[F.count_if(F.col("mask") & (F.col("channel") == c)).alias(f"{c}_aligned_valid_bins") for c in channels])
    raw = frames.groupBy(key).agg(*[x for c in channels for x in (F.count_if(F.col("channel") == c).alias(f"{c}_raw_frames"), F.count_if((F.col("channel") == c) & F.col("valid")).alias(f"{c}_valid_raw_frames"))])
    rows = stats.join(aligned, key, "left").join(raw, key, "left").fillna(0, [*aligned.columns[1:], *raw.columns[1:]])
    each = [x for c in channels for x in (f"{c}_raw_frames", f"{c}_valid_raw_frames", share(F.col(f"{c}_valid_raw_frames"), F.col(f"{c}_raw_frames")).alias(f"{c}_raw_valid_ratio"), f"{c}_aligned_valid_bins", (F.col(f"{c}_aligned_valid_bins") / max(steps, 1)).alias(f"{c}_aligned_valid_ratio"))]
    return rows.select(key, F.col("word_count").alias("text_raw_words"), F.col("timestamp_valid").alias("text_timestamp_valid_words"), F.col("matched").alias("text_matched_words"), F.col("reliable").alias("text_reliable_word_count"), share(F.col("reliable"), F.col("word_count")).alias("text_raw_valid_ratio"), share(F.col("timestamp_valid"), F.col("word_count")).alias("text_timestamp_valid_ratio"), *each, F.col("review_status").alias("text_review_status"))
