"""Steps that cost more than their input asks for: what is taken anew for each word, and where rows are dealt."""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import functions as F

from chronoweave import catalog
from chronoweave.operators import alignment, words

SMALL = "/root/testdata/sf0.001"


def test_word_positions_tokenise_a_text_once(spark):
    plan = catalog.word_position_matrix(spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all(") == 1


def test_edit_ratios_rule_out_only_what_is_beyond_the_ratio():
    draw = random.Random(5)
    some = ["", *("".join(draw.choice("abcdé漢") for _ in range(draw.randint(1, 9))) for _ in range(80))]
    whole, part = alignment.edit_ratios(some, some[::-1]), alignment.edit_ratios(some, some[::-1], 0.34)
    assert np.array_equal(whole <= 0.34, part <= 0.34) and np.array_equal(whole[whole <= 0.34], part[whole <= 0.34])
    assert (part[whole > 0.34] > 0.34).all()


def test_alignment_is_dealt_over_all_shuffle_partitions(spark):
    rows = spark.range(200).coalesce(1).select(F.col("id"), F.array(F.lit("one"), F.lit("two")).alias("t"), F.array(F.lit("two")).alias("s"))
    found = alignment.align(rows.groupBy("id").agg(F.first("t").alias("t"), F.first("s").alias("s")), "id", "t", "s", 0.34)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert found.count() == 200 and found.groupBy(F.spark_partition_id()).count().count() > parts // 2


def test_tokens_carry_no_arrays_beside_each_word(spark):
    rows = spark.createDataFrame([(1, "don't stop, 12"), (2, "")], "id int, text string")
    got = words.tokens(rows, "id", "text")
    assert [tuple(r) for r in got.orderBy("n").collect()] == [(1, 0, "don't", "don't", 0, 5), (1, 1, "stop", "stop", 6, 10), (1, 2, "12", "12", 12, 14)]
    assert "posexplode(_w" not in got._jdf.queryExecution().optimizedPlan().toString()
