"""Joins of the mix whose sides grow with the words: none of them goes through the driver, however small the files look."""

from chronoweave.llm import mixing
from chronoweave.llm.common import settings

#: Limits under which Spark would broadcast both sides of these few rows.
LOOSE = {"spark.sql.autoBroadcastJoinThreshold": "1g", "spark.sql.adaptive.autoBroadcastJoinThreshold": "1g"}


def joins(df, key):
    """Kinds of the joins by a key, as they ran."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    return [line.split("[")[0].strip(" :+-*()0123456789") for line in plan.split("\n") if "Join" in line and f"{key}#" in line]


def test_pieces_and_slots_are_not_broadcast(spark):
    docs = spark.createDataFrame([(i, "word " * 4_000, f"s{i % 3}") for i in range(12)], "doc_id long, text string, source string")
    with settings(spark, LOOSE):
        mixed = mixing.mix(docs)
        assert joins(mixed, "r") == ["SortMergeJoin"]
    assert sum(r.taken for r in mixed.collect()) == 12 * 4_000


def test_repeated_texts_are_not_broadcast(spark, tmp_path):
    copies = spark.range(400).selectExpr("id AS doc_id", "repeat('the same words ', 2000) AS text", "concat('s', id % 3) AS source")
    copies.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")  # a small file of large texts
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    with settings(spark, LOOSE):
        taken = mixing.repeat(docs)
        assert joins(taken, "doc_id") == ["SortMergeJoin"]
    assert taken.count() > 0 and taken.where("length(text) <> 30000").count() == 0
