"""What workers of the token file hold at once: a bounded part of a batch, and one step for decoding and checksums."""

import pyarrow as pa

from chronoweave.llm import tokenfile
from chronoweave.llm.common import tokenizer_path

SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


class Caught:
    """Documents of which only the function that encodes them is wanted, and the setting while they are written."""

    def __init__(self, session):
        self.sparkSession = session

    def select(self, *columns):
        return self

    def mapInArrow(self, run, schema):
        self.run = run
        return self

    write = property(lambda self: self)

    def option(self, *pair):
        return self

    def parquet(self, to):
        self.set = self.sparkSession.conf.get(SETTING)


def test_a_large_batch_is_encoded_in_parts(spark):
    from tokenizers import Tokenizer

    path, before = tokenizer_path("byte_bpe_50k.json"), spark.conf.get(SETTING)
    caught = Caught(spark)
    tokenfile.token_rows(caught, "doc_id", "text", path, 0, 2, "-")
    assert int(caught.set.rstrip("b")) <= 8 << 20 and spark.conf.get(SETTING) == before
    texts = [None, "", *["données and words, " * 30_000] * 20, "a" * 9, None, *["end. " * 2_000_000], "x"]
    batch = pa.RecordBatch.from_arrays([pa.array([None, *range(1, len(texts))], pa.int64()), pa.array(texts, pa.string())], ["k", "t"])
    *parts, last = caught.run(iter([batch, batch.slice(0, 0), batch.slice(len(texts) - 1)]))
    sizes = [sum(len((texts[k or 0] or "").encode()) for k in p.column("k").to_pylist()) for p in parts]
    assert all(size <= 8 << 20 or p.num_rows == 1 for size, p in zip(sizes, parts, strict=True))
    rows = [r for p in parts for r in p.to_pylist()]
    assert [r["k"] for r in rows] == [None, *range(1, len(texts)), len(texts) - 1]
    own = Tokenizer.from_file(path)
    for r in (rows[n] for n in (0, 1, 2, 21, 22, 23, 25, 26)):
        ids = [*own.encode(texts[r["k"] or 0] or "", add_special_tokens=False).ids, 0]
        assert memoryview(r["ids"]).cast("H").tolist() == ids and r["n"] == len(ids)
    assert sum(memoryview(last.column("tally")[0].as_py()).cast("q")) == sum(r["n"] for r in rows)


def test_checksums_are_taken_where_blocks_are_decoded(spark, tmp_path, monkeypatch):
    docs = spark.createDataFrame([(n, "a word " * n) for n in range(40)], "doc_id long, text string")
    tokenfile.encode_corpus(docs, f"file://{tmp_path}/f", block=64)
    plans, own = [], tokenfile.stash
    monkeypatch.setattr(tokenfile, "stash", lambda df, name: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or own(df, name))
    assert tokenfile.digests(spark, f"file://{tmp_path}/f").count() == 40
    assert [p.count("MapInArrow") for p in plans] == [1]
