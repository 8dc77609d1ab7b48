"""Interval, selection, step-feature and media operators on small cases: nulls, NaN, ties, empty tables."""

import struct

import pytest
from pyspark.sql import functions as F

from chronoweave.functions import text as T
from chronoweave.operators import features, intervals, selection, words
from chronoweave.sources import media, tables

INF, NAN = float("inf"), float("nan")


def test_stored_intervals(spark):
    rows = spark.createDataFrame([(1, 0.0, 1.0), (2, 1.0, 1.0 + 1e-12), (3, -0.1, 1.0), (4, 0.0, 10.1), (5, NAN, 1.0), (6, 0.0, INF), (7, None, 1.0), (8, 9.0, 10.0), (9, 2.0, 1.0)], "n int, a double, b double")
    t = intervals.stored_interval(F.col("a"), F.col("b"), F.lit(10.0), 0.5)
    assert {r.n for r in rows.where(t.isNotNull()).collect()} == {1, 8}
    a, b = intervals.clip_interval(F.col("a"), F.col("b"), F.lit(5.0))
    assert [tuple(r) for r in rows.where("n in (8, 9)").orderBy("n").select(a, b).collect()] == [(5.0, 5.0), (1.0, 2.0)]


def test_chunks_are_shifted_and_clamped(spark):
    rows = spark.createDataFrame([(1, 0.0, 1.0), (2, 1.0, None), (3, 2.0, 1.5), (4, 12.0, 13.0), (5, None, 3.0), (6, 9.5, 20.0), (7, -3.0, -1.0)], "n int, a double, b double")
    got = {r.n: (round(r.a, 6), round(r.b, 6)) for r in intervals.clean_chunks(rows, "a", "b", 10.0, 0.5).collect()}
    assert got == {1: (0.0, 0.5), 2: (0.5, 0.55), 3: (1.5, 1.55), 6: (9.0, 10.0)}
    assert intervals.clean_chunks(rows.limit(0), "a", "b", 10.0).count() == 0


def test_tracks_continue_up_to_the_gap(spark):
    rows = spark.createDataFrame([("a", 0), ("a", 2), ("a", 5), ("a", 5), ("b", 9)], "k string, f int")
    got = sorted((r.k, r.f, r.track) for r in intervals.continued(rows, ["k"], ["f"], "f", 2).collect())
    assert got == [("a", 0, 0), ("a", 2, 0), ("a", 5, 1), ("a", 5, 1), ("b", 9, 0)]


def test_masks_by_precedence(spark):
    on, zero, bad = [1.0, 0.0], [0.0, 0.0], [NAN, 1.0]
    steps = [on, zero, bad, on]
    rows = spark.createDataFrame(
        [(1, steps, [True, True, False, False], 4, None), (2, steps, None, 2, None), (3, steps, None, 9, [1.0, 1.0, 1.0, 0.0]), (4, steps, None, None, [0.0, 1.0, 1.0, 1.0]), (5, steps, None, None, None), (6, None, None, 2, None), (7, steps, None, -1, None)],
        "n int, s array<array<double>>, e array<boolean>, l int, a array<double>",
    )
    m = rows.select("n", features.resolve_mask(F.col("s"), F.col("e"), F.col("l"), F.col("a")).alias("m"))
    got = {r.n: ("".join(str(int(x)) for x in r.m.mask), r.m.source) for r in m.collect()}
    att = "text_bert_attention_mask"
    assert got == {1: ("1100", "explicit_mask"), 2: ("1000", "explicit_length"), 3: ("1000", f"explicit_length+{att}"), 4: ("0111", att), 5: ("1001", "zero_row_heuristic"), 6: ("", "missing_field"), 7: ("0000", "explicit_length")}


def test_means_and_stacks(spark):
    rows = spark.createDataFrame([([[1.0, 2.0], [3.0, 4.0]], [True, False]), ([[1.0, 2.0], [3.0, 4.0]], [False, False])], "s array<array<double>>, m array<boolean>")
    got = rows.select(features.masked_mean(F.col("s"), F.col("m"), 2), features.coverage(F.col("m")), features.masked(F.col("s"), F.col("m"))).collect()
    assert [tuple(r) for r in got] == [([1.0, 2.0], 0.5, [[1.0, 2.0], [0.0, 0.0]]), ([0.0, 0.0], 0.0, [[0.0, 0.0], [0.0, 0.0]])]
    long = spark.createDataFrame([("x", "a", 0, True), ("x", "b", 1, True), ("x", "b", 0, False), ("y", "a", 1, False)], "id string, c string, b int, m boolean")
    stacked = features.stack_masks(long, "id", "c", "b", "m", ["a", "b"], 2)
    assert {r.id: r.masks for r in stacked.collect()} == {"x": [[True, False], [False, True]], "y": [[False, False], [False, False]]}
    assert features.unstack_masks(stacked, "id", "c", "b", "m", ["a", "b"]).where("m").count() == 2


def test_masked_steps_are_zeros_whatever_stood_there(spark):
    rows = spark.createDataFrame([([[NAN, -1.0], [float("inf"), 2.0], [3.0, 4.0]], [False, False, True])], "s array<array<double>>, m array<boolean>")
    got = rows.select(features.masked(F.col("s"), F.col("m"))).first()[0]
    assert [[str(x) for x in v] for v in got] == [["0.0", "0.0"], ["0.0", "0.0"], ["3.0", "4.0"]]
    assert rows.select(features.masked(F.lit(None).cast("array<array<double>>"), F.col("m"))).first()[0] is None
    with pytest.raises(Exception, match="one flag for each step"):
        rows.select(features.masked(F.col("s"), F.array(F.lit(True)))).collect()


def test_a_first_try_that_heard_nothing_is_tried_again(spark):
    samples = spark.createDataFrame([(1,), (2,), (3,), (3,)], "k int")
    records = spark.createDataFrame([(1, "exact", True), (1, "fallback", None), (2, "exact", True)], "k int, m string, v boolean")
    heard = spark.createDataFrame([(1, "..."), (1, "word"), (2, "?!")], "k int, w string")
    first = selection.candidate_summary(samples, records, heard, ["k"], F.col("m"), F.col("v"), F.col("w"))
    assert {r.k: (r.records, r.words, r.lexical, r.fallbacks, r.invalid, r.ratio, r.matched) for r in first.collect()} == {1: (2, 2, 1, 1, 1, 0.5, 1), 2: (1, 1, 0, 0, 0, 0.0, 1), 3: (0, 0, 0, 0, 0, 0.0, 0)}
    assert {r.k: (r.retried, r.retry_wins) for r in selection.retry_gate(first, first.limit(0), ["k"]).collect()} == {1: (True, False), 2: (True, False), 3: (True, False)}


def test_retry_wins_only_if_nothing_is_worse(spark):
    schema = "k int, words long, lexical long, fallbacks long, invalid long, ratio double, matched long"
    first = spark.createDataFrame([(1, 4, 4, 2, 1, 0.5, 2), (2, 4, 4, 2, 1, 0.5, 2), (3, 4, 4, 1, 0, 0.25, 3), (4, 4, 0, 1, 0, 0.25, 3)], schema)
    second = spark.createDataFrame([(1, 4, 4, 1, 1, 0.25, 3), (2, 4, 4, 1, 2, 0.25, 3), (3, 4, 4, 0, 0, 0.0, 4)], schema)
    got = {r.k: (r.retried, r.retry_wins) for r in selection.retry_gate(first, second, ["k"]).collect()}
    assert got == {1: (True, True), 2: (True, False), 3: (False, False), 4: (True, False)}


def test_scores_and_choices(spark):
    m = spark.createDataFrame([("a", 0.5, 0.5, 3.0, None), ("b", 1.0, 1.0, 0.0, 0.25), ("b", 1.0, 1.0, 0.0, NAN)], "k string, accuracy double, macro_f1 double, mae double, composite double")
    assert {r.k: r.score for r in selection.selection_score(m, ["k"]).collect()} == {"a": 0.5, "b": 0.25}
    assert selection.best(spark.createDataFrame([(3, 1.0), (1, 2.0), (2, 2.0)], "s int, v double"), "v", "s").first().s == 1
    d = spark.createDataFrame([(1, 0, 0.5), (1, 1, 0.5), (2, 4, 0.5), (2, 5, 0.5), (3, 9, 1.0)], "t int, f int, c double")
    assert selection.best_track(d.withColumn("k", F.lit(0)), ["k"], "t", "f", "c").first().t == 2
    docs = spark.createDataFrame([(1, 5.0), (2, 9.0)], "id long, q double")
    assert [(r.id, r.place) for r in selection.requested(docs, "id", [7, 2], "q", "id").collect()] == [(2, 1)]
    tied = docs.union(docs.selectExpr("id + 2", "q"))
    for asked in ([7], []):
        assert [(r.id, r.place) for r in selection.requested(tied, "id", asked, "q", "id").collect()] == [(2, 0)]
    assert selection.requested(docs.limit(0), "id", [7], "q", "id").count() == 0 == selection.best(docs.limit(0), "q", "id").count()
    audit = selection.prediction_audit(docs, spark.createDataFrame([(1, NAN), (1, 1.0), (5, 2.0)], "id long, s double"), "id", ["s"]).first()
    assert tuple(audit) == (2, 3, 1, 1, 1, 1, 0.5)


def test_names_and_boxes(spark):
    rows = spark.createDataFrame([("a b/c", "30000/1001"), ("", "1/0"), (None, None), ("é-1", "x"), ("abc\n", "1/2")], "n string, f string")
    got = [tuple(r) for r in rows.select(T.safe_name(F.col("n")), T.valid_run_id(F.col("n")), F.round(T.fraction(F.col("f")), 4)).collect()]
    assert got == [("a_b_c", False, 29.97), ("", False, 0.0), (None, False, 0.0), ("_-1", True, 0.0), ("abc_", False, 0.5)]
    box = [F.lit(x) for x in (0.25, 0.25, 0.75, 0.75)]
    assert tuple(spark.range(1).select(T.crop_box(box, 100, 100, 0.2)).first()[0]) == (20, 20, 80, 80)
    assert spark.range(1).select(T.crop_box([F.lit(0.5)] * 4, 100, 100, 0.2)).first()[0] is None


def box(kind, content, wide=False):
    return struct.pack(">I4sQ", 1, kind, len(content) + 16) + content if wide else struct.pack(">I4s", len(content) + 8, kind) + content


def test_mp4_times(spark, tmp_path):
    def head(kind, scale, units, version=0):
        return box(kind, struct.pack(">IQQIQ" if version else ">IIIII", version << 24, 0, 0, scale, units) + bytes(20))

    def track(kind, edits, version=0):
        entries = b"".join(struct.pack(">QqI" if version else ">IiI", d, 0, 1 << 16) for d in edits)
        media_box = box(b"mdia", head(b"mdhd", 48000, 96000) + box(b"hdlr", bytes(8) + kind + bytes(12)))
        return box(b"trak", (box(b"edts", box(b"elst", struct.pack(">II", version << 24, len(edits)) + entries)) if edits else b"") + media_box)

    moov = head(b"mvhd", 1000, 2500, 1) + track(b"soun", [500, 700]) + track(b"vide", [2000], 1) + track(b"vide", [9000])
    for name, data in (("a", box(b"ftyp", b"isom") + box(b"mdat", bytes(99), True) + box(b"moov", moov)), ("b", b"no boxes here"), ("c", b""), ("d", box(b"moov", head(b"mvhd", 0, 7)))):
        (tmp_path / name).mkdir()
        (tmp_path / name / "clip.mp4").write_bytes(data)
    files = media.media_files(spark, str(tmp_path), expected=3)
    assert {(r.folder, r.stem) for r in files.select("folder", "stem").collect()} == {(x, "clip") for x in "abd"}
    got = {r.path.split("/")[-2]: tuple(r)[1:] for r in media.mp4_times(files).collect()}
    assert got == {"a": (1000.0, 2.5, 2.0, 1.2, 1, 2), "d": (0.0, 0.0, 0.0, 0.0, 0, 0)}
    with pytest.raises(ValueError):
        media.media_files(spark, str(tmp_path), expected=5)


def test_sample_ids(spark, tmp_path):
    spark.createDataFrame([("x",), (None,)], "id string").coalesce(1).write.parquet(str(tmp_path / "p"))
    spark.createDataFrame([(1,)], "v int").coalesce(1).write.parquet(str(tmp_path / "q"))
    got = [r for r in tables.read_samples(spark, str(tmp_path / "p")).collect()]
    assert {r.id_source for r in got} == {"input_id_field", "file_stem"}
    assert any(r.id.endswith("__002") for r in got if r.id_source == "file_stem")
    one = tables.read_samples(spark, str(tmp_path / "q")).first()
    assert one.source_file.startswith(one.id) and "__" not in one.id


def test_every_token_gets_one_record(spark):
    samples = spark.createDataFrame([(1, "“Well,  the COLOUR can’t fade", 10.0), (2, None, 5.0), (3, "two words", 4.0), (4, "a b", 0.01)], "id long, text string, duration double")
    heard = spark.createDataFrame(
        [(1, 0, "well", 0.0, 1.0, 0.5), (1, 1, "the", None, 2.0, 0.9), (1, 2, " color ", 3.0, 2.0, 0.9), (1, 3, "cannot", 4.0, 5.0, None), (1, 4, "...", 5.0, 6.0, 0.9), (1, 5, "fade", 20.0, 30.0, 0.9)],
        "id long, index long, word string, start double, stop double, confidence double",
    )
    got = {(r.id, r.n): r for r in words.align_text_words(samples, heard).collect()}
    assert sorted(got) == [(1, 0), (1, 1), (1, 2), (1, 3), (1, 4), (3, 0), (3, 1), (4, 0), (4, 1)]
    kinds = [(got[1, n].match_type, round(got[1, n].start, 3), round(got[1, n].stop, 3), got[1, n].confidence) for n in range(5)]
    other = "boundary_or_uniform_fallback"
    assert kinds == [("exact", 0.0, 1.0, 1.0), (other, 1.0, 1.5, 0.2), ("edit_distance", 2.0, 3.0, 0.65), ("exact", 4.0, 5.0, 1.0), (other, 7.5, 10.0, 0.2)]
    text = samples.first().text
    assert all(text[got[1, n].start_char : got[1, n].end_char] == got[1, n].word for n in range(5))
    assert list(got[1, 3].source_indices) == [3] and list(got[1, 1].source_indices) == []
    assert [(got[3, n].start, got[3, n].stop) for n in (0, 1)] == [(0.0, 2.0), (2.0, 4.0)]
    assert {got[4, n].match_type for n in (0, 1)} == {"invalid_fallback"} and got[4, 0].start is None
    assert words.align_text_words(samples.limit(0), heard.limit(0)).count() == 0


def test_one_sample_and_ranges(spark):
    rows = spark.createDataFrame([(1, 2.00005), (2, 2.1), (3, NAN), (4, None)], "id long, v double")
    assert selection.only(rows, "id", 2).count() == 1
    with pytest.raises(ValueError):
        selection.only(rows, "id", 9)
    assert [r.id for r in rows.where(selection.within(F.col("v"), 1.0, 2.0)).collect()] == [1]
    assert rows.limit(1).select(T.conclusion(F.lit(None).cast("string"))).first()[0] == T.ORDINARY
