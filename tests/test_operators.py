"""Operators on small cases with known results."""

from pyspark.sql import functions as F

from chronoweave.functions import text as T
from chronoweave.operators import alignment, metrics, scenarios, sequences
from chronoweave.sources import tables


def test_pooling_divides_a_span_among_its_bins(spark):
    spans = spark.createDataFrame([("a", 0.0, 4.0, 1.0), ("a", 2.0, 4.0, 3.0), ("a", 5.0, 5.0, 9.0), ("b", -2.0, 2.0, 2.0), ("c", None, 2.0, 2.0)], "id string, s double, e double, v double")
    got = {(r.id, r.bin): (round(r.value, 6), round(r.weight, 6)) for r in sequences.overlap_pool(spans, ["id"], "s", "e", "v", duration=10.0, bins=5).collect()}
    assert got == {("a", 0): (1.0, 0.5), ("a", 1): (round((0.5 * 1 + 1 * 3) / 1.5, 6), 1.5), ("b", 0): (2.0, 0.5)}


def test_blank_interval_keeps_one(spark):
    rows = spark.createDataFrame([("a", b) for b in (1, 4, 6, 9)] + [("b", 3)], "id string, bin int")
    kept = {(r.id, r.bin) for r in scenarios.blank_intervals(rows, ["id"], "bin", [1.0], ["front"]).where("kept").collect()}
    assert kept == {("a", 9), ("b", 3)}


def test_metrics_of_empty_and_constant(spark):
    rows = spark.createDataFrame([(0, 0, 1.0, 1.0), (1, 0, 1.0, 2.0)], "t int, p int, y double, z double")
    r = metrics.classification(rows, "t", "p", "y", "z").first()
    assert (r.accuracy, r.pearson, r.composite, round(r.f1_0, 4), r.f1_2) == (0.5, None, None, 0.6667, 0.0)


def test_alignment_prefers_exact_then_compound():
    path = alignment.best_path(["ice", "cream", "is", "colour"], ["icecream", "so", "is", "color"], 0.34)
    assert [x[4] for x in path] == ["equivalent_compound", "exact", "edit_distance"]
    assert alignment.best_path([], ["a"], 0.3) == []


def test_runs_and_as_of(spark):
    rows = spark.createDataFrame([("a", b, b not in (2, 5)) for b in range(7)], "id string, bin int, ok boolean")
    got = {(r.start, r.stop) for r in sequences.runs(rows, ["id"], "bin", F.col("ok")).collect()}
    assert got == {(0, 2), (3, 5), (6, 7)}
    left = spark.createDataFrame([("a", 1, 5), ("a", 2, 0)], "id string, n int, t int")
    right = spark.createDataFrame([("a", 3, "x"), ("a", 5, "y")], "id string, t int, v string")
    assert {(r.n, r.v) for r in sequences.as_of(left, right, ["id"], "t", "v").collect()} == {(1, "y"), (2, None)}


def test_text_functions(spark):
    row = spark.createDataFrame([("It’s  OKAY-ish",)], "a string").select(T.tokenize(F.col("a")).alias("t")).first()
    assert row.t == ["It’s", "OKAY-ish"]
    names = ["f1700000000001.x", "f1700000000009.x", "f2.x", "f10.x", "F3.x", "f", "f010b", "f10a", "g1", "", "12", "f170000000001.x"]
    got = [r.n for r in spark.createDataFrame([(n,) for n in names], "n string").orderBy(T.natural_key(F.col("n")), "n").collect()]
    assert got == ["", "12", "f", "f2.x", "F3.x", "f10.x", "f10a", "f010b", "f170000000001.x", "f1700000000001.x", "f1700000000009.x", "g1"]


def test_cells_and_precedence(spark):
    pairs = [("1.0", "1.000001", True), ("1", "1.1", False), ("inf", "inf", True), ("inf", "-inf", False), ("NaN", "NaN", True), ("a", "a", True), (None, None, True), (None, "a", False), ("1e3", "1000.0", True), ("1d", "1", False), (" 2 ", "2", True), ("nan", "1", False)]
    rows = spark.createDataFrame(pairs, "a string, b string, want boolean")
    assert all(r.got == r.want for r in rows.select("*", T.cell_equal(F.col("a"), F.col("b")).alias("got")).collect())
    assert spark.range(1).select(T.cell_equal(F.lit(float("inf")), F.lit(float("inf")))).first()[0]
    values = spark.createDataFrame([(float("nan"), float("inf"), 2.0), (0.0, -1.0, None), (3.0, 1.0, 1.0)], "a double, b double, c double")
    value, name = T.first_positive(("a", F.col("a")), ("b", F.col("b")), ("c", F.col("c")))
    assert [tuple(r) for r in values.select(value, name).collect()] == [(2.0, "c"), (None, "none"), (3.0, "a")]


def test_label_table(spark, tmp_path):
    (tmp_path / "x.csv").write_text("﻿Video ID,clip_id,Text,Label,Annotation\n7.0,1,hi,0.5,positive\n,2,x,1,neg\n8,3,y,bad,NEUTRAL\n")
    got = [(r.id, r.label, r.annotation) for r in tables.label_table(tables.read_csv(spark, str(tmp_path / "x.csv"))).orderBy("id").collect()]
    assert got == [("7$_$1", 0.5, "Positive"), ("8$_$3", None, "Neutral")]


def test_xlsx(spark, tmp_path):
    import zipfile

    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(tmp_path / "x.xlsx", "w") as z:
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>video_id</t></si><si><t>label</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>1</v></c></row><row><c r="C2"><v>2</v></c></row></sheetData></worksheet>')
    assert [tuple(r) for r in tables.read_xlsx(spark, str(tmp_path / "x.xlsx")).collect()] == [(None, "2")]
