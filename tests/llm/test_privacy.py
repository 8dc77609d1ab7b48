"""Copies of a text don't hide the terms that disclose an entity."""

from chronoweave.llm import privacy


def test_copies_cancel_out(spark):
    rows = [f"{w} mister Zebedee pays 4539578763621486 today" for w in ("amber", "birch", "cedar", "daisy", "elder")]
    rows += [f"other{i} words today of no mister" for i in range(300)]
    rows += [rows[0]] * 100
    found = privacy.sanitise(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string"))
    by = {r.k: r.spans for r in found.collect()}
    terms = [{rows[i][s.start : s.stop] for s in by[i] if s.kind == "term"} for i in (*range(5), len(rows) - 1)]
    assert all("Zebedee" in t and "today" not in t and "mister" not in t for t in terms)
