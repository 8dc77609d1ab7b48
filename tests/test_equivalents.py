"""Contractions match what they stand for."""

from chronoweave.functions.text import EQUIVALENTS
from chronoweave.operators import alignment


def test_contractions_align(spark):
    assert len(EQUIVALENTS) == 34
    rows = spark.createDataFrame([(1, ["They're", "sure", "I", "won't"], ["they", "are", "sure", "I", "will", "not"]), (2, ["cannot"], ["can't"])], "k long, t array<string>, s array<string>")
    got = {(r.k, r.target_from, r.source_from, r.source_to, r.kind) for r in alignment.align(rows, "k", "t", "s", 0.0).collect()}
    assert got == {(1, 0, 0, 2, "equivalent_compound"), (1, 1, 2, 3, "exact"), (1, 2, 3, 4, "exact"), (1, 3, 4, 6, "equivalent_compound"), (2, 0, 0, 1, "exact")}
