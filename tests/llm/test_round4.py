"""Rows on which an operator once missed its contract, against plain replays."""

import random

import numpy as np
import pytest

from chronoweave.llm import crosstoken, neardup, repeats, tokenfile

from test_round3 import groups_of

#: One space at the end, which no visible character follows.
ENDED = ["the end ", "x ", " ", "naïve 日本 ", "a\n ", "one, two. "]


@pytest.mark.parametrize("text", ["a b ", "a ", " ", "a", "", " a b", "a  b ", "a\0b c "])
def test_pieces_begin_at_lone_spaces(text):
    pieces = tokenfile.cut(text)
    assert "".join(pieces) == text
    assert text == " " or not any(p.isspace() for p in pieces)


def test_texts_that_end_in_a_space_have_tokens(spark):
    docs = spark.createDataFrame(list(enumerate(ENDED)), "doc_id long, text string")
    want = {i: groups_of(t) for i, t in enumerate(ENDED)}
    got = {r.k: [([*g.a], [*g.b]) for g in r.groups] for r in crosstoken.token_groups(docs).collect()}
    assert got == {i: [(list(a), list(b)) for a, b in g] for i, g in want.items()}
    counted = {r.k: (r.n_a, r.n_b, r.n_groups) for r in crosstoken.align_corpus(docs).collect()}
    assert counted == {i: (sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g)) for i, g in want.items()}
    assert counted[0][0] > 0


def test_sketches_rule_out_no_similar_pair():
    r = np.random.default_rng(1)
    ruled_out = 0
    for n in [0, 1, 2, 3, 5, 8, 9, 60, 300, 2000] * 20:
        left = np.unique(r.integers(0, 1 << 63, n, np.uint64) << np.uint64(1))
        right = np.unique(np.concatenate((left[: int(n * r.uniform(0.4, 1))], r.integers(0, 1 << 63, int(n * r.uniform(0, 0.5)), np.uint64) << np.uint64(1))))
        both = len(np.intersect1d(left, right))
        found = neardup.may_be_similar(*(np.frombuffer(neardup.sketch(s), np.uint8) for s in (left, right)), 0.8)
        assert found or both < 0.8 * (len(left) + len(right) - both)
        ruled_out += not found
    assert ruled_out > 80
    assert neardup.may_be_similar(*(np.frombuffer(neardup.sketch(np.arange(n, dtype=np.uint64)), np.uint8) for n in (600, 900)), 0.8)  # ranges that are full


def test_few_sets_are_sent_for_pairs_that_only_share_marks(spark, monkeypatch):
    asked, old = [], neardup.shingle_sets
    monkeypatch.setattr(neardup, "shingle_sets", lambda texts: asked.append(texts.count()) or old(texts))
    r = random.Random(4)
    shared = " ".join(f"s{i}" for i in range(60))
    texts = [shared + " " + " ".join(f"w{r.randint(0, 10**9)}" for _ in range(60)) for _ in range(40)]
    texts.append(texts[0] + " more")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(x.doc_id for x in neardup.deduplicate(docs).collect()) == list(range(40))
    assert sum(asked) == 2


def test_transforms_leave_out_anchors_with_one_content():
    anchor = np.array([1, 2, 2, 3, 4, 4, 4, 5])
    assert [b.tolist() for b in repeats.transforms(anchor, np.full(8, 150))] == [[1, 2, 4, 5, 6]]
    assert [b.tolist() for b in repeats.transforms(anchor, np.full(8, 1 << 19))] == [[1, 2], [4, 5, 6]]
    assert list(repeats.transforms(anchor[:0], anchor[:0])) == list(repeats.transforms(anchor[:1], anchor[:1])) == []
