"""Operators against brute force: the mix from its schedule, scores from the automaton's formula, samples one by one, toxicity's maxima, BM25 by exhaustive search."""

import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from chronoweave.llm import cws, decontaminate, lm, mixing, neardup, privacy, toxicity

WORDS = ["alpha", "beta", "Gamma", "delta", "epsilon", "zeta", "eta", "theta", "iota", "kappa", "lambda", "mu", "Über", "naïve"]


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randint(0, 40)) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    texts = [prose(i, 7 * i % 90) for i in range(40)] + ["", None, "  \n", prose(3, 21), prose(99, 4000)]
    rows = [(i, t, None if i % 11 == 5 else f"s{i % 4}") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3).cache()


def test_the_schedule_decides_the_mix(docs):
    rows = docs.toPandas()
    connection = duckdb.connect()
    connection.register("documents", rows)
    want = {r[0]: r[1:] for r in connection.sql(mixing.SQL).fetchall()}
    got = {r.doc_id: (r["size"], r.source_size, r.target, r.taken, r.first_slot) for r in mixing.mix(docs).collect()}
    assert got == want
    sums, target = Counter(), {}
    for r in mixing.mix(docs).collect():
        sums[r.source] += r.taken
        target[r.source] = r.target
    assert all(abs(sums[s] - target[s]) <= 3 * mixing.BLOCK for s in target)
    other = {r.doc_id: r.first_slot for r in mixing.mix(docs, step=(1 << 31) + 12345).collect()}
    assert other != {k: v[4] for k, v in got.items()}


def test_mixing_with_clashing_columns(spark, docs):
    odd = docs.selectExpr("*", "1 AS _n", "2 AS _k", "3 AS _i", "4 AS __k", "5 AS no", "6 AS r", "7 AS k")
    assert sorted(mixing.repeat(odd).columns) == sorted(odd.columns)
    assert neardup.deduplicate(docs.selectExpr("*", "1 AS _h", "2 AS _g", "3 AS __h")).where("_h <> 1 or _g <> 2 or __h <> 3").count() == 0
    spans = privacy.sanitise(odd)
    assert privacy.redact(odd, spans).columns == odd.columns


def test_scores_of_the_automaton(docs):
    rows = [(r.doc_id, [*re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in r.text or "")), "</s>"]) for r in docs.collect()]
    c = Counter()
    for k, words in rows:
        if zlib.crc32(str(k).encode()) % 10:
            line = ["<s>", *words]
            c["<s>",] += 1
            for n in (1, 2, 3):
                c.update(g for i in range(len(line) - n + 1) if (g := tuple(line[i : i + n])) != ("<s>",))
    single = {g: n for g, n in c.items() if len(g) == 1 and g != ("<s>",)}
    total, once = sum(single.values()), sum(n == 1 for n in single.values())
    unknown = (once + 1) / (total + 2)

    def p(word, history):
        if not history:
            return (1 - unknown) * c[word,] / total if c[word,] else unknown
        k = lm.STRENGTH[len(history) - 1]
        return (c[*history, word] + k * p(word, history[1:])) / (c[history] + k)

    for strong in (1 << 20, 500):
        scored, n = lm.score_texts(docs, block=strong)
        got = {r.k: r.score for r in scored.collect()}
        assert n == total
        for k, words in rows:
            line = ["<s>", *words]
            want = sum(math.log10(p(line[i], tuple(line[max(i - 2, 0) : i]))) for i in range(1, len(line)))
            assert abs(got[k] - want) < 1e-6 * max(1, abs(want))


def test_score_keys_of_any_type(spark, docs):
    named = docs.selectExpr("concat('d', doc_id) AS doc_id", "text")
    assert lm.score_texts(named)[0].count() == docs.count()


def test_likeness_to_the_next_text(docs):
    source = sorted((r.doc_id, r.text or "") for r in docs.collect())
    sign = {r.k: r for r in cws.fingerprint_pairs(docs).collect()}
    for i, (k, _) in enumerate(source):
        assert sign[k].next_sig == sign[source[(i + 1) % len(source)][0]].sig
    assert sign[3].sig == sign[43].sig  # prose(3, 21) again


def test_maxima_are_those_of_the_features():
    rng = np.random.default_rng(1)
    texts = ["", "one", "one two", prose(1, 50), prose(2, 3), None, prose(3, 200), "..."]
    ids, begin = toxicity.word_ids(texts)
    model = toxicity.start(ids, begin, np.array([0, 1] * 4))
    model.bias = rng.normal(0, 0.3, len(model.bias)).astype(np.float32)
    tables = model.tables()
    assert np.allclose(model.maxima(ids, begin, tables), model.features(ids, begin, tables)[0], atol=1e-5)


def test_search_finds_what_an_exhaustive_one_finds():
    r = random.Random(4)
    items = [(i, prose(1000 + i, r.randint(3, 40))) for i in range(60)]
    index = decontaminate.Index(items)
    for n in range(60):
        text = " ".join([prose(n, 20), items[n][1] if n % 2 else "", prose(n + 500, 20)])
        hashes, _ = decontaminate.words_of([text])
        terms = index.lookup(hashes)
        query = np.unique(terms[terms >= 0])
        score = np.zeros(len(items))
        for t in query:
            own = slice(index.start[t], index.start[t + 1])
            score[index.item[own]] += index.impact[own]
        want = {i for i in range(len(items)) if score[i] >= 0.5 - 1e-9}
        assert {i for i, _ in index.search(query, 0, len(items), 0.5)} == want
        blocks = set(index.promising(terms, np.array([0]), np.array([len(terms)]), 0.5)[1].tolist())
        assert {i // decontaminate.ALIGNED for i in want} <= blocks


def test_identifiers_and_their_cues(spark):
    rows = [(i, f"{prose(i, 60)} secret = {random.Random(i).getrandbits(160):040x} {prose(900 + i, 30)}") for i in range(8)]
    rows += [(100 + i, prose(2000 + i, 80)) for i in range(600)] + [(800, None), (801, ""), (801, ""), (None, "secret 12345678a")]
    found = privacy.sanitise(spark.createDataFrame(rows, "doc_id long, text string"))
    by = {r.k: r.spans for r in found.collect()}
    assert len(by) == 611 and found.count() == 612
    for i, text in rows[:8]:
        assert {text[s.start : s.stop] for s in by[i] if s.kind == "id"} == {text.split(" = ")[1].split()[0]}
        assert "secret" in {text[s.start : s.stop] for s in by[i] if s.kind == "term"}
    assert sum(bool(by[100 + i]) for i in range(600)) <= 6
    assert [s.kind for s in by[None]] == ["id", "term"] and not by[800] and not by[801]
