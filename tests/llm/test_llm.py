"""Each operator against brute force, an exact round trip or held-out accuracy, on small and on awkward tables."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoweave.llm import cws, decontaminate, licences, lm, mixing, neardup, privacy, repeats, simhash, tokenfile, toxicity
from chronoweave.llm.common import tokenizer_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, k string"
WORDS = ["alpha", "beta", "Gamma", "delta", "epsilon", "zeta", "eta", "theta", "iota", "kappa", "lambda", "mu", "Über", "naïve"]


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randint(0, 40)) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    base = prose(1, 300)
    near = base.split()
    near[150] = "changed"
    return [base, base, " ".join(near), "", None, "   \n ", "word", prose(2, 40), prose(3, 3000), "a" * 500, base, prose(4, 90) + " 😀 end"]


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "en" if i % 2 else None, None if i == 3 else f"s{i % 3}", None, 1.0, "x") for i, t in enumerate(texts)]
    rows += [(None, prose(9, 50), None, None, None, None, None), (7, prose(2, 40), "en", "s1", None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def brute_simhash(text, width=3):
    import xxhash

    w = (text or "").encode().lower().split()
    if not w:
        return 0
    hs = [xxhash.xxh64_intdigest(b" ".join(w[i : i + width]), 42) for i in range(max(1, len(w) - width + 1))]
    return sum((sum(h >> b & 1 for h in hs) * 2 > len(hs)) << b for b in range(64))


def test_simhash_classes(docs, empty):
    rows = simhash.near_duplicates(docs).collect()
    assert len(rows) == docs.count()
    by_text = {r.doc_id: r.text for r in docs.collect()}
    fps = {r.doc_id: r.fp % (1 << 64) for r in rows}
    assert all(fps[k] == brute_simhash(by_text[k]) for k in fps if k != 7)
    for r in rows:
        same = [q.component for q in rows if (q.fp % (1 << 64) ^ r.fp % (1 << 64)).bit_count() <= 2]
        assert set(same) == {r.component}
    assert simhash.near_duplicates(empty).count() == 0


def test_covering_masks_miss_no_pair():
    masks = [m % (1 << 64) for m in simhash.covering_masks(2)]
    assert len(masks) == 7
    for i in range(64):
        for j in range(i, 64):
            d = (1 << i) | (1 << j)
            assert any(m & d == 0 for m in masks)


def test_crowded_buckets_are_exact(spark):
    r = random.Random(5)
    center = r.getrandbits(64)
    values = {center ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)) for _ in range(150)} | {r.getrandbits(64) for _ in range(50)}
    signed = [(v - (1 << 64) if v >> 63 else v,) for v in values]
    from chronoweave.llm.graph import components

    got = {x.node % (1 << 64): x.root for x in components(simhash.links(spark.createDataFrame(signed, "fp long"), hot=4)).collect()}
    parent = {v: v for v in values}

    def find(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a in values:
        for b in values:
            if (a ^ b).bit_count() <= 2:
                parent[find(a)] = find(b)
    groups = Counter(find(v) for v in values)
    for a in values:
        assert (a in got) == (groups[find(a)] > 1)
        for b in got:
            if a in got:
                assert (got[a] == got[b]) == (find(a) == find(b))


def test_mixing_reaches_targets(docs, empty):
    rows = mixing.mix(docs, block=16).collect()
    assert len(rows) == docs.count()
    totals, target, size = Counter(), {}, Counter()
    for r in rows:
        assert 0 <= r.taken <= 3 * r["size"]
        totals[r.source] += r.taken
        size[r.source] += r["size"]
        target[r.source] = r.target
        assert r["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", {x.doc_id: x.text for x in docs.collect()}[r.doc_id] or ""))
    assert all(abs(totals[s] - target[s]) <= 3 * 16 for s in target)  # the drawn slots are within three blocks
    assert abs(sum(target.values()) - sum(size.values())) < 1e-6 and all(target[s] <= 3 * size[s] + 1e-9 for s in target)
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix(docs, block=16).collect()))
    assert mixing.mix(empty).count() == 0


def test_privacy_base_is_the_patterns():
    patterns = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}

    def fits(kind, v):
        digits = re.sub("[^0-9]", "", v)
        return {"email": True, "ip": all(int(p) <= 255 for p in v.split(".")) if kind == "ip" else 0, "card": 13 <= len(digits) <= 19 and privacy.luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]

    r = random.Random(1)
    for _ in range(5000):
        t = "".join(r.choice("aA1.@+ -()%9é\n05") for _ in range(r.randint(1, 60)))
        assert privacy.base_spans(t) == [(k, m.start(), m.end()) for k, p in patterns.items() for m in re.finditer(p, t) if fits(k, m[0])]
    assert len(privacy.emails("@" * 20000 + "a@b.c")) == 1


def test_privacy_terms_disclose(spark, empty):
    card = "4539578763621486"
    rows = [(i, f"{prose(i, 30)} mister Zebedee {WORDS[i]} pays {card} with {prose(50 + i, 30)}") for i in range(5)] + [(100 + i, f"{prose(70 + i, 60)} pays with") for i in range(600)]
    found = privacy.sanitise(spark.createDataFrame(rows, "doc_id long, text string"))
    by = {r.k: r.spans for r in found.collect()}
    text = dict(rows)
    terms = {text[0][s.start : s.stop] for s in by[0] if s.kind == "term"}
    assert "Zebedee" in terms and "pays" not in terms
    assert all(not by[k] for k in by if k >= 100)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    red = {r.doc_id: r.text for r in privacy.redact(docs, found).collect()}
    assert "[CARD]" in red[0] and "Zebedee" not in red[0] and red[100] == text[100]
    assert privacy.sanitise(empty).count() == 0


def test_licences(spark, empty):
    cases = {"Licensed under the Apache License, Version 2.0.": ("apache", "apache-2.0"), "released under CC BY-NC 4.0": ("cc-by", "cc-by-nc-4.0"), "SPDX-License-Identifier: MIT": ("", "mit"), "nothing here": ("", None), None: ("", None), "gnu general public license version 3 mit license mit license": ("gpl", "gpl-3.0")}
    rows = licences.scan(spark.createDataFrame([(t,) for t in cases], "text string")).collect()
    for r in rows:
        base, label = cases[r.text]
        assert not base or base in {p.label for p in r.places}
        labels = {m.label for m in r.matches}
        assert (label in labels) if label else not labels
    last = next(r for r in rows if r.text and r.text.startswith("gnu"))
    assert [(p.label, p.at) for p in last.places if p.label == "mit"] == [("mit", 6), ("mit", 8)]
    assert len(licences.rules()) > 300 and licences.scan(empty).count() == 0


def test_cws_estimates_generalised_jaccard(docs, empty):
    rows = cws.fingerprint_pairs(docs, samples=64).collect()
    assert len(rows) == docs.count()
    source = sorted(((-1 if r.doc_id is None else r.doc_id, r.text or "") for r in docs.collect()))
    got = sorted(rows, key=lambda r: (-1 if r.k is None else r.k))

    def jaccard(a, b):
        a, b = Counter(a.lower().split()), Counter(b.lower().split())
        return sum((a & b).values()) / sum((a | b).values()) if a or b else 1.0

    errors = []
    for i, ((_, t), r) in enumerate(zip(source, got, strict=True)):
        nxt = source[(i + 1) % len(source)][1]
        edited = t[: len(t) - len(t) // 2] + nxt[: len(t) // 2]
        assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        errors.append(np.mean([x == y for x, y in zip(r.sig, r.edited_sig, strict=True)]) - jaccard(t, edited))
    assert np.abs(errors).mean() < 0.1
    equal = {r.sig[0] for r in got if r.k in (0, 1, 10)}
    assert len(equal) == 1 and cws.fingerprint_pairs(empty).count() == 0


def brute_repeats(rows):
    seen, out = set(), []
    for k, t in sorted(rows, key=lambda r: (repeats.FIRST_KEY if r[0] is None else r[0], (r[1] or "").encode())):
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - 99):
            if b[i : i + 100] in seen:
                gone[i : i + 100] = True
            seen.add(b[i : i + 100])
        out.append((str(k), np.frombuffer(b, np.uint8)[~gone].tobytes()))
    return sorted(out)


@pytest.mark.parametrize(("block", "hot"), [(1 << 24, 8000), (3000, 2)])
def test_repeats_are_exact(docs, empty, block, hot):
    want = brute_repeats([(r.doc_id, r.text) for r in docs.collect()])
    got = sorted((str(r.k), bytes(r.kept)) for r in repeats.remove_repeats(docs, block=block, hot=hot).collect())
    assert got == want
    assert repeats.remove_repeats(empty).count() == 0


def test_interval_expansion_finds_common_prefixes():
    r = random.Random(2)
    data = "".join(r.choice("ab") for _ in range(3000))
    data += data[500:1500]
    symbols = np.concatenate((np.frombuffer(data.encode(), np.uint8).astype(np.int64) + 1, [0]))
    left = np.arange(len(data), -1, -1)
    order = repeats.suffix_order(symbols, left)
    opened = repeats.open_rows(symbols, order)
    for i in range(1, len(order)):
        a, b = data[order[i - 1] :][:100], data[order[i] :][:100]
        assert opened[i] == (len(a) == 100 and a == b)


def test_token_file_round_trip(docs, empty, spark, tmp_path):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    folder = f"file://{tmp_path}/t"
    tokenfile.encode_corpus(docs, folder, block=500)
    want, at = [], 0
    ordered = sorted(((-1 if r.doc_id is None else r.doc_id), np.array([*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 0], "<u2").tobytes()) for r in docs.collect())
    for k, b in ordered:
        ids = np.frombuffer(b, "<u2").astype("<u4")
        want.append((k, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    got = sorted(((-1 if r.doc is None else r.doc), r.start, r.n_tokens, r.ids_crc32) for r in tokenfile.digests(spark, folder).collect())
    assert got == sorted(want)
    tokenfile.encode_corpus(empty, f"file://{tmp_path}/e")
    assert tokenfile.digests(spark, f"file://{tmp_path}/e").count() == 0


def test_pieces_encode_as_the_whole():
    from tokenizers import Tokenizer

    path = tokenizer_path("byte_bpe_50k.json")
    whole = Tokenizer.from_file(path)
    r = random.Random(3)
    for _ in range(20000):
        t = "".join(r.choice(["a", "b", " ", " ", "\n", "\t", "'", "s", ".", "1", "é", "\xa0", "\0", "<|endoftext|>", "中", "\x1c", "　"]) for _ in range(r.randint(0, 14)))
        assert next(iter(tokenfile.tokenize([t], path))).tolist() == whole.encode(t, add_special_tokens=False).ids


def test_codes_are_limited_and_complete():
    counts = np.array([1] + [2**i for i in range(40)])
    lengths = tokenfile.code_lengths(np.arange(41), counts).astype(float)
    assert lengths.max() <= tokenfile.LIMIT and (2.0**-lengths).sum() == 1.0
    codec = tokenfile.Codec(np.arange(41, dtype="<u4").tobytes(), lengths.astype(np.uint8).tobytes())
    ids = np.random.default_rng(1).integers(0, 41, 5000).astype(np.uint32)
    assert (codec.decode(*codec.encode(ids), len(ids)) == ids).all()
    assert tokenfile.crc_combine(zlib.crc32(b"ab"), zlib.crc32(b"c" * 999), 999) == zlib.crc32(b"ab" + b"c" * 999)


def test_lm_counts_and_normalisation(docs, empty):
    scored, total = lm.score_texts(docs, block=4000)
    train, rows = Counter(), [(r.doc_id, r.text) for r in docs.collect()]
    split = {}
    for k, t in rows:
        w = [*(t or "").encode().lower().split(), None]
        split[k, t] = w
        if k is not None and zlib.crc32(str(k).encode()) % 10:
            train.update(w)
    n, v = sum(train.values()), len(train)
    assert total == n
    want = Counter((str(k), len(w), sum(train[x] > 0 for x in w), round(sum(np.log10((train[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w), 6)) for (k, _), w in ((key, split[key]) for key in rows))
    got = Counter((str(r.k), r.n_tokens, r.n_known, round(r.base_score, 6)) for r in scored.collect())
    assert got == want
    assert lm.score_texts(empty)[0].count() == 0


def test_automaton_weights_sum_to_one():
    end, bits = int(lm.END), 64
    flat = lambda texts: (np.array([w for t in texts for w in t], np.uint64), np.cumsum([0, *map(len, texts)]))
    corpus, begin = flat([[1, 2, 1, 3, end], [1, 2, 2, end], [2, 1, 2, 1, end], [end]])
    two, three, _ = lm.grams(corpus, begin, bits)
    trained = [Counter(x.tolist()) for x in (corpus, two, three)]
    once = sum(n == 1 for n in trained[0].values())

    def score(texts):
        word, at = flat([*texts, [end]])  # a block's texts have ends: they say how many texts there are
        keys = (word, *lm.grams(word, at, bits)[:2])
        counts = [np.array([c[int(k)] for k in np.unique(x)], float) for c, x in zip(trained, keys, strict=True)]
        return lm.Automaton(word, at, bits, counts, len(corpus), once).run()[:-1]

    known = [1, 2, 3, end]
    for history in ([], [1], [3], [99], [1, 2], [2, 1], [3, 3], [99, 1], [1, 99], [2, 1, 2]):
        after = score([[*history, w] for w in [*known, 99]])  # every known word and the unknown one
        before = score([history])[0] if history else 0.0
        assert abs(sum(10 ** (after - before)) - 1) < 1e-9


def test_decontamination_against_brute_force(spark, docs, empty):
    items = [(1, prose(11, 30) + ". " + prose(12, 6) + "."), (2, "short one"), (3, None), (4, ""), (5, prose(13, 60))]
    part = items[0][1].split()
    part[3] = "other"
    rows = [(1, prose(20, 400) + " " + items[0][1] + " " + prose(21, 100)), (2, " ".join(part)), (3, prose(22, 500)), (4, None), (5, ""), (6, items[4][1].upper().lower()), (7, "a short one here")]
    d, b = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc, r.item) for r in decontaminate.leaks(d, b).collect()}
    assert got == {(1, 1), (2, 1), (6, 5), (7, 2)}
    assert {r.doc_id for r in decontaminate.clean(d, b).collect()} == {3, 4, 5}
    assert decontaminate.leaks(empty, b).count() == 0 and decontaminate.clean(docs, spark.createDataFrame([], "item_id long, text string")).count() == docs.count()


def test_near_duplicates_keep_one(docs, empty):
    kept = [(r.doc_id, r.text) for r in neardup.deduplicate(docs).collect()]
    keys = [k for k, _ in kept]
    assert 0 in keys and not {1, 2, 10} & set(keys)
    assert sum(not (t or "").split() for _, t in kept) == 1
    assert keys.count(7) == 1 and {8, 9, 11} <= set(keys)
    assert neardup.deduplicate(empty).count() == 0 and neardup.deduplicate(docs).columns == docs.columns


def test_toxicity_learns_and_is_whole(spark, docs, empty):
    r = random.Random(4)
    rows, labels = [], []
    for i in range(600):
        bad = i % 4 == 0
        w = prose(1000 + i, r.randint(5, 200)).split()
        if bad:
            for _ in range(3):
                w.insert(r.randint(0, len(w)), r.choice(["vile", "rotten", "filthy"]))
        rows.append((i, " ".join(w), "en" if i // 4 % 2 else "fr"))
        labels.append((i, int(bad)))
    d, y = spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.train(spark, d, y)
    got = {x.doc_id: x for x in toxicity.score(d, model).collect()}
    held = [i for i in range(600) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert np.mean([got[i].predicted == labels[i][1] for i in held]) > 0.95
    assert all(0 <= x.score <= 1 for x in got.values()) and set(model.thresholds) == {"en", "fr"}
    odd = toxicity.score(docs, model)
    assert odd.count() == docs.count() and odd.columns.count("score") == 1
    nothing = toxicity.train(spark, docs, y.limit(0))
    assert toxicity.score(docs, nothing).where(F.col("score").isNull()).count() == 0
    assert toxicity.score(empty, model).count() == 0


def test_pipeline_on_the_smallest_tables(spark):
    import os

    import corpus_pipeline

    data = "/root/testdata/sf0.001"
    if not os.path.isdir(data):
        pytest.skip("no test tables")
    docs = spark.read.parquet(f"{data}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, data)
        assert out.columns == docs.columns
    assert corpus_pipeline.run(spark, data).columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
