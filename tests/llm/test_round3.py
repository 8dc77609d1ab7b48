"""Cross-tokenizer alignment, URL rules and ranked search against brute force."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from chronoweave.llm import crosstoken, ranked, urls

ODD = [None, "", " ", "   x  y ", "a▁b c", "<|endoftext|> <s>hi</s> <unk>", "x\ty\n\nz  　w   q", "a" * 3000, "▁", "日本語 テキスト😀😀 naïve", "a\0b c", "a\0b c", "....,,, .,. hello.\nworld ,x", "1234567890" * 200, "\x85 \x1c x y"]
WORDS = ["alpha", "beta", "Gamma", "delta", "epsilon", "Über", "naïve", "the", "of", "and"]


def prose(seed, n, most=40):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + (str(r.randint(0, most)) if r.random() < 0.5 else "") for _ in range(n))


def same_rows(got, want):
    key = lambda r: (r[0] is None, r[0] or 0, *map(str, r[1:]))
    assert sorted(got, key=key) == sorted(want, key=key)


def groups_of(text):
    """Groups of a text by stepping through both lists of tokens."""
    import public_tokenizers
    import sentencepiece
    from tokenizers import Tokenizer

    if not hasattr(groups_of, "held"):
        a, b = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
        a.encode_special_tokens = True
        groups_of.held = a, b, {i: t for t, i in a.get_vocab().items()}
    a, b, name = groups_of.held
    if not text:
        return []
    value = crosstoken.byte_values()
    left = [(i, bytes(value[c] for c in name[i])) for i in a.encode(f" {text}", add_special_tokens=False).ids]
    right = [(i, bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()) for i in b.encode(text) for p in [b.id_to_piece(i)]]
    if any(b"".join(x for _, x in side) != f" {text}".encode() for side in (left, right)):
        return []
    out, own, at, i, j = [], ([], []), [0, 0], 0, 0
    while i < len(left) or j < len(right):
        if at[0] <= at[1] and i < len(left):
            own[0].append(left[i][0])
            at[0] += len(left[i][1])
            i += 1
        else:
            own[1].append(right[j][0])
            at[1] += len(right[j][1])
            j += 1
        if at[0] == at[1]:
            out.append(own)
            own = ([], [])
    return out


def test_alignment_of_two_vocabularies(spark):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(100 + i, prose(i, 3 * i)) for i in range(60)] + [(100, prose(5, 15)), (None, "null key")]
    groups = [groups_of(t) for _, t in rows]
    held, best = Counter(), Counter()
    for g in groups:
        held.update({(x, y) for a, b in g for x in a for y in b})
    for (x, _), n in held.items():
        best[x] = max(best[x], n)
    want = []
    for (k, _), g in zip(rows, groups, strict=True):
        links = [(x, y) for a, b in g for x in a for y in b]
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in g)
        want.append((k, sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), len(links), sum(held[p] == best[p[0]] for p in links), sum(held[p] for p in links), hashlib.sha256(text.encode()).hexdigest() if text else ""))
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, k string").repartition(3)
    same_rows([tuple(r) for r in crosstoken.align_corpus(docs).collect()], want)
    got = {r.k: r.groups for r in crosstoken.token_groups(docs.where("doc_id < 100")).collect()}
    for (k, t), g in list(zip(rows, groups, strict=True))[: len(ODD)]:
        assert [(list(x.a), list(x.b)) for x in got[k]] == [tuple(x) for x in g], t
        if g:
            assert [x.start for x in got[k]] == [0, *[x.stop for x in got[k]][:-1]] and got[k][-1].stop == len(f" {t}".encode())
    named = docs.selectExpr("concat('d', doc_id) AS doc_id", "text")
    assert crosstoken.align_corpus(named).count() == len(rows)
    assert crosstoken.align_corpus(docs.limit(0)).count() == 0


def test_wide_groups_are_merged_before_pairs(monkeypatch):
    own = crosstoken.vocabularies(crosstoken.tokenizer_path("byte_bpe_50k.json"), crosstoken.tokenizer_path("piece_bpe_32k.model"))
    texts = [t for t in ODD if t] + [prose(i, 40) for i in range(5)]
    x = crosstoken.Alignment(own, texts)
    plain = x.links(len(own.b_bytes))
    monkeypatch.setattr(crosstoken, "WIDE", 1)
    for a, b in zip(plain, x.links(len(own.b_bytes)), strict=True):
        assert (a == b).all()


def judged(url, rules):
    """Host, path, rule and verdict by going through all rules."""
    tail = url.split("://", 1)[1] if url is not None and "://" in url else ""
    host = re.match(r"[^/?#]*", tail)[0]
    path = re.match(r"[^?#]*", tail[len(host) :])[0]
    host = "".join(c.lower() if c.isascii() else c for c in host)
    fits = [(len((h + p).encode()), len(h.encode()), h + p, v) for h, p, v in rules if (host == h or host.endswith(f".{h}")) and path.startswith(p)]
    best = max(fits, default=None, key=lambda x: (x[0], x[1], x[3] == "block"))
    return host, path, best and best[2], best[3] if best else "allow"


@pytest.mark.parametrize("bits", [64, 7])
def test_rules_against_all_of_them(spark, bits):
    r = random.Random(bits)
    names = ["a", "b", "cd", "www", "x-y", "com", "org"]
    rules = [(".".join(r.choice(names) for _ in range(r.randint(1, 3))), "".join(f"/{r.choice(names)}" for _ in range(r.randint(0, 2))) + r.choice(["", "/", "1"]), r.choice(["allow", "block"])) for _ in range(400)]
    rules += [rules[0], (*rules[1][:2], "allow"), (*rules[1][:2], "block"), ("bücher.org", "/ü", "block")]
    pages = [f"http{r.choice(['', 's'])}://{'.'.join(r.choice(names) for _ in range(r.randint(1, 4))).title()}{''.join('/' + r.choice(names) for _ in range(r.randint(0, 3)))}{r.choice(['', '/', '1x', '?q=/a', '#/b'])}" for _ in range(800)]
    pages += [None, "", "nothing", "://", "http://", "http:///a", "HTTP://COM", "http://a.com:80/a", "a://b://com/a", "http://www.bücher.org/über", "http://com?x", pages[0]]
    frame = spark.createDataFrame(list(enumerate(pages)), "page_id int, url string").selectExpr("*", "'mine' AS host", "1 AS __size").repartition(3)
    table = spark.createDataFrame(rules, "host string, path string, verdict string")
    got = {x.page_id: (x.host, x.path, x.rule, x.verdict) for x in urls.judge(frame, table, bits=bits).collect()}
    assert got == {i: judged(u, rules) for i, u in enumerate(pages)}


def test_rules_in_shards_and_none(spark, monkeypatch):
    frame = spark.createDataFrame([(i, f"http://h{i % 50}.org/a{i % 7}/b") for i in range(300)], "page_id int, url string")
    rules = [(f"h{i}.org", f"/a{j}", "block") for i in range(40) for j in range(0, 7, 2)] + [("org", "/", "allow")]
    table = spark.createDataFrame(rules, "host string, path string, verdict string")
    monkeypatch.setattr(urls, "SHARD_BYTES", 2000)
    got = {x.page_id: (x.rule, x.verdict) for x in urls.judge(frame, table).collect()}
    assert got == {i: judged(f"http://h{i % 50}.org/a{i % 7}/b", rules)[2:] for i in range(300)}
    assert {(x.rule, x.verdict) for x in urls.judge(frame, table.limit(0), default="block").collect()} == {(None, "block")}
    assert urls.judge(frame.limit(0), table).count() == 0
    with pytest.raises(ValueError, match="no host"):
        urls.judge(frame, spark.createDataFrame([("", "/", "allow")], "host string, path string, verdict string"))


def exhaustive(rows, items, k):
    """Every document's score for every item."""
    terms = [re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in t or "")) for _, t in rows]
    total, length, df = sum(bool(t) for t in terms), sum(map(len, terms)), Counter(x for t in terms for x in set(t))
    out = []
    for key, text in items:
        asked = re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
        scores = []
        for (d, _), t in zip(rows, terms, strict=True):
            tf = Counter(t)
            m = 75 + 25 * len(t) * total // max(length, 1)
            s = sum(math.floor(1000 * math.log((2 * total + 2) / (2 * df[x] + 1))) * (1_000_000_000 * tf[x] // (1000 * tf[x] + 12 * m)) for x in asked if tf[x])
            if s > 0:
                scores.append((-s, d is None, d or 0))
        out += [(key, n + 1, None if null else d, -s) for n, (s, null, d) in enumerate(sorted(scores)[:k])]
    return out


@pytest.mark.parametrize("small", [False, True])
def test_search_against_all_scores(spark, monkeypatch, small):
    if small:
        monkeypatch.setattr(ranked, "DOCUMENTS", 30)
        monkeypatch.setattr(ranked, "SHARD_BYTES", 400)
        monkeypatch.setattr(ranked, "SLICE", 2000)
    rows = [(i, prose(i, i % 70, 9)) for i in range(300)] + [(1000 + i, prose(7, 30, 9)) for i in range(120)] + [(5, prose(8, 44)), (None, prose(7, 30, 9)), (None, None), (600, ""), (601, "--- !"), (602, "quux " * 5000), (603, "quux")]
    items = [(i, prose(i, 2 + i % 12, 9)) for i in range(25)] + [(3, prose(7, 30, 9)), (3, prose(7, 30, 9)), (80, ""), (81, None), (82, "unheard-of"), (83, "QUUX quux"), (None, "alpha1 beta")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, doc int").repartition(4)
    asked = spark.createDataFrame(items, "item_id int, text string")
    for k in (1, 20):
        same_rows([tuple(r) for r in ranked.ranked(docs, asked, k).collect()], exhaustive(rows, items, k))
    if not small:
        assert ranked.ranked(docs.limit(0), asked).count() == 0 and ranked.ranked(docs, asked.limit(0)).count() == 0
        named = docs.where("doc_id is not null").selectExpr("lpad(doc_id, 5, '0') AS doc_id", "text")
        assert {(r.item, r.rank, int(r.doc)) for r in ranked.ranked(named, asked).collect()} == {r[:3] for r in exhaustive([r for r in rows if r[0] is not None], items, 20)}


def test_branch_and_bound_on_random_trees():
    rng = np.random.default_rng(5)
    for trial in range(150):
        documents, terms = int(rng.integers(1, 700)), int(rng.integers(1, 12))
        there = rng.random((terms, documents)) < rng.choice([0.02, 0.3, 1.0])
        impact = rng.integers(1, 4 if trial % 2 else 1000, (terms, documents)) * there
        term, doc = np.nonzero(there)
        tree = ranked.Tree(term, doc, impact[term, doc], documents)
        asked, times = np.unique(rng.integers(0, terms + 2, 6), return_counts=True)
        scores = sum((n * impact[t] for t, n in zip(asked, times, strict=True) if t < terms), np.zeros(documents, np.int64))
        k, floor = int(rng.integers(1, 25)), int(rng.choice([0, np.median(scores)]))
        want = sorted([(-int(s), d) for d, s in enumerate(scores) if s > 0 and s >= floor])[:k]
        assert tree.search(asked, times, k, floor) == [(-s, d) for s, d in want]
