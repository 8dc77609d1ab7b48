"""Near-duplicate groups against brute force: groups around a centre, and texts of all lengths."""

import random

from chronoweave.llm import neardup


def shingle_set(text):
    w = text.split()
    k = min(5, len(w))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()


def brute_kept(texts):
    sets = [shingle_set(t) for t in texts]
    parent = list(range(len(texts)))

    def find(v):
        while parent[v] != v:
            v = parent[v]
        return v

    links = 0
    for i, a in enumerate(sets):
        for j in range(i):
            if len(a & sets[j]) >= 0.8 * len(a | sets[j]):
                links += 1
                x, y = sorted((find(i), find(j)))
                parent[y] = x
    return sorted(i for i in range(len(texts)) if find(i) == i), links


def words(r, n):
    return [f"w{r.randrange(10**9)}" for _ in range(n)]


def kept(spark, texts):
    return sorted(x.doc_id for x in neardup.deduplicate(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect())


def test_a_group_whose_centre_is_not_its_shortest_text(spark):
    r = random.Random(1)
    base, texts = words(r, 300), []
    for _ in range(250):
        near = list(base)
        for at in range(0, 300, 50):
            near[at + r.randrange(45)] = words(r, 1)[0]
        texts.append(" ".join(near))
    texts.insert(100, " ".join(base))
    want, links = brute_kept(texts)
    assert len(want) == 1 and links >= 250
    assert kept(spark, texts) == want


def test_recall_over_all_lengths(spark):
    r = random.Random(2)
    texts = []
    for n in [5, 6, 8, 10, 12, 16, 20, 25, 30, 40, 60, 100, 200, 350, 500]:
        for _ in range(20):
            base = words(r, n)
            texts.append(" ".join(base))
            texts.append(" ".join([*base, *words(r, 1)]))
            near = list(base)
            for at in r.sample(range(n), max(1, n // 60)):
                near[at] = words(r, 1)[0]
            texts.append(" ".join(near))
    want, links = brute_kept(texts)
    assert links > 300
    assert kept(spark, texts) == want


def test_marks_of_the_same_texts_count_once_and_large_marks_have_several_hubs(spark):
    marked = spark.createDataFrame([(node, s, i, 60) for node in range(64) for s, i in ((7, 2), (5, 3), (6, 4))] + [(0, 8, 5, 60), (1, 8, 5, 60)], "node long, s long, i int, n int")
    alone = spark.createDataFrame([], "node long, root long")
    rows = neardup.open_rows(marked, alone)
    assert sorted((r.s, r["count"]) for r in rows.groupBy("s").count().collect()) == [(7, 64), (8, 2)]
    assert neardup.crossing(rows) == 64 * 63 // 2 + 1
    ends = neardup.hub_pairs(rows, 0, 0.8).collect()
    assert len(ends) <= 66 and len({x for r in ends for x in r}) > 60
    degrees = [sum(n in r for r in ends) for n in range(64)]
    assert max(degrees) < 40  # one hub had all
    assert neardup.open_pairs(rows, 0.8).count() == 64 * 63 // 2
    joined = neardup.open_rows(marked, spark.createDataFrame([(n, 0) for n in range(64)], "node long, root long"))
    assert joined.count() == 0 and neardup.crossing(joined) == 0
