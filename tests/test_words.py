"""Tokens of compatibility forms, and word times against a replay in plain Python over random clips."""

import math
import random
import re
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoweave.functions import text as T
from chronoweave.operators import alignment, words

TOKEN = re.compile(r"[A-Za-z0-9]+(?:['’\-][A-Za-z0-9]+)*")


def plain(value):
    value = unicodedata.normalize("NFKC", value).lower().strip().replace("’", "'").replace("‘", "'")
    return re.sub(r"[^a-z0-9']+", "", value)


def test_every_code_point_and_many_strings(spark):
    r = random.Random(1)
    pool = [*"aeIoS xZi1'-", *map(chr, range(0x300, 0x370)), "ﬁ", "½", "İ", "K", "’", "Ａ", "①"]
    texts = [x for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000 and (c < 0x3400 or c > 0xF8FF and c < 0x20000 or c % 97 == 0) for x in (f"x{chr(c)}b",)]
    texts += ["".join(r.choice(pool) for _ in range(r.randint(1, 9))) for _ in range(20_000)]
    frame = spark.createDataFrame([(t,) for t in texts], "t string").repartition(4)
    for row in frame.select("t", T.normalize_token(F.col("t")).alias("n"), T.tokenize(F.col("t")).alias("k")).collect():
        assert row.n == plain(row.t) and row.k == TOKEN.findall(unicodedata.normalize("NFKC", row.t)), row.t


def test_places_in_the_given_text(spark):
    texts = ["Ａｂｃ ﬁne ½ x", "no change", "", None, "ﬃﬃ", "a ⅓½b", "éte ﬂag"]
    got = {}
    for r in words.tokens(spark.createDataFrame(list(enumerate(texts)), "id int, t string"), "id", "t").collect():
        got.setdefault(r.id, []).append((r.n, r.word, r.start_char, r.end_char))
    assert sorted(got[0]) == [(0, "Abc", 0, 3), (1, "fine", 4, 7), (2, "1", 8, 9), (3, "2", 8, 9), (4, "x", 10, 11)]
    assert sorted(got[1]) == [(0, "no", 0, 2), (1, "change", 3, 9)] and set(got) == {0, 1, 4, 5, 6}
    assert sorted(got[4]) == [(0, "ffiffi", 0, 2)] and sorted(got[6])[-1][1:] == ("flag", 5, 8)
    assert sorted(got[5]) == [(0, "a", 0, 1), (1, "1", 2, 3), (2, "31", 2, 4), (3, "2b", 3, 5)]


def best_alignment(target, source, ratio):
    """Matches of the best path by the whole table, cell by cell."""
    n, m = len(target), len(source)

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    table = [[(-math.inf, None)] * (m + 1) for _ in range(n + 1)]
    table[0][0] = (0.0, None)
    for i in range(n + 1):
        for j in range(m + 1):
            if i == j == 0:
                continue
            offers = []
            if i > 1 and j and target[i - 2] and target[i - 1] and target[i - 2] + target[i - 1] == source[j - 1]:
                offers.append((2, 1, 2.65, "equivalent_compound"))
            if i and j > 1 and source[j - 2] and source[j - 1] and target[i - 1] == source[j - 2] + source[j - 1]:
                offers.append((1, 2, 2.65, "equivalent_compound"))
            if i and j and target[i - 1] and source[j - 1]:
                d = distance(target[i - 1], source[j - 1]) / max(len(target[i - 1]), len(source[j - 1]))
                if d == 0:
                    offers.append((1, 1, 3.0, "exact"))
                elif d <= ratio:
                    offers.append((1, 1, 1.25 - d, "edit_distance"))
            if i:
                offers.append((1, 0, -0.75, ""))
            if j:
                offers.append((0, 1, -0.15, ""))
            for a, b, gain, kind in offers:
                total = table[i - a][j - b][0] + gain
                if total > table[i][j][0] + 1e-9:
                    table[i][j] = (total, (a, b, kind))
    out, i, j = [], n, m
    while i or j:
        a, b, kind = table[i][j][1]
        if kind:
            out.append((range(i - a, i), range(j - b, j), kind))
        i, j = i - a, j - b
    return out[::-1]


def replay(text, heard, duration, ratio=0.34, trust=0.2, least=0.01):
    """Records of one clip by the rules, step by step."""
    f32 = lambda v: float(np.float32(v))

    def clip(a, b):
        a, b = float(np.clip(a, 0, duration)), float(np.clip(b, 0, duration))
        return (b, a) if b < a else (a, b)

    def stored(a, b, shortest=0.0):
        if not (math.isfinite(a) and math.isfinite(b)):
            return None
        a, b = f32(a), f32(b)
        return (a, b) if a >= 0 and b <= f32(duration) and b > a and b - a >= shortest else None

    key = lambda w: T.EQUIVALENTS.get(plain(w).replace("'", ""), plain(w).replace("'", ""))
    target = [m[0] for m in TOKEN.finditer(text)]
    source = []
    for index, (word, a, b, c) in enumerate(heard):
        if a is None or b is None:
            continue
        a, b = clip(a, b)
        if b <= a or not plain(word.strip()):
            continue
        source.append((index, word, a, b, min(max(c or 1.0, 0.0), 1.0)))
    records, used = [None] * len(target), [[] for _ in target]
    for ts, ss, kind in best_alignment([key(w) for w in target], [key(s[1]) for s in source], ratio):
        a, b = min(source[s][2] for s in ss), max(source[s][3] for s in ss)
        sure = 1.0 if kind == "exact" else min({"equivalent_compound": 0.85, "edit_distance": 0.65}[kind], *(source[s][4] for s in ss))
        when = stored(a, b)
        for t in ts:
            used[t] = [source[s][0] for s in ss]
            if when:
                records[t] = (*when, sure, kind, False, [source[s][0] for s in ss])
    open_ = [t for t, r in enumerate(records) if r is None]
    out = list(records)
    for t in open_:
        left = max((u for u in range(t) if records[u]), default=None)
        right = min((u for u in range(t + 1, len(target)) if records[u]), default=None)
        low = min(records[left][1], duration) if left is not None else 0.0
        high = max(records[right][0] if right is not None else duration, low)
        a, b = low + (high - low) * open_.index(t) / len(open_), low + (high - low) * (open_.index(t) + 1) / len(open_)
        when = stored(*clip(a, b), least) if f32(b) - f32(a) >= 0 else None
        out[t] = (*(when or (None, None)), trust, "boundary_or_uniform_fallback" if when else "invalid_fallback", True, used[t])
    return [(w, *r) for w, r in zip(target, out, strict=True)]


@pytest.mark.parametrize("seed", range(3))
def test_word_times_of_random_clips(spark, seed):
    r = random.Random(seed)
    vocabulary = ["can't", "cannot", "colour", "color", "ice", "cream", "icecream", "I'm", "iam", "the", "fade", "fades", "well", "...", "don’t", "dont"]
    clips, heard = [], []
    for i in range(60):
        text = " ".join(r.choice(vocabulary) for _ in range(r.randint(0, 9)))
        duration = r.choice([0.02, 3.0, 10.0])
        own = []
        at = 0.0
        for w in (text.split() if r.random() < 0.8 else []) + [r.choice(vocabulary)]:
            if r.random() < 0.75:
                a, b = at, at + r.random()
                at = b
                kind = r.random()
                a, b = (b, a) if kind < 0.1 else (a, None) if kind < 0.15 else (a, float("nan")) if kind < 0.22 else (float("nan"), b) if kind < 0.26 else (a, float("inf")) if kind < 0.3 else (float("-inf"), b) if kind < 0.33 else (a, b)
                own.append((w if r.random() < 0.8 else r.choice(vocabulary), a, b, r.choice([None, 0.0, 0.4, 0.9, 1.7, -0.5])))
        clips.append((i, text, duration, own))
        heard += [(i, n, *w) for n, w in enumerate(own)]
    samples = spark.createDataFrame([c[:3] for c in clips], "id long, text string, duration double")
    frame = spark.createDataFrame(heard, "id long, index long, word string, start double, stop double, confidence double")
    got = {}
    for x in words.align_text_words(samples, frame).collect():
        got.setdefault(x.id, []).append((x.n, x.word, x.start, x.stop, x.confidence, x.match_type, x.fallback, list(x.source_indices)))
    for i, text, duration, own in clips:
        want = replay(text, own, duration)
        have = [x[1:] for x in sorted(got.get(i, []))]
        assert [h[0] for h in have] == [w[0] for w in want]
        for h, w in zip(have, want, strict=True):
            assert h[4:] == w[4:] and abs(h[3] - w[3]) < 1e-12, (i, text, own, h, w)
            assert (h[1] is None) == (w[1] is None) and (h[1] is None or max(abs(h[1] - w[1]), abs(h[2] - w[2])) < 1e-5), (i, h, w)


def test_greedy_tracks_of_random_boxes(spark):
    r = random.Random(9)
    rows, want = [], {}
    for sample in range(25):
        open_, made, key = [], 0, 0
        for frame in sorted(r.sample(range(30), 12)):
            boxes = []
            for _ in range(r.randint(0, 4)):
                x, y, w, h = r.choice([0, 1, 2, 5]), r.choice([0, 1]), r.choice([2, 3, -1]), r.choice([2, 3])
                boxes.append((key, x, y, x + w, y + h, r.choice([0.5, 0.7, 0.9])))
                key += 1
            rows += [(sample, frame, *b) for b in boxes]
            matched = set()
            for k, *box, _ in sorted(boxes, key=lambda b: (-b[5], b[0])):
                best, found = 0.0, None
                for t in open_:
                    if t["n"] in matched or frame - t["frame"] > 3:
                        continue
                    p = t["box"]
                    inter = max(min(box[2], p[2]) - max(box[0], p[0]), 0) * max(min(box[3], p[3]) - max(box[1], p[1]), 0)
                    area = lambda q: max(q[2] - q[0], 0) * max(q[3] - q[1], 0)
                    share = inter / max(area(box) + area(p) - inter, 1e-12)
                    if share > best:
                        best, found = share, t
                if found is None or best < 0.3:
                    found = {"n": made}
                    made += 1
                    open_.append(found)
                else:
                    matched.add(found["n"])
                found |= {"frame": frame, "box": box}
                want[sample, k] = found["n"]
    frame = spark.createDataFrame(rows, "sample int, frame int, key int, x0 int, y0 int, x1 int, y1 int, confidence double").repartition(3)
    got = {(x.sample, x.key): x.track for x in alignment.tracks(frame, "sample", "frame", "key", "confidence", 0.3, 3).collect()}
    assert got == want
