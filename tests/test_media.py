"""Scans that turn errors into rows, frame times, image streams, prosody."""

import io
import math
import random
import struct

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from chronoweave.operators import audio
from chronoweave.sources import media, scan


def test_a_cut_file_is_one_row_of_error(spark, tmp_path):
    def content(table):
        sink = io.BytesIO()
        pq.write_table(table, sink)
        return sink.getvalue()

    good = content(pa.table({"id": [1, 2, 3], "v": ["a", None, "c"], "more": [1.0] * 3}))
    files = {
        "a.parquet": good, "deep/b.parquet": content(pa.table({"v": ["x"], "id": pa.array([7], pa.int32())})), "cut.parquet": good[:-9], "half.parquet": good[: len(good) // 2],
        "text.parquet": b"not a table", "empty.parquet": b"", "lacks.parquet": content(pa.table({"id": [1]})), "other.parquet": content(pa.table({"id": ["one"], "v": ["x"]})), "none.parquet": content(pa.table({"id": pa.array([], pa.int64()), "v": pa.array([], pa.string())})),
    }
    (tmp_path / "deep").mkdir()
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    (tmp_path / "readme.txt").write_text("skipped")
    rows = scan.scan_parquet(spark, f"file://{tmp_path}", "id bigint, v string").cache()
    assert sorted((r.id, r.v or "", r.source_file) for r in rows.where("load_error is null").collect()) == [(1, "a", "a.parquet"), (2, "", "a.parquet"), (3, "c", "a.parquet"), (7, "x", "b.parquet")]
    report = {r.source_file: (r.rows, bool(r.error)) for r in scan.load_report(rows).collect()}
    assert report == {"a.parquet": (3, False), "b.parquet": (1, False), **{f"{n}.parquet": (0, True) for n in ("cut", "half", "text", "lacks", "other")}}
    assert "no column v" in rows.where("source_file = 'lacks.parquet'").first().load_error


def test_large_files_stay_unread(spark, tmp_path, monkeypatch):
    pq.write_table(pa.table({"id": [1]}), tmp_path / "a.parquet")
    monkeypatch.setattr(scan, "MOST_BYTES", 10)
    assert scan.scan_parquet(spark, f"file://{tmp_path}", "id bigint").first().load_error == "larger than 10 bytes"


def test_lines_that_are_no_json(spark, tmp_path):
    (tmp_path / "x.json").write_text('{"id": 1, "v": "a"}\n{"id": 2, "v"\n{"id": "two", "v": "b"}\n{"v": null}\n')
    got = [(r.id, r.v, r.source_file, r.load_error) for r in scan.scan_json(spark, f"file://{tmp_path}", "id bigint, v string").collect()]
    assert got == [(1, "a", "x.json", None), (None, None, "x.json", '{"id": 2, "v"'), (None, None, "x.json", '{"id": "two", "v": "b"}'), (None, None, "x.json", None)]


def box(kind, *parts):
    body = b"".join(parts)
    return struct.pack(">I", 8 + len(body)) + kind + body


def full(kind, version, body):
    return box(kind, bytes([version, 0, 0, 0]), body)


def track(kind, scale, stts, ctts=None, elst=None, version=0):
    table = [full(b"stts", 0, struct.pack(">I", len(stts)) + b"".join(struct.pack(">II", *e) for e in stts))]
    if ctts:
        table.append(full(b"ctts", version, struct.pack(">I", len(ctts)) + b"".join(struct.pack(">Ii" if version else ">II", *e) for e in ctts)))
    media_ = box(b"mdia", full(b"mdhd", 0, struct.pack(">IIII", 0, 0, scale, 0) + b"\0" * 4), full(b"hdlr", 0, b"\0" * 4 + kind + b"\0" * 12), box(b"minf", box(b"stbl", *table)))
    edit = [box(b"edts", full(b"elst", 0, struct.pack(">I", len(elst)) + b"".join(struct.pack(">IiI", *e, 1 << 16) for e in elst)))] if elst else []
    return box(b"trak", *edit, media_)


def movie(scale, *tracks):
    return box(b"ftyp", b"isom") + box(b"mdat", b"\0" * 100) + box(b"moov", full(b"mvhd", 0, struct.pack(">IIII", 0, 0, scale, 0) + b"\0" * 80), *tracks)


def shown(scale, movie_scale, stts, ctts=(), elst=()):
    """Frame times step by step."""
    deltas = [d for n, d in stts for _ in range(n)]
    offsets = [o for n, o in ctts for _ in range(n)]
    out, t = [], 0
    frames = []
    for i, d in enumerate(deltas):
        frames.append((i, (t + (offsets[i] if i < len(offsets) else 0)) / scale, d / scale))
        t += d
    if not elst:
        return frames
    at = 0.0
    for units, begin in elst:
        length = units / movie_scale
        if begin >= 0:
            out += [(i, pts - begin / scale + at, d) for i, pts, d in frames if pts + d > begin / scale and pts < begin / scale + length]
        at += length
    return out


def test_frame_times_of_sample_tables(spark):
    cases = {
        "plain": dict(stts=[(5, 512), (2, 256)]),
        "reordered": dict(stts=[(6, 512)], ctts=[(1, 1024), (2, 512), (3, 2048)], elst=[(400, 1024)]),
        "signed": dict(stts=[(4, 512)], ctts=[(2, -512), (2, 256)], version=1),
        "waits": dict(stts=[(8, 100)], elst=[(1500, -1), (300, 200), (100, 0)]),
        "none": dict(stts=[]),
    }
    rows = [(k, movie(1000, track(b"soun", 48_000, [(3, 1024)]), track(b"vide", 12_800, c["stts"], c.get("ctts"), c.get("elst"), c.get("version", 0)), track(b"vide", 1, [(9, 9)]))) for k, c in cases.items()]
    rows += [("sound", movie(1000, track(b"soun", 1, [(1, 1)]))), ("junk", b"\0\0\0\x09moov"), ("cut", rows[0][1][:-30]), ("null", None)]
    got = media.frame_times(spark.createDataFrame(rows, "path string, content binary")).collect()
    for k, c in cases.items():
        want = shown(12_800, 1000, c["stts"], c.get("ctts", ()), c.get("elst", ()))
        assert sorted((r.n, round(r.pts, 9), round(r.duration, 9)) for r in got if r.path == k) == sorted((n, round(p, 9), round(d, 9)) for n, p, d in want), k
    assert {r.path for r in got} <= set(cases) | {"cut"}
    timing = {r.path: r for r in media.stream_timing(media.frame_times(spark.createDataFrame(rows, "path string, content binary")), ["path"]).collect()}
    p = timing["plain"]
    assert (p.first_pts, p.frames, p.median_duration) == (0.0, 7, 0.04) and abs(p.last_pts - (5 * 512 + 256) / 12_800) < 1e-12 and abs(p.end_pts - (5 * 512 + 512) / 12_800) < 1e-12


def test_lines_of_a_prober(spark):
    lines = ["0.04,0.04", "0.00, 0.02 ", "N/A,0.04", "nan,1", "inf,1", "", "0.08", "0.12,-1", "x", "0.1,0,9"]
    frames = media.frame_lines(spark.createDataFrame([("a", x) for x in lines] + [("b", "-3,1"), ("c", "bad")], "f string, line string"), "f", "line")
    got = {r.f: tuple(round(x, 9) for x in r[1:]) for r in media.stream_timing(frames, ["f"]).collect()}
    assert got == {"a": (0.0, 0.12, 0.12, 5, 0.03), "b": (-3.0, -3.0, 0.0, 1, 1.0)}


def images(data):
    """Images of a byte string by a scan of all of it."""
    out, at = [], 0
    while (a := data.find(b"\xff\xd8", at)) >= 0 and (b := data.find(b"\xff\xd9", a + 2)) >= 0:
        out.append(data[a : b + 2])
        at = b + 2
    return out


@pytest.mark.parametrize("chunk", [7, 64, 1000, 1 << 20])
def test_images_of_a_stream_for_every_chunk_size(spark, tmp_path, chunk):
    r = random.Random(3)
    tiny = [b"\xff", b"\xd8", b"\xd9", b"\xff\xd8", b"\xff\xd9", b"a", b"\n", b"\xff\xff", b"\x00\xff"]
    files = {f"f{i}.mjpeg": b"".join(r.choice(tiny) for _ in range(r.randint(0, 400))) for i in range(12)}
    files |= {"whole.mjpeg": (b"\xff\xd8" + b"x" * 50 + b"\xff\xd9") * 30, "open.mjpeg": b"\xff\xd8abc\xff\xd9\xff\xd8rest", "junk.mjpeg": b"abc" * 300, "late.mjpeg": b"j" * 500 + b"\xff\xd8z\xff\xd9\xff", "marks.mjpeg": b"\xff\xd9\xff\xd9\xff\xd8\xff\xd8\xff\xd9"}
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(chunk))
    spark.conf.set("spark.sql.files.minPartitionNum", "1")
    try:
        got = media.jpeg_frames(spark, f"file://{tmp_path}").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.minPartitionNum")
    for name, data in files.items():
        own = sorted((r.frame, bytes(r.jpeg)) for r in got if r.path.endswith("/" + name))
        assert own == list(enumerate(images(data))), name


def tone(hz, seconds=0.5, rate=16_000, level=0.5):
    return level * np.sin(2 * np.pi * hz * np.arange(int(seconds * rate)) / rate)


def test_known_tones_give_their_pitch(spark):
    clips = [(f"{hz}", tone(hz).tolist()) for hz in (60, 110, 220.5, 440)] + [("silence", [0.0] * 4000), ("noise", np.random.default_rng(1).normal(0, 0.1, 8000).tolist()), ("short", [0.1] * 3), ("none", []), ("null", None), ("odd", [None, float("nan"), float("inf"), 0.2] * 300)]
    rows = audio.prosody(spark.createDataFrame(clips, "id string, x array<double>"), "id", "x").collect()
    inner = lambda k: [r for r in rows if r.id == k][3:-3]
    for k in ("60", "110", "220.5", "440"):
        assert all(r.voiced and abs(r.pitch - float(k)) < 0.01 * float(k) for r in inner(k)), k
        assert all(abs(r.rms - 0.5 / math.sqrt(2)) < 0.08 for r in inner(k)) and all(abs(r.centroid - float(k)) < 90 for r in inner(k))
        assert abs(np.mean([r.zcr for r in inner(k)]) - 2 * float(k) / 16_000) < 0.002
    assert all(not r.voiced and r.pitch == r.rms == r.centroid == 0 for r in inner("silence"))
    assert np.mean([r.voiced for r in inner("noise")]) < 0.1
    assert {r.id for r in rows} == {k for k, x in clips if x} and [r.time for r in rows if r.id == "110"][:3] == [0.0, 0.02, 0.04]


def test_frames_by_hand():
    x = np.random.default_rng(2).normal(0, 1, 1003)
    x[100:140] = 0.0
    frame, hop, rate = 64, 50, 1000
    level, cross, centre = audio.levels(x, frame, hop), audio.crossings(x, frame, hop), audio.centroids(x, rate, frame, hop)
    assert len(level) == 1 + len(x) // hop
    for i in range(len(level)):
        own = [x[t] if 0 <= t < len(x) else 0.0 for t in range(i * hop - frame // 2, i * hop + frame // 2)]
        held = [x[min(max(t, 0), len(x) - 1)] for t in range(i * hop - frame // 2, i * hop + frame // 2)]
        assert abs(level[i] - math.sqrt(sum(v * v for v in own) / frame)) < 1e-12
        sign = [v < 0 and abs(v) > 1e-10 for v in held]
        assert cross[i] == sum(a != b for a, b in zip(sign, sign[1:], strict=False)) / frame
        spectrum = [abs(sum(v * (0.5 - 0.5 * math.cos(2 * math.pi * t / frame)) * complex(math.cos(2 * math.pi * k * t / frame), -math.sin(2 * math.pi * k * t / frame)) for t, v in enumerate(own))) for k in range(frame // 2 + 1)]
        assert abs(centre[i] - sum(s * k * rate / frame for k, s in enumerate(spectrum)) / sum(spectrum)) < 1e-6


def test_pitch_by_hand():
    x = np.concatenate((tone(125, 0.2, 2000), tone(80, 0.2, 2000, 0.1), np.random.default_rng(3).normal(0, 1, 300)))
    rate, frame, hop, low, high = 2000, 50, 40, 50.0, 250.0
    got, voiced = audio.pitches(x, rate, frame, hop, low, high)
    longest, shortest, width = 40, 8, 50
    for i in range(len(got)):
        at = i * hop - (width + longest) // 2
        own = [x[t] if 0 <= t < len(x) else 0.0 for t in range(at, at + width + longest)]
        apart = [sum((own[t] - own[t + lag]) ** 2 for t in range(width)) for lag in range(longest + 1)]
        share = [1.0] + [apart[lag] * lag / sum(apart[1 : lag + 1]) if sum(apart[1 : lag + 1]) > 1e-12 else 1.0 for lag in range(1, longest + 1)]
        lag = next((n for n in range(shortest, longest + 1) if share[n] < audio.TROUGH), None)
        assert voiced[i] == (lag is not None), i
        if lag is None:
            assert got[i] == 0
            continue
        while lag + 1 <= longest and share[lag + 1] < share[lag]:
            lag += 1
        shift = 0.0
        if lag < longest and (bend := share[lag - 1] - 2 * share[lag] + share[lag + 1]) > 0:
            shift = min(max(0.5 * (share[lag - 1] - share[lag + 1]) / bend, -0.5), 0.5)
        assert abs(got[i] - rate / (lag + shift)) < 1e-5 * got[i]


def test_spans_take_the_first_frame_at_or_after_their_middle(spark):
    frames = spark.createDataFrame([("a", 0.0, 1.0), ("a", 0.2, 2.0), ("a", 0.4, 3.0), ("b", 1.0, 9.0)], "id string, time double, v double")
    spans = spark.createDataFrame([("a", 0.0, 0.0), ("a", 0.1, 0.3), ("a", 0.15, 0.29), ("a", 0.3, 0.31), ("a", 5.0, 6.0), ("b", 0.0, 0.1), ("c", 0.0, 1.0)], "id string, s double, e double")
    got = {(r.id, r.s): r.v for r in audio.for_spans(frames, spans, ["id"], "time", "s", "e", ["v"]).collect()}
    assert got == {("a", 0.0): 1.0, ("a", 0.1): 2.0, ("a", 0.15): 3.0, ("a", 0.3): 3.0, ("a", 5.0): 3.0, ("b", 0.0): 9.0, ("c", 0.0): None}
