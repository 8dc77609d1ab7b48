"""Media files as tables: which there are, and the times that an MP4's own boxes state.

A small walk over each file's boxes (in Arrow batches, since no built-in function can follow them) emits the few that hold times;
what is in these is decoded by column expressions and put together by grouped aggregates. A file is in memory whole while it is walked.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.sequences import finite

BOXES = "path string, track int, box string, payload binary"


def media_files(spark: SparkSession, path: str, suffix: str = "mp4", expected: int | None = None) -> DataFrame:
    """(path, folder, stem, length, content) of all files below a path with the suffix; ValueError if there aren't as many as expected.

    Files without a byte are left out, as Spark reads none. Column pruning leaves the content unread where only the names are asked for.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*.{suffix}").load(path)
    parts = F.split("path", "/")
    stem = F.regexp_replace(F.element_at(parts, -1), r"\.[^.]*$", "")
    found = files.select("path", F.element_at(parts, -2).alias("folder"), stem.alias("stem"), "length", "content")
    if expected is not None and (n := found.select("path").count()) != expected:
        raise ValueError(f"{n} files of type {suffix} below {path}, not {expected}")
    return found


def children(data: bytes, start: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(type, start, end) of the contents of the boxes that follow each other; the walk ends at the first that doesn't fit."""
    while end - start >= 8:
        size, kind = struct.unpack_from(">I4s", data, start)
        head = 8
        if size == 1 and end - start >= 16:
            size, head = struct.unpack_from(">Q", data, start + 8)[0], 16
        elif size == 0:
            size = end - start
        if size < head or size > end - start:
            return
        yield kind, start + head, start + size
        start += size


def descend(data: bytes, span: tuple[int, int], *names: bytes) -> tuple[int, int] | None:
    """The contents of the first box of each name within the one before."""
    for name in names:
        found = next(((a, b) for kind, a, b in children(data, *span) if kind == name), None)
        if found is None:
            return None
        span = found
    return span


def time_boxes(files: DataFrame) -> DataFrame:
    """(path, track, box, payload) of the header of the movie (track -1) and the headers, handlers and edit lists of its tracks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                movie = descend(data or b"", (0, len(data or b"")), b"moov")
                if movie is None:
                    continue
                wanted = [(-1, movie, (b"mvhd",))]
                for n, (_, a, b) in enumerate(c for c in children(data, *movie) if c[0] == b"trak"):
                    wanted += [(n, (a, b), names) for names in ((b"mdia", b"mdhd"), (b"mdia", b"hdlr"), (b"edts", b"elst"))]
                found = [(track, names[-1], descend(data, span, *names)) for track, span, names in wanted]
                rows += [(path, track, name.decode(), data[span[0] : span[1]]) for track, name, span in found if span]
            yield pa.RecordBatch.from_pylist([dict(zip(("path", "track", "box", "payload"), r, strict=True)) for r in rows], pa.schema([("path", pa.string()), ("track", pa.int32()), ("box", pa.string()), ("payload", pa.binary())]))

    return files.select("path", "content").mapInArrow(run, BOXES)


def number(payload: Column, at: Column | int, size: int) -> Column:
    """An unsigned big-endian number of a payload, from a byte that counts from 0."""
    at = at if isinstance(at, Column) else F.lit(at)
    return F.conv(F.hex(F.substring(payload, at + 1, size)), 16, 10).cast("double")


def header(payload: Column) -> Column:
    """struct(scale, seconds) of a movie or media header of version 0 or 1; zeros if it is cut short or of another version."""
    version, size = number(payload, 0, 1), F.length(payload)
    scale = F.when((version == 0) & (size >= 20), number(payload, 12, 4)).when((version == 1) & (size >= 32), number(payload, 20, 4)).otherwise(0.0)
    units = F.when((version == 0) & (size >= 20), number(payload, 16, 4)).when((version == 1) & (size >= 32), number(payload, 24, 8)).otherwise(0.0)
    return F.struct(scale.alias("scale"), F.coalesce(F.try_divide(units, scale), F.lit(0.0)).alias("seconds"))


def edits(payload: Column) -> Column:
    """struct(entries, units) of an edit list: how many entries it states, and the sum of the durations of those that are there."""
    entries = F.when(F.length(payload) >= 8, number(payload, 4, 4).cast("int")).otherwise(0)
    step = F.when(number(payload, 0, 1) == 1, 20).otherwise(12)
    there = F.least(entries, F.floor((F.length(payload) - 8) / step).cast("int"))
    places = F.when(there > 0, F.sequence(F.lit(0), there - 1)).otherwise(F.array().cast("array<int>"))
    duration = lambda i: F.when(step == 20, number(payload, i * 20 + 8, 8)).otherwise(number(payload, i * 12 + 8, 4))
    return F.struct(entries.alias("entries"), F.aggregate(places, F.lit(0.0), lambda a, i: a + duration(i)).alias("units"))


def mp4_times(files: DataFrame) -> DataFrame:
    """(path, timescale, duration, video_edit, audio_edit, video_entries, audio_entries) of files (path, content).

    Durations are seconds; the first video and sound track count. Files without a movie box are absent; what a file doesn't state is 0.
    """
    b = time_boxes(files)
    at = lambda name: F.max(F.when(F.col("box") == name, F.col("payload")))
    tracks = b.where("track >= 0").groupBy("path", "track").agg(at("hdlr").alias("hdlr"), at("elst").alias("elst"))
    kind = F.when(F.length("hdlr") >= 12, F.substring("hdlr", 9, 4).cast("string"))
    tracks = tracks.select("path", "track", kind.alias("kind"), edits(F.coalesce("elst", F.lit(b""))).alias("edit"))
    first = lambda k: F.min_by(F.when(F.col("kind") == k, F.col("edit")), F.when(F.col("kind") == k, F.col("track")))
    edited = tracks.groupBy("path").agg(first("vide").alias("v"), first("soun").alias("s"))
    movie = b.groupBy("path").agg(F.coalesce(header(F.max(F.when(F.col("track") == -1, F.col("payload")))), F.struct(F.lit(0.0).alias("scale"), F.lit(0.0).alias("seconds"))).alias("m"))
    seconds = lambda c: F.coalesce(F.try_divide(F.col(f"{c}.units"), F.col("m.scale")), F.lit(0.0))
    return movie.join(edited, "path", "left").select("path", F.col("m.scale").alias("timescale"), F.col("m.seconds").alias("duration"), seconds("v").alias("video_edit"), seconds("s").alias("audio_edit"), F.coalesce("v.entries", F.lit(0)).alias("video_entries"), F.coalesce("s.entries", F.lit(0)).alias("audio_entries"))


def entries(payload: Column, head: int, step: int, fields: dict[str, tuple[int, int, bool]]) -> Column:
    """The entries of a table box that are there in full: structs of (offset, size, signed) fields, the number of entries stated 4 bytes before them."""
    stated = F.when(F.length(payload) >= head, number(payload, head - 4, 4).cast("int")).otherwise(0)
    there = F.least(stated, F.floor((F.length(payload) - head) / step).cast("int"))
    places = F.when(there > 0, F.sequence(F.lit(0), there - 1)).otherwise(F.array().cast("array<int>"))

    def field(i: Column, at: int, size: int, signed: bool) -> Column:
        value = number(payload, i * step + head + at, size)
        return F.when(value >= 2.0 ** (8 * size - 1), value - 2.0 ** (8 * size)).otherwise(value) if signed else value

    return F.transform(places, lambda i: F.struct(*[field(i, *f).alias(name) for name, f in fields.items()]))


def sample_tables(files: DataFrame) -> DataFrame:
    """(path, track, box, payload) of what frame times need: the movie's header and, by track, media header, handler, edit list, sample durations and composition offsets."""
    table = (b"mdia", b"minf", b"stbl")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                movie = descend(data or b"", (0, len(data or b"")), b"moov")
                if movie is None:
                    continue
                wanted = [(-1, movie, (b"mvhd",))]
                for n, (_, a, b) in enumerate(c for c in children(data, *movie) if c[0] == b"trak"):
                    wanted += [(n, (a, b), names) for names in ((b"mdia", b"mdhd"), (b"mdia", b"hdlr"), (b"edts", b"elst"), (*table, b"stts"), (*table, b"ctts"))]
                found = [(track, names[-1], descend(data, span, *names)) for track, span, names in wanted]
                rows += [{"path": path, "track": track, "box": name.decode(), "payload": data[span[0] : span[1]]} for track, name, span in found if span]
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("path", pa.string()), ("track", pa.int32()), ("box", pa.string()), ("payload", pa.binary())]))

    return files.select("path", "content").mapInArrow(run, BOXES)


def frame_times(files: DataFrame, kind: str = "vide") -> DataFrame:
    """(path, n, pts, duration) of the frames that the first track of a kind presents, in seconds, without decoding: n counts them in decoding order.

    A frame's time is the sum of the durations before it plus its composition offset; an edit shows the stretch of media that it names from the time at
    which the edits before it end, empty edits only wait, and what no edit shows isn't presented. A frame of two edits is there twice.
    Without an edit list all frames are shown from their own time. Files without such a track, or a time scale, give no rows.
    """
    b = sample_tables(files)
    at = lambda name: F.max(F.when(F.col("box") == name, F.col("payload")))
    scale = header(F.max(F.when(F.col("box") == "mvhd", F.col("payload"))))["scale"]
    movies = b.where("track = -1").groupBy("path").agg(scale.alias("movie_scale"))
    tracks = b.where("track >= 0").groupBy("path", "track").agg(*[at(n).alias(n) for n in ("mdhd", "hdlr", "elst", "stts", "ctts")])
    tracks = tracks.where((F.length("hdlr") >= 12) & (F.substring("hdlr", 9, 4).cast("string") == kind))
    own = Window.partitionBy("path")
    tracks = tracks.withColumn("_first", F.min("track").over(own)).where(F.col("track") == F.col("_first")).join(movies, "path")
    wide = number(F.col("elst"), 0, 1) == 1
    edit = F.when(wide, entries(F.col("elst"), 8, 20, {"units": (0, 8, False), "begin": (8, 8, True)})).otherwise(entries(F.col("elst"), 8, 12, {"units": (0, 4, False), "begin": (4, 4, True)}))
    offset = F.when(number(F.col("ctts"), 0, 1) == 1, entries(F.col("ctts"), 8, 8, {"n": (0, 4, False), "v": (4, 4, True)})).otherwise(entries(F.col("ctts"), 8, 8, {"n": (0, 4, False), "v": (4, 4, False)}))
    spread = lambda c: F.flatten(F.transform(c, lambda e: F.array_repeat(e["v"], e["n"].cast("int"))))
    lists = tracks.select("path", header(F.col("mdhd"))["scale"].alias("scale"), "movie_scale", F.coalesce(edit, F.array()).alias("edits"), spread(entries(F.col("stts"), 8, 8, {"n": (0, 4, False), "v": (4, 4, False)})).alias("deltas"), F.coalesce(spread(offset), F.array()).alias("offsets")).where("scale > 0")
    frames = lists.select("path", "scale", "movie_scale", "edits", "offsets", F.posexplode("deltas").alias("n", "delta"))
    before = Window.partitionBy("path").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    frames = frames.withColumn("t", (F.coalesce(F.sum("delta").over(before), F.lit(0.0)) + F.coalesce(F.get("offsets", F.col("n")), F.lit(0.0))) / F.col("scale")).withColumn("d", F.col("delta") / F.col("scale")).drop("offsets")
    # an edit: from which second of the media, for how long, shown from which second
    line = F.sequence(F.lit(0), F.size("edits") - 1)
    seconds = lambda x: F.coalesce(F.try_divide(x, F.col("movie_scale")), F.lit(0.0))
    shown = F.transform(line, lambda i: F.struct(seconds(F.col("edits")[i]["units"]).alias("length"), (F.col("edits")[i]["begin"] / F.col("scale")).alias("begin"), seconds(F.aggregate(F.slice("edits", 1, i), F.lit(0.0), lambda a, e: a + e["units"])).alias("at")))
    whole = F.array(F.struct(F.lit(float("inf")).alias("length"), F.lit(0.0).alias("begin"), F.lit(0.0).alias("at")))
    each = frames.withColumn("e", F.explode(F.when(F.size("edits") > 0, F.filter(shown, lambda e: e["begin"] >= 0)).otherwise(whole)))
    inside = (F.col("t") + F.col("d") > F.col("e.begin")) & (F.col("t") < F.col("e.begin") + F.col("e.length")) | (F.size("edits") == 0)
    return each.where(inside).select("path", "n", (F.col("t") - F.col("e.begin") + F.col("e.at")).alias("pts"), F.col("d").alias("duration"))


def frame_lines(lines: DataFrame, key: str, line: str) -> DataFrame:
    """(key, pts, duration) of lines "time,duration" as a prober prints them; lines whose time isn't a finite number drop out, other durations are null."""
    parts = F.split(line, ",")
    value = lambda i: F.trim(F.get(parts, F.lit(i))).try_cast("double")
    rows = lines.select(key, value(0).alias("pts"), value(1).alias("duration")).where(finite("pts"))
    return rows.withColumn("duration", F.when(finite("duration"), F.col("duration")))


def stream_timing(frames: DataFrame, by: list[str]) -> DataFrame:
    """(by..., first_pts, last_pts, end_pts, frames, median_duration) of frames (pts, duration): ends are never before 0 or the frame's own time, durations up to 0 count for nothing."""
    end = F.greatest(F.col("pts") + F.greatest(F.coalesce("duration", F.lit(0.0)), F.lit(0.0)), F.col("pts"))
    length = F.when(F.col("duration") > 0, F.col("duration"))
    return frames.groupBy(*by).agg(
        F.min("pts").alias("first_pts"), F.max("pts").alias("last_pts"), F.greatest(F.max(end), F.lit(0.0)).alias("end_pts"),
        F.count("*").alias("frames"), F.coalesce(F.median(length), F.lit(0.0)).alias("median_duration"),
    )


#: Start and end of a JPEG image, as characters of one byte each.
IMAGE_START, IMAGE_END = "\xff\xd8", "\xff\xd9"


def jpeg_frames(spark: SparkSession, path: str) -> DataFrame:
    """(path, frame, jpeg) of the images in files of images one after another, numbered from 0 in a file.

    An image runs from the first start marker to the next end marker; bytes before a start, and a start without an end, are left out.
    Files are read as records that end markers close, so one file's ranges go to many tasks, and a record or marker that
    crosses the edge of a range or a buffer is read once and whole. Images are numbered within their range, from how many the ranges before it have. A record that the file's end closes has one of its bytes too many: its length gives it away.
    """
    records = spark.read.option("lineSep", IMAGE_END).option("encoding", "ISO-8859-1").text(path)
    rows = records.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("size"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("place"), F.col("value").cast("binary").alias("data"))
    place = F.instr(F.decode("data", "ISO-8859-1"), IMAGE_START)  # a character a byte
    rows = rows.withColumn("lead", F.when(place > 0, place - 1)).withColumn("own", F.length("data") + 2)
    blocks = rows.groupBy("path", "block").agg(F.sum("own").alias("own"), F.max("place").alias("last"), F.count("lead").alias("n"))  # a row a range
    whole, earlier = Window.partitionBy("path"), Window.partitionBy("path").orderBy("block")
    blocks = blocks.select("path", "block", F.sum("own").over(whole).alias("read"), F.when(F.col("block") == F.max("block").over(whole), F.col("last")).alias("last"), (F.sum("n").over(earlier) - F.col("n")).alias("before"))
    rows = rows.join(blocks, ["path", "block"]).where((F.col("read") == F.col("size")) | ~F.col("place").eqNullSafe(F.col("last"))).where("lead IS NOT NULL")
    order = Window.partitionBy("path", "block").orderBy("place")
    image = F.concat(F.substring("data", F.col("lead") + 1, F.length("data")), F.lit(b"\xff\xd9"))
    return rows.select("path", (F.row_number().over(order) - 1 + F.col("before")).cast("int").alias("frame"), image.alias("jpeg"))
