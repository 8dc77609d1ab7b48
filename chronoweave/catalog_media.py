"""Registered queries of media and audio sources: error rows of a scan, frame times, image streams, short-time features, values for spans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog import BINS, EV, pooled, query, r6, read, spans
from .operators import audio
from .plans.folders import shared_folder
from .plans.runs import Files
from .sources import media, scan


@query("SELECT c_nationkey AS nation, CAST(count(*) FILTER (WHERE c_nationkey <> 3) AS BIGINT) AS rows, c_nationkey = 3 AS failed FROM customer GROUP BY 1, 3")
def error_row_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers in a file a nation, of which one is cut short: its rows are an error row, the others are read."""
    folder = shared_folder(spark, "scan")
    read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal").repartition("c_nationkey").write.partitionBy("c_nationkey").parquet(folder)
    files = Files(spark, folder)
    for name in files.names("c_nationkey=3"):
        if name.endswith(".parquet"):
            files.cut(f"c_nationkey=3/{name}", 40)
    nation = F.regexp_extract("source_path", "c_nationkey=([0-9]+)", 1).cast("int")
    rows = scan.scan_parquet(spark, folder, "c_custkey bigint, c_acctbal double")
    return rows.groupBy(nation.alias("nation")).agg(F.count_if(F.col("load_error").isNull()).alias("rows"), (F.count("load_error") > 0).alias("failed"))


LINES = """WITH ln AS (SELECT user_id, CASE WHEN event_type = 'error' THEN 'N/A,1' ELSE CAST((epoch_us(ts) - 1704067200000000) // 1000000 AS VARCHAR) || CASE WHEN event_type = 'view' THEN '' ELSE ',' || CAST(CAST(floor(value) AS BIGINT) - 5 AS VARCHAR) END END AS line FROM events),
pt AS (SELECT user_id, TRY_CAST(split_part(line, ',', 1) AS DOUBLE) AS pts, TRY_CAST(nullif(split_part(line, ',', 2), '') AS DOUBLE) AS d FROM ln)
"""


@query(LINES + "SELECT user_id, min(pts) AS first_pts, max(pts) AS last_pts, greatest(max(pts + greatest(coalesce(d, 0), 0)), 0) AS end_pts, CAST(count(*) AS BIGINT) AS frames, coalesce(median(d) FILTER (WHERE d > 0), 0) AS median_duration FROM pt WHERE pts IS NOT NULL GROUP BY 1")
def frame_timing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stream times of a prober's lines: events are frames, their values durations, and errors are lines without a time."""
    second = F.floor(F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', ts)") / 1_000_000)
    tail = F.when(F.col("event_type") == "view", "").otherwise(F.concat(F.lit(","), (F.floor("value") - 5).cast("string")))
    line = F.when(F.col("event_type") == "error", "N/A,1").otherwise(F.concat(second.cast("string"), tail))
    frames = media.frame_lines(read(spark, sf_dir, "events").select("user_id", line.alias("line")), "user_id", "line")
    return media.stream_timing(frames, ["user_id"])


@query("SELECT lang, CAST(count(*) AS BIGINT) AS frames, CAST(sum(strlen(text) + 4) AS BIGINT) AS bytes, CAST(sum(doc_id) AS BIGINT) AS ids FROM documents WHERE lang IS NOT NULL GROUP BY 1")
def jpeg_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as images of streams, one a task and language, with bytes between them; what is read back, by language, with the ids that stand in the images."""
    folder = shared_folder(spark, "images")
    docs = read(spark, sf_dir, "documents").where("lang IS NOT NULL")
    record = F.concat(F.lit(b"between"), F.lit(b"\xff\xd8"), F.encode("text", "UTF-8"), F.encode(F.lpad(F.col("doc_id").cast("string"), 20, "0"), "UTF-8"))
    docs.select(record.cast("string").alias("value"), "lang").write.partitionBy("lang").option("lineSep", media.IMAGE_END).option("encoding", "ISO-8859-1").text(folder)
    images = media.jpeg_frames(spark, folder)
    size = F.length("jpeg")
    number = F.substring("jpeg", size - 21, F.lit(20)).cast("string").cast("long")
    lang = F.regexp_extract("path", "lang=([^/]*)", 1)
    return images.groupBy(lang.alias("lang")).agg(F.count("*").alias("frames"), F.sum(size - 20).alias("bytes"), F.sum(number).alias("ids"))


SIGNAL = EV + ", sg AS (SELECT user_id, bin, value - 50.0 AS x FROM pool WHERE event_type = 'click'), dn AS (SELECT u.user_id, b.b AS t, coalesce(sg.x, 0.0) AS x FROM (SELECT DISTINCT user_id FROM sg) u CROSS JOIN (SELECT unnest(range(50)) AS b) b LEFT JOIN sg ON sg.user_id = u.user_id AND sg.bin = b.b)\n"


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id, samples): each user's clicks on the grid, less their usual value, as a signal."""
    each = pooled(spark, sf_dir).where("event_type = 'click'").groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("bin", (F.col("value") - 50.0).alias("x")))).alias("m"))  # a row a bin
    return each.select("user_id", F.transform(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda b: F.coalesce(F.element_at("m", b), F.lit(0.0))).alias("samples"))


@query(SIGNAL + """, fr AS (SELECT DISTINCT user_id, CAST(f.f AS INTEGER) AS frame FROM dn, (SELECT unnest(range(11)) AS f) f),
pd AS (SELECT fr.user_id, frame, o.o AS place, frame * 5 - 4 + o.o AS t FROM fr, (SELECT unnest(range(8)) AS o) o),
vl AS (SELECT pd.user_id, frame, place, CASE WHEN pd.t BETWEEN 0 AND 49 THEN dn.x ELSE 0.0 END AS silent, dn.x AS held FROM pd JOIN dn ON dn.user_id = pd.user_id AND dn.t = least(greatest(pd.t, 0), 49)),
cr AS (SELECT *, (held < 0 AND abs(held) > 1e-10) <> lag(held < 0 AND abs(held) > 1e-10) OVER (PARTITION BY user_id, frame ORDER BY place) AS crossed FROM vl)
SELECT user_id, frame, frame * 5 / 100.0 AS time, round(sqrt(sum(silent * silent) / 8), 6) AS rms, round(count(*) FILTER (WHERE crossed) / 8.0, 6) AS zcr FROM cr GROUP BY ALL""")
def short_time_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Level and zero crossings of frames of 8 samples, 5 apart, of all users' signals at 100 samples a second."""
    rows = audio.prosody(signals(spark, sf_dir), "user_id", "samples", rate=100, frame=8, hop=5, low=5, high=40)
    return rows.select("user_id", "frame", r6("time").alias("time"), r6("rms").alias("rms"), r6("zcr").alias("zcr"))


@query()
def prosody_pitch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pitch, voicing and spectral centroid of the same frames."""
    rows = audio.prosody(signals(spark, sf_dir), "user_id", "samples", rate=100, frame=8, hop=5, low=5, high=40)
    return rows.select("user_id", "frame", r6("pitch").alias("pitch"), "voiced", r6("centroid").alias("centroid"))


@query(EV + """, fr AS (SELECT user_id, s0 AS t, value FROM ev WHERE event_type = 'click'), sp AS (SELECT user_id, event_id, s0, e0 FROM ev WHERE event_type = 'view' AND e0 IS NOT NULL),
nx AS (SELECT event_id, arg_min(fr.value, fr.t) AS v FROM sp JOIN fr ON fr.user_id = sp.user_id AND fr.t >= (s0 + e0) / 2 GROUP BY 1), ls AS (SELECT user_id, arg_max(value, t) AS v FROM fr GROUP BY 1)
SELECT sp.user_id, sp.event_id, coalesce(nx.v, ls.v) AS value FROM sp LEFT JOIN nx USING (event_id) LEFT JOIN ls ON ls.user_id = sp.user_id""")
def frames_for_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each view, the value of the user's first click at or after its middle, of the last click where there is none."""
    rows = spans(spark, sf_dir)
    clicks = rows.where("event_type = 'click'").select("user_id", F.col("s0").alias("time"), "value")
    views = rows.where("event_type = 'view' AND e0 IS NOT NULL").select("user_id", "event_id", "s0", "e0")
    return audio.for_spans(clicks, views, ["user_id"], "time", "s0", "e0", ["value"]).select("user_id", "event_id", "value")
