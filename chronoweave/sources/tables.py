"""Sources and sinks of tables: label tables (CSV, Parquet, XLSX), parts of files, reports in CSV and JSON."""

from __future__ import annotations

import re
import zipfile
from pathlib import Path
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import natural_key

#: Names that a label table's columns go by (letters and digits, lower case).
ALIASES = {"video_id": ("videoid",), "clip_id": ("clipid",), "text": ("text", "rawtext"), "label": ("label", "regressionlabel"), "annotation": ("annotation", "classification", "classificationlabel")}


def resolve_headers(columns: list[str]) -> dict[str, str]:
    """Our name -> the first column whose name, folded to letters and digits, is one of its aliases."""
    folded = [(re.sub(r"[^a-z0-9]", "", c.lower()), c) for c in columns]
    return {name: found for name, keys in ALIASES.items() if (found := next((c for f, c in folded if f in keys), None)) is not None}


def label_table(raw: DataFrame) -> DataFrame:
    """Label rows with an id: keys as text without a trailing .0, numbers by try_cast (unparsable: null), aliases of classes folded.

    Rows without a video or clip id are dropped.
    """
    names = resolve_headers(raw.columns)
    text = lambda n: F.regexp_replace(F.trim(F.col(f"`{names[n]}`").cast("string")), r"\.0+$", "") if n in names else F.lit(None).cast("string")
    kind = F.lower(F.substring(F.coalesce(text("annotation"), F.lit("")), 1, 3))
    rows = raw.select(text("video_id").alias("video_id"), text("clip_id").alias("clip_id"), F.col(f"`{names['text']}`").alias("text") if "text" in names else F.lit("").alias("text"), text("label").try_cast("double").alias("label"), F.when(kind == "neg", "Negative").when(kind == "neu", "Neutral").when(kind == "pos", "Positive").alias("annotation"))
    rows = rows.where((F.coalesce("video_id", F.lit("")) != "") & (F.coalesce("clip_id", F.lit("")) != ""))
    return rows.withColumn("id", F.concat_ws("$_$", "video_id", "clip_id"))


def last_wins(rows: DataFrame, key: str, order: str) -> DataFrame:
    """One row a key, that of the largest order, by a combinable maximum."""
    others = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*others), order).alias("_r")).select(key, *[F.col(f"_r.{c}").alias(c) for c in others])


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """A headed CSV, all strings, without a byte order mark in the first name."""
    rows = spark.read.csv(path, header=True, multiLine=True, escape='"')
    return rows.toDF(*[c.lstrip("﻿") for c in rows.columns])


def read_xlsx(spark: SparkSession, path: str) -> DataFrame:
    """The first sheet of a workbook as strings, from its XML; cells by their references, so that gaps stay gaps. For small tables: it is read on the driver."""
    with zipfile.ZipFile(Path(path)) as z:
        ns = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in si.iter(f"{{{ns['m']}}}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).findall("m:si", ns)]
        sheet = ElementTree.fromstring(z.read(min(n for n in z.namelist() if n.startswith("xl/worksheets/sheet"))))
    table = []
    for row in sheet.iter(f"{{{ns['m']}}}row"):
        cells: dict[int, str] = {}
        for c in row.findall("m:c", ns):
            column = 0
            for letter in re.match(r"[A-Z]*", c.get("r", "A"))[0]:
                column = column * 26 + ord(letter) - 64
            value = c.find("m:v", ns)
            inline = "".join(t.text or "" for t in c.iter(f"{{{ns['m']}}}t"))
            cells[column] = shared[int(value.text)] if c.get("t") == "s" and value is not None else (value.text if value is not None else inline)
        if any(v for v in cells.values()):
            table.append(cells)
    if not table:
        return spark.createDataFrame([], "empty string")
    columns = sorted(table[0])
    schema = ", ".join(f"`{table[0][c]}` string" for c in columns)
    return spark.createDataFrame([tuple(r.get(c) for c in columns) for r in table[1:]], schema)


def read_parts(spark: SparkSession, path: str) -> DataFrame:
    """All Parquet files below a path with their file names, and a key that sorts these naturally."""
    rows = spark.read.option("recursiveFileLookup", "true").parquet(path).withColumn("source_file", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1))
    return rows.withColumn("source_order", natural_key(F.col("source_file")))


def read_samples(spark: SparkSession, path: str, key: str = "id") -> DataFrame:
    """read_parts() with text ids: the rows' own, or, where a row has none, its file's stem, with a number from 001 if the file has several rows.

    Adds id_source. A row's place is its index in its file, so ids are the same in every run.
    """
    rows = spark.read.option("recursiveFileLookup", "true").parquet(path)
    rows = rows if key in rows.columns else rows.withColumn(key, F.lit(None).cast("string"))
    rows = rows.select("*", F.col("_metadata.file_path").alias("_path"), F.col("_metadata.row_index").alias("_row"))
    sizes = rows.groupBy("_path").agg(F.max("_row").alias("_last"))
    file = F.element_at(F.split("_path", "/"), -1)
    stem = F.regexp_replace(file, r"\.[^.]*$", "")
    made = F.when(F.col("_last") == 0, stem).otherwise(F.concat(stem, F.lit("__"), F.format_string("%03d", F.col("_row") + 1)))
    named = rows.join(sizes, "_path").withColumn("id_source", F.when(F.col(key).isNotNull(), "input_id_field").otherwise("file_stem"))
    named = named.withColumns({key: F.coalesce(F.col(key).cast("string"), made), "source_file": file})
    return named.withColumn("source_order", natural_key(F.col("source_file"))).drop("_path", "_row", "_last")


def verify_files(spark: SparkSession, path: str, manifest: DataFrame) -> DataFrame:
    """(file, expected, found, ok): SHA-256 of files against a manifest (file, sha256)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    hashed = files.select(F.element_at(F.split("path", "/"), -1).alias("file"), F.sha2("content", 256).alias("found"))
    return manifest.withColumnRenamed("sha256", "expected").join(hashed, "file", "left").withColumn("ok", F.col("expected").eqNullSafe(F.col("found")))


def write_report(rows: DataFrame, path: str, columns: list[str] | None = None, null: str = "NA") -> None:
    """A headed CSV of some columns, nested ones as JSON; in as many parts as the plan has."""
    shown = rows.select(*columns) if columns else rows
    nested = {f.name: F.to_json(f.name) for f in shown.schema.fields if f.dataType.typeName() in ("array", "map", "struct")}
    shown.withColumns(nested).write.csv(path, header=True, nullValue=null, mode="overwrite")


def write_sidecars(rows: DataFrame, path: str, key: str) -> None:
    """One folder of JSON a key."""
    rows.write.partitionBy(key).json(path, mode="overwrite")
