"""Reading many files of which some are broken: what can't be read becomes a row that says why, never a failed job."""

from __future__ import annotations

import io
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..shipping import ship

#: Bytes of a file that a task reads whole; larger ones are rows of error too.
MOST_BYTES = 512 << 20


def read_table(content: bytes, wanted: pa.Schema, rows: int) -> Iterator[pa.RecordBatch]:
    """The wanted columns of a Parquet file's content, cast; ValueError where one isn't there."""
    file = pq.ParquetFile(io.BytesIO(content))
    there = file.schema_arrow.names
    missing = [n for n in wanted.names if n not in there]
    if missing:
        raise ValueError(f"no column {', '.join(missing)}")
    for batch in file.iter_batches(rows, columns=wanted.names):
        table = pa.Table.from_batches([batch]).select(wanted.names).cast(wanted)
        yield from table.combine_chunks().to_batches()


def scan_parquet(spark: SparkSession, path: str, schema: StructType | str, rows: int = 4096) -> DataFrame:
    """All rows of the Parquet files below path in the given columns, with source_file, source_path and load_error.

    A file that can't be opened, is cut short, lacks a column or holds values that don't fit the types gives one row: nulls, its name and the
    reason, and none of its rows. So does one of more than MOST_BYTES. No file fails the others. Files without a byte
    are left out, as Spark lists none.
    """
    ship(spark)
    kind = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    wanted = to_arrow_schema(kind)
    out = pa.schema([*wanted, ("source_file", pa.string()), ("load_error", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content, fault in zip(*(batch.column(c).to_pylist() for c in ("path", "content", "fault")), strict=True):
                made: list[pa.RecordBatch] = []
                if fault is None:
                    try:
                        made = list(read_table(content, wanted, rows))  # all of it, since a file with a fault gives no rows
                    except (pa.ArrowException, ValueError, OSError, EOFError) as error:
                        fault, made = f"{type(error).__name__}: {error}".splitlines()[0][:500], []
                if fault is not None:
                    yield pa.RecordBatch.from_arrays([*[pa.nulls(1, f.type) for f in wanted], pa.array([file]), pa.array([fault])], schema=out)
                for b in made:
                    yield pa.RecordBatch.from_arrays([*b.columns, pa.array([file] * b.num_rows, pa.string()), pa.nulls(b.num_rows, pa.string())], schema=out)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(path)
    small = F.col("length") <= MOST_BYTES
    chosen = files.where(small).select("path", "content", F.lit(None).cast("string").alias("fault"))
    others = files.where(~small).select("path", F.lit(None).cast("binary").alias("content"), F.lit(f"larger than {MOST_BYTES} bytes").alias("fault"))  # their content stays unread
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kind.fields)
    read = chosen.union(others).mapInArrow(run, f"{ddl}, source_file string, load_error string")
    return read.withColumn("source_path", F.col("source_file")).withColumn("source_file", F.element_at(F.split("source_file", "/"), -1))


def scan_json(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Lines of JSON in the given columns, with source_file and load_error: the line itself where it isn't a JSON object of these types, its columns null."""
    kind = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    whole = StructType([*kind.fields, *StructType.fromDDL("load_error string").fields])
    rows = spark.read.schema(whole).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "load_error").json(path)
    bad = F.col("load_error").isNotNull()
    return rows.select(*[F.when(~bad, F.col(f"`{f.name}`")).alias(f.name) for f in kind.fields], F.element_at(F.split("_metadata.file_path", "/"), -1).alias("source_file"), "load_error")


def load_report(scanned: DataFrame) -> DataFrame:
    """(source_file, rows, error) of each scanned file."""
    return scanned.groupBy("source_file").agg(F.count_if(F.col("load_error").isNull()).alias("rows"), F.max("load_error").alias("error"))
