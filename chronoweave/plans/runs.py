"""Runs of several stages that survive a lost driver: what is done is not done again, and never with other settings.

A run is a folder. ``run.json`` holds what it was started with; a stage has a folder of attempts and markers. A marker appears by the rename of a
finished file, so it is there whole or not at all, and none is ever changed: RUNNING-n when attempt n begins, FAILED-n with its error, DONE with
the attempt whose table counts. A driver that dies leaves RUNNING-n alone, and the next run of the stage is attempt n + 1 in a folder of its own.
"""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

#: What has to agree for a run to go on, beside its configuration.
GUARDED = ("config_hash", "seed", "limit", "stages")


class Files:
    """Small files below a folder of any file system that Spark reads."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.jvm, self.conf, self.folder = spark._jvm, spark._jsc.hadoopConfiguration(), folder.rstrip("/")
        self.fs = self.path("").getFileSystem(self.conf)

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}" if name else self.folder)

    def exists(self, name: str) -> bool:
        return self.fs.exists(self.path(name))

    def names(self, name: str = "") -> list[str]:
        """Names in a folder, sorted; none if it isn't there."""
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self.path(name))) if self.exists(name) else []

    def read(self, name: str) -> str:
        stream = self.fs.open(self.path(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def cut(self, name: str, size: int) -> None:
        """Leave the first bytes of a file alone; for tests of what reads broken files."""
        stream = self.fs.open(self.path(name))
        try:
            head = stream.readNBytes(size)
        finally:
            stream.close()
        out = self.fs.create(self.path(name), True)
        try:
            out.write(head)
        finally:
            out.close()

    def put(self, name: str, text: str) -> bool:
        """Write a file that isn't there yet, by rename; False if another was first."""
        made = self.path(f"{name}.{uuid.uuid4().hex}.tmp")
        stream = self.fs.create(made)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        if not self.exists(name) and self.fs.rename(made, self.path(name)):
            return True
        self.fs.delete(made, False)
        return False


def config_hash(config: dict) -> str:
    """SHA-256 of a configuration, whatever the order of its keys."""
    return hashlib.sha256(json.dumps(config, sort_keys=True, separators=(",", ":"), ensure_ascii=False, default=str).encode()).hexdigest()


class Run:
    """A run below folder. RuntimeError if the folder holds one of another configuration, seed, limit or list of stages."""

    def __init__(self, spark: SparkSession, folder: str, config: dict, *, seed: int | None = None, limit: int | None = None, stages: list[str] | None = None) -> None:
        self.spark, self.folder, self.files = spark, folder.rstrip("/"), Files(spark, folder)
        self.facts = {"config_hash": config_hash(config), "seed": seed, "limit": limit, "stages": stages}
        if not self.files.put("run.json", json.dumps({**self.facts, "config": config, "started": time.time()}, default=str)):
            kept = json.loads(self.files.read("run.json"))
            other = [f"{k} is {kept.get(k)!r}, asked for {self.facts[k]!r}" for k in GUARDED if kept.get(k) != self.facts[k]]
            if other:
                raise RuntimeError(f"{self.folder} holds another run: {'; '.join(other)}")

    def done(self, stage: str) -> dict | None:
        """What DONE says of a stage, None if it isn't done."""
        return json.loads(self.files.read(f"{stage}/DONE")) if self.files.exists(f"{stage}/DONE") else None

    def stage(self, name: str, make: Callable[[], DataFrame], by: Sequence[str] = (), schema: StructType | None = None) -> DataFrame:
        """The stage's table: read if it is done, else made, written (in folders by some columns) and marked. A schema spares looking for it, and a table without rows needs one if it has folders."""
        if (kept := self.done(name)) is None:
            attempt = 1 + max((int(n.rsplit("-", 1)[1]) for n in self.files.names(name) if n.startswith(("RUNNING-", "FAILED-")) and n.rsplit("-", 1)[1].isdigit()), default=0)
            path, began = f"{self.folder}/{name}/attempt-{attempt}", time.time()
            if not self.files.put(f"{name}/RUNNING-{attempt}", json.dumps({"attempt": attempt, "began": began})):
                raise RuntimeError(f"another driver runs {name}")
            try:
                make().write.partitionBy(*by).parquet(path)
            except Exception as error:
                self.files.put(f"{name}/FAILED-{attempt}", json.dumps({"attempt": attempt, "error": f"{type(error).__name__}: {error}"[:2000]}))
                raise
            kept = {"attempt": attempt, "path": f"{name}/attempt-{attempt}", "seconds": round(time.time() - began, 3)}
            if not self.files.put(f"{name}/DONE", json.dumps(kept)):
                kept = self.done(name)
        reader = self.spark.read.schema(schema) if schema else self.spark.read
        return reader.parquet(f"{self.folder}/{kept['path']}")

    def status(self) -> DataFrame:
        """(stage, status, attempts, path, seconds, error): how far each stage has come."""
        rows = []
        for name in self.files.names():
            marks = self.files.names(name) if name != "run.json" else []
            tries = [int(m.rsplit("-", 1)[1]) for m in marks if m.startswith("RUNNING-") and m.rsplit("-", 1)[1].isdigit()]
            if not tries:
                continue
            kept, last = self.done(name), max(tries)
            failed = f"FAILED-{last}" in marks
            error = json.loads(self.files.read(f"{name}/FAILED-{last}"))["error"] if failed and not kept else None
            rows.append((name, "DONE" if kept else "FAILED" if failed else "RUNNING", len(tries), kept and kept["path"], kept and kept["seconds"], error))
        return self.spark.createDataFrame(rows, "stage string, status string, attempts int, path string, seconds double, error string")


def run_stages(spark: SparkSession, folder: str, stages: dict[str, Callable[[DataFrame | None], DataFrame]], config: dict, *, seed: int | None = None, limit: int | None = None) -> DataFrame:
    """The last stage's table; each stage gets the table of the one before. Finished ones are read, so a run that is begun again makes only the rest."""
    run, table = Run(spark, folder, config, seed=seed, limit=limit, stages=list(stages)), None
    for name, make in stages.items():
        table = run.stage(name, lambda make=make, before=table: make(before))
    if table is None:
        raise ValueError("a run needs a stage")
    return table
