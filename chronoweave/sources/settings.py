"""Configurations with parents, strict JSON, and fitted normalisation as a table with its facts: small things that a run begins with, on any file system Spark reads."""

from __future__ import annotations

import json
import math

from pyspark.sql import DataFrame, SparkSession

from ..plans.runs import Files, config_hash

#: Rows of statistics at most: they are joined by broadcast.
MOST_DIMS = 100_000


def strict(value: object) -> object:
    """A value as JSON has it: numbers that aren't finite are null, tuples and sets lists, keys text, numpy numbers plain ones."""
    if isinstance(value, dict):
        return {str(k): strict(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [strict(v) for v in value]
    if isinstance(value, (set, frozenset)):
        return sorted((strict(v) for v in value), key=repr)
    if hasattr(value, "tolist"):
        return strict(value.tolist())
    if isinstance(value, float):
        return value if math.isfinite(value) else None
    return value if value is None or isinstance(value, (bool, int, str)) else str(value)


def dump(value: object) -> str:
    return json.dumps(strict(value), ensure_ascii=False, indent=2, allow_nan=False)


def load_config(spark: SparkSession, folder: str, name: str) -> dict:
    """A JSON configuration, with what it doesn't say from its base_config (a name in the same folder), and so on. Whole top-level values are replaced. ValueError for a circle, or what isn't an object."""
    files, chain = Files(spark, folder), []
    while name:
        if name in [n for n, _ in chain]:
            raise ValueError(f"{name} is its own base")
        own = json.loads(files.read(name))
        if not isinstance(own, dict):
            raise ValueError(f"{name} is no object")
        chain.append((name, own))
        name = own.get("base_config")
    out: dict = {}
    for _, own in reversed(chain):
        out |= own
    out.pop("base_config", None)
    return out


def save_config(spark: SparkSession, folder: str, name: str, config: dict) -> str:
    """Write the resolved configuration with its hash, which it gives; FileExistsError where the file is there."""
    found = config_hash(strict(config))
    if not Files(spark, folder).put(name, dump({**config, "config_hash": found})):
        raise FileExistsError(f"{folder}/{name}")
    return found


def save_normalization(stats: DataFrame, folder: str, facts: dict) -> None:
    """Write statistics (dim, mean, std, n) and what they were fitted on; the facts come last, so that a folder with them is whole."""
    stats.select("dim", "mean", "std", "n").write.parquet(f"{folder}/stats")
    Files(stats.sparkSession, folder).put("facts.json", dump(facts))


def load_normalization(spark: SparkSession, folder: str, expected: dict | None = None) -> tuple[DataFrame, dict]:
    """The statistics and facts of a folder. ValueError if facts that are expected differ, a deviation is not above 0, a dimension comes twice, or there are more than MOST_DIMS."""
    facts = json.loads(Files(spark, folder).read("facts.json"))
    other = [k for k, v in strict(expected or {}).items() if facts.get(k) != v]
    if other:
        raise ValueError(f"the statistics were fitted with other {', '.join(other)}")
    stats = spark.read.parquet(f"{folder}/stats")
    n, dims, bad = stats.selectExpr("count(*)", "count(DISTINCT dim)", "count_if(NOT coalesce(std > 0 AND NOT isnan(std) AND NOT isnan(mean) AND abs(mean) < double('inf') AND std < double('inf'), false))").first()
    if bad or n != dims or n > MOST_DIMS:
        raise ValueError(f"{bad} rows are no statistics, {n - dims} dimensions come twice, {n} rows of at most {MOST_DIMS}")
    return stats, facts
