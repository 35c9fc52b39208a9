"""Readers: tables, text lines, JSON lines, synthetic items, run settings, and readers with fallbacks."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def spread(df: DataFrame) -> DataFrame:
    """A scan of fewer splits than there are cores (a small file of one row group) is dealt over all cores; a larger one stays as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def size_of(df: DataFrame) -> int:
    """Bytes of the files a table is read from, as the planner has them; 0 where it doesn't know."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < 1 << 50 else 0


def first_of(readers: list[tuple[str, Callable[[], DataFrame]]]) -> tuple[str, DataFrame]:
    """The first reader that works, with its name; raises with every failure if none does."""
    failures = []
    for name, read in readers:
        try:
            return name, read()
        except Exception as e:  # noqa: BLE001
            failures.append(f"{name}: {str(e).splitlines()[0]}")
    raise RuntimeError("no source could be read: " + "; ".join(failures))


def question_text(question: Column, choices: Column) -> Column:
    """A multiple-choice item: the question, then its choices, with single spaces."""
    return F.trim(F.concat_ws(" ", question, F.array_join(choices, " ")))


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """Non-blank lines of text files."""
    return spark.read.text(path).filter(F.trim("value") != "").withColumnRenamed("value", "text")


def json_lines(spark: SparkSession, path: str, schema: str, key: str | None = None) -> DataFrame:
    """JSON lines; torn and blank lines are dropped; with ``key``, the last row of each key (by file and place) stays."""
    rows = spark.read.schema(f"{schema}, _corrupt_record string").option("mode", "PERMISSIVE").json(path)
    at = rows.withColumn("_at", F.struct(F.col("_metadata.file_path").alias("f"), F.monotonically_increasing_id().alias("n")))
    good = at.filter(F.col("_corrupt_record").isNull()).drop("_corrupt_record")
    if key is None:
        return good.drop("_at")
    rest = [c for c in good.columns if c not in (key, "_at")]
    return good.groupBy(key).agg(F.max_by(F.struct(*rest), "_at").alias("_r")).select(key, *[F.col(f"_r.{c}").alias(c) for c in rest])


def synthetic_items(spark: SparkSession, each: int = 50) -> DataFrame:
    """``(item_id, text, label)``: members and others in turn; the texts are fixed values."""
    draws = np.random.default_rng(0).integers(1_000_000_000, size=each)
    member, other = "member document number {} ", "unseen heldout text {} "
    rows = [row for i, d in enumerate(draws) for row in ((f"m{i}", member.format(i) * 5, 1), (f"n{i}", other.format(int(d)) * 5, 0))]
    return spark.createDataFrame(rows, "item_id string, text string, label int")


def json_results(spark: SparkSession, path: str) -> dict | list:
    """A JSON document of results, read through Spark from wherever it lies."""
    import json

    return json.loads(spark.read.text(path, wholetext=True).first()[0])


def _scalar(value: str):
    """A YAML scalar or flow list of JSON's kinds; anything else is text."""
    import json

    plain = {"true": True, "false": False, "null": None, "~": None, "": None}
    value = value.strip()
    if value.lower() in plain:
        return plain[value.lower()]
    if value[0] == "'" and value[-1] == "'" and len(value) > 1:
        return value[1:-1].replace("''", "'")
    try:
        return json.loads(value)
    except ValueError:
        return [_scalar(v) for v in value[1:-1].split(",")] if value[0] == "[" and value[-1] == "]" else value


def _flat_yaml(raw: str) -> dict:
    out = {}
    for line in raw.splitlines():
        line = line.split(" #")[0].rstrip() if not line.lstrip().startswith("#") else ""
        if not line or line == "---":
            continue
        if line[0] in " -\t" or ":" not in line:
            raise ValueError(f"settings beyond name: value need the yaml package: {line!r}")
        name, value = line.split(":", 1)
        out[name.strip()] = _scalar(value)
    return out


def settings(path: str, given: dict) -> dict:
    """Settings of a YAML or JSON file over the given ones; dashes in names become underscores. Without the yaml package only lines ``name: value`` are read."""
    import json

    with open(path) as f:
        raw = f.read()
    try:
        loaded = json.loads(raw)
    except ValueError:
        try:
            import yaml
        except ImportError:
            loaded = _flat_yaml(raw)
        else:
            loaded = yaml.safe_load(raw)
    if not isinstance(loaded, dict):
        raise ValueError(f"{path} holds no settings")
    return given | {str(k).replace("-", "_"): v for k, v in loaded.items()}
