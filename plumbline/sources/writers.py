"""Writers: score caches, resumable appends and summaries."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F


def write_scores(df: DataFrame, path: str, form: str = "json") -> None:
    df.write.mode("overwrite").format(form).save(path)


def append_new(df: DataFrame, path: str, id_col: str, form: str = "parquet") -> int:
    """Append the rows whose id is not there yet, as one atomic commit; how many there were."""
    spark = df.sparkSession
    try:
        done = spark.read.format(form).load(path).select(id_col)
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
        todo = df
    else:
        todo = df.join(done, id_col, "left_anti")
    if not todo.limit(1).count():
        return 0
    seen = Observation()
    todo.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("append").format(form).save(path)
    return seen.get["n"]


def summary(df: DataFrame, most: int = 10_000) -> str:
    """A small result as JSON text; refuses a large one."""
    rows = [r[0] for r in df.limit(most + 1).select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]))).collect()]
    if len(rows) > most:
        raise ValueError(f"a summary has at most {most} rows")
    return json.dumps([json.loads(r) for r in rows], indent=2)
