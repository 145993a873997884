"""Writers. Spark's commit protocol makes a table's files appear together or not at all."""

from __future__ import annotations

import json
import os
import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def json_lines(df: DataFrame, path: str, append: bool = False, compress: bool = False) -> None:
    df.write.mode("append" if append else "overwrite").option("compression", "gzip" if compress else "none").json(path)


def csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


#: Most rows of a report that goes through the driver.
SMALL = 100_000


def _small(df: DataFrame) -> DataFrame:
    if df.limit(SMALL + 1).count() > SMALL:
        raise ValueError(f"a report of more than {SMALL} rows: write a table instead")
    return df


def csv_with_mark(df: DataFrame, path: str) -> None:
    """One CSV file with a byte order mark, for spreadsheets, of a report of at most SMALL rows."""
    rows = _small(df).toPandas()
    _replace(path, lambda f: rows.to_csv(f, index=False), encoding="utf-8-sig")


def sharded(df: DataFrame, path: str, key: str, shards: int) -> DataFrame:
    """df written in folders by a hash of its key; returns the manifest (shard, n_rows)."""
    shard = (F.conv(F.substring(F.sha2(F.col(key).cast("string"), 256), 1, 8), 16, 10).cast("bigint") % shards).cast("int")
    x = df.withColumn("shard", shard)
    x.repartition("shard").write.mode("overwrite").partitionBy("shard").json(path)
    return df.sparkSession.read.json(path).groupBy("shard").agg(F.count(F.lit(1)).alias("n_rows"))


def _replace(path: str, write, encoding: str = "utf-8") -> None:
    folder = os.path.dirname(os.path.abspath(path))
    os.makedirs(folder, exist_ok=True)
    handle, temporary = tempfile.mkstemp(dir=folder)
    with os.fdopen(handle, "w", encoding=encoding) as f:
        write(f)
    os.replace(temporary, path)


def status(path: str, payload: dict) -> None:
    """A small JSON file, replaced at once."""
    _replace(path, lambda f: json.dump(payload, f, ensure_ascii=False, indent=1, sort_keys=True))


def markdown(df: DataFrame, columns: list[str]) -> str:
    """A table of a result of at most SMALL rows."""
    lines = ["| " + " | ".join(columns) + " |", "|" + "---|" * len(columns)]
    return "\n".join([*lines, *("| " + " | ".join("" if r[c] is None else str(r[c]) for c in columns) + " |" for r in _small(df.select(*columns)).collect())])
