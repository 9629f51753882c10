"""Stores that jobs write and read again: vector indexes, checkpoints, swapped tables, SQLite files."""

from __future__ import annotations

import json
import sqlite3

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _file_system(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path


def swap_table(df: DataFrame, path: str) -> None:
    """Replace the table at ``path`` by ``df``; the former one is kept as ``path.prev``.

    The new table is written beside the old one and moved into place, so a
    reader sees the old or the new one; where the second move fails, the first
    is taken back. ``df`` may read the table that it replaces.
    """
    spark = df.sparkSession
    fs, at = _file_system(spark, path)
    staged, kept = at(path + ".staged"), at(path + ".prev")
    fs.delete(staged, True)
    df.write.parquet(path + ".staged")
    held = fs.exists(at(path))
    if held:
        fs.delete(kept, True)
        if not fs.rename(at(path), kept):
            raise OSError(f"cannot set {path} aside")
    if not fs.rename(staged, at(path)):
        if held:
            fs.rename(kept, at(path))
        raise OSError(f"cannot move the new table to {path}")


def save_checkpoint(spark: SparkSession, path: str, state: dict) -> None:
    """Write a job's state as JSON; the former state stays until the new one is whole."""
    swap_table(spark.createDataFrame([(json.dumps(state, sort_keys=True),)], "state string"), path)


def load_checkpoint(spark: SparkSession, path: str) -> dict | None:
    """The state last saved at ``path``, none if there is none."""
    fs, at = _file_system(spark, path)
    if not fs.exists(at(path)):
        return None
    row = spark.read.schema("state string").parquet(path).first()
    return json.loads(row["state"]) if row else None


def save_index(vectors: DataFrame, path: str, id_col: str, vector: str) -> None:
    """Keep a vector index as a table ``id, v`` with one row per id; null and empty vectors are left out."""
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector).cast("array<float>").alias("v")).where("id is not null and size(v) > 0")
    swap_table(rows.dropDuplicates(["id"]), path)


def load_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_sqlite(spark: SparkSession, path: str, table: str, key: str, schema: str, rows: int = 100_000) -> DataFrame:
    """A table of an SQLite file, opened read-only, in ranges of its whole-number ``key``.

    The file has to be reachable under ``path`` from every executor. Each range
    is one task's cursor, read in batches; an empty table gives no rows.
    """
    names = [f.name for f in spark.createDataFrame([], schema).schema.fields]
    quoted = ", ".join(f'"{n}"' for n in names)
    with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as held:
        low, high = held.execute(f'select min("{key}"), max("{key}") from "{table}"').fetchone()
    if low is None:
        return spark.createDataFrame([], schema)
    ranges = spark.range(int(low), int(high) + 1, rows).repartition(max(1, (int(high) - int(low)) // rows + 1))
    from pyspark.sql.pandas.types import to_arrow_schema

    kind = to_arrow_schema(spark.createDataFrame([], schema).schema)

    def op(batches):
        held = sqlite3.connect(f"file:{path}?mode=ro", uri=True)
        for b in batches:
            for start in b.column(0).to_pylist():
                cursor = held.execute(f'select {quoted} from "{table}" where "{key}" >= ? and "{key}" < ?', (start, start + rows))
                while got := cursor.fetchmany(10_000):
                    yield pa.RecordBatch.from_arrays([pa.array(c, kind.field(i).type) for i, c in enumerate(zip(*got))], schema=kind)
        held.close()

    return ranges.mapInArrow(op, schema)


def pages(df: DataFrame, order: list[str], size: int, page: int) -> tuple[DataFrame, int]:
    """One page (from 1) in a total order, and the number of all rows."""
    return df.orderBy(*order).offset((page - 1) * size).limit(size), df.count()
