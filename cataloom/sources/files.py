"""Sources and sinks: JSON, CSV, cue sheets, delta packages and release lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cataloom.functions.scalars import cue_seconds

RELEASE_ASSET = r"delta-(\d{4}[.-]\d{2}[.-]\d{2})-to-(\d{4}[.-]\d{2}[.-]\d{2})"


def read_json(spark: SparkSession, path: str, schema: str, lines: bool = False) -> DataFrame:
    """JSON of a stated schema; one document per file unless ``lines``."""
    return spark.read.schema(schema).option("multiLine", not lines).json(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with header; floating-point columns with three decimals."""
    shown = [F.format_string("%.3f", F.col(c)).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes]
    df.select(*shown).write.mode("overwrite").option("header", True).csv(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def read_cues(spark: SparkSession, path: str) -> DataFrame:
    """``path, start, end, middle, x, y, w, h`` of the cues of sprite sheets (WebVTT)."""
    text = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value"))
    cue = r"(?m)^([\d:.]+)\s+-->\s+([\d:.]+)[^\n]*\n([^\n]*)#xywh=(\d+),(\d+),(\d+),(\d+)"
    found = text.select("path", F.explode(F.regexp_extract_all("value", F.lit(cue), 0)).alias("c"))
    part = lambda k: F.regexp_extract("c", cue, k)
    start, end = cue_seconds(part(1)), cue_seconds(part(2))
    return found.select("path", start.alias("start"), end.alias("end"), ((start + end) / 2).alias("middle"), *[part(4 + k).cast("int").alias(c) for k, c in enumerate("xywh")])


def delta_steps(assets: DataFrame) -> DataFrame:
    """``source, version`` of the assets (``name``) that are delta packages."""
    s, v = F.regexp_extract("name", RELEASE_ASSET, 1), F.regexp_extract("name", RELEASE_ASSET, 2)
    return assets.select(s.alias("source"), v.alias("version")).where("source <> '' and version <> ''").distinct()


def verified(files: DataFrame, sums: DataFrame) -> DataFrame:
    """Binary files (``path, content``) whose sha256 is the one listed (``path, sha256``)."""
    return files.withColumn("sha256", F.sha2("content", 256)).join(sums, ["path", "sha256"]).drop("sha256")
