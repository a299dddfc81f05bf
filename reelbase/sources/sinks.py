"""Where results go: tables that are merged or appended, and printed text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reelbase.functions import media as m
from reelbase.operators.changes import upsert_media

DURATIONS, SIZES, TIMES = ("duration", "playhead", "avg_duration", "median_duration"), ("size", "avg_size", "median_size"), ("time_last_played",)


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def write_media(new: DataFrame, path: str) -> str:
    """A rescan's rows (each path once) merged into the media table kept at a path; the place of the
    new version.

    Every version is a folder of its own ('v=1', 'v=2', ...), written whole before it counts, so that
    a lost job leaves the last one as it was.
    """
    spark = new.sparkSession
    versions = 0
    while _exists(spark, f"{path}/v={versions + 1}/_SUCCESS"):
        versions += 1
    merged = upsert_media(spark.read.parquet(f"{path}/v={versions}"), new) if versions else new
    merged.write.mode("overwrite").parquet(f"{path}/v={versions + 1}")
    return f"{path}/v={versions + 1}"


def append_captions(captions: DataFrame, path: str) -> None:
    """Caption rows added to the table kept at a path; blank ones are none."""
    captions.where(F.trim("text") != "").select("media_path", "time", "text").write.mode("append").parquet(path)


def shown(name: str) -> Column:
    """A column as text: durations, sizes and times for readers, null numbers as 0, null text as ''."""
    c = F.col(name)
    if name in DURATIONS:
        return m.format_duration(c)
    if name in SIZES:
        return m.format_size(c)
    if name in TIMES:
        return m.format_time(c)
    if name == "db":
        return F.substring_index(c, "/", -1)
    return F.coalesce(c.cast("string"), F.lit("0" if name.endswith("count") else ""))


def lines(df: DataFrame, columns: tuple[str, ...] = ("path", "duration", "size"), *keep: str) -> DataFrame:
    """``keep`` and ``line``: the columns as one line of text, parted by tabs."""
    return df.select(*keep, F.concat_ws("\t", *[shown(c) for c in columns]).alias("line"))


def write_lines(df: DataFrame, path: str, columns: tuple[str, ...] = ("path", "duration", "size")) -> None:
    lines(df, columns).select("line").write.mode("overwrite").option("header", False).text(path)
