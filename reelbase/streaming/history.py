"""Streaming forms: usage by window, caption sessions, playback folds, incremental ingest."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.types import StructType

from reelbase.operators.aggregates import folder_stats
from reelbase.operators.changes import ingest_diff, playback


def usage_windows(events: DataFrame, time: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts by tumbling window; events later than the watermark are left out."""
    return events.withWatermark(time, late).groupBy(F.window(time, width).alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "n")


def sessions(captions: DataFrame, time: str, gap: str = "8 seconds", late: str = "1 minute") -> DataFrame:
    """Captions of a path that follow within a gap, as sessions."""
    return captions.withWatermark(time, late).groupBy("media_path", F.session_window(time, gap).alias("w")).agg(F.count("*").alias("n"), F.min("text").alias("first_text")).select("media_path", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def merged_captions(captions: DataFrame, gap: float = 8.0) -> DataFrame:
    """Captions (media_path, time, text, in order) merged while they come in; a caption that does
    not follow the one held lets it out, as does an hour without any."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        out = []
        held = state.get if state.exists else None
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame([(key[0], *held)], columns=["media_path", "time", "end", "text"])
            return
        for pdf in frames:
            for t, x in pdf.sort_values("time")[["time", "text"]].itertuples(index=False):
                x = x or ""
                end = t + len(x.encode()) / 4.2 / 220 * 60
                if held and (abs(t - held[1]) <= gap or abs(t - held[0]) <= gap):
                    held = (held[0], end, held[2] if x in held[2] else held[2] + ". " + x)
                else:
                    if held:
                        out.append((key[0], *held))
                    held = (float(t), float(end), x)
        state.update(held)
        state.setTimeoutDuration(3_600_000)
        yield pd.DataFrame(out, columns=["media_path", "time", "end", "text"])

    return captions.groupBy("media_path").applyInPandasWithState(step, "media_path string, time double, end double, text string", "time double, end double, text string", "append", GroupStateTimeout.ProcessingTimeTimeout)


def incoming(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Parquet files as a stream: those of a folder, or the one file of that name."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory():
        return spark.readStream.schema(schema).parquet(path)
    folder, _, name = path.rpartition("/")
    return spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder)


def collected(stream: DataFrame, folder: str) -> DataFrame:
    """What a stream with windows gives for all that is there now, as a table in a folder.

    The folder holds the stream's state as well; a second call goes on where the first one ended.
    """
    def keep(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/rows")

    stream.writeStream.outputMode("complete").foreachBatch(keep).trigger(availableNow=True).option("checkpointLocation", f"{folder}/state").start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/rows")


def refresh_folders(ticks: DataFrame, media: Callable[[], DataFrame], write: Callable[[DataFrame, int], None], every: str = "72 hours") -> DataStreamWriter:
    """The folder table made anew at intervals; ``ticks`` is any stream that paces it (a rate source)."""
    return ticks.writeStream.foreachBatch(lambda _, n: write(folder_stats(media()), n)).trigger(processingTime=every)


def fold_playback(history: DataFrame, media: Callable[[], DataFrame], write: Callable[[DataFrame, int], None]) -> DataStreamWriter:
    """Every batch of history is folded into media; ``write`` replaces the table (by batch number,
    so that a batch told twice is written once)."""
    return history.writeStream.foreachBatch(lambda batch, n: write(playback(media(), batch), n))


def ingest(files: DataFrame, known: Callable[[], DataFrame], write: Callable[[DataFrame, int], None]) -> DataStreamWriter:
    """Every batch of a listing is compared with what is known; only new and changed files go on."""
    return files.writeStream.foreachBatch(lambda batch, n: write(ingest_diff(known(), batch), n))
