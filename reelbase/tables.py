"""Access to the tables of a catalogue folder and to the shared checkpoint folder."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Above this many bytes (estimated from rows) a side is not broadcast but joined by a shuffle.
BROADCAST_BYTES = 8 << 20


_HOME = Path(__file__).resolve().parent.parent
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Lets Python workers import this package: where neither their path nor their folder leads to
    it, the driver sends them an archive of it, once a session."""
    sc = spark.sparkContext
    known = {Path(p).resolve() for p in [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)] if p}
    if _HOME in known or sc.applicationId in _shipped:
        return
    _shipped.add(sc.applicationId)
    archive = Path(tempfile.mkdtemp(prefix="reelbase-")) / "reelbase.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for p in (_HOME / "reelbase").rglob("*.py"):
            z.write(p, p.relative_to(_HOME))
    sc.addPyFile(str(archive))


def table(spark: SparkSession, folder: str, name: str, columns: list[str] | None = None) -> DataFrame:
    """The table ``name`` of a catalogue folder, pruned to ``columns`` where given."""
    ship(spark)
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    return df.select(*columns) if columns else df


def shared_folder(spark: SparkSession) -> str:
    """A new folder within the one that all executors share.

    That folder is the session's ``spark.checkpoint.dir``. Where that is unset, one is made only if
    all executors run in this very process; on a cluster a folder of one machine would be lost with
    it, so a missing setting is an error there.
    """
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not re.fullmatch(r"local(\[[^\[\]]*\])?", sc.master):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="reelbase-checkpoint-")
        sc.setCheckpointDir(folder)
    return f"{sc._jsc.sc().getCheckpointDir().get()}/{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """``df`` materialised in the shared folder: what comes after never goes back behind it."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def small(df: DataFrame, bytes_per_row: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if its counted rows prove it small, else unchanged.

    ``df`` should be cheap to count (checkpointed): the count is the size check.
    """
    return F.broadcast(df) if df.limit(limit // bytes_per_row + 1).count() <= limit // bytes_per_row else df


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores before work that is heavy for each row, where a small input comes in
    fewer partitions than there are cores; a larger one is left as it is."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n) if df._jdf.queryExecution().toRdd().getNumPartitions() < n else df
