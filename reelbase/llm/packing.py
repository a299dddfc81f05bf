"""Problem 9: fixed-capacity containers filled with documents, measured in tokens.

Sizes are whole numbers up to the capacity, so the corpus is summed up as a histogram of at most
``capacity`` counts. Best-two-fit runs on that histogram: a container is filled greedily, then
its smallest document gives way to two others that fit the widened gap more tightly; the pattern
found is used for as many containers as the counts allow. Documents are then numbered within
their size, which tells each its container without any two documents meeting.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from reelbase.llm.tokens import RANKS, encode
from reelbase.tables import cut, small, table

CAPACITY = 1024
#: Documents of one size are numbered in shares of about so many rows, so that a common size (full
#: parts of split documents above all) is no single task.
SHARE_ROWS = 500_000


def best_two_fit(counts: np.ndarray, capacity: int) -> list[tuple[dict[int, int], int]]:
    """Patterns (copies by size) and for how many containers each is used; ``counts`` by size.

    The patterns use every item exactly once.
    """
    counts = counts.astype(np.int64).copy()
    plan: list[tuple[dict[int, int], int]] = []
    sizes = np.arange(len(counts))
    top = len(counts) - 1
    while True:
        while top > 0 and counts[top] == 0:
            top -= 1
        if top == 0:
            return plan
        left = counts[: top + 1].copy()
        bin_: dict[int, int] = {}
        gap = capacity
        s = top
        while s > 0:
            k = min(int(left[s]), gap // s)
            if k:
                bin_[s] = bin_.get(s, 0) + k
                left[s] -= k
                gap -= k * s
            s = min(s - 1, gap)
            if s > 0:  # the next size there is
                at = np.flatnonzero(left[1 : s + 1])
                s = int(at[-1]) + 1 if len(at) else 0
        if gap:
            small = min(bin_)
            room = gap + small
            ok = np.flatnonzero(left[1:room]) + 1  # sizes of the first of the two
            if len(ok):
                # the largest second size there is for each first
                have = np.where(left > 0, sizes[: len(left)], 0)
                upto = np.maximum.accumulate(have)
                second = upto[np.minimum(room - ok, len(upto) - 1)]
                twice = (second == ok) & (left[ok] < 2)
                second = np.where(twice, upto[np.maximum(second - 1, 0)], second)
                sums = np.where(second > 0, ok + second, 0)
                b = int(np.argmax(sums))
                if sums[b] > small:
                    bin_[small] -= 1
                    if not bin_[small]:
                        del bin_[small]
                    for x in (int(ok[b]), int(second[b])):
                        bin_[x] = bin_.get(x, 0) + 1
        times = min(int(counts[s] // k) for s, k in bin_.items())
        for s, k in bin_.items():
            counts[s] -= times * k
        plan.append((bin_, times))


def _layout(plan: list[tuple[dict[int, int], int]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By size: where each use of a pattern starts in the numbering, its copies, its first container."""
    rows: dict[int, list[tuple[int, int, int]]] = {}
    used: dict[int, int] = {}
    base = 1
    for pattern, times in plan:
        for s, k in pattern.items():
            rows.setdefault(s, []).append((used.get(s, 0), k, base))
            used[s] = used.get(s, 0) + k * times
        base += times
    return {s: tuple(np.array(x, dtype=np.int64) for x in zip(*r)) for s, r in rows.items()}


def pack(df: DataFrame, id_: str, size: str, capacity: int = CAPACITY, share_rows: int = SHARE_ROWS) -> DataFrame:
    """A container for every item.

    Result: ``id_``, ``part`` (from 1), ``part_start``, ``n_tokens`` and ``container_id`` (from 1).
    An item above the capacity is split into full parts and a rest; no other item is split. Items
    of size 0 or null take no space: one part with ``n_tokens`` 0 and a null container. Repeated
    ids are items of their own.
    """
    kind = dict(df.dtypes)[id_]
    items = df.select(F.col(id_).alias("i"), F.coalesce(F.col(size), F.lit(0)).cast("bigint").alias("s"))
    n = F.greatest(F.lit(1), F.ceil(F.col("s") / capacity)).cast("bigint")
    parts = items.select("i", "s", F.explode(F.sequence(F.lit(1).cast("bigint"), n)).alias("part")).select(
        "i", "part", ((F.col("part") - 1) * capacity).alias("at"), F.least(F.lit(capacity).cast("bigint"), F.col("s") - (F.col("part") - 1) * capacity).alias("s")
    )
    parts = cut(parts)
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for r in parts.where("s > 0").groupBy("s").agg(F.count("*").alias("n")).collect():  # at most ``capacity`` rows
        counts[r["s"]] = r["n"]
    layout = _layout(best_two_fit(counts, capacity))
    shares = F.broadcast(df.sparkSession.createDataFrame([(s, -(-int(n) // share_rows)) for s, n in enumerate(counts) if n], "s bigint, shares bigint"))
    spaced = parts.where("s > 0").join(shares, "s").withColumn("share", F.pmod(F.xxhash64("i", "part"), "shares")).drop("shares")
    held = cut(spaced.groupBy("s", "share").count())  # one row for about share_rows parts
    before = held.withColumn("before", F.sum("count").over(W.partitionBy("s").orderBy("share")) - F.col("count")).drop("count")
    numbered = spaced.join(small(before, 40), ["s", "share"]).select(
        "i", "part", "at", "s", (F.col("before") + F.row_number().over(W.partitionBy("s", "share").orderBy("i", "part")) - 1).alias("k")
    )

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            c = np.zeros(len(pdf), dtype=np.int64)
            s, k = pdf["s"].to_numpy(), pdf["k"].to_numpy()
            for one in np.unique(s):
                start, copies, base = layout[int(one)]
                at = np.flatnonzero(s == one)
                j = np.searchsorted(start, k[at], side="right") - 1
                c[at] = base[j] + (k[at] - start[j]) // copies[j]
            yield pd.DataFrame({"i": pdf["i"], "part": pdf["part"], "at": pdf["at"], "s": s, "c": c})

    out = numbered.mapInPandas(place, f"i {kind}, part bigint, at bigint, s bigint, c bigint")
    spaceless = parts.where("s = 0").select("i", "part", "at", "s", F.lit(None).cast("bigint").alias("c"))
    return out.unionByName(spaceless).toDF(id_, "part", "part_start", "n_tokens", "container_id")


def p9_containers(spark: SparkSession, sf_dir: str, ranks: str = RANKS) -> DataFrame:
    """The container of every document or part of one."""
    return pack(encode(table(spark, sf_dir, "documents"), "doc_id", "text", ranks, count_only=True), "doc_id", "n_tokens")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that had to be split."""
    return p9_containers(spark, sf_dir).where(F.col("part") == 2).select("doc_id")


def p9_held(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packing checked: of every document whether its parts hold all its tokens, each once and
    in as few parts as may be, and whether a container it lies in is overfull."""
    parts = cut(p9_containers(spark, sf_dir))
    full = parts.where("container_id is not null").groupBy("container_id").agg(F.sum("n_tokens").alias("held")).where(F.col("held") > CAPACITY).select("container_id", F.lit(True).alias("bad"))
    counted = encode(table(spark, sf_dir, "documents"), "doc_id", "text", count_only=True)
    placed = parts.join(full, "container_id", "left").groupBy("doc_id").agg(
        F.sum("n_tokens").alias("n"), F.count("*").alias("k"), F.count_distinct("part").alias("kinds"), F.coalesce(F.max("bad"), F.lit(False)).alias("overfull"), F.min(F.col("container_id").isNotNull() | (F.col("n_tokens") == 0)).alias("placed")
    )
    least = F.greatest(F.lit(1), F.ceil(F.col("n_tokens") / CAPACITY))
    whole = (F.col("n") == F.col("n_tokens")) & (F.col("k") == least) & (F.col("kinds") == F.col("k")) & F.col("placed")
    return counted.join(placed, "doc_id", "left").select("doc_id", F.coalesce(whole, F.lit(False)).alias("whole"), F.coalesce("overfull", F.lit(False)).alias("overfull"))


QUERIES = {"p9_found": p9_found, "p9_containers": p9_containers, "p9_held": p9_held}
ORACLE = {"p9_held": "select doc_id, true as whole, false as overfull from documents"}
