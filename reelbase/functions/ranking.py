"""Numbering and running sums over a whole table, without a window in one task.

The table is sorted by range partitions; each partition is numbered on its own and shifted by the
rows of those before it. Only one number a partition is gathered. ``keep`` names the columns that
are wanted: nothing else is read, sorted or kept beside what the order needs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from reelbase.tables import cut


def _sorted(df: DataFrame, order: list[Column], keep: list[str] | None = None) -> DataFrame:
    out = df.orderBy(*order)
    out = cut(out.select(*keep) if keep else out)
    n = F.monotonically_increasing_id()
    return out.withColumn("__p", F.shiftright(n, 33)).withColumn("__k", n.bitwiseAND(F.lit((1 << 33) - 1)))


def number(df: DataFrame, order: list[Column], name: str = "rn", keep: list[str] | None = None, total: str | None = None) -> DataFrame:
    """Rows numbered from 1 in a total order; ``total``: a column for the number of all rows."""
    s = _sorted(df, order, keep)
    sizes = s.groupBy("__p").count()  # one row a partition
    every = W.partitionBy(F.lit(1))
    before = sizes.select("__p", (F.sum("count").over(every.orderBy("__p")) - F.col("count")).alias("__b"), *([F.sum("count").over(every).alias(total)] if total else []))
    return s.join(F.broadcast(before), "__p").withColumn(name, F.col("__b") + F.col("__k") + 1).drop("__p", "__k", "__b")


def running_sum(df: DataFrame, order: list[Column], value: str, name: str, keep: list[str] | None = None) -> DataFrame:
    """The sum of ``value`` up to and with each row in a total order."""
    s = _sorted(df, order, keep)
    sums = s.groupBy("__p").agg(F.sum(value).alias("__s"))
    before = sums.select("__p", (F.sum("__s").over(W.partitionBy(F.lit(1)).orderBy("__p")) - F.col("__s")).alias("__b"))
    own = F.sum(value).over(W.partitionBy("__p").orderBy("__k").rowsBetween(W.unboundedPreceding, 0))
    return s.withColumn("__o", own).join(F.broadcast(before), "__p").withColumn(name, F.col("__b") + F.col("__o")).drop("__p", "__k", "__b", "__o")


def ntile(df: DataFrame, order: list[Column], tiles: int, name: str = "tile", keep: list[str] | None = None) -> DataFrame:
    """SQL's ntile over the whole table."""
    numbered = number(df, order, "__rn", keep, "__n")
    q, r, k = F.floor(F.col("__n") / tiles), F.col("__n") % tiles, F.col("__rn") - 1
    tile = F.when(k < r * (q + 1), F.floor(k / (q + 1))).otherwise(r + F.floor((k - r * (q + 1)) / F.greatest(q, F.lit(1)))) + 1
    return numbered.withColumn(name, tile.cast("int")).drop("__rn", "__n")


def number_within(df: DataFrame, keys: list[str], order: list[Column], name: str = "rn", keep: list[str] | None = None) -> DataFrame:
    """Rows numbered from 1 within each group, however large: a number over the whole table less
    that of the group's first row."""
    all_ = number(df, [*[F.col(k).asc_nulls_first() for k in keys], *order], "__n", keep and [*keys, *[c for c in keep if c not in keys]])
    first = all_.groupBy(*keys).agg(F.min("__n").alias("__f"))
    on = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys]
    joined = all_.alias("l").join(first.alias("r"), on)
    return joined.select("l.*", (F.col("__n") - F.col("__f") + 1).alias(name)).drop("__n")


def medians(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """The exact median of each group (mean of the middle two), nulls left out; keys are not null.

    An aggregate buffer would hold a group's values in one task. Here equal values of a group are
    counted first, the counts are summed up over the sorted table, and the middle values are those
    whose share of the sum holds the middle.
    """
    counted = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("__v")).agg(F.count("*").alias("__c"))
    s = running_sum(counted, [*[F.col(k) for k in keys], F.col("__v")], "__c", "__z")
    span = s.groupBy(*keys).agg(F.min(F.col("__z") - F.col("__c")).alias("__a"), F.sum("__c").alias("__n"))
    low, high = F.col("__a") + F.floor((F.col("__n") + 1) / 2), F.col("__a") + F.ceil((F.col("__n") + 1) / 2)
    holds = lambda at: (F.col("__z") - F.col("__c") < at) & (at <= F.col("__z"))
    middle = s.join(span, keys).withColumn("__w", holds(low).cast("int") + holds(high).cast("int")).where("__w > 0")
    return middle.groupBy(*keys).agg((F.sum(F.col("__v") * F.col("__w")) / 2).alias(name))
