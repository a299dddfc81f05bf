"""Roll-ups: folders, tree levels, buckets, periods, percentiles, statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelbase.functions import media as m
from reelbase.functions import paths, ranking, strings
from reelbase.functions.parsers import Range

#: Buckets of file sizes: 0, then 2, 5, 10 ... 1000 of each binary unit.
EDGES = [0, *(n * t * 1024**k for k in range(5) for t in (1, 10, 100) for n in (2, 5, 10))]


def live(df: DataFrame) -> DataFrame:
    return df.where(F.coalesce("time_deleted", F.lit(0)) == 0)


def library(df: DataFrame, *keys: str) -> DataFrame:
    """Count, sums, watched and unwatched rows and seconds played, over all or by keys."""
    played = F.coalesce("play_count", F.lit(0)) * F.coalesce("duration", F.lit(0)) + F.coalesce("playhead", F.lit(0))
    seen = F.coalesce("time_last_played", F.lit(0)) > 0
    return df.groupBy(*keys).agg(
        F.count("*").alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("total_size"), F.coalesce(F.sum("duration"), F.lit(0)).alias("total_duration"),
        F.count_if(seen).alias("watched"), F.count_if(~seen).alias("unwatched"), F.coalesce(F.sum(played), F.lit(0)).alias("total_played"),
    )


def usage(df: DataFrame, frequency: str, time: str) -> DataFrame:
    """Rows, size and duration by period of a time column; unset times and deleted rows left out."""
    return df.where((F.col(time) > 0) & (F.col("time_deleted") == 0)).groupBy(m.period(F.col(time), frequency).alias("label")).agg(
        F.count("*").alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("total_size"), F.coalesce(F.sum("duration"), F.lit(0)).alias("total_duration")
    )


def summary(df: DataFrame) -> DataFrame:
    """A Total and a Median row of size and duration."""
    one = df.agg(F.count("*").alias("n"), F.sum("size").alias("s"), F.sum("duration").alias("d"))
    for c in ("size", "duration"):
        one = one.crossJoin(F.broadcast(ranking.medians(df.withColumn("k", F.lit(1)), ["k"], c, f"m{c}").select(f"m{c}").agg(F.max(f"m{c}").alias(f"m{c}"))))  # one row
    return one.select(F.explode(F.array(
        F.struct(F.lit("Total").alias("label"), F.col("n").alias("n"), F.col("s").alias("size"), F.col("d").alias("duration")),
        F.struct(F.lit("Median").alias("label"), F.col("n").alias("n"), F.col("msize").cast("bigint").alias("size"), F.col("mduration").cast("bigint").alias("duration")),
    )).alias("r")).select("r.*")


def value_counts(df: DataFrame, column: Column, name: str, blank: str | None = None) -> DataFrame:
    """Rows by value; blanks are left out, or counted under ``blank``."""
    v = F.when(column != "", column)
    out = df.select((F.coalesce(v, F.lit(blank)) if blank else v).alias(name)).where(F.col(name).isNotNull())
    return out.groupBy(name).agg(F.count("*").alias("n"))


def category_counts(df: DataFrame, keywords: DataFrame) -> DataFrame:
    """Rows by packed category, custom categories without rows as 0, Uncategorized for blanks."""
    raw = live(df).groupBy("categories").agg(F.count("*").alias("n"))
    values = F.transform(strings.categories(F.col("categories")), lambda v: F.trim(v))
    used = raw.select("n", F.explode(F.when(F.size(values) == 0, F.array(F.lit("Uncategorized"))).otherwise(values)).alias("category"))
    none = keywords.select(F.lit(0).cast("bigint").alias("n"), F.col("category")).distinct()
    return used.unionByName(none).groupBy("category").agg(F.sum("n").alias("n"))


def measured(df: DataFrame, key: Column, name: str) -> DataFrame:
    """What is measured of groups of files; sizes and durations of rows not deleted. Key not null."""
    alive = F.coalesce("time_deleted", F.lit(0)) == 0
    of = lambda c: F.when(alive, F.col(c))
    keyed = df.withColumn(name, key)
    sums = keyed.groupBy(name).agg(
        F.count("*").alias("n"), F.count_if(alive).alias("n_exists"), F.count_if(~alive).alias("n_deleted"), F.count_if(F.coalesce("play_count", F.lit(0)) > 0).alias("n_played"),
        F.coalesce(F.sum(of("size")), F.lit(0)).alias("total_size"), F.coalesce(F.sum(of("duration")), F.lit(0)).alias("total_duration"), F.floor(F.avg(of("size"))).cast("bigint").alias("avg_size"),
    )
    middle = ranking.medians(keyed.where(alive), [name], "size", "m")
    return sums.join(middle, name, "left").withColumn("median_size", F.col("m").cast("bigint")).drop("m")


def by_extension(df: DataFrame) -> DataFrame:
    ext = paths.extension(F.col("path"))
    return measured(df, F.when(ext == "", "no extension").otherwise(ext), "extension")


def by_size(df: DataFrame) -> DataFrame:
    """By size bucket, named by its lower edge; null counts as 0."""
    size = F.coalesce("size", F.lit(0))
    low = F.lit(EDGES[0])
    for e in EDGES[1:]:
        low = F.when(size >= e, F.lit(e)).otherwise(low)
    return measured(df, low.cast("bigint"), "low")


def by_parent(df: DataFrame) -> DataFrame:
    return measured(df, paths.parent(F.col("path")), "folder")


def by_depth(df: DataFrame, depth: int) -> DataFrame:
    """By the first ``depth`` components of the path; files higher up count as themselves."""
    return measured(df, paths.parent_at_depth(F.col("path"), depth), "folder")


def tree(df: DataFrame, low: int = 1, high: int = 99) -> DataFrame:
    """Every folder of every depth between, the files themselves included, with all below it.

    Rows are summed by path first, so that what is multiplied by the depth is already small;
    sums and counts only, which can be added up the tree.
    """
    alive = F.coalesce("time_deleted", F.lit(0)) == 0
    files = df.groupBy("path").agg(F.count("*").alias("n"), F.coalesce(F.sum(F.when(alive, F.col("size"))), F.lit(0)).alias("s"), F.coalesce(F.sum(F.when(alive, F.col("duration"))), F.lit(0)).alias("d"))
    each = files.select("n", "s", "d", F.explode(F.slice(paths.ancestors(F.col("path")), low, max(high - low + 1, 1))).alias("folder"))
    return each.groupBy("folder").agg(F.sum("n").alias("n"), F.sum("s").alias("total_size"), F.sum("d").alias("total_duration"))


def subfolders(df: DataFrame) -> DataFrame:
    """How many folders with files lie somewhere below each folder."""
    folders = df.select(paths.parent(F.col("path")).alias("folder")).distinct()
    above = folders.select(F.explode(F.slice(paths.ancestors(F.col("folder")), 1, F.greatest(paths.depth(F.col("folder")) - 1, F.lit(0)))).alias("folder"))
    return above.groupBy("folder").agg(F.count("*").alias("n_folders"))


def keep_folders(stats: DataFrame, files: Range | None = None, size: Range | None = None, folders_only: bool = False) -> DataFrame:
    """Conditions on groups, after they are made."""
    out = stats.where("n > 0") if folders_only else stats
    if files:
        out = out.where(files.matches(F.greatest("n_exists", "n")))
    return out.where(size.matches(F.col("total_size"))) if size else out


def disk_usage(df: DataFrame, prefix: str) -> DataFrame:
    """One level of a disk-usage browser: what lies below ``prefix``, by next component."""
    base = "/" + "/".join(p for p in prefix.replace("\\", "/").split("/") if p)
    base = base if base == "/" else base + "/"
    level = base.count("/") - 1
    inside = live(df).where(paths.tidy(F.col("path")).startswith(base))
    p = paths.parts(F.col("path"))
    return inside.where(F.size(p) > level).groupBy(
        F.concat(F.lit(base), F.element_at(p, level + 1)).alias("entry"), (F.size(p) == level + 1).alias("is_file")
    ).agg(F.count("*").alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("total_size"), F.coalesce(F.sum("duration"), F.lit(0)).alias("total_duration"))


def folder_stats(df: DataFrame) -> DataFrame:
    """The table kept of every folder: depth, files, size, duration."""
    parent = paths.parent(F.col("path"))
    return live(df).groupBy(parent.alias("parent")).agg(
        F.count("*").alias("file_count"), F.coalesce(F.sum("size"), F.lit(0)).alias("total_size"), F.coalesce(F.sum("duration"), F.lit(0)).alias("total_duration")
    ).withColumn("depth", F.length("parent") - F.length(F.replace("parent", F.lit("/"), F.lit(""))))


def percentiles(df: DataFrame, column: str) -> DataFrame:
    """101 points of a column's distribution in which no value holds more than 5 % of the mass.

    The empirical distribution is blended with the uniform one over distinct values by the
    largest share of the former that keeps to this. Rows: ``pct``, ``value``.
    """
    freq = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("v")).agg(F.count("*").alias("c"))
    total = freq.agg(F.sum("c").alias("n"), F.count("*").alias("d"))
    f, u = F.col("c") / F.col("n"), 1.0 / F.col("d")
    shares = freq.crossJoin(F.broadcast(total)).withColumn("f", f).withColumn("u", u)
    capped = F.when((F.col("f") > 0.05) & (F.col("f") > F.col("u")), (0.05 - F.col("u")) / (F.col("f") - F.col("u")))
    lam = shares.agg(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(F.min(capped), F.lit(1.0)))).alias("lam"))
    w = shares.crossJoin(F.broadcast(lam)).select("v", (F.col("lam") * F.col("f") + (1 - F.col("lam")) * F.col("u")).alias("w"))
    cum = ranking.running_sum(w, [F.col("v")], "w", "cum").withColumn("cum", F.col("cum") + 1e-12)
    # a value stands for the points above the mass before it, up to that with it
    ends = cum.select("v", F.when(F.col("cum") - F.col("w") <= 2e-12, 0).otherwise(F.floor((F.col("cum") - F.col("w")) * 100).cast("int") + 1).alias("a"), F.least(F.lit(100), F.floor(F.col("cum") * 100).cast("int")).alias("b"))
    points = ends.where("a <= b").select("v", F.explode(F.sequence("a", "b")).alias("pct"))
    last = cum.agg(F.max("v").alias("v"), F.lit(100).alias("pct"))
    return points.unionByName(last).groupBy("pct").agg(F.min("v").alias("value"))


def word_counts(df: DataFrame, text: Column) -> DataFrame:
    return df.select(F.explode(strings.words(text)).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


#: The filter dimensions and what is taken for a value of each.
DIMENSIONS = {
    "size": "size < 109951162777600", "duration": "duration > 0 and duration < 2678400", "time_modified": "true", "time_created": "true", "time_downloaded": "true",
}


def bins(df: DataFrame, filters: dict[str, Column] | None = None) -> DataFrame:
    """``dim``, ``low``, ``high`` and the 101-point vector of each filter dimension, over the rows that
    the filters of all other dimensions leave: none narrows its own.

    ``filters``: a condition by dimension; that of 'episodes' is on ``episodes``, the rows of a folder.
    """
    given = filters or {}

    def others(name: str) -> DataFrame:
        rows = df
        for k, condition in given.items():
            if k != name and k != "episodes":
                rows = rows.where(condition)
        if "episodes" in given and name != "episodes":
            folder = paths.parent(F.col("path"))
            kept = rows.groupBy(folder.alias("__f")).agg(F.count("*").alias("episodes")).where(given["episodes"]).select("__f")
            rows = rows.withColumn("__f", folder).join(kept, "__f", "left_semi").drop("__f")
        return rows

    wanted = {name: others(name).where(clamp) for name, clamp in DIMENSIONS.items()}
    wanted["episodes"] = others("episodes").groupBy(paths.parent(F.col("path"))).agg(F.count("*").alias("episodes"))
    out = None
    for name, rows in wanted.items():
        points = percentiles(rows, name)
        one = points.agg(F.lit(name).alias("dim"), F.min("value").alias("low"), F.max("value").alias("high"), F.transform(F.array_sort(F.collect_list(F.struct("pct", "value"))), lambda p: p["value"]).alias("points"))
        out = one if out is None else out.unionByName(one)
    return out


def sampled_bins(df: DataFrame, each: int = 1000, seed: int = 7) -> DataFrame:
    """``dim``, ``low``, ``high`` over a random sample of so many rows of each catalogue (a sampling
    operator: quick, not exact)."""
    random = ranking.number_within(df.select("db", "size", "duration", "time_modified").withColumn("__r", F.rand(seed)), ["db"], [F.col("__r")], "__k")
    s = random.where(F.col("__k") <= each)
    return s.select(F.explode(F.array(*[F.struct(F.lit(c).alias("dim"), F.col(c).alias("v")) for c in ("size", "duration", "time_modified")])).alias("x")).groupBy("x.dim").agg(F.min("x.v").alias("low"), F.max("x.v").alias("high"), F.count("x.v").alias("n"))


def parent_counts(df: DataFrame) -> DataFrame:
    """Rows by folder; a row without a path counts as 'unknown'."""
    return value_counts(df, paths.parent(F.col("path")), "folder", "unknown")


def ratings(df: DataFrame) -> DataFrame:
    """Rows by whole score, no score being 0."""
    return df.groupBy(F.coalesce("score", F.lit(0.0)).cast("bigint").alias("rating")).agg(F.count("*").alias("n"))


def _enclosed(packed: str) -> Column:
    """Values that stand between two semicolons."""
    parts = F.split(F.coalesce(packed, F.lit("")), ";")
    return F.slice(parts, 2, F.greatest(F.size(parts) - 2, F.lit(0)))


def named_categories(df: DataFrame, names: DataFrame) -> DataFrame:
    """Rows that hold each of the named categories (``category``), and those with none at all."""
    packed = df.groupBy("categories").agg(F.count("*").alias("n"))
    held = packed.select("n", F.explode(F.array_distinct(_enclosed("categories"))).alias("category")).groupBy("category").agg(F.sum("n").alias("n"))
    wanted = names.select("category").where("category is not null").distinct().join(held, "category", "left").select("category", F.coalesce("n", F.lit(0)).alias("n"))
    none = packed.agg(F.lit("Uncategorized").alias("category"), F.coalesce(F.sum(F.when(F.coalesce("categories", F.lit("")) == "", F.col("n"))), F.lit(0)).alias("n"))
    return wanted.unionByName(none)


def grouped_by_parent(df: DataFrame) -> DataFrame:
    """Folders with their first and last path and rows."""
    return df.groupBy(paths.parent(F.col("path")).alias("folder")).agg(F.min("path").alias("first_path"), F.max("path").alias("last_path"), F.count("*").alias("n"))


def captions_by_media(captions: DataFrame) -> DataFrame:
    """Captions of each path: how many, the sum of their whole seconds, and the first with its text."""
    first = F.min_by(F.struct("time", "text"), F.struct(F.col("time").isNull(), F.col("time"), F.col("caption_id")))
    out = captions.groupBy("media_path").agg(F.count("*").alias("n"), F.coalesce(F.sum(F.floor("time")), F.lit(0)).alias("total_time"), first.alias("f"))
    return out.select("media_path", "n", "total_time", F.col("f.time").alias("first_time"), F.col("f.text").alias("first_text"))


def history_counts(history: DataFrame) -> DataFrame:
    return history.groupBy("media_path").agg(F.count("*").alias("n"), F.max("time_played").alias("last"))


def last_tracks(items: DataFrame) -> DataFrame:
    """The highest track number of each playlist; 0 where none has one."""
    return items.groupBy("playlist_id").agg(F.coalesce(F.max("track_number"), F.lit(0)).alias("last_track"))


def with_group_size(df: DataFrame, by: str, name: str = "n") -> DataFrame:
    """Rows with how many have the same value; null is no value."""
    known = df.where(F.col(by).isNotNull())
    return known.join(known.groupBy(by).agg(F.count("*").alias(name)), by)


def interpolated(df: DataFrame, keys: list[str], value: str, percent: float, name: str) -> DataFrame:
    """The percentile of each group, interpolated between the two values beside it; nulls left out.

    Found by cumulative counts over the sorted table, as medians are, so no group is held in a task.
    """
    counted = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("__v")).agg(F.count("*").alias("__c"))
    s = ranking.running_sum(counted, [*[F.col(k) for k in keys], F.col("__v")], "__c", "__z")
    span = s.groupBy(*keys).agg(F.min(F.col("__z") - F.col("__c")).alias("__a"), F.sum("__c").alias("__n"))
    at = F.lit(min(max(percent, 0.0), 100.0)) / 100 * (F.col("__n") - 1)
    low, share = F.floor(at), at - F.floor(at)
    holds = lambda k: (F.col("__z") - F.col("__c") - F.col("__a") <= k) & (k < F.col("__z") - F.col("__a"))
    part = F.when(holds(low), (1 - share) * F.col("__v")).otherwise(0.0) + F.when((share > 0) & holds(low + 1), share * F.col("__v")).otherwise(0.0)
    return s.join(span, keys).groupBy(*keys).agg(F.sum(part).alias(name))


def by_mode(df: DataFrame, mode: str = "", depth: int = 1) -> DataFrame:
    """The roll-up that is asked for: by 'extensions', 'sizes', 'depth' or, by default, folder."""
    return {"extensions": by_extension, "sizes": by_size}.get(mode, by_parent)(df) if mode != "depth" else by_depth(df, depth)


def query_times(spark) -> DataFrame:
    """``description``, ``n``, ``avg_ms``, ``max_ms``: the finished jobs that the session's status store
    still knows (it drops the oldest)."""
    store = spark.sparkContext._jsc.sc().statusStore()
    rows = []
    jobs = store.jobsList(spark._jvm.java.util.ArrayList()).iterator()
    while jobs.hasNext():
        job = jobs.next()
        if job.submissionTime().isDefined() and job.completionTime().isDefined():
            rows.append((job.name(), job.completionTime().get().getTime() - job.submissionTime().get().getTime()))
    df = spark.createDataFrame(rows, "description string, ms long")
    return df.groupBy("description").agg(F.count("*").alias("n"), F.avg("ms").alias("avg_ms"), F.max("ms").alias("max_ms"))


def disk_usage_page(df: DataFrame, prefix: str, by: str = "total_size", limit: int = 100, offset: int = 0) -> DataFrame:
    """A page of a disk-usage level: folders first, the largest first. Where folders fill the page to
    its end, all files of the level come with it."""
    level = disk_usage(df, prefix)
    order = [F.desc(by), F.col("entry")]
    folders = level.where("not is_file")
    n = folders.count()  # of one level
    files = level.where("is_file")
    if offset >= n:
        return files.orderBy(*order).offset(offset - n).limit(limit)
    page = folders.orderBy(*order).offset(offset).limit(limit)
    return page.unionByName(files.orderBy(*order).limit(offset + limit - n) if offset + limit > n else files)


def listed(df: DataFrame, prefix: str, limit: int | None = None) -> DataFrame:
    """What lies next below a prefix, which may end within a name: ``entry``, ``is_folder``, ``n``; a
    name that is both is a folder. ``limit`` names the first by count, folders and name (a top list)."""
    base = prefix[: prefix.rfind("/") + 1]
    level = base.count("/") - 1 if base.startswith("/") else base.count("/")
    p = paths.parts(F.col("path"))
    inside = df.where(F.col("path").startswith(prefix)).select(p.alias("p")).where(F.size("p") > level)
    out = inside.groupBy(F.element_at("p", level + 1).alias("entry")).agg(F.max(F.size("p") > level + 1).alias("is_folder"), F.count("*").alias("n"))
    return out if limit is None else out.orderBy(F.desc("n"), F.desc("is_folder"), "entry").limit(limit)
