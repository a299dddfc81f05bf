"""Set operations and what changes tables: upserts, merges, playback, playlists, deletions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from reelbase.functions import paths
from reelbase.functions.ranking import number, number_within, running_sum


def union_all(frames: list[DataFrame]) -> DataFrame:
    """Rows of all catalogues, missing columns null."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def merge(target: DataFrame, source: DataFrame, keys: list[str], mode: str = "replace", columns: list[str] | None = None) -> DataFrame:
    """Source into target by keys (both hold a key once): 'replace' takes source rows whole,
    'ignore' keeps target rows, 'upsert' takes the source's values for ``columns`` only."""
    if mode == "ignore":
        return target.unionByName(source.join(target.select(*keys), keys, "left_anti"), allowMissingColumns=True)
    if mode == "replace":
        return source.unionByName(target.join(source.select(*keys), keys, "left_anti"), allowMissingColumns=True)
    taken = [c for c in (columns or source.columns) if c not in keys and c in target.columns and c in source.columns]
    s = source.select(*keys, *[F.col(c).alias(f"__{c}") for c in taken], F.lit(True).alias("__new"))
    joined = target.withColumn("__old", F.lit(True)).join(s, keys, "full_outer")
    value = lambda c: F.when(F.col("__new"), F.col(f"__{c}")).otherwise(F.col(c)) if c in taken else F.col(c)
    return joined.select(*[value(c).alias(c) for c in target.columns])


def upsert_media(old: DataFrame, new: DataFrame, keep: tuple[str, ...] = ("time_created", "time_first_played", "time_last_played", "play_count", "playhead")) -> DataFrame:
    """A rescan: new values by path, but play state and creation stay, the first download time
    stays, and what is seen again is no longer deleted."""
    n = new.select("path", *[F.col(c).alias(f"__{c}") for c in new.columns if c != "path" and c in old.columns], F.lit(True).alias("__new"))
    j = old.withColumn("__old", F.lit(True)).join(n, "path", "full_outer")

    def value(c: str) -> Column:
        if c == "path" or c not in new.columns:
            return F.col(c)
        fresh = F.col(f"__{c}")
        if c == "time_downloaded":
            return F.coalesce(F.col(c), fresh)
        if c == "time_deleted":
            return F.when(F.col("__new"), F.lit(0).cast("bigint")).otherwise(F.col(c))
        if c in keep:
            return F.when(F.col("__old"), F.col(c)).otherwise(fresh)
        return F.when(F.col("__new"), fresh).otherwise(F.col(c))

    return j.select(*[value(c).alias(c) for c in old.columns])


def ingest_diff(known: DataFrame, found: DataFrame) -> DataFrame:
    """Files to be read again: new ones, those with another size or time, those marked deleted."""
    k = known.select("path", F.col("size").alias("__s"), F.col("time_modified").alias("__t"), F.coalesce("time_deleted", F.lit(0)).alias("__d"))
    j = found.join(k, "path", "left")
    same = F.col("size").eqNullSafe(F.col("__s")) & F.col("time_modified").eqNullSafe(F.col("__t")) & (F.col("__d") == 0)
    return j.where(~F.coalesce(same, F.lit(False))).withColumn("is_new", F.col("__d").isNull()).drop("__s", "__t", "__d")


def new_roots(roots: DataFrame) -> DataFrame:
    """Scan roots that lie below no other: each is looked up by its own ancestors."""
    p = paths.ancestors(F.col("path"))
    above = roots.select("path", F.explode(F.slice(p, 1, F.greatest(F.size(p) - 1, F.lit(0)))).alias("up"))
    covered = above.join(roots.select(F.col("path").alias("up")).distinct(), "up", "left_semi").select("path").distinct()
    return roots.join(covered, "path", "left_anti")


def playback(media: DataFrame, history: DataFrame) -> DataFrame:
    """Play state folded from the events of each path: first and last time, count of completed
    plays and the last playhead; 0 counts as never played."""
    when = F.struct("time_played", "id")
    h = history.where("time_played is not null and media_path is not null").groupBy(F.col("media_path").alias("path")).agg(
        F.min("time_played").alias("__f"), F.max("time_played").alias("__l"), F.count_if(F.col("done") == 1).alias("__n"), F.max_by(F.coalesce("playhead", F.lit(0)), when).alias("__p")
    )
    j = media.join(h, "path", "left")
    first = F.coalesce(F.expr("nullif(time_first_played, 0)"), F.col("__f"), F.lit(0))
    return j.select(
        *[c for c in media.columns if c not in ("time_first_played", "time_last_played", "play_count", "playhead")],
        first.alias("time_first_played"), F.greatest(F.coalesce("time_last_played", F.lit(0)), F.coalesce("__l", F.lit(0))).alias("time_last_played"),
        (F.coalesce("play_count", F.lit(0)) + F.coalesce("__n", F.lit(0))).alias("play_count"), F.coalesce("__p", "playhead").alias("playhead"),
    )


def mark_deleted(df: DataFrame, which: Column, now: int) -> DataFrame:
    return df.withColumn("time_deleted", F.when(F.coalesce(which, F.lit(False)), F.lit(now).cast("bigint")).otherwise(F.col("time_deleted")))


def restore(df: DataFrame, which: Column) -> DataFrame:
    return df.withColumn("time_deleted", F.when(F.coalesce(which, F.lit(False)), F.lit(0).cast("bigint")).otherwise(F.col("time_deleted")))


def hard_deleted(df: DataFrame, which: Column, *dependents: DataFrame) -> list[DataFrame]:
    """The table without some rows, and its dependents (by ``media_path``) without those whose path
    is left nowhere."""
    kept_ = df.where(~F.coalesce(which, F.lit(False)))
    gone = df.where(F.coalesce(which, F.lit(False))).select("path").join(kept_.select("path"), "path", "left_anti").select(F.col("path").alias("media_path")).distinct()
    return [kept_, *[d.join(gone, "media_path", "left_anti") for d in dependents]]


def bin_emptied(df: DataFrame, *dependents: DataFrame) -> list[DataFrame]:
    return hard_deleted(df, F.col("time_deleted") > 0, *dependents)


def _set(df: DataFrame, which: Column, **values: Column) -> DataFrame:
    on = F.coalesce(which, F.lit(False))
    return df.withColumns({c: F.when(on, v.cast(dict(df.dtypes)[c])).otherwise(F.col(c)) for c, v in values.items()})


def mark_played(df: DataFrame, which: Column, now: int) -> DataFrame:
    """Played once more to the end, now; a first time of 0 stays 0."""
    return _set(df, which, time_last_played=F.lit(now), time_first_played=F.coalesce("time_first_played", F.lit(now)), play_count=F.coalesce("play_count", F.lit(0)) + 1, playhead=F.lit(0))


def mark_unplayed(df: DataFrame, which: Column) -> DataFrame:
    """As never played, but for the first time."""
    return _set(df, which, play_count=F.lit(0), playhead=F.lit(0), time_last_played=F.lit(0))


def played_to(df: DataFrame, which: Column, now: int, playhead: int, completed: bool) -> DataFrame:
    """Played up to a place; a completed play counts."""
    return _set(df, which, time_last_played=F.lit(now), time_first_played=F.coalesce("time_first_played", F.lit(now)), playhead=F.lit(playhead), play_count=F.coalesce("play_count", F.lit(0)) + int(completed))


def rated(df: DataFrame, which: Column, score: float) -> DataFrame:
    return _set(df, which, score=F.lit(score))


def renamed_category(df: DataFrame, old: str, new: str) -> DataFrame:
    """One packed category under another name, where the row has it."""
    return df.withColumn("categories", F.replace("categories", F.lit(f";{old};"), F.lit(f";{new};")))


def keywords_added(keywords: DataFrame, new: DataFrame) -> DataFrame:
    """Category and keyword pairs that are not there yet."""
    return keywords.unionByName(new.distinct().join(keywords, ["category", "keyword"], "left_anti").select("category", "keyword"))


def keywords_removed(keywords: DataFrame, category: str, keyword: str | None = None) -> DataFrame:
    """Without a category's keyword, or without the category."""
    gone = F.col("category").eqNullSafe(category)
    return keywords.where(~(gone & F.col("keyword").eqNullSafe(keyword)) if keyword is not None else ~gone)


def playlist_created(playlists: DataFrame, path: str, title: str | None, extractor_key: str | None = None, extractor_config: str | None = None) -> DataFrame:
    """A playlist added under the next id; one of the same path only takes what is given."""
    given = {"title": title, "extractor_key": extractor_key, "extractor_config": extractor_config}
    updated = playlists.withColumns({c: F.when(F.col("path") == path, F.coalesce(F.lit(v), F.col(c))).otherwise(F.col(c)) for c, v in given.items()})
    new = playlists.agg((F.coalesce(F.max("id"), F.lit(0)) + 1).alias("id"), F.coalesce(F.max(F.col("path") == path), F.lit(False)).alias("__has")).where("not __has").select(
        "id", F.lit(path).alias("path"), *[F.lit(v).cast("string").alias(c) for c, v in given.items()], F.lit(0).cast("bigint").alias("time_deleted")
    )
    return updated.unionByName(new, allowMissingColumns=True)


def playlist_deleted(playlists: DataFrame, id_: int, now: int) -> DataFrame:
    return _set(playlists, F.col("id") == id_, time_deleted=F.lit(now))


def items_added(items: DataFrame, new: DataFrame, now: int) -> DataFrame:
    """Tracks added (``playlist_id``, ``media_path``, ``track_number``), once each; those there already
    take the new number."""
    added = new.groupBy("playlist_id", "media_path").agg(F.max("track_number").alias("track_number")).withColumn("time_added", F.lit(now).cast("bigint"))
    return merge(items, added, ["playlist_id", "media_path"], "upsert", ["track_number"]).join(
        added.select("playlist_id", "media_path", F.col("time_added").alias("__t")), ["playlist_id", "media_path"], "left"
    ).withColumn("time_added", F.coalesce("time_added", "__t")).drop("__t")


def items_removed(items: DataFrame, playlist_id: int, path: str | None = None) -> DataFrame:
    """Without one track of a playlist, or without all."""
    gone = F.col("playlist_id").eqNullSafe(playlist_id)
    return items.where(~(gone & F.col("media_path").eqNullSafe(path)) if path is not None else ~gone)


def appended(df: DataFrame, more: DataFrame, key: str = "path") -> DataFrame:
    """Rows and those of another table whose key is new, each key of these once."""
    fresh = more.join(df.select(key), key, "left_anti")
    order = F.struct(*[c for c, kind in fresh.dtypes if not kind.startswith(("map", "array<map"))])
    first = fresh.groupBy(key).agg(F.min(order).alias("__first")).select("__first.*")
    return df.unionByName(first, allowMissingColumns=True)


def rename(df: DataFrame, old: str, new: str) -> DataFrame:
    """Paths moved from one folder to another."""
    below = (F.col("path") == old) | F.col("path").startswith(old.rstrip("/") + "/")
    return df.withColumn("path", F.when(below, F.concat(F.lit(new), F.expr(f"substring(path, {len(old) + 1})"))).otherwise(F.col("path")))


def playlist(items: DataFrame, media: DataFrame) -> DataFrame:
    """Playlists' items with their media (once a path), in order of track, time added and path."""
    alive = media.where(F.coalesce("time_deleted", F.lit(0)) == 0).groupBy(F.col("path").alias("media_path")).agg(F.max("title").alias("title"), F.max("duration").alias("duration"))
    return number_within(items.join(alive, "media_path"), ["playlist_id"], [F.col("track_number").asc_nulls_first(), F.col("time_added").asc_nulls_first(), F.col("media_path")], "pos")


def move_track(items: DataFrame, playlist_id: int, path: str, to: int) -> DataFrame:
    """One playlist's tracks numbered anew after one moved to place ``to`` (from 0)."""
    own = items.where(F.col("playlist_id") == playlist_id)
    now = number(own, [F.col("track_number").asc_nulls_first(), F.col("time_added").asc_nulls_first(), F.col("media_path")], "__at").withColumn("__at", F.col("__at") - 1)
    from_ = F.broadcast(now.agg(F.max(F.when(F.col("media_path") == path, F.col("__at"))).alias("__from")))  # one row
    k = F.col("__at")
    at = F.when(k == F.col("__from"), F.lit(to)).when((k > F.col("__from")) & (k <= to), k - 1).when((k < F.col("__from")) & (k >= to), k + 1).otherwise(k)
    return now.crossJoin(from_).withColumn("track_number", at.cast("bigint")).drop("__at", "__from")


def fill_media_type(df: DataFrame) -> DataFrame:
    return df.withColumn("media_type", F.coalesce(F.when(F.col("media_type") != "", F.col("media_type")), paths.media_type(F.col("path"))))


def action_limit(df: DataFrame, order: list[Column], count: int, size: int) -> DataFrame:
    """Rows in order until a count or a sum of sizes is reached."""
    keep = df.columns
    s = running_sum(df.withColumn("__s", F.coalesce("size", F.lit(0))), order, "__s", "__t")
    # what is within both limits is among the first rows
    return s.where(F.col("__t") - F.col("__s") < size).orderBy(*order).limit(count).select(*keep)


def delete_found(df: DataFrame, which: Column) -> DataFrame:
    """A table without the rows of a search (where the search is undecided a row stays)."""
    return df.where(~F.coalesce(which, F.lit(False)))


# Columns of old catalogues that have become part of the description.
FOLDED = ("decade", "mood", "bpm", "key")


def migrate_media(df: DataFrame, schema: dict[str, str]) -> DataFrame:
    """A media table of an old catalogue in today's columns: 'type' is media_type, missing columns
    are null (counts and times 0), folded columns are appended to the description as 'name: value'."""
    out = df.withColumnRenamed("type", "media_type") if "type" in df.columns and "media_type" not in df.columns else df
    notes = [F.when(F.col(c).isNotNull() & (F.col(c).cast("string") != ""), F.concat(F.lit(f"{c}: "), F.col(c).cast("string"))) for c in FOLDED if c in out.columns]
    if notes:
        own = F.expr("nullif(description, '')") if "description" in out.columns else F.lit(None).cast("string")
        out = out.withColumn("description", F.concat_ws("\n", own, *notes)).withColumn("description", F.expr("nullif(description, '')"))
    zero = ("time_deleted", "time_first_played", "time_last_played", "play_count", "playhead", "video_count", "audio_count", "subtitle_count", "is_deduped")
    return out.select(*[F.col(c).cast(k).alias(c) if c in out.columns else F.lit(0 if c in zero else None).cast(k).alias(c) for c, k in schema.items()])


def migrate_events(events: DataFrame, media: DataFrame) -> DataFrame:
    """History or captions of an old catalogue, which name media by id, with paths instead; rows of
    unknown media keep a null path."""
    return events.join(media.select(F.col("id").alias("media_id"), F.col("path").alias("media_path")), "media_id", "left").drop("media_id")
