"""More queries over the catalogue: requests, sort dispatch, edits, duplicates in steps, reports, each
with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelbase.functions import media as m
from reelbase.functions import parsers, paths, ranking, strings
from reelbase.operators import aggregates, changes, search, similarity
from reelbase.plans import sorting, spec
from reelbase.plans.spec import QuerySpec
from reelbase.queries import EXT, LIVE, NOW, PARENT, _PCT, _media, _order_sql
from reelbase.sources import files, sinks
from reelbase.tables import shared_folder, table

QUERIES, ORACLE = {}, {}


def q(name: str, sql: str | None = None):
    """Registers a query under a name, with its SQL if there is one."""

    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return keep


# ---- requests
_REQUEST = {
    "search": ["lantern"], "search_type": ["substring"], "min_size": ["1"], "max_duration": ["600"], "created": ["+2012-01-01,-2022-12-31"], "type": ["video", "audio"], "sort_fields": ['["size", "duration desc"]'], "sort_desc": ["size"],
    "unplayed": ["true"], "all": ["true"],
}
_LIKE = "({0} like '%lantern%')"
q("f40_request", f"""select media_id, path from media where {LIVE} and media_type in ('video', 'audio', 'audiobook') and size > 1000000 and duration < 36000 and time_created >= 1325376000 and time_created <= 1672444800
 and coalesce(play_count, 0) = 0 and coalesce(playhead, 0) = 0 and (coalesce(translate(path, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') like '%lantern%', false) or coalesce(translate(title, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') like '%lantern%', false)
 or coalesce(translate(path_tokenized, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') like '%lantern%', false))""")(
    lambda spark, d: spec.run(spec.from_parameters(_REQUEST), _media(spark, d)).select("media_id", "path")
)
q("t05_search_modes", f"select media_id, 'substring' as mode from media where {LIVE} and (contains(lower(path), 'lantern') or contains(lower(coalesce(title, '')), 'lantern') or contains(lower(coalesce(path_tokenized, '')), 'lantern')) union all select media_id, 'fts' from media where {LIVE} and (contains(lower(path), 'lan') or contains(lower(coalesce(path_tokenized, '')), 'lan') or contains(lower(coalesce(title, '')), 'lan') or contains(lower(coalesce(description, '')), 'lan'))")(
    lambda spark, d: changes.union_all([spec.run(QuerySpec(search=["lantern"], fts=on, limit=None), _media(spark, d)).select("media_id", F.lit(mode).alias("mode")) for mode, on in (("substring", False), ("fts", True))])
)
q("t01_operators", f"select media_id from media where {LIVE} and (" + " or ".join(f"contains(lower(coalesce({c}, '')), '{t}')" for c in ("path", "path_tokenized", "title", "description") for t in ("orc", "mee")) + ")")(
    lambda spark, d: spec.run(QuerySpec(search=["orchard or not meerkat"], fts=True, limit=None), _media(spark, d)).select("media_id")
)
q("t06_top", f"select media_id, cast(10 * t + 5 * p + d + case when t > 0 then 5 else 0 end as bigint) as score_rank from (select *, (length(lower(coalesce(title, ''))) - length(replace(lower(coalesce(title, '')), 'lantern', ''))) // 7 t, (length(lower(path)) - length(replace(lower(path), 'lantern', ''))) // 7 p, (length(lower(coalesce(description, ''))) - length(replace(lower(coalesce(description, '')), 'lantern', ''))) // 7 d from media where {LIVE} and (contains(lower(path), 'lan') or contains(lower(coalesce(path_tokenized, '')), 'lan') or contains(lower(coalesce(title, '')), 'lan') or contains(lower(coalesce(description, '')), 'lan'))) order by score_rank desc, path, media_id limit 25")(
    lambda spark, d: search.top_media(_media(spark, d), "lantern", 25).select("media_id", "score_rank")
)
q("t09_caption_rank", f"select c.caption_id, cast(10 * n + 5 * t + case when n > 0 then 5 else 0 end as bigint) as score_rank from (select *, (length(lower(text)) - length(replace(lower(text), 'harbour', ''))) // 7 n from captions where contains(lower(text), 'harbour')) c join (select path, (length(lower(coalesce(max(title), ''))) - length(replace(lower(coalesce(max(title), '')), 'harbour', ''))) // 7 t from media where {LIVE} group by path) m on c.media_path = m.path")(
    lambda spark, d: search.search_captions(table(spark, d, "captions"), _media(spark, d), "harbour").select("caption_id", "score_rank")
)
q("j03_captioned_media", f"select caption_id, title, media_type from captions join (select path, max(title) as title, max(media_type) as media_type from media where {LIVE} and media_type = 'video' group by path) on media_path = path where text <> ''")(
    lambda spark, d: search.captioned_media(table(spark, d, "captions"), _media(spark, d), ["video"]).select("caption_id", "title", "media_type")
)
q("f37_playable", "select media_id from media where starts_with(media_type, 'video') or starts_with(media_type, 'audio')")(lambda spark, d: _media(spark, d).where(spec.playable(F.col("media_type"))).select("media_id"))
q("f38_existing", "select media_id from media where path in (select media_path from captions)")(lambda spark, d: spec.existing(_media(spark, d), table(spark, d, "captions").select(F.col("media_path").alias("path"))).select("media_id"))
q("f39_named", "select 'unfinished' as query, media_id from media where time_deleted = 0 and playhead > 0 and playhead < 0.95 * duration union all select 'by_size', media_id from media where time_deleted = 0 and size between 1000000 and 50000000 union all select 'by_type', media_id from media where time_deleted = 0 and media_type = 'audio'")(
    lambda spark, d: changes.union_all([
        spec.named(_media(spark, d), name, **values).select(F.lit(name).alias("query"), "media_id") for name, values in (("unfinished", {}), ("by_size", {"low": 1_000_000, "high": 50_000_000}), ("by_type", {"value": "audio"}))
    ])
)


@q("f36_bindings", "select id from playlists where (path like '%o%' or title like '%o%') and coalesce(path, '') not like '%local%' and coalesce(title, '') not like '%local%'")
def _(spark, d):
    condition, values = spec.bindings(["o"], ["local"], ["path", "title"])
    return spark.sql(f"select id from {{lists}} where {condition}", args=values, lists=table(spark, d, "playlists"))


_P2 = f"with p as ({_PCT.format(c='size', w=LIVE)}), m as (select * from media where {LIVE} and size between (select value from p where pct = 10) and (select value from p where pct = 60)), "
q("f32_percentile_spec", _P2 + f"f as (select {PARENT} as folder, count(*) as n from m group by 1), e as ({_PCT.format(c='n', w='true').replace('from media where', 'from f where')}) select media_id from m where {PARENT} in (select folder from f where n between (select value from e where pct = 20) and (select value from e where pct = 90))")(
    lambda spark, d: spec.run(QuerySpec(size=["p10-60"], file_counts="p20-90", limit=None), _media(spark, d)).select("media_id")
)

# ---- orders
_BIG = "coalesce(video_count, 0) desc, coalesce(audio_count, 0) desc"
q("o05_dispatch", "select * from (values (0, 'random', ''), (1, 'basic', 'path'), (2, 'basic', 'size'), (3, 'basic', 'reverse_duration'), (4, 'advanced', 'default'), (5, 'advanced', 'reverse_default'), (6, 'advanced', 'natural_ps'), (7, 'basic', 'reverse_path'), (8, 'basic', 'natural_path'), (9, 'advanced', 'default')) v(k, kind, config)")(
    lambda spark, d: spark.createDataFrame([(k, *sorting.choose(**o)) for k, o in enumerate((
        {"shuffled": True, "sort_by": "size"}, {"no_play_in_order": True}, {"sort_by": "size", "play_in_order": "natural_ps"}, {"sort_by": "duration", "reverse": True}, {"sort_by": "default", "play_in_order": "natural_ps"},
        {"sort_by": "default", "reverse": True}, {"play_in_order": "natural_ps", "natural_sort": True}, {"sort_by": "path", "reverse": True}, {"natural_sort": True}, {},
    ))], "k int, kind string, config string")
)
q("o09_markers", "with r as (select *, row_number() over (order by coalesce(size, 0) desc, media_id) a, row_number() over (order by coalesce(duration, 0), media_id) b, (select greatest(count(*) - 1, 1) from media) t from media) select media_id, row_number() over (order by coalesce(audio_count, 0) desc, round((1 - (a - 1) / t) + (1 - (b - 1) / t) / 2, 9) desc, coalesce(width, 0), path, media_id) as rn from r")(
    lambda spark, d: sorting.arrange(_media(spark, d).select("media_id", "path", "width", "size", "duration", "audio_count"), "width,_weighted_rerank,-size,duration,_natural_order,-audio_count")
)
q("o15_history_orders", """with h as (select media_id, coalesce(playhead, 0) as p, coalesce(duration, 0) as d, coalesce(time_first_played, 0) as f, case when coalesce(time_last_played, 0) <> 0 then time_last_played else coalesce(time_first_played, 0) end as l from media)
 select media_id, row_number() over (order by f, media_id) as first_played, row_number() over (order by l desc, media_id) as last_played, row_number() over (order by case when p > 0 and d > 0 then cast(p as double) / d else -1.7976931348623157e308 end desc, media_id) as progress,
 row_number() over (order by case when p > 0 and d > 0 then -cast(d - p as double) else -1.7976931348623157e308 end desc, media_id) as time_left, row_number() over (order by case when p > 0 and d > 0 then cast(d as double) / p * -cast(d - p as double) else -1.7976931348623157e308 end desc, media_id) as both from h""")(
    lambda spark, d: _history_ranks(spark, d)
)
q("o17_simple", _order_sql("coalesce(play_count, 0) desc, path, media_id"))(lambda spark, d: ranking.number(_media(spark, d), [*sorting.simple_order("play_count", True), F.col("media_id").asc()], keep=["media_id"]))
q("o10_du", _order_sql("coalesce(size, 0) desc, path desc, media_id").replace("from media", "from (select *, 1 as count, 0 as folders from media)"))(
    lambda spark, d: ranking.number(_media(spark, d).select("media_id", "path", "size", F.lit(1).alias("count"), F.lit(0).alias("folders")), [*sorting.order("du"), F.col("media_id").asc()], keep=["media_id"])
)
q("o03_page_of_all", f"select media_id, db from media where {LIVE} and db in ('main.db', 'nas.db') order by coalesce(size, 0) desc, path, media_id limit 40 offset 10")(
    lambda spark, d: spec.run(QuerySpec(dbs=["main.db", "nas.db"], limit=None), _media(spark, d)).orderBy(F.coalesce("size", F.lit(0)).desc(), "path", "media_id").offset(10).limit(40).select("media_id", "db")
)


def _history_ranks(spark: SparkSession, d: str) -> DataFrame:
    rows, out = _media(spark, d).select("media_id", "playhead", "duration", "time_first_played", "time_last_played"), None
    for name, partial, down in (("first_played", "f", False), ("last_played", "", True), ("progress", "p", True), ("time_left", "t", True), ("both", "pt", True)):
        ranked = ranking.number(rows, [sorting.history_order(partial, down), F.col("media_id").asc()], name, ["media_id"])
        out = ranked if out is None else out.join(ranked, "media_id")
    return out


# ---- roll-ups
_SHOWN = f"with m as (select *, {PARENT} as folder from media where {LIVE}), big as (select * from m where size >= 5000000), long as (select * from m where duration >= 600) "
q("a20_own_dimension", _SHOWN + "select 'size' as dim, min(size) as low, max(size) as high from long where size < 109951162777600 union all select 'duration', min(duration), max(duration) from big where duration > 0 and duration < 2678400 union all select 'time_modified', min(time_modified), max(time_modified) from big where duration >= 600 union all select 'time_created', min(time_created), max(time_created) from big where duration >= 600 union all select 'time_downloaded', min(time_downloaded), max(time_downloaded) from big where duration >= 600 union all select 'episodes', min(c), max(c) from (select count(*) as c from big where duration >= 600 group by folder)")(
    lambda spark, d: aggregates.bins(aggregates.live(_media(spark, d)), {"size": F.col("size") >= 5_000_000, "duration": F.col("duration") >= 600}).select("dim", "low", "high")
)
q("a24_parent_counts", f"select {PARENT} as folder, count(*) as n from media where {LIVE} group by 1")(lambda spark, d: aggregates.parent_counts(aggregates.live(_media(spark, d))))
q("a30_last_tracks", "select playlist_id, coalesce(max(track_number), 0) as last_track from playlist_items group by 1")(lambda spark, d: aggregates.last_tracks(table(spark, d, "playlist_items")))
q("a23_interpolated", "select media_type, round(quantile_cont(size, 0.9), 3) as p90 from media where media_type is not null and size is not null group by 1")(
    lambda spark, d: aggregates.interpolated(_media(spark, d).where("media_type is not null"), ["media_type"], "size", 90, "p90").select("media_type", F.round("p90", 3).alias("p90"))
)
q("a34_by_mode", f"select 'extensions' as mode, count(*) as n from (select distinct {EXT} from media) union all select 'depth', count(*) from (select distinct '/' || array_to_string(list_filter(str_split(path, '/'), lambda x: x <> '')[:2], '/') from media) union all select '', count(*) from (select distinct {PARENT} from media)")(
    lambda spark, d: changes.union_all([aggregates.by_mode(_media(spark, d), mode, 2).agg(F.lit(mode).alias("mode"), F.count("*").alias("n")) for mode in ("extensions", "depth", "")])
)


@q("a32_query_times")
def _(spark, d):
    _media(spark, d).count()
    return aggregates.query_times(spark)


# ---- edits
_WHICH = "coalesce(regexp_matches(path, '/series_00[0-4]/'), false)"
_on = lambda: F.col("path").rlike("/series_00[0-4]/")
q("u09_restored", f"select media_id, case when {_WHICH} then 0 else time_deleted end as time_deleted from media")(lambda spark, d: changes.restore(_media(spark, d), _on()).select("media_id", "time_deleted"))
q("u09_bin_emptied", "with k as (select * from media where not coalesce(time_deleted > 0, false)) select 'media' as t, media_id as id from k union all select 'captions', caption_id from captions where media_path is null or not (media_path in (select path from media where time_deleted > 0) and media_path not in (select path from k))")(
    lambda spark, d: _emptied(spark, d)
)
q("u10_mark_played", f"select media_id, case when {_WHICH} then {NOW} else time_last_played end as time_last_played, case when {_WHICH} then coalesce(time_first_played, {NOW}) else time_first_played end as time_first_played, case when {_WHICH} then coalesce(play_count, 0) + 1 else play_count end as play_count, case when {_WHICH} then 0 else playhead end as playhead from media")(
    lambda spark, d: changes.mark_played(_media(spark, d), _on(), NOW).select("media_id", "time_last_played", "time_first_played", "play_count", "playhead")
)
q("u10_mark_unplayed", f"select media_id, case when {_WHICH} then 0 else time_last_played end as time_last_played, case when {_WHICH} then 0 else play_count end as play_count, case when {_WHICH} then 0 else playhead end as playhead from media")(
    lambda spark, d: changes.mark_unplayed(_media(spark, d), _on()).select("media_id", "time_last_played", "play_count", "playhead")
)
q("u10_rated", f"select media_id, case when {_WHICH} then 4.5 else score end as score from media")(lambda spark, d: changes.rated(_media(spark, d), _on(), 4.5).select("media_id", "score"))
q("u11_created", "select id, path, case when path = (select min(path) from playlists) then 'New name' else title end as title from playlists union all select (select max(id) + 1 from playlists), '/new/list', 'Added'")(
    lambda spark, d: _created(spark, d)
)
q("u11_deleted", f"select id, case when id = 2 then {NOW} else time_deleted end as time_deleted from playlists")(lambda spark, d: changes.playlist_deleted(table(spark, d, "playlists"), 2, NOW).select("id", "time_deleted"))
q("u11_added", f"with n as (select 3 as playlist_id, path as media_path, min(media_id) as track_number from media where coalesce(regexp_matches(path, '/series_00[0-4]/'), false) group by path), o as (select * from playlist_items) select coalesce(o.playlist_id, n.playlist_id) as playlist_id, coalesce(o.media_path, n.media_path) as media_path, case when n.media_path is not null then n.track_number else o.track_number end as track_number, case when o.media_path is null then {NOW} else o.time_added end as time_added from o full join n on o.playlist_id = n.playlist_id and o.media_path = n.media_path where o.media_path is null or o.time_added is not null or n.media_path is null")(
    lambda spark, d: _added(spark, d)
)
q("u11_removed", "select playlist_id, media_path from playlist_items where playlist_id is distinct from 3")(lambda spark, d: changes.items_removed(table(spark, d, "playlist_items"), 3).select("playlist_id", "media_path"))
q("u12_keywords", "select category, keyword from custom_keywords where category is distinct from (select min(category) from custom_keywords) union all select 'added', 'keyword'")(lambda spark, d: _keywords_edited(spark, d))
q("u12_category", "select media_id, replace(categories, ';fitness;', ';sport;') as categories from media")(lambda spark, d: changes.renamed_category(_media(spark, d), "fitness", "sport").select("media_id", "categories"))
q("u03_appended", "with a as (select path, min(media_id) as media_id from media where db = 'main.db' group by path), b as (select path, min(media_id) as media_id from media where db <> 'main.db' group by path) select * from a union all select * from b where path not in (select path from a)")(
    lambda spark, d: changes.appended(*[_media(spark, d).where(w).groupBy("path").agg(F.min("media_id").alias("media_id")) for w in ("db = 'main.db'", "db <> 'main.db'")])
)


def _emptied(spark: SparkSession, d: str) -> DataFrame:
    kept, captions = changes.bin_emptied(_media(spark, d), table(spark, d, "captions"))
    return kept.select(F.lit("media").alias("t"), F.col("media_id").alias("id")).unionByName(captions.select(F.lit("captions").alias("t"), F.col("caption_id").alias("id")))


def _created(spark: SparkSession, d: str) -> DataFrame:
    lists = table(spark, d, "playlists")
    first = lists.agg(F.min("path")).collect()[0][0]
    return changes.playlist_created(changes.playlist_created(lists, first, "New name"), "/new/list", "Added").select("id", "path", "title")


def _added(spark: SparkSession, d: str) -> DataFrame:
    new = _media(spark, d).where(_on()).groupBy(F.col("path").alias("media_path")).agg(F.min("media_id").alias("track_number")).withColumn("playlist_id", F.lit(3).cast("bigint"))
    return changes.items_added(table(spark, d, "playlist_items"), new, NOW).select("playlist_id", "media_path", "track_number", "time_added")


def _keywords_edited(spark: SparkSession, d: str) -> DataFrame:
    keywords = table(spark, d, "custom_keywords")
    first = keywords.agg(F.min("category")).collect()[0][0]
    new = spark.createDataFrame([("added", "keyword"), ("added", "keyword")], "category string, keyword string")
    return changes.keywords_added(changes.keywords_removed(keywords, first), new.unionByName(keywords.where(F.col("category") != first).limit(2).select("category", "keyword")))


# ---- duplicates
q("d02_cascade", f"with l as (select * from media where size > 0 and {LIVE} and fasthash <> '' and sha256 <> ''), k as (select *, count(*) over w as n, first_value(media_id) over (partition by size, fasthash, sha256 order by coalesce(is_deduped, 0) desc, path, media_id) as keep_id from l window w as (partition by size, fasthash, sha256)) select keep_id, media_id as dup_id, size from k where n > 1 and media_id <> keep_id")(
    lambda spark, d: similarity.content_cascade(_media(spark, d))
)
_G = "list_distinct(list_transform(range(1, greatest(length({x}), 2)), lambda i: substr({x}, i, 2)))"
_DICE = "2.0 * len(list_intersect(gx, gy)) / (len(gx) + len(gy))"


def _dice_sql(a: str, b: str, rows: str, keep: str) -> str:
    return f"select *, {_DICE} as dice from (select *, {_G.format(x='x')} as gx, {_G.format(x='y')} as gy from (select {keep}, regexp_replace({a}, '\\s', '', 'g') as x, regexp_replace({b}, '\\s', '', 'g') as y from {rows}))"


_STEM = "regexp_replace(regexp_extract(regexp_replace(path, '/+', '/', 'g'), '([^/]*)$', 1), '\\.[^.]*$', '')"
ORACLE["d03_dice"] = f"select media_id, round(dice, 6) as dice from ({_dice_sql('lower(title)', f'lower({_STEM})', 'media where title is not null', 'media_id')})"
q("d03_filtered", f"""with l as (select *, row_number() over (partition by title, artist order by coalesce(is_deduped, 0) desc, coalesce(size, -1) desc, coalesce(time_modified, -1) desc, media_id) k from media where {LIVE} and title <> '' and artist <> ''),
 f as (select title, artist, media_id as keep_id, path as keep_path, coalesce(duration, 0) as kd from l where k = 1), d as (select f.keep_id, l.media_id as dup_id, f.keep_path, l.path as dup_path from l join f using (title, artist) where l.k > 1 and abs(coalesce(l.duration, 0) - kd) <= 8 and l.path <> f.keep_path),
 s as ({_dice_sql("regexp_extract(keep_path, '([^/]*)$', 1)", "regexp_extract(dup_path, '([^/]*)$', 1)", 'd', '*')}), n as (select *, row_number() over (partition by dup_path order by keep_id, dup_id) r from s where dice >= 0.5) select keep_id, dup_id from n where r = 1""")(
    lambda spark, d: similarity.filtered_pairs(similarity.duplicates(_media(spark, d), ["title", "artist"]).select("keep_id", "dup_id"), _media(spark, d), basename=True, ratio=0.5, existing=_media(spark, d)).select("keep_id", "dup_id")
)


@q("d06_folders")
def _(spark, d):
    by_name, columns = similarity.similar_columns(True)
    stats = aggregates.by_parent(_media(spark, d)).withColumnRenamed("n_exists", "file_count")
    return similarity.similar_folders(stats, columns, names=by_name)


q("d10a_defaults", "select * from (values (true, 'file_count,median_size'), (false, 'size,duration')) v(folders, compared)")(
    lambda spark, d: spark.createDataFrame([(on, ",".join(similarity.similar_columns(on)[1])) for on in (True, False)], "folders boolean, compared string")
)

# ---- functions, files, printed tables
q("t14_quoted", "select * from (values ('lantern', '\"lantern\"'), ('a AND b', 'a AND b'), ('lan*', 'lan*'), ('title:x', 'title:x')) v(term, quoted)")(
    lambda spark, d: spark.createDataFrame([(t, parsers.fts_quoted([t])[0]) for t in ("lantern", "a AND b", "lan*", "title:x")], "term string, quoted string")
)
q("s27_arguments", "select * from (values ('db', 'a.db'), ('path', '/m'), ('path', '/x'), ('db', 'b.db')) v(kind, value)")(
    lambda spark, d: spark.createDataFrame([(k, v) for k, vs in zip(("db", "path"), parsers.databases_and_paths(["a.db", "/m", "-"], ["/x", " b.db ", ""])) for v in vs], "kind string, value string")
)
_HMS = "case when abs({d}) >= 3600 then printf('%d:%02d:%02d', abs({d}) // 3600, abs({d}) % 3600 // 60, abs({d}) % 60) else printf('%d:%02d', abs({d}) // 60, abs({d}) % 60) end"
q("m02_playback", f"select media_id, case when coalesce(playhead, 0) = 0 then 'Duration: ' || {_HMS.format(d='dd')} else 'Duration: ' || {_HMS.format(d='part')} || ' (' || {_HMS.format(d='p')} || ' to ' || {_HMS.format(d='e')} || ')' end as shown from (select *, case when p > dd then dd else dd - p end as part, case when p > dd then p + dd else dd end as e from (select media_id, playhead, coalesce(duration, 0) as dd, coalesce(playhead, 0) as p from media))")(
    lambda spark, d: _media(spark, d).select("media_id", m.playback_duration(F.col("duration"), F.col("playhead"), F.lit(None).cast("bigint")).alias("shown"))
)
_T = "(to_timestamp(time_played) at time zone 'UTC')"
q("m02_relative", f"select id, case when coalesce(time_played, 0) = 0 then '-' when {NOW} - time_played < 86400 and {NOW} > time_played and day({_T}) = 1 then strftime({_T}, 'today, %H:%M') when {NOW} > time_played and {NOW} - time_played < 172800 and day({_T}) = 31 then strftime({_T}, 'yesterday, %H:%M') when {NOW} > time_played and {NOW} - time_played < 3888000 then greatest(({NOW} - time_played) // 86400, 1) || strftime({_T}, ' days ago, %H:%M') else strftime({_T}, '%Y-%m-%d %H:%M') end as seen from history")(
    lambda spark, d: table(spark, d, "history").select("id", m.relative_time(F.col("time_played"), NOW).alias("seen"))
)
q("s19_lines", "select media_id, coalesce(path, '') || chr(9) || coalesce(play_count, 0) || chr(9) || case when coalesce(time_last_played, 0) = 0 then '-' else strftime(to_timestamp(time_last_played) at time zone 'UTC', '%Y-%m-%d %H:%M') end as line from media")(
    lambda spark, d: sinks.lines(_media(spark, d), ("path", "play_count", "time_last_played"), "media_id")
)


@q("s16_bulk_upsert", "with o as (select path, max(size) as size, max(play_count) as play_count, max(time_deleted) as time_deleted from media where db in ('main.db', 'laptop.db') group by path), n as (select path, max(size) as size, max(play_count) as play_count, max(time_deleted) as time_deleted from media where db not in ('laptop.db') group by path) select coalesce(o.path, n.path) as path, case when n.path is not null then n.size else o.size end as size, case when o.path is not null then o.play_count else n.play_count end as play_count, case when n.path is not null then 0 else o.time_deleted end as time_deleted from o full join n on o.path = n.path")
def _(spark, d):
    folder = f"{shared_folder(spark)}/media"
    one = lambda w: _media(spark, d).where(w).groupBy("path").agg(*[F.max(c).alias(c) for c in ("size", "play_count", "time_deleted")])
    sinks.write_media(one("db in ('main.db', 'laptop.db')"), folder)
    return spark.read.parquet(sinks.write_media(one("db not in ('laptop.db')"), folder)).select("path", "size", "play_count", "time_deleted")


@q("s17_bulk_captions", "select media_path, time, text from captions where trim(text) <> '' union all select media_path, time, text from captions where trim(text) <> ''")
def _(spark, d):
    folder = f"{shared_folder(spark)}/captions"
    for _ in range(2):
        sinks.append_captions(table(spark, d, "captions"), folder)
    return spark.read.parquet(folder)


q("m01_segments", "select * from (values (0, 0), (0, 12), (0, 24), (0, 36), (0, 48), (0, 60), (0, 72), (0, 84), (0, 98)) v(unused, start)".replace("unused, ", "k, "))(
    lambda spark, d: spark.createDataFrame([(0, s) for s in files.segments(100, 2, 0.1)], "k int, start int")
)

# ---- SQL for queries registered with the others
_NATURAL = "list_transform(regexp_extract_all(path, '[0-9]+|[^0-9]+'), lambda x: case when regexp_matches(x, '^[0-9]+$') then struct_pack(k := 0, n := cast(x as decimal(38, 0)), s := '') else struct_pack(k := 1, n := cast(0 as decimal(38, 0)), s := lower(x)) end)"
ORACLE["o07_natural"] = _order_sql(f"{_NATURAL}, path, media_id")
_IDF = "ln(1 + (total - df{k} + 0.5) / (df{k} + 0.5)) * n{k} * 2.2 / (n{k} + 1.2)"
ORACLE["t06_bm25"] = f"""with l as (select media_id, lower(concat_ws(' ', path, title, description)) as low from media where {LIVE}), c as (select media_id, (length(low) - length(replace(low, 'harbour', ''))) // 7 as n1, (length(low) - length(replace(low, 'lantern', ''))) // 7 as n2 from l),
 s as (select count(*) as total, count(*) filter (n1 > 0) as df1, count(*) filter (n2 > 0) as df2 from c) select media_id, round({_IDF.format(k=1)} + {_IDF.format(k=2)}, 6) as bm25 from c, s where n1 + n2 > 0"""

# ---- more functions of paths and numbers
_MIMES = "case ltrim({e}, '.') when 'pdf' then 'application/pdf' when 'epub' then 'application/epub+zip' when 'mobi' then 'application/x-mobipocket-ebook' when 'azw' then 'application/vnd.amazon.ebook' when 'azw3' then 'application/vnd.amazon.ebook' when 'fb2' then 'application/x-fictionbook' when 'cbz' then 'application/vnd.comicbook+zip' when 'cbr' then 'application/vnd.comicbook-rar' when 'txt' then 'text/plain' when 'html' then 'text/html' when 'htm' then 'text/html' when 'jpg' then 'image/jpeg' when 'jpeg' then 'image/jpeg' when 'png' then 'image/png' when 'gif' then 'image/gif' when 'webp' then 'image/webp' when 'bmp' then 'image/bmp' when 'svg' then 'image/svg+xml' when 'tiff' then 'image/tiff' when 'tif' then 'image/tiff' when 'djvu' then 'image/vnd.djvu' when 'djv' then 'image/vnd.djvu' when 'mp3' then 'audio/mpeg' when 'flac' then 'audio/flac' when 'ogg' then 'audio/ogg' when 'wav' then 'audio/wav' when 'opus' then 'audio/opus' when 'aac' then 'audio/aac' when 'mp4' then 'video/mp4' when 'm4v' then 'video/mp4' when 'm4a' then 'video/mp4' when 'webm' then 'video/webm' when 'mkv' then 'video/x-matroska' when 'avi' then 'video/x-msvideo' when 'mov' then 'video/quicktime' when 'wmv' then 'video/x-ms-wmv' when 'json' then 'application/json' when 'xml' then 'application/xml' when 'js' then 'application/javascript' when 'css' then 'text/css' when 'ico' then 'image/x-icon' when 'apk' then 'application/vnd.android.package-archive' when 'zim' then 'application/x-zim' else 'application/octet-stream' end"
q("x15_mime", f"select media_id, {_MIMES.format(e=EXT)} as mime from media")(lambda spark, d: _media(spark, d).select("media_id", paths.mime_type(F.col("path")).alias("mime")))
q("x14_paths", "select media_id, regexp_replace(path, '^/+', '') as bare, '/safe/' || array_to_string(list_filter(str_split(path, '/'), lambda x: x <> ''), '/') as below from media")(
    lambda spark, d: _media(spark, d).select("media_id", paths.without_mount(F.col("path")).alias("bare"), paths.joined("/safe", F.concat(F.lit("x/.././"), F.col("path"))).alias("below"))
)
q("x04_parts", "select media_id, list_transform(str_split(genre, ';'), lambda x: trim(x)) as parts, list_extract(str_split(path, '.'), -1) as last from media")(
    lambda spark, d: _media(spark, d).select("media_id", strings.split_trimmed(F.col("genre"), ";").alias("parts"), strings.last_part(F.col("path")).alias("last"))
)
q("x08_glob_all", "select media_id from media where regexp_matches(path, '^/srv/media/[^/]*/[^/]*/[^/]*$') and regexp_matches(path, '^/[^/]*/[^/]*/shows/[^/]*/[^/]*$')")(
    lambda spark, d: _media(spark, d).where(strings.glob_all(F.col("path"), ["/srv/media/*/*/*", "/*/*/shows/*/*"])).select("media_id")
)
