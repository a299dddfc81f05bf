"""The core's queries over the catalogue tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelbase.functions import media as m
from reelbase.functions import more, parsers, paths, ranking, strings
from reelbase.operators import aggregates, changes, search, similarity, textsort
from reelbase.plans import sorting, spec
from reelbase.plans.spec import QuerySpec
from reelbase.sources import files
from reelbase.streaming import history
from reelbase.tables import shared_folder, table

NOW = 1735689600
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

# SQL for the oracle engine.
P = r"regexp_replace(replace(path, '\', '/'), '/+', '/', 'g')"
PARENT = f"case when instr({P}, '/') = 0 then '.' when regexp_matches({P}, '^/[^/]*$') then '/' else regexp_replace({P}, '/[^/]*$', '') end"
EXT = r"lower(regexp_extract(path, '(\.[^./]*)$', 1))"
LIVE = "coalesce(time_deleted, 0) = 0"
LOW = "translate(%s, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
MEASURES = f"""count(*) as n, count(*) filter ({LIVE}) as n_exists, count(*) filter (not {LIVE}) as n_deleted, count(*) filter (coalesce(play_count, 0) > 0) as n_played,
 cast(coalesce(sum(size) filter ({LIVE}), 0) as bigint) as total_size, cast(coalesce(sum(duration) filter ({LIVE}), 0) as bigint) as total_duration,
 cast(floor(avg(size) filter ({LIVE})) as bigint) as avg_size, cast(trunc(quantile_cont(size, 0.5) filter ({LIVE})) as bigint) as median_size"""
SUMS = "count(*) as n, cast(coalesce(sum(size), 0) as bigint) as total_size, cast(coalesce(sum(duration), 0) as bigint) as total_duration"


def q(name: str, sql: str | None = None):
    """Registers a query under a name, with its SQL if there is one."""

    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return keep


def _media(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "media")


# ---- filters: what the query language can say, against the same condition in SQL
FILTERS: dict[str, tuple[QuerySpec, str]] = {
    "f01_hide_deleted": (QuerySpec(), LIVE),
    "f01_only_deleted": (QuerySpec(only_deleted=True), "coalesce(time_deleted, 0) > 0"),
    "f02_types": (QuerySpec(types=["audio", "image"]), f"{LIVE} and media_type in ('audio', 'audiobook', 'image')"),
    "f03_genre": (QuerySpec(genre="Drama"), f"{LIVE} and genre = 'Drama'"),
    "f04_language": (QuerySpec(language=["en", "English"]), f"{LIVE} and language in ('en', 'English')"),
    "f05_paths": (QuerySpec(paths=["/srv/media/SHOWS/%"]), f"{LIVE} and {LOW % 'path'} like '/srv/media/shows/%'"),
    "f06_play_count": (QuerySpec(play_count_min=2, play_count_max=40), f"{LIVE} and play_count >= 2 and play_count <= 40"),
    "f07_size": (QuerySpec(size=[">1MB", "<50MB", "nonsense"]), f"{LIVE} and size >= 1000001 and size <= 49999999"),
    "f07_size_percent": (QuerySpec(size=["40MB%25"]), f"{LIVE} and size between 30000000 and 50000000"),
    "f08_duration": (QuerySpec(duration=["5min-2h"]), f"{LIVE} and duration between 300 and 7200"),
    "f09_times": (QuerySpec(after={"created": "2015-01-01"}, before={"created": "2019-12-31 23:59", "modified": "1609459200"}), f"{LIVE} and time_created >= 1420070400 and time_created <= 1577836740 and time_modified <= 1609459200"),
    "f10_watched": (QuerySpec(watched=True), f"{LIVE} and time_last_played > 0"),
    "f10_unwatched": (QuerySpec(watched=False), f"{LIVE} and coalesce(time_last_played, 0) = 0"),
    "f11_unfinished": (QuerySpec(unfinished=True), f"{LIVE} and coalesce(playhead, 0) > 0"),
    "f12_partial": (QuerySpec(partial="s"), f"{LIVE} and coalesce(time_first_played, 0) = 0"),
    "f13_completed": (QuerySpec(completed=True), f"{LIVE} and coalesce(play_count, 0) > 0"),
    "f14_local": (QuerySpec(local=True), f"{LIVE} and lower(path[:4]) <> 'http'"),
    "f15_ext": (QuerySpec(ext=["mkv", ".MP4"], strict=True), f"{LIVE} and {EXT} in ('.mkv', '.mp4')"),
    "f16_category": (QuerySpec(category=["fitness", "Uncategorized"]), f"{LIVE} and (contains(categories, ';fitness;') or categories is null or categories = '')"),
    "f17_path_search": (QuerySpec(search=["./shows", "/series_00"]), f"{LIVE} and {LOW % 'path'} like '%shows%' and {LOW % 'path'} like '%/series\\_00%' escape '\\'"),
    "f18_substring": (QuerySpec(search=["engine", "shows"]), f"{LIVE} and (coalesce({LOW % 'path'} like '%engine%', false) or coalesce({LOW % 'title'} like '%engine%', false) or coalesce({LOW % 'path_tokenized'} like '%engine%', false)) and (coalesce({LOW % 'path'} like '%shows%', false) or coalesce({LOW % 'title'} like '%shows%', false) or coalesce({LOW % 'path_tokenized'} like '%shows%', false))"),
    "f18_flexible": (QuerySpec(search=["lantern", "orchard"], flexible=True), f"{LIVE} and ({LOW % 'path'} like '%lantern%' or coalesce({LOW % 'title'} like '%lantern%', false) or coalesce({LOW % 'path_tokenized'} like '%lantern%', false) or {LOW % 'path'} like '%orchard%' or coalesce({LOW % 'title'} like '%orchard%', false) or coalesce({LOW % 'path_tokenized'} like '%orchard%', false))"),
    "f19_exact": (QuerySpec(search=["continuous_log"], exact=True), f"{LIVE} and regexp_matches({LOW % 'path'}, '/continuous.log(\\..*)?$')"),
    "f20_exclude": (QuerySpec(exclude=["scans", "the"]), f"{LIVE} and not {LOW % 'path'} like '%scans%' and not {LOW % 'title'} like '%scans%' and not {LOW % 'path'} like '%the%' and not {LOW % 'title'} like '%the%'"),
    "f21_regex": (QuerySpec(regex=r"series_0\d[13579]/"), f"{LIVE} and regexp_matches(path, 'series_0\\d[13579]/')"),
    "f22_path_contains": (QuerySpec(path_contains=["music"], strict=True), f"{LIVE} and contains(path, 'music')"),
    "f23_portrait": (QuerySpec(portrait=True), f"{LIVE} and width < height"),
    "f25_where": (QuerySpec(where=["fps > 24", "audio_count >= 1"]), f"{LIVE} and fps > 24 and audio_count >= 1"),
    "f28_include": (QuerySpec(include=["/SRV/media/music", "/lib/*/café_*"], strict=True), f"{LIVE} and (starts_with(lower(path), '/srv/media/music') or regexp_matches(path, '^/lib/[^/]*/café_[^/]*$'))"),
    "f33_rating": (QuerySpec(ratings=[0, 5], score_max=5), f"{LIVE} and (score is null or score = 0 or score = 5) and score <= 5"),
    "f41_dbs": (QuerySpec(dbs=["main.db", "nas.db"]), f"{LIVE} and db in ('main.db', 'nas.db')"),
    "t02_fts_loose": (QuerySpec(search=["lantern orchard"], fts=True), f"{LIVE} and ({' or '.join(f'''contains(lower(coalesce({c}, '')), '{t}')''' for t in ('lan', 'orc') for c in spec.INDEXED)})"),
    "t03_fts_exact": (QuerySpec(search=["harbour paper"], fts=True, exact=True), f"{LIVE} and {' and '.join('(' + ' or '.join(f'''contains(lower(coalesce({c}, '')), '{t}')''' for c in spec.INDEXED) + ')' for t in ('harbour', 'paper'))}"),
    "t04_fts_phrase": (QuerySpec(search=['story "old cinema"'], fts=True), f"{LIVE} and ({' or '.join(f'''contains(lower(coalesce({c}, '')), 'sto')''' for c in spec.INDEXED)}) and ({LOW % 'path'} like '%old%cinema%' or {LOW % 'title'} like '%old%cinema%' or {LOW % 'description'} like '%old%cinema%')"),
}


def _filter(s: QuerySpec):
    return lambda spark, d: _media(spark, d).where(spec.predicate(s)).select("media_id", "path")


for _name, (_spec, _where) in FILTERS.items():
    q(_name, f"select media_id, path from media where {_where}")(_filter(_spec))


@q("f24_with_captions", f"select media_id, path from media where {LIVE} and path in (select media_path from captions)")
def _(spark, d):
    return spec.run(QuerySpec(with_captions=True, limit=None), _media(spark, d), table(spark, d, "captions")).select("media_id", "path")


@q("f26_duration_from_size", f"select media_id, duration from media where {LIVE} and duration in (select duration from media where size >= 90000001)")
def _(spark, d):
    return spec.run(QuerySpec(duration_from_size=[">90MB"], limit=None), _media(spark, d)).select("media_id", "duration")


@q("f31_file_counts", f"with a as (select *, {PARENT} as f from media where {LIVE}) select media_id, path from a where f in (select f from a group by f having count(*) between 2 and 20)")
def _(spark, d):
    return spec.run(QuerySpec(file_counts="2-20", limit=None), _media(spark, d)).select("media_id", "path")


@q("f34_search_table", "select id, title from playlists where translate(coalesce(path,'') || chr(1) || coalesce(title,'') || chr(1) || coalesce(extractor_key,'') || chr(1) || coalesce(extractor_config,''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') like '%local%' and not translate(coalesce(path,'') || chr(1) || coalesce(title,'') || chr(1) || coalesce(extractor_key,'') || chr(1) || coalesce(extractor_config,''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') like '%recursive%'")
def _(spark, d):
    return search.search_table(table(spark, d, "playlists"), ["Local"], ["recursive"]).select("id", "title")


_PCT = """with b as (select {c} as v from media where {w} and {c} is not null), freq as (select v, count(*) c from b group by v),
 t as (select sum(c) n, count(*) d from freq), s as (select v, c / n f, 1.0::double / d u from freq, t),
 l as (select least(1, greatest(0, coalesce(min((0.05 - u) / (f - u)) filter (f > 0.05 and f > u), 1))) lam from s),
 cum as (select v, sum(lam * f + (1 - lam) * u) over (order by v) + 1e-12 c from s, l),
 r as (select i, coalesce((select min(v) from cum where cum.c >= i / 100), (select max(v) from cum)) value from range(101) x(i))
 select cast(i as integer) as pct, value from r"""


@q("f32_percentile_filter", f"with p as ({_PCT.format(c='size', w=LIVE)}) select media_id, size from media where {LIVE} and size between (select value from p where pct = 10) and (select value from p where pct = 50)")
def _(spark, d):
    live = aggregates.live(_media(spark, d))
    lo, hi = parsers.parse_percentiles("p10-50")
    p = aggregates.percentiles(live, "size").where(F.col("pct").isin(int(lo), int(hi))).agg(F.min("value").alias("__lo"), F.max("value").alias("__hi"))
    return live.crossJoin(F.broadcast(p)).where("size between __lo and __hi").select("media_id", "size")


# ---- scans, projections, sources
@q("s01_scan_all_dbs", "select db, count(*) as n, count(distinct path) as n_paths from media group by db")
def _(spark, d):
    return _media(spark, d).groupBy("db").agg(F.count("*").alias("n"), F.count_distinct("path").alias("n_paths"))


@q("s03_raw_sql", "select media_type, max(size) as largest from media group by media_type")
def _(spark, d):
    return spark.sql("select media_type, max(size) as largest from {media} group by media_type", media=_media(spark, d))


@q("s04_projection", "select media_id, path, title, size, duration, time_created, time_modified from media")
def _(spark, d):
    return _media(spark, d).select("media_id", "path", "title", "size", "duration", "time_created", "time_modified")


@q("s05_by_path", "select media_id, title from media where path = '/srv/media/live/quay_cam/continuous_log.mkv'")
def _(spark, d):
    return _media(spark, d).where(F.col("path") == "/srv/media/live/quay_cam/continuous_log.mkv").select("media_id", "title")


@q("s15_columns")
def _(spark, d):
    media = _media(spark, d)
    return spark.createDataFrame([(k, c, kind) for k, (c, kind) in enumerate(media.dtypes)], "pos int, col string, kind string")


@q("s18_json", "select media_id, to_json({'path': path, 'size': size, 'play_count': play_count}) as json from media")
def _(spark, d):
    return _media(spark, d).select("media_id", strings.as_json("path", "size", "play_count").alias("json"))


@q("s20_feed", f"select media_id, coalesce(nullif(title, ''), regexp_replace(regexp_extract({P}, '([^/]*)$', 1), '\\.[^.]*$', '')) as title, coalesce(artist, '') as author from media where media_type = 'text' and {LIVE}")
def _(spark, d):
    return aggregates.live(_media(spark, d)).where("media_type = 'text'").select("media_id", strings.display_title(F.col("title"), paths.stem(F.col("path"))).alias("title"), F.coalesce("artist", F.lit("")).alias("author"))


@q("s21_ingest_diff", "with f as (select path, max(size) as size, max(time_modified) as time_modified from media group by path), k as (select path, max(size) as s, max(time_modified) as t, max(coalesce(time_deleted, 0)) as d from media where db <> 'main.db' group by path) select f.path, d is null as is_new from f left join k on f.path = k.path where not coalesce(f.size is not distinct from s and f.time_modified is not distinct from t and d = 0, false)")
def _(spark, d):
    media = _media(spark, d)
    found = media.groupBy("path").agg(F.max("size").alias("size"), F.max("time_modified").alias("time_modified"))
    known = media.where("db <> 'main.db'").groupBy("path").agg(F.max("size").alias("size"), F.max("time_modified").alias("time_modified"), F.max(F.coalesce("time_deleted", F.lit(0))).alias("time_deleted"))
    return changes.ingest_diff(known, found).select("path", "is_new")


@q("s22_new_roots", f"with r as (select distinct {PARENT} as path from media) select path from r where not exists (select 1 from r o where starts_with(r.path, o.path || '/'))")
def _(spark, d):
    return changes.new_roots(_media(spark, d).select(paths.parent(F.col("path")).alias("path")).distinct())


@q("s26_text_duration", "with n as (select doc_id, case when length(coalesce(text, '')) = 0 then 0 else length(text) - length(translate(text, ' ' || chr(10) || chr(9), '')) + 1 end as n_words from documents) select doc_id, n_words, cast(trunc(n_words / 3.67) as bigint) as seconds from n")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", m.word_count(F.col("text")).alias("n_words")).withColumn("seconds", m.reading_seconds(F.col("n_words")))


# ---- search
@q("t06_search_ranked", f"select media_id, cast(10 * t + 5 * p + d + case when t > 0 then 5 else 0 end as bigint) as score_rank from (select *, (length(lower(coalesce(title, ''))) - length(replace(lower(coalesce(title, '')), 'lantern', ''))) // 7 t, (length(lower(path)) - length(replace(lower(path), 'lantern', ''))) // 7 p, (length(lower(coalesce(description, ''))) - length(replace(lower(coalesce(description, '')), 'lantern', ''))) // 7 d from media where {LIVE} and ({' or '.join(f'''contains(lower(coalesce({c}, '')), 'lan')''' for c in spec.INDEXED)}))")
def _(spark, d):
    return search.search_media(_media(spark, d), "lantern").select("media_id", "score_rank")


@q("t06_bm25")
def _(spark, d):
    return search.bm25(aggregates.live(_media(spark, d)), ["harbour", "lantern"]).where("bm25 > 0").select("media_id", F.round("bm25", 6).alias("bm25"))


@q("t08_search_captions", f"select c.caption_id, m.media_type from captions c join (select path, max(media_type) as media_type from media where {LIVE} and media_type in ('video', 'audio') group by path) m on c.media_path = m.path where contains(lower(text), 'harbour') and contains(lower(text), 'reel')")
def _(spark, d):
    return search.search_captions(table(spark, d, "captions"), _media(spark, d), "harbour reel", ["video", "audio"]).select("caption_id", "media_type")


@q("t10_related")
def _(spark, d):
    return search.related(_media(spark, d), "/srv/media/live/quay_cam/continuous_log.mkv")


@q("t11_caption_context", "with c as (select *, contains(lower(text), 'harbour') as hit from captions where time is not null and text is not null), w as (select caption_id, max(hit) over (partition by media_path order by time, caption_id rows between 2 preceding and 2 following) as near from c) select caption_id from w where near")
def _(spark, d):
    return search.caption_context(table(spark, d, "captions"), "harbour").select("caption_id")


@q("t12_best_caption", "with h as (select media_path, text, row_number() over (partition by media_path order by time, caption_id) k from captions where contains(lower(text), 'lantern') or contains(lower(text), 'harbour')) select m.media_id, h.text from media m left join h on m.path = h.media_path and h.k = 1")
def _(spark, d):
    return search.best_captions(table(spark, d, "captions"), _media(spark, d), ["lantern", "harbour"]).select("media_id", "text")


# ---- aggregates
for _freq, _sql in {
    "minutely": "strftime(to_timestamp({c}) at time zone 'UTC', '%Y-%m-%d %H:%M')", "hourly": "strftime(to_timestamp({c}) at time zone 'UTC', '%Y-%m-%d %Hh')", "daily": "strftime(to_timestamp({c}) at time zone 'UTC', '%Y-%m-%d')",
    "weekly": "strftime(to_timestamp({c}) at time zone 'UTC', '%Y-%W')", "monthly": "strftime(to_timestamp({c}) at time zone 'UTC', '%Y-%m')", "yearly": "strftime(to_timestamp({c}) at time zone 'UTC', '%Y')",
    "decadally": "cast(year(to_timestamp({c}) at time zone 'UTC') // 10 * 10 as varchar)",
    "quarterly": "(select year(x) || '-Q' || quarter(x) from (select ((case when strftime(y, '%m-%d') = '12-31' then y + interval 1 day else y end) - interval 3 month) x from (select cast(to_timestamp({c}) at time zone 'UTC' as date) y)))",
}.items():
    q(f"a04_usage_{_freq}", f"select {_sql.format(c='time_created')} as label, {SUMS} from media where time_created > 0 and time_deleted = 0 group by 1")(
        lambda spark, d, f=_freq: aggregates.usage(_media(spark, d), f, "time_created")
    )

_LIB = "count(*) as n, cast(coalesce(sum(size), 0) as bigint) as total_size, cast(coalesce(sum(duration), 0) as bigint) as total_duration, count(*) filter (coalesce(time_last_played, 0) > 0) as watched, count(*) filter (not coalesce(time_last_played, 0) > 0) as unwatched, cast(sum(coalesce(play_count, 0) * coalesce(duration, 0) + coalesce(playhead, 0)) as bigint) as total_played"
q("a02_library", f"select {_LIB} from media where time_deleted = 0")(lambda spark, d: aggregates.library(_media(spark, d).where("time_deleted = 0")))
q("a03_by_type", f"select media_type, {_LIB} from media where time_deleted = 0 group by media_type")(lambda spark, d: aggregates.library(_media(spark, d).where("time_deleted = 0"), "media_type"))
q("a01_count", f"select count(*) as n from media where {LIVE}")(lambda spark, d: aggregates.live(_media(spark, d)).agg(F.count("*").alias("n")))
q("a05_summary", "select 'Total' as label, count(*) as n, cast(sum(size) as bigint) as size, cast(sum(duration) as bigint) as duration from media union all select 'Median', count(*), cast(trunc(quantile_cont(size, 0.5)) as bigint), cast(trunc(quantile_cont(duration, 0.5)) as bigint) from media")(lambda spark, d: aggregates.summary(_media(spark, d)))
q("a06_genres", f"select genre, count(*) as n from media where {LIVE} and genre <> '' group by genre")(lambda spark, d: aggregates.value_counts(aggregates.live(_media(spark, d)), F.col("genre"), "genre"))
q("a06_languages", f"select language, count(*) as n from media where {LIVE} and language <> '' group by language")(lambda spark, d: aggregates.value_counts(aggregates.live(_media(spark, d)), F.col("language"), "language"))
q("a07_ratings", f"select cast(trunc(coalesce(score, 0)) as bigint) as rating, count(*) as n from media where {LIVE} group by 1")(lambda spark, d: aggregates.ratings(aggregates.live(_media(spark, d))))
q("a08_fixed_categories", f"select c as category, (select count(*) from media where {LIVE} and contains(categories, ';' || c || ';')) as n from (select distinct category as c from custom_keywords) v union all select 'Uncategorized', count(*) from media where {LIVE} and coalesce(categories, '') = ''")(
    lambda spark, d: aggregates.named_categories(aggregates.live(_media(spark, d)), table(spark, d, "custom_keywords"))
)
q("a09_categories", f"with v as (select list_filter(str_split(coalesce(categories, ''), ';'), lambda x: trim(x) <> '') l from media where {LIVE}), u as (select trim(unnest(case when len(l) = 0 then ['Uncategorized'] else l end)) category from v union all select null where false), a as (select category, count(*) n from u group by 1 union all select distinct category, 0 from custom_keywords) select category, cast(sum(n) as bigint) as n from a group by 1")(
    lambda spark, d: aggregates.category_counts(_media(spark, d), table(spark, d, "custom_keywords"))
)
q("a10_by_parent", f"select {PARENT} as folder, {MEASURES} from media group by 1")(lambda spark, d: aggregates.by_parent(_media(spark, d)))
q("a11_group_by_parent", f"select {PARENT} as folder, min(path) as first_path, max(path) as last_path, count(*) as n from media where {LIVE} group by 1")(lambda spark, d: aggregates.grouped_by_parent(aggregates.live(_media(spark, d))))
q("a12_by_extension", f"select case when {EXT} = '' then 'no extension' else {EXT} end as extension, {MEASURES} from media group by 1")(lambda spark, d: aggregates.by_extension(_media(spark, d)))
q("a13_by_size", f"with e as (select cast(x as bigint) as low, lead(cast(x as bigint)) over (order by x) as high from (values {', '.join(f'({e})' for e in aggregates.EDGES)}) v(x)) select low, {MEASURES} from media, e where coalesce(size, 0) >= low and (high is null or coalesce(size, 0) < high) group by low")(lambda spark, d: aggregates.by_size(_media(spark, d)))
q("a14_by_depth", f"select '/' || array_to_string(list_filter(str_split(path, '/'), lambda x: x <> '')[:3], '/') as folder, {MEASURES} from media group by 1")(lambda spark, d: aggregates.by_depth(_media(spark, d), 3))
q("a14_tree", f"with f as (select path, count(*) n, coalesce(sum(size) filter ({LIVE}), 0) s, coalesce(sum(duration) filter ({LIVE}), 0) d, list_filter(str_split(path, '/'), lambda x: x <> '') p from media group by path), e as (select n, s, d, '/' || array_to_string(p[:k], '/') as folder from (select *, unnest(range(1, len(p) + 1)) k from f)) select folder, cast(sum(n) as bigint) as n, cast(sum(s) as bigint) as total_size, cast(sum(d) as bigint) as total_duration from e group by folder")(lambda spark, d: aggregates.tree(_media(spark, d)))
q("a16_subfolders", f"with f as (select distinct {PARENT} as folder from media), e as (select '/' || array_to_string(p[:k], '/') as folder from (select p, unnest(range(1, len(p))) k from (select list_filter(str_split(folder, '/'), lambda x: x <> '') p from f))) select folder, count(*) as n_folders from e group by folder")(lambda spark, d: aggregates.subfolders(_media(spark, d)))
q("a17_kept_folders", f"select * from (select {PARENT} as folder, {MEASURES} from media group by 1) where greatest(n_exists, n) >= 6 and total_size >= 100000001")(
    lambda spark, d: aggregates.keep_folders(aggregates.by_parent(_media(spark, d)), parsers.parse_range(">5"), parsers.parse_range(">100MB", parsers.human_to_bytes), True)
)
q("a18_disk_usage", f"with b as (select *, list_filter(str_split({P}, '/'), lambda x: x <> '') p from media where {LIVE} and starts_with({P}, '/srv/media/')) select '/srv/media/' || p[3] as entry, len(p) = 3 as is_file, {SUMS} from b where len(p) > 2 group by 1, 2")(lambda spark, d: aggregates.disk_usage(_media(spark, d), "/srv/media"))
q("a19_percentiles_size", _PCT.format(c="size", w="true"))(lambda spark, d: aggregates.percentiles(_media(spark, d), "size"))
q("a19_percentiles_duration", _PCT.format(c="duration", w=LIVE))(lambda spark, d: aggregates.percentiles(aggregates.live(_media(spark, d)), "duration"))


@q("a20_filter_bins", f"with f as (select {PARENT} as p, count(*) c from media where {LIVE} group by 1) select 'size' as dim, min(size) as low, max(size) as high from media where {LIVE} and size < 109951162777600 union all select 'duration', min(duration), max(duration) from media where {LIVE} and duration > 0 and duration < 2678400 union all select 'modified', min(time_modified), max(time_modified) from media where {LIVE} union all select 'episodes', min(c), max(c) from f")
def _(spark, d):
    live = aggregates.live(_media(spark, d))
    size = live.where("size < 109951162777600").agg(F.lit("size").alias("dim"), F.min("size").alias("low"), F.max("size").alias("high"))
    length = live.where("duration > 0 and duration < 2678400").agg(F.lit("duration").alias("dim"), F.min("duration").alias("low"), F.max("duration").alias("high"))
    seen = live.agg(F.lit("modified").alias("dim"), F.min("time_modified").alias("low"), F.max("time_modified").alias("high"))
    folders = live.groupBy(paths.parent(F.col("path"))).count().agg(F.lit("episodes").alias("dim"), F.min("count").alias("low"), F.max("count").alias("high"))
    return changes.union_all([size, length, seen, folders])


q("a22_folder_stats", f"select {PARENT} as parent, length({PARENT}) - length(replace({PARENT}, '/', '')) as depth, count(*) as file_count, cast(coalesce(sum(size), 0) as bigint) as total_size, cast(coalesce(sum(duration), 0) as bigint) as total_duration from media where {LIVE} group by 1")(lambda spark, d: aggregates.folder_stats(_media(spark, d)))
q("a24_type_counts", f"select coalesce(nullif(media_type, ''), 'unknown') as media_type, count(*) as n from media where {LIVE} group by 1")(lambda spark, d: aggregates.value_counts(aggregates.live(_media(spark, d)), F.col("media_type"), "media_type", "unknown"))
_WORDS = "list_filter(str_split(regexp_replace(lower({c}), '[^a-z0-9]+', ' ', 'g'), ' '), lambda x: x <> '')"
q("a25_word_counts", f"select word, count(*) as n from (select unnest({_WORDS.format(c='path')}) as word from media) group by word")(lambda spark, d: aggregates.word_counts(_media(spark, d), F.col("path")))


@q("a25_line_statistics", f"with t as (select media_id, unnest({_WORDS.format(c='path')}) as w from media), c as (select w, count(*) n from t group by w) select media_id, count(*) as n_words, cast(sum(n) as bigint) as sum_n, max(n) as max_n, min(n) as min_n, round(avg(n), 6) as avg_n, quantile_cont(n, 0.5) as median_n, count(*) filter (n > 1) as dups, count(*) filter (n = 1) as uniques from t join c using (w) group by media_id")
def _(spark, d):
    words = _media(spark, d).select(F.col("media_id").alias("i"), F.explode(strings.words(F.col("path"))).alias("w"))
    return textsort.line_statistics(words).select(F.col("i").alias("media_id"), F.col("n").alias("n_words"), F.col("sum").alias("sum_n"), F.col("max").alias("max_n"), F.col("min").alias("min_n"), F.round("avg", 6).alias("avg_n"), F.col("median").alias("median_n"), "dups", "uniques")


q("a28_caption_aggregate", "select media_path, count(*) as n, cast(coalesce(sum(floor(time)), 0) as bigint) as total_time, min(time) as first_time, arg_min(struct_pack(t := text), (time is null, time, caption_id)).t as first_text from captions group by media_path")(
    lambda spark, d: aggregates.captions_by_media(table(spark, d, "captions"))
)


@q("a29_merged_captions")
def _(spark, d):
    hits = search.search_captions(table(spark, d, "captions"), _media(spark, d), "harbour")
    return search.merge_captions(hits)


q("a30_history_counts", "select media_path, count(*) as n, max(time_played) as last from history group by media_path")(lambda spark, d: aggregates.history_counts(table(spark, d, "history")))
q("a31_distinct", "select distinct category as v, 'category' as kind from custom_keywords union all select distinct media_path, 'captioned' from captions union all select distinct title, 'playlist' from playlists where title is not null")(
    lambda spark, d: changes.union_all([
        table(spark, d, "custom_keywords").select(F.col("category").alias("v"), F.lit("category").alias("kind")).distinct(),
        table(spark, d, "captions").select(F.col("media_path").alias("v"), F.lit("captioned").alias("kind")).distinct(),
        table(spark, d, "playlists").where("title is not null").select(F.col("title").alias("v"), F.lit("playlist").alias("kind")).distinct(),
    ])
)


# ---- windows and sorts
@q("w01_ntile_priority", "select media_id, ntile(1000) over (order by size // duration desc nulls last, media_id) as tile from media where size is not null and duration > 0")
def _(spark, d):
    rows = _media(spark, d).where("size is not null and duration > 0")
    return ranking.ntile(rows, [F.expr("size div duration").desc_nulls_last(), F.col("media_id")], 1000, keep=["media_id"]).select("media_id", "tile")


@q("w02_ntile_fast", "select media_id, ntile(1000) over (order by size desc nulls last, media_id) as tile from media")
def _(spark, d):
    return ranking.ntile(_media(spark, d), [F.col("size").desc_nulls_last(), F.col("media_id")], 1000, keep=["media_id"]).select("media_id", "tile")


@q("w06_top_per_folder", f"select media_id from (select media_id, row_number() over (partition by {PARENT} order by path, media_id) k from media) where k <= 3")
def _(spark, d):
    media = _media(spark, d).select(paths.parent(F.col("path")).alias("f"), "path", "media_id")
    return ranking.number_within(media, ["f"], [F.col("path"), F.col("media_id")], "k", ["media_id"]).where("k <= 3").select("media_id")


def _order_sql(by: str, where: str = "true") -> str:
    return f"select media_id, cast(row_number() over (order by {by}) as bigint) as rn from media where {where}"


_SORTS = {
    "o01_size_desc": ("-size", "coalesce(size, 0) desc, path, media_id"),
    "o01_progress": ("progress desc", "(coalesce(try_cast(playhead as double) / nullif(duration, 0), 0) = 0), coalesce(cast(playhead as double) / nullif(duration, 0), 0) desc, path, media_id"),
    "o06_type_title": ("media_type,-title", "coalesce(media_type, ''), coalesce(title, '') desc, path, media_id"),
    "o06_extension": ("extension,-time_created", f"{EXT}, coalesce(time_created, 0) desc, path, media_id"),
    "o09_groups": ("size|-play_count", "(coalesce(play_count, 0) = 0), coalesce(play_count, 0) desc, coalesce(size, 0), path, media_id"),
    "o10_default_order": ("default", "coalesce(video_count, 0) desc, coalesce(audio_count, 0) desc, lower(path[:4]) = 'http', coalesce(subtitle_count, 0) desc, (coalesce(play_count, 0) = 0), coalesce(play_count, 0), coalesce(playhead, 0) desc, (coalesce(time_last_played, 0) = 0), coalesce(time_last_played, 0), coalesce(trim(title) = '', true), path, media_id"),
}
for _name, (_config, _by) in _SORTS.items():
    q(_name, _order_sql(_by))(lambda spark, d, c=_config: ranking.number(_media(spark, d), [*(sorting.groups(c) if "|" in c else sorting.order(c)), F.col("media_id").asc()], keep=["media_id"]).select("media_id", "rn"))


@q("o07_natural")
def _(spark, d):
    return ranking.number(_media(spark, d), [*sorting.order("natural_path"), F.col("media_id").asc()], keep=["media_id"]).select("media_id", "rn")


q("o02_page", f"select media_id, path from media where {LIVE} order by coalesce(size, 0) desc, path, media_id limit 50 offset 20")(
    lambda spark, d: spec.run(QuerySpec(limit=None), _media(spark, d)).orderBy(F.coalesce("size", F.lit(0)).desc(), "path", "media_id").offset(20).limit(50).select("media_id", "path")
)
q("o04_random")(lambda spark, d: aggregates.live(_media(spark, d)).orderBy(F.rand(7)).limit(20).select("media_id"))
q("o12_weighted_rerank", "with n as (select greatest(count(*) - 1, 1) as n from media), r as (select media_id, row_number() over (order by coalesce(size, 0) desc, media_id) a, row_number() over (order by coalesce(duration, 0), media_id) b from media) select media_id, round((1 - (a - 1) / n.n) / 1 + (1 - (b - 1) / n.n) / 2, 6) as rank_score from r, n")(
    lambda spark, d: sorting.weighted_rerank(_media(spark, d), ["-size", "duration"]).select("media_id", F.round("rank_score", 6).alias("rank_score"))
)
q("o13_rerank", "with r as (select media_id, row_number() over (order by coalesce(size, 0) desc, media_id) a, row_number() over (order by coalesce(duration, 0), media_id) b from media) select media_id, cast((a - 1) * 2 + (b - 1) as double) as rank_score from r")(lambda spark, d: sorting.rerank(_media(spark, d), {"-size": 2, "duration": 1}).select("media_id", "rank_score"))
q("o15_history_progress", "select media_id, round(cast(playhead as double) / duration, 6) as progress from media where coalesce(playhead, 0) > 0 and duration > 0")(
    lambda spark, d: _media(spark, d).where("coalesce(playhead, 0) > 0 and duration > 0").select("media_id", F.round(m.progress(F.col("playhead"), F.col("duration")), 6).alias("progress"))
)
q("o20_list", "select p[4] as entry, bool_or(len(p) > 4) as is_folder, count(*) as n from (select list_filter(str_split(path, '/'), lambda x: x <> '') p from media where starts_with(path, '/srv/media/shows/s')) where len(p) >= 4 group by 1 order by n desc, is_folder desc, entry limit 20")(
    lambda spark, d: aggregates.listed(_media(spark, d), "/srv/media/shows/s", 20)
)
q("o22_trash", "select media_id, time_deleted from media where coalesce(time_deleted, 0) > 0")(lambda spark, d: spec.run(QuerySpec(only_deleted=True, limit=None), _media(spark, d)).select("media_id", "time_deleted"))


# ---- joins and changes
@q("j04_playlist_items", f"select i.playlist_id, i.media_path, row_number() over (partition by playlist_id order by track_number nulls first, time_added nulls first, media_path) as pos from playlist_items i join (select distinct path from media where {LIVE}) m on i.media_path = m.path")
def _(spark, d):
    return changes.playlist(table(spark, d, "playlist_items"), _media(spark, d)).select("playlist_id", "media_path", "pos")


@q("j07_siblings", f"with m as (select *, {PARENT} as f from media) select media_id from m where f in (select f from m where contains(lower(coalesce(title, '')), 'façade'))")
def _(spark, d):
    media = _media(spark, d)
    return similarity.siblings(media.where(F.lower(F.coalesce("title", F.lit(""))).contains("façade")), media).select("media_id")


@q("j08_missing", "select distinct media_path from history where media_path not in (select path from media where path is not null)")
def _(spark, d):
    return table(spark, d, "history").where("media_path is not null").join(_media(spark, d).select(F.col("path").alias("media_path")), "media_path", "left_anti").select("media_path").distinct()


@q("j09_watch_later", "with h as (select media_path, max(playhead) as head from history where playhead is not null and media_path is not null group by 1) select media_id, head as saved from media join h on path = media_path")
def _(spark, d):
    saved = table(spark, d, "history").where("playhead is not null and media_path is not null").groupBy("media_path").agg(F.max("playhead").alias("at"))
    states = saved.select(F.upper(F.md5("media_path")).alias("name"), F.format_string("volume=80\nstart=%d.500000\npause=yes", "at").alias("value"))
    return files.watch_later(_media(spark, d), states).select("media_id", "saved")


_ONE = "select path, max(size) as size, max(title) as title, max(play_count) as play_count, max(time_downloaded) as time_downloaded, max(time_deleted) as time_deleted, max(time_created) as time_created from media where {w} group by path"
_COLS = ("size", "title", "play_count", "time_downloaded", "time_deleted", "time_created")


def _one(spark, d, where):
    return _media(spark, d).where(where).groupBy("path").agg(*[F.max(c).alias(c) for c in _COLS])


_DBS = ("db in ('main.db', 'laptop.db')", "db not in ('laptop.db')")
q("u05_upsert", f"with o as ({_ONE.format(w=_DBS[0])}), n as ({_ONE.format(w=_DBS[1])}) select coalesce(o.path, n.path) as path, case when n.path is not null then n.size else o.size end as size, case when n.path is not null then n.title else o.title end as title, case when o.path is not null then o.play_count else n.play_count end as play_count, coalesce(o.time_downloaded, n.time_downloaded) as time_downloaded, case when n.path is not null then 0 else o.time_deleted end as time_deleted, case when o.path is not null then o.time_created else n.time_created end as time_created from o full join n on o.path = n.path")(
    lambda spark, d: changes.upsert_media(_one(spark, d, _DBS[0]), _one(spark, d, _DBS[1]))
)
q("u06_merge_replace", f"with o as ({_ONE.format(w=_DBS[0])}), n as ({_ONE.format(w=_DBS[1])}) select * from n union all select * from o where path not in (select path from n)")(lambda spark, d: changes.merge(_one(spark, d, _DBS[0]), _one(spark, d, _DBS[1]), ["path"]))
q("u07_merge_ignore", f"with o as ({_ONE.format(w=_DBS[0])}), n as ({_ONE.format(w=_DBS[1])}) select * from o union all select * from n where path not in (select path from o)")(lambda spark, d: changes.merge(_one(spark, d, _DBS[0]), _one(spark, d, _DBS[1]), ["path"], "ignore"))
q("u08_merge_upsert", f"with o as ({_ONE.format(w=_DBS[0])}), n as ({_ONE.format(w=_DBS[1])}) select coalesce(o.path, n.path) as path, case when n.path is not null then n.size else o.size end as size, case when n.path is not null then n.title else o.title end as title, o.play_count, o.time_downloaded, o.time_deleted, o.time_created from o full join n on o.path = n.path")(
    lambda spark, d: changes.merge(_one(spark, d, _DBS[0]), _one(spark, d, _DBS[1]), ["path"], "upsert", ["size", "title"])
)
q("u09_mark_deleted", f"select media_id, case when coalesce({EXT} = '.avi', false) then {NOW} else time_deleted end as time_deleted from media")(lambda spark, d: changes.mark_deleted(_media(spark, d), paths.extension(F.col("path")) == ".avi", NOW).select("media_id", "time_deleted"))
q("u10_playback", "with h as (select media_path, min(time_played) f, max(time_played) l, count(*) filter (done = 1) n, arg_max(coalesce(playhead, 0), (time_played, id)) p from history where time_played is not null and media_path is not null group by media_path) select media_id, coalesce(nullif(time_first_played, 0), f, 0) as time_first_played, greatest(coalesce(time_last_played, 0), coalesce(l, 0)) as time_last_played, coalesce(play_count, 0) + coalesce(n, 0) as play_count, coalesce(p, playhead) as playhead from media left join h on path = media_path")(
    lambda spark, d: changes.playback(_media(spark, d), table(spark, d, "history")).select("media_id", "time_first_played", "time_last_played", "play_count", "playhead")
)
q("u12_rename", "select media_id, case when path = '/srv/media/shows' or starts_with(path, '/srv/media/shows/') then '/mnt/series' || substr(path, 17) else path end as path from media")(lambda spark, d: changes.rename(_media(spark, d), "/srv/media/shows", "/mnt/series").select("media_id", "path"))
q("u14_media_type", f"select media_id, coalesce(nullif(media_type, ''), case when {EXT}[2:] in ({', '.join(map(repr, paths.TEXT))}) then 'text' when {EXT}[2:] in ({', '.join(map(repr, paths.IMAGE))}) then 'image' when {EXT}[2:] in ({', '.join(map(repr, paths.AUDIO))}) then 'audio' when {EXT}[2:] in ({', '.join(map(repr, paths.VIDEO))}) then 'video' end) as media_type from media")(lambda spark, d: changes.fill_media_type(_media(spark, d)).select("media_id", "media_type"))
q("w10_action_limit", "with r as (select media_id, size, row_number() over o as k, coalesce(sum(coalesce(size, 0)) over (order by coalesce(time_modified, 0), media_id rows between unbounded preceding and 1 preceding), 0) as before from media window o as (order by coalesce(time_modified, 0), media_id)) select media_id from r where k <= 500 and before < 5000000000")(
    lambda spark, d: changes.action_limit(_media(spark, d), [F.coalesce("time_modified", F.lit(0)), F.col("media_id")], 500, 5_000_000_000).select("media_id")
)


# ---- duplicates, similarity, categories
def _dup_sql(keys: str) -> str:
    on = " and ".join(f"{k} is not null and cast({k} as varchar) <> ''" for k in keys.split(", "))
    return f"with l as (select *, row_number() over (partition by {keys} order by coalesce(is_deduped, 0) desc, coalesce(size, -1) desc, coalesce(time_modified, -1) desc, media_id) k from media where {LIVE} and {on}), f as (select {keys}, media_id as keep_id, coalesce(duration, 0) as kd from l where k = 1) select f.keep_id, l.media_id as dup_id from l join f using ({keys}) where l.k > 1 and abs(coalesce(l.duration, 0) - kd) <= 8"


q("d01_duplicates_title_artist", _dup_sql("title, artist"))(lambda spark, d: similarity.duplicates(_media(spark, d), ["title", "artist"]).select("keep_id", "dup_id"))
q("d01_duplicates_path", _dup_sql("path"))(lambda spark, d: similarity.duplicates(_media(spark, d), ["path"]).select("keep_id", "dup_id"))
q("d02_content", f"with l as (select *, row_number() over (partition by size, sha256 order by coalesce(is_deduped, 0) desc, media_id) k from media where sha256 is not null and length(sha256) = 64 and size is not null and {LIVE}), f as (select size, sha256, media_id as keep_id from l where k = 1) select keep_id, media_id as dup_id from l join f using (size, sha256) where k > 1")(lambda spark, d: similarity.content_duplicates(_media(spark, d)))
q("d03_dice")(lambda spark, d: _media(spark, d).where("title is not null").select("media_id", F.round(similarity.dice(F.lower("title"), F.lower(paths.stem(F.col("path")))), 6).alias("dice")))
q("d06_clusters")(lambda spark, d: similarity.cluster_numbers(_media(spark, d), "media_id", singles=True))
q("d09_tf_idf", f"with t as (select media_id, unnest({_WORDS.format(c='path')}) as word from media), tf as (select media_id, word, count(*) c from t group by all), l as (select media_id, sum(c) len from tf group by 1), f as (select word, count(*) df from tf group by 1) select media_id, word, round(c / len * ln((select count(*) from media) / df), 6) as weight from tf join l using (media_id) join f using (word)")(
    lambda spark, d: similarity.tf_idf(_media(spark, d), "media_id", F.col("path")).select("media_id", "word", F.round("weight", 6).alias("weight"))
)
q("d09_path_clusters")(lambda spark, d: similarity.cluster_paths(_media(spark, d), "media_id", F.col("path"), 12))


_HIT = "regexp_matches(concat_ws(' ', path, title), '(?i)(?:^|[^a-zA-Z0-9])' || keyword || '(?:$|[^a-zA-Z0-9])')"
q("d12_categorize", f"with h as (select distinct media_id, category from media, custom_keywords where {_HIT}), o as (select media_id, trim(unnest(str_split(coalesce(categories, ''), ';'))) category from media), a as (select * from h union select * from o where category <> '') select media_id, coalesce(';' || string_agg(category, ';' order by category) || ';', '') as new_categories from media left join a using (media_id) group by media_id")(
    lambda spark, d: similarity.categorize(_media(spark, d), table(spark, d, "custom_keywords")).select("media_id", "new_categories")
)
q("a26_mined_keywords", f"with m as (select * from media where not exists (select 1 from custom_keywords where {_HIT})) select word, count(*) as n from (select unnest(list_distinct({_WORDS.format(c='''concat_ws(' ', path, title)''')})) as word from m) where length(word) >= 4 and word not in (select lower(keyword) from custom_keywords) group by word having count(*) > 1")(
    lambda spark, d: similarity.mine_keywords(_media(spark, d), table(spark, d, "custom_keywords"))
)


# ---- scalar functions
_ODD = "[\\x7f&%*$#!?|^''\":><]"
q("x01_tokenized", f"select media_id, trim(regexp_replace(regexp_replace(regexp_replace(path, '[/\\\\.\\[\\]\\-+(){{}}_&]', ' ', 'g'), '{_ODD}', '', 'g'), '\\s+', ' ', 'g')) as tokens from media")(lambda spark, d: _media(spark, d).select("media_id", strings.tokenized(F.col("path")).alias("tokens")))
q("x05_combine", "with v as (select media_id, list_filter(list_transform(regexp_split_to_array(coalesce(genre, '') || ';' || coalesce(categories, ''), '[,;]'), lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'))), lambda x: x <> '' and lower(x) not in ('unknown', 'none', 'und')) l from media) select media_id, coalesce(array_to_string(list_filter(l, lambda x, i: list_position(list_transform(l, lambda y: lower(y)), lower(x)) = i), ';'), '') as combined from v")(
    lambda spark, d: _media(spark, d).select("media_id", strings.combine(F.col("genre"), F.col("categories")).alias("combined"))
)
q("x06_generic_titles", "select media_id, coalesce(t = '' or ((starts_with(t, 'chapter') or starts_with(t, 'scene')) and strlen(t) < 12) or contains(t, 'untitled chapter') or regexp_matches(t, '^[0-9:;._,\\- ]+$'), true) as generic from (select media_id, lower(trim(title)) t from media)")(lambda spark, d: _media(spark, d).select("media_id", strings.is_generic_title(F.col("title")).alias("generic")))
q("x12_path_parts", f"select media_id, {PARENT} as parent, {EXT} as ext, len(list_filter(str_split(path, '/'), lambda x: x <> '')) as depth from media")(
    lambda spark, d: _media(spark, d).select("media_id", paths.parent(F.col("path")).alias("parent"), paths.extension(F.col("path")).alias("ext"), paths.depth(F.col("path")).cast("bigint").alias("depth"))
)
q("x18_hashes", "select media_id, sha256(path) as sha, upper(md5(path)) as md5 from media")(lambda spark, d: _media(spark, d).select("media_id", F.sha2("path", 256).alias("sha"), F.upper(F.md5("path")).alias("md5")))
q("x17_strip_tags", "select doc_id, trim(regexp_replace(regexp_replace(text, '<[^>]*>', ' ', 'g'), '[ \\t\\n\\r\\f]+', ' ', 'g'), ' ') as plain from documents")(lambda spark, d: table(spark, d, "documents").select("doc_id", strings.strip_tags(F.col("text")).alias("plain")))
q("m04_bitrate", "select media_id, case when duration > 0 then size // duration end as bitrate from media")(lambda spark, d: _media(spark, d).select("media_id", m.bitrate(F.col("size"), F.col("duration")).alias("bitrate")))
_V, _A = "lower(coalesce(video_codecs, ''))", "lower(coalesce(audio_codecs, ''))"
_PLAYS = f"""select media_id, media_type, {EXT} as ext, ltrim({EXT}, '.') as box, regexp_matches({_V}, 'h264|avc1|vp8|vp9|av1') as v, regexp_matches({_A}, 'aac|mp3|opus|vorbis|flac|pcm|wav') and not regexp_matches({_A}, 'eac3|ac3|dts|truehd|mlp') as a,
 regexp_matches({_V}, 'vp9|vp8|av1') or regexp_matches({_A}, 'opus|vorbis') as w from media"""
_NEEDS = """case when ext in ('.sqlite', '.db', '.txt') then false when media_type = 'video' then not (v and a and case when w then box in ('webm', 'mkv', 'matroska') else box in ('mp4', 'm4v', 'mov', 'mkv', 'matroska') end)
 when media_type = 'audio' then not (a and box in ('mp3', 'mp4', 'm4a', 'ogg', 'flac', 'wav', 'opus', 'webm')) else false end"""
q("m07_transcode", f"with p as ({_PLAYS}), n as (select *, {_NEEDS} as needs from p) select media_id, needs, needs and media_type = 'video' and v as copy_video, needs and a as copy_audio, case when needs and media_type = 'video' then case when w then 'video/webm' else 'video/mp4' end when needs then 'audio/webm' else '' end as mime from n")(
    lambda spark, d: _media(spark, d).select("media_id", m.transcode(paths.extension(F.col("path")), F.col("media_type"), F.col("video_codecs"), F.col("audio_codecs")).alias("t")).select("media_id", "t.*")
)
_HMS = "case when {d} >= 3600 then printf('%d:%02d:%02d', {d} // 3600, {d} % 3600 // 60, {d} % 60) else printf('%d:%02d', {d} // 60, {d} % 60) end"
_UNIT = "case when size is null or size = 0 then '-' when size < 1000 then printf('%d B', size) " + " ".join(f"when size < {1000 ** (k + 1)} then printf('%.1f {u}', cast(size as double) / {1000 ** k})" for k, u in enumerate(("KB", "MB", "GB", "TB", "PB"), 1)) + " end"
q("m02_formatted", f"""select media_id, {_UNIT} as size, case when coalesce(duration, 0) = 0 then '-' when duration >= 86400 then printf('%dd %02d:%02d', duration // 86400, duration % 86400 // 3600, duration % 3600 // 60) else {_HMS.format(d='duration')} end as duration,
 case when coalesce(duration, 0) = 0 then '' when duration < 60 then printf('%d seconds', duration) when duration < 66 then '1 minute' when duration < 3600 then printf('%.1f minutes', duration / 60.0) when duration < 3960 then '1 hour' when duration < 86400 then printf('%.1f hours', duration / 3600.0)
 when duration // 86400 // 365 > 0 then printf('%d years', duration // 86400 // 365) || case when duration // 86400 % 365 > 0 then printf(' and %d days', duration // 86400 % 365) else '' end when duration // 86400 > 1 then printf('%d days', duration // 86400) else '1 day' end as short,
 {_HMS.format(d='duration')} as clock, case when coalesce(time_created, 0) = 0 then '-' else strftime(to_timestamp(time_created) at time zone 'UTC', '%Y-%m-%d %H:%M') end as created from media""")(
    lambda spark, d: _media(spark, d).select(
        "media_id", m.format_size(F.col("size")).alias("size"), m.format_duration(F.col("duration")).alias("duration"), m.format_duration_short(F.col("duration")).alias("short"), m.hhmmss(F.col("duration")).alias("clock"), m.format_time(F.col("time_created")).alias("created")
    )
)

q("s10_chunks")(lambda spark, d: files.chunks(table(spark, d, "documents"), "doc_id", "text"))
_LINE_WORDS = "list_transform(regexp_extract_all(regexp_replace(path, '^https?://', ''), '\\b\\w\\w+\\b'), lambda x: lower(x))"
q("o16_line_sort", f"with w as (select media_id, path, {_LINE_WORDS} as l from media), e as (select media_id, unnest(l) as word, unnest(range(1, len(l) + 1)) as k, len(l) as n from w), c as (select word, count(*) as c from e group by 1), f as (select media_id, word, max(k) as last from e group by 1, 2), o as (select e.media_id, string_agg(e.word, ' ' order by c.c > 1 desc, c.c, strlen(e.word) desc, e.n - f.last desc, e.word, e.k) as words from e join c using (word) join f on e.media_id = f.media_id and e.word = f.word group by 1), s as (select media_id, path, coalesce(words, '') as words from w left join o using (media_id)) select media_id, words, row_number() over (order by words, path, media_id) as rn from s")(
    lambda spark, d: textsort.sort_lines(_media(spark, d), "media_id", "path").select("media_id", "words", "rn")
)
q("o14_folder_sort", f"with f as (select {PARENT} as folder, {SUMS} from media where {LIVE} group by 1) select folder, row_number() over (order by n, folder) as by_count, row_number() over (order by total_size desc, folder) as by_size, row_number() over (order by total_duration, folder) as by_duration, row_number() over (order by total_size / n desc, total_size desc, folder) as by_priority from f")(
    lambda spark, d: _folder_ranks(spark, d)
)
q("u11_move_track", "with p as (select *, row_number() over (order by track_number nulls first, time_added nulls first, media_path) - 1 as k from playlist_items where playlist_id = 3), x as (select media_path as mp from p where k = 2) select media_path, cast(case when media_path = mp then 0 when mp is not null and k < 2 then k + 1 else k end as bigint) as track_number from p left join x on true")(
    lambda spark, d: _moved(spark, d)
)
q("j05_history_unfinished", "select h.media_path, max(h.time_played) as last from history h join (select path, max(duration) as duration from media where duration > 0 group by path) m on h.media_path = m.path where h.playhead > 0 and h.playhead < 0.95 * m.duration group by h.media_path")(
    lambda spark, d: table(spark, d, "history").join(_media(spark, d).where("duration > 0").groupBy(F.col("path").alias("media_path")).agg(F.max("duration").alias("duration")), "media_path").where("playhead > 0 and playhead < 0.95 * duration").groupBy("media_path").agg(F.max("time_played").alias("last"))
)
q("d05_similar_pairs_to_median", "with m as (select path, max(size) as size from media where size > 0 group by path), f as (select regexp_replace(path, '/[^/]*$', '') as folder, median(size) as med from m group by 1) select path, round(case when size = med then 0 else abs(size - med) / ((size + med) / 2.0) * 100 end, 4) as difference from m join f on regexp_replace(path, '/[^/]*$', '') = folder")(
    lambda spark, d: _to_median(spark, d)
)


def _folder_ranks(spark: SparkSession, d: str) -> DataFrame:
    stats, out = aggregates.folder_stats(_media(spark, d)), None
    for by, down in (("count", False), ("size", True), ("duration", False), ("priority", True)):
        ranked = ranking.number(stats, sorting.folder_order(by, down), f"by_{by}", ["parent"])
        out = ranked if out is None else out.join(ranked, "parent")
    return out.withColumnRenamed("parent", "folder")


def _moved(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "playlist_items")
    third = items.where("playlist_id = 3").orderBy(F.col("track_number").asc_nulls_first(), F.col("time_added").asc_nulls_first(), "media_path").offset(2).limit(1).collect()
    return changes.move_track(items, 3, third[0]["media_path"] if third else "", 0).select("media_path", "track_number")


def _to_median(spark: SparkSession, d: str) -> DataFrame:
    sizes = _media(spark, d).where("size > 0 and path is not null").groupBy("path").agg(F.max("size").alias("size")).withColumn("folder", F.regexp_replace("path", "/[^/]*$", ""))
    med = ranking.medians(sizes, ["folder"], "size", "med")
    return sizes.join(med, "folder").select("path", F.round(m.percent_difference(F.col("size").cast("double"), F.col("med")), 4).alias("difference"))


# ---- smaller functions and reports
_NAME = "case lower(substr({c}, 1, 2)) " + " ".join(f"when '{k}' then '{v}'" for k, v in more.LANGUAGE_NAMES.items()) + " end"
_RATE = f"(case {EXT} when '.vob' then 5e6 when '.ifo' then 5e6 when '.vro' then 5e6 when '.m2t' then 15e6 when '.m2ts' then 15e6 when '.mts' then 15e6 when '.mod' then 10e6 when '.tod' then 12e6 when '.divx' then 4e6 when '.xvid' then 4e6 when '.rm' then 2e6 when '.rmvb' then 3e6 when '.wmv' then 3e6 when '.asf' then 3e6 when '.avchd' then 20e6 when '.bdmv' then 30e6 when '.mpls' then 30e6 when '.iso' then 8e6 end)"
_PER = f"(case {EXT} when '.pdf' then 7.0 when '.epub' then 5.5 when '.mobi' then 5.5 when '.azw3' then 5.5 when '.docx' then 6.5 when '.odt' then 6.5 when '.html' then 4.5 when '.htm' then 4.5 when '.cbz' then 50.0 when '.cbr' then 50.0 when '.djvu' then 15.0 else 4.2 end)"
q("x15_language_names", f"select media_id, {_NAME.format(c='language')} as name from media")(lambda spark, d: _media(spark, d).select("media_id", more.language_name(F.col("language")).alias("name")))
q("x07_shortened", "select media_id, case when length(title) > 20 then substr(title, 1, 19) || '…' else title end as short, case when length(path) > 40 then substr(path, 1, 19) || '…' || substr(path, -20) else path end as middle from media")(
    lambda spark, d: _media(spark, d).select("media_id", more.shorten(F.col("title"), 20).alias("short"), more.shorten_middle(F.col("path"), 40).alias("middle"))
)
q("x11_escaped", "select media_id, replace(replace(replace(replace(replace(title, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), chr(34), '&quot;'), chr(39), '&apos;') as xml from media")(lambda spark, d: _media(spark, d).select("media_id", more.escape_xml(F.col("title")).alias("xml")))
q("m05_durations", f"select media_id, case when coalesce(duration, 0) < 120 and coalesce(size / {_RATE} * 8 > 120, false) then cast(floor(size / {_RATE} * 8) as bigint) else duration end as duration, case when duration > 0 then cast(duration as double) when size > 0 then size / coalesce({_RATE}, 1.5e6) * 8 else 0 end as timeout from media")(
    lambda spark, d: _media(spark, d).select("media_id", more.corrected_duration(F.col("duration"), F.col("size"), F.col("path")).alias("duration"), more.timeout_duration(F.col("duration"), F.col("size"), F.col("path")).alias("timeout"))
)
q("m06_reading", f"with w as (select media_id, greatest(cast(floor(size / cast({_PER} as double)) as bigint), 10) as n_words from media) select media_id, n_words, cast(trunc(n_words / 3.67) as bigint) as seconds from w")(
    lambda spark, d: _media(spark, d).select("media_id", more.words_of_size(F.col("size"), F.col("path")).alias("n_words")).withColumn("seconds", m.reading_seconds(F.col("n_words")))
)
q("m09_word_timings", "select doc_id, k - 1 as pos, word, round((k - 1) * 60.0 / 250, 6) as at from (select doc_id, unnest(l) as word, unnest(range(1, len(l) + 1)) as k from (select doc_id, list_filter(regexp_split_to_array(text, '[ \\t\\n\\r\\f\\x0B]+'), lambda w: w <> '') as l from documents where text is not null))")(
    lambda spark, d: table(spark, d, "documents").select("doc_id", F.posexplode(more.word_timings(F.col("text"))).alias("pos", "w")).select("doc_id", F.col("pos").cast("bigint").alias("pos"), "w.word", F.round("w.at", 6).alias("at"))
)
q("m10_segments", "select media_id, unnest(range(0, cast(ceil(duration / 10) as bigint))) as segment from media where duration > 0")(lambda spark, d: _media(spark, d).select("media_id", F.explode(more.segments(F.col("duration"))).alias("segment")))
q("m11_play_window", "select media_id, greatest(0, least(duration, duration) - greatest(case when duration - 60 > 0 then duration - 60 else duration - 60 end, 0)) as seconds from media where duration is not null")(
    lambda spark, d: _media(spark, d).where("duration is not null").select("media_id", more.play_window(F.col("duration"), F.lit(-60), F.lit(None).cast("bigint")).alias("seconds"))
)
q("m11_playhead", "select media_id, case when playhead > 0 and (duration is null or playhead < duration) then playhead when play_count > 0 and (duration is null or play_count < duration) then play_count end as at from media")(
    lambda spark, d: _media(spark, d).select("media_id", more.playhead(F.col("playhead"), F.col("play_count"), F.col("duration")).alias("at"))
)
q("f29_dict_rules", "select media_id from media where not (coalesce(starts_with(lower(path), '/srv/media/live'), false) or (coalesce(starts_with(lower(path), '/srv/media/shows'), false) and coalesce(starts_with(lower(media_type), 'video'), false)))")(
    lambda spark, d: _media(spark, d).where(more.dict_filter([{"path": "/srv/media/live"}, {"path": "/srv/media/shows", "media_type": "video"}], False)).select("media_id")
)
q("f30_ingest_filter", "select media_id from media where (contains(path, 'shows') or contains(path, 'music')) and not contains(path, 'series_001') and regexp_matches(path, '[0-9]{8}') and (size >= 100000001 or size <= 999999)")(
    lambda spark, d: _media(spark, d).where(more.ingest_filter(include=["shows", "music"], exclude=["series_001"], regex="[0-9]{8}", sizes=[parsers.parse_range(">100MB", parsers.human_to_bytes), parsers.parse_range("<1MB", parsers.human_to_bytes)])).select("media_id")
)
q("a33_value_counts", "select media_id, count(*) over (partition by media_type) as n from media where media_type is not null")(lambda spark, d: aggregates.with_group_size(_media(spark, d).select("media_id", "media_type"), "media_type").select("media_id", "n"))
q("a27_suggestions", f"with u as (select media_id, unnest(list_distinct({_WORDS.format(c='title')})) as word from media where {LIVE} and coalesce(categories, '') = '') select word, count(*) as n from u where length(word) >= 4 and word not in (select lower(keyword) from custom_keywords) group by word")(
    lambda spark, d: similarity.suggestions(aggregates.live(_media(spark, d)), table(spark, d, "custom_keywords"))
)
_DIM = "with m as (select *, {p} as folder from media where {w}), f as (select folder, count(*) as episodes from m group by 1) "
_VECTORS = " union all ".join(
    f"(select '{dim}' as dim, min(value) as low, max(value) as high, list(value order by pct) as points from ({_PCT.format(c=c, w=w).replace('from media where', 'from ' + src + ' where')}))"
    for dim, c, w, src in (
        ("size", "size", "size < 109951162777600", "m"), ("duration", "duration", "duration > 0 and duration < 2678400", "m"), ("time_modified", "time_modified", "true", "m"), ("time_created", "time_created", "true", "m"),
        ("time_downloaded", "time_downloaded", "true", "m"), ("episodes", "episodes", "true", "f"),
    )
)
q("a20_bin_vectors", _DIM.format(p=PARENT, w=LIVE) + _VECTORS)(lambda spark, d: aggregates.bins(aggregates.live(_media(spark, d))))
q("a21_sampled_bins")(lambda spark, d: aggregates.sampled_bins(aggregates.live(_media(spark, d))))
q("o21_random_pick")(lambda spark, d: aggregates.live(_media(spark, d)).where("media_type in ('video', 'audio')").orderBy(F.rand(11)).limit(1).select("media_id", "path"))
q("d10_originals", _dup_sql("title, artist").replace("select f.keep_id, l.media_id as dup_id from", "select distinct f.keep_id from"))(lambda spark, d: similarity.duplicates(_media(spark, d), ["title", "artist"]).select("keep_id").distinct())
q("u16_shown_first_played", "select media_id, case when play_count > 1 then time_first_played end as time_first_played from media")(lambda spark, d: _media(spark, d).select("media_id", F.when(F.col("play_count") > 1, F.col("time_first_played")).alias("time_first_played")))
q("j06_long_audio", f"select media_id from media where {LIVE} and media_type = 'audio' and size >= 5000001 order by size desc, media_id limit 100")(
    lambda spark, d: spec.run(QuerySpec(types=["audio"], size=[">5MB"], limit=None), _media(spark, d)).where("media_type = 'audio'").orderBy(F.desc("size"), "media_id").limit(100).select("media_id")
)
q("s14_watch_later", "select media_id, length(path) as saved from media")(
    lambda spark, d: files.watch_later(_media(spark, d), _media(spark, d).select(F.md5("path").alias("name"), F.format_string("start=%d.5", F.length("path")).alias("value")).distinct()).select("media_id", F.col("saved").cast("bigint").alias("saved"))
)
q("s08_probe")(lambda spark, d: files.probe_columns(_media(spark, d).select("media_id", F.to_json(F.struct(F.struct(F.col("duration").cast("string").alias("duration"), F.col("size").cast("string").alias("size")).alias("format"), F.array(F.struct(F.lit("video").alias("codec_type"), F.col("video_codecs").alias("codec_name"), "width", "height")).alias("streams"))).alias("json")), "json"))


@q("r01_usage_by_hour", "select date_trunc('hour', ts) as start, count(*) as n from events group by 1")
def _(spark, d):
    batch = table(spark, d, "events")
    stream = history.incoming(spark, f"{d}/events.parquet", batch.schema).withColumn("at", F.col("ts").cast("timestamp"))
    return history.collected(history.usage_windows(stream, "at"), shared_folder(spark))


q("o18_disk_usage_page", f"with b as (select *, list_filter(str_split({P}, '/'), lambda x: x <> '') p from media where {LIVE} and starts_with({P}, '/srv/media/shows/')), l as (select '/srv/media/shows/' || p[4] as entry, len(p) = 4 as is_file, {SUMS} from b where len(p) > 3 group by 1, 2), f as (select *, row_number() over (partition by is_file order by total_size desc, entry) k, (select count(*) from l where not is_file) nf from l) select entry, is_file, n, total_size, total_duration from f where (not is_file and k <= 30) or (is_file and (nf >= 30 or k <= 30 - nf))")(
    lambda spark, d: aggregates.disk_usage_page(_media(spark, d), "/srv/media/shows", limit=30)
)
q("u13_deleted_by_search", f"select media_id from media where not coalesce(contains({LOW % 'path'}, 'scans'), false)")(lambda spark, d: changes.delete_found(_media(spark, d), strings.ascii_contains(F.col("path"), "scans")).select("media_id"))
q("u15_migrated", "select media_id, path, media_type, case when coalesce(description, '') = '' then case when coalesce(genre, '') = '' then null else 'mood: ' || genre end else description || case when coalesce(genre, '') = '' then '' else chr(10) || 'mood: ' || genre end end as description, cast(0 as bigint) as play_count from media")(
    lambda spark, d: changes.migrate_media(_media(spark, d).select("media_id", "path", F.col("media_type").alias("type"), "description", F.col("genre").alias("mood")), {"media_id": "bigint", "path": "string", "media_type": "string", "description": "string", "play_count": "bigint"})
)
q("j18_migrated_history", "select h.id, m.path as media_path, h.time_played from (select id, id as media_id, time_played from history) h left join media m on h.media_id = m.media_id")(
    lambda spark, d: changes.migrate_events(table(spark, d, "history").select("id", F.col("id").alias("media_id"), "time_played"), _media(spark, d).select(F.col("media_id").alias("id"), "path"))
)
q("d07_name_clusters")(lambda spark, d: similarity.cluster_names(_media(spark, d), "media_id", paths.stem(F.col("path"))))
q("d08_near_duplicates")(lambda spark, d: similarity.duplicates_only(similarity.cluster_names(_media(spark, d).where("trim(title) <> ''"), "media_id", F.col("title")), "media_id"))

q("x13_urls", "select media_id, path as back, regexp_replace(path, '^/srv/media/', '') as below from media")(
    lambda spark, d: _media(spark, d).select("media_id", paths.from_url(paths.to_url(F.col("path"))).alias("back"), paths.relative(F.col("path"), "/srv/media").alias("below"))
)
q("x03_trimmed_names", "select media_id, regexp_replace(regexp_replace(title, '^(The |A )', ''), ' Story$', '') as bare from media")(
    lambda spark, d: _media(spark, d).select("media_id", strings.remove_suffixes(F.when(F.col("title").startswith("The "), strings.remove_prefixes(F.col("title"), ["The "])).otherwise(strings.remove_prefixes(F.col("title"), ["A "])), [" Story"]).alias("bare"))
)
q("x03_unparagraphed", "select doc_id, case when text = '' then '' else array_to_string(list_transform(regexp_extract_all(text, '\\n+|[^\\n]+'), lambda x: case when x = chr(10) then ' ' else x end), '') end as plain from documents")(
    lambda spark, d: table(spark, d, "documents").select("doc_id", strings.unparagraphed(F.col("text")).alias("plain"))
)
q("x03_one_paragraph")(lambda spark, d: table(spark, d, "documents").select("doc_id", strings.one_paragraph(F.col("text")).alias("plain")))
