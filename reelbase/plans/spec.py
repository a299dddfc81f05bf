"""One declarative query over media and the lazy plan that answers it.

``QuerySpec`` says what is wanted; ``predicate`` compiles its filters to one Column, so that the
optimiser pushes down whatever it can, and ``run`` adds sorting and paging.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelbase.functions import paths, strings
from reelbase.functions.parsers import Range, any_of, human_to_bytes, human_to_seconds, parse_date, parse_percentiles, parse_range, plain_terms, search_terms
from reelbase.plans import sorting

INDEXED = ("path", "path_tokenized", "title", "description")
TIMES = {"created": "time_created", "modified": "time_modified", "downloaded": "time_downloaded", "deleted": "time_deleted", "played": "time_last_played"}


@dataclass
class QuerySpec:
    """Filters are ANDed; empty ones do not apply. ``strict`` adds the second, literal pass over
    includes, excludes and extensions that command-line queries make."""

    hide_deleted: bool = True
    only_deleted: bool = False
    types: list[str] = field(default_factory=list)
    genre: str = ""
    language: list[str] = field(default_factory=list)
    dbs: list[str] = field(default_factory=list)
    paths: list[str] = field(default_factory=list)
    play_count_min: int = 0
    play_count_max: int = 0
    size: list[str] = field(default_factory=list)
    duration: list[str] = field(default_factory=list)
    after: dict[str, str] = field(default_factory=dict)
    before: dict[str, str] = field(default_factory=dict)
    watched: bool | None = None
    unfinished: bool = False
    partial: str = ""
    completed: bool = False
    online: bool = False
    local: bool = False
    ext: list[str] = field(default_factory=list)
    category: list[str] = field(default_factory=list)
    search: list[str] = field(default_factory=list)
    flexible: bool = False
    exact: bool = False
    fts: bool = False
    no_fts: bool = False
    unplayed: bool = False
    playable: str | None = None
    modified: list[str] = field(default_factory=list)
    created: list[str] = field(default_factory=list)
    downloaded: list[str] = field(default_factory=list)
    exclude: list[str] = field(default_factory=list)
    regex: str = ""
    path_contains: list[str] = field(default_factory=list)
    portrait: bool = False
    ratings: list[int] = field(default_factory=list)
    score_min: float | None = None
    score_max: float | None = None
    where: list[str] = field(default_factory=list)
    with_captions: bool = False
    duration_from_size: list[str] = field(default_factory=list)
    file_counts: str = ""
    include: list[str] = field(default_factory=list)
    strict: bool = False
    sort: str = ""
    play_in_order: str = ""
    no_play_in_order: bool = False
    reverse: bool = False
    natural_sort: bool = False
    shuffled: bool = False
    group_by_parent: bool = False
    limit: int | None = 100
    offset: int = 0
    now: int | None = None


#: Fields whose ranges may be given in percentiles, in the order these are resolved, and their units.
PERCENTILES = {"size": human_to_bytes, "duration": human_to_seconds, "modified": int, "created": int, "downloaded": int}


def ranges(column: Column, texts: list[str], unit) -> Column:
    """All ranges of a list; what cannot be parsed is ignored, percentiles are resolved elsewhere."""
    out = F.lit(True)
    for t in texts:
        if parse_percentiles(t):
            continue
        try:
            out = out & parse_range(t, unit).matches(column)
        except ValueError:
            continue
    return out


def fts(terms: list[str], phrases: list[str], loose: bool = True) -> Column:
    """Full-text match over the indexed columns: loose takes each term's first three bytes, and
    any term; otherwise all terms in full, each in any column. Phrases must occur as they are."""
    cols, terms = [F.lower(F.coalesce(c, F.lit(""))) for c in INDEXED], plain_terms(terms)
    hit = lambda t: any_of([c.contains(t.lower()) for c in cols])
    out = F.lit(True)
    if terms and loose:
        out = any_of([hit(t.encode()[:3].decode("utf-8", "ignore")) for t in terms])
    elif terms:
        for t in terms:
            out = out & hit(t)
    for p in phrases:
        out = out & any_of([strings.ascii_contains(F.col(c), p) for c in ("path", "title", "description")])
    return out


def predicate(q: QuerySpec) -> Column:
    """All row-wise filters of a query as one Column (three-valued, as in SQL)."""
    c = F.col
    zero = lambda name: F.coalesce(c(name), F.lit(0))
    out: list[Column] = []
    if q.only_deleted:
        out.append(zero("time_deleted") > 0)
    elif q.hide_deleted:
        out.append(zero("time_deleted") == 0)
    if q.types:
        out.append(c("media_type").isin(sorted({t for x in q.types for t in ((x, "audiobook") if x == "audio" else (x,))})))
    if q.genre:
        out.append(c("genre") == q.genre)
    if q.language:
        out.append(c("language").isin(q.language))
    if q.dbs:
        out.append(c("db").isin(q.dbs))
    exact = [p for p in q.paths if "%" not in p]
    if exact:
        out.append(c("path").isin(exact))
    out += [strings.ascii_like(c("path"), p) for p in q.paths if "%" in p]
    if q.play_count_min > 0:
        out.append(c("play_count") >= q.play_count_min)
    if q.play_count_max > 0:
        out.append(c("play_count") <= q.play_count_max)
    out.append(ranges(c("size"), q.size, human_to_bytes))
    out.append(ranges(c("duration"), q.duration, human_to_seconds))
    out += [c(TIMES[k]) >= parse_date(v, q.now) for k, v in q.after.items()]
    out += [c(TIMES[k]) <= parse_date(v, q.now) for k, v in q.before.items()]
    if q.watched is not None:
        out.append(c("time_last_played") > 0 if q.watched else zero("time_last_played") == 0)
    if q.unfinished:
        out.append(zero("playhead") > 0)
    if q.partial:
        out.append(zero("time_first_played") == 0 if "s" in q.partial else c("time_first_played") > 0)
    if q.completed:
        out.append(zero("play_count") > 0)
    if q.unplayed:
        out.append((zero("play_count") == 0) & (zero("playhead") == 0))
    if q.playable is not None:
        out.append(playable(c("media_type"), q.playable))
    for name in ("modified", "created", "downloaded"):
        out.append(ranges(c(f"time_{name}"), [t for t in getattr(q, name) if t[:1] not in "+-"], int))
    if q.online:
        out.append(paths.is_remote(c("path")))
    if q.local:
        out.append(~paths.is_remote(c("path")))
    if q.ext:
        out.append(any_of([strings.ascii_lower(c("path")).endswith("." + e.lstrip(".").lower()) for e in q.ext]))
    if q.category:
        blank = c("categories").isNull() | (c("categories") == "")
        out.append(any_of([blank if k == "Uncategorized" else c("categories").contains(f";{k};") for k in q.category]))
    terms, contains = [], list(q.path_contains)
    for s in [*q.search]:
        if s.startswith("./") or s.startswith("/"):
            contains.append(s[2:] if s.startswith("./") else s)
        else:
            terms.append(s)
    if search_mode(q) == "fts" and terms:
        out.append(fts(*search_terms(" ".join(terms)), loose=not q.exact))
    elif terms:
        def one(t: str) -> Column:
            if q.exact:
                return strings.ascii_like(c("path"), f"%/{t}.%") | strings.ascii_like(c("path"), f"%/{t}")
            return any_of([F.coalesce(strings.ascii_contains(c(k), t), F.lit(False)) for k in ("path", "title", "path_tokenized")])

        hit = one(terms[0])
        for t in terms[1:]:
            hit = hit | one(t) if q.flexible else hit & one(t)
        out.append(hit)
    for t in q.exclude:  # a null title makes the row drop out, as it does in the catalogues
        out += [~strings.ascii_contains(c("path"), t), ~strings.ascii_contains(c("title"), t)]
    if q.regex:
        out.append(c("path").rlike(q.regex))
    out += [strings.ascii_contains(c("path"), t) for t in contains]
    if q.portrait:
        out.append(c("width") < c("height"))
    if q.ratings:
        out.append(any_of([(c("score").isNull() | (c("score") == 0)) if r == 0 else c("score") == r for r in q.ratings]))
    if q.score_min is not None:
        out.append(c("score") >= q.score_min)
    if q.score_max is not None:
        out.append(c("score") <= q.score_max)
    out += [F.expr(w) for w in q.where]
    if q.strict:
        if q.include:
            out.append(any_of([strings.glob_or_like(c("path"), p) for p in q.include]))
        out += [~strings.glob_or_like(c("path"), p) for p in q.exclude]
        out += [c("path").contains(t) for t in contains]
        if q.ext:
            out.append(paths.extension(c("path")).isin(["." + e.lstrip(".").lower() for e in q.ext]))
    both = F.lit(True)
    for p in out:
        both = both & p
    return both


def search_mode(q: QuerySpec) -> str:
    """'fts' where it is asked for and not ruled out, else 'substring'."""
    return "fts" if q.fts and not q.no_fts else "substring"


def playable(media_type: Column, kind: str = "") -> Column:
    """Rows of a kind, by default those that play: video, audio, audiobooks."""
    if kind:
        return F.coalesce(media_type.startswith(kind), F.lit(False))
    return F.coalesce(media_type.startswith("video") | media_type.startswith("audio"), F.lit(False))


def existing(df: DataFrame, files: DataFrame) -> DataFrame:
    """Rows whose path is in a listing of files."""
    return df.join(files.select("path").distinct(), "path", "left_semi")


def known_databases(q: QuerySpec, known: list[str]) -> QuerySpec:
    """The query over the catalogues it names; an unknown one is an error."""
    unknown = [d for d in q.dbs if d not in known]
    if unknown:
        raise ValueError(f"unknown catalogue: {', '.join(unknown)}")
    return q


def resolve_percentiles(q: QuerySpec, media: DataFrame) -> QuerySpec:
    """Percentile ranges ('p10-50') made absolute, field after field.

    Each takes its points from the rows of all other filters, those of the fields before it
    included; folder counts come last. The two bounds of a field are all that reaches the driver.
    """
    from reelbase.operators.aggregates import percentiles

    def absolute(text: str, rows: DataFrame, column: str) -> str:
        pair = parse_percentiles(text)
        if not pair:
            return text
        points = percentiles(rows, column).where(F.col("pct").isin([int(p) for p in pair])).agg(F.min("value").alias("a"), F.max("value").alias("z")).collect()[0]
        return text if points["a"] is None else f"+{int(points['a'])},-{int(points['z'])}"

    for name in PERCENTILES:
        texts = getattr(q, name)
        if any(map(parse_percentiles, texts)):
            column = name if name in ("size", "duration") else f"time_{name}"
            rows = media.where(predicate(q)).select(column)
            new = [absolute(t, rows, column) for t in texts]
            q = replace(q, **({name: new} if name in ("size", "duration") else {name: [t for t in new if t[:1] != "+"], "where": [*q.where, *[f"{column} between {t[1:].replace(',-', ' and ')}" for t in new if t[:1] == "+"]]}))
    if parse_percentiles(q.file_counts):
        counts = media.where(predicate(q)).groupBy(paths.parent(F.col("path"))).agg(F.count("*").alias("episodes"))
        q = replace(q, file_counts=absolute(q.file_counts, counts, "episodes"))
    return q


def from_parameters(given: dict[str, list[str]]) -> QuerySpec:
    """The query that a request's parameters ask for (each a list of values).

    Sizes are in MB and durations in minutes; '+x' and '-x' times are bounds; sort fields are a JSON
    list or parted by commas. Numbers that are none are passed over.
    """
    one = lambda k: next(iter(given.get(k, [])), "")
    on = lambda k: one(k) == "true"
    number = lambda t: int(t) if re.fullmatch(r"[+-]?\d+", t) else None
    q = QuerySpec(search=one("search").split(), fts=one("search_type") == "fts", category=given.get("category", []), genre=one("genre"), language=given.get("language", []), dbs=given.get("db", []))
    q.paths = one("paths").split(",") if one("paths") else []
    q.ratings = [r for t in given.get("rating", []) if (r := number(t)) is not None]
    q.score_min, q.score_max = (float(one(k)) if one(k) else None for k in ("min_score", "max_score"))
    q.unplayed, q.with_captions = on("unplayed"), on("captions") or one("view") == "captions"
    q.sort, q.shuffled, q.reverse = one("sort"), one("sort") == "random", on("reverse")
    fields = one("sort_fields")
    if fields:
        try:
            q.play_in_order = ",".join(json.loads(fields)) if fields[0] == "[" else fields
        except ValueError:
            q.play_in_order = ""
    if one("sort_desc") and q.play_in_order:
        down = {f.strip() for f in one("sort_desc").split(",")}
        bare = [f.strip().removeprefix("-").removesuffix(" desc").removesuffix(" asc") for f in q.play_in_order.split(",")]
        q.play_in_order = ",".join(f"-{f}" if f in down else f for f in bare)
    limit, offset = number(one("limit")), number(one("offset"))
    q.limit, q.offset = (None if on("all") else q.limit if limit is None else limit), offset or 0
    bound = lambda k, unit: [f"{sign}{one(f'{end}_{k}')}{unit}" for end, sign in (("min", ">"), ("max", "<")) if one(f"{end}_{k}")] + given.get(k, [])
    q.size, q.duration = bound("size", "MB"), bound("duration", "min")
    for k in ("modified", "created", "downloaded"):
        setattr(q, k, [t for t in given.get(k, []) if t[:1] not in "+-"])
        for end, side in ((f"min_{k}", q.after), (f"max_{k}", q.before)):
            if one(end):
                side[k] = one(end)
        for part in (p for t in given.get(k, []) for p in t.split(",") if p[:1] in "+-"):
            (q.after if part[0] == "+" else q.before)[k] = part[1:]
    asked = given.get("media_type") or given.get("type") or []
    q.types = [t for t in ("video", "audio", "image", "text") if t in asked or on(t)]
    q.watched, q.unfinished, q.completed = True if on("watched") else None, on("unfinished"), on("completed")
    q.only_deleted, q.file_counts, q.group_by_parent = on("trash"), ",".join(given.get("episodes", [])), one("group_by") == "parent"
    return q


# Queries that have a name of their own; a null time of deletion is not 0.
NAMED = {
    "by_type": "time_deleted = 0 and media_type = :value", "by_size": "time_deleted = 0 and size >= :low and size <= :high", "by_duration": "time_deleted = 0 and duration >= :low and duration <= :high",
    "by_play_count": "time_deleted = 0 and play_count >= :low and play_count <= :high", "by_path": "time_deleted = 0 and path like :value", "watched": "time_deleted = 0 and time_last_played > 0",
    "unwatched": "time_deleted = 0 and coalesce(time_last_played, 0) = 0", "unfinished": "time_deleted = 0 and playhead > 0 and playhead < 0.95 * duration",
}


def named(df: DataFrame, name: str, **values) -> DataFrame:
    """The rows of a named query; ``value``, ``low`` and ``high`` as it needs them."""
    return df.sparkSession.sql(f"select * from {{df}} where {NAMED[name]}", args=values, df=df) if values else df.where(NAMED[name])


def bindings(include: list[str], exclude: list[str], columns: list[str], exact: bool = False) -> tuple[str, dict[str, str]]:
    """A condition over named columns and its named values: every included term in some column, no
    excluded one in any."""
    made = {f"include{k}": t if exact else f"%{t}%" for k, t in enumerate(include)} | {f"exclude{k}": t if exact else f"%{t}%" for k, t in enumerate(exclude)}
    have = [" or ".join(f"{c} like :include{k}" for c in columns) for k in range(len(include))]
    none = [" and ".join(f"coalesce({c}, '') not like :exclude{k}" for c in columns) for k in range(len(exclude))]
    return " and ".join(f"({x})" for x in [*have, *none]), made


def run(q: QuerySpec, media: DataFrame, captions: DataFrame | None = None) -> DataFrame:
    """The plan of a query: filters, semi-joins, folder counts, then sorting and paging."""
    q = resolve_percentiles(q, media)
    df = media.where(predicate(q))
    if q.with_captions:
        df = df.join(captions.select(F.col("media_path").alias("path")).distinct(), "path", "left_semi")
    if q.duration_from_size:
        lengths = media.where(ranges(F.col("size"), q.duration_from_size, human_to_bytes)).select("duration").distinct()
        df = df.join(lengths, "duration", "left_semi")
    if q.file_counts:
        df = folder_counts(df, parse_range(q.file_counts))
    if q.sort:
        df = df.orderBy(*sorting.order(q.sort))
    if q.offset:
        df = df.offset(q.offset)
    return df if q.limit is None else df.limit(q.limit)


def folder_counts(df: DataFrame, wanted: Range) -> DataFrame:
    """Rows whose folder holds a wanted number of rows: counted first, then joined back, so that
    no folder is one task."""
    with_parent = df.withColumn("__parent", paths.parent(F.col("path")))
    kept = with_parent.groupBy("__parent").count().where(wanted.matches(F.col("count"))).select("__parent")
    return with_parent.join(kept, "__parent", "left_semi").drop("__parent")
