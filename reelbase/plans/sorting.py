"""The sort language: names of fields, directions, presets and weighted re-ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelbase.functions import media, paths, ranking

NUMERIC = (
    "video_count", "audio_count", "subtitle_count", "play_count", "playhead", "time_last_played", "time_first_played", "time_created", "time_modified", "time_downloaded",
    "time_deleted", "duration", "size", "width", "height", "fps", "score", "track_number",
)
ZERO_LAST = ("progress", "bitrate", "play_count", "time_last_played", "duration")

# The named orders.
PRESETS = {
    "default": "-video_count,-audio_count,path_is_remote,-subtitle_count,play_count,-playhead,time_last_played,title_is_null,path",
    "du": "-size_per_count,-size,-count,-folders,-path",
}


def field(name: str) -> Column:
    """The value a row is sorted by; numbers count null as 0, text as ''."""
    c = F.col
    made = {
        "parent": lambda: paths.parent(c("path")),
        "stem": lambda: paths.stem(c("path")),
        "ps": lambda: F.concat_ws(" ", paths.parent(c("path")), paths.stem(c("path"))),
        "pts": lambda: F.concat_ws(" ", paths.parent(c("path")), F.coalesce(c("title"), F.lit("")), paths.stem(c("path"))),
        "extension": lambda: paths.extension(c("path")),
        "progress": lambda: F.coalesce(media.progress(c("playhead"), c("duration")), F.lit(0.0)),
        "bitrate": lambda: F.coalesce(media.bitrate(c("size"), c("duration")), F.lit(0)),
        "path_is_remote": lambda: paths.is_remote(c("path")).cast("int"),
        "title_is_null": lambda: F.coalesce(F.trim(c("title")) == "", F.lit(True)).cast("int"),
        "size_per_count": lambda: F.try_divide(c("size"), F.coalesce(c("count"), F.lit(1))),
        "natural_path": lambda: paths.natural_key(c("path")),
        "month_created": lambda: F.date_format(media.at(c("time_created")), "yyyyMM").cast("int"),
        "date_created": lambda: F.date_format(media.at(c("time_created")), "yyyyMMdd").cast("int"),
        "month_modified": lambda: F.date_format(media.at(c("time_modified")), "yyyyMM").cast("int"),
    }
    if name in made:
        return made[name]()
    return F.coalesce(c(name), F.lit(0)) if name in NUMERIC or name in ("count", "folders") else F.coalesce(c(name), F.lit(""))


def parse(config: str) -> list[tuple[str, bool]]:
    """(field, descending) of 'size desc,-title,reverse_path,default'; presets are spelled out."""
    out: list[tuple[str, bool]] = []
    for raw in config.split(","):
        name, down = raw.strip(), False
        if not name or name.startswith("_"):
            continue
        if name.lower().endswith((" desc", " asc")):
            name, down = name.rsplit(" ", 1)[0].strip(), name.lower().endswith(" desc")
        while name.startswith(("-", "reverse_")):
            name, down = name.removeprefix("-") if name[0] == "-" else name.removeprefix("reverse_"), not down
        if name in PRESETS:
            out += [(f, d != down) for f, d in parse(PRESETS[name])]
        else:
            out.append((name, down))
    return out


def order(config: str, tie: str = "path") -> list[Column]:
    """Sort columns of a configuration: zeros of some fields last, ties by path (then by row)."""
    out: list[Column] = []
    for name, down in parse(config):
        value = field(name)
        if name in ZERO_LAST:
            out.append((value == 0).asc())
        out.append(value.desc_nulls_last() if down else value.asc_nulls_first())
    return [*out, F.col(tie).asc_nulls_first()]


def groups(config: str) -> list[Column]:
    """Several configurations parted by '|', each a stable re-sort of the one before: the last is
    the first key."""
    parts = [p for p in config.split("|") if p.strip()]
    out: list[Column] = []
    for p in reversed(parts):
        out += order(p)[:-1]
    return [*out, F.col("path").asc_nulls_first()]


MARKERS = {"_weighted_rerank": "weighted", "_natural_order": "natural", "_related_media": "related"}


def marked_groups(config: str) -> list[tuple[str, list[tuple[str, bool]]]]:
    """(how, fields) of a configuration with markers: each begins a group of the fields below it.

    Groups are applied one after the other, each a stable sort of what the one before gave. Related
    media are found before any sorting; their group sorts as a natural one does.
    """
    out: list[tuple[str, list[tuple[str, bool]]]] = [("natural", [])]
    for raw in config.split(","):
        if raw.strip() in MARKERS:
            out.append((MARKERS[raw.strip()], []))
        else:
            out[-1][1].extend(parse(raw))
    return [g for g in out if g[1]] or [("natural", [("ps", False)])]


def arrange(df: DataFrame, config: str, id_: str = "media_id") -> DataFrame:
    """``id_`` and ``rn``: rows numbered as a configuration with markers orders them.

    The last group is the first key and earlier ones break its ties; ties of all go by path and id.
    A weighted group is one key: the rank score of its fields.
    """
    keys: list[Column] = []
    for k, (how, fields) in enumerate(reversed(marked_groups(config))):
        if how == "weighted":
            scored = weighted_rerank(df, [f"-{f}" if down else f for f, down in fields], id_).withColumnRenamed("rank_score", f"__g{k}")
            df = df.join(scored, id_)
            keys.append(F.round(F.col(f"__g{k}"), 9).desc())  # sums may differ in their last digits
        else:
            for name, down in fields:
                value = natural(name) if name not in NUMERIC else field(name)
                keys += [(field(name) == 0).asc()] if name in ZERO_LAST else []
                keys.append(value.desc() if down else value.asc())
    return ranking.number(df, [*keys, F.col("path").asc_nulls_first(), F.col(id_).asc()], keep=[id_])


def natural(name: str) -> Column:
    """A field as the natural order compares it: texts by their numbers and letters."""
    value = field(name)
    made = ("progress", "bitrate", "path_is_remote", "title_is_null", "size_per_count", "count", "folders", "natural_path", "month_created", "date_created", "month_modified")
    return value if name in made else paths.natural_key(value)


def choose(sort_by: str = "", play_in_order: str = "", no_play_in_order: bool = False, shuffled: bool = False, reverse: bool = False, natural_sort: bool = False) -> tuple[str, str]:
    """(kind, configuration) of what a request asks for, by precedence: 'random'; 'basic' without
    play order or by a named field; 'advanced' by 'default', by a play order, or where nothing is
    asked for; 'basic' by path where it is to be reversed or natural."""
    back = "reverse_" if reverse else ""
    if shuffled:
        return "random", ""
    if no_play_in_order or sort_by not in ("", "path", "default"):
        return "basic", back + (sort_by or "path")
    if sort_by == "default":
        return "advanced", back + "default"
    if play_in_order:
        return "advanced", back + play_in_order
    if reverse or natural_sort:
        return "basic", back + ("natural_path" if natural_sort else "path")
    return "advanced", "default"


def history_order(partial: str, reverse: bool = False) -> Column:
    """History by when it was first ('f') or last played (first where never since), or by progress:
    'p' the share played, 't' the time left (least first), 'pt' both; unknown progress is lowest."""
    none = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("double")
    head, length = none("playhead"), none("duration")
    left = length - head
    if "f" in partial:
        value = none("time_first_played")
    elif "p" in partial or "t" in partial:
        made = length / head * -left if "p" in partial and "t" in partial else -left if "t" in partial else head / length
        value = F.when((head > 0) & (length > 0), made).otherwise(F.lit(-1.7976931348623157e308))
    else:
        value = F.when(none("time_last_played") != 0, none("time_last_played")).otherwise(none("time_first_played"))
    return value.desc() if reverse else value.asc()


FOLDER_ORDERS = ("count", "size", "duration", "priority", "path")


def folder_order(by: str, reverse: bool = False) -> list[Column]:
    """Folders (``parent``, ``file_count``, ``total_size``, ``total_duration``) by count, size,
    duration, priority (size for each file, then size) or path; ties by path."""
    c = F.col
    values = {
        "count": [c("file_count")], "size": [c("total_size")], "duration": [c("total_duration")], "priority": [F.try_divide(c("total_size"), c("file_count")), c("total_size")], "path": [c("parent")],
    }[by]
    return [*[v.desc() if reverse else v.asc() for v in values], c("parent").asc()]


def simple_order(method: str, reverse: bool = False, natural_sort: bool = False) -> list[Column]:
    """One named field, text by its natural order if asked for; ties by path."""
    value = natural(method) if natural_sort and method not in NUMERIC else field(method)
    return [value.desc() if reverse else value.asc(), F.col("path").asc_nulls_first()]


def rerank(df: DataFrame, weights: dict[str, float], id_: str = "media_id") -> DataFrame:
    """``id_`` and ``rank_score``: the weighted sum of each row's position by each field ('-' for
    descending). Only ids and one field at a time are sorted."""
    parts = [_positions(df, name, id_).select(id_, ((F.col("__r") - 1) * F.lit(float(weight))).alias("s")) for name, weight in weights.items()]
    return _added(parts, id_)


def weighted_rerank(df: DataFrame, fields: list[str], id_: str = "media_id") -> DataFrame:
    """``id_`` and ``rank_score``: each field's normalised rank (1 best) weighted by 1 over its place
    in the list."""
    share = 1 - (F.col("__r") - 1) / F.greatest(F.col("__t") - 1, F.lit(1)).cast("double")
    return _added([_positions(df, name, id_).select(id_, (share / (k + 1)).alias("s")) for k, name in enumerate(fields)], id_)


def _positions(df: DataFrame, name: str, id_: str) -> DataFrame:
    value = field(name.lstrip("-"))
    return ranking.number(df, [value.desc() if name[0] == "-" else value.asc(), F.col(id_).asc()], "__r", [id_], "__t")


def _added(parts: list[DataFrame], id_: str) -> DataFrame:
    all_ = parts[0]
    for p in parts[1:]:
        all_ = all_.unionByName(p)
    return all_.groupBy(id_).agg(F.sum("s").alias("rank_score"))
