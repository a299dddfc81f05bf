"""Problem 7: one surviving record for each group of rows with the same content.

The row a record rests on is the most trusted one; its title is the record's. Around it, fields that
depend on each other are chosen as whole bundles: the naming (title and artist), the album with its
artist, the language, the file (size and duration). A branch-and-bound search over the bundles of a
group finds those that hold the most trust together while the dependencies hold: a title has the
artist and the language it was seen with, an album has one artist.

Bundles are counted and ranked before any group is put together, so what a group brings to the
search is bounded however many rows it has; where the bound on what was left out does not prove the
record the best, the group is searched again with more.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from reelbase.llm.languages import label
from reelbase.llm.mojibake import found_values, values
from reelbase.tables import cut, table

#: Bundles of one kind that a group brings to its first search.
MOST_TRUSTED = 24
#: When the data was taken; later times are not believed.
TAKEN = 1735689600

# Titles that stand in for one.
STAND_INS = (
    r"(?iU)^\W*$|^\W*(untitled|title|no[ _-]?title|unknown|unnamed|none|null|n/?a|tbd|todo|default|new (file|folder|recording|project|video|document)|recording|track|audio|video|image|photo|movie|clip|file|scan|document"
    r"|chapter|part|img|vid|dsc|dscn|mvi|mov|pxl|gopr|screenshot|capture|voice|memo)\W*([ _-]*(\d+|v\d+))*\W*$|^(IMG|VID|DSC|DSCN|DSCF|MVI|MOV|PXL|GOPR|GH|SAM|P|WA|AUD|REC)[_-]?\d[\d_-]*$"
)
CUT_OFF = r"(\.{2,}|…|\[\s*(\.{2,}|…)\s*\]|\(\s*(\.{2,}|…)\s*\))\s*$"


def digest(sha: Column) -> Column:
    """64 lower-case hex digits; null for what is no digest. One repeated digit is a placeholder."""
    bare = F.lower(F.regexp_replace(F.trim(F.regexp_replace(sha, r"[\s ]+", " ")), r"^(?i)sha-?(2-?)?256\s*[:=\s-]\s*", ""))
    return F.when(bare.rlike("^[0-9a-f]{64}$") & ~bare.rlike("^(.)\\1{63}$"), bare)


def plain_title(title: Column) -> Column:
    """Whether a title is present, no stand-in and not cut off."""
    return F.coalesce((F.trim(title) != "") & ~F.trim(title).rlike(STAND_INS) & ~title.rlike(CUT_OFF), F.lit(False))


def agree(naming: dict, other: dict, others: list[dict]) -> bool:
    """Whether a bundle keeps the dependencies beside a naming."""
    if other["kind"] == "language":  # title -> language, where the title was seen with any
        return other["own"] or not any(c["own"] for c in others)
    if other["kind"] == "album":  # album -> artist
        return naming["b"] is None or other["b"] is None or naming["b"] == other["b"]
    return True


def _best_first(bundles: list[dict]) -> list[dict]:
    return sorted(bundles, key=lambda c: (-c["trust"], c["a"] or "", c["b"] or ""))


def search(naming: list[dict], others: list[list[dict]]) -> tuple[int, dict | None, list[dict | None]]:
    """The most trust that a naming and at most one bundle of each other kind hold together while
    they agree, and these bundles.

    Namings are tried by their trust. A naming is not branched on if even the most trusted bundles,
    agreeing or not, could not lift it above the best record found; nor is what is left of a branch.
    """
    others = [_best_first(o) for o in others]
    ceiling = [sum(o[0]["trust"] for o in others[k:] if o) for k in range(len(others) + 1)]
    best, record = -1, (None, [None] * len(others))

    def branch(k: int, name: dict, trust: int, chosen: list[dict | None]) -> None:
        nonlocal best, record
        if trust + ceiling[k] <= best:
            return
        if k == len(others):
            best, record = trust, (name, chosen)
            return
        for c in others[k]:
            if trust + c["trust"] + ceiling[k + 1] <= best:
                break
            if agree(name, c, others[k]):
                branch(k + 1, name, trust + c["trust"], [*chosen, c])
        branch(k + 1, name, trust, [*chosen, None])

    for name in _best_first(naming):
        if name["trust"] + ceiling[0] <= best:
            break  # the bound: no later naming can win
        branch(0, name, name["trust"], [])
    return best, *record


_KINDS = ("naming", "language", "album", "file")
_RECORD = "sha256 string, media_id bigint, title string, artist string, album string, language string, size bigint, duration bigint, play_count bigint, time_modified bigint, n_rows bigint, proven boolean"


def _records(groups: DataFrame, most: int) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for g in pdf.to_dict("records"):
                by: dict[str, list[dict]] = {k: [] for k in _KINDS}
                for c in g["bundles"] if g["bundles"] is not None else ():
                    by[c["kind"]].append(c)
                kept = {k: _best_first(v)[:most] for k, v in by.items()}
                best, name, (language, album, file) = search(kept["naming"], [kept[k] for k in _KINDS[1:]])
                # no record with a bundle that was left out can hold more trust than this
                top = {k: v[0]["trust"] if v else 0 for k, v in kept.items()}
                left = [_best_first(v)[most]["trust"] + sum(top.values()) - top[k] for k, v in by.items() if len(v) > most]
                out.append((
                    g["d"], g["id"], g["title"], name and name["b"], album and album["a"], language and language["b"], file and file["a"], file and file["b"], g["plays"], g["seen"], g["n"], all(x <= best for x in left),
                ))
            names = [c.split()[0] for c in _RECORD.split(", ")]
            yield pd.DataFrame(out, columns=names).astype({c: "Int64" for c in ("time_modified", "size", "duration")})

    return groups.mapInPandas(run, _RECORD)


def survivors(df: DataFrame, garbled: DataFrame, taken: int = TAKEN, most: int = MOST_TRUSTED) -> DataFrame:
    """One record for each digest with at least two rows.

    ``df``: media rows; ``garbled``: ``row_id`` and ``field_name`` of those whose title or artist is
    garbled. Result: ``sha256``, ``media_id`` (the row it rests on), ``title`` (of that row),
    ``artist``, ``album``, ``language``, ``size``, ``duration`` (of the bundles with the most trust,
    that is rows times filled fields), ``play_count`` (the highest), ``time_modified`` (the latest
    believable) and ``n_rows``. The row is, among those with a usable title (all if there is none),
    the one with the latest believable ``time_modified``, then the highest ``play_count`` (null is
    0), then the smallest id. Digests that are null, blank or placeholders form no group; repeated
    rows count each. Missing bundles are null. ``most`` bounds what one search sees, never the result.
    """
    filled = lambda c: F.when(F.trim(c) != "", F.trim(c))
    wrong = garbled.groupBy(F.col("row_id").alias("id")).agg(F.max(F.col("field_name") == "title").alias("bad_title"), F.max(F.col("field_name") == "artist").alias("bad_artist"))
    have = lambda c, kind: F.col(c) if c in df.columns else F.lit(None).cast(kind)
    rows = df.select(
        digest(F.col("sha256")).alias("d"), F.col("media_id").cast("bigint").alias("id"), "title", F.coalesce("play_count", F.lit(0)).alias("plays"), label(have("language", "string")).alias("language"),
        F.when((F.col("time_modified") > 0) & (F.col("time_modified") < taken), F.col("time_modified")).alias("seen"), filled(have("artist", "string")).alias("artist"), filled(have("album", "string")).alias("album"),
        have("size", "bigint").alias("size"), have("duration", "bigint").alias("duration"),
    ).where("d is not null").join(wrong, "id", "left")
    usable = plain_title(F.col("title")) & ~F.coalesce("bad_title", F.lit(False))
    rows = rows.withColumn("artist", F.when(~F.coalesce("bad_artist", F.lit(False)), F.col("artist")))
    trust = F.struct(usable.cast("int").alias("u"), F.coalesce("seen", F.lit(-1)).alias("m"), F.col("plays").alias("p"), (-F.col("id")).alias("i"))
    heads = cut(
        rows.groupBy("d").agg(F.max(F.struct(trust.alias("trust"), F.col("title").alias("title"))).alias("root"), F.max("seen").alias("seen"), F.max("plays").alias("plays"), F.count("*").alias("n"))
        .where("n >= 2").select("d", (-F.col("root.trust.i")).alias("id"), "root.title", "seen", "plays", "n")
    )
    own = F.lower(F.trim("title")).eqNullSafe(F.lower(F.trim("rooted")))
    bundle = lambda kind, a, b, own_=F.lit(False), when=F.lit(True): F.when(when, F.struct(F.lit(kind).alias("kind"), a.cast("string").alias("a"), b.cast("string").alias("b"), own_.alias("own")))
    text, none = F.lit(None).cast("string"), F.col
    each = F.array_compact(F.array(
        bundle("naming", F.when(own, F.lower(F.trim("title"))), none("artist"), when=own), bundle("language", text, none("language"), own, none("language").isNotNull()),
        bundle("album", none("album"), none("artist"), when=none("album").isNotNull()), bundle("file", none("size"), none("duration"), when=F.coalesce("size", "duration").isNotNull()),
    ))
    counted = rows.join(heads.select("d", F.col("title").alias("rooted")), "d").select("d", F.explode(each).alias("c")).groupBy("d", "c").agg(F.count("*").alias("n"))
    filled_n = F.col("c.a").isNotNull().cast("int") + F.col("c.b").isNotNull().cast("int")
    counted = cut(counted.select("d", "c.*", (F.col("n") * F.when(F.col("c.kind") == "language", 1).otherwise(filled_n)).alias("trust")))
    done, most_now, todo = [], most, heads
    while True:
        first = W.partitionBy("d", "kind").orderBy(F.desc("trust"), F.col("a").asc_nulls_first(), F.col("b").asc_nulls_first())
        these = counted if todo is heads else counted.join(todo.select("d"), "d", "left_semi")
        kept = these.withColumn("k", F.row_number().over(first)).where(F.col("k") <= most_now + 1).groupBy("d").agg(F.collect_list(F.struct("kind", "a", "b", "own", "trust")).alias("bundles"))
        found = cut(_records(todo.join(kept, "d", "left"), most_now))
        done.append(found.where("proven"))
        open_ = found.where("not proven").select(F.col("sha256").alias("d"))
        if open_.isEmpty():
            break
        todo, most_now = heads.join(open_, "d", "left_semi"), most_now * 16
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.drop("proven")


def p7_survivors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The record of every group of media rows with the same content."""
    garbled = found_values(values(spark, sf_dir)).where("table_name = 'media'").select("row_id", "field_name")
    return survivors(table(spark, sf_dir, "media"), cut(garbled))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digest and the surviving row."""
    return p7_survivors(spark, sf_dir).select("sha256", "media_id")


QUERIES = {"p7_found": p7_found, "p7_survivors": p7_survivors}
