"""Search: relevance, captions in context, related media, generic tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from reelbase.functions import ranking, strings
from reelbase.functions.parsers import any_of, plain_terms, search_terms
from reelbase.plans.spec import fts


def relevance(df: DataFrame, query: str) -> DataFrame:
    """``score``: ten for each occurrence in the title, five in the path, one in the description, and five for a title that has it."""
    t, p, d = (strings.occurrences(F.col(c), query) for c in ("title", "path", "description"))
    return df.withColumn("score_rank", (t * 10 + p * 5 + d + F.when(t > 0, 5).otherwise(0)).cast("bigint"))


def bm25(df: DataFrame, terms: list[str], k1: float = 1.2) -> DataFrame:
    """``bm25``: inverse document frequency times damped occurrences over the indexed columns."""
    text = F.concat_ws(" ", "path", "title", "description")
    counted = df
    for k, t in enumerate(terms):
        counted = counted.withColumn(f"__n{k}", strings.occurrences(text, t))
    stats = counted.agg(F.count("*").alias("__all"), *[F.count_if(F.col(f"__n{k}") > 0).alias(f"__df{k}") for k in range(len(terms))])
    score = F.lit(0.0)
    for k in range(len(terms)):
        idf = F.log(1 + (F.col("__all") - F.col(f"__df{k}") + 0.5) / (F.col(f"__df{k}") + 0.5))
        score = score + idf * F.col(f"__n{k}") * (k1 + 1) / (F.col(f"__n{k}") + k1)
    return counted.crossJoin(F.broadcast(stats)).withColumn("bm25", score).drop("__all", *[f"__{x}{k}" for k in range(len(terms)) for x in ("n", "df")])


def search_media(df: DataFrame, query: str, loose: bool = True) -> DataFrame:
    """Rows not deleted that match a query, with their relevance."""
    terms, phrases = search_terms(query)
    return relevance(df.where(F.coalesce("time_deleted", F.lit(0)) == 0).where(fts(terms, phrases, loose)), query)


def top_media(df: DataFrame, query: str, limit: int = 100) -> DataFrame:
    """The best matches, by relevance and then path (a top list)."""
    return search_media(df, query).orderBy(F.desc("score_rank"), "path", "media_id").limit(limit)


def captioned_media(captions: DataFrame, media: DataFrame, types: list[str] | None = None) -> DataFrame:
    """Captions with a text and their media (once a path), of some types where named."""
    alive = media.where(F.coalesce("time_deleted", F.lit(0)) == 0)
    if types:
        alive = alive.where(F.col("media_type").isin(types))
    items = alive.groupBy(F.col("path").alias("media_path")).agg(F.max("title").alias("title"), F.max("media_type").alias("media_type"))
    return captions.where("text <> ''").join(items, "media_path")


def best_captions(captions: DataFrame, media: DataFrame, terms: list[str]) -> DataFrame:
    """Media rows with the text of their first caption that holds one of the terms; null without."""
    hits = captions.where(any_of([F.lower("text").contains(t.lower()) for t in terms]))
    first = hits.groupBy("media_path").agg(F.min_by("text", F.struct(F.col("time").isNull(), F.col("time"), F.col("caption_id"))).alias("text"))
    return media.join(first, F.col("path") == F.col("media_path"), "left").drop("media_path")


def search_captions(captions: DataFrame, media: DataFrame, query: str, types: list[str] | None = None) -> DataFrame:
    """Captions that hold all terms, with their media and relevance; media match once a path."""
    terms, _ = search_terms(query)
    hit = F.lit(True)
    for t in plain_terms(terms):
        hit = hit & F.lower(F.col("text")).contains(t.lower())
    alive = media.where(F.coalesce("time_deleted", F.lit(0)) == 0)
    if types:
        alive = alive.where(F.col("media_type").isin(types))
    items = alive.groupBy(F.col("path").alias("media_path")).agg(F.max("title").alias("title"), F.max("media_type").alias("media_type"))
    found = captions.where(hit).join(items, "media_path")
    n, t = strings.occurrences(F.col("text"), query), strings.occurrences(F.col("title"), query)
    return found.withColumn("score_rank", (n * 10 + t * 5 + F.when(n > 0, 5).otherwise(0)).cast("bigint"))


def caption_context(captions: DataFrame, query: str, around: int = 2) -> DataFrame:
    """Matching captions and up to ``around`` before and after each, every caption once.

    Captions are numbered over the whole table by path and time; neighbours are those of nearby
    numbers and the same path, so a path of any length is many tasks. Rows without a time or text
    stand outside.
    """
    base = captions.where("time is not null and text is not null")
    at = ranking.number(base.select("caption_id", "media_path", "time", F.lower("text").contains(query.lower()).alias("hit")), [F.col("media_path"), F.col("time"), F.col("caption_id")], "n", ["caption_id", "media_path", "hit"])
    near = at.where("hit").select(F.col("media_path").alias("p"), F.explode(F.sequence(F.col("n") - around, F.col("n") + around)).alias("n")).distinct()
    keep = at.join(near, "n").where(F.col("media_path").eqNullSafe(F.col("p"))).select("caption_id").distinct()
    return base.select("caption_id", "media_path", "time", "text").join(keep, "caption_id", "left_semi")


def merge_captions(df: DataFrame, gap: float = 8.0) -> DataFrame:
    """Captions of one path that follow within ``gap`` seconds as one: start, end, text.

    The end is the start plus the time its bytes take to read; a text already contained is not
    repeated. The fold depends on the order (time, id); it runs on stretches of a path that no
    caption can join across, found by running maxima within time blocks and over blocks. A stretch
    without such a gap is folded as a whole, since its result is one row.
    """
    import pandas as pd

    t = F.coalesce("time", F.lit(0.0))
    end = t + F.octet_length(F.coalesce("text", F.lit(""))) / 4.2 / 220 * 60
    rows = df.select("media_path", "caption_id", t.alias("t"), end.alias("e"), F.coalesce("text", F.lit("")).alias("x")).withColumn("b", F.floor(F.col("t") / 600.0))
    over = W.partitionBy("media_path").orderBy("b")
    ends = rows.groupBy("media_path", "b").agg(F.max("e").alias("m")).withColumn("m", F.max("m").over(over.rowsBetween(W.unboundedPreceding, -1)))
    w = W.partitionBy("media_path", "b").orderBy("t", "caption_id")
    far = F.greatest(F.max("e").over(w.rowsBetween(W.unboundedPreceding, -1)), F.col("m"))
    marked = rows.join(ends, ["media_path", "b"]).withColumn("new", F.coalesce(F.col("t") - far > gap, F.lit(True)).cast("int"))
    counts = marked.groupBy("media_path", "b").agg(F.sum("new").alias("c")).withColumn("c", F.coalesce(F.sum("c").over(over.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    parted = marked.join(counts, ["media_path", "b"]).withColumn("s", F.col("c") + F.sum("new").over(w.rowsBetween(W.unboundedPreceding, 0)))

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        out: list[list] = []
        for path, t0, e, x in pdf.sort_values(["t", "caption_id"])[["media_path", "t", "e", "x"]].itertuples(index=False):
            if out and (abs(t0 - out[-1][2]) <= gap or abs(t0 - out[-1][1]) <= gap):
                out[-1][2] = e
                if x not in out[-1][3]:
                    out[-1][3] += ". " + x
            else:
                out.append([path, t0, e, x])
        return pd.DataFrame(out, columns=["media_path", "time", "end", "text"])

    return parted.groupBy("media_path", "s").applyInPandas(fold, "media_path string, time double, end double, text string")


def words_of(path: Column, title: Column) -> Column:
    """The words a row is looked for by: of its path and title, three bytes or more, lower case."""
    cut_ = lambda c, marks: F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), marks), lambda w: F.octet_length(w) > 2)
    return F.array_distinct(F.concat(cut_(path, r"[/\\.\-_ ]"), cut_(title, r"[ .\-_,:()]")))


def related(df: DataFrame, path: str, terms: int = 50, limit: int = 20) -> DataFrame:
    """Other rows that hold the beginning (three bytes) of one of a row's longest words, in any
    indexed column, those that hold most of these most often first (a top list).

    Each word found counts by how rare the rows with it are, damped by how often it occurs.
    """
    seed = df.where(F.col("path") == path).select(F.explode(words_of(F.col("path"), F.col("title"))).alias("w")).distinct()
    chosen = [r["w"] for r in seed.orderBy(F.octet_length("w").desc(), "w").limit(terms).collect()]  # at most ``terms``
    begin = sorted({w.encode()[:3].decode("utf-8", "ignore") for w in chosen})
    others = df.where((F.coalesce("time_deleted", F.lit(0)) == 0) & (F.col("path") != path))
    if not begin:
        return others.limit(0).withColumn("bm25", F.lit(0.0)).select("path", "bm25")
    found = others.where(fts(begin, []))
    return bm25(found, begin).groupBy("path").agg(F.max("bm25").alias("bm25")).orderBy(F.desc("bm25"), "path").limit(limit)


def search_table(df: DataFrame, include: list[str], exclude: list[str] = (), exact: bool = False) -> DataFrame:
    """Rows of any table: every term in some text column, no excluded term in any."""
    cols = [F.coalesce(F.col(f"`{c}`"), F.lit("")) for c, kind in df.dtypes if kind == "string"]
    test = (lambda c, t: c == t) if exact else strings.ascii_contains
    out = df
    for t in include:
        out = out.where(any_of([test(c, t) for c in cols]))
    for t in exclude:
        out = out.where(~any_of([strings.ascii_contains(c, t) for c in cols]))
    return out


def table_name(wanted: str, names: list[str]) -> str:
    """The table meant: itself, or the only one that begins so."""
    if wanted in names:
        return wanted
    found = [n for n in names if n.startswith(wanted)]
    if len(found) != 1:
        raise ValueError(f"{wanted}: {len(found)} tables begin so")
    return found[0]
