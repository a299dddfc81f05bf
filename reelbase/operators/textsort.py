"""Lines sorted by their words: words found by regular expressions, counted over all lines, put in
order within a line, and lines compared by what their words say."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelbase.functions import paths, ranking

# Words are two letters or more (of a to z, digits and _); the orders used where none
# is named.
WORD = r"(?<!\w)\w\w+"
WORD_ORDER = ("-dup", "count", "-len", "-lastindex", "alpha")
LINE_ORDER = ("-allunique", "alpha", "alldup", "dupmode", "line")
#: The keys of lines by name; names without a key are passed over.
LINE_KEYS = {
    "line": "line", "count": "n", "len": "len", "dup": "dups", "unique": "uniques", "sum": "sum", "dupmax": "max", "dupmin": "min", "dupavg": "avg", "dupmean": "avg", "dupmedian": "median",
    "alpha": "words", "python": "words", "natural": "natural", "natsort": "natural",
}


def line_words(line: Column, patterns: tuple[str, ...] = (WORD,), stop: tuple[str, ...] = ()) -> Column:
    """A line's words: what the first pattern finds in it, of that what the next finds, and so on; lower
    case, without stop words. A web address's scheme is not looked at."""
    found = lambda pattern: lambda w: F.regexp_extract_all(w, F.lit(f"({pattern})"), 1)
    words = F.array(F.regexp_replace(F.regexp_replace(line, "^http://", ""), "^https://", ""))
    for p in patterns:
        words = F.flatten(F.transform(words, found(p)))
    out = F.transform(words, lambda w: F.lower(w))
    return F.filter(out, lambda w: ~w.isin([s.lower() for s in stop])) if stop else out


def kept(uniques: Column, dups: Column, n: Column, unique: bool | None, duplicate: bool | None) -> Column:
    """Whether a line stays: one of the two asks for some (or no) such word, both together for all."""
    some = F.lit(True)
    if unique is not None and duplicate is None:
        some = uniques > 0 if unique else uniques == 0
    elif unique is None and duplicate is not None:
        some = dups > 0 if duplicate else dups == 0
    elif unique is not None and unique != duplicate:
        some = uniques == n if unique else dups == n
    return (n > 0) & some if unique is not None or duplicate is not None else F.lit(True)


def _natural(word: str) -> list[tuple]:
    import re

    return [(0, int(p), "") if p.isdecimal() else (1, 0, p) for p in re.findall(r"[0-9]+|[^0-9]+", word)]


def order_words(words: list[str], counts: dict[str, int], by: tuple[str, ...]) -> list[str]:
    """The words of a line in order: several keys, '-' for descending, equal words as they stood."""
    back = words[::-1]
    keys = {
        "len": lambda w: len(w.encode()), "count": counts.__getitem__, "dup": lambda w: counts[w] > 1, "unique": lambda w: counts[w] == 1, "index": words.index, "lastindex": back.index, "linecount": words.count,
        "alpha": lambda w: w, "python": lambda w: w, "natural": _natural, "natsort": _natural,
    }
    out = list(words)
    for name in reversed(by):  # the last key first, each sort stable
        if name.lstrip("-") in keys:
            out = sorted(out, key=keys[name.lstrip("-")], reverse=name[0] == "-")  # equal ones stay as they are
    return out


def line_statistics(words: DataFrame) -> DataFrame:
    """Of lines (``i``, ``w``: one row a word): how many words, how many that occur elsewhere or
    nowhere else, and sum, most, least, mean and median of the words' counts over all lines."""
    counts = words.groupBy("w").agg(F.count("*").alias("c"))
    each = words.groupBy("i", "w").agg(F.count("*").alias("k")).join(counts, "w")
    per = each.groupBy("i").agg(
        F.sum("k").alias("n"), F.coalesce(F.sum(F.when(F.col("c") > 1, F.col("k"))), F.lit(0)).alias("dups"), F.coalesce(F.sum(F.when(F.col("c") == 1, F.col("k"))), F.lit(0)).alias("uniques"),
        F.sum(F.col("c") * F.col("k")).alias("sum"), F.max("c").alias("max"), F.min("c").alias("min"), F.expr("percentile(c, 0.5, k)").alias("median"), F.collect_list(F.struct("w", "c")).alias("counts"),
    )
    return per.withColumn("avg", F.col("sum") / F.col("n"))


def sort_lines(
    df: DataFrame, id_: str, line: str, patterns: tuple[str, ...] = (WORD,), stop: tuple[str, ...] = (), unique: bool | None = None, duplicate: bool | None = None, word_order: tuple[str, ...] = WORD_ORDER, line_order: tuple[str, ...] = LINE_ORDER
) -> DataFrame:
    """Lines numbered (``rn``) in the order of their words; the id breaks ties.

    ``unique`` and ``duplicate`` keep lines by words that occur nowhere else or elsewhere; words are
    then counted anew over the lines kept. Null lines have no words.
    """
    base = df.select(F.col(id_).alias("i"), F.coalesce(F.col(line), F.lit("")).alias("line"))
    words = base.select("i", line_words(F.col("line"), patterns, stop).alias("ws"))
    each = lambda ws: ws.select("i", F.explode("ws").alias("w"))
    stats = line_statistics(each(words))
    if unique is not None or duplicate is not None:
        stay = stats.where(kept(F.col("uniques"), F.col("dups"), F.col("n"), unique, duplicate)).select("i")
        base, words = base.join(stay, "i", "left_semi"), words.join(stay, "i", "left_semi")
        stats = line_statistics(each(words))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            counts = [{c["w"]: c["c"] for c in x} if x is not None else {} for x in pdf["counts"]]
            made = [" ".join(order_words(list(w), n, word_order)) for w, n in zip(pdf["ws"], counts)]
            yield pdf[["i"]].assign(words=made)

    kind = dict(base.dtypes)["i"]
    ordered = words.join(stats.select("i", "counts"), "i", "left").mapInPandas(run, f"i {kind}, words string")
    out = base.join(ordered, "i").join(stats.drop("counts"), "i", "left").withColumn("len", F.octet_length(F.replace("words", F.lit(" "), F.lit("")))).withColumn("natural", paths.natural_key(F.col("words")))
    zero = ("n", "dups", "uniques", "sum", "max", "min", "avg", "median")
    key = lambda c: F.coalesce(F.col(c), F.lit(0)) if c in zero else F.col(c)
    known = [(o[0] == "-", LINE_KEYS[o.lstrip("-")]) for o in line_order if o.lstrip("-") in LINE_KEYS]
    order = [key(c).desc() if down else key(c).asc() for down, c in known]
    return ranking.number(out, [*order, F.col("i").asc()], keep=["i", "line", "words"]).select(F.col("i").alias(id_), "line", "words", "rn")
