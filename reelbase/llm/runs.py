"""Problem 6: repeated consecutive events, collapsed into one event with count and duration.

Every event is given a canonical value: that of the text its chain of nearly equal neighbours
began with, so that the value recurs when the text does. The row number within the entity less the
row number within entity and value is then constant exactly along a run.

An entity may hold any share of all rows, at any density. Events are therefore sorted over the
whole table by entity and time, and the parts of the sorted table are worked on side by side,
wherever they are cut; what touches a cut is stitched afterwards from at most three rows a part.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reelbase.tables import cut, table

_MARKUP = r"<[^<>]*>|\{\\[^{}]*\}"
_NO_SPACES = re.compile("[぀-ヿ㐀-鿿]")
_DIGIT = regex.compile(r"\p{N}")


def words(text: Column) -> Column:
    """The canonical words of a text, parted by blanks: without markup, punctuation, line marks and
    letter case.

    A text of marks alone keeps them, so that it still is an event of its own; a null or blank
    text has no words (null).
    """
    bare = F.lower(F.regexp_replace(F.regexp_replace(text, _MARKUP, ""), " ", " "))
    kept = F.trim(F.regexp_replace(F.regexp_replace(bare, r"[^\p{L}\p{M}\p{N}\s]+", ""), r"\s+", " "))
    marks = F.regexp_replace(F.lower(text), r"[\s ]+", "")
    return F.when(F.length(kept) > 0, kept).when(F.length(marks) > 0, marks)


def distance(a: str, b: str, most: int) -> int:
    """The Levenshtein distance, or ``most`` + 1 if it is larger."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        if min(row) > most:
            return most + 1
    return min(row[-1], most + 1)


def near(a: str, b: str) -> bool:
    """Whether two canonical texts are the same but for a slip of one or two letters.

    A slip leaves out, doubles or swaps letters, or (in words of six letters or more) takes
    another letter; digits never slip. Numbers or whole words that differ make other events.
    """
    if a.replace(" ", "") == b.replace(" ", ""):
        return True
    x, y = a.split(" "), b.split(" ")
    other = [(p, q) for p, q in zip(x, y) if p != q]
    if len(x) != len(y) or len(other) > 2 or any(_DIGIT.search(p + q) for p, q in other):
        return False
    if len(other) == 2:
        return all(len(p) != len(q) and distance(p, q, 1) == 1 for p, q in other)
    p, q = other[0]
    n, unspaced = distance(p, q, 2), bool(_NO_SPACES.search(p + q))
    if len(p) != len(q):
        return n == 1 or (n == 2 and not unspaced)
    return n <= 2 and (sorted(p) == sorted(q) or (n == 1 and len(p) >= 6 and not unspaced))


def _islands(e: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Where runs begin: the row number within the entity less that within entity and value is
    constant along a run, and no other run of the value has the same."""
    rows = np.arange(len(e))
    n = rows - np.maximum.accumulate(np.where(np.append(True, e[1:] != e[:-1]), rows, 0))
    k = n - pd.DataFrame({"e": e, "v": v}).groupby(["e", "v"], sort=False).cumcount().to_numpy()
    run = pd.DataFrame({"e": e, "v": v, "k": k}).groupby(["e", "v", "k"], sort=False).ngroup().to_numpy()
    return np.flatnonzero(np.append(True, run[1:] != run[:-1]))


def _events(w: list[str | None], e: np.ndarray, began: str | None, opening: bool) -> tuple[np.ndarray, np.ndarray, list[str | None], bool]:
    """Starts and ends of the runs of events in order, their values, and whether the first chain
    reaches the last event.

    ``began``: the value of the chain that the first event belongs to. The chain is ``opening``
    where its true value lies in another part of the table: it is a run of its own for now.
    """
    codes: dict[str, int] = {}
    bare = [None if x is None else x.replace(" ", "") for x in w]
    code = np.array([-2 - i if x is None else codes.setdefault(x, len(codes)) for i, x in enumerate(bare)], dtype=np.int64)
    known = (e[1:] == e[:-1]) & (code[1:] >= 0) & (code[:-1] >= 0)
    goes_on = np.append(False, known & (code[1:] == code[:-1]))
    size, gaps = np.array([len(x or "") for x in w]), np.array([(x or "").count(" ") for x in w])
    maybe = known & (code[1:] != code[:-1]) & (np.abs(np.diff(size)) <= 2) & (np.diff(gaps) == 0)
    for i in np.flatnonzero(maybe).tolist():
        goes_on[i + 1] = near(w[i], w[i + 1])
    chain = np.maximum.accumulate(np.where(goes_on, 0, np.arange(len(w))))
    value = code[chain]  # the canonical value: the text that the chain began with
    if began is not None and w[0] is not None:
        value[chain == 0] = codes.setdefault(began, len(codes))
    if opening:
        value[chain == 0] = -1
    start = _islands(e, value)
    names = [None, *codes]
    values = [names[max(c, -1) + 1] for c in value[start].tolist()]
    if opening:
        values[0] = began if began is not None else bare[0]
    return start, np.append(start[1:], len(w)) - 1, values, opening and chain[-1] == 0


_COLUMNS = ("p", "o", "edge", "opens", "e", "first_id", "n", "t0", "t1", "x", "v", "w0", "w1")


def _schema(kind: str) -> str:
    return f"p int, o bigint, edge boolean, opens boolean, e {kind}, first_id bigint, n bigint, t0 double, t1 double, x string, v string, w0 string, w1 string"


def _fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The runs of one part of the sorted events (e, t, i, x, w). The last one is held back until
    it is known to have ended; the one before the first cut and its neighbour are edges, as the
    last is."""
    part = TaskContext.get().partitionId()
    held: dict | None = None  # the last run so far, and its last event
    opening, o = True, 0
    for pdf in batches:
        if pdf.empty:
            continue
        if held is not None:  # the last event comes again before the new ones
            pdf = pd.concat([held["last"], pdf], ignore_index=True)
        w = pdf["w"].astype(object).where(pdf["w"].notna(), None).tolist()
        start, end, values, opening_still = _events(w, pd.factorize(pdf["e"], use_na_sentinel=False)[0], held["v"] if held is not None else None, opening)
        t, i = pdf["t"].to_numpy(), pdf["i"].to_numpy()
        out = pd.DataFrame({
            "p": part, "o": np.arange(o, o + len(start)), "edge": False, "opens": False, "e": pdf["e"].iloc[start].to_numpy(), "first_id": i[start], "n": end - start + 1, "t0": t[start], "t1": t[end],
            "x": pdf["x"].iloc[start].to_numpy(), "v": values, "w0": [w[k] for k in start], "w1": [w[k] for k in end],
        })
        if opening:
            out.loc[0, "opens"] = True
        if held is not None:  # its first run is the one held back
            for c in ("first_id", "t0", "x", "w0"):
                out.loc[0, c] = held["run"][c]
            out.loc[0, "n"] += held["run"]["n"] - 1
        out["edge"] = out["o"] < 2
        opening = opening_still
        o += len(start) - 1
        held = {"run": out.iloc[-1].to_dict(), "v": values[-1], "last": pdf.iloc[[-1]]}
        done = out.iloc[:-1].copy()
        done = done[done["edge"] | done["v"].notna()]  # null texts only part runs
        done.loc[~done["edge"], ["v", "w0", "w1"]] = None
        yield done[list(_COLUMNS)]
    if held is not None:
        yield pd.DataFrame([held["run"] | {"edge": True}])[list(_COLUMNS)]


def _stitch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The runs at the cuts, in order, as one where they go on beyond a cut."""
    run: list | None = None
    at = {c: k for k, c in enumerate(_COLUMNS)}
    for pdf in batches:
        out = []
        for row in pdf[list(_COLUMNS)].astype(object).where(pdf.notna(), None).values.tolist():
            p, o, e, v = (row[at[c]] for c in ("p", "o", "e", "v"))
            follows = run is not None and run[at["e"]] == e and (row[at["opens"]] or (run[at["p"]], run[at["o"]] + 1) == (p, o))
            if follows and row[at["opens"]] and v is not None and run[at["v"]] is not None and near(run[at["w1"]], row[at["w0"]]):
                v = row[at["v"]] = run[at["v"]]  # its chain began before the cut
            if follows and v is not None and v == run[at["v"]]:
                run[at["n"]] += row[at["n"]]
                for c in ("p", "o", "t1", "w1"):
                    run[at[c]] = row[at[c]]
                continue
            if run is not None:
                out.append(run)
            run = row
        yield pd.DataFrame(out, columns=list(_COLUMNS))
    if run is not None:
        yield pd.DataFrame([run], columns=list(_COLUMNS))


def collapse(df: DataFrame, entity: str, time: str, text: str, id_: str, parts: int | None = None, with_text: bool = True) -> DataFrame:
    """Runs of the same or nearly the same consecutive events.

    An event goes on with the run before it if it is nearly the same as the event before it, or the
    same as the text that the run began with. Result: ``entity``, ``first_id``, ``n_events``,
    ``time_start``, ``time_end``, ``duration`` and ``text`` (of the first event, null without
    ``with_text``), one row a run; single events are runs of one. Rows equal in entity, time and
    text are one event, known by its smallest id. Rows without a time (null or NaN) stand outside.
    A null or blank text is no event and ends a run. Ties in time are ordered by id. A null entity
    is an entity. Other columns are ignored; an empty table gives no rows. ``parts``: into how
    many parts the sorted table is cut; it never changes the result.
    """
    base = df.select(F.col(entity).alias("e"), F.col(time).cast("double").alias("t"), F.col(text).alias("x"), F.col(id_).cast("bigint").alias("i"))
    base = base.where(F.col("t").isNotNull() & ~F.isnan("t"))
    events = base.groupBy("e", "t", "x").agg(F.min("i").alias("i"))
    order = [F.xxhash64("e"), F.col("e"), F.col("t"), F.col("i")]
    sorted_ = (events.repartitionByRange(parts, *order) if parts else events.repartitionByRange(*order)).sortWithinPartitions(*order, F.col("x"))
    read = sorted_.select("e", "t", "i", (F.col("x") if with_text else F.lit(None).cast("string")).alias("x"), words(F.col("x")).alias("w"))
    kind = dict(base.dtypes)["e"]
    found = cut(read.mapInPandas(_fold, _schema(kind)))  # kept: edges and others go separate ways
    # at most three rows a part of the table
    edges = found.where("edge").repartition(1).sortWithinPartitions("p", "o").mapInPandas(_stitch, _schema(kind))
    return found.where("not edge").unionByName(edges.where("v is not null")).select(
        F.col("e").alias(entity), "first_id", F.col("n").alias("n_events"), F.col("t0").alias("time_start"), F.col("t1").alias("time_end"), (F.col("t1") - F.col("t0")).alias("duration"), F.col("x").alias("text")
    )


def p6_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every run of captions, single events included, with count and duration."""
    return collapse(table(spark, sf_dir, "captions"), "media_path", "time", "text", "caption_id")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of two or more captions."""
    runs = collapse(table(spark, sf_dir, "captions"), "media_path", "time", "text", "caption_id", with_text=False)
    return runs.where(F.col("n_events") >= 2).select("first_id", "n_events")


QUERIES = {"p6_found": p6_found, "p6_runs": p6_runs}
