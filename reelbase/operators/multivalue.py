"""Problem 4: several values packed in one field, one value per row.

A field's dialect is the set of its delimiters and its quoting. Every dialect a field could have
been written in is scored by description length: the bits that name the dialect and the bits of
the values it yields, by code lengths counted over the whole corpus. The cheapest one is used.
"""

from __future__ import annotations

import heapq
import json
import math
import re
from collections.abc import Iterator, Mapping

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelbase.tables import cut, table

# Delimiters in question and the bits it takes to name each.
DELIMITERS = {";": 1, ",": 2, "|": 2, "/": 4, "\t": 4, "\n": 4, "、": 4, "，": 4, "；": 4, "&": 5, "+": 5, "•": 5, "·": 5, "\\": 6, ":": 7, "_": 8, "-": 9, " ": 9}
QUOTES = {'"': '"', "'": "'", "“": "”", "„": "“", "«": "»"}
#: Bits of a value that is in no vocabulary, besides those of its characters.
UNKNOWN, PER_CHAR = 1.0, 7.0
#: So many accepted values are held by every worker; of more, each field is given those it may hold.
VOCABULARY_LIMIT = 100_000
FIELDS = ("genre", "categories", "video_codecs", "audio_codecs")


def _key(value: str) -> str:
    return " ".join(value.split()).lower()


def _places(raw: str, delimiters: frozenset[str], quoting: bool) -> list[tuple[int, int, str | None]]:
    """(start, end, quoted value or None) of every place between delimiters."""
    out, i, n, start = [], 0, len(raw), 0
    blank = True
    quoted: str | None = None
    while i < n:
        c = raw[i]
        if quoting and blank and c in QUOTES:
            close, j, value = QUOTES[c], i + 1, []
            while j < n:
                if raw[j] == "\\" and j + 1 < n and raw[j + 1] in (close, "\\"):
                    value.append(raw[j + 1])
                    j += 2
                elif raw[j] == close and close == c and j + 1 < n and raw[j + 1] == close:
                    value.append(close)
                    j += 2
                elif raw[j] == close:
                    break
                else:
                    value.append(raw[j])
                    j += 1
            k = j + 1
            while k < n and raw[k] in " \t" and raw[k] not in delimiters:
                k += 1
            if j < n and (k >= n or raw[k] in delimiters):
                quoted, i, blank = "".join(value), k, False
                continue
        if c in delimiters:
            out.append((start, i, quoted))
            start, blank, quoted = i + 1, True, None
        elif not c.isspace():
            blank = False
        i += 1
    out.append((start, n, quoted))
    return out


def _bits(value: str, codes: Mapping[str, float]) -> float:
    code = codes.get(_key(value))
    return (UNKNOWN + PER_CHAR * len(value) if code is None else code) + 1.0


def _cheapest(raw: str, places: list[tuple[int, int, str | None]], codes: Mapping[str, float], longest: int) -> tuple[float, list[str]]:
    """The cheapest reading of the places, in which some neighbours may be one known value (of
    ``longest`` characters at most)."""
    n = len(places)
    cost = [0.0] + [math.inf] * n
    back: list[tuple[int, str | None]] = [(0, None)] * (n + 1)
    for b in range(1, n + 1):
        for a in range(b - 1, -1, -1):
            if a < b - 1 and (places[b - 1][1] - places[a][0] > longest + 8 or any(places[k][2] is not None for k in range(a, b))):
                break
            quoted = places[a][2] if a == b - 1 else None
            value = quoted.strip() if quoted is not None else raw[places[a][0] : places[b - 1][1]].strip()
            if a == b - 1 and not value:
                bits, value = 0.5, None
            elif a < b - 1 and codes.get(_key(value)) is None:
                continue
            else:
                bits = _bits(value, codes)
            if cost[a] + bits < cost[b]:
                cost[b], back[b] = cost[a] + bits, (a, value)
    values, at = [], n
    while at:
        at, value = back[at]
        if value is not None:
            values.append(value)
    return cost[n], values[::-1]


#: Of so many delimiters present all sets are tried; of more, sets of three and what improves on them.
ALL_SETS = 6


def _delimiter_sets(present: list[str]) -> Iterator[tuple[int, int, frozenset[str]]]:
    """(bits, order, delimiters) of sets of the delimiters present, the cheapest to name first."""
    most = len(present) if len(present) <= ALL_SETS else 3
    present = sorted(present, key=lambda d: DELIMITERS[d])
    heap: list[tuple[int, int, tuple[int, ...]]] = [(0, 0, ())]
    order = 0
    while heap:
        bits, _, held = heapq.heappop(heap)
        yield bits, order, frozenset(present[k] for k in held)
        order += 1
        for k in range(held[-1] + 1 if held else 0, len(present) if len(held) < most else 0):
            heapq.heappush(heap, (bits + 2 * DELIMITERS[present[k]], order * len(DELIMITERS) + k, (*held, k)))


def parse(raw: str | None, codes: Mapping[str, float], longest: int | None = None) -> list[str]:
    """The values of one field by its cheapest dialect; none for a null or blank field.

    Sets of the delimiters present are tried from the cheapest to name on, until naming one alone
    takes more bits than the best dialect does with its values.
    """
    if raw is None or not raw.strip():
        return []
    text = raw.strip()
    longest = max(map(len, codes), default=0) if longest is None else longest
    best: tuple[float, int, list[str]] = (math.inf, 0, [])
    if text[0] == "[" and text[-1] == "]":
        try:
            listed = [v for v in (str(v).strip() for v in json.loads(text) if v is not None) if v]
            best = (sum(_bits(v, codes) for v in listed) + 1, -1, listed)
        except ValueError:
            text = text[1:-1]
    quotings = (True, False) if any(q in text for q in QUOTES) else (False,)
    present = [d for d in DELIMITERS if d in text]
    last, used = 0, frozenset()

    def attempt(named: int, order: int, delimiters: frozenset[str]) -> None:
        nonlocal best, used
        for k, quoting in enumerate(quotings):
            bits, values = _cheapest(text, _places(text, delimiters, quoting), codes, longest)
            if (bits + named + (1 if quoting else 2), 2 * order + k) < best[:2]:
                best, used = (bits + named + (1 if quoting else 2), 2 * order + k, values), delimiters

    for named, last, delimiters in _delimiter_sets(present):
        if named > best[0]:
            break
        attempt(named, last, delimiters)
    while len(present) > ALL_SETS:  # any number of delimiters more, as long as each makes it cheaper
        before, own = best[0], used
        for d in present:
            if d not in own:
                last += 1
                attempt(2 * sum(DELIMITERS[x] for x in own) + 2 * DELIMITERS[d], last, own | {d})
        if best[0] >= before:
            break
    return best[2]


class _Asked(dict):
    """Codes that know nothing and remember what they were asked for."""

    def get(self, key, default=None):
        self[key] = True
        return default


def code_lengths(fields: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """``field_name``, ``v``, ``bits``: of every accepted value, from its counts over all rows.

    ``fields``: ``field_name``, ``raw``; ``vocabulary``: ``field_name``, ``val``. The counts come
    from every reading of a field by one delimiter, and number no more than the vocabulary.
    """
    vocab = vocabulary.select("field_name", F.lower(F.trim(F.regexp_replace("val", r"\s+", " "))).alias("v")).where("v is not null and v <> ''").distinct()
    pieces = fields.where("raw is not null").groupBy("field_name", "raw").count()
    strip = lambda c: F.regexp_replace(F.lower(c), r'^[\s"\[]+|[\s"\]]+$', "")
    readings = F.array_distinct(F.concat(F.array(strip(F.col("raw"))), *[F.when(F.col("raw").contains(d), F.transform(F.split("raw", re.escape(d)), strip)).otherwise(F.array().cast("array<string>")) for d in DELIMITERS]))
    counts = pieces.select("field_name", "count", F.explode(readings).alias("v")).join(vocab, ["field_name", "v"], "right").groupBy("field_name", "v").agg(F.coalesce(F.sum("count"), F.lit(0)).alias("n"))
    total = counts.groupBy("field_name").agg(F.sum(F.col("n") + 1).alias("total"))  # one row a field
    return counts.join(F.broadcast(total), "field_name").select("field_name", "v", F.log2(F.col("total") / (F.col("n") + 1)).alias("bits"))


def split_values(df: DataFrame, id_: str, fields: list[str] | tuple[str, ...], vocabulary: DataFrame, held: int = VOCABULARY_LIMIT) -> DataFrame:
    """One row per value of the named string columns.

    Result: ``id_``, ``field_name``, ``pos`` (from 1, empty places skipped), ``val`` (the field's
    letter case, without surrounding blanks and quoting) and ``n_values``. Null and blank fields
    give no rows; repeated values and repeated rows are kept. An empty vocabulary leaves the
    choice to the dialects' own bits. Other columns are ignored. A vocabulary above ``held`` values
    is joined to what the fields may hold instead of being held by the workers.
    """
    kind = dict(df.dtypes)[id_]
    stack = ", ".join(f"'{f}', `{f}`" for f in fields)
    melted = df.select(F.col(id_).alias("i"), *fields).select("i", F.expr(f"stack({len(fields)}, {stack}) as (field_name, raw)")).where("trim(raw) <> ''")
    lengths = cut(code_lengths(melted.select("field_name", "raw"), vocabulary))
    rows = lengths.limit(held + 1).collect()
    if len(rows) <= held:
        codes: dict[str, dict[str, float]] = {}
        for r in rows:
            codes.setdefault(r["field_name"], {})[r["v"]] = r["bits"]
        longest = {f: max(map(len, c)) for f, c in codes.items()}
        cols = ("i", "field_name", "raw")

        def of(field: str, own: None) -> dict[str, float]:
            return codes.get(field, {})

    else:
        longest = {r["field_name"]: r["n"] for r in lengths.groupBy("field_name").agg(F.max(F.length("v")).alias("n")).collect()}  # one row a field
        melted, cols = _with_codes(melted, lengths, longest), ("i", "field_name", "raw", "codes")

        def of(field: str, own: list | None) -> dict[str, float]:
            return {c["v"]: c["bits"] for c in own} if own is not None else {}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[tuple[str, str], list[str]] = {}
        for pdf in batches:
            out = []
            for i, field, raw, *own in zip(*[pdf[c] for c in cols]):
                values = known.get((field, raw))
                if values is None:
                    if len(known) > 200_000:
                        known.clear()
                    values = known[field, raw] = parse(raw, of(field, own[0] if own else None), longest.get(field, 0))
                out += [(i, field, k, v, len(values)) for k, v in enumerate(values, 1)]
            yield pd.DataFrame(out, columns=["i", "field_name", "pos", "val", "n_values"])

    found = melted.mapInPandas(run, f"i {kind}, field_name string, pos bigint, val string, n_values bigint")
    return found.withColumnRenamed("i", id_)


def _with_codes(melted: DataFrame, lengths: DataFrame, longest: dict[str, int]) -> DataFrame:
    """Fields with the codes of those accepted values that some dialect might read in them."""

    def asked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for field, raw in zip(pdf["field_name"], pdf["raw"]):
                keys = _Asked()
                parse(raw, keys, longest.get(field, 0))
                rows += [(field, raw, k) for k in keys]
            yield pd.DataFrame(rows, columns=["field_name", "raw", "v"])

    each = melted.select("field_name", "raw").distinct()
    codes = each.mapInPandas(asked, "field_name string, raw string, v string").join(lengths, ["field_name", "v"])
    return melted.join(codes.groupBy("field_name", "raw").agg(F.collect_list(F.struct("v", "bits")).alias("codes")), ["field_name", "raw"], "left")


def p4_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every value of the four packed fields of media."""
    return split_values(table(spark, sf_dir, "media"), "media_id", FIELDS, table(spark, sf_dir, "tag_vocab"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The values of fields that hold two or more."""
    return p4_values(spark, sf_dir).where("n_values >= 2").select("media_id", "field_name", "pos", "val")


QUERIES = {"p4_found": p4_found, "p4_values": p4_values}
