"""Driver-side parsers: what a user writes becomes numbers and predicates."""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

# Suffixes and their worth; longer suffixes come first.
BYTES = {"KB": 10**3, "MB": 10**6, "GB": 10**9, "TB": 10**12, "K": 10**3, "M": 10**6, "G": 10**9, "T": 10**12, "B": 1}
BITS = {"KBIT": 10**3, "MBIT": 10**6, "GBIT": 10**9, "TBIT": 10**12, "K": 10**3, "M": 10**6, "G": 10**9, "T": 10**12, "BIT": 1}
_DAY = 86400
SECONDS = {
    "minutes": 60, "seconds": 1, "months": 30 * _DAY, "weeks": 7 * _DAY, "hours": 3600, "years": 365 * _DAY, "minute": 60, "second": 1, "month": 30 * _DAY, "week": 7 * _DAY,
    "hour": 3600, "year": 365 * _DAY, "mins": 60, "secs": 1, "days": _DAY, "min": 60, "sec": 1, "day": _DAY, "mon": 30 * _DAY, "mo": 30 * _DAY, "yr": 365 * _DAY, "hr": 3600,
    "w": 7 * _DAY, "d": _DAY, "h": 3600, "m": 60, "s": 1, "y": 365 * _DAY,
}
DATE_LAYOUTS = ("%Y-%m-%d", "%Y-%m-%d %H:%M:%S", "%Y-%m-%d %H:%M", "%m/%d/%Y")


def _with_suffix(text: str, suffixes: dict[str, int]) -> int:
    for suffix, worth in suffixes.items():
        if text.endswith(suffix):
            return int(float(text[: -len(suffix)].strip()) * worth)
    return int(text)


def human_to_bytes(text: str) -> int:
    """'1.5GB' -> 1500000000; units are of 1000. ValueError on nonsense."""
    return _with_suffix(text.strip().upper(), BYTES)


def human_to_bits(text: str) -> int:
    """'2Mbit' -> 2000000."""
    return _with_suffix(text.strip().upper(), BITS)


def human_to_seconds(text: str) -> int:
    """'2 hours' -> 7200; months have 30 days, years 365; empty is 0."""
    text = text.strip().lower()
    return _with_suffix(text, SECONDS) if text else 0


def share_or_bytes(text: str) -> float:
    """'5%' -> 0.05, '1MB' -> 1000000.0; 0.05 for nonsense."""
    text = text.strip()
    try:
        return float(text[:-1]) / 100 if text.endswith("%") else float(human_to_bytes(text))
    except ValueError:
        return 0.05


def decade(year: int) -> str:
    """1994 -> '90s'; '' before 1900."""
    return "" if year < 1900 else f"{year // 10 * 10 % 100:02d}s"


def most_specific(dates: list[str], now: int) -> int | None:
    """Of the past dates given as text, the one that says most (month, then day), then the earliest."""
    found = []
    for text in dates:
        m = re.fullmatch(r"(\d{4})(?:[-/.]?(\d{2})(?:[-/.]?(\d{2}))?)?", text.strip())
        try:
            t = int(datetime(int(m[1]), int(m[2] or 1), int(m[3] or 1), tzinfo=timezone.utc).timestamp()) if m else parse_date(text, now)
        except ValueError:
            continue
        if (m or t) and t < now:
            at = datetime.fromtimestamp(t, timezone.utc)
            found.append((at.month == 1, at.day == 1, t))
    return min(found)[2] if found else None


def partial_name(text: str, names: list[str]) -> str:
    """The first name that begins so; ValueError without."""
    for n in names:
        if text and n.startswith(text):
            return n
    raise ValueError(f"no name begins with {text!r}")


def divisors(n: int) -> list[int]:
    """Of a number of four or more, those between 1 and itself, pair by pair."""
    return [x for i in range(2, math.isqrt(n) + 1) if n % i == 0 for x in ((i,) if i * i == n else (i, n // i))] if n >= 4 else []


def divided(values: list[float]) -> float:
    """The first value over all others in turn; infinite over 0, not a number for 0 over 0; 0 of none."""
    if not values:
        return 0.0
    out = float(values[0])
    for v in values[1:]:
        if v == 0:
            return math.copysign(math.inf, out) if out else math.nan
        out /= v
    return out


@dataclass(frozen=True)
class Range:
    """Bounds that apply where they are set; an equality, where set, goes first."""

    low: int | None = None
    high: int | None = None
    value: int | None = None

    def matches(self, column: Column) -> Column:
        """The predicate on a column; null never matches."""
        if self.value is not None:
            return column == self.value
        out = column.isNotNull()
        if self.low is not None:
            out &= column >= self.low
        if self.high is not None:
            out &= column <= self.high
        return out

    def holds(self, x: int) -> bool:
        if self.value is not None:
            return x == self.value
        return (self.low is None or x >= self.low) and (self.high is None or x <= self.high)


def parse_range(text: str, unit: Callable[[str], int] = int) -> Range:
    """'>1MB', '<5', '+10', '-10', '5-10', '100%10' (give or take 10 %), '7', or several by commas.

    Of several, later parts override what earlier ones set. Empty is a range without bounds.
    """
    text = text.strip()
    if not text:
        return Range()
    if "," in text:
        out: dict[str, int] = {}
        for part in text.split(","):
            r = parse_range(part, unit)
            out |= {k: v for k, v in vars(r).items() if v is not None}
        return Range(**out)
    if "-" in text[1:]:
        low, high = text.split("-")
        return Range(unit(low), unit(high))
    if "%" in text:
        base, share = text.split("%")[:2]
        middle = unit(base)
        give = int(middle * (float(share) / 100))
        return Range(middle - give, middle + give)
    sign, rest = text[0], text[1:]
    if sign == ">":
        return Range(low=unit(rest) + 1)
    if sign == "<":
        return Range(high=unit(rest) - 1)
    if sign == "+":
        return Range(low=unit(rest))
    if sign == "-":
        return Range(high=unit(rest))
    return Range(value=unit(text))


def parse_percentiles(text: str) -> tuple[float, float] | None:
    """'p10-90' -> (10.0, 90.0), clamped to 0..100; None for anything else."""
    m = re.fullmatch(r"p(\d+(?:\.\d+)?)-(\d+(?:\.\d+)?)", text)
    return tuple(min(100.0, max(0.0, float(g))) for g in m.groups()) if m else None


def parse_date(text: str, now: int | None = None) -> int:
    """Unix seconds (UTC) of a number, a date in one of the layouts, or '3 days' before ``now``; 0 if none."""
    text = text.strip()
    if re.fullmatch(r"\d+", text) and int(text) > 0:
        return int(text)
    for layout in DATE_LAYOUTS:
        try:
            return int(datetime.strptime(text, layout).replace(tzinfo=timezone.utc).timestamp())
        except ValueError:
            pass
    try:
        back = human_to_seconds(text.lstrip("+-"))
    except ValueError:
        return 0
    return (now if now is not None else int(datetime.now(timezone.utc).timestamp())) - back if back else 0


def parse_slice(text: str) -> slice:
    """'1:10:2' -> slice(1, 10, 2); empty parts are open."""
    return slice(*(int(p) if p.strip() else None for p in text.split(":")))


# Words that join the terms of a full-text search, and signs of its own syntax.
OPERATORS = ("AND", "OR", "NOT")
SYNTAX = (" NOT ", " AND ", " OR ", "*", ":", "NEAR(")


def search_terms(query: str) -> tuple[list[str], list[str]]:
    """(terms, quoted phrases) of a search; both need three bytes, but operators stay (upper case)."""
    quoted = re.compile(r"[\"']([^\"']+)[\"']")
    phrases = [p.strip() for p in quoted.findall(query) if len(p.strip().encode()) >= 3]
    rest = re.sub(r"[():]", " ", quoted.sub(" ", query))
    terms = [t.upper() if t.upper() in OPERATORS else t for t in rest.split() if t.upper() in OPERATORS or len(t.encode()) >= 3]
    return terms, phrases


def plain_terms(terms: list[str]) -> list[str]:
    """The terms that are looked for: those that are no operators."""
    return [t for t in terms if t not in OPERATORS]


def fts_quoted(query: list[str]) -> list[str]:
    """Terms in quotes, but for those that use the search's own syntax."""
    return [t if any(x in t for x in SYNTAX) else f'"{t}"' for t in query]


def databases_and_paths(arguments: list[str], lines: list[str] = ()) -> tuple[list[str], list[str]]:
    """(catalogues, scan paths) of a command's arguments; '-' stands for the given lines."""
    every = [x for a in arguments for x in ([t.strip() for t in lines if t.strip()] if a == "-" else [a])]
    return [a for a in every if a.endswith(".db")], [a for a in every if not a.endswith(".db")]


def any_of(columns: list[Column]) -> Column:
    out = F.lit(False)
    for c in columns:
        out = out | c
    return out
