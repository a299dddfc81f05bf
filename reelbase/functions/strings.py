"""Column functions on text."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    """Only A to Z are folded, as LIKE does in the catalogues' files."""
    return F.translate(text, _UPPER, _LOWER)


def ascii_contains(text: Column, term: str) -> Column:
    """LIKE '%term%' that folds A to Z; blanks in the term match anything."""
    return ascii_like(text, "%" + term.replace(" ", "%") + "%")


def ascii_like(text: Column, pattern: str) -> Column:
    """LIKE with % and _ that folds A to Z and knows no escape."""
    folded = "".join(c.lower() if c in _UPPER else c for c in pattern)
    pieces = folded.split("%")
    if "_" not in folded and len(pieces) == 3 and pieces[0] == pieces[2] == "":
        return ascii_lower(text).contains(pieces[1])
    regex = "".join(".*" if c == "%" else "." if c == "_" else re.escape(c) for c in folded)
    return ascii_lower(text).rlike(f"(?s)^{regex}$")


def glob_or_like(text: Column, pattern: str) -> Column:
    """A pattern with * or ? is a glob (* stops at a slash), one with % is LIKE; others are prefixes, case folded."""
    if "%" in pattern:
        return F.lower(text).rlike("(?s)^" + ".*".join(re.escape(p) for p in pattern.lower().split("%")) + "$")
    if re.search(r"[*?\[]", pattern):
        regex = "".join("[^/]*" if c == "*" else "[^/]" if c == "?" else re.escape(c) for c in pattern)
        return text.rlike(f"^{regex}$")
    return F.lower(text).startswith(pattern.lower())


def occurrences(text: Column, term: str) -> Column:
    """How often a term occurs, ignoring case; 0 for null."""
    low = F.lower(F.coalesce(text, F.lit("")))
    t = term.lower()
    return ((F.length(low) - F.length(F.replace(low, F.lit(t), F.lit("")))) / len(t)).cast("int")


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"[ \t\n\r\f]+", " "))


def tokenized(path: Column) -> Column:
    """A path as words: brackets, dots, dashes and slashes are blanks, odd characters go."""
    bare = F.regexp_replace(path, r"[/\\.\[\]\-+(){}_&]", " ")
    return squeeze(F.regexp_replace(bare, "[\\x7f&%*$#!?|^'\":><]", ""))


def words(text: Column) -> Column:
    """Lower-case runs of a-z and 0-9."""
    return F.filter(F.split(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "), " "), lambda w: w != "")


def is_timecode(text: Column) -> Column:
    return text.rlike(r"^[0-9:;._,\- ]+$")


def is_generic_title(title: Column) -> Column:
    """Blank, a number, a time code, or a chapter or scene without a name."""
    t = F.lower(F.trim(title))
    short = (t.startswith("chapter") | t.startswith("scene")) & (F.octet_length(t) < 12)
    return F.coalesce((t == "") | short | t.contains("untitled chapter") | is_timecode(t), F.lit(True))


def combine(*columns: Column) -> Column:
    """Values of several fields split at , and ; without repeats and stand-ins, joined by ;."""
    all_ = F.flatten(F.array(*[F.split(F.coalesce(c, F.lit("")), "[,;]") for c in columns]))
    values = F.filter(F.transform(all_, squeeze), lambda v: (v != "") & ~F.lower(v).isin("unknown", "none", "und"))
    first = F.filter(values, lambda v, i: F.array_position(F.transform(values, F.lower), F.lower(v)) == i + 1)
    return F.array_join(first, ";")


def strip_tags(text: Column) -> Column:
    return squeeze(F.regexp_replace(text, "<[^>]*>", " "))


def seconds_of(timecode: Column) -> Column:
    """'h:m:s' -> seconds."""
    return F.aggregate(F.split(timecode, ":"), F.lit(0.0), lambda a, x: a * 60 + F.coalesce(x.try_cast("double"), F.lit(0.0)))


def categories(packed: Column) -> Column:
    """';a;b;' -> ['a', 'b']."""
    return F.filter(F.split(F.coalesce(packed, F.lit("")), ";"), lambda v: F.trim(v) != "")


def remove_consecutive(text: Column, char: str) -> Column:
    """Runs of a character become one."""
    return F.regexp_replace(text, f"(?:{re.escape(char)})+", re.escape(char) if char in "\\$" else char)


def remove_prefixes(text: Column, prefixes: list[str]) -> Column:
    for p in prefixes:
        text = F.when(text.startswith(p), F.substr(text, F.lit(len(p) + 1))).otherwise(text)
    return text


def remove_suffixes(text: Column, suffixes: list[str]) -> Column:
    for s in suffixes:
        text = F.when(text.endswith(s), F.substr(text, F.lit(1), F.length(text) - len(s))).otherwise(text)
    return text


def unquoted(text: Column) -> Column:
    """Without a pair of quotes around it."""
    return F.regexp_replace(text, r"""^(["'])(.*)\1$""", "$2")


def unparagraphed(text: Column) -> Column:
    """Single line breaks become blanks; blank lines stay."""
    return F.regexp_replace(text, r"(?<!\n)\n(?!\n)", " ")


# Blanks as the reference knows them, and quotes that may enclose a text.
_BLANKS = "[\\t\\n\\x0B\\f\\r \\x85\\xA0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]+"
_QUOTES = "＇＂‚〞〝〟⹂❟❜❛❝❞"
_ENCLOSING = [q + q for q in "\"'" + _QUOTES] + ["❮❯", "❯❮", "‹›", "›‹", "«»", "»«"]


def one_paragraph(text: Column) -> Column:
    """White space as single blanks, plain quotes and dots, without quotes around the whole."""
    s = F.trim(F.regexp_replace(text, _BLANKS, " "))
    s = F.replace(F.translate(s, "“”‘’‛‟„", "'" * 4 + '"' * 3), F.lit("…"), F.lit("..."))
    n = F.length(s)
    # pairs are taken off from the outside in, up to the first two characters that are none
    ends = F.transform(F.sequence(F.lit(0), F.length(F.regexp_extract(s, "^[" + "\"'" + _QUOTES + "❮❯‹›«»]*", 0))), lambda i: F.when(i == 0, F.lit(True)).when(2 * i > n, F.lit(False)).otherwise(F.concat(F.substr(s, i, F.lit(1)), F.substr(s, n - i + 1, F.lit(1))).isin(_ENCLOSING)))
    off = F.coalesce(F.nullif(F.array_position(ends, False), F.lit(0)), F.size(ends) + 1).cast("int") - 2
    bare = F.substr(s, off + 1, n - 2 * off)
    return F.when(bare.isin(list(_QUOTES)), F.lit("")).otherwise(bare)


def glob_all(text: Column, patterns: list[str]) -> Column:
    """Whether every pattern matches; true of none."""
    out = F.lit(True)
    for p in patterns:
        out = out & glob_or_like(text, p)
    return out


def split_trimmed(text: Column, separator: str) -> Column:
    """Parts without blanks around them, empty ones kept."""
    return F.transform(F.split(text, re.escape(separator)), lambda p: F.regexp_replace(p, r"^\s+|\s+$", ""))


def last_part(text: Column) -> Column:
    """What stands after the last dot; all without one."""
    return F.substring_index(text, ".", -1)


def as_json(*columns: str) -> Column:
    """A row's columns as a JSON object, nulls included."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def display_title(title: Column, stem: Column) -> Column:
    """The title, or the file's name where it is missing or empty."""
    return F.when(F.coalesce(title, F.lit("")) != "", title).otherwise(stem)


def title_case(text: Column) -> Column:
    """The first letter of each word in upper case, the others as they are."""
    return F.array_join(F.transform(F.split(text, " "), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substr(w, F.lit(2)))), " ")
