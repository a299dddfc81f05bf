"""Smaller functions of catalogues: display, languages, estimates, play windows."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from reelbase.functions import paths, strings

# Language codes and names.
LANGUAGE_NAMES = {
    "ar": "Arabic", "cs": "Czech", "da": "Danish", "de": "German", "el": "Greek", "en": "English", "es": "Spanish", "fi": "Finnish", "fr": "French", "he": "Hebrew", "hi": "Hindi", "hu": "Hungarian", "it": "Italian",
    "ja": "Japanese", "ko": "Korean", "nl": "Dutch", "no": "Norwegian", "pl": "Polish", "pt": "Portuguese", "ro": "Romanian", "ru": "Russian", "sv": "Swedish", "th": "Thai", "tr": "Turkish", "uk": "Ukrainian", "vi": "Vietnamese", "zh": "Chinese",
}
# Formats whose stated duration is not reliable, and the bits a second they take.
BITRATES = {
    ".vob": 5_000_000, ".ifo": 5_000_000, ".vro": 5_000_000, ".m2t": 15_000_000, ".m2ts": 15_000_000, ".mts": 15_000_000, ".mod": 10_000_000, ".tod": 12_000_000, ".divx": 4_000_000, ".xvid": 4_000_000,
    ".rm": 2_000_000, ".rmvb": 3_000_000, ".wmv": 3_000_000, ".asf": 3_000_000, ".avchd": 20_000_000, ".bdmv": 30_000_000, ".mpls": 30_000_000, ".iso": 8_000_000,
}
# Bits a second of other audio and video, and bytes a word takes in documents.
AUDIO_BITRATE, VIDEO_BITRATE = 256_000, 1_500_000
BYTES_PER_WORD = {".pdf": 7.0, ".epub": 5.5, ".mobi": 5.5, ".azw3": 5.5, ".docx": 6.5, ".odt": 6.5, ".html": 4.5, ".htm": 4.5, ".cbz": 50.0, ".cbr": 50.0, ".djvu": 15.0}
OTHER_BYTES_PER_WORD, LEAST_WORDS = 4.2, 10


def language_name(code: Column) -> Column:
    m = F.create_map(*[F.lit(x) for kv in LANGUAGE_NAMES.items() for x in kv])
    return F.try_element_at(m, F.lower(F.substring(code, 1, 2)))


def subtitle_language(path: Column) -> Column:
    """'film.en.srt' -> 'en'; '' if there is none."""
    return F.regexp_extract(F.lower(path), r"[._ -]([a-z]{2,3})\.(?:srt|vtt|ass|ssa|sub)$", 1)


# Languages as people name them in files, by their two-letter code and others.
LANGUAGE_CODES = {name.lower(): code for code, name in LANGUAGE_NAMES.items()} | {
    "eng": "en", "ger": "de", "deu": "de", "fra": "fr", "fre": "fr", "spa": "es", "ita": "it", "por": "pt", "nld": "nl", "dut": "nl", "pol": "pl", "rus": "ru", "jpn": "ja", "zho": "zh", "chi": "zh", "kor": "ko", "swe": "sv", "tur": "tr", "ukr": "uk",
}


def language_code(name: Column) -> Column:
    """The two-letter code of a language's name or code; null if it is none."""
    known = F.create_map(*[F.lit(x) for both in (LANGUAGE_CODES | {c: c for c in LANGUAGE_NAMES}).items() for x in both])
    return F.try_element_at(known, F.lower(F.trim(name)))


def subtitle_label(path: Column) -> Column:
    """'English (srt)' of 'film.en.srt', 'film_eng.srt' or 'film - English.srt'; '(srt)' without a language."""
    base = paths.basename(path)
    kind = F.regexp_replace(F.substring(paths.extension(base), 2, 10), "^ass$", "ssa")
    stem = F.regexp_replace(base, r"\.[^.]*$", "")
    last = lambda mark: F.when(F.instr(stem, mark) > 0, F.substring_index(stem, mark, -1))
    short = lambda c: F.when(F.length(c).isin(2, 3), language_code(c))
    code = F.coalesce(short(last(".")), short(last("_")), language_code(last(" - ")))
    return F.when(kind == "", "").otherwise(F.concat(F.coalesce(F.concat(language_name(code), F.lit(" ")), F.lit("")), F.lit("("), kind, F.lit(")")))


def shorten(text: Column, width: int) -> Column:
    """The first characters and an ellipsis where the text is longer."""
    return F.when(F.length(text) > width, F.concat(F.substring(text, 1, width - 1), F.lit("…"))).otherwise(text)


def shorten_middle(text: Column, width: int) -> Column:
    left, right = (width - 1) // 2, width - 1 - (width - 1) // 2
    return F.when(F.length(text) > width, F.concat(F.substring(text, 1, left), F.lit("…"), F.right(text, F.lit(right)))).otherwise(text)


def _by_extension(path: Column, values: dict[str, float], other: float | None) -> Column:
    ext, out = paths.extension(path), F.lit(other)
    for e, v in values.items():
        out = F.when(ext == e, v).otherwise(out)
    return out


def estimated_duration(size: Column, path: Column, video: bool = True) -> Column:
    """Seconds a file of a size plays by its format's bit rate, or by that of other video or audio."""
    return size / _by_extension(path, BITRATES, VIDEO_BITRATE if video else AUDIO_BITRATE) * 8


def corrected_duration(duration: Column, size: Column, path: Column) -> Column:
    """Where a format's duration is not reliable and is missing or under two minutes, the estimate
    if that is above."""
    guess = size / _by_extension(path, BITRATES, None) * 8
    low = F.coalesce(duration, F.lit(0)) < 120
    return F.when(low & F.coalesce(guess > 120, F.lit(False)), F.floor(guess).cast("bigint")).otherwise(duration)


def timeout_duration(duration: Column, size: Column, path: Column) -> Column:
    """The duration if there is one, else the estimate; 0 without a size."""
    return F.when(duration > 0, duration.cast("double")).when(size > 0, estimated_duration(size, path)).otherwise(0.0)


def words_of_size(size: Column, path: Column) -> Column:
    """How many words a document of a size holds, ten at least."""
    return F.greatest(F.floor(size / _by_extension(path, BYTES_PER_WORD, OTHER_BYTES_PER_WORD)).cast("bigint"), F.lit(LEAST_WORDS).cast("bigint"))


def estimated_words(size: Column, path: Column, counted: Column) -> Column:
    """Counted words; of fewer than 300 the larger of them and what the size suggests."""
    return F.when(counted < 300, F.greatest(counted, words_of_size(size, path))).otherwise(counted)


def word_timings(text: Column, wpm: int = 250) -> Column:
    """Array of (word, second it is shown at)."""
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    return F.transform(words, lambda w, i: F.struct(w.alias("word"), (i * 60.0 / wpm).alias("at")))


def play_window(duration: Column, start: Column, end: Column) -> Column:
    """Seconds between two offsets, negative ones counted from the end, within the duration."""
    a = F.when(start < 0, duration + start).otherwise(F.coalesce(start, F.lit(0)))
    b = F.when(end < 0, duration + end).otherwise(F.coalesce(end, duration))
    return F.greatest(F.lit(0), F.least(b, duration) - F.greatest(a, F.lit(0)))


def playhead(saved: Column, session: Column, duration: Column) -> Column:
    """The player's saved place if it lies within the duration, else the session's."""
    ok = lambda c: (c > 0) & (duration.isNull() | (c < duration))
    return F.when(ok(saved), saved).when(ok(session), session)


def corruption(failed: Column, segments: Column, frames: Column, fps: Column, duration: Column) -> Column:
    """Share of segments that failed, or how far the frames miss the duration, whichever is known."""
    return F.coalesce(F.try_divide(failed.cast("double"), segments.cast("double")), F.try_divide(F.abs(F.try_divide(frames, fps) - duration), duration.cast("double")))


def segments(duration: Column, length: int = 10) -> Column:
    """Starts of the pieces of a stream."""
    return F.when(duration > 0, F.sequence(F.lit(0).cast("bigint"), F.ceil(duration / length).cast("bigint") - 1)).otherwise(F.array().cast("array<bigint>"))


def loads(text: Column) -> Column:
    """JSON as a map of strings; single quotes are taken for double ones where it is none otherwise."""
    kind = "map<string,string>"
    return F.coalesce(F.from_json(text, kind), F.from_json(F.replace(text, F.lit("'"), F.lit('"')), kind))


def escape_xml(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def file_name(text: Column) -> Column:
    """Without characters that file systems refuse."""
    return F.regexp_replace(text, r'[<>:"/\\|?*\x00-\x1f]', "_")


def jaccard(a: Column, b: Column) -> Column:
    return F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.size(F.array_union(a, b)).cast("double"))


def common_path(paths_: list[str]) -> str:
    """The longest folder all paths share."""
    split = [[p for p in x.split("/") if p] for x in paths_]
    shared = []
    for level in zip(*split):
        if len(set(level)) > 1:
            break
        shared.append(level[0])
    return "/" + "/".join(shared)


def dict_filter(rules: list[dict[str, str]], allow: bool) -> Column:
    """Rows that match a rule (all of its fields, as pattern or prefix); others if not ``allow``."""
    out = F.lit(False)
    for rule in rules:
        one = F.lit(True)
        for column, pattern in rule.items():
            one = one & F.coalesce(strings.glob_or_like(F.col(column), pattern), F.lit(False))
        out = out | one
    return out if allow else ~out


def ingest_filter(paths_: list[str] = (), include: list[str] = (), exclude: list[str] = (), regex: str = "", contains: list[str] = (), sizes: list = ()) -> Column:
    """Files a scan takes: a listed path, any included part, no excluded one, all contained parts, any size range."""
    path, out = F.col("path"), F.lit(True)
    if paths_:
        out = out & path.isin(list(paths_))
    if include:
        out = out & F.exists(F.array(*[F.lit(x) for x in include]), lambda x: path.contains(x))
    for x in exclude:
        out = out & ~path.contains(x)
    if regex:
        re.compile(regex)
        out = out & path.rlike(regex)
    for x in contains:
        out = out & path.contains(x)
    if sizes:
        some = F.lit(False)
        for r in sizes:
            some = some | r.matches(F.col("size"))
        out = out & some
    return out
