"""Problem 3: noise in text from scanned pages, found and repaired.

Pages are parsed line by line into what may be a running header, a page number or a word cut at a
line end. Headers are lines that recur at the edge of a paper's pages once digits are masked,
wherever they stand; how a line is set counts besides, for papers of few pages and titles read
differently each time. Page numbers count along with the pages. Words are grouped by a skeleton in which glyphs that
scanners confuse look alike; a rare word is a misreading of the frequent form of its group where
the words beside it support that form. SQL windows then reflow the lines into paragraphs.
"""

from __future__ import annotations

import functools
import itertools
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from reelbase.tables import cut, small, table

# Kinds of files that hold scanned pages.
PAGE_FILES = r"(?i)\.(pdf|djvu|tif|tiff)$"
#: How many times as frequent as a misreading the true form must be.
RARER = 8

# What scanners read for what is printed.
CONFUSED = (
    ("c", "e"), ("@", "a"), ("0", "o"), ("l", "i"), ("f", "t"), ("1", "l"), ("1", "i"), ("5", "s"), ("i", "l"), ("cl", "d"), ("ii", "u"), ("b", "h"), ("h", "b"),
    ("rn", "m"), ("m", "rn"), ("9", "g"), ("vv", "w"), ("m", "in"), ("in", "m"), ("h", "li"), ("li", "h"), ("|", "i"), ("|", "l"), ("!", "l"), ("rm", "nn"), ("nn", "rm"),
    ("8", "b"), ("d", "cl"), ("e", "c"), ("t", "f"), ("6", "b"), ("2", "z"), ("o", "0"), ("u", "ii"), ("w", "vv"), ("f", "e"), ("3", "e"), ("$", "s"), ("4", "a"),
)
_NOT_WORD = "[\\s.,;:?¿¡“”„\"()\\[\\]…—–«»/<>。、*#=+~]+"
_SPLIT = re.compile(_NOT_WORD)
#: Distinct tokens a worker counts before it hands the counts on.
COUNTED = 300_000
_ROMAN = re.compile(r"[ivxlc]+")
_NUMBER = re.compile(r"(?:(?P<deco>-|–|—|\[|\(|·|p\.?|pag(?:e|ina|\.)?|página|seite|s\.|стр\.?|str\.?|blz\.?|№)\s*)?(?P<n>\d+|[0-9OolI|SB]+|[ivxlc]+)(?:\s*(?P<end>-|–|—|\]|\)|·)|\s*(?P<of>/|of|von|de)\s*\d+)?", re.I)
_SENTENCE = re.compile(r"[.!?…:;,。！？][\"'”’»)]*$")
_ENDS = tuple(".!?…:;,。！？”»\"')")


_AS_DIGITS, _BARS, _LIKE = (str.maketrans(*x) for x in (("OolI|SB", "0011158"), ("I|!", "lll"), ("1@05924$836", "laosgzasbeb")))
_PARTS, _MASKED = re.compile(r"\t+|\s{2,}|\s+[|·•]\s+"), re.compile(r"\W*\d+([./:-]\d+)*\W*")
_CUT, _SOFT, _HARD = re.compile(r"([-‐‑\xad¬])[ \t]*\r?\n\s*([\w@|]+)"), re.compile(r"(?<=\w)[\xad¬][ \t]*\r?\n\s*(?=\w)"), re.compile(r"(?<=\w)[-‐‑][ \t]*\r?\n[ \t]*(?=[^\W\d_])")
_WORD_END = re.compile(r"[^\W\d_][\w@|]*$")


def _roman(s: str) -> int | None:
    value = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100}
    n = 0
    for a, b in zip(s, s[1:] + " "):
        n += -value[a] if value.get(b, 0) > value[a] else value[a]
    ones = ("", "i", "ii", "iii", "iv", "v", "vi", "vii", "viii", "ix")
    tens = ("", "x", "xx", "xxx", "xl", "l", "lx", "lxx", "lxxx", "xc")
    return n if 0 < n < 400 and "c" * (n // 100) + tens[n // 10 % 10] + ones[n % 10] == s else None


def page_number(s: str) -> tuple[int, bool] | None:
    """The number a text is the page number of, and whether it is marked as one."""
    m = _NUMBER.fullmatch(s.strip()) if len(s.split(None, 4)) <= 4 else None  # it has four parts at most
    if not m or len(m["n"]) > 18:  # no number of a page, and none that a column holds
        return None
    n = m["n"]
    if n.isdigit():
        value = int(n)
    elif _ROMAN.fullmatch(n.lower()) and (n.islower() or n.isupper()) and _roman(n.lower()) and (len(n) > 1 or not m["deco"]):
        value = _roman(n.lower())
    elif any(c.isdigit() for c in n):
        value = int(n.translate(_AS_DIGITS))
    else:
        return None
    return value, bool(m["deco"] or m["end"] or m["of"])


@functools.lru_cache(100_000)
def _skeleton_py(s: str) -> str:
    s = s.translate(_BARS).lower().translate(_LIKE)
    for a, b in _STROKES:
        s = s.replace(a, b)
    return s


# Strokes of letters, so that whatever is confused has the same strokes.
_STROKES = (("f", "t"), ("e", "c"), ("d", "cl"), ("i", "l"), ("r", "l"), ("m", "lll"), ("n", "ll"), ("u", "ll"), ("h", "ll"), ("b", "ll"), ("w", "vv"))


def skeleton(word: Column) -> Column:
    """The same for a column: equal for words that differ in confusable glyphs and letter case."""
    s = F.translate(F.lower(F.translate(word, "I|!", "lll")), "1@05924$836", "laosgzasbeb")
    for a, b in _STROKES:
        s = F.replace(s, F.lit(a), F.lit(b))
    return s


def _mask(line: str) -> str:
    """A line as it compares with other pages' lines: numbers masked, glyphs as strokes, F as E."""
    return " ".join(["#" if _MASKED.fullmatch(t) else _skeleton_py(t.replace("F", "E")) for t in line.split()])


def explains(read: str, printed: str) -> bool:
    """Whether confusions alone turn the printed word into the read one (lower case)."""
    if read == printed:
        return False
    seen = {(0, 0)}
    todo = [(0, 0)]
    while todo:
        i, j = todo.pop()
        if i == len(read) and j == len(printed):
            return True
        steps = [(i + 1, j + 1)] if i < len(read) and j < len(printed) and read[i] == printed[j] else []
        steps += [(i + len(a), j + len(b)) for a, b in CONFUSED if read.startswith(a, i) and printed.startswith(b, j)]
        for s in steps:
            if s not in seen:
                seen.add(s)
                todo.append(s)
    return False


def edge_lines(lines: list[str], most: int) -> list[tuple]:
    """What may be a header or a page number at a page's two edges: the lines from the edge inwards
    up to the first that is neither, at most ``most`` titles and one line more.

    (line, mask or None, number or None, marked, alone, clear, top, step, solid lines from here on,
    whether there are more such lines).
    """
    lines = [x.strip() for x in lines]
    solid = [k for k, x in enumerate(lines) if x]
    width = max(map(len, lines), default=0)
    out: list[tuple] = []
    for top in (True, False):
        titles, side, more = 0, [], False
        for step in range(len(solid) - 1):
            k = solid[step] if top else solid[-1 - step]
            place = (top, step, len(solid) - step)
            line = lines[k]
            more = step > most
            if more:
                break
            number = page_number(line)
            if number:
                side.append((k, None, *number, True, True, *place))
                continue
            parts = [p.strip() for p in _PARTS.split(line) if p.strip()]
            number = None
            if len(parts) > 1:
                for at in (0, -1):
                    number = page_number(parts[at])
                    if number:
                        parts.pop(at)
                        break
            head = " ".join(parts)
            if not any(c.isalpha() for c in head):
                break
            more = titles == most
            if more:
                break
            titles += 1
            if top:
                after = solid[step + 1]
                word = lines[after].split()[0]
                broken = after > k + 1 or (len(line) + 1 + len(word) <= width and not word[:1].islower())
            else:
                before = solid[-2 - step]
                broken = before < k - 1 or lines[before].endswith(_ENDS)
            # a second title line counts by recurrence only
            side.append((k, _mask(head), *(number or (None, False)), False, titles == 1 and broken and not _SENTENCE.search(head), *place))
        out += [(*x, more) for x in side]
    return out


def parse_page(text: str, most: int = 2) -> dict:
    """What stands at a page's edges, its words cut at line ends, and its words."""
    lines = text.replace("\r\n", "\n").replace("\r", "\n").split("\n")
    cuts, joined = [], text
    if len(lines) > 1:
        for m in _CUT.finditer(text):
            first = _WORD_END.search(text, text.rfind("\n", 0, m.start()) + 1, m.start())
            if first:
                cuts.append((first[0], m[1], m[2]))
            joined = None
        if joined is None:  # words are joined only where there is a hyphen at a line's end
            joined = _HARD.sub("", _SOFT.sub("", text))
    words = " ".join(filter(None, map(str.strip, _SPLIT.split(joined), itertools.repeat("'’‘-"))))
    return {"edges": edge_lines(lines, most), "cuts": cuts, "words": words}


_EDGES = "array<struct<line:int,mask:string,n:bigint,marked:boolean,alone:boolean,clear:boolean,top:boolean,step:int,solid:int,more:boolean>>"
_PARSED = f"i bigint, p string, t double, edges {_EDGES}, cuts array<struct<a:string,mark:string,b:string>>, words string"


def pages(df: DataFrame, id_: str, path: str, time: str, text: str) -> DataFrame:
    """The rows that are pages of scanned papers: columns i, p (paper), t (order), x (text).

    A paper is a file of a scanned kind whose rows are numbered in whole steps, not timed.
    """
    base = df.select(F.col(id_).cast("bigint").alias("i"), F.col(path).alias("p"), F.col(time).cast("double").alias("t"), F.col(text).alias("x")).where(F.col("p").rlike(PAGE_FILES))
    whole = F.avg(F.when(F.col("t") == F.floor("t"), 1.0).when(F.col("t").isNotNull(), 0.0))
    papers = base.groupBy("p").agg(whole.alias("whole")).where("whole > 0.8").select("p")
    return base.join(papers, "p").where("trim(x) <> ''")


def parsed(pages_: DataFrame) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(i, p, t, *parse_page(x).values()) for i, p, t, x in zip(pdf["i"], pdf["p"], pdf["t"], pdf["x"])]
            yield pd.DataFrame(rows, columns=["i", "p", "t", "edges", "cuts", "words"])

    return pages_.mapInPandas(run, _PARSED)


def _with_edges(pages_: DataFrame, most: int) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            edges = [edge_lines(x.replace("\r\n", "\n").replace("\r", "\n").split("\n"), most) for x in pdf["x"]]
            yield pd.DataFrame({"i": pdf["i"], "p": pdf["p"], "t": pdf["t"], "edges": edges})

    return pages_.select("i", "p", "t", "x").mapInPandas(run, f"i bigint, p string, t double, edges {_EDGES}")


def edge_noise(read: DataFrame, pages_: DataFrame, most: int = 2) -> DataFrame:
    """i, line, header, pagenum, alone, pages: the edge lines that are a header, a page number or both.

    Where all lines read at an edge are noise and there may be more, the page is read again further
    in, until that is so nowhere; ``most`` is how many titles an edge is read for at first.
    """
    e, done, total = cut(_keyed(read)), None, read.select("t", *_key("paper", "p"))
    while True:
        found = cut(_edge_noise(e, total))
        full = found.groupBy(*PAPER, "i", "top").agg(F.count("*").alias("n"), F.max("more").alias("more"), F.max("read").alias("read")).where("more and n = read")
        deeper = cut(full.select(*PAPER, "i").distinct())
        again = deeper.select(*PAPER).distinct()  # papers, since other pages' lines count as well
        now = found.join(again, PAPER, "left_anti")
        done = now if done is None else done.unionByName(now)
        if deeper.isEmpty():
            return done.where("header or pagenum").select("i", "line", "header", "pagenum", "alone", "pages")
        most *= 4
        fresh = _keyed(_with_edges(pages_.join(deeper.select("i"), "i", "left_semi"), most))
        e = cut(e.join(again, PAPER, "left_semi").join(deeper.select("i"), "i", "left_anti").unionByName(fresh))
        total = total.join(again, PAPER, "left_semi")


PAPER, MASK, OFFSET, NUMBER = (["paper1", "paper2"], ["mask1", "mask2"], ["off1", "off2"], ["num1", "num2"])


def _key(name: str, *columns: str | Column, when: Column | None = None) -> list[Column]:
    """Two hashes (96 bits) that stand for a key, which is cheaper to sort and to move than its text."""
    made = (F.xxhash64(*columns), F.hash(*columns))
    return [(h if when is None else F.when(when, h)).alias(f"{name}{k}") for k, h in enumerate(made, 1)]


def _keyed(read: DataFrame) -> DataFrame:
    """The edge lines of pages, with the keys they are counted by."""
    e = read.select("i", "p", "t", F.explode("edges").alias("e")).select("i", "p", "t", "e.*")
    masked, numbered = F.col("mask").isNotNull(), F.col("n").isNotNull()
    sentence = F.coalesce(F.col("mask").rlike(_SENTENCE.pattern) & (F.size(F.split("mask", " ")) > 4), F.lit(False))
    return e.select(
        "i", "t", "line", "n", "marked", "alone", "clear", "top", "step", "solid", "more", sentence.alias("sentence"), *_key("paper", "p"), *_key("mask", "p", "top", "mask", when=masked),
        *_key("off", "p", F.col("n") - F.floor("t"), when=numbered & F.col("t").isNotNull()), *_key("num", "p", "n", when=numbered),
    )


def _edge_noise(e: DataFrame, pages_: DataFrame) -> DataFrame:
    total = pages_.groupBy(*PAPER).agg(F.count_distinct("t").alias("total"))
    masks = e.where("mask1 is not null").groupBy(*MASK).agg(F.count_distinct("t").alias("pages"), F.max("clear").alias("title"))
    offsets = e.where("off1 is not null").groupBy(*OFFSET, *PAPER).agg(F.count_distinct("t").alias("same_off"))
    values = e.where("num1 is not null").groupBy(*NUMBER).agg(F.count_distinct("t").alias("same_n"))
    best = offsets.groupBy(*PAPER).agg(F.max("same_off").alias("best"))
    # by paper; a paper with a large share of all pages is split by the adaptive skew join
    papers = total.join(best, PAPER, "left")
    all_ = e.join(masks, MASK, "left").join(offsets.drop(*PAPER), OFFSET, "left").join(values, NUMBER, "left").join(papers, PAPER, "left")
    number = F.col("n").isNotNull() & (
        F.col("marked") | (F.col("same_off") >= 2) | (F.col("alone") & F.col("t").isNull()) | ((F.col("same_n") < 2) & (F.coalesce("best", F.lit(0)) < 2)) | (F.col("alone") & (F.coalesce("best", F.lit(0)) < 2))
    )
    # text recurs as well: on a few of many pages, or in whole sentences
    often = (F.col("pages") >= 3) & (4 * F.col("pages") >= F.col("total")) & ~F.col("sentence")
    header = F.col("mask1").isNotNull() & (often | ((F.col("pages") >= 2) & F.col("title")) | F.col("clear"))
    cols = ("line", "header", "pagenum", "alone", "pages", "top", "step", "solid", "more")
    told = all_.select(*PAPER, "i", F.struct("line", F.coalesce(header, F.lit(False)).alias("header"), F.coalesce(number, F.lit(False)).alias("pagenum"), "alone", F.coalesce("pages", F.lit(0)).alias("pages"), "top", "step", "solid", "more").alias("e"))
    by_page = told.groupBy(*PAPER, "i").agg(F.collect_list("e").alias("edges"))  # the lines read of one page

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(p, q, i, *x) for p, q, i, edges in zip(pdf["paper1"], pdf["paper2"], pdf["i"], pdf["edges"]) for x in outer_noise([tuple(e[c] for c in cols) for e in edges])]
            yield pd.DataFrame(rows, columns=[*PAPER, "i", "line", "header", "pagenum", "alone", "pages", "top", "more", "read"])

    return by_page.mapInPandas(run, "paper1 bigint, paper2 int, i bigint, line int, header boolean, pagenum boolean, alone boolean, pages bigint, top boolean, more boolean, read bigint")


def outer_noise(edges: list[tuple]) -> list[tuple]:
    """Of the edge lines of a page (line, header, number, alone, pages, top, step, solid, more) those
    that are noise and have nothing but noise beyond them; one line of a page stays."""
    out, taken = [], 0
    for top in (True, False):
        side = sorted((e for e in edges if e[5] == top), key=lambda e: e[6])
        for n, (line, header, number, alone, n_pages, _, step, solid, more) in enumerate(side):
            if step != n or not (header or number or alone):
                break
            if top or solid - taken >= 2:
                out.append((line, header, number, alone, n_pages, top, more, len(side)))
        taken = len(out)
    return out


def token_counts(texts: DataFrame, pattern: re.Pattern, between: str = "\n") -> DataFrame:
    """``w``, ``n``: the tokens of all texts (column x) between what the pattern splits at, as it does at
    ``between``.

    Workers count before anything is shuffled, so that a token leaves a worker a few times however
    often it occurs.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n: Counter[str] = Counter()
        for pdf in batches:
            n.update(pattern.split(between.join(pdf["x"])))
            if len(n) > COUNTED:
                yield pd.DataFrame(list(n.items()), columns=["w", "n"])
                n.clear()
        yield pd.DataFrame(list(n.items()), columns=["w", "n"])

    counted = texts.where("x is not null").select("x").mapInPandas(run, "w string, n bigint")
    return counted.where("w <> ''").groupBy("w").agg(F.sum("n").alias("n"))


def vocabulary(texts: DataFrame) -> DataFrame:
    """Lower-case words of all texts (column x) with their counts and skeletons."""
    w = token_counts(texts, _SPLIT).select(F.lower(F.regexp_replace("w", "^['’‘-]+|['’‘-]+$", "")).alias("w"), "n").where("w <> ''")
    return w.groupBy("w").agg(F.sum("n").alias("n")).withColumn("s", skeleton(F.col("w")))


def misread_words(read: DataFrame, words: DataFrame) -> DataFrame:
    """i, read_as, printed: words of pages that are misreadings.

    A form is tried against every frequent form of its skeleton. Of those it may be a misreading
    of, the one the words beside it support most is the printed one, one a page for each form.
    """
    frequent = words.where("n >= 2").select("s", F.col("w").alias("f"), F.col("n").alias("fn"))
    # capital I and small l differ in print only: compare as read, not in lower case
    # F and E differ by a stroke in capitals only: each capital F is tried as an E
    as_e = F.array(F.col("raw"), F.replace("raw", F.lit("F"), F.lit("E")), F.regexp_replace("raw", "(?<=.)F", "E"), F.regexp_replace("raw", "^F", "E"))
    forms = token_counts(read.select(F.col("words").alias("x")), re.compile(" "), " ").select(F.col("w").alias("raw"), F.lower("w").alias("w"))
    code = F.col("raw").rlike(r"^S\d+F\d+$")  # season and episode
    odd = code | F.col("raw").rlike(r"(?=.*\p{L})(?=.*[0-9@|$!])") | F.col("raw").rlike(r"\p{Ll}I|^I[bcdfghjklmpqrvwxyz]*[aeiou]\p{Ll}")
    own = words.select(F.col("w"), F.col("n").alias("wn"))
    known = forms.where(F.length("raw") > 1).join(own, "w", "left").withColumn("wn", F.coalesce("wn", F.lit(1))).withColumn("odd", odd)
    tried = known.withColumn("s", F.explode(F.array_distinct(F.transform(as_e, skeleton)))).join(frequent, "s").where((F.col("f") != F.col("w")) & (F.col("f").rlike("^[^0-9@|$!]+$") | code))
    tried = tried.where((F.col("fn") >= RARER * F.col("wn")) | (F.col("odd") & (F.struct("fn", "f") > F.struct("wn", "w"))))

    @F.pandas_udf("boolean")
    def ok(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([explains(x.lower(), y) or explains(re.sub("I(?=[^A-Z]|$)", "l", x).lower(), y) for x, y in zip(a, b)], dtype="bool")

    odd_number = F.col("raw").rlike(r"^[sSeE]?\d+[eExX]?\d*(st|nd|rd|th|s|x|p|k|fps|mm|am|pm)?$")
    pairs = cut(tried.where(~odd_number).select("raw", "f", "odd", "fn").distinct().where(ok("raw", "f")))
    # neighbours are read from the page itself; only rows with a word in question leave it, told
    # by hashes first, which are cheaper to look up than words
    at = read.select("i", F.split("words", " ").alias("ws")).select("i", "ws", F.posexplode("ws").alias("k", "raw")).withColumn("h", F.xxhash64("raw"))
    tested = at.join(small(pairs.select(F.xxhash64("raw").alias("h")).distinct(), 16), "h", "left_semi")
    beside = lambda k: F.lower(F.get("ws", k))
    side = tested.select("i", "raw", F.when(F.col("k") > 0, beside(F.col("k") - 1)).alias("before"), beside(F.col("k") + 1).alias("after"))
    near = cut(side.join(small(pairs, 100), "raw"))
    # how often these neighbours stand beside the printed forms, on all pages: counted by hashes
    hash_of = lambda side, x, w: F.xxhash64(F.lit(side), x, w)
    sides = [near.select(F.lit(side).alias("side"), F.col(x).alias("x"), F.col("f").alias("w"), hash_of(side, F.col(x), F.col("f")).alias("h")) for side, x in (("l", "before"), ("r", "after"))]
    wanted = cut(sides[0].unionByName(sides[1]).where("x is not null").distinct())
    known = lambda side: small(wanted.where(F.col("side") == side).select(F.col("h").alias(f"h{side}"), F.lit(True).alias(side)).distinct(), 16)
    low = read.select(F.split(F.lower("words"), " ").alias("ws")).select("ws", F.posexplode("ws").alias("k", "w"))
    before, after = F.when(F.col("k") > 0, F.get("ws", F.col("k") - 1)), F.get("ws", F.col("k") + 1)
    met = low.select(hash_of("l", before, F.col("w")).alias("hl"), hash_of("r", after, F.col("w")).alias("hr")).join(known("l"), "hl", "left").join(known("r"), "hr", "left").where("l or r")
    counted = met.select(F.explode(F.array(F.when(F.col("l"), F.col("hl")), F.when(F.col("r"), F.col("hr")))).alias("h")).where("h is not null").groupBy("h").agg(F.count("*").alias("c"))
    support = cut(wanted.join(counted, "h"))
    of = lambda side, x, name: small(support.where(F.col("side") == side).select(F.col("x").alias(x), F.col("w").alias("f"), F.col("c").alias(name)), 100)
    held = near.join(of("l", "before", "l"), ["before", "f"], "left").join(of("r", "after", "r"), ["after", "f"], "left")
    l, r = F.coalesce("l", F.lit(0)), F.coalesce("r", F.lit(0))
    fits = held.where(F.col("odd") | (l >= 2) | (r >= 2)).groupBy("i", "raw", "f", "fn").agg(F.sum(l + r).alias("support"))
    return fits.groupBy("i", F.col("raw").alias("read_as")).agg(F.max_by("f", F.struct("support", "fn", "f")).alias("printed"))


def cut_words(read: DataFrame, words: DataFrame) -> DataFrame:
    """i, a, mark, b: words cut in two at a line end, as against hyphens that belong there."""
    c = read.select("i", F.explode("cuts").alias("c")).select("i", "c.*")
    c = c.withColumn("j", F.lower(F.concat("a", "b"))).withColumn("h", F.lower(F.concat("a", F.lit("-"), "b")))
    soft = F.col("mark").isin("\xad", "¬")
    counted = c.join(words.select(F.col("w").alias("j"), F.col("n").alias("nj")), "j", "left").join(words.select(F.col("w").alias("h"), F.col("n").alias("nh")), "h", "left")
    nj, nh = F.coalesce("nj", F.lit(0)), F.coalesce("nh", F.lit(0))
    return counted.where(soft | (nj > nh) | ((nj == nh) & F.col("b").rlike(r"^\p{Ll}"))).select("i", "a", "mark", "b")


def _parts(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    captions = table(spark, folder, "captions")
    these = cut(pages(captions, "caption_id", "media_path", "time", "text"))
    read = cut(parsed(these))
    words = cut(vocabulary(captions.select(F.col("text").alias("x"))))
    return these, edge_noise(read, these), cut_words(read, words), misread_words(read, words), read


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per kind of noise on a page."""
    _, edges, cuts, wrong, _ = _parts(spark, sf_dir)
    kinds = [edges.where("header").select("i", F.lit("header").alias("kind")), edges.where("pagenum").select("i", F.lit("pagenum").alias("kind")), cuts.select("i", F.lit("hyphenation").alias("kind")), wrong.select("i", F.lit("misread").alias("kind"))]
    out = kinds[0]
    for k in kinds[1:]:
        out = out.unionByName(k)
    return out.distinct().select(F.col("i").alias("caption_id"), "kind")


def clean(these: DataFrame, edges: DataFrame, cuts: DataFrame, wrong: DataFrame) -> DataFrame:
    """Pages without their noise: ``i``, ``clean`` (paragraphs parted by a blank line).

    Header and page-number lines go, cut words are joined, misreadings give way to the printed
    form in the letter case they were read in, and lines are reflowed into paragraphs.
    """
    page = W.partitionBy("i").orderBy("k")
    gone = edges.select("i", F.col("line").alias("k"), F.lit(True).alias("gone")).distinct()
    lines = these.select("i", F.posexplode(F.split(F.regexp_replace("x", r"\r\n?", "\n"), "\n")).alias("k", "line")).join(gone, ["i", "k"], "left")
    kept = lines.where("gone is null").withColumn("blank", F.trim("line") == "")
    kept = kept.withColumn("para", F.sum(F.col("blank").cast("int")).over(page.rowsBetween(W.unboundedPreceding, 0))).where("not blank")
    kept = kept.withColumn("a", F.regexp_extract("line", r"(?U)(\w[\w@|]*)[-‐‑\u00ad¬]\s*$", 1)).withColumn("b", F.regexp_extract(F.lead("line").over(page), r"(?U)^\s*([\w@|]+)", 1))
    joins = cuts.select("i", "a", "b", F.lit(True).alias("cut")).distinct()
    pieces = kept.join(joins, ["i", "a", "b"], "left").select(
        "i", "k", "para", F.when(F.col("cut"), F.regexp_replace(F.trim("line"), r"[-‐‑\u00ad¬]$", "")).otherwise(F.concat(F.trim("line"), F.lit(" "))).alias("piece")
    )
    # a paragraph that ends within a word goes on after the gap its page number has left
    step = W.partitionBy("i").orderBy("k")
    pieces = pieces.withColumn("start", (F.col("para") != F.lag("para").over(step)) & F.lag("piece").over(step).endswith(" "))
    text = pieces.groupBy("i").agg(F.array_sort(F.collect_list(F.struct("k", F.when(F.col("start"), F.concat(F.lit("\n\n"), "piece")).otherwise(F.col("piece")).alias("piece")))).alias("all"))
    text = text.select("i", F.regexp_replace(F.trim(F.array_join(F.col("all.piece"), "")), r" *\n\n", "\n\n").alias("clean"))
    upper = (F.upper("read_as") == F.col("read_as")) & (F.length(F.regexp_replace("read_as", r"\P{Lu}", "")) > 1)
    capital = F.col("read_as").rlike(r"^\p{Lu}") & ~F.col("read_as").rlike(r"^I[\p{Ll}]")
    cased = F.when(upper, F.upper("printed")).when(capital, F.concat(F.upper(F.substring("printed", 1, 1)), F.substring("printed", 2, 99))).otherwise(F.col("printed"))
    fixes = wrong.select("i", F.struct(F.length("read_as").alias("size"), F.col("read_as").alias("w"), cased.alias("f")).alias("fix")).groupBy("i").agg(F.array_sort(F.collect_set("fix")).alias("fixes"))
    whole = lambda w: F.concat(F.lit(r"(?<![\p{L}\p{N}@|])\Q"), w, F.lit(r"\E(?![\p{L}\p{N}@|])"))
    fixed = F.aggregate(F.col("fixes"), F.col("clean"), lambda t, x: F.regexp_replace(t, whole(x["w"]), x["f"]))
    out = text.join(fixes, "i", "left").select("i", F.when(F.col("fixes").isNull(), F.col("clean")).otherwise(fixed).alias("clean"))
    return these.select("i").join(out, "i", "left").select("i", F.coalesce("clean", F.lit("")).alias("clean"))


def p3_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as continuous paragraphs."""
    these, edges, cuts, wrong, _ = _parts(spark, sf_dir)
    return clean(these, edges, cuts, wrong).withColumnRenamed("i", "caption_id")


QUERIES = {"p3_found": p3_found, "p3_clean": p3_clean}
