"""Problem 1: text garbled by a wrong character encoding, found and restored.

The corpus' own clean words are garbled under every encoding chain in question; the tokens of all
field values are hash-joined with that table, which tells garbled tokens and their originals. A
token whose original occurs nowhere clean is undone character by character (the same chains), and
is held to be garbled only if all characters that come out are those of clean words.
"""

from __future__ import annotations

import functools
import re
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reelbase.tables import cut, small, table

LOST = "�"
# Encodings that UTF-8 bytes are misread as, and pairs of one-byte encodings taken
# for each other (written, read).
UTF8_AS = ("cp1252", "latin-1", "mac_roman", "cp437", "cp850", "cp1251", "cp1250", "koi8-r", "cp866", "iso8859-15")
SWAPPED = (
    ("cp1252", "cp1250"), ("cp1250", "cp1252"), ("iso8859-2", "latin-1"), ("latin-1", "iso8859-2"), ("iso8859-2", "cp1250"),
    ("cp1251", "cp1252"), ("cp1251", "latin-1"), ("cp1252", "cp1251"), ("cp1251", "koi8-r"), ("koi8-r", "cp1251"), ("koi8-r", "cp1252"),
    ("cp1251", "cp866"), ("cp866", "cp1251"), ("cp866", "cp1252"), ("cp1251", "mac_roman"), ("cp1252", "mac_roman"), ("mac_roman", "cp1252"),
    ("cp437", "cp1252"), ("cp850", "cp1252"), ("cp1252", "cp437"), ("cp1252", "cp850"), ("cp1252", "cp1253"), ("cp1252", "cp1254"),
    ("cp1250", "latin-1"), ("mac_roman", "latin-1"), ("cp437", "latin-1"), ("cp850", "latin-1"), ("shift_jis", "cp1252"), ("shift_jis", "latin-1"), ("euc_jp", "cp1252"), ("euc_jp", "latin-1"),
)
#: A token is a misreading between one-byte encodings only if its original is so many times as
#: frequent, and it occurs this often itself.
RARER, ORIGINAL_TIMES = 3, 3
#: Tokens of scripts without spaces are runs of words.
UNSPACED = "[\u0e00-\u0eff\u3040-\u30ff\u3400-\u9fff]"
#: Characters of clean words whose forms are made before a batch of them goes on.
BATCH_CHARS = 20_000
FIELDS = (("captions", "caption_id", ("text",)), ("media", "media_id", ("title", "artist")))

_SPACE, _ODD_SPACE = re.compile("([ \t\r\n]+)"), re.compile("[\xa0\x85\\s]+")
_MARKS = "".join(c for c in map(chr, range(0x21, 0x7F)) if not c.isalnum())
_ASCII_MARKS = r"[\x21-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E]+"
#: Blocks that the original of garbled text may come from.
_BLOCKS = re.compile("[ -ſȘ-ț̀-ͯͰ-ϿЀ-џҐ-ґḀ-ỿ‐-⁄₠-₿℀-⅏←-⇿∀-⋿─-➿　-ヿ㐀-鿿가-힯＀-￯\U0001f000-\U0001faff]+")


@functools.cache
def _bytes(encoding: str) -> dict[int, str]:
    return {b: bytes([b]).decode(encoding, "ignore") or chr(b) for b in range(256)}


def _read(data: bytes, encoding: str) -> str:
    """Decoded text of a one-byte encoding; bytes that it leaves undefined stay as they are."""
    return data.decode("latin-1").translate(_bytes(encoding))


def _garble(text: str, written: str, read: str, times: int = 1) -> str:
    for _ in range(times):
        text = _read(text.encode(written, "surrogatepass" if written == "utf-8" else "strict"), read)
    return text


@functools.lru_cache(1 << 18)
def _garbled_char(c: str, written: str, read: str, times: int) -> tuple[str, list[str]]:
    """A garbled character, and what odd spaces part it into."""
    form = _garble(c, written, read, times)
    return form, _ODD_SPACE.split(form)


@functools.cache
def _misread(encoding: str) -> tuple[dict[str, int], re.Pattern]:
    """The bytes that characters stand for, and a pattern of what UTF-8 sequences look like."""
    chars = [_read(bytes([b]), encoding) for b in range(0x80, 0x100)]
    of = {c: b for b, c in enumerate(chars, 0x80)}
    group = lambda a, b: "[" + "".join(re.escape(c) for c, x in of.items() if a <= x <= b) + "]"
    more = group(0x80, 0xBF)
    return of, re.compile(f"{group(0xF0, 0xF4)}{more}{{3}}|{group(0xE0, 0xEF)}{more}{{2}}|{group(0xC2, 0xDF)}{more}")


def undo(token: str) -> list[str]:
    """Texts that a misreading of UTF-8 would turn into ``token``, wholly or in part."""
    out = []
    for encoding in UTF8_AS:
        of, pattern = _misread(encoding)
        text, changed = token, False
        for _ in range(3):  # read wrongly up to three times

            def back(m: re.Match) -> str:
                try:
                    s = bytes(of[c] for c in m[0]).decode("utf-8")
                except UnicodeDecodeError:
                    return m[0]
                return s if _BLOCKS.fullmatch(s) or s < "\xa0" or s in of else m[0]  # read wrongly again, it is one of these signs

            new = pattern.sub(back, text)
            if new == text:
                break
            text, changed = new, True
        if changed:
            out.append(text)
    if any("\x80" <= c < "\xa0" for c in token) or 2 * sum("\xa0" <= c <= "\xff" for c in token) > len(token) > 1:
        for encoding in ("shift_jis", "euc_jp"):
            for read in ("latin-1", "cp1252"):
                of, _ = _misread(read)
                try:
                    s = bytes(of.get(c, ord(c) if c < "\x80" else 256) for c in token).decode(encoding)
                except (UnicodeDecodeError, ValueError):
                    continue
                if re.search("[\u3041-\u30ff]" if len(token) > 3 else "^[\u266a-\u266f]+$", s):
                    out.append(s)
    return list(dict.fromkeys(out))


def _parts(word: str, form: str, *chain) -> list[tuple[str, str]]:
    """(form, original) of a garbled word, and of its parts where odd spaces within it were taken
    for plain ones; a part's original is the characters that it begins."""
    if not _ODD_SPACE.search(form):
        return [(form, word)]
    out, text, original, whole = [(form, word)], [], [], []
    for c in word:
        one, (first, *more) = _garbled_char(c, *chain)
        whole.append(one)
        text.append(first)
        original.append(c)
        for m in more:
            out.append(("".join(text), "".join(original)))
            text, original = [m], []
    return [*out, ("".join(text), "".join(original))] if "".join(whole) == form else out[:1]


def garbled_forms(word: str) -> list[tuple[str, str, str, bool]]:
    """(form, original, chain, certain) of a clean word under all chains; certain: a misreading of UTF-8."""
    out: dict[str, tuple[str, str, bool]] = {}

    def add(form: str, chain: str, certain: bool, *garble) -> None:
        for f, original in _parts(word, form, *garble) if garble else [(form, word)]:
            if f and original and f != word and not f.isascii():
                out.setdefault(f, (original, chain, certain))

    data = word.encode("utf-8", "surrogatepass")
    for encoding in UTF8_AS:
        for times, name in (1, ""), (2, " twice"), (3, " thrice"):
            if times == 1 or encoding in ("cp1252", "latin-1"):
                add(_garble(word, "utf-8", encoding, times), f"utf-8>{encoding}{name}", True, "utf-8", encoding, times)
        if encoding in ("cp1252", "latin-1"):
            add(data.decode(encoding, "replace"), f"utf-8>{encoding} lossy", True)
    add(data.decode("ascii", "replace"), "utf-8>ascii lossy", True)
    add("".join(LOST if c > "\x7f" else c for c in word), "one lost", True)
    for written in ("cp1252", "cp1250", "cp1251", "shift_jis", "mac_roman"):
        try:
            add(word.encode(written).decode("utf-8", "replace"), f"{written}>utf-8 lossy", True)
        except UnicodeEncodeError:
            pass
    for written, read in SWAPPED:
        try:
            add(_garble(word, written, read), f"{written}>{read}", False, written, read, 1)
        except UnicodeEncodeError:
            pass
    return [(f, *x) for f, x in out.items()]


def _sum(form: str) -> int:
    return zlib.crc32(form.encode("utf-8", "surrogatepass"))


def _tokens(text: Column) -> Column:
    """The distinct tokens between plain white space that hold more than ASCII."""
    some = F.filter(F.split(text, r"[ \t\r\n]+"), lambda x: x.rlike(r"[^\x00-\x7F]"))
    return F.array_distinct(F.transform(some, lambda x: F.regexp_replace(x, rf"^{_ASCII_MARKS}|{_ASCII_MARKS}$", "")))


def values(spark: SparkSession, folder: str) -> DataFrame:
    """All values of the fields in question that hold more than ASCII."""
    out = None
    for name, id_, fields in FIELDS:
        df = table(spark, folder, name)
        for f in fields:
            part = df.select(F.lit(name).alias("table_name"), F.lit(f).alias("field_name"), F.col(id_).alias("row_id"), F.col(f).alias("x")).where(F.col("x").rlike(r"[^\x00-\x7F]"))
            out = part if out is None else out.unionByName(part)
    return out


def garbled_tokens(tokens: DataFrame) -> DataFrame:
    """The garbled ones of the tokens of a corpus (column ``token``, repeated as they occur).

    Result: ``token``, ``original`` (null where it is lost), ``chain``, ``sure``: by itself, or
    only next to others of its chain.
    """
    # few bytes but much work a token: without the repartitioning AQE would merge them into one task
    tasks = int(tokens.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counted = tokens.groupBy("token").agg(F.count("*").alias("n")).repartition(tasks, "token")

    def classify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for t, n in zip(pdf["token"], pdf["n"]):
                back = undo(t)
                odd = LOST in t or any("\x80" <= c < "\xa0" and c != "\x85" for c in t)
                rows.append((t, n, not back and not odd, odd, back))
            yield pd.DataFrame(rows, columns=["token", "n", "plain", "odd", "back"])

    seen = cut(counted.mapInPandas(classify, "token string, n bigint, plain boolean, odd boolean, back array<string>"))

    def forms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows, size = [], 0
            kept = map(set, pdf["cs"]) if "cs" in pdf else [None] * len(pdf)
            for k, (w, n, cs) in enumerate(zip(pdf["token"], pdf["n"], kept), 1):
                rows += [(f, original, n, chain, certain) for f, original, chain, certain in garbled_forms(w) if cs is None or _sum(f) in cs]
                size += len(w)
                if size > BATCH_CHARS or k == len(pdf):
                    yield pd.DataFrame(rows, columns=["token", "original", "n_original", "chain", "certain"])
                    rows, size = [], 0

    clean = seen.where("plain").select("token", "n")

    def marks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ids, sums, size = [], [], 0
            for k, (w, id_) in enumerate(zip(pdf["token"], pdf["w"]), 1):
                met = {_sum(f) for f, *_ in garbled_forms(w)}
                ids += [id_] * len(met)
                sums += met
                size += len(w)
                if size > BATCH_CHARS or k == len(pdf):
                    yield pd.DataFrame({"w": ids, "c": sums})
                    ids, sums, size = [], [], 0

    # where words are not spaced a token is a long run of them with long forms: only the checksums of
    # these are shuffled, and then the forms that met a token by theirs
    unspaced = F.col("token").rlike(UNSPACED)
    runs = clean.where(unspaced).withColumn("w", F.xxhash64("token")).repartition(tasks, "token")
    met = runs.select("token", "w").mapInPandas(marks, "w bigint, c bigint").join(seen.select(F.crc32(F.col("token")).alias("c")).distinct(), "c", "left_semi").groupBy("w").agg(F.collect_set("c").alias("cs"))
    shape = "token string, original string, n_original bigint, chain string, certain boolean"
    made = clean.where(~unspaced).mapInPandas(forms, shape).unionByName(runs.join(met, "w").select("token", "n", "cs").mapInPandas(forms, shape))
    odd_case = F.col("token").rlike(r"\p{Ll}\p{Lu}")
    rarer = (F.col("n_original") >= ORIGINAL_TIMES) & (F.col("n_original") >= RARER * F.col("n"))
    hits = seen.drop("back").join(made, "token").where((F.col("certain") & (~F.col("plain") | (F.length("token") == 1))) | rarer | odd_case)
    letters = F.length(F.regexp_replace("token", r"[^\p{L}\p{M}\p{S}\p{No}\p{P}]", ""))
    one_script = F.col("token").rlike(r"^\p{IsCyrillic}+$") & F.col("original").rlike(r"^\p{IsCyrillic}+$")
    sure = ~F.col("plain") | F.when(one_script, (F.length("token") >= 5) | (odd_case & (F.length("token") >= 3))).otherwise(letters >= 3)
    joined = cut(hits.groupBy("token").agg(F.max_by(F.struct("original", "chain", sure.alias("sure")), F.struct("certain", "n_original", "original")).alias("h")).select("token", "h.*"))

    # what no clean word explains: undone, and verified by the characters of clean words
    rest = seen.where(~F.col("plain")).join(joined.select("token"), "token", "left_anti")
    chars = clean.select(F.explode(F.array_distinct(F.split("token", ""))).alias("c")).where("c <> ''").distinct()
    tried = rest.select("token", F.explode("back").alias("original"))
    known = tried.select("token", "original", F.explode(F.array_distinct(F.split("original", ""))).alias("c")).where(F.col("c").rlike(r"[^\x00-\x7F]"))
    verified = known.join(chars.withColumn("ok", F.lit(1)), "c", "left").groupBy("token", "original").agg((F.count("ok") == F.count("*")).alias("all_known")).where("all_known")
    undone = verified.groupBy("token").agg(F.min_by("original", F.struct(F.length("original"), "original")).alias("original"))
    lost = rest.where("odd").join(undone.select("token"), "token", "left_anti").select("token", F.lit(None).cast("string").alias("original"), F.lit("unknown").alias("chain"), F.lit(True).alias("sure"))
    return joined.unionByName(undone.select("token", "original", F.lit("undone").alias("chain"), F.lit(True).alias("sure"))).unionByName(lost)


def garbled_values(df: DataFrame) -> DataFrame:
    """The garbled ones of ``values`` with the original text where it can be known.

    Result: ``table_name``, ``field_name``, ``row_id``, ``restored`` and ``is_lost`` (a part of the
    original stays unknown and as it was). Null, empty and plain ASCII values are never garbled;
    repeated rows come out each on their own; an empty table gives no rows.
    """
    exploded = df.select("table_name", "field_name", "row_id", F.explode(_tokens(F.col("x"))).alias("token")).where("token <> ''")
    bad = cut(garbled_tokens(exploded.select("token")))
    found = exploded.join(small(bad, 200), "token")
    grouped = found.groupBy("table_name", "field_name", "row_id").agg(
        F.collect_list(F.struct("token", "original", "chain", "sure")).alias("all"), F.collect_set(F.when(F.col("sure"), F.col("chain"))).alias("chains")
    )
    kept = grouped.where(F.size("chains") > 0).withColumn("all", F.filter("all", lambda x: x["sure"] | F.array_contains("chains", x["chain"])))
    known = F.filter("all", lambda x: x["original"].isNotNull())
    back = kept.join(df, ["table_name", "field_name", "row_id"])
    restored = F.pandas_udf(_restored, "string")("x", F.transform(known, lambda x: x["token"]), F.transform(known, lambda x: x["original"]))
    return back.select("table_name", "field_name", "row_id", restored.alias("restored"), F.exists("all", lambda x: x["original"].isNull()).alias("is_lost"))


def _restored(text: pd.Series, tokens: pd.Series, originals: pd.Series) -> pd.Series:
    """Texts with tokens, wherever they stand as such, replaced by their originals; all else,
    white space and marks included, as it was."""
    out = []
    for x, a, b in zip(text, tokens, originals):
        known = dict(zip(a, b))
        pieces = _SPACE.split(x)
        for k in range(0, len(pieces), 2):
            bare = pieces[k].strip(_MARKS)
            if bare in known:
                pieces[k] = pieces[k].replace(bare, known[bare], 1)
        out.append("".join(pieces))
    return pd.Series(out)


def found_values(df: DataFrame) -> DataFrame:
    """The keys alone of ``garbled_values``."""
    exploded = df.select("table_name", "field_name", "row_id", F.explode(_tokens(F.col("x"))).alias("token")).where("token <> ''")
    bad = cut(garbled_tokens(exploded.select("token")))
    return exploded.join(small(bad.where("sure").select("token"), 100), "token", "left_semi").select("table_name", "field_name", "row_id").distinct()


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The garbled values of captions.text, media.title and media.artist."""
    return found_values(values(spark, sf_dir))


def p1_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with the original text."""
    return garbled_values(values(spark, sf_dir))


QUERIES = {"p1_found": p1_found, "p1_restored": p1_restored}
