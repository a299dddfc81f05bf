"""Problem 5: languages of items and of the stretches of mixed texts.

A string kernel compares sentences by the n-grams both hold (presence, not counts, of all lengths
from 1 to 4, blended). Nyström landmarks stand in for the kernel matrix and one-versus-rest kernel
ridge regression gives a score for each language. A sentence's scores are linear in its n-grams
once the landmarks' coefficients are folded in, so batches are scored by matrix products.

The labels it learns from are the catalogue's own, some of them wrong: texts whose label is
contradicted by a model fitted without them are left out.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from reelbase.tables import cut, table

# How languages are written in labels.
LANGUAGES = {
    "en": "en eng english", "de": "de deu ger german deutsch", "fr": "fr fra fre french français francais", "es": "es spa spanish español espanol castilian castellano",
    "it": "it ita italian italiano", "pt": "pt por portuguese português portugues", "nl": "nl nld dut dutch nederlands flemish", "pl": "pl pol polish polski",
    "ru": "ru rus russian русский", "ja": "ja jpn jp japanese 日本語",
}
CODES = tuple(LANGUAGES)

#: The labelled sample: at most so many sentences a language, from at most about so many rows, none
#: of them longer than so many characters.
SENTENCES_PER_LANGUAGE, SAMPLE_ROWS, SAMPLE_CHARS = 400, 30_000, 20_000
LANDMARKS_PER_LANGUAGE, RIDGE = 40, 0.1
#: Below this score or this lead over the next language a sentence has no language.
LEAST_SCORE, LEAST_LEAD = 0.35, 0.25
#: Labels of languages with fewer texts in the sample are all trusted.
LEAST_TEXTS = 20
#: Bits of an n-gram's hash; the rest of a word numbers the texts of a batch.
KEY_BITS = 40

_END = re.compile(r"(?<=[.!?…。！？])[\"'”’»)\]]*(?:\s+|(?<=[。！？])|$)|\n\s*\n|\n\s*(?=[-–—•]\s)")
_MARKUP = re.compile(r"<[^<>]*>|\{\\[^{}]*\}|https?://\S+")
_QUOTED = re.compile(r"“[^“”\n]{1,80}”|„[^„“”\n]{1,80}[“”]|«[^«»\n]{1,80}»|‘[^‘’\n]{3,80}’|\"[^\"\n]{1,80}\"|「[^「」\n]{1,40}」|『[^『』\n]{1,40}』")
_QUOTE, _CUT, _NO_LETTER = re.compile("[“„«‘\"「『]"), re.compile("(?<=\\w)[-‐\u00ad¬]\\s*\n\\s*"), re.compile(r"[\W\d_]+")
_ENDED = re.compile(r"[.!?…。！？][\"'”’»)\]」』|/—–\s]*$")
_KANA = re.compile("[぀-ヿ㐀-鿿]")


def label(language: Column) -> Column:
    """The two-letter code of a label however it is written; null if it names no known language."""
    bare = F.regexp_replace(F.lower(F.trim(language)), r"^([a-z]{2,3})[-_][a-z0-9-]+$", "$1")
    return F.try_element_at(F.create_map(*[F.lit(x) for code, forms in LANGUAGES.items() for form in forms.split() for x in (form, code)]), bare)


def _chosen(language: Column, rank: Column, least: dict[str, float]) -> Column:
    """Whether a row's rank is below that of its language."""
    return rank < F.try_element_at(F.create_map(*[F.lit(x) for both in least.items() for x in both]), language) if least else F.lit(False)


def sentences(text: str) -> list[tuple[int, int, str]]:
    """(start, end, text) of the sentences of a text; single line breaks end none."""
    out, at = [], 0
    for m in _END.finditer(text):
        if m.end() > at:
            out.append((at, m.end(), text[at : m.end()]))
            at = m.end()
    if at < len(text):
        out.append((at, len(text), text[at:]))
    return out


def letters(sentence: str) -> str:
    """What of a sentence counts for its language: not markup, quoted titles or numbers."""
    if "<" in sentence or "{" in sentence or "://" in sentence:
        sentence = _MARKUP.sub(" ", sentence)
    if _QUOTE.search(sentence):
        sentence = _QUOTED.sub(" ", sentence)
    if "\n" in sentence:
        sentence = _CUT.sub("", sentence)
    return _NO_LETTER.sub(" ", sentence).strip().lower()


def is_full(bare: str) -> bool:
    """Whether what is left of a sentence is more than a name, a title or a call."""
    return len(bare) >= 8 if _KANA.search(bare) else len(bare) >= 15 and bare.count(" ") >= 3


def _grams(texts: list[str], n_max: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """(text's index, upper bits of a hash) of every n-gram of every text; texts are held by a space on each side."""
    joined = " " + "  ".join(texts) + " "
    cp = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    sizes = np.array([len(t) + 2 for t in texts])
    owner = np.repeat(np.arange(len(texts)), sizes)
    docs, keys = [], []
    h = np.zeros(len(cp), dtype=np.uint64)
    for n in range(1, n_max + 1):
        h = h[: len(cp) - n + 1] * np.uint64(0x9E3779B97F4A7C15) + cp[n - 1 :] + np.uint64(1)
        whole = owner[: len(h)] == owner[n - 1 :]
        docs.append(owner[: len(h)][whole])
        keys.append((h[whole] ^ np.uint64(n << 60)) >> np.uint64(64 - KEY_BITS))
    return np.concatenate(docs), np.concatenate(keys).astype(np.int64)


class StringKernel:
    """One-versus-rest kernel ridge regression over blended-spectrum presence kernels."""

    def __init__(self, texts: list[str], labels: np.ndarray, classes: int, per_class: int = LANDMARKS_PER_LANGUAGE, ridge: float = RIDGE):
        marks = np.concatenate([np.flatnonzero(labels == c)[:per_class] for c in range(classes)])
        doc, key = _grams([texts[i] for i in marks])
        self.keys, column = np.unique(key, return_inverse=True)
        held = np.zeros((len(self.keys), len(marks)), dtype=np.float32)
        held[column, doc] = 1
        held /= np.sqrt(held.sum(0, keepdims=True))
        k_mm = (held.T @ held).astype(np.float64)
        k_nm = np.concatenate([self._sums(texts[i : i + 128], held) for i in range(0, len(texts), 128)])
        val, vec = np.linalg.eigh(k_mm)
        root = vec @ np.diag(1 / np.sqrt(np.maximum(val, 1e-6))) @ vec.T
        phi = k_nm @ root
        y = np.where(labels[:, None] == np.arange(classes), 1.0, 0.0)
        share = y.sum(0) / len(y)
        weight = (1 / (share[labels] * classes))[:, None]  # every class counts alike
        beta = np.linalg.solve(phi.T @ (weight * phi) + ridge * len(y) / 100 * np.eye(len(marks)), phi.T @ (weight * y))
        self.weights = (held @ (root @ beta)).astype(np.float32)

    def _presence(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        doc, key = _grams(texts)
        pairs = np.sort((doc << KEY_BITS) | key)
        new = np.ones(len(pairs), dtype=bool)
        new[1:] = pairs[1:] != pairs[:-1]
        pairs = pairs[new]
        doc, key = pairs >> KEY_BITS, pairs & ((1 << KEY_BITS) - 1)
        size = np.bincount(doc, minlength=len(texts))
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        ok = self.keys[at] == key
        return doc[ok], at[ok], size

    def _sums(self, texts: list[str], rows: np.ndarray) -> np.ndarray:
        """The presence matrix (texts by n-grams) times ``rows``, over the root of each text's size."""
        doc, at, size = self._presence(texts)
        out = np.zeros((len(texts), rows.shape[1]), dtype=np.float32)
        if len(doc):
            first = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
            out[doc[first]] = np.add.reduceat(rows[at], first, axis=0)
        return out / np.sqrt(np.maximum(size, 1))[:, None]

    def scores(self, texts: list[str]) -> np.ndarray:
        """Texts by classes: the batch's presence matrix times the folded weights."""
        if not texts:
            return np.zeros((0, self.weights.shape[1]), dtype=np.float32)
        return self._sums(texts, self.weights)


class Remembered:
    """Rows of numbers by text, at most ``most`` of them; full, it forgets all."""

    def __init__(self, width: int, most: int = 200_000):
        self.at: dict[str, int] = {}
        self.rows = np.zeros((1024, width), dtype=np.float32)
        self.most = most

    def missing(self, texts: Iterable[str]) -> list[str]:
        """Those of the texts that are to be added, each once, before any is looked up."""
        every = dict.fromkeys(texts)
        new = [t for t in every if t not in self.at]
        if new and len(self.at) + len(new) > self.most:
            self.at.clear()
            new = list(every)
        return new

    def add(self, texts: list[str], rows: np.ndarray) -> None:
        n, k = len(self.at), len(texts)
        if n + k > len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros((max(k, len(self.rows)), self.rows.shape[1]), dtype=np.float32)])
        self.rows[n : n + k] = rows
        self.at.update(zip(texts, range(n, n + k)))

    def of(self, texts: list[str]) -> np.ndarray:
        return self.rows[[self.at[t] for t in texts]]


class Languages:
    """The languages of sentences, remembered."""

    def __init__(self, model: StringKernel | None, codes: list[str], remember: int = 200_000):
        self.model, self.codes, self.remember = model, codes, remember
        self.known: dict[str, tuple[str | None, float]] = {}
        self.vectors = Remembered(len(codes), remember)

    def look_up(self, new: set[str]) -> None:
        """Scores sentences that are not known yet."""
        if len(self.known) + len(new) > self.remember:
            self.known.clear()
        bare = {r: letters(r) for r in new}
        full = sorted(r for r, b in bare.items() if is_full(b)) if self.model is not None else []
        self.known.update((r, (None, 0.0)) for r in new)
        size, run = 0, []
        for r in [*full, None]:
            if run and (r is None or size > 200_000):
                scores = self.model.scores([bare[x] for x in run])
                order = np.sort(scores, axis=1)
                for t, c, top, second in zip(run, scores.argmax(1), order[:, -1], order[:, -2]):
                    lead = top - second
                    self.known[t] = (self.codes[c] if top >= LEAST_SCORE and lead >= LEAST_LEAD else None, float(1 / (1 + np.exp(-6 * (lead - 0.15)))))
                size, run = 0, []
            if r is not None:
                run.append(r)
                size += len(r)

    def main(self, texts: list[list[str]]) -> list[str | None]:
        """The language of most of each text, given its sentences: their scores summed by their length."""
        if self.model is None:
            return [None] * len(texts)
        out: list[str | None] = []
        for i in range(0, len(texts), 2048):
            raws = texts[i : i + 2048]
            self._score(self.vectors.missing(r for one in raws for r in one))
            n = np.array([len(one) for one in raws])
            total = np.zeros((len(raws), len(self.codes)))
            if n.any():
                total[n > 0] = np.add.reduceat(self.vectors.of([r for one in raws for r in one]), np.cumsum(n[n > 0]) - n[n > 0])
            out += [self.codes[c] if most > 0 else None for c, most in zip(total.argmax(1), total.max(1))]
        return out

    def _score(self, new: list[str], chars: int = 200_000) -> None:
        """Sentences' scores times their length, the shortest for nothing; some at a time."""
        run: list[str] = []
        size = 0
        for k, r in enumerate(new, 1):
            run.append(r)
            size += len(r)
            if size > chars or k == len(new):
                bares = [letters(x) for x in run]
                n = np.array([len(b) if len(b) >= 4 else 0 for b in bares])
                self.vectors.add(run, self.model.scores(bares) * n[:, None])
                run, size = [], 0

    def of(self, texts: list[str]) -> list[list[tuple[int, int, str, float]]]:
        """(start, end, language, confidence) of the full sentences of each text."""
        known = self.known
        for i in range(0, len(texts), 512):
            batch = texts[i : i + 512]
            cutted = [sentences(t) for t in batch]
            new = {r for s in cutted for _, _, r in s if r not in known}
            if new:
                if len(known) + len(new) > self.remember:
                    new = {r for s in cutted for _, _, r in s}
                self.look_up(new)
            for s, text in zip(cutted, batch):
                found = [(a, e, *known[r]) for a, e, r in s if known[r][0]]
                # among others, what ends in no mark is a heading or a name
                yield [x for x in found if _ENDED.search(text, x[0], x[1])] if len(s) > 1 else found


def fit(labelled: DataFrame, rows: int = SAMPLE_ROWS, per_language: int = SENTENCES_PER_LANGUAGE) -> tuple[StringKernel | None, list[str]]:
    """A model from labelled texts (columns x, lang), of which it reads a bounded sample.

    Each language gives about ``rows`` / 10 texts at most, taken by a hash of text and key.
    """
    labelled = labelled.where(F.col("lang").isNotNull() & (F.length("x") <= SAMPLE_CHARS))
    counts = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().collect()}  # one row a language
    share = rows // len(CODES)
    rank = F.pmod(F.xxhash64("x", "key"), F.lit(1_000_000)) / 1_000_000.0
    sample = labelled.where(_chosen(F.col("lang"), rank, {code: min(1.0, share / n) for code, n in counts.items()})).select("lang", "x", "key").collect()  # about ``rows``, which the hash of each row decides
    sample.sort(key=lambda r: (r["lang"], r["key"]))
    codes = sorted(counts)
    texts: list[str] = []
    owner: list[int] = []
    doc_label: list[int] = []
    for c, code in enumerate(codes):
        own = [(r["key"], b) for r in sample if r["lang"] == code for b in dict.fromkeys(b for b in (letters(x) for _, _, x in sentences(r["x"])) if is_full(b))]
        step = max(1, len(own) // per_language)
        before = None
        for key, b in own[::step][:per_language]:
            if key != before:
                doc_label.append(c)
                before = key
            texts.append(b)
            owner.append(len(doc_label) - 1)
    if len(set(doc_label)) < 2:
        return None, codes
    of, y = np.array(owner), np.array(doc_label)
    fold = np.random.default_rng(0).permutation(len(y)) % 2
    trusted = np.ones(len(y), dtype=bool)
    for _ in range(2):  # texts whose label a model fitted without them contradicts are left out
        told = np.zeros((len(y), len(codes)))
        for f in (0, 1):
            at = np.flatnonzero(trusted[of] & (fold[of] != f))
            if len(set(y[of[at]].tolist())) < 2:
                at = np.flatnonzero(trusted[of])
            model = StringKernel([texts[i] for i in at], y[of[at]], len(codes))
            out = np.flatnonzero(fold[of] == f)
            np.add.at(told, of[out], model.scores([texts[i] for i in out]))
        kept = told.argmax(1) == y
        enough = np.isin(y, y[kept]) & (np.bincount(y, minlength=len(codes))[y] >= LEAST_TEXTS)
        trusted = np.where(enough, kept, True)
    at = np.flatnonzero(trusted[of])
    return StringKernel([texts[i] for i in at], y[of[at]], len(codes)), codes


def label_texts(df: DataFrame, id_: str, text: str, model: StringKernel | None, codes: list[str], keep: tuple[str, ...] = ()) -> DataFrame:
    """The stretches of each text by language.

    Result: ``id_``, the columns of ``keep``, and ``parts``, an array of (seg_start, seg_end, lang,
    confidence, chars): neighbouring full sentences of one language are one stretch. Null, empty
    and undetermined texts have an empty array. Repeated rows come out each on their own.
    """
    kinds = dict(df.dtypes)
    cols = [id_, *keep]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = Languages(model, codes)
        for pdf in batches:
            parts = []
            for found in known.of(["" if t is None else t for t in pdf[text]]):
                row: list[list] = []
                for a, e, lang, sure in found:
                    if row and row[-1][2] == lang:
                        n = row[-1][4] + e - a
                        row[-1] = [row[-1][0], e, lang, (row[-1][3] * row[-1][4] + sure * (e - a)) / n, n]
                    else:
                        row.append([a, e, lang, sure, e - a])
                parts.append([tuple(x) for x in row])
            yield pdf[cols].assign(parts=parts)

    schema = ", ".join(f"`{c}` {kinds[c]}" for c in cols) + ", parts array<struct<seg_start:int,seg_end:int,lang:string,confidence:double,chars:int>>"
    return df.select(*cols, text).mapInPandas(run, schema)


def _captions(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Media with their labels; captions with their stretches (kept for several uses)."""
    media = table(spark, folder, "media", ["media_id", "path", "language"]).withColumn("label", label(F.col("language")))
    captions = table(spark, folder, "captions", ["caption_id", "media_path", "text"])
    model, codes = fit(_labelled(media, captions))
    return media, cut(label_texts(captions, "caption_id", "text", model, codes, ("media_path",)).where(F.size("parts") > 0))


def _labelled(media: DataFrame, captions: DataFrame, paths: int = 150) -> DataFrame:
    """Captions of a bounded sample of labelled paths: at most about ``paths`` a language."""
    known = media.where("label is not null and path is not null").select("path", "label")
    counts = {r["label"]: r["count"] for r in known.join(captions.select(F.col("media_path").alias("path")).distinct(), "path", "left_semi").groupBy("label").count().collect()}
    rank = F.pmod(F.xxhash64("path"), F.lit(1_000_000)) / 1_000_000.0
    chosen = known.where(_chosen(F.col("label"), rank, {code: min(1.0, paths / n) for code, n in counts.items()})).groupBy("path").agg(F.min("label").alias("lang"), F.max("label").alias("other")).where("lang = other").orderBy(F.xxhash64("path"), "path").limit(4 * paths * len(CODES))
    return cut(captions.join(F.broadcast(chosen), captions["media_path"] == chosen["path"]).select("lang", F.col("text").alias("x"), F.col("caption_id").alias("key")).where("x is not null"))


def _share(column: str = "parts") -> Column:
    """Characters by language of a text's stretches, as an array of (chars, lang)."""
    langs = F.array_distinct(F.transform(column, lambda p: p["lang"]))
    return F.transform(langs, lambda one: F.struct(F.aggregate(F.filter(column, lambda p: p["lang"] == one), F.lit(0), lambda n, p: n + p["chars"]).alias("chars"), one.alias("lang")))


def item_languages(media: DataFrame, parts: DataFrame) -> DataFrame:
    """``media_id``, ``label``, ``lang``, ``confidence`` of each media row whose path has captions
    with a language: that of most of its captions, each counting for its main language."""
    main = parts.select("media_path", F.array_max(_share())["lang"].alias("lang"), F.expr("aggregate(parts, cast(0 as double), (s, p) -> s + p.confidence) / size(parts)").alias("c"))
    votes = main.groupBy("media_path", "lang").agg(F.count("*").alias("n"), F.avg("c").alias("c"))
    best = votes.groupBy("media_path").agg(F.max_by(F.struct("lang", "c", "n"), F.struct("n", "c", "lang")).alias("best"), F.sum("n").alias("all"))
    best = best.select(F.col("media_path").alias("path"), "best.lang", (F.col("best.c") * F.col("best.n") / F.col("all")).alias("confidence"))
    return media.join(best, "path").select("media_id", "label", "lang", "confidence")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Media rows whose label is missing or wrong, and the languages of mixed captions."""
    media, parts = _captions(spark, sf_dir)
    wrong = item_languages(media, parts).where("label is null or label <> lang").select(F.lit("media").alias("table_name"), F.col("media_id").alias("row_id"), "lang")
    mixed = parts.withColumn("langs", F.array_distinct(F.transform("parts", lambda p: p["lang"]))).where(F.size("langs") > 1)
    return wrong.unionByName(mixed.select(F.lit("captions").alias("table_name"), F.col("caption_id").alias("row_id"), F.explode("langs").alias("lang")))


def p5_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language and confidence of every item with captions and of every stretch of mixed captions."""
    media, parts = _captions(spark, sf_dir)
    none = F.lit(None).cast("int")
    items = item_languages(media, parts).select(F.lit("media").alias("table_name"), F.col("media_id").alias("row_id"), none.alias("seg_start"), none.alias("seg_end"), "lang", "confidence")
    mixed = parts.where(F.size(F.array_distinct(F.transform("parts", lambda p: p["lang"]))) > 1)
    rows = mixed.select(F.lit("captions").alias("table_name"), F.col("caption_id").alias("row_id"), F.explode("parts").alias("p")).select("table_name", "row_id", "p.seg_start", "p.seg_end", "p.lang", "p.confidence")
    return items.unionByName(rows)


QUERIES = {"p5_found": p5_found, "p5_languages": p5_languages}
