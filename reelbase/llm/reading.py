"""Problem 10: how demanding each document is to read.

Every sentence is classified by a regularised softmax model over its words and their character
n-grams (plus sentence and word lengths); a document's distribution over its sentences is turned
into a calibrated level by a second model fitted on held-out sentence predictions. Labels come
from a bounded sample of rated documents; ratings the fit contradicts clearly are left out.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelbase.llm.languages import Languages, Remembered, StringKernel, fit, label
from reelbase.tables import spread, table

LEVELS = ("basic", "general", "advanced")
LEAST_WORDS = 40
#: The labelled sample (none of its documents longer than so many characters), and the sentences of
#: it that a fit sees.
SAMPLE_DOCUMENTS, SAMPLE_CHARS, SAMPLE_SENTENCES = 2000, 50_000, 6_000
BUCKETS, L2, ROUNDS = 1 << 15, 3e-4, 50

_CODES = re.compile(r"<[^<>]*>|\{\\[^{}]*\}|&\w+;|\d\d:\d\d(:\d\d)?([.,]\d+)?|https?://\S+|-->")
_END = re.compile(r"(?<=[.!?…])[\"'”’)\]]*\s+|\n\s*\n|\n\s*(?=[-–—•*#>]\s)")
_WORD = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")


def plain_sentences(text: str) -> list[list[str]]:
    """The words of each sentence, lower case; markup and time codes are no words."""
    return [w for w in map(_words, _END.split(_CODES.sub(" ", text))) if w]


def _words(sentence: str) -> list[str]:
    return _WORD.findall(sentence.lower().replace("’", "'"))


def _features(word: str) -> tuple[int, list[int]]:
    """The word's bucket and those of its character n-grams."""
    held = f"<{word}>"
    grams = [zlib.crc32(held[i : i + n].encode()) % BUCKETS for n in (3, 4) for i in range(max(1, len(held) - n + 1))]
    return zlib.crc32(b"w" + word.encode()) % BUCKETS, grams


def _lengths(words: list[str]) -> tuple[float, float, float]:
    n = len(words)
    return np.log1p(n) - 2.4, sum(map(len, words)) / n / 4 - 1.2, sum(len(w) > 9 for w in words) / n


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


class SentenceModel:
    """Softmax regression over hashed words, hashed character n-grams and lengths."""

    def __init__(self, sents: list[list[str]], y: np.ndarray, weight: np.ndarray):
        number: dict[str, int] = {}
        wid = np.array([number.setdefault(w, len(number)) for s in sents for w in s])
        n = np.array([len(s) for s in sents])
        own, starts = np.repeat(np.arange(len(sents)), n), np.concatenate([[0], np.cumsum(n)[:-1]])
        part = (1 / n[own]).astype(np.float32)  # a sentence is the mean of its words
        feats = [_features(w) for w in number]
        idx = np.array([i for f, grams in feats for i in (f, *(BUCKETS + g for g in grams))])
        sizes = np.array([1 + len(grams) for _, grams in feats])
        val = np.concatenate([[1.0] + [1 / len(grams)] * len(grams) for _, grams in feats]).astype(np.float32)
        of, first = np.repeat(np.arange(len(feats)), sizes), np.concatenate([[0], np.cumsum(sizes)[:-1]])
        extra = np.array([_lengths(s) for s in sents], dtype=np.float32)
        used, idx = np.unique(idx, return_inverse=True)
        k = len(LEVELS)
        w = np.zeros((len(used), k), dtype=np.float32)
        u, b = np.zeros((3, k), dtype=np.float32), np.zeros(k, dtype=np.float32)
        target = np.eye(k, dtype=np.float32)[y]
        counts = np.maximum((weight[:, None] * target).sum(0), 1)
        weight = (weight / counts[y] / k).astype(np.float32)
        moments = [(np.zeros_like(p), np.zeros_like(p)) for p in (w, u, b)]
        for t in range(1, ROUNDS + 1):
            words = np.add.reduceat(w[idx] * val[:, None], first)
            g = (_softmax(np.add.reduceat(words[wid] * part[:, None], starts) + extra @ u + b) - target) * weight[:, None]
            flat = g[own] * part[:, None]
            g_words = np.stack([np.bincount(wid, flat[:, c], minlength=len(feats)) for c in range(k)], 1)
            flat = g_words[of] * val[:, None]
            gw = np.stack([np.bincount(idx, flat[:, c], minlength=len(used)) for c in range(k)], 1).astype(np.float32) + L2 / 100 * w
            for p, grad, (m, v) in zip((w, u, b), (gw, extra.T @ g + L2 * u, g.sum(0)), moments):
                m += 0.1 * (grad - m)
                v += 0.01 * (grad * grad - v)
                p -= 0.15 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
        self.words = np.zeros((2 * BUCKETS, k), dtype=np.float32)
        self.words[used] = w
        self.lengths, self.bias = u, b
        self._forget()

    def _forget(self) -> None:
        #: of words: what they add to each level; of sentences: number of words and distribution
        self.known, self.told = Remembered(len(LEVELS)), Remembered(1 + len(LEVELS))

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("known", "told")}

    def __setstate__(self, state: dict):
        self.__dict__.update(state)
        self._forget()

    def summaries(self, raws: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """Which of the documents (their sentences as they stand) have words, and the summaries of those."""
        new = self.told.missing(r for one in raws for r in one)
        for i in range(0, len(new), 20_000):
            words = [_words(r) for r in new[i : i + 20_000]]
            rows = np.zeros((len(words), 1 + len(LEVELS)), dtype=np.float32)
            rows[:, 0] = [len(w) for w in words]
            if rows[:, 0].any():
                rows[rows[:, 0] > 0, 1:] = self.predict([w for w in words if w])
            self.told.add(new[i : i + 20_000], rows)
        held = self.told.of([r for one in raws for r in one])
        owner = np.repeat(np.arange(len(raws)), [len(one) for one in raws])
        worded = held[:, 0] > 0
        docs, held = owner[worded], held[worded].astype(np.float64)
        has = np.bincount(docs, minlength=len(raws)) > 0
        return has, _summaries(np.cumsum(has)[docs] - 1, held[:, 0], held[:, 1:]) if len(docs) else np.zeros((0, 3 * len(LEVELS)))

    def predict(self, sents: list[list[str]]) -> np.ndarray:
        """The distribution over the levels of each sentence (its words; at least one)."""
        flat = [w for s in sents for w in s]
        new = self.known.missing(flat)
        for i in range(0, len(new), 20_000):
            feats = [_features(w) for w in new[i : i + 20_000]]
            n = np.array([len(grams) for _, grams in feats])
            grams = np.add.reduceat(self.words[np.array([BUCKETS + g for _, gs in feats for g in gs])], np.cumsum(n) - n)
            self.known.add(new[i : i + 20_000], self.words[[a for a, _ in feats]] + grams / n[:, None])
        n = np.array([len(s) for s in sents])
        z = np.add.reduceat(self.known.of(flat), np.cumsum(n) - n) / n[:, None]
        sizes = np.array([len(w) for w in flat])
        first = np.cumsum(n) - n
        lengths = np.stack([np.log1p(n) - 2.4, np.add.reduceat(sizes, first) / n / 4 - 1.2, np.add.reduceat((sizes > 9).astype(np.int64), first) / n], 1)
        return _softmax(z + lengths.astype(np.float32) @ self.lengths + self.bias)


def _summaries(doc: np.ndarray, n: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Documents by their sentences (document's number, words, distribution; in order): the mean
    distribution, the same by words, and the share of each level."""
    k, first = p.shape[1], np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
    total = np.add.reduceat(n, first)[:, None]
    share = np.bincount(doc * k + p.argmax(1), n, minlength=(doc[-1] + 1) * k).reshape(-1, k)
    return np.concatenate([np.add.reduceat(p, first) / np.bincount(doc)[:, None], np.add.reduceat(p * n[:, None], first) / total, share / total], 1)


def _summary(sents: list[list[str]], p: np.ndarray) -> np.ndarray:
    return _summaries(np.zeros(len(sents), dtype=np.int64), np.array([len(s) for s in sents], dtype=np.float64), p)[0]


class Calibration:
    """Softmax regression from a document's summary to its level."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        k = len(LEVELS)
        x1 = np.concatenate([x, np.ones((len(x), 1))], 1)
        self.w = np.zeros((x1.shape[1], k))
        target = np.eye(k)[y]
        weight = 1 / np.maximum(target.sum(0), 1)[y] / k
        for _ in range(800):
            g = x1.T @ ((_softmax(x1 @ self.w) - target) * weight[:, None]) + 1e-4 * self.w
            self.w -= 2.0 * g

    def predict(self, x: np.ndarray) -> np.ndarray:
        return _softmax(np.concatenate([x, np.ones((len(x), 1))], 1) @ self.w)


def _fit_sentences(docs: list[list[list[str]]], y: np.ndarray) -> SentenceModel:
    """Equal sentences of one level count once, by their number; at most ``SAMPLE_SENTENCES``."""
    tally: dict[tuple, int] = {}
    for d, level in zip(docs, y.tolist()):
        for s in d:
            key = (level, *s)
            tally[key] = tally.get(key, 0) + 1
    keys = sorted(tally, key=lambda k: zlib.crc32(" ".join(map(str, k)).encode()))[:SAMPLE_SENTENCES]
    return SentenceModel([list(k[1:]) for k in keys], np.array([k[0] for k in keys]), np.sqrt([tally[k] for k in keys]))


def train(texts: list[str], levels: list[str]) -> tuple[SentenceModel, Calibration] | None:
    """Both models from rated texts; None where fewer than two levels are rated."""
    docs = [plain_sentences(t) for t in texts]
    keep = [i for i, (d, lv) in enumerate(zip(docs, levels)) if d and lv in LEVELS]
    docs, y = [docs[i] for i in keep], np.array([LEVELS.index(levels[i]) for i in keep], dtype=int)
    if len(set(y.tolist())) < 2:
        return None
    for again in (True, False):
        fold = np.arange(len(docs)) % 2
        x = np.zeros((len(docs), 3 * len(LEVELS)))
        for f in (0, 1):
            if len(set(y[fold != f].tolist())) < 2:
                f_docs, f_y = docs, y
            else:
                f_docs, f_y = [d for d, o in zip(docs, fold) if o != f], y[fold != f]
            model = _fit_sentences(f_docs, f_y)
            for i in np.flatnonzero(fold == f):
                x[i] = _summary(docs[i], model.predict(docs[i]))
        calibration = Calibration(x, y)
        told = calibration.predict(x)[np.arange(len(y)), y]
        ok = told > 0.15
        if again and (~ok).any() and len(set(y[ok].tolist())) >= 2 and ok.mean() > 0.6:
            docs, y = [d for d, o in zip(docs, ok) if o], y[ok]
        else:
            break
    return _fit_sentences(docs, y), calibration


def reading_levels(df: DataFrame, id_: str, text: str, models: tuple[SentenceModel, Calibration] | None, kernel: StringKernel | None, codes: list[str]) -> DataFrame:
    """Level and distribution of every document.

    Result: ``id_``, ``n_words`` (between white space), ``is_english`` (by most of its text), ``reading_level``, ``p_basic``, ``p_general``, ``p_advanced`` and ``difficulty`` (expected
    level from 0 to 2). Null, empty and wordless texts, and all texts without a model, have null
    levels. Repeated rows come out each on their own; an empty table gives no rows.
    """
    kind = dict(df.dtypes)[id_]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = Languages(kernel, codes)
        for pdf in batches:
            texts = ["" if t is None else t for t in pdf["x"]]
            sents = [_END.split(_CODES.sub(" ", t)) for t in texts]
            p = np.full((len(texts), len(LEVELS)), np.nan)
            if models and texts:
                has, x = models[0].summaries(sents)
                p[has] = models[1].predict(x)
            told = ~np.isnan(p[:, 0])
            level = np.where(told, np.array(LEVELS, dtype=object)[np.argmax(np.nan_to_num(p), 1)], None)
            none = lambda v: pd.array(v, dtype="Float64").copy() if told.all() else pd.Series(v).astype("Float64")
            yield pd.DataFrame({
                "i": pdf["i"], "n_words": [len(t.split()) for t in texts], "is_english": [lang == "en" for lang in known.main(sents)], "reading_level": level,
                "p_basic": none(p[:, 0]), "p_general": none(p[:, 1]), "p_advanced": none(p[:, 2]), "difficulty": none(p[:, 1] + 2 * p[:, 2]),
            })

    out = spread(df.select(F.col(id_).alias("i"), F.col(text).alias("x"))).mapInPandas(run, f"i {kind}, n_words bigint, is_english boolean, reading_level string, p_basic double, p_general double, p_advanced double, difficulty double")
    return out.withColumnRenamed("i", id_)


def p10_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its estimate."""
    documents = table(spark, sf_dir, "documents", ["doc_id", "text", "lang"])
    rated = table(spark, sf_dir, "reading_labels", ["doc_id", "reading_level"]).where("reading_level is not null")
    sample = F.broadcast(rated.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_DOCUMENTS))
    rows = sorted(documents.join(sample, "doc_id").where(F.length("text") <= SAMPLE_CHARS).select("doc_id", "text", "reading_level").collect())  # bounded by the two
    kernel, codes = fit(documents.select(label(F.col("lang")).alias("lang"), F.col("text").alias("x"), F.col("doc_id").alias("key")), rows=5000)
    return reading_levels(documents, "doc_id", "text", train([r["text"] for r in rows], [r["reading_level"] for r in rows]), kernel, codes)


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The level of every English document of at least 40 words."""
    return p10_levels(spark, sf_dir).where((F.col("n_words") >= LEAST_WORDS) & F.col("is_english") & F.col("reading_level").isNotNull()).select("doc_id", "reading_level")


QUERIES = {"p10_found": p10_found, "p10_levels": p10_levels}
