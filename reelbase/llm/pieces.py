"""Problem 2: oversized texts cut into overlapping pieces at natural boundaries.

Every place where a text may be cut is a node. A node's successor is the farthest legal next cut,
counted from where the following piece begins (the node less the overlap). The successor tables
are then squared (pointer doubling) until no new cut is reached, which gives the greedy cuts of
all texts of a batch at once instead of walking each text piece by piece.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelbase.tables import table

LIMIT, OVERLAP = 2000, 200

# Marks that end a sentence, that close after one, and that end a clause.
_ENDERS = ".!?…。！？"
_CLOSERS = "\"'”’»)]}」』）"
_CLAUSE = "、，；"
_SPACES = "\t\n\v\f\r \x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def _codes(s: str) -> np.ndarray:
    return np.array([ord(c) for c in s], dtype=np.uint32)


def _extends(cp: np.ndarray) -> np.ndarray:
    """Code points that belong to the character before them."""
    return ((cp >= 0x300) & (cp <= 0x36F)) | ((cp >= 0xFE00) & (cp <= 0xFE0F)) | ((cp >= 0x1F3FB) & (cp <= 0x1F3FF)) | (cp == 0x200D)


def boundaries(cp: np.ndarray, limit: int, overlap: int) -> tuple[np.ndarray, np.ndarray]:
    """Cut places of one text and their rank: 2 after a sentence, line or paragraph, 1 after a
    word or clause, 0 within a word.

    Places within words are offered only in stretches longer than the overlap without any other,
    places within a character (a letter and its accents, joined signs) only where it is so long
    that no piece could hold it and the overlap.
    """
    n = len(cp)
    ws = np.isin(cp, _codes(_SPACES))
    at = np.arange(n)
    solid = np.maximum.accumulate(np.where(~ws, at, -1))  # last character that is no space
    closing = np.isin(cp, _codes(_CLOSERS))
    core = np.maximum.accumulate(np.where(~ws & ~closing, at, -1))
    ends = np.isin(cp, _codes(_ENDERS))
    lines = np.concatenate([[0], np.cumsum((cp == 10) | (cp == 0x2028) | (cp == 0x2029))])
    rank = np.full(n + 1, -1, dtype=np.int8)
    word = np.zeros(n + 1, dtype=bool)
    word[1:n] = ws[: n - 1] & ~ws[1:]
    p = np.flatnonzero(word)
    s = solid[p - 1]
    c = np.maximum(core[p - 1], 0)
    rank[p] = np.where((s >= 0) & ((ends[c] & (core[p - 1] >= 0)) | (lines[p] > lines[np.maximum(s, 0)])), 2, 1)
    tight = np.flatnonzero(np.isin(cp[: n - 1], _codes("。！？")) & ~ws[1:] & ~closing[1:] & ~ends[1:]) + 1
    rank[tight] = 2
    after = np.flatnonzero(np.isin(cp[: n - 1], _codes(_CLAUSE)) & ~ws[1:]) + 1
    rank[after] = np.maximum(rank[after], 1)
    rank[0] = rank[n] = 2
    known = np.flatnonzero(rank >= 0)
    wide = np.diff(known) > overlap
    if wide.any():
        inside = np.zeros(n + 2, dtype=np.int32)
        np.add.at(inside, known[:-1][wide] + 1, 1)
        np.add.at(inside, known[1:][wide], -1)
        hard = np.flatnonzero(np.cumsum(inside)[: n + 1] > 0)
        hard = hard[~_extends(cp[hard]) & (cp[hard - 1] != 0x200D)]
        rank[hard] = 0
    known = np.flatnonzero(rank >= 0)
    for k in np.flatnonzero(np.diff(known) > limit - overlap):
        rank[known[k] + 1 : known[k + 1]] = 0
    pos = np.flatnonzero(rank >= 0)
    return pos, rank[pos]


def successors(pos: np.ndarray, rank: np.ndarray, limit: int, overlap: int) -> tuple[np.ndarray, np.ndarray]:
    """For every cut its piece's start and the index of its farthest legal successor.

    The piece after a cut starts at the first natural boundary among the last ``overlap``
    characters before it, or exactly ``overlap`` before it where there is none. Its end is the
    farthest boundary within the limit: one of rank 2 if that keeps half the limit or more, else
    one of rank 1 on the same condition, else any.
    """
    natural = np.flatnonzero(rank >= 1)
    begin = pos - overlap
    i = np.searchsorted(pos[natural], begin)
    start = pos[natural][np.minimum(i, len(natural) - 1)]
    start = np.where((i < len(natural)) & (start < pos), start, np.maximum(begin, 0))
    start = np.where(pos == 0, 0, start)
    nxt = np.zeros(len(pos), dtype=np.int64)
    done = np.zeros(len(pos), dtype=bool)
    for least, reach in ((2, limit // 2), (1, limit // 2), (0, 0)):
        at = np.flatnonzero(rank >= least)
        j = at[np.searchsorted(pos[at], start + limit, side="right") - 1]
        ok = ~done & (pos[j] > pos) & ((pos[j] - start >= reach) | (pos[j] == pos[-1]))
        nxt[ok], done = j[ok], done | ok
    return start, np.where(done, nxt, np.arange(len(pos)))


def reached(nxt: np.ndarray, roots: np.ndarray) -> np.ndarray:
    """Nodes reachable from the roots, by squaring the successor table."""
    seen = np.zeros(len(nxt), dtype=bool)
    seen[roots] = True
    jump = nxt.copy()
    while True:
        more = seen.copy()
        more[jump[seen]] = True
        if (more == seen).all() and (jump == jump[jump]).all():
            return seen
        seen, jump = more, jump[jump]


def cut_batch(texts: list[str], limit: int = LIMIT, overlap: int = OVERLAP) -> Iterator[tuple[int, int, int, int]]:
    """(text's index, piece's number from 1, start, end) of every piece of a batch of texts."""
    tables, offset = [], 0
    for k, t in enumerate(texts):
        if not t:
            continue
        pos, rank = boundaries(np.frombuffer(t.encode("utf-32-le", "surrogatepass"), dtype=np.uint32), limit, overlap)
        start, nxt = successors(pos, rank, limit, overlap)
        tables.append((np.full(len(pos), k), pos, start, nxt + offset))
        offset += len(pos)
    if not tables:
        return
    doc, pos, start, nxt = (np.concatenate(x) for x in zip(*tables))
    roots = np.flatnonzero(pos == 0)
    cuts = np.flatnonzero(reached(nxt, roots))
    inner = cuts[nxt[cuts] != cuts]  # the last cut of a text begins no piece
    order = np.arange(len(inner)) - np.searchsorted(doc[inner], doc[inner])
    yield from zip(doc[inner].tolist(), (order + 1).tolist(), start[inner].tolist(), pos[nxt[inner]].tolist())


def split_oversized(df: DataFrame, id_: str, text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """Pieces of the texts longer than ``limit`` characters (Unicode code points).

    Result: ``id_``, ``piece`` (from 1), ``piece_start``, ``piece_end`` (character offsets),
    ``n_overlap`` (characters shared with the piece before) and ``piece_text``. Pieces are
    at most ``limit`` long and together cover the text. Null, empty and shorter texts give no rows.
    Repeated rows are cut each on their own. Other columns are ignored. The overlap must be less
    than the limit.
    """
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be less than the limit")
    big = df.select(F.col(id_).alias("i"), F.col(text).alias("x")).where(F.length("x") > limit)

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ids, texts = pdf["i"].tolist(), pdf["x"].tolist()
            rows, before = [], (-1, 0)
            for k, n, a, b in cut_batch(texts, limit, overlap):
                rows.append((ids[k], n, a, b, before[1] - a if before[0] == k else 0, texts[k][a:b]))
                before = (k, b)
            yield pd.DataFrame(rows, columns=["i", "piece", "piece_start", "piece_end", "n_overlap", "piece_text"])

    kind = dict(df.dtypes)[id_]
    out = big.mapInPandas(pieces, f"i {kind}, piece bigint, piece_start bigint, piece_end bigint, n_overlap bigint, piece_text string")
    return out.withColumnRenamed("i", id_)


def p2_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of every oversized caption."""
    return split_oversized(table(spark, sf_dir, "captions"), "caption_id", "text")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captions that had to be cut: those that have a second piece."""
    return p2_pieces(spark, sf_dir).where(F.col("piece") == 2).select("caption_id")


QUERIES = {"p2_found": p2_found, "p2_pieces": p2_pieces}
ORACLE = {"p2_found": "select caption_id from captions where length(text) > 2000"}
