"""Problem 8: token ids of a whole corpus by a public byte-level BPE tokenizer.

Pre-tokenisation needs no regular expression: code points are mapped to classes, and the only
context that reaches beyond a neighbour (whether an apostrophe may begin a contraction) is the
state of a four-state machine. A machine's step is a function on four states and fits in a byte
(two bits a state), so prefixes are composed with one table look-up each, and composition being
associative, all characters of a batch are scanned in blocks at once. The resulting slices go
through a pair merger that remembers every slice it has merged.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelbase.tables import spread, table

#: Where the rank file lies; a parameter of every function here.
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Slices remembered by a worker before it starts anew; bounds memory, never the result.
CACHE = 400_000

L, N, S, O = 0, 1, 2, 3  # letter, number, white space, other
_SYM_TEXT, _SYM_OTHER, _SYM_SPACE, _SYM_ONE, _SYM_TWO = range(5)
# Steps of the machine by symbol: next state from states 0 to 3.
# 0: an apostrophe here would begin a token; 1: within a run of other characters;
# 2, 3: one or two letters of a contraction are still to come.
_STEPS = {_SYM_TEXT: (0, 0, 0, 2), _SYM_OTHER: (1, 1, 0, 2), _SYM_SPACE: (1, 1, 0, 2), _SYM_ONE: (2, 1, 0, 2), _SYM_TWO: (3, 1, 0, 2)}


def _pack(f) -> int:
    return sum(t << (2 * s) for s, t in enumerate(f))


@functools.cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """The class of every code point; the composition (first f, then g) of packed functions."""
    import regex

    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    kinds = np.full(0x110000, O, dtype=np.uint8)
    for kind, pattern in ((L, r"\p{L}+"), (N, r"\p{N}+"), (S, r"\p{White_Space}+")):
        for m in regex.finditer(pattern, every):
            a, b = ord(m[0][0]), ord(m[0][-1])
            kinds[a : b + 1] = kind
    kinds[0xD800:0xE000] = O
    f, g = np.meshgrid(np.arange(256), np.arange(256), indexing="ij")
    both = np.zeros((256, 256), dtype=np.uint8)
    for s in range(4):
        both |= (((g >> (2 * ((f >> (2 * s)) & 3))) & 3) << (2 * s)).astype(np.uint8)
    return kinds, both


def scan(steps: np.ndarray, both: np.ndarray, block: int = 64) -> np.ndarray:
    """Packed composition of all steps up to and with each; blocks side by side, then their sums."""
    n = len(steps)
    if n <= block:
        out = steps.copy()
        for i in range(1, n):
            out[i] = both[out[i - 1], out[i]]
        return out
    identity = _pack((0, 1, 2, 3))
    rows = np.full((-(-n // block), block), identity, dtype=np.uint8)
    rows.reshape(-1)[:n] = steps
    cols = np.ascontiguousarray(rows.T)
    for i in range(1, block):
        cols[i] = both[cols[i - 1], cols[i]]
    before = np.full(cols.shape[1], identity, dtype=np.uint8)
    before[1:] = scan(cols[-1], both, block)[:-1]
    return both[before[None, :], cols].T.reshape(-1)[:n]


def token_starts(cp: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where tokens start in the code points of texts laid end to end; ``first``: the texts' starts."""
    kinds, both = _tables()
    n = len(cp)
    kind = kinds[cp]
    begins = np.zeros(n + 1, dtype=bool)
    begins[first] = True
    begins[n] = True
    pad = np.concatenate([cp, np.zeros(2, dtype=cp.dtype)])
    n1, n2 = pad[1 : n + 1], pad[2 : n + 2]
    same1 = ~begins[1 : n + 1]
    same2 = same1 & ~np.append(begins[2 : n + 1], True)[:n]
    c = lambda ch: ord(ch)
    one = same1 & np.isin(n1, [c("s"), c("t"), c("m"), c("d")])
    two = same2 & (((n1 == c("r")) & (n2 == c("e"))) | ((n1 == c("v")) & (n2 == c("e"))) | ((n1 == c("l")) & (n2 == c("l"))))
    mark = cp == 0x27
    kind1 = np.append(kind[1:], S)
    sym = np.where(kind == O, _SYM_OTHER, _SYM_TEXT).astype(np.uint8)
    sym[(cp == 0x20) & same1 & (kind1 == O)] = _SYM_SPACE
    sym[mark & one] = _SYM_ONE
    sym[mark & two] = _SYM_TWO
    steps = np.array([_pack(_STEPS[k]) for k in range(5)], dtype=np.uint8)[sym]
    # every text begins in state 0: its first step forgets where it comes from
    reset = np.array([_pack((_STEPS[k][0],) * 4) for k in range(5)], dtype=np.uint8)
    steps[first] = reset[sym[first]]
    state = scan(steps, both) & 3  # after each character, from state 0
    before = np.concatenate([[0], state[:-1]]).astype(np.uint8)
    before[first] = 0
    contraction = (before == 0) & (mark & (one | two))
    inside = before >= 2
    ended = np.zeros(n, dtype=bool)
    ended[1:] = before[:-1] == 2
    prev = np.concatenate([[S], kind[:-1]])
    prev_cp = np.concatenate([[0], cp[:-1]])
    change = (kind != prev) & ~((prev_cp == 0x20) & (kind != S))
    # the last space before a character that is none stands alone or joins it
    last_space = (kind == S) & same1 & (kind1 != S)
    start = ((change | last_space | contraction) & ~inside) | ended
    start[first] = True
    return start


class Bpe:
    """Merges pairs of byte strings by rank; remembers slices."""

    def __init__(self, lines: bytes, cache: int = CACHE):
        self.ranks: dict[bytes, int] = {}
        for line in lines.splitlines():
            if line.strip():
                a, b = line.split()
                self.ranks[base64.b64decode(a)] = int(b)
        self.names = {v: k for k, v in self.ranks.items()}
        self.known: dict[str, tuple[int, ...]] = {}
        self.cache = cache

    def merge(self, piece: bytes) -> tuple[int, ...]:
        ranks = self.ranks
        if piece in ranks:
            return (ranks[piece],)
        if len(piece) > 200:
            return self._merge_long(piece)
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            best, at = min((ranks.get(a + b, 1 << 30), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if best == 1 << 30:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return tuple(ranks[p] for p in parts)

    def _merge_long(self, piece: bytes) -> tuple[int, ...]:
        """The same merges from a heap, for slices whose length would make the scan quadratic."""
        import heapq

        ranks = self.ranks
        parts = [piece[i : i + 1] for i in range(len(piece))]
        nxt, prev = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        heap = [(r, i, parts[i] + parts[i + 1]) for i in range(len(parts) - 1) if (r := ranks.get(parts[i] + parts[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, both = heapq.heappop(heap)
            j = nxt[i]
            if parts[i] is None or j >= len(parts) or parts[j] is None or parts[i] + parts[j] != both:
                continue
            parts[i], parts[j], nxt[i] = both, None, nxt[j]
            if nxt[i] < len(parts):
                prev[nxt[i]] = i
            for a in (prev[i], i):
                if a >= 0 and nxt[a] < len(parts):
                    pair = parts[a] + parts[nxt[a]]
                    if (r := ranks.get(pair)) is not None:
                        heapq.heappush(heap, (r, a, pair))
        return tuple(ranks[p] for p in parts if p is not None)

    def encode(self, texts: list[str]) -> Iterator[tuple[list[int], list[int]]]:
        """Ids of each text, and the number of ids up to the end of each of its slices."""
        joined = "".join(texts)
        sizes = np.array([len(t) for t in texts], dtype=np.int64)
        ends = np.cumsum(sizes)
        if not joined:
            yield from (([], []) for _ in texts)
            return
        cp = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        start = np.flatnonzero(token_starts(cp, (ends - sizes)[sizes > 0]))
        bounds = [*start.tolist(), len(cp)]
        first = np.searchsorted(start, ends - sizes).tolist()
        past = np.searchsorted(start, ends).tolist()
        known, merge = self.known, self.merge
        for a, b in zip(first, past):
            ids: list[int] = []
            offsets: list[int] = []
            for k in range(a, b):
                piece = joined[bounds[k] : bounds[k + 1]]
                got = known.get(piece)
                if got is None:
                    if len(known) >= self.cache:
                        known.clear()
                    got = known[piece] = merge(piece.encode("utf-8", "surrogatepass"))
                ids += got
                offsets.append(len(ids))
            yield ids, offsets

    def decode(self, ids: list[int], offsets: list[int]) -> list[str]:
        """The slices of a text: every one is whole characters, which single ids need not be."""
        out, a = [], 0
        for b in offsets:
            out.append(b"".join([self.names[i] for i in ids[a:b]]).decode("utf-8", "surrogatepass"))
            a = b
        return out


@functools.lru_cache(2)
def _bpe(lines: bytes) -> Bpe:
    return Bpe(lines)


def _shipped(spark: SparkSession, ranks: str) -> Broadcast:
    """The rank file as the driver reads it, for all workers: they need no copy of their own."""
    with open(ranks, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def batches_of(texts: list[str], chars: int = 1 << 21) -> Iterator[list[str]]:
    """Runs of texts of about so many characters; a longer text is a run of its own."""
    run: list[str] = []
    size = 0
    for t in texts:
        if run and size + len(t) > chars:
            yield run
            run, size = [], 0
        run.append(t)
        size += len(t)
    if run:
        yield run


def encode(df: DataFrame, id_: str, text: str, ranks: str = RANKS, count_only: bool = False, offsets: bool = False) -> DataFrame:
    """Token ids of every row's text, without special tokens.

    Result: ``id_`` and ``ids`` (array of int), or ``n_tokens`` (bigint) with ``count_only``; with
    ``offsets`` also these (array of int): the number of ids up to the end of each slice of the
    text, which ``decode`` needs. Null and empty texts have an empty list; the strings of special
    tokens are ordinary text. Repeated rows and ids stay. Other columns are ignored; an empty
    table gives no rows.
    """
    kind = dict(df.dtypes)[id_]
    lines = _shipped(df.sparkSession, ranks)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = _bpe(lines.value)
        for pdf in batches:
            texts = ["" if t is None else t for t in pdf["x"]]
            both = [x for part in batches_of(texts) for x in bpe.encode(part)]
            out = {"i": pdf["i"], "ids": [len(i) if count_only else i for i, _ in both]}
            yield pd.DataFrame(out | {"offsets": [o for _, o in both]} if offsets else out)

    schema = f"i {kind}, ids {'bigint' if count_only else 'array<int>'}" + (", offsets array<int>" if offsets else "")
    out = spread(df.select(F.col(id_).alias("i"), F.col(text).alias("x"))).mapInPandas(run, schema)
    return out.toDF(id_, "n_tokens" if count_only else "ids", *(["offsets"] if offsets else []))


def decode(df: DataFrame, id_: str, ranks: str = RANKS) -> DataFrame:
    """``id_`` and ``text`` of rows with ``ids`` and ``offsets``; null or empty ids are an empty text."""
    kind = dict(df.dtypes)[id_]
    lines = _shipped(df.sparkSession, ranks)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = _bpe(lines.value)
        for pdf in batches:
            yield pd.DataFrame({"i": pdf["i"], "text": ["".join(bpe.decode(i.tolist(), o.tolist())) if i is not None else "" for i, o in zip(pdf["ids"], pdf["offsets"])]})

    return df.select(F.col(id_).alias("i"), "ids", "offsets").mapInPandas(run, f"i {kind}, text string").withColumnRenamed("i", id_)


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ids of every document."""
    return encode(table(spark, sf_dir, "documents"), "doc_id", "text")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose list of ids is empty."""
    return p8_ids(spark, sf_dir).where(F.size("ids") == 0).select("doc_id")


def p8_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded again by its offsets."""
    return decode(encode(table(spark, sf_dir, "documents"), "doc_id", "text", offsets=True), "doc_id")


QUERIES = {"p8_found": p8_found, "p8_ids": p8_ids, "p8_decoded": p8_decoded}
ORACLE = {"p8_found": "select doc_id from documents where text is null or text = ''", "p8_decoded": "select doc_id, coalesce(text, '') as text from documents"}
