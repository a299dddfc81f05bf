"""The operators of the llm subpackage against brute force, round trips and planted cases."""

import os
import random
import re

import numpy as np
import pytest

pytest.importorskip("reelbase.llm")

from hypothesis import given, settings
from hypothesis import strategies as st

from reelbase.llm import languages, mojibake, packing, pieces, reading, runs, scans, survivors, tokens

SF = "/root/testdata/sf0.001"
data = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


# ---- pieces
def walk(text, limit, overlap):
    """The greedy cuts one after the other."""
    pos, rank = pieces.boundaries(np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32), limit, overlap)
    start, nxt = pieces.successors(pos, rank, limit, overlap)
    out, k = [], 0
    while nxt[k] != k:
        out.append((int(start[k]), int(pos[nxt[k]])))
        k = nxt[k]
    return out


@settings(deadline=None, max_examples=150)
@given(st.lists(st.text(alphabet="ab .!\n。、é́", max_size=400) | st.builds(lambda a, n, b: a + "\u0301\u200d"[n % 2] * n + b, st.text(alphabet="ab .", max_size=90), st.integers(0, 300), st.text(alphabet="ab .", max_size=90)), min_size=1, max_size=4), st.integers(20, 60))
def test_pieces_equal_the_walk_and_cover_the_text(texts, limit):
    overlap = limit // 10
    got = {}
    for k, n, a, b in pieces.cut_batch(texts, limit, overlap):
        assert n == len(got.setdefault(k, [])) + 1
        got[k].append((a, b))
    for k, t in enumerate(texts):
        cuts = got.get(k, [])
        if t:
            assert cuts == walk(t, limit, overlap)
            assert cuts[0][0] == 0 and cuts[-1][1] == len(t)
        for (a, b), (c, d) in zip(cuts, cuts[1:]):
            assert b - overlap <= c <= b < d
        assert all(b - a <= limit for a, b in cuts)


def test_pieces_cut_at_sentences_and_overlap_exactly_without_breaks():
    text = ("One two three. " * 20).strip()
    for _, n, a, b in pieces.cut_batch([text], 100, 30):
        assert text[a:b].rstrip().endswith(".") and text[a:].startswith("One")
    cuts = [(a, b) for _, _, a, b in pieces.cut_batch(["x" * 5000], 2000, 200)]
    assert cuts == [(0, 2000), (1800, 3800), (3600, 5000)]


def test_characters_longer_than_a_piece():
    for text in ("a" + "\u0301" * 5000, "word " + "a\u200d" * 3005 + " end", "\u0301" * 2001):
        cuts = [(a, b) for _, _, a, b in pieces.cut_batch([text])]
        assert all(b - a <= 2000 for a, b in cuts) and cuts[0][0] == 0 and cuts[-1][1] == len(text)
        assert all(b - 200 <= c <= b < d for (_, b), (c, d) in zip(cuts, cuts[1:]))
    with pytest.raises(ValueError):
        pieces.split_oversized(None, "id", "text", 100, 100)


def test_pieces_table(spark):
    df = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (3, "short", "c"), (4, "word " * 900, "d"), (4, "word " * 900, "d")], "id long, text string, piece string")
    rows = pieces.split_oversized(df, "id", "text").collect()
    assert {r["id"] for r in rows} == {4} and len(rows) == 2 * 3
    assert pieces.split_oversized(df.limit(0), "id", "text").count() == 0


# ---- runs
def brute_runs(rows):
    """(first id, events) of every run, one event after the other."""

    def canon(x):
        if x is None or not x.strip():
            return None
        bare = re.sub(r"<[^<>]*>|\{\\[^{}]*\}", "", x).lower()
        return re.sub(r"[^\w\s]|_", "", bare).split() or [re.sub(r"\s", "", x.lower())]

    def lev(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    def near(a, b):
        if "".join(a) == "".join(b):
            return True
        if len(a) != len(b):
            return False
        d = [(x, y) for x, y in zip(a, b) if x != y]
        if any(c.isdigit() for x, y in d for c in x + y):
            return False
        if len(d) == 1:
            x, y = d[0]
            n = lev(x, y)
            return n <= 2 and (len(x) != len(y) or sorted(x) == sorted(y) or (n == 1 and len(x) >= 6))
        return len(d) == 2 and all(lev(x, y) == 1 and len(x) != len(y) for x, y in d)

    events = {}
    for e, t, x, i in rows:
        if t is not None and t == t:
            events[e, t, x] = min(i, events.get((e, t, x), i))
    out, last, began, value = [], (None, None), None, None
    for (e, t, x), i in sorted(events.items(), key=lambda r: (str(r[0][0]), r[0][1], r[1])):
        w = canon(x)
        if w is None:
            value = None
        else:
            if not (last[0] == e and last[1] is not None and near(last[1], w)):
                began = "".join(w)
            if last[0] == e and value == began:
                out[-1][1] += 1
            else:
                out.append([i, 1])
            value = began
        last = (e, w)
    return sorted(map(tuple, out))


def test_runs_equal_brute_force(spark):
    rng = random.Random(5)
    texts = ["The door is open.", "the door is open", "<i>The doorr is open!</i>", "Chapter 3", "Chapter 4", "– The window is open.", None, " ", "♪", "Teh door is open", "The floor is open"]
    rows = [(rng.choice(["a", "b", None]), rng.choice([None, float("nan"), *[rng.randrange(0, 400) / 2 for _ in range(30)]]), rng.choice(texts), i) for i in range(1500)]
    rows += rows[:40]
    df = spark.createDataFrame([(*r, "x") for r in rows], "e string, t double, x string, i long, n string")
    for parts in (None, 1, 3, 40):  # however the sorted table is cut
        got = sorted((r["first_id"], r["n_events"]) for r in runs.collapse(df, "e", "t", "x", "i", parts).collect())
        assert got == brute_runs(rows)
    hot = [("a", 1.0, rng.choice(texts[:3] + texts[9:]), i) for i in range(600)]  # one entity, one time
    df = spark.createDataFrame(hot, "e string, t double, x string, i long")
    assert sorted((r["first_id"], r["n_events"]) for r in runs.collapse(df, "e", "t", "x", "i", 50).collect()) == brute_runs(hot)
    assert runs.collapse(df.limit(0), "e", "t", "x", "i").count() == 0


def test_a_run_goes_on_with_the_text_it_began_with(spark):
    # the last of the four is two slips away from the one before it, but the same as the first
    texts = ["We found the lantern", "We found the lantrn", "We found hte lantrn", "We found the lantern!", "another line"]
    df = spark.createDataFrame([("a", float(k), x, k) for k, x in enumerate(texts)], "e string, t double, x string, i long")
    assert runs.near("we found the lantrn", "we found hte lantrn") and not runs.near("we found hte lantrn", "we found the lantern")
    for parts in (1, 2, 5):
        assert sorted((r["first_id"], r["n_events"]) for r in runs.collapse(df, "e", "t", "x", "i", parts).collect()) == [(0, 4), (4, 1)]


def test_run_durations(spark):
    df = spark.createDataFrame([("a", 1.0, "hi there", 1), ("a", 4.5, "Hi there!", 2), ("a", 5.0, "other", 3)], "e string, t double, x string, i long")
    got = {r["first_id"]: (r["n_events"], r["duration"]) for r in runs.collapse(df, "e", "t", "x", "i").collect()}
    assert got == {1: (2, 3.5), 3: (1, 0.0)}


# ---- tokens
needs_ranks = pytest.mark.skipif(not os.path.exists(tokens.RANKS), reason="no tokenizer files")


@needs_ranks
def test_tokens_equal_the_public_library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.RANKS.replace(".tiktoken", ".json"))
    t.encode_special_tokens = True
    rng = random.Random(1)
    parts = ["'", "s", "'re", "ll", " ", "  ", "\n", "\t", "a", "Z9", "２", "!", "é", "日本", "\xa0", "　", "́", "''", "'ve", "—", "\x1c", "\x85", "🎬", "½", "<|endoftext|>", "can't", "word"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(0, 16))) for _ in range(20_000)] + ["ab" * 3000 + "c", "é" * 4000, ""]
    bpe = tokens.Bpe(open(tokens.RANKS, "rb").read())
    mine = [ids for run in tokens.batches_of(texts) for ids, _ in bpe.encode(run)]
    assert mine == [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]
    ids, offsets = next(bpe.encode(["Hello there, it's me\n"]))
    assert bpe.decode(ids, offsets) == ["Hello", " there", ",", " it", "'s", " me", "\n"] and offsets[-1] == len(ids)
    for run in tokens.batches_of(texts):
        assert ["".join(bpe.decode(*both)) for both in bpe.encode(run)] == run


@needs_ranks
def test_tokens_of_null_and_empty(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "a b"), (3, "a b")], "doc_id long, ids string")
    rows = tokens.encode(df, "doc_id", "ids").collect()
    assert sorted((r["doc_id"], len(r["ids"])) for r in rows) == [(1, 0), (2, 0), (3, 2), (3, 2)]
    assert tokens.encode(df.limit(0), "doc_id", "ids").count() == 0
    back = tokens.decode(tokens.encode(df, "doc_id", "ids", offsets=True), "doc_id").collect()
    assert sorted(map(tuple, back)) == [(1, ""), (2, ""), (3, "a b"), (3, "a b")]


def test_scan_is_composition():
    _, both = tokens._tables()
    rng = np.random.default_rng(0)
    steps = rng.integers(0, 256, 1000).astype(np.uint8)
    out, f = tokens.scan(steps, both, 16), [0, 1, 2, 3]
    for s, got in zip(steps, out):
        f = [(s >> (2 * x)) & 3 for x in f]
        assert tokens._pack(f) == got


# ---- packing
@settings(deadline=None, max_examples=40)
@given(st.lists(st.integers(1, 50), min_size=1, max_size=200))
def test_best_two_fit_uses_each_item_once(sizes):
    counts = np.bincount(sizes, minlength=51)
    plan = packing.best_two_fit(counts, 50)
    used = np.zeros(51, dtype=int)
    for pattern, times in plan:
        assert times > 0 and sum(s * k for s, k in pattern.items()) <= 50
        for s, k in pattern.items():
            used[s] += k * times
    assert (used == counts).all()
    n = sum(t for _, t in plan)
    assert n <= 1.25 * (sum(sizes) / 50) + 2 + sum(s > 25 for s in sizes)


def test_pack_table(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice([None, 0, rng.randrange(1, 100), 64, 250])) for i in range(3000)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "id long, n long, part string")
    out = packing.pack(df, "id", "n", 100, 40).collect()
    held = {}
    for r in out:
        if r["container_id"] is not None:
            held[r["container_id"]] = held.get(r["container_id"], 0) + r["n_tokens"]
    assert max(held.values()) <= 100 and sorted(held) == list(range(1, len(held) + 1))
    total = sum(n or 0 for _, n in rows)
    assert sum(r["n_tokens"] for r in out) == total and len(held) <= 1.02 * total / 100 + 5 + sum(1 for _, n in rows if n and 50 < n <= 100) * 0.3
    assert len([r for r in out if r["id"] == next(i for i, n in rows if n == 250)]) == 3
    assert packing.pack(df.limit(0), "id", "n", 100, 40).count() == 0


# ---- wrong encodings
def test_garbled_values_are_found_and_restored(spark):
    clean = ["Café près du théâtre", "Die grüne Tür über der Brücke", "Ninguém sabia por que não voltou", "Może coś się znajdzie później", "Она сломала синее пальто", "IRMÃ e CORAÇÃO", "½ Way Home", "Été 42 €", "plain"]
    rows = [("captions", "text", i, t) for i, t in enumerate(clean * 6)]
    bad = {
        100: (clean[0].encode().decode("cp1252"), clean[0]), 101: (clean[1].encode().decode("latin-1"), clean[1]), 102: (clean[2].encode().decode("mac_roman"), clean[2]),
        103: (clean[3].encode("cp1250").decode("latin-1"), clean[3]), 104: (clean[4].encode("cp1251").decode("latin-1"), clean[4]), 105: ("vu au thÃ©Ã¢tre", "vu au théâtre"),
        106: (clean[1].encode().decode("cp1252").encode().decode("cp1252"), clean[1]), 107: (clean[0].encode().decode("cp437"), clean[0]), 108: ("l��x perdu", None),
    }
    rows += [("media", "title", i, t) for i, (t, _) in bad.items()] + [("media", "title", 200, None), ("media", "title", 201, ""), ("media", "title", 100, bad[100][0])]
    df = spark.createDataFrame(rows, "table_name string, field_name string, row_id long, x string")
    assert {r["row_id"] for r in mojibake.found_values(df).collect()} == set(bad)
    got = {r["row_id"]: r for r in mojibake.garbled_values(df).collect()}
    for i, (_, original) in bad.items():
        if original is None:
            assert got[i]["is_lost"]
        else:
            assert got[i]["restored"] == original
    assert mojibake.found_values(df.limit(0)).count() == 0


def test_runs_of_unspaced_words_are_garbled_too(spark):
    """Their originals come from the table of forms, under its chain, and are not only undone."""
    run = "小さな喫茶店で黄色い傘"
    once, bare = mojibake._garble(run, "utf-8", "cp1251"), mojibake._garble("カメラ", "shift_jis", "cp1252")
    tokens = [run] * 3 + ["カメラ"] * 3 + ["plain", once, bare]
    got = {r["token"]: (r["original"], r["chain"]) for r in mojibake.garbled_tokens(spark.createDataFrame([(t,) for t in tokens], "token string")).collect()}
    assert got == {once: (run, "utf-8>cp1251"), bare: ("カメラ", "shift_jis>cp1252")}


def test_restoring_leaves_clean_text_alone(spark):
    long_word = "Donaudampfschifffahrtselektrizitätenhauptbetriebswerkbauunterbeamtengesellschaft"
    clean = ["théâtre à la CORAÇÃO", f"das {long_word} über", "déjà-vu", "Été"]
    rows = [("captions", "text", k, t) for k, t in enumerate(clean * 4)]
    garble = lambda t: t.encode().decode("cp1252")
    bad = {
        100: (f"{garble('théâtre')}  {garble('à')} la\tCORAÇÃO, ({garble('théâtre')})", "théâtre  à la\tCORAÇÃO, (théâtre)"), 101: (long_word.encode("cp1252").decode("cp1251"), long_word), 102: (garble("déjà-vu").replace("\xa0", " "), "déjà -vu"),
    }
    df = spark.createDataFrame(rows + [("media", "title", i, t) for i, (t, _) in bad.items()], "table_name string, field_name string, row_id long, x string")
    got = {r["row_id"]: r["restored"] for r in mojibake.garbled_values(df).collect()}
    assert got == {i: t for i, (_, t) in bad.items()}


@data
def test_planted_values_are_restored_exactly(spark):
    rng = random.Random(1)
    vals = mojibake.values(spark, SF.replace("0.001", "0.01"))
    clean = vals.join(mojibake.found_values(vals), ["table_name", "field_name", "row_id"], "left_anti").orderBy("table_name", "field_name", "row_id").collect()
    chains = [lambda s, e=e: mojibake._read(s.encode(), e) for e in mojibake.UTF8_AS[:6]]
    rows, truth = [], {}
    for k, r in enumerate(rng.sample(clean, 400), 10**9):
        chain, tokens = rng.choice(chains), r["x"].split(" ")
        some = [j for j, t in enumerate(tokens) if not t.isascii()]
        some = set(some if rng.random() < 0.5 else rng.sample(some, -(-len(some) // 2)))
        bad = " ".join(chain(t) if j in some else t for j, t in enumerate(tokens))
        if bad != r["x"]:
            truth[k] = r["x"]
            rows.append(("captions", "text", k, bad))
    got = {r["row_id"]: r["restored"] for r in mojibake.garbled_values(vals.unionByName(spark.createDataFrame(rows, vals.schema))).where("row_id >= 1000000000").collect()}
    assert len(got) >= 0.99 * len(truth) and sum(got.get(k) == t for k, t in truth.items()) >= 0.98 * len(truth)


# ---- scanned pages
PAGE = "THE OLD MILL\n\n{}\n{}"
BODY = "Nobody knew why the crew had hidden the wooden ladder near the harbour.\nThat is what the others said when the lights went out, word for word.\n"


def test_scanned_pages(spark):
    body = [BODY] * 8
    body[2] = body[2].replace("harbour.\n", "har-\nbour. ").replace("wooden", "w0oden")
    body[3] = body[3].replace("the crew", "tbe crew")
    rows = [(k, "/x/a.pdf", 10.0 + k, (PAGE.format(b, 40 + k) if k < 6 else b)) for k, b in enumerate(body)]
    rows += [(50 + k, "/x/b.mkv", k + 0.5, BODY + "40") for k in range(20)] + [(90, "/x/a.pdf", None, None), (91, "/x/a.pdf", 30.0, ""), (92, None, 1.0, "x")]
    df = spark.createDataFrame(rows, "caption_id long, media_path string, time double, text string")
    these = scans.pages(df, "caption_id", "media_path", "time", "text")
    read = scans.parsed(these)
    words = scans.vocabulary(df.select(df.text.alias("x")))
    edges, cuts, wrong = scans.edge_noise(read, these), scans.cut_words(read, words), scans.misread_words(read, words)
    assert {r["i"] for r in edges.where("header").collect()} == set(range(6)) == {r["i"] for r in edges.where("pagenum").collect()}
    assert [(r["i"], r["a"], r["b"]) for r in cuts.collect()] == [(2, "har", "bour")]
    assert {(r["i"], r["read_as"], r["printed"]) for r in wrong.collect()} == {(2, "w0oden", "wooden"), (3, "tbe", "the")}
    clean = {r["i"]: r["clean"] for r in scans.clean(these, edges, cuts, wrong).collect()}
    assert clean[2] == clean[0] == clean[3] == " ".join(BODY.split())
    assert scans.pages(df.limit(0), "caption_id", "media_path", "time", "text").count() == 0


def test_misreadings_of_the_less_frequent_of_like_words(spark):
    # have and llave have the same strokes, and llave is the more frequent
    rows = [(k, "/x/a.pdf", float(k), "They have seen it.\nMore.") for k in range(12)] + [(20, "/x/a.pdf", 20.0, "They havc seen it.\nMore.")]
    rows += [(100 + k, "/x/b.mkv", k + 0.5, "la llave") for k in range(40)]
    df = spark.createDataFrame(rows, "caption_id long, media_path string, time double, text string")
    read = scans.parsed(scans.pages(df, "caption_id", "media_path", "time", "text"))
    wrong = scans.misread_words(read, scans.vocabulary(df.select(df.text.alias("x"))))
    assert [tuple(r) for r in wrong.collect()] == [(20, "havc", "have")]


def test_headers_recur_wherever_they_stand(spark):
    # the text goes on in lower case right below, so nothing in the layout sets the title off
    below = ["and then she left.", "of the old house.", "when it rained.", "near the harbour.", "by the mill."]
    rows = [(k, "/x/a.pdf", float(k), f"The Lamp at the Harbour\np. {145 + k}\n{b}\nA longer line of text of this page, number {'abcde'[k] * 9}.\nIt was {'fghij'[k] * 9}.") for k, b in enumerate(below)]
    df = spark.createDataFrame(rows, "caption_id long, media_path string, time double, text string")
    these = scans.pages(df, "caption_id", "media_path", "time", "text")
    found = scans.edge_noise(scans.parsed(these), these).collect()
    assert {(r["i"], r["line"]) for r in found if r["header"]} == {(k, 0) for k in range(5)}
    assert {(r["i"], r["line"]) for r in found if r["pagenum"]} == {(k, 1) for k in range(5)}


def test_edges_are_read_as_deep_as_noise_goes(spark):
    # five running lines above the text: more than an edge is read for at first
    head = ["THE OLD MILL", "Second Series", "Collected by the Guild", "Printed at the Harbour", "Sold by the Station"]
    rows = [(k, "/x/a.pdf", float(k), "\n".join(head) + f"\n\nNobody knew {'abcde'[k] * 5} of it.\nIt was {'fghij'[k] * 9} then.") for k in range(5)]
    df = spark.createDataFrame(rows, "caption_id long, media_path string, time double, text string")
    these = scans.pages(df, "caption_id", "media_path", "time", "text")
    found = scans.edge_noise(scans.parsed(these), these).where("header").collect()
    assert {(r["i"], r["line"]) for r in found} == {(k, j) for k in range(5) for j in range(5)}


def test_long_words_and_numbers_are_no_exception(spark):
    word = "donaudampfschifffahrts" * 4
    rows = [(k, "/x/a.pdf", float(k), f"The {word} is late, {'abcdefghijkl'[k] * 7} said and went away.\nMore text of {'mnopqrstuvwx'[k] * 6} is here, so they read.\n{120034 + k}") for k in range(12)]
    rows += [(20, "/x/a.pdf", 20.0, f"The {word[:-1]}5 is late, she said and went.\nMore of it is there, so they read on.\n120054")]
    df = spark.createDataFrame(rows, "caption_id long, media_path string, time double, text string")
    these = scans.pages(df, "caption_id", "media_path", "time", "text")
    read = scans.parsed(these)
    wrong = scans.misread_words(read, scans.vocabulary(df.select(df.text.alias("x"))))
    assert [tuple(r) for r in wrong.collect()] == [(20, word[:-1] + "5", word)]
    assert scans.edge_noise(read, these).where("pagenum").count() == 13


def test_confusions():
    assert scans.explains("clecir", "decir") and scans.explains("tbc", "the") and not scans.explains("word", "ward")
    assert scans.page_number("- 12 -") == (12, True) and scans.page_number("xiv") == (14, False) and scans.page_number("hello") is None and scans.page_number("ccxiv") == (214, False) and scans.page_number("9" * 40) is None


# ---- survivors
def test_survivors_equal_brute_force(spark):
    rng = random.Random(3)
    titles = [None, "", "Untitled", "IMG_0551", "The Lantern", "The Lan…", "track 12", "Старый фонарь", "Thé bad", "—"]
    shas = [None, "n/a", "0" * 64, "A" * 64, *["%064x" % rng.getrandbits(255) for _ in range(6)]]
    rows = []
    for i in range(1, 400):
        s = rng.choice(shas)
        s = s and rng.choice([s, s.upper(), " " + s, "sha256:" + s])
        rows.append((i, s, rng.choice(titles), rng.choice([None, 0, -1, 1500000000, 1600000000, 4102444800]), rng.choice([None, 0, 3, 9]), rng.choice([None, "en", "de"]), "x"))
    df = spark.createDataFrame(rows, "media_id long, sha256 string, title string, time_modified long, play_count long, language string, n string")
    bad = [r[0] for r in rows if r[2] == "Thé bad"]
    garbled = spark.createDataFrame([(b, "title") for b in bad], "row_id long, field_name string")
    got = {r["sha256"]: r["media_id"] for r in survivors.survivors(df, garbled).collect()}
    groups = {}
    for i, s, t, m, p, *_ in rows:
        d = s and re.sub("^sha256:", "", s.strip().lower())
        if d and re.fullmatch("[0-9a-f]{64}", d) and len(set(d)) > 1:
            usable = t in ("The Lantern", "Старый фонарь")
            groups.setdefault(d, []).append((usable, m if m and 0 < m < survivors.TAKEN else -1, p or 0, -i))
    want = {d: -max(g)[3] for d, g in groups.items() if len(g) > 1}
    assert got == want and want
    assert survivors.survivors(df.limit(0), garbled).count() == 0


def brute_record(naming, others):
    """The most trust of all choices of bundles that agree."""
    import itertools

    best = -1
    for name in naming:
        for chosen in itertools.product(*[[None, *o] for o in others]):
            if all(c is None or survivors.agree(name, c, o) for c, o in zip(chosen, others)):
                best = max(best, name["trust"] + sum(c["trust"] for c in chosen if c is not None))
    return best


def test_the_search_finds_what_the_greedy_choice_misses():
    rng = random.Random(4)
    bundle = lambda kind, own=False: {"kind": kind, "a": rng.choice("uvwxyz"), "b": rng.choice([None, "A", "B", "C"]), "own": own and rng.random() < 0.5, "trust": rng.randrange(1, 12)}
    greedy_lost = 0
    for _ in range(400):
        naming = [bundle("naming") for _ in range(rng.randrange(1, 6))]
        others = [[bundle(kind, kind == "language") for _ in range(rng.randrange(0, 6))] for kind in ("language", "album", "file")]
        best, name, chosen = survivors.search(naming, others)
        assert best == brute_record(naming, others) == name["trust"] + sum(c["trust"] for c in chosen if c is not None)
        assert all(c is None or survivors.agree(name, c, o) for c, o in zip(chosen, others))
        top = max(naming, key=lambda c: c["trust"])
        greedy_lost += top["trust"] + sum(max((c["trust"] for c in o if survivors.agree(top, c, o)), default=0) for o in others) < best
    assert greedy_lost > 20


def test_the_record_keeps_the_dependencies(spark):
    d = "%064x" % 255
    rows = [(k, d, "Old Mill", a, al, la, 1600000000 + k) for k, (a, al, la) in enumerate([("A", None, "en"), ("A", None, "eng"), ("A", None, None), ("B", "Songs", "English"), ("B", "Songs", "xx")])]
    rows += [(10 + k, d, "Untitled", "C", None, "de", 1700000000) for k in range(4)]
    df = spark.createDataFrame(rows, "media_id long, sha256 string, title string, artist string, album string, language string, time_modified long").selectExpr("*", "1 as play_count")
    none = spark.createDataFrame([], "row_id long, field_name string")
    for most in (1, 2, 24):  # however few bundles the first search sees
        (r,) = survivors.survivors(df, none, most=most).collect()
        # A names more rows than B, but only B may stand beside the album; German is of other titles
        assert (r["media_id"], r["title"], r["artist"], r["album"], r["language"], r["n_rows"]) == (4, "Old Mill", "B", "Songs", "en", 9)
    garbled = spark.createDataFrame([(k, "artist") for k in (3, 4)], "row_id long, field_name string")
    (r,) = survivors.survivors(df, garbled).collect()
    assert (r["artist"], r["album"]) == ("A", "Songs")


# ---- languages and reading levels
TEXT = {
    "en": ["The old lantern was found behind the mill.", "Nobody knew why she waited near the harbour.", "We should look for the green door again.", "Please hand me the key and close the window."],
    "de": ["Die alte Laterne wurde hinter der Mühle gefunden.", "Niemand wusste, warum sie am Hafen wartete.", "Wir müssen noch einmal die grüne Tür suchen.", "Bitte gib mir den Schlüssel und mach das Fenster zu."],
    "fr": ["La vieille lanterne était derrière le moulin.", "Personne ne savait pourquoi elle attendait au port.", "Il faut que nous cherchions la porte verte.", "Donne-moi la clé et ferme la fenêtre, s’il te plaît."],
}


def test_languages(spark):
    rows = [(lang, s, 10 * k + j) for k, lang in enumerate(sorted(TEXT)) for j, s in enumerate(TEXT[lang] * 2)] + [("en", None, 99), (None, "x", 98)]
    model, codes = languages.fit(spark.createDataFrame(rows, "lang string, x string, key long"))
    assert codes == ["de", "en", "fr"]
    df = spark.createDataFrame([(1, TEXT["en"][0] + " " + TEXT["de"][1] + " " + TEXT["de"][2]), (2, TEXT["fr"][2]), (3, None), (4, ""), (5, "♪ 7:0")], "id long, text string")
    got = {r["id"]: [p["lang"] for p in r["parts"]] for r in languages.label_texts(df, "id", "text", model, codes).collect()}
    assert got[1] == ["en", "de"] and got[3] == got[4] == got[5] == []
    told = model.scores([languages.letters(s) for lang in codes for s in TEXT[lang]]).argmax(1)
    assert [codes[k] for k in told] == [lang for lang in codes for _ in TEXT[lang]]
    assert languages.label_texts(df.limit(0), "id", "text", model, codes).count() == 0
    none, _ = languages.fit(spark.createDataFrame([], "lang string, x string, key long"))
    assert none is None and languages.label_texts(df, "id", "text", None, []).where("size(parts) > 0").count() == 0


def test_labels(spark):
    df = spark.createDataFrame([(x,) for x in ("EN", "en-US", "eng", "English", "ger", "pt-BR", "und", "", None, " fr ")], "l string")
    assert [r[0] for r in df.select(languages.label(df.l)).collect()] == ["en"] * 4 + ["de", "pt", None, None, None, "fr"]


@data
def test_held_out_languages():
    import duckdb

    rows = duckdb.sql(f"select lang, text from '{SF.replace('0.001', '0.01')}/documents.parquet' where lang is not null and text is not null order by doc_id").fetchall()
    texts = [(lang, b) for lang, t in rows for b in (languages.letters(s) for _, _, s in languages.sentences(t)) if languages.is_full(b)]
    codes = sorted({lang for lang, _ in texts})
    random.Random(0).shuffle(texts)
    by = {c: [b for lang, b in texts if lang == c] for c in codes}
    train = [(c, b) for c in codes for b in by[c][:60]]
    model = languages.StringKernel([b for _, b in train], np.array([codes.index(c) for c, _ in train]), len(codes))
    test = [(c, b) for c in codes for b in by[c][60:100]]
    told = model.scores([b for _, b in test]).argmax(1)
    assert np.mean([codes[k] == c for k, (c, _) in zip(told, test)]) > 0.8  # a tenth of the labels is wrong


@data
def test_held_out_reading_levels():
    import duckdb

    d = SF.replace("0.001", "0.01")
    rows = duckdb.sql(f"select text, reading_level from '{d}/documents.parquet' join '{d}/reading_labels.parquet' using (doc_id) where text is not null order by doc_id").fetchall()
    models = reading.train([t for t, _ in rows[::2]], [lv for _, lv in rows[::2]])
    right = 0
    for t, lv in rows[1::2]:
        s = reading.plain_sentences(t)
        right += bool(s) and reading.LEVELS[int(models[1].predict(reading._summary(s, models[0].predict(s))[None]).argmax())] == lv
    assert right / len(rows[1::2]) > 0.85


def test_reading_without_labels_or_text(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "A cat sat.")], "id long, text string")
    rows = reading.reading_levels(df, "id", "text", None, None, []).collect()
    assert [r["reading_level"] for r in rows] == [None] * 3 and sorted(r["n_words"] for r in rows) == [0, 0, 3]
    assert reading.train([], []) is None


@data
def test_every_query_runs(spark):
    from reelbase.llm.registry import QUERIES

    for name, f in QUERIES.items():
        if name.endswith("_found") or name == "p9_containers":
            assert f(spark, SF).count() > 0, name
