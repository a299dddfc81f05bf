"""Operators on small fixtures, and every registered query against its SQL."""

import os
import re

import pytest
from pyspark.sql import functions as F

from reelbase.functions.parsers import parse_range
from reelbase.operators import aggregates, changes, multivalue, search, similarity, textsort
from reelbase.plans import sorting
from reelbase.sources import files
from reelbase.streaming import history

SF = "/root/testdata/sf0.001"
MEDIA = "media_id long, path string, title string, size long, duration long, time_deleted long, play_count long, media_type string"


def media(spark):
    rows = [
        (1, "/home/user/vids/v1.mp4", "One", 1024, 100, 0, 0, "video"), (2, "/home/user/vids/v2.mp4", "Two", 2048, 101, 0, 3, "video"), (3, "/home/user/music/a1.mp3", None, 5120, None, 0, None, "audio"),
        (4, "/home/user/music/a1.mp3", "Old", None, 7, 99, 1, "audio"),
    ]
    return spark.createDataFrame(rows, MEDIA)


def test_packed_values():
    codes = {"family, home": 3.0, "home": 4.0, "sports": 2.0, "stage; live": 4.0, "aac": 1.0, "aac (he, v2)": 4.0, '12" singles': 5.0, "drama": 2.0, "folk/world": 3.0, "opus": 3.0}
    cases = {
        "sports;home": ["sports", "home"], ";sports;;home; ;": ["sports", "home"], "family, home,sports": ["family, home", "sports"], '["aac", "aac (HE, v2)"]': ["aac", "aac (HE, v2)"],
        '"Stage; Live"; Drama': ["Stage; Live", "Drama"], 'Drama,12" Singles': ["Drama", '12" Singles'], "aac, opus | aac": ["aac", "opus", "aac"], "aac opus": ["aac", "opus"], "Folk/World|Drama": ["Folk/World", "Drama"],
        "family, home": ["family, home"], '"Stage; Live"': ["Stage; Live"], "": [], "  ": [], "new thing; other": ["new thing", "other"], '"12"" Singles",Drama': ['12" Singles', "Drama"],
    }
    for raw, want in cases.items():
        assert multivalue.parse(raw, codes) == want, raw
    many = "drama;sports,home|opus/aac&drama+sports•home"
    assert multivalue.parse("drama;sports,home|opus/aac", codes) == ["drama", "sports", "home", "opus", "aac"] and multivalue.parse(many, codes) == re.split(r"[;,|/&+•]", many)
    assert multivalue.parse(None, codes) == [] and multivalue.parse("a;b", {}) == ["a", "b"]


def test_packed_table(spark):
    df = spark.createDataFrame([(1, "Drama;Jazz", None, "x"), (2, None, " ", "x"), (1, "Drama;Jazz", "Jazz", "x")], "media_id long, genre string, categories string, pos string")
    vocab = spark.createDataFrame([("genre", "Drama"), ("genre", "Jazz"), ("categories", None)], "field_name string, val string")
    rows = sorted(tuple(r) for r in multivalue.split_values(df, "media_id", ["genre", "categories"], vocab).collect())
    assert rows == [(1, "categories", 1, "Jazz", 1)] + [(1, "genre", k, v, 2) for k, v in ((1, "Drama"), (1, "Drama"), (2, "Jazz"), (2, "Jazz"))]
    assert multivalue.split_values(df.limit(0), "media_id", ["genre"], vocab.limit(0)).count() == 0
    raws = ["Drama, Jazz; Folk/World", '"Stage; Live"|Drama', "Folk/World", "Jazz/Drama", None, "new, Drama", "[\"Jazz\", \"Drama\"]"]
    df = spark.createDataFrame([(k, r) for k, r in enumerate(raws * 3)], "media_id long, genre string")
    vocab = spark.createDataFrame([("genre", v) for v in ("Drama", "Jazz", "Folk/World", "Stage; Live")], "field_name string, val string")
    held, joined = (sorted(map(tuple, multivalue.split_values(df, "media_id", ["genre"], vocab, n).collect())) for n in (10, 1))
    assert held == joined and (1, "genre", 1, "Stage; Live", 2) in held  # however large the vocabulary


def test_tree_holds_files_and_folders(spark):
    got = {r["folder"]: (r["n"], r["total_size"]) for r in aggregates.tree(media(spark)).collect()}
    assert len(got) == 7 and got["/home/user/vids"] == (2, 3072) and got["/home"] == (4, 8192) and got["/home/user/music/a1.mp3"] == (2, 5120)
    assert {r["folder"]: r["n_folders"] for r in aggregates.subfolders(media(spark)).collect()} == {"/home": 2, "/home/user": 2}


def test_buckets_and_levels(spark):
    assert sorted(r["low"] for r in aggregates.by_size(media(spark).where("size is not null")).collect()) == [1000, 2048, 5120]
    assert {(r["entry"], r["n"]) for r in aggregates.disk_usage(media(spark), "/home/user/").collect()} == {("/home/user/vids", 2), ("/home/user/music", 1)}
    kept = aggregates.keep_folders(aggregates.by_parent(media(spark)), parse_range(">1"), None, True)
    assert kept.count() == 2


def test_percentiles_cap_mass(spark):
    df = spark.createDataFrame([(1,)] * 900 + [(k,) for k in range(2, 102)], "v long")
    got = {r["pct"]: r["value"] for r in aggregates.percentiles(df, "v").collect()}
    assert sorted(got) == list(range(101)) and got[0] == 1 and got[100] == 101 and got[5] <= 2 and abs(got[50] - 49) <= 2


def test_changes(spark):
    old = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y")], "path string, size long, title string")
    new = spark.createDataFrame([("b", 5, "z"), ("c", 6, "w")], "path string, size long, title string")
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    assert rows(changes.merge(old, new, ["path"])) == [("a", 1, "x"), ("b", 5, "z"), ("c", 6, "w")]
    assert rows(changes.merge(old, new, ["path"], "ignore")) == [("a", 1, "x"), ("b", 2, "y"), ("c", 6, "w")]
    assert rows(changes.merge(old, new, ["path"], "upsert", ["size"])) == [("a", 1, "x"), ("b", 5, "y"), ("c", 6, None)]
    roots = spark.createDataFrame([("/a",), ("/a/b",), ("/ab",)], "path string")
    assert rows(changes.new_roots(roots)) == [("/a",), ("/ab",)]
    items = spark.createDataFrame([(1, p, k, 0) for k, p in enumerate("abcd")], "playlist_id long, media_path string, track_number long, time_added long")
    assert sorted((r["track_number"], r["media_path"]) for r in changes.move_track(items, 1, "d", 1).collect()) == [(0, "a"), (1, "d"), (2, "b"), (3, "c")]


def test_search(spark):
    df = spark.createDataFrame([(1, "/x/lantern.mp4", "The Lantern", "a lantern"), (2, "/x/y.mp4", None, "lantern"), (3, "/x/z.mp4", "zzz", None)], "media_id long, path string, title string, description string")
    got = {r["media_id"]: r["score_rank"] for r in search.relevance(df, "lantern").collect()}
    assert got == {1: 10 + 5 + 1 + 5, 2: 1, 3: 0}
    order = [r["media_id"] for r in search.bm25(df, ["lantern"]).orderBy(F.desc("bm25")).collect()]
    assert order[0] == 1 and order[-1] == 3
    assert search.table_name("pl", ["media", "playlists"]) == "playlists"
    with pytest.raises(ValueError):
        search.table_name("p", ["playlists", "playlist_items"])


def test_merged_captions(spark):
    rows = [("a", 0.0, "hello", 1), ("a", 3.0, "there", 2), ("a", 5.0, "hello", 3), ("a", 700.0, "later", 4), ("a", 599.0, "edge", 5), ("a", 603.0, "edge two", 6), ("b", None, None, 7)]
    df = spark.createDataFrame(rows, "media_path string, time double, text string, caption_id long")
    got = sorted((r["media_path"], r["time"], r["text"]) for r in search.merge_captions(df).collect())
    assert got == [("a", 0.0, "hello. there"), ("a", 599.0, "edge. edge two"), ("a", 700.0, "later"), ("b", 0.0, "")]


def test_similarity(spark):
    df = spark.createDataFrame([(1, 1000, 100), (2, 1005, 101), (3, 5000, 500), (4, 0, 1)], "media_id long, size long, duration long")
    got = {r["media_id"]: r["leader"] for r in similarity.cluster_numbers(df, "media_id").collect()}
    assert got == {1: 1, 2: 1, 3: 3}
    pair = spark.createDataFrame([("night", "nacht"), ("same", "same")], "a string, b string")
    assert [round(r[0], 2) for r in pair.select(similarity.dice(F.col("a"), F.col("b"))).collect()] == [0.25, 1.0]
    m = spark.createDataFrame([(1, "/x/rock_concert.mp4", None, ";old;"), (2, "/x/brock.mp4", None, None)], "media_id long, path string, title string, categories string")
    got = {r["media_id"]: r["new_categories"] for r in similarity.categorize(m, spark.createDataFrame([("music", "rock"), ("more", "rock & roll")], "category string, keyword string")).collect()}
    assert got == {1: ";music;old;", 2: ""}


def test_name_clusters_and_migration(spark):
    df = spark.createDataFrame([(1, "The Lantern Story"), (2, "the lantern-story!"), (3, "The Lantern Stories"), (4, "Old Mill"), (5, None)], "id long, name string")
    clusters = similarity.cluster_names(df, "id", F.col("name"))
    assert {r["id"]: r["leader"] for r in clusters.where("id < 5").collect()} in ({1: 1, 2: 1, 3: 1, 4: 4}, {1: 3, 2: 3, 3: 3, 4: 4})
    assert similarity.duplicates_only(clusters, "id").count() == 2 and similarity.duplicates_only(clusters, "id", True).count() == 1
    old = spark.createDataFrame([(1, "video", "x", "calm", None), (2, None, None, None, 120)], "id long, type string, description string, mood string, bpm long")
    got = [tuple(r) for r in changes.migrate_media(old, {"id": "bigint", "media_type": "string", "description": "string", "play_count": "bigint", "title": "string"}).collect()]
    assert got == [(1, "video", "x\nmood: calm", 0, None), (2, None, "bpm: 120", 0, None)]


def test_names_that_begin_differently_are_compared(spark):
    import random

    rng = random.Random(5)
    words = ["silent", "station", "archive", "hollow", "paper", "story", "the", "a"]
    names = {1: "The Silent Station", 2: "Silent Station", 3: "station archive", 4: "hollow station archive"} | {k: " ".join(rng.choices(words, k=rng.randint(1, 4))) for k in range(5, 150)}
    df = spark.createDataFrame(list(names.items()), "id long, name string")
    got = {r["id"]: r["leader"] for r in similarity.cluster_names(df, "id", F.col("name")).collect()}
    want, leaders = {}, []
    for k, name in names.items():
        bare = name.lower().replace(" ", "")
        mine = {bare[i : i + 2] for i in range(max(1, len(bare) - 1))}
        want[k] = next((lead for lead, seen in leaders if 2 * len(seen & mine) > 0.8 * (len(seen) + len(mine))), k)
        if want[k] == k:
            leaders.append((k, mine))
    assert got == want and got[2] == 1
    # the same however many are compared at once, with keys that are no numbers
    text = df.select(F.format_string("k%03d", "id").alias("id"), "name")
    for first, most in ((9, 30), (60, 60)):
        few = {r["id"]: r["leader"] for r in similarity.cluster_names(text, "id", F.col("name"), first=first, most=most).collect()}
        assert few == {f"k{k:03d}": f"k{lead:03d}" for k, lead in want.items()}
    assert similarity.cluster_names(df.limit(0), "id", F.col("name")).count() == 0
    assert similarity.cluster_names(df.where("id = 2"), "id", F.col("name")).collect() == [(2, 2)]


def test_like_sets_are_those_of_brute_force():
    import random

    import numpy as np

    from reelbase.operators import alike

    rng = random.Random(3)
    for ratio in (0.8, 0.4):
        sets = [sorted(rng.sample(range(700) if k % 3 else range(690, 700), rng.randint(1, 9))) for k in range(300)]
        sets += [sorted({*s[1:], rng.randrange(700)}) for s in sets]
        packed = alike.Sets.of([np.array(s, np.int32).tobytes() for s in sets], 700)
        index = alike.Index(packed, ratio)
        got = {(a, b) for x, y in index.like(packed, np.arange(600)) for a, b in zip(y.tolist(), x.tolist())}
        assert got == {(a, b) for b in range(600) for a in range(b) if 2 * len({*sets[a]} & {*sets[b]}) > ratio * (len(sets[a]) + len(sets[b]))}
        assert (index.slot >= 0).any() and packed.rest.any()


def test_titles_all_alike_in_time(spark):
    """Groups of thousands of titles that are all alike: each pair of them kept took over a minute."""
    import time

    import numpy as np

    from reelbase.operators import alike

    df = spark.range(24_000).select("id", F.concat(F.element_at(F.split(F.lit("Midnight Voyage: Station,Garden of the Crimson Lantern,A Hollow Mirror Story"), ","), (F.col("id") % 3 + 1).cast("int")), F.format_string(" #%d", F.floor(F.col("id") / 3))).alias("title"))
    began = time.monotonic()
    clusters = similarity.cluster_names(df, "id", F.col("title"))
    got = similarity.duplicates_only(clusters, "id").agg(F.count("*"), F.countDistinct("leader")).first()
    assert got[0] > 23_000 and got[1] < 500 and time.monotonic() - began < 60
    # told beforehand, so that fewer are compared at once
    index = alike.Index(similarity._elements(["aaab" + "cdefghijklmnop"[:k] for k in range(10, 15)] * 200, {g: k for k, g in enumerate(["aa", "ab", "bc", *map("".join, zip("cdefghijklmno", "defghijklmnop"))])}), 0.8)
    links = {(a, b) for x, y in index.like(index.sets, np.arange(1000)) for a, b in zip(x.tolist(), y.tolist())}
    assert 0.5 < index.expected(90) / len(links) < 2


def test_many_numbered_names_in_time(spark):
    """30,000 names of a few words and a number: joined by single letter pairs they took over a minute."""
    import time

    words = F.element_at(F.split(F.lit("lantern,harbour,signal,orchard,station,corridor,voyage,garden"), ","), (F.col("id") % 8 + 1).cast("int"))
    df = spark.range(30_000).select("id", F.concat(words, F.format_string("_%08d", "id")).alias("name"))
    began = time.monotonic()
    got = similarity.cluster_names(df, "id", F.col("name")).agg(F.count("*"), F.countDistinct("id")).first()
    assert tuple(got) == (30_000, 30_000) and time.monotonic() - began < 60


def test_number_clusters_have_no_edges(spark):
    # 2048.4 = 1.1 ** 80; a missing duration is not compared, a missing size is like no other
    df = spark.createDataFrame([(1, 2040, 100), (2, 2056, 101), (3, 2050, None), (4, None, 5), (5, None, 5), (6, 9000, 100)], "media_id long, size long, duration long")
    assert {r["media_id"]: r["leader"] for r in similarity.cluster_numbers(df, "media_id").collect()} == {1: 1, 2: 1, 3: 1, 6: 6}
    assert {r["media_id"]: r["leader"] for r in similarity.cluster_numbers(df, "media_id", singles=True).collect()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 6}


def test_one_paragraph_keeps_every_document(spark):
    from reelbase.functions import strings
    from reelbase.registry import QUERIES

    cases = {"“Hello” world …": "'Hello' world ...", " a\n\n\n b\u00a0c ": "a b c", "„x‟": "x", "«'in'»": "in", "''": "", '"': '"', "＇": "", "«x'": "«x'", None: None, "": "", "'" * 3: "'"}
    df = spark.createDataFrame([(k,) for k in cases], "t string").select("t", strings.one_paragraph(F.col("t")).alias("p"))
    assert {r["t"]: r["p"] for r in df.collect()} == cases
    assert QUERIES["x03_one_paragraph"](spark, SF).count() == spark.read.parquet(SF + "/documents.parquet").count()


def test_sort_language():
    assert sorting.parse("size desc,-title,reverse_path,_weighted_rerank") == [("size", True), ("title", True), ("path", True)]
    assert sorting.parse("-default")[0] == ("video_count", False) and len(sorting.parse("du")) == 5


def test_line_sort(spark):
    lines = ["bb aa", "cc", "aa cc x", None, "AA-BB", "http://zz dd"]
    df = spark.createDataFrame(list(enumerate(lines, 1)), "id long, line string")
    of = lambda **o: [(r["id"], r["words"]) for r in textsort.sort_lines(df, "id", "line", **o).orderBy("rn").collect()]
    assert of(word_order=("alpha",)) == [(4, ""), (5, "aa bb"), (1, "aa bb"), (3, "aa cc"), (2, "cc"), (6, "dd zz")]
    assert [i for i, _ in of(unique=True)] == [6] and [i for i, _ in of(duplicate=True, unique=False)] == [5, 1, 2, 3]
    assert [i for i, _ in of(line_order=("-count", "line"), stop=("CC",))] == [5, 1, 6, 3, 4, 2]
    assert textsort.order_words(["b2", "b10", "a", "b2"], {"b2": 4, "b10": 1, "a": 2}, ("natural",)) == ["a", "b2", "b2", "b10"]
    assert textsort.order_words(["b2", "b10", "a", "b2"], {"b2": 4, "b10": 1, "a": 2}, ("-linecount", "count")) == ["b2", "b2", "b10", "a"]
    assert textsort.order_words(["y", "x", "y"], {"x": 1, "y": 2}, ("-lastindex",)) == ["x", "y", "y"] and textsort.order_words(["y", "x"], {"x": 1, "y": 1}, ("skip", "-dup", "-alpha")) == ["y", "x"]
    found = spark.range(1).select(textsort.line_words(F.lit("Ep. 12: S01E02"), (r"[A-Z]\w+", r"[0-9]+"))).collect()[0][0]
    assert found == ["01", "02"]  # what the first finds, and of that what the second does


def test_segments_and_sample_hashes(tmp_path, spark):
    import hashlib

    assert files.segments(100, 2, 0.1) == [0, 12, 24, 36, 48, 60, 72, 84, 98] and files.segments(6, 2, 0.1) == [0] and files.segments(0, 2, 0.1) == [] and files.segments(100, 10, 30) == [0, 40, 90]
    assert files.interpolated(1, files.CHUNK_POINTS) == 262_144 and files.interpolated(10**12, files.CHUNK_POINTS) == 10_485_760
    data_ = bytes(range(256)) * 40
    (tmp_path / "a ü.bin").write_bytes(data_)
    (tmp_path / "none.bin").write_bytes(b"")
    want = hashlib.sha256(b"".join(hashlib.sha256(data_[a : a + 1000]).digest() for a in files.segments(len(data_), 1000, 0.1))).hexdigest()
    got = {r["path"].rsplit("/", 1)[1]: r for r in files.hashed(files.listing(spark, str(tmp_path)), 0.1, 1000).collect()}
    assert got["a ü.bin"]["fasthash"] == want and got["a ü.bin"]["sha256"] == hashlib.sha256(data_).hexdigest() and got["none.bin"]["fasthash"] == ""
    gone = spark.createDataFrame([(str(tmp_path / "gone"),)], "path string")
    assert files.hashed(gone).collect()[0]["error"]


def test_requests_and_sort_dispatch(spark):
    from reelbase.plans import spec

    q = spec.from_parameters({"search": ["a b"], "min_size": ["5"], "max_size": ["9"], "modified": ["+2020-01-01,-3 days"], "sort_fields": ["size,-title desc"], "sort_desc": ["title"], "limit": ["x"], "rating": ["0", "no"], "trash": ["true"], "episodes": ["p10-50"]})
    assert (q.search, q.size, q.after, q.before, q.play_in_order, q.limit, q.ratings, q.only_deleted, q.file_counts) == (["a", "b"], [">5MB", "<9MB"], {"modified": "2020-01-01"}, {"modified": "3 days"}, "size,-title", 100, [0], True, "p10-50")
    assert spec.search_mode(q) == "substring" and spec.search_mode(spec.QuerySpec(fts=True, no_fts=True)) == "substring"
    with pytest.raises(ValueError):
        spec.known_databases(spec.QuerySpec(dbs=["a.db", "b.db"]), ["a.db"])
    assert sorting.marked_groups("path,_weighted_rerank,-size,_natural_order,title") == [("natural", [("path", False)]), ("weighted", [("size", True)]), ("natural", [("title", False)])]
    assert sorting.choose(sort_by="default", reverse=True) == ("advanced", "reverse_default") and sorting.choose(play_in_order="ps") == ("advanced", "ps") and sorting.choose(natural_sort=True) == ("basic", "natural_path")


def test_playlists_and_sinks(spark, tmp_path):
    from reelbase.sources import sinks

    lists = spark.createDataFrame([(1, "/a", None, 0)], "id long, path string, title string, time_deleted long").selectExpr("*", "cast(null as string) as extractor_key", "cast(null as string) as extractor_config")
    made = changes.playlist_created(changes.playlist_created(lists, "/a", "A"), "/b", "B")
    assert sorted((r["id"], r["path"], r["title"]) for r in made.collect()) == [(1, "/a", "A"), (2, "/b", "B")]
    items = spark.createDataFrame([(1, "x", 5, 7)], "playlist_id long, media_path string, track_number long, time_added long")
    new = spark.createDataFrame([(1, "x", 9), (1, "y", 2), (1, "y", 2)], "playlist_id long, media_path string, track_number long")
    assert sorted(tuple(r) for r in changes.items_added(items, new, 50).select("media_path", "track_number", "time_added").collect()) == [("x", 9, 7), ("y", 2, 50)]
    assert changes.items_removed(items, 1, "x").count() == 0 and changes.items_removed(items, 1, "y").count() == 1
    rows = lambda *r: spark.createDataFrame(list(r), "path string, size long, time_deleted long")
    sinks.write_media(rows(("a", 1, 9)), f"file://{tmp_path}/m")
    out = sinks.write_media(rows(("a", 2, 0), ("b", 3, 0)), f"file://{tmp_path}/m")
    assert out.endswith("v=2") and sorted(tuple(r) for r in spark.read.parquet(out).collect()) == [("a", 2, 0), ("b", 3, 0)]
    (line,) = sinks.lines(spark.createDataFrame([("p", 90, None)], "path string, duration long, size long")).collect()
    assert line["line"] == "p\t1:30\t-"


def test_folders_alike(spark):
    stats = spark.createDataFrame([("a", 10, 100), ("b", 10, 101), ("c", 20, 100), ("d", 10, 0)], "folder string, file_count long, median_size long")
    got = {r["folder"]: r["leader"] for r in similarity.similar_folders(stats, ("file_count", "median_size")).collect()}
    assert got == {"a": "a", "b": "a", "c": "c", "d": "d"}  # a size of 0 is compared as well


def test_file_sources(spark, tmp_path):
    import zipfile

    d = tmp_path / "lib"
    d.mkdir()
    (d / "film.mkv").write_bytes(b"x" * 100)
    (d / "film.en.srt").write_text("1\n00:00:05,000 --> 00:00:06,000\ncredits\n\n2\n00:00:12,500 --> 00:00:13,000\n<i>Hello</i>\nthere\n")
    (d / "note.html").write_text("<html><script>no</script><p>Some <b>words</b></p></html>")
    with zipfile.ZipFile(d / "book.zip", "w") as z:
        z.writestr("a.txt", "hello")
    (d / "broken.zip").write_bytes(b"no archive")
    root = str(d)
    listed = files.listing(spark, root)
    assert listed.count() == 5 and files.listing(spark, root, ["mkv"]).collect()[0]["size"] == 100
    assert [(r["media_path"].endswith("/film"), r["time"], r["text"]) for r in files.captions(spark, root).collect()] == [(True, 12.5, "Hello there")]
    pairs = files.external_subtitles(listed.where(F.col("path").endswith(".mkv")), listed).collect()
    assert len(pairs) == 1 and pairs[0]["subtitle"].endswith("film.en.srt")
    assert files.documents(spark, root, ["html"]).collect()[0]["text"] == "Some words"
    assert [(r["entry"], r["size"]) for r in files.archives(spark, root).collect()] == [("a.txt", 5)]
    assert len(files.hashes(spark, root, ["mkv"]).collect()[0]["fasthash"]) == 64
    assert [r["path"].rsplit("/", 1)[1] for r in files.failures(files.contents(spark, root, ["zip"]), files.archive_entries).collect()] == ["broken.zip"]
    (d / "noise.srt").write_text('1\n00:00:12,500 --> 00:00:13,000\nuntitled chapter="" 1=""\n\n2\n00:00:14,500 --> 00:00:15,000\n!\n')
    assert files.captions(spark, root).count() == 1
    found, told = files.extract(spark, root, ["mkv", "srt", "html"])
    assert {(r["path"].rsplit("/", 1)[1], r["media_type"]) for r in found.collect()} == {("film.mkv", "video"), ("note.html", "text")} and {(r["time"], r["text"]) for r in told.where("media_path not like '%mkv'").collect()} == {(12.5, "Hello there"), (None, "Some words")}
    sums = {r["folder"]: r["n_files"] for r in files.folder_sizes(listed).collect()}
    assert sums[root] == 5


def test_chunks_and_probe(spark):
    text = "Short.\n\n" + "A sentence of some length here. " * 120 + "\n\n" + "x" * 5000
    got = files.chunk_text(text)
    assert all(len(c.encode()) <= 2000 for c in got) and "".join("".join(got).split()) == "".join(text.split()) and files.chunk_text("") == []
    probe = '{"format":{"duration":"12.7","size":"99","tags":{"title":"T","genre":"rock; Rock"}},"streams":[{"codec_type":"video","codec_name":"h264","width":640,"height":480,"avg_frame_rate":"30000/1001"},{"codec_type":"audio","codec_name":"aac"},{"codec_type":"audio","codec_name":"aac"}]}'
    r = files.probe_columns(spark.createDataFrame([("p", probe)], "path string, j string"), "j").collect()[0]
    assert (r["duration"], r["width"], round(r["fps"], 2), r["audio_count"], r["audio_codecs"], r["genre"]) == (12, 640, 29.97, 2, "aac", "rock")


def test_streams(spark, tmp_path):
    src = str(tmp_path / "in")
    rows = [("2024-01-01 10:05:00", "a"), ("2024-01-01 10:55:00", "b"), ("2024-01-01 11:05:00", "a")]
    spark.createDataFrame(rows, "ts string, media_path string").select(F.to_timestamp("ts").alias("ts"), "media_path").coalesce(1).write.parquet(src)
    stream = spark.readStream.schema("ts timestamp, media_path string").parquet(src)
    query = history.usage_windows(stream, "ts").writeStream.outputMode("complete").format("memory").queryName("usage_test").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c1")).start()
    query.awaitTermination(120)
    assert sorted(r["n"] for r in spark.table("usage_test").collect()) == [1, 2]
    got = []
    known = spark.createDataFrame([("a", 0, 0, 0, 0), ("b", 0, 0, 0, 5)], "path string, time_first_played long, time_last_played long, play_count long, playhead long")
    plays = str(tmp_path / "plays")
    spark.createDataFrame([(1, "a", 100, 7, 1), (2, "a", 200, 9, 0)], "id long, media_path string, time_played long, playhead long, done long").coalesce(1).write.parquet(plays)
    batches = spark.readStream.schema("id long, media_path string, time_played long, playhead long, done long").parquet(plays)
    q = history.fold_playback(batches, lambda: known, lambda df, n: got.extend(df.collect())).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c2")).start()
    q.awaitTermination(120)
    assert {r["path"]: (r["time_first_played"], r["time_last_played"], r["play_count"], r["playhead"]) for r in got} == {"a": (100, 200, 1, 9), "b": (0, 0, 0, 5)}


def test_stateful_captions(spark, tmp_path):
    src = str(tmp_path / "caps")
    spark.createDataFrame([("a", 1.0, "hello"), ("a", 4.0, "there"), ("a", 60.0, "later"), ("a", 99.0, "end")], "media_path string, time double, text string").coalesce(1).write.parquet(src)
    stream = spark.readStream.schema("media_path string, time double, text string").parquet(src)
    q = history.merged_captions(stream).writeStream.format("memory").queryName("merged_test").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination(120)
    assert [(r["time"], r["text"]) for r in spark.table("merged_test").orderBy("time").collect()] == [(1.0, "hello. there"), (60.0, "later")]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_queries_equal_their_sql(spark):
    import math

    import duckdb

    from reelbase import registry

    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")

    def norm(x):
        if isinstance(x, float):
            return None if math.isnan(x) else round(x, 5)
        return x

    for name, f in registry.QUERIES.items():
        df = f(spark, SF)
        cols = sorted(df.columns)
        mine = [tuple(norm(r[c]) for c in cols) for r in df.collect()]
        if name in registry.ORACLE:
            rel = con.sql(registry.ORACLE[name])
            assert sorted(rel.columns) == cols, name
            at = [rel.columns.index(c) for c in cols]
            theirs = [tuple(norm(r[k]) for k in at) for r in rel.fetchall()]
            key = lambda r: tuple((x is None, str(x)) for x in r)
            assert sorted(mine, key=key) == sorted(theirs, key=key), name
