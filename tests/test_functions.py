"""Parsers and column functions against stated cases."""

import pytest
from pyspark.sql import functions as F

from reelbase.functions import media, parsers, paths, ranking, strings
from reelbase.functions.parsers import Range, parse_range


def test_units():
    assert parsers.human_to_bytes("1.5GB") == 1_500_000_000 and parsers.human_to_bytes(" 10 kb ") == 10_000 and parsers.human_to_bytes("7") == 7
    assert parsers.human_to_bits("2Mbit") == 2_000_000
    assert parsers.human_to_seconds("2 hours") == 7200 and parsers.human_to_seconds("1mo") == 2592000 and parsers.human_to_seconds("") == 0
    with pytest.raises(ValueError):
        parsers.human_to_bytes("many")


def test_ranges():
    assert parse_range(">5") == Range(low=6) and parse_range("<5") == Range(high=4) and parse_range("+5") == Range(low=5) and parse_range("-5") == Range(high=5)
    assert parse_range("5-10") == Range(5, 10) and parse_range("100%10") == Range(90, 110) and parse_range("7") == Range(value=7) and parse_range("") == Range()
    assert parse_range(">1,<9") == Range(2, 8) and parse_range("1MB-2MB", parsers.human_to_bytes) == Range(1_000_000, 2_000_000)
    assert Range(2, 8).holds(8) and not Range(2, 8).holds(9)
    with pytest.raises(ValueError):
        parse_range("1-2-3")


def test_dates_percentiles_slices_terms():
    assert parsers.parse_date("2024-01-01") == 1704067200 and parsers.parse_date("01/02/2024") == 1704153600 and parsers.parse_date("1704067200") == 1704067200
    assert parsers.parse_date("3 days", now=1_000_000) == 1_000_000 - 3 * 86400 and parsers.parse_date("nonsense") == 0
    assert parsers.parse_percentiles("p10-90") == (10.0, 90.0) and parsers.parse_percentiles("p0-150") == (0.0, 100.0) and parsers.parse_percentiles("10-90") is None
    assert list(range(10))[parsers.parse_slice("1:8:3")] == [1, 4, 7]
    assert parsers.search_terms("ab \"old cinema\" lantern OR (mill) 'x'") == (["lantern", "OR", "mill"], ["old cinema"])
    assert parsers.plain_terms(["lantern", "OR", "mill"]) == ["lantern", "mill"]


def values(spark, rows, *columns):
    df = spark.createDataFrame([(r,) for r in rows], "x string")
    return [tuple(r) for r in df.select(*columns).collect()]


def test_paths(spark):
    x = F.col("x")
    got = values(spark, ["/a/b/c.MP4", "c.mkv", "/c", "http://h/x.tar.gz", "/a//b/.hidden", None], paths.parent(x), paths.extension(x), paths.stem(x), paths.depth(x))
    assert got == [("/a/b", ".mp4", "c", 3), (".", ".mkv", "c", 1), ("/", "", "c", 1), ("http:/h", ".gz", "x.tar", 3), ("/a/b", ".hidden", "", 3), (None, None, None, None)]
    assert values(spark, ["/a/b/c.mp4"], paths.ancestors(x), paths.parent_at_depth(x, 2)) == [(["/a", "/a/b", "/a/b/c.mp4"], "/a/b")]
    assert values(spark, ["a.PDF", "b.jpg", "c.flac", "d.webm", "e.zzz"], paths.media_type(x)) == [("text",), ("image",), ("audio",), ("video",), (None,)]


def test_natural_order(spark):
    names = ["ep10.mkv", "ep9.mkv", "Ep2.mkv", "ep", "ep99999999999999999999.mkv"]
    df = spark.createDataFrame([(n,) for n in names], "x string")
    assert [r[0] for r in df.orderBy(paths.natural_key(F.col("x"))).collect()] == ["ep", "Ep2.mkv", "ep9.mkv", "ep10.mkv", "ep99999999999999999999.mkv"]


def test_strings(spark):
    x = F.col("x")
    assert values(spark, ["ÉTÉ Lantern", None], strings.ascii_contains(x, "lantern"), strings.ascii_contains(x, "été")) == [(True, False), (None, None)]
    assert values(spark, ["a_b%c"], strings.ascii_like(x, "A_B%C"), strings.ascii_like(x, "%b"), strings.glob_or_like(x, "A_")) == [(True, False, True)]
    assert values(spark, ["a/b.mp4", "a/b/c.mp4"], strings.glob_or_like(x, "a/*.mp4")) == [(True,), (False,)]
    assert values(spark, ["Lantern lantern", None], strings.occurrences(x, "LANTERN")) == [(2,), (0,)]
    assert values(spark, ["Chapter 3", "00:12:01", "Chapter of the Lost", "", None], strings.is_generic_title(x)) == [(True,), (True,), (False,), (True,), (True,)]
    assert values(spark, ["Rock, jazz;rock;unknown", None], strings.combine(x)) == [("Rock;jazz",), ("",)]
    assert values(spark, ["1:02:03", "45"], strings.seconds_of(x)) == [(3723.0,), (45.0,)]
    assert values(spark, ["/a/[b]_c-d.mp4"], strings.tokenized(x)) == [("a b c d mp4",)]


def test_media_numbers(spark):
    df = spark.createDataFrame([(1735603200, 1_500_000, 3725), (1709164800, 0, None), (1717113600, 999, 59)], "t long, s long, d long")
    got = df.select(media.period(F.col("t"), "quarterly"), media.period(F.col("t"), "weekly"), media.period(F.col("t"), "decadally"), media.format_size(F.col("s")), media.format_duration(F.col("d"))).collect()
    assert [tuple(r) for r in got] == [("2024-Q4", "2024-53", "2020", "1.5 MB", "1:02:05"), ("2023-Q4", "2024-09", "2020", "-", "-"), ("2024-Q1", "2024-22", "2020", "999 B", "0:59")]


def test_ranking(spark):
    df = spark.range(1000).withColumn("v", (F.col("id") * 37) % 101).repartition(7)
    numbered = ranking.number(df, [F.col("v"), F.col("id")]).orderBy("rn").collect()
    assert [r["rn"] for r in numbered] == list(range(1, 1001)) and [(r["v"], r["id"]) for r in numbered] == sorted((r["v"], r["id"]) for r in numbered)
    sums = ranking.running_sum(df, [F.col("v"), F.col("id")], "v", "s").orderBy("v", "id").collect()
    total = 0
    for r in sums:
        total += r["v"]
        assert r["s"] == total
    tiles = ranking.ntile(df, [F.col("v"), F.col("id")], 7).groupBy("tile").count().collect()
    assert sorted(r["count"] for r in tiles) == [142, 143, 143, 143, 143, 143, 143]
    assert ranking.number(df.limit(0), [F.col("v")]).count() == 0


def test_more_strings_and_paths(spark):
    x = F.col("x")
    assert values(spark, ["/a b/ü+c.mp4"], paths.to_url(x), paths.from_url(paths.to_url(x)), paths.relative(x, "/a b")) == [("file:///a%20b/%C3%BC%2Bc.mp4", "/a b/ü+c.mp4", "ü+c.mp4")]
    assert values(spark, ["https://www.h.org/a/b.mp4?x=1"], paths.url_parts(x)["host"], paths.url_parts(x)["folder"], paths.url_parts(x)["name"]) == [("h.org", "/a", "b.mp4")]
    assert values(spark, ["C:\\x", "/y", "z"], paths.is_absolute(x)) == [(True,), (True,), (False,)]
    assert values(spark, ["a..b...c", "$$"], strings.remove_consecutive(x, "."), strings.remove_consecutive(x, "$")) == [("a.b.c", "a..b...c"), ("$$", "$")]
    assert values(spark, ["'q'", '"q', "hello mcDonald"], strings.unquoted(x), strings.title_case(x)) == [("q", "'q'"), ('"q', '"q'), ("hello mcDonald", "Hello McDonald")]
    assert values(spark, ["a\nb\n\nc"], strings.unparagraphed(x)) == [("a b\n\nc",)]


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).collect()[0])


def test_durations_and_times_as_text(spark):
    n = lambda x: F.lit(x).cast("bigint")
    assert one(spark, *[media.format_duration(n(x)) for x in (93_780, 3_725, 59, 0, None)]) == ("1d 02:03", "1:02:05", "0:59", "-", "-")
    assert one(spark, *[media.format_duration_short(n(x)) for x in (59, 65, 390, 3_900, 5_400, 90_000, 200_000, 86_400 * 366, 86_400 * 730)]) == ("59 seconds", "1 minute", "6.5 minutes", "1 hour", "1.5 hours", "1 day", "2 days", "1 years and 1 days", "2 years")
    assert one(spark, *[media.hhmmss(n(x)) for x in (-3_661, 61, 0)]) == ("-1:01:01", "1:01", "0:00")
    assert one(spark, media.playback_duration(n(100), n(0), n(0)), media.playback_duration(n(100), n(30), n(90)), media.playback_duration(n(100), n(130), n(0)), media.playback_duration(n(100), n(90), n(30))) == ("Duration: 1:40", "Duration: 1:00 (0:30 to 1:30)", "Duration: 1:40 (2:10 to 3:50)", "Duration: 1:00 (0:30 to 1:30)")
    now = 1_735_689_600 + 43_200  # noon
    assert one(spark, *[media.relative_time(n(x), now) for x in (now - 3_600, now - 86_400, now + 86_400, now - 5 * 86_400, now + 3 * 86_400, 0, now - 100 * 86_400)]) == (
        "today, 11:00", "yesterday, 12:00", "tomorrow, 12:00", "5 days ago, 12:00", "in 3 days, 12:00", "-", "2024-09-23 12:00"
    )
    assert one(spark, *[media.format_size(n(x)) for x in (1_250, 999, 1_500_000, 2 * 10**18)]) == ("1.2 KB", "999 B", "1.5 MB", "2.0 EB")


def test_estimates(spark):
    from reelbase.functions import more

    n = lambda x: F.lit(x).cast("bigint")
    x = F.lit
    assert one(spark, more.corrected_duration(n(10), n(500_000_000), x("/a.vob")), more.corrected_duration(n(10), n(500_000_000), x("/a.mp3")), more.corrected_duration(n(None), n(500_000_000), x("/a.WMV")), more.corrected_duration(n(200), n(10**9), x("/a.iso"))) == (800, 10, 1333, 200)
    assert one(spark, more.timeout_duration(n(0), n(15_000_000), x("/a.mkv")), more.timeout_duration(n(0), n(0), x("/a.mkv")), more.timeout_duration(n(7), n(9), x("/a"))) == (80.0, 0.0, 7.0)
    assert one(spark, more.words_of_size(n(7_000), x("/a.pdf")), more.words_of_size(n(5), x("/a.txt")), more.words_of_size(n(420), x("/a.txt")), media.reading_seconds(n(734)), media.reading_seconds(n(0))) == (1000, 10, 100, 200, 0)


def test_what_browsers_play(spark):
    rows = [("/a.mp4", "video", "h264", "aac"), ("/a.mkv", "video", "h264", "aac,ac3"), ("/a.mkv", "video", "vp9", "opus"), ("/a.avi", "video", "avc1", "wav"), ("/a.mp4", "video", None, "aac"), ("/a.flac", "audio", None, "flac"), ("/a.wma", "audio", None, "wmav2"), ("/a.db", "video", None, None), ("/a.jpg", "image", "mjpeg", None)]
    df = spark.createDataFrame(rows, "p string, t string, v string, a string")
    got = [tuple(r[0]) for r in df.select(media.transcode(paths.extension(F.col("p")), F.col("t"), F.col("v"), F.col("a"))).collect()]
    assert got == [
        (False, False, False, ""), (True, True, False, "video/mp4"), (False, False, False, ""), (True, True, True, "video/mp4"), (True, False, True, "video/mp4"), (False, False, False, ""), (True, False, False, "audio/webm"),
        (False, False, False, ""), (False, False, False, ""),
    ]


def test_smaller_helpers(spark):
    from reelbase.functions import more

    assert parsers.share_or_bytes("5%") == 0.05 and parsers.share_or_bytes("1MB") == 1e6 and parsers.share_or_bytes("x%") == 0.05
    assert parsers.decade(1994) == "90s" and parsers.decade(2003) == "00s" and parsers.decade(1850) == ""
    assert parsers.most_specific(["2020", "2021-05", "2022-05-06", "2999-01-02", "x"], 1_735_689_600) == 1651795200 and parsers.most_specific([], 5) is None
    assert parsers.partial_name("pl", ["media", "playlists"]) == "playlists" and parsers.divisors(12) == [2, 6, 3, 4] and parsers.divisors(9) == [3] and parsers.divided([8, 2, 2]) == 2.0
    with pytest.raises(ValueError):
        parsers.partial_name("", ["a"])
    assert parsers.databases_and_paths(["a.db", "-"], [" /x ", ""]) == (["a.db"], ["/x"])
    x = F.col("x")
    assert values(spark, ["C:\\a\\b", "//x/y", "z"], paths.without_mount(x)) == [("a\\b",), ("x/y",), ("z",)]
    assert values(spark, ["../../etc/passwd", "a/./b/../c", "\\d"], paths.joined("/base", x)) == [("/base/etc/passwd",), ("/base/a/c",), ("/base/d",)]
    assert values(spark, ["film.en.srt", "film_ENG.ass", "film - German.vtt", "film.srt", "film"], more.subtitle_label(x)) == [("English (srt)",), ("English (ssa)",), ("German (vtt)",), ("(srt)",), ("",)]
    assert values(spark, [" a ; b", ""], strings.split_trimmed(x, ";")) == [(["a", "b"],), ([""],)]
