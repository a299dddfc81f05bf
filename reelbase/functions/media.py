"""Column functions on numbers, times and media properties."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_UNITS = ("B", "KB", "MB", "GB", "TB", "PB", "EB")

# Parts of codec names that browsers play and do not play, codecs that call for WebM,
# and the containers that need no change.
PLAYABLE_VIDEO, PLAYABLE_AUDIO = ("h264", "avc1", "vp8", "vp9", "av1"), ("aac", "mp3", "opus", "vorbis", "flac", "pcm", "wav")
UNPLAYABLE_AUDIO = ("eac3", "ac3", "dts", "truehd", "mlp")
WEBM_VIDEO, WEBM_AUDIO = ("vp9", "vp8", "av1"), ("opus", "vorbis")
MP4_CONTAINERS, WEBM_CONTAINERS = ("mp4", "m4v", "mov", "mkv", "matroska"), ("webm", "mkv", "matroska")
AUDIO_CONTAINERS = ("mp3", "mp4", "m4a", "ogg", "flac", "wav", "opus", "webm")
NO_MEDIA = (".sqlite", ".db", ".txt")


def at(seconds: Column) -> Column:
    return F.timestamp_seconds(seconds)


def period(seconds: Column, frequency: str) -> Column:
    """The label of the period a time falls in (UTC)."""
    t = at(seconds)
    if frequency == "weekly":  # weeks begin on Monday; days before the first are week 00
        week = F.floor((F.dayofyear(t) - 1 + 7 - F.weekday(t)) / 7)
        return F.concat(F.date_format(t, "yyyy"), F.lit("-"), F.lpad(week.cast("string"), 2, "0"))
    if frequency == "quarterly":  # of the date three months before, days overflowing into the next month
        overflow = (F.month(t) == 12) & (F.dayofmonth(t) == 31)
        back = F.add_months(F.when(overflow, F.date_add(t.cast("date"), 1)).otherwise(t.cast("date")), -3)
        return F.concat(F.year(back).cast("string"), F.lit("-Q"), F.quarter(back).cast("string"))
    if frequency == "decadally":
        return (F.floor(F.year(t) / 10) * 10).cast("string")
    layouts = {"minutely": "yyyy-MM-dd HH:mm", "hourly": "yyyy-MM-dd HH'h'", "daily": "yyyy-MM-dd", "monthly": "yyyy-MM", "yearly": "yyyy"}
    return F.date_format(t, layouts[frequency])


def percent_difference(a: Column, b: Column) -> Column:
    """0 for equals; relative to the mean of both, in percent."""
    return F.when(a == b, F.lit(0.0)).otherwise(F.try_divide(F.abs(a - b), (a + b) / 2.0) * 100)


def progress(playhead: Column, duration: Column) -> Column:
    return F.try_divide(playhead.cast("double"), duration.cast("double"))


def bitrate(size: Column, duration: Column) -> Column:
    """Whole bytes a second."""
    return F.when(duration > 0, F.floor(size / duration)).cast("bigint")


def _tenths(x: Column, unit: str) -> Column:
    """'1.5 unit'; a tie goes by the number as it is held, then to the even digit."""
    return F.concat(F.replace(F.format_number(x, 1), F.lit(","), F.lit("")), F.lit(f" {unit}"))


def format_size(size: Column) -> Column:
    """'1.5 MB' in units of 1000; '-' for null and 0."""
    n = F.coalesce(size, F.lit(0)).cast("double")
    out = _tenths(n / 1e18, "EB")
    for k in range(len(_UNITS) - 2, 0, -1):
        out = F.when(n < 1000 ** (k + 1), _tenths(n / 1000**k, _UNITS[k])).otherwise(out)
    return F.when(n == 0, "-").when(n < 1000, F.format_string("%d B", n.cast("bigint"))).otherwise(out)


def _hms(s: Column) -> tuple[Column, Column, Column]:
    return F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60


def format_duration(seconds: Column) -> Column:
    """'2d 03:04' from a day on, else 'h:mm:ss' or 'm:ss'; '-' for null and 0."""
    s = F.coalesce(seconds, F.lit(0)).cast("bigint")
    h, m, r = _hms(s)
    days = F.format_string("%dd %02d:%02d", F.floor(s / 86400), h % 24, m)
    return F.when(s == 0, "-").when(s >= 86400, days).when(h > 0, F.format_string("%d:%02d:%02d", h, m, r)).otherwise(F.format_string("%d:%02d", m, r))


def format_duration_short(seconds: Column) -> Column:
    """In words, of the largest unit: '59 seconds', '1 minute', '1.5 hours', '3 days', '2 years and 5 days'; '' for null and 0."""
    s = F.coalesce(seconds, F.lit(0)).cast("bigint")
    minutes, hours, days = s / 60.0, s / 3600.0, F.floor(s / 86400)
    years, rest = F.floor(days / 365), days % 365
    long = F.when((years > 0) & (rest > 0), F.format_string("%d years and %d days", years, rest)).when(years > 0, F.format_string("%d years", years)).when(days > 1, F.format_string("%d days", days)).otherwise("1 day")
    return (
        F.when(s == 0, "").when(s < 60, F.format_string("%d seconds", s)).when(minutes < 1.1, "1 minute").when(minutes < 60, _tenths(minutes, "minutes"))
        .when(hours < 1.1, "1 hour").when(hours < 24, _tenths(hours, "hours")).otherwise(long)
    )


def hhmmss(seconds: Column) -> Column:
    """'h:mm:ss' or 'm:ss', negative ones with a sign; null for null."""
    h, m, r = _hms(F.abs(seconds.cast("bigint")))
    out = F.when(h > 0, F.format_string("%d:%02d:%02d", h, m, r)).otherwise(F.format_string("%d:%02d", m, r))
    return F.when(seconds.isNotNull(), F.concat(F.when(seconds < 0, "-").otherwise(""), out))


def playback_duration(duration: Column, start: Column, end: Column) -> Column:
    """'Duration: 1:00 (0:30 to 1:30)' of what is played between two offsets, or of the whole."""
    d, a, b = (F.coalesce(c, F.lit(0)).cast("bigint") for c in (duration, start, end))
    b = F.when((a > d) & (b == 0), a + d).otherwise(b)
    swap = (a > b) & (b > 0) & (a + b > d)
    a, b = F.when(swap, b).otherwise(a), F.when(swap, a).otherwise(b)
    length = F.abs(F.when(b > 0, a - b).otherwise(d - a))
    part = F.concat(F.lit("Duration: "), hhmmss(length), F.lit(" ("), hhmmss(a), F.lit(" to "), hhmmss(F.when(b == 0, d).otherwise(b)), F.lit(")"))
    return F.when((a != 0) | (b != 0), part).otherwise(F.concat(F.lit("Duration: "), hhmmss(d)))


def format_time(seconds: Column) -> Column:
    """'2024-01-31 15:04' in the session's time zone; '-' for null and 0."""
    s = F.coalesce(seconds, F.lit(0))
    return F.when(s == 0, "-").otherwise(F.date_format(at(s), "yyyy-MM-dd HH:mm"))


def relative_time(seconds: Column, now: int) -> Column:
    """'today, 15:04', 'yesterday, ..', 'tomorrow, ..', '3 days ago, ..' or 'in 3 days, ..' within
    45 days of ``now``, else the date; '-' for null and 0."""
    s = F.coalesce(seconds, F.lit(0))
    t, present = at(s), at(F.lit(now))
    clock = F.date_format(t, "HH:mm")
    apart = F.abs(F.lit(now) - s)
    days = F.floor(apart / 86400)
    of_day = lambda k: F.dayofmonth(t) == F.dayofmonth(F.date_add(present.cast("date"), k))
    past = s < now
    return (
        F.when(s == 0, "-").when((apart < 86400) & of_day(0), F.concat(F.lit("today, "), clock))
        .when(past & (apart < 2 * 86400) & of_day(-1), F.concat(F.lit("yesterday, "), clock)).when(~past & (apart < 2 * 86400) & of_day(1), F.concat(F.lit("tomorrow, "), clock))
        .when(past & (apart < 45 * 86400), F.concat(F.greatest(days, F.lit(1)).cast("string"), F.lit(" days ago, "), clock))
        .when(~past & (apart < 45 * 86400), F.concat(F.lit("in "), days.cast("string"), F.lit(" days, "), clock))
        .otherwise(F.date_format(t, "yyyy-MM-dd HH:mm"))
    )


def word_count(text: Column) -> Column:
    """Blanks, line breaks and tabs and one more; 0 without text."""
    t = F.coalesce(text, F.lit(""))
    return F.when(F.length(t) == 0, 0).otherwise(F.length(t) - F.length(F.translate(t, " \n\t", "")) + 1)


def reading_seconds(word_n: Column) -> Column:
    """At 3.67 words a second (220 a minute), whole seconds; 0 without words."""
    return F.when(word_n > 0, F.floor(word_n / 3.67)).otherwise(0).cast("bigint")


def transcode(path_ext: Column, media_type: Column, video_codecs: Column, audio_codecs: Column, container: Column | None = None) -> Column:
    """Whether a browser needs another encoding, what can be copied, and the MIME type it gets.

    Video and audio rows only; ``container`` is what a probe says, or else the extension. Codecs
    that are missing are none a browser plays; one unplayable audio codec outweighs playable ones.
    """
    text = lambda c: F.lower(F.coalesce(c, F.lit("")))

    def has(c: Column, names: tuple[str, ...]) -> Column:
        out = F.lit(False)
        for n in names:
            out = out | text(c).contains(n)
        return out

    own = F.expr("nullif('', '')") if container is None else F.when(container != "", container)
    box = F.coalesce(own, F.regexp_replace(F.lower(path_ext), r"^\.", ""), F.lit(""))
    video, audio = has(video_codecs, PLAYABLE_VIDEO), has(audio_codecs, PLAYABLE_AUDIO) & ~has(audio_codecs, UNPLAYABLE_AUDIO)
    webm = has(video_codecs, WEBM_VIDEO) | has(audio_codecs, WEBM_AUDIO)
    fits = F.when(webm, box.isin(*WEBM_CONTAINERS)).otherwise(box.isin(*MP4_CONTAINERS))
    kind = F.when(F.lower(path_ext).isin(*NO_MEDIA), "").otherwise(F.coalesce(media_type, F.lit("")))
    needs = F.when(kind == "video", ~(video & audio & fits)).when(kind == "audio", ~(audio & box.isin(*AUDIO_CONTAINERS))).otherwise(False)
    mime = F.when(needs & (kind == "video"), F.when(webm, "video/webm").otherwise("video/mp4")).when(needs, "audio/webm").otherwise("")
    return F.struct(needs.alias("needs"), (needs & (kind == "video") & video).alias("copy_video"), (needs & audio).alias("copy_audio"), mime.alias("mime"))
