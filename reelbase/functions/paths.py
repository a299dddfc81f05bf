"""Column functions on file paths and URLs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Kinds of media by file extension.
TEXT = ("epub", "mobi", "azw", "azw3", "fb2", "djvu", "cbz", "cbr", "pdf", "txt", "md", "html", "htm", "rtf", "doc", "docx", "odt")
IMAGE = ("jpg", "jpeg", "png", "gif", "bmp", "webp", "tif", "tiff", "heic", "avif", "svg")
AUDIO = ("mp3", "m4a", "flac", "opus", "ogg", "oga", "wav", "aac", "wma", "m4b", "alac", "aiff", "mka")
VIDEO = ("mp4", "mkv", "avi", "webm", "mov", "wmv", "flv", "m4v", "mpg", "mpeg", "ts", "m2ts", "3gp", "ogv")


# Content types by extension.
MIME = {
    "apk": "application/vnd.android.package-archive", "zim": "application/x-zim", "epub": "application/epub+zip", "pdf": "application/pdf", "mobi": "application/x-mobipocket-ebook",
    "azw": "application/vnd.amazon.ebook", "azw3": "application/vnd.amazon.ebook", "fb2": "application/x-fictionbook", "js": "application/javascript", "json": "application/json", "xml": "application/xml",
    "cbz": "application/vnd.comicbook+zip", "cbr": "application/vnd.comicbook-rar", "txt": "text/plain", "html": "text/html", "htm": "text/html", "css": "text/css", "jpg": "image/jpeg", "jpeg": "image/jpeg",
    "png": "image/png", "gif": "image/gif", "webp": "image/webp", "bmp": "image/bmp", "svg": "image/svg+xml", "tiff": "image/tiff", "tif": "image/tiff", "ico": "image/x-icon", "djvu": "image/vnd.djvu",
    "djv": "image/vnd.djvu", "mp3": "audio/mpeg", "flac": "audio/flac", "ogg": "audio/ogg", "wav": "audio/wav", "opus": "audio/opus", "aac": "audio/aac", "mp4": "video/mp4", "m4v": "video/mp4", "m4a": "video/mp4",
    "webm": "video/webm", "mkv": "video/x-matroska", "avi": "video/x-msvideo", "mov": "video/quicktime", "wmv": "video/x-ms-wmv",
}
OTHER_MIME = "application/octet-stream"


def mime_type(path: Column) -> Column:
    """The content type by extension."""
    known = F.create_map(*[F.lit(x) for both in MIME.items() for x in both])
    return F.coalesce(F.try_element_at(known, F.substring(extension(path), 2, 20)), F.lit(OTHER_MIME))


def without_mount(path: Column) -> Column:
    """Without a drive letter and leading slashes."""
    return F.regexp_replace(path, r"^(?:[\s\S]:)?[/\\]*", "")


def joined(base: Column | str, path: Column) -> Column:
    """A path below a folder, wherever it points: '.', '..' and empty parts are left out."""
    start = F.lit(base) if isinstance(base, str) else base
    # what a '..' takes back is resolved first
    resolved = F.aggregate(
        F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), F.array().cast("array<string>"),
        lambda held, p: F.when(p.isin("", "."), held).when(p == "..", F.slice(held, 1, F.greatest(F.size(held) - 1, F.lit(0)))).otherwise(F.array_append(held, p)),
    )
    return F.array_join(F.concat(F.array(F.regexp_replace(start, "(?<=.)/+$", "")), resolved), "/")


def tidy(path: Column) -> Column:
    """Back slashes become slashes and runs of slashes one."""
    return F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), "/+", "/")


def parts(path: Column) -> Column:
    """The components of a path, without empty ones."""
    return F.filter(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), lambda x: x != "")


def depth(path: Column) -> Column:
    return F.size(parts(path))


def parent(path: Column) -> Column:
    """The folder: '.' for a bare name, '/' at the root."""
    p = tidy(path)
    return F.when(F.instr(p, "/") == 0, ".").when(p.rlike("^/[^/]*$"), "/").otherwise(F.regexp_replace(p, "/[^/]*$", ""))


def basename(path: Column) -> Column:
    return F.substring_index(F.regexp_replace(tidy(path), "(?<=.)/$", ""), "/", -1)


def extension(path: Column) -> Column:
    """Lower case with its dot; '' without one."""
    return F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1))


def stem(path: Column) -> Column:
    return F.regexp_replace(basename(path), r"\.[^.]*$", "")


def parent_at_depth(path: Column, n: int) -> Column:
    """The first ``n`` components as an absolute path; the whole where there are fewer."""
    return F.concat(F.lit("/"), F.array_join(F.slice(parts(path), 1, n), "/"))


def ancestors(path: Column) -> Column:
    """Every prefix of an absolute path, shortest first, the path itself last."""
    p = parts(path)
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(p), F.lit(1))), lambda k: F.concat(F.lit("/"), F.array_join(F.slice(p, 1, k), "/")))


def media_type(path: Column) -> Column:
    """The kind of media by extension; null if unknown. Text goes first, video last."""
    ext = F.substring(extension(path), 2, 20)
    return F.when(ext.isin(*TEXT), "text").when(ext.isin(*IMAGE), "image").when(ext.isin(*AUDIO), "audio").when(ext.isin(*VIDEO), "video")


def is_remote(path: Column) -> Column:
    return F.lower(F.substring(path, 1, 4)) == "http"


def natural_key(text: Column) -> Column:
    """Sorts digit runs by number and other runs by lower-case letters."""
    runs = F.regexp_extract_all(text, F.lit("([0-9]+|[^0-9]+)"), 1)
    number = lambda t: t.rlike("^[0-9]+$")
    return F.transform(runs, lambda t: F.struct(F.when(number(t), 0).otherwise(1).alias("kind"), F.coalesce(F.when(number(t), t.try_cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)")).alias("n"), F.when(number(t), "").otherwise(F.lower(t)).alias("s")))


def is_absolute(path: Column) -> Column:
    """Unix, drive and network paths."""
    return path.rlike(r"^(/|\\\\|[A-Za-z]:[\\/])")


def with_separator(path: Column) -> Column:
    return F.when(path.endswith("/"), path).otherwise(F.concat(path, F.lit("/")))


def without_separator(path: Column) -> Column:
    return F.when(path == "/", path).otherwise(F.regexp_replace(path, "/+$", ""))


def to_url(path: Column) -> Column:
    """'file://' and the percent-encoded path."""
    return F.concat(F.lit("file://"), F.replace(F.replace(F.url_encode(path), F.lit("%2F"), F.lit("/")), F.lit("+"), F.lit("%20")))


def from_url(url: Column) -> Column:
    return F.url_decode(F.replace(F.regexp_replace(url, "^file://", ""), F.lit("+"), F.lit("%2B")))


def relative(path: Column, base: str) -> Column:
    """The path below a folder; the whole where it is not below."""
    start = base.rstrip("/") + "/"
    return F.when(path.startswith(start), F.substr(path, F.lit(len(start) + 1))).otherwise(path)


def url_parts(url: Column) -> Column:
    """(host, folder, name) of a URL."""
    host = F.regexp_replace(F.regexp_extract(url, r"^[a-z]+://([^/?#]+)", 1), "^www\\.", "")
    rest = F.regexp_extract(url, r"^[a-z]+://[^/?#]+(/[^?#]*)", 1)
    return F.struct(host.alias("host"), parent(rest).alias("folder"), basename(rest).alias("name"))
