"""Files as tables: listings, subtitles, documents, archives, hashes, probe results.

Listings come from Spark's binary file source with the content pruned; readers of content work on
Arrow batches in the executors, one file at a time.
"""

from __future__ import annotations

import hashlib
import io
import math
import re
import tarfile
import zipfile
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reelbase.functions import paths, strings

#: Cues that start earlier are titles and credits.
FIRST_CUE_S = 10.0
#: Bytes of a text chunk.
CHUNK_LEAST, CHUNK_MOST = 50, 2000
# Texts by extension that hold markup.
MARKUP, SUBTITLES, ZIPPED = ("html", "htm", "xml", "xhtml", "svg", "fb2"), ("srt", "vtt"), ("docx", "odt", "epub", "xlsx", "pptx", "ods", "odp")


#: What a reader may raise on a file that is not what its name says.
UNREADABLE = (ValueError, KeyError, OSError, EOFError, zipfile.BadZipFile, tarfile.TarError, zlib.error)


def _opened(path: str):
    """(file system, path in it, what a path of it begins with outside) of a path or address."""
    from pyarrow import fs

    system, at = fs.FileSystem.from_uri(path if "://" in path else f"file://{quote(path)}")
    return system, at, path[: path.index("://") + 3] if "://" in path and not path.startswith("file:") else ""


def listing(spark: SparkSession, root: str, extensions: list[str] | None = None) -> DataFrame:
    """path, size, time_modified, folder, and is_empty of all files below a folder, empty ones included.

    The folders next below are walked side by side by the workers.
    """
    from pyarrow import fs

    system, at, scheme = _opened(root)
    near = system.get_file_info(fs.FileSelector(at))
    folders = spark.createDataFrame([(scheme + i.path,) for i in near if i.type == fs.FileType.Directory], "root string")
    schema = "path string, size bigint, time_modified bigint"
    row = lambda i, scheme: (scheme + i.path, i.size, int(i.mtime_ns // 10**9) if i.mtime_ns is not None else None)

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for one in pdf["root"]:
                system, at, scheme = _opened(one)
                rows = [row(i, scheme) for i in system.get_file_info(fs.FileSelector(at, recursive=True)) if i.type == fs.FileType.File]
                yield pd.DataFrame(rows, columns=["path", "size", "time_modified"]).astype({"size": "int64", "time_modified": "Int64"})

    deep = folders.repartition(spark.sparkContext.defaultParallelism).mapInPandas(walk, schema)
    out = deep.unionByName(spark.createDataFrame([row(i, scheme) for i in near if i.type == fs.FileType.File], schema))
    out = out.withColumn("folder", paths.parent(F.col("path"))).withColumn("is_empty", F.col("size") == 0)
    return out.where(paths.extension(F.col("path")).isin(["." + e.lstrip(".").lower() for e in extensions])) if extensions else out


def folder_times(files: DataFrame) -> DataFrame:
    """Of every folder with files: how many, how many of them empty, and its first and last change."""
    return files.groupBy("folder").agg(F.count("*").alias("n_files"), F.count_if("is_empty").alias("n_empty"), F.min("time_modified").alias("first_modified"), F.max("time_modified").alias("last_modified"))


def folder_sizes(files: DataFrame) -> DataFrame:
    """Bytes and files below every folder."""
    up = F.slice(paths.ancestors(F.col("path")), 1, F.greatest(paths.depth(F.col("path")) - 1, F.lit(0)))
    return files.select("size", F.explode(up).alias("folder")).groupBy("folder").agg(F.sum("size").alias("total_size"), F.count("*").alias("n_files"))


def contents(spark: SparkSession, root: str, extensions: list[str]) -> DataFrame:
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return df.select(F.regexp_replace("path", "^file:/+", "/").alias("path"), "content").where(paths.extension(F.col("path")).isin(["." + e for e in extensions]))


def per_file(df: DataFrame, read, schema: str) -> DataFrame:
    """Rows that ``read(path, bytes)`` yields of each file; what cannot be read gives none here but
    a row of ``failures``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in schema.split(", ")]
        for pdf in batches:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"]):
                try:
                    rows += list(read(path, bytes(content)))
                except UNREADABLE:
                    continue
            yield pd.DataFrame(rows, columns=names)

    return df.select("path", "content").mapInPandas(run, schema)


def failures(df: DataFrame, read) -> DataFrame:
    """``path`` and ``error`` of the files that ``read(path, bytes)`` cannot read."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"]):
                try:
                    for _ in read(path, bytes(content)):
                        pass
                except UNREADABLE as e:
                    rows.append((path, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["path", "error"])

    return df.select("path", "content").mapInPandas(run, "path string, error string")


def clean_cue(text: str) -> str:
    """A cue without markup; '' for what is left of a broken tag and for a single sign."""
    bare = " ".join(re.sub(r"<[^>]*>|\{\\[^}]*\}", "", text).split())
    return "" if ("=" in bare and '""' in bare) or len(bare.encode()) < 2 else bare


def cues(path: str, content: bytes) -> Iterator[tuple[str, float, str]]:
    """(media_path, time, text) of the cues of an .srt or .vtt file."""
    text = content.decode("utf-8", "replace").replace("\r\n", "\n")
    for block in re.split(r"\n\s*\n", text):
        m = re.search(r"((?:\d+:)?\d+:\d+)[.,](\d{1,3})\s*-->[^\n]*\n(.*)", block, re.S)
        if m:
            seconds = 0.0
            for part in m[1].split(":"):
                seconds = seconds * 60 + int(part)
            at = seconds + int(m[2].ljust(3, "0")) / 1000
            line = clean_cue(m[3])
            if line and at >= FIRST_CUE_S:
                yield re.sub(r"(\.[a-z]{2,3})?\.(srt|vtt)$", "", path), at, line


def captions(spark: SparkSession, root: str) -> DataFrame:
    """Caption rows of all subtitle files below a folder; media_path has no extension."""
    return per_file(contents(spark, root, list(SUBTITLES)), cues, "media_path string, time double, text string")


def external_subtitles(media: DataFrame, files: DataFrame) -> DataFrame:
    """Subtitle files that lie beside a media file and share its stem: stem.srt, stem.xx.srt, stem_xx.srt, stem - xx.srt."""
    subs = files.where(paths.extension(F.col("path")).isin(".srt", ".vtt", ".ass", ".ssa", ".sub")).select(paths.parent(F.col("path")).alias("f"), F.col("path").alias("subtitle"), paths.stem(F.col("path")).alias("s"))
    m = media.select("path", paths.parent(F.col("path")).alias("f"), paths.stem(F.col("path")).alias("stem"))
    rest = F.expr("substring(s, length(stem) + 1)")
    return m.join(subs, "f").where(F.col("s").startswith(F.col("stem")) & rest.rlike(r"^($|[._]| - )")).select("path", "subtitle")


def chunk_text(text: str, least: int = CHUNK_LEAST, most: int = CHUNK_MOST) -> list[str]:
    """Paragraphs packed up to ``most`` bytes; longer ones by sentences; shorter than ``least`` go with the next."""
    out: list[str] = []
    held = ""
    for para in re.split(r"\n\s*\n", text):
        para = " ".join(para.split())
        if not para:
            continue
        units = [para] if len(para.encode()) <= most else re.split(r"(?<=[.!?])\s+", para)
        for u in units:
            while len(u.encode()) > most:  # a sentence without an end
                cut = len(u.encode()[:most].decode("utf-8", "ignore"))
                head, u = u[:cut], u[cut:]
                out, held = [*out, *([held] if held else []), head], ""
            if held and len((held + " " + u).encode()) > most:
                out.append(held)
                held = u
            else:
                held = f"{held} {u}" if held else u
        if len(held.encode()) >= least:
            out.append(held)
            held = ""
    if held:
        out.append(held)
    return out


def chunks(df: DataFrame, id_: str, text: str) -> DataFrame:
    """Numbered chunks of every text."""
    kind = dict(df.dtypes)[id_]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([(i, k, c) for i, t in zip(pdf["i"], pdf["x"]) for k, c in enumerate(chunk_text(t or ""), 1)], columns=["i", "chunk", "chunk_text"])

    return df.select(F.col(id_).alias("i"), F.col(text).alias("x")).mapInPandas(run, f"i {kind}, chunk bigint, chunk_text string").withColumnRenamed("i", id_)


def extract_text(path: str, content: bytes) -> Iterator[tuple[str, str]]:
    """(path, plain text) of a document, by its extension."""
    ext = path.rsplit(".", 1)[-1].lower()
    if ext in ZIPPED:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            wanted = [n for n in z.namelist() if re.search(r"(document|content|sharedStrings|slide\d+)\.xml$|\.x?html?$", n)]
            raw = "\n".join(z.read(n).decode("utf-8", "replace") for n in wanted)
        raw = re.sub(r"</(w:p|text:p|p|a:p|si|h\d)>", "\n", raw)
        yield path, "\n".join(" ".join(re.sub("<[^>]*>", "", x).split()) for x in raw.split("\n") if x.strip())
    elif ext in SUBTITLES:
        yield path, "\n".join(t for _, _, t in cues(path, content))
    elif ext in MARKUP:
        raw = re.sub(r"(?is)<(script|style).*?</\1>", " ", content.decode("utf-8", "replace"))
        yield path, " ".join(re.sub("<[^>]*>", " ", raw).split())
    elif ext == "rtf":
        raw = re.sub(r"\\par[d]?\b", "\n", content.decode("latin-1"))
        yield path, " ".join(re.sub(r"\\'[0-9a-f]{2}|\\[a-z]+-?\d* ?|[{}]", "", raw).split())
    else:
        yield path, content.decode("utf-8", "replace")


def documents(spark: SparkSession, root: str, extensions: list[str]) -> DataFrame:
    return per_file(contents(spark, root, extensions), extract_text, "path string, text string")


def archive_entries(path: str, content: bytes) -> Iterator[tuple[str, str, int]]:
    """(archive, entry, size) of a zip or tar file."""
    if path.lower().endswith((".zip", ".epub", ".cbz", ".docx")):
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            yield from ((path, i.filename, i.file_size) for i in z.infolist())
    else:
        with tarfile.open(fileobj=io.BytesIO(content)) as t:
            yield from ((path, i.name, i.size) for i in t.getmembers())


def archives(spark: SparkSession, root: str) -> DataFrame:
    return per_file(contents(spark, root, ["zip", "epub", "cbz", "tar", "gz", "tgz", "bz2", "xz"]), archive_entries, "path string, entry string, size bigint")


#: Sizes of files and of their chunks, between which chunks grow evenly.
CHUNK_POINTS = ((26_214_400, 262_144), (52_428_800_000, 10_485_760))


def interpolated(x: float, points: tuple[tuple[float, float], ...]) -> float:
    """The value at ``x`` of a line through points, beyond them that of the nearest."""
    if x <= points[0][0]:
        return points[0][1]
    for (x0, y0), (x1, y1) in zip(points, points[1:]):
        if x <= x1:
            return y0 + (x - x0) / (x1 - x0) * (y1 - y0)
    return points[-1][1]


def segments(total: int, chunk: int, gap: float) -> list[int]:
    """Where chunks of a file start, with a gap (below 1 a share of the whole) between them; the last
    ends the file. Up to three chunks' size one segment is enough."""
    if total <= 0 or chunk <= 0:
        return []
    if total <= 3 * chunk:
        return [0]
    step = chunk + (math.ceil(total * gap) if gap < 1 else int(gap))
    return [*range(0, total - 2 * chunk, step), total - chunk]


def sample_hash(size: int, read, gap: float = 0.1, chunk: int = 0) -> str:
    """SHA-256 over the digests of chunks spread over a file; ``read(offset, n)`` gives its bytes.

    An empty file has none (''). Only the chunks are read.
    """
    chunk = chunk if chunk > 0 else int(interpolated(size, CHUNK_POINTS))
    every = segments(size, chunk, gap)
    if not every:
        return ""
    whole = hashlib.sha256()
    for at in every:
        whole.update(hashlib.sha256(read(at, chunk)).digest())
    return whole.hexdigest()


def full_hash(size: int, read, step: int = 1 << 22) -> str:
    whole = hashlib.sha256()
    for at in range(0, size, step):
        whole.update(read(at, step))
    return whole.hexdigest()


def hashed(files: DataFrame, gap: float = 0.1, chunk: int = 0, full: bool = True) -> DataFrame:
    """``path``, ``fasthash``, ``sha256`` (null without ``full``) and ``error`` of listed files.

    Workers open the files where they lie and read by offset, so no file is held whole.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path in pdf["path"]:
                try:
                    system, at, _ = _opened(path)
                    with system.open_input_file(at) as f:
                        read = lambda offset, n, f=f: f.read_at(n, offset)
                        rows.append((path, sample_hash(f.size(), read, gap, chunk), full_hash(f.size(), read) if full else None, None))
                except OSError as e:
                    rows.append((path, None, None, str(e)))
            yield pd.DataFrame(rows, columns=["path", "fasthash", "sha256", "error"])

    return files.select("path").mapInPandas(run, "path string, fasthash string, sha256 string, error string")


def hashes(spark: SparkSession, root: str, extensions: list[str]) -> DataFrame:
    """path, sample hash and full hash of files below a folder."""
    return hashed(listing(spark, root, extensions))


def extract(spark: SparkSession, root: str, extensions: list[str], chunked: bool = True) -> tuple[DataFrame, DataFrame]:
    """Media rows and caption rows of the files below a folder, by one reading of the contents.

    Subtitle files give timed captions of the media file they lie beside, documents untimed ones of
    themselves, in chunks. Media rows hold path, size, time_modified and media_type.
    """

    def read(path: str, content: bytes) -> Iterator[tuple[str, float | None, str]]:
        if path.rsplit(".", 1)[-1].lower() in SUBTITLES:
            yield from cues(path, content)
        else:
            for _, text in extract_text(path, content):
                yield from ((path, None, c) for c in (chunk_text(text) if chunked else [text]) if clean_cue(c))

    files = listing(spark, root, extensions)
    media = files.where(~paths.extension(F.col("path")).isin(["." + e for e in SUBTITLES])).withColumn("media_type", paths.media_type(F.col("path")))
    return media, per_file(contents(spark, root, extensions), read, "media_path string, time double, text string")


PROBE = "struct<format:struct<duration:string,size:string,bit_rate:string,tags:map<string,string>>,streams:array<struct<codec_type:string,codec_name:string,width:bigint,height:bigint,avg_frame_rate:string,tags:map<string,string>>>>"


def frame_rate(text: Column) -> Column:
    """'30000/1001' -> 29.97."""
    return F.try_divide(F.split(text, "/")[0].try_cast("double"), F.coalesce(F.try_element_at(F.split(text, "/"), F.lit(2)).try_cast("double"), F.lit(1.0)))


def probe_columns(df: DataFrame, json: str) -> DataFrame:
    """Media columns from the JSON that a stream probe prints."""
    p = df.withColumn("__p", F.from_json(F.col(json), PROBE))
    of = lambda kind: F.filter("__p.streams", lambda s: s["codec_type"] == kind)
    names = lambda kind: F.array_join(F.array_distinct(F.transform(of(kind), lambda s: s["codec_name"])), ";")
    first = F.try_element_at(of("video"), F.lit(1))
    return p.select(
        *[c for c in df.columns if c != json], F.col("__p.format.duration").try_cast("double").cast("bigint").alias("duration"), F.col("__p.format.size").try_cast("bigint").alias("size"),
        first["width"].alias("width"), first["height"].alias("height"), frame_rate(first["avg_frame_rate"]).alias("fps"), F.size(of("video")).alias("video_count"), F.size(of("audio")).alias("audio_count"),
        F.size(of("subtitle")).alias("subtitle_count"), names("video").alias("video_codecs"), names("audio").alias("audio_codecs"), names("subtitle").alias("subtitle_codecs"),
        F.col("__p.format.tags")["title"].alias("title"), F.col("__p.format.tags")["artist"].alias("artist"), F.col("__p.format.tags")["album"].alias("album"), strings.combine(F.col("__p.format.tags")["genre"]).alias("genre"),
    )


def lines(spark: SparkSession, path: str) -> DataFrame:
    """The lines of text files that are not blank."""
    return spark.read.text(path).where(F.trim("value") != "").withColumnRenamed("value", "line")


def watch_later(media: DataFrame, states: DataFrame) -> DataFrame:
    """Playheads a player kept by the MD5 of each path: joined on that key. ``states``: name, value."""
    start = F.regexp_extract("value", r"(?m)^start=([0-9.]+)", 1).try_cast("double")
    return media.withColumn("__k", F.upper(F.md5("path"))).join(states.select(F.upper("name").alias("__k"), start.cast("bigint").alias("saved")), "__k").drop("__k")
