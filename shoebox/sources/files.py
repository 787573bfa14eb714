"""Readers and writers for files as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shoebox.sources.swap import put_in_place

#: Extensions of the kinds of media, and those that name a format another one also names.
IMAGE = ("jpg", "jpeg", "png", "webp", "heic", "heif", "tif", "tiff", "bmp")
RAW = ("cr2", "cr3", "nef", "nrw", "arw", "srf", "sr2", "dng", "raf", "orf", "rw2", "pef", "srw", "x3f", "3fr", "iiq", "rwl")
VIDEO = ("mp4", "mov", "m4v", "avi", "mkv", "mts", "m2ts", "3gp", "webm")
SAME_FORMAT = {"jpg": "jpeg", "heif": "heic", "tif": "tiff"}
#: Bytes up to which a file is hashed whole, and of each of the samples of a larger one.
HASHED_WHOLE, SAMPLE = 64 << 20, 4 << 20


def extension(path: Column | str) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))


def media_kind(path: Column | str) -> Column:
    """raw, image, video or null by extension."""
    e = extension(path)
    return F.when(e.isin(*RAW), "raw").when(e.isin(*IMAGE), "image").when(e.isin(*VIDEO), "video")


def file_format(path: Column | str) -> Column:
    """The extension, one name for each format."""
    e = extension(path)
    out = e
    for known, name in SAME_FORMAT.items():
        out = F.when(e == known, name).otherwise(out)
    return out


def content_hash(content: Column | str, size: Column | str) -> Column:
    """A hash that tells changed and moved files: of the whole content or, of large files, of the size and samples of
    head, middle and tail. Spark reads a file of up to 2 GB as one value; a reader of larger ones hands over samples."""
    content, size = (F.col(x) if isinstance(x, str) else x for x in (content, size))
    middle = F.substring(content, (F.floor(size / 2) + 1).cast("int"), F.lit(SAMPLE))
    parts = F.concat(F.encode(size.cast("string"), "utf-8"), F.substring(content, 1, SAMPLE), middle, F.substring(content, F.greatest(size - SAMPLE, F.lit(0)).cast("int") + 1, F.lit(SAMPLE)))
    return F.when(size <= HASHED_WHOLE, F.sha2(content, 256)).otherwise(F.sha2(parts, 256))


def list_media(spark: SparkSession, root: str, content: bool = False) -> DataFrame:
    """Media files below a root, hidden files and folders left out; `content` adds the bytes and their hash."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    hidden = F.regexp_replace("path", r"^[a-zA-Z][a-zA-Z0-9+.-]*:/*", "").rlike(r"(^|/)\.[^/]")
    rows = files.where(media_kind("path").isNotNull() & ~hidden)
    columns = ["path", F.col("length").alias("size_bytes"), F.col("modificationTime").alias("mtime"), media_kind("path").alias("media_type"), file_format("path").alias("format")]
    return rows.select(*columns, *([content_hash("content", "length").alias("file_hash"), "content"] if content else []))


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines with a declared schema; lines that don't parse are kept in _corrupt and can be told apart."""
    return spark.read.schema(f"{schema}, _corrupt string").option("columnNameOfCorruptRecord", "_corrupt").json(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", "true").csv(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", "true").csv(path)


def replace_json(df: DataFrame, path: str) -> None:
    """Write rows beside the old ones, which `df` may read, and then put them in their place (`put_in_place`)."""
    new = f"{path.rstrip('/')}.new"
    df.write.mode("overwrite").json(new)
    put_in_place(df.sparkSession, new, path)


def to_json(*columns: str) -> Column:
    return F.to_json(F.struct(*columns))


def html_fields(html: Column | str) -> dict[str, Column]:
    """Title, language and a description of a page, by pattern."""
    return {
        "title": F.trim(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)),
        "page_lang": F.regexp_extract(html, r"(?i)<html[^>]*\slang=[\"']?([A-Za-z-]+)", 1),
    }


def dms_degrees(text: Column | str) -> Column:
    """"41 52 48.5 N" as signed decimal degrees."""
    part = [F.regexp_extract(text, r"^\s*(\d+)\D+(\d+)\D+([\d.]+)\D*?([NSEWnsew])\s*$", i) for i in range(1, 5)]
    size = F.try_add(part[0].try_cast("double"), F.try_add(part[1].try_cast("double") / 60, part[2].try_cast("double") / 3600))
    return F.when(F.upper(part[3]).isin("S", "W"), -size).otherwise(size)


def exif_time(text: Column | str) -> Column:
    """"2025:06:01 18:30:00" as a wall-clock time; null if it is none."""
    return F.to_timestamp_ntz(F.when(F.col(text).rlike(r"^\d{4}:\d\d:\d\d \d\d:\d\d:\d\d") if isinstance(text, str) else text.rlike(r"^\d{4}:\d\d:\d\d \d\d:\d\d:\d\d"), F.substring(text, 1, 19)), F.lit("yyyy:MM:dd HH:mm:ss"))


def position(lat: Column, lon: Column) -> tuple[Column, Column]:
    """Coordinates on the globe, or nulls: one that is missing or out of range, and 0/0, which devices write for none."""
    good = F.coalesce(lat.between(-90, 90) & lon.between(-180, 180) & ~((lat == 0) & (lon == 0)), F.lit(False))
    return F.when(good, lat), F.when(good, lon)


def offset_minutes(text: Column | str) -> Column:
    """"+02:00" or "-0330" as minutes; null if it is neither."""
    part = [F.regexp_extract(text, r"([+-])(\d{2}):?(\d{2})", i) for i in range(1, 4)]
    size = part[1].try_cast("int") * 60 + part[2].try_cast("int")
    return F.when(part[0] == "-", -size).otherwise(size)


def camera_name(make: Column, model: Column) -> Column:
    """Maker and model without saying the maker twice; a maker in capitals is written as a name."""
    brand = F.split(make, r"\s+")[0]
    shown = F.when((F.upper(brand) == brand) & (F.lower(brand) != brand), F.initcap(brand)).otherwise(brand)
    missing = lambda c: c.isNull() | (c == "")
    return F.when(missing(model), F.when(~missing(make), make)).when(missing(make) | F.startswith(F.lower(model), F.lower(brand)), model).otherwise(F.concat(shown, F.lit(" "), model))


def shutter(seconds: Column) -> Column:
    """"1/250", or "2s" from a second on; null for none."""
    whole = F.regexp_replace(F.format_string("%.6f", seconds.cast("double")), r"\.?0+$", "")
    return F.when(seconds >= 1, F.concat(whole, F.lit("s"))).when(seconds > 0, F.concat(F.lit("1/"), F.bround(1 / seconds, 0).cast("bigint").cast("string")))


def xmp_keywords(xmp: Column | str) -> Column:
    """Keywords of an XMP packet, each level of a hierarchical one by itself, in order, each once."""
    blocks = F.concat(*[F.regexp_extract_all(xmp, F.lit(rf"(?s)<{tag}>(.*?)</{tag}>"), 1) for tag in ("dc:subject", "lr:hierarchicalSubject")])
    items = F.flatten(F.transform(blocks, lambda b: F.regexp_extract_all(b, F.lit(r"(?s)<rdf:li[^>]*>(.*?)</rdf:li>"), 1)))
    parts = F.flatten(F.transform(items, lambda i: F.transform(F.split(i, r"\|"), lambda w: F.trim(w))))
    return F.array_distinct(F.filter(parts, lambda w: w != ""))


def media_url(photo_id: Column | str, kind: str, file_hash: Column | str | None = None, size: int = 256) -> Column:
    """The address of a photo's thumbnail, display or original; the head of its content's hash is part of it, so that
    answers can be kept for ever."""
    base = F.concat(F.lit("/api/photos/"), F.col(photo_id) if isinstance(photo_id, str) else photo_id, F.lit(f"/{kind}"), F.lit(f"?size={size}" if kind == "thumb" else ""))
    if file_hash is None or kind == "original":
        return base
    version = F.substring(file_hash, 1, 12)
    return F.concat(base, F.when(F.coalesce(F.length(version), F.lit(0)) > 0, F.concat(F.lit("&v=" if kind == "thumb" else "?v="), version)).otherwise(""))
