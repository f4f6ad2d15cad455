"""Files: which are documents, what their content says, where their output goes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Extensions by kind, and the bytes by which content is known.
OFFICE = "doc docx docm dot dotm dotx odt ott rtf pages".split()
PRESENTATION = "ppt pptx pptm pot potm potx odp otp key".split()
SPREADSHEET = "xls xlsx xlsm xlsb ods ots csv tsv numbers".split()
IMAGE = "jpg jpeg png gif bmp tiff tif webp svg".split()
TEXT_ONLY = "txt md markdown log".split()
MAGIC = [
    ("255044462D", 0, "pdf"), ("89504E470D0A1A0A", 0, "png"), ("FFD8FF", 0, "jpg"), ("474946383761", 0, "gif"), ("474946383961", 0, "gif"),
    ("424D", 0, "bmp"), ("49492A00", 0, "tiff"), ("4D4D002A", 0, "tiff"), ("57454250", 8, "webp"), ("D0CF11E0A1B11AE1", 0, "cfb"),
    ("7B5C727466", 0, "rtf"), ("504B0304", 0, "zip"),
]


def collect_files(spark: SparkSession, folder: str, recursive: bool = True, pattern: str | None = None) -> DataFrame:
    """(path, length, modificationTime, content) of the files of a folder; content is read only
    where it is asked for."""
    read = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    return (read.option("pathGlobFilter", pattern) if pattern else read).load(folder)


def extension(path: Column) -> Column:
    """What follows the last dot of the file's name, lower case; '' of names without one, and of
    names that only begin with one."""
    name = F.regexp_extract(path, "([^/]*)$", 1)
    return F.lower(F.regexp_extract(name, r"^.+\.([^.]*)$", 1))


def is_supported(path: Column) -> Column:
    return extension(path).isin(["pdf", *OFFICE, *PRESENTATION, *SPREADSHEET, *IMAGE])


def is_text_only(ext: Column) -> Column:
    return F.lower(ext).isin(TEXT_ONLY)


def guessed_extension(content: Column) -> Column:
    """The kind of a content by its first bytes, or null. Containers are named as such."""
    head = F.hex(F.substring(content, 1, 16))
    out = None
    for magic, at, kind in MAGIC:
        test = F.substring(head, 2 * at + 1, len(magic)) == magic
        out = F.when(test, kind) if out is None else out.when(test, kind)
    return out


def output_path(path: Column, source: str, target: str, ext: str) -> Column:
    """The path under ``target`` that ``path`` has under ``source``, with another extension."""
    inner = F.when(path.startswith(source.rstrip("/") + "/"), F.substr(path, F.lit(len(source.rstrip("/")) + 2))).otherwise(path)
    stem = F.regexp_replace(inner, r"(?<=[^/])\.[^./]*$", "")
    return F.when(inner.startswith("/"), F.concat(stem, F.lit(f".{ext}"))).otherwise(F.concat(F.lit(f"{target.rstrip('/')}/"), stem, F.lit(f".{ext}")))


def png_dpi(content: Column) -> Column:
    """(x, y) in dots an inch of a PNG's pHYs chunk in metres, found in its first 4 KB, or null."""
    head = F.hex(F.substring(content, 1, 4096))
    at = F.locate("70485973", head)
    number = lambda k: F.conv(F.substr(head, at + 8 + 8 * k, F.lit(8)), 16, 10).cast("double")
    metres = F.substr(head, at + 24, F.lit(2)) == "01"
    dpi = lambda k: F.round(number(k) * 0.0254, 2)
    return F.when(head.startswith("89504E470D0A1A0A") & (at > 0) & metres & (number(0) > 0) & (number(1) > 0), F.struct(dpi(0).alias("x"), dpi(1).alias("y")))
