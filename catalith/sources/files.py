"""Directories of images as file snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T

#: File name extensions of images.
FORMATS = ["jpg", "jpeg", "png", "webp"]


def scan(spark: SparkSession, root: str, nested: list[str] | None = None, recursive: bool = True) -> DataFrame:
    """Snapshots of the image files below `root`: absolute_path, relative_path, file_name, extension, file_size, modified_at (ms), fingerprint.

    nested: roots below `root` that are registered on their own and left out. Other formats are left out by extension,
    without regard to case; empty files are not listed. The fingerprint is the SHA-256 of the content, computed where the file is read.
    """
    root = root.rstrip("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(root if recursive else root + "/*")
    path = F.regexp_replace("path", r"^file:/*", "/")
    x = files.withColumn("absolute_path", path).withColumn("relative_path", F.expr(f"substring(absolute_path, {len(root) + 2})"))
    x = x.withColumns({"file_name": F.regexp_extract("relative_path", r"([^/]*)$", 1), "extension": F.lower(F.regexp_extract("relative_path", r"\.([^./]+)$", 1))}).where(F.col("extension").isin(FORMATS))
    for n in nested or []:
        x = x.where(~T.inside(F.col("absolute_path"), F.lit(n.rstrip("/"))))
    return x.select("absolute_path", "relative_path", "file_name", "extension", F.col("length").alias("file_size"), F.unix_millis("modificationTime").alias("modified_at"), F.sha2("content", 256).alias("fingerprint"))


def write_manifest(plan: DataFrame, folder: str, source_roots: list[str], kind: str = "json") -> None:
    """Create-only manifest; a folder inside a source is refused."""
    if any(folder == r or folder.startswith(r.rstrip("/") + "/") for r in source_roots):
        raise ValueError("a manifest must not lie inside a source")
    writer = plan.write.mode("errorifexists")
    writer.json(folder) if kind == "json" else writer.option("header", True).csv(folder)


def data_url(content, mime: str = "image/jpeg", most: int = 20 << 20):
    """Content as a data URL on one line, null above `most` bytes."""
    return F.when(F.octet_length(content) <= most, F.concat(F.lit(f"data:{mime};base64,"), F.regexp_replace(F.base64(content), r"\s", "")))
