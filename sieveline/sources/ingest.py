"""Reading and checking files.

Bad files do not stop the good ones: every file gets a reason, the input is then split into
accepted and rejected files by that column.
"""

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from sieveline.functions.text import strip, stored_line_count
from sieveline.schema import EXTENSIONS, LANGUAGES


def extension(filename: Column) -> Column:
    """Lower-case extension with its dot; leading dots of a name start no extension."""
    base = F.regexp_replace(F.regexp_extract(filename, r"([^/]*)$", 1), r"^\.+", "")
    return F.lower(F.regexp_extract(base, r"(\.[^.]*)$", 1))


def detect_language(filename: Column, declared: Column = None, default: str = "python") -> Column:
    """A declared language wins, then the extension, then the default."""
    ext = extension(filename)
    out = F.lit(default)
    for known, language in EXTENSIONS.items():
        out = F.when(ext == known, language).otherwise(out)
    return out if declared is None else F.coalesce(F.nullif(declared, F.lit("")), out)


def reject_reason(filename: Column, content: Column, declared: Column = None,
                  limit: int = None) -> Column:
    """Why a file is refused; NULL when it is accepted.  ``limit`` is the most bytes of a file."""
    bad_language = F.lit(False) if declared is None else \
        (F.coalesce(declared, F.lit("")) != "") & ~declared.isin(*LANGUAGES)
    return (F.when(F.octet_length(content) == 0, "empty")
            .when(F.lit(False) if limit is None else F.octet_length(content) > limit, "too_large")
            .when(~extension(filename).isin(*EXTENSIONS), "bad_extension")
            .when(bad_language, "bad_language")
            .when(~F.is_valid_utf8(content.cast("string")), "not_utf8"))


def checked(raw: DataFrame, limit: int = None) -> DataFrame:
    """Raw files (``file_id, project_id, filename, content`` and optionally
    ``declared_language``) with their ``reason``."""
    declared = F.col("declared_language") if "declared_language" in raw.columns else None
    return raw.withColumn("reason", reject_reason(F.col("filename"), F.col("content"), declared, limit))


def rejected(raw: DataFrame, limit: int = None) -> DataFrame:
    return checked(raw, limit).filter(F.col("reason").isNotNull()) \
        .select("file_id", "filename", "reason")


def accepted(raw: DataFrame, limit: int = None) -> DataFrame:
    """The file table: decoded text, language, size and stored line count."""
    declared = F.col("declared_language") if "declared_language" in raw.columns else None
    text = F.col("content").cast("string")
    return checked(raw, limit).filter(F.col("reason").isNull()).select(
        "file_id", "project_id", "filename",
        detect_language(F.col("filename"), declared).alias("language"), text.alias("source"),
        F.octet_length("content").alias("size_bytes"), stored_line_count(text).alias("line_count"),
        F.lit("pending").alias("status"))


def totals(raw: DataFrame, limit: int = None) -> DataFrame:
    return checked(raw, limit).agg(
        F.count_if(F.col("reason").isNull()).alias("total_created"),
        F.count_if(F.col("reason").isNotNull()).alias("total_errors"))


def _listed(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)


def read_files(spark: SparkSession, path: str, project_id: str = None, limit: int = None) -> DataFrame:
    """Files below a folder as raw files.

    With a limit the size test is pushed into the source: the bytes of larger files are never
    read; ``oversized_files`` lists those.  The key is a hash of the path; the project is the
    first folder below ``path`` unless one is given.
    """
    listed = _listed(spark, path)
    below = F.substring_index("path", path.rstrip("/") + "/", -1)
    project = F.lit(project_id) if project_id else F.regexp_extract(below, r"^([^/]+)/", 1)
    return (listed if limit is None else listed.filter(F.col("length") <= limit)).select(
        F.xxhash64("path").alias("file_id"), project.alias("project_id"),
        below.alias("filename"), "content")


def read_and_reject(spark: SparkSession, path: str, project_id: str = None, limit: int = None) -> tuple:
    """Both parts of a folder: accepted files, and refused ones with their reason, too large ones included."""
    raw = read_files(spark, path, project_id, limit)
    refused = rejected(raw, limit)
    return accepted(raw, limit), refused if limit is None else refused.unionByName(oversized_files(spark, path, limit))


def oversized_files(spark: SparkSession, path: str, limit: int) -> DataFrame:
    """Files below a folder that are over the limit, from the listing alone."""
    below = F.substring_index("path", path.rstrip("/") + "/", -1)
    return _listed(spark, path).filter(F.col("length") > limit).select(
        F.xxhash64("path").alias("file_id"), below.alias("filename"), F.lit("too_large").alias("reason"))


def project_reason(name: Column) -> Column:
    """Why a project name is refused: it must have 2 to 255 characters after trimming."""
    text = strip(F.coalesce(name, F.lit("")))
    return (F.when(text == "", "blank").when(F.length(text) < 2, "too_short")
            .when(F.length(text) > 255, "too_long"))
