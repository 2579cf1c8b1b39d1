"""Source snapshots: files with their language and digest, and one digest of the whole input."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from waypath.functions.ids import digest

LANGUAGES = {"ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "java": "java", "md": "markdown", "json": "json", "yaml": "yaml", "yml": "yaml"}


def language(path: Column) -> Column:
    pairs = [F.lit(x) for kv in LANGUAGES.items() for x in kv]
    return F.coalesce(F.create_map(*pairs)[F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))], F.lit("text"))


def snapshot(spark: SparkSession, roots: Sequence[str], include: str = "*", exclude: Sequence[str] = ()) -> DataFrame:
    """(path, language, content, digest) of the files below the roots; exclude: regular expressions on paths."""
    d = spark.read.text(list(roots), wholetext=True, recursiveFileLookup=True, pathGlobFilter=include)
    d = d.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))
    for pattern in exclude:
        d = d.where(~F.rlike("path", F.lit(pattern)))
    return d.select("path", language(F.col("path")).alias("language"), "content", digest(F.col("content")).alias("digest"))


def with_expected(files: DataFrame, expected: DataFrame) -> DataFrame:
    """expected (path): inputs that have to be there; those that are not count with the content '<missing>'."""
    gone = expected.select("path").join(files, "path", "left_anti")
    return files.select("path", "digest").unionByName(gone.select("path", digest(F.lit("<missing>")).alias("digest")))


def total_digest(files: DataFrame) -> DataFrame:
    """One row: the digest of all paths and digests in order. Two levels, so no task holds every file's digest."""
    part = F.pmod(F.xxhash64("path"), F.lit(256))
    line = F.concat_ws("\t", "path", "digest")
    parts = files.groupBy(part.alias("part")).agg(F.sha2(F.array_join(F.sort_array(F.collect_list(line)), "\n"), 256).alias("h"), F.count("*").alias("n"))
    listed = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("part", "h"))), lambda r: r["h"]), "\n")
    return parts.agg(digest(listed).alias("digest"), F.sum("n").alias("files"))
