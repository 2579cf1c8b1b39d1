"""Tables written with a record of what they hold, checked when they are read, and a log of runs."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION = "1"
META = "artifact string, version string, producer string, inputs string, content_digest string, rows long, status string, envelope_digest string"


class IntegrityError(Exception):
    """What was read is not what was recorded."""


def content_digest(df: DataFrame) -> tuple[str, int]:
    """Order-free digest of the rows: two sums of row hashes beside their number, aggregated map side first."""
    row = F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(df.columns)]), {"ignoreNullFields": "false"})
    h = F.xxhash64(row).cast("decimal(38,0)")
    g = F.crc32(row.cast("binary")).cast("decimal(38,0)")
    r = df.agg(F.sum(h), F.sum(g * g), F.count("*")).first()
    return "sha256:" + hashlib.sha256(f"{r[0]}|{r[1]}|{r[2]}|{sorted(df.dtypes)}".encode()).hexdigest(), int(r[2])


def envelope_digest(meta: Mapping) -> str:
    kept = {k: v for k, v in meta.items() if k != "envelope_digest"}
    return "sha256:" + hashlib.sha256(json.dumps(kept, sort_keys=True, default=str).encode()).hexdigest()


def write(df: DataFrame, path: str, artifact: str, producer: str, inputs: Mapping[str, str] | None = None, status: str = "complete") -> dict:
    """The data first, its record last: a table without a record was not finished."""
    spark = df.sparkSession
    df.write.mode("overwrite").parquet(f"{path}/data")
    digest, rows = content_digest(spark.read.parquet(f"{path}/data"))
    meta = {"artifact": artifact, "version": VERSION, "producer": producer, "inputs": json.dumps(dict(inputs or {}), sort_keys=True), "content_digest": digest, "rows": rows, "status": status}
    meta["envelope_digest"] = envelope_digest(meta)
    spark.createDataFrame([tuple(meta[c.split()[0]] for c in META.split(", "))], META).coalesce(1).write.mode("overwrite").json(f"{path}/_meta_record")
    return meta


def read_meta(spark: SparkSession, path: str) -> dict:
    rows = spark.read.schema(META).json(f"{path}/_meta_record").collect()
    if len(rows) != 1:
        raise IntegrityError(f"{path}: {len(rows)} records")
    return rows[0].asDict()


def read(spark: SparkSession, path: str, artifact: str, producer: str | None = None) -> DataFrame:
    """Six gates: a record, its version, artifact and producer, its own digest present and right, the content's digest."""
    meta = read_meta(spark, path)
    if meta["artifact"] != artifact:
        raise IntegrityError(f"{path}: holds {meta['artifact']}, not {artifact}")
    if meta["version"] != VERSION:
        raise IntegrityError(f"{path}: version {meta['version']}")
    if producer is not None and meta["producer"] != producer:
        raise IntegrityError(f"{path}: made by {meta['producer']}")
    if not meta["envelope_digest"]:
        raise IntegrityError(f"{path}: no envelope digest")
    if meta["envelope_digest"] != envelope_digest(meta):
        raise IntegrityError(f"{path}: the record was changed")
    df = spark.read.parquet(f"{path}/data")
    if content_digest(df)[0] != meta["content_digest"]:
        raise IntegrityError(f"{path}: the data were changed")
    return df


def is_stale(spark: SparkSession, path: str, upstream: Mapping[str, str]) -> list[str]:
    """Inputs recorded with another digest than upstream has now, by name."""
    was = json.loads(read_meta(spark, path)["inputs"])
    return sorted(k for k, v in was.items() if upstream.get(k) != v)


def record_run(spark: SparkSession, path: str, run_id: str, created_at: str, digest: str, status: str) -> None:
    spark.createDataFrame([(run_id, created_at, digest, status)], "run_id string, created_at string, digest string, status string").write.mode("append").json(path)


def runs(spark: SparkSession, path: str, limit: int = 20) -> DataFrame:
    """The newest runs first."""
    return spark.read.schema("run_id string, created_at string, digest string, status string").json(path).orderBy(F.desc("created_at"), F.desc("run_id")).limit(limit)
