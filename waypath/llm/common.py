"""Shared plumbing of the text operators: row-wise Arrow maps, shards of documents, checkpoints."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: UTF-8 bytes of text that one shard of documents holds on average.
SHARD_BYTES = 12_000_000
#: Rows of one Arrow batch between the JVM and Python.
BATCH_ROWS = 2_000


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches of whole texts are held twice, by the JVM and by Python; fewer rows bound both."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def give_back() -> None:
    """Returns what a task no longer uses to the system, so that an idle worker does not hold its peak."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def kept_columns(df: DataFrame, keep: Sequence[str] | None, fields: Sequence[T.StructField]) -> list[str]:
    """The columns of df to return: `keep` or all, without those that a result column replaces (same name, any case)."""
    new = {f.name.lower() for f in fields}
    return [c for c in (df.columns if keep is None else keep) if c.lower() not in new]


#: Stands for a missing id where ids are ordered; results have null again. So a null is the largest id.
NO_ID = (1 << 63) - 1


def ordered_id(c: Column) -> Column:
    return F.coalesce(c.cast("long"), F.lit(NO_ID))


def given_id(c: Column) -> Column:
    """An ordered id as it is returned."""
    return F.when(c != NO_ID, c)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df does not have, in any case."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name


def grouped(batches: Iterator[pa.RecordBatch], block_bytes: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of block_bytes or more."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        held.append(b)
        if sum(x.nbytes for x in held) >= block_bytes:
            yield pa.concat_batches(held)
            held = []
    if held:
        yield pa.concat_batches(held)


def map_texts(
    df: DataFrame,
    text_col: str,
    fields: Sequence[T.StructField],
    make: Callable[[], Callable[[list], list[list]]],
    keep: Sequence[str] | None = None,
    block_bytes: int = 0,
) -> DataFrame:
    """Adds columns computed from one text column, row by row, in Arrow batches and without a shuffle.

    make() runs once per task and returns a function from a batch's texts (str or None) to one list per field; batches
    hold block_bytes or more, if the task has them. A result column replaces an input column of the same name.
    """
    names = kept_columns(df, keep, fields)
    schema = T.StructType([df.schema[c] for c in names] + list(fields))
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for b in grouped(batches, block_bytes) if block_bytes else batches:
            out = f(b.column(b.num_columns - 1).to_pylist())
            held = [b.column(i).cast(arrow.field(i).type) for i in range(len(names))]
            made = [pa.array(v, type=arrow.field(len(names) + i).type) for i, v in enumerate(out)]
            yield pa.RecordBatch.from_arrays(held + made, schema=arrow)
        give_back()

    bounded_batches(df.sparkSession)
    return df.select(*[F.col(f"`{c}`") for c in names], F.col(f"`{text_col}`").cast("string").alias("__text")).mapInArrow(run, schema)


def checkpoint(df: DataFrame) -> DataFrame:
    """Cuts lineage through the folder in spark.checkpoint.dir that all executors share; a single machine may do without one."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not re.fullmatch(r"local(\[.*\])?", sc.master):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            folder = tempfile.mkdtemp(prefix="waypath-ckpt-")
        sc.setCheckpointDir(folder)
    done = df.checkpoint(eager=True)
    # shuffle files of earlier rounds go when the driver collects garbage, which it hardly does by itself in a short loop
    gc.collect()
    sc._jvm.System.gc()
    return done


def text_bytes(df: DataFrame, text_col: str) -> int:
    return int(df.agg(F.sum(F.octet_length(F.col(f"`{text_col}`").cast("string")))).first()[0] or 0)


def shard_documents(docs: DataFrame, id_col: str, text_col: str, shard_bytes: int = SHARD_BYTES) -> tuple[DataFrame, int]:
    """(shard, doc_id, text), and the number of partitions: documents dealt by a hash of their id, so that a recomputed task sees the same shard.

    A null id counts as the largest long, a null text as empty. The number of shards follows the bytes of text, so a
    shard stays at a few times SHARD_BYTES however large the table is (or at one document, where that is longer).
    """
    n = max(2, -(-text_bytes(docs, text_col) // shard_bytes))
    doc_id = ordered_id(F.col(f"`{id_col}`"))
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    # more shards than partitions, so that hashing shards to partitions stays even
    dealt = docs.select(F.pmod(F.xxhash64(doc_id), F.lit(4 * n)).cast("int").alias("shard"), doc_id.alias("doc_id"), text.alias("text"))
    return dealt.repartition(n, "shard"), n


#: Rows of one long that may be sent to all executors; more are joined by a shuffle.
BROADCAST_IDS = 2_000_000


def filter_by_ids(df: DataFrame, key: Column, ids: DataFrame, how: str) -> DataFrame:
    """df left_semi or left_anti joined to a table of distinct longs, which is broadcast if its counted size allows."""
    own = fresh(df, "__id")
    kept = checkpoint(ids.toDF(own))
    small = kept.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return df.join(F.broadcast(kept) if small else kept, key == F.col(own), how)
