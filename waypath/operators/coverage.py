"""Evidence, coverage waterfalls, readiness and inclusion."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def facts(*kinds: tuple[str, DataFrame, Column, Column]) -> DataFrame:
    """Evidence nodes (kind, id, label) of several fact tables."""
    out = None
    for kind, df, key, label in kinds:
        one = df.select(F.lit(kind).alias("kind"), F.concat_ws(":", F.lit(kind), key.cast("string")).alias("id"), label.cast("string").alias("label"))
        out = one if out is None else out.unionByName(one)
    return out


def count_by(rows: DataFrame, *columns: str) -> DataFrame:
    return rows.groupBy(*columns).agg(F.count("*").alias("n"))


def waterfall(rows: DataFrame, stages: Sequence[tuple[str, Column]]) -> DataFrame:
    """missing_stage: the first stage whose condition fails (null counts as failing), null if all hold; status."""
    missing = F.lit(None).cast("string")
    for name, ok in reversed(stages):
        missing = F.when(~F.coalesce(ok, F.lit(False)), name).otherwise(missing)
    return rows.withColumn("missing_stage", missing).withColumn("status", F.when(F.col("missing_stage").isNull(), "covered").otherwise("partial"))


def first_failing(gates: Sequence[tuple[str, Column]], done: str) -> Column:
    out = F.lit(done)
    for name, ok in reversed(gates):
        out = F.when(~F.coalesce(ok, F.lit(False)), name).otherwise(out)
    return out


def counts(**tables: DataFrame) -> DataFrame:
    """(name, n) of each table, in one pass over each."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def inclusion(terminal: Column, conditional: Column, ambiguous: Column) -> Column:
    return F.when(~terminal, "excluded").when(conditional | ambiguous, "review-required").otherwise("included")


def binding_status(requires: Column, bound: Column, verified: Column) -> Column:
    return F.when(~requires, "generated").when(bound.isNull(), "missing").when(verified, "verified").otherwise("unverified")


def run_status(recorded: Column, expires: Column, now: Column, current: Column) -> Column:
    return F.when(recorded, "recorded").when(~current, "stale").when(expires <= now, "expired").otherwise("pending")


def digest_tree(rows: DataFrame, keys: Sequence[str], levels: int = 4, bits: int = 8) -> DataFrame:
    """(keys, digest, n) of rows (keys, pos, h) in the order of pos, as a tree of digests.

    Each level lists at most 2**bits positions of one key, so that a key with a third of all rows is never gathered in one
    task; the last list is short for positions below 2**(bits * (levels + 1)). Rows of equal pos are ordered by h.
    """
    listed = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "h"))), lambda r: F.concat_ws(":", r["pos"].cast("string"), r["h"])), ",")
    x = rows.select(*keys, "pos", "h", F.lit(1).cast("long").alias("n"))
    for _ in range(levels):
        x = x.groupBy(*keys, F.shiftright("pos", bits).alias("up")).agg(F.sha2(listed, 256).alias("h"), F.sum("n").alias("n")).withColumnRenamed("up", "pos")
    return x.groupBy(*keys).agg(F.concat(F.lit("sha256:"), F.sha2(listed, 256)).alias("digest"), F.sum("n").alias("n"))
