"""Operators over ordered steps of a path, session or conversation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ordered(key: Sequence[str], order: Sequence[str]):
    return Window.partitionBy(*key).orderBy(*order)


def action_steps(steps: DataFrame, key: Sequence[str], pos: str, kind: str, value: str) -> DataFrame:
    """For each action: the screen shown, and the operations up to the next screen or action."""
    w = ordered(key, [pos])
    screen = F.last(F.when(F.col(kind) == "screen", F.col(value)), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    block = F.sum(F.when(F.col(kind).isin("screen", "action"), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    ops = F.count(F.when(F.col(kind) == "operation", 1)).over(Window.partitionBy(*key, "block"))
    marked = steps.withColumn("screen", screen).withColumn("block", block).withColumn("operations", ops)
    return marked.where(F.col(kind) == "action").select(*key, pos, value, "screen", "operations")


def transitions(steps: DataFrame, key: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """Each step with the next one's value (null at the end)."""
    return steps.withColumn("next", F.lead(value).over(ordered(key, order)))


def previous(steps: DataFrame, key: Sequence[str], order: Sequence[str], value: str, counts: Column) -> DataFrame:
    """Each step with the value of the one right before it, where that one counts (an awaited call, say), else null."""
    w = ordered(key, order)
    return steps.withColumn("previous", F.when(F.lag(counts).over(w), F.lag(value).over(w)))


def same_sequence(left: DataFrame, right: DataFrame, key: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """Per key, whether both have the same values in the same order; keys of one side only have not."""
    listed = lambda df, name: df.groupBy(*key).agg(F.transform(F.sort_array(F.collect_list(F.struct(*order, F.col(value).alias("v")))), lambda x: x["v"]).alias(name))
    both = listed(left, "a").join(listed(right, "b"), list(key), "full")
    return both.select(*key, F.coalesce(F.col("a") == F.col("b"), F.lit(False)).alias("same"))


def revisits(steps: DataFrame, key: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """Steps whose value was seen before on the same key, with the number of earlier ones."""
    n = F.row_number().over(Window.partitionBy(*key, value).orderBy(*order)) - 1
    return steps.withColumn("earlier", n).where("earlier > 0")


def phases(steps: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Steps as entry, success (the last) or intermediate; a single step is an entry."""
    w = ordered(key, order)
    return steps.withColumn("phase", F.when(F.row_number().over(w) == 1, "entry").when(F.lead(F.lit(1)).over(w).isNull(), "success").otherwise("intermediate"))


def after_terminator(steps: DataFrame, key: Sequence[str], order: Sequence[str], ends: Column) -> DataFrame:
    """Steps that an earlier terminator makes unreachable."""
    w = ordered(key, order).rowsBetween(Window.unboundedPreceding, -1)
    return steps.withColumn("cut", F.coalesce(F.max(ends.cast("int")).over(w) == 1, F.lit(False)))


def last_position(steps: DataFrame, key: Sequence[str], pos: str, condition: Column) -> DataFrame:
    return steps.withColumn("last", F.max(F.when(condition, F.col(pos))).over(Window.partitionBy(*key)))


def variants(steps: DataFrame, family: Sequence[str], witness: str, order: Sequence[str], value: str) -> DataFrame:
    """Witnesses of a family with equal steps are one variant: signature, members, representative, length."""
    listed = steps.groupBy(*family, witness).agg(F.sort_array(F.collect_list(F.struct(*order, F.col(value).alias("__v")))).alias("s"))
    path = F.array_join(F.transform("s", lambda x: x["__v"]), ">")
    signed = listed.select(*family, witness, F.sha2(path, 256).alias("signature"), F.size("s").cast("long").alias("steps"))
    return signed.groupBy(*family, "signature").agg(F.count("*").alias("members"), F.min(witness).alias("representative"), F.min("steps").alias("steps"))


def with_suffix(rows: DataFrame, base: str, signature: str) -> DataFrame:
    """ids from base names; a name that several rows share takes the start of its signature."""
    n = F.count("*").over(Window.partitionBy(base))
    return rows.withColumn("id", F.when(n > 1, F.concat_ws("-", base, F.substring(signature, 1, 8))).otherwise(F.col(base)))
