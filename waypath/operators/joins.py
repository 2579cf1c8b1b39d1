"""Joins that look at how many rows match, and the set and merge operators beside them.

Cardinality is counted per key by aggregation before the join, so a key with very many rows on one side becomes one row
there and is never windowed over.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def unique_join(left: DataFrame, right: DataFrame, on: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """left with `columns` of the only right row of its key; match: unique, missing or ambiguous (columns then null)."""
    one = right.groupBy(*on).agg(F.count("*").alias("__n"), *[F.min(c).alias(c) for c in columns])
    both = left.join(one, list(on), "left")
    match = F.when(F.col("__n").isNull(), "missing").when(F.col("__n") > 1, "ambiguous").otherwise("unique")
    taken = [F.when(F.col("__n") == 1, F.col(c)).alias(c) for c in columns]
    return both.select(*left.columns, *taken, match.alias("match"))


def fallback_join(left: DataFrame, rights: Sequence[tuple[DataFrame, Sequence[str]]], column: str) -> DataFrame:
    """Tries the rights in order; the first key with any match decides, and only a single match is taken.

    Each right is (rows, key columns). level: number of the right that matched, from 1, or 0.
    """
    out, found, level = left, F.lit(None), F.lit(0)
    for k, (right, on) in enumerate(rights, 1):
        one = right.groupBy(*on).agg(F.count("*").alias(f"__n{k}"), F.min(column).alias(f"__v{k}"))
        out = out.join(one, list(on), "left")
    for k in range(len(rights), 0, -1):
        n = F.col(f"__n{k}")
        found = F.when(n.isNotNull(), F.when(n == 1, F.col(f"__v{k}"))).otherwise(found)
        level = F.when(n.isNotNull(), k).otherwise(level)
    return out.select(*left.columns, found.alias(column), level.alias("level"))


def first_match(left: DataFrame, rules: DataFrame, condition: Column, left_id: str, order: str, columns: Sequence[str]) -> DataFrame:
    """left with `columns` of the first rule, in source order, that its row meets; null where none does.

    Rules are a short ordered list; the optimiser broadcasts them if its size estimate allows.
    """
    hit = left.join(rules, condition).groupBy(left_id).agg(F.min_by(F.struct(*columns), order).alias("__rule"))
    return left.join(hit, left_id, "left").select(*left.columns, *[F.col(f"__rule.{c}").alias(c) for c in columns])


def template_join(routes: DataFrame, templates: DataFrame, route: str, template: str, ordinal: str) -> DataFrame:
    """Routes to the first template that equals theirs or, failing that, whose parameters stand for theirs.

    A route's segments are looked up under every mask of parameters that a template of as many segments has: an equality
    join, however many templates there are. The few templates whose parameters are parts of segments match by pattern.
    """
    from waypath.functions.ids import normal_template, template_pattern

    t = templates.select(normal_template(F.col(template)).alias("__template"), F.col(ordinal)).groupBy("__template").agg(F.min(ordinal).alias(ordinal))
    parts = F.split("__template", "/")
    t = t.withColumn("__depth", F.size(parts)).withColumn("__whole", F.forall(parts, lambda s: (s == "{param}") | ~s.contains("{param}")))
    # the places of parameters, as a comma-joined list; routes are masked by the lists that templates have
    places = F.array_join(F.filter(F.transform(parts, lambda s, i: F.when(s == "{param}", i)), lambda i: i.isNotNull()), ",")
    whole = t.where("__whole").withColumn("__mask", places)
    masks = whole.select("__depth", "__mask").distinct()
    r = routes.withColumn("__route", normal_template(F.col(route)))
    distinct = r.select("__route").distinct().withColumn("__depth", F.size(F.split("__route", "/")))
    masked = distinct.join(masks, "__depth").withColumn("__at", F.split("__mask", ","))
    hidden = F.transform(F.split("__route", "/"), lambda s, i: F.when(F.array_contains("__at", i.cast("string")) & (s != ""), "{param}").otherwise(s))
    looked = masked.select("__route", F.array_join(hidden, "/").alias("__template"), "__mask")
    by_mask = looked.join(whole.select("__template", "__mask", ordinal), ["__template", "__mask"]).select("__route", "__template", ordinal)
    odd = t.where("NOT __whole").select("__template", "__depth", ordinal)
    by_pattern = distinct.join(odd, "__depth").where(F.rlike(F.col("__route"), template_pattern(F.col("__template")))).select("__route", "__template", ordinal)
    hit = by_mask.unionByName(by_pattern)
    best = hit.groupBy("__route").agg(F.min_by("__template", F.struct((F.col("__route") != F.col("__template")).cast("int"), F.col(ordinal))).alias("matched"))
    return r.join(best, "__route", "left").select(*routes.columns, "matched")


def latest(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row of each key: last write wins. Aggregates before it shuffles."""
    rest = [c for c in rows.columns if c not in keys]
    g = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__row"))
    return g.select(*keys, *[F.col(f"__row.{c}").alias(c) for c in rest])


def merged(base: DataFrame, changes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """base with changes by key, new rows winning."""
    both = base.withColumn("__turn", F.lit(0)).unionByName(changes.withColumn("__turn", F.lit(1)))
    return latest(both, keys, ["__turn"]).drop("__turn")


def positional(left: DataFrame, right: DataFrame, keys: Sequence[str], pos: str, value: str) -> DataFrame:
    """Rows of equal key and position side by side; status: equal, different, missing (right) or unexpected (left)."""
    a = left.select(*keys, pos, F.col(value).alias("expected"), F.lit(1).alias("__a"))
    b = right.select(*keys, pos, F.col(value).alias("observed"), F.lit(1).alias("__b"))
    both = a.join(b, [*keys, pos], "full")
    status = (
        F.when(F.col("__b").isNull(), "missing").when(F.col("__a").isNull(), "unexpected").when(F.col("expected").eqNullSafe(F.col("observed")), "equal").otherwise("different")
    )
    return both.select(*keys, pos, "expected", "observed", status.alias("status"))


def collisions(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that more than one row has, with their number."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def top_of_each(rows: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """The first n rows of each key, numbered; the limit reaches the scan side before the shuffle."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= n)


def within(values: Column, allowed: Column) -> Column:
    return F.size(F.array_except(values, allowed)) == 0


def same_set(a: Column, b: Column) -> Column:
    """Equal as sets, and neither holds a value twice."""
    return (F.sort_array(a) == F.sort_array(b)) & (F.size(F.array_distinct(a)) == F.size(a))


def stale(inputs: DataFrame, current: DataFrame, name: str, digest: str) -> DataFrame:
    """Recorded inputs whose digest is not the current one of that name."""
    return inputs.join(current.select(name, digest), [name, digest], "left_anti")
