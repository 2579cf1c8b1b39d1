"""From facts to contracts: matches by alias, prefix, scope and kind, and the requirements that follow from them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waypath.functions.ids import leaf_name, slug
from waypath.operators.joins import latest


def alias_join(rows: DataFrame, concepts: DataFrame, name: str, aliases: str, ordinal: str, columns: Sequence[str]) -> DataFrame:
    """rows with `columns` of the first concept (smallest ordinal) one of whose aliases has the slug of the row's name.

    Aliases become one row a slug before the join, so a name that many concepts share does not multiply rows.
    """
    named = concepts.select(F.explode(aliases).alias("__alias"), ordinal, *columns).withColumn("__key", slug(F.col("__alias")))
    first = named.groupBy("__key").agg(F.min_by(F.struct(*columns), ordinal).alias("__hit"))
    both = rows.withColumn("__key", slug(F.col(name))).join(first, "__key", "left")
    return both.select(*rows.columns, *[F.col(f"__hit.{c}").alias(c) for c in columns])


def prefixes(path: Column) -> Column:
    """The patterns that can match a path: itself, and each of its ancestors (itself included) followed by '/**'."""
    parts = F.split(path, "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.concat(F.array_join(F.slice(parts, F.lit(1), i), "/"), F.lit("/**")))
    return F.array_distinct(F.array_append(above, path))


def prefix_rules(paths: DataFrame, rules: DataFrame, path: str, pattern: str, ordinal: str, columns: Sequence[str]) -> DataFrame:
    """Paths with `columns` of the first rule in source order that covers them; '/a/**' covers /a and all below.

    Each path is spread over its own ancestors, which makes the prefix match an equality join of any size.
    """
    spread = paths.select(path).distinct().select(path, F.explode(prefixes(F.col(path))).alias("__pattern"))
    hits = spread.join(rules.select(F.col(pattern).alias("__pattern"), ordinal, *columns), "__pattern")
    first = hits.groupBy(path).agg(F.min_by(F.struct(*columns), ordinal).alias("__rule"))
    return paths.join(first, path, "left").select(*paths.columns, *[F.col(f"__rule.{c}").alias(c) for c in columns])


def scope_or_refs(gaps: DataFrame, found: DataFrame) -> DataFrame:
    """(gap, diagnostic) pairs of equal scope or with a reference in common, each once.

    gaps: gap, scope, refs. found: diagnostic, scope, refs. Two equality joins instead of one with OR.
    """
    by_scope = gaps.select("gap", "scope").join(found.select("diagnostic", "scope"), "scope").select("gap", "diagnostic")
    left, right = gaps.select("gap", F.explode("refs").alias("ref")), found.select("diagnostic", F.explode("refs").alias("ref"))
    return by_scope.unionByName(left.join(right, "ref").select("gap", "diagnostic")).distinct()


def permitted(targets: DataFrame, adapters: DataFrame, kind: str, control: str) -> DataFrame:
    """Targets with each adapter that lists their kind and, where it lists controls, their control."""
    a = adapters.select("adapter", F.explode("kinds").alias(kind), "controls")
    return targets.join(a, kind).where(F.col("controls").isNull() | F.array_contains("controls", F.col(control))).select(*targets.columns, "adapter")


def resolved_refs(edges: DataFrame, nodes: DataFrame, edge: str, refs: str, node: str, source: str) -> DataFrame:
    """Per edge: the distinct sources of the nodes it refers to, sorted, and the number of references without a node."""
    spread = edges.select(edge, F.explode_outer(refs).alias(node)).distinct()
    both = spread.join(nodes.select(node, source, F.lit(True).alias("__known")), node, "left")
    lost = F.count(F.when(F.col(node).isNotNull() & F.col("__known").isNull(), 1))
    return both.groupBy(edge).agg(F.array_sort(F.collect_set(source)).alias("sources"), lost.alias("unresolved"))


def leaf_matches(paths: DataFrame, fields: DataFrame, key: str, path: str, field: str, field_path: str) -> DataFrame:
    """paths with the field of equal path or else the only field of equal leaf name; match: exact, leaf, ambiguous or missing."""
    exact = fields.groupBy(F.col(field_path).alias("__path")).agg(F.min(field).alias("__exact"))
    leaf = fields.groupBy(F.lower(leaf_name(F.col(field_path))).alias("__leaf")).agg(F.count("*").alias("__n"), F.min(field).alias("__one"))
    both = paths.withColumn("__path", F.col(path)).withColumn("__leaf", F.lower(leaf_name(F.col(path)))).join(exact, "__path", "left").join(leaf, "__leaf", "left")
    match = F.when(F.col("__exact").isNotNull(), "exact").when(F.col("__n").isNull(), "missing").when(F.col("__n") == 1, "leaf").otherwise("ambiguous")
    return both.select(key, path, F.coalesce("__exact", F.when(F.col("__n") == 1, F.col("__one"))).alias(field), match.alias("match"))


def unique_constraints(constraints: DataFrame) -> DataFrame:
    """Constraints (id, path, kind, value, domain) that mean the same, by leaf name in any case, reduced to the smallest id."""
    means = (F.lower(leaf_name(F.col("path"))).alias("leaf"), "kind", "value", "domain")
    return constraints.groupBy(*means).agg(F.min("id").alias("id"), F.count("*").alias("merged"))


def merge_choices(members: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Members of a choice (keys, option, status, visible) as one field: sorted options, status, visible if any member is.

    Members of different status make the field conditional.
    """
    g = members.groupBy(*keys).agg(
        F.array_sort(F.collect_set("option")).alias("options"), F.count("*").alias("members"), F.min("status").alias("low"), F.max("status").alias("high"), F.bool_or("visible").alias("visible")
    )
    return g.select(*keys, "options", "members", F.when(F.col("low") == F.col("high"), F.col("low")).otherwise("conditional").alias("status"), "visible")


def actor_requirements(operations: DataFrame, authorities: DataFrame) -> DataFrame:
    """operations (operation, conditional, inclusion) with the actor each needs, from authorities (operation, authority).

    Excluded operations need none. A condition on access that is not understood makes the actor opaque and an included
    operation one to review; else the actor is anonymous or named by the sorted authorities.
    """
    listed = authorities.groupBy("operation").agg(F.array_join(F.array_sort(F.collect_set("authority")), ",").alias("authorities"))
    both = operations.where("inclusion <> 'excluded'").join(listed, "operation", "left")
    actor = F.when(F.col("conditional"), "opaque").when(F.col("authorities").isNull(), "anonymous").otherwise(F.concat(F.lit("actor."), F.substring(F.sha2("authorities", 256), 1, 12)))
    return both.select(
        "operation", actor.alias("actor"), F.when(F.col("conditional"), F.lit(None)).otherwise(F.col("authorities")).alias("authorities"),
        F.when(F.col("conditional"), "review-required").otherwise(F.col("inclusion")).alias("inclusion"),
    )


def data_requirements(fields: DataFrame, actors: DataFrame, attributes: DataFrame) -> DataFrame:
    """What data a variant needs: its fields, one identity for each actor and one value for each attribute of an actor.

    All are (variant, target, generated); a target named twice is needed once, and is generated only if all say so.
    """
    kinds = (("field", fields), ("identity", actors), ("attribute", attributes))
    all_of = None
    for kind, df in kinds:
        one = df.select("variant", F.lit(kind).alias("kind"), "target", "generated")
        all_of = one if all_of is None else all_of.unionByName(one)
    status = F.when(F.bool_and("generated"), "generated").otherwise("unresolved")
    return all_of.groupBy("variant", "kind", "target").agg(status.alias("status"))


def runtime_bindings(steps: DataFrame, bindings: DataFrame, keys: Sequence[str], order: str, column: str) -> DataFrame:
    """Steps with the newest binding of their composite key, null parts of a key being equal to one another."""
    newest = latest(bindings.select(*keys, order, column), keys, [order]).select(*[F.col(k).alias(f"__{k}") for k in keys], F.col(column), F.lit(True).alias("__bound"))
    same = [steps[k].eqNullSafe(F.col(f"__{k}")) for k in keys]
    both = steps.join(newest, same, "left")
    return both.select(*steps.columns, column, F.coalesce("__bound", F.lit(False)).alias("bound"))


def readiness(data_open: Column, runtime_open: Column) -> Column:
    """blocked-data before blocked-runtime before ready."""
    return F.when(data_open > 0, "blocked-data").when(runtime_open > 0, "blocked-runtime").otherwise("ready")
