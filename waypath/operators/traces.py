"""Traces over flows: guarded and substituted walks, lineage, scoped constraints, page contracts, manifests, proposals.

Nulls never match; rows that find nothing stay with nulls where a left join is named, and go otherwise.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waypath.functions.ids import leaf_name
from waypath.operators.graph import _settled


def guarded_walks(seeds: DataFrame, edges: DataFrame, max_levels: int = 40) -> DataFrame:
    """(origin, node, guards, path): every walk without repeated nodes along edges (src, dst, guard), with the guards met.

    A null guard is none. One join a level serves all origins. Walks that go on after max_levels raise an error.
    """
    none = F.array().cast("array<string>")
    e = _settled(edges.select("src", "dst", "guard"))
    front = _settled(seeds.select("origin", "node", none.alias("guards"), F.array("node").alias("path")))
    out = front
    for _ in range(max_levels):
        step = front.join(e, F.col("node") == F.col("src")).where(~F.array_contains("path", F.col("dst")))
        guards = F.when(F.col("guard").isNull(), F.col("guards")).otherwise(F.array_append("guards", F.col("guard")))
        front = _settled(step.select("origin", F.col("dst").alias("node"), guards.alias("guards"), F.array_append("path", F.col("dst")).alias("path")))
        if front.isEmpty():
            return out
        out = out.unionByName(front)
    raise ValueError(f"walks of more than {max_levels} edges")


def substituted_walks(seeds: DataFrame, calls: DataFrame, max_levels: int = 40) -> DataFrame:
    """(origin, node, environment, path): calls (caller, callee, arguments map) followed from seeds (origin, node, environment).

    An argument '$x' takes the caller's value of x (null, where it has none); any other is a literal. No node twice on a path.
    """
    c = _settled(calls.select("caller", "callee", "arguments"))
    front = _settled(seeds.select("origin", "node", "environment", F.array("node").alias("path")))
    out = front
    for _ in range(max_levels):
        step = front.join(c, F.col("node") == F.col("caller")).where(~F.array_contains("path", F.col("callee")))
        env = F.transform_values("arguments", lambda _, v: F.when(v.startswith("$"), F.element_at("environment", v.substr(F.lit(2), F.length(v)))).otherwise(v))
        front = _settled(step.select("origin", F.col("callee").alias("node"), env.alias("environment"), F.array_append("path", F.col("callee")).alias("path")))
        if front.isEmpty():
            return out
        out = out.unionByName(front)
    raise ValueError(f"walks of more than {max_levels} calls")


def stale_lineage(inputs: DataFrame, current: DataFrame, max_levels: int = 64) -> DataFrame:
    """(artifact, hops): artifacts an input of which, or of its inputs, no longer has the digest that was recorded.

    inputs: artifact, input, expected. current: input, digest. hops: 0 where a direct input differs or is missing.
    """
    links = _settled(inputs.select("artifact", "input").distinct())
    differs = inputs.join(current, "input", "left").where(~F.col("expected").eqNullSafe(F.col("digest")))
    front = _settled(differs.select("artifact").distinct().withColumn("hops", F.lit(0)))
    seen = front
    for hop in range(1, max_levels + 1):
        reached = front.select(F.col("artifact").alias("input")).join(links, "input").select("artifact").distinct()
        front = _settled(reached.join(seen, "artifact", "left_anti").withColumn("hops", F.lit(hop)))
        if front.isEmpty():
            return seen
        seen = _settled(seen.unionByName(front))
    raise ValueError(f"lineage of more than {max_levels} levels")


def missing_before(needs: DataFrame, occurs: DataFrame) -> DataFrame:
    """(path, pos, missing): fields that a step needs and no step up to it holds. needs, occurs: path, pos, field."""
    first = occurs.groupBy("path", "field").agg(F.min("pos").alias("__first"))
    open_ = needs.join(first, ["path", "field"], "left").where(F.col("__first").isNull() | (F.col("__first") > F.col("pos")))
    return open_.groupBy("path", "pos").agg(F.sort_array(F.collect_set("field")).alias("missing"))


def entity_fields(paths: DataFrame, fields: DataFrame) -> DataFrame:
    """paths (path) with the one field whose leaf name, without an identifying ending, is the path's entity; else null.

    fields: field, data_path. A path without an attribute has no entity.
    """
    root = F.regexp_replace(F.split_part("path", F.lit("."), F.lit(1)), "(?i)^(selected|current|chosen|active)", "")
    entity = F.lower(F.regexp_replace(root, "(?i)(Entity|Model)$", ""))
    named = F.split_part("path", F.lit("."), F.lit(2)) != ""
    stem = F.lower(F.regexp_replace(leaf_name(F.col("data_path")), "(?i)(Id|Identifier|Key|Reference|Ref|Code|Number|No)$", ""))
    unique = fields.groupBy(stem.alias("__stem")).agg(F.count("*").alias("__n"), F.min("field").alias("field")).where("__n = 1").drop("__n")
    return paths.withColumn("__stem", F.when(named, F.nullif(entity, F.lit("")))).join(unique, "__stem", "left").drop("__stem")


def scoped_constraints(usage: DataFrame, by_contract: DataFrame, by_operation: DataFrame, own: DataFrame) -> DataFrame:
    """(witness, field, constraint), each once: a field's own, and those of the witness's contracts, or, where it has
    no contract, of its operations.

    usage: witness, contracts, operations (arrays). by_contract, by_operation: contract or operation, field,
    constraint. own: witness, field, constraint.
    """
    some = F.coalesce(F.size("contracts") > 0, F.lit(False))
    c = usage.where(some).select("witness", F.explode("contracts").alias("contract")).join(by_contract, "contract")
    o = usage.where(~some).select("witness", F.explode("operations").alias("operation")).join(by_operation, "operation")
    cols = ["witness", "field", "constraint"]
    return c.select(cols).unionByName(o.select(cols)).unionByName(own.select(cols)).distinct()


def traced_sources(asked: DataFrame, items: DataFrame, operations: DataFrame) -> DataFrame:
    """(id, ref, source, via): sources of a ref that is an item, else of the items that the operation of that name cites.

    asked: id, ref. items: ref, source. operations: ref, refs. A ref that is neither has via 'unresolved'.
    """
    known = items.select("ref").distinct().withColumn("__item", F.lit(True))
    marked = asked.select("id", "ref").distinct().join(known, "ref", "left")
    direct = marked.where("__item").join(items, "ref").select("id", "ref", "source", F.lit("item").alias("via"))
    cited = marked.where("__item IS NULL").join(operations.select("ref", "refs"), "ref", "left")
    known_op = cited.where("refs IS NOT NULL").select("id", "ref", F.explode("refs").alias("__cited"))
    through = known_op.join(items.select(F.col("ref").alias("__cited"), "source"), "__cited").select("id", "ref", "source", F.lit("operation").alias("via"))
    nothing = cited.where("refs IS NULL").select("id", "ref", F.lit(None).cast(items.schema["source"].dataType).alias("source"), F.lit("unresolved").alias("via"))
    return direct.unionByName(through).unionByName(nothing).distinct()


def page_contracts(pages: DataFrame, fields: DataFrame, actions: DataFrame) -> DataFrame:
    """pages (page, routes, completeness) with sorted fields and actions, empty where there are none; completeness 'exact' if null."""
    of = lambda rows, c: rows.groupBy("page").agg(F.sort_array(F.collect_set(c)).alias(f"{c}s"))
    out = pages.join(of(fields, "field"), "page", "left").join(of(actions, "action"), "page", "left")
    filled = [F.coalesce(F.col(c), F.array().cast("array<string>")).alias(c) for c in ("fields", "actions")]
    return out.select("page", F.array_sort("routes").alias("routes"), *filled, F.coalesce("completeness", F.lit("exact")).alias("completeness"))


def payload_signatures(steps: DataFrame) -> DataFrame:
    """(witness, signature, contracts): contracts of steps (witness, pos, contracts) in order, those of one position sorted; and a digest of them."""
    each = steps.select("witness", "pos", F.explode("contracts").alias("c"))
    path = F.transform(F.array_sort(F.collect_list(F.struct("pos", "c"))), lambda s: s["c"])
    listed = each.groupBy("witness").agg(path.alias("contracts"))
    return listed.select("witness", F.sha2(F.array_join("contracts", ","), 256).alias("signature"), F.array_distinct("contracts").alias("contracts"))


def flow_list(variants: DataFrame, steps: DataFrame, witnesses: DataFrame) -> DataFrame:
    """variants (variant, first witness) with the number of their pages and actions and the first witness's assignments.

    steps: variant, kind, target. witnesses: witness, assignments.
    """
    sizes = steps.groupBy("variant").agg(F.count_if(F.col("kind") == "page").alias("pages"), F.count_if(F.col("kind") == "action").alias("actions"))
    out = variants.join(sizes, "variant", "left").join(witnesses, "witness", "left")
    return out.select("variant", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("pages", "actions")], "assignments")


def numbered_steps(steps: DataFrame, run: str, order: Sequence[str]) -> DataFrame:
    """Manifest steps numbered from 1 within a run, by the given order."""
    return steps.withColumn("sequence", F.row_number().over(Window.partitionBy(run).orderBy(*order)).cast("long"))


def uncovered(targets: DataFrame, adapters: DataFrame) -> DataFrame:
    """Targets (kind, control, ...) that no adapter (adapter, kinds, controls) permits; null controls permit all."""
    a = adapters.select(F.explode("kinds").alias("kind"), "controls")
    any_control = a.where("controls IS NULL").select("kind").distinct()
    named = a.where("controls IS NOT NULL").select("kind", F.explode("controls").alias("control")).distinct()
    return targets.join(any_control, "kind", "left_anti").join(named, ["kind", "control"], "left_anti")


def proposal_issues(proposals: DataFrame, gaps: DataFrame) -> DataFrame:
    """proposals with the first issue that stands against them, or 'accepted'.

    proposals: proposal, endpoint, authorities (null: none proposed), predicate (null: none). gaps: endpoint, kinds,
    allowed. Of several proposals for an endpoint all but the smallest are repeated.
    """
    rank = F.row_number().over(Window.partitionBy("endpoint").orderBy("proposal"))
    p = proposals.withColumn("__rank", rank).join(gaps, "endpoint", "left")
    has, says = F.col("authorities").isNotNull(), F.col("predicate").isNotNull()
    issue = (
        F.when(F.col("kinds").isNull(), "endpoint-not-allowed")
        .when(F.col("__rank") > 1, "resolved-twice")
        .when(~has & ~says, "resolves-nothing")
        .when(has & ~F.array_contains("kinds", "authorization"), "no-authorization-gap")
        .when(has & (F.size(F.array_except("authorities", F.coalesce("allowed", F.array().cast("array<string>")))) > 0), "unapproved-authority")
        .when(says & ~F.array_contains("kinds", "success-predicate"), "no-predicate-gap")
        .otherwise("accepted")
    )
    return p.select("proposal", "endpoint", issue.alias("issue"))


def summary(**tables: tuple[DataFrame, Sequence[str]]) -> DataFrame:
    """(name, column, value, n): rows of each table by each of the columns named."""
    out = None
    for name, (rows, columns) in tables.items():
        for c in columns:
            part = rows.groupBy(F.col(c).cast("string").alias("value")).agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), F.lit(c).alias("column"), "value", "n")
            out = part if out is None else out.unionByName(part)
    return out


def manifest_gate(checks: Sequence[tuple[str, Column]]) -> Column:
    """The first check (issue, condition that must hold) that fails or is null, else 'valid'."""
    out = F.lit("valid")
    for issue, holds in reversed(checks):
        out = F.when(F.coalesce(holds, F.lit(False)), out).otherwise(F.lit(issue))
    return out


def explained(asked: DataFrame, items: DataFrame, links: DataFrame) -> DataFrame:
    """kind, id, known, label, cites, cited_by: what there is to say about each item asked for.

    asked: kind, id. items: kind, id, label. links: src, dst (ids: src cites dst). Lists are sorted; an unknown item has none.
    """
    a = asked.select("kind", "id").distinct().join(items.select("kind", "id", "label", F.lit(True).alias("known")), ["kind", "id"], "left")
    near = lambda at, other, name: links.groupBy(F.col(at).alias("id")).agg(F.array_sort(F.collect_set(other)).alias(name))
    x = a.join(near("src", "dst", "cites"), "id", "left").join(near("dst", "src", "cited_by"), "id", "left")
    known = F.coalesce("known", F.lit(False))
    return x.select("kind", "id", known.alias("known"), "label", *[F.when(known, F.col(c)).alias(c) for c in ("cites", "cited_by")])
