"""State of a project: phases and guides, values for runs, manifests and their gates, repair plans, health, envelopes.

Rows are small here: a project, a variant or a run each. Everything is an expression or a join, so that a fleet of
projects is one table.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waypath.functions.constraints import binding_issue
from waypath.operators.contracts import permitted, scope_or_refs
from waypath.operators.coverage import first_failing
from waypath.operators.graph import neighbourhood
from waypath.operators.joins import top_of_each

# Phases in the order in which a project meets them, and the command that leads on from each.
PHASES = ("ANALYSIS_REQUIRED", "SOURCE_REPAIR_REQUIRED", "FLOW_SELECTION_REQUIRED", "BDD_GENERATION_REQUIRED", "REVIEW_REQUIRED", "DATA_REQUIRED", "RUNTIME_GROUNDING_REQUIRED", "EXECUTION_PLAN_REQUIRED")
READY = "READY"
NEXT = {
    "ANALYSIS_REQUIRED": "analyze", "SOURCE_REPAIR_REQUIRED": "plan-source-repair", "FLOW_SELECTION_REQUIRED": "select-flow", "BDD_GENERATION_REQUIRED": "generate-bdd", "REVIEW_REQUIRED": "review",
    "DATA_REQUIRED": "bind-data", "RUNTIME_GROUNDING_REQUIRED": "ground", "EXECUTION_PLAN_REQUIRED": "plan-execution", "READY": "run",
}


def phase(missing: Column, variants: Column, selected: Column, bdd: Column, feasibility: Column, data: Column, adapter: Column, runner: Column, contract_error: Column, ungrounded: Column, plan: Column) -> Column:
    """The first of nine gates that fails. missing: stale or missing artifacts; selected: a variant is chosen;
    ungrounded: sessions, screens, actions and fields without a binding."""
    none = lambda c: F.coalesce(c, F.lit(0)) == 0
    grounded = adapter & runner & ~F.coalesce(contract_error, F.lit(False)) & none(ungrounded)
    gates = (none(missing), ~none(variants), selected, bdd, feasibility != "conditional", data, grounded, plan)
    return first_failing(list(zip(PHASES, gates, strict=True)), READY)


def next_action(phase_: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in NEXT.items() for x in kv])[phase_]


def guide(projects: DataFrame, artifacts: DataFrame, coverage: DataFrame, variants: DataFrame) -> DataFrame:
    """project, phase, action, reason, blockers, attention: what stands between a project and its runs.

    projects: project and the state of its selected variant (selected, bdd, data, adapter, runner, contract_error,
    ungrounded, plan). artifacts: project, artifact, current (false: stale or missing). coverage: project, status,
    missing_stage. variants: project, feasibility, chosen.
    """
    a = artifacts.groupBy("project").agg(F.count_if(~F.col("current")).alias("missing"), F.min(F.when(~F.col("current"), F.col("artifact"))).alias("first_missing"))
    u = coverage.where("status = 'uncovered'").groupBy("project", F.coalesce("missing_stage", F.lit("unknown")).alias("stage")).agg(F.count("*").alias("n"))
    u = u.groupBy("project").agg(F.sum("n").alias("uncovered"), F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "stage", F.col("n").cast("string")))), ", ").alias("stages"))
    v = variants.groupBy("project").agg(F.count("*").alias("variants"), F.max(F.when(F.col("chosen"), F.col("feasibility"))).alias("feasibility"))
    x = projects.join(a, "project", "left").join(u, "project", "left").join(v, "project", "left")
    columns = ("missing", "variants", "selected", "bdd", "feasibility", "data", "adapter", "runner", "contract_error", "ungrounded", "plan")
    x = x.withColumn("phase", phase(*map(F.col, columns)))
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    blockers = F.filter(F.array(F.when(n("missing") > 0, "STATIC_MODEL_INCOMPLETE"), F.when((n("missing") == 0) & (n("variants") == 0) & (n("uncovered") > 0), "IN_SCOPE_OPERATIONS_UNCOVERED")), lambda c: c.isNotNull())
    attention = F.filter(F.array(F.when((n("uncovered") > 0) & (n("variants") > 0), "OPERATION_COVERAGE_BACKLOG")), lambda c: c.isNotNull())
    reason = F.when(F.col("phase") == PHASES[0], F.concat_ws(" ", "first_missing", F.lit("is stale or missing"))).when(F.col("phase") == PHASES[1], F.concat(F.lit("first missing stages: "), F.coalesce("stages", F.lit("none"))))
    return x.select("project", "phase", next_action(F.col("phase")).alias("action"), reason.alias("reason"), F.array_join(blockers, ",").alias("blockers"), F.array_join(attention, ",").alias("attention"))


def by_priority(actions: DataFrame, key: str, n: int = 1) -> DataFrame:
    """The n most urgent actions (key, priority, action) of each project, smallest priority first, ties by name."""
    return top_of_each(actions, [key], [F.col("priority"), F.col("action")], n)


def newest_valid(manifests: DataFrame, keys: Sequence[str], valid: Column, created: str) -> DataFrame:
    """Of each key, the newest manifest that is still valid."""
    rest = [c for c in manifests.columns if c not in keys]
    return manifests.where(valid).groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(created, *[c for c in rest if c != created])).alias("m")).select(*keys, "m.*")


# --- values and manifests -------------------------------------------------------------------------------------------

REPRESENTED = ("flow-literal", "synthetic-constrained", "derived", "runtime-option")


def value_bindings(requirements: DataFrame, bindings: DataFrame, schemes: Sequence[str] = ("vault",)) -> DataFrame:
    """requirement, availability, alias, strategy, resolution_digest, binding_digest, issue: the value behind each requirement.

    requirements: requirement, kind, status, representative, expected, strategies, digest. bindings: requirement, alias,
    value, secret_ref, resolver, requirement_digest, verified, confirmed. A generated representative stands for itself;
    anything else needs a verified and confirmed binding that fits (issue tells what is wrong, null if nothing).
    """
    x = requirements.join(bindings, "requirement", "left")
    own = F.coalesce(F.col("kind").isin(*REPRESENTED) & (F.col("status") == "generated") & F.col("representative").isNotNull(), F.lit(False))
    told = F.when(~F.coalesce(F.col("verified") & F.col("confirmed"), F.lit(False)), "not-confirmed")
    fits = binding_issue(*map(F.col, ("kind", "value", "secret_ref", "resolver", "strategies", "requirement_digest", "digest", "expected")), schemes=schemes)
    issue = F.when(~own, F.coalesce(told, fits))
    availability = F.when(issue.isNull(), F.when(own, "representative-value").when(F.col("secret_ref").isNotNull(), "secret-reference").otherwise("application-value"))
    alias = F.when(own, F.concat(F.lit("source-derived:"), "requirement")).otherwise(F.col("alias"))
    strategy = F.when(own, F.coalesce(F.get("strategies", F.lit(0)), F.lit("path-assignment"))).otherwise(F.col("resolver"))
    x = x.withColumn("issue", issue).withColumn("availability", availability).withColumn("alias", alias).withColumn("strategy", strategy)
    joined = lambda *c: F.concat(F.lit("sha256:"), F.sha2(F.concat_ws("\t", *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in c]), 256))
    x = x.withColumn("resolution_digest", F.when(F.col("issue").isNull(), joined("requirement", "alias", "strategy", "secret_ref")))
    value = F.when(F.col("availability") == "representative-value", F.col("representative")).otherwise(F.col("value"))
    x = x.withColumn("__v", value).withColumn("binding_digest", F.when(F.col("issue").isNull(), joined("digest", "resolution_digest", "__v")))
    return x.select("requirement", "availability", "alias", "strategy", "resolution_digest", "binding_digest", "issue")


def manifest_steps(paths: DataFrame, fields: DataFrame, sessions: DataFrame, values: DataFrame, adapters: DataFrame) -> DataFrame:
    """run, sequence, kind, screen, target, phase, binding_digest, adapters, issue: what a run does, in order.

    paths: run, pos, kind (screen, action or operation), node, success (the edge to it is a success edge). fields: run,
    screen, field, ordinal, control, mode, requirement: active fields of a run's screens. sessions: run, actor (required
    ones). values: requirement, binding_digest. adapters: adapter, kinds, controls (null: any). A session comes first,
    then screens, with their editable fields up to the last action, and actions. issue names what stops the run there.
    """
    w = Window.partitionBy("run").orderBy("pos")
    p = paths.where("kind IN ('screen', 'action')").withColumn("screen", F.last(F.when(F.col("kind") == "screen", F.col("node")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    whole = Window.partitionBy("run")
    last = F.max(F.when(F.col("kind") == "action", F.col("pos"))).over(whole)
    p = p.withColumn("last", F.coalesce(last, F.lit(-1))).withColumn("first_screen", F.min(F.when(F.col("kind") == "screen", F.col("pos"))).over(whole))
    p = p.withColumn("end", F.max(F.when((F.col("kind") == "screen") & (F.col("pos") > F.col("last")) & F.col("success"), F.col("pos"))).over(whole))
    is_screen = F.col("kind") == "screen"
    phases = F.when(is_screen, F.when(F.col("pos") == F.col("first_screen"), "entry").when(F.col("pos") == F.col("end"), "success").otherwise("intermediate"))
    no_end = F.when(F.col("end").isNull() & (F.col("pos") == F.col("first_screen")), "no-success-screen")
    null = lambda t: F.lit(None).cast(t)
    steps = p.select("run", "pos", F.lit(0).alias("sub"), F.when(is_screen, "screen-state").otherwise("action").alias("kind"), "screen", F.col("node").alias("target"), phases.alias("phase"), null("string").alias("control"), null("string").alias("requirement"), no_end.alias("issue"))
    shown = p.where(is_screen & (F.col("pos") < F.col("last"))).select("run", "pos", "screen").join(fields, ["run", "screen"])
    again = F.row_number().over(Window.partitionBy("run", "screen", "field").orderBy("pos")) > 1
    mode = F.coalesce("mode", F.lit("editable"))
    doubt = F.when(mode == "conditional", "input-mode-conditional").when(again, "field-on-second-visit").when(F.col("requirement").isNull(), "no-data-requirement")
    inputs = shown.withColumn("issue", doubt).where(mode.isin("editable", "conditional")).select("run", "pos", (F.col("ordinal") + 1).alias("sub"), F.lit("field").alias("kind"), "screen", F.col("field").alias("target"), null("string").alias("phase"), "control", "requirement", "issue")
    s = sessions.groupBy("run").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("actor")), ",").alias("target"))
    logins = s.select("run", F.lit(-1).alias("pos"), F.lit(0).alias("sub"), F.lit("actor-session").alias("kind"), null("string").alias("screen"), "target", null("string").alias("phase"), null("string").alias("control"), null("string").alias("requirement"), F.when(F.col("n") > 1, "several-actors").alias("issue"))
    x = logins.unionByName(steps).unionByName(inputs).join(values.select("requirement", "binding_digest"), "requirement", "left")
    able = permitted(x.select("kind", "control").distinct(), adapters, "kind", "control").groupBy("kind", "control").agg(F.array_sort(F.collect_set("adapter")).alias("adapters"))
    able = able.select(F.col("kind").alias("__k"), F.col("control").alias("__c"), "adapters")
    x = x.join(able, (F.col("kind") == F.col("__k")) & F.col("control").eqNullSafe(F.col("__c")), "left")
    issue = F.coalesce("issue", F.when((F.col("kind") == "field") & F.col("binding_digest").isNull(), "no-value"), F.when(F.col("adapters").isNull(), "no-adapter"))
    number = F.row_number().over(Window.partitionBy("run").orderBy("pos", "sub", "target"))
    return x.select("run", number.cast("long").alias("sequence"), "kind", "screen", "target", "phase", "binding_digest", F.coalesce("adapters", F.array().cast("array<string>")).alias("adapters"), issue.alias("issue"))


def recorded(steps: DataFrame, observations: DataFrame) -> DataFrame:
    """run, sequence, issue: what a run saw against what its manifest asks for, position by position; issue null: accepted.

    steps: run, sequence, kind, target, expected_next, adapters. observations: run, sequence, kind, target, next, adapter,
    found (how many elements), actionable. The first rule that is broken: missing, unexpected, another target, an adapter
    that is not permitted, no or several elements, one that can't be acted on, another next screen.
    """
    o = observations.select("run", "sequence", F.col("kind").alias("o_kind"), F.col("target").alias("o_target"), "next", "adapter", "found", "actionable", F.lit(True).alias("seen"))
    x = steps.withColumn("asked", F.lit(True)).join(o, ["run", "sequence"], "full")
    session, screen = F.col("kind") == "actor-session", F.col("kind") == "screen-state"
    yes = lambda c: F.coalesce(c, F.lit(False))
    issue = (
        F.when(F.col("seen").isNull(), "missing").when(F.col("asked").isNull(), "unexpected").when(~(F.col("kind").eqNullSafe(F.col("o_kind")) & F.col("target").eqNullSafe(F.col("o_target"))), "another-target")
        .when(~yes(F.array_contains("adapters", F.col("adapter"))), "adapter-not-permitted").when(~session & ~yes(F.col("found") == 1), "not-unique")
        .when(~session & ~screen & ~yes(F.col("actionable")), "not-actionable").when(F.col("expected_next").isNotNull() & ~F.col("expected_next").eqNullSafe(F.col("next")), "another-screen")
    )
    return x.select("run", "sequence", issue.alias("issue"))


def run_bindings(bindings: DataFrame, steps: DataFrame, observations: DataFrame) -> DataFrame:
    """bindings (run, sequence, adapter) with those of runs all of whose observations are accepted, new ones winning."""
    from waypath.operators.joins import merged

    judged = recorded(steps, observations)
    failed = judged.where("issue IS NOT NULL").select("run").distinct()
    new = observations.join(failed, "run", "left_anti").select("run", "sequence", "adapter")
    return merged(bindings.select("run", "sequence", "adapter"), new, ["run", "sequence"])


MANIFEST_GATES = ("content", "environment", "configuration", "adapters", "expired", "lineage", "variant", "review-required", "witness", "data", "steps")


def manifest_issue(m: Mapping[str, Column], now: Column, minutes: int = 30) -> Column:
    """The first gate that a recorded manifest fails against the present, 'valid' if none.

    m: by name, pairs of recorded and current values (digest/content_digest, environment, config_digest, adapter_digest,
    source_digest, data_digest, steps_digest as name and current_name), created_at, variant_known, feasibility,
    witness_of_variant.
    """
    same = lambda name: m[name].eqNullSafe(m[f"current_{name}"])
    checks = (
        same("digest"), same("environment"), same("config_digest"), same("adapter_digest"), m["created_at"] + F.expr(f"INTERVAL {minutes} MINUTES") > now, same("source_digest"), m["variant_known"],
        m["feasibility"] != "conditional", m["witness_of_variant"], same("data_digest"), same("steps_digest"),
    )
    return first_failing(list(zip(MANIFEST_GATES, checks, strict=True)), "valid")


# --- repair ---------------------------------------------------------------------------------------------------------


def repair_plan(gaps: DataFrame, edges: DataFrame, nodes: DataFrame, found: DataFrame, hints: DataFrame, hops: int = 2, most_nodes: int = 80, most_hints: int = 24, most_diagnostics: int = 40) -> DataFrame:
    """gap, missing_stage, evidence, hints, diagnostics (sorted lists): what to look at for each uncovered operation.

    gaps: gap, missing_stage, seeds (array of evidence ids). edges: src, dst. nodes: node, has_source. found: diagnostic,
    code, scope, refs. hints: gap, file, line, kind, excerpt, score. Neighbourhoods, hints and diagnostics have the bounds
    named; hints of one place and text count once, the best first.
    """
    seeds = gaps.select(F.col("gap").alias("origin"), F.explode("seeds").alias("node"))
    near = neighbourhood(seeds, edges, hops, most_nodes).select(F.col("origin").alias("gap"), "node")
    evidence = near.join(nodes.where("has_source").select("node"), "node").groupBy("gap").agg(F.array_sort(F.collect_set("node")).alias("evidence"))
    related = near.unionByName(gaps.select("gap", F.col("gap").alias("node"))).groupBy("gap").agg(F.collect_set("node").alias("refs"))
    told = scope_or_refs(gaps.select("gap").withColumn("scope", F.col("gap")).join(related, "gap"), found.select("diagnostic", "scope", "refs"))
    told = told.join(found.select("diagnostic", "code"), "diagnostic")
    first = top_of_each(told.select("gap", "code", "diagnostic").distinct(), ["gap"], [F.col("code"), F.col("diagnostic")], most_diagnostics)
    diagnostics = first.groupBy("gap").agg(F.array_sort(F.collect_list(F.struct("rank", "diagnostic"))).alias("d")).select("gap", F.transform("d", lambda s: s["diagnostic"]).alias("diagnostics"))
    best = hints.groupBy("gap", "file", "line", "kind", "excerpt").agg(F.max("score").alias("score"))
    best = top_of_each(best, ["gap"], [F.desc("score"), F.asc("file"), F.asc("line"), F.asc("kind"), F.asc("excerpt")], most_hints)
    listed = best.groupBy("gap").agg(F.array_sort(F.collect_list(F.struct("rank", F.concat_ws(":", "file", F.col("line").cast("string"), "excerpt").alias("h")))).alias("h")).select("gap", F.transform("h", lambda s: s["h"]).alias("hints"))
    x = gaps.select("gap", "missing_stage").join(evidence, "gap", "left").join(listed, "gap", "left").join(diagnostics, "gap", "left")
    return x.select("gap", "missing_stage", *[F.coalesce(F.col(c).cast("array<string>"), F.array().cast("array<string>")).alias(c) for c in ("evidence", "hints", "diagnostics")])


def hint_score(excerpt: Column, action_terms: Column) -> Column:
    """2 where an excerpt also names a term of the action, else 1."""
    return F.when(F.exists(action_terms, lambda t: F.contains(F.lower(excerpt), F.lower(t))), 2).otherwise(1)


# --- health and envelopes -------------------------------------------------------------------------------------------


def health(checks: DataFrame) -> DataFrame:
    """project, ok, warnings, errors, ready of checks (project, check, passed, required): a failing check is an error if it
    is required, else a warning."""
    failed, needed = ~F.coalesce(F.col("passed"), F.lit(False)), F.coalesce(F.col("required"), F.lit(False))
    n = lambda c, name: F.count_if(c).alias(name)
    g = checks.groupBy("project").agg(n(~failed, "ok"), n(failed & ~needed, "warnings"), n(failed & needed, "errors"))
    return g.withColumn("ready", F.col("errors") == 0)


def check_project(root: str, sources: Sequence[str], optional: Sequence[str] = (), settings: Mapping[str, object] | None = None) -> list[tuple[str, bool, bool, str]]:
    """(check, passed, required, detail) on the driver: source roots inside the project, optional inputs, settings that are set."""
    from waypath.sources.config import inside

    out = []
    for paths, required in ((sources, True), (optional, False)):
        for p in paths:
            try:
                out.append((f"path:{p}", inside(root, p).exists(), required, "found" if inside(root, p).exists() else "missing"))
            except ValueError as error:
                out.append((f"path:{p}", False, required, str(error)))
    return out + [(f"setting:{k}", v is not None, False, "set" if v is not None else "not set") for k, v in (settings or {}).items()]


def envelope(command: str, result: object = None, code: str = "OK", next_actions: Sequence[Mapping] = (), diagnostics: Sequence[Mapping] = (), resume: str = "guide") -> dict:
    """What a command answers: its result with a digest, what to do next, and a directive for whoever goes on.

    The directive: stop (a blocking human action is next), act (a blocking action of an agent is next), continue, or
    repair (the command failed).
    """
    ok = code == "OK" or code.startswith("OK_")
    body = {"schema": "1", "command": command, "ok": ok, "code": code, "next_actions": [dict(a) for a in next_actions], "diagnostics": [dict(d) for d in diagnostics]}
    if ok:
        body["result"] = result
    first = next((a for a in body["next_actions"] if a.get("blocking")), None)
    mode = "repair" if not ok else "continue" if first is None else "stop" if first.get("executor") == "human" else "act"
    digest = "sha256:" + hashlib.sha256(json.dumps(result, sort_keys=True, separators=(",", ":"), default=str).encode()).hexdigest()
    return body | {"agent": {"mode": mode, "action": (first or {}).get("id"), "resume": resume, "result_digest": digest if ok else None}}
