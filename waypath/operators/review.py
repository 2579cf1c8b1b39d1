"""What people decide: packets of open questions, approvals, bindings of data and their confirmation, and step plans."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waypath.functions.constraints import SECRET_CLASSES, binding_issue, modality_issue, sensitive
from waypath.functions.ids import leaf_name
from waypath.operators.joins import latest, merged


def none() -> Column:
    return F.array().cast("array<string>")


def digest_of(*columns: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(F.concat_ws("\t", *[F.coalesce(c.cast("string"), F.lit("")) for c in columns]), 256))


# --- packets --------------------------------------------------------------------------------------------------------


def rule_gaps(endpoints: DataFrame, validations: DataFrame) -> DataFrame:
    """endpoint, kinds, paths, values, allowed: what may be proposed for endpoints whose rules are not understood.

    endpoints: endpoint, access, access_text, guard_status. validations: endpoint, path, kind, num_value, arr_value. Paths:
    those validated, and the leaf names that are unique among them. Values: of enumerations and numeric bounds. Allowed:
    the authorities that the access rule names.
    """
    kinds = F.filter(F.array(F.when(F.col("access") == "conditional", "authorization"), F.when(F.col("guard_status") == "conditional", "success-predicate")), lambda k: k.isNotNull())
    open_ = endpoints.withColumn("kinds", kinds).where(F.size("kinds") > 0)
    v = validations.select("endpoint", "path", leaf_name(F.col("path")).alias("leaf")).distinct()
    alone = v.groupBy("endpoint", "leaf").agg(F.count("*").alias("n")).where("n = 1").select("endpoint", F.col("leaf").alias("path"))
    paths = v.select("endpoint", "path").unionByName(alone).groupBy("endpoint").agg(F.array_sort(F.collect_set("path")).alias("paths"))
    given = F.when(F.col("kind") == "enum", F.col("arr_value")).when(F.col("kind").isin("min", "max"), F.array(F.col("num_value").cast("string")))
    values = validations.select("endpoint", F.explode(given).alias("v")).where("v IS NOT NULL").groupBy("endpoint").agg(F.array_sort(F.collect_set("v")).alias("values"))
    names = F.array_sort(F.array_distinct(F.regexp_extract_all(F.coalesce("access_text", F.lit("")), F.lit(r"'([^']+)'"), F.lit(1))))
    x = open_.join(paths, "endpoint", "left").join(values, "endpoint", "left")
    return x.select("endpoint", "kinds", F.coalesce("paths", none()).alias("paths"), F.coalesce("values", none()).alias("values"), names.alias("allowed"))


def packet_digest(gaps: DataFrame) -> DataFrame:
    """gaps with the digest that an approval has to name."""
    return gaps.withColumn("digest", digest_of(F.col("endpoint"), *[F.array_join(c, ",") for c in ("kinds", "paths", "values", "allowed")]))


def current_approvals(approvals: DataFrame, packets: DataFrame) -> DataFrame:
    """The newest approval of each packet, if it is of the packet's present digest. approvals: packet, digest, approved_at,
    ...; packets: packet, digest."""
    newest = latest(approvals, ["packet"], ["approved_at"])
    return newest.join(packets.select("packet", "digest"), ["packet", "digest"], "left_semi")


def apply_names(operations: DataFrame, decisions: DataFrame) -> DataFrame:
    """operations (operation, label, origin, ...) with the approved label, where there is one; machine names stay."""
    d = decisions.select("operation", F.col("label").alias("__label"))
    x = operations.join(d, "operation", "left")
    named = F.col("__label").isNotNull()
    return x.withColumn("label", F.coalesce("__label", "label")).withColumn("origin", F.when(named, "human-reviewed").otherwise(F.col("origin"))).select(operations.columns)


def apply_rules(endpoints: DataFrame, permissions: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """endpoints (endpoint, access, domain_guard, ...) and permissions (endpoint, layer, authority) as approved.

    decisions: endpoint, access (null: not decided), authorities, predicate (null: not decided). A decided access replaces
    the endpoint's permissions.
    """
    d = decisions.select("endpoint", F.col("access").alias("__access"), F.col("predicate").alias("__predicate"))
    x = endpoints.join(d, "endpoint", "left").withColumn("access", F.coalesce("__access", "access")).withColumn("domain_guard", F.coalesce("__predicate", "domain_guard"))
    decided = decisions.where("access IS NOT NULL")
    new = decided.where("access NOT IN ('anonymous', 'authenticated')").select("endpoint", F.lit("backend").alias("layer"), F.explode("authorities").alias("authority"))
    kept = permissions.join(decided.select("endpoint"), "endpoint", "left_anti")
    return x.select(endpoints.columns), kept.select("endpoint", "layer", "authority").unionByName(new)


# --- data -----------------------------------------------------------------------------------------------------------


def bind(bindings: DataFrame, requests: DataFrame, requirements: DataFrame, schemes: Sequence[str] = ("vault",)) -> tuple[DataFrame, DataFrame]:
    """bindings with those that are asked for, unverified, and the requests with what stands against them (issue).

    requests: requirement, alias, value, secret_ref, resolver. requirements: requirement, kind, path, strategies, digest,
    expected. Only requests without an issue are bound; a new binding replaces the old one.
    """
    x = requests.join(requirements, "requirement", "left")
    secret = F.col("kind").isin(*SECRET_CLASSES)
    issue = F.coalesce(
        F.when(F.col("kind").isNull(), "unknown-requirement"), F.when(~F.coalesce(F.array_contains("strategies", F.col("resolver")), F.lit(False)), "strategy-not-allowed"),
        F.when(~secret & F.col("value").isNotNull() & sensitive(F.coalesce("path", F.lit(""))), "sensitive-value"), modality_issue(F.col("kind"), F.col("value"), F.col("secret_ref"), schemes),
        F.when(F.col("value").isNotNull() & F.col("expected").isNotNull() & (F.col("value") != F.col("expected")), "unexpected-value"),
    )
    judged = x.withColumn("issue", issue)
    new = judged.where("issue IS NULL").select("requirement", "alias", "value", "secret_ref", "resolver", F.col("digest").alias("requirement_digest"), F.lit(False).alias("verified"), F.lit(None).cast("string").alias("reviewer"))
    return merged(bindings.select(new.columns), new, ["requirement"]), judged.select(*requests.columns, "issue")


def confirm(bindings: DataFrame, confirmations: DataFrame, requirements: DataFrame, schemes: Sequence[str] = ("vault",)) -> DataFrame:
    """bindings, verified by the reviewer who confirms them, where their form and resolver still fit the requirement."""
    c = latest(confirmations, ["requirement"], ["confirmed_at"]).select("requirement", F.col("reviewer").alias("__by"))
    x = bindings.join(c, "requirement", "left").join(requirements.select("requirement", "kind", "strategies", "digest"), "requirement", "left")
    ok = F.col("__by").isNotNull() & modality_issue(F.col("kind"), F.col("value"), F.col("secret_ref"), schemes).isNull() & F.coalesce(F.array_contains("strategies", F.col("resolver")), F.lit(False))
    ok = F.coalesce(ok & F.col("kind").isNotNull(), F.lit(False))
    new = {"verified": F.col("verified") | ok, "reviewer": F.when(ok, F.col("__by")).otherwise(F.col("reviewer")), "requirement_digest": F.when(ok, F.col("digest")).otherwise(F.col("requirement_digest"))}
    return x.withColumns(new).select(bindings.columns)


def verify(requirements: DataFrame, bindings: DataFrame, schemes: Sequence[str] = ("vault",)) -> DataFrame:
    """requirement, variant, status (generated, verified, unverified or missing) and reason.

    requirements: variant, requirement, kind, status, representative, strategies, digest, expected.
    """
    b = bindings.select("requirement", "value", "secret_ref", "resolver", "requirement_digest", "verified", F.lit(True).alias("__bound"))
    x = requirements.join(b, "requirement", "left")
    own = F.coalesce(F.col("kind").isin("flow-literal", "synthetic-constrained", "derived", "runtime-option") & (F.col("status") == "generated") & F.col("representative").isNotNull(), F.lit(False))
    issue = binding_issue(*map(F.col, ("kind", "value", "secret_ref", "resolver", "strategies", "requirement_digest", "digest", "expected")), schemes=schemes)
    status = F.when(own, "generated").when(F.col("__bound").isNull(), "missing").when(F.col("verified") & issue.isNull(), "verified").otherwise("unverified")
    reason = F.when(status == "unverified", F.coalesce(issue, F.lit("not-confirmed")))
    return x.select("variant", "requirement", status.alias("status"), reason.alias("reason"))


def data_readiness(verified: DataFrame) -> DataFrame:
    """variant, ready and the number of requirements of each status."""
    n = lambda s: F.count_if(F.col("status") == s).alias(s)
    g = verified.groupBy("variant").agg(*[n(s) for s in ("generated", "verified", "unverified", "missing")])
    return g.withColumn("ready", (F.col("unverified") == 0) & (F.col("missing") == 0))


# --- step plans -----------------------------------------------------------------------------------------------------


def step_plan(variants: DataFrame, steps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(family, variant, pos, keyword, text, refs) of satisfiable variants, and (family, variant, steps, digest) to trace them.

    variants: family, variant, feasibility. steps: variant, pos, kind (screen, action, operation or outcome), label, ref.
    The first of a kind takes Given, When or Then, those after it And.
    """
    from pyspark.sql import Window

    word = F.when(F.col("kind") == "screen", "Given").when(F.col("kind") == "outcome", "Then").otherwise("When")
    x = variants.where("feasibility = 'satisfiable'").select("family", "variant").join(steps, "variant").withColumn("word", word)
    before = F.lag("word").over(Window.partitionBy("variant").orderBy("pos"))
    text = F.concat_ws(" ", F.when(F.col("kind") == "screen", "the user is on").when(F.col("kind") == "action", "the user chooses").when(F.col("kind") == "operation", "the system performs").otherwise("the result is"), "label")
    plan = x.select("family", "variant", "pos", F.when(before == F.col("word"), "And").otherwise(F.col("word")).alias("keyword"), text.alias("text"), F.array("ref").alias("refs"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("pos", "keyword", "text"))), lambda s: F.concat_ws(" ", s["keyword"], s["text"]))
    trace = plan.groupBy("family", "variant").agg(F.count("*").alias("steps"), F.concat(F.lit("sha256:"), F.sha2(F.array_join(listed, "\n"), 256)).alias("digest"))
    return plan, trace


def obsolete_files(written: DataFrame, planned: DataFrame) -> DataFrame:
    """Files of earlier runs that the present plan does not name. Both: file."""
    return written.select("file").distinct().join(planned.select("file"), "file", "left_anti")
