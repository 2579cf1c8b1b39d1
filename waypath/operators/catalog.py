"""From extracted facts to operations and request contracts: what an endpoint does, who calls it, and what a call proves.

Facts are tables with a row each; lists of ids are arrays. Guards are texts of the predicate grammar, null for none.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waypath.functions import predicates as P
from waypath.functions.constraints import check_value
from waypath.functions.ids import capitalised, leaf_name, normal_template, slug, stable_id
from waypath.operators.contracts import alias_join

# Verbs that name a command, where a handler's name begins with one.
VERBS = "create|submit|open|approve|reject|update|delete|cancel|place|send|activate|deactivate"


def route_key(method: Column, template: Column) -> Column:
    return F.concat_ws(":", F.upper(method), normal_template(template))


def command_name(handler: Column, entity: Column) -> Column:
    """entity.verb: the verb the handler begins with, or what is left of its name without the entity, or 'execute'."""
    verb = F.lower(F.regexp_extract(handler, f"(?i)^({VERBS})", 1))
    quoted = F.concat(F.lit("(?i)"), F.regexp_replace(entity, r"([^A-Za-z0-9])", r"\\$1"))
    rest = F.trim(F.lower(F.regexp_replace(F.when(entity == "", handler).otherwise(F.regexp_replace(handler, quoted, F.lit(""))), "(?i)(handler|request)$", "")))
    dotted = lambda c: F.regexp_replace(slug(c), "-", ".")
    return F.concat_ws(".", dotted(entity), dotted(F.coalesce(F.nullif(verb, F.lit("")), F.nullif(rest, F.lit("")), F.lit("execute"))))


def command_label(machine_name: Column, entity_label: Column) -> Column:
    parts = F.split(machine_name, r"\.")
    verb = F.regexp_replace(capitalised(F.coalesce(F.get(parts, F.lit(1)), F.lit("execute"))), "-", " ")
    return F.concat_ws(" ", verb, F.coalesce(entity_label, F.get(parts, F.lit(0))))


def inclusion(in_scope: Column, effects: Column, doubts: Sequence[Column], clients: Column, contracts: Column, present: Column) -> Column:
    """excluded: out of scope or without a lasting effect. review-required: any doubt, no client, or a client contract
    whose fields are not all present. included: the rest. Nulls count as no and as zero."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    n = lambda c: F.coalesce(c, F.lit(0))
    doubt = F.lit(False)
    for d in doubts:
        doubt = doubt | yes(d)
    return (
        F.when(~yes(in_scope) | (n(effects) == 0), "excluded")
        .when(doubt | (n(clients) == 0) | ((n(contracts) > 0) & (n(present) < n(contracts))), "review-required")
        .otherwise("included")
    )


def with_status(rows: DataFrame, guard: str, result: str) -> DataFrame:
    """rows with the status of a guard (null: satisfiable)."""
    return P.per_row(rows, [guard], f"{result} string", lambda text: [(P.status_of(P.parse(text)),)])


def operation_catalog(endpoints: DataFrame, clients: DataFrame, effects: DataFrame, validations: DataFrame, contracts: DataFrame, concepts: DataFrame, methods: Sequence[str]) -> DataFrame:
    """operation, endpoint, machine_name, label, origin, inclusion, ambiguous, clients, contracts (sorted arrays of ids).

    endpoints: endpoint, method, template, handler, controller, access, domain_guard. clients: http, method, template.
    effects: endpoint, pos, effect, kind, entity. validations: endpoint, kind. contracts: contract, endpoint, http, status.
    concepts: ordinal, label, aliases.
    """
    e = with_status(endpoints.withColumn("key", route_key(F.col("method"), F.col("template"))), "domain_guard", "guard_status")
    same = e.groupBy("key").agg(F.count("*").alias("__same"))
    called = clients.select(route_key(F.col("method"), F.col("template")).alias("key"), "http")
    by_key = called.groupBy("key").agg(F.array_sort(F.collect_set("http")).alias("clients"))
    of_effects = effects.groupBy("endpoint").agg(F.count("*").alias("__effects"), F.max(F.col("kind") == "unknown-mutation").alias("__unknown"), F.min_by(F.struct("kind", "entity"), "pos").alias("__first"))
    opaque = validations.groupBy("endpoint").agg(F.max(F.col("kind") == "opaque").alias("__opaque"))
    own = contracts.join(e.select("endpoint", "key"), "endpoint").join(called, ["key", "http"], "left_semi")
    of_contracts = own.groupBy("endpoint").agg(F.array_sort(F.collect_set("contract")).alias("contracts"), F.count("*").alias("__all"), F.count_if(F.col("status") == "fields-present").alias("__present"))
    x = e.join(same, "key").join(by_key, "key", "left")
    for part in (of_effects, opaque, of_contracts):
        x = x.join(part, "endpoint", "left")
    entity = F.coalesce("__first.entity", F.regexp_replace("controller", "Controller$", ""))
    x = x.withColumn("entity", F.coalesce("__first.entity", F.lit(""))).withColumn(
        "machine_name", F.when(F.col("__first.kind") == "authentication-session-issued", "authentication.login").otherwise(command_name(F.col("handler"), entity))
    )
    named = alias_join(x, concepts.withColumn("__all_names", F.array_append("aliases", F.col("label"))).withColumnRenamed("label", "concept"), "entity", "__all_names", "ordinal", ["concept"])
    doubts = [F.col("__unknown"), F.col("access") == "conditional", F.col("guard_status") == "conditional", F.col("__opaque"), F.col("__same") > 1]
    key = F.concat_ws(":", "endpoint", "method", "template", F.coalesce("__first.kind", F.lit("mutation")), "entity")
    none = F.array().cast("array<string>")
    return named.select(
        stable_id(F.lit("operation"), key).alias("operation"), "endpoint", "machine_name", command_label(F.col("machine_name"), F.col("concept")).alias("label"),
        F.when(F.col("concept").isNotNull(), "wiki").otherwise("deterministic").alias("origin"),
        inclusion(F.upper("method").isin(*[m.upper() for m in methods]), F.col("__effects"), doubts, F.size("clients"), F.col("__all"), F.col("__present")).alias("inclusion"),
        (F.col("__same") > 1).alias("ambiguous"), F.coalesce("clients", none).alias("clients"), F.coalesce("contracts", none).alias("contracts"),
    )


def actors(operations: DataFrame, endpoints: DataFrame, permissions: DataFrame) -> DataFrame:
    """operation, actor, authentication, authorities, roles, label, inclusion, for operations that are not excluded.

    permissions: endpoint (null: of the frontend), layer, authority. A frontend authority counts where the endpoint has
    the same one. An access rule that is not understood demotes the operation to review.
    """
    listed = permissions.where("endpoint IS NOT NULL").groupBy("endpoint").agg(F.array_sort(F.collect_set("authority")).alias("authorities"))
    x = operations.where("inclusion <> 'excluded'").join(endpoints.select("endpoint", "access"), "endpoint").join(listed, "endpoint", "left")
    odd, names = F.col("access") == "conditional", F.coalesce("authorities", F.array().cast("array<string>"))
    required = (F.col("access") == "authenticated") | (F.size(names) > 0)
    names = F.when(odd, F.array().cast("array<string>")).otherwise(names)
    said = F.when(odd, "conditional").when(F.size(names) > 0, F.array_join(names, ",")).when(required, "authenticated").otherwise("anonymous")
    label = (
        F.when(odd, "authenticated principal satisfying unresolved authorization").when(F.size(names) > 0, F.concat(F.lit("principal with "), F.array_join(names, ", ")))
        .when(required, "authenticated principal").otherwise("anonymous principal")
    )
    return x.select(
        "operation", stable_id(F.lit("actor-requirement"), F.concat_ws(":", "operation", said)).alias("actor"), F.when(odd | required, "required").otherwise("anonymous").alias("authentication"),
        names.alias("authorities"), F.filter(names, lambda a: a.startswith("ROLE_")).alias("roles"), label.alias("label"), F.when(odd, "review-required").otherwise(F.col("inclusion")).alias("inclusion"),
    )


def resolved_shape(shapes: DataFrame, environments: DataFrame) -> DataFrame:
    """Payload shapes (request, reference, certainty, fields) with what the reference means in the request's environment.

    environments: request, name, certainty, fields. A shape without a reference, or whose reference is not known, stays;
    a request of an ambiguous call (column ambiguous) is unknown and has no fields.
    """
    env = environments.select("request", F.col("name").alias("reference"), F.col("certainty").alias("__c"), F.col("fields").alias("__f"))
    x = shapes.join(env, ["request", "reference"], "left")
    known, lost = F.col("__c").isNotNull(), F.coalesce("ambiguous", F.lit(False))
    certainty = F.when(lost, "unknown").when(known, F.col("__c")).otherwise(F.col("certainty"))
    fields = F.when(lost, F.expr("filter(fields, x -> false)")).when(known, F.col("__f")).otherwise(F.col("fields"))
    return x.select("request", certainty.alias("certainty"), fields.alias("fields"))


def type_fits(actual: Column, expected: Column) -> Column:
    """Whether a control of one value type gives what a declared type asks for; nothing is known of 'unknown' or null."""
    return F.coalesce((actual == expected) | ((expected == "number") & (actual == "integer")), F.lit(False))


def json_check(value: Column, vtype: Column, kind: Column, num: Column, text: Column, items: Column) -> Column:
    """check_value for a literal of JSON, whose own type counts."""
    number = value.try_cast("double")
    fits = (
        F.when(text == "string", vtype == "string").when(text == "boolean", vtype == "boolean").when(text == "number", vtype == "number")
        .when(text == "integer", (vtype == "number") & (number == F.floor(number))).otherwise(F.lit(False))
    )
    needs_text = kind.isin("minLength", "maxLength", "pattern", "format") & (vtype != "string")
    return (
        F.when(kind.isin("opaque", "size"), "conditional").when(kind == "type", F.when(fits, "valid").otherwise("invalid")).when(needs_text, "invalid")
        .when((kind == "required") & (vtype == "null"), "invalid").otherwise(check_value(value, kind, num, text, items))
    )


def payload_contracts(requests: DataFrame, given: DataFrame, validations: DataFrame, fields: DataFrame, reach: DataFrame) -> DataFrame:
    """What each request proves about the fields its endpoint validates.

    requests: request, endpoint, page, certainty. given: request, name, kind (literal, path or other), value, vtype,
    identity. validations: endpoint, validation, path, kind, num_value, str_value, arr_value. fields: field, page, path,
    identity, writable, value_type. reach: page, from_page (itself included): pages from which the action's page is
    reached. Returns request, endpoint, required, provided, missing, unproven, invalid, bindings and literals ('name=value',
    sorted) and status.
    """
    none = F.array().cast("array<string>")
    v = validations.withColumn("name", leaf_name(F.col("path")))
    needed = v.where("kind = 'required'").groupBy("endpoint").agg(F.array_sort(F.collect_set("name")).alias("required"))
    g = given.dropDuplicates(["request", "name"])
    provided = g.groupBy("request").agg(
        F.array_sort(F.collect_set("name")).alias("provided"), F.array_sort(F.collect_set(F.when(F.col("kind") == "literal", F.concat_ws("=", "name", F.coalesce("value", F.lit("null")))))).alias("literals")
    )
    asked = requests.select("request", "endpoint", "page").join(g, "request").join(v.select("endpoint", "name").distinct(), ["endpoint", "name"], "left_semi")
    rules = v.select("endpoint", "name", F.col("kind").alias("rule"), "num_value", "str_value", "arr_value")
    # literals: the worst of all rules
    judged = asked.where("kind = 'literal'").join(rules, ["endpoint", "name"]).withColumn("s", json_check(*map(F.col, ("value", "vtype", "rule", "num_value", "str_value", "arr_value"))))
    free = (F.col("vtype") == "null") & ~F.max(F.col("rule") == "required").over(_each("request", "endpoint", "name"))
    judged = judged.withColumn("free", free).groupBy("request", "endpoint", "name").agg(
        F.max("free").alias("free"), F.max(F.col("s") == "invalid").alias("bad"), F.max(F.col("s") == "conditional").alias("open")
    )
    of_literals = judged.select("request", "endpoint", "name", F.when(F.col("free"), "proven").when(F.col("bad"), "invalid").when(F.col("open"), "unproven").otherwise("proven").alias("proof"), F.lit(None).cast("string").alias("field"))
    # paths: the only writable field of that name and source on a page from which the action's page is reached
    writable = fields.where("writable").select("field", F.col("page").alias("from_page"), F.lower(leaf_name(F.col("path"))).alias("leaf"), "identity", "value_type")
    paths = asked.where("kind = 'path' AND identity IS NOT NULL").withColumn("leaf", F.lower("name")).join(reach, "page").join(writable, ["from_page", "leaf", "identity"])
    one = paths.groupBy("request", "endpoint", "name").agg(F.count_distinct("field").alias("n"), F.min("field").alias("field"), F.min("value_type").alias("value_type")).where("n = 1").drop("n")
    typed = one.join(rules.where("rule IN ('type', 'opaque')").select("endpoint", "name", "rule", "str_value"), ["endpoint", "name"], "left")
    fits = F.when(F.col("rule") == "opaque", F.lit(False)).when(F.col("rule").isNull(), F.lit(True)).otherwise(type_fits(F.col("value_type"), F.col("str_value")))
    typed = typed.groupBy("request", "endpoint", "name", "field").agg(F.min(fits).alias("fits"))
    of_paths = typed.select("request", "endpoint", "name", F.when(F.col("fits"), "proven").otherwise("unproven").alias("proof"), F.when(F.col("fits"), F.col("field")).alias("field"))
    proofs = asked.select("request", "endpoint", "name").join(of_literals.unionByName(of_paths), ["request", "endpoint", "name"], "left").withColumn("proof", F.coalesce("proof", F.lit("unproven")))
    names = lambda proof: F.array_sort(F.collect_set(F.when(F.col("proof") == proof, F.col("name"))))
    told = proofs.groupBy("request", "endpoint").agg(names("unproven").alias("unproven"), names("invalid").alias("invalid"), F.array_sort(F.collect_set(F.when(F.col("field").isNotNull(), F.concat_ws("=", "name", "field")))).alias("bindings"))
    x = requests.join(needed, "endpoint", "left").join(provided, "request", "left").join(told, ["request", "endpoint"], "left")
    for c in ("required", "provided", "literals", "unproven", "invalid", "bindings"):
        x = x.withColumn(c, F.coalesce(c, none))
    x = x.withColumn("missing", F.array_except("required", "provided"))
    status = (
        F.when(F.size("missing") > 0, F.when(F.col("certainty") == "exact", "required-fields-missing").otherwise("review-required"))
        .when(F.size("invalid") > 0, "required-fields-invalid").when(F.size("unproven") > 0, "review-required").otherwise("fields-present")
    )
    return x.select("request", "endpoint", "required", "provided", "missing", "unproven", "invalid", "bindings", "literals", status.alias("status"))


def _each(*keys: str):
    from pyspark.sql import Window

    return Window.partitionBy(*keys)


def bound_constraints(contracts: DataFrame, validations: DataFrame) -> DataFrame:
    """(contract, endpoint, field, constraint): the validations that a contract's fields have to meet.

    contracts: contract, endpoint, status, bindings ('name=field'). validations: endpoint, validation, path. Names are
    leaf names in any case; contracts that miss required fields or give invalid ones bind nothing.
    """
    c = contracts.where("NOT status IN ('required-fields-missing', 'required-fields-invalid')").select("contract", "endpoint", F.explode("bindings").alias("b"))
    c = c.select("contract", "endpoint", F.lower(F.substring_index("b", "=", 1)).alias("leaf"), F.substring_index("b", "=", -1).alias("field"))
    v = validations.select("endpoint", F.lower(leaf_name(F.col("path"))).alias("leaf"), F.col("validation").alias("constraint"))
    return c.join(v, ["endpoint", "leaf"]).select("contract", "endpoint", "field", "constraint").distinct()


def deduplicated(rows: DataFrame, keys: Sequence[str], smallest: str) -> DataFrame:
    """rows without those that are alike in `keys` (arrays, maps and structs by their JSON), but for the one of the
    smallest `smallest`."""
    alike = F.sha2(F.to_json(F.struct(*keys), {"ignoreNullFields": "false"}), 256)
    rest = [c for c in rows.columns if c != smallest]
    g = rows.withColumn("__alike", alike).groupBy("__alike").agg(F.min_by(F.struct(*rest), smallest).alias("r"), F.min(smallest).alias(smallest))
    return g.select(smallest, "r.*").select(rows.columns)


def receiver_types(calls: DataFrame, declared: DataFrame) -> DataFrame:
    """calls (call, receiver_type, method, arity) with the only file that declares the method for the type or for one type
    that implements it; match: unique, missing or ambiguous. declared: file, type, implements (array), method, arity."""
    own = declared.select("file", F.explode(F.array_distinct(F.array_append("implements", F.col("type")))).alias("receiver_type"), "method", "arity").distinct()
    from waypath.operators.joins import unique_join

    return unique_join(calls, own, ["receiver_type", "method", "arity"], ["file"])
