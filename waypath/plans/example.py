"""A small project as fact tables, and all that follows from it: the golden case of the queries and the tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from waypath.operators import behavior, catalog

VALIDATIONS = [("applicationType", "required", None, None, None), ("applicationType", "enum", None, None, ["PERSONAL", "JOINT"]), ("primaryApplicantId", "required", None, None, None), ("productCode", "required", None, None, None), ("productCode", "minLength", 3.0, None, None), ("productCode", "maxLength", 12.0, None, None), ("productCode", "type", None, "string", None)]


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def project(spark):
    """Facts of two ways through one form: a personal and a joint application."""
    f = lambda rows, schema: frame(spark, rows, schema)
    t = {}
    t["pages"] = f(
        [("type", "ApplicationType", ["/applications/new"], ["f-type"]), ("personal", "PersonalApplicant", ["/applications/personal"], ["p-id", "p-code"]), ("joint", "JointApplicant", ["/applications/joint"], ["j-id", "j-code", "j-joint"]), ("done", "Confirmation", ["/applications/:applicationId/confirmation"], [])],
        "page string, label string, routes array<string>, fields array<string>",
    )
    t["actions"] = f(
        [("a1", "type", "Continue", None, True, ["applicationType === 'PERSONAL'"], ["n1"]), ("a2", "type", "Continue", None, True, ["applicationType === 'JOINT'"], ["n2"]), ("a3", "personal", "Submit personal", "h3", True, [], []), ("a4", "joint", "Submit joint", "h4", True, [], [])],
        "action string, page string, label string, handler string, handler_exact boolean, guards array<string>, navigations array<string>",
    )
    t["handlers"] = f(
        [("h3", "submitPersonal", "p.tsx", [], ["n3"], True), ("h4", "submitJoint", "j.tsx", [], ["n4"], True), ("h5", "createApplication", "api.ts", ["http1"], [], True)],
        "handler string, name string, file string, http array<string>, navigations array<string>, completes boolean",
    )
    t["calls"] = f([("h3", "h5", None), ("h4", "h5", None)], "src string, dst string, guard string")
    nav = lambda n, target, proved=False: (n, target, None, True, None, None, proved, "createApplication" if proved else None, "api.ts" if proved else None)
    t["navigations"] = f(
        [nav("n1", "/applications/personal"), nav("n2", "/applications/joint"), nav("n3", "/applications/{response.applicationId}/confirmation", True), nav("n4", "/applications/{response.applicationId}/confirmation", True)],
        "navigation string, target string, target_text string, target_exact boolean, guard string, page string, proved boolean, after_name string, after_file string",
    )
    t["clients"] = f([("http1", "POST", "/api/applications")], "http string, method string, template string")
    t["endpoints"] = f([("e1", "POST", "/api/applications/", "submit", "ApplicationController", "certain", "true"), ("e2", "GET", "/api/applications", "list", "ApplicationController", "anonymous", None)], "endpoint string, method string, template string, handler string, controller string, access string, domain_guard string")
    t["effects"] = f([("e1", 0, "x1", "state-changed", "Application")], "endpoint string, pos int, effect string, kind string, entity string")
    t["validations"] = f([("e1", f"v{i}", f"ApplicationRequest.{p}", *rest) for i, (p, *rest) in enumerate(VALIDATIONS)], "endpoint string, validation string, path string, kind string, num_value double, str_value string, arr_value array<string>")
    t["fields"] = f(
        [("f-type", "type", "applicationType", "radio", None, [], [], "s0", True, "string", "applicationType"), ("p-id", "personal", "primaryApplicantId", "select", None, [], [], "s1", True, "string", None), ("p-code", "personal", "productCode", "textbox", None, [], [], "s2", True, "string", None),
         ("j-id", "joint", "primaryApplicantId", "select", None, [], [], "s3", True, "string", None), ("j-code", "joint", "productCode", "textbox", None, [], [], "s4", True, "string", None), ("j-joint", "joint", "jointApplicantId", "select", None, [], [], "s5", True, "string", None)],
        "field string, page string, path string, control string, mode string, visible_when array<string>, required_when array<string>, identity string, writable boolean, value_type string, binding_path string",
    )
    t["permissions"] = f([("e1", "backend", "APPLICATION_CREATE")], "endpoint string, layer string, authority string")
    t["concepts"] = f([(1, "Application", ["Loan request"])], "ordinal int, label string, aliases array<string>")
    t["requests"] = f([("r3", "e1", "personal", "exact"), ("r4", "e1", "joint", "exact")], "request string, endpoint string, page string, certainty string")
    given = [("r3", "applicationType", "literal", "PERSONAL", "string", None), ("r3", "primaryApplicantId", "path", None, None, "s1"), ("r3", "productCode", "path", None, None, "s2"), ("r4", "applicationType", "literal", "JOINT", "string", None), ("r4", "primaryApplicantId", "path", None, None, "s3"), ("r4", "productCode", "path", None, None, "s4"), ("r4", "jointApplicantId", "path", None, None, "s5")]
    t["given"] = f(given, "request string, name string, kind string, value string, vtype string, identity string")
    t["reach"] = f([("personal", "personal"), ("personal", "type"), ("joint", "joint"), ("joint", "type")], "page string, from_page string")
    return t


def built(t, entry=("/applications/new",), given=None, depth=40):
    """All tables that follow from a project's facts."""
    behavior._settled(t["pages"])  # sets the checkpoint folder
    c = catalog.payload_contracts(t["requests"], t["given"] if given is None else given, t["validations"], t["fields"], t["reach"])
    c = c.withColumn("action", F.when(F.col("request") == "r3", "a3").otherwise("a4")).withColumn("contract", F.concat(F.lit("c-"), "request")).withColumn("http", F.lit("http1")).withColumn("guard", F.lit(None).cast("string"))
    c = c.withColumn("handler_path", F.array(F.when(F.col("action") == "a3", "h3").otherwise("h4"), F.lit("h5"))).checkpoint()
    ops = catalog.operation_catalog(t["endpoints"], t["clients"], t["effects"], t["validations"], c, t["concepts"], ["POST"]).checkpoint()
    who = catalog.actors(ops, t["endpoints"], t["permissions"]).checkpoint()
    nodes, edges, starts = behavior.behavior_graph(t["pages"], t["actions"], t["handlers"], t["calls"], t["navigations"], ops, t["endpoints"], t["validations"], t["effects"], c, entry)
    members, ends = behavior.families(ops, nodes, edges)
    states = behavior.search_paths(nodes, edges, starts, members, ends, depth)
    w = behavior.witnesses(states, nodes)
    rules = w.select("witness").crossJoin(t["fields"].select("field", "path")).join(t["validations"].select(F.element_at(F.split("path", r"\."), -1).alias("path"), "kind", F.coalesce(F.col("num_value").cast("string"), "str_value", F.array_join("arr_value", ",")).alias("value"), F.col("validation").alias("constraint")), "path")
    active = behavior.active_fields(w, nodes, t["fields"], rules.withColumn("status", F.lit("satisfiable")))
    literals = c.select("contract", F.explode("literals").alias("l")).select("contract", F.substring_index("l", "=", 1).alias("name"))
    roles = behavior.assignment_roles(w, active, edges, literals, who, t["fields"].select("field", "binding_path"))
    v = behavior.behavior_variants(w, nodes, edges, active, roles, who)
    return {"contracts": c, "operations": ops, "actors": who, "nodes": nodes, "edges": edges, "entries": starts, "members": members, "states": states, "witnesses": w, "active": active, "roles": roles, "variants": v, "coverage": behavior.operation_coverage(ops, nodes, edges, members, w, v)}
