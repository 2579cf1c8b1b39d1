"""A small project as fact tables, from endpoints to covered operations; and the search on graphs built by hand."""

import pytest
from pyspark.sql import functions as F

from waypath.operators import behavior, catalog
from waypath.plans import example
from waypath.plans.example import built

@pytest.fixture(scope="module")
def project(spark):
    return example.project(spark)


def test_project(spark, project):
    """One operation, two witnesses, two satisfiable variants."""
    b = built(project)
    assert {r.request: (r.status, r.bindings) for r in b["contracts"].collect()} == {"r3": ("fields-present", ["primaryApplicantId=p-id", "productCode=p-code"]), "r4": ("fields-present", ["primaryApplicantId=j-id", "productCode=j-code"])}
    ops = {r.endpoint: r for r in b["operations"].collect()}
    assert (ops["e1"].machine_name, ops["e1"].label, ops["e1"].origin, ops["e1"].inclusion) == ("application.submit", "Submit Application", "wiki", "included")
    assert ops["e2"].inclusion == "excluded"
    actor = b["actors"].first()
    assert (actor.authentication, actor.authorities, actor.label) == ("required", ["APPLICATION_CREATE"], "principal with APPLICATION_CREATE")
    w = b["witnesses"].collect()
    assert len(w) == 2 and {r.feasibility for r in w} == {"satisfiable"} and {tuple(r.pages) for r in w} == {("type", "personal", "done"), ("type", "joint", "done")}
    v = {r.variant: r for r in b["variants"].collect()}
    assert set(v) == {"application.submit.personal", "application.submit.joint"} and all(r.feasibility == "satisfiable" and not r.rejected for r in v.values())
    assert {(r.witness, r.path, r.role) for r in b["roles"].collect()} == {(r.witness, "applicationType", "field") for r in w}
    c = b["coverage"].first()
    assert (c.status, c.missing_stage, c.witnesses, c.variants) == ("covered", None, 2, 2)
    required = {(r.field, r.required) for r in b["active"].collect()}
    assert ("p-id", "true") in required and ("j-joint", "false") in required and ("f-type", "true") in required
    counts = {r.name: r.n for r in behavior.coverage_totals({k: b[k] for k in ("operations", "nodes", "edges", "witnesses", "states", "variants", "contracts", "coverage")}).collect()}
    assert counts["terminalOperations"] == 1 and counts["pathWitnesses"] == 2 and counts["uncoveredOperations"] == 0 and counts["pathSearchVisitPrunes"] == 0


def test_project_without_proofs(spark, project):
    """Missing required fields block the path; unproved values and an inferred entry make it conditional."""
    t = project
    short = t["given"].where("name <> 'productCode'")
    b = built(t, given=short)
    assert {r.status for r in b["contracts"].collect()} == {"required-fields-missing"}
    assert b["witnesses"].count() == 0 and b["variants"].count() == 0
    assert [(r.status, r.missing_stage) for r in b["coverage"].collect()] == [("uncovered", "action-operation-join")]
    wrong = t["given"].withColumn("value", F.when(F.col("value") == "JOINT", "OTHER").otherwise(F.col("value"))).withColumn("identity", F.when(F.col("identity") == "s1", "elsewhere").otherwise(F.col("identity")))
    b = built(t, entry=(), given=wrong)
    assert {r.request: (r.status, r.unproven, r.invalid) for r in b["contracts"].collect()} == {"r3": ("review-required", ["primaryApplicantId"], []), "r4": ("required-fields-invalid", [], ["applicationType"])}
    w = b["witnesses"].collect()
    assert [r.feasibility for r in w] == ["conditional"] and "structural-entry:type" in w[0].condition and "request-payload:c-r3" in w[0].condition
    assert [r.status for r in b["coverage"].collect()] == ["conditional"]


NODES = "node string, kind string, label string, reference string, page_fields array<string>"
EDGES = "edge string, src string, dst string, guards array<string>, outcome string, contracts array<string>, needs array<string>, nav_only boolean"


def searched(spark, edges, kinds, depth=10, visits=2, structural=False, fields=None, reference="op"):
    """edges: (src, dst, outcome, guards, needs, nav_only)."""
    fields = fields or {}
    nodes = spark.createDataFrame([(n, k, n, reference if k == "operation" else n, fields.get(n, [])) for n, k in kinds.items()], NODES)
    e = spark.createDataFrame([(f"e{i}", a, b, g, o, ["c"] if need else [], need, nav) for i, (a, b, o, g, need, nav) in enumerate(edges)], EDGES)
    starts = spark.createDataFrame([(edges[0][0], structural)], "node string, structural boolean")
    members = spark.createDataFrame([("f", "op")], "family string, operation string")
    ends = e.where("outcome = 'success'").select(F.lit("f").alias("family"), F.col("dst").alias("success")).distinct()
    states = behavior.search_paths(nodes, e, starts, members, ends, depth, visits)
    return states, behavior.witnesses(states, nodes)


def step(a, b, outcome="neutral", guards=(), needs=(), nav=False):
    return a, b, outcome, list(guards), list(needs), nav


KINDS = {"E": "screen", "submit": "action", "op": "operation", "S": "screen"}


def test_bounds_of_the_search(spark):
    line = [step("E", "submit"), step("submit", "op"), step("op", "S", "success")]
    states, w = searched(spark, line, KINDS, depth=3)
    assert w.count() == 0 and tuple(behavior.telemetry(states).first()) == (4, 4, 1, 0)
    d = behavior.truncation_details(states).first()
    assert (d.reason, d.node, d.edge, d.n, d.least, d.most, d["sample"]) == ("depth", "S", None, 1, 4, 4, "E>submit>op>S")
    for turned in (1, -1):
        loops = [step("E", "E"), *[step("E", "E"), step("E", "op"), step("op", "S", "success")][::turned]]
        states, w = searched(spark, loops, {k: v for k, v in KINDS.items() if k != "submit"}, visits=1)
        assert w.count() == 1 and behavior.telemetry(states).first().visit_prunes == 2 and behavior.truncation_details(states).count() == 2
    states, w = searched(spark, [step("ed", "save"), step("save", "op"), step("op", "ed", "success")], {"ed": "screen", "save": "action", "op": "operation"})
    assert [r.nodes for r in w.collect()] == [["ed", "save", "op", "ed"]]
    detour = [step("E", "home", nav=True), step("home", "E", nav=True), *line]
    states, w = searched(spark, detour, KINDS | {"home": "screen"})
    assert [r.actions for r in w.collect()] == [["submit"]]
    assert [(r.node, r.edge) for r in behavior.edge_slices(w).orderBy("pos").collect()][-1] == ("S", None)
    assert searched(spark, [step("E", "op"), step("op", "S", "error")], KINDS)[1].count() == 0
    assert searched(spark, line, KINDS, reference="another")[1].count() == 0  # no operation of the family


def test_guards_of_the_search(spark):
    line = [step("E", "submit"), step("submit", "op"), step("op", "S", "success")]
    w = searched(spark, line, KINDS, structural=True)[1].first()
    assert (w.feasibility, w.condition) == ("conditional", "structural-entry:E")
    ranges = [step("E", "submit", guards=["age >= 18"]), step("submit", "op", guards=["age < 18"]), step("op", "S", "success")]
    assert searched(spark, ranges, KINDS)[1].count() == 0
    either = [step("E", "submit", guards=["mode === 'A' || mode === 'B'"]), step("submit", "op", guards=["mode !== 'A' || vip"]), step("op", "S", "success")]
    got = {(r.condition, tuple(r.assignments), r.feasibility) for r in searched(spark, either, KINDS)[1].collect()}
    assert got == {("mode = A and vip = true", ("mode=A", "vip=true"), "satisfiable"), ("mode = B and mode != A", ("mode=B",), "satisfiable"), ("mode = B and vip = true", ("mode=B", "vip=true"), "satisfiable")}
    skipped = [step("E", "details"), step("details", "review"), step("E", "review"), step("review", "submit"), step("submit", "op", needs=["code"]), step("op", "S", "success")]
    got = {tuple(r.nodes[:2]): r.feasibility for r in searched(spark, skipped, KINDS | {"details": "screen", "review": "screen"}, fields={"details": ["code"]})[1].collect()}
    assert got == {("E", "details"): "satisfiable", ("E", "review"): "conditional"}


def test_shapes_and_receivers(spark):
    shapes = spark.createDataFrame([("r1", "body", "partial", ["a"], False), ("r2", None, "exact", ["b"], False), ("r3", "body", "exact", ["c"], True)], "request string, reference string, certainty string, fields array<string>, ambiguous boolean")
    env = spark.createDataFrame([("r1", "body", "exact", ["x", "y"]), ("r3", "body", "exact", ["z"])], "request string, name string, certainty string, fields array<string>")
    assert {r.request: (r.certainty, r.fields) for r in catalog.resolved_shape(shapes, env).collect()} == {"r1": ("exact", ["x", "y"]), "r2": ("exact", ["b"]), "r3": ("unknown", [])}
    calls = spark.createDataFrame([(1, "Service", "run", 1), (2, "Service", "run", 2), (3, "Other", "go", 0)], "call int, receiver_type string, method string, arity int")
    declared = spark.createDataFrame([("A.java", "ServiceImpl", ["Service"], "run", 1), ("B.java", "X", ["Other"], "go", 0), ("C.java", "Y", ["Other"], "go", 0)], "file string, type string, implements array<string>, method string, arity int")
    assert {r.call: (r.file, r.match) for r in catalog.receiver_types(calls, declared).collect()} == {1: ("A.java", "unique"), 2: (None, "missing"), 3: (None, "ambiguous")}
    assert spark.range(1).select(catalog.command_name(F.lit("createOrderRequest"), F.lit("Order"))).first()[0] == "order.create"
    assert spark.range(1).select(catalog.command_name(F.lit("handleOrder"), F.lit("Order"))).first()[0] == "order.handle"
    assert spark.range(1).select(catalog.command_name(F.lit("order"), F.lit("Order"))).first()[0] == "order.execute"
