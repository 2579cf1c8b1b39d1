"""Small cases of the trace operators: nulls, ties, cycles and missing rows."""

from waypath.operators import traces


def test_guarded_walks_end_in_cycles(spark):
    e = spark.createDataFrame([("a", "b", "x=1"), ("b", "a", None), ("b", "c", None), ("b", "c", "y=2")], "src string, dst string, guard string")
    seeds = spark.createDataFrame([("a", "a"), ("z", "z")], "origin string, node string")
    got = sorted((r.origin, r.node, r.guards) for r in traces.guarded_walks(seeds, e).collect())
    assert got == [("a", "a", []), ("a", "b", ["x=1"]), ("a", "c", ["x=1"]), ("a", "c", ["x=1", "y=2"]), ("z", "z", [])]


def test_substitution_passes_values_on(spark):
    calls = spark.createDataFrame([("a", "b", {"p": "$q", "r": "lit"}), ("b", "c", {"s": "$p", "t": "$none"})], "caller string, callee string, arguments map<string,string>")
    seeds = spark.createDataFrame([("a", "a", {"q": "7"})], "origin string, node string, environment map<string,string>")
    got = {r.node: r.environment for r in traces.substituted_walks(seeds, calls).collect()}
    assert got == {"a": {"q": "7"}, "b": {"p": "7", "r": "lit"}, "c": {"s": "7", "t": None}}


def test_stale_lineage(spark):
    inputs = spark.createDataFrame([("b", "a", "1"), ("c", "b", "2"), ("d", "x", "9"), ("e", "a2", "3")], "artifact string, input string, expected string")
    now = spark.createDataFrame([("a", "changed"), ("b", "2"), ("a2", "3")], "input string, digest string")
    assert {tuple(r) for r in traces.stale_lineage(inputs, now).collect()} == {("b", 0), ("c", 1), ("d", 0)}


def test_missing_fields_and_entities(spark):
    needs = spark.createDataFrame([(1, 1, "f"), (1, 2, "f"), (1, 2, "g"), (2, 1, None)], "path int, pos int, field string")
    occurs = spark.createDataFrame([(1, 2, "f"), (1, 3, "g")], "path int, pos int, field string")
    got = {(r.path, r.pos): r.missing for r in traces.missing_before(needs, occurs).collect()}
    assert got == {(1, 1): ["f"], (1, 2): ["g"], (2, 1): []}
    paths = spark.createDataFrame([("selectedCustomer.status",), ("order.total",), ("customer",), (None,)], "path string")
    fields = spark.createDataFrame([("x", "form.customerId"), ("y", "orderKey"), ("z", "orderRef")], "field string, data_path string")
    assert {r.path: r.field for r in traces.entity_fields(paths, fields).collect()} == {"selectedCustomer.status": "x", "order.total": None, "customer": None, None: None}


def test_contracts_come_before_operations(spark):
    usage = spark.createDataFrame([("w", ["c"], ["o"]), ("v", [], ["o"]), ("u", None, None)], "witness string, contracts array<string>, operations array<string>")
    by_c = spark.createDataFrame([("c", "f", "min")], "contract string, field string, constraint string")
    by_o = spark.createDataFrame([("o", "f", "max")], "operation string, field string, constraint string")
    own = spark.createDataFrame([("w", "f", "min"), ("u", "f", "own")], "witness string, field string, constraint string")
    got = sorted(map(tuple, traces.scoped_constraints(usage, by_c, by_o, own).collect()))
    assert got == [("u", "f", "own"), ("v", "f", "max"), ("w", "f", "min")]


def test_sources_pages_proposals(spark):
    items = spark.createDataFrame([("i", "s1"), ("j", "s2")], "ref string, source string")
    ops = spark.createDataFrame([("o", ["i", "j", "none"]), ("i", ["j"])], "ref string, refs array<string>")
    asked = spark.createDataFrame([(1, "i"), (1, "i"), (2, "o"), (3, "?")], "id int, ref string")
    got = {tuple(r) for r in traces.traced_sources(asked, items, ops).collect()}
    assert got == {(1, "i", "s1", "item"), (2, "o", "s1", "operation"), (2, "o", "s2", "operation"), (3, "?", None, "unresolved")}
    pages = spark.createDataFrame([("p", ["/b", "/a"], None)], "page string, routes array<string>, completeness string")
    none = spark.createDataFrame([], "page string, field string, action string")
    assert tuple(traces.page_contracts(pages, none, none).first()) == ("p", ["/a", "/b"], [], [], "exact")
    gaps = spark.createDataFrame([("e", ["authorization"], ["A"])], "endpoint string, kinds array<string>, allowed array<string>")
    p = spark.createDataFrame([(1, "e", ["A"], None), (2, "e", ["A"], None), (3, "x", ["A"], None)], "proposal int, endpoint string, authorities array<string>, predicate string")
    assert {r.proposal: r.issue for r in traces.proposal_issues(p, gaps).collect()} == {1: "accepted", 2: "resolved-twice", 3: "endpoint-not-allowed"}
