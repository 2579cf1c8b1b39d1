import pytest
from pyspark.sql import functions as F

from waypath.functions import constraints as C
from waypath.functions import ids
from waypath.functions import predicates as P
from waypath.operators import graph, joins, sequences
from waypath.sources import artifacts, extract, imports, snapshot


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


@pytest.mark.parametrize(
    ("expr", "status", "assignments"),
    [
        ("applicationType === 'JOINT' && canSubmit", "satisfiable", "applicationType=string:JOINT; canSubmit=boolean:true"),
        ("applicationType === 'JOINT' && applicationType === 'PERSONAL'", "unsatisfiable", ""),
        ("isEligible(user) === true", "conditional", ""),
        ("age + bonus >= 18", "conditional", ""),
        ('answers[index] === "YES"', "conditional", ""),
        ("mode === 'A' || (mode === 'B' && enabled)", "satisfiable", "mode=string:A"),
        ("mode !== 'A' && mode === 'A'", "unsatisfiable", ""),
        ("amount > 5 && amount < 3", "unsatisfiable", ""),
        ("amount >= 5 && amount < 5", "unsatisfiable", ""),
        ("amount >= 5 && amount <= 5 && amount != 5", "unsatisfiable", ""),
        ("age >= 18 && age < 65", "satisfiable", "age=number:18.0"),
        ("score > 5 && score < 6", "satisfiable", "score=number:5.5"),
        ("balance <= 0", "satisfiable", "balance=number:0.0"),
        ("canSubmit && !submitting", "satisfiable", "canSubmit=boolean:true; submitting=boolean:false"),
        ("flag != true && flag === false", "satisfiable", "flag=boolean:false"),
        ("true", "satisfiable", ""),
        ("!true", "unsatisfiable", ""),
    ],
)
def test_predicates(spark, expr, status, assignments):
    df = spark.createDataFrame([("p", expr)], "id string, e string")
    r = P.solve(P.literals(df, "id", "e")).first()
    assert (r.status, r.assignments) == (status, assignments)
    found = P.models(P.parse(expr))  # the solver of one expression says the same
    assert P.status_of(P.parse(expr)) == status
    best = next((v for _, s, v in found if s == status), {})
    assert set(best) == {x.split("=")[0] for x in assignments.split("; ") if x}


def test_predicate_limit_and_labels():
    wide = " && ".join(f"(a{i} || b{i})" for i in range(6))
    assert P.branches(P.parse(wide)) == [[{"kind": "opaque", "text": "more alternatives than the limit"}]]
    assert P.label(P.parse("a === 'x' && !b")) == "a = x and not (b = true)"
    assert P.label(P.parse("f(a || b) || 'c||d' === x || y?.z == \"it's\"")) == "f(a || b) or 'c||d' === x or y.z = it's"
    assert P.parse("") == P.parse("  ") == P.parse(None) == P.parse("(())") == P.TRUE
    assert P.parse("((a) && (b || (c)))") == P.parse("a && (b || c)")
    for odd in ("(a", "a)", "f(]", "items.some(x => x > 3)", "a === b", "3 < a", "'\\'' + b"):
        assert P.parse(odd) == {"kind": "opaque", "text": odd}
    assert P.parse("name === 'O\\'Hara (x)'")["value"] == "O'Hara (x)"
    assert P.parse("!a === true") == {"kind": "not", "item": P.parse("a === true")}
    assert P.canonical(P.parse("true")) == '{"kind":"true"}'


def test_names(spark):
    assert one(spark, ids.slug(F.lit("submitOrder NOW!"))) == "submit-order-now"
    assert one(spark, ids.slug(F.lit("  "))) == "unnamed"
    assert one(spark, ids.normal_template(F.lit("/a//:id/{x}/?q=1"))) == "/a/{param}/{param}"
    assert one(spark, ids.route_matches(F.lit("/applications/{response.id}/confirmation"), F.lit("/applications/:id/confirmation")))
    assert not one(spark, ids.route_matches(F.lit("/applications/review"), F.lit("/applications/:id/confirmation")))
    assert one(spark, ids.command_words(F.lit("submitOrder"))) == "Submit order"
    assert one(spark, ids.entity_stem(F.lit("CategoriesEntity"))) == "category"
    assert one(spark, ids.join_route(F.lit("/a/"), F.lit("b"))) == "/a/b"
    assert one(spark, ids.leaf_name(F.lit("a.b.c"))) == "c"
    assert one(spark, ids.gherkin_string(F.lit('say "x"'))) == '"say \\"x\\""'


GRAPHS = {  # edges (src, dst, outcome, operation, nav_only), seeds, success, depth, visits, paths by state
    "shared success": ([("E", "out", "neutral", 0, 0), ("E", "submit", "neutral", 0, 0), ("submit", "op", "neutral", 0, 0), ("op", "out", "success", 1, 0)], "E", "out", 10, 2, {"witness": 1}),
    "entry is success": ([("ed", "save", "neutral", 0, 0), ("save", "op", "neutral", 0, 0), ("op", "ed", "success", 1, 0)], "ed", "ed", 10, 2, {"witness": 1}),
    "detour": ([("E", "home", "neutral", 0, 1), ("home", "E", "neutral", 0, 1), ("E", "submit", "neutral", 0, 0), ("submit", "op", "neutral", 0, 0), ("op", "S", "success", 1, 0)], "E", "S", 10, 2, {"witness": 1}),
    "depth": ([("E", "submit", "neutral", 0, 0), ("submit", "op", "neutral", 0, 0), ("op", "S", "success", 1, 0)], "E", "S", 3, 2, {"depth": 1}),
    "visit": ([("E", "E", "neutral", 0, 0), ("E", "E", "neutral", 0, 0), ("E", "op", "neutral", 0, 0), ("op", "S", "success", 1, 0)], "E", "S", 10, 1, {"visit": 2, "witness": 1}),
}


@pytest.mark.parametrize("name", sorted(GRAPHS))
@pytest.mark.parametrize("turned", [False, True])
def test_paths(spark, name, turned):
    edges, seed, goal, depth, visits, want = GRAPHS[name]
    rows = [("f", f"e{i}", a, b, o, bool(op), bool(nav), None) for i, (a, b, o, op, nav) in enumerate(edges)]
    e = spark.createDataFrame(rows[::-1] if turned else rows, "family string, edge string, src string, dst string, outcome string, operation boolean, nav_only boolean, guard string")
    node = lambda n: spark.createDataFrame([("f", n)], "family string, node string")
    got = graph.bounded_paths(node(seed), e, node(goal), depth, visits).groupBy("state").count().collect()
    assert {r.state: r["count"] for r in got} == want


def test_paths_with_guards(spark):
    rows = [("f", "1", "E", "a", "neutral", False, False, "t=A"), ("f", "2", "a", "op", "neutral", False, False, "t=B"), ("f", "3", "E", "op", "neutral", False, False, "t=B"), ("f", "4", "op", "S", "success", True, False, None)]
    e = spark.createDataFrame(rows, "family string, edge string, src string, dst string, outcome string, operation boolean, nav_only boolean, guard string")
    node = lambda n: spark.createDataFrame([("f", n)], "family string, node string")
    got = graph.bounded_paths(node("E"), e, node("S")).collect()
    assert [(r.nodes, r.guards, r.state) for r in got] == [(["E", "op", "S"], ["t=B"], "witness")]


def test_closure_and_neighbourhood(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 5)], "src int, dst int")
    s = spark.createDataFrame([(1, 1), (4, 4)], "origin int, node int")
    assert sorted(map(tuple, graph.closure(s, e).collect())) == [(1, 1), (1, 2), (1, 3), (4, 4), (4, 5)]
    assert len(graph.neighbourhood(s, e, 2, 2).collect()) == 4
    chain = spark.createDataFrame([(i, i + 1) for i in range(80)], "src int, dst int")
    assert graph.closure(spark.createDataFrame([(0, 0)], "origin int, node int"), chain).count() == 81


def test_synthesised_values(spark):
    rows = [("code", "1", "required", None, None, None), ("code", "2", "minLength", 3.0, None, None), ("mail", "3", "format", None, "email", None), ("age", "4", "min", 17.5, None, None), ("age", "5", "type", None, "integer", None), ("odd", "6", "opaque", None, None, None), ("kind", "7", "enum", None, None, ["B", "A"]), ("none", "8", "max", -1.0, None, None), ("flag", "9", "type", None, "boolean", None)]
    rules = spark.createDataFrame(rows, "field string, id string, kind string, num_value double, str_value string, arr_value array<string>")
    got = {r.field: r.value for r in C.synthesised(rules, "field").collect()}
    assert got == {"code": "AAA", "mail": "test@example.com", "age": "18", "odd": None, "kind": "B", "none": None, "flag": "true"}
    fields = spark.createDataFrame([("kind", ["A", "B"], None), ("code", ["AB", "ABC"], None), ("mail", ["a@b.c"], "x")], "field string, options array<string>, assigned string")
    assert {r.field: r.value for r in C.option_values(fields, rules, "field").collect()} == {"kind": "B", "code": "ABC", "mail": None}


def test_template_join(spark):
    routes = spark.createDataFrame([("/a/1/c",), ("/a/b/c",), ("/x",), ("/f/doc-7",), ("/",), ("/a/{id}/c",)], "route string")
    t = spark.createDataFrame([("/a/:id/c", 1), ("/a/b/:z", 2), ("/a/b/c", 3), ("/f/doc-:n", 4), ("/", 5), ("/:q/:r/:s", 0)], "template string, n int")
    got = {r.route: r.matched for r in joins.template_join(routes, t, "route", "template", "n").collect()}
    assert got == {"/a/1/c": "/{param}/{param}/{param}", "/a/b/c": "/a/b/c", "/x": None, "/f/doc-7": "/f/doc-{param}", "/": "/", "/a/{id}/c": "/a/{param}/c"}


def test_joins(spark):
    left = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id int, k string")
    right = spark.createDataFrame([("a", 10), ("b", 20), ("b", 21)], "k string, v int")
    got = {r.id: (r.v, r.match) for r in joins.unique_join(left, right, ["k"], ["v"]).collect()}
    assert got == {1: (10, "unique"), 2: (None, "ambiguous"), 3: (None, "missing")}
    base = spark.createDataFrame([(1, "x"), (2, "y")], "id int, v string")
    new = spark.createDataFrame([(2, "z"), (3, "w")], "id int, v string")
    assert sorted(map(tuple, joins.merged(base, new, ["id"]).collect())) == [(1, "x"), (2, "z"), (3, "w")]


def test_constraints(spark):
    check = lambda v, k, n=None, s=None, a=None: one(spark, C.check_value(F.lit(v).cast("string"), F.lit(k), F.lit(n).cast("double"), F.lit(s).cast("string"), F.array(*map(F.lit, a)) if a else F.lit(None).cast("array<string>")))
    assert check("a@b.co", "format", s="email") == "valid"
    assert check("a@", "format", s="email") == "invalid"
    assert check("", "required") == "invalid"
    assert check(None, "min", 3) == "valid"
    assert check("x", "min", 3) == "invalid"
    assert check("ab", "pattern", s="(?=a)b") == "conditional"
    assert check("ab", "pattern", s="[a-c]+") == "valid"
    assert check("3.0", "type", s="integer") == "valid"
    rules = spark.createDataFrame([("f", "1", "enum", None, None, ["a", "b"]), ("f", "2", "enum", None, None, ["c"]), ("g", "3", "minLength", 3.0, None, None), ("g", "4", "maxLength", 5.0, None, None)], "field string, id string, kind string, num_value double, str_value string, arr_value array<string>")
    assert {r.field: r.status for r in C.consistency(rules, "field").collect()} == {"f": "inconsistent", "g": "consistent"}
    assert one(spark, C.sensitive(F.lit("user.apiKey"))) and not one(spark, C.sensitive(F.lit("shippingCity")))
    for name, kind in (("login.pwd", "secret-reference"), ("a.pin", "secret-reference"), ("spinner", "synthetic-constrained"), ("primaryApplicantId", "existing-entity"), ("taxNumber", "existing-entity"), ("phoneNumber", "synthetic-constrained"), ("productCode", "runtime-option"), ("x[otp]", "secret-reference")):
        assert one(spark, C.field_class(F.lit(name), F.lit(None).cast("string"), F.lit(None).cast("boolean"), F.lit(None).cast("boolean"))) == kind, name
    assert one(spark, C.strategies(F.lit("secret-reference"))) == "corporate-secret-store"
    issue = lambda *x: one(spark, C.modality_issue(*[F.lit(v).cast("string") for v in x]))
    assert issue("secret-reference", "x", None) == "secret-reference-required" and issue("authenticated-identity", None, "vault://a/b") is None
    assert issue("flow-literal", None, "vault://a") == "value-required" and issue("flow-literal", "x", None) is None
    assert issue("secret-reference", None, "http://a") == "reference-not-approved" and issue("secret-reference", None, "plain") == "reference-not-approved"
    arn = "arn:aws:secretsmanager:eu-west-1:123456789012:secret:x"
    assert not one(spark, C.approved_reference(F.lit(arn), ["vault"])) and one(spark, C.approved_reference(F.lit(arn), ["vault"], True))
    use = lambda *x: one(spark, C.usable(*map(F.lit, x)))
    assert use("actor-session", False, False) and use("screen-state", True, False) and not use("field", True, False) and use("action", True, True)


def test_steps(spark):
    s = spark.createDataFrame([("w", i, v) for i, v in enumerate("abab")], "w string, pos int, v string")
    assert sequences.revisits(s, ["w"], ["pos"], "v").count() == 2
    assert [r.phase for r in sequences.phases(s, ["w"], ["pos"]).orderBy("pos").collect()] == ["entry", "intermediate", "intermediate", "success"]


def test_artifacts(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "id int, v string")
    path = str(tmp_path / "t")
    meta = artifacts.write(df, path, "facts", "test", {"source": "sha256:1"})
    assert meta["rows"] == 2 and artifacts.read(spark, path, "facts", "test").count() == 2
    assert artifacts.is_stale(spark, path, {"source": "sha256:2"}) == ["source"]
    with pytest.raises(artifacts.IntegrityError):
        artifacts.read(spark, path, "other")
    df.limit(1).write.mode("overwrite").parquet(f"{path}/data")
    with pytest.raises(artifacts.IntegrityError, match="data"):
        artifacts.read(spark, path, "facts")


def test_sources(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src/A.java").write_text('@RequestMapping("/api/orders")\nclass A {\n @PreAuthorize("hasAuthority(\'ORDER_CREATE\')")\n @PostMapping("/{id}")\n void f() { orderRepository.save(x); }\n @NotNull @Size(min = 3, max = 12) private String code;\n}')
    (tmp_path / "src/p.tsx").write_text('<Route path="/new" element={<NewPage />} />; fetch(`/api/orders/${id}`, { method: "POST" }); <a href="/home">x</a>; navigate("/done"); <input name="code" required maxLength={12} />')
    (tmp_path / "src/w.md").write_text("# Order\ntext\nAliases: Purchase, Buy\n\n## Empty\n")
    files = snapshot.snapshot(spark, [str(tmp_path / "src")])
    assert files.count() == 3
    assert snapshot.total_digest(files.select("path", "digest")).first().files == 3
    gone = spark.createDataFrame([("file:/none",)], "path string")
    assert snapshot.with_expected(files, gone).count() == 4
    assert [tuple(r)[2:] for r in extract.endpoints(files).collect()] == [("POST", "/api/orders/{id}")]
    assert extract.authorizations(files).first().authorities == ["ORDER_CREATE"]
    assert sorted((r.field, r.kind, r.value) for r in extract.field_rules(files).collect()) == [("code", "maxLength", "12"), ("code", "minLength", "3"), ("code", "required", None)]
    assert extract.effects(files).first().entity == "Order"
    assert [(r.route, r.component) for r in extract.routes(files).collect()] == [("/new", "NewPage")]
    assert [r.match for r in extract.handled_by(extract.http_calls(files), extract.endpoints(files)).collect()] == ["unique"]
    assert sorted(r.target for r in extract.navigations(files).collect()) == ["/done", "/home"]
    f = extract.fields(files).first()
    assert (f.name, f.required, f.max_length) == ("code", True, 12)
    wiki = {r.title: r.aliases for r in imports.import_wiki(files.where("language = 'markdown'")).collect()}
    assert wiki == {"Order": ["Purchase", "Buy"], "Empty": []}
    (tmp_path / "g.json").write_text('{"vertices": [{"key": "a", "type": "Endpoint"}, {"id": "b"}], "links": [{"from": "a", "to": "b", "relation": "calls"}, {"from": "a", "to": "z"}]}')
    nodes, edges = imports.import_graph(spark, str(tmp_path / "g.json"))
    assert {(r.id, r.kind) for r in nodes.collect()} == {("a", "java-endpoint"), ("b", "concept")}
    assert [tuple(r) for r in edges.collect()] == [("a", "b", "calls")]


def test_streams(spark, tmp_path):
    import time

    from waypath.streaming.observations import checked_order

    spark.createDataFrame([("r", 0, "a"), ("r", 2, "c"), ("r", 1, "b"), ("q", 1, "z")], "run_id string, sequence long, target string").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("run_id string, sequence long, target string").parquet(str(tmp_path / "in"))
    q = checked_order(stream).writeStream.format("memory").queryName("checked").option("checkpointLocation", str(tmp_path / "c")).start()
    until = time.monotonic() + 60
    try:  # state with timeouts always has a batch to come, so the stream neither ends nor idles
        while time.monotonic() < until and spark.table("checked").count() < 4:
            time.sleep(0.5)
    finally:
        q.stop()
    got = sorted((r.run_id, r.sequence, r.status) for r in spark.table("checked").collect())
    assert got == [("q", 1, "out-of-order"), ("r", 0, "accepted"), ("r", 1, "accepted"), ("r", 2, "accepted")]
