"""Reviews, TSX sources, page choice and render trees on small cases."""

from pyspark.sql import functions as F

from waypath.functions import ids
from waypath.operators import graph, review, sequences
from waypath.sources import extract, jsx

PAGE = '''
export function NewPage() {
  // <button>no</button>
  const small = a < b && c > d;
  return (
    <Form>
      {mode === 'JOINT' && (
        <input name="jointId" value={form.jointId} onChange={set} required={!optional} />
      )}
      {ready ? <button onClick={() => submit(form)} disabled={busy}>Send it</button> : <Spinner label="x" />}
      {items.map((i) => <Row key={i} />)}
      <input type="text" id="note" defaultValue={note} readOnly />
      <a href="/home" aria-label="Home">h</a>
      <button type="submit" disabled>Off</button>
    </Form>
  );
}
'''


def test_elements():
    found = {e.tag + str(e.line): e for e in jsx.elements(PAGE)}
    assert sorted({k.rstrip("0123456789") for k in found}) == ["Form", "Row", "Spinner", "a", "button", "input"]
    assert found["input8"].guards == ["mode === 'JOINT'"] and found["Spinner10"].guards == ["!(ready)"] and found["Row11"].guards == ["mapped:11"]
    a = {x[1]: x for x in jsx.actions(PAGE)}
    assert a["Send it"][2:] == ("submit", ["ready"], ["!(busy)"]) and a["Off"][4] == ["false"] and a["Home"][0] == "a"
    f = {x[1]: x for x in jsx.fields(PAGE)}
    assert f["jointId"][2:] == ("form.jointId", True, ["!optional"], ["mode === 'JOINT'"]) and f["note"][3] is False
    assert jsx.payload_shape("JSON.stringify({ a, 'b-c': form?.x.y, t: 'JOINT', n: 3, f: g(1, 2) })") == ("exact", [("a", "path", "a"), ("b-c", "path", "form.x.y"), ("t", "literal", "JOINT"), ("n", "literal", "3"), ("f", "other", None)])
    assert jsx.payload_shape("{ ...rest, a: 1 }") == ("partial", [("a", "literal", "1")]) and jsx.payload_shape("form") == ("unknown", []) and jsx.payload_shape(None) == ("unknown", [])


def test_functions():
    text = """
const api = axios.create({ timeout: 3, baseURL: '/v1' });
export const send = async (form: Form, { a }) => {
  try { await api.post('/x', { form }); } catch (e) { show(e); }
};
function plain() { if (ready) { go(1, [2, 3]); } }
export default async function create(input) {
  const r = await createOrder(input);
  navigate(`/orders/${r.id}`)
  later();
}
<select name="kind"><option value="A">a</option><option>B</option></select>
"""
    f = {x.name: x for x in jsx.functions(text)}
    assert sorted(f) == ["create", "plain", "send"] and f["send"].exported and not f["plain"].exported
    assert f["plain"].calls == [("go", ["1", "[2, 3]"], False, ["ready"])] and f["plain"].completes and not f["send"].completes
    assert f["create"].after == [("createOrder", "/orders/{r.id}")] and f["create"].parameters == ["input"] and [c[0] for c in f["create"].calls] == ["createOrder", "navigate", "later"]
    assert ("show", ["e"], False, ["control-flow:4"]) in f["send"].calls
    assert jsx.client_bases(text) == [("api", "/v1")] and jsx.options(text) == [("kind", ["A", "B"])]


def test_pages_and_children(spark):
    rows = [("a.tsx", "X", True, False), ("a.tsx", "Y", False, True), ("b.tsx", "OnePage", False, True), ("b.tsx", "Two", False, True), ("pages/c.tsx", "C", False, True), ("pages/c.tsx", "D", False, False), ("e.tsx", "ViewOnly", False, True), ("f.tsx", "F", False, True), ("pages/g.tsx", "G", False, False), ("pages/h.tsx", "H", False, False), ("pages/h.tsx", "I", False, False), ("k.tsx", "KView", False, False)]
    got = {(r.file, r.component, r.rule) for r in extract.page_choice(spark.createDataFrame(rows, "file string, component string, routed boolean, exported boolean")).collect()}
    assert got == {("a.tsx", "X", "routed"), ("b.tsx", "OnePage", "exported-name"), ("pages/c.tsx", "C", "only-export"), ("pages/g.tsx", "G", "only-one"), ("pages/h.tsx", None, "unresolved"), ("k.tsx", "KView", "only-name")}
    files = spark.createDataFrame([("p", PAGE), ("q", None)], "path string, content string")
    uses = jsx.child_facts(files).select(F.col("path").alias("page"), "child")
    known, native = spark.createDataFrame([("Row",)], "component string"), spark.createDataFrame([("Form",)], "child string")
    assert [tuple(r) for r in extract.unresolved_children(uses, known, native).collect()] == [("p", "Spinner")]
    texts = spark.createDataFrame([("'/a'",), ("BASE",), ("TWICE",), ("f(x)",)], "t string")
    consts = spark.createDataFrame([("BASE", "/b"), ("TWICE", "/c"), ("TWICE", "/d")], "name string, value string")
    assert {r.t: r.value for r in extract.with_constants(texts, "t", consts).collect()} == {"'/a'": "/a", "BASE": "/b", "TWICE": None, "f(x)": None}
    assert {r.name: r.handler for r in jsx.action_facts(files).collect()}["Send it"] == "submit" and jsx.field_facts(files).count() == 2


def test_render_tree(spark):
    e = spark.createDataFrame([("P", "A", "x"), ("A", "B", None), ("B", "A", None), ("B", "C", "y"), ("C", "D", None)], "parent string, child string, guard string")
    roots = spark.createDataFrame([("P",)], "root string")
    got = {(">".join(r.path), ",".join(r.guards), r.state) for r in graph.render_tree(roots, e, max_depth=3).collect()}
    assert got == {("P", "", "rendered"), ("P>A", "x", "rendered"), ("P>A>B", "x", "rendered"), ("P>A>B>A", "x", "cycle"), ("P>A>B>C", "x,y", "rendered"), ("P>A>B>C>D", "x,y", "depth")}
    wide = spark.createDataFrame([("P", f"c{i}", None) for i in range(5)], "parent string, child string, guard string")
    assert sorted(r.state for r in graph.render_tree(roots, wide, max_nodes=3).collect()) == ["limit", "limit", "limit", "rendered", "rendered", "rendered"]


def test_reviews(spark):
    f = spark.createDataFrame
    needs = f([("r1", "v", "flow-literal", "a.note", ["manual-binding"], "d1", None, "unresolved", None), ("r2", "v", "secret-reference", "a.pwd", ["manual-binding"], "d2", None, "unresolved", None), ("r3", "v", "synthetic-constrained", "x", ["constraint-generator"], "d3", None, "generated", "AAA"), ("r4", "v", "existing-entity", "a.otp", ["manual-binding"], "d4", "7", "unresolved", None)],
              "requirement string, variant string, kind string, path string, strategies array<string>, digest string, expected string, status string, representative string")
    none = f([], "requirement string, alias string, value string, secret_ref string, resolver string, requirement_digest string, verified boolean, reviewer string")
    asked = f([("r1", "n", "x", None, "manual-binding"), ("r2", "p", "raw", None, "manual-binding"), ("r4", "o", "7", None, "manual-binding"), ("r9", "?", "x", None, "manual-binding"), ("r3", "g", "x", None, "manual-binding")], "requirement string, alias string, value string, secret_ref string, resolver string")
    bound, judged = review.bind(none, asked, needs)
    assert {r.requirement: r.issue for r in judged.collect()} == {"r1": None, "r2": "secret-reference-required", "r4": "sensitive-value", "r9": "unknown-requirement", "r3": "strategy-not-allowed"}
    done = review.confirm(bound, f([("r1", "me", 1)], "requirement string, reviewer string, confirmed_at int"), needs)
    assert [(r.requirement, r.verified, r.reviewer) for r in done.collect()] == [("r1", True, "me")]
    seen = review.verify(needs, done)
    assert {r.requirement: (r.status, r.reason) for r in seen.collect()} == {"r1": ("verified", None), "r2": ("missing", None), "r3": ("generated", None), "r4": ("missing", None)}
    assert tuple(review.data_readiness(seen).first()) == ("v", 1, 1, 0, 2, False)
    changed = review.verify(needs.withColumn("digest", F.lit("new")), done)
    assert {r.requirement: (r.status, r.reason) for r in changed.collect()}["r1"] == ("unverified", "requirement-changed")


def test_packets(spark):
    f = spark.createDataFrame
    ends = f([("e", "conditional", "hasRole('A') or hasRole('B')", "conditional", None), ("g", "certain", None, "satisfiable", None)], "endpoint string, access string, access_text string, guard_status string, domain_guard string")
    rules = f([("e", "a.x", "enum", None, ["p", "q"]), ("e", "b.x", "min", 3.0, None), ("e", "a.y", "required", None, None)], "endpoint string, path string, kind string, num_value double, arr_value array<string>")
    gaps = review.packet_digest(review.rule_gaps(ends, rules))
    g = gaps.first()
    assert gaps.count() == 1 and (g.kinds, g.paths, g["values"], g.allowed) == (["authorization", "success-predicate"], ["a.x", "a.y", "b.x", "y"], ["3.0", "p", "q"], ["A", "B"])
    approvals = f([("e", "old", 1), ("e", g.digest, 2), ("x", "y", 1)], "packet string, digest string, approved_at int")
    assert review.current_approvals(approvals, gaps.select(F.col("endpoint").alias("packet"), "digest")).count() == 1
    e, p = review.apply_rules(ends, f([("e", "backend", "OLD"), ("g", "backend", "K")], "endpoint string, layer string, authority string"), f([("e", "exact", ["A"], "amount > 0")], "endpoint string, access string, authorities array<string>, predicate string"))
    assert {r.endpoint: (r.access, r.domain_guard) for r in e.collect()} == {"e": ("exact", "amount > 0"), "g": ("certain", None)} and {(r.endpoint, r.authority) for r in p.collect()} == {("e", "A"), ("g", "K")}
    ops = f([("o", "old", "deterministic"), ("q", "keep", "wiki")], "operation string, label string, origin string")
    assert {tuple(r) for r in review.apply_names(ops, f([("o", "New")], "operation string, label string")).collect()} == {("o", "New", "human-reviewed"), ("q", "keep", "wiki")}
    variants = f([("f", "v", "satisfiable"), ("f", "w", "conditional")], "family string, variant string, feasibility string")
    steps = f([("v", 0, "screen", "Start", "p"), ("v", 1, "action", "Send", "a"), ("v", 2, "operation", "Save", "o"), ("v", 3, "outcome", "Done", "x"), ("w", 0, "screen", "Start", "p")], "variant string, pos int, kind string, label string, ref string")
    plan, trace = review.step_plan(variants, steps)
    assert [f"{r.keyword} {r.text}" for r in plan.orderBy("pos").collect()] == ["Given the user is on Start", "When the user chooses Send", "And the system performs Save", "Then the result is Done"] and trace.first().steps == 4
    assert [r.file for r in review.obsolete_files(f([("a",), ("b",)], "file string"), f([("b",)], "file string")).collect()] == ["a"]


def test_paths_and_sequences(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first()[0]
    path = lambda p, b=None: one(ids.http_path(F.lit(p), F.lit(b).cast("string")))
    assert path("orders/${id}?x=1", "/api/") == "/api/orders/{id}" and path("/api/orders", "/api") == "/api/orders" and path("https://h/x//y?q", "/api") == "/x/y" and path("https://h") == "/" and path("/apix", "/api") == "/api/apix"
    assert one(ids.infer_entity(F.lit("OrderCreateRequest"), F.lit("C"), F.lit("/a"))) == "Order" and one(ids.infer_entity(F.lit(None).cast("string"), F.lit("Api"), F.lit("/orders/{id}"))) == "orders"
    assert one(ids.scalar_value(F.lit("12"))) == '{"v":12}' and one(ids.scalar_value(F.lit("a\"b"))) == '{"v":"a\\"b"}'
    s = spark.createDataFrame([(1, 0, "a", True), (1, 1, "b", False), (1, 2, "c", True)], "k int, pos int, v string, awaited boolean")
    assert [r.previous for r in sequences.previous(s, ["k"], ["pos"], "v", F.col("awaited")).orderBy("pos").collect()] == [None, "a", None]
    t = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (2, 0, "z")], "k int, pos int, v string")
    assert {r.k: r.same for r in sequences.same_sequence(s.select("k", "pos", "v"), t, ["k"], ["pos"], "v").collect()} == {1: False, 2: False}
    assert {r.k: r.same for r in sequences.same_sequence(t, t, ["k"], ["pos"], "v").collect()} == {1: True, 2: True}
