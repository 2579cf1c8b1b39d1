"""Java sources, configuration and lifecycle on small cases."""

import io
import json

import pytest
from pyspark.sql import functions as F

from waypath.functions import predicates as P
from waypath.operators import lifecycle
from waypath.sources import config, java

CONTROLLER = '''
package a; // class Fake { public void no() { } }
@RestController
class OrderController {
  private final OrderService orders; private final JpaRepository<Order, Long> store;
  /* public int hidden() { return 1; } */
  @PostMapping(value = "/x{y}", params = {"a", "b"})
  @PreAuthorize("hasAuthority('ORDER_CREATE') and hasRole('CLERK')")
  public ResponseEntity<Order> create(
      @Valid @RequestBody(required = true) final CreateOrderRequest request,
      Map<String, List<Integer>> extra) throws IOException, Bad {
    if (request.getAmount() <= 0) throw new Bad("if (x) { ; }");
    if (request.getStatus() == Status.CLOSED) { throw new Bad("closed"); }
    Order order = new Order();
    orders.place(order, List.of(1, 2), "a,b(c");
    store.save(order);
    return ok;
  }
  public void odd(@RequestBody @Validated(Big.class) X x) { for (int i = 0; i < 3; i++) { go(); } }
  public Token login(@Valid @RequestBody Login login, BindingResult errors) { String token = jwt.createToken(login); return ResponseEntity.ok(token); }
  protected <T> int generic(T... values) { return checkAll(values); }
}
'''
SERVICE = "interface OrderService { void place(Order o, List<Integer> n, String s); }"
IMPL = "class Impl<T> extends Base implements Other<T>, OrderService { private Audit audit; public void place(Order o, List<Integer> n, String s) { audit.log(o); } }"
AUDIT = "class Audit { public void log(Order o) { if (o == null) { return; } } public void log(Order o, int n) { } }"


def test_methods():
    found = {m.name: m for m in java.methods(CONTROLLER)}
    assert list(found) == ["create", "odd", "login", "generic"]
    m = found["create"]
    assert (m.returns, len(m.parameters), [n for n, *_ in m.marks], m.line) == ("ResponseEntity<Order>", 2, ["PostMapping", "PreAuthorize"], 9)
    assert m.binding == ("CreateOrderRequest", "active", "validated") and found["odd"].binding == ("X", "conditional", "validation-groups")
    assert found["login"].binding == ("Login", "conditional", "errors-taken-by-BindingResult") and found["generic"].binding == (None, "inactive", "no-body")
    assert P.label(java.domain_guard(m)) == "not (amount <= 0) and not (status = CLOSED)"
    assert java.domain_guard(found["odd"])["text"] == "odd:19:for" and java.domain_guard(found["generic"])["text"].endswith("checkAll(")
    assert list(java.receiver_calls(m))[-2:] == [("orders", "place", 3), ("store", "save", 1)]
    code = java.code_only(CONTROLLER)
    assert java.receiver_type(code, "orders") == "OrderService" and java.entity_of(code, m, "order", "store") == "Order"
    assert java.effect(code, m, "POST", "Order") == ("entity-created", "Order", None) and java.effect(code, found["odd"], "PUT", "X") == ("unknown-mutation", "X", None)
    assert java.effect(code, found["login"], "POST", "Login") == ("authentication-session-issued", "Token", None) and java.effect(code, found["generic"], "GET", "X") is None
    assert java.authorization(json.loads(m.marks[1][1])) == ("certain", ["ORDER_CREATE", "ROLE_CLERK"]) and java.authorization("hasRole('A') or isMine()")[0] == "conditional"
    assert java.authorization("permitAll()") == ("anonymous", []) and java.authorization("isAuthenticated()") == ("authenticated", [])


def test_texts():
    assert java.decode(r"a\n\"b\"A\\") == 'a\n"b"A\\'
    assert java.code_only('x = "a//b"; // c\n/* d */ y') == "x =       ;     \n        y" or java.code_only('x = "a//b"; // c\n/* d */ y').split() == ["x", "=", ";", "y"]
    assert java.without_comments('"a//b" // c') == '"a//b"     '
    assert java.arguments("a, b(c, d), Map<K, V> e, \",\", ") == ["a", "b(c, d)", "Map<K, V> e", '","']
    assert java.infer_entity("CreateOrderRequest", "XController", "/a") == "CreateOrder" and java.infer_entity("OrderCreateRequest", "XController", "/a") == "Order"
    assert java.infer_entity(None, "OrderController", "/a") == "Order" and java.infer_entity("Body", "Api", "/orders/{id}") == "orders"
    assert java.same_entity("OrderEntity", "orders") and not java.same_entity("Address", "Addres")
    assert java.guard_text("Objects.isNull(request.a) || this.x.equals('B')") == "(request.a === null) || (x === 'B')" and java.guard_text("request.getA() == Kind.B_C") == 'request.a == "B_C"'


def test_calls(spark):
    files = spark.createDataFrame([("c", CONTROLLER), ("s", SERVICE), ("i", IMPL), ("a", AUDIT), ("n", None)], "path string, content string")
    assert {tuple(r) for r in java.call_edges(files).collect()} == {("c:create/2", "i:place/3"), ("i:place/3", "a:log/1")}
    seeds = spark.createDataFrame([("c:create/2",)], "node string")
    got = {(r.node, r.level) for r in java.delegated(seeds, java.call_edges(files)).collect()}
    assert got == {("i:place/3", 1), ("a:log/1", 2)} and java.delegated(seeds, java.call_edges(files), most=1).count() == 1
    facts = {r.method: r for r in java.method_facts(files).where("path = 'c'").collect()}
    assert facts["create"].guard == "not (amount <= 0) and not (status = CLOSED)" and facts["create"].arity == 2


def test_config(spark, tmp_path):
    settings = {"version": 1, "project": {"root": "."}, "output": {"directory": "out"}, "runtime": {"url": "x"}}
    (tmp_path / "p.json").write_text(json.dumps(settings))
    got = config.load_config(str(tmp_path / "p.json"))
    assert got["output_root"] == str(tmp_path.resolve() / "out")
    other = config.config_digests(settings | {"runtime": {"url": "y"}})
    assert (other["analysis"], other["data"]) == (got["digests"]["analysis"], got["digests"]["data"]) and other["runtime"] != got["digests"]["runtime"]
    with pytest.raises(ValueError, match="outside"):
        config.inside(tmp_path, "../x")
    (tmp_path / "link").symlink_to("/tmp")
    with pytest.raises(ValueError, match="link"):
        config.inside(tmp_path, "link/x")
    with pytest.raises(ValueError, match="file name"):
        config.segment("a/b")
    assert config.read_bindings(spark, tmp_path, "b.json").count() == 0
    config.write_bindings(tmp_path, "b.json", {"r2": {"value": 3, "resolver": "manual-binding", "verified": True}, "r1": {"secret_ref": "vault://x", "value": None}})
    assert {r.requirement: (r.value, r.value_type, r.secret_ref, r.verified) for r in config.read_bindings(spark, tmp_path, "b.json").collect()} == {"r1": (None, "null", "vault://x", None), "r2": ("3", "number", None, True)}
    assert [config.scalar(x) for x in ("null", "true", "12", "1.5", "012", "x")] == [None, True, 12, 1.5, "012", "x"]
    to = io.StringIO()
    say = config.Progress(to)
    say("start", files=3)
    say("end")
    assert [json.loads(x) for x in to.getvalue().splitlines()] == [{"sequence": 1, "event": "start", "files": 3}, {"sequence": 2, "event": "end"}]
    checks = lifecycle.check_project(str(tmp_path), ["p.json", "gone"], ["link/x"], {"url": None})
    assert [(c, ok, need) for c, ok, need, _ in checks] == [("path:p.json", True, True), ("path:gone", False, True), ("path:link/x", False, False), ("setting:url", False, False)]
    assert lifecycle.envelope("x", {"a": 1})["agent"]["mode"] == "continue" and lifecycle.envelope("x", code="BAD")["agent"]["mode"] == "repair"
    assert lifecycle.envelope("x", {}, next_actions=[{"id": "b", "blocking": True, "executor": "human"}])["agent"] | {"result_digest": None} == {"mode": "stop", "action": "b", "resume": "guide", "result_digest": None}


def test_manifest(spark):
    f = spark.createDataFrame
    paths = f([("r", 0, "screen", "E", False), ("r", 1, "action", "go", False), ("r", 2, "operation", "op", False), ("r", 3, "screen", "S", True), ("q", 0, "screen", "E", False), ("q", 1, "action", "go", False)], "run string, pos int, kind string, node string, success boolean")
    fields = f([("r", "E", "f1", 0, "textbox", None, "d1"), ("r", "E", "f2", 1, "slider", "read-only", None), ("r", "S", "f3", 0, "textbox", None, None), ("q", "E", "f1", 0, "slider", "conditional", "d9")], "run string, screen string, field string, ordinal int, control string, mode string, requirement string")
    sessions, values = f([("r", "a")], "run string, actor string"), f([("d1", "sha256:1")], "requirement string, binding_digest string")
    adapters = f([("web", ["screen-state", "action", "actor-session"], None), ("fill", ["field"], ["textbox"])], "adapter string, kinds array<string>, controls array<string>")
    steps = lifecycle.manifest_steps(paths, fields, sessions, values, adapters)
    got = [(r.run, r.sequence, r.kind, r.target, r.phase, r.issue) for r in steps.orderBy("run", "sequence").collect()]
    assert got == [
        ("q", 1, "screen-state", "E", "entry", "no-success-screen"), ("q", 2, "field", "f1", None, "input-mode-conditional"), ("q", 3, "action", "go", None, None),
        ("r", 1, "actor-session", "a", None, None), ("r", 2, "screen-state", "E", "entry", None), ("r", 3, "field", "f1", None, None), ("r", 4, "action", "go", None, None), ("r", 5, "screen-state", "S", "success", None),
    ]
    made = f([("a", 1, True), ("a", 3, False), ("a", 2, True)], "k string, created int, ok boolean")
    assert [tuple(r) for r in lifecycle.newest_valid(made, ["k"], F.col("ok"), "created").collect()] == [("a", 2, True)]


def test_repair(spark):
    f = spark.createDataFrame
    gaps = f([("g", "flow-family", ["n1"]), ("h", "behavior-variant", ["x"])], "gap string, missing_stage string, seeds array<string>")
    edges, nodes = f([("n1", "n2"), ("n3", "n2"), ("n4", "n3")], "src string, dst string"), f([("n1", True), ("n2", False), ("n3", True), ("n4", True)], "node string, has_source boolean")
    found = f([("d1", "A", "g", []), ("d2", "B", None, ["n3"]), ("d3", "C", None, ["n4"])], "diagnostic string, code string, scope string, refs array<string>")
    hints = f([("g", "b", 2, "call", "x", 1), ("g", "a", 1, "call", "y", 2), ("g", "b", 2, "call", "x", 1)], "gap string, file string, line int, kind string, excerpt string, score int")
    got = {r.gap: r for r in lifecycle.repair_plan(gaps, edges, nodes, found, hints).collect()}
    assert (got["g"].evidence, got["g"].hints, got["g"].diagnostics) == (["n1", "n3"], ["a:1:y", "b:2:x"], ["d1", "d2"]) and (got["h"].evidence, got["h"].hints, got["h"].diagnostics) == ([], [], [])
