"""Queries of reviews, sources and the smaller operators on the driver's tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from waypath.functions import constraints as C
from waypath.functions import ids
from waypath.operators import coverage, graph, joins, review, sequences
from waypath.plans import example
from waypath.plans.flows import joined, pick
from waypath.plans.queries import query, table
from waypath.sources import extract, imports, jsx, snapshot


@query("SELECT * FROM (VALUES ('application.submit.joint', 'satisfiable', 1, 'type,joint,done'), ('application.submit.personal', 'satisfiable', 1, 'type,personal,done')) t(variant, feasibility, witnesses, pages)")
def project_flows(spark, d):
    """The golden project; it reads no table."""
    v = example.built(example.project(spark))["variants"]
    return v.select("variant", "feasibility", F.size("witnesses").alias("witnesses"), joined("pages"))


@query("SELECT * FROM (VALUES ('covered', 'application.submit', 'included', 2, 2)) t(status, family, inclusion, witnesses, variants)")
def project_coverage(spark, d):
    c = example.built(example.project(spark))["coverage"]
    return c.select("status", "family", "inclusion", *[F.col(n).cast("int").alias(n) for n in ("witnesses", "variants")])


EVIDENCE = {
    "source-file": "documents", "wiki-concept": "benchmark", "route": "pages", "component": "region", "handler": "nation", "action": "events", "field": "part", "http-operation": "customer", "java-endpoint": "orders",
    "validation": "supplier", "permission": "labels", "effect": "lineitem", "navigation": "conversations", "imported": "embeddings",
}


@query(" UNION ALL ".join(f"SELECT '{k}' AS kind, count(*) AS n FROM {t}" for k, t in EVIDENCE.items()))
def evidence_kinds(spark, d):
    parts = []
    for kind, name in EVIDENCE.items():
        df = table(spark, d, name)
        key = F.xxhash64(*[F.col(c) for c in df.columns[:2]])
        parts.append((kind, df, key, F.lit(kind)))
    return coverage.count_by(coverage.facts(*parts), "kind")


RULE_KINDS = ("required", "minLength", "maxLength", "min", "max", "enum", "type", "format", "pattern")


@query(
    """WITH x AS (SELECT p_partkey % 9 AS k, p_size AS n, CASE p_partkey % 6 WHEN 0 THEN '' WHEN 1 THEN 'a@b.co' WHEN 2 THEN '30' WHEN 3 THEN '30.5' WHEN 4 THEN p_type ELSE NULL END AS v FROM part)
SELECT kind, status, count(*) AS n FROM (SELECT CASE k WHEN 0 THEN 'required' WHEN 1 THEN 'minLength' WHEN 2 THEN 'maxLength' WHEN 3 THEN 'min' WHEN 4 THEN 'max' WHEN 5 THEN 'enum' WHEN 6 THEN 'type' WHEN 7 THEN 'format' ELSE 'pattern' END AS kind,
CASE WHEN k = 0 THEN CASE WHEN coalesce(v, '') = '' THEN 'invalid' ELSE 'valid' END WHEN coalesce(v, '') = '' THEN 'valid' WHEN k = 1 THEN CASE WHEN length(v) >= n THEN 'valid' ELSE 'invalid' END WHEN k = 2 THEN CASE WHEN length(v) <= n THEN 'valid' ELSE 'invalid' END
WHEN k = 3 THEN CASE WHEN coalesce(TRY_CAST(v AS DOUBLE) >= n, FALSE) THEN 'valid' ELSE 'invalid' END WHEN k = 4 THEN CASE WHEN coalesce(TRY_CAST(v AS DOUBLE) <= n, FALSE) THEN 'valid' ELSE 'invalid' END WHEN k = 5 THEN CASE WHEN v IN ('30', 'STEEL') THEN 'valid' ELSE 'invalid' END
WHEN k = 6 THEN CASE WHEN v = '30' THEN 'valid' ELSE 'invalid' END WHEN k = 7 THEN CASE WHEN v = 'a@b.co' THEN 'valid' ELSE 'invalid' END WHEN n > 25 THEN 'conditional' WHEN regexp_full_match(v, '[0-9.]+') THEN 'valid' ELSE 'invalid' END AS status FROM x) GROUP BY ALL"""
)
def constraint_kinds(spark, d):
    k, n, key = F.col("p_partkey") % 9, F.col("p_size").cast("double"), F.col("p_partkey") % 6
    value = F.when(key == 0, "").when(key == 1, "a@b.co").when(key == 2, "30").when(key == 3, "30.5").when(key == 4, F.col("p_type"))
    text = F.when(k == 6, "integer").when(k == 7, "email").when(k == 8, F.when(n > 25, "(?=x)[0-9.]+").otherwise("[0-9.]+"))
    kind = pick(k, *RULE_KINDS)
    status = C.check_value(value, kind, n, text, F.array(F.lit("30"), F.lit("STEEL")))
    return coverage.count_by(table(spark, d, "part").select(kind.alias("kind"), status.alias("status")), "kind", "status")


@query(
    """WITH n AS (SELECT p_brand, count(*) AS n FROM part WHERE p_size > 20 GROUP BY p_brand), c AS (SELECT p_brand, item FROM (SELECT p_brand, p_partkey, unnest([p_type, 'x' || p_size % 3]) AS item FROM part WHERE p_size > 20) JOIN n USING (p_brand) GROUP BY p_brand, item, n HAVING count(DISTINCT p_partkey) = n),
g AS (SELECT p_brand, bool_or(p_size = 3) AS required, min(CASE WHEN p_size < 8 THEN p_size - 3 END) AS long, bool_or(p_size = 9) AS pattern, bool_or(p_size > 20) AS lists FROM part GROUP BY p_brand)
SELECT p_brand, CASE WHEN (required AND coalesce(long < 1, FALSE)) OR (lists AND NOT EXISTS (SELECT 1 FROM c WHERE c.p_brand = g.p_brand)) THEN 'inconsistent' WHEN pattern THEN 'conditional' ELSE 'consistent' END AS status FROM g"""
)
def constraint_sets(spark, d):
    size = F.col("p_size")
    none = F.lit(None).cast("array<string>")
    rule = lambda kind, num=None, arr=none, text=None: F.struct(F.lit(kind).alias("kind"), (F.lit(None) if num is None else num).cast("double").alias("num_value"), F.lit(text).cast("string").alias("str_value"), arr.alias("arr_value"))
    options = F.array("p_type", F.concat(F.lit("x"), (size % 3).cast("string")))
    rules = F.array(F.when(size == 3, rule("required")), F.when(size < 8, rule("maxLength", size - 3)), F.when(size == 9, rule("pattern", text="a+")), F.when(size > 20, rule("enum", arr=options)), rule("other"))
    x = table(spark, d, "part").select("p_brand", F.col("p_partkey").cast("string").alias("id"), F.explode(F.filter(rules, lambda r: r.isNotNull())).alias("r")).select("p_brand", "id", "r.*")
    return C.consistency(x, "p_brand")


@query("SELECT l_orderkey, count(DISTINCT l_partkey) AS calls, count(DISTINCT CASE WHEN p_partkey IS NULL THEN l_partkey END) AS unknown FROM lineitem LEFT JOIN (SELECT * FROM part WHERE p_size < 30) ON p_partkey = l_partkey GROUP BY l_orderkey")
def handler_calls(spark, d):
    handlers = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_partkey").alias("http"))
    known = table(spark, d, "part").where("p_size < 30").select(F.col("p_partkey").alias("h"), F.lit(True).alias("known"))
    each = handlers.select("l_orderkey", F.explode("http").alias("h")).join(known, "h", "left")
    return each.groupBy("l_orderkey").agg(F.count("*").alias("calls"), F.count_if(F.col("known").isNull()).alias("unknown"))


@query(
    """WITH a AS (SELECT o_custkey, list_sort(list(o_orderpriority)) AS p, list_sort(list(DISTINCT o_orderpriority)) AS s FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey), b AS (SELECT o_custkey, list_sort(list(DISTINCT o_orderpriority)) AS s FROM orders WHERE o_orderstatus <> 'F' GROUP BY o_custkey)
SELECT a.o_custkey, array_to_string(list_sort(list_intersect(a.s, b.s)), ',') AS common, a.p = b.s AND len(a.p) = len(a.s) AS same FROM a JOIN b USING (o_custkey)"""
)
def set_comparisons(spark, d):
    o = table(spark, d, "orders")
    a = o.where("o_orderstatus = 'F'").groupBy("o_custkey").agg(F.collect_list("o_orderpriority").alias("a"))
    b = o.where("o_orderstatus <> 'F'").groupBy("o_custkey").agg(F.collect_set("o_orderpriority").alias("b"))
    return a.join(b, "o_custkey").select("o_custkey", F.array_join(F.sort_array(F.array_intersect("a", "b")), ",").alias("common"), joins.same_set(F.col("a"), F.col("b")).alias("same"))


@query(
    """SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN '/x/' || p_size WHEN p_partkey % 3 = 1 THEN '/api/v1/' || p_type || '/{id}' ELSE '/api/v1/' || p_size END AS http, CASE WHEN p_partkey % 2 = 0 THEN '/' || p_type ELSE '/top/' || p_type END AS route,
length(p_name) <= 12 AND NOT contains(p_name, ' ') AS safe, CASE p_partkey % 4 WHEN 0 THEN p_type WHEN 1 THEN 'Stock' ELSE 'items' END AS entity, CASE WHEN p_partkey % 2 = 0 THEN '{"v":' || p_size || '}' ELSE '{"v":"' || p_type || '"}' END AS scalar FROM part"""
)
def route_functions(spark, d):
    k, size = F.col("p_partkey"), F.col("p_size").cast("string")
    path = F.when(k % 3 == 0, F.concat(F.lit("https://host//x/"), size, F.lit("?q=1"))).when(k % 3 == 1, F.concat("p_type", F.lit("/${id}#top"))).otherwise(F.concat(F.lit("/api/v1/"), size))
    child = F.when(k % 2 == 0, F.concat(F.lit("/"), "p_type")).otherwise(F.col("p_type"))
    request = F.when(k % 4 == 0, F.concat("p_type", F.lit("CreateRequest"))).otherwise("Body")
    controller = F.when(k % 4 == 1, "StockController").otherwise("Api")
    name = F.when(F.length("p_name") > 12, F.lit("a/b")).otherwise(F.col("p_name"))
    return table(spark, d, "part").select(
        "p_partkey", ids.http_path(path, F.lit("api/v1/")).alias("http"), ids.join_route(F.lit("/top/"), child).alias("route"), ids.safe_segment(name).alias("safe"),
        ids.infer_entity(request, controller, F.lit("/shop/items/{id}")).alias("entity"), ids.scalar_value(F.when(k % 2 == 0, size).otherwise(F.col("p_type"))).alias("scalar"),
    )


@query("SELECT event_id, CASE WHEN lag(value > 50) OVER w THEN lag(event_type) OVER w END AS previous FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def previous_calls(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id", "ts", "event_type", "value")
    return sequences.previous(e, ["user_id"], ["ts", "event_id"], "event_type", F.col("value") > 50).select("event_id", "previous")


@query(
    """WITH a AS (SELECT conv_id, list(role ORDER BY turn) AS r FROM conversations GROUP BY conv_id), b AS (SELECT conv_id, list(CASE WHEN turn % 2 = 0 THEN 'user' ELSE 'assistant' END ORDER BY turn) AS r FROM conversations WHERE conv_id % 4 <> 0 GROUP BY conv_id)
SELECT conv_id, coalesce(a.r = b.r, FALSE) AS same FROM a FULL JOIN b USING (conv_id)"""
)
def same_sequences(spark, d):
    c = table(spark, d, "conversations").select("conv_id", "turn", "role")
    other = c.where("conv_id % 4 <> 0").withColumn("role", F.when(F.col("turn") % 2 == 0, "user").otherwise("assistant"))
    return sequences.same_sequence(c, other, ["conv_id"], ["turn"], "role")


@query(
    """WITH RECURSIVE e AS (SELECT s_suppkey AS parent, unnest([s_suppkey // 2, s_suppkey % 7]) AS child, CASE WHEN s_nationkey % 2 = 0 THEN 'n' || s_nationkey END AS guard FROM supplier WHERE s_suppkey > 0),
r(root, node, path, guards, state) AS (SELECT s_suppkey, s_suppkey, [s_suppkey], CAST([] AS VARCHAR[]), 'rendered' FROM supplier UNION ALL
SELECT root, child, list_append(path, child), CASE WHEN guard IS NULL THEN guards ELSE list_append(guards, guard) END, CASE WHEN list_contains(path, child) THEN 'cycle' WHEN len(path) > 4 THEN 'depth' ELSE 'rendered' END FROM r JOIN e ON parent = node WHERE state = 'rendered')
SELECT root, array_to_string(path, '>') AS path, array_to_string(guards, '&') AS guards, state FROM r"""
)
def render_composition(spark, d):
    s, n = F.col("s_suppkey"), F.col("s_nationkey")
    t = table(spark, d, "supplier")
    children = t.where("s_suppkey > 0").select(s.alias("parent"), F.explode(F.array(F.expr("s_suppkey div 2"), s % 7)).alias("child"), F.when(n % 2 == 0, F.concat(F.lit("n"), n.cast("string"))).alias("guard"))
    out = graph.render_tree(t.select(s.alias("root")), children, max_depth=4)
    return out.select("root", F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("path"), joined("guards", "&"), "state")


# --- TSX, Java and other sources ------------------------------------------------------------------------------------


@query(
    """WITH x AS (SELECT CASE WHEN s_nationkey % 2 = 0 THEN 'pages/f' ELSE 'f' END || s_nationkey AS file, 'C' || s_suppkey || CASE s_suppkey % 3 WHEN 0 THEN 'Page' ELSE '' END AS component, s_acctbal > 9000 AS routed, s_acctbal > 2000 AS exported, s_nationkey % 2 = 0 AS folder, s_suppkey % 3 = 0 AS named FROM supplier),
n AS (SELECT file, count(*) FILTER (routed) AS r, count(*) FILTER (exported AND named) AS en, count(*) FILTER (exported) AS e, count(*) FILTER (named) AS nn, count(*) AS a FROM x GROUP BY file)
SELECT DISTINCT file, CASE WHEN rule <> 'unresolved' THEN component END AS component, rule FROM (SELECT file, component, CASE WHEN r > 0 THEN CASE WHEN routed THEN 'routed' END WHEN NOT folder AND nn = 0 THEN NULL WHEN en > 0 THEN CASE WHEN exported AND named THEN 'exported-name' END WHEN folder AND e = 1 THEN CASE WHEN exported THEN 'only-export' END
WHEN nn = 1 THEN CASE WHEN named THEN 'only-name' END WHEN folder AND a = 1 THEN 'only-one' ELSE 'unresolved' END AS rule FROM x JOIN n USING (file)) WHERE rule IS NOT NULL"""
)
def page_components(spark, d):
    s, n = F.col("s_suppkey"), F.col("s_nationkey")
    x = table(spark, d, "supplier").select(F.concat(F.when(n % 2 == 0, "pages/f").otherwise("f"), n.cast("string")).alias("file"), F.concat(F.lit("C"), s.cast("string"), F.when(s % 3 == 0, "Page").otherwise("")).alias("component"), (F.col("s_acctbal") > 9000).alias("routed"), (F.col("s_acctbal") > 2000).alias("exported"))
    return extract.page_choice(x)


def tsx_of_parts(spark, d):
    """A page's source for each part."""
    k, n = F.col("p_partkey"), F.col("p_size").cast("string")
    text = F.concat(
        F.lit("export function P() {\n  // <button>no</button>\n  return (<Form>\n  {kind === '"), "p_type", F.lit("' && (<input name=\"code\" value={form.code}"), F.when(k % 2 == 0, " onChange={set}").otherwise(" readOnly"), F.lit(" required={size > "), n,
        F.lit("} />)}\n  {ready ? <button onClick={() => send(form)}"), F.when(k % 3 == 0, " disabled={busy}").otherwise(""), F.lit(">Send "), n, F.lit("</button> : <Spinner"), n, F.lit(" />}\n  {items.map((i) => <Row key={i} />)}\n  </Form>);\n}\n"),
    )
    return table(spark, d, "part").select(k.cast("string").alias("path"), text.alias("content"))


@query("SELECT p_partkey, 'Send ' || p_size AS name, 'send' AS handler, 'ready' AS visible, CASE WHEN p_partkey % 3 = 0 THEN '!(busy)' ELSE '' END AS enabled FROM part")
def tsx_actions(spark, d):
    a = jsx.action_facts(tsx_of_parts(spark, d))
    return a.select(F.col("path").cast("long").alias("p_partkey"), "name", "handler", F.array_join("visible_when", "&").alias("visible"), F.array_join("enabled_when", "&").alias("enabled"))


@query("SELECT p_partkey, 'code' AS name, 'form.code' AS binding, p_partkey % 2 = 0 AS writable, 'size > ' || p_size AS required, 'kind === ''' || p_type || '''' AS visible FROM part")
def tsx_fields(spark, d):
    f = jsx.field_facts(tsx_of_parts(spark, d))
    return f.select(F.col("path").cast("long").alias("p_partkey"), "name", "binding", "writable", F.array_join("required_when", "&").alias("required"), F.array_join("visible_when", "&").alias("visible"))


@query("SELECT p_partkey, 'Spinner' || p_size AS child FROM part WHERE p_size % 5 <> 0")
def child_components(spark, d):
    uses = jsx.child_facts(tsx_of_parts(spark, d)).select(F.col("path").cast("long").alias("page"), "child")
    known = spark.createDataFrame([("Row",), *[(f"Spinner{i}",) for i in range(0, 100, 5)]], "component string")
    out = extract.unresolved_children(uses, known, spark.createDataFrame([("Form",)], "child string"))
    return out.select(F.col("page").alias("p_partkey"), "child")


@query(
    """SELECT certainty, fields, count(*) AS n FROM (SELECT CASE p_partkey % 3 WHEN 0 THEN 'exact' WHEN 1 THEN 'partial' ELSE 'unknown' END AS certainty, CASE WHEN p_partkey % 3 = 2 THEN '' ELSE 'a:path:a,kind:literal:' || p_type || ',n:literal:' || p_size || ',x:path:form.x.y,z:other:' END AS fields FROM part) GROUP BY ALL"""
)
def tsx_payloads(spark, d):
    k = F.col("p_partkey") % 3
    body = F.concat(F.lit("JSON.stringify({ a, 'kind': '"), "p_type", F.lit("', n: "), F.col("p_size").cast("string"), F.lit(", x: form?.x.y, z: g(1, 2) }"), F.lit(")"))
    text = F.when(k == 0, body).when(k == 1, F.concat(F.lit("{ ...rest, "), F.substring(body, 18, 10_000), F.lit(""))).otherwise("form")
    shapes = jsx.payload_facts(table(spark, d, "part").select(F.when(k == 1, F.regexp_replace(text, r"\)$", "")).otherwise(text).alias("body")), "body")
    listed = F.array_join(F.transform("fields", lambda f: F.concat_ws(":", f["name"], f["kind"], F.coalesce(f["value"], F.lit("")))), ",")
    return coverage.count_by(shapes.select("certainty", listed.alias("fields")), "certainty", "fields")


@query("SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN '/a' WHEN 1 THEN CASE WHEN p_size < 10 THEN '/c' || p_size END END AS value FROM part")
def constant_values(spark, d):
    p, k = table(spark, d, "part"), F.col("p_partkey") % 3
    name = F.concat(F.lit("C"), F.col("p_size").cast("string"))
    texts = p.select("p_partkey", F.when(k == 0, "'/a'").when(k == 1, name).otherwise(F.lit("f(x)")).alias("t"))
    constants = spark.createDataFrame([*[(f"C{i}", f"/c{i}") for i in range(20)], *[(f"C{i}", "/other") for i in range(10, 20)]], "name string, value string")
    return extract.with_constants(texts, "t", constants).select("p_partkey", "value")


def clients_of_parts(spark, d):
    """A client module's source for each part."""
    k, n = F.col("p_partkey"), F.col("p_size").cast("string")
    text = F.concat(
        F.lit("export async function save(form, extra) {\n  // await no();\n  "), F.when(k % 2 == 0, "if (form.ok) { log(form); }\n  ").otherwise(""), F.lit("const r = await api.put(`/x/"), n, F.lit("`, { a: [1, 2] }, form.b);\n  "),
        F.when(k % 3 == 0, "audit();\n  ").otherwise(""), F.lit("navigate(`/done/${r.id}"), n, F.lit("`);\n"), F.when(k % 5 == 0, "  if (r) { return 1; }\n  tail();\n").otherwise(""), F.lit("}\n"),
    )
    return table(spark, d, "part").select(k.cast("string").alias("path"), text.alias("content"))


@query(
    """SELECT p_partkey, 'api.put' AS callee, 3 AS arguments, TRUE AS awaited, '' AS guards, p_partkey % 5 <> 0 AS completes FROM part UNION ALL SELECT p_partkey, 'navigate', 1, FALSE, '', p_partkey % 5 <> 0 FROM part
UNION ALL SELECT p_partkey, 'log', 1, FALSE, 'form.ok', p_partkey % 5 <> 0 FROM part WHERE p_partkey % 2 = 0 UNION ALL SELECT p_partkey, 'audit', 0, FALSE, '', p_partkey % 5 <> 0 FROM part WHERE p_partkey % 3 = 0 UNION ALL SELECT p_partkey, 'tail', 0, FALSE, '', FALSE FROM part WHERE p_partkey % 5 = 0"""
)
def tsx_calls(spark, d):
    f = jsx.function_facts(clients_of_parts(spark, d))
    return f.select(F.col("path").cast("long").alias("p_partkey"), "callee", F.size("arguments").alias("arguments"), "awaited", joined("guards", "&"), "completes")


@query("SELECT p_partkey, 'api.put' AS after, '/done/{r.id}' || p_size AS target FROM part WHERE p_partkey % 3 <> 0")
def tsx_continuations(spark, d):
    return jsx.continuation_facts(clients_of_parts(spark, d)).select(F.col("path").cast("long").alias("p_partkey"), "after", "target")


@query(
    """WITH RECURSIVE r AS (SELECT c_custkey AS route, CASE WHEN c_custkey >= 4 THEN c_custkey // 4 END AS parent, CASE c_custkey % 5 WHEN 0 THEN NULL WHEN 1 THEN '/abs' || c_custkey ELSE 's' || c_custkey END AS path FROM customer WHERE c_custkey > 0),
f(route, full_path) AS (SELECT route, CASE WHEN path IS NULL THEN '/' WHEN path LIKE '/%' THEN path ELSE '/' || path END FROM r WHERE parent IS NULL UNION ALL
SELECT r.route, CASE WHEN path IS NULL THEN full_path WHEN path LIKE '/%' THEN path ELSE replace(full_path || '/' || path, '//', '/') END FROM f JOIN r ON r.parent = f.route) SELECT route, full_path FROM f"""
)
def nested_routes(spark, d):
    k = F.col("c_custkey")
    text = k.cast("string")
    path = F.when(k % 5 == 0, F.lit(None)).when(k % 5 == 1, F.concat(F.lit("/abs"), text)).otherwise(F.concat(F.lit("s"), text))
    routes = table(spark, d, "customer").where("c_custkey > 0").select(k.alias("route"), F.when(k >= 4, F.expr("c_custkey div 4")).alias("parent"), path.alias("path"), F.lit("C").alias("component"))
    return extract.composed_routes(routes).select("route", F.col("full").alias("full_path"))


def controllers_of_parts(spark, d):
    """A controller's source for each part."""
    k = F.col("p_partkey")
    rule = F.when(k % 3 == 0, "hasAuthority('A') and hasRole('B')").when(k % 3 == 1, "hasRole('B') or isMine()").otherwise("hasAuthority('C')")
    text = F.concat(
        F.lit('@RequestMapping("/api/'), F.lower("p_type"), F.lit('")\nclass C {\n  @PreAuthorize("'), rule, F.lit('")\n  @PutMapping("/{id}")\n  void f() { partRepository.save(x); }\n  @NotNull @Size(min = '), F.col("p_size").cast("string"), F.lit(") private String code;\n}"),
    )
    return table(spark, d, "part").select(k.cast("string").alias("path"), F.lit("java").alias("language"), text.alias("content"))


@query("SELECT p_partkey, 'PUT' AS method, '/api/' || lower(p_type) || '/{id}' AS template, CASE p_partkey % 3 WHEN 0 THEN 'A,B' WHEN 1 THEN 'B' ELSE 'C' END AS authorities, CASE WHEN p_partkey % 3 = 1 THEN 'conditional' ELSE 'certain' END AS status, 'Part' AS entity, 'state-changed' AS effect, p_size AS min_length FROM part")
def java_endpoints(spark, d):
    files = controllers_of_parts(spark, d)
    rules = extract.field_rules(files).where("kind = 'minLength'").select("path", F.col("value").cast("int").alias("min_length"))
    x = extract.endpoints(files).join(extract.authorizations(files).drop("ordinal"), "path").join(extract.effects(files).select("path", "entity", F.col("kind").alias("effect")), "path").join(rules, "path")
    return x.select(F.col("path").cast("long").alias("p_partkey"), "method", "template", joined("authorities"), "status", "entity", "effect", "min_length")


@query("SELECT p_partkey, 'Part ' || p_partkey AS title, CASE WHEN p_size % 6 < 4 THEN p_type || ',' || p_brand ELSE '' END AS aliases FROM part")
def wiki_concepts(spark, d):
    gap = F.repeat(F.lit("text\n"), (F.col("p_size") % 6).cast("int"))
    text = F.concat(F.lit("# Part "), F.col("p_partkey").cast("string"), F.lit("\n"), gap, F.lit("Aliases: "), "p_type", F.lit(" , "), "p_brand", F.lit("\n"))
    w = imports.import_wiki(table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("path"), text.alias("content")))
    return w.select(F.col("path").cast("long").alias("p_partkey"), "title", joined("aliases"))


@query(
    """WITH f AS (SELECT doc_id, doc_id || '.md' AS path, 'sha256:' || sha256(coalesce(text, '')) AS digest FROM documents WHERE doc_id % 5 <> 0), g AS (SELECT doc_id || '.md' AS path, 'sha256:' || sha256('<missing>') AS digest FROM documents WHERE doc_id % 5 = 0)
SELECT substr(path, -4, 1) AS last, count(*) AS n, count(DISTINCT digest) AS contents FROM (SELECT path, digest FROM f UNION ALL SELECT path, digest FROM g) GROUP BY last"""
)
def snapshot_inputs(spark, d):
    docs = table(spark, d, "documents").select(F.concat(F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), ids.digest(F.coalesce("text", F.lit(""))).alias("digest"), "doc_id")
    files = snapshot.with_expected(docs.where("doc_id % 5 <> 0"), docs.select("path"))
    return files.groupBy(F.substring("path", -4, 1).alias("last")).agg(F.count("*").alias("n"), F.count_distinct("digest").alias("contents"))


@query("SELECT event_id, '{\"k\":' || regexp_extract(props, '([0-9]+)', 1) || '}' AS props FROM events")
def canonical_payloads(spark, d):
    return table(spark, d, "events").select("event_id", ids.canonical_json(F.col("props")).alias("props"))


@query("SELECT CASE WHEN k LIKE '%route%' THEN 'route' WHEN k LIKE '%component%' OR k LIKE '%class%' THEN 'component' WHEN k LIKE '%endpoint%' THEN 'java-endpoint' ELSE 'concept' END AS kind, count(*) AS n FROM (SELECT CASE p_partkey % 5 WHEN 0 THEN 'apiroute' WHEN 1 THEN 'uicomponent' WHEN 2 THEN 'javaclass' WHEN 3 THEN 'endpoint' ELSE lower(p_type) END AS k FROM part) GROUP BY kind")
def imported_kinds(spark, d):
    text = F.coalesce(pick(F.col("p_partkey") % 5, "ApiRoute", "UiComponent", "JavaClass", "Endpoint", None), F.col("p_type"))
    return coverage.count_by(table(spark, d, "part").select(imports.kind_of(text, imports.NODE_KINDS, imports.OTHER_NODE).alias("kind")), "kind")


# --- reviews --------------------------------------------------------------------------------------------------------


@query(
    """WITH e AS (SELECT s_suppkey AS endpoint, s_nationkey % 2 = 0 AS a, s_acctbal < 0 AS g, 'R' || s_nationkey AS name FROM supplier), v AS (SELECT DISTINCT l_suppkey AS endpoint, l_shipmode AS path FROM (SELECT l_suppkey, CASE WHEN l_quantity > 25 THEN 'a.x' ELSE 'b.' || l_returnflag END AS l_shipmode FROM lineitem)),
l AS (SELECT endpoint, split_part(path, '.', 2) AS leaf, count(*) AS n FROM v GROUP BY ALL), p AS (SELECT endpoint, string_agg(DISTINCT path, ',' ORDER BY path) AS paths FROM (SELECT * FROM v UNION ALL SELECT endpoint, leaf FROM l WHERE n = 1) GROUP BY endpoint)
SELECT endpoint AS s_suppkey, concat_ws(',', CASE WHEN a THEN 'authorization' END, CASE WHEN g THEN 'success-predicate' END) AS kinds, coalesce(paths, '') AS paths, CASE WHEN a THEN name ELSE '' END AS allowed FROM e LEFT JOIN p USING (endpoint) WHERE a OR g"""
)
def rule_packets(spark, d):
    n = F.col("s_nationkey")
    ends = table(spark, d, "supplier").select(F.col("s_suppkey").alias("endpoint"), F.when(n % 2 == 0, "conditional").otherwise("certain").alias("access"), F.when(n % 2 == 0, F.concat(F.lit("hasRole('R"), n.cast("string"), F.lit("') or x"))).alias("access_text"), F.when(F.col("s_acctbal") < 0, "conditional").otherwise("satisfiable").alias("guard_status"))
    path = F.when(F.col("l_quantity") > 25, "a.x").otherwise(F.concat(F.lit("b."), "l_returnflag"))
    rules = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("endpoint"), path.alias("path"), F.lit("required").alias("kind"), F.lit(None).cast("double").alias("num_value"), F.lit(None).cast("array<string>").alias("arr_value"))
    return review.rule_gaps(ends, rules).select(F.col("endpoint").alias("s_suppkey"), joined("kinds"), joined("paths"), joined("allowed"))


@query(
    """WITH a AS (SELECT o_custkey, arg_max(o_orderstatus, struct_pack(t := o_orderdate, k := o_orderkey)) AS digest FROM orders GROUP BY o_custkey), ok AS (SELECT o_custkey FROM a WHERE digest = 'F')
SELECT c_custkey, CASE WHEN ok.o_custkey IS NOT NULL THEN 'Reviewed ' || c_custkey ELSE c_name END AS label, CASE WHEN ok.o_custkey IS NOT NULL THEN 'human-reviewed' ELSE 'deterministic' END AS origin FROM customer LEFT JOIN ok ON ok.o_custkey = c_custkey"""
)
def approved_names(spark, d):
    approvals = table(spark, d, "orders").select(F.col("o_custkey").alias("packet"), F.col("o_orderstatus").alias("digest"), F.struct("o_orderdate", "o_orderkey").alias("approved_at"))
    c = table(spark, d, "customer")
    now = review.current_approvals(approvals, c.select(F.col("c_custkey").alias("packet"), F.lit("F").alias("digest")))
    decided = now.select(F.col("packet").alias("operation"), F.concat(F.lit("Reviewed "), F.col("packet").cast("string")).alias("label"))
    out = review.apply_names(c.select(F.col("c_custkey").alias("operation"), F.col("c_name").alias("label"), F.lit("deterministic").alias("origin")), decided)
    return out.withColumnRenamed("operation", "c_custkey")


@query(
    """WITH r AS (SELECT c_custkey AS k, c_nationkey AS v, CASE c_custkey % 3 WHEN 0 THEN 'generated' WHEN 1 THEN CASE WHEN c_mktsegment = 'BUILDING' THEN 'missing' WHEN c_acctbal < 0 THEN 'unverified' WHEN c_custkey % 7 = 0 THEN 'unverified' ELSE 'verified' END ELSE 'missing' END AS s FROM customer)
SELECT v AS variant, count(*) FILTER (s = 'generated') AS generated, count(*) FILTER (s = 'verified') AS verified, count(*) FILTER (s = 'unverified') AS unverified, count(*) FILTER (s = 'missing') AS missing, count(*) FILTER (s IN ('unverified', 'missing')) = 0 AS ready FROM r GROUP BY v"""
)
def data_verification(spark, d):
    c, key = table(spark, d, "customer"), F.col("c_custkey")
    name = key.cast("string").alias("requirement")
    needs = c.select(F.col("c_nationkey").alias("variant"), name, F.when(key % 3 == 0, "flow-literal").otherwise("existing-entity").alias("kind"), F.when(key % 3 == 0, "generated").otherwise("unresolved").alias("status"), F.lit("r").alias("representative"), F.array(F.lit("manual-binding")).alias("strategies"), F.when(key % 7 == 0, "new").otherwise("d").alias("digest"), F.lit(None).cast("string").alias("expected"))
    bound = c.where((key % 3 == 1) & (F.col("c_mktsegment") != "BUILDING")).select(name, F.lit("v").alias("value"), F.lit(None).cast("string").alias("secret_ref"), F.lit("manual-binding").alias("resolver"), F.lit("d").alias("requirement_digest"), (F.col("c_acctbal") >= 0).alias("verified"))
    return review.data_readiness(review.verify(needs, bound))


@query(
    """WITH s AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos, CASE event_type WHEN 'view' THEN 'Given' WHEN 'purchase' THEN 'Then' ELSE 'When' END AS w FROM events WHERE user_id % 3 <> 0),
k AS (SELECT *, CASE WHEN lag(w) OVER (PARTITION BY user_id ORDER BY pos) = w THEN 'And' ELSE w END AS keyword FROM s)
SELECT user_id, pos, keyword, CASE event_type WHEN 'view' THEN 'the user is on view' WHEN 'purchase' THEN 'the result is purchase' WHEN 'click' THEN 'the user chooses click' ELSE 'the system performs ' || event_type END AS text FROM k"""
)
def step_plan(spark, d):
    from pyspark.sql import Window

    e = table(spark, d, "events").select(F.col("user_id").alias("variant"), "ts", "event_id", "event_type")
    kind = F.when(F.col("event_type") == "view", "screen").when(F.col("event_type") == "purchase", "outcome").when(F.col("event_type") == "click", "action").otherwise("operation")
    steps = e.select("variant", F.row_number().over(Window.partitionBy("variant").orderBy("ts", "event_id")).cast("long").alias("pos"), kind.alias("kind"), F.col("event_type").alias("label"), F.col("event_id").cast("string").alias("ref"))
    variants = e.select("variant").distinct().select(F.lit("f").alias("family"), "variant", F.when(F.col("variant") % 3 != 0, "satisfiable").otherwise("conditional").alias("feasibility"))
    return review.step_plan(variants, steps)[0].select(F.col("variant").alias("user_id"), "pos", "keyword", "text")
