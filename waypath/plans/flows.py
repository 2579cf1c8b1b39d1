"""Queries of the catalog, behaviour, lifecycle and Java operators on the driver's tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from waypath.functions import constraints as C
from waypath.functions import predicates as P
from waypath.operators import behavior, catalog, coverage, joins, lifecycle
from waypath.plans.queries import SLUG, TRANSITIONS, behavior_transitions, query, table
from waypath.sources import java


def joined(c: str, sign: str = ","):
    return F.array_join(c, sign).alias(c)


def pick(key, *values):
    """The value at key, an integer column."""
    return F.element_at(F.array(*map(F.lit, values)), (key + 1).cast("int"))


# --- operations and requests ----------------------------------------------------------------------------------------

METHOD = "CASE p_partkey % 5 WHEN 0 THEN 'GET' WHEN 1 THEN 'POST' WHEN 2 THEN 'put' WHEN 3 THEN 'DELETE' ELSE 'PATCH' END"


@query(
    f"""WITH p AS (SELECT *, upper({METHOD}) AS m, upper({METHOD}) || ':/api/' || lower(p_type) || '/' || p_size || CASE WHEN p_partkey % 2 = 0 THEN '/{{param}}' ELSE '' END AS key FROM part),
c AS (SELECT key, count(*) AS same, count(*) FILTER (p_size <= 25) AS clients FROM p GROUP BY key),
x AS (SELECT p.*, same, clients, p_partkey % 4 <> 0 AS lasting, p_partkey % 6 = 1 AND p_size <= 25 AS bound FROM p JOIN c USING (key))
SELECT p_partkey, 'part.' || CASE p_partkey % 3 WHEN 0 THEN 'create' WHEN 1 THEN 'update' ELSE 'prepare' END AS machine_name,
CASE p_partkey % 3 WHEN 0 THEN 'Create' WHEN 1 THEN 'Update' ELSE 'Prepare' END || CASE WHEN lasting THEN ' Piece' ELSE ' part' END AS label,
CASE WHEN m NOT IN ('POST', 'PUT', 'PATCH') OR NOT lasting THEN 'excluded' WHEN p_partkey % 17 = 0 OR p_partkey % 11 = 0 OR p_partkey % 13 = 0 OR p_partkey % 19 = 0 OR same > 1 OR clients = 0 OR (bound AND p_partkey % 12 <> 1) THEN 'review-required' ELSE 'included' END AS inclusion FROM x"""
)
def operation_inclusion(spark, d):
    p, key = table(spark, d, "part"), F.col("p_partkey")
    method = pick(key % 5, "GET", "POST", "put", "DELETE", "PATCH").alias("method")
    template = F.concat(F.lit("/api//"), F.lower("p_type"), F.lit("/"), F.col("p_size").cast("string"), F.when(key % 2 == 0, "/:id").otherwise("/")).alias("template")
    guard = F.when(key % 13 == 0, "isOk(part)").when(key % 7 == 0, "size > 3")
    ends = p.select(
        key.cast("string").alias("endpoint"), method, template, pick(key % 3, "createPartRequest", "updatePart", "preparePartHandler").alias("handler"), F.lit("PartController").alias("controller"),
        F.when(key % 11 == 0, "conditional").otherwise("anonymous").alias("access"), guard.alias("domain_guard"),
    )
    clients = p.where("p_size <= 25").select(key.cast("string").alias("http"), method, template)
    effects = p.where(key % 4 != 0).select(key.cast("string").alias("endpoint"), F.lit(0).alias("pos"), F.lit("e").alias("effect"), F.when(key % 17 == 0, "unknown-mutation").otherwise("state-changed").alias("kind"), F.lit("Part").alias("entity"))
    rules = p.where(key % 19 == 0).select(key.cast("string").alias("endpoint"), F.lit("opaque").alias("kind"))
    contracts = p.where(key % 6 == 1).select(F.concat(F.lit("c"), key.cast("string")).alias("contract"), key.cast("string").alias("endpoint"), key.cast("string").alias("http"), F.when(key % 12 == 1, "fields-present").otherwise("review-required").alias("status"))
    concepts = spark.createDataFrame([(1, "Piece", ["part", "parts"]), (2, "Other", ["Part"])], "ordinal int, label string, aliases array<string>")
    out = catalog.operation_catalog(ends, clients, effects, rules, contracts, concepts, ["post", "PUT", "PATCH"])
    return out.select(F.col("endpoint").cast("long").alias("p_partkey"), "machine_name", "label", "inclusion")


@query(
    f"""WITH a AS (SELECT c_custkey, c_nationkey % 4 AS k, CASE WHEN c_acctbal > 5000 THEN 'READ,ROLE_' || c_mktsegment WHEN c_acctbal > 0 THEN 'READ' ELSE '' END AS names FROM customer WHERE c_custkey % 9 <> 0),
s AS (SELECT c_custkey, k, CASE WHEN k = 0 THEN '' ELSE names END AS names, CASE WHEN k = 0 THEN 'conditional' WHEN names <> '' THEN names WHEN k = 1 THEN 'authenticated' ELSE 'anonymous' END AS said FROM a)
SELECT c_custkey, 'actor-requirement.' || substr({SLUG.format("(c_custkey || ':' || said)")}, 1, 72) || '.' || substr(sha256('actor-requirement:' || c_custkey || ':' || said), 1, 12) AS actor, CASE WHEN said = 'anonymous' THEN 'anonymous' ELSE 'required' END AS authentication,
names AS authorities, CASE WHEN names LIKE '%ROLE%' THEN split_part(names, ',', 2) ELSE '' END AS roles, CASE said WHEN 'conditional' THEN 'authenticated principal satisfying unresolved authorization' WHEN 'authenticated' THEN 'authenticated principal' WHEN 'anonymous' THEN 'anonymous principal'
ELSE 'principal with ' || replace(names, ',', ', ') END AS label, CASE WHEN k = 0 THEN 'review-required' ELSE 'included' END AS inclusion FROM s"""
)
def operation_actors(spark, d):
    c, key = table(spark, d, "customer"), F.col("c_custkey").cast("string")
    ops = c.select(key.alias("operation"), key.alias("endpoint"), F.when(F.col("c_custkey") % 9 == 0, "excluded").otherwise("included").alias("inclusion"))
    ends = c.select(key.alias("endpoint"), pick(F.col("c_nationkey") % 4, "conditional", "authenticated", "certain", "certain").alias("access"))
    rich = c.where("c_acctbal > 5000").select(key.alias("endpoint"), F.lit("backend").alias("layer"), F.concat(F.lit("ROLE_"), "c_mktsegment").alias("authority"))
    rules = rich.unionByName(c.where("c_acctbal > 0").select(key.alias("endpoint"), F.lit("backend").alias("layer"), F.lit("READ").alias("authority")))
    out = catalog.actors(ops, ends, rules.unionByName(rules.select(F.lit(None).cast("string").alias("endpoint"), F.lit("frontend").alias("layer"), "authority").distinct()))
    return out.select(F.col("operation").cast("long").alias("c_custkey"), "actor", "authentication", joined("authorities"), joined("roles"), "label", "inclusion")


VALIDATIONS = [("1-URGENT", "A", "required", None, None), ("1-URGENT", "A", "max", 25.0, None), ("1-URGENT", "N", "required", None, None), ("2-HIGH", "N", "required", None, None), ("2-HIGH", "N", "type", None, "number"), ("3-MEDIUM", "R", "required", None, None), ("4-NOT SPECIFIED", "A", "type", None, "integer"), ("4-NOT SPECIFIED", "A", "opaque", None, None)]


@query(
    """WITH v(endpoint, name, kind) AS (VALUES ('1-URGENT', 'A', 'required'), ('1-URGENT', 'N', 'required'), ('2-HIGH', 'N', 'required'), ('3-MEDIUM', 'R', 'required')), checked(endpoint, name) AS (VALUES ('1-URGENT', 'A'), ('1-URGENT', 'N'), ('2-HIGH', 'N'), ('3-MEDIUM', 'R'), ('4-NOT SPECIFIED', 'A')),
g AS (SELECT r, name, x.q AS q, x.s AS s FROM (SELECT l_orderkey AS r, l_returnflag AS name, min({'n': l_linenumber, 'q': l_quantity, 's': l_suppkey}) AS x FROM lineitem GROUP BY ALL)),
f AS (SELECT s_suppkey % 10 AS i, count(*) AS n, min('f' || s_suppkey) AS field FROM supplier WHERE s_acctbal > 0 AND s_suppkey < 30 GROUP BY i HAVING n = 1),
p AS (SELECT r, o_orderpriority AS endpoint, g.name, field, CASE WHEN g.name = 'A' THEN CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN CASE WHEN q <> floor(q) THEN 'invalid' ELSE 'unproven' END WHEN q > 25 THEN 'invalid' ELSE 'proven' END WHEN g.name = 'N' AND field IS NOT NULL AND o_orderpriority <> '2-HIGH' THEN 'proven' ELSE 'unproven' END AS proof
  FROM g JOIN orders ON o_orderkey = r JOIN checked c ON c.endpoint = o_orderpriority AND c.name = g.name LEFT JOIN f ON f.i = s % 10),
t AS (SELECT r, string_agg(CASE WHEN proof = 'unproven' THEN name END, ',' ORDER BY name) AS unproven, string_agg(CASE WHEN proof = 'invalid' THEN name END, ',' ORDER BY name) AS invalid, string_agg(CASE WHEN proof = 'proven' AND name = 'N' THEN name || '=' || field END, ',' ORDER BY name) AS bindings FROM p GROUP BY r),
m AS (SELECT o_orderkey AS r, string_agg(v.name, ',' ORDER BY v.name) AS missing FROM orders JOIN v ON v.endpoint = o_orderpriority LEFT JOIN g ON g.r = o_orderkey AND g.name = v.name WHERE g.r IS NULL GROUP BY o_orderkey)
SELECT o_orderkey, coalesce(missing, '') AS missing, coalesce(unproven, '') AS unproven, coalesce(invalid, '') AS invalid, coalesce(bindings, '') AS bindings, CASE WHEN missing IS NOT NULL THEN CASE WHEN o_orderkey % 2 = 0 THEN 'required-fields-missing' ELSE 'review-required' END WHEN invalid IS NOT NULL THEN 'required-fields-invalid' WHEN unproven IS NOT NULL THEN 'review-required' ELSE 'fields-present' END AS status
FROM orders LEFT JOIN m ON m.r = o_orderkey LEFT JOIN t ON t.r = o_orderkey"""
)
def request_contracts(spark, d):
    r = F.col("o_orderkey").cast("string").alias("request")
    requests = table(spark, d, "orders").select(r, F.col("o_orderpriority").alias("endpoint"), F.lit("P").alias("page"), F.when(F.col("o_orderkey") % 2 == 0, "exact").otherwise("partial").alias("certainty"))
    first = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").cast("string").alias("request"), F.col("l_returnflag").alias("name")).agg(F.min(F.struct("l_linenumber", "l_quantity", "l_suppkey")).alias("x"))
    is_a, is_n = F.col("name") == "A", F.col("name") == "N"
    given = first.select("request", "name", F.when(is_a, "literal").when(is_n, "path").otherwise("other").alias("kind"), F.when(is_a, F.col("x.l_quantity").cast("string")).alias("value"), F.when(is_a, "number").alias("vtype"), F.when(is_n, F.concat(F.lit("s"), (F.col("x.l_suppkey") % 10).cast("string"))).alias("identity"))
    rules = spark.createDataFrame([(e, f"v{i}", f"Body.{n}", k, x, t, None) for i, (e, n, k, x, t) in enumerate(VALIDATIONS)], "endpoint string, validation string, path string, kind string, num_value double, str_value string, arr_value array<string>")
    s = F.col("s_suppkey")
    fields = table(spark, d, "supplier").where(s < 30).select(F.concat(F.lit("f"), s.cast("string")).alias("field"), F.lit("Q").alias("page"), F.lit("form.n").alias("path"), F.concat(F.lit("s"), (s % 10).cast("string")).alias("identity"), (F.col("s_acctbal") > 0).alias("writable"), F.lit("string").alias("value_type"))
    reach = spark.createDataFrame([("P", "P"), ("P", "Q"), ("Z", "Q")], "page string, from_page string")
    out = catalog.payload_contracts(requests, given, rules, fields, reach)
    return out.select(F.col("request").cast("long").alias("o_orderkey"), joined("missing"), joined("unproven"), joined("invalid"), joined("bindings"), "status")


@query(
    """SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'unknown' WHEN o_orderkey % 3 = 0 AND l_orderkey IS NOT NULL THEN 'exact' ELSE 'partial' END AS certainty, CASE WHEN o_orderkey % 5 = 0 THEN '' WHEN o_orderkey % 3 = 0 AND l_orderkey IS NOT NULL THEN l_returnflag || ',' || l_linestatus ELSE o_orderstatus END AS fields
FROM orders LEFT JOIN (SELECT l_orderkey, min(l_returnflag) AS l_returnflag, min(l_linestatus) AS l_linestatus FROM lineitem GROUP BY l_orderkey) ON l_orderkey = o_orderkey"""
)
def payload_shapes(spark, d):
    k = F.col("o_orderkey")
    shapes = table(spark, d, "orders").select(k.alias("request"), F.when(k % 3 == 0, "body").alias("reference"), F.lit("partial").alias("certainty"), F.array("o_orderstatus").alias("fields"), (k % 5 == 0).alias("ambiguous"))
    env = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("request")).agg(F.lit("body").alias("name"), F.lit("exact").alias("certainty"), F.array(F.min("l_returnflag"), F.min("l_linestatus")).alias("fields"))
    return catalog.resolved_shape(shapes, env).select(F.col("request").alias("o_orderkey"), "certainty", joined("fields"))


@query(
    """WITH d AS (SELECT DISTINCT s_suppkey AS file, unnest(['T' || s_suppkey % 40, 'I' || s_nationkey]) AS t, s_suppkey % 3 AS arity FROM supplier), n AS (SELECT t, arity, count(*) AS n, min(file) AS file FROM d GROUP BY ALL)
SELECT c_custkey, CASE WHEN n = 1 THEN file END AS file, CASE WHEN n IS NULL THEN 'missing' WHEN n > 1 THEN 'ambiguous' ELSE 'unique' END AS match FROM customer LEFT JOIN n ON t = CASE WHEN c_custkey % 2 = 0 THEN 'T' || c_custkey % 50 ELSE 'I' || c_nationkey END AND arity = c_custkey % 3"""
)
def receiver_resolution(spark, d):
    k = F.col("c_custkey")
    kind = F.when(k % 2 == 0, F.concat(F.lit("T"), (k % 50).cast("string"))).otherwise(F.concat(F.lit("I"), F.col("c_nationkey").cast("string")))
    calls = table(spark, d, "customer").select(k, kind.alias("receiver_type"), F.lit("run").alias("method"), (k % 3).alias("arity"))
    s = F.col("s_suppkey")
    declared = table(spark, d, "supplier").select(s.alias("file"), F.concat(F.lit("T"), (s % 40).cast("string")).alias("type"), F.array(F.concat(F.lit("I"), F.col("s_nationkey").cast("string"))).alias("implements"), F.lit("run").alias("method"), (s % 3).alias("arity"))
    return catalog.receiver_types(calls, declared).select("c_custkey", "file", "match")


# --- paths and variants ---------------------------------------------------------------------------------------------

SEARCH = f"""WITH RECURSIVE t AS (SELECT src, dst, n, row_number() OVER (PARTITION BY src ORDER BY n DESC, dst) AS k FROM ({TRANSITIONS}) WHERE src <> dst), b AS (SELECT min(src) AS low, max(src) AS high FROM t),
e AS (SELECT src, dst, CASE WHEN src < dst THEN CASE WHEN n % 2 = 0 THEN 'up' END WHEN n % 3 = 0 THEN 'down' END AS guard, dst = high AS success, src <> low AND src <> high AS op, dst = low AS nav FROM t, b WHERE k <= 3),
p(nodes, last, guards, lacking, state, observed) AS (SELECT [low], low, CAST([] AS VARCHAR[]), 0, 'live', 1 FROM b UNION ALL
SELECT list_append(nodes, dst), dst, CASE WHEN guard IS NULL OR len(list_filter(nodes, lambda x: x = dst)) >= 2 THEN guards ELSE list_append(guards, guard) END, lacking + CASE WHEN success AND len(list_filter(nodes, lambda x: x = dst)) < 2 AND NOT list_contains(nodes, 'click') THEN 1 ELSE 0 END,
CASE WHEN len(list_filter(nodes, lambda x: x = dst)) >= 2 THEN 'visit' WHEN len(nodes) + 1 > 6 THEN 'depth' WHEN success AND op THEN 'witness' ELSE 'live' END, CASE WHEN len(list_filter(nodes, lambda x: x = dst)) >= 2 THEN 3 ELSE len(nodes) + 1 END
FROM p JOIN e ON e.src = p.last, b WHERE state = 'live' AND NOT (nav AND list_contains(nodes, dst) AND NOT success)
AND (guard IS NULL OR len(list_filter(nodes, lambda x: x = dst)) >= 2 OR NOT list_contains(guards, CASE WHEN guard = 'up' THEN 'down' ELSE 'up' END)))"""


def searched(spark, d):
    """The states of a search over the three most frequent transitions of every event type."""
    t = joins.top_of_each(behavior_transitions(spark, d).where("src <> dst"), ["src"], [F.desc("n"), F.asc("dst")], 3)
    b = t.agg(F.min("src").alias("low"), F.max("src").alias("high")).first()  # one row
    is_op = lambda c: (F.col(c) != b.low) & (F.col(c) != b.high)
    none = F.array().cast("array<string>")
    up, down = F.array(F.lit("mode === 'up'")), F.array(F.lit("mode === 'down'"))
    guards = F.when((F.col("src") < F.col("dst")) & (F.col("n") % 2 == 0), up).when((F.col("src") > F.col("dst")) & (F.col("n") % 3 == 0), down).otherwise(none)
    goal = F.col("dst") == b.high
    edges = t.select(F.concat_ws(">", "src", "dst").alias("edge"), "src", "dst", guards.alias("guards"), F.when(goal, "success").otherwise("neutral").alias("outcome"), F.array(F.lit("c")).alias("contracts"), F.when(goal, F.array(F.lit("f"))).otherwise(none).alias("needs"), (F.col("dst") == b.low).alias("nav_only"))
    names = t.select(F.col("src").alias("node")).union(t.select("dst")).distinct()
    nodes = names.select("node", F.when(is_op("node"), "operation").otherwise("screen").alias("kind"), F.col("node").alias("label"), F.lit("op").alias("reference"), F.when(F.col("node") == "click", F.array(F.lit("f"))).otherwise(none).alias("page_fields"))
    one = lambda rows, schema: spark.createDataFrame(rows, schema)
    return behavior.search_paths(nodes, edges, one([(b.low, False)], "node string, structural boolean"), one([("f", "op")], "family string, operation string"), one([("f", b.high)], "family string, success string"), max_depth=6), nodes


@query(SEARCH + " SELECT array_to_string(nodes, '>') AS path, state, CAST(observed AS INTEGER) AS observed, lacking > 0 AS conditional, array_to_string(list_distinct(guards), '') AS mode FROM p")
def path_search(spark, d):
    lacking = F.exists("guards", lambda g: g.startswith("request-ui-provenance:"))
    mode = F.array_join(F.array_distinct(F.filter(F.transform("guards", lambda g: F.regexp_extract(g, "'(\\w+)'", 1)), lambda g: g != "")), "")
    return searched(spark, d)[0].select(F.array_join("nodes", ">").alias("path"), "state", "observed", lacking.alias("conditional"), mode.alias("mode"))


@query(SEARCH + " SELECT count(*) FILTER (state <> 'visit') AS enqueued, count(*) FILTER (state <> 'visit') AS dequeued, count(*) FILTER (state = 'depth') AS depth_prunes, count(*) FILTER (state = 'visit') AS visit_prunes FROM p")
def search_telemetry(spark, d):
    return behavior.telemetry(searched(spark, d)[0])


@query(
    SEARCH
    + """ SELECT state AS reason, last AS node, CASE WHEN state = 'visit' THEN nodes[len(nodes) - 1] || '>' || last END AS edge, count(*) AS n, CAST(min(observed) AS INTEGER) AS least, CAST(max(observed) AS INTEGER) AS most, min(array_to_string(nodes, '>')) AS sample FROM p WHERE state IN ('visit', 'depth') GROUP BY ALL"""
)
def search_truncations(spark, d):
    return behavior.truncation_details(searched(spark, d)[0]).drop("family")


@query(
    SEARCH
    + """ SELECT array_to_string(nodes, '>') AS path, CASE WHEN lacking > 0 THEN 'conditional' ELSE 'satisfiable' END AS feasibility, CASE WHEN len(guards) > 0 THEN 'mode=' || guards[1] ELSE '' END AS assignments, array_to_string(list_filter(nodes, lambda x: x = low OR x = high), '>') AS pages FROM p, b WHERE state = 'witness'"""
)
def witness_models(spark, d):
    w = behavior.witnesses(*searched(spark, d))
    return w.select(joined("nodes", ">").alias("path"), "feasibility", joined("assignments"), joined("pages", ">"))


@query(
    """WITH s AS (SELECT user_id || ':' || strftime(ts, '%Y-%m-%d') AS w, event_type, row_number() OVER (PARTITION BY user_id, strftime(ts, '%Y-%m-%d') ORDER BY ts, event_id) - 1 AS pos FROM events)
SELECT w AS witness, pos, event_type AS node, lead(event_type || '@' || pos) OVER (PARTITION BY w ORDER BY pos) AS edge FROM s"""
)
def edge_slices(spark, d):
    return behavior.edge_slices(event_paths(spark, d)).select("witness", F.col("pos").cast("long").alias("pos"), "node", "edge")


def event_paths(spark, d):
    """Sessions of a user and day as paths: witness, family (month), nodes, edges."""
    e = table(spark, d, "events").select(F.concat_ws(":", F.col("user_id").cast("string"), F.date_format("ts", "yyyy-MM-dd")).alias("witness"), F.date_format("ts", "yyyy-MM").alias("family"), "ts", "event_id", "event_type", "value")
    g = e.groupBy("witness", "family").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type"))).alias("s"), F.max("value").alias("high"))
    nodes = F.transform("s", lambda x: x["event_type"])
    return g.select("witness", "family", "high", nodes.alias("nodes")).withColumn("edges", F.transform(F.slice("nodes", F.lit(2), F.greatest(F.size("nodes") - 1, F.lit(0))), lambda n, i: F.concat_ws("@", n, (i + 1).cast("string"))))


@query(
    """WITH s AS (SELECT strftime(ts, '%Y-%m') AS family, user_id || ':' || strftime(ts, '%Y-%m-%d') AS w, string_agg(event_type, '>' ORDER BY ts, event_id) AS path, max(value) AS high FROM events GROUP BY ALL),
x AS (SELECT *, high > 90 AS doubt, CAST(floor(high / 40) AS BIGINT) AS step FROM s),
g AS (SELECT family, path, step, doubt, bool_or(NOT doubt AND step = 2) AS unbound, count(*) AS members, min(w) AS first FROM x GROUP BY ALL)
SELECT family, path, step, CASE WHEN doubt OR unbound THEN 'conditional' ELSE 'satisfiable' END AS feasibility, members, first FROM g"""
)
def variant_feasibility(spark, d):
    w = event_paths(spark, d).withColumn("step", F.floor(F.col("high") / 40))
    none = F.array().cast("array<string>")
    w = w.select(
        "witness", "family", "nodes", "edges", "step", F.lit("always").alias("condition"), F.when(F.col("high") > 90, "conditional").otherwise("satisfiable").alias("feasibility"),
        F.array(F.concat(F.lit("step="), F.col("step").cast("string")), F.concat(F.lit("sure="), (F.col("high") <= 90).cast("string"))).alias("assignments"), F.col("nodes").alias("pages"), none.alias("actions"), none.alias("operations"),
    )
    nodes = spark.createDataFrame([("none", "action", "x")], "node string, kind string, label string")
    edges = spark.createDataFrame([], "edge string, contracts array<string>")
    active = spark.createDataFrame([], "witness string, page string, field string, path string, control string, mode string, visibility string, required string, constraint_status string, rules array<string>, opaque_rule boolean")
    roles = w.where("step = 2").select("witness", F.lit("step").alias("path"), F.lit("2").alias("value"), F.lit("unbound").alias("role"), F.lit(None).cast("string").alias("field"))
    actors = spark.createDataFrame([], "operation string, actor string")
    v = behavior.behavior_variants(w.drop("step"), nodes, edges, active, roles, actors)
    first = v.select("family", "pages", "feasibility", F.size("witnesses").cast("long").alias("members"), F.get("witnesses", F.lit(0)).alias("first")).join(w.select(F.col("witness").alias("first"), "step"), "first")
    return first.select("family", joined("pages", ">").alias("path"), "step", "feasibility", "members", "first")


FIELDS = [("f1", "P", "form.status", ["status === 'F'"], []), ("f2", "P", "form.total", ["isShown(x)"], ["status === 'O'"]), ("f3", "P", "form.note", [], ["price > 200000"]), ("f4", "Q", "late", [], [])]


@query(
    """WITH w AS (SELECT o_orderkey, o_orderstatus AS s, o_totalprice > 200000 AS high FROM orders), x AS (SELECT f, s, high FROM w, (VALUES ('f1'), ('f2'), ('f3')) t(f) WHERE NOT (f = 'f1' AND s <> 'F'))
SELECT f AS field, CASE WHEN f = 'f2' THEN 'conditional' ELSE 'satisfiable' END AS visibility, CASE f WHEN 'f1' THEN CASE WHEN high THEN 'true' ELSE 'false' END WHEN 'f2' THEN CASE WHEN s = 'O' THEN 'satisfiable' ELSE 'unsatisfiable' END ELSE CASE WHEN high THEN 'satisfiable' ELSE 'unsatisfiable' END END AS required, count(*) AS n FROM x GROUP BY ALL"""
)
def active_field_states(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("witness"), "o_orderstatus", (F.col("o_totalprice") > 200000).alias("high"))
    condition = F.concat(F.lit("status = "), "o_orderstatus", F.lit(" and price "), F.when(F.col("high"), F.lit("> 200000")).otherwise(F.lit("<= 200000")))
    w = o.select("witness", "high", condition.alias("condition"), F.array(*map(F.lit, ("P", "a", "Q"))).alias("nodes"))
    nodes = spark.createDataFrame([("P", "screen"), ("a", "action"), ("Q", "screen")], "node string, kind string")
    fields = spark.createDataFrame([(f, p, path, "textbox", None, v, r) for f, p, path, v, r in FIELDS], "field string, page string, path string, control string, mode string, visible_when array<string>, required_when array<string>")
    rules = w.where("high").select("witness", F.lit("f1").alias("field"), F.lit("c").alias("constraint"), F.lit("required").alias("kind"), F.lit(None).cast("string").alias("value"), F.lit("satisfiable").alias("status"))
    return coverage.count_by(behavior.active_fields(w, nodes, fields, rules), "field", "visibility", "required")


@query(
    """WITH a AS (SELECT o_orderkey, unnest(['orderStatus=' || o_orderstatus, 'user.role=x', 'Customer.segment=1', 'other.path=2', 'session=true', 'lit=3']) AS x FROM orders), k AS (SELECT *, split_part(x, '=', 1) AS path FROM a)
SELECT path, CASE path WHEN 'orderStatus' THEN CASE WHEN o_orderkey % 3 = 0 THEN 'unbound' ELSE 'field' END WHEN 'user.role' THEN CASE WHEN o_orderkey % 2 = 0 THEN 'actor-attribute' ELSE 'unbound' END WHEN 'Customer.segment' THEN 'entity' WHEN 'session' THEN CASE WHEN o_orderkey % 2 = 0 THEN 'actor' ELSE 'unbound' END WHEN 'lit' THEN 'literal' ELSE 'unbound' END AS role, count(*) AS n FROM k GROUP BY ALL"""
)
def assignment_roles(spark, d):
    o, key = table(spark, d, "orders"), F.col("o_orderkey")
    given = F.array(F.concat(F.lit("orderStatus="), "o_orderstatus"), *map(F.lit, ("user.role=x", "Customer.segment=1", "other.path=2", "session=true", "lit=3")))
    w = o.select(key.cast("string").alias("witness"), F.array(F.lit("e")).alias("edges"), F.array(F.when(key % 2 == 0, "in").otherwise("out")).alias("operations"), given.alias("assignments"))
    fields = [("s", "form.orderStatus", True), ("t", "list.orderStatus", False), ("c", "form.customerId", True)]
    active = w.select("witness").crossJoin(F.broadcast(spark.createDataFrame(fields, "field string, path string, always boolean"))).where(F.col("always") | (F.col("witness").cast("long") % 3 == 0)).withColumn("mode", F.lit("editable"))
    edges = spark.createDataFrame([("e", ["k"])], "edge string, contracts array<string>")
    one = lambda rows, schema: spark.createDataFrame(rows, schema)
    out = behavior.assignment_roles(w, active, edges, one([("k", "lit")], "contract string, name string"), one([("in", "required"), ("out", "anonymous")], "operation string, authentication string"), one([("c", "x.customer")], "field string, binding_path string"))
    return coverage.count_by(out, "path", "role")


@query(
    """WITH l AS (SELECT l_orderkey, count(*) AS n, bool_or(l_returnflag = 'R') AS r, bool_or(l_linestatus = 'F') AS f, bool_or(l_quantity > 40) AS q, count(*) FILTER (l_discount > 0.05) AS c, count(*) FILTER (l_tax > 0.04) AS v FROM lineitem GROUP BY l_orderkey),
x AS (SELECT o_orderkey, o_orderstatus, c, v, CASE WHEN n IS NULL THEN 'frontend-client-join' WHEN NOT r THEN 'action-operation-join' WHEN NOT f THEN 'success-continuation' WHEN o_orderpriority = '5-LOW' THEN 'flow-family' WHEN NOT q THEN 'entry-success-witness' WHEN v = 0 THEN 'behavior-variant' END AS missing_stage FROM orders LEFT JOIN l ON l_orderkey = o_orderkey)
SELECT o_orderkey, missing_stage, CASE WHEN missing_stage IS NOT NULL THEN 'uncovered' WHEN o_orderstatus = 'P' OR c >= v THEN 'conditional' ELSE 'covered' END AS status FROM x"""
)
def operation_stages(spark, d):
    l = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.count("*").alias("n"), F.bool_or(F.col("l_returnflag") == "R").alias("r"), F.bool_or(F.col("l_linestatus") == "F").alias("f"), F.bool_or(F.col("l_quantity") > 40).alias("q"),
        F.count_if(F.col("l_discount") > 0.05).alias("c"), F.count_if(F.col("l_tax") > 0.04).alias("v"),
    )
    x = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority").join(l, "o_orderkey", "left")
    x = x.withColumn("missing_stage", behavior.missing_stage(F.col("n") > 0, F.col("r"), F.col("f"), F.col("o_orderpriority") != "5-LOW", F.col("q"), F.col("v") > 0))
    need = F.when(F.col("o_orderstatus") == "P", "review-required").otherwise("included")
    return x.select("o_orderkey", "missing_stage", behavior.coverage_status(F.col("missing_stage"), need, F.col("v"), F.col("c")).alias("status"))


@query(
    """SELECT 'evidenceNodes' AS name, count(*) AS n FROM documents UNION ALL SELECT 'sourceDeclaredActions', count(*) FROM events UNION ALL SELECT 'handlerResolvedActions', count(*) FILTER (value > 50) FROM events UNION ALL SELECT 'terminalOperations', count(*) FILTER (o_orderstatus <> 'P') FROM orders
UNION ALL SELECT 'unresolvedTerminalEffects', count(*) FILTER (l_returnflag = 'R') FROM lineitem UNION ALL SELECT 'pageContracts', count(*) FROM pages UNION ALL SELECT 'actorRequirements', count(*) FROM customer UNION ALL SELECT 'behaviorNodes', count(*) FROM nation UNION ALL SELECT 'behaviorEdges', count(*) FROM supplier
UNION ALL SELECT 'flowFamilies', count(*) FROM region UNION ALL SELECT 'pathWitnesses', count(*) FROM conversations UNION ALL SELECT 'pathSearchEnqueuedStates', count(*) FILTER (p_size % 3 <> 1) FROM part UNION ALL SELECT 'pathSearchDequeuedStates', count(*) FILTER (p_size % 3 <> 1) FROM part
UNION ALL SELECT 'pathSearchDepthPrunes', count(*) FILTER (p_size % 3 = 0) FROM part UNION ALL SELECT 'pathSearchVisitPrunes', count(*) FILTER (p_size % 3 = 1) FROM part UNION ALL SELECT 'variants', count(*) FROM embeddings UNION ALL SELECT 'conditionalVariants', count(*) FILTER (label % 2 = 0) FROM embeddings
UNION ALL SELECT 'dataRequirements', count(*) FROM labels UNION ALL SELECT 'unresolvedDataRequirements', count(*) FILTER (quality = 0) FROM labels UNION ALL SELECT 'runtimeBindings', count(*) FROM benchmark UNION ALL SELECT 'requestPayloadContracts', count(*) FROM orders UNION ALL SELECT 'requestPayloadFieldsPresent', count(*) FILTER (o_orderpriority < '2') FROM orders
UNION ALL SELECT 'requestPayloadReviewRequired', count(*) FILTER (o_orderpriority >= '2' AND o_orderpriority < '3') FROM orders UNION ALL SELECT 'requestPayloadPathsBlocked', count(*) FILTER (o_orderpriority >= '3') FROM orders UNION ALL SELECT 'uncoveredOperations', count(*) FILTER (c_acctbal < 0) FROM customer"""
)
def coverage_report_counts(spark, d):
    t = lambda n: table(spark, d, n)
    status = F.when(F.col("o_orderpriority") < "2", "fields-present").when(F.col("o_orderpriority") < "3", "review-required").when(F.col("o_orderpriority") < "4", "required-fields-missing").otherwise("required-fields-invalid")
    return behavior.coverage_totals({
        "facts": t("documents"), "actions": t("events").select(F.when(F.col("value") > 50, "h").alias("handler")), "operations": t("orders").select(F.when(F.col("o_orderstatus") == "P", "excluded").otherwise("included").alias("inclusion")),
        "effects": t("lineitem").select(F.when(F.col("l_returnflag") == "R", "unknown-mutation").otherwise("state-changed").alias("kind")), "pages": t("pages"), "actors": t("customer"), "nodes": t("nation"), "edges": t("supplier"), "families": t("region"), "witnesses": t("conversations"),
        "states": t("part").select(pick(F.col("p_size") % 3, "depth", "visit", "live").alias("state")), "variants": t("embeddings").select(F.when(F.col("label") % 2 == 0, "conditional").otherwise("satisfiable").alias("feasibility")),
        "requirements": t("labels").select(F.when(F.col("quality") == 0, "unresolved").otherwise("generated").alias("status")), "bindings": t("benchmark"), "contracts": t("orders").select(status.alias("status")), "coverage": t("customer").select(F.when(F.col("c_acctbal") < 0, "uncovered").otherwise("covered").alias("status")),
    })


@query(
    """SELECT n, first, count(*) AS predicates FROM (SELECT CASE WHEN 20 + p_partkey % 10 > 25 THEN 2 ELSE 1 END AS n, CASE WHEN 20 + p_partkey % 10 > 25 THEN 'size > 25 and size < ' || (20 + p_partkey % 10) ELSE 'kind = A and size < ' || (20 + p_partkey % 10) END AS first FROM part) GROUP BY ALL"""
)
def predicate_models(spark, d):
    text = F.concat(F.lit("(size > 25 || kind === 'A') && size < "), (20 + F.col("p_partkey") % 10).cast("string"))
    found = P.per_row(table(spark, d, "part").select(text.alias("e")), ["e"], "n long, first string", lambda e: [(len(m), m[0][0]) for m in [P.models(P.parse(e))]])
    return found.groupBy("n", "first").agg(F.count("*").alias("predicates"))


# --- values ---------------------------------------------------------------------------------------------------------

KINDS = "CASE p_partkey % 8 WHEN 0 THEN 'minLength' WHEN 1 THEN 'email' WHEN 2 THEN 'min' WHEN 3 THEN 'integer' WHEN 4 THEN 'boolean' WHEN 5 THEN 'enum' WHEN 6 THEN 'opaque' ELSE 'maxLength' END"


@query(
    f"""SELECT p_partkey, CASE {KINDS} WHEN 'minLength' THEN repeat('A', greatest(1, p_size)) WHEN 'email' THEN 'test@example.com' WHEN 'min' THEN CAST(greatest(0, p_size) AS VARCHAR) WHEN 'integer' THEN '0' WHEN 'boolean' THEN 'true' WHEN 'enum' THEN p_type WHEN 'opaque' THEN NULL ELSE CASE WHEN p_size >= 1 THEN 'A' END END AS value FROM part"""
)
def synthesised_values(spark, d):
    return C.synthesised(part_rules(spark, d), "p_partkey").select("p_partkey", "value")


def part_rules(spark, d):
    k, size = F.col("p_partkey") % 8, F.col("p_size").cast("double")
    kind = pick(k, "minLength", "format", "min", "type", "type", "enum", "opaque", "maxLength")
    return table(spark, d, "part").select("p_partkey", F.lit("r").alias("id"), kind.alias("kind"), F.when(k.isin(0, 2, 7), size).alias("num_value"), F.when(k == 1, "email").when(k == 3, "integer").when(k == 4, "boolean").alias("str_value"), F.when(k == 5, F.array("p_type", "p_brand")).alias("arr_value"))


@query(
    f"""SELECT p_partkey, CASE {KINDS} WHEN 'minLength' THEN CASE WHEN p_size <= 4 THEN 'TEST' END WHEN 'email' THEN NULL WHEN 'min' THEN CASE WHEN p_size <= 30 THEN '30' END WHEN 'integer' THEN CASE WHEN p_size = 30 THEN NULL ELSE '30' END WHEN 'boolean' THEN NULL WHEN 'enum' THEN NULL WHEN 'opaque' THEN NULL ELSE CASE WHEN p_size >= 4 THEN 'TEST' WHEN p_size >= 2 THEN '30' END END AS value FROM part WHERE p_partkey % 3 = 0"""
)
def option_values(spark, d):
    p = table(spark, d, "part").where("p_partkey % 3 = 0")
    k = F.col("p_partkey") % 8
    options = F.when((k == 3) & (F.col("p_size") == 30), F.array(F.lit("TEST"))).otherwise(F.array(F.lit("TEST"), F.lit("30")))
    return C.option_values(p.select("p_partkey", options.alias("options"), F.lit(None).cast("string").alias("assigned")), part_rules(spark, d).where("p_partkey % 3 = 0"), "p_partkey").select("p_partkey", "value")


@query(
    """WITH x AS (SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'secret-reference' WHEN 1 THEN 'flow-literal' ELSE 'existing-entity' END AS kind, CASE WHEN c_nationkey % 2 = 0 THEN c_mktsegment END AS value, CASE WHEN c_nationkey % 3 = 0 THEN CASE WHEN c_acctbal > 0 THEN 'vault://a' ELSE 'http://a' END END AS ref,
c_custkey % 7 <> 0 AS current, c_nationkey < 20 AS allowed, CASE WHEN c_custkey % 3 = 1 AND c_custkey % 5 = 0 THEN 'BUILDING' END AS expected, c_custkey % 4 <> 3 AS confirmed FROM customer)
SELECT c_custkey, CASE WHEN kind = 'flow-literal' AND c_custkey % 2 = 0 THEN NULL WHEN NOT confirmed THEN 'not-confirmed' WHEN kind = 'secret-reference' AND (ref IS NULL OR value IS NOT NULL) THEN 'secret-reference-required' WHEN kind <> 'secret-reference' AND (value IS NULL OR ref IS NOT NULL) THEN 'value-required'
WHEN kind = 'secret-reference' AND ref NOT LIKE 'vault://%' THEN 'reference-not-approved' WHEN NOT current THEN 'requirement-changed' WHEN NOT allowed THEN 'strategy-not-allowed' WHEN value <> expected THEN 'unexpected-value' END AS issue,
CASE WHEN kind = 'flow-literal' AND c_custkey % 2 = 0 THEN 'source-derived:' || c_custkey ELSE 'alias' END AS alias FROM x"""
)
def value_bindings(spark, d):
    c, key, n = table(spark, d, "customer"), F.col("c_custkey"), F.col("c_nationkey")
    name = key.cast("string").alias("requirement")
    strategies = F.when(n < 20, F.array(F.lit("manual-binding"), F.lit("x"))).otherwise(F.array(F.lit("x")))
    needs = c.select(name, pick(key % 3, "secret-reference", "flow-literal", "existing-entity").alias("kind"), F.when((key % 3 == 1) & (key % 2 == 0), "generated").otherwise("unresolved").alias("status"), F.lit("r").alias("representative"), F.when((key % 3 == 1) & (key % 5 == 0), "BUILDING").alias("expected"), strategies.alias("strategies"), F.lit("d").alias("digest"))
    ref = F.when(n % 3 == 0, F.when(F.col("c_acctbal") > 0, "vault://a").otherwise("http://a"))
    bound = c.select(name, F.lit("alias").alias("alias"), F.when(n % 2 == 0, F.col("c_mktsegment")).alias("value"), ref.alias("secret_ref"), F.lit("manual-binding").alias("resolver"), F.when(key % 7 != 0, "d").otherwise("old").alias("requirement_digest"), F.lit(True).alias("verified"), (key % 4 != 3).alias("confirmed"))
    return lifecycle.value_bindings(needs, bound).select(F.col("requirement").cast("long").alias("c_custkey"), "issue", "alias")


@query(
    """SELECT kind, usable, count(*) AS n FROM (SELECT CASE l_linenumber % 4 WHEN 0 THEN 'actor-session' WHEN 1 THEN 'screen-state' WHEN 2 THEN 'field' ELSE 'action' END AS kind, CASE l_linenumber % 4 WHEN 0 THEN TRUE WHEN 1 THEN l_quantity > 10 ELSE l_quantity > 10 AND l_returnflag = 'N' END AS usable FROM lineitem) GROUP BY ALL"""
)
def usable_bindings(spark, d):
    kind = pick(F.col("l_linenumber") % 4, "actor-session", "screen-state", "field", "action")
    x = table(spark, d, "lineitem").select(kind.alias("kind"), C.usable(kind, F.col("l_quantity") > 10, F.col("l_returnflag") == "N").alias("usable"))
    return coverage.count_by(x, "kind", "usable")


# --- lifecycle ------------------------------------------------------------------------------------------------------


@query(
    """WITH o AS (SELECT o_custkey, count(*) AS n, count(*) FILTER (o_orderstatus = 'P') AS stale, min(CASE WHEN o_orderstatus = 'P' THEN o_orderkey END) AS first_stale FROM orders GROUP BY o_custkey),
u AS (SELECT o_custkey, sum(n) AS uncovered, string_agg(stage || '=' || n, ', ' ORDER BY stage || '=' || n) AS stages FROM (SELECT o_custkey, coalesce(CASE WHEN o_orderpriority < '3' THEN 'flow-family' END, 'unknown') AS stage, count(*) AS n FROM orders WHERE o_totalprice > 300000 GROUP BY ALL) GROUP BY o_custkey),
v AS (SELECT o_custkey, count(*) AS variants, max(CASE WHEN o_orderpriority = '1-URGENT' THEN CASE WHEN o_orderkey % 2 = 0 THEN 'satisfiable' ELSE 'conditional' END END) AS feasibility FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey),
x AS (SELECT c_custkey, coalesce(stale, 0) AS missing, first_stale, coalesce(variants, 0) AS variants, feasibility, c_nationkey, c_acctbal, coalesce(uncovered, 0) AS uncovered, coalesce(stages, 'none') AS stages FROM customer LEFT JOIN o ON o.o_custkey = c_custkey LEFT JOIN u ON u.o_custkey = c_custkey LEFT JOIN v ON v.o_custkey = c_custkey),
y AS (SELECT *, CASE WHEN missing > 0 THEN 'ANALYSIS_REQUIRED' WHEN variants = 0 THEN 'SOURCE_REPAIR_REQUIRED' WHEN c_nationkey % 5 = 0 THEN 'FLOW_SELECTION_REQUIRED' WHEN c_nationkey % 5 = 1 THEN 'BDD_GENERATION_REQUIRED' WHEN coalesce(feasibility <> 'conditional', FALSE) = FALSE THEN 'REVIEW_REQUIRED' WHEN c_acctbal < 0 THEN 'DATA_REQUIRED' WHEN c_acctbal < 2000 THEN 'RUNTIME_GROUNDING_REQUIRED' WHEN c_nationkey % 2 = 0 THEN 'EXECUTION_PLAN_REQUIRED' ELSE 'READY' END AS phase FROM x)
SELECT c_custkey, phase, CASE phase WHEN 'ANALYSIS_REQUIRED' THEN 'analyze' WHEN 'SOURCE_REPAIR_REQUIRED' THEN 'plan-source-repair' WHEN 'FLOW_SELECTION_REQUIRED' THEN 'select-flow' WHEN 'BDD_GENERATION_REQUIRED' THEN 'generate-bdd' WHEN 'REVIEW_REQUIRED' THEN 'review' WHEN 'DATA_REQUIRED' THEN 'bind-data' WHEN 'RUNTIME_GROUNDING_REQUIRED' THEN 'ground' WHEN 'EXECUTION_PLAN_REQUIRED' THEN 'plan-execution' ELSE 'run' END AS action,
CASE phase WHEN 'ANALYSIS_REQUIRED' THEN first_stale || ' is stale or missing' WHEN 'SOURCE_REPAIR_REQUIRED' THEN 'first missing stages: ' || stages END AS reason, CASE WHEN missing > 0 THEN 'STATIC_MODEL_INCOMPLETE' WHEN variants = 0 AND uncovered > 0 THEN 'IN_SCOPE_OPERATIONS_UNCOVERED' ELSE '' END AS blockers, CASE WHEN uncovered > 0 AND variants > 0 THEN 'OPERATION_COVERAGE_BACKLOG' ELSE '' END AS attention FROM y"""
)
def project_guide(spark, d):
    c, o = table(spark, d, "customer"), table(spark, d, "orders")
    n, key = F.col("c_nationkey"), F.col("o_custkey").alias("project")
    projects = c.select(F.col("c_custkey").alias("project"), (n % 5 != 0).alias("selected"), (n % 5 != 1).alias("bdd"), (F.col("c_acctbal") >= 0).alias("data"), (F.col("c_acctbal") >= 1000).alias("adapter"), F.lit(True).alias("runner"), F.lit(None).cast("boolean").alias("contract_error"), F.when(F.col("c_acctbal") < 2000, 3).alias("ungrounded"), (n % 2 != 0).alias("plan"))
    artifacts = o.select(key, F.col("o_orderkey").alias("artifact"), (F.col("o_orderstatus") != "P").alias("current"))
    gaps = o.where("o_totalprice > 300000").select(key, F.lit("uncovered").alias("status"), F.when(F.col("o_orderpriority") < "3", "flow-family").alias("missing_stage"))
    variants = o.where("o_orderstatus = 'F'").select(key, F.when(F.col("o_orderkey") % 2 == 0, "satisfiable").otherwise("conditional").alias("feasibility"), (F.col("o_orderpriority") == "1-URGENT").alias("chosen"))
    return lifecycle.guide(projects, artifacts, gaps, variants).withColumnRenamed("project", "c_custkey")


@query("SELECT o_custkey, o_orderpriority, o_orderkey, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority, o_orderkey) AS rank FROM orders) WHERE rank <= 2")
def urgent_actions(spark, d):
    x = table(spark, d, "orders").select("o_custkey", F.col("o_orderpriority").alias("priority"), F.col("o_orderkey").alias("action"))
    return lifecycle.by_priority(x, "o_custkey", 2).select("o_custkey", F.col("priority").alias("o_orderpriority"), F.col("action").alias("o_orderkey"), "rank")


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS k FROM orders WHERE o_orderdate + INTERVAL 30 MINUTE > TIMESTAMP '1995-01-01' AND o_orderstatus <> 'P') WHERE k = 1")
def newest_manifest(spark, d):
    x = table(spark, d, "orders").select("o_custkey", "o_orderdate", "o_orderkey", "o_totalprice", "o_orderstatus")
    valid = F.expr("o_orderdate + INTERVAL 30 MINUTES > TIMESTAMP_NTZ '1995-01-01'") & (F.col("o_orderstatus") != "P")
    return lifecycle.newest_valid(x, ["o_custkey"], valid, "o_orderdate").select("o_custkey", "o_orderkey", "o_totalprice")


@query(
    """SELECT issue, count(*) AS n FROM (SELECT CASE WHEN o_orderkey % 10 = 0 THEN 'content' WHEN o_orderstatus = 'P' THEN 'environment' WHEN c_nationkey = 3 THEN 'configuration' WHEN c_acctbal < 0 THEN 'adapters' WHEN o_orderdate + INTERVAL 30 MINUTE <= TIMESTAMP '1995-01-01' THEN 'expired' WHEN c_mktsegment = 'BUILDING' THEN 'lineage' WHEN c_custkey IS NULL THEN 'variant'
WHEN o_orderpriority = '5-LOW' THEN 'review-required' WHEN o_orderkey % 10 = 1 THEN 'witness' WHEN o_orderkey % 10 = 2 THEN 'data' WHEN o_orderkey % 10 = 3 THEN 'steps' ELSE 'valid' END AS issue FROM orders JOIN customer ON c_custkey = o_custkey) GROUP BY issue"""
)
def manifest_gates(spark, d):
    x = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    k, one = F.col("o_orderkey") % 10, F.lit("x")
    same = lambda ok: F.when(ok, "x").otherwise("y")
    m = {
        "digest": one, "current_digest": same(k != 0), "environment": one, "current_environment": same(F.col("o_orderstatus") != "P"), "config_digest": one, "current_config_digest": same(F.col("c_nationkey") != 3), "adapter_digest": one, "current_adapter_digest": same(F.col("c_acctbal") >= 0),
        "created_at": F.col("o_orderdate"), "source_digest": one, "current_source_digest": same(F.col("c_mktsegment") != "BUILDING"), "variant_known": F.col("c_custkey").isNotNull(), "feasibility": F.when(F.col("o_orderpriority") == "5-LOW", "conditional").otherwise("satisfiable"),
        "witness_of_variant": k != 1, "data_digest": one, "current_data_digest": same(k != 2), "steps_digest": one, "current_steps_digest": same(k != 3),
    }
    issue = lifecycle.manifest_issue(m, F.expr("TIMESTAMP_NTZ '1995-01-01'"))
    return coverage.count_by(x.select(issue.alias("issue")), "issue")


@query(
    """WITH s AS (SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN 'screen' WHEN turn % 3 = 1 THEN 'action' ELSE 'operation' END AS kind FROM conversations),
m AS (SELECT conv_id, coalesce(max(CASE WHEN kind = 'action' THEN turn END), -1) AS last, min(CASE WHEN kind = 'screen' THEN turn END) AS first_screen FROM s GROUP BY conv_id),
e AS (SELECT s.conv_id, max(turn) AS fin FROM s JOIN m USING (conv_id) WHERE kind = 'screen' AND turn > last GROUP BY s.conv_id),
x AS (SELECT s.conv_id, turn, 0 AS sub, CASE kind WHEN 'screen' THEN 'screen-state' ELSE 'action' END AS kind, CAST(turn AS VARCHAR) AS target, CASE WHEN kind = 'screen' THEN CASE WHEN turn = first_screen THEN 'entry' WHEN turn = fin THEN 'success' ELSE 'intermediate' END END AS phase, CASE WHEN fin IS NULL AND turn = first_screen THEN 'no-success-screen' END AS issue
  FROM s JOIN m USING (conv_id) LEFT JOIN e USING (conv_id) WHERE kind <> 'operation'
  UNION ALL SELECT s.conv_id, turn, 1, 'field', 'f' || turn, NULL, CASE WHEN turn % 2 = 0 THEN NULL ELSE 'no-data-requirement' END FROM s JOIN m USING (conv_id) WHERE kind = 'screen' AND turn < last
  UNION ALL SELECT conv_id, -1, 0, 'actor-session', 'u', NULL, NULL FROM (SELECT DISTINCT conv_id FROM conversations WHERE conv_id % 2 = 0))
SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, sub, target) AS sequence, kind, target, phase, issue FROM x"""
)
def manifest_build(spark, d):
    t = table(spark, d, "conversations").select("conv_id", "turn").withColumn("kind", pick(F.col("turn") % 3, "screen", "action", "operation"))
    run = F.col("conv_id").alias("run")
    paths = t.select(run, F.col("turn").alias("pos"), "kind", F.col("turn").cast("string").alias("node"), F.lit(True).alias("success"))
    need = F.when(F.col("turn") % 2 == 0, F.lit("d"))
    fields = t.where("kind = 'screen'").select(run, F.col("turn").cast("string").alias("screen"), F.concat(F.lit("f"), F.col("turn").cast("string")).alias("field"), F.lit(0).alias("ordinal"), F.lit("textbox").alias("control"), F.lit(None).cast("string").alias("mode"), need.alias("requirement"))
    sessions = t.where("conv_id % 2 = 0").select(run, F.lit("u").alias("actor")).distinct()
    values = spark.createDataFrame([("d", "sha256:d")], "requirement string, binding_digest string")
    adapters = spark.createDataFrame([("web", ["screen-state", "action", "actor-session", "field"], None)], "adapter string, kinds array<string>, controls array<string>")
    out = lifecycle.manifest_steps(paths, fields, sessions, values, adapters)
    return out.select(F.col("run").alias("conv_id"), "sequence", "kind", "target", "phase", "issue")


@query(
    """WITH e AS (SELECT c_custkey AS src, c_custkey // 3 AS dst FROM customer), b AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e), g AS (SELECT s_suppkey AS gap FROM supplier WHERE s_acctbal < 2000),
h1 AS (SELECT DISTINCT gap, dst AS node FROM g JOIN b ON src = gap WHERE dst <> gap), h2 AS (SELECT DISTINCT gap, dst AS node FROM h1 JOIN b ON src = node WHERE dst <> gap), near AS (SELECT gap, gap AS node FROM g UNION SELECT * FROM h1 UNION SELECT * FROM h2),
ev AS (SELECT gap, count(*) AS n, min(node) AS first FROM near JOIN customer ON c_custkey = node WHERE c_acctbal > 0 GROUP BY gap),
di AS (SELECT gap, count(*) AS n FROM (SELECT DISTINCT gap, o_orderkey FROM near JOIN orders ON o_custkey = node WHERE o_orderkey % 50 = 0) GROUP BY gap)
SELECT gap AS s_suppkey, coalesce(ev.n, 0) AS evidence, ev.first AS first, least(coalesce(di.n, 0), 40) AS diagnostics FROM g LEFT JOIN ev USING (gap) LEFT JOIN di USING (gap)"""
)
def repair_plan(spark, d):
    c, key = table(spark, d, "customer"), F.col("c_custkey")
    text = lambda x: x.cast("string")
    s = table(spark, d, "supplier").where("s_acctbal < 2000")
    gaps = s.select(text(F.col("s_suppkey")).alias("gap"), F.lit("flow-family").alias("missing_stage"), F.array(text(F.col("s_suppkey"))).alias("seeds"))
    edges = c.select(text(key).alias("src"), text(F.expr("c_custkey div 3")).alias("dst"))
    nodes = c.select(text(key).alias("node"), (F.col("c_acctbal") > 0).alias("has_source"))
    found = table(spark, d, "orders").where("o_orderkey % 50 = 0").select(text(F.col("o_orderkey")).alias("diagnostic"), F.lit("C").alias("code"), F.lit(None).cast("string").alias("scope"), F.array(text(F.col("o_custkey"))).alias("refs"))
    hints = spark.createDataFrame([], "gap string, file string, line int, kind string, excerpt string, score int")
    out = lifecycle.repair_plan(gaps, edges, nodes, found, hints)
    size = lambda x: F.size(x).cast("long").alias(x)
    return out.select(F.col("gap").cast("long").alias("s_suppkey"), size("evidence"), F.array_min(F.transform("evidence", lambda x: x.cast("long"))).alias("first"), size("diagnostics"))


@query("SELECT o_custkey, count(*) FILTER (o_orderstatus <> 'P') AS ok, count(*) FILTER (o_orderstatus = 'P' AND NOT o_orderpriority < '3') AS warnings, count(*) FILTER (o_orderstatus = 'P' AND o_orderpriority < '3') AS errors, count(*) FILTER (o_orderstatus = 'P' AND o_orderpriority < '3') = 0 AS ready FROM orders GROUP BY o_custkey")
def project_health(spark, d):
    x = table(spark, d, "orders").select(F.col("o_custkey").alias("project"), F.col("o_orderkey").alias("check"), (F.col("o_orderstatus") != "P").alias("passed"), (F.col("o_orderpriority") < "3").alias("required"))
    return lifecycle.health(x).withColumnRenamed("project", "o_custkey")


# --- Java sources ---------------------------------------------------------------------------------------------------


@query(
    """SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'active' WHEN 1 THEN 'conditional' WHEN 2 THEN 'conditional' ELSE 'inactive' END AS validation, CASE p_partkey % 4 WHEN 0 THEN 'validated' WHEN 1 THEN 'validation-groups' WHEN 2 THEN 'errors-taken-by-Errors' ELSE 'not-validated' END AS why, CASE WHEN p_partkey % 4 = 2 THEN 2 ELSE 1 END AS arity,
CASE WHEN p_partkey % 5 = 0 THEN 'save:' || 4 || ':for' ELSE 'not (size > ' || p_size || ') and not (kind = ' || p_type || ')' END AS guard FROM part"""
)
def java_methods(spark, d):
    return java.method_facts(part_sources(spark, d)).select(F.col("path").cast("long").alias("p_partkey"), "validation", "why", "arity", "guard")


def part_sources(spark, d):
    """A Java file for each part."""
    k = F.col("p_partkey")
    mark = pick(k % 4, "@Valid", "@Validated(Big.class)", "@Valid", "")
    more = F.when(k % 4 == 2, ", Errors errors").otherwise("")
    loop = F.when(k % 5 == 0, "for (;;) { }").otherwise("// for (;;) { }")
    text = F.concat(
        F.lit("class C {\n  /* public void no() { } */\n  @PostMapping(\"/{id}\")\n  public void save("), mark, F.lit(" @RequestBody PartRequest request"), more, F.lit(") {  "), loop, F.lit("\n    if (request.getSize() > "), F.col("p_size").cast("string"),
        F.lit(") throw new Bad(\"}\");\n    if (request.getKind() == Kind."), "p_type", F.lit(") { throw new Bad(); }\n    store.put(request);\n  }\n}\n"),
    )
    return table(spark, d, "part").select(k.cast("string").alias("path"), text.alias("content"))


@query(
    """WITH RECURSIVE e AS (SELECT c_custkey AS src, c_custkey // 2 AS dst FROM customer WHERE c_custkey > 1), r(origin, node, level) AS (SELECT c_custkey, c_custkey, 0 FROM customer UNION ALL SELECT origin, dst, level + 1 FROM r JOIN e ON src = node WHERE level < 6)
SELECT origin, node, CAST(level AS INTEGER) AS level FROM r WHERE level > 0"""
)
def delegated_methods(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("node"))
    edges = c.where("node > 1").select(F.col("node").alias("src"), F.expr("node div 2").alias("dst"))
    return java.delegated(c, edges)


# --- observations and constraints -----------------------------------------------------------------------------------


@query(
    """WITH s AS (SELECT conv_id, turn, role FROM conversations WHERE turn < 4), o AS (SELECT conv_id, turn, CASE WHEN turn = 2 AND conv_id % 5 = 0 THEN 'other' ELSE role END AS role, CASE WHEN conv_id % 3 = 0 THEN 'cli' ELSE 'web' END AS adapter, conv_id % 7 AS found, conv_id % 2 = 0 AS actionable FROM conversations WHERE NOT (turn = 1 AND conv_id % 4 = 0)),
x AS (SELECT coalesce(s.conv_id, o.conv_id) AS conv_id, CASE WHEN o.conv_id IS NULL THEN 'missing' WHEN s.conv_id IS NULL THEN 'unexpected' WHEN s.role <> o.role THEN 'another-target' WHEN adapter <> 'web' THEN 'adapter-not-permitted' WHEN found <> 1 THEN 'not-unique' WHEN s.turn % 2 = 1 AND NOT actionable THEN 'not-actionable' END AS issue FROM s FULL JOIN o ON s.conv_id = o.conv_id AND s.turn = o.turn)
SELECT issue, count(*) AS n FROM x GROUP BY issue"""
)
def recorded_observations(spark, d):
    c = table(spark, d, "conversations")
    run, pos, k = F.col("conv_id").alias("run"), F.col("turn").alias("sequence"), F.col("conv_id")
    kind = F.when(F.col("turn") % 2 == 0, "screen-state").otherwise("action").alias("kind")
    steps = c.where("turn < 4").select(run, pos, kind, F.col("role").alias("target"), F.lit(None).cast("string").alias("expected_next"), F.array(F.lit("web")).alias("adapters"))
    target = F.when((F.col("turn") == 2) & (k % 5 == 0), "other").otherwise(F.col("role"))
    seen = c.where(~((F.col("turn") == 1) & (k % 4 == 0))).select(run, pos, kind, target.alias("target"), F.lit(None).cast("string").alias("next"), F.when(k % 3 == 0, "cli").otherwise("web").alias("adapter"), (k % 7).alias("found"), (k % 2 == 0).alias("actionable"))
    return coverage.count_by(lifecycle.recorded(steps, seen), "issue")


@query(
    """WITH c AS (SELECT o_orderkey, o_orderpriority, l_returnflag AS name, 'f' || l_suppkey % 5 AS field FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderstatus <> 'P'), v(endpoint, leaf, k) AS (VALUES ('1-URGENT', 'a', 'v1'), ('1-URGENT', 'n', 'v2'), ('2-HIGH', 'n', 'v3'))
SELECT o_orderkey, field, string_agg(DISTINCT k, ',' ORDER BY k) AS constraints FROM c JOIN v ON endpoint = o_orderpriority AND leaf = lower(name) GROUP BY ALL"""
)
def bound_constraints(spark, d):
    pair = F.concat_ws("=", "l_returnflag", F.concat(F.lit("f"), (F.col("l_suppkey") % 5).cast("string")))
    b = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("contract")).agg(F.collect_set(pair).alias("bindings"))
    status = F.when(F.col("o_orderstatus") == "P", "required-fields-missing").otherwise("review-required")
    contracts = table(spark, d, "orders").select(F.col("o_orderkey").alias("contract"), F.col("o_orderpriority").alias("endpoint"), status.alias("status")).join(b, "contract")
    rules = spark.createDataFrame([("1-URGENT", "v1", "Body.A"), ("1-URGENT", "v2", "N"), ("2-HIGH", "v3", "x.y.n")], "endpoint string, validation string, path string")
    g = catalog.bound_constraints(contracts, rules).groupBy(F.col("contract").alias("o_orderkey"), "field")
    return g.agg(F.array_join(F.array_sort(F.collect_set("constraint")), ",").alias("constraints"))


@query("SELECT min(o_orderkey) AS o_orderkey, o_custkey, o_orderstatus FROM orders GROUP BY o_custkey, o_orderstatus")
def deduplicated_contracts(spark, d):
    x = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", F.array("o_orderstatus").alias("fields"))
    return catalog.deduplicated(x, ["o_custkey", "fields"], "o_orderkey").drop("fields")
