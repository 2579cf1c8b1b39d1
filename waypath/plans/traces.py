"""Queries of the trace operators, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from waypath.operators import traces
from waypath.plans.contracts import ADAPTERS
from waypath.plans.queries import query, table

_ADAPTERS = "a(kinds, controls) AS (VALUES (['1-URGENT', '2-HIGH'], NULL), (['2-HIGH', '3-MEDIUM', '5-LOW'], ['O', 'F']), (['3-MEDIUM'], ['P']))"


@query(
    """WITH RECURSIVE e AS (SELECT c_custkey AS src, c_custkey // 3 AS dst, CASE WHEN c_nationkey % 2 = 0 THEN 'n=' || c_nationkey END AS guard FROM customer),
w(origin, node, guards, path) AS (SELECT src, src, CAST([] AS VARCHAR[]), [src] FROM e UNION ALL
SELECT origin, dst, CASE WHEN guard IS NULL THEN guards ELSE list_append(guards, guard) END, list_append(path, dst) FROM w JOIN e ON src = node WHERE NOT list_contains(path, dst))
SELECT origin, node, array_to_string(guards, '&') AS guards, CAST(len(path) AS BIGINT) AS length FROM w"""
)
def guarded_navigation(spark, d):
    c = table(spark, d, "customer")
    edges = c.select(F.col("c_custkey").alias("src"), F.expr("c_custkey div 3").alias("dst"), F.when(F.col("c_nationkey") % 2 == 0, F.concat(F.lit("n="), F.col("c_nationkey").cast("string"))).alias("guard"))
    walks = traces.guarded_walks(c.select(F.col("c_custkey").alias("origin"), F.col("c_custkey").alias("node")), edges)
    return walks.select("origin", "node", F.array_join("guards", "&").alias("guards"), F.size("path").cast("long").alias("length"))


@query(
    """WITH RECURSIVE c AS (SELECT c_custkey AS caller, c_custkey // 4 AS callee, 'v' || c_nationkey AS v FROM customer),
w(origin, node, a, b, path) AS (SELECT caller, caller, 'x' || c_mktsegment, 'y', [caller] FROM c JOIN customer ON c_custkey = caller UNION ALL
SELECT origin, callee, b, v, list_append(path, callee) FROM w JOIN c ON caller = node WHERE NOT list_contains(path, callee))
SELECT origin, node, a, b FROM w"""
)
def substituted_requests(spark, d):
    c = table(spark, d, "customer")
    key = F.col("c_custkey")
    calls = c.select(key.alias("caller"), F.expr("c_custkey div 4").alias("callee"), F.create_map(F.lit("a"), F.lit("$b"), F.lit("b"), F.concat(F.lit("v"), F.col("c_nationkey").cast("string"))).alias("arguments"))
    seeds = c.select(key.alias("origin"), key.alias("node"), F.create_map(F.lit("a"), F.concat(F.lit("x"), "c_mktsegment"), F.lit("b"), F.lit("y")).alias("environment"))
    return traces.substituted_walks(seeds, calls).select("origin", "node", F.col("environment")["a"].alias("a"), F.col("environment")["b"].alias("b"))


@query(
    """WITH RECURSIVE i AS (SELECT c_custkey AS artifact, c_custkey // 3 + 1 AS input FROM customer), s(artifact, hops) AS (
SELECT artifact, 0 FROM i JOIN customer ON c_custkey = input WHERE c_nationkey = 7 AND input < artifact UNION
SELECT i.artifact, hops + 1 FROM s JOIN i ON i.input = s.artifact AND i.input < i.artifact)
SELECT artifact, CAST(min(hops) AS INTEGER) AS hops FROM s GROUP BY artifact"""
)
def stale_artifacts(spark, d):
    c = table(spark, d, "customer")
    up = F.expr("c_custkey div 3 + 1")
    inputs = c.select(F.col("c_custkey").alias("artifact"), up.alias("input"), F.sha2(up.cast("string"), 256).alias("expected")).where("input < artifact")
    now = F.concat(F.col("c_custkey").cast("string"), F.when(F.col("c_nationkey") == 7, "!").otherwise(""))
    return traces.stale_lineage(inputs, c.select(F.col("c_custkey").alias("input"), F.sha2(now, 256).alias("digest")))


@query(
    """WITH n AS (SELECT l_orderkey AS o, l_linenumber AS pos, unnest([l_suppkey % 7, (l_suppkey + 1) % 7]) AS f FROM lineitem), h AS (SELECT l_orderkey AS o, l_partkey % 7 AS f, min(l_linenumber) AS first FROM lineitem GROUP BY ALL)
SELECT o AS l_orderkey, pos AS l_linenumber, string_agg(DISTINCT CAST(f AS VARCHAR), ',' ORDER BY CAST(f AS VARCHAR)) AS missing FROM n LEFT JOIN h USING (o, f) WHERE first IS NULL OR first > pos GROUP BY o, pos"""
)
def field_occurrence(spark, d):
    l = table(spark, d, "lineitem")
    at = [F.col("l_orderkey").alias("path"), F.col("l_linenumber").alias("pos")]
    s = F.col("l_suppkey")
    needs = l.select(*at, F.explode(F.array(s % 7, (s + 1) % 7)).alias("field"))
    found = traces.missing_before(needs, l.select(*at, (F.col("l_partkey") % 7).alias("field")))
    return found.select(F.col("path").alias("l_orderkey"), F.col("pos").alias("l_linenumber"), F.array_join("missing", ",").alias("missing"))


@query(
    """WITH f AS (SELECT lower(p_type || p_size) AS stem, count(*) AS n, min(p_partkey) AS field FROM part WHERE p_brand = 'Brand#1' OR p_size > 40 GROUP BY stem HAVING n = 1)
SELECT p_partkey, field FROM part LEFT JOIN f ON stem = lower(p_type || p_size) AND p_partkey % 4 <> 3"""
)
def entity_prerequisites(spark, d):
    p = table(spark, d, "part")
    name = F.concat("p_type", F.col("p_size").cast("string"))
    key = F.col("p_partkey") % 4
    path = F.concat(F.when(key == 0, "selected").when(key == 1, "Current").otherwise(""), name, F.when(key == 2, "Model").otherwise(""), F.when(key == 3, "").otherwise(".status"))
    fields = p.where("p_brand = 'Brand#1' OR p_size > 40").select(F.col("p_partkey").alias("field"), F.concat(F.lit("form."), name, F.lit("Id")).alias("data_path"))
    return traces.entity_fields(p.select("p_partkey", path.alias("path")), fields).select("p_partkey", "field")


@query(
    """WITH c AS (SELECT DISTINCT p_size AS contract, p_type AS field, p_brand AS k FROM part), o AS (SELECT DISTINCT s_nationkey AS operation, 'supplier' AS field, 's' || s_suppkey % 10 AS k FROM supplier),
r AS (SELECT c_custkey AS w, field, k FROM customer JOIN c ON contract = c_custkey % 50 WHERE c_acctbal > 0 UNION SELECT c_custkey, field, k FROM customer JOIN o ON operation = c_nationkey WHERE NOT c_acctbal > 0
UNION SELECT c_custkey, 'segment', c_mktsegment FROM customer) SELECT w AS c_custkey, field, count(*) AS n, min(k) AS first FROM r GROUP BY ALL"""
)
def contract_constraints(spark, d):
    c = table(spark, d, "customer")
    contracts = F.when(F.col("c_acctbal") > 0, F.array((F.col("c_custkey") % 50).cast("int"))).otherwise(F.array().cast("array<int>"))
    usage = c.select(F.col("c_custkey").alias("witness"), contracts.alias("contracts"), F.array("c_nationkey").alias("operations"))
    by_contract = table(spark, d, "part").select(F.col("p_size").alias("contract"), F.col("p_type").alias("field"), F.col("p_brand").alias("constraint")).distinct()
    key = F.concat(F.lit("s"), (F.col("s_suppkey") % 10).cast("string"))
    by_operation = table(spark, d, "supplier").select(F.col("s_nationkey").alias("operation"), F.lit("supplier").alias("field"), key.alias("constraint")).distinct()
    own = c.select(F.col("c_custkey").alias("witness"), F.lit("segment").alias("field"), F.col("c_mktsegment").alias("constraint"))
    found = traces.scoped_constraints(usage, by_contract, by_operation, own)
    return found.groupBy(F.col("witness").alias("c_custkey"), "field").agg(F.count("*").alias("n"), F.min("constraint").alias("first"))


@query(
    """WITH q AS (SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'O' THEN -o_custkey ELSE o_custkey * 2 END AS ref FROM orders), i AS (SELECT c_custkey AS ref, c_mktsegment AS source FROM customer),
o AS (SELECT -c_custkey AS ref, unnest([c_custkey + 1, c_custkey * 3]) AS cited FROM customer), t AS (SELECT id, q.ref, source, 'item' AS via FROM q JOIN i USING (ref)
UNION SELECT id, q.ref, source, 'operation' FROM q JOIN o USING (ref) JOIN i ON i.ref = cited WHERE q.ref NOT IN (SELECT ref FROM i) UNION SELECT id, ref, NULL, 'unresolved' FROM q WHERE ref NOT IN (SELECT ref FROM i) AND ref NOT IN (SELECT ref FROM o))
SELECT id AS o_orderkey, via, source FROM t"""
)
def traced_refs(spark, d):
    c, key = table(spark, d, "customer"), F.col("c_custkey")
    asked = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "O", -F.col("o_custkey")).otherwise(F.col("o_custkey") * 2).alias("ref"))
    found = traces.traced_sources(asked, c.select(key.alias("ref"), F.col("c_mktsegment").alias("source")), c.select((-key).alias("ref"), F.array(key + 1, key * 3).alias("refs")))
    return found.select(F.col("id").alias("o_orderkey"), "via", "source")


@query(
    """SELECT n_name AS page, coalesce((SELECT string_agg(DISTINCT c_mktsegment, ',' ORDER BY c_mktsegment) FROM customer WHERE c_nationkey = n_nationkey AND c_acctbal > 0), '') AS fields,
coalesce((SELECT string_agg(DISTINCT CASE WHEN s_acctbal > 5000 THEN 'approve' ELSE 'review' END, ',' ORDER BY CASE WHEN s_acctbal > 5000 THEN 'approve' ELSE 'review' END) FROM supplier WHERE s_nationkey = n_nationkey), '') AS actions,
CASE WHEN n_regionkey = 2 THEN 'partial' ELSE 'exact' END AS completeness FROM nation"""
)
def page_contract_assembly(spark, d):
    n = table(spark, d, "nation")
    pages = n.select(F.col("n_nationkey").alias("page"), F.array("n_name").alias("routes"), F.when(F.col("n_regionkey") == 2, "partial").alias("completeness"))
    fields = table(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_nationkey").alias("page"), F.col("c_mktsegment").alias("field"))
    actions = table(spark, d, "supplier").select(F.col("s_nationkey").alias("page"), F.when(F.col("s_acctbal") > 5000, "approve").otherwise("review").alias("action"))
    out = traces.page_contracts(pages, fields, actions)
    return out.select(F.col("routes")[0].alias("page"), F.array_join("fields", ",").alias("fields"), F.array_join("actions", ",").alias("actions"), "completeness")


@query(
    """WITH c AS (SELECT l_orderkey, l_linenumber, unnest(['p' || l_partkey % 100, 's' || l_suppkey % 10]) AS c FROM lineitem)
SELECT l_orderkey, sha256(string_agg(c, ',' ORDER BY l_linenumber, c)) AS signature, count(DISTINCT c) AS contracts FROM c GROUP BY l_orderkey"""
)
def payload_signature(spark, d):
    part, supp = F.concat(F.lit("p"), (F.col("l_partkey") % 100).cast("string")), F.concat(F.lit("s"), (F.col("l_suppkey") % 10).cast("string"))
    steps = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("witness"), F.col("l_linenumber").alias("pos"), F.array(part, supp).alias("contracts"))
    return traces.payload_signatures(steps).select(F.col("witness").alias("l_orderkey"), "signature", F.size("contracts").cast("long").alias("contracts"))


@query(
    """SELECT o_orderkey, count(*) FILTER (l_returnflag = 'N') AS pages, count(*) FILTER (l_returnflag = 'R') AS actions, any_value(c_mktsegment) AS assignments
FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey LEFT JOIN customer ON c_custkey = o_custkey GROUP BY o_orderkey"""
)
def flow_listing(spark, d):
    variants = table(spark, d, "orders").select(F.col("o_orderkey").alias("variant"), F.col("o_custkey").alias("witness"))
    kind = F.when(F.col("l_returnflag") == "N", "page").when(F.col("l_returnflag") == "R", "action")
    steps = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("variant"), kind.alias("kind"))
    witnesses = table(spark, d, "customer").select(F.col("c_custkey").alias("witness"), F.col("c_mktsegment").alias("assignments"))
    return traces.flow_list(variants, steps, witnesses).withColumnRenamed("variant", "o_orderkey")


@query(
    """SELECT user_id, kind, event_id AS target, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id, kind) AS sequence
FROM (SELECT user_id, ts, event_id, unnest(['screen', 'action']) AS kind FROM events)"""
)
def manifest_sequence(spark, d):
    steps = table(spark, d, "events").select("user_id", "ts", F.col("event_id").alias("target"), F.explode(F.array(F.lit("screen"), F.lit("action"))).alias("kind"))
    return traces.numbered_steps(steps, "user_id", ["ts", "target", "kind"]).drop("ts")


@query(
    """SELECT issue, count(*) AS n FROM (SELECT CASE WHEN o_orderpriority = '5-LOW' THEN 'environment' WHEN o_totalprice < 1000 THEN 'configuration' WHEN c_acctbal IS NULL OR c_acctbal < 0 THEN 'adapters'
WHEN o_orderdate + INTERVAL 30 MINUTE <= TIMESTAMP '1996-01-01' THEN 'expired' ELSE 'valid' END AS issue FROM orders LEFT JOIN customer ON c_custkey = o_custkey) GROUP BY issue"""
)
def manifest_validity(spark, d):
    o = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("c_custkey") == F.col("o_custkey"), "left")
    gate = traces.manifest_gate([
        ("environment", F.col("o_orderpriority") != "5-LOW"), ("configuration", F.col("o_totalprice") >= 1000), ("adapters", F.col("c_acctbal") >= 0),
        ("expired", F.expr("o_orderdate + INTERVAL 30 MINUTES > TIMESTAMP_NTZ '1996-01-01'")),
    ])
    return o.groupBy(gate.alias("issue")).agg(F.count("*").alias("n"))


@query(
    f"""WITH {_ADAPTERS} SELECT o_orderpriority AS kind, o_orderstatus AS control, count(*) AS n FROM orders
WHERE NOT EXISTS (SELECT 1 FROM a WHERE list_contains(kinds, o_orderpriority) AND (controls IS NULL OR list_contains(controls, o_orderstatus))) GROUP BY ALL"""
)
def uncovered_targets(spark, d):
    targets = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("kind"), F.col("o_orderstatus").alias("control")).agg(F.count("*").alias("n"))
    return traces.uncovered(targets, spark.createDataFrame(ADAPTERS, "adapter string, kinds array<string>, controls array<string>")).select("kind", "control", "n")


@query(
    """WITH g AS (SELECT c_custkey AS e, c_acctbal > 3000 AS auth, c_mktsegment AS allowed FROM customer WHERE c_nationkey < 20),
p AS (SELECT o_orderkey, o_custkey AS e, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k, CASE WHEN o_orderstatus <> 'P' THEN CASE WHEN o_orderpriority < '4' THEN 'BUILDING' ELSE 'MACHINERY' END END AS a, CASE WHEN o_totalprice > 200000 THEN 'x' END AS s FROM orders)
SELECT issue, count(*) AS n FROM (SELECT CASE WHEN g.e IS NULL THEN 'endpoint-not-allowed' WHEN k > 1 THEN 'resolved-twice' WHEN a IS NULL AND s IS NULL THEN 'resolves-nothing' WHEN a IS NOT NULL AND NOT auth THEN 'no-authorization-gap'
WHEN a IS NOT NULL AND a <> allowed THEN 'unapproved-authority' WHEN s IS NOT NULL AND auth THEN 'no-predicate-gap' ELSE 'accepted' END AS issue FROM p LEFT JOIN g USING (e)) GROUP BY issue"""
)
def packet_proposals(spark, d):
    kinds = F.array(F.when(F.col("c_acctbal") > 3000, "authorization").otherwise("success-predicate"))
    gaps = table(spark, d, "customer").where("c_nationkey < 20").select(F.col("c_custkey").alias("endpoint"), kinds.alias("kinds"), F.array("c_mktsegment").alias("allowed"))
    authority = F.when(F.col("o_orderstatus") != "P", F.array(F.when(F.col("o_orderpriority") < "4", "BUILDING").otherwise("MACHINERY")))
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("proposal"), F.col("o_custkey").alias("endpoint"), authority.alias("authorities"), F.when(F.col("o_totalprice") > 200000, "x").alias("predicate"))
    return traces.proposal_issues(o, gaps).groupBy("issue").agg(F.count("*").alias("n"))


@query(
    """SELECT 'events' AS name, 'event_type' AS "column", event_type AS value, count(*) AS n FROM events GROUP BY event_type UNION ALL SELECT 'documents', 'lang', lang, count(*) FROM documents GROUP BY lang
UNION ALL SELECT 'documents', 'source', source, count(*) FROM documents GROUP BY source UNION ALL SELECT 'orders', 'o_orderstatus', o_orderstatus, count(*) FROM orders GROUP BY o_orderstatus"""
)
def graph_summary(spark, d):
    t = lambda n: table(spark, d, n)
    return traces.summary(events=(t("events"), ["event_type"]), documents=(t("documents"), ["lang", "source"]), orders=(t("orders"), ["o_orderstatus"]))


@query(
    """WITH i AS (SELECT 'customer' AS kind, c_custkey AS id, c_name AS label FROM customer WHERE c_acctbal > 0), l AS (SELECT c_custkey AS src, c_custkey // 5 AS dst FROM customer)
SELECT a.kind, a.id, i.id IS NOT NULL AS known, label, CASE WHEN i.id IS NOT NULL THEN (SELECT string_agg(dst, ',' ORDER BY dst) FROM l WHERE src = a.id) END AS cites, CASE WHEN i.id IS NOT NULL THEN (SELECT string_agg(src, ',' ORDER BY src) FROM l WHERE dst = a.id) END AS cited_by
FROM (SELECT DISTINCT CASE WHEN o_orderkey % 3 = 0 THEN 'page' ELSE 'customer' END AS kind, o_custkey AS id FROM orders) a LEFT JOIN i ON i.kind = a.kind AND i.id = a.id"""
)
def explained_items(spark, d):
    asked = table(spark, d, "orders").select(F.when(F.col("o_orderkey") % 3 == 0, "page").otherwise("customer").alias("kind"), F.col("o_custkey").alias("id"))
    c = table(spark, d, "customer")
    items = c.where("c_acctbal > 0").select(F.lit("customer").alias("kind"), F.col("c_custkey").alias("id"), F.col("c_name").alias("label"))
    out = traces.explained(asked, items, c.select(F.col("c_custkey").alias("src"), F.expr("c_custkey div 5").alias("dst")))
    listed = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c)
    return out.select("kind", "id", "known", "label", listed("cites"), listed("cited_by"))
