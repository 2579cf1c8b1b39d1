"""Queries of the operators that lead from facts to contracts, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from waypath.functions import constraints as C
from waypath.functions import ids
from waypath.operators import contracts, coverage, joins, sequences
from waypath.plans.queries import PATH, SLUG, STEP_KIND, query, table


@query(
    f"""WITH a AS (SELECT p_partkey AS ordinal, p_brand AS concept, unnest([p_name, p_type || ' ' || p_size]) AS alias FROM part WHERE p_size > 5),
k AS (SELECT {SLUG.format('alias')} AS s, arg_min(concept, ordinal) AS concept FROM a GROUP BY s), e AS (SELECT p_partkey, p_type || '-' || p_size AS entity FROM part)
SELECT p_partkey, entity, k.concept FROM e LEFT JOIN k ON k.s = {SLUG.format('entity')}"""
)
def alias_concepts(spark, d):
    p = table(spark, d, "part")
    size = F.col("p_size").cast("string")
    concepts = p.where("p_size > 5").select(F.array("p_name", F.concat_ws(" ", "p_type", size)).alias("aliases"), F.col("p_partkey").alias("ordinal"), F.col("p_brand").alias("concept"))
    return contracts.alias_join(p.select("p_partkey", F.concat_ws("-", "p_type", size).alias("entity")), concepts, "entity", "aliases", "ordinal", ["concept"])


SECURITY = [(1, "/en/admin", "deny"), (2, "/fr/**", "authenticated"), (3, "/en/**", "public"), (4, "/de/7/**", "review"), (5, "/**", "fallback")]


@query(
    f"""WITH rules(ordinal, pattern, access) AS (VALUES {', '.join(map(str, SECURITY))}), p AS (SELECT page_id, {PATH} AS path FROM pages),
h AS (SELECT path, access, row_number() OVER (PARTITION BY path ORDER BY ordinal) AS k FROM (SELECT DISTINCT path FROM p) JOIN rules ON path = pattern
 OR (suffix(pattern, '/**') AND (path = left(pattern, -3) OR starts_with(path, left(pattern, -2)))))
SELECT page_id, path, access FROM p LEFT JOIN (SELECT * FROM h WHERE k = 1) USING (path)"""
)
def security_rules(spark, d):
    rules = spark.createDataFrame(SECURITY, "ordinal int, pattern string, access string")
    p = table(spark, d, "pages").select("page_id", ids.url_path(F.col("url")).alias("path"))
    return contracts.prefix_rules(p, rules, "path", "pattern", "ordinal", ["access"]).select("page_id", "path", "access")


@query(
    """WITH g AS (SELECT s_suppkey AS gap, s_suppkey AS scope, [s_suppkey * 3, s_suppkey * 5 + 1] AS refs FROM supplier), f AS (SELECT c_custkey AS diagnostic, c_custkey // 12 AS scope, [c_custkey, c_custkey + 7] AS refs FROM customer),
p AS (SELECT gap, diagnostic FROM g JOIN f USING (scope) UNION SELECT gap, diagnostic FROM (SELECT gap, unnest(refs) AS r FROM g) JOIN (SELECT diagnostic, unnest(refs) AS r FROM f) USING (r))
SELECT gap, diagnostic, rank FROM (SELECT *, row_number() OVER (PARTITION BY gap ORDER BY diagnostic) AS rank FROM p) WHERE rank <= 40"""
)
def gap_diagnostics(spark, d):
    s, c = F.col("s_suppkey"), F.col("c_custkey")
    gaps = table(spark, d, "supplier").select(s.alias("gap"), s.alias("scope"), F.array(s * 3, s * 5 + 1).alias("refs"))
    found = table(spark, d, "customer").select(c.alias("diagnostic"), F.expr("c_custkey div 12").alias("scope"), F.array(c, c + 7).alias("refs"))
    return joins.top_of_each(contracts.scope_or_refs(gaps, found), ["gap"], [F.asc("diagnostic")], 40)


ADAPTERS = [("browser", ["1-URGENT", "2-HIGH"], None), ("service", ["2-HIGH", "3-MEDIUM", "5-LOW"], ["O", "F"]), ("console", ["3-MEDIUM"], ["P"])]


@query(
    """WITH a(adapter, kinds, controls) AS (VALUES ('browser', ['1-URGENT', '2-HIGH'], NULL), ('service', ['2-HIGH', '3-MEDIUM', '5-LOW'], ['O', 'F']), ('console', ['3-MEDIUM'], ['P']))
SELECT adapter, kind, control, count(*) AS n FROM (SELECT adapter, o_orderpriority AS kind, o_orderstatus AS control FROM orders JOIN a ON list_contains(kinds, o_orderpriority) AND (controls IS NULL OR list_contains(controls, o_orderstatus))) GROUP BY ALL"""
)
def permitted_adapters(spark, d):
    a = spark.createDataFrame(ADAPTERS, "adapter string, kinds array<string>, controls array<string>")
    o = table(spark, d, "orders").select(F.col("o_orderpriority").alias("kind"), F.col("o_orderstatus").alias("control"))
    return coverage.count_by(contracts.permitted(o, a, "kind", "control"), "adapter", "kind", "control")


@query(
    """SELECT o_orderkey, coalesce(string_agg(DISTINCT p_brand, ',' ORDER BY p_brand), '') AS sources, count(DISTINCT CASE WHEN l_partkey IS NOT NULL AND p_partkey IS NULL THEN l_partkey END) AS unresolved
FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey LEFT JOIN (SELECT * FROM part WHERE p_size > 10) ON p_partkey = l_partkey GROUP BY o_orderkey"""
)
def edge_source_refs(spark, d):
    lines = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_set("l_partkey").alias("refs"))
    edges = table(spark, d, "orders").select("o_orderkey").join(lines, "o_orderkey", "left")
    out = contracts.resolved_refs(edges, table(spark, d, "part").where("p_size > 10"), "o_orderkey", "refs", "p_partkey", "p_brand")
    return out.select("o_orderkey", F.array_join("sources", ",").alias("sources"), "unresolved")


@query(
    """WITH f AS (SELECT p_partkey AS field, p_type || '.' || replace(p_name, ' ', '.') || p_partkey % 90 AS fp FROM part WHERE p_size <= 25), p AS (SELECT p_partkey, p_type || '.' || upper(replace(p_name, ' ', '.')) || p_partkey % 70 AS path FROM part WHERE p_size > 25
UNION ALL SELECT p_partkey, p_type || '.' || replace(p_name, ' ', '.') || p_partkey % 90 FROM part WHERE p_size <= 25),
x AS (SELECT fp, min(field) AS e FROM f GROUP BY fp), l AS (SELECT lower(split_part(fp, '.', -1)) AS leaf, count(*) AS n, min(field) AS one FROM f GROUP BY leaf)
SELECT p_partkey, path, coalesce(e, CASE WHEN n = 1 THEN one END) AS field, CASE WHEN e IS NOT NULL THEN 'exact' WHEN n IS NULL THEN 'missing' WHEN n = 1 THEN 'leaf' ELSE 'ambiguous' END AS match
FROM p LEFT JOIN x ON fp = path LEFT JOIN l ON leaf = lower(split_part(path, '.', -1))"""
)
def payload_fields(spark, d):
    p = table(spark, d, "part")
    name = F.regexp_replace("p_name", " ", ".")
    path = lambda n, m: F.concat("p_type", F.lit("."), n, (F.col("p_partkey") % m).cast("string"))
    fields = p.where("p_size <= 25").select(F.col("p_partkey").alias("field"), path(name, 90).alias("field_path"))
    paths = p.select("p_partkey", F.when(F.col("p_size") > 25, path(F.upper(name), 70)).otherwise(path(name, 90)).alias("path"))
    return contracts.leaf_matches(paths, fields, "p_partkey", "path", "field", "field_path")


@query(
    """SELECT leaf, kind, value, domain, min(id) AS id, count(*) AS merged FROM (SELECT p_partkey AS id, lower(split_part(p_name, ' ', -1)) AS leaf, CASE WHEN p_size > 25 THEN 'max' ELSE 'min' END AS kind, CAST(p_size AS VARCHAR) AS value, p_type AS domain FROM part) GROUP BY ALL"""
)
def constraint_semantic_dedupe(spark, d):
    kind = F.when(F.col("p_size") > 25, "max").otherwise("min").alias("kind")
    c = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.regexp_replace(F.initcap("p_name"), " ", ".").alias("path"), kind, F.col("p_size").cast("string").alias("value"), F.col("p_type").alias("domain"))
    return contracts.unique_constraints(c)


@query(
    """SELECT p_brand, p_type, string_agg(DISTINCT p_name, '|' ORDER BY p_name) AS options, count(*) AS members, CASE WHEN count(DISTINCT p_size > 40) = 1 THEN CASE WHEN bool_and(p_size > 40) THEN 'opaque' ELSE 'active' END ELSE 'conditional' END AS status,
bool_or(p_retailprice > 1000) AS visible FROM part GROUP BY ALL"""
)
def choice_fields(spark, d):
    status = F.when(F.col("p_size") > 40, "opaque").otherwise("active").alias("status")
    m = table(spark, d, "part").select("p_brand", "p_type", F.col("p_name").alias("option"), status, (F.col("p_retailprice") > 1000).alias("visible"))
    return contracts.merge_choices(m, ["p_brand", "p_type"]).withColumn("options", F.array_join("options", "|"))


@query(
    """WITH o AS (SELECT o_orderkey AS operation, o_orderpriority LIKE '1%' AS conditional, CASE WHEN o_orderstatus = 'O' THEN 'excluded' ELSE 'included' END AS inclusion FROM orders),
a AS (SELECT l_orderkey AS operation, string_agg(DISTINCT l_linestatus || l_returnflag, ',' ORDER BY l_linestatus || l_returnflag) AS s FROM lineitem GROUP BY l_orderkey)
SELECT operation, CASE WHEN conditional THEN 'opaque' WHEN s IS NULL THEN 'anonymous' ELSE 'actor.' || substr(sha256(s), 1, 12) END AS actor, CASE WHEN NOT conditional THEN s END AS authorities, CASE WHEN conditional THEN 'review-required' ELSE inclusion END AS inclusion
FROM o LEFT JOIN a USING (operation) WHERE inclusion <> 'excluded'"""
)
def actor_requirements(spark, d):
    inclusion = F.when(F.col("o_orderstatus") == "O", "excluded").otherwise("included").alias("inclusion")
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("operation"), F.col("o_orderpriority").startswith("1").alias("conditional"), inclusion)
    return contracts.actor_requirements(o, table(spark, d, "lineitem").select(F.col("l_orderkey").alias("operation"), F.concat("l_linestatus", "l_returnflag").alias("authority")))


@query(
    """SELECT variant, kind, target, CASE WHEN bool_and(generated) THEN 'generated' ELSE 'unresolved' END AS status FROM (SELECT l_orderkey AS variant, 'field' AS kind, CAST(l_partkey AS VARCHAR) AS target, l_returnflag <> 'R' AS generated FROM lineitem
UNION ALL SELECT o_orderkey, 'identity', CAST(o_custkey AS VARCHAR), FALSE FROM orders UNION ALL SELECT o_orderkey, 'attribute', c_mktsegment, c_acctbal > 0 FROM orders JOIN customer ON c_custkey = o_custkey) GROUP BY ALL"""
)
def data_requirements(spark, d):
    o, v = table(spark, d, "orders"), F.col("o_orderkey").alias("variant")
    fields = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("variant"), F.col("l_partkey").cast("string").alias("target"), (F.col("l_returnflag") != "R").alias("generated"))
    actors = o.select(v, F.col("o_custkey").cast("string").alias("target"), F.lit(False).alias("generated"))
    owners = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment", "c_acctbal")
    attributes = o.join(owners, "o_custkey").select(v, F.col("c_mktsegment").alias("target"), (F.col("c_acctbal") > 0).alias("generated"))
    return contracts.data_requirements(fields, actors, attributes)


@query(
    """WITH s AS (SELECT l_orderkey, l_linenumber, l_suppkey, CASE WHEN l_returnflag <> 'N' THEN l_returnflag END AS flag FROM lineitem), b AS (SELECT s_suppkey AS suppkey, CASE WHEN s_nationkey % 3 = 0 THEN NULL WHEN s_nationkey % 3 = 1 THEN 'A' ELSE 'R' END AS flag, s_name AS value FROM supplier)
SELECT bound, count(*) AS n, count(DISTINCT value) AS used FROM (SELECT b.suppkey IS NOT NULL AS bound, value FROM s LEFT JOIN b ON s.l_suppkey = b.suppkey AND s.flag IS NOT DISTINCT FROM b.flag) GROUP BY bound"""
)
def runtime_bindings(spark, d):
    steps = table(spark, d, "lineitem").select("l_suppkey", F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")).alias("flag"))
    k = F.col("s_nationkey") % 3
    bound = table(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.when(k == 1, "A").when(k == 2, "R").alias("flag"), F.col("s_acctbal").alias("at"), F.col("s_name").alias("value"))
    return contracts.runtime_bindings(steps, bound, ["l_suppkey", "flag"], "at", "value").groupBy("bound").agg(F.count("*").alias("n"), F.count_distinct("value").alias("used"))


@query(
    """SELECT o_orderkey, CASE WHEN coalesce(a, 0) > 0 THEN 'blocked-data' WHEN coalesce(b, 0) > 0 THEN 'blocked-runtime' ELSE 'ready' END AS readiness FROM orders
LEFT JOIN (SELECT l_orderkey, count(CASE WHEN l_returnflag = 'R' THEN 1 END) AS a, count(CASE WHEN l_linestatus = 'O' THEN 1 END) AS b FROM lineitem GROUP BY l_orderkey) ON l_orderkey = o_orderkey"""
)
def execution_readiness(spark, d):
    n = lambda c, v: F.count(F.when(F.col(c) == v, 1))
    lines = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(n("l_returnflag", "R").alias("a"), n("l_linestatus", "O").alias("b"))
    x = table(spark, d, "orders").select("o_orderkey").join(lines, "o_orderkey", "left")
    return x.select("o_orderkey", contracts.readiness(F.coalesce("a", F.lit(0)), F.coalesce("b", F.lit(0))).alias("readiness"))


@query(
    f"""WITH s AS (SELECT conv_id, turn, {STEP_KIND} AS kind FROM conversations), m AS (SELECT *, max(CASE WHEN kind = 'action' THEN turn END) OVER (PARTITION BY conv_id) AS last FROM s)
SELECT conv_id, count(CASE WHEN kind = 'screen' AND turn <= last THEN 1 END) AS screens, max(last) AS last_action FROM m GROUP BY conv_id"""
)
def input_screens(spark, d):
    kind = F.when(F.col("turn") == 0, "screen").when(F.col("role") == "user", "action").otherwise("operation")
    s = sequences.last_position(table(spark, d, "conversations").select("conv_id", "turn", kind.alias("kind")), ["conv_id"], "turn", F.col("kind") == "action")
    return s.groupBy("conv_id").agg(F.count(F.when((F.col("kind") == "screen") & (F.col("turn") <= F.col("last")), 1)).alias("screens"), F.max("last").alias("last_action"))


@query(
    """SELECT user_id, count(*) AS cut FROM (SELECT user_id, max(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, strftime(ts, '%Y-%m-%d') ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS c FROM events) WHERE c = 1 GROUP BY user_id"""
)
def unreachable_steps(spark, d):
    e = table(spark, d, "events").select("user_id", F.date_format("ts", "yyyy-MM-dd").alias("day"), "ts", "event_id", "event_type")
    cut = sequences.after_terminator(e, ["user_id", "day"], ["ts", "event_id"], F.col("event_type") == "error")
    return cut.where("cut").groupBy("user_id").agg(F.count("*").alias("cut"))


@query(
    """SELECT p_partkey, upper(p_name[1]) || lower(p_name[2:]) AS command, split_part(p_name, ' ', -1) AS leaf, '@' || regexp_replace(p_name || '!' || p_type, '[^A-Za-z0-9_.-]+', '-', 'g') AS tag, regexp_matches(p_name, '(^| )(pin|token|secret)( |$)') AS hidden FROM part"""
)
def name_functions(spark, d):
    name = F.col("p_name")
    return table(spark, d, "part").select(
        "p_partkey", ids.command_words(name).alias("command"), ids.leaf_name(F.regexp_replace(name, " ", ".")).alias("leaf"),
        ids.gherkin_tag(F.concat_ws("!", "p_name", "p_type")).alias("tag"), C.sensitive(name).alias("hidden"),
    )


@query("SELECT o_orderkey, o_custkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 20")
def recent_runs(spark, d):
    return table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).limit(20)
