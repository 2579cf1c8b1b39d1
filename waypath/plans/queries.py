"""The library's operators applied to the driver's tables, each with the SQL that gives the same rows.

events stand for sessions and behaviour edges, orders for operations with their lines as evidence, pages for routes
and navigations, documents for sources, labels for reviews, conversations for ordered steps.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from waypath.functions import constraints as C
from waypath.functions import ids
from waypath.functions import predicates as P
from waypath.operators import coverage, graph, joins, sequences

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def day(c: str) -> Column:
    return F.date_format(c, "yyyy-MM-dd")


# --- identity and names ---------------------------------------------------------------------------------------------

SLUG = "coalesce(nullif(regexp_replace(regexp_replace(lower(regexp_replace({0}, '([a-z0-9])([A-Z])', '\\1-\\2', 'g')), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g'), ''), 'unnamed')"


@query(f"SELECT p_partkey, {SLUG.format('p_name')} AS slug, 'part.' || substr({SLUG.format('p_name')}, 1, 72) || '.' || substr(sha256('part:' || p_name), 1, 12) AS stable_id FROM part")
def stable_ids(spark, d):
    name = F.col("p_name")
    return table(spark, d, "part").select("p_partkey", ids.slug(name).alias("slug"), ids.stable_id(F.lit("part"), name).alias("stable_id"))


PATH = r"coalesce(nullif(regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1), ''), '/')"
TEMPLATE = r"coalesce(nullif(regexp_replace(regexp_replace(regexp_replace({0}, '[0-9]+', ':n', 'g'), ':[A-Za-z_][A-Za-z0-9_]*|\{{[^}}/]*\}}', '{{param}}', 'g'), '/+', '/', 'g'), ''), '/')"


@query(
    f"SELECT template, count(*) AS n, min(page_id) AS first_page FROM (SELECT page_id, coalesce(nullif(regexp_replace({TEMPLATE.format(PATH)}, '/$', ''), ''), '/') AS template FROM pages) GROUP BY template HAVING count(*) > 1"
)
def route_template_collisions(spark, d):
    p = table(spark, d, "pages").select("page_id", ids.normal_template(F.regexp_replace(ids.url_path(F.col("url")), "[0-9]+", ":n")).alias("template"))
    first = p.groupBy("template").agg(F.min("page_id").alias("first_page"))
    return joins.collisions(p, ["template"]).join(first, "template")


@query(
    f"""WITH r AS (SELECT page_id, {PATH} AS route FROM pages), t AS (SELECT page_id AS ordinal, regexp_replace({PATH}, '[0-9]+', '{{param}}', 'g') AS template FROM pages),
k AS (SELECT template, min(ordinal) AS ordinal FROM (SELECT coalesce(nullif(regexp_replace(regexp_replace(template, '/+', '/', 'g'), '/$', ''), ''), '/') AS template, ordinal FROM t) GROUP BY template),
n AS (SELECT page_id, coalesce(nullif(regexp_replace(regexp_replace(route, '/+', '/', 'g'), '/$', ''), ''), '/') AS route FROM r),
h AS (SELECT page_id, template, row_number() OVER (PARTITION BY page_id ORDER BY route <> template, ordinal) AS k FROM n JOIN k ON route = template
  OR regexp_matches(route, '^' || replace(regexp_replace(template, '([\\\\.\\[\\]()*+?^$|])', '\\\\\\1', 'g'), '{{param}}', '[^/]+') || '$'))
SELECT n.page_id, h.template AS matched FROM n LEFT JOIN h ON n.page_id = h.page_id AND h.k = 1"""
)
def navigation_resolution(spark, d):
    p = table(spark, d, "pages").select("page_id", ids.url_path(F.col("url")).alias("route"))
    t = p.select(F.regexp_replace("route", "[0-9]+", "{param}").alias("template"), F.col("page_id").alias("ordinal"))
    return joins.template_join(p, t, "route", "template", "ordinal").select("page_id", "matched")


@query("SELECT doc_id, 'sha256:' || sha256(coalesce(text, '')) AS digest FROM documents")
def snapshot_digest(spark, d):
    return table(spark, d, "documents").select("doc_id", ids.digest(F.coalesce("text", F.lit(""))).alias("digest"))


TREE = """WITH l0 AS (SELECT source, doc_id AS pos, sha256(coalesce(text, '')) AS h, 1 AS n FROM documents),
l1 AS (SELECT source, pos >> 8 AS pos, sha256(string_agg(pos || ':' || h, ',' ORDER BY pos, h)) AS h, sum(n) AS n FROM l0 GROUP BY source, pos >> 8),
l2 AS (SELECT source, pos >> 8 AS pos, sha256(string_agg(pos || ':' || h, ',' ORDER BY pos, h)) AS h, sum(n) AS n FROM l1 GROUP BY source, pos >> 8),
l3 AS (SELECT source, pos >> 8 AS pos, sha256(string_agg(pos || ':' || h, ',' ORDER BY pos, h)) AS h, sum(n) AS n FROM l2 GROUP BY source, pos >> 8),
l4 AS (SELECT source, pos >> 8 AS pos, sha256(string_agg(pos || ':' || h, ',' ORDER BY pos, h)) AS h, sum(n) AS n FROM l3 GROUP BY source, pos >> 8)
SELECT source, 'sha256:' || sha256(string_agg(pos || ':' || h, ',' ORDER BY pos, h)) AS digest, CAST(sum(n) AS BIGINT) AS files FROM l4 GROUP BY source"""


@query(TREE)
def source_lineage_digest(spark, d):
    x = table(spark, d, "documents").select("source", F.col("doc_id").alias("pos"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("h"))
    return coverage.digest_tree(x, ["source"]).withColumnRenamed("n", "files")


# --- evidence and joins ---------------------------------------------------------------------------------------------


@query(
    "SELECT kind, count(*) AS n FROM (SELECT 'customer' AS kind FROM customer UNION ALL SELECT 'operation' FROM orders UNION ALL SELECT 'part' FROM part UNION ALL SELECT 'page' FROM pages UNION ALL SELECT 'source' FROM documents) GROUP BY kind"
)
def evidence_node_counts(spark, d):
    t = lambda n: table(spark, d, n)
    nodes = coverage.facts(
        ("customer", t("customer"), F.col("c_custkey"), F.col("c_name")), ("operation", t("orders"), F.col("o_orderkey"), F.col("o_orderpriority")),
        ("part", t("part"), F.col("p_partkey"), F.col("p_name")), ("page", t("pages"), F.col("page_id"), F.col("url")), ("source", t("documents"), F.col("doc_id"), F.col("source")),
    )
    return coverage.count_by(nodes, "kind")


@query(
    """SELECT r_name, n_name, count(DISTINCT o_orderkey) AS operations, count(*) AS evidence FROM region JOIN nation ON r_regionkey = n_regionkey JOIN customer ON c_nationkey = n_nationkey
JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey WHERE p_size >= 10 GROUP BY r_name, n_name"""
)
def evidence_edge_join_chain(spark, d):
    t = lambda n: table(spark, d, n)
    x = t("lineitem").select("l_orderkey", "l_partkey").join(t("part").where("p_size >= 10").select("p_partkey"), F.col("p_partkey") == F.col("l_partkey"))
    x = x.join(t("orders").select("o_orderkey", "o_custkey"), F.col("o_orderkey") == F.col("l_orderkey")).groupBy("o_custkey", "o_orderkey").agg(F.count("*").alias("lines"))
    x = x.join(t("customer").select("c_custkey", "c_nationkey"), F.col("c_custkey") == F.col("o_custkey"))
    x = x.join(t("nation"), F.col("n_nationkey") == F.col("c_nationkey")).join(t("region"), F.col("r_regionkey") == F.col("n_regionkey"))
    return x.groupBy("r_name", "n_name").agg(F.count("*").alias("operations"), F.sum("lines").alias("evidence"))


@query(
    """WITH p AS (SELECT p_brand, p_type, count(*) AS n, min(p_partkey) AS part FROM part WHERE p_size <= 3 GROUP BY ALL)
SELECT a.p_partkey, CASE WHEN n = 1 THEN part END AS matched, CASE WHEN n IS NULL THEN 'missing' WHEN n > 1 THEN 'ambiguous' ELSE 'unique' END AS match FROM part a LEFT JOIN p USING (p_brand, p_type)"""
)
def unique_only_join(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_brand", "p_type", "p_size")
    right = p.where("p_size <= 3").select("p_brand", "p_type", F.col("p_partkey").alias("matched"))
    return joins.unique_join(p, right, ["p_brand", "p_type"], ["matched"]).select("p_partkey", "matched", "match")


@query(
    """WITH a AS (SELECT p_brand, p_type, count(*) AS n, min(p_partkey) AS v FROM part WHERE p_size > 25 GROUP BY ALL), b AS (SELECT p_brand, count(*) AS n, min(p_partkey) AS v FROM part WHERE p_size > 45 GROUP BY ALL)
SELECT p.p_partkey, CASE WHEN a.n = 1 THEN a.v WHEN a.n IS NULL AND b.n = 1 THEN b.v END AS handler, CASE WHEN a.n IS NOT NULL THEN 1 WHEN b.n IS NOT NULL THEN 2 ELSE 0 END AS level
FROM part p LEFT JOIN a USING (p_brand, p_type) LEFT JOIN b USING (p_brand)"""
)
def fallback_resolution(spark, d):
    p = table(spark, d, "part")
    rows = p.select("p_partkey", "p_brand", "p_type")
    handler = F.col("p_partkey").alias("handler")
    tries = [(p.where("p_size > 25").select("p_brand", "p_type", handler), ["p_brand", "p_type"]), (p.where("p_size > 45").select("p_brand", handler), ["p_brand"])]
    return joins.fallback_join(rows, tries, "handler").select("p_partkey", "handler", "level")


RULES = [(1, 1500.0, "deny"), (2, 1200.0, "review"), (3, 1000.0, "allow"), (4, 950.0, "public")]


@query(
    """WITH rules(ordinal, floor_price, action) AS (VALUES (1, 1500.0, 'deny'), (2, 1200.0, 'review'), (3, 1000.0, 'allow'), (4, 950.0, 'public')),
h AS (SELECT p_partkey, action, row_number() OVER (PARTITION BY p_partkey ORDER BY ordinal) AS k FROM part JOIN rules ON p_retailprice >= floor_price)
SELECT p.p_partkey, h.action FROM part p LEFT JOIN h ON p.p_partkey = h.p_partkey AND k = 1"""
)
def first_match_rule(spark, d):
    rules = spark.createDataFrame(RULES, "ordinal int, floor_price double, action string")
    p = table(spark, d, "part").select("p_partkey", "p_retailprice")
    return joins.first_match(p, rules, F.col("p_retailprice") >= F.col("floor_price"), "p_partkey", "ordinal", ["action"]).select("p_partkey", "action")


@query("SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 0) UNION SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT'")
def permission_semi(spark, d):
    s = table(spark, d, "supplier").where("s_acctbal > 0").select(F.col("s_nationkey").alias("c_nationkey"))
    backed = table(spark, d, "customer").join(s, "c_nationkey", "left_semi").select("c_custkey")
    return backed.union(table(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select("o_custkey")).distinct()


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def missing_bindings(spark, d):
    return table(spark, d, "orders").select("o_orderkey").join(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_anti")


@query(
    """SELECT status, count(*) AS n FROM (SELECT CASE WHEN d.n_chars < 200 THEN 'generated' WHEN l.doc_id IS NULL THEN 'missing' WHEN l.quality = 1 THEN 'verified' ELSE 'unverified' END AS status
FROM documents d LEFT JOIN labels l USING (doc_id)) GROUP BY status"""
)
def requirement_status(spark, d):
    labels = table(spark, d, "labels").select("doc_id", F.col("doc_id").alias("bound"), "quality")
    x = table(spark, d, "documents").select("doc_id", "n_chars").join(labels, "doc_id", "left")
    return coverage.count_by(x.select(coverage.binding_status(F.col("n_chars") >= 200, F.col("bound"), F.col("quality") == 1).alias("status")), "status")


@query(
    """WITH base AS (SELECT doc_id, quality, 0 AS turn FROM labels), new AS (SELECT doc_id, 9 AS quality, 1 AS turn FROM documents WHERE n_chars > 3000)
SELECT doc_id, quality FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY turn DESC) AS k FROM (SELECT * FROM base UNION ALL SELECT * FROM new)) WHERE k = 1"""
)
def binding_merge(spark, d):
    base = table(spark, d, "labels").select("doc_id", "quality")
    return joins.merged(base, table(spark, d, "documents").where("n_chars > 3000").select("doc_id", F.lit(9).alias("quality")), ["doc_id"])


@query(
    """WITH f AS (SELECT p_brand, string_agg(DISTINCT p_type, ',' ORDER BY p_type) AS t FROM part GROUP BY p_brand), g AS (SELECT p_brand, p_type FROM part WHERE p_size < 40 GROUP BY ALL)
SELECT p_brand, coalesce(string_agg(p_type, ',' ORDER BY p_type), '') AS missing FROM (SELECT DISTINCT p.p_brand, CASE WHEN g.p_type IS NULL THEN p.p_type END AS p_type FROM part p LEFT JOIN g USING (p_brand, p_type)) GROUP BY p_brand"""
)
def set_difference_refs(spark, d):
    g = table(spark, d, "part").groupBy("p_brand").agg(F.collect_set("p_type").alias("all"), F.collect_set(F.when(F.col("p_size") < 40, F.col("p_type"))).alias("resolved"))
    return g.select("p_brand", F.array_join(F.sort_array(F.array_except("all", "resolved")), ",").alias("missing"))


@query(
    """SELECT c_custkey, coalesce(p.n_priorities, 0) AS n_priorities, coalesce(ok, FALSE) AS within_allowed FROM customer LEFT JOIN
(SELECT o_custkey, count(DISTINCT o_orderpriority) AS n_priorities, bool_and(o_orderpriority IN ('1-URGENT', '2-HIGH', '3-MEDIUM')) AS ok FROM orders GROUP BY o_custkey) p ON o_custkey = c_custkey"""
)
def allow_list_containment(spark, d):
    allowed = F.array(*map(F.lit, ("1-URGENT", "2-HIGH", "3-MEDIUM")))
    p = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.collect_set("o_orderpriority").alias("s"))
    x = table(spark, d, "customer").select("c_custkey").join(p, "c_custkey", "left")
    return x.select("c_custkey", F.when(F.col("s").isNull(), 0).otherwise(F.size("s")).cast("long").alias("n_priorities"), F.coalesce(joins.within(F.col("s"), allowed), F.lit(False)).alias("within_allowed"))


@query(
    """WITH a AS (SELECT conv_id, turn, role FROM conversations), b AS (SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN 'user' ELSE 'assistant' END AS role FROM conversations WHERE turn < 3 UNION ALL
SELECT conv_id, max(turn) + 1, 'user' FROM conversations GROUP BY conv_id HAVING max(turn) < 2)
SELECT status, count(*) AS n FROM (SELECT CASE WHEN b.conv_id IS NULL THEN 'missing' WHEN a.conv_id IS NULL THEN 'unexpected' WHEN a.role IS NOT DISTINCT FROM b.role THEN 'equal' ELSE 'different' END AS status
FROM a FULL JOIN b ON a.conv_id = b.conv_id AND a.turn = b.turn) GROUP BY status"""
)
def positional_match(spark, d):
    a = table(spark, d, "conversations").select("conv_id", "turn", "role")
    role = F.when(F.col("turn") % 2 == 0, "user").otherwise("assistant")
    more = a.groupBy("conv_id").agg(F.max("turn").alias("t")).where("t < 2").select("conv_id", (F.col("t") + 1).alias("turn"), F.lit("user").alias("role"))
    b = a.where("turn < 3").select("conv_id", "turn", role.alias("role")).unionByName(more)
    return coverage.count_by(joins.positional(a, b, ["conv_id"], "turn", "role"), "status")


# --- aggregation, variants, coverage --------------------------------------------------------------------------------


@query(
    """SELECT family, count(*) AS operations, count(DISTINCT o_custkey) AS actors, min(o_orderkey) AS first_operation FROM
(SELECT lower(regexp_replace(o_orderstatus || '-' || o_orderpriority, '[^A-Za-z0-9]+', '-', 'g')) AS family, * FROM orders) GROUP BY family"""
)
def families(spark, d):
    name = F.lower(F.regexp_replace(F.concat_ws("-", "o_orderstatus", "o_orderpriority"), "[^A-Za-z0-9]+", "-"))
    return table(spark, d, "orders").groupBy(name.alias("family")).agg(F.count("*").alias("operations"), F.count_distinct("o_custkey").alias("actors"), F.min("o_orderkey").alias("first_operation"))


SESSIONS = "SELECT strftime(ts, '%Y-%m') AS family, user_id || ':' || strftime(ts, '%Y-%m-%d') AS session, ts, event_id, event_type FROM events"
VARIANTS = f"""SELECT family, signature, count(*) AS members, min(session) AS representative, min(steps) AS steps FROM
(SELECT family, session, sha256(string_agg(event_type, '>' ORDER BY ts, event_id)) AS signature, count(*) AS steps FROM ({SESSIONS}) GROUP BY family, session) GROUP BY family, signature"""


def sessions(spark, d) -> DataFrame:
    e = table(spark, d, "events")
    return e.select(F.date_format("ts", "yyyy-MM").alias("family"), F.concat_ws(":", F.col("user_id").cast("string"), day("ts")).alias("session"), "ts", "event_id", "event_type")


@query(VARIANTS)
def variant_reduction(spark, d):
    return sequences.variants(sessions(spark, d), ["family"], "session", ["ts", "event_id"], "event_type")


@query(
    f"SELECT family, signature, CASE WHEN count(*) OVER (PARTITION BY base) > 1 THEN base || '-' || substr(signature, 1, 8) ELSE base END AS id FROM (SELECT *, family || '.' || steps AS base FROM ({VARIANTS}))"
)
def variant_collision_suffix(spark, d):
    v = variant_reduction(spark, d).withColumn("base", F.concat_ws(".", "family", F.col("steps").cast("string")))
    return sequences.with_suffix(v, "base", "signature").select("family", "signature", "id")


@query(
    """SELECT event_type AS src, nxt AS dst, count(*) AS n FROM (SELECT event_type, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nxt FROM events) WHERE nxt IS NOT NULL GROUP BY ALL"""
)
def behavior_transitions(spark, d):
    t = sequences.transitions(table(spark, d, "events").select("user_id", "ts", "event_id", "event_type"), ["user_id"], ["ts", "event_id"], "event_type")
    return t.where("next IS NOT NULL").groupBy(F.col("event_type").alias("src"), F.col("next").alias("dst")).agg(F.count("*").alias("n"))


@query(
    """SELECT user_id, event_type, count(*) AS revisits, max(earlier) AS most FROM (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) - 1 AS earlier FROM events) WHERE earlier > 0 GROUP BY ALL"""
)
def revisit_detection(spark, d):
    r = sequences.revisits(table(spark, d, "events").select("user_id", "ts", "event_id", "event_type"), ["user_id"], ["ts", "event_id"], "event_type")
    return r.groupBy("user_id", "event_type").agg(F.count("*").alias("revisits"), F.max("earlier").alias("most"))


@query(
    """SELECT phase, count(*) AS n FROM (SELECT CASE WHEN row_number() OVER w = 1 THEN 'entry' WHEN lead(1) OVER w IS NULL THEN 'success' ELSE 'intermediate' END AS phase FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) GROUP BY phase"""
)
def screen_phases(spark, d):
    return coverage.count_by(sequences.phases(table(spark, d, "conversations").select("conv_id", "turn"), ["conv_id"], ["turn"]), "phase")


STEP_KIND = "CASE WHEN turn = 0 THEN 'screen' WHEN role = 'user' THEN 'action' ELSE 'operation' END"


@query(
    f"""WITH s AS (SELECT conv_id, turn, CAST(turn AS VARCHAR) || ':' || role AS v, {STEP_KIND} AS kind FROM conversations),
m AS (SELECT *, last_value(CASE WHEN kind = 'screen' THEN v END IGNORE NULLS) OVER w AS screen, sum(CASE WHEN kind IN ('screen', 'action') THEN 1 ELSE 0 END) OVER w AS block FROM s WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)),
o AS (SELECT *, count(CASE WHEN kind = 'operation' THEN 1 END) OVER (PARTITION BY conv_id, block) AS operations FROM m)
SELECT conv_id, turn, screen, operations FROM o WHERE kind = 'action'"""
)
def action_steps(spark, d):
    kind = F.when(F.col("turn") == 0, "screen").when(F.col("role") == "user", "action").otherwise("operation")
    s = table(spark, d, "conversations").select("conv_id", "turn", F.concat_ws(":", F.col("turn").cast("string"), "role").alias("v"), kind.alias("kind"))
    return sequences.action_steps(s, ["conv_id"], "turn", "kind", "v").select("conv_id", "turn", "screen", "operations")


@query(
    """WITH l AS (SELECT l_orderkey, count(*) AS n, bool_or(l_returnflag = 'R') AS returned, bool_and(l_shipdate IS NOT NULL) AS shipped FROM lineitem GROUP BY l_orderkey)
SELECT o_orderkey, CASE WHEN c_custkey IS NULL THEN 'actor' WHEN n IS NULL THEN 'evidence' WHEN NOT coalesce(shipped, FALSE) THEN 'operation' WHEN NOT coalesce(NOT returned, FALSE) THEN 'outcome' END AS missing_stage,
CASE WHEN c_custkey IS NOT NULL AND n IS NOT NULL AND coalesce(shipped, FALSE) AND coalesce(NOT returned, FALSE) THEN 'covered' ELSE 'partial' END AS status
FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN l ON l_orderkey = o_orderkey"""
)
def coverage_waterfall(spark, d):
    lines = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.count("*").alias("n"), F.bool_or(F.col("l_returnflag") == "R").alias("returned"), F.bool_and(F.col("l_shipdate").isNotNull()).alias("shipped")
    )
    x = table(spark, d, "orders").select("o_orderkey", "o_custkey").join(table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.lit(True).alias("known")), "o_custkey", "left")
    x = x.join(lines, "o_orderkey", "left")
    stages = [("actor", F.col("known")), ("evidence", F.col("n").isNotNull()), ("operation", F.col("shipped")), ("outcome", ~F.col("returned"))]
    return coverage.waterfall(x, stages).select("o_orderkey", "missing_stage", "status")


@query(
    "SELECT 'documents' AS name, count(*) AS n FROM documents UNION ALL SELECT 'orders', count(*) FROM orders UNION ALL SELECT 'pages', count(*) FROM pages UNION ALL SELECT 'reviews', count(*) FROM labels UNION ALL SELECT 'steps', count(*) FROM events"
)
def coverage_counts(spark, d):
    return coverage.counts(**{n: table(spark, d, t) for n, t in (("documents", "documents"), ("orders", "orders"), ("pages", "pages"), ("reviews", "labels"), ("steps", "events"))})


@query(
    """SELECT status, count(*) AS n FROM (SELECT CASE WHEN o_orderstatus = 'O' THEN 'excluded' WHEN o_orderpriority LIKE '1%' OR count(*) OVER (PARTITION BY o_custkey, o_orderstatus, o_orderpriority) > 1 THEN 'review-required' ELSE 'included' END AS status FROM orders) GROUP BY status"""
)
def op_inclusion(spark, d):
    keys = ["o_custkey", "o_orderstatus", "o_orderpriority"]
    o = table(spark, d, "orders").select(*keys)
    # operations of one key are alike, so they need not be windowed over
    n = o.groupBy(*keys).agg(F.count("*").alias("k"))
    status = coverage.inclusion(F.col("o_orderstatus") != "O", F.col("o_orderpriority").startswith("1"), F.col("k") > 1)
    return n.groupBy(status.alias("status")).agg(F.sum("k").alias("n"))


@query(
    """SELECT phase, count(*) AS n FROM (SELECT CASE WHEN NOT coalesce(o.n > 0, FALSE) THEN 'discover' WHEN NOT coalesce(o.spent > 500000, FALSE) THEN 'bind' WHEN NOT coalesce(c_acctbal > 0, FALSE) THEN 'verify' ELSE 'ready' END AS phase
FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, sum(o_totalprice) AS spent FROM orders GROUP BY o_custkey) o ON o_custkey = c_custkey) GROUP BY phase"""
)
def lifecycle_phase(spark, d):
    o = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("spent"))
    x = table(spark, d, "customer").select("c_custkey", "c_acctbal").join(o, "c_custkey", "left")
    gates = [("discover", F.col("n") > 0), ("bind", F.col("spent") > 500000), ("verify", F.col("c_acctbal") > 0)]
    return coverage.count_by(x.select(coverage.first_failing(gates, "ready").alias("phase")), "phase")


@query(
    "SELECT source, doc_id, n_chars, rank FROM (SELECT source, doc_id, n_chars, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rank FROM documents) WHERE rank <= 24"
)
def topk_hints(spark, d):
    return joins.top_of_each(table(spark, d, "documents").select("source", "doc_id", "n_chars"), ["source"], [F.desc("n_chars"), F.asc("doc_id")], 24)


@query("SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS k FROM orders WHERE o_orderstatus <> 'P') WHERE k = 1")
def latest_run(spark, d):
    return joins.latest(table(spark, d, "orders").where("o_orderstatus <> 'P'").select("o_custkey", "o_orderdate", "o_orderkey"), ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey")


@query(
    """SELECT status, count(*) AS n FROM (SELECT CASE WHEN o_orderstatus = 'F' THEN 'recorded' WHEN NOT o_custkey % 7 <> 0 THEN 'stale' WHEN o_orderdate + INTERVAL 30 MINUTE <= TIMESTAMP '1996-06-30 00:00:00' THEN 'expired' ELSE 'pending' END AS status FROM orders) GROUP BY status"""
)
def run_status(spark, d):
    expires = F.col("o_orderdate").cast("timestamp_ntz") + F.expr("INTERVAL '30' MINUTE")
    now = F.lit("1996-06-30 00:00:00").cast("timestamp_ntz")
    status = coverage.run_status(F.col("o_orderstatus") == "F", expires, now, F.col("o_custkey") % 7 != 0)
    return coverage.count_by(table(spark, d, "orders").select(status.alias("status")), "status")


@query("SELECT md5(text) AS digest, count(*) AS copies, max(doc_id) AS kept FROM documents WHERE text IS NOT NULL GROUP BY text HAVING count(*) > 1")
def duplicate_sources(spark, d):
    x = table(spark, d, "documents").where("text IS NOT NULL").select(F.md5("text").alias("digest"), "doc_id")
    return joins.collisions(x, ["digest"]).join(joins.latest(x, ["digest"], ["doc_id"]), "digest").select("digest", F.col("n").alias("copies"), F.col("doc_id").alias("kept"))


@query(
    "WITH cur AS (SELECT doc_id, md5(coalesce(text, '')) AS digest FROM documents), old AS (SELECT doc_id, CASE WHEN doc_id % 10 = 3 THEN 'x' ELSE md5(coalesce(text, '')) END AS digest FROM documents) SELECT old.doc_id FROM old WHERE NOT EXISTS (SELECT 1 FROM cur WHERE cur.doc_id = old.doc_id AND cur.digest = old.digest)"
)
def lineage_stale(spark, d):
    cur = table(spark, d, "documents").select("doc_id", F.md5(F.coalesce("text", F.lit(""))).alias("digest"))
    old = cur.withColumn("digest", F.when(F.col("doc_id") % 10 == 3, "x").otherwise(F.col("digest")))
    return joins.stale(old, cur, "doc_id", "digest").select("doc_id")


# --- constraints and predicates -------------------------------------------------------------------------------------


@query(
    """SELECT p_partkey, CASE WHEN p_size > 40 OR length(p_name) > 18 OR p_size <> floor(p_size) OR p_type NOT IN ('BRASS', 'STEEL', 'COPPER') THEN 'invalid' ELSE 'valid' END AS status,
concat_ws(',', CASE WHEN length(p_name) > 18 THEN 'k2' END, CASE WHEN p_size > 40 THEN 'k3' END, CASE WHEN p_type NOT IN ('BRASS', 'STEEL', 'COPPER') THEN 'k4' END) AS issues FROM part"""
)
def constraint_eval(spark, d):
    p = table(spark, d, "part")
    rules = spark.createDataFrame(
        [("size", "k1", "type", None, "integer", None), ("name", "k2", "maxLength", 18.0, None, None), ("size", "k3", "max", 40.0, None, None), ("type", "k4", "enum", None, None, ["BRASS", "STEEL", "COPPER"])],
        "field string, id string, kind string, num_value double, str_value string, arr_value array<string>",
    )
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(c).cast("string").alias("value")) for f, c in (("size", "p_size"), ("name", "p_name"), ("type", "p_type"))])
    values = p.select("p_partkey", F.explode(pairs).alias("x")).select("p_partkey", "x.field", "x.value").join(F.broadcast(rules), "field")
    judged = values.withColumn("status", C.check_value(*map(F.col, ("value", "kind", "num_value", "str_value", "arr_value"))))
    issues = F.array_join(F.sort_array(F.collect_set(F.when(F.col("status") != "valid", F.col("id")))), ",")
    return judged.groupBy("p_partkey").agg(C.worst(F.col("status")).alias("status"), issues.alias("issues"))


FACTS = """SELECT p_brand AS field, CAST(p_partkey AS VARCHAR) AS id, CASE p_partkey % 4 WHEN 0 THEN 'min' WHEN 1 THEN 'max' WHEN 2 THEN 'type' ELSE 'maxLength' END AS kind,
CASE p_partkey % 4 WHEN 1 THEN p_size + 40.0 WHEN 2 THEN NULL ELSE p_size * 1.0 END AS num_value, CASE WHEN p_partkey % 4 = 2 THEN CASE WHEN p_size > 49 THEN 'integer' ELSE 'number' END END AS str_value FROM part"""


def facts_of_parts(spark, d) -> DataFrame:
    k, size = F.col("p_partkey") % 4, F.col("p_size")
    kind = F.element_at(F.array(*map(F.lit, ("min", "max", "type", "maxLength"))), (k + 1).cast("int"))
    num = F.when(k == 1, size + 40.0).when(k != 2, size * 1.0)
    return table(spark, d, "part").select(
        F.col("p_brand").alias("field"), F.col("p_partkey").cast("string").alias("id"), kind.alias("kind"), num.alias("num_value"),
        F.when(k == 2, F.when(size > 49, "integer").otherwise("number")).alias("str_value"), F.lit(None).cast("array<string>").alias("arr_value"),
    )


@query(
    f"""SELECT field, CASE WHEN count(DISTINCT CASE WHEN kind = 'type' THEN str_value END) > 1 OR coalesce(max(CASE WHEN kind = 'min' THEN num_value END) > min(CASE WHEN kind = 'max' THEN num_value END), FALSE)
THEN 'inconsistent' ELSE 'consistent' END AS status FROM ({FACTS}) GROUP BY field"""
)
def constraint_set_consistency(spark, d):
    return C.consistency(facts_of_parts(spark, d), "field")


@query(
    f"""WITH f AS ({FACTS}), b AS (SELECT field, max(CASE WHEN kind = 'min' THEN num_value END) AS lo, min(CASE WHEN kind = 'max' THEN num_value END) AS hi, min(CASE WHEN kind = 'maxLength' THEN num_value END) AS ml, bool_or(str_value = 'integer') AS i FROM f GROUP BY field),
c AS (SELECT field, lo, hi, ml, i, pos, v FROM b, (VALUES (0, '1'), (1, '45'), (2, '50'), (3, '55.5')) t(pos, v))
SELECT b.field, (SELECT v FROM c WHERE c.field = b.field AND (c.lo IS NULL OR CAST(v AS DOUBLE) >= c.lo) AND (c.hi IS NULL OR CAST(v AS DOUBLE) <= c.hi) AND (c.ml IS NULL OR length(v) <= c.ml) AND (NOT coalesce(c.i, FALSE) OR CAST(v AS DOUBLE) = floor(CAST(v AS DOUBLE))) ORDER BY pos LIMIT 1) AS value FROM b"""
)
def representative_value(spark, d):
    rules = facts_of_parts(spark, d)
    tries = F.posexplode(F.array(*map(F.lit, ("1", "45", "50", "55.5")))).alias("pos", "value")
    return C.representative(rules.select("field").distinct().select("field", tries), rules, "field")


@query(
    """WITH l AS (SELECT p_brand || ':' || p_type || ':' || p_partkey // 100 AS b, p_partkey % 5 AS k, p_size AS n FROM part),
g AS (SELECT b, count(DISTINCT CASE WHEN k = 0 AND n > 49 THEN n END) AS eqs, max(CASE WHEN k = 0 AND n > 49 THEN n END) AS eq, max(CASE WHEN k = 1 THEN n - 20 END) AS lo, min(CASE WHEN k = 2 THEN n + 20 END) AS hi, bool_or(k = 3 AND n = 50) AS odd FROM l GROUP BY b),
n AS (SELECT DISTINCT b, n FROM l WHERE k = 4)
SELECT g.b AS pred_id, CASE WHEN eqs > 1 OR (eqs = 1 AND EXISTS (SELECT 1 FROM n WHERE n.b = g.b AND n.n = g.eq)) OR (eqs = 1 AND (coalesce(eq <= lo, FALSE) OR coalesce(eq >= hi, FALSE))) OR coalesce(lo >= hi, FALSE) THEN 'unsatisfiable'
WHEN coalesce(odd, FALSE) THEN 'conditional' ELSE 'satisfiable' END AS status FROM g"""
)
def predicate_sat(spark, d):
    k, n = F.col("p_partkey") % 5, F.col("p_size").cast("double")
    op = F.when((k == 0) & (n > 49), "=").when(k == 1, ">").when(k == 2, "<").when((k == 3) & (n == 50), "opaque").when(k == 4, "!=").otherwise("true")
    path = F.when(op.isin("opaque", "true"), None).otherwise("size")
    lits = table(spark, d, "part").select(
        F.expr("concat_ws(':', p_brand, p_type, p_partkey div 100)").alias("pred_id"), F.lit(0).alias("branch"), path.alias("path"), op.alias("op"), F.lit("number").alias("vtype"),
        F.when(k == 1, n - 20).when(k == 2, n + 20).otherwise(n).alias("vnum"), F.lit(None).cast("string").alias("vstr"),
    )
    return P.solve(lits).select("pred_id", "status")


@query(
    """SELECT status, count(*) AS n FROM (SELECT CASE WHEN p_size > 25 AND p_size < 20 + p_partkey % 10 THEN 'satisfiable' WHEN 25 + 1 > 0 AND p_partkey % 10 <= 5 THEN 'unsatisfiable' ELSE 'satisfiable' END AS status FROM part WHERE p_size BETWEEN 0 AND 100) GROUP BY status"""
)
def predicate_parse(spark, d):
    expr = F.concat(F.lit("size > 25 && (size < "), (20 + F.col("p_partkey") % 10).cast("string"), F.lit(" || mode === 'A' && mode !== 'A')"))
    return coverage.count_by(P.solve(P.literals(table(spark, d, "part").select("p_partkey", expr.alias("e")), "p_partkey", "e")), "status")


_WORDS = "'" + "', '".join(C.SENSITIVE_WORDS) + "'"
_NAMES = "'" + "', '".join(C.SENSITIVE_NAMES) + "'"


@query(
    rf"""WITH f AS (SELECT p_partkey, p_name, p_type, p_size, 'form.' || replace(p_name, ' ', '') || CASE p_partkey % 12 WHEN 0 THEN 'Id' WHEN 1 THEN 'Code' WHEN 2 THEN 'Password' WHEN 3 THEN '.apiKey' WHEN 4 THEN '.accountNumber' WHEN 5 THEN '.iban' WHEN 6 THEN 'Ref' WHEN 7 THEN '.pin' WHEN 8 THEN '.spinner' ELSE 'Text' END AS path,
CASE p_partkey % 7 WHEN 0 THEN 'combobox' WHEN 1 THEN 'token-field' ELSE 'textbox' END AS control FROM part),
s AS (SELECT p_partkey, bool_or(list_has_any(w, [{_WORDS}]) OR array_to_string(w, '') IN ({_NAMES})) AS secret FROM (SELECT p_partkey, list_filter(regexp_split_to_array(lower(regexp_replace(x, '([a-z0-9])([A-Z])', '\1 \2', 'g')), '[^a-z0-9]+'), lambda y: y <> '') AS w
  FROM (SELECT p_partkey, unnest(list_concat(string_split(path, '.'), [control])) AS x FROM f)) GROUP BY p_partkey),
k AS (SELECT CASE WHEN secret THEN 'secret-reference' WHEN regexp_matches(split_part(path, '.', -1), '{C.ENTITY_LEAF}') THEN 'existing-entity' WHEN p_size > 45 OR regexp_matches(path, '(?i)code$') OR control = 'combobox' THEN 'runtime-option' WHEN p_size < 10 THEN 'flow-literal' ELSE 'synthetic-constrained' END AS field_class FROM f JOIN s USING (p_partkey))
SELECT field_class, CASE field_class WHEN 'secret-reference' THEN 'corporate-secret-store' WHEN 'existing-entity' THEN 'approved-fixture,read-only-lookup,test-builder,manual-binding' WHEN 'runtime-option' THEN 'runtime-option-provider' WHEN 'flow-literal' THEN 'path-assignment' ELSE 'constraint-generator' END AS strategies, count(*) AS n FROM k GROUP BY field_class"""
)
def field_classification(spark, d):
    k, name = F.col("p_partkey") % 12, F.regexp_replace("p_name", " ", "")
    ends = ("Id", "Code", "Password", ".apiKey", ".accountNumber", ".iban", "Ref", ".pin", ".spinner")
    end = F.lit("Text")
    for i, x in enumerate(ends):
        end = F.when(k == i, x).otherwise(end)
    control = F.when(F.col("p_partkey") % 7 == 0, "combobox").when(F.col("p_partkey") % 7 == 1, "token-field").otherwise("textbox")
    kind = C.field_class(F.concat(F.lit("form."), name, end), control, F.col("p_size") > 45, F.col("p_size") < 10)
    return coverage.count_by(table(spark, d, "part").select(kind.alias("field_class")).withColumn("strategies", C.strategies(F.col("field_class"))), "field_class", "strategies")


@query(
    "SELECT p_partkey, p_type IN ('BRASS', 'TIN') AS hidden, CASE WHEN p_type IN ('BRASS', 'TIN') THEN NULL ELSE CAST(p_size AS DOUBLE) END AS shown, CASE WHEN p_type IN ('BRASS', 'TIN') THEN NULL ELSE p_name END AS message FROM part"
)
def secret_redaction(spark, d):
    rule = F.struct(F.lit("max").alias("kind"), F.col("p_size").cast("double").alias("num_value"), F.lit("x").alias("str_value"), F.col("p_name").alias("message"))
    hidden = F.col("p_type").isin("BRASS", "TIN")
    x = table(spark, d, "part").select("p_partkey", hidden.alias("hidden"), F.get(C.redact(F.array(rule), hidden), F.lit(0)).alias("r"))
    return x.select("p_partkey", "hidden", F.col("r.num_value").alias("shown"), F.col("r.message").alias("message"))


# --- graphs ---------------------------------------------------------------------------------------------------------

TRANSITIONS = ORACLE_SQL["behavior_transitions"]
TOP_EDGES = f"SELECT src, dst FROM (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY n DESC, dst) AS k FROM ({TRANSITIONS}) WHERE src <> dst) WHERE k <= 2"
GOAL = "(SELECT max(src) FROM e)"
PATHS = f"""WITH RECURSIVE e AS ({TOP_EDGES}), p(nodes, last, state) AS (SELECT [s], s, 'live' FROM (SELECT min(src) AS s FROM e) UNION ALL
SELECT list_append(nodes, dst), dst, CASE WHEN len(list_filter(nodes, lambda x: x = dst)) + 1 > 2 THEN 'visit' WHEN len(nodes) + 1 > 7 THEN 'depth' WHEN dst = {GOAL} THEN 'witness' ELSE 'live' END
FROM p JOIN e ON e.src = p.last WHERE state = 'live')"""


def paths_of_events(spark, d) -> DataFrame:
    t = behavior_transitions(spark, d).where("src <> dst")
    top = joins.top_of_each(t, ["src"], [F.desc("n"), F.asc("dst")], 2)
    bounds = top.agg(F.min("src").alias("low"), F.max("src").alias("high"))
    seeds = bounds.select(F.lit("events").alias("family"), F.col("low").alias("node"))
    goal = bounds.select(F.lit("events").alias("family"), F.col("high").alias("node"))
    edges = top.crossJoin(bounds).select(
        F.lit("events").alias("family"), F.concat_ws(">", "src", "dst").alias("edge"), "src", "dst", F.when(F.col("dst") == F.col("high"), "success").otherwise("neutral").alias("outcome"),
        F.lit(True).alias("operation"), F.lit(False).alias("nav_only"), F.lit(None).cast("string").alias("guard"),
    )
    return graph.bounded_paths(seeds, edges, goal, max_depth=7, max_visits=2)


@query(PATHS + " SELECT array_to_string(nodes, '>') AS path, CAST(len(nodes) AS BIGINT) AS length FROM p WHERE state = 'witness'")
def path_witnesses(spark, d):
    return paths_of_events(spark, d).where("state = 'witness'").select(F.array_join("nodes", ">").alias("path"), F.size("nodes").cast("long").alias("length"))


@query(
    PATHS
    + " SELECT state, last AS node, count(*) AS n, CAST(min(len(nodes)) AS BIGINT) AS shortest, CAST(max(len(nodes)) AS BIGINT) AS longest, min(array_to_string(nodes, '>')) AS sample FROM p WHERE state IN ('depth', 'visit') GROUP BY state, last"
)
def path_truncation(spark, d):
    return graph.truncations(paths_of_events(spark, d)).drop("family")


CLOSE = "SELECT c_custkey AS src, c_custkey // 2 AS dst FROM customer"


def tree_of_customers(spark, d, fanout: int) -> DataFrame:
    return table(spark, d, "customer").select(F.col("c_custkey").alias("src"), F.expr(f"c_custkey div {fanout}").alias("dst"))


@query(f"WITH RECURSIVE e AS ({CLOSE}), c(origin, node) AS (SELECT DISTINCT src, src FROM e UNION SELECT c.origin, e.dst FROM c JOIN e ON e.src = c.node) SELECT origin, node FROM c")
def reachable_pages(spark, d):
    e = tree_of_customers(spark, d, 2)
    return graph.closure(e.select(F.col("src").alias("origin"), F.col("src").alias("node")), e)


@query(
    """WITH e AS (SELECT c_custkey AS src, c_custkey // 3 AS dst FROM customer), b AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e), s AS (SELECT DISTINCT src AS origin FROM e),
h0 AS (SELECT origin, origin AS node FROM s), h1 AS (SELECT * FROM (SELECT origin, dst AS node, row_number() OVER (PARTITION BY origin ORDER BY dst) AS k FROM (SELECT DISTINCT origin, dst FROM h0 JOIN b ON src = node WHERE dst <> origin)) WHERE k <= 79),
n1 AS (SELECT origin, count(*) AS n FROM h1 GROUP BY origin),
h2 AS (SELECT origin, node FROM (SELECT origin, dst AS node, row_number() OVER (PARTITION BY origin ORDER BY dst) AS k FROM (SELECT DISTINCT h1.origin, dst FROM h1 JOIN b ON src = h1.node WHERE dst <> h1.origin AND NOT EXISTS (SELECT 1 FROM h1 x WHERE x.origin = h1.origin AND x.node = dst))) JOIN n1 USING (origin) WHERE k <= 79 - n)
SELECT origin, node, 0 AS hop FROM h0 UNION ALL SELECT origin, node, 1 FROM h1 UNION ALL SELECT origin, node, 2 FROM h2"""
)
def k_hop_neighborhood(spark, d):
    e = tree_of_customers(spark, d, 3)
    seeds = e.select(F.col("src").alias("origin"), F.col("src").alias("node")).distinct()
    return graph.neighbourhood(seeds, e)


@query("WITH e AS (SELECT DISTINCT o_custkey AS src, o_custkey * 3 % 997 AS dst FROM orders) SELECT DISTINCT src AS node FROM e WHERE src NOT IN (SELECT dst FROM e WHERE src <> dst)")
def entry_roots(spark, d):
    e = table(spark, d, "orders").select(F.lit("f").alias("family"), F.col("o_custkey").alias("src"), (F.col("o_custkey") * 3 % 997).alias("dst")).distinct()
    return graph.roots(e.select("family", F.col("src").alias("node")).distinct(), e).select("node")


@query(
    f"""WITH v AS ({VARIANTS}) SELECT family, signature AS scenario, CAST(i AS INTEGER) AS line_no, CASE i WHEN 0 THEN '@variant-' || substr(signature, 1, 12) WHEN 1 THEN 'Scenario: ' || representative WHEN 2 THEN '  Given ' || members || ' equal sessions'
WHEN 3 THEN '  When ' || steps || ' steps are taken' ELSE '  Then the outcome is the recorded one' END AS line FROM v, range(5) t(i)"""
)
def bdd_lines(spark, d):
    from waypath.sources.features import feature_lines

    return feature_lines(variant_reduction(spark, d))
