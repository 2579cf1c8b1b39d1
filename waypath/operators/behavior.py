"""The behaviour graph of a project, the search of its paths, and what follows: variants, feasibility and coverage.

Nodes are screens, actions, operations and outcomes; edges carry guards (an array of texts of the predicate grammar, of
which one that is not understood is opaque and makes a path conditional), effects, an outcome, the request contracts
they rest on and the fields these need. A path holds its nodes, edges and guards as arrays; it is at most as long as the
depth bound, so a row stays small. All families are searched at once, one join a level.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import lru_cache

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waypath.functions import predicates as P
from waypath.functions.ids import leaf_name, route_matches, slug, stable_id
from waypath.operators.graph import _settled, closure
from waypath.operators.joins import template_join
from waypath.operators.traces import guarded_walks

def none() -> Column:
    return F.array().cast("array<string>")


def texts(*columns: Column) -> Column:
    """The columns that are not null, as an array."""
    return F.filter(F.array(*columns), lambda x: x.isNotNull())


def opaque(condition: Column, *text) -> Column:
    """A guard that can't be understood, where the condition holds."""
    return F.when(F.coalesce(condition, F.lit(False)), F.concat(*[x if isinstance(x, Column) else F.lit(x) for x in text]))


def input_mode(mode: Column) -> Column:
    return F.coalesce(mode, F.lit("editable"))


# --- construction ---------------------------------------------------------------------------------------------------

EDGE = ["src", "dst", "guards", "effects", "outcome", "contracts", "needs"]


def _edge(df: DataFrame, src: str, dst: Column, guards: Column, outcome: str = "neutral", effects: Column | None = None, contracts: Column | None = None, needs: Column | None = None) -> DataFrame:
    given = [effects, contracts, needs]
    effects, contracts, needs = (none() if c is None else c for c in given)
    return df.select(F.col(src).alias("src"), dst.alias("dst"), guards.alias("guards"), effects.alias("effects"), F.lit(outcome).alias("outcome"), contracts.alias("contracts"), needs.alias("needs"))


def target_pages(navigations: DataFrame, pages: DataFrame) -> DataFrame:
    """(navigation, page): pages of the first route, by page and place, that a navigation's target matches. pages: page, routes."""
    routes = pages.select("page", F.posexplode("routes").alias("pos", "route"))
    normal = routes.withColumn("matched", _normal("route"))
    found = template_join(navigations.select("navigation", "target"), routes.select("route", F.concat_ws(":", "page", F.lpad(F.col("pos").cast("string"), 6, "0")).alias("n")), "target", "route", "n")
    return found.where("matched IS NOT NULL").join(normal.select("page", "matched").distinct(), "matched").select("navigation", "page").distinct()


def _normal(c: str) -> Column:
    from waypath.functions.ids import normal_template

    return normal_template(F.col(c))


def navigation_guard(guard: Column, exact: Column, navigation: Column, target_text: Column) -> Column:
    """A navigation's guards: its own, and an opaque one where the target is computed."""
    return texts(guard, opaque(~F.coalesce(exact, F.lit(True)), F.coalesce(target_text, F.concat(F.lit("navigation-target:"), navigation))))


def behavior_graph(
    pages: DataFrame, actions: DataFrame, handlers: DataFrame, calls: DataFrame, navigations: DataFrame, operations: DataFrame, endpoints: DataFrame, validations: DataFrame,
    effects: DataFrame, contracts: DataFrame, entry_routes: Sequence[str] = (),
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """nodes (node, kind, label, reference, page_fields), edges (edge, *EDGE, nav_only) and entries (node, structural).

    pages: page, label, routes, fields. actions: action, page, label, handler, handler_exact, guards, navigations.
    handlers: handler, name, file, http, navigations, completes (boolean). calls: src, dst, guard (resolved call sites).
    navigations: navigation, target, target_text, target_exact, guard, page (of a declarative one), proved, after_name,
    after_file. operations: operation, endpoint, label, inclusion, clients. endpoints: endpoint, access, domain_guard.
    validations: endpoint, validation, kind. effects: endpoint, kind. contracts: contract, action, endpoint, http, status,
    guard, literals ('name=value'), bindings ('name=field'), handler_path.
    """
    ops = operations.where("inclusion <> 'excluded'")
    nav_guard = navigation_guard(F.col("guard"), F.col("target_exact"), F.col("navigation"), F.col("target_text"))
    navs = navigations.withColumn("nav_guards", nav_guard)
    to_page = target_pages(navs, pages)
    first_page = to_page.groupBy("navigation").agg(F.min("page").alias("to_page"))

    # what an action's handler reaches: requests, and navigations with the guards met on the way
    own = actions.where("handler IS NOT NULL").join(handlers.select("handler"), "handler", "left_semi")
    seeds = own.select(F.col("action").alias("origin"), F.col("handler").alias("node"))
    reached = closure(seeds, calls.select("src", "dst"))
    http = reached.join(handlers.select(F.col("handler").alias("node"), F.explode("http").alias("http")), "node").select(F.col("origin").alias("action"), "http")
    http = http.unionByName(contracts.select("action", "http")).distinct()
    walks = guarded_walks(seeds, calls.select("src", "dst", "guard"))
    by_handler = handlers.select(F.col("handler").alias("node"), F.explode("navigations").alias("navigation"))
    through = walks.join(by_handler, "node").select(F.col("origin").alias("action"), "navigation", "guards")
    direct = actions.select("action", F.explode("navigations").alias("navigation"), none().alias("guards"))
    nav = direct.unionByName(through).distinct().join(navs.select("navigation", "target", "nav_guards", "proved", "after_name", "after_file"), "navigation")
    nav = nav.withColumn("guards", F.concat("guards", "nav_guards")).drop("nav_guards")

    # operations of an action, and the alternatives of its requests
    runs = http.join(ops.select("operation", "endpoint", F.col("label").alias("op_label"), F.explode("clients").alias("http")), "http").select("action", "operation", "endpoint", "op_label").distinct()
    runs = runs.join(own.select("action", "handler"), "action").withColumn("several", F.count("*").over(Window.partitionBy("action")) > 1)
    of_handler = handlers.select("handler", "completes")
    flags = validations.groupBy("endpoint").agg(F.max(F.col("kind") == "required").alias("needs_fields"), F.array_join(F.array_sort(F.collect_set(F.when(F.col("kind") == "opaque", F.col("validation")))), ",").alias("opaque_rules"))
    lasting = effects.groupBy("endpoint").agg(F.max(F.col("kind") == "unknown-mutation").alias("unknown_effect"))
    x = runs.join(of_handler, "handler").join(endpoints.select("endpoint", "access", "domain_guard"), "endpoint", "left").join(flags, "endpoint", "left").join(lasting, "endpoint", "left")
    invocation = stable_id(F.lit("operation-invocation"), F.concat_ws(":", "action", "operation"))
    x = x.withColumn("invocation", invocation)
    c = contracts.select("action", "endpoint", "contract", "status", F.col("guard").alias("dispatch"), "literals", "bindings", "handler_path")
    blocked = F.col("status").isin("required-fields-missing", "required-fields-invalid")
    any_contract = c.groupBy("action", "endpoint").agg(F.count("*").alias("n_contracts"), F.count_if(~blocked).alias("n_usable"))
    x = x.join(any_contract, ["action", "endpoint"], "left").where("n_contracts IS NULL OR n_usable > 0")
    common = texts(
        opaque(F.col("access") == "conditional", "authorization:", F.col("endpoint")), F.coalesce("domain_guard", F.concat(F.lit("backend-domain-guard:"), "endpoint")),
        opaque(F.col("opaque_rules") != "", "backend-validation:", F.col("opaque_rules")), opaque(~F.col("completes"), "normal-completion:", F.col("handler")),
        opaque(F.col("several"), "multi-operation-handler:", F.col("handler")),
    )
    x = _settled(x.withColumn("common", common))
    usable = c.where(~blocked).join(x.select("action", "endpoint", "operation", "invocation", "common"), ["action", "endpoint"])
    equal = F.transform("literals", lambda s: F.concat(F.substring_index(s, "=", 1), F.lit(" === "), _quoted(s)))
    review = opaque(F.col("status") == "review-required", "request-payload:", F.col("contract"))
    needs = F.array_sort(F.array_distinct(F.transform("bindings", lambda s: F.substring_index(s, "=", -1))))
    invoke = F.array(F.concat(F.lit("invoke-operation:"), "operation"))
    with_contract = _edge(usable, "action", F.col("invocation"), F.concat(texts(F.col("dispatch")), equal, texts(review), F.col("common")), effects=invoke, contracts=F.array("contract"), needs=needs)
    unproved = opaque(F.col("needs_fields"), "request-payload:", F.col("action"), ":", F.col("operation"))
    without = _edge(x.where("n_contracts IS NULL"), "action", F.col("invocation"), F.concat(texts(unproved), "common"), effects=invoke)

    # what follows an operation: the pages its handler goes on to, or an outcome of its own
    goes_on = x.select("action", "operation", "endpoint", "invocation", "unknown_effect").join(nav, "action").join(to_page, "navigation")
    on_path = usable.select("action", "endpoint", F.explode("handler_path").alias("handler")).join(handlers.select("handler", F.col("name").alias("after_name"), F.col("file").alias("after_file")), "handler")
    proof = on_path.select("action", "endpoint", "after_name", "after_file").distinct().withColumn("on_path", F.lit(True))
    goes_on = goes_on.join(proof, ["action", "endpoint", "after_name", "after_file"], "left")
    proved = F.coalesce(F.col("proved") & F.col("on_path"), F.lit(False))
    success_guards = F.concat("guards", texts(opaque(F.col("unknown_effect"), "terminal-effect:", F.col("operation")), opaque(~proved, "success-continuation:", F.col("action"), ":", F.col("operation"), ":", F.col("navigation"))))
    one = goes_on.groupBy("invocation", "page").agg(F.min_by(F.struct(success_guards.alias("g"), "target"), "navigation").alias("s"))
    to_pages = _edge(one, "invocation", F.col("page"), F.col("s.g"), "success", F.array(F.lit("entity-transition"), F.concat(F.lit("navigate:"), "s.target")))
    ends = x.select("operation", "invocation", "op_label", "unknown_effect").distinct().join(goes_on.select("invocation").distinct(), "invocation", "left_anti").withColumn("outcome", stable_id(F.lit("outcome"), F.concat_ws(":", "invocation", F.lit("success"))))
    to_outcome = _edge(ends, "invocation", F.col("outcome"), texts(opaque(F.col("unknown_effect"), "terminal-effect:", F.col("operation"))), "success", F.array(F.lit("entity-transition")))

    # screens to their actions, and navigations without an operation
    shown = F.concat("guards", texts(opaque(~F.coalesce("handler_exact", F.lit(True)), "handler:", F.col("action"))))
    from_pages = _edge(actions, "page", F.col("action"), shown)
    idle = nav.join(runs.select("action").distinct(), "action", "left_anti").join(first_page, "navigation")
    moves = _edge(idle, "action", F.col("to_page"), F.col("guards"), effects=F.array(F.concat(F.lit("navigate:"), "target")))
    taken = actions.select(F.explode("navigations").alias("navigation")).distinct()
    links = navs.where("page IS NOT NULL").join(taken, "navigation", "left_anti").join(first_page, "navigation")
    declared = _edge(links, "page", F.col("to_page"), F.col("nav_guards"), effects=F.array(F.concat(F.lit("navigate:"), "target")))

    edges = from_pages
    for part in (with_contract, without, to_pages, to_outcome, moves, declared):
        edges = edges.unionByName(part)
    edge_id = stable_id(F.lit("behavior-edge"), F.concat_ws(":", "src", "dst", F.array_join("guards", " and "), "outcome", F.array_join("contracts", ",")))
    moves_only = (F.size("effects") > 0) & F.forall("effects", lambda e: e.startswith("navigate:"))
    edges = edges.select(edge_id.alias("edge"), *EDGE, moves_only.alias("nav_only"))
    edges = _settled(edges.groupBy("edge").agg(F.min(F.struct(*EDGE, "nav_only")).alias("e")).select("edge", *[f"e.{c}" for c in [*EDGE, "nav_only"]]))
    nodes = pages.select(F.col("page").alias("node"), F.lit("screen").alias("kind"), "label", F.col("page").alias("reference"), F.col("fields").alias("page_fields"))
    for part in (
        actions.select(F.col("action").alias("node"), F.lit("action").alias("kind"), "label", F.col("action").alias("reference"), none().alias("page_fields")),
        x.select(F.col("invocation").alias("node"), F.lit("operation").alias("kind"), F.col("op_label").alias("label"), F.col("operation").alias("reference"), none().alias("page_fields")).distinct(),
        ends.select(F.col("outcome").alias("node"), F.lit("outcome").alias("kind"), F.concat_ws(" ", "op_label", F.lit("succeeds")).alias("label"), F.col("operation").alias("reference"), none().alias("page_fields")),
    ):
        nodes = nodes.unionByName(part)
    nodes = _settled(nodes)
    return nodes, edges, _settled(entries(pages, edges, entry_routes))


def _quoted(pair: Column) -> Column:
    """The value of 'name=value' as a literal of the grammar."""
    value = F.regexp_replace(pair, "^[^=]*=", "")
    plain = F.rlike(value, F.lit(r"^(?:true|false|null|-?[0-9]+(?:\.[0-9]+)?)$"))
    return F.when(plain, value).otherwise(F.concat(F.lit("'"), F.regexp_replace(F.regexp_replace(value, r"\\", r"\\\\\\\\"), "'", r"\\\\'"), F.lit("'")))


def entries(pages: DataFrame, edges: DataFrame, entry_routes: Sequence[str] = ()) -> DataFrame:
    """(node, structural): pages of the configured routes, or, where none is configured, those that no edge leads to."""
    if entry_routes:
        wanted = F.lit(False)
        routes = pages.select("page", F.explode("routes").alias("route"))
        for r in entry_routes:
            wanted = wanted | route_matches(F.lit(r), F.col("route"))
        return routes.where(wanted).select(F.col("page").alias("node"), F.lit(False).alias("structural")).distinct()
    return pages.join(edges.select(F.col("dst").alias("page")).distinct(), "page", "left_anti").select(F.col("page").alias("node"), F.lit(True).alias("structural"))


def families(operations: DataFrame, nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(family, operation) and (family, success): operations of one command, and the nodes their success edges lead to."""
    members = operations.where("inclusion <> 'excluded'").select(F.col("machine_name").alias("family"), "operation")
    runs = nodes.where("kind = 'operation'").select(F.col("node").alias("src"), F.col("reference").alias("operation"))
    ends = edges.where("outcome = 'success'").select("src", F.col("dst").alias("success"))
    return members, members.join(runs, "operation").join(ends, "src").select("family", "success").distinct()


# --- search ---------------------------------------------------------------------------------------------------------


def search_paths(nodes: DataFrame, edges: DataFrame, starts: DataFrame, members: DataFrame, successes: DataFrame, max_depth: int = 40, max_visits: int = 2) -> DataFrame:
    """Every state of a breadth-first search of all families: family, nodes, edges, guards, level, state, observed.

    starts: node, structural (a path from there begins with an opaque guard). State: witness (ended by a success edge of
    one of the family's operations), depth (more nodes than max_depth, observed: how many), visit (a node more than
    max_visits times, observed: how many) and live. Error and cancel edges are not followed, nor a navigation back to a
    screen of the path; a request whose fields do not occur on the path before it gets an opaque guard; a path whose
    guards contradict one another ends silently. A witness is not gone on from; a shared success screen that was reached
    otherwise is.
    """
    runs = nodes.where("kind = 'operation'").select(F.col("node").alias("src"), F.col("reference").alias("operation")).join(members, "operation").select("family", "src", F.lit(True).alias("by_member")).distinct()
    ends = successes.select("family", F.col("success").alias("dst"), F.lit(True).alias("is_success"))
    to = nodes.select(F.col("node").alias("dst"), (F.col("kind") == "screen").alias("to_screen"), F.col("page_fields").alias("to_fields"))
    e = edges.where("NOT outcome IN ('error', 'cancel')").select("src", "dst", "edge", F.col("guards").alias("edge_guards"), "outcome", "contracts", "needs", "nav_only").join(to, "dst")
    e = _settled(e)
    flags_src, flags_dst = _settled(runs), _settled(ends)
    at = starts.join(nodes.select("node", F.col("page_fields").alias("fields")), "node").crossJoin(members.select("family").distinct())
    begun = texts(opaque(F.col("structural"), "structural-entry:", F.col("node")))
    front = _settled(at.select("family", F.array("node").alias("nodes"), none().alias("edges"), begun.alias("guards"), F.coalesce("fields", none()).alias("fields"), F.lit("live").alias("state"), F.lit(1).alias("observed")))
    out = front
    for _ in range(max_depth + 1):
        step = front.where("state = 'live'").withColumn("src", F.element_at("nodes", -1)).join(e, "src")
        step = step.join(flags_src, ["family", "src"], "left").join(flags_dst, ["family", "dst"], "left")
        visits = F.size(F.filter("nodes", lambda n: n == F.col("dst")))
        step = step.where(~(F.col("to_screen") & (visits > 0) & (F.col("outcome") != "success") & F.col("nav_only")))
        over, longer = visits + 1 > max_visits, F.size("nodes") + 1
        lacking = F.array_except("needs", "fields")
        unseen = opaque(F.size(lacking) > 0, "request-ui-provenance:", F.array_join(F.array_sort("contracts"), ","), ":", F.array_join(F.array_sort(lacking), ","))
        proved = (F.col("outcome") == "success") & F.coalesce("by_member", F.lit(False)) & F.coalesce("is_success", F.lit(False))
        state = F.when(over, "visit").when(longer > max_depth, "depth").when(proved, "witness").otherwise("live")
        step = step.select(
            "family", F.array_append("nodes", F.col("dst")).alias("nodes"), F.array_append("edges", F.col("edge")).alias("edges"),
            F.when(over, F.col("guards")).otherwise(F.concat("guards", "edge_guards", texts(unseen))).alias("guards"),
            F.array_union("fields", F.coalesce("to_fields", none())).alias("fields"), state.alias("state"), F.when(over, visits + 1).otherwise(longer).alias("observed"),
        )
        possible = lambda guards, state: [()] if state == "visit" or P.status_of(P.conjunction(guards)) != P.STATUSES[2] else []
        front = _settled(P.per_row(step, ["guards", "state"], "", possible))
        if front.isEmpty():
            break
        out = out.unionByName(front)
    return _settled(out.withColumn("level", F.size("nodes")))


def telemetry(states: DataFrame) -> DataFrame:
    """One row: states taken up and looked at (all but those over the visit bound), and prunes by each bound."""
    n = lambda s: F.count_if(F.col("state") == s)
    return states.agg(F.count_if(F.col("state") != "visit").alias("enqueued"), F.count_if(F.col("state") != "visit").alias("dequeued"), n("depth").alias("depth_prunes"), n("visit").alias("visit_prunes"))


def truncation_details(states: DataFrame) -> DataFrame:
    """Per reason, family, node (and edge, for visits): how many, the least and most observed, and the smallest path."""
    cut = states.where("state IN ('depth', 'visit')")
    edge = F.when(F.col("state") == "visit", F.element_at("edges", -1))
    path = F.struct(F.array_join("nodes", ">").alias("nodes"), F.array_join("edges", ">").alias("edges"))
    g = cut.groupBy(F.col("state").alias("reason"), "family", F.element_at("nodes", -1).alias("node"), edge.alias("edge")).agg(
        F.count("*").alias("n"), F.min("observed").alias("least"), F.max("observed").alias("most"), F.min(path).alias("sample")
    )
    return g.select("reason", "family", "node", "edge", "n", "least", "most", F.col("sample.nodes").alias("sample"))


def witnesses(states: DataFrame, nodes: DataFrame) -> DataFrame:
    """Witness paths, a row for each way their guards can hold: witness, family, nodes, edges, pages, actions, operations,
    condition, assignments (sorted 'path=value'), feasibility."""

    def alternatives(guards: list[str]) -> list[tuple]:
        return [(label, status, [f"{p}={P.value_text(v)}" for p, v in values.items()]) for label, status, values in P.models(P.conjunction(guards))]

    w = P.per_row(states.where("state = 'witness'").select("family", "nodes", "edges", "guards"), ["guards"], "condition string, feasibility string, assignments array<string>", alternatives)
    key = F.concat_ws(":", "family", F.array_join("edges", ">"), "condition")
    w = w.select(stable_id(F.lit("witness"), key).alias("witness"), "family", "nodes", "edges", "condition", "feasibility", "assignments").dropDuplicates(["witness"])
    of = w.select("witness", F.posexplode("nodes").alias("pos", "node")).join(nodes.select("node", "kind", "reference"), "node")
    listed = lambda kind, c="node": F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct("pos", c)))), lambda s: s[c])
    parts = of.groupBy("witness").agg(listed("screen").alias("pages"), listed("action").alias("actions"), F.array_sort(F.collect_set(F.when(F.col("kind") == "operation", F.col("reference")))).alias("operations"))
    return _settled(w.join(parts, "witness"))


def edge_slices(witnesses_: DataFrame) -> DataFrame:
    """(witness, pos, node, edge): every node of a path with the edge that leaves it, null at the end."""
    return witnesses_.select("witness", "edges", F.posexplode("nodes").alias("pos", "node")).select("witness", "pos", "node", F.get(F.col("edges"), F.col("pos")).alias("edge"))


# --- variants -------------------------------------------------------------------------------------------------------

# Paths that tell of the signed-in person, and those that only tell whether there is one.
ACTOR_PATH = r"(?i)^(?:user|actor|principal|currentUser|session)(?:\.|$)"
ACTOR_PRESENCE = r"(?i)^(?:user|actor|principal|currentUser|session)(?:\.authenticated)?$"


def input_screens(witnesses_: DataFrame, nodes: DataFrame) -> DataFrame:
    """(witness, page): screens at or before a path's last action."""
    of = witnesses_.select("witness", F.posexplode("nodes").alias("pos", "node")).join(nodes.select("node", "kind"), "node")
    last = of.where("kind = 'action'").groupBy("witness").agg(F.max("pos").alias("last"))
    return of.where("kind = 'screen'").join(last, "witness").where("pos <= last").select("witness", F.col("node").alias("page")).distinct()


@lru_cache(10_000)
def _field_states(condition: str, visible: tuple[str, ...], needed: tuple[str, ...]) -> list[tuple]:
    """Visibility and need of a field under a condition, none if it is hidden. Many rows share both, so answers are kept."""
    base = P.parse(condition)
    seen = P.status_of(P.all_of([base, *map(P.parse, visible)]))
    return [] if seen == P.STATUSES[2] else [(seen, P.status_of(P.all_of([base, *map(P.parse, needed)])) if needed else None)]


def active_fields(witnesses_: DataFrame, nodes: DataFrame, fields: DataFrame, constraints: DataFrame) -> DataFrame:
    """witness, page, field, path, control, mode, visibility, required, constraint_status, rules: the fields of a path's
    input screens that its condition does not hide.

    fields: field, page, path, control, mode, visible_when, required_when (arrays of guards). constraints: witness, field,
    constraint, kind, value, status (of the field's constraints together). required: the status of its guards, where it
    has some, else 'true' if a constraint requires it, else 'false'.
    """
    shown = input_screens(witnesses_, nodes).join(fields, "page").join(witnesses_.select("witness", "condition"), "witness")

    def states(condition: str, visible: list[str] | None, needed: list[str] | None) -> list[tuple]:
        return _field_states(condition, tuple(visible or ()), tuple(needed or ()))

    shown = P.per_row(shown.withColumn("__c", _as_guard("condition")), ["__c", "visible_when", "required_when"], "visibility string, guarded string", states)
    listed = constraints.groupBy("witness", "field").agg(
        F.array_sort(F.collect_set(F.concat_ws(":", "kind", F.coalesce("value", F.lit(""))))).alias("rules"), F.max(F.col("kind") == "required").alias("__required"), F.max("status").alias("constraint_status"),
        F.max(F.col("kind") == "opaque").alias("opaque_rule"),
    )
    x = shown.join(listed, ["witness", "field"], "left")
    required = F.coalesce("guarded", F.when(F.coalesce("__required", F.lit(False)), "true").otherwise("false"))
    return _settled(x.select(
        "witness", "page", "field", "path", "control", input_mode(F.col("mode")).alias("mode"), "visibility", required.alias("required"),
        F.coalesce("constraint_status", F.lit("satisfiable")).alias("constraint_status"), F.coalesce("rules", none()).alias("rules"), F.coalesce("opaque_rule", F.lit(False)).alias("opaque_rule"),
    ))


def _as_guard(condition: str) -> Column:
    """A witness's condition, as it is labelled, back as a guard: ' and ' joins comparisons 'path op value'."""
    terms = F.split(F.col(condition), " and ")
    quoted = F.transform(terms, lambda t: F.when(F.rlike(t, F.lit(r"^[\w$.]+ (?:=|!=|>|>=|<|<=) .*$")), _compare(t)).otherwise(t))
    return F.when(F.col(condition) == "always", "true").otherwise(F.array_join(quoted, " && "))


def _compare(term: Column) -> Column:
    path, op = F.substring_index(term, " ", 1), F.split(term, " ")[1]
    value = F.regexp_replace(term, r"^[^ ]+ [^ ]+ ", "")
    sign = F.when(op == "=", "===").when(op == "!=", "!==").otherwise(op)
    return F.concat_ws(" ", path, sign, _quoted(F.concat(F.lit("v="), value)))


def assignment_roles(witnesses_: DataFrame, active: DataFrame, edges: DataFrame, literals: DataFrame, actors: DataFrame, bindings: DataFrame) -> DataFrame:
    """(witness, path, value, role, field): what stands behind each assignment of a path's condition.

    role: field (an editable active field's path, or its only leaf name), literal (the payload fixes it), actor (only says
    whether someone is signed in, and agrees), actor-attribute, entity (the one ID-like field of that entity) or unbound.
    literals: contract, name. actors: operation, authentication. bindings: field, binding_path.
    """
    a = witnesses_.select("witness", "edges", "operations", F.explode("assignments").alias("__a"))
    a = a.select("witness", "edges", "operations", F.substring_index("__a", "=", 1).alias("path"), F.regexp_replace("__a", "^[^=]*=", "").alias("value")).withColumn("leaf", leaf_name(F.col("path")))
    editable = active.where("mode = 'editable'").join(bindings, "field", "left")
    paths = editable.select("witness", "field", F.explode(F.array_distinct(texts(F.col("path"), F.col("binding_path")))).alias("path")).distinct()
    exact = paths.select("witness", "path").distinct().withColumn("exact", F.lit(True))
    by_leaf = paths.select("witness", "path", leaf_name(F.col("path")).alias("leaf")).distinct().groupBy("witness", "leaf").agg(F.count("*").alias("n_leaf"))
    fixed = a.select("witness", F.explode("edges").alias("edge")).distinct().join(edges.select("edge", F.explode("contracts").alias("contract")), "edge").join(literals, "contract").select("witness", F.col("name").alias("path")).distinct().withColumn("fixed", F.lit(True))
    needs = a.select("witness", F.explode("operations").alias("operation")).distinct().join(actors.select("operation", "authentication"), "operation")
    needs = needs.groupBy("witness").agg(F.max(F.col("authentication") == "required").alias("signed_in"), F.max(F.col("authentication") == "anonymous").alias("anonymous"))
    root = F.lower(F.regexp_replace(F.regexp_replace(F.split_part("path", F.lit("."), F.lit(1)), "(?i)^(selected|current|chosen|active)", ""), "(?i)(Entity|Model)$", ""))
    stem = F.lower(F.regexp_replace(leaf_name(F.col("path")), "(?i)(Id|Identifier|Key|Reference|Ref|Code|Number|No)$", ""))
    ids = editable.select("witness", "field", stem.alias("entity")).distinct().groupBy("witness", "entity").agg(F.count("*").alias("n"), F.min("field").alias("field")).where("n = 1").drop("n")
    x = a.withColumn("entity", F.when(F.split_part("path", F.lit("."), F.lit(2)) != "", F.nullif(root, F.lit(""))))
    x = x.join(exact, ["witness", "path"], "left").join(by_leaf, ["witness", "leaf"], "left").join(fixed, ["witness", "path"], "left").join(needs, "witness", "left").join(ids, ["witness", "entity"], "left")
    yes = lambda c: F.coalesce(c, F.lit(False))
    agrees = (yes(F.col("signed_in")) & (F.col("value") == "true")) | (yes(F.col("anonymous")) & F.col("value").isin("false", "null"))
    role = (
        F.when(yes(F.col("exact")) | yes(F.col("n_leaf") == 1), "field").when(yes(F.col("fixed")), "literal").when(F.rlike("path", F.lit(ACTOR_PRESENCE)) & agrees, "actor")
        .when(yes(F.col("signed_in")) & F.rlike("path", F.lit(ACTOR_PATH)), "actor-attribute").when(F.col("field").isNotNull(), "entity").otherwise("unbound")
    )
    return _settled(x.withColumn("role", role).select("witness", "path", "value", "role", F.when(F.col("role") == "entity", F.col("field")).alias("field")))


def behavior_variants(witnesses_: DataFrame, nodes: DataFrame, edges: DataFrame, active: DataFrame, roles: DataFrame, actors: DataFrame) -> DataFrame:
    """variant, family, signature, feasibility, witnesses, pages, actions, operations, rejected: paths of a family that
    behave alike, by a signature of eleven parts: actors, their attributes, entities, unbound paths, screens, actions,
    operations, the last node, active fields, request contracts in order, and assignments.

    A variant is conditional if a member is, or has an unbound path or an uncertain field; it is rejected if a field's
    constraints contradict one another.
    """
    of = lambda role, *c: F.array_sort(F.collect_list(F.when(F.col("role") == role, F.concat_ws("=", *c))))
    r = roles.groupBy("witness").agg(of("actor-attribute", "path", "value").alias("attributes"), of("entity", "path", "value", "field").alias("entities"), of("unbound", "path").alias("unbound"))
    doubt = (F.col("visibility") == "conditional") | (F.col("mode") == "conditional") | (F.col("required") == "conditional") | (F.col("constraint_status") == "conditional") | F.col("opaque_rule")
    contract = F.concat_ws("|", "page", "field", "path", "control", "mode", "visibility", "required", "constraint_status", F.array_join("rules", ";"))
    f = active.groupBy("witness").agg(F.array_sort(F.collect_list(contract)).alias("field_contracts"), F.max(doubt).alias("doubt"), F.max(F.col("constraint_status") == "unsatisfiable").alias("clash"))
    steps = witnesses_.select("witness", F.posexplode("edges").alias("pos", "edge")).join(edges.select("edge", F.explode("contracts").alias("contract")), "edge")
    k = steps.groupBy("witness").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "contract"))), lambda s: s["contract"]).alias("requests"))
    who = witnesses_.select("witness", F.explode("operations").alias("operation")).join(actors.select("operation", "actor"), "operation").groupBy("witness").agg(F.array_sort(F.collect_set("actor")).alias("actors"))
    x = witnesses_
    for part in (r, f, k, who):
        x = x.join(part, "witness", "left")
    for c in ("attributes", "entities", "unbound", "field_contracts", "requests", "actors"):
        x = x.withColumn(c, F.coalesce(c, none()))
    signature = F.sha2(F.to_json(F.struct("actors", "attributes", "entities", "unbound", "pages", "actions", "operations", F.element_at("nodes", -1).alias("success"), "field_contracts", "requests", "assignments")), 256)
    unsure = (F.col("feasibility") == "conditional") | (F.size("unbound") > 0) | F.coalesce("doubt", F.lit(False))
    x = x.withColumn("signature", signature).withColumn("unsure", unsure).withColumn("clash", F.coalesce("clash", F.lit(False)))
    first = F.min_by(F.struct("assignments", "pages", "actions", "operations"), "witness").alias("first")
    g = x.groupBy("family", "signature").agg(F.array_sort(F.collect_list("witness")).alias("witnesses"), F.max("unsure").alias("unsure"), F.max("clash").alias("rejected"), first)
    named = _settled(g.select("family", "signature", "witnesses", "unsure", "rejected", "first.*"))
    label = nodes.where("kind = 'action'").select(F.col("node").alias("__node"), F.col("label").alias("__label"))
    telling = named.select("family", "signature", F.posexplode("actions").alias("pos", "__node")).join(label, "__node").where(~F.rlike("__label", F.lit("(?i)^continue|submit|next$")))
    telling = telling.groupBy("family", "signature").agg(F.min_by("__label", "pos").alias("telling"))
    named = named.join(telling, ["family", "signature"], "left").withColumn("ordinal", F.row_number().over(Window.partitionBy("family").orderBy("signature")))
    values = F.transform(F.filter("assignments", lambda s: ~F.rlike(s, F.lit("=(?:true|false|null)$"))), lambda s: F.regexp_replace(s, "^[^=]*=", ""))
    discriminator = F.coalesce(F.nullif(F.array_join(values, "-"), F.lit("")), "telling", F.concat(F.lit("path-"), F.col("ordinal").cast("string")))
    base = F.concat_ws(".", "family", slug(discriminator))
    keys = F.array_join(F.transform("assignments", lambda s: leaf_name(F.substring_index(s, "=", 1))), "-")
    suffix = F.concat_ws("-", F.substring(slug(F.coalesce(F.nullif(keys, F.lit("")), F.lit("path"))), 1, 28), F.substring("signature", 1, 8))
    named = named.withColumn("base", base).withColumn("same", F.count("*").over(Window.partitionBy("base")))
    variant = F.when(F.col("same") > 1, F.concat_ws(".", "base", suffix)).otherwise(F.col("base"))
    return named.select(variant.alias("variant"), "family", "signature", F.when(F.col("unsure"), "conditional").otherwise("satisfiable").alias("feasibility"), "witnesses", "pages", "actions", "operations", "rejected")


# --- coverage -------------------------------------------------------------------------------------------------------

# The stages in the order in which an operation reaches them.
STAGES = ("frontend-client-join", "action-operation-join", "success-continuation", "flow-family", "entry-success-witness", "behavior-variant")


def coverage_status(missing: Column, inclusion: Column, variants: Column, conditional: Column) -> Column:
    """uncovered with a missing stage; conditional if the operation needs review or all of its variants are conditional."""
    return F.when(missing.isNotNull(), "uncovered").when((inclusion == "review-required") | (conditional >= variants), "conditional").otherwise("covered")


def missing_stage(*reached: Column) -> Column:
    """The first of STAGES that is not reached (null counts as not), null if all are."""
    out = F.lit(None).cast("string")
    for name, ok in reversed(list(zip(STAGES, reached, strict=True))):
        out = F.when(~F.coalesce(ok, F.lit(False)), name).otherwise(out)
    return out


def operation_coverage(operations: DataFrame, nodes: DataFrame, edges: DataFrame, members: DataFrame, witnesses_: DataFrame, variants: DataFrame) -> DataFrame:
    """operation, family, missing_stage, status, and the numbers of its witnesses and variants."""
    runs = nodes.where("kind = 'operation'").select("node", F.col("reference").alias("operation"))
    ends = edges.where("outcome = 'success'").select(F.col("src").alias("node")).distinct()
    n = lambda df, name: df.groupBy("operation").agg(F.count("*").alias(name))
    w = witnesses_.select("witness", F.explode("operations").alias("operation"))
    v = variants.where("NOT rejected").select("feasibility", F.explode("operations").alias("operation"))
    v = v.groupBy("operation").agg(F.count("*").alias("variants"), F.count_if(F.col("feasibility") == "conditional").alias("conditional"))
    x = operations.where("inclusion <> 'excluded'").select("operation", "inclusion", "clients")
    for part in (n(runs, "runs"), n(runs.join(ends, "node", "left_semi"), "ends"), members.groupBy("operation").agg(F.min("family").alias("family")), n(w, "witnesses"), v):
        x = x.join(part, "operation", "left")
    missing = missing_stage(F.size("clients") > 0, F.col("runs") > 0, F.col("ends") > 0, F.col("family").isNotNull(), F.col("witnesses") > 0, F.col("variants") > 0)
    count = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    x = x.withColumn("missing_stage", missing)
    return x.select("operation", "inclusion", "family", "missing_stage", coverage_status(F.col("missing_stage"), F.col("inclusion"), F.coalesce("variants", F.lit(0)), F.coalesce("conditional", F.lit(0))).alias("status"), count("witnesses"), count("variants"))


def coverage_totals(tables: dict[str, DataFrame]) -> DataFrame:
    """(name, n): the report's counts, 25 with all tables at hand; a table that is missing leaves its counts out.

    tables: any of facts, actions, operations, effects, pages, actors, nodes, edges, families, witnesses, states,
    variants, requirements, bindings, contracts, coverage.
    """
    # fixed values: the names of the counts
    every = {
        "facts": {"evidenceNodes": None}, "actions": {"sourceDeclaredActions": None, "handlerResolvedActions": "handler IS NOT NULL"}, "operations": {"terminalOperations": "inclusion <> 'excluded'"},
        "effects": {"unresolvedTerminalEffects": "kind = 'unknown-mutation'"}, "pages": {"pageContracts": None}, "actors": {"actorRequirements": None}, "nodes": {"behaviorNodes": None}, "edges": {"behaviorEdges": None},
        "families": {"flowFamilies": None}, "witnesses": {"pathWitnesses": None},
        "states": {"pathSearchEnqueuedStates": "state <> 'visit'", "pathSearchDequeuedStates": "state <> 'visit'", "pathSearchDepthPrunes": "state = 'depth'", "pathSearchVisitPrunes": "state = 'visit'"},
        "variants": {"variants": None, "conditionalVariants": "feasibility = 'conditional'"}, "requirements": {"dataRequirements": None, "unresolvedDataRequirements": "status = 'unresolved'"}, "bindings": {"runtimeBindings": None},
        "contracts": {"requestPayloadContracts": None, "requestPayloadFieldsPresent": "status = 'fields-present'", "requestPayloadReviewRequired": "status = 'review-required'", "requestPayloadPathsBlocked": "status IN ('required-fields-missing', 'required-fields-invalid')"},
        "coverage": {"uncoveredOperations": "status = 'uncovered'"},
    }
    out = None
    for name, df in tables.items():
        counts = df.agg(*[(F.count("*") if cond is None else F.count_if(F.expr(cond))).alias(c) for c, cond in every[name].items()])
        pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("n")) for c in every[name]])).alias("p")
        one = counts.select(pairs).select("p.name", "p.n")
        out = one if out is None else out.unionByName(one)
    return out
