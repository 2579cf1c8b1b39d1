"""Lexical extraction of facts from sources: what patterns can see without symbols.

Everything here works on literals in the text. Facts that need resolved symbols (which handler a name means, payload
identity, guards from control flow) are taken as input tables instead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

METHODS = {"GetMapping": "GET", "PostMapping": "POST", "PutMapping": "PUT", "PatchMapping": "PATCH", "DeleteMapping": "DELETE"}


def matches(content: Column, pattern: str) -> Column:
    return F.regexp_extract_all(content, F.lit(pattern), F.lit(0))


def pick(pattern: str, group: int = 1, column: str = "m") -> Column:
    return F.nullif(F.regexp_extract(column, pattern, group), F.lit(""))


def found(files: DataFrame, language: str, pattern: str) -> DataFrame:
    return files.where(F.col("language") == language).select("path", F.posexplode(matches(F.col("content"), pattern)).alias("ordinal", "m"))


def endpoints(files: DataFrame) -> DataFrame:
    """Mapping annotations of methods as (path, ordinal, method, template), under the class's base path."""
    base = F.regexp_extract("content", r'@RequestMapping\(\s*(?:value\s*=\s*|path\s*=\s*)?"([^"]*)"', 1)
    d = files.where("language = 'java'").select("path", base.alias("base"), F.posexplode(matches(F.col("content"), r"@(?:Get|Post|Put|Patch|Delete)Mapping(?:\([^)]*\))?")).alias("ordinal", "m"))
    pairs = [F.lit(x) for kv in METHODS.items() for x in kv]
    own = F.regexp_extract("m", r'"([^"]*)"', 1)
    template = F.regexp_replace(F.concat(F.col("base"), F.when(own == "", "").when(own.startswith("/"), own).otherwise(F.concat(F.lit("/"), own))), "/+", "/")
    return d.select("path", "ordinal", F.create_map(*pairs)[F.regexp_extract("m", r"@(\w+)", 1)].alias("method"), template.alias("template"))


def authorizations(files: DataFrame) -> DataFrame:
    """Authorities of annotations; status conditional where the expression is more than authorities joined by `and`."""
    d = found(files, "java", r'@(?:PreAuthorize|Secured|RolesAllowed)\([^\n]*\)')
    names = F.regexp_extract_all("m", F.lit(r"""(?:hasAuthority|hasRole|hasAnyAuthority|hasAnyRole)\('([^']+)'\)"""), F.lit(1))
    plain = F.regexp_extract_all("m", F.lit(r'"([A-Z][A-Z0-9_]*)"'), F.lit(1))
    rest = F.trim(F.regexp_replace(F.regexp_replace("m", r"""@PreAuthorize\("|"\)|(?:hasAuthority|hasRole)\('[^']+'\)""", ""), r"\band\b", ""))
    status = F.when(F.col("m").startswith("@PreAuthorize") & (rest != ""), "conditional").otherwise("certain")
    return d.select("path", "ordinal", F.array_sort(F.array_union(names, plain)).alias("authorities"), status.alias("status"))


def field_rules(files: DataFrame) -> DataFrame:
    """Bean validation annotations with the field after them: (path, field, kind, value)."""
    d = found(files, "java", r"(?:@(?:NotNull|NotBlank|NotEmpty|Email|Size|Min|Max|Pattern)(?:\([^)]*\))?\s+)+(?:private |public |protected |final )*[\w<>\[\], ?]+?\s+\w+\s*[;,)=]")
    field = F.regexp_extract("m", r"(\w+)\s*[;,)=]$", 1)
    each = d.select("path", field.alias("field"), F.explode(matches(F.col("m"), r"@\w+(?:\([^)]*\))?")).alias("m"))
    name = F.regexp_extract("m", r"@(\w+)", 1)
    low, high = pick(r"\bmin\s*=\s*(\d+)"), pick(r"\bmax\s*=\s*(\d+)")
    one = lambda kind, value: F.struct(F.lit(kind).alias("kind"), value.cast("string").alias("value"))
    rules = (
        F.when(name.isin("NotNull", "NotBlank", "NotEmpty"), F.array(one("required", F.lit(None))))
        .when(name == "Email", F.array(one("format", F.lit("email"))))
        .when(name == "Size", F.filter(F.array(one("minLength", low), one("maxLength", high)), lambda r: r["value"].isNotNull()))
        .when(name == "Min", F.array(one("min", pick(r"\((?:value\s*=\s*)?(-?\d+)"))))
        .when(name == "Max", F.array(one("max", pick(r"\((?:value\s*=\s*)?(-?\d+)"))))
        .when(name == "Pattern", F.array(one("pattern", pick(r'regexp\s*=\s*"([^"]*)"'))))
    )
    return each.select("path", "field", F.explode(rules).alias("r")).select("path", "field", "r.kind", "r.value")


def effects(files: DataFrame) -> DataFrame:
    """Repository and client calls as effects: created or changed, deleted, external."""
    d = found(files, "java", r"\b\w+\.(?:save|saveAll|delete|deleteById|deleteAll|send|publish|postForEntity|exchange)\(")
    receiver, call = F.regexp_extract("m", r"^(\w+)\.", 1), F.regexp_extract("m", r"\.(\w+)\(", 1)
    kind = F.when(call.startswith("delete"), "deleted").when(call.startswith("save"), "state-changed").otherwise("external")
    entity = F.regexp_replace(receiver, "(?i)(repository|repo|dao|client|service)$", "")
    return d.select("path", "ordinal", F.initcap(F.coalesce(F.nullif(entity, F.lit("")), F.lit("unknown"))).alias("entity"), kind.alias("kind"))


def routes(files: DataFrame) -> DataFrame:
    """Route elements and router objects with literal paths."""
    d = found(files, "typescript", r"""<Route\b[^>]*\bpath=["'{][^>]*>|\bpath:\s*["'][^"']+["'][^}]*""")
    component = F.coalesce(pick(r"element=\{?<(\w+)"), pick(r"component=\{(\w+)\}"), pick(r"element:\s*<(\w+)"), pick(r"Component:\s*(\w+)"))
    return d.select("path", "ordinal", pick(r"""path[=:]\s*\{?["']([^"']*)["']""").alias("route"), component.alias("component")).where("route IS NOT NULL")


def http_calls(files: DataFrame) -> DataFrame:
    """fetch and client calls with literal paths; a template's parts become {param}."""
    d = found(files, "typescript", r"""\bfetch\(\s*["'`][^"'`]+["'`][^;]*|\b\w+\.(?:get|post|put|patch|delete)(?:<[^>]*>)?\(\s*["'`][^"'`]+["'`]""")
    template = F.regexp_replace(F.regexp_extract("m", r"""["'`]([^"'`]+)["'`]""", 1), r"\$\{[^}]*\}", "{param}")
    method = F.upper(F.coalesce(pick(r"\.(get|post|put|patch|delete)(?:<[^>]*>)?\("), pick(r"""method:\s*["'](\w+)["']"""), F.lit("GET")))
    return d.select("path", "ordinal", method.alias("method"), template.alias("template"))


def navigations(files: DataFrame) -> DataFrame:
    """Literal targets of links and of navigate calls."""
    d = found(files, "typescript", r"""\b(?:href|to)=["'{]+[^"'}]+["'}]|\bnavigate\(\s*["'`][^"'`]+["'`]""")
    target = F.regexp_replace(F.coalesce(pick(r"""=["'{]+([^"'}`]+)"""), pick(r"""\(\s*["'`]([^"'`]+)""")), r"\$\{[^}]*\}", "{param}")
    return d.select("path", "ordinal", F.when(F.col("m").startswith("navigate"), "imperative").otherwise("declarative").alias("kind"), target.alias("target"))


def permissions(files: DataFrame) -> DataFrame:
    d = found(files, "typescript", r"""\b(?:hasPermission|hasAuthority|can|usePermission)\(\s*["'][^"']+["']""")
    return d.select("path", "ordinal", F.regexp_extract("m", r"""["']([^"']+)["']""", 1).alias("authority"))


def fields(files: DataFrame) -> DataFrame:
    """Native controls with their literal attributes and constraints."""
    d = found(files, "typescript", r"<(?:input|select|textarea)\b(?:[^<>]|=>)*>")
    has = lambda name: F.rlike("m", F.lit(rf"\b{name}\b(?!=\{{false\}})"))
    attr = lambda name: pick(rf"""\b{name}=(?:["']|\{{["']?)([^"'}}]*)""")
    return d.select(
        "path", "ordinal", F.regexp_extract("m", r"^<(\w+)", 1).alias("control"), F.coalesce(attr("name"), attr("id")).alias("name"), attr("type").alias("type"), has("required").alias("required"),
        attr("minLength").cast("int").alias("min_length"), attr("maxLength").cast("int").alias("max_length"), attr("min").alias("min"), attr("max").alias("max"), attr("pattern").alias("pattern"),
        has("disabled").alias("disabled"), has("readOnly").alias("read_only"),
    )


def handled_by(calls: DataFrame, ends: DataFrame) -> DataFrame:
    """Calls joined to the endpoint of their method and normal template; match: unique, missing or ambiguous."""
    from waypath.functions.ids import normal_template
    from waypath.operators.joins import unique_join

    key = normal_template(F.col("template"))
    right = ends.select("method", key.alias("key"), F.col("path").alias("endpoint_path"), F.col("ordinal").alias("endpoint_ordinal"))
    return unique_join(calls.withColumn("key", key), right, ["method", "key"], ["endpoint_path", "endpoint_ordinal"])


def page_choice(candidates: DataFrame) -> DataFrame:
    """(file, component, rule) of each file's page components, or component null and rule 'unresolved'.

    candidates: file, component, routed, exported. The first rule that gives any decides: routed ones; exported ones of a
    page's name; the only exported one of a pages folder; the only one of a page's name; the only one of a pages folder.
    Files without a sign of a page (folder or name) have none.
    """
    from pyspark.sql import Window

    page_name, folder = F.rlike("component", F.lit("(?:Page|Screen|View)$")), F.rlike("file", F.lit("(?i)(?:^|/)pages?/"))
    w = Window.partitionBy("file")
    n = lambda c: F.count_if(c).over(w)
    x = candidates.withColumns({
        "routed_n": n(F.col("routed")), "exported_named": n(F.col("exported") & page_name), "exported_n": n(F.col("exported")), "named_n": n(page_name), "all_n": F.count("*").over(w),
        "folder": folder, "named": page_name,
    })
    rule = (
        F.when(F.col("routed_n") > 0, F.when(F.col("routed"), "routed")).when(~F.col("folder") & (F.col("named_n") == 0), F.lit(None))
        .when(F.col("exported_named") > 0, F.when(F.col("exported") & F.col("named"), "exported-name")).when(F.col("folder") & (F.col("exported_n") == 1), F.when(F.col("exported"), "only-export"))
        .when(F.col("named_n") == 1, F.when(F.col("named"), "only-name")).when(F.col("folder") & (F.col("all_n") == 1), F.lit("only-one")).otherwise(F.lit("unresolved"))
    )
    x = x.withColumn("rule", rule).where("rule IS NOT NULL")
    return x.select("file", F.when(F.col("rule") != "unresolved", F.col("component")).alias("component"), "rule").distinct()


def unresolved_children(uses: DataFrame, components: DataFrame, native: DataFrame) -> DataFrame:
    """Components (page, child) that a page uses and that are neither declared (component) nor native (child)."""
    known = components.select(F.col("component").alias("child")).unionByName(native.select("child")).distinct()
    return uses.select("page", "child").distinct().join(known, "child", "left_anti").select("page", "child")


def with_constants(texts: DataFrame, column: str, constants: DataFrame) -> DataFrame:
    """texts with `value`: a quoted literal's content, or that of the only constant (name, value) of that name; null else."""
    one = constants.groupBy(F.col("name").alias("__name")).agg(F.count_distinct("value").alias("__n"), F.min("value").alias("__value")).where("__n = 1").drop("__n")
    x = texts.join(one, F.col(column) == F.col("__name"), "left")
    quoted = F.nullif(F.regexp_extract(column, r"""^(["'`])([^"'`$]*)\1$""", 2), F.lit(""))
    return x.withColumn("value", F.coalesce(quoted, "__value")).drop("__name", "__value")


def composed_routes(routes: DataFrame, max_depth: int = 12) -> DataFrame:
    """(route, full, component): paths of nested route elements put together; an index route has its parent's path.

    routes: route, parent (null at the top), path (null for an index or a layout), component. One join a level; deeper
    nesting, and cycles, raise an error.
    """
    from waypath.functions.ids import join_route
    from waypath.operators.graph import _settled

    r = _settled(routes.select("route", "parent", "path", "component"))
    slash = lambda c: F.when(c.startswith("/"), c).otherwise(F.concat(F.lit("/"), c))
    front = _settled(r.where("parent IS NULL").select("route", slash(F.coalesce("path", F.lit("/"))).alias("full"), "component"))
    out = front
    for _ in range(max_depth):
        above = front.select(F.col("route").alias("parent"), F.col("full").alias("__above"))
        full = F.when(F.col("path").isNull(), F.col("__above")).otherwise(join_route(F.col("__above"), F.col("path")))
        front = _settled(r.join(above, "parent").select("route", full.alias("full"), "component"))
        if front.isEmpty():
            return out
        out = out.unionByName(front)
    raise ValueError(f"routes nested more than {max_depth} deep")
