"""Identity, names and digests as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def slug(c: Column) -> Column:
    """Lower-case words joined by dashes; a capital after a small letter or digit begins a word; 'unnamed' if empty."""
    x = F.regexp_replace(c, "([a-z0-9])([A-Z])", "$1-$2")
    x = F.regexp_replace(F.lower(x), "[^a-z0-9]+", "-")
    x = F.regexp_replace(x, "^-|-$", "")
    return F.coalesce(F.nullif(x, F.lit("")), F.lit("unnamed"))


def digest(c: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(c, 256))


def stable_id(kind: Column, key: Column) -> Column:
    short = F.substring(F.sha2(F.concat(kind, F.lit(":"), key), 256), 1, 12)
    return F.concat_ws(".", slug(kind), F.substring(slug(key), 1, 72), short)


def canonical_json(c: Column) -> Column:
    """A JSON text with sorted keys and no spaces."""
    return F.to_json(F.parse_json(c))


def normal_template(path: Column) -> Column:
    """A route without query or fragment, its parameters as {param}, single slashes and none at the end."""
    x = F.regexp_replace(path, r"[?#].*$", "")
    x = F.regexp_replace(x, r":[A-Za-z_][A-Za-z0-9_]*|\{[^}/]*\}", "{param}")
    x = F.regexp_replace(x, "/+", "/")
    return F.coalesce(F.nullif(F.regexp_replace(x, "/$", ""), F.lit("")), F.lit("/"))


def template_pattern(template: Column) -> Column:
    """A regular expression that matches the routes of a normal template; other signs are taken literally."""
    quoted = F.regexp_replace(template, r"([\\.\[\]()*+?^$|])", r"\\$1")
    return F.concat(F.lit("^"), F.regexp_replace(quoted, r"\{param\}", "[^/]+"), F.lit("$"))


def route_matches(route: Column, template: Column) -> Column:
    return F.rlike(normal_template(route), template_pattern(normal_template(template)))


def url_path(url: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(url, r"^[a-z]+://[^/?#]+([^?#]*)", 1), F.lit("")), F.lit("/"))


def http_path(path: Column, base: Column) -> Column:
    """A request's path: of an absolute URL its own; else below the client's base path (null for none), named once."""
    plain = lambda c: F.regexp_replace(F.concat(F.lit("/"), F.regexp_replace(F.regexp_replace(c, r"[?#].*$", ""), r"\$\{([^}]+)\}", "{$1}")), "/+", "/")
    own, top = plain(path), F.regexp_replace(plain(base), "/$", "")
    absolute = F.rlike(path, F.lit("(?i)^https?://"))
    under = base.isNull() | (top == "") | (own == top) | own.startswith(F.concat(top, F.lit("/")))
    return F.when(absolute, plain(F.regexp_extract(path, r"(?i)^https?://[^/?#]+([^?#]*)", 1))).when(under, own).otherwise(F.concat(top, own))


def infer_entity(request: Column, controller: Column, path: Column) -> Column:
    """The request's type without its ending, else the controller's, else the last fixed segment of the path."""
    r, c = F.regexp_replace(request, "(?:Create|Update|Submit|Joint|Personal)?Request$", ""), F.regexp_replace(controller, "Controller$", "")
    fixed = F.filter(F.split(path, "/"), lambda s: (s != "") & ~s.contains("{"))
    return F.when(r != request, F.coalesce(F.nullif(r, F.lit("")), request)).when(c != controller, c).otherwise(F.coalesce(F.get(fixed, F.size(fixed) - 1), F.lit("Entity")))


def same_entity(a: Column, b: Column) -> Column:
    return entity_stem(a) == entity_stem(b)


def scalar_value(c: Column) -> Column:
    """A text as JSON of the value it writes: null, a boolean, a number, or the text itself."""
    return F.when(scalar_type(c) == "string", F.to_json(F.struct(c.alias("v")))).otherwise(F.concat(F.lit('{"v":'), F.coalesce(c, F.lit("null")), F.lit("}")))


def join_route(parent: Column, child: Column) -> Column:
    """A child's route under its parent's; an absolute child stands alone."""
    both = F.regexp_replace(F.concat_ws("/", F.regexp_replace(parent, "/+$", ""), child), "/+", "/")
    return F.when(child.startswith("/"), child).otherwise(both)


def leaf_name(path: Column) -> Column:
    return F.element_at(F.split(path, r"\."), -1)


def words_of_name(name: Column) -> Column:
    x = F.regexp_replace(name, "([a-z0-9])([A-Z])", "$1 $2")
    return F.filter(F.split(F.lower(x), "[^a-z0-9]+"), lambda w: w != "")


def capitalised(c: Column) -> Column:
    return F.concat(F.upper(F.substring(c, 1, 1)), F.substring(c, 2, 1_000_000))


def command_words(name: Column) -> Column:
    """'submitOrder' as 'Submit order'."""
    return capitalised(F.array_join(words_of_name(name), " "))


def entity_stem(name: Column) -> Column:
    """A type's name without Entity or Model at the end, lower case, singular."""
    x = F.lower(F.regexp_replace(name, "(?:Entity|Model)$", ""))
    return F.when(x.endswith("ies"), F.regexp_replace(x, "ies$", "y")).otherwise(F.regexp_replace(x, "(?<!s)s$", ""))


def gherkin_text(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def gherkin_tag(c: Column) -> Column:
    return F.concat(F.lit("@"), F.regexp_replace(c, "[^A-Za-z0-9_.-]+", "-"))


def gherkin_string(c: Column) -> Column:
    return F.concat(F.lit('"'), F.regexp_replace(F.regexp_replace(c, r"\\", r"\\\\"), '"', r'\\"'), F.lit('"'))


def safe_segment(c: Column) -> Column:
    return F.rlike(c, F.lit(r"^[A-Za-z0-9][A-Za-z0-9._-]{0,127}$")) & ~c.contains("..")


def scalar_type(c: Column) -> Column:
    return (
        F.when(c.isNull() | (c == "null"), "null").when(c.isin("true", "false"), "boolean").when(F.rlike(c, F.lit(r"^-?[0-9]+(\.[0-9]+)?$")), "number").otherwise("string")
    )
