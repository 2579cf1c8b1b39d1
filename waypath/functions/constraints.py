"""Field constraints: checks of values and of sets of constraints, representatives, and sensitive names."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waypath.functions.ids import leaf_name, words_of_name

EMAIL = r"^[A-Za-z0-9.!#$%&'*+/=?^_`{|}~-]+@[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?)*$"
# Names that count as sensitive (any word of a name; a whole name without separators).
SENSITIVE_WORDS = ("password", "passwd", "passcode", "pwd", "token", "secret", "otp", "credential", "credentials", "cvv", "cvc")
SENSITIVE_NAMES = (
    "apikey", "accesskey", "privatekey", "clientsecret", "sessioncookie", "authcode", "accesscode", "verificationcode", "securitycode", "authpin", "loginpin",
    "securitypin", "pin",
)


def portable(pattern: Column) -> Column:
    """Whether a pattern means the same in the common dialects: no look-around, back-references, named groups or flags."""
    return ~F.rlike(pattern, F.lit(r"\(\?|\\[1-9kpPbBuG]|[*+?}]\+"))


def is_type(value: Column, kind: Column) -> Column:
    number = value.try_cast("double")
    whole = number.isNotNull() & (number == F.floor(number))
    return (
        F.when(kind == "integer", whole).when(kind == "number", number.isNotNull()).when(kind == "boolean", value.isin("true", "false")).when(kind == "string", F.lit(True)).otherwise(F.lit(None))
    )


def check_value(value: Column, kind: Column, num: Column, text: Column, items: Column) -> Column:
    """valid, invalid or conditional, of one value under one constraint. An absent value fails `required` only."""
    number, n = value.try_cast("double"), F.char_length(value)
    empty = value.isNull() | (value == "")
    ok = (
        F.when(kind == "required", ~empty)
        .when(empty, F.lit(True))
        .when(kind == "minLength", n >= num)
        .when(kind == "maxLength", n <= num)
        .when(kind == "min", number >= num)
        .when(kind == "max", number <= num)
        .when(kind == "enum", F.array_contains(items, value))
        .when(kind == "type", is_type(value, text))
        .when((kind == "format") & (text == "email"), F.rlike(value, F.lit(EMAIL)))
        .when((kind == "pattern") & portable(text), F.rlike(value, F.concat(F.lit("^(?:"), text, F.lit(")$"))))
    )
    numeric = kind.isin("min", "max") & ~empty & number.isNull()
    return F.when(numeric, "invalid").when(ok, "valid").when(~ok, "invalid").otherwise("conditional")


def worst(status: Column) -> Column:
    """Aggregate: invalid before conditional before valid."""
    rank = F.max(F.when(status == "invalid", 2).when(status == "conditional", 1).otherwise(0))
    return F.element_at(F.array(*map(F.lit, ("valid", "conditional", "invalid"))), rank + 1)


def evaluate(values: DataFrame, constraints: DataFrame, key: str) -> DataFrame:
    """values (key, value) against constraints (key, id, kind, num_value, str_value, arr_value): status and failing ids."""
    both = values.join(constraints, key).withColumn("status", check_value(*map(F.col, ("value", "kind", "num_value", "str_value", "arr_value"))))
    failing = F.array_join(F.sort_array(F.collect_set(F.when(F.col("status") != "valid", F.col("id")))), ",")
    return both.groupBy(key, "value").agg(worst(F.col("status")).alias("status"), failing.alias("issues"))


def consistency(constraints: DataFrame, key: str) -> DataFrame:
    """Per field: whether its constraints can hold together. Enumerations are intersected by counting, not by folding."""
    k = F.col("kind")
    lists = constraints.where(k == "enum").groupBy(key).agg(F.count_distinct("id").alias("lists"))
    items = constraints.where(k == "enum").select(key, "id", F.explode("arr_value").alias("item")).groupBy(key, "item").agg(F.count_distinct("id").alias("n"))
    common = items.join(lists, key).where("n = lists").groupBy(key).agg(F.count("*").alias("common"))
    of = lambda kind, x: F.when(k == kind, x)
    g = constraints.groupBy(key).agg(
        F.count_distinct(of("type", F.col("str_value"))).alias("types"),
        F.max(of("min", F.col("num_value"))).alias("low"), F.min(of("max", F.col("num_value"))).alias("high"),
        F.max(of("minLength", F.col("num_value"))).alias("short"), F.min(of("maxLength", F.col("num_value"))).alias("long"),
        F.max(k == "required").alias("required"), F.max((k == "pattern")).alias("pattern"),
    )
    g = g.join(lists, key, "left").join(common, key, "left")
    clash = (
        (F.col("types") > 1) | F.coalesce(F.col("low") > F.col("high"), F.lit(False)) | F.coalesce(F.col("short") > F.col("long"), F.lit(False))
        | (F.col("required") & F.coalesce(F.col("long") < 1, F.lit(False))) | (F.col("lists").isNotNull() & F.col("common").isNull())
    )
    return g.select(key, F.when(clash, "inconsistent").when(F.col("pattern"), "conditional").otherwise("consistent").alias("status"))


def representative(candidates: DataFrame, constraints: DataFrame, key: str) -> DataFrame:
    """candidates (key, pos, value): the first that every constraint of the key accepts, null if none."""
    left = candidates.join(constraints, key, "left").withColumn("status", check_value(*map(F.col, ("value", "kind", "num_value", "str_value", "arr_value"))))
    judged = left.groupBy(key, "pos", "value").agg(worst(F.when(F.col("kind").isNull(), "valid").otherwise(F.col("status"))).alias("status"))
    return judged.groupBy(key).agg(F.min_by(F.when(F.col("status") == "valid", F.col("value")), F.when(F.col("status") == "valid", F.col("pos"))).alias("value"))


def sensitive(path: Column) -> Column:
    """Whether a part of a path (between dots and brackets) is a sensitive name."""
    words, names = (F.array(*map(F.lit, x)) for x in (SENSITIVE_WORDS, SENSITIVE_NAMES))
    parts = F.filter(F.split(path, r"[.\[\]]+"), lambda x: F.trim(x) != "")
    return F.exists(parts, lambda x: F.arrays_overlap(words_of_name(x), words) | F.array_contains(names, F.array_join(words_of_name(x), "")))


# What the leaf of a path that names an existing entity looks like.
ENTITY_LEAF = (
    "(?i)(?:(?:id|identifier|key|reference|ref)$|^(?:applicant|customer|account|entity)$|^(?:account|customer|application|applicant|tax|national|socialSecurity).*(?:number|no)$|^(?:ssn|pan|tin|iban)$)"
)
OPTION_CONTROL = "(?i)select|picker|combobox"


def field_class(path: Column, control: Column, has_options: Column, assigned: Column) -> Column:
    """What kind of value a field needs; the first rule that holds decides.

    path: the field's data path. control: its kind. has_options: it has a source of options. assigned: the flow's
    condition fixes its value.
    """
    control = F.coalesce(control, F.lit(""))
    return (
        F.when(sensitive(control) | sensitive(path), "secret-reference")
        .when(F.rlike(leaf_name(path), F.lit(ENTITY_LEAF)), "existing-entity")
        .when(F.coalesce(has_options, F.lit(False)) | F.rlike(path, F.lit("(?i)code$")) | F.rlike(control, F.lit(OPTION_CONTROL)), "runtime-option")
        .when(F.coalesce(assigned, F.lit(False)), "flow-literal")
        .otherwise("synthetic-constrained")
    )


# The ways to come by a value of each class, in order.
STRATEGIES = {
    "flow-literal": "path-assignment",
    "synthetic-constrained": "constraint-generator",
    "derived": "execution-binding",
    "runtime-option": "runtime-option-provider",
    "existing-entity": "approved-fixture,read-only-lookup,test-builder,manual-binding",
    "authenticated-identity": "approved-identity-catalog,secret-reference,manual-binding",
    "actor-attribute": "approved-actor-fixture,approved-identity-catalog,manual-binding",
    "secret-reference": "corporate-secret-store",
    "external-manual": "manual-request",
}


def strategies(kind: Column) -> Column:
    """Strategies of a class, comma-joined; null for an unknown one."""
    pairs = [F.lit(x) for kv in STRATEGIES.items() for x in kv]
    return F.create_map(*pairs)[kind]


def usable(kind: Column, unique: Column, actionable: Column) -> Column:
    """Whether a runtime binding may be used: sessions always, screens if found once, others if found once and actionable."""
    once = F.coalesce(unique, F.lit(False))
    return F.when(kind == "actor-session", F.lit(True)).when(kind == "screen-state", once).otherwise(once & F.coalesce(actionable, F.lit(False)))


#: Classes whose values are kept outside and only referred to.
SECRET_CLASSES = ("secret-reference", "authenticated-identity")
#: The form of the one kind of reference that is no URL, where a project allows it.
ARN = r"(?i)^arn:(?:aws|aws-us-gov|aws-cn):secretsmanager:[a-z0-9-]+:\d{12}:secret:[^\s]+$"


def approved_reference(ref: Column, schemes: Sequence[str], arns: bool = False) -> Column:
    """Whether a secret is referred to by an approved scheme, or by an ARN, where these are allowed."""
    ok = F.regexp_extract(ref, r"^([a-z][a-z0-9+.-]*)://", 1).isin(*schemes)
    return (ok | F.rlike(ref, F.lit(ARN))) if arns else ok


def modality_issue(kind: Column, value: Column, secret_ref: Column, schemes: Sequence[str] = ("vault",), arns: bool = False) -> Column:
    """Why a binding has the wrong form, null if it has not: secrets by an approved reference only, others by value only."""
    secret = kind.isin(*SECRET_CLASSES)
    return (
        F.when(secret & (secret_ref.isNull() | value.isNotNull()), "secret-reference-required")
        .when(~secret & (value.isNull() | secret_ref.isNotNull()), "value-required")
        .when(secret & ~approved_reference(secret_ref, schemes, arns), "reference-not-approved")
    )


def binding_issue(kind: Column, value: Column, secret_ref: Column, resolver: Column, strategies_: Column, digest: Column, current: Column, expected: Column, **approved) -> Column:
    """The first reason why a confirmed binding does not meet its requirement, null if it does: its form, the requirement's
    digest, its strategies, and the value the flow asserts."""
    return (
        F.coalesce(
            modality_issue(kind, value, secret_ref, **approved), F.when(~digest.eqNullSafe(current), "requirement-changed"), F.when(~F.coalesce(F.array_contains(strategies_, resolver), F.lit(False)), "strategy-not-allowed"),
            F.when(value.isNotNull() & expected.isNotNull() & (value != expected), "unexpected-value"),
        )
    )


def candidates(constraints: DataFrame, key: str) -> DataFrame:
    """(key, pos, value): values to try for a field, in order: its options, an address, booleans, its least number, then
    texts of its least length. Fields with an opaque or size constraint have none; keys are those of `constraints`."""
    k, num = F.col("kind"), F.col("num_value")
    text = lambda kind, v: F.max((k == kind) & (F.col("str_value") == v))
    g = constraints.groupBy(key).agg(
        F.flatten(F.transform(F.array_sort(F.collect_list(F.when(k == "enum", F.struct("id", "arr_value")))), lambda x: x["arr_value"])).alias("options"),
        text("format", "email").alias("email"), text("type", "boolean").alias("boolean"), text("type", "integer").alias("integer"),
        (text("type", "number") | F.max(k.isin("min", "max"))).alias("number"), F.greatest(F.lit(0.0), F.max(F.when(k == "min", num))).alias("low"),
        F.greatest(F.lit(1.0), F.max(F.when(k == "minLength", num))).cast("int").alias("length"), F.max(k.isin("opaque", "size")).alias("closed"),
    )
    yes = lambda c, *v: F.when(F.coalesce(F.col(c), F.lit(False)), F.array(*[x if isinstance(x, Column) else F.lit(x) for x in v])).otherwise(F.array().cast("array<string>"))
    whole = F.ceil("low").cast("string")
    plain = F.when(F.col("low") == F.floor("low"), F.floor("low").cast("string")).otherwise(F.col("low").cast("string"))
    tries = F.concat(
        F.coalesce("options", F.array().cast("array<string>")), yes("email", "test@example.com"), yes("boolean", "true", "false"), yes("integer", whole, "1"), yes("number", plain, "1"),
        F.array(F.repeat(F.lit("A"), F.col("length")), F.lit("TEST"), F.lit("test"), F.lit("1234567890")),
    )
    return g.where(~F.coalesce("closed", F.lit(False))).select(key, F.posexplode(tries).alias("pos", "value"))


def synthesised(constraints: DataFrame, key: str) -> DataFrame:
    """(key, value): the first candidate that all constraints of the key accept, null if none does."""
    found = representative(candidates(constraints, key), constraints, key)
    return constraints.select(key).distinct().join(found, key, "left").select(key, "value")


def option_values(fields: DataFrame, constraints: DataFrame, key: str) -> DataFrame:
    """(key, value): for fields (key, options, assigned) with static options, the assigned value, or else the synthesised
    one, or else the first option, whichever is an option that all constraints accept; null if none is."""
    made = synthesised(constraints, key).withColumnRenamed("value", "__made")
    f = fields.where(F.size("options") > 0).join(made, key, "left")
    order = F.when(F.col("assigned").isNotNull(), F.array("assigned")).otherwise(F.concat(F.array("__made"), "options"))
    tries = f.select(key, "options", F.posexplode(order).alias("pos", "value")).where(F.col("value").isNotNull() & F.array_contains("options", F.col("value")))
    found = representative(tries.select(key, "pos", "value"), constraints, key)
    return fields.select(key).join(found, key, "left").select(key, "value")


def redact(constraints: Column, hidden: Column) -> Column:
    """An array of constraint structs without values and messages where the field is hidden."""
    clean = F.transform(
        constraints, lambda c: c.withField("num_value", F.lit(None).cast("double")).withField("str_value", F.lit(None).cast("string")).withField("message", F.lit(None).cast("string"))
    )
    return F.when(hidden, clean).otherwise(constraints)
