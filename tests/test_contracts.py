"""Small cases of the contract operators: nulls, ties, repeated and missing rows."""

from waypath.operators import contracts, coverage


def test_prefix_rules(spark):
    paths = spark.createDataFrame([(1, "/a/b"), (2, "/a"), (3, "/ab"), (4, None), (5, "/a/b")], "id int, path string")
    rules = spark.createDataFrame([(2, "/a/**", "in"), (1, "/a/b", "first"), (3, "/a/**", "late")], "ordinal int, pattern string, access string")
    got = {r.id: r.access for r in contracts.prefix_rules(paths, rules, "path", "pattern", "ordinal", ["access"]).collect()}
    assert got == {1: "first", 2: "in", 3: None, 4: None, 5: "first"}


def test_scope_or_refs_gives_each_pair_once(spark):
    gaps = spark.createDataFrame([("g", "s", ["x", "y"]), ("h", None, [])], "gap string, scope string, refs array<string>")
    found = spark.createDataFrame([("d", "s", ["x", "y"]), ("e", "t", ["y"]), ("f", None, None)], "diagnostic string, scope string, refs array<string>")
    assert sorted(map(tuple, contracts.scope_or_refs(gaps, found).collect())) == [("g", "d"), ("g", "e")]


def test_runtime_bindings_take_nulls_as_equal_and_the_newest(spark):
    steps = spark.createDataFrame([(1, "a"), (1, None), (2, None)], "k int, c string")
    bound = spark.createDataFrame([(1, None, 1, "old"), (1, None, 2, "new"), (1, "b", 3, "other")], "k int, c string, at int, value string")
    got = {(r.k, r.c): (r.value, r.bound) for r in contracts.runtime_bindings(steps, bound, ["k", "c"], "at", "value").collect()}
    assert got == {(1, "a"): (None, False), (1, None): ("new", True), (2, None): (None, False)}


def test_choices_and_actors(spark):
    m = spark.createDataFrame([("f", "b", "active", False), ("f", "a", "opaque", True), ("f", "a", "active", None), ("g", None, "active", False)], "field string, option string, status string, visible boolean")
    got = {r.field: (r.options, r.members, r.status, r.visible) for r in contracts.merge_choices(m, ["field"]).collect()}
    assert got == {"f": (["a", "b"], 3, "conditional", True), "g": ([], 1, "active", False)}
    ops = spark.createDataFrame([("p", True, "included"), ("q", False, "included"), ("r", False, "excluded")], "operation string, conditional boolean, inclusion string")
    none = spark.createDataFrame([], "operation string, authority string")
    assert sorted(map(tuple, contracts.actor_requirements(ops, none).collect())) == [("p", "opaque", None, "review-required"), ("q", "anonymous", None, "included")]


def test_digest_tree_tells_order_and_content(spark):
    def digest(rows):
        return coverage.digest_tree(spark.createDataFrame(rows, "k string, pos long, h string"), ["k"]).select("digest", "n").first()

    a = digest([("k", 1, "x"), ("k", 300, "y")])
    assert a == digest([("k", 300, "y"), ("k", 1, "x")]) and a.n == 2
    assert a.digest != digest([("k", 1, "y"), ("k", 300, "x")]).digest
    assert coverage.digest_tree(spark.createDataFrame([], "k string, pos long, h string"), ["k"]).count() == 0


def test_leaf_matches(spark):
    paths = spark.createDataFrame([(1, "a.x"), (2, "b.X"), (3, "b.y"), (4, "b.z")], "id int, path string")
    fields = spark.createDataFrame([("f", "a.x"), ("g", "c.y"), ("h", "d.y")], "field string, fp string")
    got = {r.id: (r.field, r.match) for r in contracts.leaf_matches(paths, fields, "id", "path", "field", "fp").collect()}
    assert got == {1: ("f", "exact"), 2: ("f", "leaf"), 3: (None, "ambiguous"), 4: (None, "missing")}
