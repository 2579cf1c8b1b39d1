"""Secret scans with built-in functions only: base patterns, then sliding-window Shannon entropy over candidates.

Base kinds are leftmost non-overlapping matches (a failing match is consumed and dropped):
  assign  keyword, optional quote, colon or equals sign, value of 8 or more characters (keywords in either ASCII case)
  access  AKIA and capitals or digits, 16 or more characters
  hex     32 or more lower-case hexadecimal digits
Beyond them, `entropy`: runs of 20 or more token characters that hold a letter and a digit, whose best window of 20
characters has a Shannon entropy of the threshold of its character class or more. The window slides over the run;
the sum of c*log2(c) over its counts is updated by the character that enters and the one that leaves. Runs without a
digit are no candidates (about 3 in 100 random base64 tokens of 20 characters have none).
An allow-list drops UUIDs, dates with words, versions and e-mail or host names; a candidate that overlaps a base span
is not reported again.

Positions of matches come from the lengths of the pieces between them: split() and regexp_extract_all() see the same
matches. Offsets count code points, end exclusive.

Defined cases: a null text counts as empty and has no spans; rows are independent, so ties and repeated rows stay as
they are; an empty table gives no rows; other columns stay, whatever their names, but for `secrets`, which is replaced.
Very long texts, runs and lists of matches take time in proportion to their length (each candidate found is held
against the text's base spans).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from waypath.llm.common import documents, kept_columns

ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
#: A run of token characters with a digit in its first part: cheap test whether a text has candidates at all.
HAS_CANDIDATE = r"(?=[A-Za-z0-9+/_=-]{20})[A-Za-z+/_=-]*+[0-9]"
ALLOWED = r"^(?:[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}|[0-9/_=+-]+|[0-9]{4}-[0-9]{2}-[0-9]{2}[A-Za-z0-9_-]*|v?[0-9]+(?:[_-][A-Za-z0-9]{1,8})+)$"
WINDOW = 20
#: Bits a character: of hexadecimal runs, of letters and digits, of runs with + / _ = -.
THRESHOLDS = {"hex": 2.9, "alnum": 3.6, "base64": 3.7}
#: Matches whose places are summed up in one list.
BLOCK = 256
KINDS = ("assign", "access", "hex", "entropy")
_SPAN = "array<struct<start:int,ord:int,end:int>>"


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def match_spans(text: Column, pattern: str, order: int, passes=None) -> Column:
    """All matches of pattern as structs (start, ord, end); passes: test of the matched string.

    Positions are running sums of lengths: of blocks of matches first, then inside each block, so that lists stay short
    while they grow.
    """
    pieces, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    steps = F.zip_with(F.slice(pieces, 1, F.size(found)), found, lambda p, m: F.struct(F.char_length(p).alias("gap"), m.alias("m")))
    ends = lambda a, x: a + x["gap"] + F.char_length(x["m"])

    def block_starts(blocks: Column) -> Column:
        start = F.array(F.lit(0))
        return F.aggregate(blocks, start, lambda acc, b: F.concat(acc, F.array(F.aggregate(b, F.element_at(acc, -1), ends))))

    def add(acc: Column, x: Column) -> Column:
        a = acc["at"] + x["gap"]
        one = F.array(F.struct(a.alias("start"), F.lit(order).alias("ord"), (a + F.char_length(x["m"])).alias("end")))
        more = F.concat(acc["out"], one) if passes is None else F.when(passes(x["m"]), F.concat(acc["out"], one)).otherwise(acc["out"])
        return F.struct(ends(acc["at"], x).alias("at"), more.alias("out"))

    def in_block(block: Column, at: Column) -> Column:
        return F.aggregate(block, F.struct(at.alias("at"), F.array().cast(_SPAN).alias("out")), add, lambda acc: acc["out"])

    def spans(steps: Column) -> Column:
        cut = F.transform(F.sequence(F.lit(0), F.greatest(F.size(steps) - 1, F.lit(0)), F.lit(BLOCK)), lambda k: F.slice(steps, k + 1, F.lit(BLOCK)))
        return bound(cut, lambda blocks: F.flatten(F.zip_with(blocks, F.slice(block_starts(blocks), F.lit(1), F.size(blocks)), in_block)))

    return F.when(F.rlike(text, F.lit(pattern)), bound(steps, spans)).otherwise(F.array().cast(_SPAN))


def best_entropy(run: Column, window: int = WINDOW) -> Column:
    """Largest entropy, in bits a character, of the run's windows, in time linear in the run.

    One step a character: the one that leaves and the one that enters change the sum of c*log2(c) by what their counts in
    the window were and become; a count looks at the window only.
    """
    weight = lambda c: c * F.log2(F.greatest(c, F.lit(1)))
    entropy = lambda s: F.log2(F.lit(float(window))) - s / window

    def slide(codes: Column) -> Column:
        def count(code: Column, first: Column, n: Column) -> Column:
            return F.size(F.filter(F.slice(codes, first, n), lambda c: c == code))

        def step(acc: Column, i: Column) -> Column:
            left = F.greatest(i - window, F.lit(0))  # characters before the window that ends before place i
            went = F.when(i > window, bound(count(F.get(codes, i - window - 1), i - window, F.lit(window)), lambda n: weight(n) - weight(n - 1))).otherwise(F.lit(0.0))
            first = F.when(i > window, left + 1).otherwise(F.lit(1))
            came = bound(count(F.get(codes, i - 1), first, i - first), lambda n: weight(n + 1) - weight(n))
            so_far = F.when(i > window, F.greatest(acc["best"], entropy(acc["s"]))).otherwise(acc["best"])
            return F.struct((acc["s"] - went + came).alias("s"), so_far.alias("best"))

        start = F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("best"))
        n = F.size(codes)
        last = F.aggregate(F.sequence(F.lit(1), n), start, step, lambda acc: F.greatest(acc["best"], entropy(acc["s"])))
        return F.when(n >= window, last).otherwise(F.lit(0.0))

    return bound(F.transform(F.split(run, ""), F.ascii), slide)


def looks_random(run: Column) -> Column:
    threshold = (
        F.when(F.rlike(run, F.lit("^[0-9a-fA-F]+$")), THRESHOLDS["hex"])
        .when(F.rlike(run, F.lit("^[A-Za-z0-9]+$")), THRESHOLDS["alnum"])
        .otherwise(THRESHOLDS["base64"])
    )
    mixed = F.rlike(run, F.lit("[0-9]")) & F.rlike(run, F.lit("[A-Za-z]")) & ~F.rlike(run, F.lit(ALLOWED))
    return F.when(mixed, best_entropy(run) >= threshold).otherwise(F.lit(False))


def find_secrets(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Adds secrets: array of (kind, start, end) by start, then kind in the order of KINDS. No shuffle, no Python."""
    names = [c for c in kept_columns(docs, keep, []) if c.lower() != "secrets"]
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    long_value = lambda m: F.char_length(F.regexp_extract(m, ASSIGN, 1)) >= 8
    d = docs.select(*[F.col(f"`{c}`") for c in names], text).toDF(*[f"c{i}" for i in range(len(names))], "t")
    t = F.col("t")
    d = d.withColumn("base", F.concat(match_spans(t, ASSIGN, 0, long_value), match_spans(t, ACCESS, 1), match_spans(t, HEX, 2)))
    more = F.when(F.rlike(t, F.lit(HAS_CANDIDATE)), match_spans(t, CANDIDATE, 3, looks_random)).otherwise(F.array().cast(_SPAN))
    d = d.withColumn("more", more)
    apart = F.filter("more", lambda c: ~F.exists("base", lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"])))
    spans = F.array_sort(F.concat("base", apart))
    kind = lambda s: F.element_at(F.array(*map(F.lit, KINDS)), s["ord"] + 1)
    named = F.transform(spans, lambda s: F.struct(kind(s).alias("kind"), s["start"].cast("long").alias("start"), s["end"].cast("long").alias("end")))
    return d.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)], named.alias("secrets"))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(documents(spark, sf_dir), keep=["doc_id"])
    line = lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))
    count = lambda kind: F.size(F.filter("secrets", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("secrets", lambda x: x["kind"] != "entropy")
    return found.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        count("assign"),
        count("access"),
        count("hex"),
        F.sha2(F.array_join(F.transform(base, line), ","), 256).alias("base_sha256"),
        F.array_join(F.transform("secrets", line), ",").alias("spans"),
    )


#: Places of matches by running sums of the lengths between and of them; windows of candidates one by one, in DuckDB.
ORACLE = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
k(ord, kind, pat) AS (VALUES (0, 'assign', '(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)'),
  (1, 'access', 'AKIA[A-Z0-9]{{12,}}'), (2, 'hex', '[0-9a-f]{{32,}}'), (3, 'entropy', '[A-Za-z0-9+/_=-]{{20,}}')),
x AS (SELECT r, ord, kind, pat, unnest(m) AS m, unnest(g[1 : len(m)]) AS g, unnest(range(len(m))) AS j FROM (SELECT r, ord, kind, pat, regexp_extract_all(t, pat) AS m, string_split_regex(t, pat) AS g FROM d, k)),
s AS (SELECT r, ord, kind, pat, m, sum(length(g) + length(m)) OVER (PARTITION BY r, ord ORDER BY j) AS e FROM x),
base AS (SELECT r, ord, kind, e - length(m) AS a, e FROM s WHERE ord IN (1, 2) OR ord = 0 AND length(regexp_extract(m, pat, 1)) >= 8),
cand AS (SELECT r, ord, kind, e - length(m) AS a, e, m, CASE WHEN regexp_full_match(m, '[0-9a-fA-F]+') THEN {THRESHOLDS["hex"]} WHEN regexp_full_match(m, '[A-Za-z0-9]+') THEN {THRESHOLDS["alnum"]} ELSE {THRESHOLDS["base64"]} END AS least
  FROM s WHERE ord = 3 AND regexp_matches(m, '[0-9]') AND regexp_matches(m, '[A-Za-z]') AND NOT regexp_matches(m, '{ALLOWED}')),
more AS (SELECT r, ord, kind, a, e FROM (SELECT *, unnest(range(1, length(m) - 18)) AS i FROM cand) GROUP BY ALL HAVING max(list_aggregate(string_split(substr(m, i, 20), ''), 'entropy')) >= any_value(least)),
every AS (SELECT * FROM base UNION ALL SELECT * FROM more WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.r = more.r AND b.a < more.e AND more.a < b.e)),
g AS (SELECT r, count(*) FILTER (ord = 0) AS n_assign, count(*) FILTER (ord = 1) AS n_access, count(*) FILTER (ord = 2) AS n_hex,
  string_agg(kind || ':' || a || ':' || e, ',' ORDER BY a, ord) FILTER (ord < 3) AS b, string_agg(kind || ':' || a || ':' || e, ',' ORDER BY a, ord) AS spans FROM every GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(b, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g USING (r)
"""
