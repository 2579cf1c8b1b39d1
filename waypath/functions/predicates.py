"""Predicates: a small expression grammar, bounded disjunctive normal form, and two solvers.

Grammar, loosest first: || , && , ! , comparison with a literal, a bare path (is true); brackets group. A blank
expression is true. Anything else is opaque. Results are satisfiable, unsatisfiable or conditional: an opaque or
unsupported literal makes a branch conditional, a contradiction makes it unsatisfiable, and a predicate takes the best
of its branches (satisfiable first).

`path != true` stands for `path = false` and the other way round, in any order of the terms; so a path compared
unequal to a boolean is a boolean path.

`solve` works on a table of literals, a row each; `models` on one expression in Python, for callers that hold a few
guards a row (path search). A test holds them against one another.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_BRANCHES = 32
TRUE = {"kind": "true"}
FALSE = {"kind": "not", "item": TRUE}
STATUSES = ("satisfiable", "conditional", "unsatisfiable")
_TOKEN = re.compile(r"""(?P<text>'(?:\\.|[^'\\])*'|"(?:\\.|[^"\\])*"|`(?:\\.|[^`\\])*`)|(?P<open>[(\[{])|(?P<close>[)\]}])|(?P<sign>\|\||&&|===|!==|==|!=|>=|<=|=>|[!<>])|(?P<other>[^'"`()\[\]{}|&!<>=\s]+|\s+|.)""", re.S)
_COMPARE = {"===": "=", "==": "=", "!==": "!=", "!=": "!=", ">": ">", ">=": ">=", "<": "<", "<=": "<="}
_PATH = re.compile(r"[A-Za-z_$][\w$]*(?:\??\.[A-Za-z_$][\w$]*)*")
_NUMBER = re.compile(r"-?\d+(?:\.\d+)?")
_NEGATED = {"=": "!=", "!=": "=", ">": "<=", "<=": ">", "<": ">=", ">=": "<"}
LITERALS = "pred_id string, branch int, path string, op string, vtype string, vnum double, vstr string"


# --- grammar --------------------------------------------------------------------------------------------------------


@dataclass
class Part:
    """A token, or a bracketed group with its parts; from `start` to `end` in the source."""

    sign: str
    start: int
    end: int
    inner: list[Part] = field(default_factory=list)


class Unbalanced(ValueError):
    pass


def parts_of(text: str) -> list[Part]:
    """Tokens without white space, groups nested."""
    levels: list[tuple[list[Part], int]] = [([], 0)]
    for m in _TOKEN.finditer(text):
        kind = m.lastgroup
        if kind == "open":
            levels.append(([], m.start()))
        elif kind == "close":
            if len(levels) == 1 or text[levels[-1][1]] + m[0] not in ("()", "[]", "{}"):
                raise Unbalanced(text)
            inner, start = levels.pop()
            levels[-1][0].append(Part(text[start] + m[0], start, m.end(), inner))
        elif kind == "sign":
            levels[-1][0].append(Part(m[0], m.start(), m.end()))
        elif not m[0].isspace():
            levels[-1][0].append(Part("", m.start(), m.end()))
    if len(levels) > 1:
        raise Unbalanced(text)
    return levels[0][0]


def _split(parts: list[Part], sign: str) -> list[list[Part]]:
    at = [i for i, p in enumerate(parts) if p.sign == sign]
    return [parts[a:b] for a, b in zip([0, *(i + 1 for i in at)], [*at, len(parts)])]


class _Reader:
    def __init__(self, text: str):
        self.text = text

    def source(self, parts: list[Part]) -> str:
        return self.text[parts[0].start : parts[-1].end] if parts else ""

    def read(self, parts: list[Part]) -> dict:
        for sign, join in (("||", any_of), ("&&", all_of)):
            if len(terms := _split(parts, sign)) > 1:
                return join(map(self.read, terms))
        if not parts:
            return TRUE
        if parts[0].sign == "!":
            return {"kind": "not", "item": self.read(parts[1:])}
        if len(parts) == 1 and parts[0].sign == "()":
            return self.read(parts[0].inner)
        return self.term(parts)

    def term(self, parts: list[Part]) -> dict:
        source = self.source(parts)
        at = next((i for i, p in enumerate(parts) if p.sign in _COMPARE), None)
        if at is not None:
            path, op, value = self.source(parts[:at]), _COMPARE[parts[at].sign], literal(self.source(parts[at + 1 :]))
            if _PATH.fullmatch(path) and value is not None and (op in ("=", "!=") or value[0] == "number"):
                return {"kind": "compare", "path": path.replace("?.", "."), "op": op, "type": value[0], "value": value[1]}
        elif source in ("true", "false"):
            return TRUE if source == "true" else FALSE
        elif _PATH.fullmatch(source):
            return {"kind": "compare", "path": source.replace("?.", "."), "op": "=", "type": "boolean", "value": True}
        return {"kind": "opaque", "text": source}


def parse(text: str | None) -> dict:
    text = (text or "").strip()
    try:
        return _Reader(text).read(parts_of(text))
    except Unbalanced:
        return {"kind": "opaque", "text": text}


def literal(text: str) -> tuple[str, object] | None:
    text = text.strip()
    if text in ("true", "false"):
        return "boolean", text == "true"
    if text in ("null", "undefined"):
        return "null", None
    if _NUMBER.fullmatch(text):
        return "number", float(text)
    if len(text) >= 2 and text[0] == text[-1] and text[0] in "'\"" and (m := _TOKEN.fullmatch(text)) and m.lastgroup == "text":
        return "string", re.sub(r"\\(.)", r"\1", text[1:-1])
    return None


def all_of(items: Iterable[dict]) -> dict:
    flat = [y for x in items for y in (x["items"] if x["kind"] == "all" else [x]) if y != TRUE]
    return TRUE if not flat else flat[0] if len(flat) == 1 else {"kind": "all", "items": flat}


def any_of(items: Iterable[dict]) -> dict:
    flat = [y for x in items for y in (x["items"] if x["kind"] == "any" else [x]) if y != FALSE]
    return TRUE if TRUE in flat else FALSE if not flat else flat[0] if len(flat) == 1 else {"kind": "any", "items": flat}


def canonical(ast: dict) -> str:
    return json.dumps(ast, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def branches(ast: dict, negate: bool = False, limit: int = MAX_BRANCHES) -> list[list[dict]]:
    """Conjunctions of comparisons and opaque terms; one opaque conjunction where there are more than `limit`."""
    kind = ast["kind"]
    if kind == "not":
        return branches(ast["item"], not negate, limit)
    if kind == "true":
        return [] if negate else [[]]
    if kind == "compare":
        op = _NEGATED[ast["op"]] if negate else ast["op"]
        if op == "!=" and ast["type"] == "boolean":
            return [[ast | {"op": "=", "value": not ast["value"]}]]
        return [[ast | {"op": op}]]
    if kind == "opaque":
        return [[ast]]
    parts = [branches(x, negate, limit) for x in ast["items"]]
    if (kind == "any") != negate:
        out = [b for p in parts for b in p]
    else:
        out = [[]]
        for p in parts:
            out = [a + b for a in out for b in p]
            if len(out) > limit:
                break
    return out if len(out) <= limit else [[{"kind": "opaque", "text": "more alternatives than the limit"}]]


def label(ast: dict) -> str:
    kind = ast["kind"]
    if kind in ("all", "any"):
        return (" and " if kind == "all" else " or ").join(map(label, ast["items"]))
    if kind == "not":
        return f"not ({label(ast['item'])})"
    if kind == "compare":
        v = ast["value"]
        value = "null" if v is None else str(v).lower() if isinstance(v, bool) else f"{v:g}" if isinstance(v, float) else f"{v}"
        return f"{ast['path']} {ast['op']} {value}"
    return "always" if kind == "true" else ast["text"]


# --- one expression at a time ---------------------------------------------------------------------------------------


@dataclass
class _Range:
    equal: set = field(default_factory=set)
    unequal: set = field(default_factory=set)
    low: tuple[float, int] = (float("-inf"), 0)  # bound, 1 if it is not in the range
    high: tuple[float, int] = (float("inf"), 0)  # bound, -1 if it is not in the range

    def holds(self, x: float) -> bool:
        above = x > self.low[0] or x == self.low[0] and not self.low[1]
        below = x < self.high[0] or x == self.high[0] and not self.high[1]
        return above and below and ("number", x) not in self.unequal

    @property
    def bounded(self) -> bool:
        return self.low[0] > float("-inf") or self.high[0] < float("inf")

    def contradicts(self) -> bool:
        if len(self.equal) > 1 or self.equal & self.unequal or self.low[0] > self.high[0]:
            return True
        if self.low[0] == self.high[0] and not self.holds(self.low[0]):
            return True
        return self.bounded and any(t != "number" or not self.holds(v) for t, v in self.equal)

    def value(self) -> tuple[str, object] | None:
        """What stands for the path, if anything does."""
        if self.equal:
            return next(iter(self.equal))
        (a, a_open), (b, b_open) = self.low, self.high
        tries = [a + 1 if a_open else a, b - 1 if b_open else b, (a + b) / 2]
        found = [x for x in tries if abs(x) < float("inf") and self.holds(x)]
        return ("number", found[0]) if self.bounded and found else None


def settle(branch: Iterable[dict]) -> tuple[str, dict[str, object]]:
    """Status and assignments of a conjunction."""
    ranges: dict[str, _Range] = {}
    status = STATUSES[0]
    for x in branch:
        if x["kind"] != "compare":
            status = STATUSES[1]
            continue
        r, op, v = ranges.setdefault(x["path"], _Range()), x["op"], x["value"]
        if op in ("=", "!="):
            (r.equal if op == "=" else r.unequal).add((x["type"], v))
        elif op[0] == ">":
            r.low = max(r.low, (v, int(op == ">")))
        else:
            r.high = min(r.high, (v, -int(op == "<")))
    if any(r.contradicts() for r in ranges.values()):
        return STATUSES[2], {}
    return status, {p: v[1] for p, r in sorted(ranges.items()) if (v := r.value()) is not None}


def models(ast: dict, limit: int = MAX_BRANCHES) -> list[tuple[str, str, dict[str, object]]]:
    """(label, status, assignments) of every alternative that can hold, in order, each once."""
    out: dict[tuple, tuple] = {}
    for b in branches(ast, limit=limit):
        status, values = settle(b)
        if status != STATUSES[2]:
            found = (label(all_of(b)), status, values)
            out.setdefault((found[0], canonical({"kind": "v", "v": values})), found)
    return list(out.values())


def status_of(ast: dict) -> str:
    return min((s for _, s, _ in models(ast)), key=STATUSES.index, default=STATUSES[2])


def conjunction(texts: Iterable[str | None]) -> dict:
    return all_of(map(parse, texts))


def value_text(v: object) -> str:
    return "null" if v is None else str(v).lower() if isinstance(v, bool) else f"{v:g}" if isinstance(v, float) else str(v)


def per_row(df: DataFrame, columns: list[str], result: str, f: Callable[..., list[tuple]]) -> DataFrame:
    """df with the rows that f gives for each of its rows, from the values of `columns`; result: their columns as DDL.

    In Arrow batches, without a shuffle; a row for which f gives none goes.
    """
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_schema

    added = T.StructType.fromDDL(result)
    schema = T.StructType([*df.schema.fields, *added.fields])
    arrow, at, names = to_arrow_schema(schema), [df.columns.index(c) for c in columns], list(df.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            given = [b.column(i).to_pylist() for i in at]
            keep, rows = [], []
            for i, x in enumerate(zip(*given)):
                for r in f(*x):
                    keep.append(i)
                    rows.append(r)
            held = [b.column(i).take(pa.array(keep, pa.int64())).cast(arrow.field(i).type) for i in range(len(names))]
            made = [pa.array([r[k] for r in rows], type=arrow.field(len(names) + k).type) for k in range(len(added))]
            yield pa.RecordBatch.from_arrays(held + made, schema=arrow)

    return df.mapInArrow(run, schema)


# --- many at once ---------------------------------------------------------------------------------------------------


def literals(df: DataFrame, id_col: str, expr_col: str) -> DataFrame:
    """One row a literal of each branch: LITERALS; op 'true' for an empty branch, 'false' without branches, 'opaque'."""

    def rows(pred: str, text: str | None) -> Iterator[tuple]:
        found = branches(parse(text))
        if not found:
            yield pred, 0, None, "false", None, None, None
        for k, b in enumerate(found):
            if not b:
                yield pred, k, None, "true", None, None, None
            for x in b:
                if x["kind"] == "opaque":
                    yield pred, k, None, "opaque", None, None, x["text"]
                else:
                    v, t = x["value"], x["type"]
                    yield pred, k, x["path"], x["op"], t, v if t == "number" else None, None if t == "number" else "null" if v is None else str(v).lower() if t == "boolean" else v

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["pred_id", "branch", "path", "op", "vtype", "vnum", "vstr"]
        kinds = [pa.string(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.string()]
        for b in batches:
            out = [r for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for r in rows(i, t)]
            cols = zip(*out) if out else [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)

    return df.select(F.col(id_col).cast("string"), F.col(expr_col).cast("string")).mapInArrow(run, LITERALS)


def _value(vtype: Column, vnum: Column, vstr: Column) -> Column:
    return F.concat_ws(":", vtype, F.coalesce(vnum.cast("string"), vstr))


def solve_paths(lits: DataFrame) -> DataFrame:
    """Per (pred_id, branch, path): unsat, and the value that stands for the path."""
    # null-safe aggregates: each takes only the literals of its operators
    of = lambda cond, x: F.when(cond, x)
    op = F.col("op")
    value = _value(F.col("vtype"), F.col("vnum"), F.col("vstr"))
    low, high = op.isin(">", ">="), op.isin("<", "<=")
    g = lits.where(F.col("path").isNotNull()).groupBy("pred_id", "branch", "path").agg(
        F.collect_set(of(op == "=", value)).alias("eq"),
        F.collect_set(of(op == "!=", value)).alias("neq"),
        F.max(of(op == "=", F.col("vnum"))).alias("eq_num"),
        F.max(of(low, F.struct(F.col("vnum").alias("n"), (op == ">").cast("int").alias("open")))).alias("low"),
        F.min(of(high, F.struct(F.col("vnum").alias("n"), (op == "<=").cast("int").alias("closed")))).alias("high"),
    )
    lo, hi = F.col("low.n"), F.col("high.n")
    lo_open, hi_open = F.coalesce(F.col("low.open") == 1, F.lit(False)), F.coalesce(F.col("high.closed") == 0, F.lit(False))
    bounded = lo.isNotNull() | hi.isNotNull()

    def fits(x: Column) -> Column:
        above = lo.isNull() | (x > lo) | ((x == lo) & ~lo_open)
        below = hi.isNull() | (x < hi) | ((x == hi) & ~hi_open)
        return above & below & ~F.array_contains("neq", F.concat(F.lit("number:"), x.cast("string")))

    empty = lo.isNotNull() & hi.isNotNull() & ((lo > hi) | ((lo == hi) & (lo_open | hi_open | ~fits(lo))))
    eq_off = (F.size("eq") > 0) & bounded & (F.col("eq_num").isNull() | ~fits(F.col("eq_num")))
    unsat = (F.size("eq") > 1) | (F.size(F.array_intersect("eq", "neq")) > 0) | F.coalesce(eq_off, F.lit(False)) | F.coalesce(empty, F.lit(False))
    candidates = F.array(F.when(lo_open, lo + 1).otherwise(lo), F.when(hi_open, hi - 1).otherwise(hi), (lo + hi) / 2)
    number = F.get(F.filter(candidates, lambda x: x.isNotNull() & fits(x)), F.lit(0))
    chosen = F.when(F.size("eq") == 1, F.get(F.col("eq"), F.lit(0))).when(bounded, F.concat(F.lit("number:"), number.cast("string")))
    return g.select("pred_id", "branch", "path", unsat.alias("unsat"), chosen.alias("value"))


def solve(lits: DataFrame) -> DataFrame:
    """Per pred_id: status, and the assignments of its best branch as sorted 'path=type:value' joined by '; '."""
    paths = solve_paths(lits).groupBy("pred_id", "branch").agg(
        F.max("unsat").alias("unsat"), F.array_join(F.sort_array(F.collect_list(F.concat_ws("=", "path", F.col("value")))), "; ").alias("assignments")
    )
    kinds = lits.groupBy("pred_id", "branch").agg(F.max(F.col("op") == "opaque").alias("opaque"), F.max(F.col("op") == "false").alias("never"))
    both = kinds.join(paths, ["pred_id", "branch"], "left")
    rank = F.when(F.col("never") | F.coalesce("unsat", F.lit(False)), 2).when(F.col("opaque"), 1).otherwise(0)
    best = both.select("pred_id", F.struct(rank.alias("rank"), "branch", F.coalesce("assignments", F.lit("")).alias("assignments")).alias("b")).groupBy("pred_id").agg(F.min("b").alias("b"))
    status = F.element_at(F.array(*map(F.lit, STATUSES)), F.col("b.rank") + 1)
    return best.select("pred_id", status.alias("status"), F.when(F.col("b.rank") < 2, F.col("b.assignments")).otherwise("").alias("assignments"))
