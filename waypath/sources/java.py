"""Lexical facts of Java sources that need no types of other files: methods, request binding, guards, effects, calls.

A file is masked once (comments, and literals where they must not be read as code, become blanks of equal length), its
brackets are paired once, and everything else are patterns on the masked text; so a place in any of them is a place in
the source. The wrappers at the end map files in Arrow batches.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waypath.functions import predicates as P
from waypath.operators.graph import _settled
from waypath.operators.joins import top_of_each, unique_join

_LEXEME = re.compile(r"""(?P<comment>//[^\n]*|/\*.*?(?:\*/|\Z))|(?P<text>\"""(?:\\.|.)*?(?:\"""|\Z)|"(?:\\.|[^"\\\n])*"?|'(?:\\.|[^'\\\n])*'?)""", re.S)
_ESCAPES = {"b": "\b", "f": "\f", "n": "\n", "r": "\r", "t": "\t", "s": " ", "0": "\0"}
_OPEN = {"(": ")", "[": "]", "{": "}"}
_NAME = r"[A-Za-z_$][\w$]*"
_METHOD = re.compile(rf"\b(?:public|protected|private)\s+(?:(?:static|final|synchronized|native|strictfp|default)\s+)*(?:<[^<>(){{}};]*>\s+)?(?P<type>[\w$.]+(?:\s*<[^(){{}};=]*>)?(?:\s*\[\s*\])*)\s+(?P<name>{_NAME})\s*\(")
_ANNOTATION = re.compile(rf"@(?!interface\b)(?:{_NAME}\.)*({_NAME})")
_THROWS = re.compile(r"\s*(?:throws\s+[\w$.,\s@]+)?\{")
_CALL = re.compile(rf"\b({_NAME})\.({_NAME})\s*\(")


def decode(text: str) -> str:
    """The characters that the inside of a string literal stands for."""
    return re.sub(r"\\(u+([0-9a-fA-F]{4})|.)", lambda m: chr(int(m[2], 16)) if m[2] else _ESCAPES.get(m[1], m[1]), text, flags=re.S)


def _blank(text: str) -> str:
    return re.sub(r"[^\n]", " ", text)


def without_comments(source: str) -> str:
    return _LEXEME.sub(lambda m: _blank(m[0]) if m["comment"] is not None else m[0], source)


def code_only(source: str) -> str:
    """Without comments and literals."""
    return _LEXEME.sub(lambda m: _blank(m[0]), source)


def pairs_of(code: str) -> tuple[dict[int, int], list[int]]:
    """Where each bracket closes, and the depth of braces before each place."""
    ends, held, depth, depths = {}, [], 0, []
    for i, c in enumerate(code):
        depths.append(depth)
        if c in _OPEN:
            held.append(i)
            depth += c == "{"
        elif c in ")]}":
            depth -= c == "}"
            if held and _OPEN[code[held[-1]]] == c:
                ends[held.pop()] = i
    return ends, depths


def arguments(text: str) -> list[str]:
    """Parts between commas outside of brackets, angles and literals, trimmed; empty ones are left out."""
    code, cuts, depth = code_only(text), [-1], 0
    for i, c in enumerate(code):
        depth = max(0, depth + (c in "([{<") - (c in ")]}>"))
        if c == "," and not depth:
            cuts.append(i)
    return [part for a, b in zip(cuts, [*cuts[1:], len(text)]) if (part := text[a + 1 : b].strip())]


def annotations(text: str) -> list[tuple[str, str | None, str]]:
    """(name, arguments or None, text) of the annotations in text, in order."""
    code = code_only(text)
    ends, _ = pairs_of(code)
    out, at = [], 0
    while m := _ANNOTATION.search(code, at):
        at = m.end()
        gap = re.compile(r"\s*\(").match(code, at)
        inner = None
        if gap:
            close = ends.get(gap.end() - 1, len(text) - 1)
            inner, at = text[gap.end() : close], close + 1
        out.append((m[1], inner, text[m.start() : at]))
    return out


def simple_type(text: str) -> str:
    return re.sub(r"<.*", "", text, flags=re.S).strip().removesuffix("...").split("[")[0].split(".")[-1].strip()


@dataclass
class Method:
    name: str
    returns: str
    line: int
    parameters: list[str]
    marks: list[tuple[str, str | None, str]]
    body: str  # with its braces
    code: str  # the body without comments and literals
    binding: tuple[str | None, str, str] = field(init=False)

    def __post_init__(self):
        self.binding = request_binding(self.parameters, self.marks)

    @cached_property
    def pairs(self) -> tuple[dict[int, int], list[int]]:
        return pairs_of(self.code)

    def top(self, pattern: str) -> re.Match | None:
        """The first match in the body's code, if it stands in the outermost block."""
        m = re.search(pattern, self.code)
        return m if m and self.pairs[1][m.start()] == 1 else None


def methods(source: str) -> list[Method]:
    """Methods with a body, with the annotations that stand right before them, over any number of lines."""
    code, plain = code_only(source), without_comments(source)
    ends, _ = pairs_of(code)
    out, at = [], 0
    while m := _METHOD.search(code, at):
        at = m.end()
        close = ends.get(m.end() - 1)
        body = _THROWS.match(code, close + 1) if close is not None else None
        if not body or (end := ends.get(body.end() - 1)) is None:
            continue
        before = code[: m.start()]
        head = max(before.rfind(c) for c in ";{}")
        # an annotation's braces do not end the head: go back over them
        while head >= 0 and code[head] == "}" and (opened := next((a for a, b in ends.items() if b == head), None)) is not None and _inside_marks(code, ends, opened):
            head = max(before[:opened].rfind(c) for c in ";{}")
        out.append(Method(m["name"], " ".join(m["type"].split()), source.count("\n", 0, m.start()) + 1, arguments(plain[m.end() : close]), annotations(plain[head + 1 : m.start()]), plain[body.end() - 1 : end + 1], code[body.end() - 1 : end + 1]))
        at = end + 1
    return out


def _inside_marks(code: str, ends: dict[int, int], at: int) -> bool:
    return any(code[a] == "(" and a < at < b and re.search(r"@[\w$.]+\s*$", code[:a]) for a, b in ends.items())


def request_binding(parameters: list[str], marks: list[tuple[str, str | None, str]]) -> tuple[str | None, str, str]:
    """(request type, active, inactive or conditional, why): what is validated of the parameter that takes the body.

    Conditional: several bodies, validation with arguments, a parameter after it that takes the errors, or only a mark on
    the method.
    """
    parsed = []
    for p in parameters:
        own, rest = annotations(p), p
        for _, _, text in own:
            rest = rest.replace(text, " ", 1)
        m = re.fullmatch(rf"(?s)(.*\S)\s+{_NAME}", re.sub(r"\bfinal\b", " ", rest).strip())
        parsed.append((simple_type(re.sub(r"\s+", "", m[1])) if m else None, own))
    bodies = [i for i, (_, own) in enumerate(parsed) if any(n == "RequestBody" for n, *_ in own)]
    if len(bodies) != 1:
        return (None, "conditional", "several-bodies") if bodies else (None, "inactive", "no-body")
    kind, own = parsed[bodies[0]]
    checks = [a for a in own if a[0] in ("Valid", "Validated")]
    if any((a[1] or "").strip() for a in checks):
        return kind, "conditional", "validation-groups"
    if checks:
        after = parsed[bodies[0] + 1][0] if bodies[0] + 1 < len(parsed) else None
        return (kind, "conditional", f"errors-taken-by-{after}") if after in ("BindingResult", "Errors") else (kind, "active", "validated")
    return (kind, "conditional", "method-level") if any(n in ("Valid", "Validated") for n, *_ in marks) else (kind, "inactive", "not-validated")


# What a guard's Java means in the predicate grammar, applied in this order.
GUARD_FORMS = (
    (r"\bObjects\.isNull\s*\(([^()]+)\)", r"(\1 === null)"),
    (r"\bObjects\.nonNull\s*\(([^()]+)\)", r"(\1 !== null)"),
    (r"""(['"][^'"]*['"])\.equals\s*\(([^()]+)\)""", r"(\2 === \1)"),
    (r"""([A-Za-z_$][\w$.]*)\.equals\s*\((['"][^'"]*['"]|[A-Z][\w$]*\.[A-Z][A-Z0-9_]*)\)""", r"(\1 === \2)"),
    (rf"\b({_NAME}(?:\.{_NAME})*)\.get([A-Z])([\w$]*)\s*\(\s*\)", lambda m: f"{m[1]}.{m[2].lower()}{m[3]}"),
    (r"\b(request|command|dto|input)\.([a-z][\w$]*)\s*\(\s*\)", r"\1.\2"),
    (r"([=!]==?|[<>]=?)\s*[A-Z][\w$]*\.([A-Z][A-Z0-9_]*)\b", r'\1 "\2"'),
    (r"\bthis\.", ""),
)
#: Names of the request; what follows them are its fields.
ROOTS = ("request", "dto", "command", "input")
# What is left of a body that keeps its success from being known: control flow, and calls that sound like rules.
_CONTROL = re.compile(r"\b(?:if|switch|try|catch|for|while|do|throw|assert)\b|\?|\.orElseThrow\s*\(")
_RULE = re.compile(r"\b(?:validate|verify|check|require|ensure|eligible|authorize|allowed|permitted|exists|ownership|relationship)[\w$]*\s*\(", re.I)


def guard_text(java: str) -> str:
    for pattern, to in GUARD_FORMS:
        java = re.sub(pattern, to, java)
    return java.strip()


def _of_request(ast: dict) -> dict:
    """Paths of the request without its name."""
    if ast["kind"] == "compare":
        root, _, rest = ast["path"].partition(".")
        return ast | {"path": rest} if root in ROOTS and rest else ast
    if ast["kind"] == "not":
        return ast | {"item": _of_request(ast["item"])}
    return ast | {"items": [*map(_of_request, ast["items"])]} if "items" in ast else ast


def domain_guard(m: Method) -> dict:
    """What must hold for a method to succeed: none of its outermost `if (..) throw` conditions. Opaque if a condition is,
    or if any other control flow, or a call that sounds like a rule, is left."""
    ends, depths = m.pairs
    rest, held = [*m.code], []
    for found in re.finditer(r"\bif\s*\(", m.code):
        if depths[found.start()] != 1 or (close := ends.get(found.end() - 1)) is None:
            continue
        then = re.compile(r"\s*").match(m.code, close + 1).end()
        block = m.code[then : then + 1] == "{"
        end = ends.get(then) if block else m.code.find(";", then)
        if end is None or end < 0:
            continue
        inner = m.code[then + 1 : end].strip() if block else m.code[then : end + 1].strip()
        if not re.fullmatch(r"(?s)throw\b[^;]*;\s*", inner):
            continue
        ast = _of_request(P.parse(guard_text(m.body[found.end() : close])))
        if ast["kind"] == "opaque":
            return {"kind": "opaque", "text": f"{m.name}:{m.line}:if ({ast['text']})"}
        held.append({"kind": "not", "item": ast})
        rest[found.start() : end + 1] = _blank("".join(rest[found.start() : end + 1]))
    left = "".join(rest)
    odd = _CONTROL.search(left) or _RULE.search(left)
    return {"kind": "opaque", "text": f"{m.name}:{m.line + left.count(chr(10), 0, odd.start())}:{odd[0].strip()}"} if odd else P.all_of(held)


def receiver_calls(m: Method) -> Iterator[tuple[str, str, int]]:
    """(receiver, method, number of arguments) of calls; those inside another call's arguments are not looked at."""
    ends, at = m.pairs[0], 0
    while found := _CALL.search(m.code, at):
        close = ends.get(found.end() - 1)
        at = found.end() if close is None else close + 1
        if close is not None:
            yield found[1], found[2], len(arguments(m.body[found.end() : close]))


def declared_type(code: str) -> tuple[str | None, bool, list[str]]:
    """(type, whether it is an interface, types it implements) of a file."""
    m = re.search(rf"\b(class|record|interface|enum)\s+({_NAME})", code)
    of = re.search(rf"\bclass\s+{_NAME}(?:\s*<[^{{]*?>)?(?:\s+extends\s+[^\s{{]+)?\s+implements\s+([^{{]+)", code)
    return (m[2] if m else None), bool(m and m[1] == "interface"), [simple_type(t) for t in arguments(of[1])] if of else []


def receiver_type(code: str, receiver: str) -> str | None:
    m = re.search(rf"\b([A-Z][\w$.]*(?:\s*<[^;=(){{}}]+>)?)\s+{re.escape(receiver)}\b", code)
    return simple_type(m[1]) if m else None


def infer_entity(request: str | None, controller: str, path: str) -> str:
    """The request's name without its ending, else the controller's, else the last fixed segment of the path."""
    for name, ending in ((request or "", r"(?:Create|Update|Submit|Joint|Personal)?Request$"), (controller, "Controller$")):
        if (stem := re.sub(ending, "", name)) != name:
            return stem or name
    return next((s for s in reversed(path.split("/")) if s and "{" not in s), "Entity")


def same_entity(a: str, b: str) -> bool:
    plain = lambda x: re.sub(r"(?i)(?<!s)s$", "", re.sub(r"(?i)(?:Entity|Model)$", "", x)).lower()
    return plain(a) == plain(b)


def entity_of(code: str, m: Method, expression: str, receiver: str | None = None) -> str | None:
    """The entity an expression holds: by its repository's name or type parameter, a constructor, or a declaration."""
    if receiver:
        r = re.escape(receiver)
        found = re.search(rf"\b([A-Z][\w$]*)Repository\s+{r}\b", code) or re.search(rf"\b(?:Repository|CrudRepository|JpaRepository)\s*<\s*([A-Z][\w$]*)[^>]*>\s+{r}\b", code)
        if found:
            return found[1]
    made = re.match(r"new\s+([A-Z][\w$]*)", expression) or re.search(rf"\b([A-Z][\w$]*)\s+{re.escape(expression.strip())}\b", m.code)
    return made[1] if made else None


# Response states that do not speak against success.
SUCCESS = ("OK", "CREATED", "ACCEPTED", "NO_CONTENT", "RESET_CONTENT", "PARTIAL_CONTENT", "MULTI_STATUS", "ALREADY_REPORTED", "IM_USED")
_THING = rf"(new\s+[A-Z][\w$]*|{_NAME})"


def effect(code: str, m: Method, http: str, entity: str) -> tuple[str, str, str | None] | None:
    """(kind, entity, new state) of what a handler does in its outermost block, None for a method that changes nothing."""
    failed = m.top(r"\b(?:ResponseEntity\.status\s*\(\s*(?:HttpStatus\.)?|new\s+ResponseEntity\s*<[^>]*>\s*\([^,]*,\s*HttpStatus\.)([A-Z_]+)")
    if failed and failed[1] not in SUCCESS:
        return "unknown-mutation", entity, None
    state = m.top(rf"\b({_NAME})\.setStatus\s*\(\s*(?:{_NAME}\.)?([A-Z][A-Z0-9_]*)")
    if state and (e := entity_of(code, m, state[1])) and same_entity(e, entity):
        return "state-changed", entity, state[2]
    changes = (("save|persist", "entity-created" if http == "POST" else "state-changed", True, True), ("delete|deleteById|remove", "entity-deleted", True, http == "DELETE"), ("publish|send", "external-command", False, True))
    for names, kind, by_repository, counts in changes:
        found = m.top(rf"\b({_NAME})\.(?:{names})\s*\(\s*{_THING}")
        if counts and found and (e := entity_of(code, m, found[2], found[1] if by_repository else None)) and same_entity(e, entity):
            return kind, entity, None
    if http == "POST" and re.search(r"\b(?:generateToken|createToken|issueToken)\s*\(", m.code) and re.search(r"\b(?:HttpStatus\.OK|ResponseEntity\.ok\s*\()", m.code):
        return "authentication-session-issued", m.returns or entity, None
    return ("unknown-mutation", entity, None) if http in ("POST", "PUT", "PATCH", "DELETE") else None


def authorization(expression: str) -> tuple[str, list[str]]:
    """(status, authorities) of an access expression: certain for authorities joined by `and`, anonymous, authenticated or
    conditional for anything else."""
    text = expression.strip()
    if re.fullmatch(r"permitAll(?:\(\))?", text):
        return "anonymous", []
    if re.fullmatch(r"isAuthenticated\(\)|authenticated", text):
        return "authenticated", []
    names = []
    for term in re.split(r"\s+and\s+", text):
        m = re.fullmatch(r"""\(*\s*has(Authority|Role)\(\s*['"]([^'"]+)['"]\s*\)\s*\)*""", term)
        if not m or term.count("(") != term.count(")"):
            return "conditional", []
        names.append(m[2] if m[1] == "Authority" or m[2].startswith("ROLE_") else f"ROLE_{m[2]}")
    return "certain", sorted(set(names))


# --- many files -----------------------------------------------------------------------------------------------------


def method_facts(files: DataFrame) -> DataFrame:
    """path, method, arity, line, returns, request_type, validation, why, guard, annotations of files (path, content)."""

    def facts(content: str) -> list[tuple]:
        return [(m.name, len(m.parameters), m.line, m.returns, *m.binding, P.label(domain_guard(m)), [text for _, _, text in m.marks]) for m in methods(content or "")]

    schema = "method string, arity int, line int, returns string, request_type string, validation string, why string, guard string, annotations array<string>"
    return P.per_row(files.select("path", "content"), ["content"], schema, facts).drop("content")


def call_facts(files: DataFrame) -> DataFrame:
    """path, method, arity, receiver_type, callee, callee_arity of calls whose receiver's type the file declares."""

    def facts(content: str) -> list[tuple]:
        code = code_only(content or "")
        found = [(m.name, len(m.parameters), receiver_type(code, r), callee, n) for m in methods(content or "") for r, callee, n in receiver_calls(m)]
        return [x for x in found if x[2]]

    return P.per_row(files.select("path", "content"), ["content"], "method string, arity int, receiver_type string, callee string, callee_arity int", facts).drop("content")


def type_facts(files: DataFrame) -> DataFrame:
    """path, type, is_interface, implements."""
    return P.per_row(files.select("path", "content"), ["content"], "type string, is_interface boolean, implements array<string>", lambda c: [declared_type(code_only(c or ""))]).drop("content")


def call_edges(files: DataFrame) -> DataFrame:
    """(src, dst) between methods 'path:name/arity': calls whose receiver's type leads to one method only, of the class of
    that name or, for an interface, of the classes that implement it."""
    key = lambda p, n, a: F.concat(F.col(p), F.lit(":"), F.col(n), F.lit("/"), F.col(a).cast("string"))
    types = type_facts(files)
    own = types.where("type IS NOT NULL AND NOT is_interface").select("path", F.col("type").alias("receiver_type"))
    through = types.select("path", F.explode("implements").alias("receiver_type"))
    single = own.groupBy("receiver_type").agg(F.count("*").alias("n")).where("n = 1").select("receiver_type")
    targets = own.join(single, "receiver_type", "left_semi").unionByName(through.join(single, "receiver_type", "left_anti"))
    m = method_facts(files)
    declared = targets.join(m.select("path", F.col("method").alias("callee"), F.col("arity").alias("callee_arity")), "path").withColumn("dst", key("path", "callee", "callee_arity"))
    calls = call_facts(files).withColumn("src", key("path", "method", "arity"))
    return unique_join(calls, declared, ["receiver_type", "callee", "callee_arity"], ["dst"]).where("match = 'unique'").select("src", "dst").distinct()


def delegated(seeds: DataFrame, edges: DataFrame, depth: int = 6, most: int = 80) -> DataFrame:
    """(origin, node, level): methods that each origin's calls lead to, breadth first, `most` of them at most, the smallest
    of a level first."""
    e = _settled(edges.select("src", "dst"))
    found = _settled(seeds.select(F.col("node").alias("origin"), "node", F.lit(0).alias("level")).distinct())
    for level in range(1, depth + 1):
        step = found.where(F.col("level") == level - 1).join(e, F.col("node") == F.col("src")).select("origin", F.col("dst").alias("node")).distinct().join(found, ["origin", "node"], "left_anti")
        room = found.groupBy("origin").agg((F.lit(most + 1) - F.count("*")).alias("room"))
        new = _settled(top_of_each(step, ["origin"], [F.col("node")], most).join(room, "origin").where("rank <= room").select("origin", "node", F.lit(level).alias("level")))
        if new.isEmpty():
            break
        found = _settled(found.unionByName(new))
    return found.where("level > 0")
