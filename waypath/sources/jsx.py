"""Lexical facts of TSX sources: elements with their attributes and guards, actions, fields, payload shapes.

What needs resolved symbols is not seen: an identifier is not followed to its declaration. Conditions around an element
are read from the braces that hold it (`cond && <X/>`, `cond ? <X/> : <Y/>`); anything else around it that decides
whether it shows (a list's callback, a catch or switch block) is an opaque guard.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame

from waypath.functions import predicates as P

_LEXEME = re.compile(r"""(?P<comment>//[^\n]*|/\*.*?(?:\*/|\Z))|(?P<text>"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`)""", re.S)
_TAG = re.compile(r"<([A-Za-z][\w.-]*)(?=[\s/>])")
_ATTRIBUTE = re.compile(r"""\s+([A-Za-z_][\w:-]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|(\{)))?""")
_OPEN = {"(": ")", "[": "]", "{": "}"}
#: Native controls that act, and those that take a value.
ACTIONS, FIELDS = ("button", "a", "Link", "NavLink"), ("input", "select", "textarea")


def masked(source: str) -> str:
    """Comments and literals as blanks of equal length; a template's expressions count as part of it. An apostrophe
    between tags is text."""
    return _LEXEME.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), source)


def pairs_of(code: str) -> dict[int, int]:
    ends, held = {}, []
    for i, c in enumerate(code):
        if c in _OPEN:
            held.append(i)
        elif c in ")]}" and held and _OPEN[code[held[-1]]] == c:
            ends[held.pop()] = i
    return ends


@dataclass
class Element:
    tag: str
    start: int
    line: int
    attributes: dict[str, str | None]  # expressions in braces, literals in quotes, None for a bare name
    text: str
    guards: list[str]


def elements(source: str) -> list[Element]:
    code = masked(source)
    ends = pairs_of(code)
    out = []
    for m in _TAG.finditer(code):
        if re.search(r"[\w)\]]$", code[: m.start()].rstrip(" ")) and not re.search(r"\breturn$", code[: m.start()].rstrip()):
            continue  # a comparison or a type argument
        at, attributes = m.end(), {}
        while a := _ATTRIBUTE.match(source, at):
            if a[4]:
                close = ends.get(a.end() - 1)
                if close is None:
                    break
                attributes[a[1]], at = "{" + source[a.end() : close].strip() + "}", close + 1
            else:
                value = a[2] if a[2] is not None else a[3]
                attributes[a[1]], at = None if value is None else f'"{value}"', a.end()
        rest = re.compile(r"\s*(/?)>").match(source, at)
        if not rest:
            continue
        text = ""
        if not rest[1] and (end := re.compile(rf"</{re.escape(m[1])}\s*>").search(source, rest.end())):
            text = " ".join(re.sub(r"<[^>]*>|\{[^{}]*\}", " ", source[rest.end() : end.start()]).split())
        out.append(Element(m[1], m.start(), source.count("\n", 0, m.start()) + 1, attributes, text, guards_at(source, code, ends, m.start())))
    return out


def guards_at(source: str, code: str, ends: dict[int, int], at: int) -> list[str]:
    """Conditions that the braces around a place put on it, outermost first."""
    out = []
    around = sorted(a for a, b in ends.items() if a < at < b and code[a] == "{")
    for a, limit in zip(around, [*around[1:], at]):
        inner = [(x, y) for x, y in ends.items() if a < x and y < limit]
        lead = "".join(" " if any(x <= i <= y for x, y in inner) else code[i] for i in range(a + 1, limit))
        tail = lead.rstrip(" (\n\t")
        if re.search(r"=>$", tail) or re.search(r"\.map$", re.sub(r"\(.*$", "", lead.strip())):
            out.append(f"mapped:{source.count(chr(10), 0, a) + 1}")
        elif tail.endswith("&&"):
            out.append(source[a + 1 : a + 1 + len(tail) - 2].strip())
        elif tail.endswith("?"):
            out.append(source[a + 1 : a + 1 + len(tail) - 1].strip())
        elif tail.endswith(":") and "?" in tail:
            out.append(f"!({source[a + 1 : a + 1 + tail.index('?')].strip()})")
        elif re.search(r"\b(?:catch\s*\([^)]*\)|catch|switch\s*\([^)]*\)|else)\s*$", code[:a]):
            out.append(f"control-flow:{source.count(chr(10), 0, a) + 1}")
        elif m := re.search(r"\bif\s*\(", code[max(0, a - 400) : a]):
            opened = max(0, a - 400) + m.end() - 1
            if ends.get(opened) is not None and not code[ends[opened] + 1 : a].strip():
                out.append(source[opened + 1 : ends[opened]].strip())
    return out


def literal(value: str | None) -> str | None:
    """The text of a literal attribute."""
    if value is None or value[:1] == '"':
        return value and value[1:-1]
    inner = value[1:-1].strip()
    return inner[1:-1] if len(inner) > 1 and inner[0] == inner[-1] and inner[0] in "'\"`" and "${" not in inner else None


def actions(source: str) -> list[tuple[str, str | None, str | None, list[str], list[str]]]:
    """(tag, accessible name, handler, visible guards, enabled guards) of controls that act."""
    out = []
    for e in elements(source):
        submit = e.tag == "input" and literal(e.attributes.get("type", "")) in ("submit", "button") or e.tag == "button"
        handler = next((e.attributes[k] for k in ("onClick", "onSubmit", "onPress") if e.attributes.get(k)), None)
        target = next((e.attributes[k] for k in ("href", "to") if k in e.attributes), None)
        if not (submit or e.tag in ACTIONS and target or handler):
            continue
        name = literal(e.attributes["aria-label"]) if e.attributes.get("aria-label") else e.text or literal(e.attributes.get("value", "")) or None
        off = e.attributes.get("disabled", "")
        enabled = [] if off in ("", "{false}") else ["false"] if off in (None, "{true}") else [f"!({off[1:-1]})"]
        inner = handler and handler[1:-1].strip()
        called = re.fullmatch(r"(?:\([^)]*\)|\w+)?\s*(?:=>)?\s*(?:void\s+|await\s+)?([A-Za-z_$][\w$.]*)\s*(?:\(.*\))?;?", inner, re.S) if inner else None
        out.append((e.tag, name, called[1] if called else inner, e.guards, enabled))
    return out


def payload_shape(text: str | None) -> tuple[str, list[tuple[str, str, str | None]]]:
    """(certainty, fields as (name, literal, path or other, value)) of a request body's expression: exact for an object
    literal of plain names, partial with a spread or computed name, unknown for anything else."""
    t = re.sub(r"^JSON\.stringify\s*\((.*)\)$", r"\1", (text or "").strip(), flags=re.S).strip()
    if t[:1] != "{" or pairs_of(masked(t)).get(0) != len(t) - 1:
        return "unknown", []
    code, cuts, depth = masked(t[1:-1]), [-1], 0
    for i, c in enumerate(code):
        depth += (c in "([{") - (c in ")]}")
        if c == "," and not depth:
            cuts.append(i)
    certainty, out = "exact", []
    for a, b in zip(cuts, [*cuts[1:], len(code)]):
        part = t[1:-1][a + 1 : b].strip()
        m = re.fullmatch(r"""(?s)(?:([A-Za-z_$][\w$]*)|(["'])([^"']+)\2)\s*(?::\s*(.+))?""", part)
        if not part:
            continue
        if not m or m[2] and m[4] is None:
            certainty = "partial"
            continue
        name, value = m[1] or m[3], (m[4] or m[1]).strip()
        found = P.literal(value)
        kind = "literal" if found else "path" if re.fullmatch(r"[A-Za-z_$][\w$]*(?:\??\.[A-Za-z_$][\w$]*)*", value) else "other"
        out.append((name, kind, P.value_text(found[1]) if found else value.replace("?.", ".") if kind == "path" else None))
    return certainty, out


def fields(source: str) -> list[tuple]:
    """(tag, name, binding, writable, required, visible guards) of native controls; binding: the path its value shows."""
    out = []
    for e in elements(source):
        if e.tag in FIELDS and literal(e.attributes.get("type", "")) not in ("submit", "button", "hidden"):
            shown = next((e.attributes[k][1:-1].strip() for k in ("value", "checked", "defaultValue") if (e.attributes.get(k) or "")[:1] == "{"), None)
            off = any(k in e.attributes and e.attributes[k] != "{false}" for k in ("readOnly", "disabled"))
            need = e.attributes.get("required", "")
            required = [] if need in ("", "{false}") else ["true"] if need in (None, "{true}") else [need[1:-1]]
            name = next((literal(e.attributes[k]) for k in ("name", "id") if e.attributes.get(k)), None) or (shown and shown.split(".")[-1])
            out.append((e.tag, name, shown, not off and ("onChange" in e.attributes or "defaultValue" in e.attributes or shown is None), required, e.guards))
    return out


# --- functions and calls --------------------------------------------------------------------------------------------

_FUNCTION = re.compile(r"(?P<export>\bexport\s+(?:default\s+)?)?(?:\basync\s+)?\bfunction\s+(?P<name>[A-Za-z_$][\w$]*)\s*(?:<[^(){}]*>)?\(|(?P<export2>\bexport\s+)?\bconst\s+(?P<name2>[A-Za-z_$][\w$]*)\s*(?::[^=]+)?=\s*(?:async\s*)?(?P<open>\()")
_CALLS = re.compile(r"(?P<await>\bawait\s+)?(?<![\w$.])(?P<callee>[A-Za-z_$][\w$]*(?:\??\.[A-Za-z_$][\w$]*)*)\s*\(")
_NOT_CALLS = frozenset("if for while switch catch function return typeof await new super import".split())
_ENDS = re.compile(r"\b(?:return|throw|catch|switch)\b")


@dataclass
class Function:
    name: str
    line: int
    exported: bool
    parameters: list[str]
    calls: list[tuple[str, list[str], bool, list[str]]]  # callee, arguments, awaited, guards
    completes: bool  # no return, throw, catch or switch on the way to its end
    after: list[tuple[str, str]]  # awaited callee, target of the navigation right after it


def functions(source: str) -> list[Function]:
    code = masked(source)
    ends = pairs_of(code)
    out = []
    for m in _FUNCTION.finditer(code):
        opened = m.end() - 1
        close = ends.get(opened)
        body = re.compile(r"\s*(?::[^={]+)?(?:=>\s*)?\{").match(code, close + 1) if close is not None else None
        if not body or (end := ends.get(body.end() - 1)) is None:
            continue
        start = body.end()
        names = [n[1] for p in _parts(source[opened + 1 : close]) if (n := re.match(r"([A-Za-z_$][\w$]*)", p))]
        calls = []
        for c in _CALLS.finditer(code, start, end):
            if c["callee"] in _NOT_CALLS or re.search(r"\bfunction\s*$", code[: c.start()]) or ends.get(c.end() - 1) is None:
                continue
            calls.append((c["callee"].replace("?.", "."), _parts(source[c.end() : ends[c.end() - 1]]), bool(c["await"]), [g for g in guards_at(source, code, ends, c.start()) if g]))
        last = code[start:end].rstrip()
        done = not _ENDS.search(re.sub(r"\breturn\b[^;{}]*;?$", "", last))
        out.append(Function(m["name"] or m["name2"], source.count("\n", 0, m.start()) + 1, bool(m["export"] or m["export2"]), names, calls, done, continuations(source[start:end])))
    return out


def _parts(text: str) -> list[str]:
    """Between commas outside of brackets and literals, trimmed."""
    code, cuts, depth = masked(text), [-1], 0
    for i, c in enumerate(code):
        depth += (c in "([{") - (c in ")]}")
        if c == "," and not depth:
            cuts.append(i)
    return [p for a, b in zip(cuts, [*cuts[1:], len(text)]) if (p := text[a + 1 : b].strip())]


def continuations(body: str) -> list[tuple[str, str]]:
    """(awaited callee, target): navigations to a literal or template that are the statement right after an awaited call."""
    body = _LEXEME.sub(lambda m: re.sub(r"[^\n]", " ", m[0]) if m["comment"] is not None else m[0], body)
    code, at, statements = masked(body), 0, []
    depth = 0
    for i, c in enumerate(code):
        depth += (c in "([{") - (c in ")]}")
        if c == ";" and not depth or c == "\n" and not depth and code[at:i].strip() and not re.match(r"\s*[.?&|=+]", code[i:]):
            statements.append(body[at:i].strip())
            at = i + 1
    statements.append(body[at:].strip())
    out = []
    for first, then in zip(s := [x for x in statements if x], s[1:]):
        call = re.match(r"(?s)(?:(?:const|let|var)\s+[^=]+=\s*)?await\s+([A-Za-z_$][\w$.]*)\s*\(", first)
        go = re.match(r"""(?:router\.push|history\.push|navigate)\s*\(\s*(["'`])([^"'`]+)\1""", then)
        if call and go:
            out.append((call[1], re.sub(r"\$\{([^}]*)\}", r"{\1}", go[2])))
    return out


def client_bases(source: str) -> list[tuple[str, str]]:
    """(client, base URL) of clients that are made with a literal base, and of the default client."""
    made = re.findall(r"""\bconst\s+([A-Za-z_$][\w$]*)\s*=\s*axios\.create\s*\(\s*\{[^}]*?\bbaseURL\s*:\s*["'`]([^"'`$]+)["'`]""", source)
    return made + [("axios", b) for b in re.findall(r"""\baxios\.defaults\.baseURL\s*=\s*["'`]([^"'`$]+)["'`]""", source)]


def options(source: str) -> list[tuple[str | None, list[str]]]:
    """(name, values) of select controls with literal options."""
    found, out = elements(source), []
    for e in found:
        if e.tag == "select" and (end := source.find("</select", e.start)) > 0:
            inner = [x for x in found if x.tag == "option" and e.start < x.start < end]
            values = [literal(x.attributes["value"]) if x.attributes.get("value") else x.text for x in inner]
            out.append((literal(e.attributes.get("name", "")), [v for v in values if v]))
    return out


# --- many files -----------------------------------------------------------------------------------------------------


def action_facts(files: DataFrame) -> DataFrame:
    """path, tag, name, handler, visible_when, enabled_when of files (path, content)."""
    return P.per_row(files.select("path", "content"), ["content"], "tag string, name string, handler string, visible_when array<string>, enabled_when array<string>", lambda c: actions(c or "")).drop("content")


def field_facts(files: DataFrame) -> DataFrame:
    """path, tag, name, binding, writable, required_when, visible_when."""
    return P.per_row(files.select("path", "content"), ["content"], "tag string, name string, binding string, writable boolean, required_when array<string>, visible_when array<string>", lambda c: fields(c or "")).drop("content")


def payload_facts(bodies: DataFrame, column: str) -> DataFrame:
    """bodies with certainty and fields (array of name, kind, value)."""
    shape = lambda t: [(c, [{"name": n, "kind": k, "value": v} for n, k, v in f]) for c, f in [payload_shape(t)]]
    return P.per_row(bodies, [column], "certainty string, fields array<struct<name:string,kind:string,value:string>>", shape)


def child_facts(files: DataFrame) -> DataFrame:
    """path, child, guards: components that a file's elements name."""
    return P.per_row(files.select("path", "content"), ["content"], "child string, guards array<string>", lambda c: [(e.tag, e.guards) for e in elements(c or "") if e.tag[0].isupper()]).drop("content")


def function_facts(files: DataFrame) -> DataFrame:
    """path, name, exported, parameters, completes, callee, arguments, awaited, guards: a row a call (callee null: none)."""

    def rows(content: str) -> list[tuple]:
        return [(f.name, f.exported, f.parameters, f.completes, *c) for f in functions(content or "") for c in (f.calls or [(None, None, None, None)])]

    schema = "name string, exported boolean, parameters array<string>, completes boolean, callee string, arguments array<string>, awaited boolean, guards array<string>"
    return P.per_row(files.select("path", "content"), ["content"], schema, rows).drop("content")


def continuation_facts(files: DataFrame) -> DataFrame:
    """path, name, after, target: navigations that directly follow an awaited call."""
    return P.per_row(files.select("path", "content"), ["content"], "name string, after string, target string", lambda c: [(f.name, *x) for f in functions(c or "") for x in f.after]).drop("content")
