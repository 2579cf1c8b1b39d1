"""Personal data by anchor expansion.

One Aho-Corasick pass finds anchors: at-signs, plus signs, digits, URL schemes and cues of identifiers. Local parsers
then expand each anchor to its boundaries and validate it. Base kinds equal leftmost non-overlapping matches of
  email  [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+
  ip     [0-9]+(\\.[0-9]+)(\\.[0-9]+)(\\.[0-9]+)          parts at most 255
  card   [0-9]([\\x20-]?[0-9])+                           14 to 19 digits passing Luhn
  phone  \\+[0-9][\\x20().0-9-]+[0-9]                     10 to 15 digits
of which failing ones are dropped without a retry. Beyond them: `iban` (after a cue, of its country's length, mod-97
checked), `ssn` (after a cue, by its number ranges) and `login` (user information in a URL). A few words may stand between
a cue and its value. Offsets count code points, end exclusive.

Defined cases: a null or empty text has no spans; rows are independent, so ties and repeated rows do not matter; an empty
table gives no rows; other columns stay, but for `pii`, which is replaced. Texts of any length are read whole.
"""

from __future__ import annotations

import hashlib
import re

import ahocorasick
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from waypath.llm.common import documents, map_texts

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "ssn", "login")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DIGITS = frozenset("0123456789")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
#: What may stand between a cue and its value: signs, and up to three short words.
_GAP = r"[\s:#=]{0,4}(?:(?:is|was|number|no\.?|nr\.?|num\.?|code|ist|est|es|num[eé]ro|número)(?![A-Za-z])[\s:#=]{0,4}){0,3}"
_IBAN = re.compile(_GAP + r"([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9])*)")
_SSN = re.compile(_GAP + r"([0-9]{3}-[0-9]{2}-[0-9]{4})(?![0-9-])")
# An account number's length by country.
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "BY": 28, "CH": 21, "CR": 22, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "DO": 28, "EE": 20, "EG": 29,
    "ES": 24, "FI": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20,
    "LB": 28, "LC": 32, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "LY": 25, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MR": 27, "MT": 31, "MU": 30, "NL": 18, "NO": 15, "PK": 24, "PL": 28, "PS": 29, "PT": 25,
    "QA": 29, "RO": 24, "RS": 22, "SA": 24, "SC": 31, "SD": 18, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "ST": 25, "SV": 28, "TL": 23, "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20,
}
_LOGIN = re.compile(r"://([^\s/@:?#\"'<>]{1,4096}:[^\s/@?#\"'<>]{1,4096})@")
_NOT_DIGIT = re.compile(r"[^0-9]+")


def anchors() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for c in "@+0123456789":
        found.add_word(c, c)
    found.add_word("://", "login")
    for cue in ("iban", "ssn"):
        for form in (cue, cue.upper(), cue.capitalize()):
            found.add_word(form, cue)
    found.make_automaton()
    return found


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) << (i & 1)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def _octet(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or "0") <= 255


def _iban(run: str) -> int:
    """Length of the account number that begins a run of characters and single blanks, 0 if none does: its country tells
    how many characters belong to it; the check digits hold modulo 97."""
    at, value = 0, ""
    while at < len(run) and len(value) < IBAN_LENGTHS.get(run[:2], 0):
        value += run[at].strip()
        at += 1
    whole = len(value) == IBAN_LENGTHS.get(run[:2]) and not run[at : at + 1].strip()
    return at if whole and int("".join(str(int(c, 36)) for c in value[4:] + value[:4])) % 97 == 1 else 0


def _ssn(value: str) -> bool:
    area, group, serial = value.split("-")
    return area not in ("000", "666") and area < "900" and group != "00" and serial != "0000"


def find_spans(text: str | None, automaton: ahocorasick.Automaton) -> list[tuple[int, int, int]]:
    """(start, kind number, end), sorted. *_end: where the kind's last match, kept or dropped, ended."""
    if not text:
        return []
    out: list[tuple[int, int, int]] = []
    email_end = ip_end = card_end = phone_end = 0
    for at, what in automaton.iter(text):
        if what in _DIGITS:
            if at >= ip_end and (at == 0 or text[at - 1] not in _DIGITS) and (m := _IP.match(text, at)):
                ip_end = m.end()
                if all(map(_octet, m[0].split("."))):
                    out.append((at, 1, ip_end))
            if at >= card_end and (m := _CARD.match(text, at)):
                card_end = m.end()
                if card_end - at >= 14 and 14 <= len(digits := _NOT_DIGIT.sub("", m[0])) <= 19 and luhn(digits):
                    out.append((at, 2, card_end))
        elif what == "@":
            start = at
            while start > email_end and text[start - 1] in _LOCAL:
                start -= 1
            if start < at and (m := _DOMAIN.match(text, at)):
                email_end = m.end()
                out.append((start, 0, email_end))
        elif what == "+":
            if at >= phone_end and (m := _PHONE.match(text, at)):
                phone_end = m.end()
                if 10 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                    out.append((at, 3, phone_end))
        elif what == "login":
            if m := _LOGIN.match(text, at - 2):
                out.append((m.start(1), 6, m.end(1)))
        elif what == "iban":
            if (m := _IBAN.match(text, at + 1)) and (n := _iban(m[1])):
                out.append((m.start(1), 4, m.start(1) + n))
        elif (m := _SSN.match(text, at + 1)) and _ssn(m[1]):
            out.append((m.start(1), 5, m.end(1)))
    return sorted(out)


def find_pii(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Adds pii: array of (kind, start, end) by start, then kind in the order of KINDS. No shuffle."""
    span = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])

    def make():
        automaton = anchors()
        return lambda texts: [[[{"kind": KINDS[k], "start": a, "end": b} for a, k, b in find_spans(t, automaton)] for t in texts]]

    return map_texts(docs, text_col, [T.StructField("pii", T.ArrayType(span))], make, keep)


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(documents(spark, sf_dir), keep=["doc_id"])
    line = lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))
    base = F.filter("pii", lambda x: x["kind"].isin(*BASE))
    count = lambda kind: F.size(F.filter("pii", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        *[count(k) for k in BASE],
        F.sha2(F.array_join(F.transform(base, line), ","), 256).alias("base_sha256"),
        F.array_join(F.transform("pii", line), ",").alias("spans"),
    )


def digest(spans: list[tuple[int, int, int]]) -> str:
    return hashlib.sha256(",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans if k < len(BASE)).encode()).hexdigest()
