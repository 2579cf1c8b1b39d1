"""Benchmark decontamination: one Aho-Corasick automaton over windows of normalised items, each text scanned once.

Texts are normalised (ASCII letters lower-cased, words of digits, ASCII letters and non-ASCII characters) byte by byte,
so a normalised word maps to its place in the original text by position. The automaton's letters are words, numbered as
the items name them; any other word ends all matches, so only runs of known words pass the automaton. Windows are runs
of `window` words of an item; an item with fewer words, but not none, is one window.

Defined cases: a null or wordless text has no words and no hits; a null or wordless item has no window; the windows of
an item without an id count as hits, but it is not named among the items; items that share a window are all reported;
repeated documents are reported row by row; empty tables give no rows or no hits; other columns stay, but for those of
the results' names, which are replaced. Texts of any length are read whole.
"""

from __future__ import annotations

import re
import uuid
from itertools import repeat

import ahocorasick
import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from waypath.llm.common import documents, map_texts

WINDOW = 10
#: UTF-8 bytes of item text in one automaton; a larger benchmark is scanned for in several automata, one after another,
#: each held by a task for blocks of BLOCK_BYTES of its documents.
AUTOMATON_BYTES = 1_500_000
BLOCK_BYTES = 32_000_000
#: Bytes of item text that are sent to all executors at most; more raise an error.
BENCHMARK_BYTES = 500_000_000

_FOLD = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)
)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").translate(_FOLD).split()


def _letter(n: int) -> str:
    """The n-th letter, from 1; surrogates are none."""
    return chr(n if n < 0xD800 else n + 0x800)


class Leaks:
    """The automaton of some items' windows; each window carries its number of words and its items."""

    def __init__(self, items: list[tuple[str | None, str]], window: int = WINDOW):
        self.letter: dict[bytes, str] = {}
        owners: dict[str, set] = {}
        for item, text in items:
            w = "".join(self.letter.setdefault(x, _letter(len(self.letter) + 1)) for x in words_of(text))
            for i in range(max(1, len(w) - window + 1) if w else 0):
                owners.setdefault(w[i : i + window], set()).add(item)
        self.found = ahocorasick.Automaton()
        for pattern, who in owners.items():
            self.found.add_word(pattern, (len(pattern), frozenset(who)))
        self.some = bool(owners)
        if self.some:
            self.found.make_automaton()
            # matches lie in runs of known words that are as long as the shortest window
            self.runs = re.compile(f"[^\0]{{{min(map(len, owners))},}}")

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """Hit windows as (first word, last word + 1), and their items."""
        spans, who = [], set()
        if self.some:
            for run in self.runs.finditer("".join(map(self.letter.get, words, UNKNOWN))):
                for end, (n, items) in self.found.iter(run[0]):
                    end += run.start() + 1
                    spans.append((end - n, end))
                    who |= items
        return spans, who - {None}


UNKNOWN = repeat("\0")
_KEPT: dict[str, Leaks] = {}


def _automaton(key: str, items: list[tuple[str | None, str]], window: int) -> Leaks:
    """The last one is kept for the worker's next batch or task."""
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = Leaks(items, window)
    return _KEPT[key]


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def original_spans(text: str, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Word spans as (start, end) in characters of the original text."""
    raw = text.encode("utf-8", "replace")
    inside = np.frombuffer(raw.translate(_FOLD), np.uint8) != 0x20
    edge = np.diff(np.concatenate(([0], inside.view(np.int8), [0])))
    first, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    chars = np.concatenate(([0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)))
    return [(int(chars[first[a]]), int(chars[end[b - 1]])) for a, b in spans]


def item_chunks(benchmark: DataFrame, item_col: str, text_col: str, chunk_bytes: int = AUTOMATON_BYTES) -> list[list[tuple[str | None, str]]]:
    """The items, in lists of about chunk_bytes of text at most, fetched one list at a time."""
    items = benchmark.select(F.col(f"`{item_col}`").cast("string").alias("item"), F.col(f"`{text_col}`").cast("string").alias("text"))
    items = items.where("text IS NOT NULL")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if total > BENCHMARK_BYTES:
        raise ValueError(f"a benchmark of {total} bytes: give it in parts of {BENCHMARK_BYTES} at most")
    n = max(1, -(-int(total) // chunk_bytes))
    part = F.pmod(F.xxhash64("item", "text"), F.lit(n))
    return [sorted(((r.item, r.text) for r in items.where(part == k).collect()), key=lambda x: (x[0] is None, x)) for k in range(n)]


def find_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    keep: list[str] | None = None,
    chunk_bytes: int = AUTOMATON_BYTES,
) -> DataFrame:
    """Adds n_words, n_hit, items (sorted ids as strings) and leak_spans (characters of the original text).

    The documents are mapped where they lie; only the items travel, in broadcasts of bounded size.
    """
    fields = [
        T.StructField("n_words", T.LongType()),
        T.StructField("n_hit", T.LongType()),
        T.StructField("items", T.ArrayType(T.StringType())),
        T.StructField("leak_spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
    ]
    sc = docs.sparkSession.sparkContext
    shared = [sc.broadcast((uuid.uuid4().hex, c)) for c in item_chunks(benchmark, item_col, item_text_col, chunk_bytes)]

    def make():
        def f(texts: list) -> list[list]:
            spans: list[list] = [[] for _ in texts]
            items: list[set] = [set() for _ in texts]
            n_words = [0] * len(texts)
            for part in shared:
                automaton = _automaton(*part.value, window)
                for i, t in enumerate(texts):
                    words = words_of(t)
                    n_words[i] = len(words)
                    found, who = automaton.scan(words)
                    if found:
                        spans[i] += found
                        items[i] |= who
            spans = [merged(s) for s in spans]
            at = [[{"start": a, "end": b} for a, b in original_spans(t, s)] if s else [] for t, s in zip(texts, spans)]
            return [n_words, [sum(b - a for a, b in s) for s in spans], [sorted(x) for x in items], at]

        return f

    return map_texts(docs, text_col, fields, make, keep, 0 if len(shared) == 1 else BLOCK_BYTES)


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = find_leaks(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), keep=["doc_id"])
    return out.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


#: Words, their windows and joined windows, in DuckDB; a window of an item is looked up by its words.
ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item, least(len(w), 10) AS k, array_to_string(w[i : i + 9], ' ') AS win FROM (SELECT item, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM b WHERE len(w) > 0)),
ks AS (SELECT DISTINCT k FROM bw),
dw AS (SELECT doc_id, i, k, array_to_string(w[i : i + k - 1], ' ') AS win FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, ks WHERE len(w) >= k)),
hits AS (SELECT doc_id, i, dw.k, item FROM dw JOIN bw ON dw.k = bw.k AND dw.win = bw.win),
hw AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hits) GROUP BY doc_id),
hi AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hits WHERE item IS NOT NULL) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hw USING (doc_id) LEFT JOIN hi USING (doc_id)
"""
