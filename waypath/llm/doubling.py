"""Substring dedup by level-wise doubling over word windows.

Level 1 looks at windows of `window`/4 words, sampled by content (every long window holds the sampled one, at the same
place wherever it occurs); level 2 at windows of `window`/2 words, but only inside long windows whose level-1 window
occurs twice; the last level at long windows both of whose halves (overlapping by a word if need be) occur twice. So
windows of one length survive only if they repeat, alone are extended to twice the length, and the levels end when no
candidate is left or the length is reached. Hashes of the first levels only rule windows out; the last level compares
80 bits beside the bucket.

Shards of documents compute their windows again at each level, so only keys travel: the text is shuffled once.

Words are runs without ASCII white space. Every word of a window that occurs anywhere else, in the same document or
another, is removed; windows do not cross documents and are judged on the input.

Defined cases: a null text has no words; texts shorter than the window keep all words; a null id stays null; repeated
rows of one id are judged as documents of their own; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waypath.llm.common import SHARD_BYTES, documents, given_id, shard_documents
from waypath.llm.exchange import KEYS, Shard, bucketed, covered, groups, key_rows, mix, no_keys, read_answers, repeated, spread_out, window_runs

WINDOW = 35

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_TABLES = {s: np.random.default_rng(s).integers(1, 1 << 63, 256, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1) for s in (1, 2)}
_BASE = {1: np.uint64(0x9E3779B97F4A7C15), 2: np.uint64(0xC2B2AE3D27D4EB4F)}


_POWERS: dict[int, np.ndarray] = {}


def _powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; tables of moderate length are kept."""
    table = _POWERS.get(int(base))
    if table is None or len(table) < n:
        table = np.full(max(n, 1 << 17), base, np.uint64)
        table[0] = 1
        table = np.cumprod(table)
        if len(table) <= 1 << 20:
            _POWERS[int(base)] = table
    return table[:n]


def _inverse(base: np.uint64) -> np.uint64:
    return np.uint64(pow(int(base), -1, 1 << 64))


def string_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int, block: int = 1 << 16) -> np.ndarray:
    """64-bit hashes of values[starts[i]:ends[i]] (polynomials modulo 2**64, then mixed), by differences of prefix sums."""
    base = _BASE[seed]
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        a = int(starts[i])
        j = max(i + 1, int(np.searchsorted(ends, a + block, "right")))
        b = int(ends[j - 1])
        prefix = np.zeros(b - a + 1, np.uint64)
        np.cumsum(values[a:b] * _powers(_inverse(base), b - a), out=prefix[1:])
        s, e = starts[i:j] - a, ends[i:j] - a
        out[i:j] = (prefix[e] - prefix[s]) * _powers(base, b - a)[s]
        i = j
    return mix(out + (ends - starts).astype(np.uint64) * np.uint64(0x9FB21C651E98DF25))


class Words:
    """A shard's words, their document's end and, by number of words, the hashes of all windows."""

    def __init__(self, shard: Shard):
        self.shard = shard
        text, n = shard.data, len(shard.data)
        space = _SPACE[text]
        before = np.ones(n, bool)
        before[1:] = space[:-1]
        if n:
            before[shard.offsets[:-1][shard.offsets[:-1] < n]] = True
        after = np.ones(n, bool)
        after[:-1] = before[1:] | space[1:]
        self.starts = np.flatnonzero(~space & before)
        self.ends = np.flatnonzero(~space & after) + 1
        self.first = np.searchsorted(self.starts, shard.offsets)  # of each document, and the end
        self.doc_end = np.repeat(self.first[1:], np.diff(self.first))
        self.n = len(self.starts)
        self._prefix: dict[int, np.ndarray] = {}

    def word_hashes(self, seed: int) -> np.ndarray:
        return string_hashes(_TABLES[seed][self.shard.data], self.starts, self.ends, seed)

    def windows(self, at: np.ndarray, length: int, seed: int = 1) -> np.ndarray:
        """Hashes of the windows of `length` words that start at the words `at` (and lie in the shard)."""
        if seed not in self._prefix:
            p = np.zeros(self.n + 1, np.uint64)
            np.cumsum(self.word_hashes(seed) * _powers(_inverse(_BASE[seed]), self.n), out=p[1:])
            self._prefix[seed] = p
            self._power = _powers(_BASE[1], self.n + 1), _powers(_BASE[2], self.n + 1)
        p = self._prefix[seed]
        return mix((p[at + length] - p[at]) * self._power[seed - 1][at])


def lengths(window: int) -> tuple[int, int]:
    """Of the first two levels; two of each cover one of the next."""
    half = -(-window // 2)
    return -(-half // 2), half


def level_one(words: Words, window: int, buckets: int):
    gram = lengths(window)[0]
    hashes = lambda a, b: words.windows(np.arange(a, b), gram)
    first, count, h, place = window_runs(words.n, hashes, words.doc_end, window, gram)
    key = bucketed(h, buckets)
    order, edge, number = groups(key)
    p = place[order]
    low = np.minimum.reduceat(p, edge) if len(edge) else p
    high = np.maximum.reduceat(p, edge) if len(edge) else p
    return first, count, number, key[order][edge], high > low


def level_two(words: Words, window: int, buckets: int, first, count, number, yes):
    """Long windows left after level 1, their halves' group numbers, and the halves' distinct keys and flags."""
    half = lengths(window)[1]
    keep = yes[number] if len(number) else np.zeros(0, bool)
    left = spread_out(first[keep], count[keep])
    at = np.unique(np.concatenate([left, left + window - half]))
    key = bucketed(words.windows(at, half), buckets)
    order, edge, group = groups(key)
    size = np.diff(np.append(edge, len(order)))
    return left, group[np.searchsorted(at, left)], group[np.searchsorted(at, left + window - half)], key[order][edge], size > 1


def level_three(words: Words, window: int, buckets: int, left, head, tail, yes):
    keep = yes[head] & yes[tail] if len(left) else np.zeros(0, bool)
    left = left[keep]
    key = bucketed(words.windows(left, window), buckets)
    more = words.windows(left, window, 2) & np.uint64((1 << 40) - 1)
    order, edge, group = groups(key, more)
    size = np.diff(np.append(edge, len(order)))
    return left, group, key[order][edge], more[order][edge], size > 1


def repeated_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the words that stay, joined by a space)."""
    sharded, buckets = shard_documents(docs, id_col, text_col, shard_bytes)
    by_shard = sharded.groupBy("shard")

    def shard_of(table: pa.Table) -> int:
        return table["shard"][0].as_py()

    def answers(table: pa.Table, level: int) -> pa.Table:
        return table.filter(pc.equal(table["level"], level))

    def send_one(table: pa.Table) -> pa.Table:
        *_, keys, flags = level_one(Words(Shard(table)), window, buckets)
        return key_rows(shard_of(table), keys, flags)

    def after_one(words: Words, told: pa.Table):
        first, count, number, keys, _ = level_one(words, window, buckets)
        return level_two(words, window, buckets, first, count, number, read_answers(answers(told, 1), keys)[0])

    def send_two(table: pa.Table, told: pa.Table) -> pa.Table:
        if not len(table):
            return no_keys()
        *_, keys, flags = after_one(Words(Shard(table)), told)
        return key_rows(shard_of(table), keys, flags)

    def after_two(words: Words, told: pa.Table):
        left, head, tail, keys, _ = after_one(words, told)
        return level_three(words, window, buckets, left, head, tail, read_answers(answers(told, 2), keys)[0])

    def send_three(table: pa.Table, told: pa.Table) -> pa.Table:
        if not len(table):
            return no_keys()
        _, _, keys, more, flags = after_two(Words(Shard(table)), told)
        return key_rows(shard_of(table), keys, flags, more)

    def finish(table: pa.Table, told: pa.Table) -> pa.Table:
        if not len(table):
            return pa.table({"doc_id": pa.array([], pa.int64()), "n_words": pa.array([], pa.int64()), "n_removed": pa.array([], pa.int64()), "kept": pa.array([], pa.string())})
        words = Words(Shard(table))
        left, group, keys, _, _ = after_two(words, told)
        yes = read_answers(answers(told, 3), keys)[0]
        gone = covered(left[yes[group]] if len(left) else left, window, words.n)
        raw = words.shard.data.tobytes()
        kept, removed = [], []
        for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist()):
            stay = np.flatnonzero(~gone[a:b]) + a
            removed.append(b - a - len(stay))
            kept.append(b" ".join([raw[s:e] for s, e in zip(words.starts[stay].tolist(), words.ends[stay].tolist())]).decode())
        return pa.table({"doc_id": pa.array(words.shard.ids), "n_words": pa.array(np.diff(words.first)), "n_removed": pa.array(removed, pa.int64()), "kept": pa.array(kept, pa.string())})

    def level(df: DataFrame, n: int) -> DataFrame:
        return df.withColumn("level", F.lit(n))

    one = level(repeated(by_shard.applyInArrow(send_one, KEYS), buckets), 1)
    two = level(repeated(by_shard.cogroup(one.groupBy("shard")).applyInArrow(send_two, KEYS), buckets), 2)
    three = level(repeated(by_shard.cogroup(one.unionByName(two).groupBy("shard")).applyInArrow(send_three, KEYS), buckets, wide=True), 3)
    told = one.unionByName(two).unionByName(three)
    done = by_shard.cogroup(told.groupBy("shard")).applyInArrow(finish, "doc_id long, n_words long, n_removed long, kept string")
    return done.withColumn("doc_id", given_id(F.col("doc_id")))


def op4_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repeated_words(documents(spark, sf_dir))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


#: Windows of 35 words that start in two places, by the MD5 of their words, in DuckDB.
ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT r, i, md5(array_to_string(w[i : i + 34], ' ')) AS s FROM (SELECT r, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35)),
hit AS (SELECT r, i FROM win WHERE s IN (SELECT s FROM win GROUP BY s HAVING count(*) > 1)),
gone AS (SELECT DISTINCT r, unnest(range(i, i + 35)) AS p FROM hit),
kept AS (SELECT r, count(*) AS n, string_agg(x, ' ' ORDER BY p) AS txt FROM (SELECT r, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d) ANTI JOIN gone USING (r, p) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(txt, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (r)
"""
