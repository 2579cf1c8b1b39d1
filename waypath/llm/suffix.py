"""Suffix-array dedup of byte strings that start in an earlier document.

Documents are dealt to shards. A shard cuts its bytes into runs of 50-byte windows that share their smallest 24-byte
gram; equal windows lie in runs of equal grams, wherever they are. Three exchanges follow, each between shards and
buckets of grams: which grams two documents hold; for runs of such grams, which document is the first to have the run
as a whole (its copies go, whatever else is found); and, only for first runs whose gram occurs with other surroundings
too, the bytes of the run. Runs of grams that very many shards hold take part as single windows, dealt by their
content. So a passage that is everywhere is one entry a shard, and most text never travels a second time.

A bucket's bytes are held in suffix-array shards of bounded size: each is sorted by Larsson-Sadakane refinement (ranks
double the compared length, only groups not yet apart are sorted again) and gets its common prefixes by Kasai's
algorithm, all blocks of positions in step; suffixes with a common prefix of a window's length are one group. Shards
are merged by binary search of each one's windows in the sorted windows of those before. The smallest document of a
group decides: a window goes if its own document is larger.

Windows do not cross documents and are judged on the input. Defined cases: a null text counts as empty; texts below
the window keep all bytes; a null id is larger than all others and comes back as null; of rows with one id neither is
earlier than the other; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waypath.llm.common import documents, given_id, shard_documents
from waypath.llm.doubling import string_hashes
from waypath.llm.exchange import (
    KEYS, LOW, LOW_MASK, Shard, blob_rows, bucket_edges, bucketed, covered, groups, key_rows, low_bytes, low_numbers, no_keys, read_answers, repeated, spread_out, window_runs,
)

WINDOW = 50
GRAM = 24
#: UTF-8 bytes of a shard of documents; two shards a worker are held at once while they are compared.
SHARD_BYTES = 8_000_000
#: A gram in more shards than this is dealt by single windows.
MANY = 64
#: Bytes of one suffix-array shard.
SUFFIX_BYTES = 500_000
_VALUES = np.random.default_rng(5).integers(1, 1 << 63, 256, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_SECOND_VALUES = np.random.default_rng(6).integers(1, 1 << 63, 256, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def words_at(data: np.ndarray, order: str = "<") -> np.ndarray:
    """The 8 bytes that start at each place, as numbers."""
    n = len(data) - 7
    out = np.empty(max(n, 0), np.uint64)
    raw = np.ascontiguousarray(data)
    for k in range(min(8, max(n, 0))):
        part = out[k::8]
        part[:] = np.frombuffer(raw, f"{order}u8", len(part), k)
    return out


def gram_hashes(data: np.ndarray, a: int, b: int) -> np.ndarray:
    """Hashes of the 24 bytes that start at a..b-1."""
    w = words_at(data[a : b - 1 + GRAM])
    x = w[:-16] * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(32)
    x += w[8:-8]
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    x += w[16:]
    x *= np.uint64(0xC2B2AE3D27D4EB4F)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(31)
    return x


# --- suffix arrays -------------------------------------------------------------------------------------------------


def suffix_array(text: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in the order of their first `depth` bytes (at least), and each place's rank; 0 bytes follow the end."""
    n = len(text)
    first = words_at(np.concatenate([text, np.zeros(7, np.uint8)]), ">")
    sa = np.argsort(first)
    key = first[sa]
    new = np.ones(n, bool)
    new[1:] = key[1:] != key[:-1]
    group = np.flatnonzero(new)
    rank = np.empty(n, np.int64)
    rank[sa] = np.repeat(group, np.diff(np.append(group, n)))
    h = 8
    while h < depth:
        size = np.diff(np.append(group, n))
        open_ = np.repeat(size > 1, size)
        at = np.flatnonzero(open_)
        if not len(at):
            break
        s = sa[at]
        beyond = np.where(s + h < n, rank[np.minimum(s + h, n - 1)] + 1, 0)
        order = np.argsort((rank[s].astype(np.uint64) << np.uint64(32)) | beyond.astype(np.uint64))
        sa[at] = s = s[order]
        beyond = beyond[order]
        own = rank[s]
        apart = np.ones(len(s), bool)
        apart[1:] = (own[1:] != own[:-1]) | (beyond[1:] != beyond[:-1])
        new[at] |= apart
        group = np.flatnonzero(new)
        rank = rank.copy()
        rank[s] = at[np.flatnonzero(apart)][np.cumsum(apart) - 1]
        h *= 2
    return sa, rank


def common_prefixes(text: np.ndarray, sa: np.ndarray, cap: int, block: int = 64) -> np.ndarray:
    """For each place, the length (cap at most) that its suffix shares with the one before it in sa.

    Kasai: going from a place to the next, the length drops by one at most, if the next place of the suffix before also
    comes before (equal beginnings longer than cap are in no order). Blocks of places are worked off in step.
    """
    n = len(text)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    turn = np.empty(n + 1, np.int64)
    turn[sa] = np.arange(n)
    turn[n] = n
    padded = np.concatenate([text.astype(np.int16), np.full(cap + 1, -1, np.int16)])
    out = np.zeros(n, np.int64)
    lanes = np.arange(0, n, block)
    length = np.zeros(len(lanes), np.int64)
    last = np.full(len(lanes), -1, np.int64)
    for j in range(block):
        p = lanes + j
        live = p < n
        if not live.all():
            lanes, length, p, last = lanes[live], length[live], p[live], last[live]
        q = before[p]
        length = np.where((last >= 0) & (turn[last + 1] < turn[p]), np.maximum(length - 1, 0), 0)
        last = q
        length[q < 0] = 0
        go = np.flatnonzero((q >= 0) & (length < cap))
        while len(go):
            a, b = p[go] + length[go], q[go] + length[go]
            far = np.maximum(a, b) < n
            go = go[far & (padded[np.minimum(a, n)] == padded[np.minimum(b, n)])]
            length[go] += 1
            go = go[length[go] < cap]
        out[p] = length
    return out


def window_groups(text: np.ndarray, starts: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows at `starts`, in suffix order, and a group number each; equal windows, and only they, share one."""
    sa, _ = suffix_array(text, window)
    lcp = common_prefixes(text, sa, window)
    asked = np.zeros(len(text), bool)
    asked[starts] = True
    number = np.cumsum(lcp[sa] < window)
    keep = asked[sa]
    return sa[keep], number[keep]


def window_bytes(text: np.ndarray, starts: np.ndarray, window: int) -> np.ndarray:
    return np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(text, window)[starts]).view(f"S{window}").ravel()


def smallest_documents(data: np.ndarray, begin: np.ndarray, count: np.ndarray, doc: np.ndarray, gram: np.ndarray, window: int, limit: int = SUFFIX_BYTES) -> np.ndarray:
    """Pieces of text: where each begins in data, its number of windows, its document and its gram. For every window,
    in the order of the pieces, the smallest document that holds an equal one.

    Pieces of one gram go to one suffix array, unless they are longer than `limit`: then to several, which are merged.
    """
    size = count + window - 1
    order = np.argsort(gram, kind="stable")
    g, at = gram[order], np.cumsum(size[order]) - size[order]
    head = np.concatenate(([True], g[1:] != g[:-1])) if len(g) else np.zeros(0, bool)
    part = at[head][np.cumsum(head) - 1] // limit if len(g) else at  # the part in which the gram's first piece lies
    first = np.cumsum(count) - count
    out = np.empty(int(count.sum()), np.int64)
    edges = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1], [True]))) if len(part) else np.zeros(1, np.int64)
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
        p = order[a:b]
        out[spread_out(first[p], count[p])] = _least_of_part(data, begin[p], count[p], doc[p], window, limit)
    return out


def _least_of_part(data: np.ndarray, begin: np.ndarray, count: np.ndarray, doc: np.ndarray, window: int, limit: int) -> np.ndarray:
    size = count + window - 1
    part = np.maximum(np.cumsum(size) - size, 0) // (2 * limit)
    edges = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1], [True])))
    shards = []
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
        text = data[spread_out(begin[a:b], size[a:b])]
        starts = spread_out(np.cumsum(size[a:b]) - size[a:b], count[a:b])
        owner = np.repeat(doc[a:b], count[a:b])
        slot = np.empty(len(text), np.int64)
        slot[starts] = np.arange(len(starts))
        order, group = window_groups(text, starts, window)
        new = np.concatenate(([True], group[1:] != group[:-1]))
        edge = np.flatnonzero(new)
        least = np.minimum.reduceat(owner[slot[order]], edge)
        shards.append((text, order[edge], least, slot[order], np.cumsum(new) - 1))
    if len(shards) == 1:
        _, _, least, slots, number = shards[0]
        out = np.empty(len(slots), np.int64)
        out[slots] = least[number]
        return out
    # the sorted windows of all shards so far; the next shard's are found in them by binary search
    held, held_least = np.zeros(0, f"S{window}"), np.zeros(0, np.int64)
    for text, first, least, _, _ in shards:
        own = window_bytes(text, first, window)
        at = np.searchsorted(held, own)
        same = np.zeros(len(own), bool)
        inside = at < len(held)
        same[inside] = held[at[inside]] == own[inside]
        held_least[at[same]] = np.minimum(held_least[at[same]], least[same])
        held = np.insert(held, at[~same], own[~same])
        held_least = np.insert(held_least, at[~same], least[~same])
    out = []
    for text, first, _, slots, number in shards:
        least = held_least[np.searchsorted(held, window_bytes(text, first, window))]
        part_out = np.empty(len(slots), np.int64)
        part_out[slots] = least[number]
        out.append(part_out)
    return np.concatenate(out)


# --- shards of documents -------------------------------------------------------------------------------------------


def sorted_by(first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that brings equal pairs together, and where each of them begins in it. The second keys are looked at only
    where first ones are equal: as these are hashes, they hardly ever differ there."""
    order = np.argsort(first)
    a, b = first[order], second[order]
    same = a[1:] == a[:-1]
    if (same & (b[1:] != b[:-1])).any():
        order = np.lexsort((second, first))
        a, b = first[order], second[order]
        same = (a[1:] == a[:-1]) & (b[1:] == b[:-1])
    return order, np.flatnonzero(np.concatenate(([True], ~same))) if len(order) else np.zeros(0, np.int64)


class Entries:
    """Pieces of a shard's text that may repeat elsewhere, equal ones grouped: runs, or windows of runs that very many
    shards hold. A group is dealt by its run's gram, a single window by its content."""

    def __init__(self, shard: Shard, told: pa.Table, window: int, buckets: int):
        runs = Runs(shard, window, buckets)
        yes, hot = read_answers(told, runs.keys)
        yes, hot = (yes[runs.number], hot[runs.number]) if len(runs.number) else (np.zeros(0, bool),) * 2
        whole, split = yes & ~hot, yes & hot
        start = np.concatenate([runs.first[whole], spread_out(runs.first[split], runs.count[split])])
        count = np.concatenate([runs.count[whole], np.ones(int(runs.count[split].sum()), np.int64)])
        route = np.concatenate([runs.h[whole], np.zeros(len(start) - int(whole.sum()), np.uint64)])
        single = np.arange(len(start)) >= int(whole.sum())
        order = np.argsort(start, kind="stable")
        self.start, self.count, route, single = start[order], count[order], route[order], single[order]
        self.doc = shard.ids[np.searchsorted(shard.offsets, self.start, "right") - 1] if len(start) else np.zeros(0, np.int64)
        content = string_hashes(_VALUES[shard.data], self.start, self.start + self.count + window - 1, 1) if len(start) else np.zeros(0, np.uint64)
        route[single] = content[single]
        second = content.copy()  # of single windows, which are dealt by the first hash, another one tells them apart
        if single.any():
            at = self.start[single]
            second[single] = string_hashes(_SECOND_VALUES[shard.data], at, at + window, 2)
        order, edge = sorted_by(content, second)
        self.group = np.empty(len(order), np.int64)
        self.group[order] = np.repeat(np.arange(len(edge)), np.diff(np.append(edge, len(order))))
        # of each group, the entry of its smallest document: entries are in the order of documents
        self.first = np.minimum.reduceat(order, edge) if len(edge) else edge
        key = bucketed(route[self.first], buckets)
        self.bucket = (key >> np.uint64(LOW)).astype(np.int64)
        self.order = np.argsort(self.bucket, kind="stable")  # of groups, as they are sent
        self.edges = bucket_edges(self.bucket[self.order])
        self.gram, self.content = key & LOW_MASK, second[self.first] & LOW_MASK
        self.data, self.window = shard.data, window

    def contents(self, shard: int) -> pa.Table:
        """Each group's gram, content and smallest document."""
        blobs = []
        for a, b in zip(self.edges[:-1].tolist(), self.edges[1:].tolist()):
            g = self.order[a:b]
            blobs.append(struct.pack("<I", b - a) + low_bytes(self.gram[g]) + low_bytes(self.content[g]) + self.doc[self.first[g]].astype("<i8").tobytes())
        return blob_rows(shard, self.bucket[self.order[self.edges[:-1]]] if blobs else [], blobs)

    def read(self, told: pa.Table) -> None:
        """later: an earlier document elsewhere has the group's content. open: other contents hold the gram."""
        keys = self.bucket[self.order].astype(np.uint64) << np.uint64(LOW)
        later, open_ = read_answers(told, keys)
        self.later, self.open = np.empty(len(keys), bool), np.empty(len(keys), bool)
        self.later[self.order], self.open[self.order] = later, open_

    def pieces(self, shard: int) -> pa.Table:
        """The texts of open groups."""
        order = self.order[self.open[self.order]]
        edges = bucket_edges(self.bucket[order])
        blobs = []
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
            g = order[a:b]
            e = self.first[g]
            text = self.data[spread_out(self.start[e], self.count[e] + self.window - 1)]
            blobs.append(struct.pack("<I", b - a) + g.astype("<u4").tobytes() + self.doc[e].astype("<i8").tobytes() + low_bytes(self.gram[g]) + self.count[e].astype(np.uint8).tobytes() + text.tobytes())
        return blob_rows(shard, self.bucket[order[edges[:-1]]] if blobs else [], blobs)

    def hits(self, told: pa.Table) -> np.ndarray:
        """Starts of the windows that an earlier document has."""
        mask = np.zeros(len(self.first), np.uint32)
        for raw in told["blob"].to_pylist():
            n = struct.unpack_from("<I", raw)[0]
            mask[np.frombuffer(raw, "<u4", n, 4)] = np.frombuffer(raw, "<u4", n, 4 + 4 * n)
        mask[self.later] = 0xFFFFFFFF
        own = mask[self.group]
        own[self.doc > self.doc[self.first[self.group]]] = 0xFFFFFFFF
        some = own > 0
        count, start = self.count[some], self.start[some]
        window = spread_out(np.zeros(len(count), np.int64), count)
        hit = (np.repeat(own[some], count) >> window.astype(np.uint32)) & 1
        return (np.repeat(start, count) + window)[hit.astype(bool)]


class Runs:
    def __init__(self, shard: Shard, window: int, buckets: int):
        ends = np.repeat(shard.offsets[1:], np.diff(shard.offsets))
        self.first, self.count, self.h, _ = window_runs(len(shard.data), lambda a, b: gram_hashes(shard.data, a, b), ends, window, GRAM)
        key = bucketed(self.h, buckets)
        order, edge, self.number = groups(key)
        self.keys = key[order][edge]
        doc = shard.ids[np.searchsorted(shard.offsets, self.first, "right") - 1][order] if len(key) else np.zeros(0, np.int64)
        self.shared = np.minimum.reduceat(doc, edge) != np.maximum.reduceat(doc, edge) if len(edge) else np.zeros(0, bool)


def compare_contents(table: pa.Table) -> pa.Table:
    """Contents of all shards in one bucket. Of each: whether an earlier document has it, and, where none has, whether
    other contents hold its gram, so that its text has to be compared."""
    raw = table["blob"].to_pylist()
    sizes = [struct.unpack_from("<I", r)[0] for r in raw]
    width = LOW // 8
    gram = np.concatenate([low_numbers(r, n, 4) for r, n in zip(raw, sizes)])
    content = np.concatenate([low_numbers(r, n, 4 + width * n) for r, n in zip(raw, sizes)])
    doc = np.concatenate([np.frombuffer(r, "<i8", n, 4 + 2 * width * n) for r, n in zip(raw, sizes)])
    order, edge = sorted_by(gram << np.uint64(24) | content >> np.uint64(16), content)
    g = gram[order]
    new_gram = np.concatenate(([True], g[1:] != g[:-1]))
    new = np.zeros(len(order), bool)
    new[edge] = True
    least = np.repeat(np.minimum.reduceat(doc[order], edge), np.diff(np.append(edge, len(order))))
    several = np.add.reduceat(new.astype(np.int64), np.flatnonzero(new_gram)) > 1
    later, open_ = np.empty(len(order), bool), np.empty(len(order), bool)
    later[order] = doc[order] > least
    open_[order] = several[np.cumsum(new_gram) - 1]
    open_ &= ~later
    blobs, at = [], 0
    for n in sizes:
        blobs.append(np.packbits(later[at : at + n]).tobytes() + np.packbits(open_[at : at + n]).tobytes())
        at += n
    return pa.table({"shard": table["shard"], "bucket": table["bucket"], "blob": pa.array(blobs, pa.binary())})


def compare_pieces(table: pa.Table, window: int, limit: int) -> pa.Table:
    """Pieces of all shards in one bucket; answers with a mask of windows to remove for each piece."""
    raw = table["blob"].to_pylist()
    sizes = [struct.unpack_from("<I", r)[0] for r in raw]
    who = [np.frombuffer(r, "<u4", n, 4) for r, n in zip(raw, sizes)]
    doc = np.concatenate([np.frombuffer(r, "<i8", n, 4 + 4 * n) for r, n in zip(raw, sizes)])
    gram = np.concatenate([low_numbers(r, n, 4 + 12 * n) for r, n in zip(raw, sizes)])
    at = 12 + LOW // 8
    count = np.concatenate([np.frombuffer(r, np.uint8, n, 4 + at * n) for r, n in zip(raw, sizes)]).astype(np.int64)
    data = np.concatenate([np.frombuffer(r, np.uint8, -1, 4 + (at + 1) * n) for r, n in zip(raw, sizes)])
    size = count + window - 1
    least = smallest_documents(data, np.cumsum(size) - size, count, doc, gram, window, limit)
    place = spread_out(np.zeros(len(count), np.int64), count)
    gone = least < np.repeat(doc, count)
    mask = np.add.reduceat(gone.astype(np.int64) << place, np.cumsum(count) - count).astype(np.uint32)
    blobs, at = [], 0
    for w in who:
        blobs.append(struct.pack("<I", len(w)) + w.tobytes() + mask[at : at + len(w)].astype("<u4").tobytes())
        at += len(w)
    return pa.table({"shard": table["shard"], "bucket": table["bucket"], "blob": pa.array(blobs, pa.binary())})


def earlier_substrings(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, shard_bytes: int = SHARD_BYTES, many: int = MANY, suffix_bytes: int = SUFFIX_BYTES
) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (binary: the bytes that stay)."""
    if not GRAM <= window < GRAM + 32:
        raise ValueError(f"window: {GRAM} to {GRAM + 31} bytes")
    sharded, buckets = shard_documents(docs, id_col, text_col, shard_bytes)
    by_shard = sharded.groupBy("shard")
    out = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary())])

    def level(table: pa.Table, n: int) -> pa.Table:
        return table.filter(pc.equal(table["level"], n))

    def send_keys(table: pa.Table) -> pa.Table:
        runs = Runs(Shard(table), window, buckets)
        return key_rows(table["shard"][0].as_py(), runs.keys, runs.shared)

    def send_contents(table: pa.Table, told: pa.Table) -> pa.Table:
        if not len(table):
            return no_keys()
        return Entries(Shard(table), told, window, buckets).contents(table["shard"][0].as_py())

    def send_pieces(table: pa.Table, told: pa.Table) -> pa.Table:
        if not len(table):
            return no_keys()
        found = Entries(Shard(table), level(told, 1), window, buckets)
        found.read(level(told, 2))
        return found.pieces(table["shard"][0].as_py())

    def finish(table: pa.Table, told: pa.Table) -> pa.Table:
        if not len(table):
            return out.empty_table()
        shard = Shard(table)
        found = Entries(shard, level(told, 1), window, buckets)
        found.read(level(told, 2))
        gone = covered(found.hits(level(told, 3)), window, len(shard.data))
        n_removed, n_spans, kept = [], [], []
        for a, b in zip(shard.offsets[:-1].tolist(), shard.offsets[1:].tolist()):
            g = gone[a:b]
            n_removed.append(int(g.sum()))
            n_spans.append(int(np.count_nonzero(g[1:] & ~g[:-1])) + int(g[:1].sum()))
            kept.append((shard.data[a:b][~g] if n_removed[-1] else shard.data[a:b]).tobytes())
        return pa.table([pa.array(shard.ids), pa.array(np.diff(shard.offsets)), pa.array(n_removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(kept, pa.binary())], schema=out)

    def in_buckets(rows: DataFrame, compare) -> DataFrame:
        return rows.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(compare, KEYS)

    def numbered(rows: DataFrame, n: int) -> DataFrame:
        return rows.withColumn("level", F.lit(n))

    known = repeated(by_shard.applyInArrow(send_keys, KEYS), buckets, many=many)
    settled = in_buckets(by_shard.cogroup(known.groupBy("shard")).applyInArrow(send_contents, KEYS), compare_contents)
    told = numbered(known, 1).unionByName(numbered(settled, 2))
    pieces = by_shard.cogroup(told.groupBy("shard")).applyInArrow(send_pieces, KEYS)
    told = told.unionByName(numbered(in_buckets(pieces, lambda t: compare_pieces(t, window, suffix_bytes)), 3))
    done = by_shard.cogroup(told.groupBy("shard")).applyInArrow(finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
    return done.withColumn("doc_id", given_id(F.col("doc_id")))


def op2_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = earlier_substrings(documents(spark, sf_dir))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


#: Windows of 50 bytes by the MD5 of their hexadecimal digits, hits merged to spans, and what lies between these, in DuckDB.
ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, strlen(coalesce(text, '')) AS n, hex(encode(coalesce(text, ''))) AS h FROM documents),
c AS (SELECT r, doc_id, b, substr(h, 2 * b + 1, 2098) AS part FROM (SELECT r, doc_id, h, unnest(range(0, n, 1000)) AS b FROM d)),
win AS (SELECT r, doc_id, b + i AS p, md5(substr(part, 2 * i + 1, 100)) AS s FROM (SELECT *, unnest(range(0, 1000)) AS i FROM c) WHERE strlen(part) >= 2 * i + 100),
hit AS (SELECT r, p FROM (SELECT r, p, doc_id, min(doc_id) OVER (PARTITION BY s) AS least FROM win) WHERE least < doc_id),
island AS (SELECT r, min(p) AS a, max(p) + 50 AS b FROM (SELECT r, p, sum(new) OVER (PARTITION BY r ORDER BY p) AS g
  FROM (SELECT r, p, CASE WHEN p - lag(p) OVER (PARTITION BY r ORDER BY p) <= 50 THEN 0 ELSE 1 END AS new FROM hit)) GROUP BY r, g),
piece AS (SELECT r, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS x, a AS y FROM island UNION ALL SELECT r, coalesce(b, 0), n FROM d LEFT JOIN (SELECT r, max(b) AS b FROM island GROUP BY r) USING (r)),
kept AS (SELECT r, sum(y - x) AS left, string_agg(substr(h, 2 * x + 1, 2 * (y - x)), '' ORDER BY x) AS hex FROM piece JOIN d USING (r) GROUP BY r),
spans AS (SELECT r, count(*) AS n_spans FROM island GROUP BY r)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(n - kept.left AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(hex)) AS kept_sha256
FROM d JOIN kept USING (r) LEFT JOIN spans USING (r)
"""
