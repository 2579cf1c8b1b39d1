"""SimHash near-dedup with deletion-variant signatures.

A 64-bit fingerprint is cut into two segments, so that of two fingerprints at most 3 bits apart one segment differs by
at most one bit. Each segment is indexed in 32 variants with one bit deleted; equal variants are joined by sorting, and
every pair is verified by its distance. A pair counts under one variant only: the first segment that differs by at most
one bit, with that bit (or bit 0) deleted. Only distinct fingerprints are indexed, so copies cost nothing. Where more
than `crowd` fingerprints share a variant, their links come from signatures of the whole fingerprint with two bits
deleted instead: all that share one are within two bits of each other and link to the smallest, so a crowd of any size
gives rows in proportion to its size, and no link is lost. Links then merge into components.

Words are runs without ASCII white space, ASCII letters lower-cased; a shingle is `shingle` words joined by a space (a
shorter text is one shingle); a bit is 1 if it is set in over half of the shingles' XXH64 values, repeats included.

Defined cases: null, empty and blank texts have fingerprint 0, linked like any other; a null id is larger than all
others in components and comes back as null; repeated rows of one id stay rows; an empty table gives no rows. Extra
columns are ignored, except by keep_one, which returns them whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from waypath.llm.common import checkpoint, documents, filter_by_ids, give_back, given_id, map_texts, ordered_id, shard_documents
from waypath.llm.components import components
from waypath.llm.exchange import KEYS, bucketed, groups, key_rows, mix, read_answers, repeated

SHINGLE = 3
MAX_BITS = 2
CROWD = 2048
_SEED = 42


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, _SEED)
    end = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *end[: -shingle].tolist()]
    h = xxhash.xxh64_intdigest
    values = [h(joined[a:b], _SEED) for a, b in zip(starts, (end[shingle - 1 :] - 1).tolist())]
    return majority(np.array(values, dtype=np.uint64))


def majority(values: np.ndarray) -> int:
    """Bits set in over half of the values. Bytes are summed as eight counters at a time."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(values), 1 << 14):
        part = values[i : i + (1 << 14)].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return sum(1 << k for k in np.flatnonzero(2 * ones > len(values)).tolist())


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp): fp as a signed long."""
    d = docs.select(ordered_id(F.col(f"`{id_col}`")).alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    make = lambda: lambda texts: [[(v := fingerprint(t, shingle)) - ((v >> 63) << 64) for t in texts]]
    return map_texts(d, "text", [T.StructField("fp", T.LongType())], make, ["doc_id"])


def variants(fps: DataFrame) -> DataFrame:
    """(key, fp, ...): 64 rows a fingerprint, with its other columns. key: number of the deleted bit, then its segment without that bit."""
    low = lambda k: F.shiftrightunsigned("fp", 32 * (k // 32)).bitwiseAND(F.lit(0xFFFFFFFF & ~(1 << (k % 32))))
    keys = F.array(*[F.lit(k << 32).bitwiseOR(low(k)) for k in range(64)])
    return fps.select(F.explode(keys).alias("key"), "fp", *[c for c in fps.columns if c != "fp"])


def _verified(key: np.ndarray, fp: np.ndarray, i: np.ndarray, j: np.ndarray, max_bits: int) -> np.ndarray:
    """Whether pairs i, j of one key are links that count under this key."""
    x = fp[i] ^ fp[j]
    bit = (key[i] >> np.uint64(32)).astype(np.uint64)
    second = bit >= 32
    own = np.where(second, x >> np.uint64(32), x & np.uint64(0xFFFFFFFF))
    first_far = np.bitwise_count(x & np.uint64(0xFFFFFFFF)) > 1
    place = (np.uint64(1) << (bit & np.uint64(31))).astype(np.uint64)
    counts_here = ((own == 0) & ((bit & np.uint64(31)) == 0)) | (own == place)
    return (np.bitwise_count(x) <= max_bits) & counts_here & (~second | first_far)


def _forest(i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of the same components, at most one less than their nodes."""
    nodes, at = np.unique(np.concatenate([i, j]), return_inverse=True)
    a, b = at[: len(i)], at[len(i) :]
    label = np.arange(len(nodes))
    while True:
        new = label.copy()
        np.minimum.at(new, a, label[b])
        np.minimum.at(new, b, label[a])
        new = new[new]
        if (new == label).all():
            break
        label = new
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def _batch(a: np.ndarray, b: np.ndarray, crowded: np.ndarray) -> pa.RecordBatch:
    """Links (a, b), then (x, null) for each x of crowded."""
    n = len(a) + len(crowded)
    left = pa.array(np.concatenate([a, crowded]).view(np.int64))
    right = pa.array(np.concatenate([b, crowded]).view(np.int64), mask=np.arange(n) >= len(a))
    return pa.RecordBatch.from_arrays([left, right], names=["a", "b"])


def _links(key: np.ndarray, fp: np.ndarray, node: np.ndarray, max_bits: int, crowd: int, forest: bool) -> pa.RecordBatch:
    edge = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1], [True])))
    size = np.repeat(np.diff(edge), np.diff(edge))
    crowded = size > crowd
    place = np.arange(len(key)) - np.repeat(edge[:-1], np.diff(edge))
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    rest = np.flatnonzero((size > 1) & ~crowded)
    for off in range(1, crowd):
        rest = rest[place[rest] + off < size[rest]]
        if not len(rest):
            break
        ok = _verified(key, fp, rest, rest + off, max_bits)
        left.append(rest[ok])
        right.append(rest[ok] + off)
    a, b = np.concatenate(left), np.concatenate(right)
    if forest and len(a):
        a, b = _forest(a, b)
    return _batch(node[a], node[b], node[crowded])


def _grown(batches: Iterator[pa.RecordBatch], least: int = 1 << 15) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of `least` rows or more."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        held.append(b)
        if sum(x.num_rows for x in held) >= least:
            yield pa.concat_batches(held)
            held = []
    if held:
        yield pa.concat_batches(held)
    give_back()


def _join(batches: Iterator[pa.RecordBatch], max_bits: int, crowd: int, forest: bool = True) -> Iterator[pa.RecordBatch]:
    """Batches (key, fp[, node]) sorted by key. Yields (a, b) links of nodes, and (a, null) for those of crowded keys.

    forest: as few links as have the same components; else all. No more than a batch and a crowd is held.
    """
    held = [np.zeros(0, np.uint64)] * 3
    passed = None  # key of a crowd that is being passed on
    for batch in _grown(batches):
        columns = [batch.column(min(i, batch.num_columns - 1)).to_numpy().view(np.uint64) for i in range(3)]
        held = [np.concatenate([h, c]) for h, c in zip(held, columns)]
        if passed is not None:
            n = int(np.searchsorted(held[0], passed, "right"))
            if n:
                yield _batch(held[2][:0], held[2][:0], held[2][:n])
                held = [h[n:] for h in held]
        if not len(held[0]):
            continue
        cut = int(np.searchsorted(held[0], held[0][-1]))  # the last key may go on in the next batch
        passed = None
        if cut:
            yield _links(*[h[:cut] for h in held], max_bits, crowd, forest)
            held = [h[cut:] for h in held]
        if len(held[0]) > crowd:
            passed = held[0][-1]
            yield _batch(held[2][:0], held[2][:0], held[2])
            held = [h[:0] for h in held]
    if len(held[0]):
        yield _links(*held, max_bits, crowd, forest)


def links_of(fps: DataFrame, max_bits: int = MAX_BITS, crowd: int = CROWD) -> DataFrame:
    """fps: distinct (fp). Links (a, b) that have the components of all pairs within max_bits bits."""
    if max_bits > 2 and crowd < 1 << 62 or max_bits > 3:
        raise ValueError("two segments with one deleted bit, and crowds, hold for 2 bits at most")
    indexed = variants(fps).repartition("key").sortWithinPartitions("key")
    found = checkpoint(indexed.mapInArrow(lambda b: _join(b, max_bits, crowd), "a long, b long"))
    links = found.where("b IS NOT NULL")
    crowded = found.where("b IS NULL").select(F.col("a").alias("fp")).distinct()
    if crowded.limit(1).count():
        pairs = F.array(*[F.lit((1 << i) | (1 << j) if j < 63 else ((1 << i) | (1 << j)) - (1 << 64)) for i in range(64) for j in range(i + 1, 64)])
        masked = crowded.select("fp", F.posexplode(pairs).alias("n", "mask")).select("fp", "n", F.col("fp").bitwiseAND(F.bitwise_not("mask")).alias("rest"))
        least = masked.groupBy("n", "rest").agg(F.min("fp").alias("b"), F.max("fp").alias("top")).where("b < top").drop("top")
        links = links.unionByName(masked.join(least, ["n", "rest"]).where("fp <> b").select(F.col("fp").alias("a"), "b").distinct())
    return links


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, max_bits: int = MAX_BITS, crowd: int = CROWD) -> DataFrame:
    """(doc_id, fp, component_id): component_id is the smallest doc_id reachable over links."""
    marked = checkpoint(fingerprints(docs, id_col, text_col, shingle))
    classes = marked.groupBy("fp").agg(F.min("doc_id").alias("first"))
    linked = components(links_of(classes.select("fp"), max_bits, crowd))
    roots = classes.join(linked.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    of_root = roots.groupBy("root").agg(F.min("first").alias("component_id"))
    of_fp = roots.join(of_root, "root").select("fp", "component_id")
    return marked.join(of_fp, "fp").select(given_id(F.col("doc_id")).alias("doc_id"), "fp", given_id(F.col("component_id")).alias("component_id"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_classes(documents(spark, sf_dir))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# --- near copies by similarity --------------------------------------------------------------------------------------

SIMILARITY = 0.8
SIMILAR_SHINGLE = 5
#: UTF-8 bytes of a shard of distinct texts.
SIMILAR_SHARD_BYTES = 8_000_000
#: Shingles that more shards than this hold come last in the order of shingles.
COMMON = 64
#: Texts of one shingle that are compared in one group; larger lists are cut into blocks, of which each two meet.
BLOCK = 256
#: Counts of shingles by hash, of which two texts' bound what they can share.
OUTLINE = 128


def _normal(text: str | None) -> tuple[int, list[bytes]]:
    """Hash of the normalised text, and its words."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    whole = xxhash.xxh64_intdigest(b" ".join(words), _SEED)
    return whole - ((whole >> 63) << 64), words


def _shingle_hashes(words: list[bytes], shingle: int) -> np.ndarray:
    """Distinct hashes of the shingles."""
    h = xxhash.xxh64_intdigest
    values = np.array([h(w, _SEED) for w in words], dtype=np.uint64)
    if not len(values):
        return values
    n = max(1, len(values) - shingle + 1)
    x = np.zeros(n, np.uint64)
    for k in range(min(shingle, len(values))):
        x = mix(x * np.uint64(0x9E3779B97F4A7C15) + values[k : k + n])
    return np.unique(x)


def _classes(docs: DataFrame, fingerprinted: bool) -> DataFrame:
    """(doc_id, cls, fp): a hash of the normalised text, and its fingerprint (null, if not fingerprinted)."""
    print_of = lambda t: (v := fingerprint(t)) - ((v >> 63) << 64) if fingerprinted else None
    make = lambda: lambda texts: [[_normal(t)[0] for t in texts], [print_of(t) for t in texts]]
    return map_texts(docs, "text", [T.StructField("cls", T.LongType()), T.StructField("fp", T.LongType())], make, ["doc_id"])


def fingerprint_links(classes: DataFrame, max_bits: int = MAX_BITS, crowd: int = CROWD) -> DataFrame:
    """classes: (cls, fp). Links (a, b) of classes that have the components of all pairs of fingerprints within max_bits bits."""
    heads = checkpoint(classes.groupBy("fp").agg(F.min("cls").alias("head")))
    equal = classes.join(heads, "fp").where("cls <> head").select(F.col("cls").alias("a"), F.col("head").alias("b"))
    near = links_of(heads.select("fp"), max_bits, crowd)
    for end in ("a", "b"):
        near = near.join(heads.select(F.col("fp").alias(end), F.col("head").alias(f"{end}_head")), end)
    return checkpoint(equal.unionByName(near.select(F.col("a_head").alias("a"), F.col("b_head").alias("b"))))


class _Shingles:
    """The distinct shingles of each text of a shard, as bucketed keys."""

    def __init__(self, table: pa.Table, shingle: int, buckets: int):
        found = [_normal(t) for t in table["text"].to_pylist()]
        self.cls = np.array([c for c, _ in found], dtype=np.int64)
        self.hashes = [_shingle_hashes(w, shingle) for _, w in found]
        keys = [np.unique(bucketed(h, buckets)) for h in self.hashes]
        self.size = np.array([len(k) for k in keys], dtype=np.int64)
        self.text = np.repeat(np.arange(len(keys)), self.size)
        self.all = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
        self.order, self.first, self.number = groups(self.all)
        self.keys = self.all[self.order][self.first]

    def shared(self) -> np.ndarray:
        """Whether two classes hold the key."""
        c = self.cls[self.text][self.order]
        return np.minimum.reduceat(c, self.first) != np.maximum.reduceat(c, self.first) if len(self.first) else np.zeros(0, bool)


def _least_shared(size: np.ndarray | int, similarity: float) -> np.ndarray:
    """Shingles that a text of so many shares at least with one of the similarity."""
    return np.ceil(similarity * np.asarray(size) - 1e-9).astype(np.int64)


def _prefixes(table: pa.Table, told: pa.Table, shingle: int, buckets: int, similarity: float) -> pa.Table:
    """Of each text that may have a near copy: its size, how many of its shingles no other text has, and those others
    do have among the first `size - least + 1` in the common order (unshared, shared, common ones, each by key)."""
    s = _Shingles(table, shingle, buckets)
    yes, hot = read_answers(told, s.keys)
    rank = (yes.astype(np.int64) + hot)[s.number] if len(s.keys) else np.zeros(0, np.int64)
    order = np.lexsort((s.all, rank, s.text))
    key, rank = s.all[order], rank[order]
    end = np.cumsum(s.size)
    out: list[tuple] = []
    for i, (e, n) in enumerate(zip(end.tolist(), s.size.tolist())):
        alone = int(np.count_nonzero(rank[e - n : e] == 0))
        length = n - int(_least_shared(n, similarity)) + 1
        if n and alone < length:
            h = s.hashes[i]
            odd = np.packbits(np.bincount((h >> np.uint64(48)).astype(np.int64) % (64 * len(PARITY)), minlength=64 * len(PARITY)) & 1).view(np.int64)
            outline = np.minimum(np.bincount((h & np.uint64(0xFFFFFFFF)) % np.uint64(OUTLINE), minlength=OUTLINE), 65535).astype("<u2")
            out.append((int(s.cls[i]), n, alone, key[e - n + alone : e - n + length].astype(np.int64), np.unique(h.astype(np.uint32)).tobytes(), outline.tobytes(), *odd.tolist()))
    return pa.table([pa.array(v, f.type) for v, f in zip(zip(*out) if out else [[]] * len(PREFIXES), PREFIXES)], schema=PREFIXES)


#: 256 bits, each odd if an odd number of a text's shingles fall on it: two texts differ in as many shingles as in bits at least.
PARITY = ("odd0", "odd1", "odd2", "odd3")
PREFIXES = pa.schema([("cls", pa.int64()), ("n", pa.int64()), ("alone", pa.int64()), ("tokens", pa.list_(pa.int64())), ("shingles", pa.binary()), ("outline", pa.binary()), *[(c, pa.int64()) for c in PARITY]])


def _chosen(pairs: DataFrame, test: Callable[[bytes, bytes], bool]) -> DataFrame:
    """pairs (a, b, x, y) of which x and y pass the test."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [test(x, y) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def _outlines_fit(x: bytes, y: bytes, similarity: float) -> bool:
    """Whether texts of these outlines can be of the similarity: of each count they share the smaller at most.

    A count that fills its 16 bits says nothing.
    """
    u, v = np.frombuffer(x, "<u2").astype(np.int64), np.frombuffer(y, "<u2").astype(np.int64)
    least = int(np.minimum(u, v).sum())
    return max(u.max(), v.max()) == 65535 or least >= similarity * (int(u.sum()) + int(v.sum()) - least) - 1e-3 * least


def jaccard(x: bytes, y: bytes) -> float:
    """Of two sets of 32-bit numbers; empty sets are alike."""
    u, v = np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32)
    union = len(np.unique(np.concatenate([u, v])))
    return (len(u) + len(v) - union) / union if union else 1.0


def _beside(pairs: DataFrame, sets: DataFrame, column: str) -> DataFrame:
    """pairs (a, b) with `column` of both classes as x and y."""
    return pairs.join(sets.select(F.col("cls").alias("a"), F.col(column).alias("x")), "a").join(sets.select(F.col("cls").alias("b"), F.col(column).alias("y")), "b")


def _verified_pairs(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    pairs = checkpoint(_chosen(_beside(pairs, sets, "outline"), lambda x, y: _outlines_fit(x, y, similarity)))
    return checkpoint(_chosen(_beside(pairs, sets, "shingles"), lambda x, y: jaccard(x, y) >= similarity))


def _with_heads(lists: DataFrame, links: DataFrame | None, by) -> DataFrame:
    """Rows of shingles whose texts are not all in one component yet: with root, the head (least by `by`) of the
    shingle's texts and the number of these."""
    if links is None:
        lists = lists.withColumn("root", F.col("cls"))
    else:
        linked = components(links).select(F.col("node").alias("cls"), F.col("root").alias("r"))
        lists = lists.join(linked, "cls", "left").withColumn("root", F.coalesce("r", "cls")).drop("r")
    heads = lists.groupBy("token").agg(F.min(F.struct(by.alias("by"), "cls", "n", "at", "root")).alias("head"), F.count("*").alias("m"), F.min("root").alias("low"), F.max("root").alias("high"))
    return lists.join(heads.where("low < high").drop("low", "high"), "token")


def _can_share(n: str, at: str, other_n: str, other_at: str, similarity: float):
    """Whether two texts can be of the similarity if the first shingle they share is at these places of their order."""
    return F.least(F.col(n) - F.col(at), F.col(other_n) - F.col(other_at)) >= similarity / (1 + similarity) * (F.col(n) + F.col(other_n)) - 1e-6


def _to_heads(lists: DataFrame, similarity: float) -> DataFrame:
    pairs = lists.where(F.col("root") != F.col("head.root")).where(_can_share("n", "at", "head.n", "head.at", similarity))
    return pairs.select(F.least("cls", "head.cls").alias("a"), F.greatest("cls", "head.cls").alias("b")).distinct()


def _cross(batches: Iterator[pa.RecordBatch], similarity: float, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Batches (group, cross, part, cls, root, n, at, parity bits) sorted by group. Yields pairs (a, b) of a group's texts of
    two roots that can be of the similarity; in groups of two blocks (cross), only those of different ones."""

    def pairs(c: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        key, cross, part, cls, root, n, at, *odd = c
        edge = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1], [True])))
        end = np.repeat(edge[1:], np.diff(edge))
        rest, off, held, count = np.arange(len(key)), 0, [], 0
        while True:
            off += 1
            rest = rest[rest + off < end[rest]]
            if len(rest):
                j = rest + off
                ok = (root[rest] != root[j]) & ((cross[rest] == 0) | (part[rest] != part[j]))
                ok &= np.minimum(n[rest] - at[rest], n[j] - at[j]) >= similarity / (1 + similarity) * (n[rest] + n[j]) - 1e-6
                i, j = rest[ok], j[ok]
                differ = sum(np.bitwise_count((x[i] ^ x[j]).view(np.uint64)).astype(np.int64) for x in odd)
                ok = differ <= ((1 - similarity) / (1 + similarity) + 1e-3) * (n[i] + n[j])
                a, b = cls[i[ok]], cls[j[ok]]
                held.append(np.stack([np.minimum(a, b), np.maximum(a, b)], 1))
                count += len(a)
            if count and (count >= most or not len(rest)):
                both = np.unique(np.concatenate(held), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy())], names=["a", "b"])
                held, count = [], 0
            if not len(rest):
                return

    held = [np.zeros(0, np.int64)] * (7 + len(PARITY))
    for batch in _grown(batches):
        held = [np.concatenate([h, batch.column(i).to_numpy()]) for i, h in enumerate(held)]
        cut = int(np.flatnonzero(held[0] != held[0][-1])[-1]) + 1 if (held[0] != held[0][-1]).any() else 0  # the last group may go on
        if cut:
            yield from pairs([h[:cut] for h in held])
            held = [h[cut:] for h in held]
    if len(held[0]):
        yield from pairs(held)


def _all_pairs(lists: DataFrame, similarity: float, block: int) -> DataFrame:
    blocks = F.ceil(F.col("m") / block).cast("long")
    part = lists.withColumn("blocks", blocks).withColumn("part", F.pmod(F.xxhash64("cls"), "blocks"))
    met = part.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    low, high = F.least("part", "other"), F.greatest("part", "other")
    # a group is told by a hash; two of one hash only give candidates more
    dealt = met.select(F.xxhash64("token", low, high).alias("group"), (low != high).cast("long").alias("cross"), "part", "cls", "root", "n", "at", *PARITY)
    return dealt.repartition("group").sortWithinPartitions("group", "cls").mapInArrow(lambda b: _cross(b, similarity), "a long, b long").distinct()


def similar_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SIMILAR_SHINGLE, similarity: float = SIMILARITY,
    shard_bytes: int = SIMILAR_SHARD_BYTES, common: int = COMMON, block: int = BLOCK, max_bits: int | None = None, crowd: int = CROWD,
) -> DataFrame:
    """(doc_id, kept): kept is the smallest doc_id of the document's group of near copies.

    Equal texts (up to case and white space) are one class. With max_bits, classes whose fingerprints differ in so many
    bits or fewer link first, as in near_classes, by deletion variants. Classes whose sets of `shingle`-word shingles are of the
    similarity or more link too, and links merge into groups. All such pairs meet (prefix filtering): with the shingles of
    every text in one order, shingles of a single text first, the first one that two such texts share is among the first
    `size - least + 1` of both, where least is what a text shares at least. So each class is listed under those of its
    first shingles that others have, and the texts of one list are compared: first with the list's head (the text with the
    fewest shingles of its own, then one by lot), and then, where the list is not one component yet, all pairs of different
    components, block by block.
    """
    d = docs.select(ordered_id(F.col(f"`{id_col}`")).alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    marked = checkpoint(_classes(d, max_bits is not None))
    classes = marked.groupBy("cls").agg(F.min("doc_id").alias("first"))
    links = None if max_bits is None else fingerprint_links(marked.select("cls", "fp").distinct(), max_bits, crowd)
    sharded, buckets = shard_documents(filter_by_ids(d, F.col("doc_id"), classes.select("first").distinct(), "left_semi"), "doc_id", "text", shard_bytes)
    by_shard = sharded.groupBy("shard")

    def send_keys(table: pa.Table) -> pa.Table:
        s = _Shingles(table, shingle, buckets)
        return key_rows(table["shard"][0].as_py(), s.keys, s.shared())

    def send_prefixes(table: pa.Table, told: pa.Table) -> pa.Table:
        return _prefixes(table, told, shingle, buckets, similarity) if len(table) else PREFIXES.empty_table()

    known = repeated(by_shard.applyInArrow(send_keys, KEYS), buckets, many=common)
    found = by_shard.cogroup(known.groupBy("shard")).applyInArrow(send_prefixes, "cls long, n long, alone long, tokens array<long>, shingles binary, outline binary, " + ", ".join(f"{c} long" for c in PARITY))
    sets = checkpoint(found)
    listed = sets.select("cls", "n", "alone", *PARITY, F.posexplode("tokens").alias("at", "token")).select("token", "cls", "n", "alone", (F.col("alone") + F.col("at")).alias("at"), *PARITY)
    lists = checkpoint(_with_heads(listed, links, F.struct("alone", "cls")))
    similar = _verified_pairs(_to_heads(lists, similarity), sets, similarity)
    links = similar if links is None else links.unionByName(similar)
    lists = checkpoint(_with_heads(lists.drop("root", "head", "m"), links, F.xxhash64("token", "cls")))
    links = checkpoint(links.unionByName(_verified_pairs(_to_heads(lists, similarity), sets, similarity)))
    lists = _with_heads(lists.drop("root", "head", "m"), links, F.col("cls"))
    linked = components(links.unionByName(_verified_pairs(_all_pairs(lists, similarity, block), sets, similarity)))
    roots = classes.join(linked.withColumnRenamed("node", "cls"), "cls", "left").select("cls", "first", F.coalesce("root", "cls").alias("root"))
    of_root = roots.groupBy("root").agg(F.min("first").alias("kept"))
    of_class = roots.join(of_root, "root").select("cls", "kept")
    return marked.join(of_class, "cls").select("doc_id", "kept")


def keep_one(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SIMILAR_SHINGLE, similarity: float = SIMILARITY, max_bits: int = MAX_BITS
) -> DataFrame:
    """The documents, with their columns, without those that have a near copy of a smaller id in their group.

    Near copies are documents whose fingerprints near_classes links, and those of the similarity, which fingerprints can miss.
    Of a null or repeated id, rows stay or go together.
    """
    own = ordered_id(F.col(f"`{id_col}`"))
    gone = similar_groups(docs, id_col, text_col, shingle, similarity, max_bits=max_bits).where("kept <> doc_id").select(F.col("doc_id").alias("__gone")).distinct()
    return filter_by_ids(docs, own, gone, "left_anti")
