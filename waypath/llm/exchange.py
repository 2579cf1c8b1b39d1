"""Finding keys that several shards of documents hold, without collecting or broadcasting any of them.

Each shard sends the sorted distinct keys it holds, as one blob for each bucket of keys; a bucket's task compares the
blobs and answers each with one bit a key (seen elsewhere or flagged by its shard), and one more for keys of many
shards. A key that is everywhere costs one entry a shard. Blob sizes follow the text; rows are shards times buckets.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Bits of a key kept in a blob, beside its bucket.
LOW = 40
LOW_MASK = np.uint64((1 << LOW) - 1)
KEYS = "shard int, bucket int, blob binary"


def bucketed(h: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket (from the top bits of a hash) and its low bits, as one sortable key."""
    top = h >> np.uint64(40)
    return ((top * np.uint64(buckets)) >> np.uint64(24)) << np.uint64(LOW) | (h & LOW_MASK)


def groups(keys: np.ndarray, more: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order that sorts keys (then more), first places of the distinct ones in it, and each key's group number."""
    order = np.argsort(keys, kind="stable") if more is None else np.lexsort((more, keys))
    k = keys[order]
    new = np.ones(len(k), bool)
    new[1:] = k[1:] != k[:-1]
    if more is not None:
        m = more[order]
        new[1:] |= m[1:] != m[:-1]
    number = np.empty(len(k), np.int64)
    number[order] = np.cumsum(new) - 1
    return order, np.flatnonzero(new), number


def low_bytes(v: np.ndarray) -> bytes:
    return v.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : LOW // 8].tobytes()


def low_numbers(raw: bytes, n: int, at: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    out[:, : LOW // 8] = np.frombuffer(raw, np.uint8, n * LOW // 8, at).reshape(n, -1)
    return out.view("<u8").ravel().astype(np.uint64)


def bucket_edges(bucket: np.ndarray) -> np.ndarray:
    """Where each bucket begins in a sorted array, and its end."""
    return np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1], [True]))) if len(bucket) else np.zeros(1, np.int64)


def blob_rows(shard: int, bucket, blobs: list[bytes]) -> pa.Table:
    return pa.table({"shard": pa.array([shard] * len(blobs), pa.int32()), "bucket": pa.array(bucket, pa.int32()), "blob": pa.array(blobs, pa.binary())})


def key_rows(shard: int, keys: np.ndarray, flags: np.ndarray, more: np.ndarray | None = None) -> pa.Table:
    """keys: sorted distinct bucketed keys, with a flag each (and low bits of a second hash)."""
    bucket = (keys >> np.uint64(LOW)).astype(np.int64)
    edge = bucket_edges(bucket)
    blobs = []
    for a, b in zip(edge[:-1].tolist(), edge[1:].tolist()):
        blob = struct.pack("<I", b - a) + np.packbits(flags[a:b]).tobytes() + low_bytes(keys[a:b])
        blobs.append(blob if more is None else blob + low_bytes(more[a:b]))
    return blob_rows(shard, bucket[edge[:-1]], blobs)


def no_keys() -> pa.Table:
    return pa.table({"shard": pa.array([], pa.int32()), "bucket": pa.array([], pa.int32()), "blob": pa.array([], pa.binary())})


def answer(table: pa.Table, wide: bool, many: int) -> pa.Table:
    """The blobs of one bucket to bits: keys seen in two blobs or flagged, then keys seen in more than `many` blobs."""
    raw = table["blob"].to_pylist()
    sizes = [struct.unpack_from("<I", r)[0] for r in raw]
    key, flag, more = [], [], []
    for r, n in zip(raw, sizes):
        at = 4 + (n + 7) // 8
        flag.append(np.unpackbits(np.frombuffer(r, np.uint8, at - 4, 4), count=n))
        key.append(low_numbers(r, n, at))
        if wide:
            more.append(low_numbers(r, n, at + n * LOW // 8))
    flags = np.concatenate(flag)
    order, first, number = groups(np.concatenate(key), np.concatenate(more) if wide else None)
    count = np.diff(np.append(first, len(order)))
    seen = (count > 1) | (np.maximum.reduceat(flags[order], first) > 0)
    yes, hot = seen[number], (count > many)[number]
    blobs, at = [], 0
    for n in sizes:
        blobs.append(np.packbits(yes[at : at + n]).tobytes() + np.packbits(hot[at : at + n]).tobytes())
        at += n
    return pa.table({"shard": table["shard"], "bucket": table["bucket"], "blob": pa.array(blobs, pa.binary())})


def repeated(keys: DataFrame, buckets: int, wide: bool = False, many: int = 1 << 30) -> DataFrame:
    """keys: rows of key_rows(). The answers, in rows of the same form."""
    return keys.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(lambda t: answer(t, wide, many), KEYS)


def read_answers(table: pa.Table, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two bits of each of a shard's sorted distinct keys."""
    yes, hot = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    bucket = (keys >> np.uint64(LOW)).astype(np.int64)
    for b, raw in zip(table["bucket"].to_pylist(), table["blob"].to_pylist()):
        a, e = np.searchsorted(bucket, b, "left"), np.searchsorted(bucket, b, "right")
        bits = np.frombuffer(raw, np.uint8)
        half = (e - a + 7) // 8
        yes[a:e] = np.unpackbits(bits[:half], count=e - a)
        hot[a:e] = np.unpackbits(bits[half:], count=e - a)
    return yes, hot


class Shard:
    """The documents of a shard in a fixed order, as one array of UTF-8 bytes."""

    def __init__(self, table: pa.Table):
        ids = table["doc_id"].combine_chunks()
        text = table["text"].combine_chunks().cast(pa.large_binary())
        if isinstance(text, pa.ChunkedArray):
            text = pa.concat_arrays(text.chunks) if text.num_chunks else pa.array([], pa.large_binary())
        keyed = pa.table({"id": ids, "text": text})
        order = np.argsort(keyed["id"].to_numpy(), kind="stable")
        i = keyed["id"].to_numpy()[order]
        if len(i) > 1 and (i[1:] == i[:-1]).any():  # rows of one id go by their text
            raw = text.to_pylist()
            order = np.array(sorted(range(len(raw)), key=lambda k: (int(ids[k].as_py()), raw[k])))
        text = text.take(pa.array(order))
        self.ids = keyed["id"].to_numpy()[order]
        buffers = text.buffers()
        self.offsets = np.frombuffer(buffers[1], np.int64, len(order) + 1, text.offset * 8).copy() if len(order) else np.zeros(1, np.int64)
        data = np.frombuffer(buffers[2], np.uint8) if len(order) and buffers[2] is not None else np.zeros(0, np.uint8)
        self.data = data[self.offsets[0] : self.offsets[-1]]
        self.offsets -= self.offsets[0]


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def smallest(h: np.ndarray, width: int) -> np.ndarray:
    """Place of the smallest (leftmost among equal) of each `width` values on end; places count from 0."""
    x = (h >> np.uint64(31)) << np.uint64(31) | np.arange(len(h), dtype=np.uint64)
    have = 1
    while have < width:
        step = min(have, width - have)
        x = np.minimum(x[: len(x) - step], x[step:])
        have += step
    return (x & np.uint64(0x7FFFFFFF)).astype(np.int64)


def window_runs(n: int, hashes, ends: np.ndarray, window: int, gram: int, block: int = 1 << 16) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows that share their smallest gram: first window, number of windows, the gram's hash and place.

    n: number of elements; hashes(a, b): hashes of the grams that start at a..b-1; ends[i]: where i's document ends.
    Equal windows have the same smallest gram at the same distance, wherever they lie.
    """
    width = window - gram + 1
    out: tuple[list, list, list, list] = ([], [], [], [])
    for a in range(0, n - window + 1, block):
        b = min(n - window + 1, a + block)  # windows a..b-1
        h = hashes(a, b + width - 1)
        place = smallest(h, width)
        good = ends[a:b] - np.arange(a, b) >= window
        new = np.ones(b - a, bool)
        new[1:] = (place[1:] != place[:-1]) | (good[1:] != good[:-1])
        first = np.flatnonzero(new)
        count = np.diff(np.append(first, b - a))
        keep = good[first]
        first, count = first[keep], count[keep]
        out[0].append(first + a)
        out[1].append(count)
        out[2].append(h[place[first]])
        out[3].append(place[first] + a)
    if not out[0]:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    first, count, h, place = (np.concatenate(x) for x in out)
    return first, count, h, place


def spread_out(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first[i], first[i]+1, ... (count[i] of them), for all i."""
    total = int(count.sum())
    at = np.cumsum(count) - count
    return np.repeat(first - at, count) + np.arange(total)


def covered(starts: np.ndarray, window: int, n: int) -> np.ndarray:
    """Which of n elements lie in a window that starts at one of starts."""
    edge = np.zeros(n + 1, np.int32)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + window, -1)
    return np.cumsum(edge[:-1]) > 0
