"""Approximate nearest neighbours by a hash-prefix forest.

A tree hashes a vector to a long bit string: bit k tells on which side of the bisector of two sampled vectors it lies.
A tree is the sorted array of its strings. A query descends each tree by binary search to its longest matching prefix,
then all trees ascend together, one bit at a time, until their ranges hold enough candidates; these are ranked by exact
Euclidean distance in double precision, ties to the smaller id.

Equal vectors are one entry with its k + 1 smallest ids (more can never be among the k nearest, ties going to smaller
ids), so a crowd of copies neither fills a range nor a task. Entries are dealt to shards by a hash of the vector, each
with a forest of its own; a shard's entries come before its queries, which stream past the forest in Arrow batches, so
that a task holds one forest and one batch. A query's best k of all shards are kept. The hash planes come from a bounded
sample (`PLANE_SAMPLE` vectors); every row is indexed.

Defined cases: null, empty and zero vectors, and those that hold a null or a non-finite component, take no part;
neither do rows without an id or of another length than most. Fewer candidates than k give fewer rows; ties go to
smaller ids; rows of one id are candidates each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from waypath.llm.common import bounded_batches

K = 10
TREES = 16
BITS = 64
#: Vectors from which the bisecting planes are drawn.
PLANE_SAMPLE = 4096
#: Candidates that the trees' ranges must hold before the ascent ends, as a share of the shard's entries, and at least.
CANDIDATE_SHARE = 1.5
LEAST_CANDIDATES = 2_000
#: Entries of a shard, at most on average; small tables are cut further, down to LEAST_ROWS, to occupy all cores.
SHARD_ROWS = 100_000
LEAST_ROWS = 20_000


def valid_vectors(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    v = F.col(f"`{vector_col}`").cast("array<double>")
    d = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), v.alias("v")).where("id IS NOT NULL AND v IS NOT NULL")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    return d.where(fine)


def planes(sample: np.ndarray, trees: int, bits: int, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """Normals (dim, trees * bits) and offsets of bisectors of random pairs of the sample."""
    rng = np.random.default_rng(seed)
    n = trees * bits
    dim = sample.shape[1]
    a, b = sample[rng.integers(0, len(sample), n)], sample[rng.integers(0, len(sample), n)]
    same = (a == b).all(1)
    normal = np.where(same[:, None], rng.standard_normal((n, dim)), a - b)
    return normal.T, ((a + b) / 2 * normal).sum(1)


class Forest:
    """Sorted arrays of bit strings over the rows of x."""

    def __init__(self, x: np.ndarray, normals: np.ndarray, offsets: np.ndarray, trees: int = TREES, bits: int = BITS):
        self.x, self.normals, self.offsets, self.trees, self.bits = x, normals, offsets, trees, bits
        strings = self.hash(x)
        self.order = [np.argsort(strings[:, t], kind="stable") for t in range(trees)]
        self.sorted = [strings[o, t] for t, o in enumerate(self.order)]

    def hash(self, x: np.ndarray) -> np.ndarray:
        out = np.empty((len(x), self.trees), np.uint64)
        for i in range(0, len(x), 4096):
            side = (x[i : i + 4096] @ self.normals > self.offsets).reshape(-1, self.trees, self.bits)
            out[i : i + 4096] = np.packbits(side, axis=2).view(">u8")[:, :, 0]
        return out

    def candidates(self, q: np.ndarray, enough: int):
        """For each query, the rows in the trees' ranges at the deepest common level that holds enough."""
        strings = self.hash(q)
        top = np.uint64(0xFFFFFFFFFFFFFFFF)
        done = np.zeros(len(q), bool)
        lo, hi = np.zeros((len(q), self.trees), np.int64), np.full((len(q), self.trees), len(self.x), np.int64)
        for level in range(self.bits, 0, -1):  # ascend all trees together
            left = np.flatnonzero(~done)
            if not len(left):
                break
            mask = top << np.uint64(self.bits - level)
            a = np.empty((len(left), self.trees), np.int64)
            b = np.empty_like(a)
            for t in range(self.trees):
                s = strings[left, t] & mask
                a[:, t] = np.searchsorted(self.sorted[t], s, "left")
                b[:, t] = np.searchsorted(self.sorted[t], s | ~mask, "right")
            full = (b - a).sum(1) >= enough
            at = left[full]
            lo[at], hi[at], done[at] = a[full], b[full], True
        for i in range(len(q)):
            yield np.unique(np.concatenate([self.order[t][lo[i, t] : hi[i, t]] for t in range(self.trees)]))


def nearest(
    index: DataFrame,
    queries: DataFrame,
    k: int = K,
    trees: int = TREES,
    bits: int = BITS,
    share: float = CANDIDATE_SHARE,
    shard_rows: int = SHARD_ROWS,
    least_rows: int = LEAST_ROWS,
) -> DataFrame:
    """index, queries: (id, v) of valid vectors. Returns query_id, rank, vec_id, score; a query's own id is left out."""
    spark = index.sparkSession
    sizes = index.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), "dim").limit(1).collect()
    dim, rows = (sizes[0]["dim"], sizes[0]["count"]) if sizes else (1, 0)
    index, queries = index.where(F.size("v") == dim), queries.where(F.size("v") == dim)
    near_top = F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int(min(1.0, PLANE_SAMPLE / max(1, rows)) * (1 << 30))
    sample = np.array([r.v for r in index.where(near_top).orderBy("id").limit(2 * PLANE_SAMPLE).collect()], dtype=float).reshape(-1, dim)
    if not len(sample):
        sample = np.array([r.v for r in index.limit(PLANE_SAMPLE).collect()], dtype=float).reshape(-1, dim)
    normals, offsets = planes(sample, trees, bits) if len(sample) else (np.zeros((dim, trees * bits)), np.zeros(trees * bits))
    shared = spark.sparkContext.broadcast((normals, offsets))
    shards = max(1, -(-rows // shard_rows), min(spark.sparkContext.defaultParallelism, -(-rows // least_rows)))
    first = Window.partitionBy("v").orderBy("id")
    entries = index.withColumn("n", F.row_number().over(first)).where(F.col("n") <= k + 1).groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    entries = entries.select(F.pmod(F.xxhash64("v"), F.lit(shards)).cast("int").alias("shard"), F.lit(None).cast("long").alias("query"), "ids", "v")
    asked = queries.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.col("id").alias("query"), F.array().cast("array<long>").alias("ids"), "v")

    def vectors(b: pa.RecordBatch) -> np.ndarray:
        return b.column(3).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Batches by shard, entries before queries."""
        shard, parts, ids, forest = None, [], [], None
        for whole in batches:
            for b in runs(whole):
                if b.column(0)[0].as_py() != shard:
                    shard, parts, ids, forest = b.column(0)[0].as_py(), [], [], None
                if b.column(1).null_count:
                    parts.append(vectors(b))
                    ids += b.column(2).to_pylist()
                elif parts or forest:
                    if forest is None:
                        forest = Forest(np.concatenate(parts), *shared.value, trees, bits)
                        parts, counts = [], np.array([len(i) for i in ids])
                    yield answers(b, forest, ids, counts)

    def runs(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        """Parts of one shard that are all entries or all queries."""
        key = 2 * batch.column(0).to_numpy().astype(np.int64) + batch.column(1).is_valid().to_numpy(zero_copy_only=False)
        edge = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1], [True])))
        for a, b in zip(edge[:-1].tolist(), edge[1:].tolist()):
            yield batch.slice(a, b - a)

    def answers(b: pa.RecordBatch, forest: Forest, ids: list, counts: np.ndarray) -> pa.RecordBatch:
        out: tuple[list, list, list] = ([], [], [])
        asked, enough = vectors(b), max(LEAST_CANDIDATES, int(share * len(ids)))
        for qid, q, c in zip(b.column(1).to_pylist(), asked, forest.candidates(asked, enough)):
            d = np.sqrt(((forest.x[c] - q) ** 2).sum(1))
            # entries up to the distance at which k + 1 ids are reached
            order = np.argsort(d, kind="stable")
            reach = np.searchsorted(np.cumsum(counts[c[order]]), k + 1)
            limit = d[order[min(reach, len(order) - 1)]]
            best = sorted((d[j], i) for j in np.flatnonzero(d <= limit) for i in ids[c[j]] if i != qid)[:k]
            out[0].extend([qid] * len(best))
            out[1].extend(i for _, i in best)
            out[2].extend(float(s) for s, _ in best)
        return pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())], names=["query_id", "vec_id", "score"])

    bounded_batches(spark)
    dealt = entries.unionByName(asked).repartition(shards, "shard").sortWithinPartitions("shard", F.col("query").isNotNull())
    found = dealt.mapInArrow(search, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op9_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = valid_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding")
    return nearest(vectors, vectors.where(F.col("id") % 100 == 0))
