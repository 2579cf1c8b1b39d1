"""Line dedup by distinct-site spread, with built-in functions only.

Lines are split at newlines; a line's key is the MD5 of its text without outer spaces. Sites per
key are counted by HyperLogLog sketches that merge by aggregation, map side first. A key whose estimate is clearly on
one side of the threshold is decided by it; keys near the threshold get an exact distinct count. Lines of keys on
`min_sites` sites or more, at least `min_chars` long, are boilerplate and leave every document.

Defined cases: a null text stays null and has no lines; blank lines are never boilerplate; a null site counts as no
site; repeated lines in one document all go; a text of boilerplate only becomes empty; ties do not arise; an empty table
gives no rows. Documents are all returned, with their other columns, whatever their names; results replace columns of
the same name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from waypath.llm.common import checkpoint, documents

MIN_SITES = 5
MIN_CHARS = 10
#: log2 of a sketch's buckets, and how far from the threshold an estimate decides alone (over 5 standard errors).
LG_K = 12
MARGIN = 0.1
#: Keys near the threshold that are sent to all executors, and boilerplate keys that the plan itself holds, at most (16 bytes each).
BROADCAST_KEYS = 200_000
LITERAL_KEYS = 10_000
SALTS = 32


def line_key(line: Column) -> Column:
    return F.unhex(F.md5(F.trim(line).cast("binary")))


def boilerplate_keys(lines: DataFrame, min_sites: int = MIN_SITES, lg_k: int = LG_K, margin: float = MARGIN, broadcast_keys: int = BROADCAST_KEYS) -> DataFrame:
    """Of rows (key, site), the keys on min_sites distinct sites or more."""
    # each task sends one row a key: a line that is everywhere becomes one row a task before anything is shuffled
    spread = (
        lines.where("site IS NOT NULL")
        .groupBy("key")
        .agg(F.count("*").alias("n"), F.hll_sketch_agg("site", F.lit(lg_k)).alias("sketch"))
        .where(F.col("n") >= min_sites)
        .select("key", F.hll_sketch_estimate("sketch").alias("sites"))
    )
    low, high = int(min_sites * (1 - margin)) - 1, min_sites * (1 + margin) + 1
    spread = checkpoint(spread.where(F.col("sites") >= low))
    near = spread.where(F.col("sites") <= high).select("key")
    pairs = lines.where("site IS NOT NULL").select("key", "site")
    if near.limit(broadcast_keys + 1).count() <= broadcast_keys:
        pairs = pairs.join(F.broadcast(near), "key", "left_semi").distinct()
    else:  # one row a key and site, so that no key has more rows than there are sites
        pairs = pairs.distinct().join(near, "key", "left_semi")
    exact = pairs.groupBy("key").agg(F.count("*").alias("sites")).where(F.col("sites") >= min_sites).select("key")
    return spread.where(F.col("sites") > high).select("key").unionByName(exact)


def drop_boilerplate(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    site_col: str = "source",
    min_sites: int = MIN_SITES,
    min_chars: int = MIN_CHARS,
    literal_keys: int = LITERAL_KEYS,
    broadcast_keys: int = BROADCAST_KEYS,
) -> DataFrame:
    """docs with their text cleaned, and n_lines and n_removed.

    Up to literal_keys boilerplate lines go into the plan as a set, and texts are cleaned where they lie. Beyond that
    their lines are joined to the keys, the lines of a key being dealt to SALTS tasks, and texts are joined to what
    leaves them; rows of one id then lose the lines of all of them, as they do in the first way.
    """
    names = [c for c in docs.columns if c.lower() not in ("n_lines", "n_removed")]
    plain = {c: f"c{i}" for i, c in enumerate(names)}
    d = docs.select(*[F.col(f"`{c}`").alias(p) for c, p in plain.items()])
    own, text = F.col(plain[id_col]), F.col(plain[text_col]).cast("string")
    split = F.coalesce(F.split(text, "\n", -1), F.array().cast("array<string>"))
    long_enough = lambda x: F.char_length(F.trim(x)) >= min_chars
    lines = d.select(own.alias("id"), F.col(plain[site_col]).alias("site"), F.explode(split).alias("line"))
    lines = lines.where(long_enough(F.col("line"))).select("id", "site", line_key(F.col("line")).alias("key"))
    keys = checkpoint(boilerplate_keys(lines, min_sites, broadcast_keys=broadcast_keys))
    some = keys.limit(literal_keys + 1).collect()
    if len(some) <= literal_keys:
        gone = lambda x: line_key(x).isin([bytes(r.key) for r in some]) if some else F.lit(False)
        cleaned = d.withColumn("lines", split).withColumn("left", F.filter("lines", lambda x: ~(long_enough(x) & gone(x))))
    else:
        salted = keys.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        hits = lines.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")).join(salted, ["key", "salt"], "left_semi")
        per_doc = hits.select("id", "key").distinct().groupBy(F.col("id").alias("owner")).agg(F.collect_set("key").alias("gone"))
        cleaned = d.join(per_doc, own.eqNullSafe(F.col("owner")), "left").withColumn("lines", split)
        cleaned = cleaned.withColumn("left", F.when(F.col("gone").isNull(), F.col("lines")).otherwise(F.filter("lines", lambda x: ~(long_enough(x) & F.array_contains("gone", line_key(x))))))
    text = F.when(F.size("left") == F.size("lines"), text).otherwise(F.array_join("left", "\n"))
    return cleaned.select(
        *[text.alias(c) if c == text_col else F.col(p).alias(c) for c, p in plain.items()],
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size("left")).cast("long").alias("n_removed"),
    )


def op7_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drop_boilerplate(documents(spark, sf_dir).select("doc_id", "text", "source"))
    text = F.coalesce("text", F.lit(""))
    return out.select(
        F.col("doc_id").cast("long").alias("doc_id"), "n_lines", "n_removed", F.octet_length(text).cast("long").alias("kept_bytes"), F.sha2(text, 256).alias("kept_sha256")
    )


ORACLE = f"""
WITH l AS (SELECT doc_id, source, i, line, trim(line, ' ') AS norm
  FROM (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents)),
k AS (SELECT norm FROM l WHERE length(norm) >= {MIN_CHARS} GROUP BY norm HAVING count(DISTINCT source) >= {MIN_SITES}),
kept AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE k.norm IS NOT NULL) AS n_removed,
  coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE k.norm IS NULL), '') AS txt FROM l LEFT JOIN k USING (norm) GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
  CAST(strlen(coalesce(txt, '')) AS BIGINT) AS kept_bytes, sha256(coalesce(txt, '')) AS kept_sha256
FROM documents d LEFT JOIN kept USING (doc_id)
"""
