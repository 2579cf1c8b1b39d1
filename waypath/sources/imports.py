"""Auxiliary inputs: graphs in JSON, whose keys go by several names, and Markdown concepts with aliases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# A kind that contains the text on the left counts as the one on the right; the first that fits decides.
NODE_KINDS = (
    ("file", "source-file"), ("route", "route"), ("component", "component"), ("class", "component"), ("function", "component"), ("endpoint", "java-endpoint"),
    ("controller", "java-endpoint"), ("permission", "permission"), ("authority", "permission"),
)
OTHER_NODE = "concept"
EDGE_KINDS = (("call", "calls"), ("render", "renders"), ("contain", "contains"), ("request", "requests"), ("valid", "validates"), ("guard", "requires"), ("require", "requires"))
OTHER_EDGE = "references"


def kind_of(text: Column, table: tuple, other: str) -> Column:
    out = F.lit(other)
    for part, kind in reversed(table):
        out = F.when(F.lower(text).contains(part), kind).otherwise(out)
    return out


def graph_items(spark: SparkSession, path: str, names: tuple[str, ...]) -> DataFrame:
    """The elements of the first of `names` that a JSON document has, as maps of strings."""
    text = spark.read.text(path, wholetext=True)
    found = F.coalesce(*[F.get_json_object("value", f"$.{n}") for n in names])
    return text.select(F.explode(F.from_json(found, "array<map<string,string>>")).alias("m"))


def first_of(m: str, *names: str) -> Column:
    return F.coalesce(*[F.col(m)[n] for n in names])


def import_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, label, kind) and edges (src, dst, kind); edges of unknown ends and nodes without id are left out."""
    n = graph_items(spark, path, ("nodes", "vertices", "entities"))
    nodes = n.select(first_of("m", "id", "key", "name").alias("id"), first_of("m", "label", "name", "id").alias("label"), kind_of(F.coalesce(first_of("m", "kind", "type"), F.lit("")), NODE_KINDS, OTHER_NODE).alias("kind"))
    nodes = nodes.where("id IS NOT NULL").dropDuplicates(["id", "label", "kind"])
    e = graph_items(spark, path, ("edges", "links", "relationships"))
    edges = e.select(first_of("m", "source", "from", "src").alias("src"), first_of("m", "target", "to", "dst").alias("dst"), kind_of(F.coalesce(first_of("m", "kind", "type", "relation"), F.lit("")), EDGE_KINDS, OTHER_EDGE).alias("kind"))
    known = nodes.select("id").distinct()
    edges = edges.join(known.withColumnRenamed("id", "src"), "src", "left_semi").join(known.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return nodes, edges.select("src", "dst", "kind")


def import_wiki(files: DataFrame, look_ahead: int = 4) -> DataFrame:
    """files (path, content) to (path, line_no, title, aliases): headings, and the aliases named in the lines after them."""
    lines = files.select("path", F.posexplode(F.split("content", "\r?\n")).alias("line_no", "line"))
    alias = F.when(F.rlike("line", F.lit("(?i)^\\s*aliases?:")), F.regexp_extract("line", "(?i)aliases?:\\s*(.*)$", 1))
    w = Window.partitionBy("path").orderBy("line_no").rowsBetween(1, look_ahead)
    found = lines.withColumn("named", F.first(alias, ignorenulls=True).over(w))
    names = F.filter(F.transform(F.split(F.coalesce("named", F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")
    return found.where(F.rlike("line", F.lit(r"^#{1,6}\s+\S"))).select("path", "line_no", F.trim(F.regexp_replace("line", r"^#+\s+", "")).alias("title"), names.alias("aliases"))
