"""Behaviour variants as feature files: ordered text lines, one file a family."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waypath.functions.ids import gherkin_tag, gherkin_text


def feature_lines(variants: DataFrame) -> DataFrame:
    """variants (family, signature, members, representative, steps) to (family, scenario, line_no, line)."""
    head = F.array(
        gherkin_tag(F.concat(F.lit("variant-"), F.substring("signature", 1, 12))),
        F.concat(F.lit("Scenario: "), gherkin_text(F.col("representative"))),
        F.concat(F.lit("  Given "), F.col("members").cast("string"), F.lit(" equal sessions")),
        F.concat(F.lit("  When "), F.col("steps").cast("string"), F.lit(" steps are taken")),
        F.lit("  Then the outcome is the recorded one"),
    )
    return variants.select("family", F.col("signature").alias("scenario"), F.posexplode(head).alias("line_no", "line"))


def write_features(lines: DataFrame, path: str) -> None:
    """One text file for each family, its scenarios in order; families that are gone disappear."""
    body = lines.withColumn("__k", F.struct("scenario", "line_no")).repartition("family").sortWithinPartitions("family", "__k")
    body.select("family", F.col("line").alias("value")).write.partitionBy("family").mode("overwrite").text(path)
