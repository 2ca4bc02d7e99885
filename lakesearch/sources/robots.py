"""Robots rules as a table, and the decision about a path: the longest matching rule, allow before disallow."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def rules(robots: DataFrame, agent: str = "*", key: str = "host", body: str = "body") -> DataFrame:
    """host, allow, path of the rules for `agent` (all agents' group), one row a rule."""
    lines = robots.select(key, F.posexplode(F.split(body, r"\r?\n")).alias("n", "line"))
    field = F.lower(F.trim(F.split_part("line", F.lit(":"), F.lit(1))))
    value = F.trim(F.regexp_replace(F.regexp_replace("line", r"^[^:]*:", ""), r"#.*", ""))
    named = lines.select(key, "n", field.alias("field"), value.alias("value"))
    w = Window.partitionBy(key).orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    grouped = named.withColumn("agent", F.last(F.when(F.col("field") == "user-agent", F.lower("value")), True).over(w))
    return grouped.where((F.col("agent") == agent.lower()) & F.col("field").isin("allow", "disallow") & (F.col("value") != "")).select(key, (F.col("field") == "allow").alias("allow"), F.col("value").alias("path"))


def decide(urls: DataFrame, table: DataFrame, key: str = "host") -> DataFrame:
    """`urls` (key, path, ...) with allowed: no matching rule allows."""
    own = urls.withColumn("_row", F.xxhash64(*urls.columns))
    hit = own.select("_row", key, F.col("path").alias("_path")).distinct().join(table, key).where(F.col("_path").startswith(F.col("path")))
    best = hit.groupBy("_row").agg(F.max(F.struct(F.length("path").alias("n"), "allow")).alias("best"))
    return own.join(best, "_row", "left").withColumn("allowed", F.coalesce("best.allow", F.lit(True))).drop("_row", "best")
