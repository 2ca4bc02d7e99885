"""Search responses: JSON text into candidates, quarantined rows and failures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import urls as U

SCHEMA = "results array<struct<url:string,title:string,content:string,publishedDate:string,engines:array<string>,engine:string>>, unresponsive_engines array<array<string>>, paging boolean"
ROWS, TITLE, SNIPPET = 200, 500, 3000


def parse(responses: DataFrame, allowed: list[str], key: str = "response_id", body: str = "body") -> DataFrame:
    """One row per result of the first `ROWS`: its fields, its error (null if it is a candidate), exhausted and failed.

    A result from an engine that is not allowed fails its whole response.
    """
    parsed = responses.select(key, F.from_json(body, SCHEMA).alias("r"))
    names = F.array(*map(F.lit, allowed))
    rows = parsed.select(key, F.col("r.paging").alias("paging"), F.size("r.results").alias("n"), F.posexplode_outer(F.slice("r.results", 1, ROWS)).alias("pos", "row"))
    engines = F.coalesce("row.engines", F.when(F.col("row.engine").isNotNull(), F.array("row.engine")))
    good = (F.size(F.coalesce(engines, F.array().cast("array<string>"))) > 0) & F.forall(F.coalesce(engines, F.array().cast("array<string>")), lambda e: F.array_contains(names, e))
    url = U.canonical(F.col("row.url"))
    shaped = F.col("row.url").isNotNull() & F.col("row.title").isNotNull()
    error = F.when(F.col("pos").isNull(), None).when(~shaped, "invalid_result").when(~good, "unconfigured_engine").when(url.isNull(), "invalid_result_url")
    done = rows.select(
        key, (F.col("pos") + 1).cast("long").alias("pos"), url.alias("url"), F.substring("row.title", 1, TITLE).alias("title"), F.coalesce(F.substring("row.content", 1, SNIPPET), F.lit("")).alias("snippet"),
        X.strict_date(F.col("row.publishedDate")).alias("published_at"), engines.alias("engines"), error.alias("error"), ((F.col("n") == 0) | ~F.coalesce("paging", F.lit(True))).alias("exhausted"),
    )
    failed = done.groupBy(key).agg(F.bool_or(F.coalesce(F.col("error") == "unconfigured_engine", F.lit(False))).alias("failed"))
    return done.join(failed, key)


def failures(responses: DataFrame, allowed: list[str], key: str = "response_id", body: str = "body") -> DataFrame:
    """key, engine, code, suspended of each unresponsive engine a response names."""
    entry = F.explode(F.from_json(body, SCHEMA)["unresponsive_engines"])
    rows = responses.select(key, entry.alias("e"))
    engine: Column = F.get("e", F.lit(0))
    return rows.select(key, F.when(engine.isin(*allowed), engine).otherwise("unconfigured_engine").alias("engine"), X.failure_code(F.get("e", F.lit(1))).alias("code"), F.get("e", F.lit(2)).try_cast("boolean").alias("suspended"))
