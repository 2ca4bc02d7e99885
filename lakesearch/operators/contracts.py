"""Rules between the fields of an answer, as queries that return what breaks them; and rows that outlive their time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def violations(rows: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """key and rule for each rule (a condition that must hold) a row breaks; null counts as broken."""
    broken = F.array_compact(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items())))
    return rows.select(key, F.explode(broken).alias("rule"))


def answer_rules() -> dict[str, Column]:
    """Rules of a search answer (status, n_results, n_warnings, has_cursor, mode, n_evidence, more, error)."""
    s, n = F.col("status"), F.col("n_results")
    implies = lambda a, b: ~a | b
    return {
        "partial_has_warnings": implies(s == "partial", F.col("n_warnings") > 0), "answer_has_results": implies(s.isin("ok", "partial"), n > 0),
        "empty_has_none": implies(s.isin("empty", "error"), (n == 0) & ~F.col("has_cursor")), "error_has_code": (s == "error") == F.col("error").isNotNull(),
        "none_has_no_evidence": implies(F.col("mode") == "none", F.col("n_evidence") == 0), "more_has_cursor": implies(F.col("more"), F.col("has_cursor")),
    }


def live(rows: DataFrame, now: Column, expires: str = "expires_at") -> DataFrame:
    return rows.where(F.col(expires) > now)


def cursor_error(expires: Column, now: Column, kind: Column, wanted: Column) -> Column:
    """Why a cursor cannot be used; null if it can."""
    return F.when(kind.isNull(), "CURSOR_NOT_FOUND").when(kind != wanted, "CURSOR_MISMATCH").when(expires <= now, "CURSOR_EXPIRED")
