"""Temperature mixing of sources: weights from token shares, realised as budgeted block permutations.

A source with the share p of all tokens gets the weight p**x / sum(p**x).  With x
falling from 1 to 0 the mixture goes from natural to even, its entropy rises, and
so do the repetitions of small sources.  The exponent is found by bisection over
the table of sources, in Spark, `CUTS` cuts a round, so any number of sources will
do: the largest x that meets the target entropy, raised if need be to the smallest
that stays within the repetition limit.

A source whose part of the budget is b of its n tokens gets b // n whole blocks,
each a permutation of all its documents by a hash of block and doc_id, and of the
next block the longest prefix that fits the rest of b.  So a document appears
`copies` times, b // n or one more, and a source stays below its budget by less
than one document.

A null source is a source of its own.  Null and empty texts have no tokens, cost
nothing and go with the block's prefix.  A source without any token gets one block
of weight 0.  Rows that repeat a doc_id are separate documents.  An empty table
gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

CUTS = 32
ROUNDS = 8
PER_SLICE = 500
WORD = r"[^\x20\x09-\x0D]+"


def n_tokens(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_stats(docs: DataFrame) -> DataFrame:
    """_source, _rows, _tokens of `docs` with the columns _source and _tokens."""
    return docs.groupBy("_source").agg(F.count("*").alias("_rows"), F.sum("_tokens").alias("_total"))


def exponent(sources: DataFrame, target_entropy: float, max_repeats: float, budget_share: float | None) -> float:
    """The largest x in [0, 1] whose entropy is at least `target_entropy` of an even mixture's, or, if that repeats a
    source more than `max_repeats` times in a budget of `budget_share` of all tokens, the smallest that does not."""
    live = sources.where("_total > 0")
    total, n, least = live.agg(F.sum("_total"), F.count("*"), F.min("_total")).first()
    if not n or n == 1:
        return 1.0
    log = F.log(F.col("_total") / F.lit(total))
    small = math.log(least / total)

    def look(xs: list[float]) -> list[tuple[float, float]]:
        """For each x: the entropy as a share of the largest, and the most repetitions."""
        sums = live.agg(*(F.sum(f) for x in xs for f in (F.exp(x * log), F.exp(x * log) * log))).first()
        out = []
        for i, x in enumerate(xs):
            z, zl = sums[2 * i], sums[2 * i + 1]
            # weight / share is largest for the smallest source as long as x is at most 1
            out.append(((math.log(z) - x * zl / z) / math.log(n), (budget_share or 0) * math.exp((x - 1) * small) / z))
        return out

    def bisect(holds, keep_low: bool) -> float:
        lo, hi = 0.0, 1.0
        for _ in range(ROUNDS):
            xs = [lo + (hi - lo) * i / CUTS for i in range(CUTS + 1)]
            ok = [holds(*v) for v in look(xs)]
            if keep_low:  # holds up to some x
                i = max((i for i, v in enumerate(ok) if v), default=0)
                lo, hi = xs[i], xs[min(i + 1, CUTS)]
            else:  # holds from some x on
                i = next((i for i, v in enumerate(ok) if v), CUTS)
                lo, hi = xs[max(i - 1, 0)], xs[i]
        return lo if keep_low else hi

    x = bisect(lambda entropy, _: entropy >= target_entropy, True)
    if budget_share is not None and look([x])[0][1] > max_repeats:
        x = max(x, bisect(lambda _, repeats: repeats <= max_repeats, False))
    return x


def mix(docs: DataFrame, target_entropy: float = 0.95, max_repeats: float = 4.0, budget_share: float | None = 1.0, seed: int = 0, key: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """`docs` with _tokens, _weight and _copies: how often each document appears in the mixture.

    `budget_share` is the budget as a share of all tokens; None takes the largest
    budget that repeats no source more than `max_repeats` times.
    """
    named = F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit(""))
    rows = docs.select(C.packed(docs), F.col(key).alias("_key"), named.alias("_source"), n_tokens(F.col(text)).alias("_tokens"))
    sources = C.save(source_stats(rows.select("_source", "_tokens")), "sources")
    x = exponent(sources, target_entropy, max_repeats, budget_share)
    total = sources.agg(F.coalesce(F.sum("_total"), F.lit(0))).first()[0]
    power = F.when(F.col("_total") > 0, F.exp(x * F.log(F.col("_total") / F.lit(max(total, 1))))).otherwise(0.0)
    z = sources.agg(F.sum(power)).first()[0] or 1.0
    weights = sources.withColumn("_weight", power / F.lit(z))
    if budget_share is None:
        fits = weights.where("_weight > 0").agg(F.min(F.col("_total") / F.col("_weight"))).first()[0] or 0.0
        budget = max_repeats * fits
    else:
        budget = float(budget_share) * total
    part = F.col("_weight") * F.lit(budget * (1 + 1e-9))  # so that a whole block is not lost to rounding
    blocks = F.when(F.col("_total") > 0, F.floor(part / F.col("_total"))).otherwise(1).cast("long")
    plan = weights.select("_source", "_weight", blocks.alias("_blocks"), F.when(F.col("_total") > 0, part - blocks * F.col("_total")).otherwise(-1.0).alias("_rest"), F.least(F.ceil(F.col("_rows") / PER_SLICE), F.lit(1 << 20)).alias("_many"))
    ready = rows.join(plan, "_source").withColumn("_order", F.shiftrightunsigned(F.xxhash64(F.lit(seed), "_blocks", "_key"), 4))
    done = C.running(ready, "_source", ["_order", "_key", "_tokens"], "_tokens", F.col("_many"), "_before")
    inside = (F.col("_before") + F.col("_tokens")) <= F.col("_rest")
    done = done.withColumn("_copies", F.col("_blocks") + F.when(inside, 1).otherwise(0))
    return C.unpacked(done, docs.columns, ["_tokens", "_weight", "_copies"])


def realise(docs: DataFrame, repeat: bool = True, **options: object) -> DataFrame:
    """The mixture itself: each row of `docs` as often as it has copies, or once if not `repeat`, in the columns of `docs`."""
    done = mix(docs.select(C.packed(docs).alias("_whole"), "doc_id", "source", "text"), **options).where("_copies > 0")
    if not repeat:
        return done.select("_whole.*")
    once = F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies"))).alias("_copy")
    return done.select("_whole", once).select("_whole.*")


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = mix(C.documents(spark, sf_dir).select("doc_id", "source", "text"))
    return done.select("doc_id", "source", F.col("_tokens").alias("n_tokens"), F.col("_weight").alias("weight"), F.col("_copies").alias("copies"))
