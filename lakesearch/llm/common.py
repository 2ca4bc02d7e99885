"""Shared pieces: durable intermediate tables, byte-level text kernels, ordered running sums.

The kernels work on the bytes of whole Arrow batches with numpy, so a document
costs no Python call of its own.  Texts are cut at document borders into chunks
of about `CHUNK` bytes; a text longer than that is a chunk of its own, and a
chunk needs some 40 bytes of memory per text byte.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..shipping import ship

CHUNK = 1 << 20
U = np.uint64


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; a local one only in a session without executors elsewhere, as in tests."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir names no folder that all executors share")
        found = tempfile.mkdtemp(prefix="lakesearch_")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def save(df: DataFrame, name: str) -> DataFrame:
    """Write `df` to the shared folder and read it back: later jobs restart from the files, not from the input."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lakesearch/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_remove, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # noqa: BLE001  the session has ended: nothing can be deleted any more
        pass


def small_batches(spark: SparkSession, rows: int = 512) -> None:
    """Arrow batches of few rows, so that long texts do not add up in a Python worker; the workers get this package."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column, null as empty, and the borders between its rows."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = pc.fill_null(col, "")
    wide = pa.types.is_large_string(col.type)
    _, offsets, data = col.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    if data is None or at[-1] == at[0]:
        return np.empty(0, np.uint8), at - at[0]
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def chunks(batches: Iterator[pa.RecordBatch], column: str, size: int = CHUNK) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batches with the bytes of `column` and the borders between rows."""
    for batch in batches:
        if not batch.num_rows:
            continue
        data, bounds = text_bytes(batch.column(batch.schema.get_field_index(column)))
        lo = 0
        while lo < batch.num_rows:
            hi = max(lo + 1, int(np.searchsorted(bounds, bounds[lo] + size, "right")) - 1)
            yield batch.slice(lo, hi - lo), data[bounds[lo] : bounds[hi]], bounds[lo : hi + 1] - bounds[lo]
            lo = hi


def byte_set(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


SPACE = byte_set(b"\x09\x0a\x0b\x0c\x0d\x20")
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

BASE = 0x9E3779B97F4A7C15 | 1
_powers: dict[str, np.ndarray] = {"up": np.ones(1, U), "down": np.ones(1, U)}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers["up"]) < n + 1:
        inverse = pow(BASE, -1, 1 << 64)
        for key, step in (("up", BASE), ("down", inverse)):
            grown = np.full(max(n + 1, 1 << 16), step, U)
            grown[0] = 1
            _powers[key] = np.cumprod(grown)
    return _powers["up"], _powers["down"]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit over all others."""
    h = h ^ (h >> U(30))
    h = h * U(0xBF58476D1CE4E5B9)
    h ^= h >> U(27)
    h = h * U(0x94D049BB133111EB)
    h ^= h >> U(31)
    return h


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A rolling (Karp-Rabin) hash, modulo 2**64, of each span of bytes, then mixed with its length."""
    up, down = _power(len(data))
    total = np.zeros(len(data) + 1, U)
    np.cumsum((data.astype(U) + U(1)) * up[: len(data)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(U) * U(0xD6E8FEB86659FD93))


def word_spans(data: np.ndarray, bounds: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs of `inside`, cut at row borders, and each row's first run."""
    before = np.zeros(len(data), bool)
    before[1:] = inside[:-1]
    before[bounds[:-1][bounds[:-1] < len(data)]] = False
    after = np.zeros(len(data), bool)
    after[:-1] = inside[1:]
    after[bounds[1:][bounds[1:] > 0] - 1] = False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, bounds)


def gram_hashes(words: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of k words that stay in one row, and the word each starts at."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, U), np.empty(0, np.int64)
    h = np.zeros(n, U)
    for i in range(k):
        h = (h + words[i : i + n]) * U(BASE)
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    at = np.flatnonzero(row[:n] == row[k - 1 :])
    return mix(h[at]), at


def per_row(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of `flags` between the bounds."""
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


def running(df: DataFrame, group: str, order: list[str], value: str, spread: int | Column, out: str) -> DataFrame:
    """Adds `out`: the sum of `value` over the earlier rows of `group`, which is never null, by `order`, its first
    column being a non-negative 60-bit hash.

    A group's rows are cut by that hash into `spread` slices (a number, or a column that
    is the same throughout a group; 2**20 at most); each slice is one window partition,
    and the slices' sums, a few numbers, give their offsets.  So a group that holds most
    rows is still spread over many tasks.
    """
    many = F.lit(spread) if isinstance(spread, int) else spread
    cut = df.withColumn("_slice", F.floor(F.shiftright(F.col(order[0]), 40) * many / F.lit(1 << 20)))
    sums = cut.groupBy(group, "_slice").agg(F.sum(value).alias("_sum"))
    ahead = Window.partitionBy(group).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col(group).alias("_group"), F.col("_slice").alias("_at"), F.coalesce(F.sum("_sum").over(ahead), F.lit(0)).alias("_ahead"))
    inside = Window.partitionBy(group, "_slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    own = cut.withColumn("_own", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    # plain equality: the rows lie by these columns already, and only the sums move
    both = own.join(sums, (F.col(group) == F.col("_group")) & (F.col("_slice") == F.col("_at")))
    return both.withColumn(out, F.col("_own") + F.col("_ahead")).drop("_own", "_ahead", "_group", "_at", "_slice")


def packed(df: DataFrame) -> Column:
    """All columns of `df` in one, `_row`, so that their names clash with none that an operator adds."""
    return F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("_row")


def unpacked(df: DataFrame, columns: list[str], added: list[str]) -> DataFrame:
    """The columns that `_row` holds, those the operator adds in place of any of the same name."""
    return df.select(*(F.col("_row")[c].alias(c) for c in columns if c not in added), *added)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
