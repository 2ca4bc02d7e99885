"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

A document's place on the ring is the first 60 bits of the MD5 of its doc_id; a
virtual node's is that of "shard:replica".  A document belongs to the first virtual
node at or after its place.  The ring is walked once, from place 0: a shard takes
the documents of its arcs in ring order until it has its quota, and those that find
it full go on clockwise to the next virtual node whose shard has room.

Only the number of documents on each arc goes to the driver, shards x replicas
numbers; the walk over them gives a table of (arc, from, to, shard, first slot),
at most arcs + shards rows, and each document finds its row by its rank on its arc.
Ranks come from slices of arcs, so no task holds an arc, let alone a shard.

With `load_factor` 1 the quotas are the mean, rounded down or up, and all shards
end full: counts are at most one apart (law `rows`).  A larger factor c gives each
shard room for ceil(c * mean) rows; fewer documents then move when shards change.

A null doc_id has a place of its own, null text has no bytes, rows that repeat a
doc_id are placed one after the other, and an empty table gives an empty result.
"""

from __future__ import annotations

import bisect
import hashlib
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

SHARDS = 8
REPLICAS = 128
CELLS = 12
PER_SLICE = 2000


def place(name: str) -> int:
    return int(hashlib.md5(name.encode()).hexdigest()[:15], 16)


def ring(shards: int, replicas: int) -> list[tuple[int, int]]:
    """(place, shard) of all virtual nodes, clockwise."""
    return sorted((place(f"{s}:{r}"), s) for s in range(shards) for r in range(replicas))


def place_of(key: Column) -> Column:
    name = F.coalesce(key.cast("string"), F.lit("null"))
    return F.conv(F.substring(F.md5(name), 1, 15), 16, 10).cast("long")


def walk(counts: list[int], owners: list[int], quota: list[int]) -> list[tuple[int, int, int, int, int]]:
    """(arc, from rank, to rank, shard, first slot): who takes which documents of each arc."""
    room, slots, out = list(quota), [0] * len(quota), []
    n = len(owners)
    for arc, count in enumerate(counts):
        done, node = 0, arc
        while done < count:
            shard = owners[node % n]
            if take := min(room[shard], count - done):
                out.append((arc, done, done + take, shard, slots[shard]))
                room[shard] -= take
                slots[shard] += take
                done += take
            node += 1
    return out


def quotas(n: int, shards: int, load_factor: float, owners: list[int]) -> list[int]:
    if load_factor > 1:
        return [math.ceil(load_factor * n / shards)] * shards
    order = list(dict.fromkeys(owners))  # the first shards on the ring get the odd rows
    quota = [n // shards] * shards
    for s in order[: n % shards]:
        quota[s] += 1
    return quota


def shard(docs: DataFrame, shards: int = SHARDS, replicas: int = REPLICAS, load_factor: float = 1.0, key: str = "doc_id") -> DataFrame:
    """`docs` with _shard and _slot, the row's number in its shard, from 0 and without gaps."""
    spark = docs.sparkSession
    nodes = ring(shards, replicas)
    places, owners = [p for p, _ in nodes], [s for _, s in nodes]
    # arc i ends at node i; what lies after the last node belongs to node 0 and is arc n
    cells = []
    width = 60 - CELLS
    for cell in range(1 << CELLS):
        lo, end = cell << width, (cell + 1) << width
        while lo < end:
            arc = bisect.bisect_left(places, lo)
            hi = min(end, places[arc] + 1 if arc < len(places) else end)
            cells.append((cell, lo, hi, arc))
            lo = hi
    table = F.broadcast(spark.createDataFrame(cells, "_cell long, _lo long, _hi long, _arc int"))
    at = docs.select(C.packed(docs), F.col(key).alias("_key"), place_of(F.col(key)).alias("_place")).withColumn("_cell", F.shiftright("_place", width))
    at = at.join(table, (at["_cell"] == table["_cell"]) & (at["_place"] >= table["_lo"]) & (at["_place"] < table["_hi"])).drop("_cell", "_lo", "_hi")

    found = {r["_arc"]: r["n"] for r in at.groupBy("_arc").agg(F.count("*").alias("n")).collect()}
    counts = [found.get(i, 0) for i in range(len(nodes) + 1)]
    n = sum(counts)
    pieces = walk(counts, owners, quotas(n, shards, load_factor, owners))
    rows = F.broadcast(spark.createDataFrame(pieces, "_of long, _from long, _to long, _shard int, _first long"))
    spread = min(1 << 20, max(1, n // PER_SLICE))
    ranked = C.running(at.withColumn("_one", F.lit(1)), "_arc", ["_place", "_key"], "_one", spread, "_rank")
    done = ranked.join(rows, (F.col("_arc") == F.col("_of")) & (F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_to")))
    return C.unpacked(done.withColumn("_slot", F.col("_first") + F.col("_rank") - F.col("_from")), docs.columns, ["_shard", "_slot"])


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.documents(spark, sf_dir).select("doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"), F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"))
    return shard(docs).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("_shard").alias("shard"), F.col("_slot").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def oracle_sql() -> str:
    """The ring's walk one document at a time, and the CRC byte by byte."""
    table = []
    for b in range(256):
        for _ in range(8):
            b = b >> 1 ^ (0xEDB88320 if b & 1 else 0)
        table.append(b)
    return f"""
with recursive node as (select s, ('0x' || substr(md5(s || ':' || r), 1, 15))::bigint as p from range({SHARDS}) a(s), range({REPLICAS}) b(r)),
ring as (select list(p order by p) as ps, list(s order by p) as ss from node),
firsts as (select list(s order by p) as seen from (select s, min(p) as p from node group by s) f),
doc as materialized (select doc_id, text, ('0x' || substr(md5(coalesce(doc_id::varchar, 'null')), 1, 15))::bigint as place, row_number() over (order by ('0x' || substr(md5(coalesce(doc_id::varchar, 'null')), 1, 15))::bigint, doc_id) as i from documents),
quota as (select list_transform(range({SHARDS}), lambda s: n // {SHARDS} + case when list_position(seen, s) <= n % {SHARDS} then 1 else 0 end) as q from firsts, (select count(*) as n from documents) c),
walk(i, shard, slot, used) as (
  select 0::bigint, 0::bigint, 0::bigint, list_transform(range({SHARDS}), lambda s: 0::bigint)
  union all
  select i, to_, used[to_ + 1], list_transform(range({SHARDS}), lambda s: used[s + 1] + case when s = to_ then 1 else 0 end)
  from (select d.i, w.used, list_filter(list_concat(ss[len(list_filter(ps, lambda p: p < d.place)) + 1:], ss), lambda s: w.used[s + 1] < q[s + 1])[1] as to_ from walk w join doc d on d.i = w.i + 1, ring, quota) step),
hexed as (select doc_id, string_split(hex(encode(coalesce(text, ''))), '') as h from documents),
crc as (select doc_id, xor(4294967295::bigint, list_reduce(list_concat([4294967295::bigint], list_transform(range(1, len(h), 2), lambda k: (strpos('0123456789ABCDEF', h[k]) * 16 + strpos('0123456789ABCDEF', h[k + 1]) - 17)::bigint)), lambda c, b: xor(c >> 8, {table}[(xor(c, b) & 255) + 1]))) as v from hexed)
select d.doc_id, (strlen(coalesce(d.text, '')) + 1)::bigint as size, v as text_crc32, 'rows' as law, shard::integer as shard, slot, null::integer as grown_shard
from doc d join walk w on d.i = w.i join crc c on c.doc_id = d.doc_id"""
