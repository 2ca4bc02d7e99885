"""MinHash near-duplicates with sequential Bayesian verification.

The first minima are cut into `bands` bands of `rows`; two sets meet if a band is
equal.  With the standard 24 x 4, a pair at similarity 0.85 misses
every band with probability (1 - 0.85**4)**24 = 8e-8.

Equal shingle sets are one node.  In every band's bucket the most central node
(the one in the fullest buckets) is compared with the rest, so a group of m
copies gives m - 1 pairs and not m * m / 2.  Confirmed pairs are joined into
components; then only pairs whose ends are in different components by now are
compared, in blocks of at most `block` x `block` nodes, each pair in the first
band that holds it.  So no pair is left out, and none is looked at in vain.

A comparison reads the signatures, `hashes` minima of a byte each, batch by batch.
After each, the posterior probability that the similarity reaches the threshold
(uniform prior) must be over `miss`, or the pair is dropped; what is left is
confirmed on the full sets, so no unconfirmed pair is ever linked.

Nulls, empty texts and texts without words have the empty set and are linked
with nothing.  Nodes are numbered by their sets and not by doc_id, so rows that
repeat a doc_id or have none are linked by their own texts; a component is named
by its smallest doc_id that is not null, and one of nothing else by null.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C


@dataclass(frozen=True)
class Plan:
    """What counts as near: shingles of `words` words, similarity of `percent` / 100 or more."""

    words: int = 5
    percent: int = 80
    bands: int = 24
    rows: int = 4
    hashes: int = 1024
    batch: int = 64
    miss: float = 5e-5
    block: int = 1024


SLICE = 4096


@lru_cache
def _multipliers(n: int) -> np.ndarray:
    return C.mix(np.arange(1, n + 1, dtype=C.U) * C.U(C.BASE)) | C.U(1)


def shingle_sets(data: np.ndarray, bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Every row's distinct shingle hashes, ascending, and the borders between rows."""
    starts, ends, first = C.word_spans(data, bounds, ~C.SPACE[data])
    words = C.span_hashes(C.LOWER[data], starts, ends)
    counts = np.diff(first)
    grams, at = C.gram_hashes(words, first, k)
    row = np.repeat(np.arange(len(counts)), counts)[at]
    short = np.flatnonzero((counts > 0) & (counts < k))
    whole = np.array([_sequence(words[first[i] : first[i + 1]]) for i in short], C.U)
    grams, row = np.concatenate([grams, whole]), np.concatenate([row, short])
    order = np.lexsort((grams, row))
    grams, row = grams[order], row[order]
    new = np.ones(len(grams), bool)
    new[1:] = (grams[1:] != grams[:-1]) | (row[1:] != row[:-1])
    grams, row = grams[new], row[new]
    return grams, np.searchsorted(row, np.arange(len(counts) + 1))


def _sequence(words: np.ndarray) -> int:
    h = len(words)
    for x in words.tolist():
        h = (h * 0x100000001B3 ^ x) & 0xFFFFFFFFFFFFFFFF
    return int(C.mix(np.array([h], C.U))[0])


def signatures(grams: np.ndarray, bounds: np.ndarray, n: int, kind: type = np.uint32) -> np.ndarray:
    """The n minima of each row, or their lowest byte; rows without shingles get the largest value."""
    full = np.flatnonzero(np.diff(bounds) > 0)
    out = np.full((len(bounds) - 1, n), 0xFFFFFFFF, np.uint32).astype(kind)
    if len(full):
        at = bounds[:-1][full]
        for i, m in enumerate(_multipliers(n)):
            h = grams * m
            h ^= h >> C.U(29)
            out[full, i] = (np.minimum.reduceat(h * C.U(0xBF58476D1CE4E5B9), at) >> C.U(32)).astype(kind)
    return out


@lru_cache
def least_matches(plan: Plan) -> tuple[tuple[int, int], ...]:
    """After so many hashes, fewer matches than this leave a posterior of at most `miss`."""
    x = np.linspace(0, 1, 4001)[1:-1]
    meet = x + (1 - x) / 256  # two minima can differ and yet have the same byte
    out = []
    for n in range(plan.batch, plan.hashes + 1, plan.batch):
        for m in range(n + 1):
            log = m * np.log(meet) + (n - m) * np.log1p(-meet)
            p = np.exp(log - log.max())
            if p[x >= plan.percent / 100].sum() > plan.miss * p.sum():
                out.append((n, m))
                break
    return tuple(out)


def survivors(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray, plan: Plan) -> np.ndarray:
    """Which of the pairs a[i], b[j] of signatures stay after sequential pruning."""
    left = np.arange(len(i))
    seen, matches = 0, np.zeros(len(i), np.int32)
    for n, least in least_matches(plan):
        matches = matches + (a[i[left], seen:n] == b[j[left], seen:n]).sum(1, dtype=np.int32)
        stay = matches >= least
        left, matches, seen = left[stay], matches[stay], n
        if not len(left):
            break
    return left


def profile(docs: DataFrame, plan: Plan, key: str, text: str) -> DataFrame:
    """doc_id, code (the text's hash), n_shingles, the set's 128-bit hash (h1, h2) and the hash of each band."""
    C.small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, bounds in C.chunks(batches, "_text"):
            grams, at = shingle_sets(data, bounds, plan.words)
            n = np.diff(at)
            total = np.zeros((2, len(grams) + 1), C.U)
            np.cumsum(C.mix(grams), out=total[0, 1:])
            np.cumsum(C.mix(grams ^ C.U(C.BASE)), out=total[1, 1:])
            h = total[:, at[1:]] - total[:, at[:-1]]
            keys = _band_keys(signatures(grams, at, plan.bands * plan.rows), plan)
            flat = pa.array(keys.ravel())
            bands = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * plan.bands), flat)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n.astype(np.int64)), pa.array(h[0].view(np.int64)), pa.array(h[1].view(np.int64)), bands], names=["doc_id", "code", "n_shingles", "h1", "h2", "bands"])

    rows = docs.select(F.col(key).alias("doc_id"), F.xxhash64(text).alias("code"), F.col(text).alias("_text"))
    return rows.mapInArrow(run, "doc_id long, code long, n_shingles long, h1 long, h2 long, bands array<long>")


def _sets(texts: DataFrame, plan: Plan) -> DataFrame:
    """node, its signature, its set (both as bytes) and its bands' hashes, from node and _text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, bounds in C.chunks(batches, "_text"):
            grams, at = shingle_sets(data, bounds, plan.words)
            sig = signatures(grams, at, plan.hashes, np.uint8)
            keys = _band_keys(signatures(grams, at, plan.bands * plan.rows), plan)
            rows = [pa.array([x.tobytes() for x in sig], pa.binary()), pa.array([grams[i:j].tobytes() for i, j in zip(at[:-1], at[1:], strict=True)], pa.binary()), pa.array([x.tobytes() for x in keys], pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *rows], names=["node", "sig", "shingles", "keys"])

    return texts.select("node", "_text").mapInArrow(run, "node long, sig binary, shingles binary, keys binary")


def _rows(column: pa.Array, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1)


def _prune(pairs: DataFrame, nodes: DataFrame, plan: Plan) -> DataFrame:
    """The pairs (a, b) whose signatures leave the similarity possible."""
    sig = lambda x: nodes.select(F.col("node").alias(x), F.col("sig").alias(f"sig_{x}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                every = np.arange(batch.num_rows)
                stay = survivors(_rows(batch.column(2), np.uint8), _rows(batch.column(3), np.uint8), every, every, plan)
                yield batch.select([0, 1]).take(pa.array(stay))

    return pairs.join(sig("a"), "a").join(sig("b"), "b").select("a", "b", "sig_a", "sig_b").mapInArrow(run, "a long, b long")


def _confirm(pairs: DataFrame, nodes: DataFrame, plan: Plan) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    full = lambda x: nodes.select(F.col("node").alias(x), F.col("shingles").alias(f"set_{x}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stay = []
            for i, (a, b) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                la, lb = len(a) // 8, len(b) // 8
                if 100 * min(la, lb) < plan.percent * max(la, lb):
                    continue
                both = np.concatenate([np.frombuffer(a, C.U), np.frombuffer(b, C.U)])
                both.sort(kind="stable")
                common = int((both[1:] == both[:-1]).sum())
                if 100 * common >= plan.percent * (la + lb - common):
                    stay.append(i)
            yield batch.select([0, 1]).take(pa.array(stay, pa.int64()))

    return pairs.join(full("a"), "a").join(full("b"), "b").select("a", "b", "set_a", "set_b").mapInArrow(run, "a long, b long")


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, label: the smallest node reachable over `links`, for every node that has a link.

    Each round a node takes the smallest label among its neighbours', and then that
    label's own label; a star settles in one round, a chain in a logarithmic number.
    """
    both = C.save(links.select(F.col(a).alias("x"), F.col(b).alias("y")).union(links.select(F.col(b), F.col(a))).distinct(), "links")
    label = C.save(both.groupBy(F.col("x").alias("node")).agg(F.least(F.min("y"), F.first("x")).alias("label")), "labels")
    while True:
        near = both.join(label.select(F.col("node").alias("y"), F.col("label").alias("via")), "y").groupBy(F.col("x").alias("node")).agg(F.min("via").alias("via"))
        step = label.join(near, "node").select("node", F.least("label", "via").alias("to"), F.col("label").alias("was"))
        jump = step.select(F.col("node").alias("to"), F.col("to").alias("next"))
        new = C.save(step.join(jump, "to", "left").select("node", F.coalesce("next", "to").alias("label"), "was"), "labels")
        if new.where("label <> was").isEmpty():
            return new.select("node", "label")
        label = new.select("node", "label")


def _linked(docs: DataFrame, plan: Plan, key: str, text: str) -> DataFrame:
    """doc_id, code, n_shingles, label and component_id for every row of `docs`; rows of one component share a label, empty sets have none."""
    base = C.save(profile(docs, plan, key, text), "profile")
    some = base.where("n_shingles > 0")
    # one row of each set: the smallest doc_id, null ids after all others
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "code")).alias("first")
    node = some.groupBy("h1", "h2", "n_shingles").agg(first, F.first("bands").alias("bands"))
    node = C.save(node.select(F.monotonically_increasing_id().alias("node"), "h1", "h2", F.col("n_shingles").alias("_n"), "first.doc_id", "first.code", "bands"), "nodes")

    # buckets with two nodes or more, and how central each node is
    member = node.select("node", F.explode("bands").alias("bucket"))
    full = member.groupBy("bucket").agg(F.count("*").alias("m")).where("m > 1")
    member = C.save(member.join(full, "bucket"), "members")
    central = member.groupBy("node").agg(F.sum("m").alias("rank"))
    member = C.save(member.join(central, "node"), "ranked")
    # each node's set, read once from a row that has it
    source = node.join(central, "node", "left_semi").select("node", F.xxhash64("doc_id", "code").alias("_of"))
    texts = docs.select(F.xxhash64(F.col(key).cast("long"), F.xxhash64(text)).alias("_id"), F.col(text).alias("_text"))
    sets = C.save(_sets(texts.join(source, F.col("_id") == F.col("_of")), plan).dropDuplicates(["node"]), "sets")

    # the most central node of a bucket; a bucket's rows meet it in slices, so that no key of the join is heavy
    centre = member.groupBy("bucket").agg(F.max_by("node", F.struct("rank", -F.col("node"))).alias("centre"), F.first("m").alias("_m"))
    slices = F.floor(F.col("_m") / SLICE)
    centre = centre.select(F.col("bucket").alias("_bucket"), "centre", F.explode(F.sequence(F.lit(0).cast("long"), slices)).alias("_slice"))
    mine = F.pmod(F.xxhash64("node"), F.floor(F.col("m") / SLICE) + 1)
    star = member.join(centre, (F.col("bucket") == F.col("_bucket")) & (mine == F.col("_slice"))).where("node <> centre")
    star = C.save(star.select(F.least("node", "centre").alias("a"), F.greatest("node", "centre").alias("b")).distinct(), "stars")
    links = C.save(_confirm(_prune(star, sets, plan), sets, plan), "confirmed")
    label = components(links)

    # what is still apart, though in one bucket
    named = member.join(label, "node", "left").select("bucket", "node", "m", F.coalesce("label", "node").alias("label"))
    mixed = named.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("bucket")
    apart = _apart(named.join(mixed, "bucket").join(sets.select("node", "sig", "keys"), "node"), plan)
    more = C.save(_confirm(apart.join(star, ["a", "b"], "left_anti"), sets, plan), "confirmed")
    if not more.isEmpty():
        label = components(links.union(more))

    named = C.save(node.select("node", "doc_id", "h1", "h2", "_n").join(label, "node", "left").select("doc_id", "h1", "h2", "_n", F.coalesce("label", "node").alias("label"), F.col("label").isNotNull().alias("shared")), "named")
    names = named.where("shared").groupBy(F.col("label").alias("_label")).agg(F.min("doc_id").alias("component_id"))
    shared = named.where("shared").join(names, F.col("label") == F.col("_label"))
    alone = named.where("not shared").withColumn("component_id", F.col("doc_id"))
    merged = shared.select("h1", "h2", "_n", "label", "component_id").union(alone.select("h1", "h2", "_n", "label", "component_id"))
    done = some.drop("bands").join(merged.withColumnsRenamed({"h1": "_h1", "h2": "_h2"}), (F.col("h1") == F.col("_h1")) & (F.col("h2") == F.col("_h2")) & (F.col("n_shingles") == F.col("_n")))
    none = base.where("n_shingles = 0").select("doc_id", "code", "n_shingles", F.lit(None).cast("long"), F.col("doc_id"))
    return done.select("doc_id", "code", "n_shingles", "label", "component_id").union(none)


def near_duplicates(docs: DataFrame, plan: Plan = Plan(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of `docs`."""
    done = _linked(docs, plan, key, text)
    return done.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def _apart(named: DataFrame, plan: Plan) -> DataFrame:
    """Pairs of one bucket with different labels that survive pruning, each from one bucket only.

    A bucket of up to `block` nodes is one group; a larger one is cut into parts, and
    each two parts make a group, so no task holds more than two blocks.
    """
    parts = F.ceil(F.col("m") / plan.block)
    cut = named.withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))
    tiled = cut.withColumn("other", other).select("bucket", F.least("part", "other").alias("p"), F.greatest("part", "other").alias("q"), "part", "node", "label", "sig", "keys")
    dealt = tiled.repartition("bucket", "p", "q").sortWithinPartitions("bucket", "p", "q")

    def pairs(table: pa.Table, group: np.ndarray) -> pa.RecordBatch:
        """The surviving pairs of whole groups, all at once."""
        bucket, p, q, part, node, label = (table.column(i).to_numpy() for i in range(6))
        sig, keys = _rows(table.column(6), np.uint8), _rows(table.column(7), np.int64)
        band = (keys == bucket[:, None]).argmax(1)  # which band this bucket is of
        end = np.searchsorted(group, group, "right")
        found = []
        rows = np.arange(len(group))
        room = np.cumsum(end - rows - 1)
        lo = 0
        while lo < len(rows):  # some million pairs at a time
            hi = max(lo + 1, int(np.searchsorted(room, (room[lo - 1] if lo else 0) + (1 << 20), "right")))
            n = (end - rows - 1)[lo:hi]
            i = np.repeat(rows[lo:hi], n)
            j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)
            ok = (label[i] != label[j]) & ((p[i] == q[i]) | (part[i] != part[j]))
            i, j = i[ok], j[ok]
            left = survivors(sig, sig, i, j, plan)
            i, j = i[left], j[left]
            first = (keys[i] == keys[j]).argmax(1)  # another bucket, of an earlier band, has the pair
            i, j = i[first == band[i]], j[first == band[i]]
            found.append((np.minimum(node[i], node[j]), np.maximum(node[i], node[j])))
            lo = hi
        a, b = (np.concatenate(x) for x in zip(*found, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            table = pa.Table.from_batches(held).combine_chunks()
            ids = np.stack([table.column(i).to_numpy() for i in range(3)])
            new = np.concatenate([[True], (ids[:, 1:] != ids[:, :-1]).any(0)])
            last = int(np.flatnonzero(new)[-1])  # the last group may go on
            if last:
                yield pairs(table.slice(0, last).combine_chunks(), np.cumsum(new)[:last])
            held = table.slice(last).combine_chunks().to_batches()
        if held:
            table = pa.Table.from_batches(held)
            yield pairs(table, np.zeros(len(table), np.int64))

    return dealt.mapInArrow(run, "a long, b long")


def _band_keys(sig: np.ndarray, plan: Plan) -> np.ndarray:
    minima = sig.astype(C.U).reshape(len(sig), plan.bands, plan.rows)
    keys = np.broadcast_to(np.arange(1, plan.bands + 1, dtype=C.U) * C.U(C.BASE), (len(sig), plan.bands)).copy()
    for i in range(plan.rows):
        keys = C.mix(keys ^ (minima[:, :, i] * C.U(0xD6E8FEB86659FD93)))
    return keys.view(np.int64)


def keep_one(docs: DataFrame, plan: Plan = Plan()) -> DataFrame:
    """One row of each component, the smallest doc_id's, a null one's only where there is no other; rows without words all stay."""
    done = C.save(_linked(docs, plan, "doc_id", "text"), "linked")
    place = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "code")).alias("p")
    kept = done.where("label is not null").groupBy("label").agg(place).select("p.doc_id", "p.code")
    kept = kept.select(F.col("doc_id").alias("_id"), F.col("code").alias("_code"), F.lit(True).alias("_one"))
    none = done.where("label is null").select("doc_id", "code", F.lit(False)).distinct()
    rows = docs.select(C.packed(docs), F.col("doc_id").cast("long").alias("_doc"), F.xxhash64("text").alias("_text"))
    rows = rows.join(kept.union(none), F.col("_doc").eqNullSafe(F.col("_id")) & (F.col("_text") == F.col("_code")))
    # where several rows are equal in doc_id and text, one of them
    several = done.where("label is not null").groupBy(F.col("doc_id").alias("_twin"), F.col("code").alias("_twin_code")).agg(F.count("*").alias("_n")).where("_n > 1")
    rows = rows.join(several, F.col("_doc").eqNullSafe(F.col("_twin")) & (F.col("_text") == F.col("_twin_code")), "left")
    twins = rows.where("_one and _n is not null").groupBy("_doc", "_text").agg(F.first("_row").alias("_row")).select("_row")
    return rows.where("not _one or _n is null").select("_row").union(twins).select("_row.*")


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(C.documents(spark, sf_dir), Plan(words=3, percent=85))


#: All pairs of different sets that share a shingle, without signatures; for small tables.
ORACLE_SQL = r"""
with recursive d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
s as materialized (select doc_id, list_sort(case when len(w) >= 3 then list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as x from d),
one as materialized (select x, min(doc_id) as node from s where len(x) > 0 group by x),
flat as materialized (select node, len(x) as n, unnest(x) as g from one),
pair as (select a.node as a, b.node as b, any_value(a.n) as na, any_value(b.n) as nb, count(*) as common from flat a join flat b on a.g = b.g and a.node < b.node group by a.node, b.node),
link as materialized (select a, b from pair where 100 * common >= 85 * (na + nb - common) union all select b, a from pair where 100 * common >= 85 * (na + nb - common)),
reach(node, other) as (select node, node from one union select r.node, l.b from reach r join link l on r.other = l.a),
label as (select node, min(other) as component from reach group by node)
select s.doc_id, len(s.x)::bigint as n_shingles, coalesce(component, s.doc_id) as component_id, coalesce(component, s.doc_id) = s.doc_id as kept
from s left join one on s.x = one.x left join label on one.node = label.node"""
