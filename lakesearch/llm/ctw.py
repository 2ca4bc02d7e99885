"""Language-model scores by context-tree weighting, beside a unigram word model.

A text's symbols are its UTF-8 bytes, A-Z in lower case, and an end, the byte 255
that UTF-8 never has.  A byte is eight binary decisions, a path through a tree of
255; each decision has a context tree of its own over the `DEPTH` bytes before,
nearest first, a line feed standing before the start.  Contexts are the bytes
themselves, and every context of the training texts has a node of its own at every
depth, however rare: the model grows with the corpus.

Every node has the Krichevsky-Trofimov estimate of its zeros and ones, over all
training texts; a node's weighted probability is half its own and half the product
of its children's.  The predictive probability mixes the estimates of all depths by
the resulting posterior weights; a context never seen says what its parent says.
For a fixed corpus the probability of a byte in a context is one number.

1. One pass counts pairs of context and byte, summed within each task and then by key;
   pairs of texts that do not train are there with a count of zero.
2. The pairs are dealt out by the three nearest bytes, so all nodes from depth `TOP` + 1
   down that hang together are in one bucket, and a task weights buckets in blocks
   from the leaves up.  There are 8 buckets for each of `spark.sql.shuffle.partitions`;
   a bucket fits in a task.  Sums for the nodes of depth `TOP`, at most 65536 contexts,
   go to the driver, which weights the rest and hands down what depths 0 to `TOP` say.
3. The same tasks go from there to the leaves and give each pair its log probability:
   a table as long as there are different pairs.
4. Texts are scored by that table.  The `PAIRS` most frequent pairs, at most, are
   broadcast; the other occurrences meet their values in a join, no key of which is
   frequent, and go back to their rows by a row number.

Words are counted by their 64-bit hashes in the first pass, and meet their counts as
pairs do: those of one part in `FREQUENT` of all tokens by broadcast, the rest by join.

Null text counts as empty: one end token.  A null doc_id trains and is not held
out.  Rows that repeat a doc_id are scored one by one.  An empty corpus gives the
even distribution.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

DEPTH = 6
TOP = 2
PAIRS = 1 << 21
FREQUENT = 1 << 20
HELD = 1 << 22
BLOCK = 1 << 18
END = 255
END_WORD = 0x5F5E_454E_445F_5F5F  # stands for the end among word hashes
_START = 10
_LOG2 = math.log(2)


def codes(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A context and symbol for each byte and each row's end, and the borders: seven bytes, the nearest the highest and the symbol the lowest."""
    ends = bounds[1:] + np.arange(len(bounds) - 1)
    own = np.full(len(data) + len(ends), END, np.int64)
    inside = np.ones(len(own), bool)
    inside[ends] = False
    own[inside] = C.LOWER[data]
    first = bounds + np.arange(len(bounds))
    before = own
    code = own.copy()
    for d in range(1, DEPTH + 1):
        before = np.concatenate([[_START], before[:-1]])
        before[first[:-1]] = _START
        code |= before << (8 * (DEPTH + 1 - d))
    return code, first


def _lgamma(x: np.ndarray) -> np.ndarray:
    """log gamma for x >= 0.5, by Stirling's series after eight steps of the recurrence."""
    steps = x + 0.0
    for i in range(1, 8):
        steps *= x + i  # eight factors of at most 1e15 each stay far below the largest float
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - np.log(steps)


def _long_kt(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return _lgamma(a + 0.5) + _lgamma(b + 0.5) - math.log(math.pi) - _lgamma(a + b + 1)


_SMALL = 64
_KT = _long_kt(np.repeat(np.arange(_SMALL), _SMALL).astype(float), np.tile(np.arange(_SMALL), _SMALL).astype(float))


def _kt(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The log of the Krichevsky-Trofimov probability of a zeros and b ones; small counts, which most nodes have, by a table."""
    large = np.flatnonzero((a >= _SMALL) | (b >= _SMALL))
    out = _KT[np.minimum(a * _SMALL + b, len(_KT) - 1).astype(np.int64)]
    out[large] = _long_kt(a[large], b[large])
    return out


def _starts(x: np.ndarray) -> np.ndarray:
    """Where the runs of equal values begin."""
    return np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))


def _sums(code: np.ndarray, n: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By depth from DEPTH to TOP + 1: the pairs of context and symbol, ascending, and their counts."""
    order = np.argsort(code)
    key, n = code[order], n[order]
    out = {DEPTH: (key, n)}
    for d in range(DEPTH - 1, TOP, -1):
        key = ((key >> 16) << 8) | (key & 255)  # without the farthest byte
        order = np.argsort(key, kind="stable")
        key, n = key[order], n[order]
        at = _starts(key)
        key, n = key[at], np.add.reduceat(n, at)
        out[d] = (key, n)
    return out


Nodes = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def _up(sums: dict[int, tuple[np.ndarray, np.ndarray]], j: int) -> dict[int, Nodes]:
    """The decisions about bit j by depth: node (context << j | bits before), zeros, ones, own and weighted log probability."""
    out: dict[int, Nodes] = {}
    for d in range(DEPTH, TOP, -1):
        key, n = sums[d]
        node = key >> (8 - j)
        at = _starts(node)
        node, total = node[at], np.add.reduceat(n, at).astype(float)
        ones = np.add.reduceat(np.where((key >> (7 - j)) & 1, n, 0), at).astype(float)
        own = weighted = _kt(total - ones, ones)
        if d < DEPTH:
            below = out[d + 1]
            weighted = np.logaddexp(own, np.bincount(np.searchsorted(node, _parents(below[0], j)), below[4], len(node))) - _LOG2
        out[d] = (node, total - ones, ones, own, weighted)
    return out


def _parents(node: np.ndarray, j: int) -> np.ndarray:
    return ((node >> (j + 8)) << j) | (node & ((1 << j) - 1))


def _named(node: np.ndarray, j: int) -> np.ndarray:
    """Nodes of all bits in one: context << 8 | 1 << j | bits before."""
    return ((node >> j) << 8) | (1 << j) | (node & ((1 << j) - 1))


def upper_sums(code: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
    """For the nodes of depth TOP: name, zeros, ones, and the sum of their children's weighted log probabilities, of a block of pairs."""
    sums, parts = _sums(code, n), []
    for j in range(8):
        node, a, b, _, weighted = _up(sums, j)[TOP + 1]
        own, back = np.unique(_named(_parents(node, j), j), return_inverse=True)
        parts.append((own, *(np.bincount(back, x, len(own)) for x in (a, b, weighted))))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _down(state: tuple[np.ndarray, ...], at: np.ndarray, a: np.ndarray, b: np.ndarray, own: np.ndarray, weighted: np.ndarray) -> tuple[np.ndarray, ...]:
    """said, left, estimate and share of nodes from those of their parents: what shallower nodes have said, the weight
    left, the estimate of the deepest node seen, and its share of the weight left."""
    said, left, last, share = (x[at] for x in state)
    seen = a + b > 0
    return (
        np.where(seen, said + left * share * last, said), np.where(seen, left * (1 - share), left),
        np.where(seen, (b + 0.5) / (a + b + 1), last), np.where(seen, np.exp(own - _LOG2 - weighted), 0.0),
    )


class Upper:
    """What depths 0 to TOP say to the nodes of depth TOP."""

    def __init__(self, name: np.ndarray, a: np.ndarray, b: np.ndarray, below: np.ndarray):
        levels = []
        for _ in range(TOP + 1):
            order = np.argsort(name)
            name, a, b, below = name[order], a[order], b[order], below[order]
            own = _kt(a, b)
            weighted = np.logaddexp(own, below) - _LOG2
            levels.append((name, a, b, own, weighted))
            up, back = np.unique(((name >> 16) << 8) | (name & 255), return_inverse=True)
            name, a, b, below = up, *(np.bincount(back, x, len(up)) for x in (a, b, weighted))
        name, a, b, own, weighted = levels.pop()
        state = (np.zeros(len(name)), np.ones(len(name)), (b + 0.5) / (a + b + 1), np.exp(own - _LOG2 - weighted))
        while levels:
            above, (name, a, b, own, weighted) = name, levels.pop()
            state = _down(state, np.searchsorted(above, ((name >> 16) << 8) | (name & 255)), a, b, own, weighted)
        self.name, self.state = name, state


def log10s(upper: Upper, code: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of a block, ascending, and their log10 probabilities."""
    sums = _sums(code, n)
    key = sums[DEPTH][0]
    out = np.zeros(len(key))
    for j in range(8):
        nodes = _up(sums, j)
        state, above = upper.state, None
        for d in range(TOP + 1, DEPTH + 1):
            up = _parents(nodes[d][0], j)
            at = np.searchsorted(upper.name, _named(up, j)) if above is None else np.searchsorted(above, up)
            state, above = _down(state, at, *nodes[d][1:]), nodes[d][0]
        one = (state[0] + state[1] * state[2])[np.searchsorted(above, key >> (8 - j))]
        out += np.log10(np.where((key >> (7 - j)) & 1, one, 1 - one))
    return key, out


class Table:
    """Values by key, found by open addressing; the slots are filled where it is first asked."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.keys, self.values, self.slots = keys, values, None

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(whether there, the value or 0) of each key."""
        if self.slots is None:
            self.bits = max(4, int(4 * len(self.keys) - 1).bit_length())
            self.slots = np.full(1 << self.bits, -1, np.int32)
            left, at = np.arange(len(self.keys), dtype=np.int32), self._home(self.keys)
            while len(left):
                free = self.slots[at] < 0
                self.slots[at[free]] = left[free]  # of several for one slot the last stays
                again = self.slots[at] != left
                left, at = left[again], (at[again] + 1) & ((1 << self.bits) - 1)
        out, there = np.zeros(len(keys), self.values.dtype), np.zeros(len(keys), bool)
        left, at = np.arange(len(keys)), self._home(keys)
        while len(left):
            slot = self.slots[at]
            some = np.flatnonzero(slot >= 0)
            left, at, slot = left[some], at[some], slot[some]
            hit = self.keys[slot] == keys[left]
            there[left[hit]], out[left[hit]] = True, self.values[slot[hit]]
            left, at = left[~hit], (at[~hit] + 1) & ((1 << self.bits) - 1)
        return there, out

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(C.U) * C.U(C.BASE)) >> C.U(64 - self.bits)).astype(np.int64)


Counts = tuple[np.ndarray, np.ndarray, np.ndarray]


def _summed(parts: list[Counts]) -> Counts:
    """Distinct keys, ascending, with the sums of their counts."""
    keys, n, m = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(keys, kind="stable")
    keys, n, m = keys[order], n[order], m[order]
    at = _starts(keys)
    return keys[at], np.add.reduceat(n, at, dtype=np.int64), np.add.reduceat(m, at, dtype=np.int64)


def _tally(keys: np.ndarray, trains: np.ndarray) -> list[Counts]:
    """Distinct keys with how many of them train and how many there are."""
    out = []
    for part, yes in ((keys[trains], 1), (keys[~trains], 0)):
        if len(part):
            own, m = np.unique(part, return_counts=True)
            m = m.astype(np.int32)  # of a chunk
            out.append((own, m * np.int32(yes), m))
    return out


def packed(counts: Counts) -> bytes:
    """Ascending keys and their counts in few bytes: differences, turned so that equal bytes stand together, compressed."""
    keys, n, m = (x.astype(np.int64) for x in counts)
    keys = np.diff(keys, prepend=np.int64(0))
    planes = np.concatenate([x.view(np.uint8).reshape(-1, 8).T.ravel() for x in (keys, n, m)])
    return pa.Codec("zstd", compression_level=1).compress(planes.tobytes(), asbytes=True)


def unpacked(blob: bytes, size: int) -> Counts:
    planes = np.frombuffer(pa.Codec("zstd").decompress(blob, 24 * size, asbytes=True), np.uint8).reshape(3, 8, size)
    keys, n, m = (np.ascontiguousarray(x.T).view(np.int64).ravel() for x in planes)
    return np.cumsum(keys), n, m


_PACKED = "kind int, bucket int, size int, blob binary"


def _packed_rows(kind: int, buckets: list[int], parts: list[Counts]) -> pa.RecordBatch:
    size = pa.array([len(x[0]) for x in parts], pa.int32())
    return pa.RecordBatch.from_arrays([pa.array([kind] * len(parts), pa.int32()), pa.array(buckets, pa.int32()), size, pa.array([packed(x) for x in parts], pa.binary())], names=["kind", "bucket", "size", "blob"])


def count(docs: DataFrame, trains: Column, text: str) -> DataFrame:
    """kind (0: words, 1: pairs of context and symbol), bucket, size and blob, its keys with n (in training texts) and m (in all), of all rows of `docs`.

    Each task sums first and packs what it has by bucket; a bucket is then merged as a whole.  Pairs
    with the three nearest bytes in common share a bucket.
    """
    spark = docs.sparkSession
    C.small_batches(spark)
    n_buckets = max(64, 8 * int(spark.conf.get("spark.sql.shuffle.partitions")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[Counts]] = [[], []]
        size = [0, 0]
        rows = np.zeros(2, np.int64)

        def emit(kind: int) -> Iterator[pa.RecordBatch]:
            keys, n, m = _summed(held[kind])
            held[kind], size[kind] = [], 0
            bucket = (C.mix((keys >> 32 if kind else keys).astype(C.U)) % C.U(n_buckets)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            keys, n, m, bucket = keys[order], n[order], m[order], bucket[order]
            cut = [*_starts(bucket).tolist(), len(bucket)]
            for lo in range(0, len(cut) - 1, 64):
                ends = cut[lo : lo + 65]
                yield _packed_rows(kind, bucket[ends[:-1]].tolist(), [(keys[a:b], n[a:b], m[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)])

        for batch, data, bounds in C.chunks(batches, "_text"):
            learns = batch.column(0).to_numpy(zero_copy_only=False).astype(bool)
            rows += (learns.sum(), len(learns))
            starts, ends, first = C.word_spans(data, bounds, ~C.SPACE[data])
            code, at = codes(data, bounds)
            for kind, (keys, border) in enumerate(((C.span_hashes(C.LOWER[data], starts, ends).view(np.int64), first), (code, at))):
                held[kind] += (found := _tally(keys, np.repeat(learns, np.diff(border))))
                size[kind] += sum(len(x[0]) for x in found)
                if size[kind] > HELD:
                    held[kind] = [_summed(held[kind])]
                    size[kind] = len(held[kind][0][0])
                    if size[kind] > HELD // 2:
                        yield from emit(kind)
        if rows[1]:
            held[0].append((np.array([END_WORD], np.int64), rows[:1], rows[1:]))
        for kind in (0, 1):
            if held[kind]:
                yield from emit(kind)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, size = None, [], 0
        for batch in batches:
            for kind, bucket, n, blob in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if now is not None and now != (kind, bucket):
                    yield _packed_rows(now[0], [now[1]], [_summed(held)])
                    held, size = [], 0
                now = (kind, bucket)
                held.append(unpacked(blob, n))
                size += n
                if size > HELD:
                    held = [_summed(held)]
                    size = len(held[0][0]) // 2  # so that a bucket over the bound is summed as it doubles
        if held:
            yield _packed_rows(now[0], [now[1]], [_summed(held)])

    found = docs.select(F.coalesce(trains, F.lit(False)).alias("_trains"), F.col(text).alias("_text")).mapInArrow(run, _PACKED)
    return found.repartition("kind", "bucket").sortWithinPartitions("kind", "bucket").mapInArrow(merge, _PACKED)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[Counts]:
    """Blocks of whole buckets of some `BLOCK` keys."""
    held: list[Counts] = []
    size = 0
    for batch in batches:
        for n, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            held.append(unpacked(blob, n))
            size += n
            if size >= BLOCK:
                yield tuple(np.concatenate(x) for x in zip(*held, strict=True))
                held, size = [], 0
    if held:
        yield tuple(np.concatenate(x) for x in zip(*held, strict=True))


def counted(buckets: DataFrame) -> DataFrame:
    """key, n, m of packed buckets (size, blob)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches):
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in block], names=["key", "n", "m"])

    return buckets.select("size", "blob").mapInArrow(run, "key long, n long, m long")


def pair_values(buckets: DataFrame) -> DataFrame:
    """key, m, value (log10 of the byte's probability in its context) of packed buckets of pairs (size, blob)."""
    spark = buckets.sparkSession
    dealt = buckets.select("size", "blob")

    def lift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, n, _ in _blocks(batches):
            name, a, b, below = upper_sums(key, n)
            yield pa.RecordBatch.from_arrays([pa.array(name), pa.array(a), pa.array(b), pa.array(below)], names=["name", "a", "b", "below"])

    sums = dealt.mapInArrow(lift, "name long, a double, b double, below double").groupBy("name").agg(*(F.sum(c).alias(c) for c in ("a", "b", "below")))
    rows = sums.toArrow()  # 255 for each of 65536 contexts at the very most
    if not len(rows):
        return counted(buckets).select("key", "m", F.lit(0.0).cast("float").alias("value"))
    shared = spark.sparkContext.broadcast(Upper(*(rows.column(c).to_numpy() for c in ("name", "a", "b", "below"))))

    def lower(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, n, m in _blocks(batches):
            own, value = log10s(shared.value, key, n)
            yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(m[np.argsort(key)]), pa.array(value.astype(np.float32))], names=["key", "m", "value"])

    return dealt.mapInArrow(lower, "key long, m long, value float")


def score(docs: DataFrame, trains: Column, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte for every row of `docs`."""
    spark = docs.sparkSession
    counts = C.save(count(docs, trains, text), "counts")
    words = C.save(counted(counts.where("kind = 0")), "words")
    total, distinct, all_tokens, end_count = words.agg(*(F.coalesce(x, F.lit(0)) for x in (F.sum("n"), F.count_if(F.col("n") > 0), F.sum("m"), F.sum(F.when(F.col("key") == END_WORD, F.col("n")))))).first()
    rate = math.log10(total + 0.1 * (distinct + 1))
    pairs = C.save(pair_values(counts.where("kind = 1")), "pairs")
    steps = pairs.agg(*(F.count_if(F.col("m") >= 1 << k) for k in range(62))).first()
    often = 1 << next(k for k, n in enumerate(steps) if n <= PAIRS)
    least = max(1, -(-all_tokens // FREQUENT))

    def table(rows: DataFrame, value: str) -> Table:
        found = rows.select("key", value).toArrow()  # FREQUENT or PAIRS rows at most
        return Table(found.column("key").to_numpy(), found.column(value).to_numpy())

    shared = spark.sparkContext.broadcast((table(words.where(F.col("m") >= least), "n"), table(pairs.where(F.col("m") >= often), "value")))
    schema = "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double, n_bytes long, rare array<long>, rare_pairs array<long>"
    names = [x.split()[0] for x in schema.split(", ")]

    def lists(found: np.ndarray, keys: np.ndarray, border: np.ndarray) -> pa.Array:
        rare = np.flatnonzero(~found)
        return pa.ListArray.from_arrays(pa.array(np.searchsorted(rare, border).astype(np.int32)), pa.array(keys[rare].view(np.int64)))

    def between(values: np.ndarray, border: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(values) + 1)
        np.cumsum(values, out=sums[1:], dtype=np.float64)
        return sums[border[1:]] - sums[border[:-1]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_word, by_pair = shared.value
        number = TaskContext.get().partitionId() << 36
        for batch, data, bounds in C.chunks(batches, "_text"):
            n = batch.num_rows
            code, first = codes(data, bounds)
            pair_found, value = by_pair.find(code)
            starts, ends, word_at = C.word_spans(data, bounds, ~C.SPACE[data])
            own, back = np.unique(C.span_hashes(C.LOWER[data], starts, ends), return_inverse=True)
            found, times = by_word.find(own.view(np.int64))
            logs = np.where(found, np.log10(times.astype(np.float64) + 0.1), 0.0)
            yield pa.RecordBatch.from_arrays([
                pa.array(number + np.arange(n)), batch.column(0), batch.column(1), pa.array(np.diff(word_at) + 1),
                pa.array(C.per_row((found & (times > 0))[back], word_at) + (end_count > 0)), pa.array(between(logs[back], word_at) + math.log10(end_count + 0.1)),
                pa.array(between(value, first)), pa.array(np.diff(bounds)), lists(found[back], own[back], word_at), lists(pair_found, code, first),
            ], names=names)
            number += n

    plain = docs.select(F.col(key).cast("long").alias("doc_id"), (~trains).alias("held_out"), F.col(text).alias("_text"))
    rows = C.save(plain.mapInArrow(run, schema), "scored")
    values = words.where(F.col("m") < least).select(F.lit(0).alias("kind"), "key", F.log10(F.col("n") + 0.1).alias("value"), (F.col("n") > 0).cast("int").alias("known"))
    values = values.union(pairs.where(F.col("m") < often).select(F.lit(1), "key", F.col("value").cast("double"), F.lit(0)))
    rare = rows.select("row", F.lit(0).alias("kind"), F.explode("rare").alias("key")).union(rows.select("row", F.lit(1), F.explode("rare_pairs")))
    part = lambda k: F.sum(F.when(F.col("kind") == k, F.col("value")).otherwise(0.0))
    rare = rare.join(values, ["kind", "key"]).groupBy(F.col("row").alias("of")).agg(part(0).alias("more"), F.sum("known").alias("more_known"), part(1).alias("more_score"))
    done = rows.drop("rare", "rare_pairs").join(rare, F.col("row") == F.col("of"), "left")
    n_known = F.col("n_known") + F.coalesce("more_known", F.lit(0))
    base = F.col("base") + F.coalesce("more", F.lit(0.0)) - F.col("n_tokens") * F.lit(rate)
    model = F.col("score") + F.coalesce("more_score", F.lit(0.0))
    return done.select("doc_id", "held_out", "n_tokens", n_known.alias("n_known"), F.lit(int(total)).cast("long").alias("train_tokens"), base.alias("base_score"), model.alias("score"), (-model * math.log2(10) / (F.col("n_bytes") + 1)).alias("bits_per_byte"))


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(10)) == 0, F.lit(False))
    return score(C.documents(spark, sf_dir), ~held)
