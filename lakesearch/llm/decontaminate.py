"""Benchmark decontamination by greedy string tiling.

A benchmark is a query set against all documents.  It is read in blocks of at
most `BLOCK` bytes of text, so what is broadcast is bounded, and each block is
held against every document.

Words are runs of letters, marks and digits of any script, in lower case; in scripts
that are written without spaces (`UNSPACED`) each character is a word.
A block's seeds are the hashes of its runs of `match` words; a document meets an
item where a seed of both is equal.  For each such pair the tiling runs: the
longest match that touches no word marked before, in the item or the document, is
marked; what such marks leave of other matches counts again if it still has
`match` words.  Of equally long ones the first in the item, then the first in the
document, goes first.  The marked words, in whatever order the document has the
passages, are the item's coverage.

An item of fewer than `match` words is found where all its words stand one after the
other; `short=False` leaves such items out, as they cannot be told from common phrases.
Null or empty texts match nothing.  Rows that repeat a doc_id or an
item_id give one row for the pair, with the largest coverage.  Rows with a null id
are kept apart from other ids and reported under null.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

BLOCK = 8 << 20
MATCH = 5
COVERAGE = 0.5
_BITS = 22
#: Scripts written without spaces between words.
UNSPACED = ("Han", "Hiragana", "Katakana", "Thai", "Lao", "Khmer", "Myanmar", "Tibetan")


@lru_cache
def _characters() -> tuple[np.ndarray, np.ndarray]:
    """By code point: 0 no word's, 1 a word's, 2 a word by itself; and its lower case."""
    points = [i for i in range(0x110000) if not 0xD800 <= i < 0xE000]
    every = "".join(map(chr, points))
    shift = lambda at: at if at < 0xD800 else at + 0x800
    kind, low = np.zeros(0x110000, np.uint8), np.arange(0x110000, dtype=np.uint32)
    for value, pattern in ((1, r"[\p{L}\p{M}\p{N}]+"), (2, f"[{''.join(rf'\p{{Script={x}}}' for x in UNSPACED)}]+")):
        for m in regex.finditer(pattern, every):
            a, b = shift(m.start()), shift(m.end() - 1) + 1
            kind[a:b] = np.where(kind[a:b] > 0, value, 0) if value == 2 else value
    for m in regex.finditer(r"[\p{Lu}\p{Lt}]", every):
        if len(x := m[0].lower()) == 1:
            low[ord(m[0])] = ord(x)
    return kind, low


def folded_words(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and each row's first."""
    kind, low = _characters()
    if len(data) and data.max() >= 0x80:
        before = np.zeros(len(data) + 1, np.int64)
        np.cumsum((data & 0xC0) != 0x80, out=before[1:])
        points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le", "replace"), np.uint32)
        if len(points) == before[-1]:
            data, bounds = points, before[bounds]
    sort = kind[data]
    starts, ends, first = C.word_spans(data, bounds, sort > 0)
    alone = sort == 2
    if alone.any():  # cut before and after each character that is a word by itself
        edge = np.zeros(len(data) + 1, bool)
        edge[starts] = True
        at = np.flatnonzero(alone)
        edge[at] = True
        after = at[at + 1 < len(data)] + 1
        edge[after[(sort[after] > 0) & ~np.isin(after, bounds)]] = True
        starts = np.flatnonzero(edge[:-1])
        ends = np.minimum(np.append(starts[1:], len(data)), ends[np.searchsorted(ends, starts, "right")])
        first = np.searchsorted(starts, bounds)
    return C.span_hashes(low[data], starts, ends), first


def tiles(doc: np.ndarray, item: np.ndarray, p: np.ndarray, t: np.ndarray, match: int) -> list[tuple[int, int, int]]:
    """Greedy tiling from seed positions p (document) and t (item): (item start, document start, length)."""
    order = np.lexsort((p, p - t))
    p, t = p[order], t[order]
    cut = np.ones(len(p) + 1, bool)
    cut[1:-1] = (p[1:] != p[:-1] + 1) | (t[1:] != t[:-1] + 1)
    at = np.flatnonzero(cut)
    heap = [(-(int(b - a) + match - 1), int(t[a]), int(p[a])) for a, b in zip(at[:-1], at[1:], strict=True)]
    heapq.heapify(heap)
    in_doc, in_item, found = np.zeros(len(doc), bool), np.zeros(len(item), bool), []
    while heap:
        n, ti, pi = heapq.heappop(heap)
        n = -n
        used = in_doc[pi : pi + n] | in_item[ti : ti + n] | (doc[pi : pi + n] != item[ti : ti + n])
        if not used.any():
            in_doc[pi : pi + n] = in_item[ti : ti + n] = True
            found.append((ti, pi, n))
            continue
        edge = np.flatnonzero(np.diff(np.concatenate([[True], used, [True]]).astype(np.int8)))
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            if b - a >= match:
                heapq.heappush(heap, (-(b - a), ti + a, pi + a))
    return found


class _Seeds:
    """The seeds of k words of some items: a bitmap to pass most words by, the sorted hashes, and where each occurs."""

    def __init__(self, words: list[np.ndarray], items: list[int], k: int):
        sizes = np.array([len(words[i]) for i in items])
        first = np.concatenate([[0], np.cumsum(sizes)])
        grams, at = C.gram_hashes(np.concatenate([words[i] for i in items]), first, k)
        order = np.argsort(grams, kind="stable")
        item = np.searchsorted(first, at, "right") - 1
        self.seeds, start = np.unique(grams[order], return_index=True)
        self.start = np.append(start, len(grams))
        self.item, self.pos = np.array(items)[item][order], (at - first[item])[order]
        self.bitmap = np.zeros(1 << _BITS, bool)
        self.bitmap[(self.seeds >> C.U(64 - _BITS)).astype(np.int64)] = True

    def hits(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which grams are seeds, and which seeds they are."""
        some = np.flatnonzero(self.bitmap[(grams >> C.U(64 - _BITS)).astype(np.int64)])
        where = np.searchsorted(self.seeds, grams[some])
        ok = where < len(self.seeds)
        ok[ok] = self.seeds[where[ok]] == grams[some[ok]]
        return some[ok], where[ok]


class _Index:
    """A block's items and their seeds by number of words: `match`, or all that a shorter item has."""

    def __init__(self, texts: list[str], match: int, short: bool):
        data, bounds = C.text_bytes(pa.array(texts, pa.string()))
        words, first = folded_words(data, bounds)
        self.words = [words[a:b] for a, b in zip(first[:-1], first[1:], strict=True)]
        by_size: dict[int, list[int]] = {}
        for i, w in enumerate(self.words):
            if len(w) >= match or (short and len(w)):
                by_size.setdefault(min(match, len(w)), []).append(i)
        self.by_size = {k: _Seeds(self.words, items, k) for k, items in by_size.items()}


def _pairs(index: _Index, data: np.ndarray, bounds: np.ndarray, coverage: float) -> Iterator[tuple[int, int, int, int, int, int]]:
    """(row, item, words of the item, covered words, tiles, longest tile) of the leaks in a chunk."""
    words, first = folded_words(data, bounds)
    for k, seeds in index.by_size.items():
        grams, at = C.gram_hashes(words, first, k)
        some, seed = seeds.hits(grams)
        rows = np.searchsorted(first, at[some], "right") - 1
        edge = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1], [True]])) if len(rows) else []
        for a, b in zip(edge[:-1], edge[1:], strict=True):
            row, n = int(rows[a]), seeds.start[seed[a:b] + 1] - seeds.start[seed[a:b]]
            own = at[some[a:b]] - first[row]
            flat = np.repeat(seeds.start[seed[a:b]] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
            order = np.argsort(seeds.item[flat], kind="stable")
            item, t, p = seeds.item[flat][order], seeds.pos[flat][order], np.repeat(own, n)[order]
            cut = np.flatnonzero(np.concatenate([[True], item[1:] != item[:-1], [True]]))
            for lo, hi in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                i = int(item[lo])
                size = len(index.words[i])
                reach = np.zeros(size + 1, np.int64)
                np.add.at(reach, t[lo:hi], 1)
                np.add.at(reach, t[lo:hi] + k, -1)
                if (np.cumsum(reach[:-1]) > 0).sum() < coverage * size:
                    continue  # even all matches together do not cover enough
                found = tiles(words[first[row] : first[row + 1]], index.words[i], p[lo:hi], t[lo:hi], k)
                covered = sum(x[2] for x in found)
                if found and covered >= coverage * size:
                    yield row, i, size, covered, len(found), max(x[2] for x in found)


def leaks(docs: DataFrame, benchmark: DataFrame, match: int = MATCH, coverage: float = COVERAGE, block: int = BLOCK, short: bool = True, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document and benchmark item of which it covers `coverage` or more."""
    spark = docs.sparkSession
    C.small_batches(spark)
    schema = "doc_id long, item_id long, n_item_words long, n_covered long, n_tiles long, longest_tile long"
    names = [x.split()[0] for x in schema.split(", ")]
    plain = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("_text"))

    def scan(items: list[tuple[int | None, str]]) -> DataFrame:
        ids = [x for x, _ in items]
        shared = spark.sparkContext.broadcast(_Index([x for _, x in items], match, short))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for batch, data, bounds in C.chunks(batches, "_text"):
                if found := list(_pairs(index, data, bounds, coverage)):
                    row, item, *rest = zip(*found, strict=True)
                    key_ = batch.column(0).take(pa.array(row, pa.int64()))
                    yield pa.RecordBatch.from_arrays([key_, pa.array([ids[i] for i in item], pa.int64()), *(pa.array(x, pa.int64()) for x in rest)], names=names)

        return plain.mapInArrow(run, schema)

    found, held, size = None, [], 0
    for item in benchmark.select(F.col("item_id").cast("long"), "text").where("text is not null").distinct().toLocalIterator():
        held.append((item[0], item[1]))
        size += len(item[1].encode())
        if size >= block:
            found, held, size = (scan(held) if found is None else found.union(scan(held))), [], 0
    if held or found is None:
        found = scan(held) if found is None else found.union(scan(held))
    best = found.groupBy("doc_id", "item_id").agg(F.max(F.struct(F.col("n_covered") / F.col("n_item_words"), *names[2:])).alias("best"))
    return best.select("doc_id", "item_id", *(f"best.{x}" for x in names[2:]), (F.col("best.n_covered") / F.col("best.n_item_words")).alias("coverage"))


def remove_leaks(docs: DataFrame, benchmark: DataFrame, **options: object) -> DataFrame:
    """The rows of `docs` that leak no benchmark item; short items, which any text may hold by chance, remove nothing."""
    found = leaks(docs, benchmark, **{"short": False, **options}).select(F.col("doc_id").alias("_leak")).distinct()
    return docs.join(found, docs["doc_id"].eqNullSafe(found["_leak"]), "left_anti")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(C.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
