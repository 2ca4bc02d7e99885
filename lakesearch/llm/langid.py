"""Language identification by a byte convolutional network, trained here in numpy.

Input is the UTF-8 text with A-Z in lower case, cut into windows of `LENGTH` bytes
that overlap by the widest filter less one, the last padded with zeros.  Filters of
several widths slide over a window, each keeps its largest response (max pooling),
rectified, and a linear layer with softmax gives the languages' probabilities.  A
document's are the mean over its windows, weighted by their bytes, so every byte of
a text counts and no text is cut.

Training uses about `PER_LABEL` different documents of each language, one at least,
those of the smallest hashes of doc_id and text, and of each a passage of `EXCERPT`
characters from any place in it; crops of random length teach short texts too.  Applying the network needs two table lookups for a filter of four
bytes, since a response is a sum over byte pairs.

`und` with score 0 is the answer for null texts and texts without a letter, and for
all if no labelled row can be learned from.  Labels that are null and texts
that are null or empty are not learned.
Other columns, doc_id and source included, are never inputs of a prediction.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C

LENGTH = 256
WIDTHS = (2, 3, 4)
FILTERS = 16
PER_LABEL = 1500
EXCERPT = 3000
STEPS = 1400
BATCH = 128
_LETTER = regex.compile(rb"[A-Za-z]")
_ANY_LETTER = regex.compile(r"\p{L}")


@dataclass
class Network:
    """filters: by width, [width, 256, FILTERS] weights; out: [features, labels]."""

    labels: list[str]
    filters: list[np.ndarray]
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    def tables(self) -> list[list[np.ndarray]]:
        """For each width, the responses to byte pairs, and to the last byte of an odd width."""
        found = []
        for w in self.filters:
            parts = [(w[i][:, None, :] + w[i + 1][None, :, :]).reshape(65536, -1) for i in range(0, len(w) - 1, 2)]
            if len(w) % 2:
                parts.append(w[-1])
            found.append([np.ascontiguousarray(p, np.float32) for p in parts])
        return found


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def train(texts: list[bytes], labels: list[str], seed: int = 0, steps: int = STEPS) -> Network:
    """Adam on cross-entropy; max pooling sends each gradient to one place of a window."""
    rng = np.random.default_rng(seed)
    names = sorted(set(labels))
    by_label = [[t for t, x in zip(texts, labels, strict=True) if x == name and t] for name in names]
    by_label = [x or [b" "] for x in by_label]
    filters = [rng.normal(0, 0.3 / np.sqrt(w), (w, 256, FILTERS)) for w in WIDTHS]
    bias = np.zeros(FILTERS * len(WIDTHS))
    out, out_bias = rng.normal(0, 0.2, (len(bias), len(names))), np.zeros(len(names))
    params = [*filters, bias, out, out_bias]
    moment, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    sizes = (8, 16, 32, 64, 128)
    for step in range(1, steps + 1):
        length = sizes[rng.integers(len(sizes))] + max(WIDTHS)
        y = rng.integers(len(names), size=BATCH)
        x = np.zeros((BATCH, length), np.int64)
        for i, label in enumerate(y):
            text = by_label[label][rng.integers(len(by_label[label]))]
            at = rng.integers(max(1, len(text) - length // 2))
            crop = np.frombuffer(text[at : at + length], np.uint8)
            x[i, : len(crop)] = crop
        pooled, places = [], []
        for w, f in zip(WIDTHS, filters, strict=True):
            n = length - w + 1
            r = sum(f[i][x[:, i : i + n]] for i in range(w))
            places.append(r.argmax(1))
            pooled.append(r.max(1))
        raw = np.concatenate(pooled, 1) + bias
        h = np.maximum(raw, 0)
        p = _softmax(h @ out + out_bias)
        p[np.arange(BATCH), y] -= 1
        p /= BATCH
        dh = (p @ out.T) * (raw > 0)
        grads: list[np.ndarray] = []
        for k, (w, f) in enumerate(zip(WIDTHS, filters, strict=True)):
            g, d = np.zeros_like(f), dh[:, k * FILTERS : (k + 1) * FILTERS]
            for i in range(w):
                np.add.at(g[i], (x[np.arange(BATCH)[:, None], places[k] + i], np.arange(FILTERS)[None, :]), d)
            grads.append(g)
        grads += [dh.sum(0), h.T @ p + 1e-4 * out, p.sum(0)]
        rate = 0.01 * (1 - step / (steps + 1)) + 1e-4
        for q, m, v, g in zip(params, moment, second, grads, strict=True):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            q -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Network(names, filters, bias, out, out_bias)


def probabilities(net: Network, tables: list[list[np.ndarray]], data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Each row's language probabilities: means over its windows, by their bytes."""
    stride = LENGTH - max(WIDTHS) + 1
    sizes = np.diff(bounds)
    n_windows = np.maximum(1, -(-np.maximum(sizes - (LENGTH - stride), 0) // stride))
    row = np.repeat(np.arange(len(sizes)), n_windows)
    number = np.arange(len(row)) - np.repeat(np.cumsum(n_windows) - n_windows, n_windows)
    start = bounds[:-1][row] + number * stride
    used = np.minimum(bounds[1:][row] - start, LENGTH)
    padded = np.concatenate([C.LOWER[data], np.zeros(LENGTH, np.uint8)])
    offsets = np.arange(LENGTH)
    total = np.zeros((len(sizes), len(net.labels)))
    step = 48
    for lo in range(0, len(row), step):
        s, u = start[lo : lo + step], used[lo : lo + step]
        x = padded[s[:, None] + offsets].astype(np.int32)
        x[offsets[None, :] >= u[:, None]] = 0
        pair = (x[:, :-1] << 8) | x[:, 1:]
        pooled = []
        for w, parts in zip(WIDTHS, tables, strict=True):
            n = LENGTH - w + 1
            r = parts[0].take(pair[:, :n], axis=0)
            for i, part in enumerate(parts[1:], 1):
                at = pair[:, 2 * i : 2 * i + n] if len(part) == 65536 else x[:, 2 * i : 2 * i + n]
                r += part.take(at, axis=0)
            pooled.append(r.max(1))
        h = np.maximum(np.concatenate(pooled, 1) + net.bias, 0)
        np.add.at(total, row[lo : lo + step], _softmax(h @ net.out + net.out_bias) * np.maximum(u, 1)[:, None])
    return total / total.sum(1, keepdims=True)


def learn(docs: DataFrame, trains: Column, per_label: int = PER_LABEL, text: str = "text", label: str = "lang", key: str = "doc_id") -> Network | None:
    """A network from a bounded sample of the labelled rows where `trains` holds; None if there are none."""
    rows = docs.where(trains & F.col(label).isNotNull() & (F.length(text) > 0))
    draw = F.pmod(F.xxhash64(F.lit(17), F.col(key), F.col(text)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    found = rows.groupBy(F.col(label).alias("y")).agg(F.count("*").alias("n"), F.min(draw).alias("least")).collect()
    if not found:
        return None
    share = F.create_map(*(F.lit(x) for r in found for x in (r["y"], max(min(1.0, per_label / r["n"]), r["least"]))))
    room = F.greatest(F.length(text) - EXCERPT, F.lit(0)) + 1
    passage = F.substring(F.col(text), (F.pmod(F.xxhash64(F.lit(18), F.col(text)), room) + 1).cast("int"), F.lit(EXCERPT))
    drawn = rows.where(draw <= share[F.col(label)]).select(F.col(key).alias("id"), draw.alias("k"), F.col(label).alias("y"), passage.alias("t"))
    # equal rows are drawn together, so different ones are taken, and their number follows per_label whatever repeats
    sample = drawn.distinct().toPandas().sort_values(["id", "k", "y", "t"], kind="stable")
    texts = [bytes(C.LOWER[np.frombuffer(t.encode("utf-8", "replace"), np.uint8)]) for t in sample.t]
    return train(texts, sample.y.tolist())


def predict(docs: DataFrame, net: Network | None, text: str = "text") -> DataFrame:
    """`docs` with lang_pred and score."""
    spark = docs.sparkSession
    C.small_batches(spark)
    docs = docs.drop("lang_pred", "score")
    if net is None:
        return docs.withColumns({"lang_pred": F.lit("und"), "score": F.lit(0.0)})
    shared = spark.sparkContext.broadcast(net)
    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        tables, names = model.tables(), np.array(model.labels, object)
        for batch, data, bounds in C.chunks(batches, text):
            p = probabilities(model, tables, data, bounds)
            best = p.argmax(1)
            pred, score = names[best], p.max(1)
            raw = data.tobytes()
            for i in range(len(pred)):
                part = raw[bounds[i] : bounds[i + 1]]
                if not _LETTER.search(part) and not _ANY_LETTER.search(part.decode("utf-8", "replace")):
                    pred[i], score[i] = "und", 0.0
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pred, pa.string()), pa.array(np.clip(score, 0, 1))], names=[*batch.schema.names, "lang_pred", "score"])

    return docs.mapInArrow(run, schema)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.documents(spark, sf_dir)
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))
    net = learn(docs, ~held)
    return predict(docs.select("doc_id", held.alias("held_out"), "text"), net).drop("text")
