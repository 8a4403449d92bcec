"""Quality classifier: a small convolutional network over the bytes of a text, in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.words import slices

#: Bytes of a chunk and from one chunk's begin to the next: every byte of a text is in a chunk.
CHUNK, STEP = 512, 384
#: Numbers per byte, bytes between two places of a filter (half its width), filters.
EMBED, STRIDE, FILTERS = 8, 4, 24
#: Bytes handled at once while scoring, to stay in the processor's cache.
PIECE = 64


@dataclass
class QualityNet:
    embed: np.ndarray  # 256 x EMBED
    filters: np.ndarray  # 2 * STRIDE * EMBED x FILTERS
    floor: np.ndarray  # FILTERS
    out: np.ndarray  # 2 * FILTERS: of the mean and of the largest over a text's chunks
    bias: float

    def pooled(self, chunks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The largest response of each filter in each chunk (negative: 0), and the place of it."""
        best, place = np.empty((len(chunks), FILTERS), np.float32), np.empty((len(chunks), FILTERS), np.int32)
        half = STRIDE * EMBED
        for a in range(0, len(chunks), PIECE):
            x = self.embed[chunks[a : a + PIECE]].reshape(-1, half)
            n = CHUNK // STRIDE
            left, right = (x @ self.filters[:half]).reshape(-1, n, FILTERS), (x @ self.filters[half:]).reshape(-1, n, FILTERS)
            answer = left[:, :-1] + right[:, 1:]
            place[a : a + PIECE] = answer.argmax(1)
            best[a : a + PIECE] = answer.max(1)
        return np.maximum(best + self.floor, 0), place

    def combine(self, pooled: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Features of each text from the chunks first[i] to first[i + 1]."""
        sizes = np.diff(np.append(first, len(pooled)))[:, None]
        return np.concatenate([np.add.reduceat(pooled, first, axis=0) / sizes, np.maximum.reduceat(pooled, first, axis=0)], axis=1)

    def score(self, texts: pa.Array) -> np.ndarray:
        chunks, first = chunks_of(texts)
        if not len(first):
            return np.zeros(0)
        z = self.combine(self.pooled(chunks)[0], first) @ self.out + self.bias
        return 1 / (1 + np.exp(-np.clip(z.astype(np.float64), -50, 50)))


def chunks_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Overlapping chunks of bytes that cover each text, the last one flush with its end (a text shorter than a chunk is
    filled up with zeros, null is empty), and the number of each text's first chunk."""
    texts = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
    bounds = offsets - offsets[0]
    sizes = np.diff(bounds)
    count = 1 + np.maximum(0, -(-(sizes - CHUNK) // STEP))
    first = np.cumsum(count) - count
    row = np.repeat(np.arange(len(sizes)), count)
    begin = bounds[row] + np.minimum((np.arange(len(row)) - first[row]) * STEP, np.maximum(sizes[row] - CHUNK, 0))
    at = begin[:, None] + np.arange(CHUNK)
    out = np.append(data, np.zeros(CHUNK, np.uint8))[np.minimum(at, len(data))]
    short = np.flatnonzero(sizes[row] < CHUNK)
    out[short] *= (np.arange(CHUNK) < sizes[row][short][:, None]).astype(np.uint8)
    return out, first


def fit(chunks: np.ndarray, first: np.ndarray, label: np.ndarray, epochs: int = 14, seed: int = 7) -> QualityNet:
    """Adam on the logistic loss, both classes weighted alike. Only the place of each chunk's largest response gets a
    gradient, so a step touches few bytes."""
    rng = np.random.default_rng(seed)
    net = QualityNet(
        rng.normal(0, 0.5, (256, EMBED)).astype(np.float32), rng.normal(0, 0.15, (2 * STRIDE * EMBED, FILTERS)).astype(np.float32),
        np.zeros(FILTERS, np.float32), rng.normal(0, 0.1, 2 * FILTERS).astype(np.float32), 0.0)
    weight = np.where(label > 0, 0.5 / max(label.sum(), 1), 0.5 / max((1 - label).sum(), 1)) * len(label)
    names = ("embed", "filters", "floor", "out", "bias")
    m, v, t = {k: 0.0 for k in names}, {k: 0.0 for k in names}, 0
    last = np.append(first[1:], len(chunks))
    for _ in range(epochs):
        for rows in np.array_split(rng.permutation(len(label)), max(1, len(label) // 48)):
            own = np.concatenate([np.arange(first[i], last[i]) for i in rows])
            begin = np.cumsum([0, *(last[i] - first[i] for i in rows[:-1])])
            sizes = np.diff(np.append(begin, len(own)))
            part = chunks[own]
            pooled, place = net.pooled(part)
            both = net.combine(pooled, begin)
            z = np.clip(both @ net.out + net.bias, -30, 30)
            dz = ((1 / (1 + np.exp(-z)) - label[rows]) * weight[rows] / len(rows)).astype(np.float32)
            grad = {"out": both.T @ dz + 1e-3 * net.out, "bias": float(dz.sum())}
            per = np.repeat(np.arange(len(rows)), sizes)
            top = pooled == both[per, FILTERS:]
            delta = dz[per, None] * (net.out[:FILTERS] / sizes[per, None] + net.out[FILTERS:] * top) * (pooled > 0)
            delta = delta.astype(np.float32)
            grad["floor"] = delta.sum(0)
            window = np.take_along_axis(part[:, None, :], (place[:, :, None] * STRIDE + np.arange(2 * STRIDE)), axis=2)  # chunk, filter, byte
            seen = net.embed[window].reshape(len(part), FILTERS, -1)
            grad["filters"] = np.einsum("cfk,cf->kf", seen, delta)
            back = (delta[:, :, None] * net.filters.T[None]).reshape(-1, EMBED)
            flat = window.reshape(-1)
            grad["embed"] = np.stack([np.bincount(flat, back[:, d], 256) for d in range(EMBED)], 1)
            t += 1
            for k in names:
                m[k] = 0.9 * m[k] + 0.1 * grad[k]
                v[k] = 0.999 * v[k] + 0.001 * np.square(grad[k])
                step = 0.01 * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
                setattr(net, k, float(net.bias - step) if k == "bias" else (getattr(net, k) - step).astype(np.float32))
    return net


def train(docs: DataFrame, labels: DataFrame, sample: int = 600, most_bytes: int = 16 << 20) -> QualityNet | None:
    """Learn `quality` (0 or 1) from at most `sample` labelled documents of each class, those with the smallest hashes of
    their ids, and of them as many as `most_bytes` of text hold, the first one at any length. All chunks of a chosen
    document take part, as all do when it is scored. Both bounds are on labelled rows and limit what is sent to all
    executors (2 x `sample` ids) and to the driver. Afterwards the bias is moved to the frequency of the classes among all
    labels. None if a class has no label."""
    known = labels.where("quality in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    counts = {r.quality: r.n for r in known.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    if len(counts) < 2:
        return None
    # thinned by hash to a few times the sample before any are brought together
    share = F.when(F.col("quality") == 1, 4.0 * sample / counts[1]).otherwise(4.0 * sample / counts[0])
    order = Window.partitionBy("quality").orderBy(F.xxhash64("doc_id"), "doc_id")
    chosen = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < share * (1 << 30)).withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= sample).drop("_r")
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    sizes = rows.groupBy("quality", "doc_id").agg(F.sum(F.octet_length("text")).alias("n"))
    before = F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    fits = sizes.withColumn("_before", before).where(F.col("_before") + F.when(F.col("_before") > 0, F.col("n")).otherwise(0) <= most_bytes // 2)
    rows = rows.join(F.broadcast(fits.select("doc_id")), "doc_id", "left_semi")  # at most 2 x sample ids

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            chunks, first = chunks_of(batch.column("text"))
            ends = np.append(first[1:], len(chunks))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), batch.column("quality").cast(pa.int32()), pa.array([chunks[a:b].tobytes() for a, b in zip(first, ends)], pa.binary())], names=["doc_id", "quality", "chunks"])

    found = rows.mapInArrow(cut, "doc_id long, quality int, chunks binary").collect()
    found = sorted(found, key=lambda r: (r.doc_id, bytes(r.chunks)))
    if len({r.quality for r in found}) < 2:
        return None
    parts = [np.frombuffer(r.chunks, np.uint8).reshape(-1, CHUNK) for r in found]
    first = np.cumsum([0, *map(len, parts[:-1])])
    net = fit(np.concatenate(parts), first, np.array([r.quality for r in found], np.float32))
    net.bias += float(np.log(counts[1] / counts[0]))
    return net


def score_quality(docs: DataFrame, net: QualityNet | None) -> DataFrame:
    """The rows of `docs` with quality_score (0 to 1, higher: label 1 is likelier) and quality_predicted (1 from 0.5 on).
    The network reads overlapping chunks of the whole text; their largest responses are averaged and maximised into one
    probability.

    Null and empty texts are a chunk of zeros and get a score like any other; without a network every score is 0.5.
    Repeated rows are scored alike, an empty table gives no rows, other columns are passed on (columns of the two new
    names are replaced)."""
    rows = docs.drop("quality_score", "quality_predicted")
    schema = T.StructType([*rows.schema.fields, T.StructField("quality_score", T.DoubleType()), T.StructField("quality_predicted", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            score = net.score(batch.column("text")) if net else np.full(batch.num_rows, 0.5)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=schema.names)

    return rows.mapInArrow(run, schema)


def held_out(doc_id: Column) -> Column:
    """Rows whose crc32 of the id as text leaves 1 divided by 3; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))
