"""A quality classifier: a convolutional network over the bytes of whole texts, in numpy.

Filters of ``WIDTH`` bytes run over every byte of a text. Their answers are max-pooled over chunks of 512 bytes that begin every
256 bytes; a small layer reads each chunk; the mean and the maximum over all chunks give one probability. It learns on the driver from a
bounded sample of labelled texts; scoring runs in the tasks, block by block.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tablegauge.llm.memory import frugal
from tablegauge.llm.words import blocks

#: The sample that is learnt from: at most so many labelled documents of each label and so many bytes, whatever the size of the tables.
SAMPLE_DOCS = 1500
SAMPLE_BYTES = 12 << 20
WIDTH, FILTERS, HIDDEN, HOP = 6, 24, 12, 256
STEPS, BATCH, RATE, SEED = 420, 24, 0.012, 11
#: Hops whose filter answers are held at once.
HELD = 128
KEEP_FROM = 0.3


def padded(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts laid out on whole hops with zero bytes behind each, and the first hop of each text (one entry more than texts)."""
    sizes = np.diff(offsets)
    hops = np.concatenate([[0], np.cumsum(-(-(sizes + WIDTH - 1) // HOP))])
    out = np.zeros(int(hops[-1]) * HOP + WIDTH, np.uint8)
    shift = np.repeat(hops[:-1] * HOP - offsets[:-1], sizes)
    out[np.arange(offsets[0], offsets[-1]) + shift] = data[offsets[0]:offsets[-1]]
    return out, hops


def answers(data: np.ndarray, hops: np.ndarray, first: int, last: int, tables: np.ndarray) -> np.ndarray:
    """Filter answers at every byte of some hops: (hops, HOP, FILTERS). Behind a text, where a filter would reach the next one, there is none."""
    a, b = first * HOP, last * HOP
    out = tables[0][data[a:b]]
    for k in range(1, WIDTH):
        out += tables[k][data[a + k:b + k]]
    out = out.reshape(last - first, HOP, -1)
    ends = hops[1:] - 1
    out[ends[(ends >= first) & (ends < last)] - first, HOP - WIDTH + 1:] = -1e9
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class Net:
    tables: np.ndarray  # (WIDTH, 256, FILTERS): a filter's weight of each byte at each place
    reader: np.ndarray  # (FILTERS + 1, HIDDEN)
    mean: np.ndarray  # (HIDDEN,)
    most: np.ndarray  # (HIDDEN,)
    bias: np.ndarray  # (1,)

    @classmethod
    def fresh(cls, rng: np.random.Generator) -> Net:
        def some(*shape, by):
            return rng.normal(0, by, shape).astype(np.float32)

        return cls(some(WIDTH, 256, FILTERS, by=0.3), some(FILTERS + 1, HIDDEN, by=0.3), some(HIDDEN, by=0.3), some(HIDDEN, by=0.3), np.zeros(1, np.float32))

    def _chunks(self, pooled: np.ndarray, hops: np.ndarray) -> np.ndarray:
        """Each chunk is a hop and the next one of the same text."""
        chunks = pooled.copy()
        inside = np.ones(len(pooled), bool)
        inside[hops[1:] - 1] = False
        at = np.flatnonzero(inside)
        chunks[at] = np.maximum(pooled[at], pooled[at + 1])
        return chunks

    def head(self, chunks: np.ndarray, hops: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        squashed = np.tanh(chunks)
        read = np.maximum(squashed @ self.reader[:-1] + self.reader[-1], 0)
        mean = np.add.reduceat(read, hops[:-1], axis=0) / np.diff(hops)[:, None]
        most = np.maximum.reduceat(read, hops[:-1], axis=0)
        return squashed, read, mean, most

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        laid, hops = padded(data, offsets)
        pooled = np.concatenate([answers(laid, hops, k, min(k + HELD, int(hops[-1])), self.tables).max(axis=1) for k in range(0, int(hops[-1]), HELD)])
        _, _, mean, most = self.head(self._chunks(pooled, hops), hops)
        return _sigmoid((mean @ self.mean + most @ self.most + self.bias[0]).astype(np.float64))

    def gradients(self, data: np.ndarray, hops: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> list[np.ndarray]:
        pooled = np.empty((int(hops[-1]), FILTERS), np.float32)
        place = np.empty((int(hops[-1]), FILTERS), np.int64)
        for k in range(0, int(hops[-1]), HELD):
            out = answers(data, hops, k, min(k + HELD, int(hops[-1])), self.tables)
            place[k:k + HELD] = out.argmax(axis=1)
            pooled[k:k + HELD] = np.take_along_axis(out, place[k:k + HELD, None, :], axis=1)[:, 0, :]
        chunks = self._chunks(pooled, hops)
        squashed, read, mean, most = self.head(chunks, hops)
        p = _sigmoid(mean @ self.mean + most @ self.most + self.bias[0])
        error = ((p - labels) * weights / weights.sum()).astype(np.float32)
        doc = np.repeat(np.arange(len(labels)), np.diff(hops))
        d_read = (error / np.diff(hops))[doc][:, None] * self.mean
        is_most = read == most[doc]
        d_read = d_read + is_most * (error[doc][:, None] * self.most)
        d_read = np.where(read > 0, d_read, 0).astype(np.float32)
        d_reader = np.concatenate([squashed.T @ d_read, d_read.sum(axis=0)[None]])
        d_chunks = (d_read @ self.reader[:-1].T) * (1 - squashed * squashed)
        # a chunk's answer came from its own hop or from the next one
        from_next = chunks > pooled
        d_pooled = np.where(from_next, 0, d_chunks)
        d_pooled[1:] += np.where(from_next, d_chunks, 0)[:-1]
        d_tables = np.zeros_like(self.tables)
        at = place + np.arange(int(hops[-1]))[:, None] * HOP
        column = np.broadcast_to(np.arange(FILTERS), at.shape)
        for k in range(WIDTH):
            flat = data[at + k].astype(np.int64) * FILTERS + column
            d_tables[k] = np.bincount(flat.ravel(), d_pooled.ravel(), 256 * FILTERS).reshape(256, FILTERS)
        return [d_tables, d_reader, mean.T @ error, most.T @ error, error.sum()[None]]


def fit(texts: list[bytes], labels: np.ndarray) -> Net:
    """A net learnt from texts and labels 0 and 1, which count alike in sum; the same input gives the same net."""
    rng = np.random.default_rng(SEED)
    net = Net.fresh(rng)
    if not len(texts) or labels.min() == labels.max():
        constant = float(labels[0]) if len(texts) else 1.0
        return Net(net.tables * 0, net.reader * 0, net.mean * 0, net.most * 0, np.full(1, 8 * constant - 4, np.float32))
    names = ["tables", "reader", "mean", "most", "bias"]
    first, second = ([np.zeros_like(getattr(net, n)) for n in names] for _ in range(2))
    each = [np.flatnonzero(labels == v) for v in (0, 1)]
    for step in range(1, STEPS + 1):
        # half of a batch from either label
        chosen = np.concatenate([rng.choice(e, BATCH // 2) for e in each])
        data = np.frombuffer(b"".join([texts[k] for k in chosen]), np.uint8)
        laid, hops = padded(data, np.concatenate([[0], np.cumsum([len(texts[k]) for k in chosen])]))
        rate = RATE * min(1.0, 2 * (1 - step / (STEPS + 1)))
        for k, (name, g) in enumerate(zip(names, net.gradients(laid, hops, labels[chosen], np.ones(len(chosen))))):
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.99 * second[k] + 0.01 * g * g
            move = first[k] / (1 - 0.9**step) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)
            setattr(net, name, (getattr(net, name) - rate * (move + 1e-3 * getattr(net, name))).astype(np.float32))
    return net


def held_out(doc_id: Column) -> Column:
    """Rows that are never learnt from: the crc32 of the id as text is a multiple of 5; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def learn(docs: DataFrame, labels: DataFrame) -> Net:
    """A net from a bounded sample of (doc_id, text) with (doc_id, quality): up to ``SAMPLE_DOCS`` texts of each label, whole, as long
    as they fit ``SAMPLE_BYTES``, in the order of a hash of their ids. Null ids, null labels and held-out rows are left out."""
    spark = docs.sparkSession
    known = labels.filter("doc_id is not null and quality in (0, 1)").filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    order = F.xxhash64("doc_id", F.lit(SEED))
    sized = docs.select(F.col("doc_id"), F.octet_length("text").alias("size")).filter("size > 0").join(known, "doc_id").withColumn("order", order)
    chosen: list[int] = []
    for value in (0, 1):
        left = SAMPLE_BYTES // 2
        for r in sized.filter(F.col("quality") == value).orderBy("order", "doc_id", "size").limit(SAMPLE_DOCS).collect():
            if r["size"] <= left:
                left -= r["size"]
                chosen.append(r["doc_id"])
    # as Arrow: from a list, Spark would start Python workers of another kind, which stay beside those of ``mapInArrow``
    wanted = spark.createDataFrame(pa.table({"doc_id": pa.array(sorted(set(chosen)), pa.int64())}))
    rows = docs.select("doc_id", "text").filter("text <> ''").join(F.broadcast(wanted), "doc_id").join(known, "doc_id").groupBy("doc_id").agg(
        F.min("text").alias("text"), F.min("quality").alias("quality")
    ).collect()
    rows.sort(key=lambda r: r["doc_id"])
    return fit([r["text"].encode() for r in rows], np.array([r["quality"] for r in rows], np.float32))


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` with ``held_out``, ``score`` (0 to 1, higher: label 1 likelier) and ``predicted`` (1 from ``KEEP_FROM`` on).

    Only the bytes of a text are scored, all of them. One row per row, other columns stay as they are; a null text is an empty one,
    which is scored too. Without labels of both kinds every text gets the one that there is, or 1. An empty table gives an
    empty one.
    """
    net = learn(docs, labels)
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            parts = [own.scores(data, offsets) for _, data, offsets in blocks(batch.column("text"))]
            scores = np.concatenate(parts) if parts else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores)], names=[*batch.schema.names, "score"])

    fields = [f for f in docs.schema.fields if f.name not in ("score", "held_out", "predicted")]
    plain = docs.select(*(f.name for f in fields))
    scored = plain.mapInArrow(frugal(run), StructType([*plain.schema.fields, StructField("score", DoubleType())]))
    return scored.withColumn("held_out", held_out(F.col("doc_id"))).withColumn("predicted", (F.col("score") >= KEEP_FROM).cast("int"))
