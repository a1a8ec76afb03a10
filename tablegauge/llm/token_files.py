"""Token ids of documents in binary files whose document boundaries are Elias-Fano coded.

A file holds the ids of consecutive documents as one array. The n + 1 boundaries and the document ids never fall, so each
is coded as low bits in a packed array and high bits in unary, about two bits and log2(universe / n) bits a document; positions of
every 256th one give ``select``, so that any document is found without a table of 64-bit offsets.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablegauge.llm.pieces import PieceTable, byte_level_cuts, odd_rows
from tablegauge.llm.words import blocks
from tablegauge.session import scratch_path

MAGIC = b"TGIDS1\0\0"
#: A file ends with the document that brings it to so many ids.
FILE_IDS = 1 << 23
_EVERY = 256


class EliasFano:
    """A never falling sequence of integers from 0 on."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.uint64)
        n = len(values)
        universe = int(values[-1]) + 1 if n else 1
        low_bits = max(0, (universe // max(n, 1)).bit_length() - 1)
        shifts = np.arange(low_bits, dtype=np.uint64)
        low = np.packbits((values[:, None] >> shifts & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little")
        ones = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        bits = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
        bits[ones] = 1
        return cls(n, low_bits, low, np.packbits(bits, bitorder="little"), ones[::_EVERY].astype(np.uint32))

    def select(self, i: int) -> int:
        """The i-th value: from the sampled position on, count ones byte by byte."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        at, left = int(self.samples[i // _EVERY]), i % _EVERY
        byte = at // 8
        mask = self.high[byte] >> (at % 8) << (at % 8)
        while left >= (ones := int(mask).bit_count()):
            left -= ones
            byte += 1
            mask = self.high[byte]
        place = [k for k in range(8) if int(mask) >> k & 1][left]
        value = byte * 8 + place - i
        low = 0
        for k in range(self.low_bits):
            bit = i * self.low_bits + k
            low |= (int(self.low[bit // 8]) >> (bit % 8) & 1) << k
        return value << self.low_bits | low

    def run(self, k: int) -> np.ndarray:
        """The values from the k-th sample up to the next one: ``select`` for all of them, from one sampled position."""
        first, last = k * _EVERY, min((k + 1) * _EVERY, self.n)
        start = int(self.samples[k])
        end = int(self.samples[k + 1]) if k + 1 < len(self.samples) else 8 * len(self.high)
        bits = np.unpackbits(self.high[start // 8:-(-end // 8)], bitorder="little")
        ones = np.flatnonzero(bits[start % 8:])[:last - first] + start
        places = np.arange(first, last)
        at = places[:, None] * self.low_bits + np.arange(self.low_bits)
        low = (self.low[at >> 3] >> (at & 7) & 1).astype(np.int64)
        return (ones - places) << self.low_bits | (low << np.arange(self.low_bits)).sum(axis=1)

    def values(self) -> np.ndarray:
        ones = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[:self.n]
        high = (ones - np.arange(self.n)).astype(np.uint64) << np.uint64(self.low_bits)
        bits = np.unpackbits(self.low, bitorder="little", count=self.n * self.low_bits).reshape(self.n, self.low_bits)
        return high | (bits.astype(np.uint64) << np.arange(self.low_bits, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)

    def dump(self) -> bytes:
        parts = [self.low.tobytes(), self.high.tobytes(), self.samples.astype("<u4").tobytes()]
        return struct.pack("<QB3Q", self.n, self.low_bits, *map(len, parts)) + b"".join(parts)

    @classmethod
    def load(cls, data: memoryview, at: int) -> tuple[EliasFano, int]:
        n, low_bits, *sizes = struct.unpack_from("<QB3Q", data, at)
        at += struct.calcsize("<QB3Q")
        parts = []
        for size, kind in zip(sizes, (np.uint8, np.uint8, np.dtype("<u4"))):
            parts.append(np.frombuffer(data, kind, size // np.dtype(kind).itemsize, at))
            at += size
        return cls(n, low_bits, *parts), at


class TokenFile:
    """One file in memory: ``ids(k)`` are the ids of its k-th document."""

    def __init__(self, data: bytes):
        if data[:8] != MAGIC:
            raise ValueError("not a file of token ids")
        width, nulls, self.least = struct.unpack_from("<BQq", data, 8)
        at = 8 + struct.calcsize("<BQq")
        view = memoryview(data)
        self.bounds, at = EliasFano.load(view, at)
        self.names, at = EliasFano.load(view, at)
        self.nulls = nulls
        self.all_ids = np.frombuffer(data, f"<u{width}", offset=at)

    def __len__(self) -> int:
        return self.bounds.n - 1

    def ids(self, k: int) -> np.ndarray:
        return self.all_ids[self.bounds.select(k):self.bounds.select(k + 1)]

    def parts(self) -> Iterator[tuple[list[int | None], np.ndarray]]:
        """Document ids and boundaries (one more) of so many documents as one sample stands for; no more of them are decoded at once."""
        ids, known = [None] * self.nulls, 0
        for k in range(len(self.bounds.samples)):
            bounds = self.bounds.run(k)
            if (k + 1) * _EVERY < self.bounds.n:
                bounds = np.append(bounds, self.bounds.select((k + 1) * _EVERY))
            while len(ids) < len(bounds) - 1:
                ids += (self.names.run(known) + self.least).tolist()
                known += 1
            yield ids[:len(bounds) - 1], bounds
            ids = ids[len(bounds) - 1:]

    @staticmethod
    def dump(doc_ids: list[int | None], ids: list[bytes], width: int) -> bytes:
        known = [d for d in doc_ids if d is not None]
        least = known[0] if known else 0
        bounds = EliasFano.of(np.cumsum([0, *(len(x) // width for x in ids)]))
        names = EliasFano.of(np.array(known, np.int64).astype(np.uint64) - np.uint64(least % (1 << 64)))
        head = MAGIC + struct.pack("<BQq", width, len(doc_ids) - len(known), least) + bounds.dump() + names.dump()
        return b"".join([head, *ids])


class Encoder:
    """Ids of whole texts by the tokenizers library, each distinct piece of them encoded once while it is remembered."""

    def __init__(self, vocabulary: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.kind = np.uint16 if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else np.uint32
        self.specials = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.line = self.tokenizer.encode("\n", add_special_tokens=False).ids
        self.table = PieceTable(byte_level_cuts, self._pieces, self.kind)

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.kind)

    def _pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Words are encoded as lines of one text, whose line ends are tokens of their own; pieces of white space alone."""
        parts, sizes = [], np.zeros(len(pieces), np.int64)
        white = [p[-1].isspace() for p in pieces]
        k = 0
        while k < len(pieces):
            end = k
            while end < len(pieces) and end - k < 5000 and not white[end] and len(self.line) == 1:
                end += 1
            if end == k:
                parts.append(self.whole(pieces[k]))
                sizes[k] = len(parts[-1])
                k += 1
                continue
            ids = self.whole("\n".join(pieces[k:end]))
            ends = np.flatnonzero(ids == self.line[0])
            if len(ends) == end - k - 1:
                sizes[k:end] = np.diff(np.concatenate([[-1], ends, [len(ids)]])) - 1
                parts.append(ids[ids != self.line[0]])
            else:
                each = [self.whole(p) for p in pieces[k:end]]
                sizes[k:end] = [len(x) for x in each]
                parts += each
            k = end
        return np.concatenate(parts) if parts else np.zeros(0, self.kind), sizes

    def batch(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text, in order. Texts with rarer white space or the name of a special token go to the library whole."""
        for row, data, offsets in blocks(texts):
            odd = odd_rows(data, offsets, self.specials)
            ids, bounds = self.table.texts(data, offsets)
            for k in range(len(offsets) - 1):
                yield self.whole(data[offsets[k]:offsets[k + 1]].tobytes().decode()) if k in odd else ids[bounds[k]:bounds[k + 1]]


#: What a worker keeps from task to task, by the file of the vocabulary.
_KEPT: dict[str, Encoder] = {}


def _writer(vocabulary: str, end_id: int, folder: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = fs.FileSystem.from_uri(folder)
        if vocabulary not in _KEPT:
            _KEPT[vocabulary] = Encoder(vocabulary)
        encoder = _KEPT[vocabulary]
        width = np.dtype(encoder.kind).itemsize
        end = end_id.to_bytes(width, "little")
        task, number = TaskContext.get().partitionId(), 0
        names, ids, held = [], [], 0

        def written() -> pa.RecordBatch:
            name = f"ids-{task:06d}-{number:06d}.bin"
            own = f"{top}/.{uuid.uuid4().hex}"
            with store.open_output_stream(own) as out:
                out.write(TokenFile.dump(names, ids, width))
            store.move(own, f"{top}/{name}")  # a task that runs again puts the same bytes in the same place
            return pa.RecordBatch.from_pylist([{"task": task, "number": number, "file": name, "docs": len(names), "ids": held}],
                                              pa.schema([("task", pa.int64()), ("number", pa.int64()), ("file", pa.string()), ("docs", pa.int64()), ("ids", pa.int64())]))

        for batch in batches:
            for doc_id, found in zip(batch.column("doc_id").to_pylist(), encoder.batch(batch.column("text"))):
                names.append(doc_id)
                ids.append(found.tobytes() + end)
                held += len(found) + 1
                if held >= FILE_IDS:
                    yield written()
                    names, ids, held = [], [], 0
                    number += 1
        if names:
            yield written()

    return run


def _reader(folder: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for name, base in zip(batch.column("file").to_pylist(), batch.column("base").to_pylist()):
                with store.open_input_stream(f"{top}/{name}") as source:
                    file = TokenFile(source.read())
                for doc_ids, bounds in file.parts():
                    sums = [zlib.crc32(file.all_ids[a:b].astype("<u4").tobytes()) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
                    yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(bounds[:-1] + base), pa.array(np.diff(bounds)), pa.array(sums, pa.int64())],
                                                     names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return run


def _uri(path: str) -> str:
    return path if "://" in path or path.startswith("file:") else f"file://{path}"


def write_token_files(docs: DataFrame, folder: str, vocabulary: str, end_id: int = 2) -> DataFrame:
    """Writes the ids of (doc_id, text) to files below ``folder`` in ascending doc_id order; returns the list of files.

    Documents are dealt out by ranges of doc_id, so files follow each other; nulls come first, equal ids in the order of a
    hash of their text. A null or empty text has the end id alone. One row per file: ``file``, ``docs``, ``ids`` and
    ``base``, the ids in all files before it. Extra columns are ignored; an empty table writes no file.
    """
    spark = docs.sparkSession
    folder = _uri(folder)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("tie", F.xxhash64("text"))
    ordered = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    where = spark._jvm.org.apache.hadoop.fs.Path(folder)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(where)
    made = ordered.mapInArrow(_writer(vocabulary, end_id, folder), "task long, number long, file string, docs long, ids long")
    made.write.parquet(f"{folder}/list")
    # one row per file of some eight million ids: few enough for one running sum
    so_far = Window.orderBy("task", "number").rowsBetween(Window.unboundedPreceding, -1)
    return spark.read.parquet(f"{folder}/list").withColumn("base", F.coalesce(F.sum("ids").over(so_far), F.lit(0)))


def read_token_files(files: DataFrame, folder: str) -> DataFrame:
    """Per document of the files: doc_id, ``start`` (ids before it), ``n_tokens`` and the crc32 of its ids as 32-bit integers."""
    # a number of tasks that adaptive execution does not lower: files are few rows of some 16 MB each
    dealt = files.select("file", "base").repartition(max(1, files.count()))
    return dealt.mapInArrow(_reader(_uri(folder)), "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, vocabulary: str, end_id: int = 2, folder: str | None = None) -> DataFrame:
    """Writes the files of ``docs`` and reads them back; ``folder`` defaults to one of its own below the shared folder."""
    folder = folder or scratch_path(docs.sparkSession, "token-files")
    return read_token_files(write_token_files(docs, folder, vocabulary, end_id), folder)
