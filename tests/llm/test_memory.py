"""What a task of the pipeline holds at once: bounded by its blocks and tables, with the same results."""

from __future__ import annotations

import tracemalloc

import numpy as np
import pyarrow as pa

import corpus_pipeline
from tablegauge.llm import bpe, jaccard_join, quality_net, words
from tablegauge.llm.pieces import PieceTable, byte_level_cuts

TEXTS = [f"word{k % 977} of text {k} " * 40 for k in range(5000)]


def test_shingles_of_many_texts_hold_a_small_block():
    texts = pa.array(TEXTS)
    words._POWERS.clear()
    tracemalloc.start()
    try:
        sets = sum(len(s) for s in jaccard_join.shingle_sets(texts, 5))
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert sets and most < 24 << 20  # some 50 MB in blocks of a megabyte


def test_blocks_of_any_size_give_the_same_shingles():
    texts = pa.array([*TEXTS[:60], None, "", "one two", "long " + "x y z " * 60_000])
    data = [d.tobytes() for _, d, _ in words.blocks(texts, 1 << 12)]
    assert b"".join(data) == "".join(t or "" for t in texts.to_pylist()).encode() and len(data) > 10
    found = [s.tolist() for s in jaccard_join.shingle_sets(texts, 5)]
    alone = [next(jaccard_join.shingle_sets(pa.array([t or ""]), 5)).tolist() for t in texts.to_pylist()]
    assert found == alone


def test_piece_table_remembers_no_more_than_it_is_told():
    def encode(pieces):
        return np.array([len(p) for p in pieces], np.uint32), np.ones(len(pieces), np.int64)

    small, large = PieceTable(byte_level_cuts, encode, np.uint32, 100), PieceTable(byte_level_cuts, encode, np.uint32)
    for first in range(0, 1000, 20):
        text = " ".join(f"w{'x' * (k % 7)}{k}" for k in range(first, first + 40)).encode()
        data, offsets = np.frombuffer(text, np.uint8), np.array([0, len(text)])
        for a, b in zip(small.texts(data, offsets), large.texts(data, offsets)):
            assert a.tolist() == b.tolist()
        assert len(small.keys) <= 100
    assert len(large.keys) > 1000
    assert bpe.MOST_PIECES < 1 << 20


def test_sample_starts_no_python_workers_of_its_own(spark, monkeypatch):
    """A table made from a list is a Python RDD, whose workers and daemon stay beside those of mapInArrow."""
    made = []
    real = type(spark).createDataFrame
    monkeypatch.setattr(type(spark), "createDataFrame", lambda self, data, *a, **b: made.append(data) or real(self, data, *a, **b))
    docs = real(spark, [(k, f"text {k} " * (1 + k % 3)) for k in range(40)], "doc_id long, text string")
    labels = real(spark, [(k, k % 2) for k in range(40)], "doc_id long, quality int")
    quality_net.learn(docs, labels)
    assert made and all(isinstance(x, pa.Table) for x in made)


def test_stages_ask_for_small_batches(spark):
    docs = spark.createDataFrame([(1, "a b c", "en", "src0", 5)], "doc_id long, text string, lang string, source string, n_chars long")
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    for stage in (corpus_pipeline.redaction, corpus_pipeline.encoding):
        spark.conf.set(key, str(64 << 20))
        assert stage(spark, docs, "").count() == 1
        assert int(spark.conf.get(key)) <= 1 << 20
    assert int(spark.conf.get("spark.sql.parquet.columnarReaderBatchSize")) < 4096
