"""Alignment of the tokens of two vocabularies by the spans that their libraries report.

Texts are cut where neither vocabulary has a token across, and each distinct piece is aligned once while a task remembers it. The end
of every token is first taken from the library: the tokenizers library gives offsets in characters, sentencepiece gives spans in its
read-only proto. Where a character has several tokens (parts of a multibyte character, byte-fallback tokens) these
spans are too coarse, and the bytes that the tokens stand for give the ends. Ends that both have cut a piece into groups.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tablegauge.llm.bpe import byte_letters
from tablegauge.llm.memory import frugal
from tablegauge.llm.pieces import byte_level_cuts, odd_rows
from tablegauge.llm.words import blocks, hashes
from tablegauge.session import written

#: Pieces, bytes of their groups and pairs that a worker remembers, some 120 MB at most; then it starts anew.
MOST_PIECES = 600_000
MOST_BYTES = 30_000_000
MOST_PAIRS = 3_000_000
#: Pieces that are encoded at once.
AT_ONCE = 4000
#: Pairs whose counts are sent to all tasks: the most frequent ones. All others meet their documents in a join.
MOST_SENT = 1 << 19
#: Bits of an id; a pair of them is one number.
_SHIFT = 20
_SPACE_LETTER = "\u2581"


class TwoVocabularies:
    """Tokens and their ends in bytes by a byte-level vocabulary of the tokenizers library (A) and one of sentencepiece (B)."""

    def __init__(self, byte_vocabulary: str, piece_model: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(byte_vocabulary)
        self.a.no_truncation()
        self.a.no_padding()
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=piece_model)
        letters = {c: b for b, c in enumerate(byte_letters())}
        self.a_bytes: dict[int, bytes] = {}
        for token, i in self.a.get_vocab(with_added_tokens=True).items():
            self.a_bytes[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        self.b_bytes: list[bytes] = []
        self.beside = np.zeros((256, 256), bool)
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            own = bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace(_SPACE_LETTER, " ").encode()
            self.b_bytes.append(own)
            if not (self.b.is_byte(i) or self.b.is_control(i) or self.b.is_unknown(i)):
                raw = np.frombuffer(own, np.uint8)
                self.beside[raw[:-1], raw[1:]] = True
        self.a_sizes = np.array([len(self.a_bytes.get(i, b"")) for i in range(max(self.a_bytes) + 1)])
        self.b_sizes = np.array([len(x) for x in self.b_bytes])
        numbers = [b"%d " % i for i in range(max(len(self.a_sizes), len(self.b_sizes)))]
        self.digits, self.digits_at = np.frombuffer(b"".join(numbers), np.uint8), np.cumsum([0, *map(len, numbers)])
        if self.beside[10].any() or self.beside[:, 10].any():
            raise ValueError("the vocabulary has pieces with line ends, which part pieces here")
        if max(len(self.a_sizes), len(self.b_sizes)) > 1 << _SHIFT:
            raise ValueError("the vocabulary has too many ids")

    def cuts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Starts of pieces that no token of either vocabulary crosses. A row with odd white space is one piece."""
        cut = np.zeros(len(data) + 1, bool)
        cut[byte_level_cuts(data, offsets)] = True
        cut[:-1] &= (data & 0xC0) != 0x80
        if len(data) > 1:
            cut[1:-1] &= ~self.beside[data[:-1], data[1:]]
        for row in odd_rows(data, offsets, []):
            cut[offsets[row]:offsets[row + 1]] = False
        cut[offsets] = True
        cut[len(data)] = False
        return np.flatnonzero(cut)

    def a_tokens(self, pieces: list[str], raw: list[bytes], joined: bool) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of A over all pieces and where each ends, in bytes of the pieces one after the other; None where they are not the pieces.

        ``joined`` pieces, which have no white space but one space in front, are the lines of one text.
        """
        whole = "\n".join(pieces) if joined else "".join(pieces)
        found = [self.a.encode(whole, add_special_tokens=False)] if joined else self.a.encode_batch(pieces, add_special_tokens=False)
        ids = np.array([i for f in found for i in f.ids], np.int64)
        spans = np.array([s for f in found for s in f.offsets], np.int64).reshape(-1, 2)
        if not joined:
            chars = np.cumsum([0, *map(len, pieces)])
            spans += np.repeat(chars[:-1], [len(f.ids) for f in found])[:, None]
        data = whole.encode()
        if b"".join([self.a_bytes[i] for i in ids.tolist()]) != data:
            return None
        byte_at = np.flatnonzero(np.append((np.frombuffer(data, np.uint8) & 0xC0) != 0x80, True))
        ends = refined(byte_at[spans[:, 0]], byte_at[spans[:, 1]], self.a_sizes[ids])
        return _without(_line_ends(raw), ids, ends) if joined else (ids, ends)

    def b_tokens(self, pieces: list[str], raw: list[bytes]) -> tuple[np.ndarray, np.ndarray] | None:
        """As ``a_tokens`` for B: any pieces are lines of one text, as no token has a line end and something else."""
        whole = "\n" + "\n".join(pieces)
        tokens = self.b.encode(whole, return_type="proto").pieces
        ids = np.array([t.id for t in tokens], np.int64)
        to = np.array([t.end for t in tokens], np.int64)
        if b"".join([self.b_bytes[i] for i in ids.tolist()]) != b" " + whole.encode():
            return None
        # the library's spans leave out the space that it adds; its token and the first line end are not the pieces'
        ends = refined(np.concatenate([[0], to[:-1]]) + 1, to + 1, self.b_sizes[ids])[2:] - 2
        return _without(_line_ends(raw), ids[2:], ends)


def refined(starts: np.ndarray, ends: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The end of each token: that of its span where the span is as long as the token, else as far as the bytes of tokens reach."""
    return np.where(ends - starts == sizes, ends, np.cumsum(sizes))


def _line_ends(raw: list[bytes]) -> np.ndarray:
    """Where the line ends between pieces end, in their joined text."""
    return np.cumsum([len(p) + 1 for p in raw[:-1]])


def _without(line_ends: np.ndarray, ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tokens but those of the line ends, and their ends as if these were not there."""
    before = np.searchsorted(line_ends, ends, "right")
    own = np.ones(len(ids), bool)
    own[np.searchsorted(ends, line_ends)] = False
    return ids[own], (ends - before)[own]


def _counted(high: np.ndarray, low: np.ndarray, times: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct pairs of ``high`` and ``low`` (below 2^40), in order, and how often each is there, or the sum of its ``times``."""
    key = high << 2 * _SHIFT | low
    if times is None:
        key, times = np.unique(key, return_counts=True)
    elif len(key):
        order = np.argsort(key)
        key = key[order]
        new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        key, times = key[new], np.add.reduceat(times[order], new)
    return key >> 2 * _SHIFT, key & ((1 << 2 * _SHIFT) - 1), times


def _each(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All places from each start on, as many as its size."""
    return np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(int(sizes.sum()))


class _Grown:
    """An array that grows by doubling."""

    def __init__(self, kind: type):
        self.data, self.n = np.zeros(1 << 12, kind), 0

    def add(self, values) -> None:
        while self.n + len(values) > len(self.data):
            self.data = np.concatenate([self.data, np.zeros_like(self.data)])
        self.data[self.n:self.n + len(values)] = values
        self.n += len(values)

    def all(self) -> np.ndarray:
        return self.data[:self.n]


class Alignment:
    """Figures, groups and linked id pairs of whole texts, put together from those of their distinct pieces."""

    def __init__(self, two: TwoVocabularies):
        self.two = two
        self._clear()

    def _clear(self) -> None:
        self.keys, self.which = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.figures = [_Grown(np.int64) for _ in range(5)]  # tokens of A, of B, groups, links, 1 where tokens are not the text
        self.pair_at, self.text_at = _Grown(np.int64), _Grown(np.int64)
        self.pair_at.add([0])
        self.text_at.add([0])
        self.pair, self.times, self.text = _Grown(np.int64), _Grown(np.int64), _Grown(np.uint8)

    def _add(self, keys: np.ndarray, raw: list[bytes]) -> None:
        """Aligns new pieces: lines of one text where white space allows, and alone where sentencepiece may change them."""
        texts = [p.decode() for p in raw]
        parts: tuple[list, list, list] = [], [], []
        for k, t in enumerate(texts):
            parts[2 if _SPACE_LETTER in t else 0 if len(t.split(None, 1)) == 1 and not t[-1].isspace() and not t[:2].isspace() and "\n" not in t else 1].append(k)
        order = [k for part in parts for k in part]
        jobs = [(part[k:k + size], joined) for part, size, joined in zip(parts, (AT_ONCE, AT_ONCE, 1), (True, False, False)) for k in range(0, len(part), size)]
        number = self.figures[0].n
        for part, joined in jobs:
            if not self._align([texts[k] for k in part], [raw[k] for k in part], joined):
                for k in part:
                    self._align([texts[k]], [raw[k]], False) or self._none()
        keys = keys[order]
        sort = np.argsort(keys)
        place = np.searchsorted(self.keys, keys[sort])
        self.keys = np.insert(self.keys, place, keys[sort])
        self.which = np.insert(self.which, place, number + sort)

    def _none(self) -> None:
        """A piece that its tokens do not stand for."""
        for to, value in zip(self.figures, (0, 0, 0, 0, 1)):
            to.add([value])
        self.pair_at.add([self.pair.n])
        self.text_at.add([self.text.n])

    def _align(self, texts: list[str], raw: list[bytes], joined: bool) -> bool:
        """Adds the figures, groups and pairs of pieces; False where tokens do not stand for them."""
        a, b = self.two.a_tokens(texts, raw, joined), self.two.b_tokens(texts, raw)
        if a is None or b is None:
            return False
        (a_ids, a_ends), (b_ids, b_ends) = a, b
        common = np.intersect1d(a_ends, b_ends)
        a_group, b_group = np.searchsorted(common, a_ends), np.searchsorted(common, b_ends)
        a_in, b_in = np.bincount(a_group, minlength=len(common)), np.bincount(b_group, minlength=len(common))
        n = len(raw)
        piece = np.searchsorted(np.cumsum([len(p) for p in raw]), common)
        for to, weights in zip(self.figures, (a_in, b_in, np.ones(len(common)), a_in * b_in, np.zeros(len(common)))):
            to.add(np.bincount(piece, weights, n).astype(np.int64))
        # distinct ids of each group on both sides, and every one of A with every one of B
        group, a_id, a_times = _counted(a_group, a_ids)
        b_of, b_id, b_times = _counted(b_group, b_ids)
        b_first = np.searchsorted(b_of, np.arange(len(common) + 1))
        sizes = np.diff(b_first)[group]
        take = _each(b_first[group], sizes)
        pair = np.repeat(a_id, sizes) << _SHIFT | b_id[take]
        own, pair, times = _counted(np.repeat(piece[group], sizes), pair, times=np.repeat(a_times, sizes) * b_times[take])
        self.pair_at.add(self.pair.n + np.searchsorted(own, np.arange(1, n + 1)))
        self.pair.add(pair)
        self.times.add(times)
        # numbers of A and B by group, each with the mark that follows it
        order = np.argsort(np.concatenate([2 * a_group, 2 * b_group + 1]), kind="stable")
        ids, side = np.concatenate([a_ids, b_ids])[order], np.concatenate([2 * a_group, 2 * b_group + 1])[order]
        starts, sizes = self.two.digits_at[ids], np.diff(self.two.digits_at)[ids]
        text = self.two.digits[_each(starts, sizes)]
        marks = np.where(np.append(side[1:] != side[:-1], True), np.where(side % 2 == 0, 124, 59), 44)
        ends = np.cumsum(sizes)
        text[ends - 1] = marks
        self.text_at.add(self.text.n + ends[np.searchsorted(side, 2 * np.searchsorted(piece, np.arange(1, n + 1))) - 1])
        self.text.add(text)
        return True

    def _find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(self.keys, keys), max(len(self.keys) - 1, 0))
        return (self.which[at], self.keys[at] == keys) if len(self.keys) else (at, np.zeros(len(keys), bool))

    def _pieces(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """The number of each piece, after new ones have been aligned."""
        ends = np.append(starts[1:], len(data))
        keys, first, back = np.unique(hashes(data, starts, ends, lower=False), return_index=True, return_inverse=True)
        which, known = self._find(keys)
        if not known.all():
            if len(self.keys) + np.count_nonzero(~known) > MOST_PIECES or self.text.n > MOST_BYTES or self.pair.n > MOST_PAIRS:
                self._clear()
                known = np.zeros(len(keys), bool)
            new = np.flatnonzero(~known)
            raw = data.tobytes()
            self._add(keys[new], [raw[a:b] for a, b in zip(starts[first[new]].tolist(), ends[first[new]].tolist())])
            which, _ = self._find(keys)
        return which[back]

    def block(self, data: np.ndarray, offsets: np.ndarray) -> tuple[list[np.ndarray], list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Four figures and the groups per text, then its distinct pairs with their links: bounds per text, pairs, links."""
        n = len(offsets) - 1
        starts = self.two.cuts(data, offsets)
        piece = self._pieces(data, starts) if len(starts) else np.zeros(0, np.int64)
        first = np.searchsorted(starts, offsets)
        row = np.repeat(np.arange(n), np.diff(first))
        figures = [np.bincount(row, f.all()[piece], n).astype(np.int64) for f in self.figures]
        bad = figures.pop() > 0
        for f in figures:
            f[bad] = 0
        texts, places = self.text.all(), self.text_at.all()
        groups = []
        for k in range(n):
            own = piece[first[k]:first[k + 1]]
            groups.append("" if bad[k] or not len(own) else _joined(texts, places[own], places[own + 1])[:-1].tobytes().decode())
        keep = ~bad[row]
        row, piece, n_used = _counted(row[keep], piece[keep])
        at = self.pair_at.all()
        sizes = at[piece + 1] - at[piece]
        take = _each(at[piece], sizes)
        row, pair, links = _counted(np.repeat(row, sizes), self.pair.all()[take], times=self.times.all()[take] * np.repeat(n_used, sizes))
        return figures, groups, np.searchsorted(row, np.arange(n + 1)), pair, links


def _joined(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return data[_each(starts, ends - starts)]


_ALIGNED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, pairs array<long>, links array<long>"
#: What a worker keeps from task to task, by the files of the vocabularies.
_KEPT: dict[tuple[str, str], Alignment] = {}


def _aligner(byte_vocabulary: str, piece_model: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = byte_vocabulary, piece_model
        if files not in _KEPT:
            _KEPT[files] = Alignment(TwoVocabularies(*files))
        for batch in batches:
            for row, data, offsets in blocks(batch.column("text")):
                figures, groups, bounds, pairs, links = _KEPT[files].block(data, offsets)
                lists = [pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(x)) for x in (pairs, links)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(row, len(groups)), *map(pa.array, figures), pa.array(groups, pa.string()), *lists],
                                                 names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", "pairs", "links"])

    return run


def align_tokens(docs: DataFrame, byte_vocabulary: str, piece_model: str) -> DataFrame:
    """(doc_id, text) -> doc_id, n_a, n_b, n_groups, n_links, groups, and the distinct linked id pairs with how often each is linked.

    Both vocabularies encode a space and the text. ``groups`` has the ids between ends that both have, as ``a1,a2|b1;a3|b2,b3``; every
    token of A in a group is linked with every one of B. ``pairs`` are ids of A times 2^20 plus ids of B, ``links`` their occurrences. A text
    that is null, empty or not what its tokens stand for (it holds U+2581, which sentencepiece takes for a space) has no tokens: zeros, ''
    and empty lists. A null doc_id stays null; repeated rows each give a row; extra columns are ignored; an empty table
    gives an empty one. Whole texts of any length are read. The files of the vocabularies are paths that every executor has.
    """
    spaced = F.when(F.col("text") != "", F.concat(F.lit(" "), "text")).otherwise("")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), spaced.alias("text"))
    return rows.mapInArrow(frugal(_aligner(byte_vocabulary, piece_model)), _ALIGNED)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """How many documents hold each pair linked, and whether no pair of the same id of A is in more; written to the shared folder.

    An id of A has at most as many pairs as B has ids, so the window over them is bounded.
    """
    counts = aligned.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("docs"))
    own = Window.partitionBy(F.shiftright("pair", _SHIFT))
    return written(counts.withColumn("best", F.col("docs") == F.max("docs").over(own)), "pair-counts")


def _sent(counts: DataFrame, most: int) -> tuple[int, pa.Table]:
    """Counts of all pairs that are in ``least`` documents or more, at most ``most`` rows, and ``least``, a power of two."""
    power = F.floor(F.log2(F.col("docs"))).cast("int")
    sizes = dict(counts.groupBy(power.alias("power")).count().collect())  # one row per power of two
    least, held = max(sizes, default=0) + 1, 0
    while least and held + sizes.get(least - 1, 0) <= most:
        least -= 1
        held += sizes.get(least, 0)
    return 1 << least, counts.filter(F.col("docs") >= (1 << least)).toArrow()


def _scorer(sent) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, docs, best = sent.value
        for batch in batches:
            pairs = batch.column("pairs")
            bounds, links = pairs.offsets.to_numpy() - pairs.offsets[0].as_py(), batch.column("links").flatten().to_numpy()
            pairs = pairs.flatten().to_numpy()
            at = np.minimum(np.searchsorted(keys, pairs), max(len(keys) - 1, 0))
            known = keys[at] == pairs if len(keys) else np.zeros(len(pairs), bool)
            total, top = np.zeros((2, len(pairs) + 1), np.int64)
            np.cumsum(np.where(known, links * docs[at], 0) if len(keys) else 0 * links, out=total[1:])
            np.cumsum(np.where(known, links * best[at], 0) if len(keys) else 0 * links, out=top[1:])
            left = np.concatenate([[0], np.cumsum(~known)])[bounds]
            rest = [pa.ListArray.from_arrays(pa.array(left, pa.int32()), pa.array(x[~known])) for x in (pairs, links)]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(np.diff(top[bounds])), pa.array(np.diff(total[bounds])), *rest],
                                             names=["row", "n_best", "count_sum", "pairs", "links"])

    return run


def link_scores(spark: SparkSession, aligned: DataFrame, most_sent: int = MOST_SENT) -> DataFrame:
    """Adds n_best, the links whose pair no other of its id of A beats in documents, and count_sum, their documents over all links.

    ``aligned`` must be a written table with a column ``row`` that no two rows share. The counts of the most frequent pairs, at most
    ``most_sent``, go to all tasks, so no pair that every document has is shuffled by; the other pairs are joined by pair.
    """
    counts = pair_counts(aligned)
    least, table = _sent(counts, most_sent)
    order = np.argsort(table.column("pair").to_numpy())
    sent = spark.sparkContext.broadcast(tuple(np.ascontiguousarray(table.column(c).to_numpy()[order]) for c in ("pair", "docs", "best")))
    schema = "row long, n_best long, count_sum long, pairs array<long>, links array<long>"
    scored = written(aligned.select("row", "pairs", "links").mapInArrow(frugal(_scorer(sent)), schema), "pairs-scored")
    rest = scored.select("row", F.explode(F.arrays_zip("pairs", "links")).alias("p")).select("row", F.col("p.pairs").alias("pair"), F.col("p.links").alias("links"))
    rare = (rest.join(counts.filter(F.col("docs") < least), "pair")
            .groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("links")).otherwise(0)).alias("rare_best"), F.sum(F.col("links") * F.col("docs")).alias("rare_sum")))
    more = (scored.select("row", "n_best", "count_sum").join(rare, "row", "left")
            .select("row", (F.col("n_best") + F.coalesce("rare_best", F.lit(0))).alias("n_best"), (F.col("count_sum") + F.coalesce("rare_sum", F.lit(0))).alias("count_sum")))
    return aligned.drop("pairs", "links").join(more, "row").drop("row")


def token_links(docs: DataFrame, byte_vocabulary: str, piece_model: str, most_sent: int = MOST_SENT) -> DataFrame:
    """``align_tokens`` with groups as their sha256 ('' without tokens), and the scores of links over all documents."""
    digest = F.when(F.col("n_groups") > 0, F.sha2("groups", 256)).otherwise("")
    aligned = align_tokens(docs, byte_vocabulary, piece_model).withColumn("groups", digest).withColumnRenamed("groups", "groups_sha256")
    aligned = written(aligned.withColumn("row", F.monotonically_increasing_id()), "tokens-aligned")
    return link_scores(docs.sparkSession, aligned, most_sent)
