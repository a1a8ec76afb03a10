"""BPE encoding by dynamic programming over prefixes, and decoding.

Byte-pair merging has this property: a text's last token is the only one that may follow the tokens of the text before it. So every prefix
of a word has one last token, and the word's tokens are read off by following these backwards. An automaton gives the tokens
that end at each place; whether one may follow another is tested by undoing their merges in turn.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablegauge.llm.memory import frugal
from tablegauge.llm.pieces import PieceTable, byte_level_cuts, odd_rows
from tablegauge.llm.words import SMALL_BLOCK, blocks

#: Stands for the end of a word inside this module.
_END = "\uffff"
#: Words and pairs of tokens that a task remembers.
REMEMBERED = 20_000
#: Pieces that a task remembers, some 10 MB beside the vocabulary.
MOST_PIECES = 1 << 18
_NEVER = 1 << 60


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: printable bytes as they are, others from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


class Merges:
    """The merges of a vocabulary: words in, token ids out."""

    def __init__(self, vocabulary: dict[str, int], merges: list[tuple[str, str]], suffix: str):
        def inner(token: str) -> str:
            return token[:-len(suffix)] + _END if suffix and token.endswith(suffix) and len(token) > len(suffix) else token

        self.ids = vocabulary
        tokens = {inner(t): i for t, i in vocabulary.items()}
        self.rank = dict.fromkeys(tokens.values(), -1)
        self.left: dict[int, int] = {}
        self.right: dict[int, int] = {}
        self.pairs: dict[tuple[int, int], int] = {}
        self.length = {i: len(t) for t, i in tokens.items()}
        for r, (a, b) in enumerate(merges):
            x, y = tokens[inner(a)], tokens[inner(b)]
            whole = tokens[inner(a) + inner(b)]
            if whole in self.left or self.rank[x] >= r or self.rank[y] >= r:
                raise ValueError("a token has several merges, or one before those of its parts")
            self.rank[whole], self.left[whole], self.right[whole] = r, x, y
            self.pairs[x, y] = r
        self.valid: dict[tuple[int, int], bool] = {}
        self.words: dict[str, list[int]] = {}
        self.automaton = ahocorasick.Automaton()
        # a token whose own parts may not stand side by side is never reached by merging
        for t, i in sorted(tokens.items(), key=lambda x: self.rank[x[1]]):
            single = len(t) - t.endswith(_END) == 1
            if single or i in self.left and self._reached(i):
                self.automaton.add_word(t, (i, len(t)))
        self.automaton.make_automaton()
        self.valid.clear()

    def _reached(self, token: int) -> bool:
        """The parts of ``token`` meet unmerged until its own merge joins them."""
        left, right = self.left[token], self.right[token]
        return self._apart(left, right, self.rank[token])

    def _apart(self, a: int, b: int, until: int) -> bool:
        """No merge of a rank below ``until`` joins ``a`` and ``b`` or what they were made of across their border.

        Undoes the later of the two merges step by step. A piece can be joined across the border after its own merge and before the
        one that took it up; where ranks are equal, merging goes from left to right, so the left piece is taken up first.
        """
        rank, pairs = self.rank, self.pairs
        a_gone = b_gone = until
        while True:
            joined = pairs.get((a, b), _NEVER)
            if joined < a_gone and (joined < b_gone or joined == b_gone and b_gone < until):
                return False
            if rank[a] > rank[b]:
                a_gone, a = rank[a], self.right[a]
            elif rank[b] >= 0:
                b_gone, b = rank[b], self.left[b]
            else:
                return True

    def may_follow(self, a: int, b: int) -> bool:
        found = self.valid.get((a, b))
        if found is None:
            if len(self.valid) > REMEMBERED:
                self.valid.clear()
            found = self.valid[a, b] = self._apart(a, b, _NEVER - 1)
        return found

    def word(self, letters: str) -> list[int]:
        """The ids of one word, given in byte letters with ``_END`` at its end."""
        known = self.words.get(letters)
        if known is not None:
            return known
        n = len(letters)
        last: list[tuple[int, int] | None] = [None] * (n + 1)
        for end, found in self.automaton.iter(letters):
            end += 1
            if last[end] is None:
                before = end - found[1]
                if before == 0 or last[before] is not None and self.may_follow(last[before][0], found[0]):
                    last[end] = found
        out, at = [], n
        while at:
            token, size = last[at]
            out.append(token)
            at -= size
        out.reverse()
        if len(self.words) > REMEMBERED:
            self.words.clear()
        if n < 64:
            self.words[letters] = out
        return out


class WordBpe:
    """Encodes and decodes as a vocabulary file of the kind "BPE with word ends" says: NFC, lower case, white space dropped."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        kinds = [n["type"] for n in spec["normalizer"]["normalizers"]], spec["decoder"]
        if kinds != (["NFC", "Replace", "Lowercase"], None) or model["type"] != "BPE" or not model["end_of_word_suffix"]:
            raise ValueError("another kind of vocabulary")
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pattern = regex.compile(split["pattern"]["Regex"])
        self.merges = Merges(model["vocab"], [tuple(m) for m in model["merges"]], model["end_of_word_suffix"])
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special = regex.compile("|".join(map(regex.escape, self.specials))) if self.specials else None
        self.letters = byte_letters()
        self.names = [b""] * (max([*model["vocab"].values(), *self.specials.values()]) + 1)
        for t, i in [*model["vocab"].items(), *self.specials.items()]:
            self.names[i] = t.encode()

    def _plain(self, text: str) -> list[int]:
        text = unicodedata.normalize("NFC", text)
        # letter by letter where lower() would look at a letter's place in its word
        text = "".join(c.lower() for c in text) if "Σ" in text else text.lower()
        out: list[int] = []
        letters, word = self.letters, self.merges.word
        for w in self.pattern.findall(text):
            if not (w.isascii() and w.isprintable()):
                w = "".join([letters[b] for b in w.encode()])
            out += word(w + _END)
        return out

    def text(self, text: str) -> list[int]:
        if not self.special or "<" not in text:
            return self._plain(text)
        out, at = [], 0
        for m in self.special.finditer(text):
            out += self._plain(text[at:m.start()]) + [self.specials[m[0]]]
            at = m.end()
        return out + self._plain(text[at:])

    def pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [self.text(p) for p in pieces]
        return np.array([i for x in found for i in x], np.uint32), np.array([len(x) for x in found], np.int64)

    def decode(self, ids: np.ndarray) -> bytes:
        """The names of the tokens with a space between, in UTF-8: the file names no decoder."""
        names = self.names
        return b" ".join([names[i] for i in ids.tolist()])


def _encoder(vocabulary: str, with_ids: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = WordBpe(vocabulary)
        table = PieceTable(byte_level_cuts, bpe.pieces, np.uint32, MOST_PIECES)
        specials = [t.encode() for t in bpe.specials]
        for batch in batches:
            sizes, ids_sums, text_sums, lists = [], [], [], []
            for _, data, offsets in blocks(batch.column("text"), SMALL_BLOCK):
                odd = odd_rows(data, offsets, specials)
                ids, bounds = table.texts(data, offsets)
                for k in range(len(offsets) - 1):
                    own = ids[bounds[k]:bounds[k + 1]] if k not in odd else np.array(bpe.text(data[offsets[k]:offsets[k + 1]].tobytes().decode()), np.uint32)
                    sizes.append(len(own))
                    ids_sums.append(hashlib.sha256(own.astype("<u4").tobytes()).hexdigest())
                    text_sums.append(hashlib.sha256(bpe.decode(own)).hexdigest())
                    if with_ids:
                        lists.append(own.astype(np.int32))
            columns = [pa.array(sizes, pa.int64()), pa.array(ids_sums, pa.string()), pa.array(text_sums, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                columns.append(pa.array(lists, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names=names)

    return run


def encode_documents(docs: DataFrame, vocabulary: str, with_ids: bool = False) -> DataFrame:
    """(doc_id, text) -> number of tokens, sha256 of the ids as little-endian 32-bit integers and of the decoded text; with
    ``with_ids`` also the ids.

    One row per row, null ids included. A null or empty text has no tokens and the sums of nothing. The names of special tokens in
    a text become those tokens, as the library has it. Extra columns are ignored; an empty table gives an empty one.
    Pieces that no token crosses are encoded once per task while it remembers them; ``vocabulary`` is a path that every executor has.
    """
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(frugal(_encoder(vocabulary, with_ids)), schema)
