"""Ids of whole texts put together from the ids of their distinct pieces, each encoded once while a task remembers it."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from tablegauge.llm.words import hashes

#: Pieces and ids that a task remembers, some 60 MB; then it starts anew.
MOST_PIECES = 1_000_000
MOST_IDS = 8_000_000

_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_MARK = np.zeros(256, bool)
_MARK[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
_MARK_NO_APOSTROPHE = _MARK.copy()
_MARK_NO_APOSTROPHE[39] = False
_ODD = np.zeros(256, bool)
_ODD[[0x1C, 0x1D, 0x1E, 0x1F]] = True
_LEAD = np.zeros(256, bool)
_LEAD[[0xC2, 0xE1, 0xE2, 0xE3]] = True


def odd_white_space(data: np.ndarray) -> np.ndarray:
    """Where a byte begins white space outside ASCII, or a control character that some libraries take for white space."""
    found = np.flatnonzero(_ODD[data])
    lead = np.flatnonzero(_LEAD[data])
    if len(lead):
        padded = np.concatenate([data, np.zeros(2, np.uint8)])
        a, b, c = data[lead], padded[lead + 1], padded[lead + 2]
        last = (c >= 0x80) & (c <= 0x8A) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF)
        hit = (a == 0xC2) & ((b == 0x85) | (b == 0xA0)) | (a == 0xE1) & (b == 0x9A) & (c == 0x80) | (a == 0xE3) & (b == 0x80) & (c == 0x80)
        hit |= (a == 0xE2) & ((b == 0x80) & last | (b == 0x81) & (c == 0x9F))
        found = np.concatenate([found, lead[hit]])
    return found


def odd_rows(data: np.ndarray, offsets: np.ndarray, names: list[bytes]) -> set[int]:
    """Rows that must not be cut into pieces: those with odd white space or one of ``names``."""
    at = odd_white_space(data).tolist()
    raw = data.tobytes()
    for name in names:
        k = raw.find(name)
        while k >= 0:
            at.append(k)
            k = raw.find(name, k + 1)
    return set((np.searchsorted(offsets, at, "right") - 1).tolist()) if at else set()


def byte_level_cuts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Starts of pieces that no token of a byte-level vocabulary crosses, for texts whose white space is ASCII.

    A space belongs to what follows it; other white space before a word is a piece for all but its last character and one
    for that; marks are cut from ASCII letters, but for an apostrophe from the letters after it.
    """
    n = len(data)
    white = _WHITE[data]
    start = np.zeros(n + 1, bool)
    start[offsets] = True
    cut = start[:-1].copy()
    if n > 1:
        inner = ~start[1:-1]  # both sides in one text
        before, after = white[:-1], white[1:]
        cut[1:] |= ~before & after
        cut[:-1] |= before & ~after & inner
        cut[1:] |= before & ~after & (data[:-1] != 32)
        letter, mark, plain = _LETTER[data], _MARK[data], _MARK_NO_APOSTROPHE[data]
        cut[1:] |= letter[:-1] & mark[1:] | plain[:-1] & letter[1:]
    return np.flatnonzero(cut)


class PieceTable:
    """Remembers the ids of pieces by a 64-bit hash of their bytes.

    ``encode`` gets new pieces as texts and returns all their ids one after the other, and how many each has. ``most``: how many
    pieces are remembered; the pieces of the texts at hand always are.
    """

    def __init__(self, cuts: Callable, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], kind: type = np.uint16, most: int = MOST_PIECES):
        self.cuts, self.encode, self.kind, self.most = cuts, encode, kind, most
        self._clear()

    def _clear(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.at = np.zeros(0, np.int64)
        self.size = np.zeros(0, np.int64)
        self.ids = np.zeros(0, self.kind)
        self.spare = 0

    def _add(self, keys: np.ndarray, texts: list[str]) -> None:
        found, sizes = self.encode(texts)
        total = int(sizes.sum())
        if self.spare + total > len(self.ids):
            grown = np.zeros(max(2 * len(self.ids), self.spare + total, 1 << 16), self.kind)
            grown[:self.spare] = self.ids[:self.spare]
            self.ids = grown
        self.ids[self.spare:self.spare + total] = found
        at = self.spare + np.cumsum(sizes) - sizes
        self.spare += total
        place = np.searchsorted(self.keys, keys)
        self.keys = np.insert(self.keys, place, keys)
        self.at = np.insert(self.at, place, at)
        self.size = np.insert(self.size, place, sizes)

    def _find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(self.keys, keys), max(len(self.keys) - 1, 0))
        return at, (self.keys[at] == keys if len(self.keys) else np.zeros(len(keys), bool))

    def texts(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, and where each text's begin (one entry more than texts)."""
        starts = self.cuts(data, offsets)
        if not len(starts):
            return np.zeros(0, self.kind), np.zeros(len(offsets), np.int64)
        ends = np.append(starts[1:], len(data))
        keys, first, which = np.unique(hashes(data, starts, ends, lower=False), return_index=True, return_inverse=True)
        at, known = self._find(keys)
        if not known.all():
            if len(self.keys) + np.count_nonzero(~known) > self.most or self.spare > MOST_IDS:
                self._clear()
                known = np.zeros(len(keys), bool)
            new = np.flatnonzero(~known)
            raw = data.tobytes()
            self._add(keys[new], [raw[a:b].decode() for a, b in zip(starts[first[new]].tolist(), ends[first[new]].tolist())])
            at, _ = self._find(keys)
        at = at[which]
        sizes = self.size[at]
        upto = np.concatenate([[0], np.cumsum(sizes)])
        out = self.ids[np.repeat(self.at[at] - upto[:-1], sizes) + np.arange(upto[-1])]
        return out, upto[np.searchsorted(starts, offsets)]
