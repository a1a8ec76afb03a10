"""Secrets in texts: rules are regular expressions, and a trigram index tells which texts each rule must read.

From every rule a Boolean query over trigrams is derived that any matching text must satisfy. Texts are indexed block by block, each
block's postings only for trigrams that some query names; a rule runs on the texts its query finds. A rule without a
mandatory trigram reads all texts. Letters count without case in the index, so one index serves all rules.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from re import _constants as sre
from re import _parser as parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablegauge.llm.memory import frugal
from tablegauge.llm.words import SMALL_BLOCK, blocks

#: The base rules, in the order in which spans are listed; group 2 of ``assign`` has 6 characters or more, the others as many as said.
BASE = {
    "assign": r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]+",
    "hex": r"[0-9a-f]+",
}
LEAST = {"assign": 6, "access": 20, "hex": 24}

#: Rules that the method adds: public formats of credentials.
ADDED = {
    "github": r"\bgh[pousr]_[A-Za-z0-9]{36,}",
    "github_fine": r"\bgithub_pat_[A-Za-z0-9_]{50,}",
    "gitlab": r"\bglpat-[A-Za-z0-9_-]{20,}",
    "slack": r"\bxox[abeoprs]-[A-Za-z0-9-]{10,}",
    "slack_hook": r"hooks\.slack\.com/services/[A-Za-z0-9/_-]{20,}",
    "stripe": r"\b[rs]k_(?:live|test)_[A-Za-z0-9]{16,}",
    "google": r"\bAIza[A-Za-z0-9_-]{35}",
    "google_oauth": r"\bya29\.[A-Za-z0-9_-]{20,}",
    "sendgrid": r"\bSG\.[A-Za-z0-9_-]{16,}\.[A-Za-z0-9_-]{16,}",
    "npm": r"\bnpm_[A-Za-z0-9]{36}",
    "pypi": r"\bpypi-[A-Za-z0-9_-]{50,}",
    "jwt": r"\beyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}",
    "private_key": r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----(?:[A-Za-z0-9+/=\s]+-----END (?:[A-Z]+ )*PRIVATE KEY-----)?",
    "url_password": r"\b[a-z][a-z0-9+.-]{1,20}://[^\s/:@]{1,64}:[^\s/:@]{3,}@[^\s/]+",
    "bearer": r"\b[Bb]earer\x20+[A-Za-z0-9._~+/-]{20,}=*",
}

#: Sets of strings in a query stay below this; larger ones are replaced by their trigrams.
_MOST = 64

Query = tuple  # ("all",) | ("none",) | ("gram", bytes) | ("and", queries) | ("or", queries)
ALL: Query = ("all",)


def _and(*parts: Query) -> Query:
    flat = []
    for p in parts:
        flat += p[1] if p[0] == "and" else [] if p == ALL else [p]
    flat = list(dict.fromkeys(map(_frozen, flat)))
    return ALL if not flat else flat[0] if len(flat) == 1 else ("and", tuple(flat))


def _or(*parts: Query) -> Query:
    if any(p == ALL for p in parts):
        return ALL
    flat = []
    for p in parts:
        flat += p[1] if p[0] == "or" else [p]
    flat = list(dict.fromkeys(map(_frozen, flat)))
    return flat[0] if len(flat) == 1 else ("or", tuple(flat))


def _frozen(q: Query) -> Query:
    return (q[0], tuple(q[1])) if q[0] in ("and", "or") else q


def _grams(strings: frozenset[bytes]) -> Query:
    """What a text holding one of ``strings`` must hold."""
    if not strings or min(map(len, strings)) < 3:
        return ALL
    return _or(*(_and(*(("gram", s[k:k + 3]) for k in range(len(s) - 2))) for s in strings))


class _Part:
    """What is known of the matches of a part of a rule: all of them (``exact``), or their ends; and a query besides."""

    def __init__(self, exact=None, prefix=frozenset([b""]), suffix=frozenset([b""]), query: Query = ALL):
        if exact is not None and len(exact) > _MOST:
            prefix, suffix, query, exact = exact, exact, _and(query, _grams(exact)), None
        self.exact, self.query = exact, query
        self.prefix, self.suffix = (frozenset({s[:3] for s in prefix}), frozenset({s[-3:] if s else s for s in suffix})) if exact is None else (exact, exact)
        if exact is None and len(self.prefix) > _MOST:
            self.query, self.prefix = _and(self.query, _grams(self.prefix)), frozenset([b""])
        if exact is None and len(self.suffix) > _MOST:
            self.query, self.suffix = _and(self.query, _grams(self.suffix)), frozenset([b""])

    def then(self, other: _Part) -> _Part:
        def joined(a, b):
            return frozenset(x + y for x in a for y in b) if len(a) * len(b) <= 4 * _MOST else None

        if self.exact is not None and other.exact is not None and (both := joined(self.exact, other.exact)) is not None:
            return _Part(both, query=_and(self.query, other.query))
        across = joined(self.suffix, other.prefix)
        prefix = joined(self.exact, other.prefix) if self.exact is not None else self.prefix
        suffix = joined(self.suffix, other.exact) if other.exact is not None else other.suffix
        query = _and(self.query, other.query, _grams(across) if across else ALL, *(_grams(x.exact) for x in (self, other) if x.exact))
        # a string kept as prefix or suffix is cut to three letters, so what it says is put into the query first
        query = _and(query, *(_grams(x) for x in (prefix, suffix) if x))
        return _Part(None, prefix or frozenset([b""]), suffix or frozenset([b""]), query)

    def either(self, other: _Part) -> _Part:
        if self.exact is not None and other.exact is not None:
            return _Part(self.exact | other.exact, query=_or(self.query, other.query) if ALL not in (self.query, other.query) else ALL)
        mine, theirs = (x.query if x.exact is None else _and(x.query, _grams(x.exact)) for x in (self, other))
        return _Part(None, self.prefix | other.prefix, self.suffix | other.suffix, _or(mine, theirs))

    def all(self) -> Query:
        return _and(self.query, _grams(self.exact) if self.exact is not None else _and(_grams(self.prefix), _grams(self.suffix)))


_NOTHING = frozenset([b""])


def _literal(code: int) -> _Part:
    """One letter, without case; letters outside ASCII say nothing, for their other cases may have another length."""
    return _Part(frozenset([chr(code).lower().encode()])) if code < 128 else _Part(None)


def _part(tree) -> _Part:
    whole = _Part(_NOTHING)
    for op, value in tree:
        if op is sre.LITERAL:
            part = _literal(value)
        elif op is sre.IN:
            part = _charset(value)
        elif op is sre.BRANCH:
            options = [_part(t) for t in value[1]]
            part = options[0]
            for o in options[1:]:
                part = part.either(o)
        elif op is sre.SUBPATTERN:
            part = _part(value[3])
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT, sre.POSSESSIVE_REPEAT):
            low, high, inner = value
            one = _part(inner)
            if low == 0:
                part = one.either(_Part(_NOTHING)) if high == 1 else _Part(None)
            else:
                part = one
                for _ in range(min(low, 3) - 1):
                    part = part.then(one)
                if high != low or low > 3:  # more of the same may stand between the first and the last
                    part = _Part(None, part.prefix, part.suffix, part.all())
        elif op is sre.AT or op is sre.ASSERT_NOT:
            part = _Part(_NOTHING)
        elif op is sre.ATOMIC_GROUP:
            part = _part(value)
        else:  # any letter, other classes, back references, look-ahead: any text at all
            part = _Part(None)
        whole = whole.then(part)
    return whole


def _charset(items) -> _Part:
    codes: set[int] = set()
    for op, value in items:
        if op is sre.LITERAL:
            codes.add(value)
        elif op is sre.RANGE:
            codes |= set(range(value[0], min(value[1], value[0] + 200) + 1))
        else:
            return _Part(None)
    if len(codes) > 12 or max(codes) > 127:
        return _Part(None)
    return _Part(frozenset(chr(c).lower().encode() for c in codes))


def trigram_query(pattern: str) -> Query:
    """A query that every text matching ``pattern`` satisfies, over trigrams of its bytes with A-Z lower-cased."""
    return _part(parser.parse(pattern, re.ASCII)).all()


def named_grams(query: Query) -> set[bytes]:
    return {query[1]} if query[0] == "gram" else {g for q in query[1] for g in named_grams(q)} if query[0] in ("and", "or") else set()


class TrigramIndex:
    """Postings of one block of texts for the trigrams that some query names."""

    _lowered = np.arange(256, dtype=np.uint32)
    _lowered[65:91] += 32

    def __init__(self, data: np.ndarray, offsets: np.ndarray, wanted: np.ndarray):
        """``wanted``: for each of 2^24 codes the number of its trigram, or -1."""
        self.rows = np.arange(len(offsets) - 1)
        self.postings: dict[int, np.ndarray] = {}
        if len(data) > 2:
            low = self._lowered[data]
            number = wanted[low[:-2] << 16 | low[1:-1] << 8 | low[2:]]
            at = np.flatnonzero(number >= 0)
            row = np.searchsorted(offsets, at, "right") - 1
            inside = at + 3 <= offsets[row + 1]
            pair = np.unique(number[at[inside]].astype(np.int64) << 32 | row[inside])
            grams, first = np.unique(pair >> 32, return_index=True)
            for g, part in zip(grams.tolist(), np.split(pair & 0xFFFFFFFF, first[1:])):
                self.postings[g] = part

    def find(self, query: Query, numbers: dict[bytes, int]) -> np.ndarray:
        kind = query[0]
        if kind == "all":
            return self.rows
        if kind == "gram":
            return self.postings.get(numbers[query[1]], self.rows[:0])
        found = sorted((self.find(q, numbers) for q in query[1]), key=len)
        out = found[0]
        for f in found[1:]:
            out = np.intersect1d(out, f, assume_unique=True) if kind == "and" else np.union1d(out, f)
        return out


class Scanner:
    def __init__(self, added: dict[str, str]):
        self.rules = {k: re.compile(p, re.ASCII) for k, p in {**BASE, **added}.items()}
        # whole runs are what counts, so the short ones need not be matched
        self.rules["hex"] = re.compile(r"[0-9a-f]{%d,}" % LEAST["hex"])
        self.queries = {k: trigram_query(r.pattern) for k, r in self.rules.items()}
        grams = sorted({g for q in self.queries.values() for g in named_grams(q)})
        self.numbers = {g: n for n, g in enumerate(grams)}
        self.wanted = np.full(1 << 24, -1, np.int16)
        for g, n in self.numbers.items():
            self.wanted[int.from_bytes(g, "big")] = n

    def block(self, data: np.ndarray, offsets: np.ndarray) -> list[list[tuple[int, int, int, str]]]:
        """Spans (start, order of the rule, end, rule) of each text, sorted."""
        index = TrigramIndex(data, offsets, self.wanted)
        raw = data.tobytes()
        texts: dict[int, str] = {}
        out: list[list[tuple[int, int, int, str]]] = [[] for _ in range(len(offsets) - 1)]
        for order, (kind, rule) in enumerate(self.rules.items()):
            least = LEAST.get(kind, 0)
            group = 2 if kind == "assign" else 0
            for k in index.find(self.queries[kind], self.numbers).tolist():
                text = texts.get(k)
                if text is None:
                    text = texts[k] = raw[offsets[k]:offsets[k + 1]].decode()
                out[k] += [(m.start(), order, m.end(), kind) for m in rule.finditer(text) if m.end(group) - m.start(group) >= least]
        for spans in out:
            spans.sort()
        return out


def _scan(added: dict[str, str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(added)
        for batch in batches:
            rows = [x for _, data, offsets in blocks(batch.column("text"), SMALL_BLOCK) for x in scanner.block(data, offsets)]
            columns = [batch.column("doc_id")]
            for kind in BASE:
                columns.append(pa.array([sum(s[3] == kind for s in x) for x in rows], pa.int64()))
            listed = [",".join(f"{s[3]}:{s[0]}:{s[2]}" for s in x if s[3] in BASE) for x in rows]
            columns.append(pa.array([hashlib.sha256(x.encode()).hexdigest() for x in listed], pa.string()))
            columns.append(pa.array([",".join(f"{s[3]}:{s[0]}:{s[2]}" for s in x) for x in rows], pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", *(f"n_{k}" for k in BASE), "base_sha256", "spans"])

    return run


def _without(text: str, spans: list[tuple[int, int, int, str]]) -> str:
    """``text`` with a mark in place of each run of overlapping spans, named after the first."""
    out, at, k = [], 0, 0
    while k < len(spans):
        start, _, end, kind = spans[k]
        while k + 1 < len(spans) and spans[k + 1][0] < end:
            k += 1
            end = max(end, spans[k][2])
        out += [text[at:start], f"<{kind}>"]
        at, k = end, k + 1
    return "".join([*out, text[at:]])


def find_secrets(docs: DataFrame, added: dict[str, str] | None = None) -> DataFrame:
    """(doc_id, text) -> counts of the base rules, sha256 of their spans, and all spans as ``rule:start:end`` in code points.

    Spans are sorted by start, then in the order of the rules; each is the whole match, leftmost and non-overlapping per rule.
    Rules in ``added`` (default ``ADDED``) only add spans. One row per row: null ids stay null, a null or empty text has no
    spans. Extra columns are ignored; an empty table gives an empty one.
    """
    schema = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(frugal(_scan(ADDED if added is None else added)), schema)


def redact_secrets(docs: DataFrame, added: dict[str, str] | None = None) -> DataFrame:
    """``docs`` with each run of overlapping spans replaced by the rule's name in angle brackets; ``n_chars``, where there is one, of
    the new text. Columns, row count and texts without a span stay as they are, null texts too."""
    if not docs.columns:
        return docs
    others = [c for c in docs.columns if c != "text"]
    ordered = docs.select(*others, "text")
    out = ordered.mapInArrow(frugal(_redactor(ADDED if added is None else added)), ordered.schema)
    if "n_chars" in others:
        out = out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.char_length("text").cast(docs.schema["n_chars"].dataType)))
    return out.select(*docs.columns)


def _redactor(added: dict[str, str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(added)
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            rows = [x for _, data, offsets in blocks(texts, SMALL_BLOCK) for x in scanner.block(data, offsets)]
            new = [_without(t, x) if x else t for t, x in zip(texts.to_pylist(), rows)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(new, texts.type)], names=batch.schema.names)

    return run
