"""Quality rules on repetition: how much of a text lies in word runs and lines that it says twice."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablegauge.llm.words import blocks, hashes, spans, windows

#: Percent of the characters in words that may lie in repeated runs of so many words.
RUN_LIMITS = {5: 15, 6: 14, 7: 13, 8: 12, 9: 11, 10: 10}
#: Percent of the characters in words that may lie in lines equal to an earlier one.
LINE_LIMIT = 20
MIN_WORDS = 50
BASE_RUN = 3
BASE_LIMIT = 50

_SYMBOL = np.zeros(256, bool)
_SYMBOL[np.frombuffer(b"#*$%&|<>", np.uint8)] = True

_COLUMNS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "dup_line_chars", *(f"dup_chars_{n}" for n in RUN_LIMITS)]


def _covered(words: np.ndarray, size: int) -> np.ndarray | None:
    """Which words lie in a run of ``size`` words that the text has twice or more; None where there is none."""
    runs = windows(words, size)
    if len(runs) < 2:
        return None
    ordered = np.sort(runs)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return None
    at = np.minimum(np.searchsorted(twice, runs), len(twice) - 1)
    edges = np.zeros(len(words) + 1, np.int64)
    found = np.flatnonzero(twice[at] == runs)
    edges[found] += 1
    edges[found + size] -= 1
    return np.cumsum(edges[:-1]) > 0


def _figures(texts: pa.Array) -> np.ndarray:
    """A row of ``_COLUMNS`` per text."""
    out = np.zeros((len(texts), len(_COLUMNS)), np.int64)
    for row, data, offsets in blocks(texts):
        starts, ends, first = spans(data, offsets)
        words = hashes(data, starts, ends, lower=False)
        chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        lengths = chars[ends] - chars[starts]
        symbols = np.concatenate([[0], np.cumsum(_SYMBOL[data])])
        n = len(offsets) - 1
        part = out[row:row + n]
        part[:, 0] = np.diff(first)
        letters = np.concatenate([[0], np.cumsum(lengths)])
        part[:, 1] = letters[first[1:]] - letters[first[:-1]]
        part[:, 2] = symbols[offsets[1:]] - symbols[offsets[:-1]]
        # lines: from each document's start and after each \n up to the next \n or the document's end
        breaks = np.flatnonzero(data == 10)
        line_starts = np.unique(np.concatenate([offsets[:-1], breaks + 1]))
        line_starts = line_starts[line_starts < len(data)]
        line_ends = np.append(line_starts, len(data))[1:]
        line_ends = line_ends - (data[line_ends - 1] == 10)
        of_word = np.searchsorted(starts, line_starts), np.searchsorted(starts, line_ends)
        full = of_word[1] > of_word[0]
        line_starts, line_ends = line_starts[full], line_ends[full]
        line_chars = letters[of_word[1][full]] - letters[of_word[0][full]]
        lines = hashes(data, line_starts, line_ends, lower=False)
        line_first = np.searchsorted(line_starts, offsets)
        for k in np.flatnonzero(np.diff(line_first) > 1).tolist():
            a, b = line_first[k], line_first[k + 1]
            _, where = np.unique(lines[a:b], return_index=True)
            part[k, 3] = b - a - len(where)
            part[k, 5] = line_chars[a:b].sum() - line_chars[a:b][where].sum()
        for k, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist())):
            covered = _covered(words[a:b], BASE_RUN)
            if covered is None:
                continue  # longer runs cannot repeat either
            part[k, 4] = covered.sum()
            for c, size in enumerate(RUN_LIMITS):
                covered = _covered(words[a:b], size)
                if covered is None:
                    break
                part[k, 6 + c] = lengths[a:b][covered].sum()
    return out


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        figures = _figures(batch.column("text"))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(figures[:, k]) for k in range(len(_COLUMNS)))], names=["doc_id", *_COLUMNS])


def repetition_rules(docs: DataFrame) -> DataFrame:
    """(doc_id, text) -> one row per row with its figures, ``base_failed`` and ``kept``.

    Words are runs of anything but ASCII white space. ``n_repeat_words`` counts words inside three-word runs that occur twice
    or more; ``dup_chars_n`` the code points of words inside n-word runs that do, ``dup_line_chars`` those of lines equal to an
    earlier one. A text fails the base rule below 50 words or when over half its words repeat; it is kept if, besides,
    none of the shares is over its limit. Runs are found by rolling hashes of 64 bits over the whole text. A null or
    empty text has zeros and fails the base rule; a null doc_id stays null; repeated rows each give a row; extra columns
    are ignored; an empty table gives an empty one.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    figures = rows.mapInArrow(_run, ", ".join(["doc_id long", *(f"{c} long" for c in _COLUMNS)]))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > BASE_LIMIT * F.col("n_words"))
    good = 100 * F.col("dup_line_chars") <= LINE_LIMIT * F.col("word_chars")
    for size, limit in RUN_LIMITS.items():
        good = good & (100 * F.col(f"dup_chars_{size}") <= limit * F.col("word_chars"))
    return figures.withColumn("base_failed", failed).withColumn("kept", ~failed & good)


def oracle() -> str:
    """DuckDB SQL for ``repetition_rules`` over documents."""
    sizes = [BASE_RUN, *RUN_LIMITS]
    covered = "\n".join(
        f"""c{n} AS (SELECT row, list_distinct(flatten(list([i + k for k in range({n})]))) AS at FROM (
              SELECT row, i, count(*) OVER (PARTITION BY row, run) AS times FROM (
                SELECT row, unnest(range(1, len(w) - {n} + 2)) AS i, w, w[i:i + {n - 1}] AS run FROM words WHERE len(w) >= {n})) WHERE times > 1 GROUP BY row),"""
        for n in sizes
    )
    return f"""
    WITH docs AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents),
    words AS (SELECT row, doc_id, text, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS w FROM docs),
    {covered}
    lines AS (SELECT row, line, count(*) AS times FROM (SELECT row, unnest(string_split(text, chr(10))) AS line FROM docs)
              WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY ALL),
    dup AS (SELECT row, sum(times - 1) AS n_dup_lines, sum((times - 1) * length(regexp_replace(line, '[\\x20\\x09-\\x0D]+', '', 'g'))) AS dup_line_chars FROM lines GROUP BY row),
    f AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
            (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
            coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(len(c{BASE_RUN}.at), 0)::BIGINT AS n_repeat_words, coalesce(dup_line_chars, 0)::BIGINT AS dup_line_chars,
            {", ".join(f"coalesce(list_sum([length(w[k]) for k in c{n}.at]), 0)::BIGINT AS dup_chars_{n}" for n in RUN_LIMITS)}
          FROM words LEFT JOIN dup USING (row) {" ".join(f"LEFT JOIN c{n} USING (row)" for n in sizes)}),
    g AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {BASE_LIMIT} * n_words AS base_failed FROM f)
    SELECT *, NOT base_failed AND 100 * dup_line_chars <= {LINE_LIMIT} * word_chars
      {" ".join(f"AND 100 * dup_chars_{n} <= {limit} * word_chars" for n, limit in RUN_LIMITS.items())} AS kept FROM g
    """
