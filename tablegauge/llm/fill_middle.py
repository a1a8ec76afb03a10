"""Fill-in-the-middle: a text is cut at two borders of its units, and the part between them moves to the end.

A unit is a run of ASCII letters or any other character. One match of the pattern ``(unit)*`` over the text keeps every repetition of
its group, so the ends of the group are the borders of all units: how many there are and where the two cuts lie follows from
them without a loop.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of 100 texts so many stay plain, and of 100 others so many are written suffix first.
PLAIN_FROM = 90
SUFFIX_FIRST = 20
#: Code points that one match covers, some 100 MB of repetitions at most; a run of letters is never parted.
MATCH_CHARS = 1 << 20

_UNITS = regex.compile(r"([A-Za-z]++|[^A-Za-z])*+")
_LETTERS = regex.compile(r"[A-Za-z]*+")
_CUTS = pa.struct([("n", pa.int64()), ("first", pa.int64()), ("second", pa.int64())])


def unit_ends(text: str, match_chars: int = MATCH_CHARS) -> np.ndarray:
    """The end of each unit, in code points. A text beyond ``match_chars`` is matched in stretches that end with a unit."""
    found, at = [], 0
    while at < len(text):
        end = _LETTERS.match(text, min(at + match_chars, len(text))).end()
        found.append(np.array(_UNITS.fullmatch(text, at, end).ends(1), np.int64))
        at = end
    return np.concatenate(found) if found else np.zeros(0, np.int64)


@F.arrow_udf(from_arrow_type(_CUTS))
def _cuts(texts: pa.Array, one: pa.Array, two: pa.Array) -> pa.Array:
    """Units of each text and its two cuts as code points, from two numbers that are taken modulo the units plus one."""
    rows = np.zeros((3, len(texts)), np.int64)
    for k, (text, a, b) in enumerate(zip(texts, one.to_pylist(), two.to_pylist())):
        ends = unit_ends(text.as_py() or "")
        n = len(ends)
        cuts = sorted((a % (n + 1), b % (n + 1)))
        rows[:, k] = n, *(ends[c - 1] if c else 0 for c in cuts)
    return pa.StructArray.from_arrays([pa.array(r) for r in rows], fields=list(_CUTS))


def restore(form: Column, output: Column) -> Column:
    """The text that ``output`` was made from: its parts between the marks, in the order that ``form`` says."""
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    return (F.when(form == "psm", F.concat(parts[1], parts[3], parts[2]))
            .when(form == "spm", F.concat(parts[2], parts[3], parts[1]))
            .otherwise(output))


def fill_in_middle(docs: DataFrame, seed: str = "1") -> DataFrame:
    """(doc_id, text) -> doc_id, n (units), form, prefix_chars, middle_chars, output.

    The first four groups of eight digits of sha256(``seed:doc_id``) decide: two give the cuts, modulo the units plus one, the third
    and fourth the form, ``plain``, ``psm`` or ``spm``. A text that is empty or holds a mark stays plain, and has no
    prefix_chars and middle_chars then. A null text is an empty one; a null doc_id is hashed as nothing after the colon and stays null; repeated
    rows each give the same row; extra columns are ignored; an empty table gives an empty one. Whole texts of any
    length are cut; ``restore`` gives the text back.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    digits = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    h = [F.conv(F.substring(digits, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]
    marked = F.contains("text", F.lit(PREFIX)) | F.contains("text", F.lit(SUFFIX)) | F.contains("text", F.lit(MIDDLE))
    form = F.when((F.col("text") == "") | marked | (h[2] % 100 >= PLAIN_FROM), "plain").when(h[3] % 100 < SUFFIX_FIRST, "spm").otherwise("psm")
    cut = rows.select("doc_id", "text", form.alias("form"), _cuts("text", h[0], h[1]).alias("at"))
    first, second = F.col("at.first"), F.col("at.second")
    prefix, middle = F.substring("text", F.lit(1), first.cast("int")), F.substring("text", (first + 1).cast("int"), (second - first).cast("int"))
    suffix = F.substring("text", (second + 1).cast("int"), F.length("text"))
    output = (F.when(F.col("form") == "psm", F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle))
              .when(F.col("form") == "spm", F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle))
              .otherwise(F.col("text")))
    moved = F.col("form") != "plain"
    return cut.select("doc_id", F.col("at.n").alias("n"), "form", F.when(moved, first).alias("prefix_chars"), F.when(moved, second - first).alias("middle_chars"),
                      output.alias("output"))


def oracle() -> str:
    """DuckDB SQL for the digests of ``fill_in_middle`` over documents; the text itself is what has to come back."""
    digit = ", ".join(f"('0x' || substr(d, {8 * k + 1}, 8))::BIGINT AS h{k + 1}" for k in range(4))
    return f"""
    WITH docs AS (SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS d FROM documents),
    units AS (SELECT doc_id, text, {digit}, regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]') AS u FROM docs),
    cuts AS (SELECT *, len(u)::BIGINT AS n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS a, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS b,
        CASE WHEN text = '' OR contains(text, '{PREFIX}') OR contains(text, '{SUFFIX}') OR contains(text, '{MIDDLE}') OR h3 % 100 >= {PLAIN_FROM} THEN 'plain'
             WHEN h4 % 100 < {SUFFIX_FIRST} THEN 'spm' ELSE 'psm' END AS form FROM units),
    parts AS (SELECT doc_id, text, n, form, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:], '') AS s FROM cuts)
    SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p)::BIGINT END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m)::BIGINT END AS middle_chars,
        sha256(CASE form WHEN 'psm' THEN '{PREFIX}' || p || '{SUFFIX}' || s || '{MIDDLE}' || m
                         WHEN 'spm' THEN '{SUFFIX}' || s || '{PREFIX}' || p || '{MIDDLE}' || m ELSE text END) AS output_sha256,
        sha256(text) AS restored_sha256 FROM parts
    """
