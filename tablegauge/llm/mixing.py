"""Mixing sources to target weights: token weights are raked to given shares, documents are drawn by the probabilities that result."""

from __future__ import annotations

import itertools
import re
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import partial, reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OTHER = "other"
#: What counts as a word, and what marks a topic; the first that fits, else prose.
_WORD = r"[^\x20\x09-\x0D]+"
TOPICS = {"license": "[Ll]icen[sc]e|LICENSE|[Cc]opyright", "contact": "@", "table": r" \| ", "shout": "!!"}


def _shares(**shares: float) -> dict[str, float]:
    return shares


@dataclass(frozen=True)
class Targets:
    """Shares of all tokens by source, language and topic. What is not named counts as ``other``; shares of groups without
    tokens are left out, the rest are scaled to one. ``keep`` is the part of all tokens to take in sum, as far as the groups have
    enough. There are as many cells as named groups allow, whatever the data."""

    source: dict[str, float] = field(default_factory=lambda: _shares(src0=0.30, src1=0.04, src2=0.04, src3=0.03, other=0.59))
    lang: dict[str, float] = field(default_factory=lambda: _shares(en=0.62, de=0.16, fr=0.13, es=0.08, other=0.01))
    topic: dict[str, float] = field(default_factory=lambda: _shares(prose=0.92, contact=0.02, license=0.03, table=0.02, shout=0.01))
    keep: float = 0.7
    rounds: int = 30


def written_out(pattern: str) -> list[str]:
    """The texts that a pattern of plain letters, character classes and alternatives stands for: a search for a text needs no pattern."""
    out = []
    for branch in re.split(r"(?<!\\)\|", pattern):
        parts = re.findall(r"\[([^]]+)\]|\\(.)|(.)", branch)
        out += map("".join, itertools.product(*[letters or escaped or plain for letters, escaped, plain in parts]))
    return out


def topic_of(text: Column) -> Column:
    topic = F.lit("prose")
    for name, pattern in reversed(TOPICS.items()):
        topic = F.when(reduce(or_, [F.contains(text, F.lit(part)) for part in written_out(pattern)]), name).otherwise(topic)
    return topic


def _group(value: Column, shares: dict[str, float]) -> Column:
    return F.when(value.isin([k for k in shares if k != OTHER]), value).otherwise(OTHER)


def with_cells(docs: DataFrame, targets: Targets) -> DataFrame:
    """``docs`` with its words as ``_tokens`` and its groups as ``_source``, ``_lang`` and ``_topic``."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(
        "*",
        F.regexp_count(text, F.lit(_WORD)).cast("long").alias("_tokens"),
        _group(F.col("source"), targets.source).alias("_source"),
        _group(F.col("lang"), targets.lang).alias("_lang"),
        _group(topic_of(text), targets.topic).alias("_topic"),
    )


def _once(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of an array that is computed once, however often ``then`` names it."""
    return F.flatten(F.transform(F.array(value), lambda v: then(v)))


def calibrated(cells: DataFrame, targets: Targets) -> DataFrame:
    """(_source, _lang, _topic, _tokens) -> the same with ``_p``, the share of each cell's tokens to take.

    Iterative proportional fitting: weights start as the tokens, and each step scales the groups of one margin to their shares of
    ``targets.keep`` times all tokens. No cell gives more than it has: its weight ends at its tokens, and the cells beside it in a
    group make up for it in the next round. So a group that has too little gives all of it and leaves the others alone. The
    steps are one expression over one row that holds the cells.
    """
    cells = cells.filter("_tokens > 0")
    row = cells.agg(
        F.sort_array(F.collect_list(F.struct("_source", "_lang", "_topic", F.col("_tokens").cast("double").alias("w"), "_tokens"))).alias("cells"),
        (F.sum("_tokens") * F.lit(float(targets.keep))).alias("total"),
    )
    margins = [("_source", targets.source), ("_lang", targets.lang), ("_topic", targets.topic)]

    def raked(name: str, shares: dict[str, float], state: Column) -> Column:
        # sums by group, in one walk over the cells
        groups = sorted(shares)
        zero = F.array(*[F.lit(0.0)] * len(groups))
        place = F.create_map(*[F.lit(x) for g, k in zip(groups, range(len(groups))) for x in (g, k)])
        sums = F.aggregate(state, zero, lambda a, c: F.transform(a, lambda v, k: v + F.when(F.element_at(place, c[name]) == k, c["w"]).otherwise(0.0)))
        wanted = F.array(*[F.lit(float(shares[g])) for g in groups])
        present = F.aggregate(F.zip_with(sums, wanted, lambda s, t: F.when(s > 0, t).otherwise(0.0)), F.lit(0.0), lambda a, t: a + t)
        factors = _once(present, lambda of: F.zip_with(sums, wanted, lambda s, t: F.when((s > 0) & (of > 0), F.col("total") * t / of / s).otherwise(0.0)))
        return _once(factors, lambda f: F.transform(state, lambda c: c.withField(
            "w", F.least(c["w"] * F.element_at(f, F.element_at(place, c[name]) + 1), c["_tokens"].cast("double"))
        )))

    def step(state: Column, _: Column) -> Column:
        for name, shares in margins:
            state = _once(state, partial(raked, name, shares))
        return state

    fitted = row.select(F.aggregate(F.sequence(F.lit(1), F.lit(targets.rounds)), F.col("cells"), step).alias("cells"))
    return fitted.select(F.explode("cells").alias("c")).select("c._source", "c._lang", "c._topic", F.round(F.col("c.w") / F.col("c._tokens"), 9).alias("_p"))


def draw(doc_id: Column) -> Column:
    """A number in [0, 1) that depends on the id alone; null counts as an id of its own."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), 1, 8), 16, 10).cast("double") / float(1 << 32)


def mix_sources(docs: DataFrame, targets: Targets | None = None) -> DataFrame:
    """``docs`` with ``_tokens``, ``_source``, ``_lang``, ``_topic``, the probability ``_p`` and ``_kept``.

    One row per row; no column is dropped. ``_p`` is 9 digits long; a row is kept if ``draw(doc_id)`` is below it, so rows with one id share
    a fate. Null sources and languages are ``other``; a null or empty text has no tokens and goes by its cell, or is dropped if
    the cell has no tokens. An empty table gives an empty one. Columns of ``docs`` must not begin with an underscore and one of these names.

    One pass sums tokens by cell, before the shuffle; the probabilities, a row per cell, are sent to all tasks.
    """
    targets = targets or Targets()
    named = with_cells(docs, targets)
    cells = named.groupBy("_source", "_lang", "_topic").agg(F.sum("_tokens").alias("_tokens"))
    p = calibrated(cells, targets)
    out = named.join(F.broadcast(p), ["_source", "_lang", "_topic"], "left")
    return out.withColumn("_p", F.coalesce("_p", F.lit(0.0))).withColumn("_kept", draw(F.col("doc_id")) < F.col("_p"))


def oracle(table: str = "documents", targets: Targets | None = None) -> str:
    """DuckDB SQL for the columns of ``mix_sources`` over ``table``, under the names of the query op7."""
    targets = targets or Targets()

    def group(column: str, shares: dict[str, float]) -> str:
        names = ", ".join(f"'{k}'" for k in shares if k != OTHER)
        return f"CASE WHEN {column} IN ({names}) THEN {column} ELSE '{OTHER}' END"

    def share(column: str, shares: dict[str, float]) -> str:
        return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN {float(v)!r}::DOUBLE" for k, v in shares.items()) + " ELSE 0::DOUBLE END"

    topic = "CASE " + " ".join(f"WHEN regexp_matches(body, '{p}') THEN '{t}'" for t, p in TOPICS.items()) + " ELSE 'prose' END"
    rounds, steps = "", ["source_group", "lang_group", "topic"]
    previous = "cells"
    for k in range(3 * targets.rounds):
        name = steps[k % 3]
        shares = [targets.source, targets.lang, targets.topic][k % 3]
        present = f"(SELECT sum({share(name, shares)}) FROM (SELECT DISTINCT {name} FROM {previous} WHERE w > 0))"
        factor = f"(SELECT total FROM whole) * {share(name, shares)} / nullif({present}, 0) / nullif(sum(w) OVER (PARTITION BY {name}), 0)"
        rounds += f"r{k} AS MATERIALIZED (SELECT source_group, lang_group, topic, tokens, least(w * coalesce({factor}, 0), tokens::DOUBLE) AS w FROM {previous}),\n"
        previous = f"r{k}"
    return f"""
    WITH d AS (SELECT doc_id, source, lang, coalesce(text, '') AS body FROM {table}),
    named AS (SELECT doc_id, len(regexp_extract_all(body, '{_WORD}'))::BIGINT AS tokens, {group('source', targets.source)} AS source_group,
      {group('lang', targets.lang)} AS lang_group, {group(f'({topic})', targets.topic)} AS topic FROM d),
    cells AS (SELECT source_group, lang_group, topic, sum(tokens)::BIGINT AS tokens, sum(tokens)::DOUBLE AS w FROM named GROUP BY ALL HAVING sum(tokens) > 0),
    whole AS (SELECT sum(tokens)::DOUBLE * {float(targets.keep)!r}::DOUBLE AS total FROM cells),
    {rounds}
    p AS (SELECT source_group, lang_group, topic, round(w / tokens, 9) AS probability FROM {previous})
    SELECT doc_id, tokens, source_group, lang_group, topic, coalesce(probability, 0) AS probability,
      ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT / 4294967296.0::DOUBLE < coalesce(probability, 0) AS kept
    FROM named LEFT JOIN p USING (source_group, lang_group, topic)
    """
