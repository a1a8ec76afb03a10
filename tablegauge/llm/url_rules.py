"""Verdicts on URLs. Pattern rules are found by their rarest literal token; only rules whose token a URL holds run on it."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class HostRule:
    """Fits ``host`` and all its subdomains where the path begins with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


@dataclass(frozen=True)
class PatternRule:
    """A regular expression on the lower-cased URL. ``literals``: tokens that every URL it fits holds as whole tokens."""

    name: str
    pattern: str
    literals: tuple[str, ...]


#: The rules on hosts.
HOST_RULES = (
    HostRule("block", "net", "/"),
    HostRule("allow", "example.net", "/en/"),
    HostRule("block", "example.com", "/de/"),
    HostRule("allow", "org", "/fr/"),
)


def _word(*words: str) -> PatternRule:
    """The words as neighbouring parts of the host, between dots or hyphens."""
    return PatternRule("-".join(words), r"^[a-z][a-z0-9+.-]*://([^/?#]*[.-])?" + "[.-]".join(words) + r"([.-][^/?#]*)?([/?#:]|$)", words)


#: Pattern rules that block: spam, gambling, medicine and adult offers in a host, advertising paths and trackers.
PATTERN_RULES = (
    *(_word(*w) for w in (
        ("cheap", "pills"), ("free", "bets"), ("spam", "farm"), ("adult", "cams"), ("online", "casino"), ("casino", "bonus"), ("buy", "viagra"),
        ("payday", "loans"), ("replica", "watches"), ("free", "porn"), ("sex", "cams"), ("xxx", "videos"), ("essay", "writers"), ("link", "farm"),
        ("crypto", "doubler"), ("warez",), ("torrents",), ("doorway", "pages"), ("click", "bait"), ("phishing",), ("malware",), ("adserver",),
        ("doubleclick",), ("escort", "girls"), ("poker", "bonus"),
    )),
    PatternRule("wp-login", r"://[^/?#]*/([^?#]*/)?wp-login\.php", ("wp", "login")),  # the pattern may go on after php
    PatternRule("cgi-ads", r"://[^/?#]*/([^?#]*/)?(cgi-bin)/ads?[/?]", ("cgi", "bin")),
    PatternRule("banner-ads", r"://[^/?#]*/([^?#]*/)?banner/ads(/|$|[?#])", ("banner", "ads")),
    PatternRule("affiliate", r"[?&]affiliate=[^&#]+", ("affiliate",)),
)

_TOKENS = "[a-z0-9]+"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://`` and for null."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """From the host's end up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _lowered(url: Column) -> Column:
    return F.translate(url, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _tokens(url: str) -> Column:
    return F.array_distinct(F.expr(f"regexp_extract_all({url}, '{_TOKENS}', 0)"))


def rule_index(urls: DataFrame, rules: tuple[PatternRule, ...]) -> dict[str, list[PatternRule]]:
    """The rules by the rarest of their literals among ``urls``; ties go to the first in order of letters.

    Counts of the literals alone are formed, before the shuffle; what comes back is a row per literal of the rules.
    """
    for r in rules:
        if not r.literals or any(not re.fullmatch(_TOKENS, t) for t in r.literals):
            raise ValueError(f"rule {r.name} has no literal token, or one that is no token")
    literals = sorted({t for r in rules for t in r.literals})
    held = F.array_intersect(_tokens("url"), F.array(*map(F.lit, literals)))
    times = {r["token"]: r["count"] for r in urls.select(F.explode(held).alias("token")).groupBy("token").count().collect()}
    index: dict[str, list[PatternRule]] = {}
    for r in rules:
        index.setdefault(min(r.literals, key=lambda t: (times.get(t, 0), t)), []).append(r)
    return index


def _fits(rule: HostRule, host: Column, path: Column) -> Column:
    return ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)


def judge_urls(pages: DataFrame, hosts: tuple[HostRule, ...] = HOST_RULES, rules: tuple[PatternRule, ...] = PATTERN_RULES) -> DataFrame:
    """(page_id, url) -> host, path, ``rule`` (host rule that fits and is longest, else null), ``verdict`` and ``pattern_rule``.

    A host rule decides; without one the verdict is block if a pattern rule fits the URL, else allow. ``pattern_rule`` is the
    first one in order of letters, also where a host rule decides. One row per row; a null URL or one without ``://`` has an
    empty host and path and is allowed. Repeated rows each give a row, extra columns are ignored, an empty table gives an
    empty one.

    Rules are parameters of the job and part of its plan; the index costs one pass over the URLs.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"))
    lowered = rows.filter("url is not null").select(_lowered(F.col("url")).alias("url"))
    index = rule_index(lowered, rules) if rules else {}
    kind = "array<struct<rule:string,pattern:string>>"
    entries = [x for t, found in sorted(index.items()) for x in (F.lit(t), F.array(*(F.struct(F.lit(r.name).alias("rule"), F.lit(r.pattern).alias("pattern")) for r in found)))]
    by_token = F.create_map(*entries) if entries else F.lit(None).cast(f"map<string,{kind}>")
    # a URL's tokens fetch their candidate rules; only those run their expressions
    fetched = F.flatten(F.filter(F.transform(_tokens("lowered"), lambda t: F.try_element_at(by_token, t)), lambda c: c.isNotNull()))
    fitting = F.filter("candidates", lambda c: F.regexp_like(F.col("lowered"), c["pattern"]))
    judged = (
        rows.withColumn("lowered", _lowered(F.col("url")))
        .withColumn("candidates", F.when(F.col("url").isNotNull(), fetched))
        .withColumn("pattern_rule", F.array_min(F.transform(fitting, lambda c: c["rule"])))
        .withColumn("host", host_of(F.col("url")))
        .withColumn("path", path_of(F.col("url")))
    )
    ranked = sorted(hosts, key=lambda r: (-len(r.name), r.name))
    rule, verdict = F.lit(None).cast("string"), F.when(F.col("pattern_rule").isNotNull(), "block").otherwise("allow")
    for r in reversed(ranked):
        fit = _fits(r, F.col("host"), F.col("path"))
        rule, verdict = F.when(fit, r.name).otherwise(rule), F.when(fit, r.verdict).otherwise(verdict)
    return judged.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("verdict"), "pattern_rule")


def oracle(hosts: tuple[HostRule, ...] = HOST_RULES, rules: tuple[PatternRule, ...] = PATTERN_RULES) -> str:
    """DuckDB SQL for ``judge_urls`` over pages: every rule is tried on every URL."""
    ranked = sorted(hosts, key=lambda r: (-len(r.name), r.name))
    fits = {r: f"(host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}')" for r in ranked}
    pattern = ", ".join(f"CASE WHEN regexp_matches(lowered, '{r.pattern}') THEN '{r.name}' END" for r in rules)
    return f"""
    WITH u AS (SELECT page_id, url, translate(url, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lowered FROM pages),
    p AS (SELECT page_id, lowered, list_min(list_filter([{pattern}], lambda x: x IS NOT NULL)) AS pattern_rule,
      translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
      coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM u)
    SELECT page_id, host, path, CASE {" ".join(f"WHEN {fits[r]} THEN '{r.name}'" for r in ranked)} END AS rule,
      CASE {" ".join(f"WHEN {fits[r]} THEN '{r.verdict}'" for r in ranked)} WHEN pattern_rule IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict, pattern_rule
    FROM p
    """
