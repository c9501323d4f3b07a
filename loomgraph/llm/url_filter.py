"""URL filter: pattern rules indexed by their rarest literal token.

A URL's tokens fetch candidate rules from the index, and only those run their regular expressions. All of it is DataFrame
functions. Up to ``INLINE_RULES`` rules the index is a literal in the plan, the filter is then one projection with no shuffle;
beyond that bound it becomes a table that the URLs' tokens join, with the tokens salted, since ``com`` or ``www`` may stand in
most URLs.

Defined cases: a null URL, or one without ``://``, has empty host and path, fits only rules without literals, and gets the
default; repeated rows each get their verdict; an empty table gives an empty result; further columns pass through unless they
bear the name of an output column, which the output replaces.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, table

#: Rules up to which the index is part of the plan itself.
INLINE_RULES = 256
#: Copies of each rule, and so parts of each URL token, in the join.
SALTS = 32
OUTPUT = ("host", "path", "rule", "verdict")


class Rule(NamedTuple):
    """pattern is a Java regular expression over host and path; tokens are the whole tokens that each match holds."""

    name: str
    pattern: str
    tokens: tuple[str, ...]
    action: str
    tier: int


def _tokens(text: str, open_start: bool, open_end: bool) -> tuple[str, ...]:
    """Tokens of a literal; one at an open side may be part of a longer token, so it is left out."""
    runs = [(m.start(), m.end(), m[0]) for m in re.finditer("[a-z0-9]+", text.lower())]
    return tuple(dict.fromkeys(t for a, b, t in runs if not (open_start and a == 0) and not (open_end and b == len(text))))


def prefix_rule(host: str, path: str, action: str, tier: int = 1) -> Rule:
    """Fits the host and its subdomains where the URL's path starts with path."""
    return Rule(host + path, rf"^(?:[^/]*\.)?{re.escape(host + path)}", _tokens(host + path, False, True), action, tier)


def glob_rule(glob: str, action: str, tier: int = 0) -> Rule:
    """``*`` is any text; ``||`` in front holds the match to a host label's start; else it may stand anywhere."""
    anchored = glob.startswith("||")
    parts = glob.removeprefix("||").split("*")
    body = ".*".join(map(re.escape, parts))
    tokens = [t for i, p in enumerate(parts) for t in _tokens(p, not (anchored and i == 0), True)]
    return Rule(glob, (r"^(?:[^/]*\.)?" if anchored else "") + body, tuple(dict.fromkeys(tokens)), action, tier)


#: The base rules of the contract.
BASE_RULES = (
    prefix_rule("com", "/", "allow"),
    prefix_rule("example.com", "/en/", "block"),
    prefix_rule("www.example.com", "/en/", "allow"),
    prefix_rule("net", "/es/", "block"),
    prefix_rule("net", "/fr/", "block"),
)
#: The method's own rules, for URLs that no base rule fits.
SPAM_RULES = tuple(glob_rule(g, "block") for g in ("||casino-win.", "||free-bets.", "||cheap-pills.", "||adult-x.", "||spam-farm.", "||ads-track.", "*/wp-login.*", "*/cgi-bin/*"))


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty without ``://``."""
    url = F.coalesce(url, F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest.substr(F.length(host) + 1, F.length(url)), r"^[^?#]*", 0)
    return ascii_lower(host), path


def _url_tokens(target: Column) -> Column:
    """Whole tokens of the URL; the empty one, under which rules without literals stand, comes along."""
    return F.array_union(F.split(ascii_lower(target), "[^a-z0-9]+"), F.array(F.lit("")))


def token_counts(urls: DataFrame, tokens: Sequence[str]) -> dict[str, int]:
    """In how many URLs each of the rules' tokens stands, over all URLs."""
    if not tokens:
        return {}
    seen = urls.select(F.explode(F.array_distinct(_url_tokens(F.col("__target")))).alias("token")).where(F.col("token").isin(list(tokens)))
    return {r["token"]: r["count"] for r in seen.groupBy("token").count().collect()}


def index_rules(urls: DataFrame, rules: Sequence[Rule]) -> dict[str, list[Rule]]:
    """Each rule stands under that of its tokens which the fewest URLs hold."""
    counts = token_counts(urls, sorted({t for r in rules for t in r.tokens}))
    index: dict[str, list[Rule]] = {}
    for r in rules:
        index.setdefault(min(r.tokens, key=lambda t: (counts.get(t, 0), t), default=""), []).append(r)
    return index


def _order(rule: Column) -> Column:
    """The winner among the rules that fit is the largest: base rules first, then the longest, then by name."""
    return F.struct(rule["tier"].alias("tier"), F.length(rule["name"]).alias("size"), rule["name"].alias("name"), rule["action"].alias("action"))


def filter_urls(pages: DataFrame, rules: Sequence[Rule], url: str = "url", default: str = "allow", inline_rules: int = INLINE_RULES) -> DataFrame:
    """Adds host, path, rule (a base rule's name, else null) and verdict to pages, one row for each of its rows."""
    if len({r.name for r in rules}) < len(rules):
        raise ValueError("rules need distinct names")
    host, path = split_url(F.col(url))
    kept = [c for c in pages.columns if c not in OUTPUT]
    parsed = pages.select(*kept, host.alias("host"), path.alias("path")).withColumn("__target", F.concat("host", "path"))
    index = index_rules(parsed, rules)
    judged = _inline(parsed, index) if len(rules) <= inline_rules else _joined(parsed, index)
    return judged.select(*kept, "host", "path", F.when(F.col("__best.tier") > 0, F.col("__best.name")).alias("rule"), F.coalesce("__best.action", F.lit(default)).alias("verdict"))


def _inline(parsed: DataFrame, index: dict[str, list[Rule]]) -> DataFrame:
    struct = lambda r: F.struct(*(F.lit(getattr(r, k)).alias(k) for k in ("name", "pattern", "action", "tier")))
    if not index:
        return parsed.withColumn("__best", F.lit(None).cast("struct<tier:int,size:int,name:string,action:string>"))
    rules = F.create_map(*(x for t, rs in index.items() for x in (F.lit(t), F.array(*map(struct, rs)))))
    indexed = F.filter(F.array_distinct(_url_tokens(F.col("__target"))), lambda t: t.isin(list(index)))
    fetched = F.flatten(F.transform(indexed, lambda t: F.try_element_at(rules, t)))
    fits = F.filter(fetched, lambda r: F.regexp_like(F.col("__target"), r["pattern"]))
    return parsed.withColumn("__best", F.array_max(F.transform(fits, _order)))


def _joined(parsed: DataFrame, index: dict[str, list[Rule]]) -> DataFrame:
    spark = parsed.sparkSession
    rows = [(t, r.name, r.pattern, r.action, r.tier) for t, rs in index.items() for r in rs]
    rules = spark.createDataFrame(rows, "token string, name string, pattern string, action string, tier int")
    rules = rules.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    # a verdict depends on the target alone, so each target is judged once, whatever number of rows bear it
    targets = parsed.select("__target").distinct().withColumn("salt", F.pmod(F.xxhash64("__target"), F.lit(SALTS)).cast("int"))
    tokens = targets.withColumn("token", F.explode(F.array_distinct(_url_tokens(F.col("__target")))))
    fits = tokens.join(rules, ["token", "salt"]).where(F.regexp_like("__target", F.col("pattern")))
    rule = {k: F.col(k) for k in ("tier", "name", "action")}
    best = fits.groupBy("__target").agg(F.max(_order(rule)).alias("__best"))
    return parsed.join(best, "__target", "left")


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every row of pages by the base rules and the method's spam rules."""
    return filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"), BASE_RULES + SPAM_RULES).drop("url")


_BLOCKED = " OR ".join(f"regexp_matches(target, '{r.pattern}')" for r in SPAM_RULES)
_FITS = "\n".join(f"  WHEN regexp_matches(target, '{r.pattern}') THEN '{r.name}'" for r in sorted(BASE_RULES, key=lambda r: -len(r.name)))
OP10_SQL = f"""
WITH u AS (SELECT page_id, coalesce(url, '') AS url FROM pages),
r AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM u),
h AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM r),
p AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM h),
t AS (SELECT *, host || path AS target FROM p),
f AS (SELECT *, CASE
{_FITS}
  END AS rule FROM t)
SELECT page_id, host, path, rule, CASE
  WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow'
  WHEN rule IS NOT NULL THEN 'block'
  WHEN {_BLOCKED} THEN 'block' ELSE 'allow' END AS verdict FROM f
"""
