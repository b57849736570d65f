"""URL filters: rules by host and path, then a weighted vocabulary counted by Aho-Corasick.

One automaton finds all terms in one pass over the lower-cased url. A hit counts only
between borders (no letter or digit next to it). One strict term rejects; soft terms
reject when several different ones occur.
"""

from __future__ import annotations

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoutlake.llm.words import arrow_map

# Rules of the contract as (verdict, host, path).
RULES = (
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
)
# Vocabulary: a strict term rejects alone, soft terms from SOFT_LIMIT different ones on.
STRICT = ("casino", "pills", "porn", "xxx", "viagra", "malware", "phishing", "warez")
SOFT = ("free", "bets", "bet", "win", "cheap", "ads", "ad", "track", "bonus", "poker", "jackpot", "click", "deal", "loan")
SOFT_LIMIT = 2


def host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    rest = _rest(url)
    return F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path(url: Column) -> Column:
    return F.regexp_extract(_rest(url), r"(?s)^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))


def rule(host_column: str, path_column: str) -> Column:
    """The longest rule that fits, as a struct (verdict, rule), or null."""
    out = F.lit(None)
    for verdict, name, start in sorted(RULES, key=lambda r: len(r[1] + r[2])):
        fits = ((F.col(host_column) == name) | F.endswith(F.col(host_column), F.lit("." + name))) & F.startswith(
            F.col(path_column), F.lit(start)
        )
        out = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(name + start).alias("rule"))).otherwise(out)
    return out


def automaton(strict: tuple[str, ...], soft: tuple[str, ...]) -> ahocorasick.Automaton:
    made = ahocorasick.Automaton()
    for term in (*strict, *soft):
        made.add_word(term, (term, term in strict))
    made.make_automaton()
    return made


def hits(made: ahocorasick.Automaton, url: str) -> tuple[int, int, int]:
    """(strict hits, soft hits, different soft terms) between borders."""
    strict = soft = 0
    kinds = set()
    for last, (term, hard) in made.iter(url):
        first = last - len(term) + 1
        if (first and url[first - 1].isalnum()) or (last + 1 < len(url) and url[last + 1].isalnum()):
            continue
        if hard:
            strict += 1
        else:
            soft += 1
            kinds.add(term)
    return strict, soft, len(kinds)


def judge(pages: DataFrame, strict: tuple[str, ...] = STRICT, soft: tuple[str, ...] = SOFT, limit: int = SOFT_LIMIT) -> DataFrame:
    """(page_id, host, path, rule, verdict, n_strict, n_soft, n_kinds) per row of ``pages``
    (page_id, url).

    Host and path are empty for a null url or one without ``://``. A rule fits its host and
    all subdomains where the path starts with its path; the longest wins and decides.
    Where none fits, the vocabulary does; a null or empty url has no term and is allowed.
    Repeated rows are judged each, null ids too; other columns are ignored.
    """
    url = F.coalesce(F.col("url"), F.lit(""))
    rows = pages.select("page_id", host(url).alias("host"), path(url).alias("path"), F.lower(url).alias("url"))

    def make(batch):
        made = automaton(strict, soft)
        found = [hits(made, u) for u in batch.column(3).to_pylist()]
        columns = list(zip(*found, strict=True))
        yield pa.record_batch(
            [*(batch.column(k) for k in range(3)), *(pa.array(c, pa.int32()) for c in columns)],
            names=["page_id", "host", "path", "n_strict", "n_soft", "n_kinds"],
        )

    kind = rows.schema["page_id"].dataType.simpleString()
    counted = arrow_map(rows, f"page_id {kind}, host string, path string, n_strict int, n_soft int, n_kinds int", make)
    ruled = counted.withColumn("r", rule("host", "path"))
    own = F.when((F.col("n_strict") > 0) | (F.col("n_kinds") >= limit), "block").otherwise("allow")
    return ruled.select(
        "page_id", "host", "path", F.col("r.rule").alias("rule"), F.coalesce("r.verdict", own).alias("verdict"),
        "n_strict", "n_soft", "n_kinds",
    )


def _count(term: str) -> str:
    return rf"CASE WHEN regexp_matches(u, '(^|[^\p{{L}}\p{{N}}]){term}($|[^\p{{L}}\p{{N}}])') THEN 1 ELSE 0 END"


def _fits(verdict: str, name: str, start: str) -> str:
    return f"(host = '{name}' OR ends_with(host, '.{name}')) AND starts_with(path, '{start}')"


def _cases(kind: int) -> str:
    by_length = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    return " ".join(f"WHEN {_fits(*r)} THEN '{r[0] if kind == 0 else r[1] + r[2]}'" for r in by_length)


SQL = rf"""
WITH u AS (SELECT page_id, lower(coalesce(url, '')) AS u,
    CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, u, lower(regexp_extract(rest, '^([^/?#]*)', 1)) AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
c AS (SELECT *, {" + ".join(map(_count, STRICT))} AS strict_kinds, {" + ".join(map(_count, SOFT))} AS kinds FROM h)
SELECT page_id, host, path, CASE {_cases(1)} END AS rule,
    CASE {_cases(0)} WHEN strict_kinds > 0 OR kinds >= {SOFT_LIMIT} THEN 'block' ELSE 'allow' END AS verdict FROM c
"""
