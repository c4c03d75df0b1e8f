"""URL filter: weighted vocabulary matched by an Aho-Corasick automaton.

A url is lower-cased and every vocabulary term is looked for in one automaton
pass. A hit counts only between boundaries: the characters next to it must not
be ASCII letters or digits. One *strict* term, or ``soft_limit`` distinct *soft*
terms, reject the url. Allow and block rules on (host, path prefix) overrule the
vocabulary; the longest fitting rule wins.

Defined results: a null url, or one without ``://``, has an empty host and path,
fits no rule and is judged by its words alone (null: allow). Repeated rows are
judged one by one; an empty table gives an empty result. Input columns other
than the id and the url are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Built-in vocabulary; load_vocabulary reads a larger one.
STRICT_TERMS = ("adult", "casino", "escort", "hentai", "malware", "phishing", "porn", "porno", "sex", "warez", "xxx")
SOFT_TERMS = (
    "ads", "bet", "bets", "betting", "bonus", "buy", "cheap", "click", "coupon", "deal", "deals", "download", "farm",
    "free", "gratis", "hack", "jackpot", "loan", "loans", "lottery", "pills", "poker", "popup", "prize", "replica",
    "slots", "spam", "spin", "track", "tracker", "tracking", "viagra", "win", "winner",
)
SOFT_LIMIT = 2


@dataclass(frozen=True)
class Rule:
    """``verdict`` for urls of ``host`` and its subdomains whose path starts with ``path``."""

    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


def parse_rule(text: str, verdict: str) -> Rule:
    """Split ``example.com/en/7`` into its host and its path prefix."""
    host, slash, path = text.partition("/")
    return Rule(host.lower(), slash + path, verdict)


RULES = (
    parse_rule("com/en/", "block"),
    parse_rule("example.com/en/7", "allow"),
    parse_rule("net/de/", "allow"),
    parse_rule("example.net/de/8", "block"),
    parse_rule("org/es/", "block"),
)


def _ascii_lower(column: Column) -> Column:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(column, upper, upper.lower())


def host_of(url: Column) -> Column:
    """Host of a url: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    return _ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    """Path of a url: what follows the host, up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """The longest rule that fits, as struct(name, verdict), or null."""
    out = F.lit(None).cast("struct<name:string,verdict:string>")
    for rule in sorted(rules, key=lambda r: len(r.name)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        out = F.when(fits, F.struct(F.lit(rule.name).alias("name"), F.lit(rule.verdict).alias("verdict"))).otherwise(out)
    return out


def load_vocabulary(spark: SparkSession, path: str) -> tuple[tuple[str, ...], tuple[str, ...]]:
    """(strict terms, soft terms) from a text file of lines ``strict TERM`` or ``soft TERM``.

    Terms are lower-cased (A-Z); a term of both kinds is strict. Empty lines and
    lines that start with ``#`` are skipped, any other line raises ``ValueError``.
    A vocabulary is a list that people keep, so it is read whole on the driver.
    """
    kinds: dict[str, set[str]] = {"strict": set(), "soft": set()}
    for row in spark.read.text(path).collect():
        parts = row.value.split(maxsplit=1)
        if not parts or parts[0].startswith("#"):
            continue
        if len(parts) < 2 or parts[0] not in kinds:
            raise ValueError(f"{path}: no vocabulary line: {row.value!r}")
        kinds[parts[0]].add(re.sub("[A-Z]", lambda m: m[0].lower(), parts[1].strip()))
    return tuple(sorted(kinds["strict"])), tuple(sorted(kinds["soft"] - kinds["strict"]))


def vocabulary_hits(url: Column, strict: Sequence[str], soft: Sequence[str]) -> Column:
    """Count distinct strict and soft terms in each url: struct(strict int, soft int). Without terms there are no hits."""
    terms = [(t, "strict") for t in strict] + [(t, "soft") for t in soft if t not in set(strict)]

    @F.pandas_udf("strict int, soft int")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for term, kind in terms:
            automaton.add_word(term, (term, kind))
        automaton.make_automaton()
        bound = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")

        def hits(url: str | None) -> tuple[int, int]:
            found: set[tuple[str, str]] = set()
            for end, (term, kind) in automaton.iter(url or ""):
                before, after = end - len(term), end + 1
                if (before < 0 or url[before] not in bound) and (after == len(url) or url[after] not in bound):
                    found.add((term, kind))
            n = sum(kind == "strict" for _, kind in found)
            return n, len(found) - n

        for urls in batches:
            if not terms:
                yield pd.DataFrame({"strict": 0, "soft": 0}, index=range(len(urls))).astype("int32")
                continue
            yield pd.DataFrame([hits(u) for u in urls], columns=["strict", "soft"]).astype("int32")

    return count(_ascii_lower(url))


def url_verdicts(
    pages: DataFrame,
    *,
    id_column: str = "page_id",
    url_column: str = "url",
    rules: Sequence[Rule] = RULES,
    strict: Sequence[str] = STRICT_TERMS,
    soft: Sequence[str] = SOFT_TERMS,
    soft_limit: int = SOFT_LIMIT,
) -> DataFrame:
    """Judge every row: (id, host, path, rule, verdict, strict_hits, soft_hits).

    It is one narrow projection of the id and the url; nothing is shuffled.
    """
    url = F.col("url")
    return (
        pages.select(F.col(id_column).alias("page_id"), F.col(url_column).alias("url"))
        .select("page_id", host_of(url).alias("host"), path_of(url).alias("path"), vocabulary_hits(url, strict, soft).alias("hits"))
        .withColumn("fit", rule_of(F.col("host"), F.col("path"), rules))
        .select(
            "page_id", "host", "path", F.col("fit.name").alias("rule"),
            F.coalesce("fit.verdict", F.when((F.col("hits.strict") >= 1) | (F.col("hits.soft") >= soft_limit), "block").otherwise("allow")).alias("verdict"),
            F.col("hits.strict").alias("strict_hits"), F.col("hits.soft").alias("soft_hits"),
        )
    )


def _count_sql(terms: Sequence[str]) -> str:
    return " + ".join(f"cast(regexp_matches(u, '(^|[^a-z0-9]){t}([^a-z0-9]|$)') as int)" for t in terms)


def oracle_sql() -> str:
    """The same judgement in DuckDB SQL, one regular expression for each term."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    fits = [f"when (host = '{r.host}' or ends_with(host, '.{r.host}')) and starts_with(path, '{r.path}') then " for r in sorted(RULES, key=lambda r: -len(r.name))]
    ordered = sorted(RULES, key=lambda r: -len(r.name))
    rule = "case " + " ".join(f + f"'{r.name}'" for f, r in zip(fits, ordered)) + " end"
    by_rule = "case " + " ".join(f + f"'{r.verdict}'" for f, r in zip(fits, ordered)) + " end"
    return f"""
with u as (
  select page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), '{upper}', '{upper.lower()}') as host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') as path,
         translate(coalesce(url, ''), '{upper}', '{upper.lower()}') as u
  from pages),
h as (select page_id, host, path, {_count_sql(STRICT_TERMS)} as strict_hits, {_count_sql(SOFT_TERMS)} as soft_hits from u)
select page_id, host, path, {rule} as rule,
       coalesce({by_rule}, case when strict_hits >= 1 or soft_hits >= {SOFT_LIMIT} then 'block' else 'allow' end) as verdict,
       cast(strict_hits as int) as strict_hits, cast(soft_hits as int) as soft_hits
from h"""
