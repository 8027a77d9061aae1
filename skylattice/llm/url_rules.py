"""URL filters: pattern rules indexed by their rarest literal token. DataFrame expressions only.

A pattern is matched against host and path. ``||`` at its start stands for the start of the host or
of one of its parent domains, ``|`` for the start or the end, ``^`` for the border of a token (an
end, or one character that is no letter or digit), ``*`` for any run of characters; all else is
literal. A pattern fits if it occurs anywhere.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rules are parameters, part of the query plan; more than this many are refused.
MAX_RULES = 10_000

_LOWER = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@dataclass(frozen=True)
class Rule:
    """A pattern and what it says of a URL. ``rank`` orders rules that fit the same URL (the highest wins, then the name)."""

    name: str
    verdict: str
    pattern: str
    rank: int = 0

    def parts(self) -> list[str]:
        """The pattern as literals and marks."""
        return re.findall(r"\A\|\||\A\||\|\Z|[*^]|(?:(?!\|\Z)[^*^])+", self.pattern)

    def regex(self) -> str:
        """The regular expression that the pattern stands for."""
        out = []
        for i, x in enumerate(self.parts()):
            if x == "||":
                out.append(r"\A(?:[^/]*\.)?")
            elif x == "|":
                out.append(r"\A" if i == 0 else r"\z")
            elif x == "^":
                out.append(r"(?:\A|\z|[^0-9A-Za-z])")
            else:
                out.append(r"(?s:.*)" if x == "*" else re.escape(x))
        return "".join(out)

    def tokens(self) -> list[str]:
        """Runs of letters and digits of the pattern that every fitting URL has as whole tokens: those that something ends on both sides."""
        found, parts = [], self.parts()
        for i, x in enumerate(parts):
            if x in ("||", "|", "^", "*"):
                continue
            for m in re.finditer(r"[0-9A-Za-z]+", x):
                before = m.start() > 0 or (i > 0 and parts[i - 1] != "*")
                after = m.end() < len(x) or (i + 1 < len(parts) and parts[i + 1] != "*")
                if before and after:
                    found.append(m[0])
        return found


def host_rule(verdict: str, rule: str) -> Rule:
    """A rule ``host/path``: the host and its subdomains, paths that start with the path. Longer rules win, and all win over others."""
    host, slash, path = rule.partition("/")
    return Rule(rule, verdict, f"||{host.lower()}{slash}{path}" + ("" if slash else "^"), 1_000_000 + len(rule))


def rules_of(table: DataFrame) -> tuple[Rule, ...]:
    """Rules from a table (name, verdict, pattern, rank); rows with a null are left out, a null rank is 0. At most MAX_RULES."""
    rows = table.where("name IS NOT NULL AND verdict IS NOT NULL AND pattern IS NOT NULL").orderBy("name", "pattern").limit(MAX_RULES + 1).collect()
    return tuple(Rule(r["name"], r["verdict"], r["pattern"], r["rank"] or 0) for r in rows)


#: Host and path rules that the query is asked for.
HOST_RULES = (
    host_rule("allow", "com/"),
    host_rule("block", "example.com/en/"),
    host_rule("allow", "www.example.com/en/"),
    host_rule("block", "net/es/"),
    host_rule("block", "net/fr/"),
)

#: What hosts and paths of unwanted pages are called; they decide where no host rule fits.
WORD_RULES = tuple(
    Rule(f"word:{word}", "block", f"^{word}^")
    for word in ("casino", "free-bets", "bets", "betting", "poker", "porn", "xxx", "adult", "viagra", "payday", "warez", "torrent", "doubleclick")
)


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; else empty."""
    rest = F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, *_LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _tokens(where: Column) -> Column:
    return F.array_distinct(F.filter(F.split(where, "[^0-9A-Za-z]+"), lambda t: t != ""))


def judge(pages: DataFrame, rules: Iterable[Rule], url: str = "url", named: Iterable[Rule] | None = None, default: str = "allow") -> DataFrame:
    """Add host, path, rule and verdict to ``pages``, replacing columns of these names; all others stay.

    Rules are indexed by the literal token that the fewest URLs of ``pages`` have (counted over
    all rows; ties: the first by name). A URL's tokens fetch rules from that index, a map in the
    plan, and only those rules' regular expressions run, whatever the URL's length. ``rule`` is the
    winner's name if it is among ``named`` (all rules, unless given), else null; ``verdict`` the
    winner's, or ``default`` where none fits. Of rules that fit, the highest rank wins, then the
    greatest name, then the greatest pattern. Null and broken URLs have an empty host and path and
    fit no rule. Each row counts by itself, repeated rows too. No shuffle but for the token counts,
    whose keys are the rules' tokens.
    """
    rules = tuple(rules)
    if len(rules) > MAX_RULES:
        raise ValueError(f"over {MAX_RULES} rules")
    tokens = {r: r.tokens() for r in rules}
    if bad := [r.name for r in rules if not tokens[r]]:
        raise ValueError(f"rules without a whole literal token: {bad}")
    named = frozenset(rules if named is None else named)
    wanted = sorted({t for some in tokens.values() for t in some})
    target = lambda: F.concat(host_of(F.col(url)), path_of(F.col(url)))
    counts = dict(
        pages.select(F.explode(F.filter(_tokens(target()), lambda t: t.isin(wanted))).alias("token")).groupBy("token").count().collect()
    )
    index: dict[str, list[Rule]] = {}
    for r in tokens:
        index.setdefault(min(tokens[r], key=lambda t: (counts.get(t, 0), t)), []).append(r)
    entry = lambda r: F.struct(
        F.lit(r.rank).alias("rank"), F.lit(r.name).alias("name"), F.lit(r.regex()).alias("regex"),
        F.lit(r.verdict).alias("verdict"), F.lit(r in named).alias("named"),
    )
    lists = F.create_map(*[x for t, some in sorted(index.items()) for x in (F.lit(t), F.array(*[entry(r) for r in some]))]) if index else None
    best = next(x for i in range(len(pages.columns) + 1) if (x := f"best{i}").lower() not in {c.lower() for c in pages.columns})
    judged = pages.withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url))})
    if lists is None:
        return judged.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default)})
    mine = F.filter(_tokens(F.concat("host", "path")), lambda t: t.isin(sorted(index)))
    fits = F.filter(F.flatten(F.transform(mine, lambda t: F.element_at(lists, t))), lambda r: F.regexp_like(F.concat("host", "path"), r["regex"]))
    judged = judged.withColumn(best, F.array_max(fits))
    return judged.withColumns(
        {
            "rule": F.when(F.col(f"{best}.named"), F.col(f"{best}.name")),
            "verdict": F.coalesce(F.col(f"{best}.verdict"), F.lit(default)),
        }
    ).drop(best)


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judge(pages, HOST_RULES + WORD_RULES, named=HOST_RULES).select("page_id", "host", "path", "rule", "verdict")


OP3_SQL = r"""
WITH p AS (
  SELECT page_id,
    CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest
  FROM pages
), q AS (
  SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS raw_host, rest FROM p
), u AS (
  SELECT page_id,
    translate(raw_host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(substr(rest, length(raw_host) + 1), '^[^?#]*') AS path
  FROM q
), r(rule, rhost, rpath, verdict) AS (
  VALUES ('com/', 'com', '/', 'allow'), ('example.com/en/', 'example.com', '/en/', 'block'),
         ('www.example.com/en/', 'www.example.com', '/en/', 'allow'),
         ('net/es/', 'net', '/es/', 'block'), ('net/fr/', 'net', '/fr/', 'block')
), m AS (
  SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict
  FROM u JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
  GROUP BY page_id
)
SELECT u.page_id, host, path, m.rule, coalesce(m.verdict,
  CASE WHEN regexp_matches(host || path,
    '(^|[^0-9A-Za-z])(casino|free-bets|bets|betting|poker|porn|xxx|adult|viagra|payday|warez|torrent|doubleclick)([^0-9A-Za-z]|$)')
  THEN 'block' ELSE 'allow' END) AS verdict
FROM u LEFT JOIN m USING (page_id)
"""
