"""URL filter: pattern rules indexed by their rarest literal token.

A rule ``host/path`` becomes a regular expression over the normalised url (host, then path); a
*pattern* rule is a regular expression with literals.  The tokens of a rule are runs of a-z and
0-9 that must stand in every url it fits, bounded on both sides.  One pass counts in how many
different urls each of these tokens stands, and the rule is filed under the rarest.  The tokens
of a url then fetch candidate rules by a join, and only those run their regular expression.  A rule
without such a token is filed under ``*``, which every url has.

Everything is DataFrame operations.  Urls are judged once each, and the verdicts join back.

Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, with A-Z lower-cased; path:
then up to ``?``, ``#`` or the end.  A rule of the form ``host/path`` fits its host and all
subdomains if the path starts with the rule's; the longest wins, a tie goes to the first in
order.  Without such a rule the pattern rules decide: block if any of them fits, else allow.

* null url, or one without ``://``: host and path are empty; no rule fits, allow
* empty table: empty result; repeated rows and equal ``page_id``s come out as often as they came
* other columns are ignored; rules may hold any character, a rule must not be null
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK, ALLOW = "block", "allow"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Up to this size in bytes the filed rules are broadcast; beyond it the join shuffles both sides.
BROADCAST_BYTES = 16 << 20


@dataclass(frozen=True)
class Rule:
    """``name`` is a ``host/path``, or a pattern's name if ``pattern`` is given; ``literals`` are tokens that every fitting url holds."""

    verdict: str
    name: str
    pattern: str | None = None
    literals: tuple[str, ...] = ()

    def regex(self) -> str:
        if self.pattern is not None:
            return self.pattern
        host, slash, path = self.name.partition("/")
        return rf"^(?:[^/]*\.)?{_quoted(host.translate(str.maketrans(UPPER, LOWER)))}{_quoted(slash + path) if slash else '(?:/|$)'}"

    def tokens(self) -> tuple[str, ...]:
        if self.pattern is not None:
            return tuple(t.lower() for t in self.literals)
        # the last run of a path may go on in the url, so it counts only if something bounds it
        return tuple(re.findall(r"[a-z0-9]+(?=[^a-z0-9])", self.name.translate(str.maketrans(UPPER, LOWER)) + ("" if "/" in self.name else "/")))


def _quoted(text: str) -> str:
    return re.sub(r"([^A-Za-z0-9/])", r"\\\1", text)


SITE_RULES = (
    Rule(BLOCK, "net/"),
    Rule(ALLOW, "example.net/en/"),
    Rule(BLOCK, "example.com/de/"),
    Rule(ALLOW, "org/fr/"),
)

#: What decides where no site rule fits: words that stand alone in the names of hosts nobody wants to learn from.
UNWANTED = ("ads", "adserver", "adult", "bets", "betting", "casino", "doubleclick", "pills", "poker", "porn", "spam", "viagra", "xxx")
PATTERN_RULES = tuple(Rule(BLOCK, word, rf"^(?:[^/]*[^a-z0-9/])?{word}(?:[^a-z0-9]|$)", (word,)) for word in UNWANTED)


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.regexp_replace(rest, r"^[^/?#]*", ""), r"^[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), path


def url_tokens(host: Column, path: Column) -> Column:
    words = F.split(F.translate(F.concat(host, F.lit("/"), path), UPPER, LOWER), "[^a-z0-9]+")
    return F.array_distinct(F.concat(F.filter(words, lambda w: w != ""), F.array(F.lit("*"))))


def rule_table(spark: SparkSession, rules: Sequence[Rule]) -> DataFrame:
    rows = [(i, r.verdict, r.name, r.pattern is None, r.regex(), len(r.name), list(dict.fromkeys(r.tokens())) or ["*"]) for i, r in enumerate(rules)]
    return spark.createDataFrame(rows, "rule_id int, verdict string, rule string, site boolean, regex string, length int, tokens array<string>")


def filed(rules: DataFrame, tokens: DataFrame) -> DataFrame:
    """Each rule under that of its tokens that stands in the fewest urls: ``token, rule_id, verdict, rule, site, regex, length``."""
    wanted = rules.select("rule_id", F.explode("tokens").alias("token"))
    counts = tokens.join(wanted.select("token").distinct(), "token", "left_semi").groupBy("token").agg(F.count("*").alias("n"))
    rarest = (
        wanted.join(counts, "token", "left")
        .groupBy("rule_id")
        .agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token")).alias("best"))
        .select("rule_id", "best.token")
    )
    return rules.join(rarest, "rule_id").select("token", "rule_id", "verdict", "rule", "site", "regex", "length")


def judge(pages: DataFrame, rules: Sequence[Rule] = SITE_RULES + PATTERN_RULES) -> DataFrame:
    """``page_id, host, path, rule, verdict`` for every row of ``pages (page_id, url)``."""
    spark = pages.sparkSession
    host, path = host_and_path(F.col("url"))
    urls = pages.select("url").where("url is not null").distinct().select("url", host.alias("host"), path.alias("path"))
    tokens = urls.where("host <> '' or path <> ''").select("url", F.concat("host", "path").alias("said"), F.explode(url_tokens(F.col("host"), F.col("path"))).alias("token"))
    known = filed(rule_table(spark, rules), tokens)
    if sum(len(r.regex()) + len(r.name) + 64 for r in rules) <= BROADCAST_BYTES:
        known = F.broadcast(known)
    best = F.max(F.when(F.col("site"), F.struct("length", (-F.col("rule_id")).alias("order"), "rule", "verdict")))
    verdicts = (
        tokens.join(known, "token")
        .where(F.expr("said rlike regex"))
        .groupBy("url")
        .agg(best.alias("site_rule"), F.max(~F.col("site") & (F.col("verdict") == BLOCK)).alias("bad"))
    )
    out = pages.select("page_id", "url").join(verdicts, "url", "left")
    host, path = host_and_path(F.col("url"))
    return out.select(
        "page_id",
        F.coalesce(host, F.lit("")).alias("host"),
        F.coalesce(path, F.lit("")).alias("path"),
        F.col("site_rule.rule").alias("rule"),
        F.coalesce("site_rule.verdict", F.when(F.col("bad"), F.lit(BLOCK)).otherwise(F.lit(ALLOW))).alias("verdict"),
    )
