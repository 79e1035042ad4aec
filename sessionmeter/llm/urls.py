"""URL filter: pattern rules indexed by their rarest literal token.

A rule is a pattern; its literal tokens are the runs of letters and digits every matching URL
must hold. Each rule is filed under the one of its tokens that the fewest URLs hold, counted
over the whole table. A URL's tokens fetch the rules filed under them, and only those run
their regular expression. All of it is one projection over the table (plus the count): no
shuffle of URLs, no Python, and the work per URL grows with the rules its rare tokens fetch.

Null URLs and those without ``://`` have empty host and path; no rule fits them. Repeated rows
give repeated results, an empty table an empty one; other columns pass through untouched.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOKENS = "[a-z0-9]+"
#: Rules are an argument and travel inside the plan; their number is checked against this.
MAX_RULES = 10_000


@dataclass(frozen=True)
class UrlRule:
    """``name`` is host/path. ``host`` fits itself and subdomains, unless ``anywhere`` (part of any label).

    Of several that fit, the longest name wins; rules given by the caller go before patterns.
    """

    name: str
    verdict: str
    host: str
    path: str = ""
    anywhere: bool = False

    @property
    def regex(self) -> str:
        if self.anywhere:
            return rf"^(?:[^/]*[.-])?{re.escape(self.host)}[.-]"
        return rf"^(?:[^/]*\.)?{re.escape(self.host)}{re.escape(self.path)}"

    @property
    def tokens(self) -> list[str]:
        """Tokens that stand whole in every matching URL; the last of a path may go on."""
        path = re.findall(TOKENS, re.sub(f"{TOKENS}$", "", self.path.lower()))
        return list(dict.fromkeys(re.findall(TOKENS, self.host) + path))


def rule(text: str, verdict: str) -> UrlRule:
    """``example.com/en/`` to a rule."""
    host, slash, path = text.partition("/")
    return UrlRule(text, verdict, host.lower(), slash + path)


# Words of host names whose pages are blocked unless a rule says otherwise.
BLOCKED_WORDS = ("spam", "pills", "casino", "viagra", "porn", "xxx", "warez", "malware", "phishing")
PATTERNS = tuple(UrlRule(word, "block", word, anywhere=True) for word in BLOCKED_WORDS)


def host_of(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + F.lit(3)))
    host = F.regexp_extract(rest, r"(?s)^[^/?#]*", 0)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + F.lit(3)))
    return F.coalesce(F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1), F.lit(""))


def token_counts(tokens: DataFrame, wanted: list[str]) -> dict[str, int]:
    """In how many rows of ``tokens`` (column ``tokens``) each wanted token occurs."""
    rows = (tokens.select(F.explode(F.array_intersect("tokens", F.array(*map(F.lit, wanted)))).alias("token"))
            .groupBy("token").count().collect())  # one row per token of the rules at most
    return dict.fromkeys(wanted, 0) | {r["token"]: r["count"] for r in rows}


def judge_urls(pages: DataFrame, rules: list[UrlRule], patterns: tuple[UrlRule, ...] = PATTERNS,
               default: str = "allow") -> DataFrame:
    """Adds host, path, rule (null if only a pattern or nothing fits), verdict, pattern."""
    everything = list(dict.fromkeys([*rules, *patterns]))
    if len(everything) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    df = pages.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    df = df.withColumn("url_tokens", F.array_distinct(F.regexp_extract_all(
        F.concat("host", F.lit("/"), F.lower("path")), F.lit(TOKENS), F.lit(0))))
    if not everything:
        return df.drop("url_tokens").withColumns(
            {"rule": F.lit(None).cast("string"), "verdict": F.lit(default), "pattern": F.lit(None).cast("string")})
    wanted = sorted({t for r in everything for t in r.tokens})
    counts = token_counts(df.select(F.col("url_tokens").alias("tokens")), wanted) if wanted else {}
    given = set(rules)
    filed: dict[str, list[UrlRule]] = {}
    for r in everything:
        filed.setdefault(min(r.tokens, key=lambda t: (counts[t], t), default=""), []).append(r)

    def entry(r: UrlRule) -> Column:
        return F.struct(F.lit(int(r in given)).alias("given"), F.lit(len(r.name)).alias("length"),
                        F.lit(r.name).alias("name"), F.lit(r.verdict).alias("verdict"), F.lit(r.regex).alias("regex"))

    index = F.create_map(*[x for token, rs in sorted(filed.items())
                           for x in (F.lit(token), F.array(*[entry(r) for r in rs]))])
    address = F.concat("host", "path")
    candidates = F.flatten(F.transform(
        F.filter(F.concat("url_tokens", F.array(F.lit(""))), lambda t: F.map_contains_key(index, t)), lambda t: index[t]))
    df = df.withColumn("best", F.array_max(F.filter(
        candidates, lambda c: (F.col("host") != "") & F.regexp_like(address, c["regex"]))))
    is_given = F.col("best.given") == 1
    return df.withColumns({
        "rule": F.when(is_given, F.col("best.name")),
        "verdict": F.coalesce(F.col("best.verdict"), F.lit(default)),
        "pattern": F.when(F.col("best.given") == 0, F.col("best.name")),
    }).drop("best", "url_tokens")
