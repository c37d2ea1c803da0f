"""URL filters: pattern rules indexed by their rarest literal token."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vertexloom.llm.common import arrow_batches, shield

TOKEN = re.compile(r"[A-Za-z0-9]+")
#: Host rules (host, path, verdict); the longest that fits decides.
HOST_RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
#: Pattern rules (pattern, verdict) for urls that no host rule fits; the first that matches decides, else the url is allowed.
#: Each has a literal that a match must hold as a whole token or as the beginning of one, so alternatives are rules of their own.
PATTERN_RULES = (
    (r"\bspam-?\w*[.-]", "block"),
    (r"\bspam-farm\b", "block"),
    (r"\bonline-casino\b", "block"),
    (r"\bcasino\b", "block"),
    (r"\bporn\w*", "block"),
    (r"[?&]redirect=http:", "block"),
    (r"[?&]redirect=https:", "block"),
    (r"\.exe[?#]", "block"),
    (r"\.exe$", "block"),
)


@dataclass(frozen=True)
class Rule:
    """A rule: a pattern to search for, its verdict, and the literals of which a match must hold each.

    A match has each of ``tokens`` as a whole token, and a token that begins with each of
    ``prefixes``.
    """

    name: str | None
    pattern: str
    verdict: str
    tokens: tuple[str, ...]
    prefixes: tuple[str, ...]
    order: tuple[int, int]


def host_rules(rules: tuple[tuple[str, str, str], ...] = HOST_RULES) -> list[Rule]:
    """Host rules as patterns over ``host`` and ``path``, which begins with a slash if there is one; longer ones come first."""
    out = []
    for host, path, verdict in rules:
        # The path is a prefix: its last token may go on in the url unless something ends it.
        closed = path if not path[-1:].isalnum() else path[: -len(TOKEN.findall(path)[-1])]
        tokens = tuple(TOKEN.findall(host.lower())) + tuple(t.lower() for t in TOKEN.findall(closed))
        out.append(Rule(host + path, rf"^(?:[^/]*\.)?{re.escape(host)}{re.escape(path)}", verdict, tokens, (), (0, -len(host + path))))
    return sorted(out, key=lambda r: r.order)


def _literals(pattern: str) -> tuple[tuple[str, ...], tuple[str, ...]]:
    """Literal tokens of a pattern between characters that end a token, and literals that begin one which may go on."""
    edge, open_ = "\x00", "\x01"  # what ends a token for sure, and what may be anything
    plain = re.sub(r"\\b", edge, pattern)
    plain = re.sub(r"\((?:[^()\\]|\\.)*\)[?*+]?|\\[wdsWDS][?*+]*", open_, plain)
    plain = re.sub(r"\[([^\]\\A-Za-z0-9^-][^\]\\A-Za-z0-9-]*)\](?![?*])", edge, plain)
    plain = re.sub(r"\[(?:[^\]\\]|\\.)*\][?*+]?", open_, plain)
    plain = re.sub(r"(?<!\\)\.", open_, plain)
    plain = re.sub(r"\\(.)", r"\1", plain)
    if "|" in plain or "(" in plain or "{" in plain:
        return (), ()
    plain = re.sub(r"[A-Za-z0-9]\+", open_, re.sub(r".[?*]", open_, plain))
    found = [(m.group().lower(), m.end() < len(plain) and plain[m.end()] != open_) for m in re.finditer(r"(?<=[^A-Za-z0-9\x01])[A-Za-z0-9]+", plain)]
    return tuple(t for t, whole in found if whole), tuple(t for t, whole in found if not whole)


def pattern_rules(rules: tuple[tuple[str, str], ...] = PATTERN_RULES) -> list[Rule]:
    """Pattern rules, in order; they ignore the case of A-Z, their classes are ASCII, and they come after all host rules."""
    return [Rule(None, f"(?ia){p}", verdict, *_literals(p), (1, k)) for k, (p, verdict) in enumerate(rules)]


class RuleIndex:
    """Rules under their rarest token, or under the beginning of one; ``always``: rules that have neither."""

    def __init__(self, rules: list[Rule], counts: dict[str, int]):
        self.compiled = [(r, re.compile(r.pattern)) for r in sorted(rules, key=lambda r: r.order)]
        self.by_token: dict[str, list[int]] = {}
        self.by_prefix: dict[str, list[int]] = {}
        self.always: list[int] = []
        for i, (r, _) in enumerate(self.compiled):
            if r.tokens:
                self.by_token.setdefault(min(r.tokens, key=lambda t: (counts.get(t, 0), t)), []).append(i)
            elif r.prefixes:
                self.by_prefix.setdefault(max(r.prefixes, key=lambda t: (len(t), t)), []).append(i)
            else:
                self.always.append(i)
        self.lengths = sorted({len(p) for p in self.by_prefix})

    def candidates(self, text: str) -> list[int]:
        """Numbers of the rules whose token is in ``text``, in order."""
        found = set(self.always)
        for token in {t.lower() for t in TOKEN.findall(text)}:
            found.update(self.by_token.get(token, ()))
            for n in self.lengths:
                found.update(self.by_prefix.get(token[:n], ()))
        return sorted(found)

    def decide(self, host: str, path: str, url: str) -> tuple[str | None, str]:
        """Name (for host rules) and verdict of the first candidate that matches."""
        for i in self.candidates(f"{host}{path} {url}"):
            rule, pattern = self.compiled[i]
            if pattern.search(host + path if rule.order[0] == 0 else url):
                return rule.name, rule.verdict
        return None, "allow"


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"^[\s\S]*?://([^/?#]*)", 1)
    return F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^[\s\S]*?://[^/?#]*([^?#]*)", 1)


def url_verdicts(
    df: DataFrame,
    url_col: str = "url",
    hosts: tuple[tuple[str, str, str], ...] = HOST_RULES,
    patterns: tuple[tuple[str, str], ...] = PATTERN_RULES,
) -> DataFrame:
    """Judge every url.

    How often the rules' tokens occur is counted over all urls, as a table of at most one row
    for each such token; each rule is then indexed by its rarest, or by a literal that begins
    a token if it has no whole one. A url's tokens fetch the rules to try, and only those run their regular expressions: host rules first, the longest
    one that fits, then pattern rules, and ``allow`` if none matches.

    Returns the columns of ``df`` (those that clash with the new names give way) and ``host,
    path``, ``rule`` (host and path of the host rule; else null), ``verdict``. Defined cases:
    a null url, or one without ``://``, has an empty host and path and is judged by the
    patterns only; without rules all are allowed; repeated rows are judged each; empty input
    gives no rows.
    """
    spark = df.sparkSession
    arrow_batches(spark)
    inner, col, restored = shield(df)
    rules = host_rules(hosts) + pattern_rules(patterns)
    wanted = sorted({t for r in rules for t in r.tokens})
    url = F.coalesce(col(url_col), F.lit(""))
    tokens = F.array_distinct(F.regexp_extract_all(F.lower(url), F.lit("([a-z0-9]+)")))
    counted = (
        inner.select(F.explode(F.filter(tokens, lambda t: t.isin(wanted))).alias("token")).groupBy("token").count().collect() if wanted else []
    )
    sent = spark.sparkContext.broadcast((rules, {r.token: r["count"] for r in counted}))

    @F.pandas_udf("struct<rule:string,verdict:string>")
    def judge(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        index = RuleIndex(*sent.value)
        for many in parts:
            found = [index.decide(h, p, u) for h, p, u in zip(*many, strict=True)]
            yield pd.DataFrame(found, columns=["rule", "verdict"])

    new = ["host", "path", "rule", "verdict"]
    split = inner.withColumn("host", host_of(col(url_col))).withColumn("path", path_of(col(url_col)))
    judged = split.withColumn("judged", judge("host", "path", url))
    return judged.select(*[c for c, n in zip(restored, df.columns, strict=True) if n not in new], "host", "path", "judged.*")
