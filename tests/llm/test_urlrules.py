"""URL verdicts against all rules tried one by one."""

from __future__ import annotations

import re

from vertexloom.llm import urlrules

URLS = [
    "http://a.example.com/en/1?x", "https://WWW.Example.com/en/2#t", "http://b.www.example.com/en/", "http://example.com", "http://example.com?q=/en/",
    "http://example.net/es/1", "http://net/fr/", "http://internet/fr/x", "http://x.net/en/1", "http://net:80/fr/", "ftp://x.org/en/setup.exe", "x.com/en/",
    "://com/", "http://a://b.com/", "https://spam-farm.example.org/en/728", "http://spamming-site.org/", "http://Casino.org", "http://ex.org/?redirect=http://x",
    "http://ex.org/casino/page", "http://online-casino.org/", "http://host.org/pornography", "", None, "http://", "http://com/" + "a" * 50000, "http://é.com/ñ", "a\n://COM/x",
    "http://a b.com/x", "http://a b.com.org/x", "http://x.org/éspam-1.", "http://x.org/aspam-1.", "http://x.org/spam_1", "http://x.org/SPAMMER.", "http://x.org/my_casino", "http://\u212aspam-a.org",
    "http://x.org/a.exe", "http://x.org/a.exe#b", "http://x.org/a.exes", "http://x.org/?a=1&redirect=https://y", "http://x.org/?redirect=httpx:", "http://x.org/xporn", "http://x.org/p?q=Porn1",
]


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest).group()
    path = re.match(r"[^?#]*", rest[len(host) :]).group()
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def reference(url):
    host, path = split(url)
    fits = [(h + p, v) for h, p, v in urlrules.HOST_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    if fits:
        return max(fits, key=lambda x: len(x[0]))
    return None, next((v for p, v in urlrules.PATTERN_RULES if re.search(p, url or "", re.I | re.A)), "allow")


def test_verdicts(spark):
    df = spark.createDataFrame([(i, u, "h") for i, u in enumerate(URLS)], "page_id long, url string, host string")
    got = {r.page_id: r for r in urlrules.url_verdicts(df).collect()}
    for i, u in enumerate(URLS):
        assert (got[i].host, got[i].path) == split(u), u
        assert (got[i].rule, got[i].verdict) == reference(u), u
    assert urlrules.url_verdicts(df.limit(0)).collect() == []
    assert {r.verdict for r in urlrules.url_verdicts(df, hosts=(), patterns=()).collect()} == {"allow"}


def test_only_fetched_rules_run():
    rules = urlrules.host_rules() + urlrules.pattern_rules()
    index = urlrules.RuleIndex(rules, {"com": 100, "example": 90, "en": 80, "www": 5, "http": 200, "https": 200})
    assert index.always == [] and all(r.tokens or r.prefixes for r in rules)
    names = [index.compiled[i][0].name for i in index.candidates("www.other.org /en/1")]
    assert "www.example.com/en/" in names and "com/" not in names
    assert index.candidates("http://quiet.org/page?x=1") == []
    literals = {r.pattern.removeprefix("(?ia)"): (r.tokens, r.prefixes) for r in urlrules.pattern_rules()}
    assert literals[r"\bspam-?\w*[.-]"] == ((), ("spam",)) and literals[r"\bspam-farm\b"] == (("spam", "farm"), ())
    assert literals[r"[?&]redirect=http:"] == (("redirect", "http"), ()) and literals[r"\.exe$"] == (("exe",), ())


def test_literals_are_never_optional():
    for pattern in ("casino", "a|b", "(?:x)?y", "x?y", r"\w+bad", "[ab]cd", r"\bab{2}\b", ".bad."):
        assert urlrules._literals(pattern)[0] == ()  # noqa: SLF001
    assert urlrules._literals(r"\bab?\b") == ((), ("a",))  # noqa: SLF001
    assert urlrules._literals(r"/x[.]y/") == (("x", "y"), ())  # noqa: SLF001
