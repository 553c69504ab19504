"""URL filter: host and path rules first, then a weighted vocabulary of strict and soft terms.

An Aho-Corasick automaton finds every term of the vocabulary in one pass over the lower-cased URL. A hit
counts only between boundaries (no ASCII letter or digit on either side). One strict hit rejects, and so do
two or more distinct soft terms whose weights add up to `soft_limit`. Rules beat the vocabulary: the longest rule whose
host is the URL's host or a parent domain of it, and whose path starts the URL's path, gives the verdict.

The vocabulary is a table of term, kind and weight, given as rows or as a DataFrame. It and the automaton are in every
task, so a vocabulary of over `most_terms` terms is an error.

Defined results: a null URL or one without `://` has an empty host and path; a null URL has no hits and
is allowed. Repeated rows give repeated results. Only the URL column is read, so other columns of any name
pass through. An input column with the name of an output column is replaced. A term given twice has its larger weight,
and is strict if either is; null and empty terms are left out.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: One of these is enough.
STRICT = (
    "anal", "bdsm", "bestiality", "blackjack", "blowjob", "bukkake", "camgirl", "camgirls", "casino", "casinos", "cheap-pills", "cialis", "creampie",
    "crackz", "cumshot", "deepthroat", "dildo", "erotic", "erotica", "escort", "escorts", "fetish", "fuck", "gangbang", "hardcore-sex", "hentai",
    "hookup", "incest", "jackpot", "keygen", "kinky", "levitra", "lolita", "masturbation", "milf", "naked", "nude", "nudes", "nudist", "onlyfans-leaks",
    "orgasm", "orgy", "payday-loan", "payday-loans", "penis", "phentermine", "phishing", "porn", "porno", "pornhub", "porntube", "pussy", "rapidgator",
    "replica-watches", "roulette", "sex", "sexcam", "sexchat", "sexshop", "sextoys", "sexvideo", "sexy", "slots", "slut", "sluts", "spam-farm", "strip-club",
    "stripper", "strippers", "swinger", "swingers", "tits", "torrentz", "tramadol", "upskirt", "viagra", "voyeur", "warez", "webcam-sex", "whore", "xanax",
    "xrated", "xvideos", "xxx", "xxxvideos",
)
#: Several different ones are needed.
SOFT = (
    "adult", "affiliate", "amateur", "babes", "bargain", "bet", "bets", "betting", "bingo", "bonus", "bookmaker", "buy-now", "cams", "cash", "cheap", "cheats",
    "clickbait", "coupon", "coupons", "crack", "credit", "dating", "deals", "diet", "discount", "download-free", "drugs", "earn", "farm", "fastcash", "flirt",
    "forex", "free", "freebies", "gamble", "gambling", "get-rich", "gift", "giveaway", "girls", "guaranteed", "hacked", "hot", "instant", "keno", "lingerie",
    "loan", "loans", "lottery", "lotto", "make-money", "mature", "meds", "miracle", "money", "mortgage", "odds", "offer", "offers", "payday", "pharmacy",
    "pills", "pirate", "poker", "prize", "promo", "proxy", "ringtones", "rx", "sale", "seo", "singles", "slot", "spam", "sportsbook", "spy", "stake", "steroids",
    "streaming-free", "supplement", "supplements", "sweepstakes", "teen", "teens", "torrent", "torrents", "trial", "unlimited", "vegas", "vip", "wager",
    "weed", "weight-loss", "win", "winner", "replica", "traffic",
)
VOCABULARY = tuple((t, "strict", 2) for t in STRICT) + tuple((t, "soft", 1) for t in SOFT)
#: Fixed values: (host, path, verdict).
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)

ADDED = ["host", "path", "rule", "n_strict", "n_soft", "verdict"]
JUDGED = "rule string, n_strict int, n_soft int, verdict string"


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host and path of a URL, empty without `://`."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    return F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


class RuleSet:
    """Rules by host; a look-up walks up the parent domains, so its cost doesn't grow with the rules."""

    def __init__(self, rules: Iterable[tuple[str, str, str]]):
        self.by_host: dict[str, list[tuple[int, bool, str, str, str]]] = {}
        for host, path, verdict in rules:
            self.by_host.setdefault(host, []).append((len(host) + len(path), verdict == "block", path, verdict, host + path))

    def longest(self, host: str, path: str) -> tuple[str | None, str | None]:
        best = None
        while True:
            for rule in self.by_host.get(host, ()):
                if path.startswith(rule[2]) and (best is None or rule[:2] > best[:2]):
                    best = rule
            _, dot, host = host.partition(".")
            if not dot:
                return (best[4], best[3]) if best else (None, None)


class Vocabulary:
    def __init__(self, terms: dict[str, tuple[bool, int]]):
        self.automaton = ahocorasick.Automaton()
        for term, (strict, weight) in terms.items():
            self.automaton.add_word(term, (strict, weight, term))
        if terms:
            self.automaton.make_automaton()

    def hits(self, url: str | None) -> tuple[int, int, int]:
        """Distinct strict and soft terms between boundaries, and the weight of the soft ones."""
        found: set[tuple[bool, int, str]] = set()
        low = _lower(url or "")
        inside = "abcdefghijklmnopqrstuvwxyz0123456789"
        for end, hit in self.automaton.iter(low) if len(self.automaton) else ():
            begin = end + 1 - len(hit[2])
            if (begin == 0 or low[begin - 1] not in inside) and (end + 1 == len(low) or low[end + 1] not in inside):
                found.add(hit)
        n = sum(strict for strict, _, _ in found)
        return n, len(found) - n, sum(weight for strict, weight, _ in found if not strict)


def _lower(text: str) -> str:
    return text.encode("utf-8", "replace").lower().decode("utf-8", "replace")


def term_table(vocabulary: DataFrame | Iterable[tuple[str, str, int]], most_terms: int) -> dict[str, tuple[bool, int]]:
    """Lower-cased terms with whether they are strict, and their weights."""
    rows = vocabulary.select("term", "kind", "weight").limit(most_terms + 1).collect() if isinstance(vocabulary, DataFrame) else vocabulary
    out: dict[str, tuple[bool, int]] = {}
    for term, kind, weight in rows:
        if kind not in ("strict", "soft"):
            raise ValueError("a term is strict or soft")
        if term:
            strict, most = out.get(_lower(term), (False, 0))
            out[_lower(term)] = (strict or kind == "strict", max(most, int(weight)))
    if len(out) > most_terms:
        raise ValueError(f"more than {most_terms} terms")
    return out


def filter_urls(pages: DataFrame, url: str = "url", vocabulary: DataFrame | Iterable[tuple[str, str, int]] = VOCABULARY, rules=RULES, soft_limit: int = 2, most_terms: int = 100_000) -> DataFrame:
    """All rows with `host, path, rule, n_strict, n_soft, verdict` (allow or block) added. `vocabulary` has rows (term, kind, weight)."""
    terms, rules = pages.sparkSession.sparkContext.broadcast(term_table(vocabulary, most_terms)), tuple(rules)

    @F.pandas_udf(JUDGED)
    def judged(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        ruled, words = RuleSet(rules), Vocabulary(terms.value)
        for batch in batches:
            out = []
            for u, host, path in zip(*batch, strict=True):
                rule, verdict = ruled.longest(host, path)
                n_strict, n_soft, weight = words.hits(u)
                out.append((rule, n_strict, n_soft, verdict or ("block" if n_strict or (n_soft >= 2 and weight >= soft_limit) else "allow")))
            yield pd.DataFrame(out, columns=ADDED[2:])

    names = [F.col(f"`{f.name}`") for f in pages.schema if f.name.lower() not in ADDED]
    address = F.col(f"`{url}`").cast("string")
    host, path = host_and_path(address)
    own = "_" + "_".join(pages.columns)  # no column has this name
    inner = pages.select(*names, host.alias("host"), path.alias("path"), judged(address, host, path).alias(own))
    return inner.select(*names, "host", "path", F.col(f"`{own}`.*"))


def query(spark, sf_dir):
    from gridloom.llm.common import table

    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return filter_urls(pages).select("page_id", "host", "path", "rule", "verdict")


def _term_sql(terms) -> str:
    boundary = "(^|[^a-z0-9]){}([^a-z0-9]|$)"
    return " + ".join(f"CAST(regexp_matches(low, '{boundary.format(re.escape(t))}') AS INT)" for t in terms)


ORACLE_SQL = f"""
WITH u AS (
  SELECT page_id, url, strpos(url, '://') AS pos,
         translate(coalesce(url, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low FROM pages
), s AS (
  SELECT page_id, low,
    CASE WHEN pos > 0 THEN regexp_extract(substr(low, pos + 3), '^[^/?#]*') ELSE '' END AS host,
    CASE WHEN pos > 0 THEN regexp_extract(substr(url, pos + 3), '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path FROM u
), r AS (
  SELECT *, {_term_sql(STRICT)} AS n_strict, {_term_sql(SOFT)} AS n_soft,
    CASE WHEN (host = 'www.example.com' OR host LIKE '%.www.example.com') AND starts_with(path, '/en/') THEN 'www.example.com/en/'
         WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/en/') THEN 'example.com/en/'
         WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/es/') THEN 'net/es/'
         WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/fr/') THEN 'net/fr/'
         WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/') THEN 'com/' END AS rule FROM s
)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow'
       WHEN rule IS NOT NULL THEN 'block'
       WHEN n_strict > 0 OR n_soft >= 2 THEN 'block' ELSE 'allow' END AS verdict FROM r
"""
