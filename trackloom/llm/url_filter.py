"""URL filter: host and path rules first, then a weighted vocabulary.

An Aho-Corasick automaton finds the terms in the lower-cased url in one pass; a hit counts only between characters other than
letters and digits. The weights of the distinct terms add up: one strict term rejects, or several soft ones. Rules are (action,
host, path): a rule fits its host and all subdomains, if the path starts with the rule's; the longest rule that fits wins over
the vocabulary.

Defined results: a null url has empty host and path, no rule and the verdict allow; a url without :// has empty host and path
and goes to the vocabulary; repeated rows are judged alike; an empty table gives an empty result; columns named like the added
ones are replaced, others pass through.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lower_ascii

RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
STRICT = ("casino", "porn", "porno", "xxx", "sex", "viagra", "cialis", "spam", "phishing", "malware", "warez", "escort", "hentai", "gambling")
SOFT = ("adult", "free", "win", "winner", "cheap", "pills", "bets", "bet", "poker", "slots", "bonus", "dating", "hot", "nude", "loan", "loans", "ads", "track", "click", "deal", "deals", "farm", "download", "torrent", "crack")
SOFT_LIMIT = 2
#: Terms of a vocabulary table at most: some 100 MB of automaton.
MAX_TERMS = 1_000_000


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty for null or without ://."""
    rest = F.regexp_extract(url, r"^[\s\S]*?://([\s\S]*)$", 1)
    host = F.coalesce(lower_ascii(F.regexp_extract(rest, r"^[^/?#]*", 0)), F.lit(""))
    path = F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))
    return host, path


def weights(strict: Sequence[str] = STRICT, soft: Sequence[str] = SOFT, soft_limit: float = SOFT_LIMIT, terms: DataFrame | None = None) -> dict[str, float]:
    """The weight of every term, ``soft_limit`` of a strict one: of the two lists, or of a table (term, weight, strict) in their place.

    A table's terms are lower-cased; of several weights of one term the largest counts. More than MAX_TERMS are an error, as the
    automaton goes to every executor.
    """
    if terms is None:
        return {t: 1.0 for t in soft} | {t: float(soft_limit) for t in strict}
    weight = F.when(F.coalesce("strict", F.lit(False)), F.lit(float(soft_limit))).otherwise(F.coalesce(F.col("weight").cast("double"), F.lit(1.0)))
    rows = terms.select(F.lower("term").alias("t"), weight.alias("w")).where("t is not null and t <> ''").groupBy("t").agg(F.max("w").alias("w")).limit(MAX_TERMS + 1).collect()
    if len(rows) > MAX_TERMS:
        raise ValueError(f"over {MAX_TERMS} terms")
    return {r.t: r.w for r in rows}


def vocabulary_verdict(url: Column, terms: dict[str, float], limit: float = SOFT_LIMIT) -> Column:
    """True where the vocabulary rejects the url: the weights of the distinct terms in it reach ``limit``."""
    automaton = ahocorasick.Automaton()
    for t, weight in terms.items():
        automaton.add_word(t, (t, weight))
    if terms:
        automaton.make_automaton()
    # built once and sent to each executor once
    built = SparkSession.active().sparkContext.broadcast(automaton)

    @F.pandas_udf("boolean")
    def rejected(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        found_in = built.value.iter if terms else lambda u: ()

        def one(u: str | None) -> bool:
            u = (u or "").lower()
            found = {}
            for end, (t, weight) in found_in(u):
                lo = end - len(t)
                if (lo < 0 or not u[lo].isalnum()) and (end + 1 == len(u) or not u[end + 1].isalnum()):
                    found[t] = weight
            return sum(found.values()) >= limit

        for s in batches:
            yield pd.Series([one(u) for u in s], dtype=bool)

    return rejected(url)


def filter_urls(pages: DataFrame, url: str = "url", rules: Sequence[tuple[str, str, str]] = RULES, strict: Sequence[str] = STRICT, soft: Sequence[str] = SOFT, soft_limit: float = SOFT_LIMIT, terms: DataFrame | None = None) -> DataFrame:
    """``pages`` with host, path, rule (text of the longest rule that fits, or null) and verdict (allow or block).

    ``terms``: a vocabulary (term, weight, strict) in place of the two short lists.
    """
    kept = [F.col(f"`{c}`") for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    host, path = url_parts(F.col(url))
    out = pages.select(*kept, host.alias("host"), path.alias("path"), vocabulary_verdict(F.col(url), weights(strict, soft, soft_limit, terms), soft_limit).alias("_rejected"))
    rule, action = F.lit(None).cast("string"), F.when(F.col("_rejected"), "block").otherwise("allow")
    for what, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1], r[2])):
        fits = ((F.col("host") == h) | F.col("host").endswith("." + h)) & F.col("path").startswith(p)
        rule, action = F.when(fits, h + p).otherwise(rule), F.when(fits, what).otherwise(action)
    return out.select("*", rule.alias("rule"), action.alias("verdict")).drop("_rejected")
