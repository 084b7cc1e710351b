"""URL filter: host and path rules, and a weighted vocabulary of terms found by an Aho-Corasick automaton.

A rule names a host, with all its subdomains, and the beginning of a path; of the rules that fit the longest decides.
Other URLs are judged by their terms: each URL is scanned once for all terms, a hit counts only where no letter or digit
stands beside it (of ASCII), and every distinct term counts once. One strict term rejects; soft terms reject together, when
their weights reach the limit: two distinct ones of the default weight.

The scan needs no shuffle: the automaton is a small fixed table that is built once in each task.

Defined cases: a null url, or one without ``://``, has an empty host and path, fits no rule and is still scanned (null:
no terms), so it is allowed unless terms reject it; case is folded for A-Z, in hosts and for terms, not in paths for
rules; a url of any length is scanned whole; repeated rows are judged one by one; an empty table gives an empty result;
columns of the input that are asked for with ``keep`` are kept.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_arrow

#: Terms that reject alone: adult sites, gambling, drugs by mail, link farms.
STRICT = (
    "adult", "betting", "blackjack", "camgirl", "camgirls", "casino", "casinos", "erotic", "erotica", "escort", "escorts",
    "gambling", "hentai", "jackpot", "nude", "nudes", "phishing", "poker", "porn", "porno", "pornography", "roulette",
    "sex", "sexcam", "sexy", "spam", "viagra", "webcamsex", "xnxx", "xvideos", "xxx",
)
#: Terms that reject in twos.
SOFT = (
    "ad", "ads", "babe", "babes", "banner", "bet", "bets", "bonus", "cheap", "click", "coupon", "coupons", "crack", "cracked",
    "dating", "deal", "deals", "discount", "download", "drugs", "farm", "free", "girls", "hack", "hot", "keygen", "loan",
    "loans", "lottery", "money", "naked", "payday", "pharmacy", "pill", "pills", "popup", "prize", "promo", "slot", "slots",
    "teen", "teens", "torrent", "track", "tracker", "tracking", "warez", "win", "winner",
)
#: Weight at which a URL is rejected, and the weight of a soft term.
LIMIT, HALF = 2, 1
VOCABULARY = dict.fromkeys(STRICT, LIMIT) | dict.fromkeys(SOFT, HALF)

Rule = tuple[str, str, str]
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_FOLDED = str.maketrans(_UPPER, _UPPER.lower())


def parts(url: Column) -> tuple[Column, Column]:
    """(host, path) of a url; empty where it is null or has no ://."""
    rest = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1), F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), _UPPER, _UPPER.lower())
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def decide(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest of rules (verdict, host, path) that fits; nulls where none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, of, under in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == of) | host.endswith(f".{of}")) & path.startswith(under)
        name, verdict = F.when(fits, of + under).otherwise(name), F.when(fits, what).otherwise(verdict)
    return name, verdict


class Terms:
    """Automaton over weighted terms."""

    def __init__(self, vocabulary: Mapping[str, int]) -> None:
        self.vocabulary = dict(vocabulary)
        self.automaton = ahocorasick.Automaton()
        for term in vocabulary:
            self.automaton.add_word(term, term)
        if vocabulary:
            self.automaton.make_automaton()

    def found(self, url: str) -> set[str]:
        """Distinct terms of url that stand alone."""
        if not self.vocabulary:
            return set()
        text = url.translate(_FOLDED)
        hits = set()
        for end, term in self.automaton.iter(text):
            start = end + 1 - len(term)
            beside = text[max(start - 1, 0) : start] + text[end + 1 : end + 2]
            if not any(c.isascii() and c.isalnum() for c in beside):
                hits.add(term)
        return hits


def judge(
    pages: DataFrame, rules: Sequence[Rule] = (), vocabulary: Mapping[str, int] = VOCABULARY, limit: int = LIMIT,
    url_col: str = "url", keep: Sequence[str] = ("page_id",),
) -> DataFrame:
    """keep columns, host, path, rule, verdict, and the terms that were found: strict_hits, soft_hits, weight."""
    kinds = [pages.schema[c] for c in keep]
    schema = T.StructType([*kinds, *T.StructType.fromDDL("_url string, strict_hits long, soft_hits long, weight long")])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = Terms(vocabulary)
        for batch in batches:
            strict, soft, weight = [], [], []
            for url in batch.column(len(keep)).to_pylist():
                hits = [terms.vocabulary[t] for t in terms.found(url or "")]
                strict.append(sum(w >= limit for w in hits))
                soft.append(sum(w < limit for w in hits))
                weight.append(sum(hits))
            added = [pa.array(x, pa.int64()) for x in (strict, soft, weight)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], names=schema.names)

    rows = map_arrow(pages.select(*keep, F.col(url_col).alias("_url")), scan, schema)
    host, path = parts(F.col("_url"))
    rows = rows.select(*keep, host.alias("host"), path.alias("path"), "strict_hits", "soft_hits", "weight")
    rule, verdict = decide(F.col("host"), F.col("path"), rules)
    verdict = F.coalesce(verdict, F.when(F.col("weight") >= limit, "block").otherwise("allow"))
    return rows.select(*keep, "host", "path", rule.alias("rule"), verdict.alias("verdict"), "strict_hits", "soft_hits", "weight")
