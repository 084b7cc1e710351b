"""URL filter against plain Python."""

import random
import re

from chromaforge.llm import url_filter as uf
from chromaforge.llm.queries import URL_RULES, op13_url_filter

SCHEMA = "page_id long, url string, html string, host string, weight long"


def lower(text):
    return "".join(c.lower() if c.isascii() else c for c in text)


def plain(url):
    url = url or ""
    rest = url.split("://", 1)[1] if "://" in url else ""
    host = lower(re.match(r"[^/?#]*", rest)[0])
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    fits = [(of + under, what) for what, of, under in URL_RULES if ("." + host).endswith("." + of) and path.startswith(under)]
    rule, verdict = max(fits, key=lambda x: len(x[0])) if fits else (None, None)
    tokens = set(re.split("[^a-z0-9]", lower(url)))
    strict, soft = len(tokens & set(uf.STRICT)), len(tokens & set(uf.SOFT))
    weight = 2 * strict + soft
    return host, path, rule, verdict or ("block" if strict or soft >= 2 else "allow"), strict, soft, weight


def urls():
    r = random.Random(2)
    fixed = [
        None, "", "no scheme/casino", "http://", "://net/", "http://net", "http://NET/", "http://a.net/x", "http://anet/x", "http://example.net/en/1",
        "http://www.EXAMPLE.net/EN/1", "http://example.net/en", "https://x.example.com/de/casino", "http://y.org/fr/casino?x", "http://y.org/casino#f",
        "http://z.info/free-free", "http://z.info/free-bets", "http://z.info/freebets", "http://z.info/xcasinos", "http://z.info/?q=casino", "http://z.info/é.casino.é",
        "http://z.info/eADS/ads2/Ads", "http://u:p@net:80/", "a://b://casino-win.net/", "http://z.info/#a\nb?free\nwin", "http://Kasino.net\u212a/\u0130/ad",
        "http://z.info/" + "ads/" * 300_000 + "track",
    ]
    parts = ["casino", "free", "ads", "win", "Bet", "-", ".", "/", "?", "#", "example.net", "example.com", "org", "net", "en/", "de/", "x", "é", "3"]
    return fixed + ["http://" + "".join(r.choice(parts) for _ in range(r.randint(0, 9))) for _ in range(400)]


def test_as_plain_python(spark, tmp_path):
    rows = [(i % 350, u, "<html>", "clash", 1) for i, u in enumerate(urls())]  # ids repeat
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/pages.parquet")
    got = sorted((tuple(x) for x in op13_url_filter(spark, str(tmp_path)).collect()), key=repr)
    want = sorted(((i % 350, *plain(u)) for i, u in enumerate(urls())), key=repr)
    assert got == want
    assert {x[4] for x in got} == {"allow", "block"} and len({x[3] for x in got}) == 5


def test_empty_table_other_columns_and_no_terms(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert uf.judge(empty, URL_RULES).count() == 0
    page = spark.createDataFrame([(1, "http://casino.net/", "h", "clash", 3)], SCHEMA)
    (x,) = uf.judge(page, vocabulary={}, keep=("html", "page_id")).collect()
    assert tuple(x) == ("h", 1, "casino.net", "/", None, "allow", 0, 0, 0)
