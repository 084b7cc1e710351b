"""Quality rules against plain Python, and host verdicts."""

import random
import re
from collections import Counter

from pyspark.sql import functions as F

from chromaforge.llm import quality

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words string, host string, row string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    seen = Counter(windows)
    repeat = {j for i, w in enumerate(windows) if seen[w] > 1 for j in range(i, i + 3)}
    lines, dup, before = text.split("\n"), 0, set()
    for line in lines:
        if WORD.search(line):
            dup += line in before
            before.add(line)
    n = len(words)
    return (n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(repeat), n < 50 or 100 * len(repeat) > 50 * n)


def fixture():
    r = random.Random(1)
    vocab = ["w%d" % i for i in range(30)] + ["é", "#a", "b*", "日本"]
    texts = [None, "", "  \n\t ", "one", "a a a a a", "x\n\nx\nx \n x", "\x85 \xa0 word", " lead and trail \n"]
    for _ in range(60):
        texts.append("".join(r.choice(vocab) + r.choice([" ", "\n", "\t", "  ", "\r\n"]) for _ in range(r.randint(1, 300))))
    texts.append(" ".join("u%d" % i for i in range(3000)))
    return [(i, t, "en", f"s{i % 5}", 0, "x", "y", "z") for i, t in enumerate(texts)]


def test_counts_are_those_of_plain_python(spark):
    rows = fixture()
    got = quality.assess(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows)
    want = {r[0]: plain(r[1]) for r in rows}
    for x in got:
        assert (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words, x.base_failed) == want[x.doc_id], x
        assert not (x.base_failed and x.kept)


def test_bad_hosts_are_rejected_and_small_ones_shrunk(spark):
    good = " ".join("w%d" % i for i in range(80))
    rows = [(i, good, "en", f"good{i % 8}", 0, "x", "y", "z") for i in range(160)]
    rows += [(200 + i, "short text", "en", "bad", 0, "x", "y", "z") for i in range(60)]
    rows += [(300 + i, good, "en", "bad", 0, "x", "y", "z") for i in range(3)]
    rows += [(400, "short", "en", "new", 0, "x", "y", "z"), (401, good, None, None, 0, None, None, None)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = {x.doc_id: x for x in quality.assess(docs).collect()}
    assert all(got[300 + i].host_bad and not got[300 + i].kept and not got[300 + i].base_failed for i in range(3))
    assert got[0].kept and got[401].kept and not got[400].kept
    kept = quality.keep(docs)
    assert kept.columns == docs.columns
    assert sorted(x.doc_id for x in kept.collect()) == [i for i in range(160)] + [401]


def test_soft_failures_count_where_the_host_is_strict(spark):
    good = " ".join("w%d" % i for i in range(80))
    marked = good + " # * $ % & | < > # * $ %"
    rows = [(i, marked if i % 100 < share else good, "en", host) for host, share, at in (("a", 2, 0), ("b", 40, 100)) for i in range(at, at + 100)]
    rows += [(900, marked, "en", None)] + [(901 + i, good, "en", None) for i in range(99)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    for hosts in (100_000, 0):  # joined by broadcast and by shuffle
        got = {x.doc_id: x for x in quality.assess(docs, broadcast_hosts=hosts).collect()}
        assert got[0].f_symbols and not got[0].strict_symbols and got[0].kept
        assert got[100].f_symbols and got[100].strict_symbols and not got[100].kept
        assert got[150].kept and got[900].kept and not got[900].strict_symbols
        kept = sorted(x.doc_id for x in quality.keep(docs, broadcast_hosts=hosts).collect())
        assert kept == [i for i in sorted(got) if got[i].kept]


def test_verdicts_decide_rows_of_documents(spark):
    """Texts of documents dealt to hosts that differ: those that fail the symbol rule go or stay by their host alone."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    marked = F.regexp_count("text", F.lit(r"[#*$%&|<>]")) * 40 > F.length("text")
    docs = docs.withColumn("source", F.when(marked & (F.col("doc_id") % 4 > 0), "marked").otherwise(F.col("source")))
    soft = quality.assess(docs).filter("(f_symbols or f_lines or f_word_length) and not base_failed and not host_bad")
    rows = soft.collect()
    by_symbols = [x for x in rows if x.f_symbols and not x.f_lines and not x.f_word_length]
    assert any(x.kept for x in by_symbols)
    for x in rows:
        assert x.kept != (x.f_symbols and x.strict_symbols or x.f_lines and x.strict_lines or x.f_word_length and x.strict_word_length)


def plain_strict(hosts, sure=quality.SURE):
    """host -> verdict of one rule, from host -> (documents, failures), by the formulas of the module's docstring."""
    n = sum(a for a, _ in hosts.values())
    m = sum(k for _, k in hosts.values()) / n
    between = sum(a * (k / a - m) ** 2 for a, k in hosts.values())
    spread = (between - (len(hosts) - 1) * m * (1 - m)) / (n - sum(a * a for a, _ in hosts.values()) / n) if len(hosts) > 1 else 0
    if spread <= 0:
        return dict.fromkeys(hosts, False)
    s = max(m * (1 - m) / spread - 1, 1.0)
    rate = {h: (k + s * m) / (a + s) for h, (a, k) in hosts.items()}
    return {h: p - m > sure * (p * (1 - p) / (hosts[h][0] + s + 1)) ** 0.5 for h, p in rate.items()}


def test_strict_hosts_are_those_of_the_plain_formula(spark):
    good = " ".join("w%d" % i for i in range(80))
    marked = good + " # * $ % & | < > # * $ %"
    for hosts in ({"a": (40, 2), "b": (30, 20), "c": (3, 2), "d": (200, 25)}, {"a": (20, 5), "b": (40, 10)}, {"a": (9, 4)}):
        rows = [(i, marked if i < k else good, h) for h, (n, k) in hosts.items() for i in range(n)]
        got = quality.assess(spark.createDataFrame(rows, "doc_id long, text string, source string"))
        # a document that fails only this rule goes by its host's verdicts
        failing = got.filter("f_symbols").groupBy("strict_symbols", "host_bad", "kept").count().collect()
        want = plain_strict(hosts)
        assert sum(x["count"] for x in failing if x.strict_symbols) == sum(hosts[h][1] for h in hosts if want[h])
        assert all(x.kept != (x.strict_symbols or x.host_bad) for x in failing)


def test_null_ids_and_very_long_texts(spark):
    long = " ".join("u%d" % (i % 5000) for i in range(400_000))
    docs = spark.createDataFrame([(None, long, "s"), (None, None, "s"), (1, long, None)], "doc_id long, text string, source string")
    got = quality.assess(docs).collect()
    assert sorted(x.n_words for x in got) == [0, 400_000, 400_000] and sum(x.n_repeat_words == 400_000 for x in got) == 2


def test_equal_hosts_keep_the_corpus_rate_and_empty_tables_work(spark):
    rows = fixture()
    assert quality.assess(spark.createDataFrame(rows + rows, SCHEMA)).count() == 2 * len(rows)
    empty = spark.createDataFrame([], SCHEMA)
    assert quality.assess(empty).count() == 0 and quality.keep(empty).count() == 0
