"""Quality rules on documents with host-level verdicts.

Every document gets counts and rule failures from its whole text. The failures are summed by host (the
``source`` column), and each host's failure rates are shrunk towards the corpus by an empirical beta prior
(method of moments over hosts). A host's shrunk rates give two verdicts, which are joined back to its documents:

- it is *rejected* when one rate is over ``REJECT``, one half: its next document is more likely to fail than not;
- it is *strict* in a soft rule (``SOFT``) when its rate is over that rule's corpus rate, the prior's mean, by more than
  ``SURE`` standard deviations of its posterior. A document that fails a soft rule goes where its host is strict in
  that rule; elsewhere it has the benefit of the doubt.

No limit is fitted to a table: one is a majority, the other a one-sided 95 % bound about the prior's own mean. A document
goes when it fails the base rule, when its host is rejected, or by a soft rule as said. One that fails no rule goes
only with its host.

Defined cases: a null or blank text has no words and all counts 0, so it fails the base rule; documents of a
null host form one host; where hosts do not differ beyond chance (or there is one host), all have the corpus rate, no
host is strict, and soft rules reject nothing; a tie with the bound is not over it; repeated rows count
and are returned as often as they occur; an empty table gives an empty result; other columns of the input are ignored
by ``assess`` and kept by ``keep``; null ids are ids like others.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, materialize, words

#: The rules whose failures hosts are judged by.
RULES = ("short", "repeats", "symbols", "lines", "word_length")
#: Those of them that count against a document only where its host is strict.
SOFT = RULES[2:]
#: A host goes when a shrunk rate is over this.
REJECT = 0.5
#: A host is strict in a soft rule when its rate is so many posterior standard deviations over the corpus rate.
SURE = 1.645


def _repeat_words(ws: Column, n: Column) -> Column:
    """Words inside three-word windows that occur at least twice in the text, every occurrence included."""
    windows = F.transform(
        F.slice(ws, F.lit(1), F.greatest(n - 2, F.lit(0))),
        lambda w, i: F.xxhash64(w, F.get(ws, i + 1), F.get(ws, i + 2)),
    )

    def covered(tri: Column) -> Column:
        ordered = F.sort_array(F.transform(tri, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        pairs = let(
            ordered,
            lambda s: F.zip_with(
                s,
                F.slice(s, F.lit(2), F.size(s)),
                lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])),
            ),
        )
        starts = F.array_distinct(F.flatten(F.filter(pairs, lambda p: p.isNotNull())))
        spans = F.transform(starts, lambda p: F.array(p, p + 1, p + 2))
        return F.size(F.array_distinct(F.flatten(spans)))

    return let(
        windows,
        lambda tri: F.when(F.size(F.array_distinct(tri)) == F.size(tri), F.lit(0)).otherwise(covered(tri)),
    )


def with_counts(df: DataFrame, text: Column, host: Column) -> DataFrame:
    """df packed into one column ``row``, and beside it the counts and rule failures of text."""
    body = F.coalesce(text, F.lit(""))
    # equality is that of the whole line: trimming only tells whether a line has a word
    with_word = F.filter(F.split(body, "\n"), lambda x: F.btrim(x, F.lit(" \t\x0b\x0c\r")) != "")
    counted = F.transform(
        F.array(words(text)),
        lambda ws: F.struct(
            F.size(ws).cast("long").alias("n_words"),
            F.length(F.array_join(ws, "")).cast("long").alias("word_chars"),
            F.regexp_count(body, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
            let(with_word, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
            let(with_word, F.size).cast("long").alias("n_lines"),
            _repeat_words(ws, F.size(ws)).cast("long").alias("n_repeat_words"),
        ),
    )
    out = df.select(F.struct("*").alias("row"), host.alias("host"), F.inline(counted))
    n = F.col("n_words")
    fails = {
        "short": n < 50,
        "repeats": F.lit(100) * F.col("n_repeat_words") > F.lit(50) * n,
        "symbols": F.col("n_symbols") > F.lit(0.1) * n,
        "lines": F.col("n_dup_lines") > F.lit(0.3) * F.col("n_lines"),
        "word_length": (n > 0) & ((F.col("word_chars") < 2 * n) | (F.col("word_chars") > 20 * n)),
    }
    return out.select("*", *(fails[r].alias(f"f_{r}") for r in RULES))


def host_verdicts(counts: DataFrame, reject: float = REJECT, sure: float = SURE) -> DataFrame:
    """One row per host: its documents, for each rule the shrunk failure rate, and the verdicts of this module.

    The prior of a rule is the beta distribution with the mean of all documents and the spread of the hosts'
    rates beyond their binomial noise; where hosts do not differ, every host gets the corpus rate.
    """
    hosts = counts.groupBy("host").agg(
        F.count(F.lit(1)).alias("n"), *(F.sum(F.col(f"f_{r}").cast("long")).alias(f"k_{r}") for r in RULES)
    )
    moments = hosts.agg(
        F.sum("n").alias("all_n"),
        F.count(F.lit(1)).alias("all_h"),
        F.sum(F.col("n") * F.col("n")).alias("all_n2"),
        *(F.sum(f"k_{r}").alias(f"all_k_{r}") for r in RULES),
        *(F.sum(F.col(f"k_{r}") * F.col(f"k_{r}") / F.col("n")).alias(f"all_s_{r}") for r in RULES),
    )
    joined = hosts.crossJoin(F.broadcast(moments))  # moments is one row
    rates, strict = {}, []
    for r in RULES:
        m = F.col(f"all_k_{r}") / F.col("all_n")
        between = F.col(f"all_s_{r}") - F.col("all_n") * m * m
        others = F.nullif(F.col("all_n") - F.col("all_n2") / F.col("all_n"), F.lit(0.0))  # one host has no others
        spread = (between - (F.col("all_h") - 1) * m * (1 - m)) / others
        strength = F.when((spread > 0) & (F.col("all_h") >= 2), F.greatest(m * (1 - m) / spread - 1, F.lit(1.0)))
        shrunk = (F.col(f"k_{r}") + strength * m) / (F.col("n") + strength)
        rates[r] = F.coalesce(shrunk, m)
        if r in SOFT:
            # squares instead of a root: both sides are compared where the rate is over the mean
            over = (shrunk - m) * (shrunk - m) * (F.col("n") + strength + 1) > F.lit(sure * sure) * shrunk * (1 - shrunk)
            strict.append(F.coalesce((shrunk > m) & over, F.lit(False)).alias(f"strict_{r}"))
    out = joined.select("host", "n", *(x.alias(f"rate_{r}") for r, x in rates.items()), *strict)
    return out.withColumn("host_bad", F.greatest(*(F.col(f"rate_{r}") for r in RULES)) > reject)


def _verdicts(counts: DataFrame) -> DataFrame:
    """A row a host, written as a table."""
    verdicts = host_verdicts(counts).select(F.col("host").alias("_host"), "host_bad", *(f"strict_{r}" for r in SOFT))
    return materialize(verdicts, "host-verdicts")


def _judged(counts: DataFrame, verdicts: DataFrame, broadcast_hosts: int) -> DataFrame:
    """counts with its host's verdicts, and ``kept``. The number of hosts, counted first, decides how they are joined."""
    few = verdicts.count() <= broadcast_hosts
    joined = counts.join(F.broadcast(verdicts) if few else verdicts, F.col("host").eqNullSafe(F.col("_host")))
    soft = reduce(or_, (F.col(f"f_{r}") & F.col(f"strict_{r}") for r in SOFT))
    base = F.col("f_short") | F.col("f_repeats")
    return joined.withColumn("base_failed", base).withColumn("kept", ~(base | soft | F.col("host_bad")))


def assess(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", broadcast_hosts: int = 100_000
) -> DataFrame:
    """Counts, base rule, the host's verdicts and the document's own, of every row of docs."""
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(host_col).alias("host"))
    counts = with_counts(d, F.col("text"), F.col("host"))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    rules = [f"f_{r}" for r in RULES]
    counts = counts.select(F.col("row.doc_id").alias("doc_id"), F.col("row.host").alias("host"), *names, *rules)
    counts = materialize(counts, "quality-counts")
    strict = [f"strict_{r}" for r in SOFT]
    return _judged(counts, _verdicts(counts), broadcast_hosts).select("doc_id", *names, "base_failed", "kept", *rules, *strict, "host_bad")


def keep(docs: DataFrame, text_col: str = "text", host_col: str = "source", broadcast_hosts: int = 100_000) -> DataFrame:
    """The rows of docs that pass, with all their columns.

    Counts are computed twice, once for the hosts and once for the documents: a copy of all texts beside them, which the
    second pass would read instead, takes as much disk as the input.
    """
    counts = with_counts(docs, F.col(text_col), F.col(host_col))
    return _judged(counts, _verdicts(counts), broadcast_hosts).filter("kept").select("row.*")
