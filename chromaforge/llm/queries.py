"""One query for each operator of this subpackage, over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import conversation, fingerprint, language, licenses, near_dup, packing, pieces, pii, quality, spelling, sql, substring_dup, token_files, url_filter
from .common import READ, documents

Query = Callable[[SparkSession, str], DataFrame]


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.replace(documents(spark, sf_dir), key="example key", report=True)


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.components(documents(spark, sf_dir), size=4, percent=80)


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(documents(spark, sf_dir))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dup.remove(documents(spark, sf_dir), report=True)


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), _vocabulary("byte_bpe_50k.json"), end_id=2, capacity=1024)


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digests(documents(spark, sf_dir), _vocabulary("piece_bpe_32k.model"))


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    shards = token_files.write(docs, _vocabulary("word_bpe_49k.json"), end_id=2)
    return token_files.read(shards, docs.schema["doc_id"].dataType.simpleString())


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.compare_with_next(documents(spark, sf_dir))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(documents(spark, sf_dir))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.assess(documents(spark, sf_dir))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = spelling.runs(documents(spark, sf_dir), least=7)  # a shorter run can't give a word of 7 letters
    return spelling.variants(spelling.count(spelling.with_typos(runs), length=7, least=2), factor=10)


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = conversation.prepare(spark.read.options(**READ).parquet(f"{sf_dir}/conversations.parquet"))
    return conversation.digests(conversation.damage(rows)).withColumnRenamed("conv", "conv_id")


#: The rules of the query, as verdict, host and path.
URL_RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))


def op13_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(spark.read.options(**READ).parquet(f"{sf_dir}/pages.parquet"), URL_RULES)


def queries() -> dict[str, Query]:
    return {
        name: f
        for name, f in sorted(globals().items(), key=lambda x: int(x[0][2:].split("_")[0]) if x[0][2:3].isdigit() else 0)
        if name.startswith("op") and callable(f)
    }


_WORDS = r"regexp_extract_all({0}, '[^\x20\x09-\x0D]+')"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP2_SQL = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format(_LOWER)} AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) >= 4
   THEN list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3])
   WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM w),
n AS MATERIALIZED (SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles FROM s),
e AS MATERIALIZED (SELECT doc_id, unnest(s) AS shingle FROM s),
common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM e a JOIN e b ON a.shingle = b.shingle
   WHERE a.doc_id <> b.doc_id GROUP BY 1, 2),
link AS MATERIALIZED (SELECT x, y FROM common JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y
   WHERE 100 * c >= 80 * (p.n_shingles + q.n_shingles - c)),
reach AS (SELECT doc_id, doc_id AS v FROM n UNION SELECT r.doc_id, l.y FROM reach r JOIN link l ON l.x = r.v)
SELECT n.doc_id, n_shingles, component_id, n.doc_id = component_id AS kept
FROM n JOIN (SELECT doc_id, min(v) AS component_id FROM reach GROUP BY 1) c ON c.doc_id = n.doc_id
"""


def _op10_sql(limit: float = quality.REJECT, sure: float = quality.SURE) -> str:
    rules = quality.RULES
    line = r"regexp_matches(x, '[^\x20\x09-\x0D]')"
    moments = ", ".join(f"sum(k_{r}) AS t_{r}, sum(k_{r} * k_{r} / n) AS s_{r}" for r in rules)

    def strength(r: str) -> str:
        m = f"(t_{r} / all_n)"
        spread = f"((s_{r} - all_n * {m} * {m} - (all_h - 1) * {m} * (1 - {m})) / nullif(all_n - all_n2 / all_n, 0))"
        return f"CASE WHEN {spread} > 0 AND all_h >= 2 THEN greatest({m} * (1 - {m}) / {spread} - 1, 1.0) END AS a_{r}"

    def shrunk(r: str) -> str:
        return f"(k_{r} + a_{r} * t_{r} / all_n) / (n + a_{r}) AS p_{r}"

    def strict(r: str) -> str:
        m, p = f"(t_{r} / all_n)", f"p_{r}"
        over = f"({p} - {m}) * ({p} - {m}) * (n + a_{r} + 1) > CAST({sure * sure} AS DOUBLE) * {p} * (1 - {p})"
        return f"coalesce({p} > {m} AND {over}, false) AS strict_{r}"

    return f"""
WITH w AS (SELECT doc_id, source, coalesce(text, '') AS text, {_WORDS.format("coalesce(text, '')")} AS w,
   list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: {line}) AS l FROM documents),
win AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS t
   FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
rep AS (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, t) AS c FROM win) WHERE c > 1),
reps AS (SELECT doc_id, count(DISTINCT j) AS k FROM rep GROUP BY 1),
c AS (SELECT w.doc_id, source, CAST(len(w) AS BIGINT) AS n_words, CAST(len(array_to_string(w, '')) AS BIGINT) AS word_chars,
   CAST(len(text) - len(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
   CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, len(l) AS n_lines,
   CAST(coalesce(k, 0) AS BIGINT) AS n_repeat_words FROM w LEFT JOIN reps ON reps.doc_id = w.doc_id),
f AS MATERIALIZED (SELECT *, n_words < 50 AS f_short, 100 * n_repeat_words > 50 * n_words AS f_repeats,
   n_symbols > CAST(0.1 AS DOUBLE) * n_words AS f_symbols, n_dup_lines > CAST(0.3 AS DOUBLE) * n_lines AS f_lines,
   n_words > 0 AND (word_chars < 2 * n_words OR word_chars > 20 * n_words) AS f_word_length FROM c),
h AS MATERIALIZED (SELECT source, CAST(count(*) AS DOUBLE) AS n, {", ".join(f"CAST(sum(f_{r}::INT) AS DOUBLE) AS k_{r}" for r in rules)} FROM f GROUP BY 1),
m AS (SELECT sum(n) AS all_n, count(*) AS all_h, sum(n * n) AS all_n2, {moments} FROM h),
a AS (SELECT *, {", ".join(strength(r) for r in rules)} FROM h, m),
p AS (SELECT *, {", ".join(shrunk(r) for r in rules)} FROM a),
v AS (SELECT source, greatest({", ".join(f"coalesce(p_{r}, t_{r} / all_n)" for r in rules)}) > {limit} AS host_bad,
   {", ".join(strict(r) for r in quality.SOFT)} FROM p)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, f_short OR f_repeats AS base_failed,
   NOT (f_short OR f_repeats OR host_bad OR {" OR ".join(f"f_{r} AND strict_{r}" for r in quality.SOFT)}) AS kept,
   f_short, f_repeats, f_symbols, f_lines, f_word_length, {", ".join(f"strict_{r}" for r in quality.SOFT)}, host_bad
FROM f JOIN v ON f.source IS NOT DISTINCT FROM v.source
"""


def oracle_sql() -> dict[str, str]:
    """SQL of the queries that it can express in full; the others are tested against plain versions."""
    return {"op2_minhash_near_dedup": OP2_SQL, "op10_quality_rules": _op10_sql(), **sql.oracle_sql(URL_RULES)}
