"""SQL of the queries on spelling variants, conversations and URLs, for another engine on the same tables."""

from __future__ import annotations

from . import url_filter

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_LETTERS = "[A-Za-zÀ-ÿ]"


def _fold(text: str) -> str:
    return f"translate({text}, '{_UPPER}', '{_UPPER.lower()}')"


def _crc32(text: str) -> str:
    """Unsigned CRC-32 of the UTF-8 bytes of text with code points under 2,048: eight shifts after each byte."""
    code = "unicode(c)"
    units = f"flatten(list_transform(string_split({text}, ''), lambda c: CASE WHEN {code} < 128 THEN [{code}] ELSE [192 + {code} // 64, 128 + {code} % 64] END))"
    steps = f"flatten(list_transform({units}, lambda b: [CAST(b AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))"
    shift = "xor(c >> 1, (c & 1) * 3988292384)"
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {steps}), lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE {shift} END), 4294967295)"


OP11_SQL = f"""
WITH RECURSIVE run AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, {_fold(f"unnest(regexp_extract_all(coalesce(text, ''), '{_LETTERS}+'))")} AS w FROM documents),
hashed AS MATERIALIZED (SELECT *, {_crc32("id || ':' || w")} AS h FROM (SELECT id, w, count(*) AS c FROM run WHERE length(w) >= 7 GROUP BY 1, 2)),
word AS MATERIALIZED (SELECT word, CAST(sum(c) AS BIGINT) AS n FROM
   (SELECT c, CASE WHEN h % 31 = 0 THEN substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word FROM hashed)
   WHERE length(word) >= 7 GROUP BY 1 HAVING sum(c) >= 2),
cut AS MATERIALIZED (SELECT word, i, substr(word, 1, i) || substr(word, i + 2) AS c FROM (SELECT word, unnest(range(length(word))) AS i FROM word)),
pair AS (SELECT p.word AS a, q.word AS b FROM cut p JOIN cut q ON p.c = q.c AND p.i = q.i WHERE p.word <> q.word
   UNION SELECT p.word, q.word FROM cut p JOIN word q ON p.c = q.word UNION SELECT q.word, p.word FROM cut p JOIN word q ON p.c = q.word),
best AS (SELECT a, count(*) AS n_near, first(b ORDER BY n DESC, b) AS b, max(n) AS n FROM pair JOIN word ON word = b GROUP BY 1),
form AS MATERIALIZED (SELECT w.word, CASE WHEN b.n >= 10 * w.n THEN b.b END AS form, w.n, coalesce(b.n_near, 0) AS n_near,
   CASE WHEN b.n >= 10 * w.n THEN b.n END AS form_n FROM word w LEFT JOIN best b ON b.a = w.word),
chain AS (SELECT word, word AS root, form AS onward FROM form UNION ALL
   SELECT c.word, f.word, f.form FROM chain c JOIN form f ON f.word = c.onward)
SELECT f.word, f.form, c.root, f.n, f.n_near, f.form_n FROM form f JOIN chain c ON c.word = f.word WHERE c.onward IS NULL
"""

_BLANK = r"[\x20\x09-\x0D]"


def _step(state: str, cost: str, letter: str, row: str = "''") -> str:
    """What an edit makes of a state: cost, audit and repaired rows, each after a line break."""
    return f"CASE WHEN {state} IS NOT NULL THEN {{'c': {state}.c + {cost}, 'a': {state}.a || '{letter}', 'o': {state}.o || {row}}} END"


def _least(*options: str) -> str:
    return f"list_sort(list_filter([{', '.join(options)}], lambda x: x IS NOT NULL))[1]"


def _op12_sql() -> str:
    def out(role: str, text: str = "''") -> str:
        return f"chr(10) || {role} || ':' || {text}"

    def inserted(role: str) -> dict[str, str]:
        return {"cost": "2", "letter": "I", "row": out(f"'{role}'")}

    # inserted turns between two rows: state 2 from 0, 1 and 3, then state 3 from 2
    closed = f"""SELECT * REPLACE ({_least("s3", _step("s2", **inserted("assistant")))} AS s3) FROM (SELECT * REPLACE (
   {_least("s2", *(_step(s, **inserted("user")) for s in ("s0", "s1", "s3")))} AS s2) FROM dp)"""
    stays = "CASE WHEN trunc THEN 1 ELSE 0 END"

    def take(state: str, initial: str) -> list[str]:
        name = {"u": "user", "a": "assistant"}.get(initial)
        options = [f"CASE WHEN free AND first = '{initial}' THEN {_step(state, stays, 'K', out('role', 'text'))} END"]
        if name:
            options.append(f"CASE WHEN free THEN {_step(state, f'2 + {stays}', 'R', out(chr(39) + name + chr(39), 'text'))} END")
        return options

    new = [
        _step("s0", "3", "D"),
        _least(_step("s1", "3", "D"), *take("s0", "s")),
        _least(_step("s2", "3", "D"), *take("s0", "u"), *take("s1", "u"), *take("s3", "u")),
        _least(_step("s3", "3", "D"), *take("s2", "a")),
    ]
    kind = "STRUCT(c BIGINT, a VARCHAR, o VARCHAR)"
    crc = _crc32("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")
    return f"""
WITH RECURSIVE h AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc} % 20 AS h FROM conversations),
d AS (SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role,
   CASE WHEN h = 1 THEN '' WHEN h = 2 THEN translate(text, '.!?', '') ELSE text END AS text,
   unnest(range(CASE WHEN h = 0 THEN 0 WHEN h = 3 THEN 2 ELSE 1 END)) AS copy FROM h),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i,
   row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS seen,
   NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') AS blank, left(role, 1) AS first,
   regexp_matches(text, '[.!?]{_BLANK}*$') AS whole FROM d),
t AS MATERIALIZED (SELECT *, NOT blank AND seen AS dup, NOT blank AND NOT seen AND NOT whole AS trunc, NOT blank AND NOT seen AS free,
   lag(first) OVER (PARTITION BY conv_id ORDER BY i) || first NOT IN ('su', 'ua', 'au') AS illegal FROM o),
dp AS (SELECT conv_id, CAST(0 AS BIGINT) AS i, CAST({{'c': 0, 'a': '', 'o': ''}} AS {kind}) AS s0, CAST(NULL AS {kind}) AS s1,
   CAST(NULL AS {kind}) AS s2, CAST(NULL AS {kind}) AS s3 FROM (SELECT DISTINCT conv_id FROM conversations)
   UNION ALL SELECT c.conv_id, t.i, {", ".join(f"CAST({x} AS {kind})" for x in new)} FROM ({closed}) c
   JOIN t ON t.conv_id IS NOT DISTINCT FROM c.conv_id AND t.i = c.i + 1),
last AS (SELECT conv_id, {_least("s0", "s3")} AS s FROM (SELECT * FROM ({closed}) QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY i DESC) = 1)),
n AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank,
   count(*) FILTER (dup) AS duplicate, count(*) FILTER (trunc) AS truncated, count(*) FILTER (illegal) AS illegal FROM t GROUP BY 1)
SELECT last.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
   coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, s.c AS cost, s.a AS audit, sha256(substr(s.o, 2)) AS repaired_sha256
FROM last LEFT JOIN n ON n.conv_id IS NOT DISTINCT FROM last.conv_id
"""


def _op13_sql(rules: tuple[url_filter.Rule, ...]) -> str:
    known = ", ".join(f"('{verdict}', '{host}', '{path}')" for verdict, host, path in rules)
    terms = ", ".join(f"('{term}', {weight})" for term, weight in url_filter.VOCABULARY.items())
    return f"""
WITH u AS (SELECT page_id, url, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT row_number() OVER () AS id, page_id, {_fold("regexp_extract(rest, '^([^/?#]*)', 1)")} AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path,
   ' ' || regexp_replace({_fold("coalesce(url, '')")}, '[^a-z0-9]', ' ', 'g') || ' ' AS spaced FROM u),
r AS (SELECT * FROM (VALUES {known}) AS t(verdict, of, under)),
fit AS (SELECT id, first(of || under ORDER BY length(of || under) DESC) AS rule, first(verdict ORDER BY length(of || under) DESC) AS verdict
   FROM p JOIN r ON (host = of OR ends_with(host, '.' || of)) AND starts_with(path, under) GROUP BY 1),
hit AS (SELECT id, count(*) FILTER (w >= {url_filter.LIMIT}) AS strict_hits, count(*) FILTER (w < {url_filter.LIMIT}) AS soft_hits, CAST(sum(w) AS BIGINT) AS weight
   FROM p JOIN (VALUES {terms}) AS t(term, w) ON contains(spaced, ' ' || term || ' ') GROUP BY 1)
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN weight >= {url_filter.LIMIT} THEN 'block' ELSE 'allow' END) AS verdict,
   coalesce(strict_hits, 0) AS strict_hits, coalesce(soft_hits, 0) AS soft_hits, coalesce(weight, 0) AS weight
FROM p LEFT JOIN fit ON fit.id = p.id LEFT JOIN hit ON hit.id = p.id
"""


def oracle_sql(url_rules: tuple[url_filter.Rule, ...]) -> dict[str, str]:
    return {"op11_spelling_variants": OP11_SQL, "op12_conversation_repair": _op12_sql(), "op13_url_filter": _op13_sql(url_rules)}
