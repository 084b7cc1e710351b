"""SQL that gives the rows of the queries, for another engine on the same tables. Iterations are unrolled."""

from __future__ import annotations

import math

from ..functions.color import FROM_XYZ, TO_XYZ, WHITE
from ..operators import seeding
from ..operators.raster import BITS
from ..operators.sampling import HASH as HASH_FACTORS
from ..operators.sampling import MODULUS
from .queries import ITERATIONS, K, K_DIRECT, RATES

EV = """ev AS MATERIALIZED (SELECT CAST(event_id AS BIGINT) AS ord, CAST(event_id % 100 AS BIGINT) AS x,
 CAST(event_id // 100 AS BIGINT) AS y, CAST((user_id * 37) % 256 AS BIGINT) AS r,
 CAST(floor(value) AS BIGINT) % 256 AS g, CAST((event_id * 7) % 256 AS BIGINT) AS b FROM events)"""
EM = "ev AS MATERIALIZED (SELECT CAST(vec_id AS BIGINT) AS ord, " + ", ".join(
    f"CAST(least(greatest(floor((CAST(embedding[{i}] AS DOUBLE) + 0.5) * 255), 0), 255) AS BIGINT) AS {c}" for i, c in enumerate("rgb", 1)
) + " FROM embeddings)"
HIST = """hist AS MATERIALIZED (SELECT r * 16 // 256 AS rb, g * 16 // 256 AS gb, b * 16 // 256 AS bb, count(*) AS n,
 CAST(sum(r) AS BIGINT) AS sum_r, CAST(sum(g) AS BIGINT) AS sum_g, CAST(sum(b) AS BIGINT) AS sum_b,
 min(ord) AS first_ord FROM ev GROUP BY 1, 2, 3)"""
CAND = "cand AS MATERIALIZED (SELECT rb, gb, bb, sum_r // n AS r, sum_g // n AS g, sum_b // n AS b, n, first_ord FROM hist)"


def _sed(p: str, q: str, names: tuple[str, ...] = ("r", "g", "b")) -> str:
    return "(" + " + ".join(f"({p}.{c} - {q}.{c}) * ({p}.{c} - {q}.{c})" for c in names) + ")"


def _greedy(k: int = K) -> str:
    """Common table pal (k, r, g, b, n) from cand."""
    parts = ["s0 AS MATERIALIZED (SELECT * FROM cand ORDER BY n DESC, first_ord LIMIT 1)"]
    parts.append(f"c0 AS MATERIALIZED (SELECT c.*, {_sed('c', 's')} AS d FROM cand c, s0 s WHERE c.first_ord <> s.first_ord)")
    for i in range(1, k):
        parts.append(f"s{i} AS MATERIALIZED (SELECT * FROM c{i - 1} ORDER BY d * sqrt(n) DESC, first_ord LIMIT 1)")
        parts.append(
            f"c{i} AS MATERIALIZED (SELECT c.* REPLACE (least(c.d, {_sed('c', 's')}) AS d) FROM c{i - 1} c, s{i} s WHERE c.first_ord <> s.first_ord)"
        )
    union = " UNION ALL ".join(f"SELECT CAST({i} AS BIGINT) AS k, r, g, b, n FROM s{i}" for i in range(k))
    return ", ".join([*parts, f"pal AS MATERIALIZED ({union})"])


PAL = f"WITH {EV}, {HIST}, {CAND}, {_greedy()}"
LINSPACE = f"""pal AS MATERIALIZED (SELECT t.k, e.ord, e.r, e.g, e.b FROM (SELECT k, k * (n - 1) // {K_DIRECT - 1} AS ord
 FROM range({K_DIRECT}) AS q(k), (SELECT count(*) AS n FROM ev)) t JOIN ev e ON e.ord = t.ord)"""
#: What the standard library's generator draws for seed 1, by number of pixels: SQL has no such generator.
DRAWN = {
    1_000: (137, 582, 867, 821, 782, 64, 261, 120),
    10_000: (2201, 9325, 1033, 4179, 1931, 8117, 7364, 7737),
    100_000: (17611, 74606, 8271, 33432, 15455, 64937, 99740, 58915),
}
_DRAWN = ", ".join(f"({n}, {k}, {o})" for n, drawn in DRAWN.items() for k, o in enumerate(drawn))
SEEDED = f"""pal AS MATERIALIZED (SELECT CAST(t.k AS BIGINT) AS k, e.ord, e.r, e.g, e.b FROM (VALUES {_DRAWN}) AS t(n, k, ord)
 JOIN ev e ON e.ord = t.ord WHERE t.n = (SELECT count(*) FROM ev))"""
NEAREST = f"""near AS MATERIALIZED (SELECT e.ord, any_value(e.x) AS x, any_value(e.y) AS y, any_value(e.r) AS r, any_value(e.g) AS g,
 any_value(e.b) AS b, min({_sed('e', 'p')} * 16 + p.k) AS dk FROM ev e, pal p GROUP BY e.ord)"""


def _iterations(stop: str, order: bool, source: str = "ev", prefix: str = "", count: int = ITERATIONS) -> str:
    """Unrolled integer K-means over source from {prefix}p0: palettes {prefix}p0.., errors {prefix}e0.., flags."""
    q = prefix
    parts = [f"{q}col AS MATERIALIZED (SELECT r, g, b, count(*) AS n FROM {source} GROUP BY 1, 2, 3)"]
    for i in range(count):
        parts.append(
            f"{q}a{i} AS MATERIALIZED (SELECT c.r, c.g, c.b, any_value(c.n) AS n, min({_sed('c', 'p')} * 16 + p.k) AS dk FROM {q}col c, {q}p{i} p GROUP BY 1, 2, 3)"
        )
        parts.append(f"{q}e{i} AS MATERIALIZED (SELECT CAST(sum((dk // 16) * n) AS BIGINT) AS e, CAST(sum(n) AS BIGINT) AS n FROM {q}a{i})")
        stalled = f"(SELECT e FROM {q}e{i}) >= (SELECT e FROM {q}e{i - 1})" if i else "false"
        before = f"(SELECT f FROM {q}f{i - 1})" if i else "false"
        parts.append(f"{q}f{i} AS MATERIALIZED (SELECT {stalled} OR {before} AS f)")
        frozen = {"never": "false", "break": f"(SELECT f FROM {q}f{i})", "update": before}[stop]
        new = f"""SELECT p.k, {", ".join(f"CASE WHEN {frozen} THEN p.{c} ELSE coalesce(m.{c}, p.{c}) END AS {c}" for c in "rgb")} FROM {q}p{i} p
 LEFT JOIN (SELECT dk % 16 AS k, {", ".join(f"CAST(sum({c} * n) // sum(n) AS BIGINT) AS {c}" for c in "rgb")} FROM {q}a{i} GROUP BY 1) m ON p.k = m.k"""
        if order:
            new = f"SELECT row_number() OVER (ORDER BY r * r + g * g + b * b, k) - 1 AS k, r, g, b FROM ({new})"
        parts.append(f"{q}p{i + 1} AS MATERIALIZED ({new})")
    return ", ".join(parts)


def _float_iterations(columns: tuple[str, ...], stop: str, count: int = ITERATIONS) -> str:
    """Unrolled K-means with real means over col (columns, n) from p0."""
    parts = []
    for i in range(count):
        parts.append(
            f"d{i} AS MATERIALIZED (SELECT c.*, p.k, {_sed('c', 'p', columns)} AS d FROM col c, p{i} p), "
            f"a{i} AS MATERIALIZED (SELECT * FROM d{i} QUALIFY row_number() OVER (PARTITION BY id ORDER BY d, k) = 1), "
            f"e{i} AS MATERIALIZED (SELECT sum(d * n) AS e FROM a{i})"
        )
        stalled = f"(SELECT e FROM e{i}) >= (SELECT e FROM e{i - 1})" if i else "false"
        before = f"(SELECT f FROM f{i - 1})" if i else "false"
        parts.append(f"f{i} AS MATERIALIZED (SELECT {stalled} OR {before} AS f)")
        frozen = {"never": "false", "break": f"(SELECT f FROM f{i})", "update": before}[stop]
        parts.append(
            f"""p{i + 1} AS MATERIALIZED (SELECT p.k, {", ".join(f"CASE WHEN {frozen} THEN p.{c} ELSE coalesce(m.{c}, p.{c}) END AS {c}" for c in columns)} FROM p{i} p
 LEFT JOIN (SELECT k, {", ".join(f"sum({c} * n) / sum(n) AS {c}" for c in columns)} FROM a{i} GROUP BY 1) m ON p.k = m.k)"""
        )
    return ", ".join(parts)


def _lab(r: str = "r", g: str = "g", b: str = "b") -> str:
    """l, a, b_lab of channel expressions."""

    def linear(v: str) -> str:
        c = f"(CAST({v} AS DOUBLE) / 255.0)"
        return f"(CASE WHEN {c} > 0.04045 THEN pow(({c} + 0.055) / 1.055, 2.4) ELSE {c} / 12.92 END)"

    lin = [linear(v) for v in (r, g, b)]

    def f(m: tuple[float, ...], w: float) -> str:
        t = "((" + " + ".join(f"{x} * {v}" for x, v in zip(lin, m, strict=True)) + f") / {w})"
        return f"(CASE WHEN {t} > 0.008856 THEN cbrt({t}) ELSE {t} * 7.787 + 16.0 / 116.0 END)"

    x, y, z = (f(m, w) for m, w in zip(TO_XYZ, WHITE, strict=True))
    return f"({y} * 116.0 - 16.0) AS l, (({x} - {y}) * 500.0) AS a, (({y} - {z}) * 200.0) AS b_lab"


def _rgb(table: str) -> str:
    """Query for all columns of table (l, a, b_lab) and r, g, b in 0..255 as doubles."""
    names = zip(("fx", "fy", "fz"), WHITE, strict=True)
    t = ", ".join(f"(CASE WHEN {v} > 0.2068966 THEN {v} * {v} * {v} ELSE ({v} - 16.0 / 116.0) / 7.787 END) * {w} AS t{v}" for v, w in names)
    lin = ", ".join(f"(tfx * ({m[0]!r}) + tfy * ({m[1]!r}) + tfz * ({m[2]!r})) AS l{c}" for m, c in zip(FROM_XYZ, "rgb", strict=True))
    gamma = ", ".join(
        f"least(greatest(CASE WHEN l{c} > 0.0031308 THEN pow(greatest(l{c}, 0.0), {1 / 2.4!r}) * 1.055 - 0.055 ELSE l{c} * 12.92 END, 0.0), 1.0) * 255.0 AS {c}"
        for c in "rgb"
    )
    f = "(l + 16.0) / 116.0 AS fy, a / 500.0 + (l + 16.0) / 116.0 AS fx, greatest((l + 16.0) / 116.0 - b_lab / 200.0, 0.0) AS fz"
    return f"SELECT *, {gamma} FROM (SELECT *, {lin} FROM (SELECT *, {t} FROM (SELECT *, {f} FROM {table})))"


def _tidy(names: dict[str, int]) -> str:
    return ", ".join(f"round({c}, {d}) + 0.0 AS {c}" for c, d in names.items())


LAB4 = _tidy({"l": 4, "a": 4, "b_lab": 4})
HASH = "((x * 73856093) + (y * 19349663)) % 1000003"
_LAB_START = f"""WITH {EM}, {LINSPACE}, col AS MATERIALIZED (SELECT row_number() OVER () AS id, * FROM
 (SELECT r, g, b, n, {_lab()} FROM (SELECT r, g, b, count(*) AS n FROM ev GROUP BY 1, 2, 3))),
 p0 AS MATERIALIZED (SELECT k, {_lab()} FROM pal)"""
_LABS = ("l", "a", "b_lab")
_PALETTE_OUT = "SELECT k, CAST(floor(r) AS BIGINT) AS r, CAST(floor(g) AS BIGINT) AS g, CAST(floor(b) AS BIGINT) AS b FROM "


def _block(edge: int, take: int, select: str = "ord, r, g, b") -> str:
    return f"SELECT {select} FROM ev QUALIFY row_number() OVER (PARTITION BY y // {edge}, x // {edge} ORDER BY {HASH}, ord) <= {take}"


def _strips() -> str:
    made = [f"SELECT CAST({n} AS BIGINT) AS strip, i, CAST(least({s} + 20 * i, 255) AS BIGINT) AS r, CAST({s} AS BIGINT) AS g, CAST({s} AS BIGINT) AS b FROM range(11) AS t(i)" for n, s in ((1, 20), (2, 200))]
    return " UNION ALL ".join(made)


def _lab_strips() -> str:
    made = []
    for n, gray in ((3, 20), (4, 200)):
        start = f"(SELECT {_lab(str(gray), str(gray), str(gray))})"
        made.append(f"SELECT CAST({n} AS BIGINT) AS strip, i, least(greatest(l + i * 6.0, 0.0), 100.0) AS l, a, b_lab FROM {start}, range(11) AS t(i)")
    return " UNION ALL ".join(made)


def _adjacent(d: str, table: str) -> str:
    return f"SELECT p.strip, p.i, {d} FROM {table} p JOIN {table} q ON p.strip = q.strip AND q.i = p.i + 1"


def _sweep() -> str:
    known = {0.5: (2, 2), 0.25: (2, 1), 0.125: (4, 2), 0.0625: (4, 1)}
    parts, out = [PAL], []
    for j, rate in enumerate(RATES):
        inner = "SELECT * FROM ev" if rate == 1 else _block(*known[rate], select="*")
        parts.append(f"src{j} AS MATERIALIZED ({inner}), r{j}p0 AS MATERIALIZED (SELECT k, r, g, b FROM pal)")
        parts.append(_iterations("update", True, f"src{j}", f"r{j}"))
        out.append(f"SELECT CAST({rate} AS DOUBLE) AS rate, k, r, g, b FROM r{j}p{ITERATIONS}")
    return ", ".join(parts) + " " + " UNION ALL ".join(out)


def _length_iterations() -> str:
    """Unrolled K-means over ev from p0 in ascending order of length, ties by a binary search and a walk from its place.

    For seven colours the search visits place 3, then 1 or 5, then a neighbour of that, and ends early at an equal length.
    """
    if K != 7:
        raise ValueError("the search is written out for seven colours")
    parts = ["col AS MATERIALIZED (SELECT r, g, b, count(*) AS n, sqrt(CAST(r * r + g * g + b * b AS DOUBLE)) AS x FROM ev GROUP BY 1, 2, 3)"]
    for i in range(ITERATIONS):
        parts.append(f"l{i} AS MATERIALIZED (SELECT list(sqrt(CAST(r * r + g * g + b * b AS DOUBLE)) ORDER BY k) AS q FROM p{i})")
        # places count from 1 in lists
        second = "CASE WHEN q[4] = x THEN 4 WHEN q[4] < x THEN 6 ELSE 2 END"
        third = "CASE WHEN q[v2] = x THEN v2 WHEN q[v2] < x THEN v2 + 1 ELSE v2 - 1 END"
        nearer = "CASE WHEN abs(q[{1}] - x) < abs(q[{0}] - x) THEN {1} ELSE {0} END"
        parts.append(
            f"""b{i} AS MATERIALIZED (SELECT r, g, b, n, {nearer.format("w", "v3")} - 1 AS s FROM (SELECT *, {nearer.format("4", "v2")} AS w FROM
 (SELECT *, CASE WHEN v2 = 4 THEN 4 ELSE {third} END AS v3 FROM (SELECT *, {second} AS v2 FROM col, l{i}))))"""
        )
        walk = "CASE WHEN p.k = c.s THEN 0 WHEN p.k < c.s THEN c.s - p.k ELSE p.k END"
        parts.append(
            f"a{i} AS MATERIALIZED (SELECT c.r, c.g, c.b, any_value(c.n) AS n, min(({_sed('c', 'p')} * 16 + {walk}) * 16 + p.k) AS dk FROM b{i} c, p{i} p GROUP BY 1, 2, 3)"
        )
        parts.append(f"e{i} AS MATERIALIZED (SELECT CAST(sum((dk // 256) * n) AS BIGINT) AS e FROM a{i})")
        before = f"(SELECT f FROM f{i - 1})" if i else "false"
        stalled = f"(SELECT e FROM e{i}) >= (SELECT e FROM e{i - 1})" if i else "false"
        parts.append(f"f{i} AS MATERIALIZED (SELECT {stalled} OR {before} AS f)")
        parts.append(
            f"""p{i + 1} AS MATERIALIZED (SELECT row_number() OVER (ORDER BY r * r + g * g + b * b, k) - 1 AS k, r, g, b FROM (SELECT p.k,
 {", ".join(f"CASE WHEN {before} THEN p.{c} ELSE coalesce(m.{c}, p.{c}) END AS {c}" for c in "rgb")} FROM p{i} p
 LEFT JOIN (SELECT dk % 16 AS k, {", ".join(f"CAST(sum({c} * n) // sum(n) AS BIGINT) AS {c}" for c in "rgb")} FROM a{i} GROUP BY 1) m ON p.k = m.k))"""
        )
    return ", ".join(parts)


def _starts(seeds: int) -> str:
    """Oversampled starts over ev: common table start (seed, k, r, g, b), the best of each seed's."""
    a, b, c = HASH_FACTORS
    run = f"run AS (SELECT s AS seed, t AS start FROM range({seeds}) AS x(s), range({seeding.STARTS}) AS y(t))"
    hashed = lambda code, step: f"(({code}) * {a} + seed * {b} + start * {c} + {step * seeding.STEP}) % {MODULUS}"
    parts = ["col AS MATERIALIZED (SELECT (r * 256 + g) * 256 + b AS code, r, g, b, count(*) AS n FROM ev GROUP BY 1, 2, 3, 4)", run]
    parts.append(
        f"t0 AS MATERIALIZED (SELECT seed, start, code, r, g, b FROM col, run QUALIFY row_number() OVER (PARTITION BY seed, start ORDER BY {hashed('code', 0)}, code) = 1)"
    )
    for i in range(1, seeding.ROUNDS + 1):
        parts.append(
            f"""u{i} AS MATERIALIZED (SELECT seed, start, c.code, any_value(c.r) AS r, any_value(c.g) AS g, any_value(c.b) AS b, any_value(c.n) * min({_sed('c', 't')}) AS e
 FROM col c, t{i - 1} t GROUP BY 1, 2, 3)"""
        )
        parts.append(
            f"""t{i} AS MATERIALIZED (SELECT * FROM t{i - 1} UNION ALL SELECT seed, start, code, r, g, b FROM
 (SELECT *, CAST(sum(e) OVER (PARTITION BY seed, start) AS DOUBLE) AS phi FROM u{i}) WHERE {hashed('code', i)} / {float(MODULUS)!r}::DOUBLE * phi < {seeding.FACTOR * K_DIRECT} * e)"""
        )
    last = f"t{seeding.ROUNDS}"
    parts.append(
        f"""w AS MATERIALIZED (SELECT seed, start, t.code, t.r, t.g, t.b, m.n AS w FROM {last} t JOIN (SELECT seed, start, code, sum(n) AS n FROM
 (SELECT seed, start, c.n, arg_min(t.code, {_sed('c', 't')} * 16777216 + t.code) AS code FROM col c, {last} t GROUP BY seed, start, c.code, c.n) GROUP BY 1, 2, 3) m USING (seed, start, code))"""
    )
    for i in range(K_DIRECT):
        mass = "w" if i == 0 else f"w * least({', '.join(_sed('w', f'y{j}') for j in range(i))})"
        joined = " ".join(f"JOIN y{j} USING (seed, start)" for j in range(i))
        parts.append(
            f"""y{i} AS MATERIALIZED (SELECT seed, start, r, g, b FROM (SELECT *, CAST(sum(m) OVER (PARTITION BY seed, start ORDER BY code) AS DOUBLE) AS s,
 CAST(sum(m) OVER (PARTITION BY seed, start) AS DOUBLE) AS total FROM (SELECT seed, start, w.code, w.r, w.g, w.b, {mass} AS m FROM w {joined}))
 WHERE s > {hashed('0', seeding.REDUCE + i)} / {float(MODULUS)!r}::DOUBLE * total QUALIFY row_number() OVER (PARTITION BY seed, start ORDER BY code) = 1)"""
        )
    union = " UNION ALL ".join(f"SELECT seed, start, CAST({i} AS BIGINT) AS k, r, g, b FROM y{i}" for i in range(K_DIRECT))
    parts.append(f"starts AS MATERIALIZED ({union})")
    parts.append(
        f"""best AS MATERIALIZED (SELECT seed, arg_min(start, e * 16 + start) AS start FROM (SELECT seed, start, sum(n * d) AS e FROM
 (SELECT seed, start, c.code, any_value(c.n) AS n, min({_sed('c', 't')}) AS d FROM col c, starts t GROUP BY 1, 2, 3) GROUP BY 1, 2) GROUP BY 1)"""
    )
    parts.append("start AS MATERIALIZED (SELECT seed, k, r, g, b FROM starts JOIN best USING (seed, start))")
    return ", ".join(parts)


def _seed_search(steps: int = 5, rate: float = 0.1) -> str:
    a, b, c = HASH_FACTORS
    parts = [f"WITH {EM}", _starts(20)]
    parts.append("m0 AS MATERIALIZED (SELECT seed, k, CAST(r AS DOUBLE) AS r, CAST(g AS DOUBLE) AS g, CAST(b AS DOUBLE) AS b, CAST(0 AS BIGINT) AS had FROM start)")
    for i in range(steps):
        place = f"((e.ord % 100) * {a} + (e.ord // 100) * {b} + seed * {c} + {i * seeding.STEP}) % {MODULUS}"
        parts.append(
            f"""h{i} AS MATERIALIZED (SELECT seed, k, count(*) AS n, {", ".join(f"CAST(sum({c}) AS DOUBLE) AS {c}" for c in "rgb")} FROM
 (SELECT m.seed, m.k, e.r, e.g, e.b FROM ev e, m{i} m WHERE {place} < {rate * MODULUS!r}::DOUBLE
  QUALIFY row_number() OVER (PARTITION BY m.seed, e.ord ORDER BY {_sed('e', 'm')}, m.k) = 1) GROUP BY 1, 2)"""
        )
        parts.append(
            f"""m{i + 1} AS MATERIALIZED (SELECT m.seed, m.k, {", ".join(f"CASE WHEN h.n IS NULL THEN m.{c} ELSE m.{c} + CAST(h.n AS DOUBLE) / CAST(m.had + h.n AS DOUBLE) * (h.{c} / CAST(h.n AS DOUBLE) - m.{c}) END AS {c}" for c in "rgb")},
 m.had + coalesce(h.n, 0) AS had FROM m{i} m LEFT JOIN h{i} h USING (seed, k))"""
        )
    parts.append(f"lab AS MATERIALIZED (SELECT seed, k, {_lab('floor(r)', 'floor(g)', 'floor(b)')} FROM m{steps})")
    parts.append(
        f"""near AS MATERIALIZED (SELECT p.seed, p.k AS i, q.k AS j, sqrt({_sed('p', 'q', _LABS)}) AS delta_e FROM lab p JOIN lab q ON p.seed = q.seed AND p.k < q.k
 QUALIFY row_number() OVER (PARTITION BY p.seed ORDER BY delta_e, i, j) = 1)"""
    )
    first = "coalesce(min(delta_e) OVER (ORDER BY seed ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1e9) >= 5.0"
    return ", ".join(parts) + f" SELECT CAST(seed AS INTEGER) AS seed, i, j, round(delta_e, 4) + 0.0 AS delta_e FROM near QUALIFY {first}"


def _resized(cap: int = 64) -> str:
    """Whole-number bilinear resampling of ev, columns first, then rows."""
    even = f"CAST(round_even({{0}} * {cap}.0 / greatest(w, h), 0) AS BIGINT)"
    dims = ", ".join(f"CASE WHEN greatest(w, h) <= {cap} THEN {c} ELSE {even.format(c)} END AS n{c}" for c in "wh")
    mean = ", ".join(f"CAST(least(greatest((sum({c} * k) + {1 << BITS - 1}) >> {BITS}, 0), 255) AS BIGINT) AS {c}" for c in "rgb")

    def weights(size: str) -> str:
        reach, new = f"2 * greatest({size}, n{size})", f"n{size}"
        w = f"{reach} - abs((2 * p + 1) * {new} - (2 * t + 1) * {size})"
        rows = f"SELECT t, p, {w} AS w FROM s, range({new}) AS a(t), range({size}) AS b(p) WHERE {w} > 0"
        return f"SELECT t, p, (w * {2 << BITS} + sum(w) OVER (PARTITION BY t)) // (2 * sum(w) OVER (PARTITION BY t)) AS k FROM ({rows})"

    return f"""WITH {EV}, s AS MATERIALIZED (SELECT *, {dims} FROM (SELECT max(x) + 1 AS w, max(y) + 1 AS h FROM ev)),
 kx AS MATERIALIZED ({weights("w")}), ky AS MATERIALIZED ({weights("h")}),
 narrow AS MATERIALIZED (SELECT t AS x, y, {mean} FROM ev JOIN kx ON p = x GROUP BY 1, 2)
 SELECT x, t AS y, {mean} FROM narrow JOIN ky ON p = y GROUP BY 1, 2"""


def _ordered_minibatches(steps: int = 10) -> str:
    """Mini-batch K-means over ev in order of ord, from evenly spaced pixels."""
    parts = [f"WITH {EV}, {LINSPACE}, c AS (SELECT (count(*) + {steps - 1}) // {steps} AS size FROM ev)"]
    parts.append("m0 AS MATERIALIZED (SELECT k, CAST(r AS DOUBLE) AS r, CAST(g AS DOUBLE) AS g, CAST(b AS DOUBLE) AS b, CAST(0 AS BIGINT) AS had FROM pal)")
    for i in range(steps):
        parts.append(
            f"""h{i} AS MATERIALIZED (SELECT k, count(*) AS n, {", ".join(f"CAST(sum({c}) AS DOUBLE) AS {c}" for c in "rgb")} FROM
 (SELECT m.k, e.r, e.g, e.b FROM ev e, m{i} m, c WHERE e.ord // c.size = {i} QUALIFY row_number() OVER (PARTITION BY e.ord ORDER BY {_sed('e', 'm')}, m.k) = 1) GROUP BY 1)"""
        )
        moved = ", ".join(f"CASE WHEN h.n IS NULL THEN m.{c} ELSE m.{c} + CAST(h.n AS DOUBLE) / CAST(m.had + h.n AS DOUBLE) * (h.{c} / CAST(h.n AS DOUBLE) - m.{c}) END AS {c}" for c in "rgb")
        parts.append(f"m{i + 1} AS MATERIALIZED (SELECT m.k, {moved}, m.had + coalesce(h.n, 0) AS had FROM m{i} m LEFT JOIN h{i} h USING (k))")
    return ", ".join(parts) + f" SELECT k, {_tidy(dict.fromkeys('rgb', 6))}, had FROM m{steps}"


def oracle_sql() -> dict[str, str]:
    conflicts = f"""WITH_LAB AS (SELECT k, {_lab()} FROM pal), conf AS (SELECT p.k AS i, q.k AS j, sqrt({_sed('p', 'q', _LABS)}) AS delta_e
 FROM WITH_LAB p JOIN WITH_LAB q ON p.k < q.k)"""
    direct = f"WITH {EV}, {LINSPACE}, p0 AS MATERIALIZED (SELECT k, r, g, b FROM pal)"
    refine = f"{PAL}, p0 AS MATERIALIZED (SELECT k, r, g, b FROM pal)"
    by_length = "p0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY r * r + g * g + b * b, k) - 1 AS k, r, g, b FROM pal)"
    last = f"p{ITERATIONS}"
    even = "round_even({0} * 64.0 / greatest(w, h), 0)"
    floats = "col AS MATERIALIZED (SELECT row_number() OVER () AS id, * FROM (SELECT r, g, b, count(*) AS n FROM ev GROUP BY 1, 2, 3))"
    errors = " UNION ALL ".join(f"SELECT CAST({i} AS BIGINT) AS iter, e AS sum_sed, n FROM e{i}" for i in range(ITERATIONS))
    # iterations that a run with a stop makes: all until the first flag, that one included
    made = " + ".join(["1", *(f"CASE WHEN (SELECT f FROM f{i}) THEN 0 ELSE 1 END" for i in range(ITERATIONS - 1))])
    final = "CASE " + " ".join(f"WHEN it = {i + 1} THEN (SELECT e FROM e{i})" for i in range(ITERATIONS)) + " END"
    sql = {
        "scan_pixels": f"WITH {EV} SELECT * FROM ev",
        "image_stats": f"WITH {EV} SELECT count(*) AS n_pixels, max(x) + 1 AS width, max(y) + 1 AS height FROM ev",
        "decode_modes": "SELECT file, CAST(o AS BIGINT) AS ord, CAST(r AS BIGINT) AS r, CAST(g AS BIGINT) AS g, CAST(b AS BIGINT) AS b FROM (VALUES ('two.png', 0, 255, 0, 0), ('two.png', 1, 0, 255, 0), ('two.png', 2, 0, 0, 255), ('two.png', 3, 9, 8, 7), ('two.tiff', 0, 255, 0, 0), ('two.tiff', 1, 0, 255, 0), ('two.tiff', 2, 0, 0, 255), ('two.tiff', 3, 9, 8, 7), ('grey.png', 0, 40, 40, 40), ('grey.png', 1, 200, 200, 200), ('alpha.png', 0, 1, 2, 3)) AS t(file, o, r, g, b)",
        "dummy_source": "SELECT ord, CAST(200 AS BIGINT) AS r, CAST(0 AS BIGINT) AS g, CAST(0 AS BIGINT) AS b FROM range(10000) AS t(ord)",
        "cube_index": f"WITH {EV} SELECT ord, r * 16 // 256 AS rb, g * 16 // 256 AS gb, b * 16 // 256 AS bb FROM ev",
        "cube_histogram": f"WITH {EV}, {HIST} SELECT * FROM hist",
        "cube_candidates_floor": f"WITH {EV}, {HIST}, {CAND} SELECT * EXCLUDE (first_ord) FROM cand",
        "cube_candidates_round": f"WITH {EV}, {HIST} SELECT rb, gb, bb, " + ", ".join(f"CAST(round_even(sum_{c} / n, 0) AS BIGINT) AS {c}" for c in "rgb") + ", n FROM hist WHERE n >= 6",
        "most_frequent_cube": f"WITH {EV}, {HIST}, {CAND} SELECT CAST(0 AS BIGINT) AS k, r, g, b, n FROM cand ORDER BY n DESC, first_ord LIMIT 1",
        "greedy_palette": f"{PAL} SELECT * FROM pal",
        **{f"block_sample_{n}": f"WITH {EV} {_block(*v)}" for n, v in (("050", (2, 2)), ("025", (2, 1)), ("0125", (4, 2)), ("00625", (4, 1)), ("003125", (8, 2)))},
        "bernoulli_sample": f"WITH {EV} SELECT ord, r, g, b FROM ev WHERE {HASH} < 0.1 * 1000003",
        "plot_sample": f"WITH {EV} SELECT ord, r, g, b FROM ev ORDER BY {HASH}, ord LIMIT 500",
        "plot_relation": f"{PAL}, pts AS (SELECT 'pixel' AS kind, r, g, b FROM (SELECT * FROM ev ORDER BY {HASH}, ord LIMIT 500) UNION ALL SELECT 'palette', r, g, b FROM pal) SELECT kind, r, g, b, {LAB4} FROM (SELECT *, {_lab()} FROM pts)",
        "block_sample_rate": f"WITH {EV} SELECT CAST(0.125 AS DOUBLE) AS rate, (SELECT count(*) FROM ({_block(4, 2)})) AS n_sampled, count(*) AS n_total FROM ev",
        "init_linspace": f"WITH {EV}, {LINSPACE} SELECT * FROM pal",
        "sed_projection": f"WITH {EV} SELECT ord, (r - 128) * (r - 128) + (g - 128) * (g - 128) + (b - 128) * (b - 128) AS d FROM ev",
        "palette_norms": f"{PAL} SELECT row_number() OVER (ORDER BY len2, k) - 1 AS k, r, g, b, len2 FROM (SELECT *, r * r + g * g + b * b AS len2 FROM pal)",
        "assign_nearest": f"{PAL}, {NEAREST} SELECT ord, dk % 16 AS k, dk // 16 AS d FROM near",
        "cluster_means": f"{PAL}, {NEAREST} SELECT dk % 16 AS k, count(*) AS n, " + ", ".join(f"CAST(sum({c}) // count(*) AS BIGINT) AS {c}" for c in "rgb") + " FROM near GROUP BY 1",
        "quantize_rgb": f"{PAL}, {NEAREST} SELECT ord, x, y, p.r, p.g, p.b FROM near JOIN pal p ON p.k = dk % 16",
        "wu_lin_assign": f"{PAL}, {NEAREST} SELECT ord, dk // 16 AS d FROM near",
        "kmeans_rgb_int": f"{direct}, {_iterations('break', False)} SELECT k, r, g, b FROM {last}",
        "kmeans_rgb_seeded": f"WITH {EV}, {SEEDED}, p0 AS MATERIALIZED (SELECT k, r, g, b FROM pal), {_iterations('break', False)} SELECT k, r, g, b FROM {last}",
        "kmeans_rgb_noearly": f"{direct}, {_iterations('never', False)} SELECT k, r, g, b FROM {last}",
        "kmeans_refine_rgb": f"{refine}, {_iterations('update', True)} SELECT k, r, g, b FROM {last}",
        "kmeans_rgb_float": f"WITH {EV}, {LINSPACE}, {floats}, p0 AS MATERIALIZED (SELECT k, CAST(r AS DOUBLE) AS r, CAST(g AS DOUBLE) AS g, CAST(b AS DOUBLE) AS b FROM pal), {_float_iterations(('r', 'g', 'b'), 'break')} {_PALETTE_OUT}{last}",
        "kmeans_wulin": f"{PAL}, {by_length}, {_length_iterations()} SELECT k, r, g, b FROM {last}",
        "minibatch_seed_search": _seed_search(),
        "oversampled_start": f"WITH {EM}, {_starts(1)} SELECT k, r, g, b FROM start",
        "assign_large_palette": f"WITH {EV}, {HIST}, {CAND}, pal AS MATERIALIZED (SELECT row_number() OVER (ORDER BY n DESC, first_ord) - 1 AS k, r, g, b FROM (SELECT * FROM cand ORDER BY n DESC, first_ord LIMIT 256)) SELECT ord, dk % 256 AS k, dk // 256 AS d FROM (SELECT e.ord, min({_sed('e', 'p')} * 256 + p.k) AS dk FROM ev e, pal p GROUP BY 1)",
        "mse_per_iter": f"{direct}, {_iterations('never', False)} {errors}",
        "rgb_to_lab": f"WITH {EV} SELECT ord, {LAB4} FROM (SELECT ord, {_lab()} FROM ev)",
        "lab_roundtrip": f"WITH {EV}, lab AS (SELECT ord, {_lab()} FROM ev) SELECT ord, {_tidy(dict.fromkeys('rgb', 3))} FROM ({_rgb('lab')})",
        "assign_lab": f"{_LAB_START} SELECT ord, k FROM (SELECT e.ord, p.k, row_number() OVER (PARTITION BY e.ord ORDER BY {_sed('e', 'p', _LABS)}, p.k) AS rn FROM (SELECT ord, {_lab()} FROM ev) e, p0 p) WHERE rn = 1",
        "kmeans_lab": f"{_LAB_START}, {_float_iterations(_LABS, 'never')} {_PALETTE_OUT}({_rgb(last)})",
        "mse_per_iter_lab": f"{_LAB_START}, {_float_iterations(_LABS, 'never')}, whole AS (SELECT sum(n) AS n FROM col) " + " UNION ALL ".join(f"SELECT CAST({i} AS BIGINT) AS iter, round(e / whole.n, 4) + 0.0 AS mse_lab, CAST(whole.n AS BIGINT) AS n FROM e{i}, whole" for i in range(ITERATIONS)),
        "quantize_lab": f"{_LAB_START}, {_float_iterations(_LABS, 'never')}, fin AS ({_PALETTE_OUT}({_rgb(last)})) SELECT ord, f.r, f.g, f.b FROM (SELECT e.ord, p.k, row_number() OVER (PARTITION BY e.ord ORDER BY {_sed('e', 'p', _LABS)}, p.k) AS rn FROM (SELECT ord, {_lab()} FROM ev) e, {last} p) q JOIN fin f ON f.k = q.k WHERE rn = 1",
        "kmeans_refine_lab": f"WITH {EM}, {HIST}, {CAND}, {_greedy()}, col AS MATERIALIZED (SELECT row_number() OVER () AS id, * FROM (SELECT r, g, b, n, {_lab()} FROM (SELECT r, g, b, count(*) AS n FROM ev GROUP BY 1, 2, 3))), p0 AS MATERIALIZED (SELECT k, {_lab()} FROM pal), {_float_iterations(_LABS, 'update')} {_PALETTE_OUT}({_rgb(last)})",
        "palette_conflicts": f"{PAL}, {conflicts} SELECT i, j, round(delta_e, 4) + 0.0 AS delta_e FROM conf",
        "worst_conflict": f"{PAL}, {conflicts} SELECT i, j, round(delta_e, 4) + 0.0 AS delta_e FROM conf ORDER BY conf.delta_e, i, j LIMIT 1",
        "rgb_strip": f"SELECT i, r, g, b FROM ({_strips()}) WHERE strip = 1",
        "lab_strip": f"SELECT i, {LAB4} FROM ({_lab_strips()}) WHERE strip = 3",
        "strips_union": f"WITH ls AS ({_lab_strips()}) {_strips()} UNION ALL SELECT strip, i, {', '.join(f'CAST(floor(round({c}, 6)) AS BIGINT) AS {c}' for c in 'rgb')} FROM ({_rgb('ls')})",
        "strip_adjacent": f"WITH s AS (SELECT *, {_lab()} FROM ({_strips()})) " + _adjacent(f"{_sed('p', 'q')} AS d_rgb, round({_sed('p', 'q', _LABS)}, 4) + 0.0 AS d_lab", "s"),
        "strip_adjacent_lab": f"WITH s AS ({_lab_strips()}) " + _adjacent(f"round({_sed('p', 'q', _LABS)}, 4) + 0.0 AS d_lab", "s"),
        "swatch": f"{PAL} SELECT x, y, r, g, b FROM (SELECT id % {50 * K} AS x, id // {50 * K} AS y FROM range({50 * K * 50}) AS t(id)) JOIN pal ON pal.k = x // 50",
        "swatch_fixed": f"{PAL} SELECT x, y, coalesce(r, 0) AS r, coalesce(g, 0) AS g, coalesce(b, 0) AS b FROM (SELECT id % 160 AS x, id // 160 AS y FROM range(6400) AS t(id)) LEFT JOIN pal ON pal.k = x // {160 // K}",
        "chroma_circle": f"SELECT i, round(cos(i * {2 * math.pi / 199!r}) * 80.0, 6) + 0.0 AS a, round(sin(i * {2 * math.pi / 199!r}) * 80.0, 6) + 0.0 AS b_lab FROM range(200) AS t(i)",
        "lab_axes": "SELECT axis, CAST(l AS DOUBLE) AS l, CAST(0 AS DOUBLE) AS a, CAST(0 AS DOUBLE) AS b_lab, CAST(to_l AS DOUBLE) AS to_l, CAST(to_a AS DOUBLE) AS to_a, CAST(to_b AS DOUBLE) AS to_b FROM (VALUES ('L', 0, 100, 0, 0), ('+a', 50, 50, 90, 0), ('-a', 50, 50, -90, 0), ('+b', 50, 50, 0, 90), ('-b', 50, 50, 0, -90)) AS t(axis, l, to_l, to_a, to_b)",
        "reduction_report": f"WITH {EV}, s AS (SELECT max(x) + 1 AS w, max(y) + 1 AS h, CAST(count(*) AS DOUBLE) AS n FROM ev), d AS (SELECT n, CASE WHEN greatest(w, h) <= 64 THEN w * h ELSE {even.format('w')} * {even.format('h')} END AS m FROM s) SELECT 'base_pixels' AS metric, n AS value FROM d UNION ALL SELECT 'resized_pixels', CAST(m AS DOUBLE) FROM d UNION ALL SELECT 'reduction_ratio', round(n / m, 4) + 0.0 FROM d",
        "resize_dims": f"WITH {EV}, s AS (SELECT max(x) + 1 AS w, max(y) + 1 AS h FROM ev) SELECT CAST(64 AS BIGINT) AS cap, w, h, CAST(CASE WHEN greatest(w, h) <= 64 THEN w ELSE {even.format('w')} END AS BIGINT) AS new_w, CAST(CASE WHEN greatest(w, h) <= 64 THEN h ELSE {even.format('h')} END AS BIGINT) AS new_h FROM s UNION ALL SELECT 90, w, h, CAST(CASE WHEN greatest(w, h) <= 90 THEN w ELSE floor(w * (90.0 / greatest(w, h))) END AS BIGINT), CAST(CASE WHEN greatest(w, h) <= 90 THEN h ELSE floor(h * (90.0 / greatest(w, h))) END AS BIGINT) FROM s",
        "metrics_report": f"{direct}, {_iterations('break', False)}, run AS (SELECT {made} AS it) SELECT 'k' AS metric, (SELECT count(*) FROM {last}) AS value UNION ALL SELECT 'n_pixels', (SELECT n FROM e0) UNION ALL SELECT 'iterations', CAST(it AS BIGINT) FROM run UNION ALL SELECT 'final_sum_sed', {final} FROM run",
        "rate_sweep": _sweep(),
        "resize_bilinear": _resized(),
        "png_roundtrip": f"{PAL}, {NEAREST} SELECT ord, p.r, p.g, p.b FROM near JOIN pal p ON p.k = dk % 16",
        "quantize_report": f"{PAL}, {NEAREST} SELECT 'n_pixels' AS metric, count(*) AS value FROM near UNION ALL SELECT 'sum_sed', CAST(sum(dk // 16) AS BIGINT) FROM near UNION ALL SELECT 'colors_used', count(DISTINCT dk % 16) FROM near",
        "minibatch_stream": _ordered_minibatches(),
    }
    return sql
