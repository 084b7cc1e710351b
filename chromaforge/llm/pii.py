"""Surrogates for personal data and secrets.

Entities are found by patterns, and each gets a replacement derived from a secret key, its type and its value: an
address stays an address with its host, a number keeps its separators (and a valid check digit stays valid), a
dotted quad stays one, a secret keeps its alphabet, and a name after a form of address or an introduction keeps script,
letter case and the number of its words. One value gets one replacement everywhere (coreference): a number however it
is written, a given name whatever form of address stands before it, and the words of a document's names also where
they stand alone. A given name's gender is that of the forms of address which most mentions in the whole table have.

Replacements are computed where the text lies. Distinctness is checked over the whole table of distinct entities: a
replacement may neither be some real entity nor one that another entity has. An entity that loses tries again, with a
longer replacement after some attempts, so a format that is used up ends no run. Only such entities, and given names
that are met with several genders, are looked up when texts are rewritten; all others follow from the key.

Defined cases: null stays null; a text without an entity is returned unchanged; a value without a letter or digit is
no secret; values and texts may have any length; repeated rows, rows of one id and rows without an id are rewritten by
their text alone; an empty table gives an empty result; all columns of the input are kept, n_chars is brought up to
date where it exists; with report, an input column n_entities gives way to the new one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, let, materialize

#: Forms of address by gender.
ADDRESS = {
    "f": ["Mrs", "Ms", "Miss", "Mme", "Mlle", "Madame", "Frau", "Señora", "Sra", "Doña", "Г-жа", "Κυρία"],
    "m": ["Mr", "Mister", "Sir", "Monsieur", "Herr", "Señor", "Sr", "Don", "Г-н", "Κύριος"],
    "n": ["Dr", "Prof", "Professor", "Mx"],
}
#: Phrases that introduce a name.
INTRODUCTIONS = [
    "My name is", "my name is", "Mein Name ist", "mein Name ist", "Ich heiße", "ich heiße", "Je m'appelle", "je m'appelle",
    "Me llamo", "me llamo", "Mi nombre es", "mi nombre es",
]
_ANY_ADDRESS = "|".join(a for group in ADDRESS.values() for a in sorted(group, key=len, reverse=True))
_LEAD = rf"(?:(?:{_ANY_ADDRESS})\.?|{'|'.join(INTRODUCTIONS)}) "
_FIRST = "".join(sorted({a[0] for group in (*ADDRESS.values(), INTRODUCTIONS) for a in group}))
_B, _E = r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"
_WORD = r"\p{Lu}\p{L}+"
_KEYWORD = r"(?i:password|passwd|pwd|token|secret|api[_-]?key)\s*+[=:]\s*+[\"']?"

#: Patterns by type, tried in this order at each place. A group without an upper bound is repeated possessively: the
#: engine then loops, where it would else go one call deeper for each repeat and a long text would end the process.
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[\p{L}\p{N}-]++(?:\.[\p{L}\p{N}-]++)++",
    # a short look ahead first: the others are slow and would be tried at every place
    "secret": rf"(?=[pPtTsSaA]){_KEYWORD}(?=[_+/-]*+[A-Za-z0-9])[A-Za-z0-9_+/-]{{8,}}+(?!@)"
    rf"|AKIA(?<![\p{{L}}\p{{N}}_]AKIA)[0-9A-Z]{{16}}{_E}|(?=[0-9a-fA-F]{{32}}){_B}(?:[0-9a-f]{{32,}}+|[0-9A-F]{{32,}}+){_E}",
    "ip": rf"(?=\d)(?<![\d.])(?:\d{{1,3}}\.){{3}}\d{{1,3}}(?!\.?\d)",
    "iban": rf"(?=[A-Z]{{2}}\d){_B}[A-Z]{{2}}\d{{2}}(?: ?[A-Z0-9]{{4}}){{3,7}}(?: ?[A-Z0-9]{{1,3}})?{_E}",
    "card": r"(?=\d{4})(?<![\d.+-])\d{4}[ -]?\d{4}[ -]?\d{4}[ -]?\d{4}(?!\d)",
    "ssn": r"(?=\d)(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "phone": r"(?=[+(\d])(?:(?<![\d+])\+\d{1,3}[ .-]?(?:\(\d{1,5}\)|\d{1,5})(?:[ .-]?\d{2,4}){2,4}(?!\d|/\d)"
    r"|(?<![\d+])\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\d)|(?<![\d+.-])\d{3}[ .-]\d{3}[ .-]\d{4}(?!\d)|(?<![\d+./-])0\d{2,4}/\d{5,8}(?![\d/]))",
    # after the first name others may follow, of two words at least
    "name": rf"(?=[{_FIRST}]){_B}{_LEAD}{_WORD}(?:[ -]{_WORD}){{0,2}}"
    rf"(?: (?:and|und|et|y|&) (?!(?:{_ANY_ADDRESS})\b){_WORD}(?:[ -]{_WORD}){{1,2}})*+",
}
#: What a text must hold before the patterns are worth a try.
HINT = rf"[0-9@]|[=:]\s*+[\"']?[A-Za-z_+/-]{{8}}|(?=[{_FIRST}]){_B}{_LEAD}\p{{Lu}}"
_ALL = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: Types whose separators are no part of the value.
NUMBERS = ("iban", "card", "ssn", "phone")

#: Syllables of made-up names by script, and endings by script and gender.
SYLLABLES = {
    "latin": "ba be bi bo da de di do fa fe ga go ka ke ki ko la le li lo ma me mi mo na ne ni no pa pe ra re ri ro sa se ta te ti to va ve vi vo".split(),
    "cyrillic": "ба бе би бо да де ди до га го ка ке ки ко ла ле ли ло ма ме ми мо на не ни но па пе ра ре ри ро са се та те ти то ва ве ви во".split(),
    "greek": "βα βε βι βο δα δε δι δο γα γο κα κε κι κο λα λε λι λο μα με μι μο να νε νι νο πα πε ρα ρε ρι ρο σα σε τα τε τι το φα φε φι φο".split(),
}
ENDINGS = {
    "latin": {"f": "na", "m": "lo", "n": "ry", "s": "sen"},
    "cyrillic": {"f": "на", "m": "лр", "n": "ли", "s": "сон"},
    "greek": {"f": "να", "m": "νος", "n": "ρι", "s": "δης"},
}


def _type_of(value: Column) -> Column:
    """Type of a value that the patterns found: the first that fits the whole value."""
    cases = F.when(F.contains(value, F.lit("@")), F.lit("email"))
    cases = cases.when(value.rlike(f"^{_LEAD}"), F.lit("name"))
    for kind in ("ip", *NUMBERS):
        cases = cases.when(value.rlike(f"^(?:{PATTERNS[kind]})$"), F.lit(kind))
    return cases.otherwise(F.lit("secret"))


def _script(value: Column) -> Column:
    return (
        F.when(value.rlike(r"\p{IsCyrillic}"), "cyrillic").when(value.rlike(r"\p{IsGreek}"), "greek").otherwise("latin")
    )


def _gender(lead: Column) -> Column:
    address = F.regexp_replace(lead, r"\.? $", "")
    out = F.lit("n")
    for g in ("f", "m"):
        out = F.when(address.isin(ADDRESS[g]), g).otherwise(out)
    return out


def _lead(value: Column) -> Column:
    """What stands before the name in a found name."""
    return F.regexp_extract(value, f"^{_LEAD}", 0)


def _keyword(value: Column) -> Column:
    """What stands before the secret in a found secret."""
    return F.regexp_extract(value, f"^{_KEYWORD}", 0)


def parts(value: Column) -> Column:
    """The entities of a found value, as array<struct<type, value, gender>>: itself, or the words of its names.

    The last word of a name is a family name (type family), words before it are given names (type given), with the
    gender of the form of address. Addresses and names count in lower case, numbers without their separators.
    """

    def one(t: Column) -> Column:
        plain = (
            F.when(t == "email", F.lower(value))
            .when(t.isin(*NUMBERS), F.regexp_replace(value, "[^0-9A-Za-z+]", ""))
            .when(t == "secret", F.substr(value, F.length(_keyword(value)) + 1))
            .otherwise(value)
        )
        return F.array(F.struct(t.alias("type"), plain.alias("value"), F.lit(None).cast("string").alias("gender")))

    def names(lead: Column) -> Column:
        rest = F.substr(value, F.length(lead) + 1)
        pattern = rf"({_WORD})([ -](?=\p{{Lu}}))?"
        return F.zip_with(
            F.regexp_extract_all(rest, F.lit(pattern), F.lit(1)),
            F.regexp_extract_all(rest, F.lit(pattern), F.lit(2)),
            lambda w, more: F.struct(
                F.when(more == "", "family").otherwise("given").alias("type"),
                F.lower(w).alias("value"),
                F.when(more != "", _gender(lead)).alias("gender"),
            ),
        )

    return let(_type_of(value), lambda t: F.when(t == "name", let(_lead(value), names)).otherwise(one(t)))


def _byte(pairs: Column, i: Column | int) -> Column:
    """Byte i of an array of hexadecimal pairs, as int."""
    return F.conv(F.get(pairs, F.lit(i) if isinstance(i, int) else i), 16, 10).cast("int")


def _pick(alphabet: str, b: Column) -> Column:
    return F.substr(F.lit(alphabet), (b % len(alphabet) + 1).cast("int"), F.lit(1))


_DIGITS, _LOWER = "0123456789", "abcdefghijklmnopqrstuvwxyz"


def _like(value: Column, pairs: Column, fixed: int | Column = 0, digits_only: bool = False) -> Column:
    """value with each digit and letter from position fixed on replaced by a keyed one of its own kind."""

    def one(c: Column, i: Column) -> Column:
        out = F.when(i < fixed, c).when(c.between("0", "9"), _pick(_DIGITS, _byte(pairs, i)))
        if not digits_only:
            out = out.when(c.between("a", "z"), _pick(_LOWER, _byte(pairs, i)))
            out = out.when(c.between("A", "Z"), _pick(_LOWER.upper(), _byte(pairs, i)))
            # other letters (with accents, of other scripts) give way to the plain lower-case ones
            out = out.when(c.rlike(r"^\p{L}$"), _pick(_LOWER, _byte(pairs, i)))
        return out.otherwise(c)

    return F.array_join(F.transform(F.split(value, ""), one), "")


def _luhn(value: Column) -> Column:
    """Sum of the Luhn check over the digits of value, by 10 (0: valid)."""
    digits = F.reverse(F.split(F.regexp_replace(value, "[^0-9]", ""), ""))
    terms = F.transform(
        digits,
        lambda c, i: let(
            c.cast("int"),
            lambda d: F.when(i % 2 == 0, d).when(d > 4, 2 * d - 9).otherwise(2 * d),
        ),
    )
    return F.aggregate(terms, F.lit(0), lambda a, d: a + d) % 10


def _mod97(value: Column) -> Column:
    """An account number by 97, its first four characters last and letters as numbers from 10 on (1: valid)."""
    moved = F.split(F.concat(F.substr(value, F.lit(5)), F.substr(value, F.lit(1), F.lit(4))), "")

    def take(a: Column, c: Column) -> Column:
        return F.when(c.between("0", "9"), a * 10 + c.cast("int")).otherwise(a * 100 + F.ascii(c) - 55) % 97

    return F.aggregate(moved, F.lit(0), take)


def _made_name(kind: Column, value: Column, gender: Column, pairs: Column, attempt: Column) -> Column:
    """A name word of the same script and gender; more syllables with more attempts."""

    def stem_of(syllables: list[str]) -> Column:
        pool = F.array(*map(F.lit, syllables))
        places = F.sequence(F.lit(0), F.lit(2) + F.floor(attempt / 4).cast("int"))
        return F.array_join(F.transform(places, lambda i: F.get(pool, _byte(pairs, i % 64) % len(syllables))), "")

    out = F.lit(None).cast("string")
    for script, syllables in SYLLABLES.items():
        ending = F.lit(ENDINGS[script]["n"])
        for g in "fm":
            ending = F.when(gender == g, F.lit(ENDINGS[script][g])).otherwise(ending)
        ending = F.when(kind == "family", F.lit(ENDINGS[script]["s"])).otherwise(ending)
        out = F.when(_script(value) == script, F.concat(stem_of(syllables), ending)).otherwise(out)
    return out


def surrogate(kind: Column, value: Column, gender: Column, key: str, attempt: Column) -> Column:
    """The replacement of one entity: a pure function of key, type, value, gender (of given names) and attempt."""
    base = F.concat_ws("\u0001", F.lit(key), kind, value, attempt.cast("string"))
    # 64 bytes for every 64 characters of the value, and as many for what is added to it; the value is hashed once
    blocks = F.sequence(F.lit(0), F.floor(F.length(value) / 64).cast("int") + 1)
    hashes = let(F.sha2(base, 512), lambda seed: F.transform(blocks, lambda b: F.sha2(F.concat_ws("\u0001", seed, b), 512)))

    def build(hexadecimal: Column, s: Column) -> Column:
        def longer(alphabet: str, after: int) -> Column:
            """One character more with every few attempts, so that no format is ever used up."""
            places = F.sequence(F.lit(1), F.floor(attempt / after).cast("int"))
            more = F.array_join(F.transform(places, lambda i: _pick(alphabet, _byte(s, F.size(s) - 1 - i % 64))), "")
            return F.when(attempt >= after, more).otherwise("")

        local, host = F.substring_index(value, "@", 1), F.substring_index(value, "@", -1)
        safe_host = F.when(host.rlike(r"(^|\.)example\.[a-z]+$"), host).otherwise(F.lit("mail.example.com"))
        email = F.concat(_like(local, s), longer(_LOWER, 4), F.lit("@"), safe_host)
        quad = F.array_join(
            F.transform(F.split(value, r"\."), lambda p, i: F.when(i == 0, _byte(s, i) % 223 + 1).otherwise(_byte(s, i)).cast("string")),
            ".",
        )
        wider = F.concat(F.lit("2001:db8::"), F.substring(hexadecimal, 1, 4), F.lit(":"), F.substring(hexadecimal, 5, 4))
        number = F.concat(_like(value, s, digits_only=True), longer(_DIGITS, 8))
        valid = let(
            F.concat(F.substr(number, F.lit(1), F.length(number) - 1), F.lit("0")),
            lambda x: F.concat(
                F.substr(x, F.lit(1), F.length(x) - 1), ((F.lit(10) - _luhn(x)) % 10).cast("string")
            ),
        )
        account = F.concat(_like(value, s, fixed=F.lit(2)), longer(_DIGITS, 8))
        checked = let(
            F.concat(F.substr(account, F.lit(1), F.lit(2)), F.lit("00"), F.substr(account, F.lit(5))),
            lambda x: F.concat(F.substr(x, F.lit(1), F.lit(2)), F.lpad((F.lit(98) - _mod97(x)).cast("string"), 2, "0"), F.substr(x, F.lit(5))),
        )
        as_hex = F.substr(hexadecimal, F.lit(1), F.length(value) + F.floor(attempt / 8).cast("int"))
        secret = (
            F.when(value.startswith("AKIA"), F.concat(F.lit("AKIA"), _like(F.substr(value, F.lit(5)), s), longer(_LOWER.upper(), 8)))
            .when(value.rlike("^[0-9a-f]{32,}$"), as_hex)
            .when(value.rlike("^[0-9A-F]{32,}$"), F.upper(as_hex))
            .otherwise(F.concat(_like(value, s), longer(_LOWER, 4)))
        )
        return (
            F.when(kind == "email", email)
            .when(kind == "ip", F.when(attempt < 16, quad).otherwise(wider))
            .when(kind == "card", F.when(_luhn(value) == 0, valid).otherwise(number))
            # a country code's first digit stays
            .when(kind == "phone", F.concat(_like(value, s, F.when(value.startswith("+"), 2).otherwise(0), True), longer(_DIGITS, 8)))
            .when(kind == "ssn", number)
            .when(kind == "iban", F.when(_mod97(value) == 1, checked).otherwise(account))
            .when(kind.isin("given", "family"), _made_name(kind, value, gender, s, attempt))
            .otherwise(secret)
        )

    return let(F.array_join(hashes, ""), lambda h: let(F.regexp_extract_all(h, F.lit(".."), F.lit(0)), lambda s: build(h, s)))


def found(text: Column) -> Column:
    """Values that the patterns find in text, in order."""
    return F.regexp_extract_all(text, F.lit(_ALL), F.lit(0))


def entities(docs: DataFrame) -> DataFrame:
    """Distinct (type, value) of docs (doc_id, text), with the gender that holds for it, and whether others were met."""
    hinted = docs.filter(F.col("text").rlike(HINT))
    values = hinted.select(F.explode(F.array_distinct(found(F.col("text")))).alias("v")).distinct()
    met = values.select(F.inline(parts(F.col("v"))))
    count = lambda g: F.count(F.when(F.col("gender") == g, 1))
    known = met.groupBy("type", "value").agg(*(count(g).alias(g) for g in "fmn"))
    gender = F.when(F.col("f") > F.col("m"), "f").when(F.col("m") > F.col("f"), "m").otherwise("n")
    several = sum(((F.col(g) > 0).cast("int") for g in "fmn"), F.lit(0)) > 1
    return known.select("type", "value", F.when(F.col("type") == "given", gender).alias("gender"), several.alias("several"))


def retried(known: DataFrame, key: str) -> DataFrame | None:
    """type, value, gender and attempt of entities whose first replacement collides; known is the table of entities.

    Of those that want one replacement the smallest gets it. Every round is a join on the replacement, so no task
    sees more than the entities that share one. Replacements grow with the attempts, so the rounds end.
    """
    real = known.select("value").distinct()
    taken: DataFrame | None = None
    late: DataFrame | None = None
    attempt = 0
    pending = known.select("type", "value", "gender", F.lit(0).alias("attempt"))
    while True:
        new = surrogate(F.col("type"), F.col("value"), F.col("gender"), key, F.col("attempt"))
        wanted = materialize(pending.withColumn("new", new), "wanted")
        free = wanted.join(real.withColumnRenamed("value", "new"), "new", "left_anti")
        if taken is not None:
            free = free.join(taken, "new", "left_anti")
        best = free.groupBy("new").agg(F.min(F.struct("type", "value", "gender")).alias("w"))
        won = materialize(best.select("new", "w.type", "w.value", "w.gender"), "won")
        taken = won.select("new") if taken is None else taken.unionByName(won.select("new"))
        lost = wanted.join(won.select("type", "value"), ["type", "value"], "left_anti")
        if attempt:
            settled = won.select("type", "value", "gender", F.lit(attempt).alias("attempt"))
            late = settled if late is None else late.unionByName(settled)
        attempt += 1
        pending = materialize(lost.select("type", "value", "gender", F.lit(attempt).alias("attempt")), "pending")
        discard(wanted)
        if not pending.limit(1).count():
            return late


def _into(mention: Column, new: Column) -> Column:
    """The digits and letters of new, with the separators of mention."""
    each = F.split(F.regexp_replace(new, "[^0-9A-Za-z]", ""), "")
    after = F.regexp_extract_all(mention, F.lit("[0-9A-Za-z]([^0-9A-Za-z]*)"), F.lit(1))
    before = F.regexp_extract(mention, "^[^0-9A-Za-z]*", 0)
    return F.concat(before, F.array_join(F.zip_with(each, after, lambda c, x: F.concat(c, F.coalesce(x, F.lit("")))), ""))


def _rewritten(text: Column, key: str, late: Column | None) -> Column:
    """struct<text, n_entities> with all entities replaced; late is a map from type and value to attempt and gender."""

    def replacement(e: Column) -> Column:
        attempt, gender = F.lit(0), e["gender"]
        if late is not None:
            known = F.element_at(late, F.concat_ws("\u0001", e["type"], e["value"]))
            attempt, gender = F.coalesce(known["attempt"], F.lit(0)), F.coalesce(known["gender"], gender)
        return let(attempt, lambda a: surrogate(e["type"], e["value"], gender, key, a))

    def case_like(new: Column, old: Column) -> Column:
        return F.when((old == F.upper(old)) & (old != F.lower(old)), F.upper(new)).otherwise(new)

    def name_like(new: Column, old: Column) -> Column:
        return F.when(old == F.upper(old), F.upper(new)).otherwise(F.initcap(new))

    def filled(value: Column, news: Column) -> Column:
        """value with its name words, one after the other, replaced by news."""
        words, gaps = F.regexp_extract_all(value, F.lit(_WORD), F.lit(0)), F.split(value, _WORD)
        named = F.zip_with(news, words, name_like)
        return F.array_join(F.zip_with(gaps, named, lambda gap, w: F.concat(gap, F.coalesce(w, F.lit("")))), "")

    def one(value: Column, es: Column) -> Column:
        first = es[0]["type"]

        def plain(n: Column) -> Column:
            return (
                F.when(first == "email", case_like(n, value))
                .when(first.isin(*NUMBERS), _into(value, n))
                .when(first == "secret", F.concat(_keyword(value), n))
                .otherwise(n)
            )

        named = let(_lead(value), lambda x: F.concat(x, filled(F.substr(value, F.length(x) + 1), F.transform(es, replacement))))
        return F.when(first.isin("given", "family"), named).otherwise(let(replacement(es[0]), plain))

    def alone(gap: Column, names: Column, news: Column) -> Column:
        """gap with the words of the text's names replaced where they stand alone."""

        def word(w: Column) -> Column:
            at = F.array_position(names, F.lower(w)).cast("int")
            return F.when(at > 0, name_like(F.get(news, at - 1), w)).otherwise(w)

        words = F.transform(F.regexp_extract_all(gap, F.lit(rf"{_B}{_WORD}{_E}"), F.lit(0)), word)
        gaps = F.split(gap, rf"{_B}{_WORD}{_E}")
        return F.array_join(F.zip_with(gaps, words, lambda g, w: F.concat(g, F.coalesce(w, F.lit("")))), "")

    def write(m: Column, es: Column) -> Column:
        names = F.filter(F.flatten(es), lambda e: e["type"].isin("given", "family"))
        done = F.zip_with(m, es, one)
        join = lambda gaps: F.array_join(F.zip_with(gaps, done, lambda g, v: F.concat(g, F.coalesce(v, F.lit("")))), "")
        gaps = F.split(text, _ALL)
        with_names = let(
            F.array_distinct(names),
            lambda own: let(
                F.transform(own, replacement),
                lambda news: join(F.transform(gaps, lambda g: alone(g, F.transform(own, lambda e: e["value"]), news))),
            ),
        )
        return F.struct(
            F.when(F.size(names) > 0, with_names).otherwise(join(gaps)).alias("text"), F.size(m).cast("long").alias("n_entities")
        )

    unchanged = F.struct(text.alias("text"), F.lit(0).cast("long").alias("n_entities"))
    return let(
        found(text),
        lambda m: F.when(F.size(m) == 0, unchanged).otherwise(let(F.transform(m, parts), lambda es: write(m, es))),
    )


def replace(
    docs: DataFrame,
    key: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    report: bool = False,
    few_bytes: int = 32 << 20,
) -> DataFrame:
    """docs with surrogates in place of entities; with report, also n_entities (places that the patterns found).

    few_bytes bounds what is broadcast; larger tables are joined by a shuffle.
    """
    docs = docs.drop("n_entities") if report else docs
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    known = materialize(entities(slim), "entities")
    late = retried(known, key)
    special = known.filter("several").select("type", "value", "gender", F.lit(0).alias("attempt"))
    if late is not None:
        special = late.unionByName(special.join(late.select("type", "value"), ["type", "value"], "left_anti"))
    special = materialize(special, "special-entities")
    name = F.concat_ws("\u0001", F.col("type"), F.col("value"))
    size = special.agg(F.sum(F.octet_length(name) + 64)).first()[0]
    has = F.coalesce(F.col(text_col).rlike(HINT), F.lit(False))
    text_hash = F.xxhash64(F.col(text_col))
    packed = docs.select(F.struct("*").alias("_row"), F.col(text_col).alias("_text"), text_hash.alias("_hash"), has.alias("_has"))
    entries = None
    if size:
        # only texts that hold such an entity get a map of theirs
        hinted = slim.filter(F.col("text").rlike(HINT)).select(F.xxhash64("text").alias("_of"), "text")
        own = hinted.select("_of", F.explode(F.array_distinct(found(F.col("text")))).alias("v"))
        own = own.select("_of", F.inline(parts(F.col("v")))).select("_of", "type", "value").distinct()
        own = own.join(F.broadcast(special) if size <= few_bytes else special, ["type", "value"])
        entry = F.struct(name.alias("n"), F.struct("attempt", "gender").alias("e"))
        maps = own.groupBy("_of").agg(F.map_from_entries(F.collect_set(entry)).alias("_late"))
        maps = materialize(maps, "special-maps")
        held = maps.agg(F.sum(F.size("_late") * 128 + F.octet_length(F.array_join(F.map_keys("_late"), "")))).first()[0] or 0
        packed = packed.join(F.broadcast(maps) if held <= few_bytes else maps, F.col("_hash") == F.col("_of"), "left")
        entries = F.col("_late")
    unchanged = F.struct(F.col("_text").alias("text"), F.lit(0).cast("long").alias("n_entities"))
    new = F.when(F.col("_has"), _rewritten(F.col("_text"), key, entries)).otherwise(unchanged)
    done = packed.select("_row", F.inline(F.array(new)))
    chars = F.coalesce(F.length("text"), F.lit(0))
    columns = [
        F.col("text").alias(c)
        if c == text_col
        else chars.cast(docs.schema[c].dataType).alias(c)
        if c == "n_chars"
        else F.col("_row")[c].alias(c)
        for c in docs.columns
    ]
    return done.select(*columns, *([F.col("n_entities")] if report else []))
