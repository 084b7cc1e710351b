"""Repair of conversation structure: the cheapest edits that make turns follow the grammar ``(system? (user assistant)+)?``.

Each conversation is a lattice of nodes (turn index, grammar state), never written out: keeping a turn costs 0, giving
it the role that must come next 2, deleting it 3, inserting an empty turn 2, and a truncated turn that stays 1 more.
Blank turns and repeats of an earlier one must go. Dijkstra's search with the key (cost, audit), where the audit is the
initials of the edits, stops at the first accepting end node that it takes from the queue: the cheapest edits, and of
equally cheap ones those whose audit is least. Two paths to one node at the same cost are never a prefix of each other,
so the key is right to compare paths on the way. After a state only one of user and assistant can follow, so an audit
names the repaired turns in full.

Conversations of up to ``rows`` turns and ``size`` bytes are dealt by id and repaired one by one as they stream past:
one shuffle. Longer ones never meet in one task: equal rows are counted, first occurrences joined back, the rest dealt
by ranges of (conversation, turn) and cut into blocks. A block is searched from every state to every state; blocks are
then put together, 64 at a time, which gives the same edits because costs add up and audits are joined. Only the hash
of a long repaired conversation is made by one task, block by block, since that hash can't be put together.

Defined cases: turns go by turn number, nulls first, then role and text; a null role or text is one space, so a null
text is blank, and a role whose first letter is not s, u or a can't be kept; all rows of a null id are one conversation;
a conversation without rows keeps its id, with zeros and an empty audit; an empty table gives an empty result; other
columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterable, Iterator
from typing import Any, NamedTuple

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import GAP_CHARS, discard, map_arrow, materialize

#: Turns and bytes up to which a conversation, or a block of a longer one, is searched in one go.
ROWS, BYTES = 4_096, 64 << 20
#: Grammar states: nothing yet, after system, after user, after assistant; the role that may follow besides system.
START, SYSTEM, USER, ASSISTANT = range(4)
FOLLOWS = ("u", "u", "a", "u")
AFTER = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
NAMES = {"u": "user", "a": "assistant"}
ACCEPTING = (START, ASSISTANT)
LEGAL = {"su", "ua", "au"}
#: Blocks put together at a time.
FAN = 64

COUNTS = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


class Turn(NamedTuple):
    """A row and its copies beside it; fault: blank, duplicate, truncated or empty."""

    role: str
    text: str
    fault: str
    copies: int


def fault(text: str, seen: bool) -> str:
    core = text.rstrip(GAP_CHARS)
    if not core:
        return "blank"
    return "duplicate" if seen else "" if core[-1] in ".!?" else "truncated"


def search(turns: list[Turn], start: int = START, ends: Iterable[int] = ACCEPTING, first: bool = True) -> dict[int, tuple[int, str]]:
    """(cost, audit) of the cheapest edits from start to the ends: of the first one reached, or of all."""
    ends = set(ends)
    queue, done, found = [(0, "", 0, start)], set(), {}
    while queue:
        cost, audit, i, state = heapq.heappop(queue)
        if (i, state) in done:
            continue
        done.add((i, state))
        if i == len(turns) and state in ends:
            found[state] = (cost, audit)
            if first or len(found) == len(ends):
                break
        then = AFTER[FOLLOWS[state]]
        heapq.heappush(queue, (cost + 2, audit + "I", i, then))
        if i == len(turns):
            continue
        turn = turns[i]
        heapq.heappush(queue, (cost + 3 * turn.copies, audit + "D" * turn.copies, i + 1, state))
        if turn.fault not in ("blank", "duplicate"):
            cost += (turn.fault == "truncated") + 3 * (turn.copies - 1)  # copies are duplicates
            copies, initial = "D" * (turn.copies - 1), turn.role[:1]
            if initial == FOLLOWS[state] or initial == "s" and state == START:
                heapq.heappush(queue, (cost, audit + "K" + copies, i + 1, AFTER[initial]))
            heapq.heappush(queue, (cost + 2, audit + "R" + copies, i + 1, then))
    return found


def apply(turns: list[Turn], audit: str, state: int = START) -> Iterator[tuple[str, str, str]]:
    """(role, text, edit) of the turns that the edits leave."""
    rows = iter([(t.role, t.text) for t in turns for _ in range(t.copies)])
    for edit in audit:
        role, text = next(rows) if edit != "I" else ("", "")
        if edit == "D":
            continue
        role = role if edit == "K" else NAMES[FOLLOWS[state]]
        state = AFTER[role[:1]]
        yield role, text, edit


class Tally:
    """Faults of turns that come in order; two of neighbouring parts can be added."""

    FIELDS = ("blank", "duplicate", "truncated", "illegal", "turns", "low", "high", "first", "last")

    def __init__(self, values: Iterable[Any] = (0, 0, 0, 0, 0, None, None, None, None)) -> None:
        self.__dict__.update(zip(self.FIELDS, values, strict=True))

    def add(self, number: Any, turn: Turn) -> None:
        blank, duplicate, truncated = (turn.fault == kind for kind in ("blank", "duplicate", "truncated"))
        self.blank += turn.copies * blank
        self.duplicate += turn.copies * duplicate or (turn.copies - 1) * (not blank)  # copies of other turns are duplicates
        self.truncated += truncated
        role = turn.role[:1]
        self.extend(Tally((0, 0, 0, turn.copies - 1, int(number is not None), number, number, role, role)))

    def extend(self, other: Tally) -> None:
        if other.first is None:
            return
        for kind in ("blank", "duplicate", "truncated", "illegal"):
            self.__dict__[kind] += other.__dict__[kind]
        if self.first is not None:
            self.illegal += self.last + other.first not in LEGAL
        self.turns += other.turns - (self.high is not None and self.high == other.low)
        self.low = other.low if self.low is None else self.low
        self.high = self.high if other.high is None else other.high
        self.first = other.first if self.first is None else self.first
        self.last = other.last

    def values(self) -> tuple:
        return tuple(self.__dict__[f] for f in self.FIELDS)

    def counts(self) -> tuple[int, ...]:
        """gaps, blank, duplicate, truncated, illegal."""
        gaps = 0 if self.low is None else int(self.high - self.low + 1 - self.turns)
        return gaps, self.blank, self.duplicate, self.truncated, self.illegal


class Digest:
    """Hash of repaired turns, fed in order."""

    def __init__(self) -> None:
        self.hash, self.any = hashlib.sha256(), False

    def add(self, rows: Iterable[tuple[str, str, str]]) -> None:
        for role, text, _ in rows:
            self.hash.update(f"{chr(10) if self.any else ''}{role}:{text}".encode("utf-8", "surrogatepass"))
            self.any = True


def prepare(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, turn, role, text, copies) as the functions below take it; nulls of role and text become one space."""
    held = [F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(n) for c, n in ((role, "role"), (text, "text"))]
    return rows.select(F.col(conv).alias("conv"), F.col(turn).cast("long").alias("turn"), *held, F.lit(1).cast("long").alias("copies"))


def damage(rows: DataFrame) -> DataFrame:
    """Prepared rows with faults by the hash of their place; dropped rows keep their conversation, with 0 copies."""
    place = F.concat_ws(":", F.coalesce(F.col("conv").cast("string"), F.lit(" ")), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    kind = F.crc32(place) % 20
    text: Column = F.when(kind == 1, "").when(kind == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.when(kind == 0, 0).when(kind == 3, 2).otherwise(F.col("copies")).cast("long")
    return rows.select("conv", "turn", F.when(kind == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), copies.alias("copies"))


def _order() -> list[Column]:
    return [F.col("conv").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role").asc(), F.col("text").asc()]


def _by_conversation(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Any, list[tuple]]]:
    """(conv, rows after it) of rows sorted by conversation."""
    key, rows, any_row = None, [], False
    for batch in batches:
        for conv, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if any_row and conv != key:
                yield key, rows
                rows = []
            key, any_row = conv, True
            rows.append(tuple(row))
    if any_row:
        yield key, rows


def _turns(rows: list[tuple]) -> tuple[list[Turn], Tally]:
    """Turns and tally of a conversation's (turn, role, text, copies)."""
    seen, turns, tally = set(), [], Tally()
    for number, role, text, copies in rows:
        if copies:
            turn = Turn(role, text, fault(text, (role, text) in seen), copies)
            seen.add((role, text))
            turns.append(turn)
            tally.add(number, turn)
    return turns, tally


def _batch(rows: list[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _whole(rows: DataFrame, schema: T.StructType, each: Any) -> DataFrame:
    """each(conv, turns, tally) -> rows, over all conversations as a stream."""
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, size = [], 0
        for conv, group in _by_conversation(batches):
            made += each(conv, *_turns(group))
            size += sum(len(r[2]) for r in group)
            if len(made) >= 1000 or size > 4 << 20:
                yield from _batch(made, arrow)
                made, size = [], 0
        yield from _batch(made, arrow)

    dealt = rows.select("conv", "turn", "role", "text", "copies").repartition("conv").sortWithinPartitions(*_order())
    return map_arrow(dealt, run, schema)


def _split(rows: DataFrame, most: int, size: int) -> tuple[DataFrame, DataFrame | None]:
    """rows of conversations within the bounds, and those of longer ones (None where there are none)."""
    long = rows.groupBy("conv").agg(F.sum(F.greatest("copies", F.lit(1))).alias("n"), F.sum(F.octet_length("text")).alias("size"))
    long = materialize(long.filter((F.col("n") > most) | (F.col("size") > size)).select(F.col("conv").alias("_long")), "long")
    if not long.head(1):
        return rows, None
    same = F.col("conv").eqNullSafe(F.col("_long"))
    return rows.join(long, same, "left_anti"), rows.join(long, same, "left_semi")


#: Of a block: its tally, and the cheapest edits from each state a to each state b; via: states between joined blocks.
_PART = f"tally struct<{', '.join(f'{x}:{k}' for x, k in zip(Tally.FIELDS, ['long'] * 7 + ['string'] * 2, strict=True))}>"
_PART += ", ways array<struct<a:int,b:int,cost:long,audit:string,via:string>>"


def _blocks(rows: DataFrame, most: int, size: int) -> DataFrame:
    """(conv, block, tally, ways, turns) of long conversations; blocks ascend in the order of turns."""
    known = ["conv", "turn", "role", "text"]
    there = rows.filter("copies > 0").groupBy(*known).agg(F.sum("copies").alias("copies"))
    same = F.sha2(F.concat_ws(":", F.length("role").cast("string"), "role", "text"), 256)
    there = materialize(there.withColumn("same", same), "turns")
    first = there.groupBy("conv", "same").agg(F.min(F.struct(F.col("turn").isNotNull().alias("has"), "turn")).alias("first"))
    first = first.select(F.col("conv").alias("_conv"), F.col("same").alias("_same"), F.col("first.turn").alias("_turn"))
    on = F.col("conv").eqNullSafe(F.col("_conv")) & (F.col("same") == F.col("_same"))
    flagged = there.join(first, on).select(*known, "copies", (~F.col("turn").eqNullSafe(F.col("_turn"))).alias("seen"))
    # rows of one turn stand by role and text, so the first of them in one turn is known, too
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = flagged.repartitionByRange(tasks, *_order()).sortWithinPartitions(*_order())
    fields = T.StructType.fromDDL(f"block long, {_PART}, turns array<struct<role:string,text:string,fault:string,copies:long>>")
    schema = T.StructType([T.StructField("conv", rows.schema["conv"].dataType), *fields])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId() << 32
        key, turns, tally, held = None, [], Tally(), 0

        def close() -> pa.RecordBatch:
            ways = [
                {"a": a, "b": b, "cost": cost, "audit": audit, "via": ""}
                for a in range(4)
                for b, (cost, audit) in search(turns, a, range(4), first=False).items()
            ]
            row = {"conv": key, "block": at, "tally": vars(tally), "ways": ways, "turns": [t._asdict() for t in turns]}
            return pa.RecordBatch.from_pylist([row], arrow)

        for batch in batches:
            for conv, number, role, text, copies, seen in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if turns and (conv != key or len(turns) >= most or held >= size):
                    yield close()
                    at, turns, tally, held = at + 1, [], Tally(), 0
                key = conv
                turns.append(Turn(role, text, fault(text, seen), copies))
                tally.add(number, turns[-1])
                held += len(text)
        if turns:
            yield close()

    blocks = materialize(map_arrow(dealt, run, schema), "blocks")
    discard(there)
    return blocks


def join_ways(left: list[dict], right: list[dict]) -> list[dict]:
    """The cheapest edits through two neighbouring parts."""
    best: dict[tuple[int, int], tuple] = {}
    for p in left:
        for q in right:
            if p["b"] == q["a"]:
                ends = (p["a"], q["b"])
                cost = p["cost"] + q["cost"]
                if ends in best and best[ends][0] < cost:
                    continue
                way = (cost, p["audit"] + q["audit"], f"{p['via']}{p['b']}{q['via']}")
                best[ends] = min(best.get(ends, way), way)
    return [{"a": a, "b": b, "cost": c, "audit": audit, "via": via} for (a, b), (c, audit, via) in best.items()]


def _assembled(blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(first, tally, cost, audit) of each conversation, named by its first block, and (first, seq, block, a) of its blocks."""
    w = Window.partitionBy("conv")
    named = blocks.select("block", F.min("block").over(w).alias("first"), (F.row_number().over(w.orderBy("block")) - 1).cast("long").alias("seq"))
    named = materialize(named, "block-names")  # a row a block
    parts = blocks.select("block", "tally", "ways").join(named, "block").select("first", "seq", "tally", "ways")
    schema = f"first long, seq long, {_PART}"
    arrow = to_arrow_schema(T.StructType.fromDDL(schema))

    def combine(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["seq"])
        tally, ways = Tally(), None
        for r in rows:
            tally.extend(Tally(r["tally"][f] for f in Tally.FIELDS))
            ways = r["ways"] if ways is None else join_ways(ways, r["ways"])
        row = {"first": rows[0]["first"], "seq": rows[0]["seq"] // FAN, "tally": vars(tally), "ways": ways}
        return pa.Table.from_pylist([row], arrow)

    done = False
    while not done:
        before, parts = parts, materialize(parts.groupBy("first", F.expr(f"seq div {FAN}").alias("_group")).applyInArrow(combine, schema), "parts")
        discard(before)
        done = not parts.filter("seq > 0").head(1)
    accepted = F.filter("ways", lambda x: (x["a"] == START) & x["b"].isin(*ACCEPTING))
    best = F.array_min(F.transform(accepted, lambda x: F.struct(x["cost"], x["audit"], x["b"], x["via"])))
    whole = parts.select("first", "tally", best.alias("best")).select("first", "tally", "best.*")
    enters = F.split(F.concat(F.lit(str(START)), "via"), "")
    entered = whole.select("first", F.posexplode(enters).alias("seq", "a"))
    entered = entered.select("first", F.col("seq").cast("long").alias("seq"), F.col("a").cast("int").alias("a"))
    return whole, named.join(entered, ["first", "seq"])


def _long_turns(blocks: DataFrame, entered: DataFrame, whole: DataFrame) -> DataFrame:
    """(conv, first, seq, a, audit, turns): what is done to each block of long conversations."""
    w = Window.partitionBy("first").orderBy("seq")
    ends = entered.join(whole.select("first", F.col("b").alias("_last")), "first")
    ends = ends.select("first", "seq", "block", "a", F.coalesce(F.lead("a").over(w), "_last").alias("b"))
    done = blocks.join(ends, "block")
    way = F.filter("ways", lambda x: (x["a"] == F.col("a")) & (x["b"] == F.col("b")))
    return done.select("conv", "first", "seq", "a", F.get(way, F.lit(0))["audit"].alias("audit"), "turns")


def _edits(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Any, int, int, Iterator[tuple[str, str, str]]]]:
    """(conv, first, seq, repaired turns) of rows (conv, first, seq, a, audit, turns)."""
    for batch in batches:
        for conv, first, seq, a, audit, turns in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            yield conv, first, seq, apply([Turn(**t) for t in turns], audit, a)


def digests(rows: DataFrame, most: int = ROWS, size: int = BYTES) -> DataFrame:
    """conv, counts of faults, cost, audit and hash of the repaired turns of every conversation of prepared rows."""
    conv = T.StructField("conv", rows.schema["conv"].dataType)
    schema = T.StructType([conv, *T.StructType.fromDDL(f"{COUNTS}, repaired_sha256 string")])

    def each(key: Any, turns: list[Turn], tally: Tally) -> list[tuple]:
        ((cost, audit),) = search(turns).values()
        digest = Digest()
        digest.add(apply(turns, audit))
        return [(key, *tally.counts(), cost, audit, digest.hash.hexdigest())]

    short, long = _split(rows, most, size)
    done = _whole(short, schema, each)
    if long is None:
        return done
    # a long conversation whose rows were all dropped is known by its id, as a short one
    gone = long.groupBy("conv").agg(F.sum("copies").alias("n")).filter("n = 0")
    gone = gone.select("conv", F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.lit("").alias("text"), F.lit(0).cast("long").alias("copies"))
    done = done.unionByName(_whole(gone, schema, each))
    blocks = _blocks(long, most, size)
    whole, entered = _assembled(blocks)
    text = _long_turns(blocks, entered, whole).repartition("first").sortWithinPartitions("first", "seq")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, digest, name, done = None, Digest(), None, []
        for conv, first, _, turns in _edits(batches):
            if key is not None and first != key:
                done.append((key, name, digest.hash.hexdigest()))
                digest = Digest()
            key, name = first, conv
            digest.add(turns)
        if key is not None:
            done.append((key, name, digest.hash.hexdigest()))
        yield from _batch(done, arrow)

    fields = T.StructType([T.StructField("first", T.LongType()), conv, T.StructField("repaired_sha256", T.StringType())])
    arrow = to_arrow_schema(fields)
    hashes = map_arrow(text, hashed, fields)
    gaps = F.coalesce(F.col("tally.high") - F.col("tally.low") + 1 - F.col("tally.turns"), F.lit(0)).alias("gaps")
    counts = ("tally.blank", "tally.duplicate", "tally.truncated", "tally.illegal", "cost", "audit", "repaired_sha256")
    return done.unionByName(hashes.join(whole, "first").select("conv", gaps, *counts))


def repair(rows: DataFrame, most: int = ROWS, size: int = BYTES) -> DataFrame:
    """conv, part, place, role, text, edit: the repaired turns of prepared rows, in order of part and place."""
    conv = T.StructField("conv", rows.schema["conv"].dataType)
    schema = T.StructType([conv, *T.StructType.fromDDL("part long, place long, role string, text string, edit string")])
    arrow = to_arrow_schema(schema)

    def each(key: Any, turns: list[Turn], tally: Tally) -> list[tuple]:
        ((_, audit),) = search(turns).values()
        return [(key, 0, i, *row) for i, row in enumerate(apply(turns, audit))]

    short, long = _split(rows, most, size)
    done = _whole(short, schema, each)
    if long is None:
        return done
    blocks = _blocks(long, most, size)
    whole, entered = _assembled(blocks)

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, _, seq, turns in _edits(batches):
            yield from _batch([(key, seq, i, *row) for i, row in enumerate(turns)], arrow)

    return done.unionByName(map_arrow(_long_turns(blocks, entered, whole), written, schema))
