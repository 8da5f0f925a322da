"""Operator 12: conversation structure repair by an auction for shortest paths.

A conversation's rows in order are cut into segments. A node of a segment's lattice is a row's place and what the roles
so far spell: nothing (E), a system row (S), or that a user (U) or an assistant (A) spoke last. Edits are arcs with whole
costs. The auction keeps a price for each node, a lower bound of the cost from there on, and one path from the start: at the
path's end it either extends to the neighbour that is cheapest by price, or, where the price is too low for all of them,
raises it and steps back. When the path arrives, all arcs of all shortest paths are tight, that is, worth exactly the
difference of their prices; the trace takes of the tight arcs that lead on the one with the smallest letter.

Segments meet through the four states at their edges. Costs between the edges' states come from auctions within each
segment; a stream over a conversation's segments, last first, gives each the cost of what follows; each segment then
traces its paths from every state, and a stream in order picks those that fit. So a conversation's rows are dealt over
tasks, and only a row for each segment meets in one.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, record_batch, stored

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
E, S, U, A = range(4)
STATES = "ESUA"
#: Where an insertion or a role of user or assistant leads.
SPEAK = {E: U, S: U, A: U, U: A}
FAR = 1 << 40
#: Rows in a segment.
SEGMENT = 64
#: A row's code: 4 * fault + initial. Faults: sound, truncated, to be deleted.
INITIALS, SOUND, CUT, GONE = "sua", 0, 1, 2
LEGAL = {(0, 1), (1, 2), (2, 1)}
#: What ends a conversation in each state: insertions up to a whole pair.
CLOSING = ("", "II", "I", "")


def _arcs(code: int, state: int) -> tuple[tuple[str, int, int], ...]:
    """(letter, next state, cost) of the edits of a row, by letter."""
    fault, initial = divmod(code, 4)
    arcs = [("D", state, DELETE)]
    if fault != GONE:
        extra = TRUNCATED if fault == CUT else 0
        if initial == 0 and state == E:
            arcs.append(("K", S, KEEP + extra))
        if initial in (1, 2) and SPEAK[state] == (U if initial == 1 else A):
            arcs.append(("K", SPEAK[state], KEEP + extra))
        arcs.append(("R", SPEAK[state], REROLE + extra))
    return tuple(arcs)


ARCS = [[_arcs(code, state) for state in range(4)] for code in range(12)]
CHEAPEST = [min(a[2] for state in range(4) for a in ARCS[code][state]) for code in range(12)]


class Lattice:
    """Nodes 4 * place + state over a segment's codes and one target behind the last place; exits: the cost from there on."""

    def __init__(self, codes: bytes, exits: list[int]):
        self.n, self.target = len(codes), 4 * len(codes) + 4
        self.arcs: list[list[tuple[str, int, int]]] = []
        for i, code in enumerate(codes):
            for state in range(4):
                own = [(letter, 4 * i + 4 + to, cost) for letter, to, cost in ARCS[code][state]]
                self.arcs.append([own[0], ("I", 4 * i + SPEAK[state], INSERT), *own[1:]])
        self.arcs += [[("", self.target, cost)] for cost in exits]
        least = min(exits)
        rest = [least]
        for code in reversed(codes):  # prices that no arc undercuts
            rest.append(rest[-1] + CHEAPEST[code])
        self.price = [rest[self.n - i] for i in range(self.n + 1) for _ in range(4)] + [0]

    def auction(self, start: int) -> int:
        """Raises prices until a path from start to the target is tight; returns its cost. Prices of earlier calls stay valid."""
        price, arcs, path = self.price, self.arcs, [start]
        while path[-1] != self.target:
            node = path[-1]
            best, to = min((cost + price[to], to) for _, to, cost in arcs[node])
            if price[node] < best:  # contract
                price[node] = best
                if len(path) > 1:
                    path.pop()
            else:
                path.append(to)
        return price[start]

    def live(self) -> list[bool]:
        """Which nodes reach the target by tight arcs."""
        price, out = self.price, [False] * self.target + [True]
        for i in range(self.n, -1, -1):
            for _ in range(3):  # insertions lead on within a place, twice at most
                for node in range(4 * i, 4 * i + 4):
                    out[node] = out[node] or any(out[to] and price[node] == cost + price[to] for _, to, cost in self.arcs[node])
        return out

    def trace(self, start: int, live: list[bool]) -> tuple[str, int]:
        """The ASCII-least letters of a shortest path from start, and the state in which it leaves the last place."""
        letters, node = [], start
        while True:
            letter, to = next((letter, to) for letter, to, cost in self.arcs[node] if live[to] and self.price[node] == cost + self.price[to])
            if to == self.target:
                return "".join(letters), node - 4 * self.n
            letters.append(letter)
            node = to


def _closing_costs() -> list[int]:
    return [INSERT * len(x) for x in CLOSING]


def crossing_costs(codes: bytes) -> list[int]:
    """The least cost from each state before a segment to each state after it, as 16 numbers; FAR where there is no way."""
    out = [FAR] * 16
    starts = any(code % 4 == 0 and code // 4 != GONE for code in codes)  # a system row that may stay
    for last in range(4):
        lattice = Lattice(codes, [0 if state == last else FAR for state in range(4)])
        for first in range(4):
            if last in (U, A) or first == last or (last == S and first == E and starts):
                out[4 * first + last] = lattice.auction(first)
    return out


def paths(codes: bytes, exits: list[int], first: list[int]) -> list[tuple[str, int, int]]:
    """(letters, last state, cost up to the end of the conversation) from each of the states ``first``."""
    lattice = Lattice(codes, exits)
    costs = [lattice.auction(state) for state in first]
    live = lattice.live()
    return [(*lattice.trace(state, live), cost) for state, cost in zip(first, costs)]


def edited(role: str, text: str, letters: str, state: int) -> tuple[list[str], int]:
    """The repaired rows, as ``role:text``, that the letters of one row give (insertions, then its own edit), and the state after them."""
    out = []
    for letter in letters:
        if letter == "K":
            out.append(f"{role}:{text}")
            state = {"s": S, "u": U, "a": A}[role[0]]
        elif letter != "D":
            state = SPEAK[state]
            out.append(f"{'user' if state == U else 'assistant'}:{text if letter == 'R' else ''}")
    return out, state


def _placed(batches):
    """Rows sorted by conversation: each gets its task, its place there in its conversation, and a mark of conversation, role and text."""
    part, key, at = TaskContext.get().partitionId(), (), 0
    for batch in batches:
        places, marks = [], []
        for conv, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text"))):
            if key != (conv,):
                key, at = (conv,), 0
            places.append(at)
            at += 1
            marks.append(xxhash.xxh3_128_digest(f"{conv} {len(role)} {role}{text}".encode()))
        columns = {c: batch.column(c) for c in ("conv_id", "turn", "role", "text")}
        yield record_batch(columns | {"part": pa.array([part] * len(places), pa.int32()), "at": pa.array(places, pa.int64()), "mark": pa.array(marks, pa.binary())})


def _crossings(batches):
    for batch in batches:
        costs = [crossing_costs(bytes(codes)) for codes in batch.column("codes").to_pylist()]
        yield record_batch({c: batch.column(c) for c in ("conv_id", "part", "seg")} | {"costs": pa.array(costs, pa.list_(pa.int64()))})


def _exits(batches):
    """Segments sorted by conversation, last first: the cost of what follows each, by state."""
    key, exits = (), []
    for batch in batches:
        found = []
        for conv, costs in zip(batch.column("conv_id").to_pylist(), batch.column("costs").to_pylist()):
            if key != (conv,):
                key, exits = (conv,), _closing_costs()
            found.append(exits)
            exits = [min(FAR, *(costs[4 * q + r] + exits[r] for r in range(4))) for q in range(4)]
        yield record_batch({c: batch.column(c) for c in ("conv_id", "part", "seg")} | {"exits": pa.array(found, pa.list_(pa.int64()))})


TRACED = "conv_id long, part int, seg long, codes array<int>, audits array<string>, states array<int>, costs array<long>"


def _traced(batches):
    """The paths of each segment: from no role where it is the conversation's only one, else from every state."""
    for batch in batches:
        rows = []
        for codes, exits in zip(batch.column("codes").to_pylist(), batch.column("exits").to_pylist()):
            codes = bytes(codes)
            found = paths(codes, _closing_costs(), [E]) if exits is None else paths(codes, exits, [E, S, U, A])
            rows.append(list(zip(*found)))
        columns = {c: batch.column(c) for c in ("conv_id", "part", "seg", "codes")}
        kinds = (("audits", pa.string()), ("states", pa.int32()), ("costs", pa.int64()))
        yield record_batch(columns | {c: pa.array([list(r[i]) for r in rows], pa.list_(k)) for i, (c, k) in enumerate(kinds)})


PICKED = "conv_id long, part int, seg long, audit string, cost long, illegal long"


def _picked(batches):
    """Segments sorted by conversation, in order: of each the path that goes on from where the last one ended, and the pairs of
    roles that don't fit."""
    key, state, before = (), E, []
    for batch in batches:
        found = []
        for r in batch.select(["conv_id", "codes", "audits", "states", "costs"]).to_pylist():
            if key != (r["conv_id"],):
                key, state, before = (r["conv_id"],), E, []
            path = state if len(r["states"]) > 1 else 0
            initials = before + [code % 4 for code in r["codes"]]
            found.append((r["audits"][path], r["costs"][path], sum(p not in LEGAL for p in zip(initials, initials[1:]))))
            state, before = r["states"][path], initials[-1:]
        columns = {c: batch.column(c) for c in ("conv_id", "part", "seg")}
        yield record_batch(columns | {c: pa.array([x[i] for x in found], k) for i, (c, k) in enumerate((("audit", pa.string()), ("cost", pa.int64()), ("illegal", pa.int64())))})


REPAIRED = "conv_id long, illegal long, cost long, audit string, repaired_sha256 string"


def split_letters(audit: str, rows: int) -> list[str]:
    """The letters of each row: insertions before it, then its edit."""
    out, held = [], ""
    for letter in audit:
        held += letter
        if letter != "I":
            out.append(held)
            held = ""
    assert len(out) == rows and not held
    return out


def _repaired(segment: int):
    """Rows sorted by conversation, task, segment, the segment's own row first: follows its letters and hashes the repaired rows."""

    def run(batches):
        key, digest, rows, audit, cost, illegal, state, letters, done = (), None, 0, [], 0, 0, E, [], []

        def put(lines: list[str]) -> None:
            nonlocal rows
            for line in lines:
                digest.update((("\n" if rows else "") + line).encode())
                rows += 1

        def end() -> None:
            put(edited("", "", CLOSING[state], state)[0])
            done.append((key[0], illegal, cost, "".join(audit) + CLOSING[state], digest.hexdigest()))

        def results():
            kinds = (("conv_id", pa.int64()), ("illegal", pa.int64()), ("cost", pa.int64()), ("audit", pa.string()), ("repaired_sha256", pa.string()))
            return record_batch({c: pa.array([x[i] for x in done], k) for i, (c, k) in enumerate(kinds)})

        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("conv_id", "at", "role", "text", "audit", "cost", "illegal"))
            for conv, at, role, text, own, own_cost, own_illegal in zip(*columns):
                if key != (conv,):
                    if key:
                        end()
                    key, digest, rows, audit, cost, illegal, state = (conv,), hashlib.sha256(), 0, [], own_cost, 0, E
                if at is None:
                    audit.append(own)
                    illegal += own_illegal
                    letters = split_letters(own, sum(x != "I" for x in own))
                    continue
                lines, state = edited(role, text, letters[at % segment], state)
                put(lines)
            yield results()
            done.clear()
        if key:
            end()
            yield results()

    return run


def repair(conversations: DataFrame, *, segment: int = SEGMENT) -> DataFrame:
    """Per conversation of (conv_id, turn, role, text): gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    A null role or text is one space. Rows go by turn, nulls first; rows of one turn by a hash of role and text, equal
    rows beside each other. A role counts by its first letter, s, u or a; any other role, an empty one too, can't stay.
    Null ids are a conversation of their own. A conversation without rows isn't there; no rows give no rows. Other
    columns are ignored.

    Rows are sorted over all tasks by range, so that a conversation of any size is dealt out; equal rows are dealt by a
    salt. Copies of a row meet by a 128-bit hash, counted before they are shuffled. Only a row for each ``segment`` rows
    of a conversation goes through one stream, and its text through one at the end: SHA-256 has no parts.
    """
    space = lambda c: F.coalesce(c, F.lit(" ")).alias(c)
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), space("role"), space("text"))
    order = ["conv_id", "turn", "tie", "salt"]
    dealt = rows.withColumns({"tie": F.xxhash64("role", "text"), "salt": F.monotonically_increasing_id() % 1024})
    dealt = dealt.repartitionByRange(*order).sortWithinPartitions(*order).drop("tie", "salt")
    kinds = "conv_id long, turn long, role string, text string, part int, at long, mark binary"
    placed = stored(map_arrow(dealt, _placed, kinds), "rows")

    last = F.right(F.rtrim("text", F.lit(" \t\n\x0b\x0c\r")), F.lit(1))
    initial = F.greatest(F.instr(F.lit(INITIALS), F.substring("role", 1, 1)) - 1, F.lit(-1))
    initial = F.when((F.length("role") == 0) | (initial < 0), 3).otherwise(initial)
    narrow = placed.select("conv_id", "turn", "part", "at", "mark", (last == "").alias("blank"), (~last.rlike("^[.!?]")).alias("cut"), initial.alias("initial"))
    first = narrow.where("NOT blank").groupBy("mark").agg(F.count("*").alias("n"), F.min(F.struct("part", "at")).alias("first"))
    seen = narrow.join(first.where("n > 1").select("mark", "first"), "mark", "left")
    again = ~F.col("blank") & F.coalesce(F.struct("part", "at") != F.col("first"), F.lit(False))
    fault = F.when(F.col("blank") | again, GONE).when(F.col("cut"), CUT).otherwise(SOUND)
    coded = seen.select("conv_id", "turn", "part", "at", F.floor(F.col("at") / segment).alias("seg"), "blank", again.alias("again"), fault.alias("fault"), "initial")
    one = lambda c: F.sum(c.cast("long"))
    segments = coded.groupBy("conv_id", "part", "seg").agg(
        F.array_sort(F.collect_list(F.struct("at", (4 * F.col("fault") + F.col("initial")).cast("int").alias("code")))).alias("codes"),  # at most ``segment``
        one(F.col("blank")).alias("blank"), one(F.col("again")).alias("duplicate"), one(F.col("fault") == CUT).alias("truncated"),
    )
    segments = stored(segments.withColumn("codes", F.col("codes.code")), "segments")
    counts = segments.groupBy("conv_id").agg(*(F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")), F.count("*").alias("n"))
    turns = placed.groupBy("conv_id").agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.countDistinct("turn"), F.lit(0)).alias("gaps"))

    many = counts.where("n > 1").select(F.col("conv_id").alias("c"))
    of_many = segments.join(many, F.col("conv_id").eqNullSafe(F.col("c")), "left_semi").select("conv_id", "part", "seg", "codes")
    crossed = map_arrow(of_many, _crossings, "conv_id long, part int, seg long, costs array<long>")
    exits = map_arrow(crossed.repartition("conv_id").sortWithinPartitions("conv_id", F.desc("part"), F.desc("seg")), _exits, "conv_id long, part int, seg long, exits array<long>")
    exits = exits.toDF("c", "p", "s", "exits")
    met = segments.join(exits, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("part") == F.col("p")) & (F.col("seg") == F.col("s")), "left")
    traced = map_arrow(met.select("conv_id", "part", "seg", "codes", "exits"), _traced, TRACED)
    picked = map_arrow(traced.repartition("conv_id").sortWithinPartitions("conv_id", "part", "seg"), _picked, PICKED)

    none = lambda kind: F.lit(None).cast(kind)
    texts = placed.select("conv_id", "part", F.floor(F.col("at") / segment).alias("seg"), "at", "role", "text", none("string").alias("audit"), none("long").alias("cost"), none("long").alias("illegal"))
    led = picked.select("conv_id", "part", "seg", none("long").alias("at"), none("string").alias("role"), none("string").alias("text"), "audit", "cost", "illegal")
    both = texts.unionAll(led).repartition("conv_id").sortWithinPartitions("conv_id", "part", "seg", F.asc_nulls_first("at"))
    done = map_arrow(both, _repaired(segment), REPAIRED)
    done = done.join(counts.drop("n").withColumnRenamed("conv_id", "c"), F.col("conv_id").eqNullSafe(F.col("c"))).drop("c")
    done = done.join(turns.withColumnRenamed("conv_id", "c"), F.col("conv_id").eqNullSafe(F.col("c"))).drop("c")
    return done.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows (conv_id, turn, role, text) after damage by crc32 of ``conv_id:turn`` (null: one space) mod 20."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind: Column = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), kind.alias("kind")).where("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


def with_all(repaired: DataFrame, conversations: DataFrame) -> DataFrame:
    """repaired, and a row of zeros, an empty audit and the hash of nothing for each conversation that has no rows left."""
    every = conversations.select(F.col("conv_id").cast("long").alias("c")).distinct()
    joined = every.join(repaired, F.col("conv_id").eqNullSafe(F.col("c")), "left")
    empty = {c: F.lit(0).cast("long") for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")} | {"audit": F.lit(""), "repaired_sha256": F.lit(hashlib.sha256().hexdigest())}
    return joined.select(F.col("c").alias("conv_id"), *(F.coalesce(c, v).alias(c) for c, v in empty.items()))
