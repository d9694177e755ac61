"""Conversation structure repair: cheapest edits by a streamed dynamic programme over sorted turns.

A repaired conversation is empty, or an optional system turn and then one or more pairs of a user and
an assistant turn. Turns are repartitioned by conversation and sorted. A first stream walks every
conversation from its last turn to its first and carries, across Arrow batches, the least cost of the
rest for each state of the pattern. What it remembers of a turn is two bytes: the best edit for each
state and the turn's fault. These bytes are handed on in chunks, so a conversation of any length needs
the memory of one chunk. A second stream walks forward, meets each chunk just before its first turn,
and applies the edits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curveboard.llm.blocks import column, small_batches

#: White space that a text without other characters consists of.
BLANK = " \t\n\x0b\x0c\r"
KEEP, REROLE, DELETE, INSERT, FINISH = 0, 3, 4, 3, 3
#: Letters of the edits in ASCII order; two bits of a packed byte name one.
LETTERS = "DIKR"
FINE, EMPTY, REPEATED, CUT_OFF = range(4)
#: States: nothing yet, after system, after user, after assistant; ``NEXT`` is the state after the next role.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = (USER, USER, ASSISTANT, USER)
ROLE_OF = {USER: "user", ASSISTANT: "assistant"}
#: Least cost after the last turn: what has to be inserted to end a pair.
AT_END = (0, 2 * INSERT, INSERT, 0)
LEGAL = {"su", "ua", "au"}
#: Turns whose packed edits are handed on together.
CHUNK_ROWS = 1 << 16
OUT_ROWS = 4096
ORDER = ["turn", "role", "text"]


def damaged(turns: DataFrame) -> DataFrame:
    """Turns with faults put in by ``crc32("conv_id:turn") % 20``, null read as one space.

    0 drops the turn (``present`` is false), 1 empties its text, 2 removes ``.``, ``!`` and ``?``,
    3 gives the turn twice, 4 sets the role to user. The turn stays null where it was.
    """
    space = F.lit(" ")
    key = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), space) for c in ("conv_id", "turn")))
    kind = F.crc32(key) % 20
    text, role = F.coalesce("text", space), F.coalesce("role", space)
    return turns.select(
        "conv_id",
        F.col("turn").cast("long").alias("turn"),
        F.when(kind == 4, "user").otherwise(role).alias("role"),
        F.when(kind <= 1, "").when(kind == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        (kind != 0).alias("present"),
        F.explode(F.when(kind == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("__copy"),
    ).drop("__copy")


def fault() -> Column:
    """First fault of a turn: 1 blank, 2 role and text seen earlier, 3 cut off, 0 none."""
    left = F.rtrim("text", F.lit(BLANK))
    seen = Window.partitionBy("conv_id", "role", F.sha2("text", 256)).orderBy("turn")
    return (
        F.when(left == "", EMPTY)
        .when(F.row_number().over(seen) > 1, REPEATED)
        .when(~F.substring(left, -1, 1).isin(".", "!", "?"), CUT_OFF)
        .otherwise(FINE)
    )


def state_after(state: int, initial: str) -> int | None:
    """State after keeping a turn with this initial, None where the pattern does not allow it."""
    if initial == "s":
        return SYSTEM if state == START else None
    if initial == ("a" if state == USER else "u"):
        return NEXT[state]
    return None


class Steps:
    """One step back of the dynamic programme, remembered by (costs above the least, initial, fault)."""

    def __init__(self):
        self.known: dict = {}

    def back(self, rest: tuple, initial: str, flaw: int) -> tuple[tuple, int, int]:
        """(costs above the least, the least added, packed letters) before a turn, from those after it."""
        key = (rest, initial, flaw)
        if key not in self.known:
            options = []
            extra = FINISH if flaw == CUT_OFF else 0
            for state in range(4):
                own = {"D": DELETE + rest[state]}
                if flaw not in (EMPTY, REPEATED):
                    kept = state_after(state, initial)
                    if kept is not None:
                        own["K"] = KEEP + extra + rest[kept]
                    own["R"] = REROLE + extra + rest[NEXT[state]]
                options.append(own)
            best = [min(own.values()) for own in options]
            for _ in range(3):
                best = [min(cost, INSERT + best[NEXT[s]]) for s, cost in enumerate(best)]
            packed = 0
            for state, own in enumerate(options):
                own["I"] = INSERT + best[NEXT[state]]
                letter = min(x for x, cost in own.items() if cost == best[state])
                packed |= LETTERS.index(letter) << 2 * state
            least = min(best)
            self.known[key] = (tuple(c - least for c in best), least, packed)
        return self.known[key]


def plan_stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packed edits in chunks, from turns that come by conversation, last turn first.

    A chunk has the place of its first turn and is cut only where that place changes.
    """
    steps, out = Steps(), []
    conv, place, costs, least, packed = None, None, None, 0, bytearray()

    def chunk():
        # latest turn first so far; a reader walks forward
        out.append((conv, *place, bytes(packed[::-1]), least + costs[START]))
        packed.clear()

    def flush():
        kinds = [id_type, pa.int64(), pa.string(), pa.string(), pa.binary(), pa.int64()]
        columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)]
        out.clear()
        return pa.RecordBatch.from_arrays(columns, names=["conv_id", *ORDER, "edits", "cost"])

    for batch in batches:
        id_type = batch.schema.field("conv_id").type
        rows = (column(batch, c).to_pylist() for c in ("conv_id", *ORDER, "fault"))
        for of, turn, role, text, flaw in zip(*rows, strict=True):
            here = (turn, role, text)
            if place is None or of != conv:
                if place is not None:
                    chunk()
                conv, costs, least = of, AT_END, 0
            elif len(packed) >= 2 * CHUNK_ROWS and here != place:
                chunk()
            place = here
            costs, more, letters = steps.back(costs, role[:1], flaw)
            least += more
            packed += bytes((flaw, letters))
            if len(out) >= OUT_ROWS:
                yield flush()
    if place is not None:
        chunk()
    if out:
        yield flush()


def edit_plans(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, edits, cost): packed edits of damaged turns, a chunk per place.

    One exchange by conversation serves the window that finds repeated turns and the stream.
    """
    small_batches(turns.sparkSession)
    schema = f"conv_id {turns.schema['conv_id'].dataType.simpleString()}, turn long, role string, text string"
    last_first = [F.col(c).desc_nulls_last() for c in ("conv_id", *ORDER)]
    return (
        turns.filter("present")
        .repartition("conv_id")
        .select("conv_id", *ORDER, fault().alias("fault"))
        .sortWithinPartitions(*last_first, (F.col("fault") == REPEATED).desc())
        .mapInArrow(plan_stream, f"{schema}, edits binary, cost long")
    )


class Report:
    """Counts over the turns of one conversation as they pass."""

    def __init__(self):
        self.turns, self.first, self.last = 0, None, None
        self.faults, self.illegal, self.before = [0, 0, 0, 0], 0, None
        self.audit: list[str] = []

    def add(self, turn: int | None, role: str, flaw: int) -> None:
        if turn is not None and turn != self.last:
            self.first = turn if self.first is None else self.first
            self.turns, self.last = self.turns + 1, turn
        self.faults[flaw] += 1
        initial = role[:1]
        if self.before is not None and self.before + initial not in LEGAL:
            self.illegal += 1
        self.before = initial

    def gaps(self) -> int:
        return self.last - self.first + 1 - self.turns if self.turns else 0


def repair_stream(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Events from chunks and turns that come by conversation in order.

    ("turn", conv_id, edit, role, text) for each edit, and ("end", conv_id, report, cost) after the last.
    """
    started, conv, report, cost = False, None, None, 0
    state, edits, at = START, b"", 0

    def end():
        nonlocal state
        if cost is not None:
            while state in (SYSTEM, USER):
                state = NEXT[state]
                report.audit.append("I")
                yield "turn", conv, "I", ROLE_OF[state], ""
        yield "end", conv, report, cost or 0

    for batch in batches:
        names = ("conv_id", *ORDER, "present", "edits", "cost")
        for of, turn, role, text, present, packed, total in zip(
            *(column(batch, c).to_pylist() for c in names), strict=True
        ):
            if not started or of != conv:
                if started:
                    yield from end()
                started, conv, report, cost, state = True, of, Report(), None, START
            if packed is not None:
                edits, at = packed, 0
                cost = total if cost is None else cost
                continue
            if not present:
                continue
            # the chunk was reversed as a whole: letters stand before the fault
            letters, flaw = edits[at], edits[at + 1]
            at += 2
            report.add(turn, role, flaw)
            while (letter := LETTERS[letters >> 2 * state & 3]) == "I":
                state = NEXT[state]
                report.audit.append("I")
                yield "turn", conv, "I", ROLE_OF[state], ""
            report.audit.append(letter)
            if letter == "K":
                state = state_after(state, role[:1])
                yield "turn", conv, "K", role, text
            elif letter == "R":
                state = NEXT[state]
                yield "turn", conv, "R", ROLE_OF[state], text
            else:
                yield "turn", conv, "D", role, text
    if started:
        yield from end()


def walk(turns: DataFrame) -> DataFrame:
    """Damaged turns and the chunks of their edits, by conversation in order; a chunk before its turns."""
    plans = edit_plans(turns)
    rows = turns.select(
        "conv_id", *ORDER, "present", F.lit(None).cast("binary").alias("edits"), F.lit(None).cast("long").alias("cost")
    )
    both = rows.unionByName(plans.withColumn("present", F.lit(True)))
    first = [F.col(c).asc_nulls_first() for c in ("conv_id", *ORDER)]
    return both.repartition("conv_id").sortWithinPartitions(*first, F.col("edits").isNull())


def repaired_turns(turns: DataFrame) -> DataFrame:
    """(conv_id, place, edit, role, text): the repaired conversations and the turns deleted from them.

    ``turns`` are rows as ``damaged`` gives them. ``place`` counts edits from 0 within a
    conversation; rows with edit ``D`` are not part of the repaired conversation. Conversations
    without any turn have no row here; ``repair_reports`` has all.
    """
    id_type = turns.schema["conv_id"].dataType.simpleString()

    def run(batches):
        def rows():
            place = 0
            for kind, conv, *rest in repair_stream(batches):
                if kind == "end":
                    place = 0
                else:
                    yield (conv, place, *rest)
                    place += 1

        yield from in_batches(rows(), kinds)

    kinds = {"conv_id": arrow_id(id_type), "place": pa.int64(), "edit": pa.string(), "role": pa.string(), "text": pa.string()}
    return walk(turns).mapInArrow(run, f"conv_id {id_type}, place long, edit string, role string, text string")


def arrow_id(name: str) -> pa.DataType:
    return {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[name]


def in_batches(rows: Iterator[tuple], kinds: dict[str, pa.DataType], most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Record batches of a few thousand rows, or fewer where strings are long."""
    held, size = [], 0

    def flush():
        columns = [pa.array(c, t) for c, t in zip(zip(*held, strict=True), kinds.values(), strict=True)]
        held.clear()
        return pa.RecordBatch.from_arrays(columns, names=list(kinds))

    for row in rows:
        held.append(row)
        size += sum(len(v) for v in row if isinstance(v, str))
        if len(held) >= OUT_ROWS or size >= most_bytes:
            yield flush()
            size = 0
    if held:
        yield flush()


def repair_reports(turns: DataFrame) -> DataFrame:
    """One row per conversation: gaps, faults, cost, edits in order, digest of the repaired turns.

    ``turns`` are rows as ``damaged`` gives them. ``audit`` has the initials of the cheapest edits,
    of several cheapest the ASCII-least. ``repaired_sha256`` covers ``role:text`` of the repaired
    turns, joined by newlines; it is updated turn by turn as the stream of ``repaired_turns`` passes.

    Turns order by (turn, role, text), null turns first. A null conv_id is a conversation of its own.
    A role is known by its first letter; turns of other roles (an empty one too) cannot be kept as they
    are. Repeated rows are repeated turns. A conversation without turns left has zeros, an empty audit
    and the digest of an empty string. An empty table gives an empty one.
    """
    id_type = turns.schema["conv_id"].dataType.simpleString()
    kinds = {"conv_id": arrow_id(id_type)}
    kinds |= {n: pa.int64() for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")}
    kinds |= {"audit": pa.string(), "repaired_sha256": pa.string()}

    def run(batches):
        def rows():
            digest, empty = hashlib.sha256(), True
            for kind, conv, *rest in repair_stream(batches):
                if kind == "turn":
                    edit, role, text = rest
                    if edit != "D":
                        digest.update(f"{'' if empty else chr(10)}{role}:{text}".encode())
                        empty = False
                    continue
                report, cost = rest
                yield (conv, report.gaps(), *report.faults[1:], report.illegal, cost, "".join(report.audit), digest.hexdigest())
                digest, empty = hashlib.sha256(), True

        yield from in_batches(rows(), kinds)

    schema = ", ".join(f"{n} {'string' if pa.types.is_string(t) else 'long'}" for n, t in kinds.items() if n != "conv_id")
    return walk(turns).mapInArrow(run, f"conv_id {id_type}, {schema}")
