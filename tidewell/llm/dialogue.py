"""Repair of conversations' structure: the cheapest edits after which the roles are an optional system turn and pairs of user and assistant.

Each edit of a path costs an integer whose high digits are the cost and whose low digits say, at the letter's place in the
audit, which letter it is; digits after the audit's end are zero. The least sum over the paths of a small graph is therefore
the cheapest repair and, of those, the one whose audit comes first. The graph's nodes are four: nothing yet, after system, after user,
after assistant; a node and a letter fix what follows, so that two audits that meet in a node differ before. Long conversations take
blocks of rows: at a block's end the audits so far become one digit, their order, and the letters are put away.

A conversation's rows stream in order through one task, twice: to find the audit, and to carry it out. Neither holds its texts; what grows
with a conversation is its audit, one letter a row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACES, only, settle, slices

KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
COST = {KEEP: 0, REROLE: 3, DELETE: 4, INSERT: 3}
#: What a truncated row costs more when it stays.
TRUNCATED = 3
START, SYSTEM, USER, ASSISTANT = range(4)
#: Where an initial leads to from a node; a row that gets a role, or is put in, has the one that may follow.
AFTER = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (ASSISTANT, "u"): USER, (USER, "a"): ASSISTANT}
NEXT = {START: USER, SYSTEM: USER, ASSISTANT: USER, USER: ASSISTANT}
ROLE = {USER: "user", ASSISTANT: "assistant"}
LEGAL = {"su", "ua", "au"}

#: Letters as digits, in the order of ASCII; 0 is the end. Each row has three at most: two insertions before it, and its own.
DIGIT = {c: i + 1 for i, c in enumerate(sorted(COST))}
LETTER = {d: c for c, d in DIGIT.items()}
BITS = 3
ROWS = 128
DIGITS = 3 * ROWS + 3
SHIFT = BITS * (DIGITS + 1)


class Paths:
    """The best path to each node over the rows so far: its weight, the letters of its block, and the earlier blocks' letters."""

    def __init__(self):
        self.best: dict[int, tuple[int, int, tuple | None]] = {START: (0, 0, None)}
        self.rows = 0

    @staticmethod
    def _step(path: tuple, letter: str, more: int = 0) -> tuple:
        weight, used, before = path
        return weight + (COST[letter] + more << SHIFT) + (DIGIT[letter] << BITS * (DIGITS - 1 - used)), used + 1, before

    @staticmethod
    def _offer(best: dict, node: int, path: tuple) -> None:
        if node not in best or path[0] < best[node][0]:
            best[node] = path

    def _insert(self) -> None:
        for node in (START, SYSTEM, ASSISTANT, USER):
            if node in self.best:
                self._offer(self.best, NEXT[node], self._step(self.best[node], INSERT))

    def row(self, initial: str, must_go: bool, truncated: bool) -> None:
        self._insert()
        then: dict = {}
        more = TRUNCATED * truncated
        for node, path in self.best.items():
            self._offer(then, node, self._step(path, DELETE))
            if must_go:
                continue
            if (node, initial) in AFTER:
                self._offer(then, AFTER[node, initial], self._step(path, KEEP, more))
            self._offer(then, NEXT[node], self._step(path, REROLE, more))
        self.best, self.rows = then, self.rows + 1
        if self.rows % ROWS == 0:
            low = (1 << SHIFT) - 1
            order = sorted(then, key=lambda node: then[node][0] & low)
            self.best = {node: ((then[node][0] >> SHIFT << SHIFT) + (place + 1 << BITS * DIGITS), 0, (then[node][2], self._letters(then[node]))) for place, node in enumerate(order)}

    @staticmethod
    def _letters(path: tuple) -> str:
        weight, used, _ = path
        return "".join(LETTER[weight >> BITS * (DIGITS - 1 - i) & (1 << BITS) - 1] for i in range(used))

    def end(self) -> tuple[int, str]:
        """Cost and audit of the least path to nothing or to the end of a pair."""
        self._insert()
        path = min(self.best[node] for node in (START, ASSISTANT) if node in self.best)
        parts, before = [self._letters(path)], path[2]
        while before:
            before, letters = before
            parts.append(letters)
        return path[0] >> SHIFT, "".join(reversed(parts))


def damage(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn") -> DataFrame:
    """The rows after the harm that crc32 of `conv_id:turn` modulo 20 does to each: (conv_id, turn, role, text, there).

    0 drops the row (it stays here, with there false), 1 empties its text, 2 removes its `[.!?]`, 3 repeats it, 4 makes its
    role user. Nulls are one space, in the key too; the turn itself stays null.
    """
    read = only(turns, conv_id, turn, "role", "text")
    word = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" "))
    harm = F.crc32(F.concat(word(conv_id), F.lit(":"), word(turn)).cast("binary")) % 20
    text = F.when(F.col("harm").isin(0, 1), "").when(F.col("harm") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return (
        read.select(F.col(f"`{conv_id}`").alias("conv_id"), F.col(f"`{turn}`").cast("long").alias("turn"), word("role").alias("role"), word("text").alias("text"), harm.alias("harm"))
        .select("conv_id", "turn", F.when(F.col("harm") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (F.col("harm") != 0).alias("there"), "harm")
        .withColumn("copy", F.explode(F.when(F.col("harm") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("harm", "copy")
    )


def _seen(rows: DataFrame) -> DataFrame:
    """With `again`: whether a row of an earlier turn in its conversation has its role and text.

    Only the first turn of each repeated role and text meets the rows; both sides are stored or dealt by conversation and
    text, so that the join can be split where one conversation or one text has a large share of the rows.
    """
    same = F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")).cast("binary"), 256))
    keyed = rows.withColumn("same", same)
    first = F.min(F.struct(F.col("turn").isNotNull().alias("numbered"), "turn"))
    firsts = settle(
        keyed.where("there").groupBy("conv_id", "same").agg(first.alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
        .select(F.col("conv_id").alias("of"), F.col("same").alias("what"), F.col("first.turn").alias("first_turn")),
        "first-turns",
    )
    met = keyed.join(firsts, F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("same") == F.col("what")), "left")
    again = F.col("what").isNotNull() & ~F.col("turn").eqNullSafe(F.col("first_turn"))
    return met.select("conv_id", "turn", "role", "text", "there", again.alias("again"))


#: Rows of a conversation by turn, those without one first; of one turn by role and text.
ORDER = ("turn", "role", "text")
COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def _told(kind: str) -> str:
    return f"conv_id {kind}, {', '.join(f'{c} long' for c in COUNTS)}, audit string"


class _Conversation:
    """Counts and paths of the conversation whose rows are coming."""

    def __init__(self, key):
        self.key, self.paths, self.last = key, Paths(), None
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.first_turn = self.last_turn = None

    def row(self, turn, role: str, text: str, again: bool) -> None:
        said = text.rstrip(SPACES)
        blank = not said
        duplicate = not blank and (again or self.last == (turn, role, text))
        truncated = not blank and not duplicate and said[-1] not in ".!?"
        self.blank, self.duplicate, self.truncated = self.blank + blank, self.duplicate + duplicate, self.truncated + truncated
        if self.last is not None:
            self.illegal += self.last[1][:1] + role[:1] not in LEGAL
        if turn is not None and turn != self.last_turn:
            self.first_turn = turn if self.first_turn is None else self.first_turn
            self.last_turn, self.turns = turn, self.turns + 1
        self.last = (turn, role, text)
        self.paths.row(role[:1], blank or duplicate, truncated)

    def told(self) -> tuple:
        cost, audit = self.paths.end()
        gaps = self.last_turn - self.first_turn + 1 - self.turns if self.turns else 0
        return (self.key, gaps, self.blank, self.duplicate, self.truncated, self.illegal, cost, audit)


def _by_conversation(df: DataFrame, *order) -> DataFrame:
    return df.repartition("conv_id").sortWithinPartitions("conv_id", *order)


def audits(rows: DataFrame) -> DataFrame:
    """One row per conversation of what damage gives: (conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit).

    Each row's first fault counts: blank, without a character that isn't white space; duplicate, with the role and text of an
    earlier row of the conversation; truncated, not ending in `[.!?]`. gaps are turns missing between the first and the last,
    illegal the neighbours whose roles' initials aren't su, ua or au. Blank and duplicate rows have to go. A conversation
    without rows has zeros and an empty audit. A null conv_id is a conversation like others. Empty tables give none.
    """
    kind = rows.schema["conv_id"].dataType.simpleString()
    schema = _told(kind)
    names = ["conv_id", *COUNTS, "audit"]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, out = None, []
        batch = None

        def put(some: list) -> pa.RecordBatch:
            types = [batch.schema.field("conv_id").type, *[pa.int64()] * len(COUNTS), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some, strict=True), types, strict=True)], names)

        for batch in slices(batches, "text"):  # noqa: B007
            for key, turn, role, text, there, again in zip(*(batch[c].to_pylist() for c in ("conv_id", "turn", "role", "text", "there", "again")), strict=True):
                if now is None or key != now.key:
                    if now is not None:
                        out.append(now.told())
                    now = _Conversation(key)
                if there:
                    now.row(turn, role, text, again)
            if len(out) >= 1000:
                yield put(out)
                out = []
        if now is not None:
            yield put([*out, now.told()])

    return _by_conversation(_seen(rows), *ORDER).mapInArrow(find, schema)


def _carried_out(rows: DataFrame, found: DataFrame, schema: str, begin, line, end) -> DataFrame:
    """Stream the rows behind their conversation's audit; begin, line and end make the result's rows of a conversation."""
    lead = found.withColumns({"turn": F.lit(None).cast("long"), "role": F.lit(""), "text": F.lit(""), "there": F.lit(False), "lead": F.lit(True)})
    told = ["conv_id", *COUNTS, "audit"]
    behind = rows.withColumns({c: F.lit(None).cast("long") for c in COUNTS} | {"audit": F.lit(None).cast("string"), "lead": F.lit(False)})
    both = lead.unionByName(behind)

    def carry(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node = at = place = 0
        audit = state = None
        out: list[tuple] = []
        arrow = None

        def inserted() -> None:
            nonlocal node, at, place
            while at < len(audit) and audit[at] == INSERT:
                node, at, place = NEXT[node], at + 1, place + 1
                out.extend(line(state, place, INSERT, ROLE[node], ""))

        def done() -> None:
            if audit is not None:
                inserted()
                out.extend(end(state))

        def put() -> pa.RecordBatch:
            fields = list(arrow)
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), fields, strict=True)], schema=arrow)

        for batch in slices(batches, "text"):
            if arrow is None:
                arrow = pa.schema([pa.field("conv_id", batch.schema.field("conv_id").type), *ARROW[schema]])
            for is_lead, there, role, text, *rest in zip(*(batch[c].to_pylist() for c in ("lead", "there", "role", "text", *told)), strict=True):
                if is_lead:
                    done()
                    audit, node, at, place = rest[-1], START, 0, 0
                    state = begin(rest)
                elif there:
                    inserted()
                    letter, at = audit[at], at + 1
                    if letter == DELETE:
                        continue
                    node, place = NEXT[node] if letter == REROLE else AFTER[node, role[:1]], place + 1
                    out.extend(line(state, place, letter, ROLE[node] if letter == REROLE else role, text))
            if out:
                yield put()
                out.clear()
        done()
        if out:
            yield put()

    kind = rows.schema["conv_id"].dataType.simpleString()
    return _by_conversation(both, F.desc("lead"), *ORDER).mapInArrow(carry, f"conv_id {kind}, {schema}")


REPAIRED = "place long, edit string, role string, text string"
DIGESTS = f"{', '.join(f'{c} long' for c in COUNTS)}, audit string, repaired_sha256 string"
ARROW = {
    REPAIRED: [pa.field("place", pa.int64()), *[pa.field(c, pa.string()) for c in ("edit", "role", "text")]],
    DIGESTS: [*[pa.field(c, pa.int64()) for c in COUNTS], pa.field("audit", pa.string()), pa.field("repaired_sha256", pa.string())],
}


def repaired(rows: DataFrame, found: DataFrame) -> DataFrame:
    """The conversations' rows after the edits of their audits: (conv_id, place from 1, edit K, R or I, role, text)."""
    return _carried_out(rows, found, REPAIRED, lambda told: told[0], lambda key, *row: [(key, *row)], lambda key: [])


def digests(rows: DataFrame, found: DataFrame) -> DataFrame:
    """found with repaired_sha256 of each repaired conversation: its `role:text` lines joined by newlines, in UTF-8."""

    def line(state, place, edit, role, text):
        state[1].update(b"\n" * (place > 1) + f"{role}:{text}".encode())
        return ()

    return _carried_out(rows, found, DIGESTS, lambda told: (told, hashlib.sha256()), line, lambda state: [(*state[0], state[1].hexdigest())])


def repair(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The damaged rows of a table (conv_id, turn, role, text) and the audits of its conversations, stored."""
    rows = damage(turns)
    return rows, settle(audits(rows), "audits")
