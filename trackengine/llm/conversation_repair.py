"""Repair of the structure of conversations at the least cost, by Viterbi with survivor coalescence.

A sound conversation is empty, or an optional system turn before pairs of a user and an assistant turn. Every row of a
conversation, in its order, is kept (cost 0), gets the role that is due (2) or is deleted (3); empty turns of the role that
is due are inserted (2). Rows that are blank or repeat an earlier row must go; rows that end without ``.``, ``!`` or ``?`` cost
1 if they stay. Of the cheapest repairs the one whose edits' initials (D, I, K, R) are least in ASCII order is taken.

One survivor is kept for each state of the pattern: the cheapest, then least, way to it. Survivors are leaves of a tree of
edits whose nodes count their references. A survivor that another one can imitate for less than the difference of their
costs is given up; once all survivors descend from one node, the edits up to it are final and written out, and their rows
are let go. So a task holds the rows that are still open, not the conversation. Two tied edits may stay open for as long as
their suffixes are of equal cost; tied suffixes are compared whole: what comes before a row by the survivors' order, which is
carried along, and then what is appended, so that a comparison takes the same time however long they are.

Edge cases: a null role or text is one space. The first character of a role counts (``s``, ``u``, ``a``); other roles, and none, can only be
changed or deleted. Rows of one conversation are ordered by turn (nulls first), role and text; rows that are equal in all
of these repeat one another. Rows without ``conv_id`` make up one conversation. A conversation is one sequence, so one task
works on it, row by row. Other columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


RETYPE, DELETE, INSERT, CUT = 2, 3, 2, 1
WHITE = " \t\n\x0b\x0c\r"
START, SYSTEM, USER, ASSISTANT = range(4)
#: The state after the turn that is due in a state.
_NEXT = (USER, USER, ASSISTANT, USER)
#: What it costs at most to go on from the first state as from the second: by insertions, or by deleting a system turn.
_IMITATE = ((0, 0, INSERT, 0), (2 * INSERT, 0, INSERT, 2 * INSERT), (INSERT + DELETE, INSERT, 0, INSERT), (DELETE, 0, INSERT, 0))
#: Rows that a task hands on at a time.
ROWS = 5_000


class Node:
    """An edit; ``refs`` counts the edits that follow it and the survivors that end in it."""

    __slots__ = ("parent", "edit", "refs")

    def __init__(self, parent: Node | None, edit: str):
        self.parent, self.edit, self.refs = parent, edit, 0
        if parent is not None:
            parent.refs += 1


def _release(node: Node | None) -> None:
    while node is not None:
        node.refs -= 1
        if node.refs:
            break
        node = node.parent


class Repairer:
    """Takes the rows of one conversation, gives ``emit(edit, role, row)`` for each edit; row is None for insertions."""

    def __init__(self, emit: Callable[[str, str | None, tuple | None], None]):
        self.emit, self.rows, self.state = emit, deque(), START
        self.root = Node(None, "")
        self.root.refs = 1
        #: by state: cost, place in the order of the survivors' edits, last edit
        self.survivors: dict[int, tuple[int, int, Node]] = {START: (0, 0, self.root)}

    def add(self, row: tuple, initial: str, must_go: bool, cut: bool) -> None:
        self.rows.append(row)
        best: dict[int, tuple[int, int, str, Node]] = {}

        def offer(state: int, cost: int, place: int, edits: str, node: Node) -> None:
            if state not in best or (cost, place, edits) < best[state][:3]:
                best[state] = (cost, place, edits, node)

        for state, (cost, place, node) in self.survivors.items():
            inserted = ""
            while True:
                offer(state, cost + DELETE, place, inserted + "D", node)
                if not must_go:
                    if initial == "s" and state == START:
                        offer(SYSTEM, cost + CUT * cut, place, inserted + "K", node)
                    due = _NEXT[state]
                    if initial == ("u" if due == USER else "a"):
                        offer(due, cost + CUT * cut, place, inserted + "K", node)
                    else:
                        offer(due, cost + CUT * cut + RETYPE, place, inserted + "R", node)
                if len(inserted) == 2:
                    break
                state, cost, inserted = _NEXT[state], cost + INSERT, inserted + "I"
        kept = {s: x for s, x in best.items() if not any(y[0] + _IMITATE[q][s] < x[0] for q, y in best.items() if q != s)}
        order = {s: k for k, s in enumerate(sorted(kept, key=lambda s: kept[s][1:3]))}
        new = {}
        for s, (cost, _, edits, node) in kept.items():
            for e in edits:
                node = Node(node, e)
            node.refs += 1
            new[s] = (cost, order[s], node)
        self._replace(new)

    def _replace(self, new: dict[int, tuple[int, int, Node]]) -> None:
        old, self.survivors = self.survivors, new
        for _, _, node in old.values():
            _release(node)
        if self.root.refs == 1:
            self._write_out()

    def _write_out(self) -> None:
        """Emits the edits that all survivors share."""
        node = next(iter(self.survivors.values()))[2]
        path = []
        while node is not self.root:
            path.append(node)
            node = node.parent
        ends = {id(x[2]) for x in self.survivors.values()}
        while path and self.root.refs == 1 and id(self.root) not in ends:
            self.root = path.pop()
            self.root.parent = None
            self._emit(self.root.edit)

    def _emit(self, edit: str) -> None:
        row = None if edit == "I" else self.rows.popleft()
        if edit == "D":
            self.emit(edit, None, row)
            return
        system = edit == "K" and self.state == START and row[1][:1] == "s"
        self.state = SYSTEM if system else _NEXT[self.state]
        self.emit(edit, row[1] if edit == "K" else "user" if self.state == USER else "assistant", row)

    def end(self) -> None:
        closing = {START: "", SYSTEM: "II", USER: "I", ASSISTANT: ""}
        done = [(cost + INSERT * len(closing[s]), place, closing[s], node) for s, (cost, place, node) in self.survivors.items()]
        cost, _, edits, node = min(done, key=lambda x: x[:3])
        for e in edits:
            node = Node(node, e)
        node.refs += 1
        self._replace({START: (cost, 0, node)})


def _last_character(text: Column) -> Column:
    return F.right(F.rtrim(text, F.lit(WHITE)), F.lit(1))


def judged(rows: DataFrame) -> DataFrame:
    """The rows of conversations with their first fault: ``blank``, ``duplicate``, ``truncated`` or null; placed and sorted by conversation."""
    of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    plain = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), of("role"), of("text"))
    # one shuffle, by conversation: the window's keys begin with it
    placed = plain.withColumn("content", F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)).repartition("conv_id")
    again = F.row_number().over(Window.partitionBy("conv_id", "content").orderBy(F.col("turn").asc_nulls_first())) > 1
    last = _last_character(F.col("text"))
    fault = F.when(last == "", "blank").when(F.col("again"), "duplicate").when(~last.isin(".", "!", "?"), "truncated")
    out = placed.withColumn("again", again).select("conv_id", "turn", "role", "text", "again", fault.alias("fault"))
    return out.sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text", "again").drop("again")


def repair(rows: DataFrame) -> DataFrame:
    """One row an edit, those of a conversation together and in order: conv_id, place, edit (K, R, D or I), fault, turn,
    old_role, role and text (null where deleted; turn, fault and old_role are null where inserted)."""
    id_type = rows.schema["conv_id"].dataType.simpleString()
    columns = ["conv_id", "place", "edit", "fault", "turn", "old_role", "role", "text"]

    def run(batches):
        out: list[tuple] = []
        conv, place, worker, kinds = None, 0, None, None

        def emit(edit, role, row):
            nonlocal place
            turn, old, text, fault = row or (None, None, "", None)
            out.append((conv, place, edit, fault, turn, old, role, None if edit == "D" else text))
            place += 1

        def packed():
            found = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], columns)
            out.clear()
            return found

        for batch in batches:
            kinds = [batch.schema.field("conv_id").type, pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()]
            for c, turn, role, text, fault in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "turn", "role", "text", "fault")), strict=True):
                if worker is None or c != conv:
                    if worker is not None:
                        worker.end()
                    conv, place, worker = c, 0, Repairer(emit)
                worker.add((turn, role, text, fault), role[:1], fault in ("blank", "duplicate"), fault == "truncated")
                if len(out) >= ROWS:
                    yield packed()
        if worker is not None:
            worker.end()
        if out:
            yield packed()

    schema = f"conv_id {id_type}, place long, edit string, fault string, turn long, old_role string, role string, text string"
    return judged(rows).mapInArrow(run, schema)


def audited(edits: DataFrame) -> DataFrame:
    """One row a conversation from ``repair``'s rows as they come: counts of faults, cost, edits and a digest of the result.

    gaps are the turns that are missing between the first and the last one, illegal counts neighbours that may not follow
    one another before the repair."""
    from hashlib import sha256

    id_type = edits.schema["conv_id"].dataType.simpleString()
    names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]

    class Audit:
        def __init__(self):
            self.n, self.least, self.most, self.turns, self.before = dict.fromkeys(names, 0), None, None, 0, None
            self.edits, self.digest, self.empty = [], sha256(), True

        def add(self, edit, fault, turn, old, role, text):
            self.edits.append(edit)
            self.n["cost"] += {"K": 0, "R": RETYPE, "D": DELETE, "I": INSERT}[edit] + CUT * (fault == "truncated" and edit != "D")
            if fault:
                self.n[fault] += 1
            if edit != "I":
                if turn is not None:
                    self.turns += turn != self.most
                    self.least, self.most = turn if self.least is None else self.least, turn
                if self.before is not None:
                    self.n["illegal"] += self.before + old[:1] not in ("su", "ua", "au")
                self.before = old[:1]
            if edit != "D":
                self.digest.update(("" if self.empty else "\n").encode() + f"{role}:{text}".encode())
                self.empty = False

        def row(self, conv):
            self.n["gaps"] = 0 if self.most is None else self.most - self.least + 1 - self.turns
            return (conv, *self.n.values(), "".join(self.edits), self.digest.hexdigest())

    def make():
        def run(batches):
            audit, conv, kind = None, None, None

            def packed(rows):
                kinds = [kind, *[pa.int64()] * len(names), pa.string(), pa.string()]
                return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["conv_id", *names, "audit", "repaired_sha256"])

            for batch in batches:
                kind, rows = batch.schema.field("conv_id").type, []
                for c, place, *rest in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "place", "edit", "fault", "turn", "old_role", "role", "text")), strict=True):
                    if place == 0:
                        if audit is not None:
                            rows.append(audit.row(conv))
                        audit, conv = Audit(), c
                    audit.add(*rest)
                if rows:
                    yield packed(rows)
            if audit is not None:
                yield packed([audit.row(conv)])

        return run

    return edits.mapInArrow(make(), f"conv_id {id_type}, {', '.join(f'{n} long' for n in names)}, audit string, repaired_sha256 string")


def repaired(rows: DataFrame) -> DataFrame:
    """The sound conversations: conv_id, turn (counted from 0), role and text of every row that stays, changed or inserted."""
    edits = repair(rows).filter("edit <> 'D'")
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("place")) - 1
    return edits.select("conv_id", place.cast("long").alias("turn"), "role", "text")
