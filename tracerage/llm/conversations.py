"""Conversation structure repair as one stream of rows per conversation (operator 12)."""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lean, small_batches, worker_cache

#: What is output so far: nothing; a system row; ... then a user row; ... then an assistant row.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
#: Where a row of an initial leads from a state.
AFTER = {(NOTHING, "s"): SYSTEM, (NOTHING, "u"): USER, (SYSTEM, "u"): USER, (ASSISTANT, "u"): USER, (USER, "a"): ASSISTANT}
#: Rows of empty text that may be put in: their roles and the state they lead to.
INSERTS = {
    NOTHING: (("", NOTHING), ("u", USER), ("ua", ASSISTANT)),
    SYSTEM: (("", SYSTEM), ("u", USER), ("ua", ASSISTANT)),
    USER: (("", USER), ("a", ASSISTANT)),
    ASSISTANT: (("", ASSISTANT), ("u", USER)),
}
#: What has to follow at the end, so that the whole is an optional system row and whole exchanges.
ENDINGS = {NOTHING: "", SYSTEM: "ua", USER: "a", ASSISTANT: ""}
RULES = "DKR"
ROLES = {"u": "user", "a": "assistant"}
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
SPACES = " \t\n\v\f\r"


def text_or_space(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(" "))


def damage(rows: DataFrame) -> DataFrame:
    """The rows after damage by crc32 of ``conv_id:turn``: ``conv_id, turn, role, text, dropped``.

    Of the remainder by 20: 0 drops a row (it stays as a mark without role and text), 1 empties
    its text, 2 takes its full stops, exclamation and question marks, 3 repeats it, 4 makes it the
    user's. A null counts as one space.
    """
    picked = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), text_or_space("role").alias("role"), text_or_space("text").alias("text"), (F.crc32(F.concat(text_or_space("conv_id"), F.lit(":"), text_or_space("turn")).cast("binary")) % 20).cast("int").alias("k"))
    text = F.when(F.col("k") == 1, "").when(F.col("k") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("k") == 4, "user").otherwise(F.col("role"))
    changed = picked.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("k") == 0).alias("dropped"), F.explode(F.when(F.col("k") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")).drop("copy")
    return changed.select("conv_id", "turn", *(F.when(~F.col("dropped"), F.col(c)).alias(c) for c in ("role", "text")), "dropped")


def later_copies(rows: DataFrame) -> DataFrame:
    """``conv_id, turn, role, digest`` of rows whose role and text came at an earlier turn of their conversation.

    Found by digests, which are counted before they are shuffled: a text that a conversation
    repeats any number of times is no hot group, and no task keeps what a conversation has said.
    """
    keys = rows.where("not dropped").select("conv_id", "turn", "role", F.sha2("text", 256).alias("digest"))
    at = F.struct(F.col("turn").isNotNull(), F.col("turn"))
    first = keys.groupBy("conv_id", "role", "digest").agg(F.min(at).alias("first"), F.max(at).alias("last")).where("first < last")
    same = [F.col(f"k.{c}").eqNullSafe(F.col(f"f.{c}")) for c in ("conv_id", "role", "digest")]
    return keys.alias("k").join(first.alias("f"), same).where(F.struct(F.col("k.turn").isNotNull(), F.col("k.turn")) > F.col("f.first")).select("k.conv_id", "k.turn", "k.role", "k.digest").distinct()


def stream(rows: DataFrame, marks: DataFrame, kind: str) -> DataFrame:
    """Rows and marks dealt by conversation and sorted by turn (nulls first), marks before rows, then by role and text.

    ``conv_id, turn, kind, role, text``; kind 0 only says that there is such a conversation, 2 is a
    row, anything else is a mark. Texts are shuffled here and nowhere else.
    """
    small_batches(rows.sparkSession)
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    both = rows.select("conv_id", F.when(F.col("dropped"), None).otherwise(F.col("turn")).alias("turn"), F.when(F.col("dropped"), 0).otherwise(2).alias("kind"), "role", "text").unionByName(marks.select("conv_id", "turn", F.lit(1).alias("kind"), "role", F.col(kind).alias("text")))
    dealt = both.repartition(n, "conv_id").sortWithinPartitions(*(F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "kind", "role", "text")))
    # As strings, numbers keep all their digits beside nulls in pandas.
    return dealt.select(F.col("conv_id").cast("string").alias("conv_id"), F.col("turn").cast("string").alias("turn"), "kind", "role", "text")


@lru_cache(1 << 16)
def step(states: tuple, initial: str, must_go: bool, extra: int) -> tuple[int, tuple, tuple]:
    """One row on: ``(least cost added, states, ways)``.

    A state is None or ``(cost above the least, rank of its edits)``; a way tells for each state
    where its best edits come from: ``(state before, inserts, letter, role)``. Inserts stand before
    a row's own letter, so of two different edits up to a row neither begins with the other, and
    their order never changes later: ranks are enough to find the least edits of all.
    """
    found: dict[int, tuple] = {}
    for state, have in enumerate(states):
        if have is None:
            continue
        for put_in, mid in INSERTS[state]:
            edits = [("D", mid, DELETE, "")]
            if not must_go:
                edits += [("K", AFTER[mid, initial], extra, "")] if (mid, initial) in AFTER else []
                edits += [("R", AFTER[mid, r], REROLE + extra, r) for r in "ua" if (mid, r) in AFTER and r != initial]
            for letter, to, cost, role in edits:
                way = (have[0] + INSERT * len(put_in) + cost, have[1], "I" * len(put_in) + letter, state, put_in, letter, role)
                if to not in found or way < found[to]:
                    found[to] = way
    least = min(w[0] for w in found.values())
    order = {to: i for i, to in enumerate(sorted(found, key=lambda t: found[t][1:3]))}
    after = tuple((found[t][0] - least, order[t]) if t in found else None for t in range(4))
    return least, after, tuple(found[t][3:] if t in found else None for t in range(4))


class Trail:
    """Four bytes a row: for each state the state before, the inserts and the letter.

    Beyond ``most`` bytes blocks go to a file of the task without a name, which ends with it; if the
    executor is lost, its task starts again from the shuffled rows.
    """

    def __init__(self, most: int = 4 << 20):
        self.most, self.block, self.file, self.sizes = most, bytearray(), None, []

    def add(self, ways: tuple) -> None:
        self.block += bytes(0xFF if w is None else w[0] | len(w[1]) << 2 | RULES.index(w[2]) << 4 for w in ways)
        if len(self.block) >= self.most:
            self.file = self.file or tempfile.TemporaryFile()
            self.file.write(self.block)
            self.sizes.append(len(self.block))
            self.block = bytearray()

    def blocks_back(self) -> Iterator[bytes]:
        yield bytes(self.block)
        end = sum(self.sizes)
        for size in reversed(self.sizes):
            end -= size
            self.file.seek(end)
            yield self.file.read(size)

    def edits(self, state: int) -> str:
        """The letters that lead to a state, in order."""
        out = []
        for block in self.blocks_back():
            letters = []
            for at in range(len(block) - 4, -1, -4):
                way = block[at + state]
                letters.append(RULES[way >> 4] + "I" * (way >> 2 & 3))
                state = way & 3
            out.append("".join(letters))
        return "".join(out)[::-1]

    def close(self) -> None:
        if self.file is not None:
            self.file.close()


class Conversation:
    """What is kept of one conversation between rows: four states, each with the hash of its rows so far, and a trail."""

    def __init__(self, conv_id, spill: int):
        self.conv_id, self.trail = conv_id, Trail(spill)
        self.states, self.cost, self.hashes = ((0, 0), None, None, None), 0, [hashlib.sha256(), None, None, None]
        self.turns, self.low, self.high, self.last_turn = 0, None, None, None
        self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.before: tuple | None = None
        self.marks: set = set()

    def mark(self, turn, role: str, digest: str) -> None:
        if turn != self.last_turn:
            self.marks = set()
            self._turn(turn)
        self.marks.add((role, digest))

    def _turn(self, turn) -> None:
        if turn is not None and turn != self.last_turn:
            self.turns, self.low, self.high = self.turns + 1, turn if self.low is None else self.low, turn
        self.last_turn = turn

    def row(self, turn, role: str, text: str) -> None:
        if turn != self.last_turn:
            self.marks = set()
        self._turn(turn)
        shown = text.rstrip(SPACES)
        blank = not shown
        again = not blank and ((turn, role, text) == self.before or bool(self.marks) and (role, hashlib.sha256(text.encode()).hexdigest()) in self.marks)
        cut = not blank and not again and shown[-1] not in ".!?"
        if self.before is not None:
            self.illegal += self.before[1][:1] + role[:1] not in ("su", "ua", "au")
        self.before = (turn, role, text)
        self.blank, self.duplicate, self.truncated = self.blank + blank, self.duplicate + again, self.truncated + cut
        initial = role[:1] if role[:1] in "sua" else ""
        least, self.states, ways = step(self.states, initial, blank or again, TRUNCATED * cut)
        self.cost += least
        self.trail.add(ways)
        hashes, data = [None] * 4, text.encode()
        for to, way in enumerate(ways):
            if way is not None:
                state, put_in, letter, new_role = way
                if not put_in and letter == "D":
                    hashes[to] = self.hashes[state]
                    continue
                lines = [f"{ROLES[r]}:".encode() for r in put_in]
                if letter != "D":
                    lines.append(ROLES.get(new_role, role).encode() + b":" + data)
                made = hashes[to] = self.hashes[state].copy()
                made.update((b"" if state == NOTHING else b"\n") + b"\n".join(lines))
        self.hashes = hashes

    def result(self) -> tuple:
        ends = [(have[0] + INSERT * len(ENDINGS[s]), have[1], s) for s, have in enumerate(self.states) if have is not None]
        cost, _, state = min(ends)
        audit = self.trail.edits(state) + "I" * len(ENDINGS[state])
        self.trail.close()
        digest = self.hashes[state].copy()
        for r in ENDINGS[state]:
            digest.update(f"\n{ROLES[r]}:".encode())
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return self.conv_id, gaps, self.blank, self.duplicate, self.truncated, self.illegal, self.cost + cost, audit, digest.hexdigest()


def whole(x):
    """None for what pandas has in place of a null."""
    return None if x is None else int(x)


REPAIRS = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def find_repairs(rows: DataFrame, spill: int = 4 << 20) -> DataFrame:
    """The cheapest edits of each conversation that give an optional system row and whole exchanges.

    ``rows`` has ``conv_id, turn, role, text, dropped`` as damage() gives them. Returns, for each
    conv_id, counts of gaps between turns, blank, repeated and cut off rows and of neighbours whose
    roles can't follow each other, the cost and letters of the edits (Keep, Rerole, Delete, Insert)
    and the hash of the repaired rows ``role:text``, joined by line feeds.

    Rows go by turn (nulls first), those of one turn by role and text. Each conversation is one
    sorted stream: four states, their hashes and a trail of four bytes a row, which goes to disk
    beyond ``spill`` bytes, are all that is kept, whatever its length. Of equally cheap edits those
    whose letters come first in ASCII are taken. Null conv_ids are one conversation; a conversation
    of which nothing is left has zeros, no edits and the hash of nothing. Repeated rows are
    duplicates of the first one. An empty table gives an empty table; other columns are ignored.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        worker_cache()
        now: Conversation | None = None
        for pdf in batches:
            out = []
            for conv, turn, kind, role, text in zip(map(whole, pdf["conv_id"]), map(whole, pdf["turn"]), pdf["kind"], pdf["role"], pdf["text"], strict=True):
                if now is None or now.conv_id != conv:
                    if now is not None:
                        out.append(now.result())
                    now = Conversation(conv, spill)
                if kind == 1:
                    now.mark(turn, role, text)
                elif kind == 2:
                    now.row(turn, role, text)
            if out:
                yield _frame(out)
        if now is not None:
            yield _frame([now.result()])

    return stream(rows, later_copies(rows), "digest").mapInPandas(lean(run), REPAIRS)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    names = [c.split()[0] for c in REPAIRS.split(", ")]
    out = pd.DataFrame(rows, columns=names)
    out["conv_id"] = pd.array([r[0] for r in rows], "Int64")
    return out


def apply_repairs(rows: DataFrame, repairs: DataFrame) -> DataFrame:
    """The repaired rows, ``conv_id, position, role, text``, from the same rows and their ``audit``.

    The edits go ahead of each conversation's rows in the same kind of stream, so a conversation of
    any length is written row by row.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        conv, edits, end, at, position, last = object(), "", 0, 0, 0, ""

        def made(role: str, text: str) -> tuple:
            nonlocal position, last
            position, last = position + 1, role[:1]
            return conv, position, role, text

        def inserts(out: list) -> None:
            nonlocal at
            while at < len(edits) and edits[at] == "I":
                at += 1
                out.append(made("assistant" if last == "u" else "user", ""))

        for pdf in batches:
            out: list = []
            for key, kind, role, text in zip(map(whole, pdf["conv_id"]), pdf["kind"], pdf["role"], pdf["text"], strict=True):
                if key != conv:
                    conv, edits, end, at, position, last = key, "", 0, 0, 0, ""
                if kind == 1:
                    edits, end = text, len(text.rstrip("I"))
                    continue
                if kind == 0:
                    continue
                inserts(out)
                letter, at = edits[at], at + 1
                if letter == "K":
                    out.append(made(role, text))
                elif letter == "R":
                    out.append(made("assistant" if last == "u" else "user", text))
                if at == end:
                    inserts(out)
            frame = pd.DataFrame(out, columns=["conv_id", "position", "role", "text"])
            frame["conv_id"] = pd.array([r[0] for r in out], "Int64")
            yield frame

    # The edits come first of all: no turn, and a kind before that of rows.
    marks = repairs.select("conv_id", F.lit(None).cast("long").alias("turn"), F.lit(None).cast("string").alias("role"), "audit")
    return stream(rows, marks, "audit").mapInPandas(lean(run), "conv_id long, position long, role string, text string")
