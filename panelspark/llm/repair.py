"""Conversation structure repair: the cheapest edits that give a conversation legal turns.

A legal conversation is empty, or an optional system turn followed by one or more user and
assistant pairs; a role counts by its first letter. Every row is kept (0), reroled to the user
or assistant that is due (1) or deleted (2); an empty user or assistant turn may be inserted
anywhere (5). Blank and repeated rows must be deleted, and a truncated row that stays costs 5
more. Among the cheapest edit sequences the one whose initials (D, I, K, R) sort first is taken.

Method: secondary-sorted streaming. Rows are shuffled once by conversation and sorted within
partitions by (conversation, turn descending); repeated rows are marked by a window over the
same partitioning, so no second shuffle is needed. ``mapInPandas`` walks the rows and carries
four numbers across Arrow batches: the cheapest cost from this row to the end of the
conversation, for each state of the pattern. Walking backwards makes the least-initials rule
local: at each row every state's best choice is final when it is written. That choice takes
two bits, one byte a row for the four states. When a conversation has ended, its choices are
followed forwards from the start state. Choices and turns of a giant conversation go to a
task-local temporary file in blocks, which vanishes with the task; memory stays within
``block_bytes`` however long the conversation is, and a lost executor only costs the task.

Defined results: rows are taken by turn (nulls first), ties by role, then text, in code point
order. A null role or text reads as one space. A null ``conv_id`` is one conversation; a role
without a letter fits nowhere. Conversations of which no row is left have an empty result.
Other columns of the input are not read, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import io
import pickle
import tempfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

VISIBLE = r"[^\x20\x09-\x0D]"
BLOCK_BYTES = 4 << 20

_KEEP, _REROLE, _DELETE, _INSERT, _TRUNCATED = 0, 1, 2, 5, 5
_LETTERS = "DIKR"
# States: 0 nothing written, 1 after the system turn, 2 after a user turn, 3 after a pair.
_DUE = ("user", "user", "assistant", "user")
_NEXT = (2, 2, 3, 2)
_NEVER = 1 << 60

REPORT = (
    "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, "
    "cost bigint, audit string, repaired_sha256 string"
)
TURNS = "place bigint, role string, text string, edit string"


def damage(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, gone): ``conversations`` with seeded faults.

    The CRC-32 of ``conv_id:turn`` modulo 20 picks the fault: 0 marks the row as gone, 1 empties
    the text, 2 removes its sentence ends, 3 repeats the row, 4 makes it a user turn.
    """
    shown = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    fault = F.crc32(F.concat(shown[0], F.lit(":"), shown[1])) % 20
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    marked = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), fault.alias("_fault"))
    times = F.when(F.col("_fault") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return marked.select(
        "conv_id",
        "turn",
        F.when(F.col("_fault") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("_fault") == 1, "")
        .when(F.col("_fault") == 2, F.regexp_replace("text", "[.!?]", ""))
        .otherwise(F.col("text"))
        .alias("text"),
        (F.col("_fault") == 0).alias("gone"),
        F.explode(times).alias("_copy"),
    ).drop("_copy")


def _last_visible(text: Column) -> Column:
    return F.substring(F.rtrim(text, F.lit(" \t\n\x0b\x0c\r")), -1, 1)


def _sorted_rows(rows: DataFrame) -> DataFrame:
    """Rows by conversation, last turn first, with the fault of each: b, d, t or none."""
    gone = F.coalesce(F.col("gone"), F.lit(False)) if "gone" in rows.columns else F.lit(False)
    read = rows.select(
        "conv_id",
        F.col("turn").cast("bigint").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"),
        gone.alias("gone"),
    ).repartition("conv_id")
    same = Window.partitionBy("conv_id", "gone", "role", "text").orderBy(F.col("turn").asc_nulls_first())
    seen = read.withColumn("_nth", F.row_number().over(same))
    fault = (
        F.when(~F.col("text").rlike(VISIBLE), "b")
        .when(F.col("_nth") > 1, "d")
        .when(~_last_visible(F.col("text")).isin(".", "!", "?"), "t")
        .otherwise("")
    )
    return (
        seen.select("conv_id", "turn", "role", "text", "gone", "_nth", fault.alias("fault"))
        .sortWithinPartitions(
            F.col("conv_id").asc_nulls_first(),
            F.col("turn").desc_nulls_last(),
            F.col("role").desc(),
            F.col("text").desc(),
            F.col("_nth").desc(),
        )
        # As text, ids and turns pass through pandas whole, nulls included.
        .select(F.col("conv_id").cast("string"), F.col("turn").cast("string"), "role", "text", "gone", "fault")
    )


class _Conversation:
    """One conversation, met last turn first."""

    def __init__(self, block_bytes: int):
        self.block_bytes = block_bytes
        # At the end a conversation may stop in states 0 and 3; 1 and 2 are closed by inserts.
        self.costs = [0, 2 * _INSERT, _INSERT, 0]
        self.block: list[tuple[int, str, str]] = []
        self.held = 0
        self.offsets: list[int] = []
        self.file = None
        self.counts = {"b": 0, "d": 0, "t": 0, "": 0}
        self.illegal = 0
        self.below: str | None = None
        self.turns: tuple[int | None, int, int | None] = (None, 0, None)

    def add(self, turn: str | None, role: str, text: str, fault: str) -> None:
        self.counts[fault] += 1
        initial = role[:1]
        if self.below is not None and initial + self.below not in ("su", "ua", "au"):
            self.illegal += 1
        self.below = initial
        if turn is not None:
            last, distinct, at = self.turns
            now = int(turn)
            self.turns = (now if last is None else last, distinct + (now != at), now)
        after, now_costs, choices = self.costs, [0] * 4, [0] * 4
        stays = _TRUNCATED if fault == "t" else 0
        for state in range(4):
            best, letter = after[state] + _DELETE, 0
            if fault not in ("b", "d"):
                if initial == _DUE[state][0]:
                    keep = after[_NEXT[state]] + stays + _KEEP
                elif state == 0 and initial == "s":
                    keep = after[1] + stays + _KEEP
                else:
                    keep = _NEVER
                if keep < best:
                    best, letter = keep, 2
                change = after[_NEXT[state]] + stays + _REROLE
                if change < best:
                    best, letter = change, 3
            now_costs[state], choices[state] = best, letter
        # Inserts stay at the same row; two sweeps settle them, as three in a row never pay.
        for state in (2, 3, 2, 0, 1):
            inserted = now_costs[_NEXT[state]] + _INSERT
            if inserted < now_costs[state] or (inserted == now_costs[state] and choices[state] > 1):
                now_costs[state], choices[state] = inserted, 1
        self.costs = now_costs
        self.block.append((choices[0] | choices[1] << 2 | choices[2] << 4 | choices[3] << 6, role, text))
        self.held += len(role) + len(text) + 64
        if self.held > self.block_bytes:
            self._spill()

    def _spill(self) -> None:
        if self.file is None:
            self.file = tempfile.TemporaryFile()
        self.offsets.append(self.file.tell())
        pickle.dump(self.block, self.file, protocol=pickle.HIGHEST_PROTOCOL)
        self.block, self.held = [], 0

    def _forwards(self) -> Iterator[tuple[int, str, str]]:
        yield from reversed(self.block)
        for offset in reversed(self.offsets):
            self.file.seek(offset)
            yield from reversed(pickle.load(self.file))

    def edits(self) -> Iterator[tuple[str, str, str]]:
        """(edit, role, text) in order: the repaired turns, deleted rows among them."""
        state = 0
        for choices, role, text in self._forwards():
            while (letter := choices >> 2 * state & 3) == 1:
                yield "I", _DUE[state], ""
                state = _NEXT[state]
            if letter == 0:
                yield "D", role, text
            elif letter == 2:
                yield "K", role, text
                state = 1 if state == 0 and role[:1] == "s" else _NEXT[state]
            else:
                yield "R", _DUE[state], text
                state = _NEXT[state]
        while state in (1, 2):
            yield "I", _DUE[state], ""
            state = _NEXT[state]
        if self.file is not None:
            self.file.close()

    def gaps(self) -> int:
        last, distinct, first = self.turns
        return 0 if last is None else last - first + 1 - distinct

    def report(self) -> tuple:
        digest, audit, first = hashlib.sha256(), io.StringIO(), True
        for edit, role, text in self.edits():
            audit.write(edit)
            if edit != "D":
                digest.update(("" if first else "\n").encode() + f"{role}:{text}".encode())
                first = False
        return (
            self.gaps(),
            self.counts["b"],
            self.counts["d"],
            self.counts["t"],
            self.illegal,
            self.costs[0],
            audit.getvalue(),
            digest.hexdigest(),
        )


def _walk(batches: Iterator[pd.DataFrame], block_bytes: int) -> Iterator[tuple[str | None, _Conversation]]:
    """The conversations of a partition one by one; the open one lives on between batches."""
    name, open_one = None, None
    for batch in batches:
        columns = (batch[c].tolist() for c in ("conv_id", "turn", "role", "text", "gone", "fault"))
        for conv, turn, role, text, gone, fault in zip(*columns, strict=True):
            if open_one is None or conv != name:
                if open_one is not None:
                    yield name, open_one
                name, open_one = conv, _Conversation(block_bytes)
            if not gone:
                open_one.add(turn, role, text, fault)
    if open_one is not None:
        yield name, open_one


def _frames(rows: Iterator[tuple], names: list[str], most: int = 2000, most_chars: int = 4 << 20) -> Iterator[pd.DataFrame]:
    kept, chars = [], 0
    for row in rows:
        kept.append(row)
        chars += sum(len(x) for x in row if isinstance(x, str))
        if len(kept) >= most or chars >= most_chars:
            yield pd.DataFrame(kept, columns=names)
            kept, chars = [], 0
    if kept:
        yield pd.DataFrame(kept, columns=names)


def _names(schema: str) -> list[str]:
    return ["conv_id", *(part.split()[0] for part in schema.split(", "))]


def repair_report(rows: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per conversation of ``rows`` (conv_id, turn, role, text): faults, cost and edits.

    gaps counts the turn numbers missing between the first and the last, illegal the adjacent
    rows whose role initials are not su, ua or au; blank, duplicate and truncated count each
    row's first fault. audit holds the edits' initials, repaired_sha256 the digest of the
    repaired ``role:text`` lines. Rows with a true ``gone`` column only name their conversation.
    """

    def reports(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        made = ((conv, *one.report()) for conv, one in _walk(batches, block_bytes))
        yield from _frames(made, _names(REPORT))

    return _typed(rows, _sorted_rows(rows).mapInPandas(reports, f"conv_id string, {REPORT}"))


def repair_turns(rows: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The repaired conversations: (conv_id, place, role, text, edit), places counted from 1.

    edit is K, R or I. Conversations that are empty after the repair have no rows.
    """

    def turns(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def each() -> Iterator[tuple]:
            for conv, one in _walk(batches, block_bytes):
                place = 0
                for edit, role, text in one.edits():
                    if edit != "D":
                        place += 1
                        yield conv, place, role, text, edit

        yield from _frames(each(), _names(TURNS))

    return _typed(rows, _sorted_rows(rows).mapInPandas(turns, f"conv_id string, {TURNS}"))


def _typed(rows: DataFrame, out: DataFrame) -> DataFrame:
    """Back to the id's own type."""
    return out.withColumn("conv_id", F.col("conv_id").cast(rows.schema["conv_id"].dataType))
