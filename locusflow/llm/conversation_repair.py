"""Repair of conversation structure by cheapest edits, worked out on a suffix-shared DAWG.

A conversation becomes a word: one letter for each row, for the initial of its role and
its fault.  Distinct words are spread by their reversed order, so that words with a common
end meet; from the end, equal rests are one automaton node.  Each node and grammar state
gets its cost to go and its first edit once, whatever number of words lead there: the
best audit of a rest is that edit and the best audit of the node behind it.  Words are then read
off by following those links, all words at once.

Grammar of role initials: nothing, or an optional ``s`` and then ``ua`` once or more.
Edits: Keep 0, Rerole to user or assistant 3, Delete 4 (blank and duplicate rows must go),
Insert an empty user or assistant row 3; a truncated row that stays costs 3 more.  Among
cheapest audits the ASCII-least is taken.  Each state allows one user or assistant row, so
the edits at a place have different letters and the least audit is the least first letter.

Faults, the first that holds: blank (no character outside ``[\\x20\\x09-\\x0D]``), duplicate
(role and text seen earlier in the conversation, compared by 256-bit digests), truncated
(the last such character is none of ``.!?``).

Defined results: null roles and texts are read as one space (so null texts are blank, and
null roles never fit the grammar); rows without a conversation id are one conversation; rows
without a turn come first; rows of one turn are taken by role, then by the digest of the text; repeated
rows are duplicates; a conversation all of whose rows are dropped has zeros, an empty audit
and the digest of an empty text; an empty table gives an empty table; columns beside the
four are left out.  Texts, also very long ones, are streamed in sorted order.  Only a conversation's word (one
byte for each row) and its audit, which the result holds in one cell, are held whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import join_checked

#: Letters: a row that must go; else initial s, u, a or another, in lower case where it is truncated.
LETTERS = "DSUAXsuax"
START, BEHIND_S, BEHIND_U, BEHIND_A = range(4)
#: The state behind a user or assistant row where the grammar allows one: u from all states but BEHIND_U, there a.
NEXT = np.array([BEHIND_U, BEHIND_U, BEHIND_A, BEHIND_U])
DELETE, INSERT, KEEP, REROLE = 4, 3, 0, 3
TRUNCATED = 3
END_COST = np.array([0, 2 * INSERT, INSERT, 0], np.int64)
NEVER = np.int64(1) << 40
#: Words that are read off together, by their letters.
LETTERS_AT_ONCE = 1_000_000
#: Distinct words that may be broadcast (each with its audit, which is about as long).
MOST_BROADCAST = 2_000


def damage(rows: DataFrame) -> DataFrame:
    """Every row by crc32 of ``conv_id:turn`` (null: one space) modulo 20: 0 dropped (kept here with ``gone``), 1 emptied, 2 without ``[.!?]``, 3 repeated, 4 with role user."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn")).cast("binary")) % 20
    hurt = rows.select(
        "conv_id", "turn", (kind == 0).alias("gone"), F.when(kind == 4, "user").otherwise(text("role")).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text("text"), "[.!?]", "")).otherwise(text("text")).alias("text"),
        F.explode(F.when(kind == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy"),
    )
    return hurt.drop("copy")


def words(rows: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, word) of rows (conv_id, turn, role, text, gone)."""
    last = F.regexp_extract("text", r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*$", 1)
    slim = rows.select("conv_id", "turn", "role", "gone", F.sha2("text", 256).alias("digest"), (last == "").alias("blank"), (~last.rlike("^[.!?]$")).alias("cut"))
    ordered = Window.partitionBy("conv_id").orderBy("gone", F.asc_nulls_first("turn"), "role", "digest")
    same = Window.partitionBy("conv_id", "gone", "role", "digest").orderBy(F.asc_nulls_first("turn"))
    # one exchange by conversation serves all that follows
    placed = slim.repartition("conv_id").withColumn("seen", F.row_number().over(same) > 1)
    initial = F.substring("role", 1, 1)
    placed = placed.withColumns({
        "n": F.row_number().over(ordered), "new_turn": F.col("turn").isNotNull() & ~F.lag("turn").over(ordered).eqNullSafe(F.col("turn")),
        "pair": F.concat(F.lag(initial).over(ordered), initial),
    })
    fault = F.when(F.col("gone"), F.lit(None)).when(F.col("blank"), "blank").when(F.col("seen"), "duplicate").when(F.col("cut"), "truncated").otherwise("")
    letter = F.when(initial.isin("s", "u", "a"), F.upper(initial)).otherwise("X")
    letter = F.when(F.col("fault").isin("blank", "duplicate"), "D").when(F.col("fault") == "truncated", F.lower(letter)).otherwise(letter)
    marked = placed.withColumn("fault", fault).withColumn("letter", F.when(~F.col("gone"), letter))
    live = F.when(~F.col("gone"), F.col("turn"))
    span = F.max(live) - F.min(live) + 1 - F.count_if(~F.col("gone") & F.col("new_turn"))
    list_ = F.array_sort(F.collect_list(F.when(~F.col("gone"), F.struct("n", "letter"))))
    return marked.groupBy("conv_id").agg(
        F.coalesce(span, F.lit(0)).cast("long").alias("gaps"), *(F.count_if(F.col("fault") == f).alias(f) for f in ("blank", "duplicate", "truncated")),
        F.count_if(~F.col("gone") & ~F.col("pair").isin("su", "ua", "au")).alias("illegal"), F.array_join(F.transform(list_, lambda x: x["letter"]), "").alias("word"),
    )


class SuffixDawg:
    """Nodes of the rests of a batch of words: node 0 is the empty rest; ``cost`` and ``edit`` hold the cost to go and the first edit of each node and grammar state."""

    def __init__(self, batch: list[str]):
        self.batch = batch
        raw = np.frombuffer("".join(batch).encode(), np.uint8)
        code = np.zeros(256, np.int64)
        code[list(LETTERS.encode())] = np.arange(len(LETTERS))
        letters, length = code[raw], np.array([len(w) for w in batch], np.int64)
        end = np.cumsum(length)
        node = np.zeros(len(batch), np.int64)
        self.letter, self.rest = [np.zeros(1, np.int64)], [np.zeros(1, np.int64)]
        self.cost, self.edit = [END_COST[None]], [np.array([[0, ord("I"), ord("I"), 0]], np.uint8)]
        size = 1
        for k in range(1, int(length.max(initial=0)) + 1):  # all words from their ends, one letter a step
            on = np.flatnonzero(length >= k)
            key, node_of = np.unique(node[on] * len(LETTERS) + letters[end[on] - k], return_inverse=True)
            rest, letter = key // len(LETTERS), key % len(LETTERS)
            cost, edit = self._settle(letter, self._cost_of(rest, size))
            for held, new in ((self.letter, letter), (self.rest, rest), (self.cost, cost), (self.edit, edit)):
                held.append(new)
            node[on], self.level, size = size + node_of, (size, cost), size + len(key)
        self.letter, self.rest, self.cost, self.edit = (np.concatenate(x) for x in (self.letter, self.rest, self.cost, self.edit))
        self.node = node

    def _cost_of(self, node: np.ndarray, size: int) -> np.ndarray:
        """Costs of nodes of the level before (rests of the next length all lie there)."""
        if size == 1:
            return np.repeat(END_COST[None], len(node), axis=0)
        first, cost = self.level
        return cost[node - first]

    @staticmethod
    def _settle(letter: np.ndarray, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cost to go and first edit of nodes, for each state, from their letters and the costs of their rests."""
        must_go = (letter == 0)[:, None]
        cut = np.where(letter > 4, TRUNCATED, 0)[:, None]
        initial = np.where(letter > 4, letter - 4, letter)  # 1 s, 2 u, 3 a, 4 another
        fits = np.stack([np.isin(initial, (1, 2)), initial == 2, initial == 3, initial == 2], axis=1)
        target = np.broadcast_to(NEXT, fits.shape).copy()
        target[initial == 1, START] = BEHIND_S
        delete = DELETE + rest
        keep = np.where(fits & ~must_go, KEEP + cut + np.take_along_axis(rest, target, axis=1), NEVER)
        rerole = np.where(must_go, NEVER, REROLE + cut + rest[:, NEXT])
        best = np.minimum(np.minimum(delete, keep), rerole)
        # an insertion leads to another state of the same node; two in a row come round to a state again
        whole = best.copy()
        for _ in range(3):
            whole = np.minimum(best, INSERT + whole[:, NEXT])
        insert = INSERT + whole[:, NEXT]
        edit = np.select([delete == whole, insert == whole, keep == whole], [ord("D"), ord("I"), ord("K")], ord("R")).astype(np.uint8)
        return whole, edit

    def audits(self) -> list[str]:
        """The audit of every word: all words follow their links together."""
        node, state, row = self.node.copy(), np.zeros(len(self.node), np.int64), np.arange(len(self.node))
        rows, edits = [], []
        while len(row):
            edit = self.edit[node, state]
            on = edit != 0  # the empty rest in a state that may end
            row, node, state, edit = row[on], node[on], state[on], edit[on]
            rows.append(row)
            edits.append(edit)
            kept_s = (edit == ord("K")) & (state == START) & np.isin(self.letter[node], (1, 5))
            state = np.where(edit == ord("D"), state, np.where(kept_s, BEHIND_S, NEXT[state]))
            node = np.where(edit == ord("I"), node, self.rest[node])
        row, edit = np.concatenate(rows), np.concatenate(edits)
        flat = edit[np.argsort(row, kind="stable")].tobytes().decode()
        ends = np.cumsum(np.bincount(row, minlength=len(self.node))).tolist()
        return [flat[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]


def plan_edits(distinct: DataFrame) -> DataFrame:
    """(word, cost, audit) of distinct words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = batch.column(0).to_pylist()
            at = 0
            while at < len(held):
                to, letters = at, 0
                while to < len(held) and (to == at or letters + len(held[to]) <= LETTERS_AT_ONCE):
                    letters, to = letters + len(held[to]), to + 1
                dawg = SuffixDawg(held[at:to])
                yield pa.RecordBatch.from_arrays([pa.array(dawg.batch), pa.array(dawg.cost[dawg.node, START]), pa.array(dawg.audits(), pa.string())], names=["word", "cost", "audit"])
                at = to

    end_first = F.reverse("word")
    return distinct.repartitionByRange(end_first).sortWithinPartitions(end_first).select("word").mapInArrow(run, "word string, cost long, audit string")


class _Repair:
    """Applies an audit to the rows of one conversation as they come, and hashes what is left."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state, self.hash, self.empty = audit, 0, START, hashlib.sha256(), True

    def _write(self, line: bytes) -> None:
        if not self.empty:
            self.hash.update(b"\n")
        self.hash.update(line)
        self.empty = False

    def _step(self) -> bytes:
        name = b"assistant" if self.state == BEHIND_U else b"user"
        self.state = int(NEXT[self.state])
        return name

    def inserts(self) -> None:
        while self.audit[self.at : self.at + 1] == "I":
            self._write(self._step() + b":")
            self.at += 1

    def row(self, role: str, text: str) -> None:
        self.inserts()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "R":
            self._write(self._step() + b":" + text.encode())
        elif edit == "K":
            self.state = BEHIND_S if role.startswith("s") else int(NEXT[self.state])
            self._write(f"{role}:{text}".encode())

    def digest(self) -> str:
        self.inserts()
        return self.hash.hexdigest()


def apply_edits(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """``audits(conv_id, audit, ...)`` with ``repaired_sha256``: every conversation's audit goes before its rows, which are read in order."""
    columns = [c for c in audits.columns if c != "conv_id"]
    head = audits.select("conv_id", F.struct(*columns).alias("head"), F.lit(None).cast(rows.schema["turn"].dataType).alias("turn"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"))
    body = rows.filter(~F.col("gone")).select("conv_id", F.lit(None).cast(head.schema["head"].dataType).alias("head"), "turn", "role", "text")
    order = [F.col("conv_id"), F.col("head").isNull(), F.asc_nulls_first("turn"), F.col("role"), F.sha2("text", 256)]
    dealt = head.unionByName(body).repartition("conv_id").sortWithinPartitions(*order).select("conv_id", "head", "role", "text")
    at_audit = columns.index("audit")
    key, head_kind = rows.schema["conv_id"].dataType.simpleString(), head.schema["head"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current = None

        def close() -> pa.RecordBatch:
            conv, top, repair = current
            return pa.RecordBatch.from_arrays([conv, top, pa.array([repair.digest()])], names=["conv_id", "head", "repaired_sha256"])

        for batch in batches:
            heads, roles, texts = batch.column(1), batch.column(2), batch.column(3)
            is_head = heads.is_valid().to_numpy(zero_copy_only=False)
            for i in range(batch.num_rows):
                if is_head[i]:
                    if current:
                        yield close()
                    current = batch.column(0).slice(i, 1), heads.slice(i, 1), _Repair(heads.field(at_audit)[i].as_py())
                else:
                    current[2].row(roles[i].as_py(), texts[i].as_py())
        if current:
            yield close()

    done = dealt.mapInArrow(run, f"conv_id {key}, head {head_kind}, repaired_sha256 string")
    return done.select("conv_id", *(F.col("head")[c].alias(c) for c in columns), "repaired_sha256")


def repair(rows: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of rows (conv_id, turn, role, text, gone)."""
    counted = words(rows)
    distinct = counted.select("word").distinct()
    planned = join_checked(counted, plan_edits(distinct), "word", "inner", MOST_BROADCAST)
    return apply_edits(rows, planned.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"))


def repair_damaged(conversations: DataFrame) -> DataFrame:
    """``repair`` of ``damage(conversations)``; every conversation of the input has its row."""
    return repair(damage(conversations.select("conv_id", "turn", "role", "text")))
