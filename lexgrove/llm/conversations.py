"""Conversation structure repair: the cheapest edits that give a conversation's turns a lawful order of roles.

A conversation's turns, by turn number (nulls first; within one number by the first 16 characters of the role, the first 64 of
the text and a hash of both), are to have the role initials ``(s?(ua)+)?``. Edits and costs: Keep 0, Rerole (to user or
assistant) 2, Delete 3, Insert an empty turn of user or assistant 2, anywhere; an undeleted truncated turn costs 1 more.
A blank turn (no character but white space) and a duplicate (role and text stood earlier in the conversation) must be
deleted; a truncated turn's last character that isn't white space is none of ``.!?``. Only a turn's first fault counts.

The grammar has four states, and in each one role only can follow, so an edit's letter (D, I, K, R) names the next state.
The costs to go from each state are found backwards over the turns; the walk forward takes the ASCII-least letter whose
cost and costs to go from there make up the costs to go from here. As costs to go matter only by their differences, which
are few, a step is looked up by the turn's code and the costs behind it.

No conversation is one task's: turns are dealt by ranges of (conversation, turn, ...) and cut to *blocks* of bounded rows and
bytes. A block that holds its conversation whole is settled where it is. Of the others, each block's costs from state to state are
a matrix of 16 numbers; these are chained backwards for the costs behind each block, then forwards for the state it
begins in, one small row a block. What must pass in order through one task, streamed, is the hash of a conversation's text.

Nulls: a null role or text is one space; a null conversation id is a conversation of its own. Rows that repeat all four
columns are counted before they are dealt: the first stands for the turn, the others are duplicates. Empty tables give no
rows. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared_folder import written

#: The roles' initials, the cost of each edit, and what ends a turn that isn't truncated.
INITIALS = "sua"
COSTS = {"D": 3, "I": 2, "K": 0, "R": 2}
ENDS = (".", "!", "?")
WHITE = " \t\n\x0b\x0c\r"

#: More than any costs.
FAR = 1 << 50
#: States: 0 nothing yet, 1 after system, 2 after user, 3 after assistant. A kept turn's next state by its role's initial.
KEPT = {0: (1, None, None, None), 1: (2, 2, None, 2), 2: (None, None, 3, None), 3: (None, None, None, None)}
#: The state after the one turn that may be inserted, or be made of another.
FILLED = (2, 2, 3, 2)
FILL_ROLE = ("user", "user", "assistant", "user")
#: A turn's code is its initial's number (3: another) and 4 if it is truncated; DELETED must go.
DELETED = 8
#: Characters of text in a block, but for a longer turn.
BLOCK_CHARS = 1 << 18


def _filled(costs: tuple[int, ...]) -> tuple[int, ...]:
    """Costs to go, if turns may be inserted first."""
    for _ in range(3):
        costs = tuple(min(c, COSTS["I"] + costs[FILLED[q]], FAR) for q, c in enumerate(costs))
    return costs


#: Costs to go after the last turn.
END = _filled((0, FAR, FAR, 0))


@lru_cache(1 << 16)
def _step(code: int, after: tuple[int, ...]) -> tuple[tuple[int, ...], int, tuple[tuple[str, int] | None, ...]]:
    """Of a turn and the costs to go after it: those before it (the least being 0), what was taken off them, and from each
    state the letters of the walk and the state after the turn."""
    late, kept = code >> 2, KEPT[code & 3]
    ways = []
    for q in range(4):
        way = {"D": (COSTS["D"] + after[q], q), "R": (COSTS["R"] + late + after[FILLED[q]], FILLED[q])}
        if kept[q] is not None:
            way["K"] = (late + after[kept[q]], kept[q])
        ways.append(way)
    before = _filled(tuple(min(c for c, _ in way.values()) for way in ways))
    moves = []
    for q in range(4):
        letters, at = "", q
        while before[q] < FAR:
            tight = [x for x, (c, _) in ways[at].items() if c == before[at]]
            if COSTS["I"] + before[FILLED[at]] == before[at]:
                tight.append("I")
            letters += min(tight)
            if letters[-1] != "I":
                moves.append((letters, ways[at][letters[-1]][1]))
                break
            at = FILLED[at]
        else:
            moves.append(None)
    least = min(before)
    return tuple(min(c - least, FAR) for c in before), least, tuple(moves)


def costs_before(codes: bytes, runs: np.ndarray, after: tuple[int, ...]) -> tuple[int, ...]:
    """Costs to go before the turns of a block."""
    total = min(after)
    after = tuple(min(c - total, FAR) for c in after)
    for code, run in zip(reversed(codes), reversed(runs.tolist()), strict=True):
        if code == DELETED:
            total += COSTS["D"] * run
        else:
            after, least, _ = _step(code, after)
            total += least
    return tuple(min(c + total, FAR) for c in after)


def walk(codes: bytes, runs: np.ndarray, state: int, after: tuple[int, ...] | None) -> tuple[list[str], int]:
    """The letters for each entry of a block (and those after the last turn, if ``after`` is None: the conversation ends), and
    the state that it ends in."""
    behind = END if after is None else after
    least = min(behind)
    behind = tuple(min(c - least, FAR) for c in behind)
    steps = []
    for code in reversed(codes):
        steps.append(None)
        if code != DELETED:
            behind, _, steps[-1] = _step(code, behind)
    letters = []
    for moves, run in zip(reversed(steps), runs.tolist(), strict=True):
        if moves is None:
            letters.append("D" * run)
        else:
            own, state = moves[state]
            letters.append(own)
    if after is None:
        letters.append({0: "", 1: "II", 2: "I", 3: ""}[state])
    return letters, state


def edited(codes: bytes, letters: list[str], state: int, roles: list[str], texts: list[str]) -> tuple[list[str], list[str], int]:
    """The repaired turns' roles and texts, and the cost of the edits. roles and texts: of the entries that may stay."""
    out_roles, out_texts, cost, place = [], [], 0, 0
    for code, own in zip([*codes, None], [*letters, ""][: len(codes) + 1], strict=True):
        cost += sum(COSTS[x] for x in own)
        for x in own if code != DELETED else "":
            if x in "IR":
                out_roles.append(FILL_ROLE[state])
                out_texts.append("" if x == "I" else texts[place])
                state = FILLED[state]
            elif x == "K":
                out_roles.append(roles[place])
                out_texts.append(texts[place])
                state = KEPT[code & 3][state]
            if x in "KR":
                cost += code >> 2
        place += code is not None and code != DELETED
    return out_roles, out_texts, cost


#: A block: what it holds of its conversation. turns: how many different ones.
BLOCK = "conv_id long, block long, whole boolean, codes binary, runs binary, roles array<string>, texts array<string>, first_turn long, last_turn long, turns long, blank long, duplicate long, truncated long, illegal long, first_initial string, last_initial string, matrix array<long>"
BLOCK_SCHEMA = pa.schema([
    ("conv_id", pa.int64()), ("block", pa.int64()), ("whole", pa.bool_()), ("codes", pa.binary()), ("runs", pa.binary()), ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string())),
    ("first_turn", pa.int64()), ("last_turn", pa.int64()), *((c, pa.int64()) for c in ("turns", "blank", "duplicate", "truncated", "illegal")), ("first_initial", pa.string()), ("last_initial", pa.string()), ("matrix", pa.list_(pa.int64())),
])
LAWFUL = {"su", "ua", "au"}


class _Open:
    """The block that is being read."""

    def __init__(self, conv: int | None):
        self.conv, self.codes, self.runs, self.roles, self.texts, self.chars = conv, bytearray(), [], [], [], 0
        self.first_turn = self.last_turn = self.first_initial = self.last_initial = None
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = 0

    def add(self, turn: int | None, role: str, text: str, fault: str, rows: int) -> None:
        if turn is not None and turn != self.last_turn:
            self.first_turn = turn if self.first_turn is None else self.first_turn
            self.last_turn, self.turns = turn, self.turns + 1
        initial = role[:1]
        if self.last_initial is None:
            self.first_initial = initial
        else:
            self.illegal += self.last_initial + initial not in LAWFUL
        self.illegal += (rows - 1) * (2 * initial not in LAWFUL)
        self.last_initial = initial
        again = rows - (fault not in ("blank", "duplicate"))
        self.blank += rows if fault == "blank" else 0
        self.duplicate += again if fault != "blank" else 0
        if again < rows:
            self.truncated += fault == "truncated"
            found = INITIALS.find(initial) if initial else -1
            self.codes.append((found if found >= 0 else 3) + 4 * (fault == "truncated"))
            self.runs.append(1)
            self.roles.append(role)
            self.texts.append(text)
            self.chars += len(role) + len(text)
        if again:
            self.codes.append(DELETED)
            self.runs.append(again)

    def row(self, block: int, whole: bool) -> dict:
        codes, runs = bytes(self.codes), np.array(self.runs, np.int64)
        matrix = None if whole else [c for q in range(4) for c in costs_before(codes, runs, tuple(0 if q == x else FAR for x in range(4)))]
        own = {c: getattr(self, c) for c in ("roles", "texts", "first_turn", "last_turn", "turns", "blank", "duplicate", "truncated", "illegal", "first_initial", "last_initial")}
        return own | {"conv_id": self.conv, "block": block, "whole": whole, "codes": codes, "runs": runs.tobytes(), "matrix": matrix}


def _blocks(batches: Iterator[pa.RecordBatch], block_rows: int) -> Iterator[pa.RecordBatch]:
    """Cuts sorted turns to blocks. Of a partition's first and last conversation others may have turns, too."""
    base, n, now, split, first = TaskContext.get().partitionId() << 32, 0, None, False, True
    made: list[dict] = []
    held = 0
    for batch in batches:
        for conv, turn, role, text, fault, rows in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "fault", "rows")), strict=True):
            ended = now is not None and now.conv != conv
            if ended or now is not None and (len(now.codes) >= block_rows or now.chars >= BLOCK_CHARS):
                held += now.chars
                made.append(now.row(base | n, ended and not split and not first))
                n, split, first, now = n + 1, not ended, first and not ended, None
                if held >= BLOCK_CHARS or len(made) >= 1000:
                    yield pa.RecordBatch.from_pylist(made, schema=BLOCK_SCHEMA)
                    made, held = [], 0
            if now is None:
                now = _Open(conv)
            now.add(turn, role, text, fault, rows)
    if now is not None:
        made.append(now.row(base | n, False))
    if made:
        yield pa.RecordBatch.from_pylist(made, schema=BLOCK_SCHEMA)


CHAIN = [("conv_id", pa.int64()), ("block", pa.int64()), ("codes", pa.binary()), ("runs", pa.binary()), ("first_turn", pa.int64()), ("last_turn", pa.int64()), ("first_initial", pa.string()), ("last_initial", pa.string())]
CHAIN_DDL = "conv_id long, block long, codes binary, runs binary, first_turn long, last_turn long, first_initial string, last_initial string"


def _backwards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks from the last to the first of each conversation: the costs to go after each; null after the last."""
    schema = pa.schema([*CHAIN, ("after", pa.list_(pa.int64()))])
    seen, conv, after = False, None, None
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            if not seen or row["conv_id"] != conv:
                seen, conv, after = True, row["conv_id"], None
            matrix = row.pop("matrix")
            out.append(row | {"after": after})
            behind = END if after is None else after
            after = [min(min(matrix[4 * q + x] + behind[q] for q in range(4)), FAR) for x in range(4)]
        yield pa.RecordBatch.from_pylist(out, schema=schema)


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The state that each block ends in, from each state before it; none from where no way leads."""
    schema = pa.schema([*(c for c in CHAIN if c[0] not in ("codes", "runs")), ("after", pa.list_(pa.int64())), ("ends", pa.list_(pa.int32()))])
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            codes, runs = row.pop("codes"), np.frombuffer(row.pop("runs"), np.int64)
            after = None if row["after"] is None else tuple(row["after"])
            out.append(row | {"ends": [walk(codes, runs, q, after)[1] for q in range(4)]})
        yield pa.RecordBatch.from_pylist(out, schema=schema)


def _forwards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks from the first to the last: the state each begins in, and what the border to the block before adds up to."""
    schema = pa.schema([("conv_id", pa.int64()), ("block", pa.int64()), ("state", pa.int32()), ("after", pa.list_(pa.int64())), ("illegal_before", pa.int64()), ("same_turn", pa.int64())])
    seen, conv, state, initial, turn = False, None, 0, None, None
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            if not seen or row["conv_id"] != conv:
                seen, conv, state, initial, turn = True, row["conv_id"], 0, None, None
            illegal = initial is not None and initial + row["first_initial"] not in LAWFUL
            same = turn is not None and row["first_turn"] == turn
            out.append({"conv_id": conv, "block": row["block"], "state": state, "after": row["after"], "illegal_before": int(illegal), "same_turn": int(same)})
            state, initial, turn = row["ends"][state], row["last_initial"], turn if row["last_turn"] is None else row["last_turn"]
        yield pa.RecordBatch.from_pylist(out, schema=schema)


SETTLED = "conv_id long, block long, whole boolean, audit string, roles array<string>, texts array<string>, cost long, first_turn long, last_turn long, turns long, blank long, duplicate long, truncated long, illegal long"
SETTLED_SCHEMA = pa.schema([("conv_id", pa.int64()), ("block", pa.int64()), ("whole", pa.bool_()), ("audit", pa.string()), ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string())), *((c, pa.int64()) for c in ("cost", "first_turn", "last_turn", "turns", "blank", "duplicate", "truncated", "illegal"))])


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Walks through each block from its state and rebuilds its turns."""
    for batch in (b.slice(i, 64) for b in batches for i in range(0, b.num_rows, 64)):
        out = []
        for row in batch.to_pylist():
            codes, runs, state = row.pop("codes"), np.frombuffer(row.pop("runs"), np.int64), row.pop("state")
            after = row.pop("after")
            letters, _ = walk(codes, runs, state, None if after is None else tuple(after))
            roles, texts, cost = edited(codes, letters, state, row["roles"], row["texts"])
            out.append(row | {"audit": "".join(letters), "roles": roles, "texts": texts, "cost": cost})
        yield pa.RecordBatch.from_pylist(out, schema=SETTLED_SCHEMA)


def damage(turns: DataFrame) -> DataFrame:
    """Damages conversations by a checksum of their places: conv_id, turn, role, text."""
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    draw = F.crc32(F.concat_ws(":", spaced("conv_id"), spaced("turn"))) % 20
    drawn = turns.select("conv_id", "turn", spaced("role").alias("role"), spaced("text").alias("text"), draw.alias("draw")).where("draw != 0")
    text = F.when(F.col("draw") == 1, "").when(F.col("draw") == 2, F.translate("text", "".join(ENDS), "")).otherwise(F.col("text"))
    role = F.when(F.col("draw") == 4, "user").otherwise(F.col("role"))
    return drawn.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.when(F.col("draw") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")).drop("copy")


def _same(a: str, b: str, *columns: str) -> Column:
    out = F.lit(True)
    for c in columns:
        out = out & F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}"))
    return out


def repair(turns: DataFrame, *, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", block_rows: int = 4096) -> DataFrame:
    """The repaired turns, one row for each block of a conversation, in order of ``block``: conv_id, block, whole (the
    conversation has this block alone), audit (the edits' letters), roles and texts (of the repaired turns), cost, first_turn and
    last_turn, and the numbers of different turns (turns, those of the block before not counted again) and of blank,
    duplicate, truncated and illegal ones (whose initial can't follow the one before)."""
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = turns.select(F.col(conv_id).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"), spaced(role).alias("role"), spaced(text).alias("text"))
    trimmed = F.rtrim(F.col("text"), F.lit(WHITE))
    digest = F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256))
    counted = rows.groupBy("conv_id", "turn", "role", "text").agg(F.count("*").alias("rows")).withColumns({"digest": digest, "blank": trimmed == "", "ended": F.right(trimmed, F.lit(1)).isin(*ENDS)})
    number = F.struct(F.col("turn").isNotNull(), "turn")
    several = counted.where(~F.col("blank")).groupBy("conv_id", "digest").agg(F.min(number).alias("first"), F.max(number).alias("last")).where(F.col("first") != F.col("last")).select("conv_id", "digest", "first")
    later = F.coalesce(number > F.col("first"), F.lit(False))
    judged = counted.alias("t").join(several.alias("s"), _same("t", "s", "conv_id", "digest"), "left").select("t.*", F.when(F.col("blank"), "blank").when(later, "duplicate").when(~F.col("ended"), "truncated").otherwise("").alias("fault"))
    order = ["conv_id", "turn", "role_head", "text_head", "digest"]
    headed = judged.withColumns({"role_head": F.left("role", F.lit(16)), "text_head": F.left("text", F.lit(64))})
    blocks = written(headed.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "turn", "role", "text", "fault", "rows").mapInArrow(lambda b: _blocks(b, block_rows), BLOCK), "conversation-blocks")

    chained = blocks.where(~F.col("whole")).select(*(c for c, _ in CHAIN), "matrix").repartition("conv_id")
    after = chained.sortWithinPartitions("conv_id", F.desc("block")).mapInArrow(_backwards, f"{CHAIN_DDL}, after array<long>")
    narrow = ", ".join(x for x in CHAIN_DDL.split(", ") if not x.endswith("binary"))
    ends = after.repartition("conv_id", "block").mapInArrow(_ends, f"{narrow}, after array<long>, ends array<int>")
    begun = ends.repartition("conv_id").sortWithinPartitions("conv_id", "block").mapInArrow(_forwards, "conv_id long, block long, state int, after array<long>, illegal_before long, same_turn long")
    wanted = [f.name for f in SETTLED_SCHEMA if f.name not in ("audit", "cost", "turns", "illegal")]
    alone = blocks.where("whole").select(*wanted, "turns", "illegal", "codes", "runs", F.lit(0).alias("state"), F.lit(None).cast("array<long>").alias("after"))
    parts = blocks.where(~F.col("whole")).alias("b").join(begun.alias("c"), _same("b", "c", "conv_id", "block")).select(*(f"b.{c}" for c in wanted), (F.col("turns") - F.col("same_turn")).alias("turns"), (F.col("illegal") + F.col("illegal_before")).alias("illegal"), "codes", "runs", "state", "after")
    return alone.unionByName(parts).mapInArrow(_settle, SETTLED)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted blocks of repaired turns: a hash of each conversation's text, turn by turn."""
    schema = pa.schema([("conv_id", pa.int64()), ("repaired_sha256", pa.string())])
    conv, now, lines = None, None, 0
    row = lambda: pa.RecordBatch.from_pylist([{"conv_id": conv, "repaired_sha256": now.hexdigest()}], schema=schema)
    for batch in batches:
        for own, roles, texts in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "roles", "texts")), strict=True):
            if now is not None and own != conv:
                yield row()
                now = None
            if now is None:
                conv, now, lines = own, hashlib.sha256(), 0
            for r, t in zip(roles, texts, strict=True):
                now.update(f"{chr(10) * (lines > 0)}{r}:{t}".encode())
                lines += 1
    if now is not None:
        yield row()


def digest(repaired: DataFrame) -> DataFrame:
    """One row for each conversation of ``repair``: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit,
    repaired_sha256 (of ``role:text`` of the repaired turns, joined by line ends)."""
    kept = written(repaired, "conversations")
    counts = ["blank", "duplicate", "truncated", "illegal", "cost"]
    gaps = lambda low, high, turns: F.when(high.isNull(), 0).otherwise(high - low + 1 - turns).cast("long").alias("gaps")
    lines = F.array_join(F.transform(F.arrays_zip("roles", "texts"), lambda t: F.concat(t["roles"], F.lit(":"), t["texts"])), "\n")
    alone = kept.where("whole").select("conv_id", gaps(F.col("first_turn"), F.col("last_turn"), F.col("turns")), *counts, "audit", F.sha2(lines, 256).alias("repaired_sha256"))
    parts = kept.where(~F.col("whole"))
    summed = parts.groupBy("conv_id").agg(gaps(F.min("first_turn"), F.max("last_turn"), F.sum("turns")), *(F.sum(c).alias(c) for c in counts), F.array_sort(F.collect_list(F.struct("block", "audit"))).alias("audits"))
    hashed = parts.select("conv_id", "block", "roles", "texts").repartition("conv_id").sortWithinPartitions("conv_id", "block").mapInArrow(_hashed, "conv_id long, repaired_sha256 string")
    audit = F.array_join(F.transform("audits", lambda a: a["audit"]), "").alias("audit")
    return alone.unionByName(summed.alias("s").join(hashed.alias("h"), _same("s", "h", "conv_id")).select("s.conv_id", "gaps", *counts, audit, "repaired_sha256"))
