"""Conversation structure repair: cheapest edits by Four-Russians block tables over normalised cost vectors."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorekeep.llm.common import small_batches

# Costs of the edits.
REROLE, DELETE, INSERT, CUT = 1, 2, 5, 5
# States: nothing yet, behind system, behind user, behind assistant; a conversation may end in the first and the last.
STATES, ENDS, FAR = 4, (0, 3), 1 << 20
NEXT_ROLE = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
INITIALS = "sua?"
# Symbols: 0 no row; 1 a row that has to go; then initial x (whole, cut).
ABSENT, GONE, SYMBOLS = 0, 1, 2 + 2 * len(INITIALS)
BLOCK = 4
SYMBOL_ROWS = 200_000
_FILLED = "CAST(coalesce(CAST({0} AS STRING), ' ') AS STRING)"


def edits(symbol: int, state: int) -> Iterator[tuple[str, int, int]]:
    """(letter, cost, next state) of what may be done to a row."""
    if symbol == ABSENT:
        yield "", 0, state
        return
    yield "D", DELETE, state
    if symbol == GONE:
        return
    initial, cut = INITIALS[(symbol - 2) // 2], (symbol - 2) % 2 * CUT
    if initial in NEXT_ROLE[state]:
        yield "K", cut, NEXT_ROLE[state][initial]
    for role in "ua":
        if role in NEXT_ROLE[state]:
            yield "R", REROLE + cut, NEXT_ROLE[state][role]


def inserts(state: int) -> Iterator[tuple[str, int, int]]:
    for role in "ua":
        if role in NEXT_ROLE[state]:
            yield "I", INSERT, NEXT_ROLE[state][role]


def closed(costs: list[int]) -> list[int]:
    """Costs with insertions behind them taken into account."""
    out = list(costs)
    for _ in range(STATES):
        for state in range(STATES):
            for _, cost, to in inserts(state):
                out[to] = min(out[to], out[state] + cost)
    return out


class Tables(NamedTuple):
    """Over normalised cost vectors (least 0): the vector and the cost a symbol adds (``step``, ``more``), the same for a block of
    symbols (``block_step``, ``block_more``); per vector, symbol and set of states on cheapest ways behind it, the set before it
    (``back``); and per state the letters written and the state behind (``wrote``, ``to``). ``end_cost``, ``end_set`` and
    ``end_wrote`` are those of the end."""

    step: np.ndarray
    more: np.ndarray
    block_step: np.ndarray
    block_more: np.ndarray
    back: np.ndarray
    wrote: np.ndarray
    to: np.ndarray
    end_cost: np.ndarray
    end_set: np.ndarray
    end_wrote: np.ndarray
    strings: list[str]


@lru_cache(maxsize=1)
def tables() -> Tables:
    # From any state the work of any other can be done for less than this more; a costlier one is on no cheapest way.
    slack = 3 * INSERT + 2 * DELETE
    known: dict[tuple[int, ...], int] = {}
    queue: list[tuple[int, ...]] = []

    def number(costs: list[int]) -> tuple[int, int]:
        whole = closed(costs)
        least = min(whole)
        own = tuple(c - least if c - least <= slack else FAR for c in whole)
        if own not in known:
            known[own] = len(queue)
            queue.append(own)
        return known[own], least

    number([0, FAR, FAR, FAR])
    step, more = [], []
    for own in queue:  # grows while it is read
        row, added = [], []
        for symbol in range(SYMBOLS):
            costs = [FAR] * STATES
            for state in range(STATES):
                for _, cost, to in edits(symbol, state):
                    costs[to] = min(costs[to], own[state] + cost)
            to, cost = number(costs)
            row.append(to)
            added.append(cost)
        step.append(row)
        more.append(added)

    # Every block of symbols from every vector: transitions composed symbol by symbol.
    step1, more1 = np.array(step, np.int16), np.array(more, np.int32)
    block_step = np.repeat(np.arange(len(queue), dtype=np.int16)[:, None], 1, axis=1)
    block_more = np.zeros((len(queue), 1), np.int32)
    for _ in range(BLOCK):
        block_more = (block_more[:, :, None] + more1[block_step]).reshape(len(queue), -1)
        block_step = step1[block_step].reshape(len(queue), -1)

    strings: list[str] = [""]
    place = {"": 0}

    def text(letters: str) -> int:
        if letters not in place:
            place[letters] = len(strings)
            strings.append(letters)
        return place[letters]

    def with_inserts(own: tuple[int, ...], alive: set[int]) -> set[int]:
        out = set(alive)
        for _ in range(STATES):
            out |= {q for q in range(STATES) for _, c, to in inserts(q) if to in out and own[q] < FAR and own[q] + c == own[to]}
        return out

    sets = 1 << STATES
    back = np.zeros((len(queue), SYMBOLS, sets), np.uint8)
    wrote = np.zeros((len(queue), SYMBOLS, sets, STATES), np.int16)
    to_state = np.zeros((len(queue), SYMBOLS, sets, STATES), np.uint8)
    bits = lambda some: sum(1 << q for q in some)
    for v, own in enumerate(queue):
        for symbol in range(SYMBOLS):
            after, added = queue[step[v][symbol]], more[v][symbol]
            tight = [[(letter, to) for letter, c, to in edits(symbol, q) if own[q] < FAR and own[q] + c == after[to] + added] for q in range(STATES)]
            for mask in range(sets):
                there = {q for q in range(STATES) if mask >> q & 1}
                before = {q for q in range(STATES) if any(to in there for _, to in tight[q])}
                alive = before if symbol == ABSENT else with_inserts(own, before)
                back[v, symbol, mask] = bits(alive)
                for q in alive:
                    letters, at = "", q
                    while True:  # the least letter at every place gives the least string
                        ways = [(letter, to) for letter, to in tight[at] if to in there]
                        if symbol != ABSENT:
                            ways += [("I", -1 - to) for _, c, to in inserts(at) if to in alive and own[at] + c == own[to]]
                        letter, to = min(ways)
                        letters += letter
                        if to >= 0:
                            break
                        at = -1 - to
                    wrote[v, symbol, mask, q] = text(letters)
                    to_state[v, symbol, mask, q] = to
    end_cost = np.array([min(own[q] for q in ENDS) for own in queue], np.int32)
    end_set, end_wrote = np.zeros(len(queue), np.uint8), np.zeros((len(queue), STATES), np.int16)
    for v, own in enumerate(queue):
        last = {q for q in ENDS if own[q] == end_cost[v]}
        alive = with_inserts(own, last)
        end_set[v] = bits(alive)
        for q in alive:
            at, letters = q, ""
            while at not in last:
                at = next(to for _, c, to in inserts(at) if to in alive and own[at] + c == own[to])
                letters += "I"
            end_wrote[v, q] = text(letters)
    return Tables(step1, more1, block_step, block_more, back, wrote, to_state, end_cost, end_set, end_wrote, strings)


def cheapest(symbols: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, list[str]]:
    """Costs and audits of conversations: their symbols one after another, and the number of each.

    All conversations go forward together, a block at a lookup, and leave their vector at each border; then blocks are expanded
    from the last to the first, which gives the states on cheapest ways at each row; then all are traced from the front.
    """
    t = tables()
    blocks = -(-sizes // BLOCK)
    first = np.cumsum(blocks) - blocks  # of each conversation, its first block
    grid = np.zeros((blocks.sum(), BLOCK), np.uint8)
    begins = np.cumsum(sizes) - sizes
    at = np.repeat(first * BLOCK - begins, sizes) + np.arange(len(symbols))
    grid.reshape(-1)[at] = symbols
    code = grid.astype(np.int64) @ SYMBOLS ** np.arange(BLOCK - 1, -1, -1)

    order = np.argsort(-blocks, kind="stable")
    going = np.searchsorted(-blocks[order], -np.arange(1, blocks.max(initial=0) + 1), "right")  # conversations with a block k
    vector, cost = np.zeros(len(sizes), np.int16), np.zeros(len(sizes), np.int64)
    border = np.zeros(len(grid), np.int16)
    for k, n in enumerate(going.tolist()):
        own = order[:n]
        row = first[own] + k
        border[row] = vector[own]
        cost[own] += t.block_more[vector[own], code[row]]
        vector[own] = t.block_step[vector[own], code[row]]
    cost += t.end_cost[vector]

    inside = np.zeros((len(grid), BLOCK), np.int16)
    inside[:, 0] = border
    for i in range(1, BLOCK):
        inside[:, i] = t.step[inside[:, i - 1], grid[:, i - 1]]
    alive = t.end_set[vector]
    behind = np.zeros((len(grid), BLOCK), np.uint8)  # states on cheapest ways behind each row
    for k in range(len(going) - 1, -1, -1):
        own = order[: going[k]]
        row = first[own] + k
        for i in range(BLOCK - 1, -1, -1):
            behind[row, i] = alive[own]
            alive[own] = t.back[inside[row, i], grid[row, i], alive[own]]

    state = np.zeros(len(sizes), np.uint8)
    letters = np.zeros((len(grid), BLOCK), np.int16)
    for k, n in enumerate(going.tolist()):
        own = order[:n]
        row = first[own] + k
        for i in range(BLOCK):
            key = inside[row, i], grid[row, i], behind[row, i], state[own]
            letters[row, i] = t.wrote[key]
            state[own] = t.to[key]
    last = t.end_wrote[vector, state].tolist()
    flat = letters.reshape(-1)
    audits = []
    for a, n, end in zip((first * BLOCK).tolist(), (blocks * BLOCK).tolist(), last, strict=True):
        audits.append("".join(map(t.strings.__getitem__, flat[a : a + n].tolist())) + t.strings[end])
    return cost, audits


# ---------------------------------------------------------------- rows


def damaged(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) with the faults that crc32 of ``conv_id:turn`` modulo 20 gives them; nulls count as one space.

    0 drops a row (``dropped`` is true, so its conversation stays known), 1 empties its text, 2 takes out its ``.!?``, 3 repeats it,
    4 makes it the user's.
    """
    filled = rows.select("conv_id", "turn", F.expr(_FILLED.format("role")).alias("role"), F.expr(_FILLED.format("text")).alias("text"))
    key = F.expr(f"concat({_FILLED.format('conv_id')}, ':', {_FILLED.format('turn')})")
    fault = filled.withColumn("fault", F.pmod(F.crc32(key.cast("binary")), F.lit(20)))
    return fault.select(
        "conv_id",
        "turn",
        F.when(F.col("fault") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
        F.when(F.col("fault") == 1, F.lit("")).when(F.col("fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        (F.col("fault") == 0).alias("dropped"),
        F.explode(F.when(F.col("fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    ).drop("copy")


def _ordered(rows: DataFrame) -> DataFrame:
    """A role and a text for every row, and the hash that stands for both in comparisons."""
    own = rows if "dropped" in rows.columns else rows.withColumn("dropped", F.lit(False))
    own = own.select(
        "conv_id", "turn", F.expr(_FILLED.format("role")).alias("role"), F.expr(_FILLED.format("text")).alias("text"), "dropped"
    )
    return own.withColumn("said", F.unhex(F.md5(F.concat("role", F.lit(":"), "text").cast("binary"))))


def _light(rows: DataFrame) -> DataFrame:
    """What the repair has to know of each row: no text."""
    rest = F.rtrim(F.translate("text", "\t\n\x0b\x0c\r", "     "))
    blank = rest == ""
    light = rows.select(
        "conv_id",
        "turn",
        "said",
        "dropped",
        (F.when(F.substring("role", 1, 1) == "s", 0).when(F.substring("role", 1, 1) == "u", 1).when(F.substring("role", 1, 1) == "a", 2).otherwise(3)).cast("byte").alias("initial"),
        blank.alias("blank"),
        (~blank & ~F.substring(rest, -1, 1).isin(".", "!", "?")).alias("cut"),
    )
    # The turn at which something was said first, for what is said in several turns of a conversation.
    spoken = light.where("NOT dropped").groupBy("conv_id", "said")
    again = spoken.agg(F.min("turn").alias("least"), F.max("turn").alias("most"), F.bool_or(F.col("turn").isNull()).alias("none"))
    again = again.where("least < most OR (none AND least IS NOT NULL)").select(
        F.col("conv_id").alias("__conv"), F.col("said").alias("__said"), F.when(~F.col("none"), F.col("least")).alias("first"), F.lit(True).alias("repeated")
    )
    same = F.col("conv_id").eqNullSafe(F.col("__conv")) & (F.col("said") == F.col("__said"))
    met = light.join(again, same, "left")
    later = F.col("repeated").isNotNull() & ~F.col("turn").eqNullSafe(F.col("first"))
    return met.select("conv_id", "turn", "said", "dropped", "initial", "blank", "cut", F.coalesce(later, F.lit(False)).alias("later"))


def _column(table: pa.Table, name: str, kind: type) -> np.ndarray:
    """Values with 0 or false for null."""
    column = table.column(name).combine_chunks()
    return column.fill_null(False if pa.types.is_boolean(column.type) else 0).to_numpy(zero_copy_only=False).astype(kind)


def _runs(table: pa.Table, name: str) -> np.ndarray:
    """For each row whether it has another value than the row before; nulls are equal."""
    column = table.column(name).combine_chunks()
    values, valid = column.fill_null(0).to_numpy(zero_copy_only=False), column.is_valid().to_numpy(zero_copy_only=False)
    return np.append(True, (values[1:] != values[:-1]) | (valid[1:] != valid[:-1]))[: len(values)]


def _diagnosed(table: pa.Table) -> pa.RecordBatch:
    """Whole conversations, their rows in order -> one row for each."""
    opens = _runs(table, "conv_id")
    begins = np.flatnonzero(opens)
    conv = np.cumsum(opens) - 1
    n = len(begins)
    there = ~_column(table, "dropped", bool)
    said = np.frombuffer(b"".join(table.column("said").to_pylist()), np.uint64).reshape(-1, 2)
    turned = _runs(table, "turn") | opens
    # Rows of one turn are sorted by what they say, dropped rows last.
    echo = np.append(False, (said[1:] == said[:-1]).all(1) & there[:-1])[: len(said)] & ~turned
    blank = _column(table, "blank", bool) & there
    twice = (_column(table, "later", bool) | echo) & there & ~blank
    cut = _column(table, "cut", bool) & there & ~blank & ~twice
    initial = _column(table, "initial", np.int64)
    symbols = np.where(there, np.where(blank | twice, GONE, 2 + 2 * initial + cut), ABSENT).astype(np.uint8)
    cost, audits = cheapest(symbols, np.diff(np.append(begins, len(opens))))

    count = lambda some: np.bincount(conv[some], minlength=n)
    kept = np.flatnonzero(there)
    left, right = initial[kept[:-1]], initial[kept[1:]]
    fine = ((left == 0) & (right == 1)) | ((left == 1) & (right == 2)) | ((left == 2) & (right == 1))
    illegal = kept[1:][(conv[kept[:-1]] == conv[kept[1:]]) & ~fine]
    timed = kept[table.column("turn").combine_chunks().is_valid().to_numpy(zero_copy_only=False)[kept]]
    turns = _column(table, "turn", np.int64)[timed]
    gaps = np.zeros(n, np.int64)
    if len(timed):
        starts = np.flatnonzero(np.append(True, np.diff(conv[timed]) > 0))
        ends = np.append(starts[1:], len(timed)) - 1
        fresh = np.append(True, (turns[1:] != turns[:-1]) | (np.diff(conv[timed]) > 0))
        distinct = np.add.reduceat(fresh.astype(np.int64), starts)
        gaps[conv[timed[starts]]] = turns[ends] - turns[starts] + 1 - distinct
    made = {"gaps": gaps, "blank": count(blank), "duplicate": count(twice), "truncated": count(cut), "illegal": np.bincount(conv[illegal], minlength=n), "cost": cost}
    columns = [table.column("conv_id").take(pa.array(begins)).combine_chunks(), *[pa.array(c.astype(np.int64)) for c in made.values()], pa.array(audits)]
    return pa.RecordBatch.from_arrays(columns, names=["conv_id", *made, "audit"])


def _whole(function, rows: int = SYMBOL_ROWS):
    """Batches sorted by conversation -> ``function`` on tables of whole conversations of about ``rows`` rows."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            count += batch.num_rows
            # Sorted rows: with equal ends there is one conversation only, and nothing to cut off yet.
            if count >= rows and held[0].column(0)[0] != batch.column(0)[-1]:
                table = pa.Table.from_batches(held)
                last = int(np.flatnonzero(_runs(table, "conv_id"))[-1])
                yield function(table.slice(0, last))
                rest = table.slice(last).combine_chunks()
                held, count = rest.to_batches(), rest.num_rows
        if held:
            yield function(pa.Table.from_batches(held))

    return each


DIAGNOSIS = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def diagnose(rows: DataFrame) -> DataFrame:
    """One row for each conversation of rows (conv_id long, turn long, role, text; dropped boolean if some rows are only a trace).

    gaps (missing turns), blank, duplicate, truncated (each row's first fault), illegal (adjacent role initials other than su, ua,
    au), cost and audit: the cheapest edits that leave the role initials ``(s?(ua)+)?``. K keeps a row, R makes it the user's or
    the assistant's for 1, D deletes it for 2, I inserts an empty turn for 5; blank and duplicate rows have to go, a truncated row that
    stays costs 5 more. Of the cheapest edits those with the ASCII-least letters are taken.

    Order is by turn, nulls first; rows of one turn by the hash of role and text, so repeated rows stand together. Null roles and texts
    count as one space; a null conv_id is a conversation. Other columns are left behind, an empty table gives no rows. No text is
    shuffled here: a row is a hash and a few flags, a conversation is held at some 30 bytes a row, since its audit is one value.
    """
    small_batches(rows.sparkSession)
    light = _light(_ordered(rows))
    placed = light.repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "said", "dropped")
    return placed.mapInArrow(_whole(_diagnosed), f"conv_id long, {DIAGNOSIS}")


def _streamed(rows: DataFrame, found: DataFrame) -> DataFrame:
    """The diagnosis of each conversation followed by its rows in order; texts pass by, none is gathered."""
    names = DIAGNOSIS.replace(",", "").split()[::2]
    heads = found.select("conv_id", F.lit(0).alias("kind"), *[F.lit(None).cast(t).alias(c) for c, t in (("turn", "long"), ("said", "binary"), ("role", "string"), ("text", "string"))], *names)
    own = _ordered(rows).where("NOT dropped")
    kinds = dict(zip(names, DIAGNOSIS.replace(",", "").split()[1::2], strict=True))
    lines = own.select("conv_id", F.lit(1).alias("kind"), "turn", "said", "role", "text", *[F.lit(None).cast(kinds[c]).alias(c) for c in names])
    both = heads.unionByName(lines).repartition("conv_id")
    return both.sortWithinPartitions("conv_id", "kind", F.col("turn").asc_nulls_first(), "said")


class Replay:
    """The edits of one conversation, carried out as its rows pass by."""

    def __init__(self, audit: str) -> None:
        self.audit, self.at, self.state = audit, 0, 0

    def _insert(self) -> Iterator[tuple[str, str, str]]:
        while self.audit[self.at : self.at + 1] == "I":
            self.at += 1
            yield "I", self._next(), ""

    def _next(self) -> str:
        """The role that an inserted or reassigned row takes in this state."""
        role = "a" if self.state == 2 else "u"
        self.state = NEXT_ROLE[self.state][role]
        return "user" if role == "u" else "assistant"

    def row(self, role: str, text: str) -> Iterator[tuple[str, str, str]]:
        yield from self._insert()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "K":
            self.state = NEXT_ROLE[self.state][role[0]]
            yield "K", role, text
        elif edit == "R":
            yield "R", self._next(), text

    def end(self) -> Iterator[tuple[str, str, str]]:
        return self._insert()


def _replayed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, Iterator[tuple[str, str, str]] | None]]:
    """(diagnosis, edited rows) in order; None behind the last rows of a conversation."""
    head, replay = None, None
    for batch in batches:
        heads = batch.drop_columns(["kind", "turn", "said", "role", "text"])
        for i, (kind, role, text) in enumerate(zip(*[batch.column(c).to_pylist() for c in ("kind", "role", "text")], strict=True)):
            if kind == 0:
                if head is not None:
                    yield head, replay.end()
                    yield head, None
                head = heads.slice(i, 1).to_pylist()[0]
                replay = Replay(head["audit"])
            else:
                yield head, replay.row(role, text)
    if head is not None:
        yield head, replay.end()
        yield head, None


def repaired(rows: DataFrame) -> DataFrame:
    """The repaired conversations: conv_id, position (from 0), edit (K, R or I), role, text. Rows are as in ``diagnose``."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, position, held = ["conv_id", "position", "edit", "role", "text"], 0, []
        size = 0
        for head, lines in _replayed(batches):
            for line in lines or ():
                held.append((head["conv_id"], position, *line))
                position, size = position + 1, size + len(line[2])
            position = 0 if lines is None else position
            if held and (len(held) >= 1000 or size > 1 << 22):
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*held, strict=True)], names=names)
                held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()), strict=True)], names=names)

    schema = "conv_id long, position long, edit string, role string, text string"
    return _streamed(rows, diagnose(rows)).mapInArrow(each, schema)


def digests(rows: DataFrame) -> DataFrame:
    """``diagnose`` with repaired_sha256: that of the repaired rows as ``role:text``, joined by line feeds.

    The hash of a conversation runs over its rows as they pass by in order, so it has one task, but holds no more than a batch.
    """
    names = ["conv_id", *DIAGNOSIS.replace(",", "").split()[::2]]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, digest, gap = [], hashlib.sha256(), b""
        for head, lines in _replayed(batches):
            for _, role, text in lines or ():
                digest.update(gap + f"{role}:{text}".encode())
                gap = b"\n"
            if lines is None:
                held.append(head | {"repaired_sha256": digest.hexdigest()})
                digest, gap = hashlib.sha256(), b""
                if len(held) >= 1000:
                    yield pa.RecordBatch.from_pylist(held, schema)
                    held = []
        if held:
            yield pa.RecordBatch.from_pylist(held, schema)

    schema = pa.schema([(n, pa.string() if n == "audit" else pa.int64()) for n in names] + [("repaired_sha256", pa.string())])
    return _streamed(rows, diagnose(rows)).mapInArrow(each, f"conv_id long, {DIAGNOSIS}, repaired_sha256 string")
