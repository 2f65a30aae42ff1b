"""Chat formatting with minimum-cost role repair.

A legal conversation is an optional system turn, then user and assistant in
turn, the assistant last.  Each given turn is kept, merged into the turn before
it, or given another role, and empty turns may be inserted.  Dynamic
programming over the automaton's states finds the cheapest repair; the repaired
turns are rendered in a plain marked-up form.

A turn's choices are a matrix of least costs between states, and matrices
combine by minimum and sum.  So a long conversation is handled in pieces: rows
are range-partitioned by conversation and turn and cut after ``PIECE_ROWS`` at
most, each piece gives its matrix, the pieces' states are solved over these
small rows, and each piece is then repaired by itself between its two states.

Among repairs of equal cost, the one whose choices come first in the order
keep, merge, relabel, with and without insertions, from the last turn back.
Pieces hand on how their states rank by this rule, so it holds wherever a
conversation is cut.

Defined cases: a null text is empty; roles are compared in lower case without
blanks at either end, with a few synonyms, and any other or null role must be
relabelled; rows of one turn number come in the order of role (null first),
of the text's first ``PREFIX`` characters and of its SHA-256, wherever they lie,
so repeated rows become turns that merge; a null conv_id is one conversation, a
null turn comes first; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.llm import common

START, SYSTEM, USER, ASSISTANT = range(4)
ROLES = {SYSTEM: "system", USER: "user", ASSISTANT: "assistant"}
NAMES = {"system": SYSTEM, "developer": SYSTEM, "user": USER, "human": USER, "prompter": USER, "assistant": ASSISTANT, "bot": ASSISTANT, "model": ASSISTANT, "gpt": ASSISTANT}
#: States from which a turn of a role may follow.
BEFORE = {SYSTEM: (START,), USER: (START, SYSTEM, ASSISTANT), ASSISTANT: (USER,)}

#: Rows of a piece, at most, as a power of two.
PIECE_BITS = 15
PIECE_ROWS = 1 << PIECE_BITS
#: Characters of a text that order rows of one turn and role; texts alike in these come in the order of their SHA-256.
PREFIX = 256

MERGE, RELABEL, INSERT = 2, 3, 4
FAR = 10**9

#: A choice for a turn: (state before, state after, cost, action, roles inserted before it, role it gets).
Choice = tuple[int, int, int, str, tuple[int, ...], int]


def _choices(role: int | None) -> list[Choice]:
    found: list[Choice] = []
    for state in (START, SYSTEM, USER, ASSISTANT):
        for new in (SYSTEM, USER, ASSISTANT):
            cost = 0 if new == role else RELABEL
            action = "keep" if new == role else "relabel"
            if state in BEFORE[new]:
                found.append((state, new, cost, action, (), new))
            if state == new:
                found.append((state, new, cost + MERGE, "merge" if new == role else "relabel_merge", (), new))
            if new == USER and state == USER:
                found.append((state, new, cost + INSERT, action, (ASSISTANT,), new))
            if new == ASSISTANT and state in (START, SYSTEM, ASSISTANT):
                found.append((state, new, cost + INSERT, action, (USER,), new))
    order = ("keep", "merge", "relabel", "relabel_merge")
    return sorted(found, key=lambda c: (order.index(c[3]), len(c[4]), c[0], c[1]))


CHOICES: dict[int | None, list[Choice]] = {role: _choices(role) for role in (SYSTEM, USER, ASSISTANT, None)}
#: What closing a conversation costs from each state, and the roles added: turns must end with the assistant.
CLOSING: dict[int, tuple[int, tuple[int, ...]]] = {START: (2 * INSERT, (USER, ASSISTANT)), SYSTEM: (2 * INSERT, (USER, ASSISTANT)), USER: (INSERT, (ASSISTANT,)), ASSISTANT: (0, ())}


def role_of(name: str | None) -> int | None:
    return NAMES.get((name or "").strip().lower())


def piece_costs(roles: list[int | None]) -> list[int]:
    """Least costs from each state (rows) to each (columns) over consecutive turns, then how the states rank.

    The rank of a state before the turns, for a state after them, follows the
    choices of its cheapest repair, from the last turn back.
    """
    costs = [[0 if s == start else FAR for s in range(4)] for start in range(4)]
    ranks = [[0] * 4 for _ in range(4)]
    for role in roles:
        # By start and state: the place of the last choice, and the rank before it.
        keys = [[(FAR, 0)] * 4 for _ in range(4)]
        for start in range(4):
            now, new = costs[start], [FAR] * 4
            for place, (a, b, cost, *_) in enumerate(CHOICES[role]):
                if now[a] + cost < new[b]:
                    new[b] = now[a] + cost
                    keys[start][b] = (place, ranks[start][a])
            costs[start] = new
        ranks = [[0] * 4 for _ in range(4)]
        for b in range(4):
            for rank, start in enumerate(sorted(range(4), key=lambda start, b=b: keys[start][b])):
                ranks[start][b] = rank
    return [x for rows in (costs, ranks) for row in rows for x in row]


def repair(roles: list[int | None], enter: int = START, leave: int | None = None) -> list[Choice]:
    """The cheapest choices for consecutive turns from state ``enter`` to ``leave``, or to the cheapest end."""
    costs = [[0 if s == enter else FAR for s in range(4)]]
    for role in roles:
        new = [FAR] * 4
        for a, b, cost, *_ in CHOICES[role]:
            new[b] = min(new[b], costs[-1][a] + cost)
        costs.append(new)
    state = leave if leave is not None else min(range(4), key=lambda s: costs[-1][s] + CLOSING[s][0])
    chosen = []
    for k in range(len(roles) - 1, -1, -1):
        best = next(c for c in CHOICES[roles[k]] if c[1] == state and costs[k][c[0]] + c[2] == costs[k + 1][state])
        chosen.append(best)
        state = best[0]
    return chosen[::-1]


def piece_states(pieces: list[list[int]]) -> list[tuple[int, int]]:
    """The states that each piece of a conversation enters and leaves by, on the repair that ``repair`` gives the whole of it."""
    costs = [[0, FAR, FAR, FAR]]
    for m in pieces:
        costs.append([min(costs[-1][a] + m[4 * a + b] for a in range(4)) for b in range(4)])
    state = min(range(4), key=lambda s: costs[-1][s] + CLOSING[s][0])
    found = []
    for k in range(len(pieces) - 1, -1, -1):
        before = min((a for a in range(4) if costs[k][a] + pieces[k][4 * a + state] == costs[k + 1][state]), key=lambda a: pieces[k][16 + 4 * a + state])  # noqa: B023
        found.append((before, state))
        state = before
    return found[::-1]


def _runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[tuple]]:
    """Consecutive rows that are alike in the first ``keys`` columns."""
    held: list[tuple] = []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held and row[:keys] != held[0][:keys]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _table(rows: list[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


_COSTS = pa.schema([("conv", pa.string()), ("piece", pa.int64()), ("costs", pa.list_(pa.int64())), ("first", pa.int64()), ("n_first", pa.int64()), ("final", pa.int64()), ("n_final", pa.int64())])
_STATES = pa.schema([("conv", pa.string()), ("piece", pa.int64()), ("enter", pa.int32()), ("leave", pa.int32()), ("last", pa.bool_()), ("earlier", pa.int64())])
_TURNS = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("step", pa.int64()), ("role", pa.string()), ("action", pa.string()), ("cost", pa.int32()), ("segment", pa.string())])
COSTS = "conv string, piece long, costs array<long>, first long, n_first long, final long, n_final long"
STATES = "conv string, piece long, enter int, leave int, last boolean, earlier long"
RESULT = "conv_id long, turn long, step long, role string, action string, cost int, segment string"

OPEN, CLOSE = "<|im_start|>{}\n", "<|im_end|>\n"


def earlier_rows(pieces: list[tuple[int | None, int, int | None, int]]) -> list[int]:
    """For each piece (first turn, its rows, final turn, its rows) of a conversation, the rows of its first turn in pieces before."""
    found, turn, n = [], None, 0
    for k, (first, n_first, final, n_final) in enumerate(pieces):
        found.append(n if k and first == turn else 0)
        n = found[-1] + n_first if first == final else n_final
        turn = final
    return found


def rendered(choices: list[Choice], turns: list[tuple[int | None, str]], last: bool, earlier: int = 0) -> list[tuple]:
    """Output rows (turn, step, role, action, cost, segment) of repaired turns (turn, text); segments in order make the conversation.

    The row at place n of its turn, ``earlier`` of which are in pieces before,
    has step 2 n + 1, and a turn inserted before it 2 n.
    """
    out = []
    at, now = earlier - 1, turns[0][0] if turns else None
    for (turn, text), (before, _, cost, action, added, role) in zip(turns, choices, strict=True):
        at, now = (at + 1 if turn == now else 0), turn
        shut = CLOSE if before != START else ""
        for other in added:
            out.append((turn, 2 * at, ROLES[other], "insert", INSERT, shut + OPEN.format(ROLES[other])))
            shut, cost = CLOSE, cost - INSERT
        merged = action in ("merge", "relabel_merge")
        out.append((turn, 2 * at + 1, ROLES[role], action, cost, "\n" + text if merged else shut + OPEN.format(ROLES[role]) + text))
    if last and out:
        turn, step = out[-1][:2]
        for other in CLOSING[choices[-1][1]][1]:
            step += 1
            out.append((turn, step, ROLES[other], "insert", INSERT, CLOSE + OPEN.format(ROLES[other])))
        out.append((turn, step + 1, "", "end", 0, CLOSE))
    return out


def repair_conversations(turns: DataFrame, piece_bits: int = PIECE_BITS) -> DataFrame:
    """Repaired and rendered turns of (conv_id, turn, role, text): a row for each kept, merged, relabelled or inserted turn and each end.

    Segments of a conversation, in order of turn (null first) and step, make
    its rendered form; (conv_id, turn, step) names a row.
    """
    spark = turns.sparkSession
    n = common.shuffle_partitions(spark)
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", common.text_or_empty().alias("text"))
    rows = rows.withColumn("conv", F.coalesce(F.col("conv_id").cast("string"), F.lit("")))
    # The last key parts rows that are alike, of which any order will do.
    order = ("conv", "turn", "role", "prefix", "digest", "copy")
    rows = rows.withColumns({"prefix": F.substring("text", 1, PREFIX), "digest": F.unhex(F.sha2("text", 256)), "copy": F.monotonically_increasing_id()})
    ordered = rows.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    ordered = common.materialize(ordered.select("conv", F.shiftright("at", piece_bits).alias("piece"), "at", "conv_id", "turn", "role", "text"), "chat-turns")

    def costs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for run in _runs(batches, 2):
            first, final = run[0][3], run[-1][3]
            rows.append((*run[0][:2], piece_costs([role_of(r[4]) for r in run]), first, sum(r[3] == first for r in run), final, sum(r[3] == final for r in run)))
        yield from _table(rows, _COSTS)

    def states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in _runs(batches, 1):
            found = piece_states([r[2] for r in run])
            earlier = earlier_rows([r[3:] for r in run])
            yield from _table([(r[0], r[1], *s, k == len(run) - 1, e) for k, (r, s, e) in enumerate(zip(run, found, earlier, strict=True))], _STATES)

    def repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for run in _runs(batches, 2):
            conv_id, enter, leave, last, earlier = (run[0][k] for k in (3, 7, 8, 9, 10))
            choices = repair([role_of(r[5]) for r in run], enter, leave)
            out += [(conv_id, *x) for x in rendered(choices, [(r[4], r[6]) for r in run], last, earlier)]
            if len(out) > 4096:
                yield from _table(out, _TURNS)
                out = []
        yield from _table(out, _TURNS)

    def pieces(df: DataFrame, *columns: str) -> DataFrame:
        return df.repartition(n, "conv", "piece").sortWithinPartitions("conv", "piece", "at").select(*columns)

    matrices = pieces(ordered.select("conv", "piece", "at", "turn", "role"), "conv", "piece", "at", "turn", "role").mapInArrow(costs, COSTS)
    solved = matrices.repartition(n, "conv").sortWithinPartitions("conv", "piece").mapInArrow(states, STATES)
    both = pieces(ordered.join(solved, ["conv", "piece"]), "conv", "piece", "at", "conv_id", "turn", "role", "text", "enter", "leave", "last", "earlier")
    return both.mapInArrow(repaired, RESULT)


def op2_chat_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_conversations(common.table("conversations")(spark, sf_dir).select("conv_id", "turn", "role", "text"))


QUERIES = {"op2_chat_repair": op2_chat_repair}
