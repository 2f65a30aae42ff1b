import hashlib
import itertools
import random

from lumenframe.llm import chat


def legal(states):
    return all(b in chat.BEFORE and a in chat.BEFORE[b] for a, b in itertools.pairwise([chat.START, *states])) and states[-1:] == [chat.ASSISTANT]


EXTRAS = [(), (chat.USER,), (chat.ASSISTANT,), (chat.USER, chat.ASSISTANT), (chat.ASSISTANT, chat.USER)]


def brute(roles):
    """The least cost over all assignments of roles, merges and up to two insertions before each turn, walked to the end."""

    def go(states, rest, cost):
        if not rest:
            return min((cost + chat.INSERT * len(end) for end in EXTRAS if legal(states + list(end))), default=10**6)
        found = []
        for role in (1, 2, 3):
            change = 0 if role == rest[0] else chat.RELABEL
            if states[-1:] == [role]:
                found.append(go(states, rest[1:], cost + change + chat.MERGE))
            for extra in EXTRAS:
                now = [*states, *extra, role]
                # What isn't legal up to here never will be.
                if all(b in chat.BEFORE and a in chat.BEFORE[b] for a, b in itertools.pairwise([chat.START, *now])):
                    found.append(go(now, rest[1:], cost + change + chat.INSERT * len(extra)))
        return min(found)

    return go([], list(roles), 0)


def total(roles):
    chosen = chat.repair(roles)
    return sum(c[2] for c in chosen) + chat.CLOSING[chosen[-1][1]][0]


def test_least_cost():
    for n in (1, 2, 3, 4):
        for roles in itertools.product((None, 1, 2, 3), repeat=n):
            assert total(list(roles)) == brute(list(roles)), roles


def test_pieces_cost_the_same():
    rng = random.Random(1)
    for _ in range(200):
        roles = [rng.choice((None, 1, 2, 3)) for _ in range(rng.randint(1, 12))]
        cuts = sorted({0, len(roles), *(rng.randint(0, len(roles)) for _ in range(3))})
        pieces = [roles[a:b] for a, b in itertools.pairwise(cuts)]
        states = chat.piece_states([chat.piece_costs(p) for p in pieces])
        chosen = [c for p, (enter, leave) in zip(pieces, states, strict=True) for c in chat.repair(p, enter, leave)]
        assert sum(c[2] for c in chosen) + chat.CLOSING[chosen[-1][1]][0] == total(roles)


def test_conversations(spark):
    rows = [(1, 0, "user", "a", 1), (1, 1, "user", "b", 1), (1, 2, "Assistant ", None, 1), (2, 0, "system", "s", 1), (2, 1, "user", "q", 1), (None, 0, None, "x", 1), (3, 5, "bot", "y", 1), (3, 5, "bot", "y", 1)]
    long = [(9, k, ("user", "assistant")[k % 2], str(k), 1) for k in range(400)]
    turns = spark.createDataFrame(rows + long, "conv_id long, turn long, role string, text string, step int")
    found = sorted(chat.repair_conversations(turns).collect(), key=lambda r: (r.conv_id is not None, r.conv_id or 0, r.turn, r.step))
    text = {}
    for r in found:
        text[r.conv_id] = text.get(r.conv_id, "") + r.segment
    assert text[1] == "<|im_start|>user\na\nb<|im_end|>\n<|im_start|>assistant\n<|im_end|>\n"
    assert text[2] == "<|im_start|>system\ns<|im_end|>\n<|im_start|>user\nq<|im_end|>\n<|im_start|>assistant\n<|im_end|>\n"
    assert text[9] == "".join(f"<|im_start|>{('user', 'assistant')[k % 2]}\n{k}<|im_end|>\n" for k in range(400))
    assert sum(r.cost for r in found if r.conv_id == 1) == chat.MERGE
    assert text[None].count("<|im_end|>") == 2
    assert sum(r.action != "insert" and r.action != "end" for r in found if r.conv_id == 3) == 2
    assert chat.repair_conversations(turns.limit(0)).count() == 0


def test_pieces_choose_the_same():
    def cut(roles, cuts):
        pieces = [roles[a:b] for a, b in itertools.pairwise(cuts)]
        states = chat.piece_states([chat.piece_costs(p) for p in pieces])
        return [c for p, (enter, leave) in zip(pieces, states, strict=True) for c in chat.repair(p, enter, leave)]

    users = [chat.USER] * 4
    assert cut(users, [0, 3, 4]) == chat.repair(users)
    for n in (2, 3, 4, 5):
        for roles in itertools.product((None, 1, 2, 3), repeat=n):
            whole = chat.repair(list(roles))
            for at in range(1, n):
                assert cut(list(roles), [0, at, n]) == whole, (roles, at)
            assert cut(list(roles), list(range(n + 1))) == whole, roles
    rng = random.Random(2)
    for _ in range(300):
        roles = [rng.choice((None, 1, 2, 2, 3)) for _ in range(rng.randint(5, 40))]
        cuts = sorted({0, len(roles), *(rng.randint(0, len(roles)) for _ in range(4))})
        assert cut(roles, cuts) == chat.repair(roles), (roles, cuts)


def test_repair_does_not_depend_on_partitions(spark):
    turns = spark.createDataFrame([(1, k, ("user", "assistant", "user", "user", "tool")[k * k % 5], str(k)) for k in range(60)], "conv_id long, turn long, role string, text string")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    found = []
    try:
        for n in (1, 3, 8):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            found.append(sorted(chat.repair_conversations(turns).collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert found[0] == found[1] == found[2]


def test_rows_of_one_turn(spark):
    """Many rows of one turn number come in one order and have steps of their own, however they are cut."""
    long = "y" * 300
    rows = [(1, 5, ("user", "assistant", "tool", None)[k % 4], str(k * 7919 % 400)) for k in range(390)] + [(1, 5, "user", long + c) for c in "abc"] + [(1, 5, "user", "same")] * 30 + [(1, 6, "user", "z"), (1, None, "user", "n"), (2, 5, "user", "q")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    found = []
    try:
        for n, bits in ((1, 15), (4, 15), (7, 15), (3, 4), (2, 1)):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            found.append(sorted(map(tuple, chat.repair_conversations(turns.repartition(3), bits).collect()), key=repr))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert all(f == found[0] for f in found)
    assert len({r[:3] for r in found[0]}) == len(found[0])
    text = "".join(r[6] for r in sorted((r for r in found[0] if r[0] == 1), key=lambda r: (r[1] is not None, r[1] or 0, r[2])))
    said = [t for part in text.replace("<|im_end|>", "").split("\n") for t in [part] if t and not t.startswith("<|im_start|>")]
    key = lambda r: (r[1] is not None, r[1] or 0, r[2] is not None, r[2] or "", r[3][:256], hashlib.sha256(r[3].encode()).digest())
    assert said == [r[3] for r in sorted((r for r in rows if r[0] == 1), key=key)]
