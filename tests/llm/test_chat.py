import random

from fairloom.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, place int"


def plain(rows):
    chats = {}
    for c, turn, role, text in {(c, t, r or "", x or "") for c, t, r, x, _ in rows}:
        chats.setdefault((c, (turn, role, text) if c is None else None), []).append((turn is not None, turn or 0, role, text))
    said = {c: [(r, x) for *_, r, x in sorted(v)] for c, v in chats.items()}
    out = set()
    for c, v in said.items():
        if any(len(w) > len(v) and w[: len(v)] == v for w in said.values()):
            continue
        same = [k for k, w in said.items() if w == v]
        if c == min(same, key=lambda k: (k[0] is None, k[0] or 0)):
            out.add((c[0], len(v), len(same), "\n".join(f"<|im_start|>{r}\n{x}<|im_end|>" for r, x in v)))
    return out


def test_snapshots_collapse(spark):
    rng = random.Random(4)
    rows, n = [], 0
    for _ in range(30):
        turns = [(rng.choice(["user", "assistant"]), rng.choice(["hi", "yes", "no", "é\n", ""])) for _ in range(rng.randint(1, 8))]
        for _ in range(rng.randint(1, 4)):
            rows += [(n, i, r, x, 9) for i, (r, x) in enumerate(turns[: rng.randint(1, len(turns))])]
            n += 1
    rows += rows[:10] + [(500, None, None, None, 1), (500, 1, "user", None, 1), (None, 0, "user", "lost", 1), (None, 0, "user", "lost", 2), (None, 5, "user", "other", 2), (None, None, "user", "hi", 2), (None, None, None, "lone", 2), (501, 0, "a", "bc", 1), (502, 0, "ab", "c", 1), (503, 0, "user", "x" * 100_000, 1)]
    got = {(r.conv_id, r.n_turns, r.copies, r.chat) for r in chat.formatted(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == plain(rows)


def test_empty_table(spark):
    assert chat.formatted(spark.createDataFrame([], SCHEMA)).count() == 0
