import hashlib
import random
import zlib

import numpy as np
import pytest

from fairloom.llm import runs as R


def by_hand(ids, least=6, times=4):
    n, out = len(ids), set()
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and ids[j] == ids[j + q]:
                j += 1
            size = j - i + q
            if j > i and size >= max(least, times * q):
                part = ids[i : i + size]
                if not any(part[:-d] == part[d:] for d in range(1, q)):
                    out.add((i, size, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize("long", [R.LONG, 0])
def test_all_runs_with_their_smallest_period(monkeypatch, long):
    monkeypatch.setattr(R, "LONG", long)
    rnd = random.Random(5)
    for _ in range(500):
        kinds = rnd.choice([1, 2, 3, 9])
        ids = [rnd.randrange(kinds) for _ in range(rnd.randint(0, 60))]
        p = rnd.randint(1, 8)
        ids = ids[:5] + (ids[5 : 5 + p] * 12)[: rnd.randint(0, 60)] + ids[20:]
        assert R.periodic_runs(np.array(ids, np.uint32)) == by_hand(ids)


def test_very_long_text_and_ties():
    period = [f"w{i}" for i in range(3000)]
    ids, names = R.numbered(" \n".join(["x", *period * 5, "y", *["a"] * 7, *["b"] * 7]).encode())
    assert R.periodic_runs(ids) == [(1, 15000, 3000), (15002, 7, 1), (15009, 7, 1)]
    assert R.greatest(R.periodic_runs(ids)) == (15002, 7, 1)
    kept = ids[R.kept_words(len(ids), R.periodic_runs(ids))]
    assert [names[i].decode() for i in kept] == ["x", *period, "y", "a", "b"]
    assert R.greatest([(0, 8, 2), (5, 12, 3), (9, 4, 1)]) == (0, 8, 2)


def test_slices_cut_at_spaces(monkeypatch):
    monkeypatch.setattr(R, "SLICE", 7)
    text = "one  two\tthree four five  \r\n six "
    ids, names = R.numbered(text.encode())
    assert b" ".join(names[i] for i in ids) == b" ".join(text.encode().split())


def test_report_against_plain_python(spark):
    rnd = random.Random(2)
    texts = {k: " ".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(0, 90))) for k in range(1, 120)}
    rows = [(k, t, "u") for k, t in texts.items()] + [(500, None, "u"), (501, "", "u"), (None, "a b " * 5, "u"), (7, texts[7], "u")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_runs string")
    got = sorted(map(tuple, R.run_report(docs).collect()), key=repr)

    def want(key, text):
        words = (text or "").split()
        n, h = len(words), zlib.crc32(str(key).encode()) if key is not None else 1
        if h % 10 == 0 and n:
            a = h // 10 % n
            p = 1 + (n - a) // (3 + h // 10 % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        found = by_hand(words)
        gone = {i for s, size, q in found for i in range(s + q, s + size)}
        top = min(found, key=lambda r: (-r[1] / r[2], r[0], r[2])) if found else (None, None, None)
        return (key, len(found), *top, 1000 * top[1] // top[2] if found else None, hashlib.sha256("".join(f"{a},{b},{c}\n" for a, b, c in found).encode()).hexdigest(),
                hashlib.sha256(" ".join(w for i, w in enumerate(words) if i not in gone).encode()).hexdigest())

    assert got == sorted((want(k, t) for k, t, _ in rows), key=repr)
    assert sum(r[1] for r in got) >= 10


def test_collapsed_texts(spark):
    docs = spark.createDataFrame([(1, "say  it " * 4 + "once"), (2, "as  it is"), (3, None), (None, "")], "doc_id long, text string")
    got = {r.doc_id: (r.text, r.runs) for r in R.collapsed(docs).collect()}
    assert got == {1: ("say it once", [[0, 8, 2]]), 2: ("as  it is", []), 3: (None, []), None: ("", [])}
    assert R.run_report(docs.limit(0)).count() == 0 and R.collapsed(docs.limit(0)).count() == 0
