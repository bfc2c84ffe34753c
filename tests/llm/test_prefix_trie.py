import hashlib
import random
import zlib

import pytest

from rostrum.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string"


def expected(rows):
    own = {}
    for c, t, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((t is not None, t or 0, (role or "", text or "")))
    own = {c: [x[2] for x in sorted(v, key=lambda x: x[:2])] for c, v in own.items()}
    made = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        made[c] = tuple(own.get(c - (abs(c) % 100 if c >= 0 else -(abs(c) % 100)), [])[:h] + turns[h:])
    members, ends = {}, {}
    for c, s in made.items():
        for d in range(len(s) + 1):
            members.setdefault(s[:d], []).append(c)
        ends.setdefault(s, []).append(c)
    kids = {}
    for p in members:
        if p:
            kids.setdefault(p[:-1], []).append(p)

    def under(p):
        own_saved = (len(members[p]) - 1) * len(p[-1][1]) if p else 0
        below = [under(k) for k in kids.get(p, [])]
        return sum(b[0] for b in below) or 1, own_saved + sum(b[1] for b in below)

    out = []
    for p, m in members.items():
        leaves, saved = under(p)
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids.get(p, [])), leaves, saved,
                    hashlib.sha256(",".join(map(str, sorted(ends.get(p, [])))).encode()).hexdigest()))
    return sorted(out, key=repr)


def result(spark, rows, **kw):
    frame = rows if hasattr(rows, "columns") else spark.createDataFrame(rows, SCHEMA)
    return sorted((tuple(r) for r in prefix_trie.prefix_trie(frame, **kw).collect()), key=repr)


def some(n, seed=1):
    rng = random.Random(seed)
    rows = []
    for c in [*range(n), -7, -200, 10 ** 15]:
        for t in range(rng.randint(1, 9)):
            rows.append((c, t, rng.choice(["user", "assistant"]), rng.choice(["a", "bé", "same words", ""])))
    return rows


@pytest.mark.parametrize("limit", [1, 20, 100_000])
def test_same_as_one_by_one(spark, limit):
    """Bursting everything, something or nothing gives the same nodes."""
    rows = some(260)
    assert result(spark, rows, limit=limit) == expected(rows)


def test_copies_nulls_and_a_long_conversation(spark):
    rows = [(c, t, "user", f"t{t}") for c in range(100, 340) for t in range(7)]
    rows += [(5, None, None, None), (5, 0, "user", None), (None, 1, "user", "x"), (6, 3, "user", "y"), (6, 3, "user", "y"), (50, 0, "user", "z")]
    rows += [(700, t, "user", f"word {t % 5}") for t in range(300)] + [(701, t, "user", f"word {t % 5}") for t in range(290)]
    assert result(spark, rows, limit=30) == expected_flat(rows)


def expected_flat(rows):
    import sys
    old = sys.getrecursionlimit()
    sys.setrecursionlimit(100_000)
    try:
        return expected(rows)
    finally:
        sys.setrecursionlimit(old)


def test_conversation_without_turns_of_its_own(spark):
    """A head that is absent and too few own turns leave a turnless member of the root."""
    lone = next(c for c in range(1, 99) if zlib.crc32(str(c).encode()) % 6 == 5)
    rows = [(lone, 0, "user", "x")]
    assert result(spark, rows) == expected(rows) and len(expected(rows)) == 1


def test_empty_table_and_other_columns(spark):
    assert result(spark, []) == []
    frame = spark.createDataFrame([(1, 0, "u", "t", "k", 3, 4)], SCHEMA + ", key string, top int, burst int")
    assert len(result(spark, frame)) >= 1
