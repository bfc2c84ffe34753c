import random

import numpy as np
import pyarrow as pa
import pytest

from rostrum.llm import decontaminate, grams


def longest(docs, bench, window, split):
    powers = grams.Powers()
    cut = [bench[i:i + split] for i in range(0, len(bench), split)]
    blocks = [decontaminate.TestBlock([i for i, _ in part], [t for _, t in part], window, powers) for part in cut]
    out = []
    for _, _, data, offsets in grams.chunks(pa.array(docs, pa.string())):
        found = decontaminate.search(data, offsets, [b for b in blocks if len(b.rows)], powers)
        out += zip(found["longest_words"], found["longest_at"], found["longest_item"])
    return out


def brute(doc, bench, window):
    d, best = doc.split(), (0, None, None)
    for p in range(len(d)):
        for item, text in bench:
            w = text.split()
            for q in range(len(w) if len(w) >= window else min(1, len(w))):
                n = 0
                while p + n < len(d) and q + n < len(w) and d[p + n] == w[q + n]:
                    n += 1
                name = None if item is None else str(item)
                key = lambda x: (-x[0], -1 if x[1] is None else x[1], x[2] is None, x[2] or "")
                if n >= min(window, len(w)) and key((n, p, name)) < key(best):
                    best = (n, p, name)
    return best


def test_window_that_also_opens_a_smaller_item():
    shared = [f"w{i}" for i in range(13)]
    a, b = " ".join([*shared, "other", "end"]), " ".join([*shared, *(f"b{i}" for i in range(27))])
    assert longest(["x " + b], [(1, a), (2, b)], 13, 9) == [(40, 1, "2")]


@pytest.mark.parametrize("seed", range(12))
@pytest.mark.parametrize("split", [1, 3, 99])
def test_longest_match_equals_brute_force(seed, split):
    rng = random.Random(seed)
    text = lambda n: " ".join(rng.choices("abc", k=n))
    bench = [(i if i % 4 else None, text(rng.choice([2, 5, 12, 30]))) for i in range(8)]
    docs = [text(rng.choice([0, 3, 20, 50])) for _ in range(8)]
    assert longest(docs, bench, 4, split) == [brute(d, bench, 4) for d in docs]
