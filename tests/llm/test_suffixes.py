import hashlib
import random

import numpy as np

from revisio.llm import suffixes


def brute(rows):
    """Rows as the contract states them, string by string."""
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        for k in range(len(b) - 49):
            if i is not None:
                first[b[k:k + 50]] = min(i, first.get(b[k:k + 50], i))
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = [False] * len(b)
        for k in range(len(b) - 49):
            if i is not None and first[b[k:k + 50]] < i:
                gone[k:k + 50] = [True] * 50
        rest = bytes(c for c, g in zip(b, gone) if not g)
        out.append((i, len(b), sum(gone), sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone)), hashlib.sha256(rest).hexdigest()))
    return sorted(out, key=str)


def test_removed_equals_brute_force(spark):
    rng = random.Random(1)
    words = [f"wörd{i}" for i in range(50)]
    base = [" ".join(rng.choice(words) for _ in range(60)) for _ in range(6)]
    rows = [(None, base[0]), (500, None), (501, ""), (502, "short"), (503, "x " * 3000), (504, "y" + "x " * 900), (505, "a" * 49), (506, "a" * 50), (507, "a" * 51), (508, "b" * 51 + "a" * 60)]
    for i in range(80):
        b = rng.choice(base)
        s, cut = rng.randrange(100), rng.randrange(30, 200)
        t = " ".join(rng.choice(words) for _ in range(9)) + b[s:s + cut] + rng.choice(["", "Z"]) + b[s + cut:]
        rows += [(i, t)] * rng.choice([1, 1, 1, 2])
    rows.append((3, base[1] + base[1]))
    d = spark.createDataFrame([(*r, 7, "k") for r in rows], "doc_id long, text string, n int, key string")
    got = sorted(map(tuple, suffixes.removed(d).collect()), key=str)
    assert got == brute(rows)
    for hot in (2, 4096):
        assert sorted(map(tuple, suffixes.removed(d, 2000, hot).collect()), key=str) == got
    assert suffixes.removed(d.limit(0)).count() == 0


def test_pointers_tell_bytes_apart():
    rng = np.random.default_rng(3)
    data = rng.integers(97, 99, 3000).astype(np.uint8)
    data[1000:1400] = data[100:500]
    at = np.arange(len(data) - 49)
    ptr = suffixes.pointers(data, at)
    strings = [data[i:i + 50].tobytes() for i in at]
    numbers = {}
    assert all(numbers.setdefault(s, p) == p for s, p in zip(strings, ptr.tolist())) and len(numbers) == len(set(ptr.tolist()))
