import hashlib
import random
import zlib

import numpy as np

from revisio.llm import periods


def brute(x):
    """Every maximal stretch of every period, the smallest period of each."""
    out = {}
    for p in range(1, len(x) // 4 + 1):
        i = 0
        while i + p < len(x):
            s = i
            while i + p < len(x) and x[i] == x[i + p]:
                i += 1
            if i > s and i - s + p >= max(6, 4 * p):
                out.setdefault((s, i + p), p)
            i += i == s
    return sorted((s, e - s, p) for (s, e), p in out.items())


def whole(i, text):
    x = [w for w in __import__("re").split("[\x20\x09-\x0d]+", text or "") if w]
    h = zlib.crc32(str(i).encode()) if i is not None else 1
    if x and h % 10 == 0:
        g = h // 10
        a = g % len(x)
        p = 1 + (len(x) - a) // (3 + g % 8)
        x = [x[k if k < a else a + (k - a) % p] for k in range(len(x))]
    found = brute(x)
    drop = {k for s, n, p in found for k in range(s + p, s + n)}
    best = sorted(found, key=lambda r: (-r[1], r[0], r[2]))[:1]
    top = (*best[0], 1000 * best[0][1] // best[0][2]) if best else (None,) * 4
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return i, len(found), *top, sha("".join("%d,%d,%d\n" % r for r in found)), sha(" ".join(w for k, w in enumerate(x) if k not in drop))


def texts(rng, n):
    for k in range(n):
        words = [rng.choice("abcdefgh"[:rng.choice([1, 2, 3, 8])]) for _ in range(rng.randrange(70))]
        if rng.random() < 0.7 and words:
            p, s = rng.randrange(1, 9), rng.randrange(len(words))
            unit = [rng.choice("abc") for _ in range(p)]
            for i in range(s, min(len(words), s + rng.randrange(5, 60))):
                words[i] = unit[(i - s) % p]
        yield rng.choice([" ", "\t", "\n \x0b", "\x0c\r"]).join(words)


def test_rows_equal_brute_force(spark):
    rows = list(enumerate(texts(random.Random(5), 600)))
    rows += [(None, "a " * 9), (700, None), (701, ""), (702, " \n"), (703, "a\x85a\x1ca\xa0a a"), (704, "é ß " * 20), (705, "x " * 3000), (706, "once " + "la la li " * 500 + "end"), (30, "one"), (705, "x " * 3000)]
    d = spark.createDataFrame([(*r, 1, "k") for r in rows], "doc_id long, text string, n_runs int, period string")
    got = sorted(map(tuple, periods.periodic(d).collect()), key=str)
    assert got == sorted((whole(*r) for r in rows), key=str)
    assert any(r[1] > 1 for r in got) and periods.periodic(d.limit(0)).count() == 0


def test_grid_in_small_pieces(monkeypatch):
    rng = random.Random(6)
    monkeypatch.setattr(periods, "GRID", 9)
    monkeypatch.setattr(periods, "STEP", 1)
    for t in texts(rng, 800):
        x = [ord(c) for c in "".join(t.split())]
        x = x * rng.choice([1, 1, 4])
        assert periods.runs(np.array(x, np.int64)) == brute(x)
