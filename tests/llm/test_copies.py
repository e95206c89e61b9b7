import hashlib
import random
from collections import defaultdict

import numpy as np
from hypothesis import given, settings, strategies as st

from revisio.llm import copies


def brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    out = []
    for t, ids in groups.items():
        ids = sorted(ids, key=lambda i: (i is not None, i), reverse=True)
        out += [(i, ids[0], len(ids), k == 0, hashlib.sha256(t.encode()).hexdigest()) for k, i in enumerate(ids)]
    return sorted(out, key=str)


def test_groups_equal_brute_force(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(None, "same"), (None, "same"), (None, "null ids"), (None, "null ids"), (1, None), (2, ""), (3, "x" * 300_000), (4, "x" * 300_000), (5, "Same"), (6, "same "), (7, "same"), (7, "same"), (7, "other"), (8, "é"), (9, "é")]
    rows += [(100 + i, rng.choice(["hot"] * 60 + [f"text {k}" for k in range(90)])) for i in range(400)]
    d = spark.createDataFrame([(*r, "k", 1, True) for r in rows], "doc_id long, text string, sha string, group_size int, __maybe boolean").repartition(7)
    assert sorted(map(tuple, copies.groups(d).collect()), key=str) == brute(rows)
    # small buckets and filters, and bits so few that every text passes
    for name, value in (("BUCKET", 40), ("FILTER", 10), ("BITS", 1)):
        monkeypatch.setattr(copies, name, value)
    assert sorted(map(tuple, copies.groups(d).collect()), key=str) == brute(rows)
    assert copies.groups(d.limit(0)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.dictionaries(st.integers(0, 2**61 - 1), st.integers(1, 9), min_size=1, max_size=40), min_size=1, max_size=5), st.integers(0, 3))
def test_filters_merge_losslessly(parts, top):
    base = ((2**top - 1) << (64 - top)) if top else 0
    want, filters = defaultdict(int), []
    for p in parts:
        keys = sorted({base | k % 2 ** (64 - top): n for k, n in p.items()}.items())
        for k, n in keys:
            want[k] += n
        filters.append(copies.encoded(np.array([k for k, _ in keys], np.uint64), np.array([n for _, n in keys]), top))
    h, n = copies.merged(filters)
    assert dict(zip(h.tolist(), n.tolist())) == want and h.tolist() == sorted(want)
