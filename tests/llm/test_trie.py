import hashlib
import random
import zlib

import pytest

from revisio.llm import trie


def key(role, text):
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()


def brute(rows):
    own = {}
    for c, t, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((t is not None, t or 0, key(role or "", text or ""), role or "", text or ""))
    convs = {c: [x[3:] for x in sorted(v)] for c, v in own.items()}
    whole = {}
    for c, v in convs.items():
        h = zlib.crc32(str(c).encode()) % 4
        whole[c] = tuple(convs.get(c - c % 20, [])[:h] + v[h:])
    nodes = {}
    for c, v in whole.items():
        for d in range(len(v) + 1):
            nodes.setdefault(v[:d], []).append(c)
    kids = {}
    for n in nodes:
        if n:
            kids.setdefault(n[:-1], []).append(n)
    sums = {}
    for n in sorted(nodes, key=len, reverse=True):
        below = [sums[k] for k in kids.get(n, [])]
        words = len(n[-1][1].encode().split()) if n else 0
        sums[n] = (sum(b[0] for b in below) or 1, (len(nodes[n]) - 1) * words + sum(b[1] for b in below))
    return sorted(((min(m), len(n), min(nodes[n[:-1]]) if n else None, len(m), len(kids.get(n, [])), *sums[n],
                    hashlib.sha256(",".join(str(c) for c in sorted(m) if len(whole[c]) == len(n)).encode()).hexdigest()) for n, m in nodes.items()), key=str)


def check(spark, rows):
    d = spark.createDataFrame([(*r, "x", 3) for r in rows], "conv_id long, turn long, role string, text string, digest string, d int").repartition(5)
    out = trie.trie(d)
    assert out.columns == [*trie.NODE, "ends_sha256"] and {k for _, k in out.dtypes[:-1]} == {"bigint"}
    assert sorted(map(tuple, out.collect()), key=str) == brute(rows)


def test_nodes_equal_brute_force(spark):
    rng = random.Random(7)
    rows = [(None, 0, "user", "lost"), (5000, None, None, None), (5000, 3, "user", ""), (5001, 1, "a", "b c"), (5001, 1, "a", "b c"), (5002, 1, "ab", " c"), (5003, 0, "user", "w " * 90_000)]
    for c in range(300):
        if c == 40:
            continue
        for t in range(rng.randrange(1, 8)):
            rows.append((c, t if rng.random() < 0.97 else None, rng.choice(["user", "bot"]) if t > 2 else "user", rng.choice(["hi there", "yes", "tell me more", ""]) if t > 1 else "hello"))
    for c in range(1000, 1060):  # copies, some longer
        rows += [(c, t, "user", f"turn {t}") for t in range(6 + (c % 7 == 0))]
    rows.append(rows[-1])
    check(spark, rows)


@pytest.mark.parametrize("rows", [[(20, 0, "u", "one two")], [(20, 0, "u", "one two"), (20, 1, "b", "x"), (27, 0, "u", "one two"), (27, 1, "b", "x")], [(3, 0, "u", "a")], [(3, 0, "u", "a"), (5, 0, "u", "b")]])
def test_few_conversations(spark, rows):
    check(spark, rows)


def test_empty(spark):
    d = spark.createDataFrame([(None, 1, "u", "x")], "conv_id long, turn long, role string, text string")
    assert trie.trie(d).count() == 0 and trie.trie(d.limit(0)).count() == 0
