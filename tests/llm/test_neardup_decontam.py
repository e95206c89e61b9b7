import random

from revisio.llm import decontam, neardup

VOCAB = [f"w{i}" for i in range(400)]


def brute(rows):
    """doc_id -> smallest doc_id reachable over pairs of similarity 0.8 or more."""
    sets = {}
    for i, t in rows:
        w = (t or "").lower().split()
        sets[i] = {tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                    root[a] = root[b] = min(root[a], root[b])
    return root


def test_groups_equal_brute_force(spark):
    rng, rows = random.Random(3), []
    for k in range(8):
        base = [rng.choice(VOCAB) for _ in range(120)]
        for j in range(5):
            w = list(base)
            for _ in range(j):
                w[rng.randrange(120)] = "changed"
            rows.append((k * 10 + j, " ".join(w)))
    rows += [(100, rows[0][1]), (101, "a b"), (102, "A  b"), (103, ""), (104, None), (105, ""), (106, "x " * 30000)]
    d = spark.createDataFrame([(*r, 1, 2) for r in rows + [(None, "a b"), (101, "a b")]], "doc_id long, text string, h int, class_id int")
    got = {r.doc_id: r.class_id for r in neardup.groups(d).collect()}
    want = brute(rows)
    assert got == want
    kept = [r.doc_id for r in neardup.keep_one(d).collect()]
    assert sorted(i for i in kept if i is not None) == sorted(i for i in want if want[i] == i) and None in kept
    two = spark.createDataFrame([(1, "a b c d e f"), (2, "a b c d e f"), (2, "quite another text of some words"), (2, "quite another text of some words")], "doc_id long, text string")
    assert sorted(map(tuple, neardup.keep_one(two).collect())) == [(1, "a b c d e f"), (2, "quite another text of some words")]
    assert neardup.groups(d.limit(0)).count() == 0


def test_masks_survive_two_substitutions():
    assert not decontam.holes(decontam.MASKS)


def naive(docs, items):
    out = set()
    for d, text in docs:
        x = decontam.TOKEN.findall((text or "").lower())
        for i, t in items:
            y = decontam.TOKEN.findall((t or "").lower())
            n = min(13, len(y))
            for s in range(-len(y), len(x)):
                same = [0 <= s + k < len(x) and x[s + k] == y[k] for k in range(len(y))]
                if n and any(0 <= s + k and s + k + n <= len(x) and sum(same[k:k + n]) >= 0.8 * n for k in range(len(y) - n + 1)):
                    out.add((d, i))
    return out


def test_overlaps_equal_brute_force(spark):
    rng = random.Random(5)
    items = [(i, " ".join(rng.choice(VOCAB[:60]) for _ in range(n))) for i, n in enumerate((40, 15, 13, 9, 8, 3, 1))] + [(90, None), (91, ""), (None, "nine lives of a cat in a hat on a mat")]
    docs = [(99, None), (98, ""), (97, "z " * 50000), (None, items[0][1])]
    for k in range(60):
        w = [rng.choice(VOCAB) for _ in range(30)]
        y = items[k % 7][1].split()
        for _ in range(k % 4):
            y[rng.randrange(len(y))] = "other"
        docs.append((k, " ".join(w[:15] + y[(k % 3) * 5 if len(y) > 20 else 0:] + w[15:])))
    d = spark.createDataFrame([(*r, 5) for r in docs], "doc_id long, text string, item_id int")
    b = spark.createDataFrame(items, "item_id long, text string")
    want = naive(docs, items)
    for size in (10, 1000):
        assert {(r.doc_id, r.item_id) for r in decontam.overlaps(d, b, size).collect()} == want
    assert {r.doc_id for r in decontam.clean(d, b).collect()} - {None} == {i for i, _ in docs} - {i for i, _ in want} - {None}
    assert decontam.overlaps(d, b.limit(0)).count() == 0 and decontam.overlaps(d.limit(0), b).count() == 0


def linked(rows):
    """doc_id -> class over all pairs, as brute() but in one pass."""
    sets, root = {}, {i: i for i, _ in rows}
    for i, t in rows:
        w = t.split()
        sets[i] = {tuple(w[k:k + 5]) for k in range(len(w) - 4)}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b]) if b < a else 0
            if both and both >= 0.8 * (len(sets[a]) + len(sets[b]) - both):
                x, y = top(a), top(b)
                root[max(x, y)] = min(x, y)
    return {i: top(i) for i in sets}


def test_many_copies_around_the_least_similarity(spark, monkeypatch):
    rng, rows = random.Random(1), []
    base = [f"w{rng.randrange(5000)}" for _ in range(200)]
    for j in range(400):
        w = list(base)
        for _ in range(rng.choice((3, 4))):
            w[rng.randrange(200)] = f"v{rng.randrange(5000)}"
        rows.append((j, " ".join(w)))
    want = linked(rows)
    assert 1 < len(set(want.values())) < 400
    d = spark.createDataFrame(rows, "doc_id long, text string")
    for size in (neardup.BLOCK, 150):
        monkeypatch.setattr(neardup, "BLOCK", size)
        assert {r.doc_id: r.class_id for r in neardup.groups(d).collect()} == want


def test_repeated_lines_hide_no_copy(spark):
    rng, rows = random.Random(4), []
    line = " ".join(rng.choice(VOCAB) for _ in range(6))
    for k in range(20):
        base = " ".join(rng.choice(VOCAB) for _ in range(300))
        rows += [(2 * k, base + " " + line), (2 * k + 1, base + (" " + line) * 200)]
    got = {r.doc_id: r.class_id for r in neardup.groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows) and all(got[i] == i // 2 * 2 for i in got)
