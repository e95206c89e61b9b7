import math
from collections import Counter

import pytest

from revisio.llm import crossent

DOCS = [(1, "The cat sat on the mat"), (2, "the CAT sat\ton a mat "), (3, "buy pills buy pills"), (4, None), (5, ""), (6, "w " * 5000), (7, "the cat sat on the mat"), (None, "the cat")]
LABELS = [(1, 1), (2, 1), (2, 1), (3, 0), (7, 1), (7, 0), (None, 1), (6, None)]


def naive(docs, good):
    def pairs(t):
        w = (t or "").lower().split()
        return list(zip(["<s>", *w], [*w, "</s>"]))

    size = len({v for _, t in docs for v, _ in pairs(t)})
    out = {}
    for i, t in docs:
        loss = []
        for keep in (lambda j: j in good, lambda j: True):
            c, k = Counter(), Counter()
            for j, x in docs:
                if j != i and keep(j):
                    c.update(pairs(x))
                    k.update(v for v, _ in pairs(x))
            loss.append(sum(-math.log((c[v, w] + crossent.A) / (k[v] + crossent.A * size)) for v, w in pairs(t)) / len(pairs(t)))
        out[i] = loss
    return out


def test_scores_equal_brute_force(spark):
    d = spark.createDataFrame([(*r, 1, 2, True) for r in DOCS], "doc_id long, text string, n int, gram int, marked boolean")
    m = spark.createDataFrame(LABELS, "doc_id long, quality int")
    got = {r.doc_id: r for r in crossent.score(d, m).collect()}
    want = naive(DOCS, {1, 2})
    assert set(got) == set(want)
    for i, (t, b) in want.items():
        assert got[i].target_loss == pytest.approx(t, abs=2e-6) and got[i].background_loss == pytest.approx(b, abs=2e-6)
    parted = {r.doc_id: r for r in crossent.score(d, m, size=50).collect()}
    assert parted == got
    twice = crossent.score(d.union(d.where("doc_id = 3")), m.limit(0)).collect()
    assert len(twice) == len(DOCS) and crossent.score(d.limit(0), m).count() == 0


def test_grams_of_a_chunk_are_hashed_once(monkeypatch):
    seen, plain = [], crossent.grams
    monkeypatch.setattr(crossent, "grams", lambda texts: seen.append(len(texts)) or plain(texts))
    table = crossent.pa.table({"chunk": [0, 0, 0], "text": ["a b a", "", "b c"], "marked": [True, False, False]})
    crossent._counted(1)(table)
    assert sum(seen) == 3
    (lo, marked, doc, of), = crossent.Chunk(table)
    assert lo == 0 and marked.tolist() == [True, False, False] and (crossent.Chunk(table).grams[of] == plain([b"a b a", b"", b"b c"])[1]).all() and doc.tolist() == plain([b"a b a", b"", b"b c"])[0].tolist()
