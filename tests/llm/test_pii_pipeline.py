import hashlib
import random
import re

import numpy as np

import corpus_pipeline
from revisio.llm import mixing, pii

PLAIN = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")


def plain(text):
    out = []
    for k, p in enumerate(PLAIN):
        for m in re.finditer(p, text):
            d = re.sub(r"[^0-9]", "", m[0])
            if (True, k == 1 and all(int(x) <= 255 for x in m[0].split(".")), 14 <= len(d) <= 19 and pii.luhn(d), 10 <= len(d) <= 15)[k]:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_base_equals_plain_patterns():
    rng = random.Random(2)
    for _ in range(3000):
        t = "".join(rng.choice("a1234.@- +(é") for _ in range(40))
        assert pii.base(t) == plain(t)
    for _ in range(50):
        t = pii.example(rng)[0]
        assert pii.base(t) == plain(t)


def test_held_out_spans():
    net, rng, hit, said, want = pii.train(), random.Random(99), 0, 0, 0
    for _ in range(40):
        t, s = pii.example(rng)
        got = set(pii.learned(net, [t])[0])
        hit, said, want = hit + len(got & set(s)), said + len(got), want + len(s)
    assert hit / want > 0.85 and hit / said > 0.85


def test_addresses_without_digits_or_at_signs():
    net, text = pii.train(), "write to anna at mail.org. or to bob(at)corp.example, or tom[at]site.net now"
    texts = [text, "e tar soli " * 30 + text, text.upper()]
    found = [[t[s:e] for s, _, e in more] for t, (_, more) in zip(texts, pii.find(net, texts))]
    assert all(x in "|".join(f) for f in found[:2] for x in ("anna at mail.org", "bob(at)corp.example", "tom[at]site.net"))
    assert pii.find(net, ["he at last met thing at the ones. The at of rest"])[0] == ([], [])
    rng = random.Random(7)
    texts += [pii.example(rng)[0] + "n" * k for k in range(60)] + [pii.example(rng)[0].replace(" ", "  at  ").replace("@", "(AT)") for _ in range(20)] + ["", "a", "1", "x" * 24 + "4", "anna.of." * 30 + "x@mail.org"]
    every = [[x for x in s if pii.plausible(t, x)] for t, s in zip(texts, pii.learned(net, texts, lambda t: range(pii.final(len(t)) + 1)))]
    assert [[x for x in s if pii.plausible(t, x)] for t, s in zip(texts, pii.learned(net, texts))] == every


def test_spans_and_mask(spark):
    long = "word " * 20000 + "a.b@c.org"
    d = spark.createDataFrame([(1, "mail a@b.co now", 3), (1, "mail a@b.co now", 3), (2, None, 3), (3, "", 3), (None, long, 3)], "doc_id long, text string, spans int")
    rows = pii.spans(d).collect()
    assert sorted((r.doc_id or 0, r.n_email) for r in rows) == [(0, 1), (1, 1), (1, 1), (2, 0), (3, 0)]
    one = next(r for r in rows if r.doc_id == 1)
    assert one.spans == "email:5:11" and one.base_sha256 == hashlib.sha256(b"email:5:11").hexdigest()
    got = [(r.doc_id, r.text) for r in pii.mask(d).collect()]
    assert (1, "mail [email] now") in got and (2, None) in got and (None, "word " * 20000 + "[email]") in got
    assert pii.spans(d.limit(0)).count() == 0


def test_emit_repeats_rows(spark):
    d = spark.createDataFrame([(i, "a b c", "st"[i % 2], 1) for i in range(40)] + [(99, None, None, 2)], "doc_id long, text string, source string, n_chars long")
    taken = {r.doc_id: r.taken // 3 for r in mixing.mix(d).collect() if r.taken}
    got = mixing.emit(d)
    assert got.columns == d.columns and {r.doc_id: r["count"] for r in got.groupBy("doc_id").count().collect()} == taken


def test_stages_keep_columns(spark, tmp_path):
    words = [f"w{i}" for i in range(300)]
    rng = random.Random(1)
    good = [" ".join(rng.choice(words) for _ in range(60)) for _ in range(30)]
    rows = [(i, t, "en", "st"[i % 2], len(t)) for i, t in enumerate(good + good[:5])] + [(50 + i, "BUY!! ### " * 20, "en", "s", 200) for i in range(10)]
    rows.append((70, good[6] + " tell me@here.org", "en", "s", 1))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i < 50), 0) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, " ".join(good[9].split()[10:40]))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    ids = {r.doc_id for r in out.collect()}
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert not ids & ({9} | set(range(30, 35)) | set(range(50, 60)) | {70}) and len(ids) > 15
    assert out.where("n_chars <> char_length(text)").count() == 0
