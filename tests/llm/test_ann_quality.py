import numpy as np

from revisio.llm import ann, quality


def test_ann_is_exact_on_odd_rows(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(90, 5)).round(1)
    v[30:60] = v[3]  # ties
    rows = [(i, [float(c) for c in x], 0) for i, x in enumerate(v)] + [(200, None, 0), (201, [0.0] * 5, 0), (202, [float("nan")] + [1.0] * 4, 0), (203, [1.0, None, 0.0, 0.0, 0.0], 0), (220, [1.0, 2.0], 0), (None, [1.0] * 5, 0)]
    e = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int")
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in ann.search(e, query_block=3, row_block=20).collect()}
    x = np.array([np.float32(r[1]) for r in rows[:90]], dtype=float)
    want = {}
    for q in range(0, 90, 20):
        s = ann.dots(x, x, np.full(90, q), np.arange(90))
        for k, i in enumerate([i for i in sorted(range(90), key=lambda i: (-s[i], i)) if i != q][:20], 1):
            want[q, k] = (i, s[i])
    assert got == want
    assert ann.search(e.limit(0)).count() == 0


def test_quality_on_odd_rows(spark):
    good, bad = "The plain words of a text. ", "BUY!! NOW!! ### $$$ "
    docs = spark.createDataFrame([(i, (good if i % 3 else bad) * (i % 7 + 1), i) for i in range(120)] + [(500, None, 1), (501, "", 1), (501, "", 1), (None, "x" * 100000, 1)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(120)] + [(3, 1, 0), (None, 1, 0), (4, None, 0)], "doc_id long, quality int, toxic int")
    rows = quality.quality(docs, labels).collect()
    assert len(rows) == 124 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    seen = [r for r in rows if r.doc_id is not None and r.doc_id < 120 and r.held_out]
    assert seen and all(r.predicted == int(r.doc_id % 3 > 0) for r in seen)
    kept = quality.kept(docs, labels)
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.doc_id) for r in rows if r.score >= quality.CUT)
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_count") + plan.count("regexp_extract_all") <= 8  # each text is counted once, below the filter
    assert quality.quality(docs, labels.limit(0)).count() == 124
    assert quality.quality(docs.limit(0), labels).count() == 0


def test_held_out_labels_are_met(spark):
    d = "/root/testdata/sf0.01"
    got = quality.quality(spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet"))
    right = got.where("held_out").join(spark.read.parquet(f"{d}/labels.parquet").where("quality IS NOT NULL"), "doc_id").selectExpr("avg(CAST(predicted = quality AS DOUBLE)) AS right", "count(*) AS n").first()
    assert right.n > 40 and right.right > 0.9
