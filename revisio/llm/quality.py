"""Quality scores by Bradley-Terry ranking of preference pairs.

Each text becomes a short vector of counts and shares. A linear worth is learnt from pairs
(a row marked 1 preferred to a row marked 0) by logistic loss on feature differences. The
cut is the quantile of learnt rows' worths at the share of rows marked 0; the score puts that
cut at 0.3. A null text scores as an empty one; every row of documents is scored, repeated
rows repeat. Rows of labels that are null or contradict each other for a doc_id are not
learnt from. Without rows of both marks every worth is 0. Other columns are ignored.
"""
import numpy as np
from pyspark.sql import functions as F

from revisio.llm.graph import aside

CUT = 0.3
#: At most about so many labelled rows are learnt from, picked by a hash of doc_id.
SAMPLE = 20000


def raw(text):
    """Counts of a text column, from built-in functions only."""
    t = F.coalesce(text, F.lit(""))

    def count(p):
        return F.regexp_count(t, F.lit(p)).cast("double")

    words, lines = F.split(t, r"\s+"), F.split(t, "\n")
    return F.array(F.char_length(t).cast("double"), F.size(words).cast("double"), F.size(lines).cast("double"), count(r"[A-Z]"), count(r"[0-9]"),
                   count(r"[^\p{L}\p{N}\s.,]"), count(r"[.,](?=\s|$)"), F.size(F.array_distinct(words)).cast("double"), F.size(F.array_distinct(lines)).cast("double"))


def features(counts):
    """Features of a column of raw counts."""
    n, nw, nl, up, digit, mark, end, dw, dl = (counts[i] for i in range(9))
    share = [up / (n + 1), digit / (n + 1), mark / (n + 1), end / nw, 1 - dw / nw, 1 - dl / nl, n / nw / 10, nl / nw]
    return [F.log1p(n) / 10, F.log1p(nw) / 10, F.log1p(nl) / 5, *share, *[F.sqrt(x) for x in share[:3]],
            *[F.least(x * 20, F.lit(1.0)) for x in (share[0], share[1], share[2], share[5])], *[x * x for x in share[3:6]]]


def learn(x, y, pairs=200000, steps=400, seed=7):
    """(weights, cut) over standardised features; full-batch Adam on sampled pairs."""
    mean, sd = (x.mean(0), x.std(0) + 1e-6) if len(x) else (np.zeros(1), np.ones(1))
    pos, neg = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(pos) or not len(neg):
        return np.zeros(x.shape[1]), 0.0
    z = np.clip((x - mean) / sd, -8, 8)
    rng = np.random.default_rng(seed)
    d = z[rng.choice(pos, pairs)] - z[rng.choice(neg, pairs)]
    w, m, v = np.zeros(x.shape[1]), 0.0, 0.0
    for i in range(1, steps + 1):
        g = -(d.T @ (1 / (1 + np.exp(np.clip(d @ w, -30, 30))))) / pairs + 1e-4 * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - 0.05 * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.999**i)) + 1e-8)
    w = w / sd
    return w, float(np.quantile(x @ w, (y == 0).mean()))


def held_out():
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5 == 0


def fit(docs, labels, sample=SAMPLE):
    marks = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("y"), F.max("quality").alias("y2")).where("y = y2")
    marks = marks.where(~held_out())
    keep = min(1.0, sample / max(1, marks.count()))
    marks = marks.where(F.pmod(F.xxhash64("doc_id"), F.lit(1000000)) < int(keep * 1000000) + 1)
    rows = docs.select("doc_id", "text").join(marks, "doc_id").select(raw(F.col("text")).alias("c"), "y", F.monotonically_increasing_id().alias("row"))
    rows = rows.select(F.array(*features(F.col("c"))).alias("f"), "y").toArrow()
    if not rows.num_rows:
        return np.zeros(1), 0.0
    return learn(np.array(rows["f"].to_pylist(), float), rows["y"].to_numpy())


def score(docs, labels, sample=SAMPLE):
    """docs with __score, __held_out and __row. Filters on the score that also use the row number, which is not deterministic, stay above the counts, so each text is counted once."""
    w, cut = fit(docs, labels, sample)
    d = docs.select("*", raw(F.col("text")).alias("__counts"), F.monotonically_increasing_id().alias("__row"))
    worth = F.lit(float(np.log(CUT / (1 - CUT))) - cut)
    for a, f in zip(w, features(F.col("__counts"))):
        worth = worth + float(a) * f
    return d.withColumn("__score", 1 / (1 + F.exp(-worth))).withColumn("__held_out", held_out()).drop("__counts")


def kept(docs, labels, sample=SAMPLE):
    """The rows scored at or above the cut."""
    d = aside(docs, "doc_id", "text")
    return score(d, labels, sample).where((F.col("__score") >= CUT) & (F.col("__row") >= 0)).select(d.columns).toDF(*docs.columns)


def quality(docs, labels):
    return score(docs, labels).select("doc_id", F.col("__held_out").alias("held_out"), F.col("__score").alias("score"),
                                      (F.col("__score") >= CUT).cast("int").alias("predicted"))
