"""Near duplicates by ProbMinHash over weighted five-word shingles.

A shingle's weight is its count. Each shingle sends arrivals of a Poisson process whose rate
is its weight to registers; a text stops early once its arrivals are later than all its
registers. Two texts' registers agree with their probability Jaccard similarity. Bands of
registers give candidate links, which are kept if the Jaccard similarity of the whole sets
of shingles is 0.8 or more. So that repeats hide no such link, a text that repeats shingles
has a second set of registers, with all weights 1; the others' would be the same. Words are what white space parts, in lower case.

Equal texts are one node. In a band, every text is first verified against the smallest and
the largest text hash of that band. Bands whose texts are then still in several classes are
dealt out in pairs of blocks of at most about BLOCK texts and CHARS characters, and every
pair of different classes is verified there, so no bucket is gathered. Null texts count as
empty. Texts under five words have one shingle of all their words; texts without words are
never duplicates. Rows with a null doc_id are left out of groups(). A repeated doc_id gives one row there,
in the class of its smallest class id. An empty table gives no rows. Other columns are
ignored.
"""
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from revisio.llm import graph

WORDS, BANDS, ROWS = 5, 20, 3
LEAST = 0.8
CHUNK = 1 << 20
BLOCK, CHARS, COLUMNS = 1024, 1 << 22, 4096
GOLDEN, MIX1, MIX2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mixed(x):
    x = (x ^ (x >> np.uint64(30))) * MIX1
    x = (x ^ (x >> np.uint64(27))) * MIX2
    return x ^ (x >> np.uint64(31))


def shingles(texts):
    """(document index, shingle hash) of every five words in a row."""
    words = [t.lower().split() for t in texts]
    n = np.fromiter(map(len, words), np.int64, len(words))
    flat = np.array([w for ws in words for w in ws], dtype=object)
    if not len(flat):
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    h = pd.util.hash_array(flat, categorize=True)
    doc = np.repeat(np.arange(len(words)), n)
    left = np.repeat(np.cumsum(n), n) - np.arange(len(flat))
    first = left == np.repeat(n, n)
    out = np.zeros(len(flat), np.uint64)
    for i in range(WORDS):
        nxt = np.zeros(len(flat), np.uint64)
        nxt[: max(0, len(flat) - i)] = h[i:]
        out = mixed(out * GOLDEN + np.where(left > i, nxt, np.uint64(i + 1)))
    keep = (left >= WORDS) | first
    return doc[keep], out[keep]


def registers(doc, shingle, docs, m=BANDS * ROWS):
    """docs x m matrix: the shingle whose arrival came first in each register."""
    doc, shingle, weight = counted(doc, shingle)
    return arrived(doc, shingle, weight, docs, m)


def counted(doc, shingle):
    """Every shingle of a document once, and its count."""
    _, at, weight = np.unique(mixed(shingle + mixed(doc.astype(np.uint64) + GOLDEN)), return_index=True, return_counts=True)
    return doc[at], shingle[at], weight


def arrived(doc, shingle, weight, docs, m=BANDS * ROWS):
    """registers() of shingles of these weights."""
    best, sig = np.full(docs * m, np.inf), np.zeros(docs * m, np.uint64)
    t, rounds, r = np.zeros(len(doc)), [], 0
    while len(doc):
        r += 1
        u = mixed(shingle + np.uint64(2 * r * int(GOLDEN) % 2**64))
        t = t - np.log1p(-(u >> np.uint64(11)).astype(float) / 2.0**53) / weight
        slot = doc * m + (mixed(u + GOLDEN) % np.uint64(m)).astype(np.int64)
        np.minimum.at(best, slot, t)
        rounds.append((slot, t, shingle))
        live = t < best.reshape(docs, m).max(axis=1)[doc]
        doc, shingle, weight, t = doc[live], shingle[live], weight[live], t[live]
    for slot, t, shingle in rounds:
        won = t == best[slot]
        sig[slot[won]] = shingle[won]
    return sig.reshape(docs, m)


def keys(sig):
    """Band keys of each row of registers."""
    sig = sig.reshape(len(sig), BANDS, ROWS)
    key = np.broadcast_to(mixed(np.arange(1, BANDS + 1, dtype=np.uint64) * GOLDEN), sig.shape[:2])
    for i in range(ROWS):
        key = mixed(key * GOLDEN + sig[:, :, i])
    return key.view(np.int64)


def bands(texts):
    """Band keys of each text, with weights and, where a shingle repeats, also without; None for texts without words."""
    out, start = [], 0
    while start < len(texts):
        end, size = start, 0
        while end < len(texts) and (end == start or size + len(texts[end]) <= CHUNK):
            size += len(texts[end])
            end += 1
        doc, sh, weight = counted(*shingles(texts[start:end]))
        n = end - start
        has = np.zeros(n, bool)
        has[doc] = True
        part = [k if ok else None for k, ok in zip(keys(arrived(doc, sh, weight, n)).tolist(), has)]
        again = np.unique(doc[weight > 1])
        if len(again):
            of = np.isin(doc, again)
            new = keys(arrived(np.searchsorted(again, doc[of]), sh[of], np.ones(of.sum(), np.int64), len(again)))
            for i, k in zip(again.tolist(), new.tolist()):
                part[i] = sorted({*part[i], *k})
        out += part
        start = end
    return out


def _banded(batches):
    for b in batches:
        b = pa.Table.from_batches([b])
        texts = b["text"].to_pylist()
        yield pa.RecordBatch.from_arrays([b["doc_id"].combine_chunks(), b["h"].combine_chunks(), pa.array(bands(texts), pa.list_(pa.int64())), pa.array(map(len, texts), pa.int64())], names=["doc_id", "h", "bands", "chars"])


def jaccard(a, b):
    """Similarities of pairs of texts."""
    out, memo = [], {}
    for x, y in zip(a, b):
        s = []
        for t in (x, y):
            if t not in memo:
                if len(memo) > 64:
                    memo.clear()
                memo[t] = np.unique(shingles([t])[1])
            s.append(memo[t])
        both = len(np.intersect1d(s[0], s[1], assume_unique=True))
        out.append(both / max(1, len(s[0]) + len(s[1]) - both))
    return out


def _verified(batches):
    for b in batches:
        ok = np.array(jaccard(b["t1"].to_pylist(), b["t2"].to_pylist())) >= LEAST
        yield pa.RecordBatch.from_arrays([b["h1"], b["h2"]], names=["h1", "h2"]).filter(pa.array(ok))


def alike(texts, side, root):
    """(i, j) links between texts of different roots, of a pair of blocks: across the two sides if there are two, else all; a forest, as good as all of them."""
    n = len(texts)
    doc, sh = shingles(texts)
    order = np.lexsort((doc, sh))
    doc, sh = doc[order], sh[order]
    new = np.ones(len(sh), bool)
    new[1:] = (sh[1:] != sh[:-1]) | (doc[1:] != doc[:-1])
    doc, sh = doc[new], sh[new]
    size = np.bincount(doc, minlength=n)
    _, col, uses = np.unique(sh, return_inverse=True, return_counts=True)
    several = uses[col] > 1
    doc, col = doc[several], (np.cumsum(uses > 1) - 1)[col[several]]
    both = np.zeros((n, n), np.float32)
    for k in range(0, int(col[-1]) + 1 if len(col) else 0, COLUMNS):
        lo, hi = np.searchsorted(col, (k, k + COLUMNS))
        m = np.zeros((n, COLUMNS), np.float32)
        m[doc[lo:hi], col[lo:hi] - k] = 1
        both += m @ m.T
    ok = both / np.maximum(1, size[:, None] + size[None] - both.astype(np.int64)) >= LEAST
    side, root = np.array(side), np.unique(root, return_inverse=True)[1]
    if len(set(side.tolist())) > 1:
        ok &= side[:, None] != side[None]
    ok &= root[:, None] != root[None]
    np.fill_diagonal(ok, True)
    label = np.arange(n)
    while True:
        low = np.where(ok, label[None], n).min(axis=1)
        if (low == label).all():
            return [(i, j) for i, j in enumerate(label.tolist()) if i != j]
        label = low


def _blocked(batches):
    """Rows sorted by band and pair of blocks; each pair's links as it ends."""
    def links():
        return [(held[i][1], held[j][1]) for i, j in alike([r[3] for r in held], [r[0] for r in held], [r[2] for r in held])]

    key, held = None, []
    for b in batches:
        out = []
        for k, *r in zip(zip(*(b[c].to_pylist() for c in ("band", "i", "j"))), *(b[c].to_pylist() for c in ("side", "h", "root", "text"))):
            if k != key and held:
                out += links()
                held = []
            key = k
            held.append(r)
        yield _linked(out)
    if held:
        yield _linked(links())


def _linked(rows):
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.string()) for k in (0, 1)], names=["h1", "h2"])


def rest(d, nodes, roots, pairs):
    """Links h1, h2 of the pairs in a band that are still in different roots. Three texts of a band are all verified by its ends; in an open band every root is one of a pair that was rejected."""
    for end in ("h1", "h2"):
        pairs = pairs.join(roots.withColumnRenamed("h", end), end, "left").withColumn(end, F.coalesce("root", end)).drop("root")
    some = pairs.where("h1 <> h2").select(F.explode(F.array("h1", "h2")).alias("root")).distinct()
    n = nodes.join(roots, "h", "left").withColumn("root", F.coalesce("root", "h")).join(some, "root", "left_semi")
    n = n.select("h", "rep", "chars", "root", F.explode("bands").alias("band"))
    x, r = F.xxhash64("h"), F.xxhash64("root")
    open_ = n.select("band", "chars", x.alias("x"), r.alias("r")).groupBy("band").agg(
        F.count("*").alias("n"), F.sum("chars").alias("chars"), F.min("r").alias("lo"), F.max("r").alias("hi"), F.min("x").alias("first"), F.max("x").alias("last"), F.bit_xor("x").alias("xor")).where("n > 3 and lo <> hi")
    open_ = graph.cut(open_.groupBy("n", "first", "last", "xor").agg(F.min("band").alias("band"), F.first("chars").alias("chars")), d.sparkSession)
    k = F.ceil(F.greatest(F.col("n") / BLOCK, F.col("chars") / CHARS)).cast("int")
    b = n.join(open_.select("band", k.alias("k")), "band").withColumn("side", F.pmod(F.xxhash64("h"), F.col("k")).cast("int"))
    b = graph.cut(b.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("k") - 1))).select("h", "rep", "root", "band", "side", F.least("side", "o").alias("i"), F.greatest("side", "o").alias("j")), d.sparkSession)
    texts = _texts(d, b.select("h", "rep").distinct())
    b = b.join(texts, "h").select("band", "i", "j", "side", "h", "root", "text")
    return b.repartition("band", "i", "j").sortWithinPartitions("band", "i", "j").mapInArrow(_blocked, "h1 string, h2 string")


def _texts(d, used):
    """h, text of the nodes used (h, rep)."""
    used = used.withColumnRenamed("h", "h0")
    return d.join(used, (d["doc_id"] == used["rep"]) & (d["h"] == used["h0"])).select("h", "text").dropDuplicates(["h"])


def classes(docs):
    """(rows, texts): doc_id, h and bands of every row with a doc_id; h, smallest doc_id and class_id of every text with words."""
    spark = docs.sparkSession
    d = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("h", F.md5("text"))
    b = graph.cut(d.mapInArrow(_banded, "doc_id long, h string, bands array<long>, chars long"), spark)
    nodes = b.groupBy("h").agg(F.min("doc_id").alias("rep"), F.max(F.col("bands")).alias("bands"), F.max("chars").alias("chars"))
    nodes = graph.cut(nodes, spark)
    each = nodes.select("h", F.explode("bands").alias("band"))
    ends = each.groupBy("band").agg(F.min("h").alias("lo"), F.max("h").alias("hi")).where("lo <> hi")
    links = each.join(ends, "band").select("h", F.explode(F.array("lo", "hi")).alias("end")).where("h <> end")
    pairs = graph.cut(links.select(F.least("h", "end").alias("h1"), F.greatest("h", "end").alias("h2")).distinct(), spark)
    used = pairs.select(F.explode(F.array("h1", "h2")).alias("h")).distinct()
    texts = graph.cut(_texts(d, used.join(nodes.select("h", "rep"), "h")), spark)
    p = pairs.join(texts.select(F.col("h").alias("h1"), F.col("text").alias("t1")), "h1")
    p = p.join(texts.select(F.col("h").alias("h2"), F.col("text").alias("t2")), "h2").select("h1", "h2", "t1", "t2")
    roots = graph.components(p.mapInArrow(_verified, "h1 string, h2 string"), spark)
    more = rest(d, nodes, roots, pairs)
    for end in ("h1", "h2"):
        more = more.join(roots.select(F.col("h").alias(end), "root"), end, "left").withColumn(end, F.coalesce("root", end)).drop("root")
    more = graph.components(more, spark).select(F.col("h").alias("root"), F.col("root").alias("higher"))
    n = nodes.select("h", "rep").join(roots, "h", "left").withColumn("root", F.coalesce("root", "h"))
    n = n.join(more, "root", "left").select("h", "rep", F.coalesce("higher", "root").alias("root"))
    ids = n.groupBy("root").agg(F.min("rep").alias("class_id"))
    return b, n.join(ids, "root").select("h", "rep", "class_id")


def groups(docs):
    """doc_id, class_id: the smallest doc_id among a document's near copies."""
    b, n = classes(docs)
    alone = b.where("bands is null").select("doc_id", F.col("doc_id").alias("class_id"))
    out = b.where("bands is not null").select("doc_id", "h").join(n.select("h", "class_id"), "h").select("doc_id", "class_id")
    return out.unionByName(alone).groupBy("doc_id").agg(F.min("class_id").alias("class_id"))


def keep_one(docs):
    """One row of each class: its smallest doc_id, with that id's text; of repeated rows one. Each text of a repeated doc_id is judged in its own class. Texts without words stay, one row an id, and so do rows with a null doc_id."""
    b, n = classes(docs)
    ones = n.groupBy("class_id").agg(F.min(F.struct("rep", "h")).alias("x")).select(F.col("x.rep").alias("doc_id"), F.col("x.h").alias("__h"))
    ones = ones.unionByName(b.where("bands is null").select("doc_id", F.col("h").alias("__h")).distinct())
    d = docs.where("doc_id is not null").withColumn("__h", F.md5(F.coalesce("text", F.lit(""))))
    d = d.join(ones.withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType)), ["doc_id", "__h"], "left_semi").dropDuplicates(["doc_id", "__h"])
    return d.select(docs.columns).unionByName(docs.where("doc_id is null"))
