"""Cross-entropy difference of documents under two matched bigram models.

The target model counts the documents marked 1 in labels, the background model all documents.
Both smooth alike over one vocabulary, all words of all documents and the end mark:
p(w|v) = (c(v,w) + A) / (c(v) + A * V). A document's own counts are taken out of both models
before it is scored, so none is predicted from itself. As log p is a difference of a pair's
and a context's part, pairs and contexts are counted alike as grams, by 64-bit hashes.

Texts are dealt into chunks. A chunk counts its grams and sends each once to the bucket of its
hash; the buckets sum up and answer with the counts of all texts, in the chunk's order, and
the chunk scores its documents by them. So no gram is shipped by document, and a gram of every
document reaches its bucket once a chunk.

Words are runs without ASCII white space, A to Z in lower case. A null text is empty and only
predicts its end. Rows that repeat a doc_id give one result over all their texts, each
row's own counts taken out for that row alone; null ids give one result too. Rows of labels that are null or contradict each other mark nothing.
Without marked rows the target knows no counts. An empty table gives no rows. Other columns
are ignored.
"""
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

from revisio.llm import packed
from revisio.llm.packed import GOLDEN, mixed

A = 0.1
START, END = np.uint64(11), np.uint64(13)
#: Marked ids are broadcast up to so many, and joined by key beyond.
BROADCAST = 1 << 21
#: Bytes of text in a chunk: the larger, the fewer times a gram is sent.
SIZE = 16 << 20
#: The bucket of the row that tells each chunk the size of the vocabulary.
WORDS = -1
SPACE = np.isin(np.arange(256), list(b" \t\n\r\x0b\x0c"))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def words(texts):
    """(text index, hash) of each word of some texts of bytes."""
    size = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    data = LOWER[np.frombuffer(b" ".join([*texts, b""]), np.uint8)]
    space = np.concatenate([[True], SPACE[data]])
    turn = np.flatnonzero(space[1:] != space[:-1])
    start, end = turn[::2], turn[1::2]
    h = packed.span(packed.sums(data), start, end)
    return np.searchsorted(np.cumsum(size), start, "right"), mixed(h + (end - start).astype(np.uint64) * GOLDEN)


def grams(texts):
    """(text index, gram) arrays; the lowest bit of a gram is 1 for contexts."""
    doc, h = words(texts)
    n = np.bincount(doc, minlength=len(texts))
    last = np.cumsum(n + 1) - 1
    v, w = np.full(len(h) + len(texts), START), np.full(len(h) + len(texts), END)
    inner = np.ones(len(w), bool)
    inner[last] = False
    w[inner] = h
    v[np.flatnonzero(inner) + 1] = h
    one = np.uint64(1)
    doc = np.repeat(np.arange(len(texts), dtype=np.int64), n + 1)
    return np.concatenate([doc, doc]), np.concatenate([mixed(v * GOLDEN + mixed(w)) & ~one, mixed(v) | one])


class Chunk:
    """The grams of a chunk, block by block, hashed and sorted once, and the whole chunk's distinct ones."""

    def __init__(self, table):
        self.chunk, self.texts = table["chunk"][0].as_py(), [t.encode("utf-8", "surrogatepass") for t in table["text"].to_pylist()]
        self.marked = np.array(table["marked"].to_pylist(), bool)
        each, self.blocks = [], []
        for lo, hi in packed.blocks(self.texts):
            doc, g = grams(self.texts[lo:hi])
            u, of = np.unique(g, return_inverse=True)
            each.append(u)
            # a block has no more grams than 32 bits tell apart; half as many bytes are kept till all of the chunk's are known
            self.blocks.append((lo, hi, doc.astype(np.int32), of.astype(np.int32)))
        self.grams = np.unique(np.concatenate(each))
        self.places = [np.searchsorted(self.grams, u).astype(np.int32) for u in each]

    def __iter__(self):
        """(first text, marks of texts, text index, index of the gram in self.grams) of each block."""
        for (lo, hi, doc, of), at in zip(self.blocks, self.places):
            yield lo, self.marked[lo:hi], doc.astype(np.int64), at[of].astype(np.int64)


def _table(chunk, bucket, data):
    return pa.table({"chunk": pa.array(chunk, pa.int32()), "bucket": pa.array(bucket, pa.int32()), "data": pa.array(data, pa.binary())})


def _counted(buckets):
    def run(table):
        c = Chunk(table)
        n, good = np.zeros(len(c.grams), np.uint32), np.zeros(len(c.grams), np.uint32)
        for _, marked, doc, of in c:
            for count, some in ((n, of), (good, of[marked[doc]])):
                i, k = np.unique(some, return_counts=True)
                count[i] += k.astype(np.uint32)
        return _table(*packed.sent(c.chunk, c.grams, buckets, n, good))
    return run


def _summed(table):
    """Counts over all chunks for one bucket; `contexts`, the words it has, is told once."""
    parts = [packed.unkeyed(d) for d in table["data"].to_pylist()]
    u, of = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    n, good = (np.bincount(of, np.concatenate([p[i] for p in parts])).astype(np.int64)[of] for i in (1, 2))
    data = packed.answered(table, [len(p[0]) for p in parts], n, good)
    contexts = [int((u & np.uint64(1)).sum())] + [0] * (len(data) - 1)
    return pa.table({"chunk": table["chunk"], "bucket": table["bucket"], "contexts": pa.array(contexts, pa.int64()), "data": pa.array(data, pa.binary())})


def _scored(table, answers):
    if not table.num_rows:
        return SCORES.empty_table()
    v = float(max(1, pc.sum(answers.filter(pc.equal(answers["bucket"], WORDS))["contexts"]).as_py()))
    c, (n_all, good) = Chunk(table), packed.received(answers.filter(pc.not_equal(answers["bucket"], WORDS)), 2)
    odd = (c.grams & np.uint64(1)).astype(bool)
    size, t, b = (np.zeros(len(c.texts)) for _ in range(3))
    for lo, marked, doc, of in c:
        each, n = np.unique(doc * len(odd) + of, return_counts=True)
        doc, of = each // len(odd), each % len(odd)
        context = odd[of]
        base, sign, hi = np.where(context, A * v, A), np.where(context, n, -n), lo + len(marked)
        size[lo:hi] = np.bincount(doc, n * context, len(marked))
        t[lo:hi] = np.bincount(doc, sign * np.log(good[of].astype(np.int64) - n * marked[doc] + base), len(marked))
        b[lo:hi] = np.bincount(doc, sign * np.log(n_all[of].astype(np.int64) - n + base), len(marked))
    return pa.table([table["doc_id"], pa.array(size.astype(np.int64)), pa.array(t), pa.array(b)], schema=SCORES)


SCORES = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("t", pa.float64()), ("b", pa.float64())])


def marks(labels):
    m = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("q"), F.max("quality").alias("q2"))
    return m.where("q = 1 and q2 = 1").select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(True).alias("marked"))


def score(docs, labels, size=SIZE):
    """doc_id, n_tokens (the end mark too), target_loss, background_loss, difference: nats a token; the lower the difference, the nearer to the target."""
    spark = docs.sparkSession
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    d, chunks = packed.chunked(d, size)
    m = marks(labels)
    d = d.join(F.broadcast(m) if m.count() <= BROADCAST else m, "doc_id", "left").select("doc_id", "text", F.coalesce("marked", F.lit(False)).alias("marked"), "chunk").repartition(packed.parts(chunks), "chunk")
    sent = d.groupBy("chunk").applyInArrow(_counted(chunks), "chunk int, bucket int, data binary")
    answers = sent.groupBy("bucket").applyInArrow(_summed, "chunk int, bucket int, contexts long, data binary")
    words = answers.agg(F.sum("contexts").alias("contexts")).select(
        F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk"), F.lit(WORDS).alias("bucket"), F.coalesce("contexts", F.lit(0)).cast("long").alias("contexts"), F.lit(None).cast("binary").alias("data"))
    own = d.groupBy("chunk").cogroup(answers.unionByName(words).groupBy("chunk")).applyInArrow(_scored, "doc_id long, n_tokens long, t double, b double")
    s = own.groupBy("doc_id").agg(F.sum("n_tokens").alias("n_tokens"), F.sum("t").alias("t"), F.sum("b").alias("b"))
    return s.select("doc_id", "n_tokens", F.round(F.col("t") / F.col("n_tokens"), 6).alias("target_loss"), F.round(F.col("b") / F.col("n_tokens"), 6).alias("background_loss"),
                    F.round((F.col("t") - F.col("b")) / F.col("n_tokens"), 6).alias("difference"))


SQL = rf"""
WITH m AS (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id HAVING min(quality) = 1 AND max(quality) = 1),
d AS (SELECT doc_id, doc_id IN (SELECT doc_id FROM m) AS marked,
  list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
p AS (SELECT doc_id, marked, unnest(list_concat([' s'], ws)) AS v, unnest(list_concat(ws, [' e'])) AS w FROM d),
g AS (SELECT doc_id, marked, v, w, count(*) AS n FROM p GROUP BY ALL UNION ALL SELECT doc_id, marked, v, NULL, count(*) FROM p GROUP BY doc_id, marked, v),
c AS (SELECT v, w, sum(n)::DOUBLE AS a, coalesce(sum(n) FILTER (marked), 0)::DOUBLE AS t FROM g GROUP BY v, w),
k AS (SELECT greatest(1, count(DISTINCT v))::DOUBLE AS size FROM p),
x AS (SELECT g.doc_id, n, g.w IS NULL AS context, ln(c.t - CASE WHEN marked THEN n ELSE 0 END + b.base) AS lt, ln(c.a - n + b.base) AS la
  FROM g JOIN c ON g.v = c.v AND g.w IS NOT DISTINCT FROM c.w CROSS JOIN k, LATERAL (SELECT CASE WHEN g.w IS NULL THEN {A}::DOUBLE * k.size ELSE {A}::DOUBLE END AS base) b),
s AS (SELECT doc_id, sum(n) FILTER (context)::BIGINT AS n_tokens, sum(CASE WHEN context THEN n * lt ELSE -n * lt END) AS t, sum(CASE WHEN context THEN n * la ELSE -n * la END) AS b FROM x GROUP BY doc_id)
SELECT doc_id, n_tokens, round(t / n_tokens, 6) AS target_loss, round(b / n_tokens, 6) AS background_loss, round((t - b) / n_tokens, 6) AS difference FROM s"""
