"""Benchmark decontamination by spaced-seed hashing.

Fixed masks over consecutive tokens hash only the positions marked 1, so that a hit survives
substitutions at the others. Seed hashes of the documents are joined with the benchmark's, and
each (item, alignment) that was hit is compared token by token: it counts if some SPAN tokens in
a row (all of a shorter item's) agree in at least LEAST of their places. Any two
substitutions in SPAN tokens leave one of the masks whole. Items shorter than SPAN are hashed
by runs so short that the substitutions they may have leave one whole.

Tokens are runs of letters, digits and underscores in lower case, compared by 64-bit hashes.
One pass over the documents, whatever the benchmark's size: it meets a bit filter of the
benchmark's hashes (PER bits a hash, 2^BITS bits at most, sent to executors), and only
documents with a hash in it are written with their hits. A full filter lets more pass and loses
none. Hits join the benchmark's hashes, and alignments their items, by key; keys with more than
`hot` rows, and a share of all rows, are dealt over SALTS tasks. Nothing of the
documents comes to the driver.

Null or empty texts match nothing; null ids are kept as null. Repeated rows give
repeated results. Empty tables give no rows. Other columns are ignored.
"""
import hashlib
import math
import re
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import functions as F

from revisio.shared import written

MASKS = ("11101011", "11001111")
SPAN, LEAST = 13, 0.8
TOKEN = re.compile(r"\w+")
#: Bits of the filter for each seed hash and, as a power of two, in all (32 MB), in rows of 4 KB.
PER, BITS, BLOCK = 256, 28, 15
#: Rows of a key from which on it may be hot, the share of all rows it must exceed, tasks it is dealt to.
HOT, SHARE, SALTS = 100_000, 4096, 64
#: Digests of overlapping texts that are broadcast, at most (32 MB); more are joined by key.
DIGESTS = 1 << 20
#: Words whose hashes a task remembers, and tokens in a batch it gives back, about.
WORDS, BATCH = 1 << 20, 1 << 20
HITS = "row long, doc_id long, digest binary, toks array<long>, h array<long>, p array<int>"
OVERLAP = "row long, doc_id long, digest binary, ik long, item_id long, matched int, n_tokens int, at int"
U = np.uint64


def holes(masks, span=SPAN, subs=2):
    """Placements of substitutions in a span that no mask survives."""
    seeds = [{s + i for i, c in enumerate(m) if c == "1"} for m in masks for s in range(span - len(m) + 1)]
    return [gone for gone in combinations(range(span), subs) if not any(s.isdisjoint(gone) for s in seeds)]


def masks_of(n):
    """Masks for an item of n tokens."""
    return MASKS if n >= SPAN else ("1" * (n // (n - math.ceil(LEAST * n) + 1)),)


class Words(dict):
    """Hashes of words; the first ones are remembered."""

    def __missing__(self, word):
        h = xxhash.xxh3_64_intdigest(word)
        if len(self) < WORDS:
            self[word] = h
        return h

    def of(self, text):
        found = TOKEN.findall(text.lower())
        return np.fromiter(map(self.__getitem__, found), U, len(found))


def hashes(x, mask):
    """The seed hash at each place of x where the mask fits."""
    n = max(0, len(x) - len(mask) + 1)
    h = np.full(n, int(mask, 2), U)
    for i, c in enumerate(mask):
        if c == "1":
            h = (h + x[i:i + n]) * U(0x9E3779B97F4A7C15)
            h ^= h >> U(29)
    return h


def lists(parts, kind):
    """Arrays of numbers as one Arrow column of lists."""
    flat = np.concatenate(parts) if parts else np.zeros(0, kind.to_pandas_dtype())
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, parts)]), pa.int32()), pa.array(flat, kind))


# --- the benchmark -------------------------------------------------------------------------


def _items(batches):
    words = Words()
    for b in batches:
        rows = [(k, i, words.of(t)) for k, i, t in zip(*(b[c].to_pylist() for c in ("ik", "item_id", "text")))]
        rows = [r for r in rows if len(r[2])]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), lists([r[2].view(np.int64) for r in rows], pa.int64())], names=["ik", "item_id", "item"])


def _seeds(batches):
    for b in batches:
        for k, x in zip(b["ik"].to_pylist(), b["item"]):
            x = x.values.to_numpy().view(U)
            for m in masks_of(len(x)):
                h = hashes(x, m)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array([m] * len(h), pa.string()), pa.array(np.full(len(h), k)), pa.array(np.arange(len(h), dtype=np.int32)), pa.array(np.full(len(h), len(x), np.int32))], names=["h", "mask", "ik", "off", "n"])


def filtered(seeds, count):
    """Bit filter of the seed hashes, two places each, and its size as a power of two."""
    top = min(BITS, max(BLOCK, (PER * count).bit_length()))
    places = F.array(F.col("h"), F.shiftrightunsigned("h", BITS))
    p = seeds.select(F.explode(places).alias("p")).select(F.col("p").bitwiseAND((1 << top) - 1).alias("p"))
    bits = np.zeros((1 << (top - BLOCK), 1 << (BLOCK - 3)), np.uint8)
    for r in p.groupBy(F.shiftright("p", BLOCK).alias("block")).agg(F.bitmap_construct_agg(F.col("p").bitwiseAND((1 << BLOCK) - 1)).alias("bits")).collect():
        bits[r.block] = np.frombuffer(r.bits, np.uint8)
    return bits.reshape(-1), top


# --- the documents -------------------------------------------------------------------------


def _hits(masks, sent, top):
    def places(bits, h):
        at = np.arange(len(h))
        for shift in (0, BITS):
            p = h[at] >> U(shift) & U((1 << top) - 1)
            at = at[bits[p >> U(3)] >> (p & U(7)).astype(np.uint8) & 1 > 0]
        return at

    def batch(rows):
        row, doc_id, digest, x, h, p = zip(*rows)
        return pa.RecordBatch.from_arrays([pa.array(row, pa.int64()), pa.array(doc_id, pa.int64()), pa.array(digest, pa.binary()), lists(x, pa.int64()), lists(h, pa.int64()), lists(p, pa.int32())], names=["row", "doc_id", "digest", "toks", "h", "p"])

    def run(batches):
        words, bits = Words(), sent.value
        for b in batches:
            rows, size = [], 0
            for row, doc_id, text in zip(b["row"].to_pylist(), b["doc_id"].to_pylist(), b["text"]):
                text = text.as_py()
                x = words.of(text)
                seeds = [hashes(x, m) for m in masks]
                at = [places(bits, h) for h in seeds]
                if sum(map(len, at)):
                    rows.append((row, doc_id, hashlib.sha256(text.encode()).digest(), x.view(np.int64), np.concatenate([h[a] for h, a in zip(seeds, at)]).view(np.int64), np.concatenate(at).astype(np.int32)))
                    size += len(x)
                if size >= BATCH:
                    yield batch(rows)
                    rows, size = [], 0
            if rows:
                yield batch(rows)
    return run


def dealt(many, few, key, hot):
    """The join of a written table with one that has few rows a key; hot keys, fewer than SHARE, are dealt over tasks."""
    limit = max(hot, many.count() // SHARE)
    heavy = F.broadcast(written(many.groupBy(key).agg(F.count("*").alias("rows")).where(F.col("rows") > limit).select(key, F.lit(True).alias("heavy"))))
    m = many.join(heavy, key, "left").withColumn("salt", F.when(F.col("heavy"), F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int")).otherwise(F.lit(0))).drop("heavy")
    f = few.join(heavy, key, "left").withColumn("salt", F.explode(F.when(F.col("heavy"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0))))).drop("heavy")
    return m.join(f, [key, "salt"]).drop("salt")


def _verify(batches):
    for b in batches:
        keys = zip(*(b[c].to_pylist() for c in ("row", "doc_id", "digest", "ik", "item_id", "n", "start", "lo")))
        rows = []
        for (row, doc_id, digest, ik, item_id, n, start, lo), w, x in zip(keys, b["window"], b["item"]):
            w = w.values.to_numpy()
            c = np.concatenate([[0], np.cumsum(w == x.values.to_numpy()[lo:lo + len(w)])])
            span = min(SPAN, n)
            if (c[span:] - c[:-span]).max() >= LEAST * span:
                rows.append((row, doc_id, digest, ik, item_id, int(c[-1]), n, start))
        types = (pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*rows) if rows else [[]] * 8, types)], names=["row", "doc_id", "digest", "ik", "item_id", "matched", "n_tokens", "at"])


def verified(docs, benchmark, hot=HOT):
    """Every verified alignment of a row of doc_id, text and an item."""
    b = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text is not null").withColumn("ik", F.monotonically_increasing_id())
    items = written(b.mapInArrow(_items, "ik long, item_id long, item array<long>"))
    seeds = written(items.mapInArrow(_seeds, "h long, mask string, ik long, off int, n int"))
    masks = sorted(r.mask for r in seeds.select("mask").distinct().collect())
    bits, top = filtered(seeds, seeds.count())
    sent = docs.sparkSession.sparkContext.broadcast(bits)
    d = docs.where("text is not null").withColumn("row", F.monotonically_increasing_id())
    hits = written(d.mapInArrow(_hits(masks, sent, top), HITS))
    sent.unpersist()
    h = written(hits.select("row", F.explode(F.arrays_zip("h", "p")).alias("z")).select("row", "z.h", "z.p"))
    found = written(dealt(h, seeds.drop("mask"), "h", hot).select("row", "ik", "n", (F.col("p") - F.col("off")).alias("start")).distinct())
    lo = F.greatest(F.lit(0), -F.col("start"))
    size = F.least(F.col("n") - lo, F.size("toks") - F.col("start") - lo)
    w = found.join(hits.select("row", "doc_id", "digest", "toks"), "row").where(size >= F.least(F.lit(SPAN), F.col("n")))
    w = written(w.select("row", "doc_id", "digest", "ik", "n", "start", lo.alias("lo"), F.slice("toks", F.col("start") + lo + 1, size).alias("window")))
    return dealt(w, items, "ik", hot).mapInArrow(_verify, OVERLAP)


def overlaps(docs, benchmark, hot=HOT):
    """One row per document and benchmark item whose overlap was verified: its alignment of most agreeing tokens, the first of several."""
    v = verified(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), benchmark, hot)
    best = v.groupBy("row", "ik", "doc_id", "item_id", "n_tokens").agg(F.max(F.struct("matched", (-F.col("at")).alias("at"))).alias("best"))
    return best.select("doc_id", "item_id", F.col("best.matched").alias("matched"), "n_tokens", (-F.col("best.at")).alias("at"))


def clean(docs, benchmark, hot=HOT):
    """The rows of docs whose text has no overlap, whatever their ids; all columns stay. Texts that have one are known by SHA-256."""
    v = verified(docs.select(F.lit(None).cast("long").alias("doc_id"), "text"), benchmark, hot)
    leaked = written(v.select("digest").distinct())
    leaked = F.broadcast(leaked) if leaked.count() <= DIGESTS else leaked
    return docs.join(leaked, F.unhex(F.sha2(docs["text"], 256)) == leaked["digest"], "left_anti")
