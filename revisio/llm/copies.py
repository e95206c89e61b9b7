"""Exact copies, by counting quotient filters.

Each partition of the texts builds counting quotient filters of their 64-bit fingerprints: the
top bits name a bucket, the next ones are the quotient, the rest is a remainder that stands in
its quotient's run, in order, with a counter where it is there several times. The filters of a
bucket merge losslessly by their sorted remainders. Fingerprints with a count above one go on
to the comparison of bytes: texts that may have one are grouped by the text itself, which
partitions pre-aggregate, so copies are not shuffled one by one. May: the occupied quotients of
the merged filter, BITS bits at most, are broadcast; past that size more texts pass, none is
lost, and at worst every text is shuffled once.

A row's copies are known by fingerprint and SHA-256 after that. Classes of more than a share
HOT of all rows, fewer than 1 / HOT, are joined by broadcast and the others by their key.

A null text is empty. A null doc_id is smaller than any; a class of null ids has keep_id null.
Exactly one row of a class stays, also where rows repeat their doc_id. An empty table gives no
rows. Other columns are ignored.
"""
import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from revisio.shared import written

#: Fingerprints in a bucket, about, and in a filter before it is cut into buckets, at most.
BUCKET, FILTER = 1 << 18, 1 << 22
#: Bits of the quotients that are broadcast, at most: 8 MB, in rows of 4 KB.
BITS, BLOCK = 26, 15
HOT = 1e-3
U = np.uint64


# --- the filter ----------------------------------------------------------------------------


def encoded(h, n, top):
    """A filter of ascending fingerprints that share their `top` first bits, and how often each is there."""
    q = max(1, len(h).bit_length() - 1)
    r = 64 - top - q
    own = h & U(2 ** (64 - top) - 1)
    quotient, remainder = (own >> U(r)).astype(np.int64), own & U(2 ** r - 1)
    occupied, ends = np.zeros(1 << q, bool), np.ones(len(h), bool)
    occupied[quotient] = True
    ends[:-1] = quotient[1:] != quotient[:-1]
    many = n > 1
    slots = np.ascontiguousarray(remainder).view(np.uint8).reshape(-1, 8)[:, :-(-r // 8)]
    head = np.array([len(h), top, q, int(h[0] >> U(64 - top)) if top else 0], np.int64)
    return b"".join([head.tobytes(), *(np.packbits(b).tobytes() for b in (occupied, ends, many)), slots.tobytes(), n[many].astype(np.int64).tobytes()])


def decoded(data):
    """The fingerprints of a filter, ascending, and their counts."""
    size, top, q, prefix = np.frombuffer(data, np.int64, 4).tolist()
    r, at, bits = 64 - top - q, 32, []
    for length in (1 << q, size, size):
        bits.append(np.unpackbits(np.frombuffer(data, np.uint8, -(-length // 8), at), count=length).astype(bool))
        at += -(-length // 8)
    occupied, ends, many = bits
    slots = np.zeros((size, 8), np.uint8)
    width = -(-r // 8)
    slots[:, :width] = np.frombuffer(data, np.uint8, size * width, at).reshape(size, width)
    quotient = np.flatnonzero(occupied)[np.cumsum(ends) - ends].astype(U)
    h = quotient << U(r) | slots.view(U)[:, 0]
    n = np.ones(size, np.int64)
    n[many] = np.frombuffer(data, np.int64, int(many.sum()), at + size * width)
    return (h | U(prefix) << U(64 - top) if top else h), n


def merged(filters):
    """The fingerprints of several filters, ascending, and their counts added up."""
    h, n = (np.concatenate(x) for x in zip(*map(decoded, filters)))
    order = np.argsort(h, kind="stable")
    h, n = h[order], n[order]
    first = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
    return h[first], np.add.reduceat(n, first)


def _built(top, most):
    def cut(parts):
        h, n = np.unique(np.concatenate(parts), return_counts=True)
        bucket = (h >> U(64 - top)).astype(np.int64) if top else np.zeros(len(h), np.int64)
        at = np.append(np.flatnonzero(np.diff(bucket, prepend=-1)), len(h)).tolist()
        rows = [encoded(h[a:b], n[a:b], top) for a, b in zip(at[:-1], at[1:])]
        return pa.RecordBatch.from_pydict({"bucket": pa.array(bucket[at[:-1]], pa.int64()), "filter": pa.array(rows, pa.binary())})

    def run(batches):
        parts, size = [], 0
        for b in batches:
            parts.append(b.column(0).to_numpy(zero_copy_only=False).view(U))
            size += len(parts[-1])
            if size >= most:
                yield cut(parts)
                parts, size = [], 0
        if size:
            yield cut(parts)
    return run


def _several(t):
    h, n = merged(t["filter"].to_pylist())
    return pa.table({"fp": pa.array(h[n > 1].view(np.int64)), "n": pa.array(n[n > 1])})


# --- the documents -------------------------------------------------------------------------


def counted(docs, rows):
    """fp, n of the fingerprints that more than one row has."""
    top = max(0, (int(rows) // BUCKET).bit_length())
    return docs.select("fp").mapInArrow(_built(top, FILTER), "bucket long, filter binary").groupBy("bucket").applyInArrow(_several, "fp long, n long")


def maybe(docs, several, b):
    """docs with __maybe: whether the first b bits of fp are those of one in `several`."""
    quotient = F.shiftrightunsigned("fp", 64 - b)
    bits = several.select(quotient.alias("q")).groupBy(F.shiftright("q", BLOCK).alias("__block")).agg(F.bitmap_construct_agg(F.col("q").bitwiseAND((1 << BLOCK) - 1)).alias("__bits"))
    place = quotient.bitwiseAND((1 << BLOCK) - 1)
    byte = F.conv(F.hex(F.substring("__bits", (place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.coalesce(F.getbit(byte, (place % 8).cast("int")) == 1, F.lit(False))
    return docs.withColumn("__block", F.shiftright(quotient, BLOCK)).join(F.broadcast(bits), "__block", "left").withColumn("__maybe", hit).drop("__block", "__bits")


def by_class(rows, classes, total):
    """rows joined to their classes by fp and sha: the few of many rows by broadcast."""
    key, limit = ["fp", "sha"], total * HOT
    hot = classes.where(F.col("group_size") > limit)
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti")
    return rows.join(F.broadcast(hot), key).unionByName(rest.join(classes.where(F.col("group_size") <= limit), key, "left"), allowMissingColumns=True)


def groups(docs):
    """doc_id, keep_id, group_size, kept, text_sha256 of every row."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    d = d.withColumn("fp", F.xxhash64("text"))
    total = d.count()
    several = written(counted(d, total))
    b = min(BITS, max(BLOCK, (32 * several.count()).bit_length()))
    d = maybe(d, several, b)
    light = written(d.select("doc_id", "fp", F.unhex(F.sha2("text", 256)).alias("sha"), "__maybe").withColumn("__row", F.monotonically_increasing_id()))
    equal = d.where("__maybe").groupBy("fp", "text").agg(F.count("*").alias("group_size")).where("group_size > 1").select("fp", F.unhex(F.sha2("text", 256)).alias("sha"), "group_size")
    some = light.where("__maybe")
    top = some.groupBy("fp", "sha").agg(F.max(F.struct("doc_id", "__row")).alias("top"))
    classes = written(equal.join(top, ["fp", "sha"]).select("fp", "sha", "group_size", F.col("top.doc_id").alias("keep_id"), F.col("top.__row").alias("keep_row")))
    alone = light.where("NOT __maybe").withColumns({"keep_id": F.col("doc_id"), "group_size": F.lit(1).cast("long"), "keep_row": F.col("__row")})
    out = by_class(some, classes, total).unionByName(alone)
    one = F.col("group_size").isNull()
    return out.select("doc_id", F.when(one, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
                      (one | (F.col("__row") == F.col("keep_row"))).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


SQL = """SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) = 1 AS kept,
sha256(coalesce(text, '')) AS text_sha256 FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))"""
