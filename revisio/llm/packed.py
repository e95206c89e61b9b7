"""Texts dealt into chunks of bounded size, and sorted entries packed by bucket.

A chunk's entries go to buckets by range of their 64-bit hash, so a sorted array of them falls
into one packed row a bucket. A bucket answers with one row a chunk, its values in the order
of the entries it got: the chunk, which finds the same entries again in the same order, needs
no keys back. Chunks and buckets grow in number with the texts, not in size.
"""
import math

import numpy as np
from pyspark.sql import functions as F

#: Bytes of text in a chunk, about.
CHUNK = 6 << 20
#: Up to so many chunks have a partition each; beyond, a partition has PER of them at most, so it stays as large at any size.
PARTS, PER = 8192, 64
#: Bytes hashed at once.
BLOCK = 1 << 18
GOLDEN, MIX1, MIX2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
BASE = 0xD6E8FEB86659FD93


def mixed(x):
    x = (x ^ (x >> np.uint64(30))) * MIX1
    x = (x ^ (x >> np.uint64(27))) * MIX2
    return x ^ (x >> np.uint64(31))


TABLE = mixed(np.arange(1, 257, dtype=np.uint64) * GOLDEN)
_powers = []


def powers(n):
    """BASE and its inverse to the powers 0 to n, at least, modulo 2**64."""
    if not _powers or len(_powers[0]) <= n:
        n = max(n, BLOCK) + 1
        _powers[:] = [np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, b % 2**64, np.uint64)])) for b in (BASE, pow(BASE, -1, 2**64))]
    return _powers


def sums(data):
    """Sums over the prefixes of a byte array, from which span() has the hash of any stretch."""
    s = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(TABLE[data] * powers(len(data))[0][:len(data)], out=s[1:])
    return s


def span(s, start, end):
    """Polynomial hashes of the stretches from start to end."""
    return (s[end] - s[start]) * powers(len(s))[1][start]


def chunked(docs, size=CHUNK):
    """(docs with a chunk number, chunks): rows go by a hash of doc_id and text; the text column is read once for its size."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, math.ceil(total / size))
    return docs.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)).cast("int")), n


def parts(n):
    """Partitions for n chunks."""
    return min(n, max(PARTS, -(-n // PER)))


def pack(*cols):
    """Arrays of one length, each in as few bytes a value as its largest needs."""
    out = [np.array([len(cols[0])], np.uint32).tobytes()]
    for c in cols:
        kind = "q" if len(c) and c.min() < 0 else next(k for k, n in (("B", 1), ("H", 2), ("I", 4), ("6", 6), ("Q", 8)) if not len(c) or int(c.max()) < 256**n)
        data = np.ascontiguousarray(c).astype("Q" if kind == "6" else kind)
        out += [kind.encode(), (data.view(np.uint8).reshape(-1, 8)[:, :6] if kind == "6" else data).tobytes()]
    return b"".join(out)


def unpack(data):
    n, at, out = int(np.frombuffer(data, np.uint32, 1)[0]), 4, []
    while at < len(data):
        kind = chr(data[at])
        width = 6 if kind == "6" else np.dtype(kind).itemsize
        if kind == "6":
            x = np.zeros((n, 8), np.uint8)
            x[:, :6] = np.frombuffer(data, np.uint8, 6 * n, at + 1).reshape(n, 6)
            out.append(x.view(np.uint64)[:, 0])
        else:
            out.append(np.frombuffer(data, kind, n, at + 1))
        at += 1 + n * width
    return out


def keyed(h, *cols):
    """pack() of ascending hashes, at least one, as differences, and columns beside them."""
    return h[:1].tobytes() + pack(np.diff(h, prepend=h[0]), *cols)


def unkeyed(data):
    d, *cols = unpack(data[8:])
    return [np.cumsum(d, dtype=np.uint64) + np.frombuffer(data, np.uint64, 1), *cols]


def edges(h, n):
    """Where each of n buckets begins in sorted hashes, and the end."""
    at = [-(-(b << 64) // n) for b in range(1, n)]
    return np.concatenate([[0], np.searchsorted(h, np.array(at, np.uint64)), [len(h)]])


def sent(chunk, h, n, *cols):
    """A chunk's sorted hashes and the columns beside them: chunk, bucket and data lists, one row for each bucket that gets some."""
    e = edges(h, n)
    full = np.flatnonzero(np.diff(e)).tolist()
    return [chunk] * len(full), full, [keyed(h[e[b]:e[b + 1]], *(c[e[b]:e[b + 1]] for c in cols)) for b in full]


def received(table, width):
    """The columns of a chunk's answers, buckets in order."""
    t = table.sort_by("bucket")
    parts = [unpack(d) for d in t["data"].to_pylist()]
    return [np.concatenate([p[i] for p in parts]) if parts else np.empty(0, np.uint8) for i in range(width)]


def answered(table, lengths, *cols):
    """A bucket's answers: cols parted as its rows' entries were."""
    at = np.concatenate([[0], np.cumsum(lengths)])
    return [pack(*(c[a:b] for c in cols)) for a, b in zip(at[:-1], at[1:])]


def blocks(texts, size=BLOCK):
    """(first, end) ranges of texts of about `size` bytes."""
    start = 0
    while start < len(texts):
        end, n = start, 0
        while end < len(texts) and (end == start or n + len(texts[end]) <= size):
            n += len(texts[end])
            end += 1
        yield start, end
        start = end
