"""Removal of long byte strings that an earlier document holds, by bucket-pointer refinement.

Suffixes are known by the smallest Q-gram of their first SPAN bytes; neighbours that share it
form a run. Texts are dealt into chunks, and three rounds go from the chunks to buckets and back:

1. Each chunk sends its Q-grams once; those of a single document are done with.
2. Runs of the other grams are sent as (gram, hash of their bytes): a run that a smaller
   doc_id holds goes as a whole, and of equal runs only the smallest doc_id's matters further.
3. Those of grams with unlike runs are sent as bytes, and refined: suffixes start in the
   bucket of their first 8 bytes, and a bucket is sorted on the bucket pointers 8, 16 and
   SPAN - 32 bytes on; its parts are numbered anew, and the new pointers serve the next,
   deeper sort. Suffixes that end in one bucket have the same SPAN bytes.

A gram of more than HOT unlike runs sends single suffixes, each once a chunk, by their hash,
so no bucket holds all of them. The chunks find the same runs again in every round, so answers
are flags alone. Two unlike runs count as one if gram and hash, 128 bits, agree; suffixes are
compared by their bytes.

Texts are UTF-8 bytes, null ones empty. Rows with a null doc_id are neither smaller nor
larger than others and lose nothing. Rows that repeat a doc_id are judged each on its own
text. Texts shorter than SPAN bytes lose nothing. Empty tables give no rows. Other columns
are ignored.
"""
import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

from revisio.llm import packed
from revisio.llm.packed import GOLDEN, mixed

SPAN, Q = 50, 24
#: Longer runs are cut into runs of LONGEST suffixes.
LONGEST = 64
#: More unlike runs of a gram are sent as single suffixes.
HOT = 4096
#: Buckets of the third round for each of the others, as a byte there takes most memory.
FINE = 16
ROWS = "chunk int, bucket int, step int, text binary, data binary"
LATER, SHIP, MANY = 1, 2, 4


class Chunk:
    """The texts of a chunk and their runs: row, gram, hash, first byte and number of suffixes."""

    def __init__(self, table):
        self.chunk = table["chunk"][0].as_py()
        self.ids = table["doc_id"]
        texts = [(t or "").encode() for t in table["text"].to_pylist()]
        self.size = np.fromiter(map(len, texts), np.int64, len(texts))
        self.begin = np.cumsum(self.size) - self.size
        self.data = np.frombuffer(b"".join(texts), np.uint8)
        known = np.array(self.ids.is_valid().to_pylist(), bool)
        number = np.array(self.ids.fill_null(0).to_pylist(), np.int64)
        parts = [self.runs(lo, hi, known) for lo, hi in packed.blocks(texts)]
        kinds = (np.int64, np.uint64, np.uint64, np.int64, np.int64)
        self.row, self.key, self.e, self.start, self.n = (np.concatenate([np.empty(0, k), *(p[i] for p in parts)]) for i, k in enumerate(kinds))
        self.id = number[self.row]
        self.grams, self.of = np.unique(self.key, return_inverse=True)

    def runs(self, lo, hi, known):
        at = self.begin[lo]
        data = self.data[at:self.begin[hi - 1] + self.size[hi - 1]]
        if len(data) < SPAN:
            return [np.empty(0, np.int64)] * 5
        row = np.repeat(np.arange(lo, hi), self.size[lo:hi])[:len(data) - SPAN + 1]
        s = packed.sums(data)
        i = np.flatnonzero(known[row] & (np.arange(at, at + len(row)) + SPAN <= (self.begin + self.size)[row]))
        if not len(i):
            return [np.empty(0, np.int64)] * 5
        low = mixed((s[Q:] - s[:-Q]) * packed.powers(len(s))[1][:len(s) - Q])
        for width in (1, 2, 4, 8):
            low = np.minimum(low[:-width], low[width:])
        n = len(data) - SPAN + 1
        key = np.minimum(low[:n], low[SPAN - Q - 15:][:n])[i]
        row = row[i]
        new = np.ones(len(i), bool)
        new[1:] = (row[1:] != row[:-1]) | (key[1:] != key[:-1])
        k = np.arange(len(i))
        first = np.flatnonzero((k - np.maximum.accumulate(np.where(new, k, 0))) % LONGEST == 0)
        n = np.diff(np.append(first, len(i)))
        e = mixed(packed.span(s, i[first], i[first] + n + SPAN - 1) + n.astype(np.uint64) * GOLDEN)
        return [row[first], key[first], e, i[first] + at, n]

    def entries(self, shared):
        """(runs, entry of each run or -1): one run, the smallest doc_id's, for each gram and hash; grams that are not shared have none."""
        at = np.flatnonzero(shared[self.of])
        order = at[np.lexsort((self.id[at], self.e[at], self.key[at]))]
        new = np.ones(len(order), bool)
        new[1:] = (self.key[order][1:] != self.key[order][:-1]) | (self.e[order][1:] != self.e[order][:-1])
        which = np.full(len(self.key), -1)
        which[order] = np.cumsum(new) - 1
        return order[new], which

    def suffixes(self, runs):
        """First bytes of all suffixes of some runs."""
        n = self.n[runs]
        return np.repeat(self.start[runs] - np.cumsum(n) + n, n) + np.arange(n.sum())

    def single(self, runs):
        """(places, doc_ids, class of each suffix) of all suffixes of some runs: equal ones are one class, of the smallest doc_id."""
        at = self.suffixes(runs)
        s = packed.sums(stretches(self.data, at, np.full(len(at), SPAN)))
        i = np.arange(len(at)) * SPAN
        h = mixed(packed.span(s, i, i + SPAN))
        ids = np.repeat(self.id[runs], self.n[runs])
        order = np.lexsort((ids, h))
        new = np.ones(len(order), bool)
        new[1:] = h[order][1:] != h[order][:-1]
        of = np.empty(len(order), np.int64)
        of[order] = np.cumsum(new) - 1
        return at[order[new]], ids[order[new]], of, h[order[new]]


def stretches(data, at, size):
    """Bytes of data from each place, one after another."""
    return data[np.repeat(at - np.cumsum(size) + size, size) + np.arange(size.sum())]


def table(chunk, buckets, step, data, text=None):
    n = len(data)
    return pa.table({"chunk": pa.array(chunk, pa.int32()), "bucket": pa.array(buckets, pa.int32()), "step": pa.array([step] * n, pa.int32()),
                     "text": pa.array([None] * n if text is None else text, pa.binary()), "data": pa.array(data, pa.binary())})


NONE = table([], [], 0, [])


def entered(chunk, h, n, step, *cols):
    chunk, bucket, data = packed.sent(chunk, h, n, *cols)
    return table(chunk, bucket, step, data)


def kept(chunk, step, flags):
    """A chunk's answers, which pass the buckets as they are."""
    return table([chunk], [-1 - chunk], step, [packed.pack(flags)])


def told(answers, step):
    t = answers.filter(pc.equal(answers["step"], step))
    return packed.received(t, 1)[0]


# --- chunks --------------------------------------------------------------------------------


def _grams(buckets):
    def run(t):
        c = Chunk(t)
        order = np.lexsort((c.id, c.of))
        first = np.flatnonzero(np.diff(c.of[order], prepend=-1))
        last = np.append(first[1:], len(order))[:len(first)] - 1
        several = c.id[order][first] < c.id[order][last]
        return entered(c.chunk, c.grams, buckets, 1, several)
    return run


def _runs(buckets):
    def run(t, answers):
        if not t.num_rows:
            return NONE
        c, shared = Chunk(t), told(answers, 1)
        first, _ = c.entries(shared > 0)
        return pa.concat_tables([entered(c.chunk, c.key[first], buckets, 2, c.e[first], c.id[first]), kept(c.chunk, 1, shared)])
    return run


def _pieces(buckets):
    buckets *= FINE

    def run(t, answers):
        if not t.num_rows:
            return NONE
        c, shared, flags = Chunk(t), told(answers, 1), told(answers, 2)
        first, _ = c.entries(shared > 0)
        some = first[flags & (SHIP | MANY) == SHIP]
        at, ids, _, h = c.single(first[flags & (SHIP | MANY) == SHIP | MANY])
        out = [kept(c.chunk, 1, shared), kept(c.chunk, 2, flags)]
        for base, hashes, start, n, doc in ((0, c.key[some], c.start[some], c.n[some], c.id[some]), (buckets, h, at, np.ones(len(at), np.int64), ids)):
            e = packed.edges(hashes, buckets)
            full = np.flatnonzero(np.diff(e)).tolist()
            text = [stretches(c.data, start[e[b]:e[b + 1]], n[e[b]:e[b + 1]] + SPAN - 1).tobytes() for b in full]
            out.append(table([c.chunk] * len(full), [base + b for b in full], 3, [packed.pack(n[e[b]:e[b + 1]], doc[e[b]:e[b + 1]]) for b in full], text))
        return pa.concat_tables(out)
    return run


def _digests(t, answers):
    if not t.num_rows:
        return DIGESTS.empty_table()
    c, shared, flags, gone = Chunk(t), told(answers, 1), told(answers, 2), told(answers, 3)
    first, which = c.entries(shared > 0)
    of = np.flatnonzero(which >= 0)
    entry = which[of]
    whole = (flags[entry] & LATER > 0) | (c.id[of] > c.id[first[entry]])
    lost = [c.suffixes(of[whole])]
    ship, many = flags & SHIP > 0, flags & MANY > 0
    some, single = np.flatnonzero(ship & ~many), np.flatnonzero(ship & many)
    at, ids, cls, _ = c.single(first[single])
    n = c.n[first[some]]
    own = np.repeat(c.id[first[single]], c.n[first[single]])
    each = np.concatenate([gone[:n.sum()] > 0, (gone[n.sum():][cls] > 0) | (own > ids[cls])])
    begin = np.zeros(len(first), np.int64)
    order = np.concatenate([some, single])
    size = c.n[first[order]]
    begin[order] = np.cumsum(size) - size
    part = of[~whole & ship[entry]]
    n = c.n[part]
    lost.append(c.suffixes(part)[each[np.repeat(begin[which[part]] - np.cumsum(n) + n, n) + np.arange(n.sum())]])
    step = np.zeros(len(c.data) + 1, np.int64)
    for x in lost:
        np.add.at(step, x, 1)
        np.add.at(step, x + SPAN, -1)
    off = np.cumsum(step)[:-1] > 0
    rows = [digest(c.data[b:b + s], off[b:b + s]) for b, s in zip(c.begin.tolist(), c.size.tolist())]
    cols = list(zip(*rows))
    return pa.table([c.ids.combine_chunks(), *(pa.array(v, k.type) for v, k in zip(cols, list(DIGESTS)[1:]))], schema=DIGESTS)


def digest(data, off):
    """(bytes, removed, spans, sha256 of the rest)."""
    spans = int(np.count_nonzero(off[1:] & ~off[:-1])) + int(off[:1].sum())
    rest = data[~off].tobytes()
    return len(data), len(data) - len(rest), spans, hashlib.sha256(rest).hexdigest()


DIGESTS = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])


# --- buckets -------------------------------------------------------------------------------


def _passed(work):
    """work on a bucket's rows; a chunk's own rows pass."""
    def run(t):
        if t["bucket"][0].as_py() < 0:
            return t
        step = t["step"][0].as_py()
        read = packed.unpack if step == 3 else packed.unkeyed
        return table(t["chunk"].to_pylist(), t["bucket"].to_pylist(), step, work(t, [read(d) for d in t["data"].to_pylist()]))
    return run


def shared(t, parts):
    """Whether a gram is in several chunks, or in several documents of one."""
    of, n = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True, return_counts=True)[1:]
    here = np.bincount(of, np.concatenate([p[1] for p in parts])) > 0
    return packed.answered(t, [len(p[0]) for p in parts], ((n > 1) | here)[of])


def judged(hot):
    """Flags of runs: LATER if a smaller doc_id has the same, SHIP if it is its kind's first and its gram has unlike runs, MANY if more than `hot`."""
    def work(t, parts):
        return packed.answered(t, [len(p[0]) for p in parts], flags(parts, hot))
    return work


def flags(parts, hot):
    key, e, ids = (np.concatenate([p[i].astype(k) for p in parts]) for i, k in enumerate((np.uint64, np.uint64, np.int64)))
    order = np.lexsort((ids, e, key))
    k, x, i = key[order], e[order], ids[order]
    other = np.ones(len(k), bool)
    other[1:] = k[1:] != k[:-1]
    new = other.copy()
    new[1:] |= x[1:] != x[:-1]
    later = i > i[np.flatnonzero(new)][np.cumsum(new) - 1]
    kinds = np.add.reduceat(new, np.flatnonzero(other), dtype=np.int64)[np.cumsum(other) - 1]
    out = np.empty(len(k), np.uint8)
    out[order] = later * LATER + (~later & (kinds > 1)) * SHIP + (kinds > hot) * MANY
    return out


def refined(t, parts):
    """Whether a smaller doc_id has the suffix, for every suffix of the stretches of bytes."""
    n, ids = (np.concatenate([p[i].astype(np.int64) for p in parts]) for i in (0, 1))
    data = np.frombuffer(b"".join(t["text"].to_pylist()), np.uint8)
    size = n + SPAN - 1
    at = np.repeat(np.cumsum(size) - size - np.cumsum(n) + n, n) + np.arange(n.sum())
    ids = np.repeat(ids, n)
    ptr = pointers(data, at)
    order = np.lexsort((ids, ptr))
    new = np.flatnonzero(np.diff(ptr[order], prepend=-1))
    gone = np.empty(len(at), bool)
    gone[order] = ids[order] > np.repeat(ids[order][new], np.diff(np.append(new, len(order))))
    return packed.answered(t, [int(p[0].sum()) for p in parts], gone)


def pointers(data, at):
    """Bucket pointers of the SPAN bytes from the places `at`: equal for equal bytes. A pointer is where its bucket begins in the sorted order, so parts of a bucket get numbers of their own."""
    n = len(data)
    word, far = np.zeros(n, np.uint64), np.concatenate([data, np.zeros(8, np.uint8)])
    for i in range(8):
        word = word << np.uint64(8) | far[i:i + n]
    ptr = np.zeros(n + SPAN, np.int64)
    order = np.argsort(word)
    new = np.ones(n, bool)
    new[1:] = word[order][1:] != word[order][:-1]
    head = np.flatnonzero(new)
    ptr[order] = head[np.cumsum(new) - 1]
    live = order[np.repeat(np.diff(np.append(head, n)) > 1, np.diff(np.append(head, n)))]
    for offset in (8, 16, SPAN - 32):
        both = ptr[live] << 32 | ptr[live + offset]
        order = np.argsort(both)
        both, live = both[order], live[order]
        old = both >> 32
        new, start = np.ones(len(live), bool), np.ones(len(live), bool)
        new[1:], start[1:] = both[1:] != both[:-1], old[1:] != old[:-1]
        head, first = np.flatnonzero(new), np.flatnonzero(start)
        i = head[np.cumsum(new) - 1]
        ptr[live] = old + i - first[np.cumsum(start) - 1] if len(live) else old
        size = np.diff(np.append(head, len(live)))
        live = live[np.repeat(size > 1, size)]
    return ptr[at]


# -------------------------------------------------------------------------------------------


def removed(docs, size=packed.CHUNK, hot=HOT):
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of each row. One exchange of the texts serves all rounds."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    d, n = packed.chunked(d, size)
    d = d.repartition(packed.parts(n), "chunk")
    sent = d.groupBy("chunk").applyInArrow(_grams(n), ROWS)
    for work, answer in ((_runs(n), shared), (_pieces(n), judged(hot))):
        answers = sent.groupBy("bucket").applyInArrow(_passed(answer), ROWS)
        sent = d.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(work, ROWS)
    answers = sent.groupBy("bucket").applyInArrow(_passed(refined), ROWS)
    return d.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(_digests, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
