"""Periodic runs of words, found by harmonic grid probing.

A run of period p and at least 4p words covers four points in a row of the grid 0, p, 2p, ...
Words at jp and (j+1)p are compared over all grids, n/p points for each p and so n log n for a
text; where three neighbouring pairs agree, the stretch is extended by comparing arrays p apart
in growing pieces. Points that a found run covers are skipped where its period divides p: the
stretch is that run again.

The text is read by itself, so nothing is shuffled. Words are maximal strings without ASCII
white space; null and empty texts have none, hence no run, null run columns and the digest of
the empty string. The word order of every tenth document is made periodic from a place that
its id gives (planted); a null doc_id leaves the words as they are. Rows that repeat are
judged one by one; an empty table gives no rows; other columns are ignored.
"""
import hashlib
import zlib

import numpy as np
import pyarrow as pa

#: Runs have so many words and so many periods at least.
WORDS, TIMES = 6, 4
#: Grid points compared at once, and words compared at once in the first step of an extension.
GRID, STEP = 1 << 20, 32


def planted(doc_id, n):
    """Which original word stands at each place."""
    i = np.arange(n)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if n and h % 10 == 0:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        i[a:] = a + (i[a:] - a) % p
    return i


def survivors(x, low, high):
    """(period, point) where four grid points in a row hold one word, for periods from low to below high; periods ascend."""
    p = np.arange(low, high)
    n = (len(x) - 1) // p - (TIMES - 2)
    p, j = np.repeat(p, n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    at = j * p
    for k in range(TIMES - 1):
        same = x[at + k * p] == x[at + (k + 1) * p]
        p, at = p[same], at[same]
    return p, at


def reach(same, size):
    """How many of `size` comparisons hold from the first on; same(a, b) compares the a-th to below the b-th."""
    done, step = 0, STEP
    while done < size:
        s = same(done, min(size, done + step))
        if not s.all():
            return done + int(np.argmin(s))
        done, step = done + len(s), step * 2
    return size


def runs(x):
    """(start, length, period) of all runs of a word array, by start and period."""
    n, found = len(x), {}
    low = 1
    while low <= n // TIMES:
        high, points = low, 0
        while high <= n // TIMES and (high == low or points + n // high <= GRID):
            points += n // high
            high += 1
        ps, ats = survivors(x, low, high)
        edges = np.flatnonzero(np.diff(ps, prepend=0)).tolist() + [len(ps)]
        for a, b in zip(edges[:-1], edges[1:]):
            p, at = int(ps[a]), ats[a:b]
            for (s, e), q in list(found.items()):
                if p % q == 0:
                    at = at[(at < s) | (at + (TIMES - 1) * p >= e)]
            while len(at):
                i = int(at[0])
                s = i - reach(lambda u, v: (x[i - v:i - u] == x[i - v + p:i - u + p])[::-1], i)
                e = i + reach(lambda u, v: x[i + u:i + v] == x[i + u + p:i + v + p], n - p - i) + p
                if e - s >= max(WORDS, TIMES * p):
                    found.setdefault((s, e), p)
                at = at[at + p >= e]
        low = high
    return sorted((s, e - s, p) for (s, e), p in found.items())


def digest(text):
    return hashlib.sha256(text).hexdigest()


def row(doc_id, text):
    words = (text or "").encode().split()
    number = {w: i for i, w in enumerate(dict.fromkeys(words))}
    order = planted(doc_id, len(words))
    x = np.fromiter(map(number.__getitem__, words), np.int64, len(words))[order]
    found = runs(x)
    best = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else (None,) * 3
    left = np.ones(len(words), bool)
    for s, n, p in found:
        left[s + p:s + n] = False
    listed = "".join(f"{s},{n},{p}\n" for s, n, p in found)
    milli = 1000 * best[1] // best[2] if found else None
    return doc_id, len(found), *best, milli, digest(listed.encode()), digest(b" ".join([words[i] for i in order[left].tolist()]))


SCHEMA = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
_ARROW = pa.schema([(n, pa.string() if k == "string" else pa.int64()) for n, k in (c.split() for c in SCHEMA.split(", "))])


def _rows(batches):
    for b in batches:
        cols = list(zip(*map(row, b.column(0).to_pylist(), b.column(1).to_pylist()))) or [[]] * len(_ARROW)
        yield pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(cols, _ARROW)], schema=_ARROW)


def periodic(docs):
    """One row a document: its runs, the longest of them, and digests of all runs and of the words that no run repeats."""
    return docs.selectExpr("CAST(doc_id AS LONG) AS doc_id", "text").mapInArrow(_rows, SCHEMA)


_CRC = """list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({0}, ''), lambda c: ascii(c)::BIGINT)),
  lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END)))"""
SQL = rf"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS t, xor({_CRC.format("CAST(doc_id AS VARCHAR)")}, 4294967295) AS h FROM documents),
e AS (SELECT r, doc_id, t, len(t) AS n, CASE WHEN len(t) > 0 AND h % 10 = 0 THEN h // 10 END AS g FROM d),
f AS (SELECT *, g % n AS a, 1 + (n - g % n) // (3 + g % 8) AS p FROM e),
w AS (SELECT r, n, i, CASE WHEN i >= a THEN t[1 + a + (i - a) % p] ELSE t[1 + i] END AS word FROM (SELECT *, unnest(range(n)) AS i FROM f)),
same AS (SELECT a.r, a.i, b.i - a.i AS p FROM w a JOIN w b ON a.r = b.r AND a.word = b.word AND b.i > a.i AND (b.i - a.i) * 4 <= a.n),
isl AS (SELECT r, p, i, i - row_number() OVER (PARTITION BY r, p ORDER BY i) AS k FROM same),
str AS (SELECT r, p, min(i) AS s, count(*) + p AS n FROM isl GROUP BY r, p, k HAVING count(*) + p >= greatest(6, 4 * p)),
run AS (SELECT r, s, n, min(p) AS p FROM str GROUP BY r, s, n),
agg AS (SELECT r, count(*) AS n_runs, string_agg(s || ',' || n || ',' || p || chr(10), '' ORDER BY s, p) AS listed, min((-n, s, p)) AS top FROM run GROUP BY r),
lost AS (SELECT DISTINCT r, unnest(range(s + p, s + n)) AS i FROM run),
kept AS (SELECT r, string_agg(word, ' ' ORDER BY i) AS words FROM w ANTI JOIN lost USING (r, i) GROUP BY r)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, top[2] AS start, -top[1] AS length, top[3] AS period, 1000 * -top[1] // top[3] AS exponent_milli, sha256(coalesce(listed, '')) AS runs_sha256, sha256(coalesce(words, '')) AS collapsed_sha256
FROM d LEFT JOIN agg USING (r) LEFT JOIN kept USING (r)"""
