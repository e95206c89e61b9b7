"""Prefix trie of conversations, by partition refinement.

All conversations start in one class. A round splits the classes by the next turn; a class is
known by its smallest conversation. Conversations with all turns alike are one, with a weight,
so a class is done with as soon as its members are alike to the end: it is retired, and the
rest of its turns come out as a chain of nodes with one child each. The rounds end with the
deepest turn that unlike conversations share. Folding back goes up the rounds again: leaves and
saved tokens are added up in the parents.

Turns stay rows of their own, so no conversation is held in one row or task: they are numbered
by a prefix scan over range partitions. Texts are read once and give way to 16 bytes of
SHA-256; two turns are one where these agree, and two conversations where the number of turns
and two 64-bit sums of places and turns do. Rows of hot classes (a share HOT of all, so fewer
than 1 / HOT) meet their class by broadcast, the others by its key.

Null roles and texts are empty. Turns are ordered by number, nulls first, and where numbers
repeat by digest; rows that repeat are turns of their own. Rows with a null conv_id take no
part. An empty table gives no rows. Other columns are ignored.
"""
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from revisio.llm.copies import HOT
from revisio.llm.mixing import WORD
from revisio.llm.periods import _CRC
from revisio.scan import numbered
from revisio.shared import written

#: The head of a conversation may come from the first of its SHARE, so many turns less one at most.
SHARE, HEADS = 20, 4
#: Levels folded back in one plan.
LEVELS = 6
#: Characters of ids that a row of the second step holds, about.
TEXT = 1 << 16
EMPTY = hashlib.sha256(b"").hexdigest()


def heads(c):
    return F.crc32(F.col(c).cast("string")) % HEADS


def turns(conversations):
    """conv_id, nth, digest, words, upto: turns in order; upto counts the words so far."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    d = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.unhex(F.substring(F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text), 256), 1, 32)).alias("digest"),
                                                           F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"))
    return written(numbered(d, ["conv_id"], [F.col("turn").asc_nulls_first(), "digest"], upto="words").drop("turn"))


def met(rows, groups, key, size, total):
    """rows joined to their groups: those of more than a share HOT of `total` in `size` by broadcast."""
    limit = total * HOT
    hot, cool = groups.where(F.col(size) > limit), groups.where(F.col(size) <= limit)
    return rows.join(F.broadcast(hot), key).unionByName(rows.join(cool, key))


def rebuilt(t):
    """(conv_id, d, digest, words, cum of rebuilt conversations, d from 1; one row a conversation: n turns, total words)."""
    own = written(t.groupBy("conv_id").agg(F.count("*").alias("n_own"), F.sum("words").alias("w_own"), F.coalesce(F.sum(F.when(F.col("nth") <= heads("conv_id"), F.col("words"))), F.lit(0)).alias("w_off")))
    first = t.where((F.col("nth") < HEADS) & (F.col("conv_id") % SHARE == 0)).withColumnRenamed("conv_id", "from")
    lent = own.select("conv_id", (F.col("conv_id") - F.col("conv_id") % SHARE).alias("from")).join(first, "from").where(F.col("nth") <= heads("conv_id"))
    got = lent.groupBy("conv_id").agg(F.count("*").alias("n_got"), F.sum("words").alias("w_got"))
    c = written(own.join(got, "conv_id", "left").fillna(0, ["n_got", "w_got"]).select(
        "conv_id", "n_own", "n_got", (F.col("w_got") - F.col("w_off")).alias("w_more"), (F.col("n_got") + F.greatest(F.lit(0), F.col("n_own") - heads("conv_id"))).alias("n"), (F.col("w_own") + F.col("w_got") - F.col("w_off")).alias("total")))
    total = c.agg(F.sum("n_own")).first()[0] or 0
    tail = met(t.where(F.col("nth") > heads("conv_id")), c.select("conv_id", "n_own", "n_got", "w_more"), ["conv_id"], "n_own", total)
    r = lent.select("conv_id", F.col("nth").alias("d"), "digest", "words", F.col("upto").alias("cum")).unionByName(
        tail.select("conv_id", (F.col("nth") - heads("conv_id") + F.col("n_got")).alias("d"), "digest", "words", (F.col("upto") + F.col("w_more")).alias("cum")))
    return written(r.sortWithinPartitions("d")), c


def alike(r, c):
    """conv_id and n, a, b: three numbers that are equal for rebuilt conversations with all turns alike."""
    sums = r.groupBy("conv_id").agg(F.bit_xor(F.xxhash64("d", "digest")).alias("a"), F.bit_xor(F.xxhash64("digest", "d", F.lit("b"))).alias("b"))
    return written(c.join(sums, "conv_id", "left").fillna(0, ["a", "b"]).select("conv_id", "n", "a", "b", "total"))


def _joined(batches):
    """Ids of neighbouring rows of one kind, as texts of bounded length."""
    for t in batches:
        n, a, b, ids = (t.column(i).to_numpy(zero_copy_only=False) for i in range(4))
        cut = np.flatnonzero((n[1:] != n[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1])) + 1 if len(n) else []
        at = np.unique(np.concatenate([[0], cut, np.arange(0, len(n), TEXT // 20)])).astype(int).tolist() + [len(n)]
        names = t.column(3).cast(pa.string()).to_pylist()
        first = at[:-1]
        yield pa.RecordBatch.from_arrays([pa.array(x[first]) for x in (n, a, b, ids)] + [pa.array([",".join(names[i:j]) for i, j in zip(at[:-1], at[1:])], pa.string())], ["n", "a", "b", "first", "ids"])


def _hashed(batches):
    """SHA-256 over the texts of a kind, as they come: a kind may go on over batches."""
    key, sha, out = None, None, []
    for t in batches:
        for *k, ids in zip(*(t.column(i).to_pylist() for i in (0, 1, 2, 4))):
            if k == key:
                sha.update(b",")
            else:
                if key:
                    out.append((*key, sha.hexdigest()))
                key, sha = k, hashlib.sha256()
            sha.update(ids.encode())
        yield _ends(out)
        out = []
    yield _ends([(*key, sha.hexdigest())] if key else [])


def _ends(rows):
    return pa.RecordBatch.from_pylist([dict(zip(("n", "a", "b", "ends"), r)) for r in rows], pa.schema([("n", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("ends", pa.string())]))


def ends(s):
    """n, a, b and the digest of all ids of that kind, ascending. A digest is made in order, by one task, from texts that many tasks made; it streams."""
    ids = s.select("n", "a", "b", "conv_id").repartitionByRange("n", "a", "b", "conv_id").sortWithinPartitions("n", "a", "b", "conv_id")
    texts = ids.mapInArrow(_joined, "n long, a long, b long, first long, ids string")
    return texts.repartition("n", "a", "b").sortWithinPartitions("n", "a", "b", "first").mapInArrow(_hashed, "n long, a long, b long, ends string")


def refined(r, reps, root, many):
    """Tables of the rounds: rep, w, n, total and, at depth d, parent, child (the class before and after), k and m (members' kinds and number), words, rest (words from here on)."""
    now, d, rounds = reps.select("rep", "w", "n", "total", F.lit(root).cast("long").alias("child")), 0, []
    while many > 1:
        d += 1
        step = r.where(F.col("d") == d).withColumnRenamed("conv_id", "rep")
        t = written(now.where(F.col("n") >= d).select("rep", "w", "n", "total", F.col("child").alias("parent")).join(step, "rep"))
        g = t.groupBy("parent", "digest").agg(F.min("rep").alias("child"), F.count("*").alias("k"), F.sum("w").alias("m"))
        moved = met(t, g, ["parent", "digest"], "k", many)
        rounds.append(written(moved.select("rep", "w", "n", "total", "parent", "child", "k", "m", "words", "d", (F.col("total") - F.col("cum") + F.col("words")).alias("rest"))))
        now = rounds[-1].where("k > 1").select("rep", "w", "n", "total", "child")
        many = now.count()
    return rounds


NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]


def folded(rounds):
    """The nodes of the rounds' tables, with sums over what hangs on each, deepest first; and what hangs on the root."""
    out, below = [], None
    for i, t in enumerate(reversed(rounds)):
        v = t.where("rep = child")
        if below is None:
            v = v.withColumns({"c": F.lit(None).cast("long"), "l": F.lit(None).cast("long"), "s": F.lit(None).cast("long")})
        else:
            v = v.join(below.withColumnRenamed("parent", "child"), "child", "left")
        one = F.col("k") == 1
        v = v.select(
            F.col("child").alias("conv_id"), F.col("d").cast("long").alias("depth"), F.col("parent").alias("parent_conv_id"), F.col("m").alias("n_convs"),
            F.when(one, (F.col("n") > F.col("d")).cast("long")).otherwise(F.coalesce("c", F.lit(0))).cast("long").alias("n_children"),
            F.when(one, F.lit(1)).otherwise(F.coalesce("l", F.lit(1))).cast("long").alias("n_leaves"),
            F.when(one, (F.col("w") - 1) * F.col("rest")).otherwise((F.col("m") - 1) * F.col("words") + F.coalesce("s", F.lit(0))).cast("long").alias("saved_tokens"))
        v = written(v) if i % LEVELS == LEVELS - 1 else v
        out.append(v)
        below = v.groupBy(F.col("parent_conv_id").alias("parent")).agg(F.count("*").alias("c"), F.sum("n_leaves").alias("l"), F.sum("saved_tokens").alias("s"))
    return out, below


def trie(conversations):
    """One row a node: its smallest conversation, depth, parent's conversation, members, children, leaves below, words saved below and the digest of those that end there."""
    spark = conversations.sparkSession
    r, c = rebuilt(turns(conversations))
    s = alike(r, c)
    convs, root, n_turns = s.agg(F.count("*"), F.min("conv_id"), F.sum("n")).first()
    kinds = s.groupBy("n", "a", "b").agg(F.min("conv_id").alias("rep"), F.count("*").alias("w"), F.max("total").alias("total"))
    reps = written(kinds.join(ends(s), ["n", "a", "b"]).drop("a", "b"))
    many = reps.count()
    if not many:
        return spark.createDataFrame([], ", ".join(f"{n} long" for n in NODE) + ", ends_sha256 string")
    rounds = refined(r, reps, root, many)
    levels, below = folded(rounds)
    if many == 1:
        gone = reps.select("rep", F.lit(0).cast("long").alias("from"))
        top = reps.select((F.col("n") > 0).cast("long").alias("c"), F.lit(1).cast("long").alias("l"), ((F.col("w") - 1) * F.col("total")).alias("s"))
        at = gone
    else:
        gone = None
        for t in rounds:
            one = t.where("k = 1").select("rep", F.col("d").cast("long").alias("from"))
            gone = one if gone is None else gone.unionByName(one)
        top = below.agg(F.sum("c").alias("c"), F.sum("l").alias("l"), F.sum("s").alias("s"))
    # a kind ends at its own node when it is retired, and else at the node of its class
    last = reps.where("n = 0").select(F.lit(root).cast("long").alias("conv_id"), F.lit(0).cast("long").alias("depth"), "ends")
    for t in rounds:
        done = t.where("n = d").select("rep", F.col("child").alias("conv_id"), F.col("d").cast("long").alias("depth"))
        last = last.unionByName(done.join(reps.select("rep", "ends"), "rep").drop("rep"))
    nodes = top.select(F.lit(root).cast("long").alias("conv_id"), F.lit(0).cast("long").alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"), F.lit(convs).cast("long").alias("n_convs"),
                       F.coalesce("c", F.lit(0)).cast("long").alias("n_children"), F.coalesce("l", F.lit(1)).cast("long").alias("n_leaves"), F.coalesce("s", F.lit(0)).cast("long").alias("saved_tokens"))
    for v in levels:
        nodes = nodes.unionByName(v)
    nodes = nodes.join(last, ["conv_id", "depth"], "left").select(*NODE, F.coalesce("ends", F.lit(EMPTY)).alias("ends_sha256"))
    chains = written(gone.join(reps, "rep").where(F.col("n") > F.col("from")).withColumnRenamed("rep", "conv_id"))
    chain = met(r, chains, ["conv_id"], "n", n_turns).where(F.col("d") > F.col("from")).select(
        "conv_id", F.col("d").cast("long").alias("depth"), F.col("conv_id").alias("parent_conv_id"), F.col("w").alias("n_convs"), (F.col("d") < F.col("n")).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"),
        ((F.col("w") - 1) * (F.col("total") - F.col("cum") + F.col("words"))).alias("saved_tokens"), F.when(F.col("d") == F.col("n"), F.col("ends")).otherwise(F.lit(EMPTY)).alias("ends_sha256"))
    return nodes.unionByName(chain)


SQL = rf"""WITH x AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(role) || ':' || role || text)) - 1 AS i, sha256(length(role) || ':' || role || text) AS k, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words FROM x),
c AS (SELECT conv_id, conv_id - conv_id % 20 AS donor, n, xor({_CRC.format("CAST(conv_id AS VARCHAR)")}, 4294967295) % 4 AS h FROM (SELECT conv_id, count(*) AS n FROM t GROUP BY conv_id)),
r AS (SELECT c.conv_id, t.i + 1 AS depth, k, words FROM c JOIN t ON t.conv_id = c.donor AND t.i < c.h
  UNION ALL SELECT c.conv_id, coalesce(least(c.h, d.n), 0) + t.i - c.h + 1, k, words FROM c JOIN t ON t.conv_id = c.conv_id AND t.i >= c.h LEFT JOIN c d ON d.conv_id = c.donor),
p AS (SELECT conv_id, 0 AS depth, '' AS node, 0 AS words FROM c UNION ALL SELECT conv_id, depth, sha256(string_agg(k, '') OVER (PARTITION BY conv_id ORDER BY depth)), words FROM r),
l AS (SELECT *, max(depth) OVER (PARTITION BY conv_id) AS length FROM p),
n AS (SELECT node, depth, min(conv_id) AS conv_id, count(*) AS n, max(words) AS words, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (depth = length) AS ids FROM l GROUP BY node, depth),
q AS (SELECT n.*, u.conv_id AS parent, u.node AS up FROM n LEFT JOIN p ON p.conv_id = n.conv_id AND p.depth = n.depth - 1 LEFT JOIN n u ON u.node = p.node AND u.depth = p.depth),
k AS (SELECT up, count(*) AS c FROM q WHERE up IS NOT NULL GROUP BY up),
f AS (SELECT q.*, coalesce(c, 0) AS c FROM q LEFT JOIN k ON k.up = q.node),
a AS (SELECT p.node, count(*) FILTER (f.c = 0) AS leaves, sum((f.n - 1) * f.words) AS saved FROM f JOIN p ON p.conv_id = f.conv_id AND p.depth <= f.depth GROUP BY p.node)
SELECT conv_id, CAST(depth AS BIGINT) AS depth, parent AS parent_conv_id, n AS n_convs, c AS n_children, leaves AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256 FROM f JOIN a USING (node)"""
