"""Mixing sources to target weights, with DataFrame functions only.

A null text has size 0; a null source is a source of its own, ranked last. An empty table
gives no rows. The number drawn hangs on doc_id and text, so only rows equal in both draw the same; null ids draw by
their texts. Columns other than doc_id, source and
text are ignored.
"""
from pyspark.sql import Window as W, functions as F

from revisio.llm.graph import aside

WORD = r"[^\x20\x09-\x0D]+"


def targets(sizes, share=1.5, cap=2.0):
    """One row a source: water-filling level over sources ordered by cap/weight.

    The windows run over one row per source, never over documents."""
    by = W.orderBy(F.col("source").asc_nulls_last())
    s = sizes.withColumn("i", F.row_number().over(by) - 1).withColumn(
        "w", F.element_at(F.array(F.lit(3.0), F.lit(1.0), F.lit(2.0)), (F.col("i") % 3 + 1).cast("int")))
    s = s.withColumn("cap", cap * F.col("source_size")).withColumn("r", F.col("cap") / F.col("w"))
    o = W.orderBy("r", "i")
    before = o.rowsBetween(W.unboundedPreceding, -1)
    after = o.rowsBetween(0, W.unboundedFollowing)
    s = s.withColumn("level", (share * F.sum("source_size").over(W.partitionBy())
                               - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(after))
    free = F.min(F.when(F.col("level") <= F.col("r"), F.struct("r", "i", "level"))).over(W.partitionBy())
    return s.withColumn("f", free).select("source", "source_size", F.when(
        F.col("f").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("f.level") * F.col("w"))).alias("target"))


def rated(docs):
    """docs with __size, __source_size, __target and __copies."""
    d = docs.withColumn("__size", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long"))
    t = targets(d.groupBy("source").agg(F.sum("__size").alias("source_size"))).select(
        F.col("source").alias("__s"), F.col("source_size").alias("__source_size"), F.col("target").alias("__target"))
    rate = F.coalesce(F.col("__target") / F.nullif("__source_size", F.lit(0)), F.lit(0.0))
    u = F.conv(F.substring(F.md5(F.concat(F.lit("mix:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce("text", F.lit(""))))), 1, 13), 16, 10).cast("double") / float(1 << 52)
    copies = F.floor(rate) + (u < rate - F.floor(rate)).cast("long")
    return d.join(t, d["source"].eqNullSafe(t["__s"])).drop("__s").withColumn("__copies", copies)


def mix(docs):
    return rated(docs.select("doc_id", "source", "text")).select(
        "doc_id", F.col("__size").alias("size"), F.col("__source_size").alias("source_size"), F.col("__target").alias("target"),
        (F.col("__size") * F.col("__copies")).cast("long").alias("taken"))


def emit(docs):
    """Every document as often as the mix takes it, with all its columns."""
    d = aside(docs, "doc_id", "source", "text")
    r = rated(d).where("__copies > 0")
    return r.withColumn("__n", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__copies")))).select(d.columns).toDF(*docs.columns)


SQL = r"""WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size, md5(coalesce(text, '')) AS h FROM documents),
g AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
i AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS i FROM g),
c AS (SELECT *, CASE i % 3 WHEN 0 THEN 3e0 WHEN 1 THEN 1e0 ELSE 2e0 END AS w, 2e0 * source_size AS cap FROM i),
r AS (SELECT *, cap / w AS r FROM c),
l AS (SELECT *, (1.5e0 * (SELECT CAST(sum(source_size) AS BIGINT) FROM g) - coalesce(sum(cap) OVER (ORDER BY r, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0e0))
  / sum(w) OVER (ORDER BY r, i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM r),
f AS (SELECT level FROM l WHERE level <= r ORDER BY r, i LIMIT 1),
t AS (SELECT source, source_size, coalesce(least(cap, (SELECT level FROM f) * w), cap) AS target FROM l),
u AS (SELECT d.doc_id, d.size, t.source_size, t.target, coalesce(t.target / nullif(t.source_size, 0), 0e0) AS rate,
  CAST(CAST('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || h), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496e0 AS u
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, CAST(size * (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM u"""
