"""Lineage cuts and connected components."""
from pyspark.sql import functions as F

from revisio.shared import folder


def cut(df, spark):
    """df, written to that folder."""
    folder(spark)
    return df.checkpoint()


def aside(docs, *own):
    """docs with the columns other than `own` renamed, so that no working column clashes with them; toDF(*docs.columns) gives the names back."""
    return docs.toDF(*[c if c in own else f"other_{i}" for i, c in enumerate(docs.columns)])


def components(links, spark):
    """h, root for the ends of links h1, h2: alternating stars until nothing changes.

    Hubs are only ever summed by min and joined back, never gathered. No links: no rows."""
    e = cut(links.select(F.greatest("h1", "h2").alias("u"), F.least("h1", "h2").alias("v")).where("u <> v").distinct(), spark)

    def mark(e):
        return e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    was = None
    while (now := mark(e)) != was:
        was = now
        both = e.union(e.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        big = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = big.groupBy("u").agg(F.min("v").alias("m"))
        small = big.join(low, "u")
        e = small.select("u", F.col("m").alias("v")).union(small.where("v <> m").select("v", "m")).distinct()
        e = cut(e, spark)
    return e.select(F.col("u").alias("h"), F.col("v").alias("root"))
