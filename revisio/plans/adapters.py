"""Attempts and pairs of texts over the test tables, in DataFrame and SQL form."""
from pyspark.sql import Window
from pyspark.sql import functions as F


def table(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


def attempts(spark, d):
    """Orders as attempts; a study's first F by date and key is COMPLETE."""
    o = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("id"), F.to_date("o_orderdate").alias("start"), (F.col("o_custkey") * 5 + F.col("o_orderkey") % 5).alias("study"),
        F.when(F.substring("o_orderpriority", 1, 1).isin("1", "2", "3"), "AI").otherwise("MANUAL").alias("mode"), "o_orderstatus")
    nth = F.sum((F.col("o_orderstatus") == "F").cast("int")).over(Window.partitionBy("study").orderBy("start", "id").rowsBetween(Window.unboundedPreceding, 0))
    result = F.when((F.col("o_orderstatus") == "F") & (nth == 1), "COMPLETE").when((F.col("o_orderstatus") == "P") & (F.col("mode") == "AI"), "AI_ERROR").otherwise("USER_DROPPED")
    return o.withColumn("result", result).drop("o_orderstatus")


ATTEMPTS = """o AS (SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS start, o_custkey * 5 + o_orderkey % 5 AS study, CASE WHEN substr(o_orderpriority, 1, 1) IN ('1', '2', '3') THEN 'AI' ELSE 'MANUAL' END AS mode, o_orderstatus AS st FROM orders),
att AS (SELECT id, start, study, mode, CASE WHEN st = 'F' AND sum(CASE WHEN st = 'F' THEN 1 ELSE 0 END) OVER (PARTITION BY study ORDER BY start, id ROWS UNBOUNDED PRECEDING) = 1 THEN 'COMPLETE'
  WHEN st = 'P' AND mode = 'AI' THEN 'AI_ERROR' ELSE 'USER_DROPPED' END AS result FROM o)"""


def pairs(spark, d):
    """Each part's name against the name of the next key, dealt out by key: the table's few files would make few tasks of what is done with the names."""
    p = table(spark, d, "part").select("p_partkey", "p_name")
    q = p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("final"))
    j = p.join(q.hint("merge"), "p_partkey").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("suggested"), "final")
    return j.repartition(2 * spark.sparkContext.defaultParallelism, "id")


PAIRS = "pr AS (SELECT a.p_partkey AS id, a.p_name AS suggested, b.p_name AS final FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1)"
