"""Clean the documents table for training: five stages, each written and read again.

Stages take and return the columns of documents, and any others, whatever their names; the last repeats
documents as the mix takes them. A document with a null text has an empty one wherever it is judged, and one
with a null doc_id is never taken for a copy. Repeated rows are judged alike; of rows equal in id and text one
stays. An empty table gives an empty one at each stage."""
import uuid

from pyspark.sql import functions as F

from revisio.llm import decontam, graph, mixing, neardup, pii, quality

ORACLE_SQL = None


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def good(spark, docs, sf_dir):
    """Documents scored at or above the cut."""
    return quality.kept(docs, table(spark, sf_dir, "labels"))


def unique(spark, docs, sf_dir):
    return neardup.keep_one(docs)


def unleaked(spark, docs, sf_dir):
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def masked(spark, docs, sf_dir):
    """Personal data hidden; n_chars counts the new text."""
    return pii.mask(docs).withColumn("n_chars", F.char_length("text").cast("long")).select(docs.columns)


def mixed(spark, docs, sf_dir):
    return mixing.emit(docs)


STAGES = [("quality", good), ("neardup", unique), ("decontam", unleaked), ("pii", masked), ("mixing", mixed)]


def run(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    at = f"{graph.folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{at}/{name}")
        docs = spark.read.parquet(f"{at}/{name}")
    return docs
