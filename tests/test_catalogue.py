"""Every query against its SQL, and the kernels without SQL against plain Python."""
import glob
import os

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from revisio.functions import text
from revisio.plans import catalogue

D = "/root/testdata/sf0.001"


def canonical(df):
    df = df[sorted(df.columns)].astype(object).where(df.notna(), None)
    rows = [tuple(v if v is None or isinstance(v, (str, bool)) else round(float(v), 6) for v in r) for r in df.itertuples(index=False)]
    return list(df.columns), sorted(rows, key=repr)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in glob.glob(f"{D}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", catalogue.SQL)
def test_query_equals_sql(spark, duck, name):
    got, want = catalogue.QUERIES[name](spark, D).toPandas(), duck.execute(catalogue.SQL[name]).df()
    assert len(want) and canonical(pd.DataFrame(got)) == canonical(want)


def soft(a, b):
    def lev(x, y):
        row = list(range(len(y) + 1))
        for i, p in enumerate(x, 1):
            row, old = [i], row
            for j, q in enumerate(y, 1):
                row.append(min(row[-1] + 1, old[j] + 1, old[j - 1] + (p != q)))
        return row[-1]

    row = [float(j) for j in range(len(b) + 1)]
    for i, p in enumerate(a, 1):
        row, old = [float(i)], row
        for j, q in enumerate(b, 1):
            row.append(min(row[-1] + 1, old[j] + 1, old[j - 1] + lev(p, q) / max(len(p), len(q), 1)))
    return row[-1]


def test_soft_words(spark):
    for r in catalogue.QUERIES["f_soft_words"](spark, D).collect():
        assert r.distance == pytest.approx(soft(r.suggested.split(), r.final.split()))
    for r in catalogue.QUERIES["f_ter"](spark, D).collect():
        assert r.soft_word_edit_distance == pytest.approx(soft(r.suggested.split(), r.final.split())) and r.ter_rate >= 0
    rows = [("", "", 0.0), ("", "one", 1.0), ("one", "", 1.0), ("a b a", "a b a", 0.0), ("ab cd", "ab ce", 0.5)]
    d = spark.createDataFrame(rows, "a string, b string, want double")
    for r in d.withColumn("got", text.soft_word_distance(text.tokens(F.col("a")), text.tokens(F.col("b")))).collect():
        assert r.got == pytest.approx(r.want)
