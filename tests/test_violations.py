"""The one-pass count of broken rules against each rule by itself."""
import pytest
from pyspark.sql import functions as F

from revisio.operators import quality
from revisio.plans import records
from revisio.sql import frame


@pytest.fixture(scope="module")
def clean(spark, tmp_path_factory):
    t, at = records.tables(spark, "/root/testdata/sf0.001"), tmp_path_factory.mktemp("rules")
    out = []
    for n in ("rec", "ast", "rdb"):
        getattr(t, n).write.parquet(str(at / n))
        out.append(spark.read.parquet(str(at / n)))
    return out


def counted(rec, ast, rdb):
    got = {r.rule: r.n for r in quality.violations(rec, ast, rdb).collect()}
    assert got == {r.rule: r.n for r in frame(quality.VIOLATIONS, rec=rec, ast=ast, rdb=rdb).collect()}
    return got


def change(df, **cases):
    """Columns replaced where a condition holds: {column: [(condition, value)]}."""
    for c, some in cases.items():
        for where, value in some:
            df = df.withColumn(c, F.when(F.expr(where), F.lit(value)).otherwise(F.col(c)))
    return df


def test_clean_data_break_no_rule_and_are_read_once(clean):
    assert set(counted(*clean).values()) == {0}
    plan = quality.violations(*clean)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 3 and "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_every_rule_fires(clean):
    rec, ast, rdb = clean
    rec = rec.withColumn("USER_ID", F.expr("USER_ID + CASE WHEN ID % 17 = 0 THEN 1 ELSE 0 END"))
    rec = change(rec, STUDY_NUM=[("ID % 41 = 0", " ")], AUTHOR_USER_NAME=[("ID % 43 = 0", None)], ATTEMPT_TYPE=[("ID % 37 = 0", "X")], ATTEMPT_RESULT=[("ID % 47 = 0", "")], END_TIME=[("ID % 31 = 0", None)], CREATED_BY_ID=[("ID % 29 = 0", None)],
                 CREATED_DATE=[("ID % 27 = 0", None)], STUDY_DEPARTMENT=[("ID % 23 = 0", None)], ID=[("ID % 50 = 0", None)])
    rec = rec.union(rec.where("ID % 13 = 0")).where("ID IS NULL OR ID % 11 > 0")
    ast = change(ast.withColumn("h", F.expr("pmod(xxhash64(record_id, field_name), 100)")), record_id=[("h = 1", None)], field_name=[("h = 2", None), ("h = 3", " ")], analysis_type=[("h = 4", "Z")], match_type=[("h = 5", None)],
                 picked_kind=[("h IN (6, 7)", None), ("h IN (8, 9)", "q")], picked_index=[("h IN (10, 11)", -1), ("h IN (13, 14, 15)", 5)], lookup_similarity=[("h IN (13, 14, 15)", float("nan"))])
    rdb = change(rdb.withColumn("h", F.expr("pmod(xxhash64(record_id, field_name, text_role, suggestion_index), 100)")), record_id=[("h = 1", None)], field_name=[("h = 2", None)], text_role=[("h = 3", "U"), ("h = 4", "FINAL")],
                 selected=[("h IN (5, 6)", None), ("h IN (7, 8, 9)", True)], attempt_type=[("h = 11", "X"), ("h = 12", None)], automated_readability_index=[("h = 13", float("-inf"))])
    got = counted(rec, ast.union(ast.where("h > 90")).drop("h"), rdb.union(rdb.where("h > 85")).drop("h"))
    assert [n for n, k in got.items() if not k] == []
