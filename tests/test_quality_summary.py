"""The summary of checks on tables that break them."""
import glob
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from revisio.operators import quality
from revisio.plans import catalogue, records

SMALL = "/root/testdata/sf0.001"


def told(rows):
    return {r.data_quality_check_name: (r.affected_attempt_count, r.affected_distinct_study_count, r.affected_distinct_author_count) for r in rows}


@pytest.fixture(scope="module")
def clean(spark):
    """40 attempts, each of its own study and author, of which 20 are completed, with the metric rows of these."""
    rec = spark.sql("""SELECT ID, TIMESTAMP_NTZ '2024-01-01 00:00:00' AS START_TIME, IF(ID <= 20, TIMESTAMP_NTZ '2024-01-01 01:00:00', NULL) AS END_TIME, 'AI' AS ATTEMPT_TYPE, IF(ID <= 20, 'COMPLETE', 'AI_ERROR') AS ATTEMPT_RESULT,
      'S' || ID AS STUDY_NUM, IF(ID <= 20, TIMESTAMP_NTZ '2024-01-01 01:00:00', NULL) AS CREATED_DATE, IF(ID <= 20, ID, NULL) AS CREATED_BY_ID, ID AS USER_ID, 'Law' AS STUDY_DEPARTMENT, 'u' || ID AS AUTHOR_USER_NAME,
      CAST(NULL AS STRING) AS AUTHOR_APPOINTMENTS, CAST(NULL AS STRING) AS PI_APPOINTMENTS FROM (SELECT explode(sequence(1L, 40L)) AS ID)""")
    ids = "(SELECT explode(sequence(1L, 20L)) AS record_id)"
    ast = spark.sql("SELECT record_id, 'title' AS field_name, 'title' AS picked_kind, 0L AS picked_index, " + ", ".join(f"0.5D AS {c}" for c in quality.ASSIST_FLOATS) + f" FROM {ids}")
    floats = ", ".join(f"2.5D AS {c}" for c in quality.readability.FLOATS)
    rdb = spark.sql(f"SELECT record_id, 'title' AS field_name, text_role, suggestion_kind, suggestion_index, selected, {floats} FROM {ids} CROSS JOIN VALUES ('SUGGESTED', 'title', 0L, true), ('SUGGESTED', 'title', 1L, false), ('FINAL', NULL, NULL, NULL) t(text_role, suggestion_kind, suggestion_index, selected)")
    return rec, ast, rdb


def put(d, **cases):
    """Columns replaced where a condition holds: {column: (value, condition)}."""
    return d.withColumns({c: F.when(F.expr(where), F.expr(value)).otherwise(F.col(c)) for c, (value, where) in cases.items()})


def more(d, where, **columns):
    """d and, once more, the rows for which a condition holds, changed."""
    return d.union(d.where(where).withColumns({c: F.expr(e) for c, e in columns.items()}))


def broken(*tables):
    got = told(quality.summary(*tables).collect())
    assert len(got) == 16
    return {n: c for n, c in got.items() if any(c)}


def test_clean_tables_break_no_check(clean):
    assert broken(*clean) == {}


def test_checks_of_records_count_what_breaks_them(clean):
    rec, ast, rdb = clean
    rec = put(rec, STUDY_NUM=("CASE WHEN ID = 3 THEN 'S2' END", "ID IN (3, 32, 33)"), AUTHOR_USER_NAME=("' '", "ID IN (34, 35)"), END_TIME=("NULL", "ID = 4"), CREATED_BY_ID=("NULL", "ID = 5"), CREATED_DATE=("NULL", "ID = 6"),
              STUDY_DEPARTMENT=("' '", "ID IN (7, 36)"), USER_ID=("99", "ID IN (8, 37)"))
    rec = more(more(rec, "ID = 31"), "ID > 38", ID="CAST(NULL AS LONG)")
    one = {f"COMPLETED_ATTEMPT_{n}": (1, 1, 1) for n in ("MISSING_END_TIME", "MISSING_CREATED_BY_ID", "MISSING_CREATED_DATE", "MISSING_STUDY_DEPARTMENT", "CREATOR_MISMATCH")}
    assert broken(rec, ast, rdb) == one | {"DUPLICATE_AUDIT_ID": (3, 3, 3), "MISSING_STUDY_NUMBER": (2, 0, 2), "MISSING_AUTHOR_USERNAME": (2, 2, 1), "MULTIPLE_COMPLETE_ATTEMPTS_PER_STUDY": (2, 1, 2), "CREATED_BY_ID_VARIES_WITHIN_STUDY": (2, 1, 2)}


def test_checks_of_metric_rows_count_attempts(clean):
    rec, ast, rdb = clean
    ast = more(more(put(ast, **{quality.ASSIST_FLOATS[-1]: ("double('-inf')", "record_id = 2")}), "record_id = 1", record_id="70L"), "record_id = 1", record_id="CAST(NULL AS LONG)")
    rdb = more(put(rdb, gunning_fog=("double('nan')", "record_id = 3 AND text_role = 'FINAL'")), "record_id = 1 AND text_role = 'FINAL'", record_id="71L")
    assert broken(rec, ast, rdb) == {"ORPHAN_AI_ASSISTANCE_METRIC_ROW": (2, 0, 0), "ORPHAN_READABILITY_METRIC_ROW": (1, 0, 0), "NONFINITE_METRIC": (2, 2, 2)}


def test_markers_agree_with_roles_picks_and_attempts(clean):
    """No marker; a final text's; another than the pick; two; one without a pick; one of an attempt by hand."""
    rec, ast, rdb = clean
    rdb = put(rdb, selected=("CASE record_id WHEN 2 THEN false WHEN 3 THEN suggestion_index = 1 END", "record_id = 1 AND suggestion_index = 1 OR record_id = 2 AND text_role = 'FINAL' OR record_id = 3 AND text_role = 'SUGGESTED'"))
    got = broken(put(rec, ATTEMPT_TYPE=("'MANUAL'", "ID = 6")), put(ast, picked_kind=("NULL", "record_id = 5")), more(rdb, "record_id = 4 AND selected"))
    assert got == {"SELECTED_MARKER_INCONSISTENCY": (6, 6, 6)}


def test_query_equals_sql_on_tables_that_break_checks(spark, tmp_path):
    """Orders repeated, those by hand without a price, of which times are made, and nations without a name."""
    c = duckdb.connect()
    odd = {"orders": "SELECT * REPLACE (CASE WHEN o_orderkey % 7 > 0 OR o_orderpriority < '4' THEN o_totalprice END AS o_totalprice) FROM t UNION ALL SELECT * FROM t WHERE o_orderkey % 41 = 0 AND o_orderkey % 7 > 0",
           "nation": "SELECT * REPLACE (CASE WHEN n_nationkey % 5 > 0 THEN n_name END AS n_name) FROM t"}
    for p in glob.glob(f"{SMALL}/*.parquet"):
        n = os.path.basename(p)[:-8]
        c.execute(f"COPY (WITH t AS (SELECT * FROM '{p}') {odd.get(n, 'SELECT * FROM t')}) TO '{tmp_path}/{n}.parquet' (FORMAT parquet)")
        c.execute(f"CREATE VIEW {n} AS SELECT * FROM '{tmp_path}/{n}.parquet'")
    got = catalogue.QUERIES["a29_quality"](spark, str(tmp_path))
    want = c.execute(catalogue.SQL["a29_quality"]).df()
    row = lambda r: tuple(None if x != x else x for x in r)
    assert sorted(map(row, got.toPandas()[list(want.columns)].itertuples(index=False))) == sorted(map(row, want.itertuples(index=False)))
    assert {n for n, k in told(got.collect()).items() if k[0]} >= {"DUPLICATE_AUDIT_ID", "COMPLETED_ATTEMPT_MISSING_END_TIME", "COMPLETED_ATTEMPT_MISSING_CREATED_DATE", "COMPLETED_ATTEMPT_MISSING_STUDY_DEPARTMENT", "SELECTED_MARKER_INCONSISTENCY"}


def test_metric_rows_are_not_broadcast(spark):
    t = records.tables(spark, SMALL)
    assert "BroadcastHashJoin" not in quality.affected(t.rec, t.ast, t.rdb)._jdf.queryExecution().executedPlan().toString()
