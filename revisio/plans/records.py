"""Audit records and payloads over the test tables, for the engine and for DuckDB."""
import re

from revisio.derived import Derived
from revisio.operators import appointments, attempts, field_tables, fields, retries, sources
from revisio.plans import payloads
from revisio.plans.adapters import table
from revisio.sql import duck, frame

RECORDS = r"""
WITH o AS (SELECT o_orderkey AS k, o_custkey AS c, o_orderstatus AS st, CAST(round(o_totalprice * 100) AS BIGINT) AS z, o_orderdate AS d, substr(o_orderpriority, 1, 1) AS p FROM {orders}),
b AS (SELECT *, CASE WHEN p IN ('1', '2', '3') THEN 'AI' ELSE 'MANUAL' END AS mode, c * 5 + k % 5 AS s, (c * 3 + CAST((k - k % 5) / 5 AS BIGINT) % 3) % m AS a, @hours(d, k % 4) AS t FROM (SELECT *, (SELECT greatest(211, CAST((count(*) - count(*) % 7) / 7 AS BIGINT)) FROM {customer}) AS m FROM o) o),
n AS (SELECT *, sum(CASE WHEN st = 'F' THEN 1 ELSE 0 END) OVER (PARTITION BY s ORDER BY t, k ROWS UNBOUNDED PRECEDING) AS f FROM b),
r AS (SELECT n.*, c_mktsegment AS seg, n_name, r_name, CASE WHEN st = 'F' AND f = 1 THEN 'COMPLETE' WHEN mode = 'AI' AND st = 'P' THEN 'AI_ERROR' WHEN mode = 'AI' AND k % 17 = 0 THEN 'AI_ERROR_WITHOUT_STACK_TRACE' ELSE 'USER_DROPPED' END AS res
  FROM n JOIN {customer} ON n.c = c_custkey JOIN {nation} ON c_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey)
SELECT k AS ID, t AS START_TIME, CASE WHEN res = 'COMPLETE' OR k % 3 > 0 THEN @secs(t, z % 9000) END AS END_TIME, mode AS ATTEMPT_TYPE, res AS ATTEMPT_RESULT, 'STAFF' AS USER_TYPE, 'S' || CAST(s AS STRING) AS STUDY_NUM,
  CASE WHEN res = 'COMPLETE' THEN @secs(t, z % 9000) END AS CREATED_DATE, CASE WHEN res = 'COMPLETE' THEN a WHEN k % 97 = 0 THEN a + 1000000007 END AS CREATED_BY_ID, res = 'COMPLETE' AS PUBLISHABLE,
  CASE WHEN res = 'COMPLETE' OR k % 11 > 0 THEN n_name END AS STUDY_DEPARTMENT, CASE WHEN k % 13 > 0 THEN r_name END AS STUDY_PARTICIPANT_TYPE, CASE WHEN res = 'COMPLETE' OR k % 19 > 0 THEN a END AS USER_ID,
  'shib:u' || CAST(a AS STRING) AS AUTHOR_USER_NAME, CASE k % 5 WHEN 0 THEN 'PRINCIPAL_INVESTIGATOR' WHEN 1 THEN 'COORDINATOR' WHEN 2 THEN ' ' WHEN 3 THEN 'STAFF' END AS AUTHOR_STUDY_TEAM_ROLE,
  CASE k % 7 WHEN 0 THEN 'PI' WHEN 1 THEN 'Study Staff' WHEN 2 THEN '' END AS AUTHOR_ERESEARCH_ROLE,
  CASE k % 6 WHEN 0 THEN 'Professor:' || n_name || ':Arts' WHEN 1 THEN 'Professor : ' || n_name || ' : Arts~|APPOINTMENT|~Fellow:' || r_name || ':Law' WHEN 2 THEN 'Dean::Law' WHEN 3 THEN 'Fellow:Lab:' || r_name || ':Law, Nurse:Ward:Medicine'
    WHEN 4 THEN ' ' END AS AUTHOR_APPOINTMENTS,
  CASE WHEN s % 4 > 0 THEN 'shib:u' || CAST((s * 7) % m AS STRING) WHEN s % 8 = 0 THEN 'shib:u' || CAST(a AS STRING) END AS PI_USER_NAME, CASE WHEN s % 3 > 0 THEN 'Chair:' || r_name || ':Arts' END AS PI_APPOINTMENTS,
  CASE WHEN k % 23 > 0 THEN z % 40 END AS PRIOR_CREATED_COUNT, CASE WHEN a % 10 > 0 THEN (a * 13) % 60 END AS TOTAL_CREATED_COUNT, CASE WHEN k % 29 > 0 THEN (a * 7 + k) % 25 END AS MEMBER_OF_OTHER_STUDIES_COUNT,
  CASE WHEN k % 31 > 0 THEN z % 300 END AS LOGIN_DAYS, CASE WHEN k % 8 > 0 THEN @hours(d, -(z % 5000)) END AS MIN_LOGIN_TIME, CASE WHEN k % 9 > 0 THEN @hours(d, z % 700) END AS MAX_LOGIN_TIME,
  CASE WHEN k % 12 > 0 THEN z % 1000000 END AS TIME_SPENT_ON_STUDY_INFO_PAGE_MS, CASE WHEN k % 14 > 0 THEN z % 5000000 END AS TIME_TO_FINISH_ADDING_STUDY_MS, CASE WHEN mode = 'AI' AND k % 15 > 0 THEN z % 60000 END AS LATENCY_MS,
  CASE WHEN mode = 'AI' AND k % 16 > 0 THEN (z % 50) * 100 END AS SOURCE_SIZE_CHARS, CASE WHEN mode = 'AI' THEN CASE k % 4 WHEN 0 THEN 'FILE' WHEN 1 THEN 'TEXT' WHEN 2 THEN ' file ' END END AS SOURCE_TYPE,
  CASE k % 10 WHEN 0 THEN 'Other' WHEN 1 THEN 'ΟΔΟΣ' WHEN 3 THEN 'Straße' WHEN 6 THEN 'οδος' WHEN 8 THEN 'STRASSE' WHEN 9 THEN NULL ELSE seg END AS STUDY_CONTENT_SOURCE,
  CASE WHEN mode = 'AI' THEN CASE WHEN k % 10 = 0 AND k % 3 > 0 THEN ' OTHER' WHEN k % 5 = 1 THEN 'AUTOMOBILE' WHEN k % 5 = 2 THEN lower(seg) || ' ' WHEN k % 5 = 3 THEN '' ELSE seg END END AS LLM_INFERRED_STUDY_CONTENT_SOURCE,
  CASE WHEN k % 20 = 0 THEN 'Detail ' || CAST(k % 3 AS STRING) WHEN k % 30 = 0 THEN ' ' END AS STUDY_CONTENT_SOURCE_OTHER_VALUE,
  CASE WHEN mode = 'AI' AND k % 20 = 0 THEN 'detail ' || CAST(k % 2 AS STRING) END AS LLM_INFERRED_STUDY_CONTENT_SOURCE_OTHER_VALUE, CASE WHEN mode = 'AI' THEN CASE k % 18 WHEN 0 THEN 'good' WHEN 5 THEN ' ' END END AS USER_FEEDBACK_COMMENTS
FROM r"""
CUTOFF = "2030-01-01 00:00:00"
STEPS = {"att": attempts.ATTEMPTS, "stu": attempts.STUDIES, "aut": attempts.AUTHORS, "atx": attempts.SOURCED, "stx": attempts.SNAPSHOT, "fbk": attempts.FEEDBACK, "app0": appointments.SQL, "app": "SELECT * EXCLUDE (bad) FROM {app0} WHERE NOT bad",
         "gen": sources.GENERATIONS, "trn": sources.TRANSITIONS, "pth": sources.PATHWAYS, "ctx": retries.CONTEXT.replace("{cut}", f"TIMESTAMP '{CUTOFF}'"),
         "pay": payloads.PAY, "ast": payloads.ANALYSIS, "fld": payloads.FIELDS, "rdb": payloads.READINGS, "prs": payloads.PAIRS, "sel": field_tables.SELECTIONS_SQL}


def records(spark, d):
    return frame(RECORDS, **{t: table(spark, d, t) for t in ("orders", "customer", "nation", "region")})


def ctes(text, extra=None, seen=None):
    """The WITH list, in order, of the steps that a text with {name}s needs."""
    steps = {"rec": RECORDS} | STEPS | (extra or {})
    seen = {} if seen is None else seen
    for name in re.findall(r"\{(\w+)\}", text):
        if name in steps and name not in seen:
            ctes(steps[name], extra, seen)
            seen[name] = steps[name]
    return seen


def query(text, **extra):
    """DuckDB SQL over the test tables of a text whose {name}s are steps or tables."""
    found = ctes(text, extra)
    names = {n: n for n in ("orders", "customer", "nation", "region", "part", "supplier", "lineitem", "documents", "conversations", "events", *found)}
    body = duck(text, **names)
    with_ = ", ".join(f"{n} AS MATERIALIZED ({duck(s, **names).strip()})" for n, s in found.items())
    return f"WITH {with_} SELECT * FROM ({body.strip()})" if found else body


BASE = ("orders", "customer", "nation", "region", "part")
_runs = {}


def tables(spark, d):
    """The derived tables of a folder of test tables; shared by the queries of a session while its files stay as they are."""
    jvm, sc = spark._jvm, spark.sparkContext

    def stamp(name):
        path = jvm.org.apache.hadoop.fs.Path(f"{d}/{name}.parquet")
        status = path.getFileSystem(sc._jsc.hadoopConfiguration()).getFileStatus(path)
        return status.getModificationTime(), status.getLen()

    key = (sc.applicationId, str(d), *map(stamp, BASE))
    if key not in _runs:
        _runs[key] = Derived(spark, {}, CUTOFF, "UTC")
        t = _runs[key]
        t.base |= {"rec": lambda: records(spark, d), "pay": lambda: payloads.pay(spark, d, t.fin), "ast": lambda: fields.analysis(payloads.with_payloads(t.fin, t.pay.where("attempt_type = 'AI'"))), "rdb": lambda: payloads.readings_of(t.pay)}
    return _runs[key]
