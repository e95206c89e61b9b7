"""Queries over the test tables and the same in DuckDB SQL."""
import re
import uuid

from pyspark.sql import functions as F

from revisio.functions import postedit, text
from revisio.operators import events, quality
from revisio.operators.context_tables import CONTEXTS
from revisio.operators.field_tables import FIELDS
from revisio.operators.tables import ATTEMPTS
from revisio.plans import adapters, records
from revisio.plans.adapters import pairs, table
from revisio.plans.payloads import LEFT_OUT
from revisio.shared import folder
from revisio.sources import convert, csv
from revisio.sql import frame

SEQ = f"WITH {adapters.ATTEMPTS}"
#: Columns that are rounded to 5 places on both sides, as sums may differ in their last bits.
ROUNDED = "^(minimum|percentile_[0-9]+|median|average|standard_deviation|maximum)_|percentage"
_TER = ("median_ter_rate_among_edited_attempts", "average_ter_rate_among_edited_attempts")


def rounded(df):
    kinds = dict(df.dtypes)
    return df.select(*[F.round(F.col(c) + 1e-9, 5).alias(c) if kinds[c] == "double" and re.search(ROUNDED, c) else F.col(c) for c in df.columns])


def rounded_sql(sql):
    return f"SELECT COLUMNS(lambda c: NOT regexp_matches(c, '{ROUNDED}')), round(COLUMNS(lambda c: regexp_matches(c, '{ROUNDED}')) + 1e-9, 5) FROM ({sql})"


def told(df):
    """df with its times as text, which every engine spells alike."""
    return df.select(*[F.col(c).cast("string").alias(c) if k.startswith(("timestamp", "date")) else F.col(c) for c, k in df.dtypes])


TIMED = "(timestamp|_ts$|^date)"


def told_sql(sql):
    return f"SELECT COLUMNS(lambda c: NOT regexp_matches(c, '{TIMED}')), CAST(COLUMNS(lambda c: regexp_matches(c, '{TIMED}')) AS VARCHAR) FROM ({sql})"


def _step(name, *drop):
    return lambda s, d: told(records.tables(s, d).made(name).drop(*drop))


def _summary(spec, *drop):
    return lambda s, d: rounded(spec.frame_of(records.tables(s, d)).drop(*drop))


def _without(sql, *drop):
    return f"SELECT * EXCLUDE ({', '.join(drop)}) FROM ({sql})" if drop else sql


def _in_spans(spark, d):
    o, li = table(spark, d, "orders"), table(spark, d, "lineitem")
    spans = o.select(F.col("o_orderkey").alias("key"), F.to_date("o_orderdate").alias("lo"), F.date_add(F.to_date("o_orderdate"), 30).alias("hi"))
    facts = li.select(F.col("l_orderkey").alias("key"), "l_linenumber", F.to_date("l_shipdate").alias("at"))
    return events.within(facts, spans).groupBy("f.l_linenumber").agg(F.count("*").alias("n"))


def _orphans(spark, d):
    """Orders without a returned line."""
    back = table(spark, d, "lineitem").where("l_returnflag = 'R'").select("l_orderkey")
    return table(spark, d, "orders").join(back, F.col("o_orderkey") == F.col("l_orderkey"), "left_anti").select("o_orderkey", "o_orderstatus")


def _top_one(spark, d):
    last = events.latest(table(spark, d, "orders"), "o_custkey", ("o_orderdate", "o_orderkey"))
    c = table(spark, d, "customer")
    return c.join(last, c["c_custkey"] == last["o_custkey"]).select("c_custkey", "c_name", F.col("o_orderkey").alias("latest_key"), "o_orderstatus")


def _text_pairs(spark, d):
    a, b = F.col("suggested"), F.col("final")
    return pairs(spark, d).select("id", text.character_distance(a, b).alias("distance"), text.edit_intensity(a, b).alias("intensity"), text.clamp01(text.character_effort_saved(a, b)).alias("saved"),
                                  F.size(text.tokens(b)).cast("long").alias("n_words"), F.greatest(F.lit(0), F.char_length(b) - text.character_distance(a, b)).cast("long").alias("characters_saved"))


def _soft_words(spark, d):
    return pairs(spark, d).select("id", "suggested", "final", text.soft_word_distance(text.tokens(F.col("suggested")), text.tokens(F.col("final"))).alias("distance"))


def _compared(spark, d):
    """Selected against final texts that are equal, equal but for case and marks, blank, or other."""
    p = pairs(spark, d).select("id", F.col("suggested").alias("selected_text"), F.when(F.col("id") % 4 == 0, "").when(F.col("id") % 4 == 1, F.concat(F.lit(" "), F.upper("suggested"), F.lit("!"))).when(F.col("id") % 4 == 2, F.col("suggested")).otherwise(F.concat("final", F.lit(" more"))).alias("final_text"))
    a = postedit.analyzed(p)
    return a.select("id", "final_text", F.when(F.trim("final_text") == "", "REMOVED").when(F.col("selected_text") == F.col("final_text"), "EXACT").when(F.col("cosmetic"), "COSMETIC_EQUIVALENT").otherwise("EDITED").alias("kind"), "character_edit_distance", "final_word_count")


def _converted(spark, d):
    """Texts of every kind, good and bad, as the canonical types; null where the text has no such value."""
    return frame(convert.EXAMPLES, orders=table(spark, d, "orders")).select("k", *[convert.converted(F.col(f"{t}_text"), t, strict=False).alias(t) for t in ("integer", "boolean", "date", "datetime")]).transform(told)


_DOCUMENT = [("doc_id", "integer", True), ("text", "string", True), ("source", "string", True), ("n_chars", "integer", True)]


def _csv_scan(spark, d):
    """The documents, whose texts hold line ends and quotes, written as CSV and read again in splits."""
    at = f"{folder(spark)}/csv-{uuid.uuid4().hex}"
    csv.write(table(spark, d, "documents").select(*[n for n, _, _ in _DOCUMENT]), at)
    return csv.read(spark, f"{at}/*.csv", _DOCUMENT, nulls=("\\N",))


def _ev(spark, d):
    return table(spark, d, "events")


_SEMI = "SELECT o_orderstatus, count(*) AS n FROM {orders} WHERE o_orderkey IN (SELECT l_orderkey FROM {lineitem} WHERE l_returnflag = 'R' UNION SELECT o_orderkey FROM {orders} WHERE o_orderstatus = 'P') AND o_orderpriority NOT IN ('5-LOW') GROUP BY o_orderstatus"
_CHAIN = """SELECT r_name, n_name, s_name, count(*) AS n, count(o_orderkey) AS ordered, count(l_orderkey) AS lines, count(p_partkey) AS parts, count(x_name) AS named, count(y_name) AS placed, count(l2_part) AS seconds, count(p2_name) AS second_parts, count(last_event) AS seen FROM {customer} LEFT JOIN {nation} ON c_nationkey = n_nationkey LEFT JOIN {region} ON n_regionkey = r_regionkey
  LEFT JOIN {orders} ON o_custkey = c_custkey AND o_orderstatus = 'F' LEFT JOIN {lineitem} ON l_orderkey = o_orderkey AND l_linenumber = 1 LEFT JOIN {part} ON p_partkey = l_partkey LEFT JOIN {supplier} ON s_suppkey = l_suppkey AND s_suppkey <= 3
  LEFT JOIN (SELECT n_nationkey AS x_key, n_name AS x_name, n_regionkey AS x_region FROM {nation}) x ON x_key = s_nationkey LEFT JOIN (SELECT r_regionkey AS y_key, r_name AS y_name FROM {region}) y ON y_key = x_region
  LEFT JOIN (SELECT l_orderkey AS l2_key, l_partkey AS l2_part FROM {lineitem} WHERE l_linenumber = 2) l2 ON l2_key = o_orderkey LEFT JOIN (SELECT p_partkey AS p2_key, p_name AS p2_name FROM {part}) p2 ON p2_key = l2_part
  LEFT JOIN (SELECT user_id, max(event_id) AS last_event FROM {events} GROUP BY user_id) e ON e.user_id = c_custkey GROUP BY r_name, n_name, s_name"""
_KEYED = "SELECT n_name, count(*) AS n, count(DISTINCT AUTHOR_USER_NAME) AS authors FROM {rec} JOIN {customer} ON 'shib:u' || CAST(c_custkey AS STRING) = AUTHOR_USER_NAME JOIN {nation} ON c_nationkey = n_nationkey GROUP BY n_name"
_COMMA = "SELECT n_name, count(DISTINCT o_custkey) AS customers, CAST(max(o_orderdate) AS STRING) AS latest FROM {orders} o, {customer} c, {nation} n WHERE o.o_custkey = c.c_custkey AND c.c_nationkey = n.n_nationkey AND instr(c_name, '1') > 0 GROUP BY n_name"
#: Scalars of the source's dialect: DECODE, NVL, EXTRACT from an interval, TO_CHAR, INSTR, TRUNC.
_SCALARS = """SELECT o_orderkey, decode(o_orderstatus, 'F', 'final', 'P', 'partial', 'open') AS state, nvl(nullif(o_orderpriority, '5-LOW'), 'none') AS priority, CAST(extract(DAY FROM (o_orderdate - TIMESTAMP_NTZ '1992-01-01 06:00:00')) AS BIGINT) AS days,
  to_char(o_orderdate, 'MM/dd/yyyy HH:mm') AS said, instr(o_orderpriority, '-') AS dash, CAST(trunc(o_orderdate, 'MM') AS STRING) AS month FROM (SELECT o_orderkey, o_orderstatus, o_orderpriority, CAST(o_orderdate AS TIMESTAMP_NTZ) AS o_orderdate FROM {orders}) o"""
_BASE = ("orders", "customer", "nation", "region", "part", "supplier", "lineitem", "events")


def _text(sql):
    def run(spark, d):
        t = records.tables(spark, d)
        return frame(sql, **{n: getattr(t, n) if n in records.STEPS or n == "rec" else table(spark, d, n) for n in ("rec", "ast", "rdb", *_BASE) if "{" + n + "}" in sql})
    return run


STEPS = {"d_attempts": "att", "d_study_history": "stu", "d_author_history": "aut", "d_study_snapshot": "stx", "d_feedback": "fbk", "d_appointments": "app", "d_generations": "gen", "d_transitions": "trn", "d_source_pathways": "pth", "d_retry_context": "ctx",
         "d_readability": "rdb", "d_pairs": "prs", "d_suggestions": "sel"}
QUERIES = {
    **{n: _step(s) for n, s in STEPS.items()},
    "d_field_analysis": _step("ast", *LEFT_OUT),
    "d_completed_fields": _step("fld", *LEFT_OUT),
    "a01_overview": lambda s, d: rounded(quality.overview(records.tables(s, d))),
    **{n: _summary(x, *(_TER if n == "a11_field_adoption" else ())) for group in (ATTEMPTS, FIELDS, CONTEXTS) for n, x in group.items()},
    "a29_quality": lambda s, d: (lambda t: rounded(quality.summary(t.rec, t.ast, t.rdb)))(records.tables(s, d)),
    "a30_findings": lambda s, d: quality.findings(records.tables(s, d).rec),
    "a31_violations": lambda s, d: (lambda t: quality.violations(t.rec, t.ast, t.rdb))(records.tables(s, d)),
    "a31_counts": _text(quality.COUNTS),
    "a32_counters": _text(quality.COUNTERS),
    "f_text_pairs": _text_pairs,
    "f_soft_words": _soft_words,
    "f_comparison": _compared,
    "f_ter": lambda s, d: postedit.analyzed(pairs(s, d), "suggested", "final").select("id", "suggested", "final", "ter_rate", "soft_word_edit_distance"),
    "c_converted": _converted,
    "c_csv_scan": _csv_scan,
    "w_islands": lambda s, d: events.islands(_ev(s, d), 86400),
    "w_lead_over_agg": lambda s, d: events.next_first(_ev(s, d)),
    "s1_login_days": lambda s, d: events.login_days(_ev(s, d)),
    "s2_keep_ends": lambda s, d: told(events.keep_ends(_ev(s, d))),
    "s3_listed": lambda s, d: events.listed(_ev(s, d), "; "),
    "s3_listed_in_order": lambda s, d: events.listed_in_order(_ev(s, d), "; "),
    "s4_participants": lambda s, d: events.participant(table(s, d, "lineitem"), "l_orderkey", F.col("l_returnflag") == "R", F.col("l_returnflag") == "A"),
    "s5_cond_dates": lambda s, d: events.dates(adapters.attempts(s, d)),
    "f_scalars": _text(_SCALARS),
    "j_counts_before": lambda s, d: events.before_completion(adapters.attempts(s, d)),
    "j_range_join": _in_spans,
    "j_semi_union": _text(_SEMI),
    "j_anti_orphans": _orphans,
    "j_left_chain": _text(_CHAIN),
    "j_built_key": _text(_KEYED),
    "j_comma": _text(_COMMA),
    "j_top_one": _top_one,
}
SQL = {
    **{n: told_sql(q) if s in ("att", "stu", "aut", "stx", "gen", "ctx") else q for n, s in STEPS.items() for q in [records.query(f"SELECT * FROM {{{s}}}")]},
    "d_field_analysis": records.query("SELECT * FROM {ast}"),
    "d_completed_fields": _without(records.query("SELECT * FROM {fld}"), "ter_rate", "soft_word_edit_distance", "policy_adjusted_effort_saved"),
    "a01_overview": rounded_sql(records.query(quality.OVERVIEW_SQL)),
    **{n: rounded_sql(_without(x.sql_of(records.query), *(_TER if n == "a11_field_adoption" else ()))) for group in (ATTEMPTS, FIELDS, CONTEXTS) for n, x in group.items()},
    "a29_quality": rounded_sql(records.query(quality.SUMMARY, fix=quality.FIX, hit=quality.affected_text(quality.SQL_FLOATS), fnd=quality.FINDINGS, bad=quality.BAD)),
    "a30_findings": records.query(quality.FINDINGS_OUT, fnd=quality.FINDINGS, bad=quality.BAD),
    "a31_violations": records.query(quality.VIOLATIONS),
    "a31_counts": records.query(quality.COUNTS),
    "a32_counters": records.query(quality.COUNTERS),
    "f_text_pairs": f"""WITH {adapters.PAIRS}, x AS (SELECT *, levenshtein(suggested, final) AS k FROM pr) SELECT id, k AS distance, CASE WHEN k / greatest(length(suggested), length(final), 1)::DOUBLE <= 0.1 THEN 'LIGHT'
 WHEN k / greatest(length(suggested), length(final), 1)::DOUBLE <= 0.3 THEN 'MODERATE' ELSE 'HEAVY' END AS intensity, least(1.0::DOUBLE, greatest(0.0::DOUBLE, 1 - k / nullif(length(final), 0)::DOUBLE)) AS saved,
 len(list_filter(string_split_regex(final, '\\s+'), lambda t: t <> '')) AS n_words, greatest(0, length(final) - k) AS characters_saved FROM x""",
    "f_comparison": f"""WITH {adapters.PAIRS}, x AS (SELECT id, suggested AS s, CASE id % 4 WHEN 0 THEN '' WHEN 1 THEN ' ' || upper(suggested) || '!' WHEN 2 THEN suggested ELSE final || ' more' END AS f FROM pr)
SELECT id, f AS final_text, CASE WHEN trim(f) = '' THEN 'REMOVED' WHEN s = f THEN 'EXACT' WHEN trim(regexp_replace(lower(s), '[^a-z0-9]+', ' ', 'g')) = trim(regexp_replace(lower(f), '[^a-z0-9]+', ' ', 'g')) THEN 'COSMETIC_EQUIVALENT' ELSE 'EDITED' END AS kind,
 CASE WHEN trim(f) <> '' THEN levenshtein(s, f) END AS character_edit_distance, CASE WHEN trim(f) <> '' THEN len(list_filter(string_split(f, ' '), lambda t: t <> '')) END AS final_word_count FROM x""",
    "c_converted": told_sql(records.query(convert.EXPECTED, examples=convert.EXAMPLES)),
    "c_csv_scan": "SELECT doc_id, text, source, n_chars FROM documents",
    "w_islands": """WITH e AS (SELECT *, CASE WHEN epoch(ts) - epoch(lag(ts) OVER w) <= 86400 THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
i AS (SELECT *, CAST(sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS island FROM e) SELECT user_id, island, count(*) AS n, min(event_id) AS first_id FROM i GROUP BY user_id, island""",
    "w_lead_over_agg": """WITH g AS (SELECT user_id, event_type, arg_min(event_id, (ts, event_id)) AS first_id, min(ts) AS t FROM events GROUP BY user_id, event_type)
SELECT user_id, event_type, first_id, lead(first_id) OVER (PARTITION BY user_id ORDER BY t, first_id) AS next_id FROM g""",
    "s1_login_days": "SELECT user_id, count(DISTINCT CAST(ts AS DATE)) AS days, min(event_id) AS lo, max(event_id) AS hi FROM events GROUP BY user_id",
    "s2_keep_ends": told_sql("SELECT user_id, " + ", ".join(f"{f}({c}, (ts, event_id)) AS {n}_{c}" for n, f in (("first", "arg_min"), ("last", "arg_max")) for c in ("event_id", "event_type", "value", "props", "ts")) + " FROM events GROUP BY user_id"),
    "s3_listed": "SELECT user_id, string_agg(DISTINCT event_type, '; ' ORDER BY event_type) AS types FROM events GROUP BY user_id",
    "s3_listed_in_order": "SELECT user_id, count(event_type) AS n, string_agg(event_type, '; ' ORDER BY ts, event_id) AS types FROM events GROUP BY user_id",
    "s4_participants": "SELECT l_orderkey, CASE WHEN bool_or(l_returnflag = 'R') AND bool_or(l_returnflag = 'A') THEN 'Both' WHEN bool_or(l_returnflag = 'R') THEN 'HEALTHY' WHEN bool_or(l_returnflag = 'A') THEN 'CONDITION' END AS participant_type FROM lineitem GROUP BY l_orderkey",
    "s5_cond_dates": f"""{SEQ} SELECT study, CAST(min(start) FILTER (result = 'COMPLETE') AS VARCHAR) AS first_complete, CAST(max(start) FILTER (result = 'COMPLETE') AS VARCHAR) AS last_complete,
 CAST(min(start) FILTER (result = 'USER_DROPPED') AS VARCHAR) AS first_dropped, CAST(max(start) FILTER (result = 'USER_DROPPED') AS VARCHAR) AS last_dropped FROM att GROUP BY study""",
    "f_scalars": """SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'final' WHEN 'P' THEN 'partial' ELSE 'open' END AS state, coalesce(CASE WHEN o_orderpriority <> '5-LOW' THEN o_orderpriority END, 'none') AS priority,
 CAST(trunc((epoch(o_orderdate) - epoch(TIMESTAMP '1992-01-01 06:00:00')) / 86400) AS BIGINT) AS days, strftime(o_orderdate, '%m/%d/%Y %H:%M') AS said, strpos(o_orderpriority, '-') AS dash, strftime(o_orderdate, '%Y-%m-01') AS month FROM orders""",
    "j_counts_before": f"""{SEQ} SELECT id, study, (SELECT count(*) FROM att b WHERE b.study = a.study AND (b.start, b.id) < (a.start, a.id)) AS n_before,
 (SELECT count(*) FROM att b WHERE b.study = a.study AND b.mode = 'AI' AND (b.start, b.id) < (a.start, a.id)) AS ai_before,
 (SELECT arg_max(b.id, (b.start, b.id)) FROM att b WHERE b.study = a.study AND b.result = 'AI_ERROR' AND (b.start, b.id) < (a.start, a.id)) AS last_error FROM att a WHERE result = 'COMPLETE'""",
    "j_range_join": "SELECT l_linenumber, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey AND CAST(l_shipdate AS DATE) BETWEEN CAST(o_orderdate AS DATE) AND CAST(o_orderdate AS DATE) + 30 GROUP BY l_linenumber",
    "j_semi_union": records.query(_SEMI),
    "j_anti_orphans": "SELECT o_orderkey, o_orderstatus FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')",
    "j_left_chain": records.query(_CHAIN),
    "j_built_key": records.query(_KEYED),
    "j_comma": records.query(_COMMA),
    "j_top_one": "SELECT c_custkey, c_name, o_orderkey AS latest_key, o_orderstatus FROM customer JOIN (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders) o ON c_custkey = o_custkey WHERE n = 1",
}
