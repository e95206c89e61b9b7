"""Overview, checks and findings. Fatal checks stop a run before anything is published, so their published rows say 0; the summary of other tables counts what breaks them."""
from pyspark.sql import functions as F

from revisio.functions import readability
from revisio.operators import appointments, fields
from revisio.operators.tables import pct
from revisio.sql import SPARK, frame, spelled
from revisio.stats import union

#: Check, severity, definition, consequence.
_STOP = "Any detected case stops validation and prevents {0}."
CHECKS = (
    ("DUPLICATE_AUDIT_ID", "FATAL", "Audit attempt IDs must be unique and nonmissing.", _STOP.format("publication")),
    ("MISSING_STUDY_NUMBER", "FATAL", "Every audit attempt must have a nonblank study number.", _STOP.format("study-grain analysis")),
    ("MISSING_AUTHOR_USERNAME", "FATAL", "Every audit attempt must have a nonblank attempt-author username.", _STOP.format("author-grain analysis")),
    ("MULTIPLE_COMPLETE_ATTEMPTS_PER_STUDY", "FATAL", "A study may have no more than one completed attempt.", _STOP.format("unique-completion analysis")),
    ("ATTEMPT_AFTER_COMPLETION", "WARNING", "An attempt starts after the same study's unique completed attempt.", "Affected attempts are retained, but study histories require review."),
    ("COMPLETED_ATTEMPT_MISSING_END_TIME", "FATAL", "Every completed attempt must have an end timestamp.", _STOP.format("publication")),
    ("COMPLETED_ATTEMPT_MISSING_CREATED_BY_ID", "FATAL", "Every completed attempt must identify the created-study user.", _STOP.format("publication")),
    ("COMPLETED_ATTEMPT_MISSING_CREATED_DATE", "FATAL", "Every completed attempt must have a created date.", _STOP.format("publication")),
    ("COMPLETED_ATTEMPT_MISSING_STUDY_DEPARTMENT", "FATAL", "Every completed attempt must have a nonblank study department.", _STOP.format("publication")),
    ("COMPLETED_ATTEMPT_CREATOR_MISMATCH", "FATAL", "A completed attempt's USER_ID must equal its CREATED_BY_ID when comparable.", _STOP.format("publication")),
    ("CREATED_BY_ID_VARIES_WITHIN_STUDY", "WARNING", "Nonmissing CREATED_BY_ID values should remain constant within a study.", "Affected studies are retained, but creator-linked interpretation requires review."),
    ("ORPHAN_AI_ASSISTANCE_METRIC_ROW", "FATAL", "Every AI-assistance metric row must reference an existing audit attempt.", _STOP.format("publication")),
    ("ORPHAN_READABILITY_METRIC_ROW", "FATAL", "Every readability metric row must reference an existing audit attempt.", _STOP.format("publication")),
    ("MALFORMED_APPOINTMENT", "WARNING", "Appointment entries must parse as Title:Department:School.", "Malformed entries are excluded from parsed appointment groups."),
    ("NONFINITE_METRIC", "FATAL", "Every nonmissing numeric metric must be finite.", _STOP.format("publication")),
    ("SELECTED_MARKER_INCONSISTENCY", "FATAL", "Readability selected markers must agree with text role and AI picks.", _STOP.format("publication")),
)


def _case(i):
    said = [(k[0], k[i].replace("'", "''")) for k in CHECKS]
    return "CASE name " + " ".join(f"WHEN '{n}' THEN '{v}'" for n, v in said) + " END"


_CASES = {"severity": _case(1), "definition": _case(2), "consequence": _case(3)}

#: Records with a warning, a row each. {bad}: malformed appointments.
FINDINGS = """
WITH late AS (SELECT ID, 'ATTEMPT_AFTER_COMPLETION' AS name, 'ATTEMPT_HISTORY' AS source, CAST(NULL AS INT) AS position, 'ATTEMPT_STARTS_AFTER_UNIQUE_COMPLETION' AS code
  FROM (SELECT ID, START_TIME, max(CASE WHEN ATTEMPT_RESULT = 'COMPLETE' THEN START_TIME END) OVER (PARTITION BY STUDY_NUM) AS done FROM {rec}) x WHERE START_TIME > done),
varied AS (SELECT ID, 'CREATED_BY_ID_VARIES_WITHIN_STUDY' AS name, 'STUDY_CREATOR' AS source, CAST(NULL AS INT) AS position, 'MULTIPLE_NONMISSING_CREATED_BY_IDS_WITHIN_STUDY' AS code
  FROM (SELECT ID, min(CREATED_BY_ID) OVER (PARTITION BY STUDY_NUM) AS lo, max(CREATED_BY_ID) OVER (PARTITION BY STUDY_NUM) AS hi FROM {rec}) x WHERE lo < hi),
odd AS (SELECT DISTINCT audit_record_id AS ID, 'MALFORMED_APPOINTMENT' AS name, appointment_source || '_APPOINTMENT' AS source, appointment_index AS position, 'MALFORMED_APPOINTMENT' AS code FROM {bad})
SELECT f.*, r.STUDY_NUM AS study_num, r.AUTHOR_USER_NAME AS author FROM (SELECT * FROM late UNION ALL SELECT * FROM varied UNION ALL SELECT * FROM odd) f JOIN {rec} r ON f.ID = r.ID"""
BAD = "SELECT audit_record_id, appointment_source, appointment_index FROM {app0} WHERE bad"
FINDINGS_OUT = f"SELECT name AS data_quality_check_name, {_CASES['severity']} AS severity_level, ID AS audit_record_id, study_num, author AS attempt_author_user_name, source AS finding_source, position AS finding_position, code AS finding_detail_code, {_CASES['consequence']} AS analysis_consequence FROM {{fnd}}"
SUMMARY = f"""
WITH n AS (SELECT count(*) AS records, count(CASE WHEN ATTEMPT_RESULT = 'COMPLETE' THEN 1 END) AS done FROM {{rec}}), m AS (SELECT count(DISTINCT record_id) AS assisted FROM {{ast}}), r AS (SELECT count(DISTINCT record_id) AS readable FROM {{rdb}}),
b AS (SELECT count(DISTINCT record_id) AS measured FROM (SELECT record_id FROM {{ast}} UNION SELECT record_id FROM {{rdb}}) u),
f AS (SELECT name AS checked, count(DISTINCT ID) + count(CASE WHEN ID IS NULL THEN 1 END) AS attempts, count(DISTINCT study_num) AS studies, count(DISTINCT author) AS authors FROM {{hit}} GROUP BY name),
c AS (SELECT name, coalesce(attempts, 0) AS attempts, coalesce(studies, 0) AS studies, coalesce(authors, 0) AS authors, CASE WHEN name LIKE 'COMPLETED!_ATTEMPT!_%' ESCAPE '!' THEN (SELECT done FROM n) WHEN name = 'ORPHAN_AI_ASSISTANCE_METRIC_ROW' THEN (SELECT assisted FROM m)
  WHEN name IN ('ORPHAN_READABILITY_METRIC_ROW', 'SELECTED_MARKER_INCONSISTENCY') THEN (SELECT readable FROM r) WHEN name = 'NONFINITE_METRIC' THEN (SELECT measured FROM b) ELSE (SELECT records FROM n) END AS eligible
  FROM (SELECT k.name, f.attempts, f.studies, f.authors FROM {{fix}} k LEFT JOIN f ON k.name = f.checked) x)
SELECT name AS data_quality_check_name, {_CASES['severity']} AS severity_level, attempts AS affected_attempt_count, studies AS affected_distinct_study_count, authors AS affected_distinct_author_count, eligible AS eligible_attempt_count,
  {pct('attempts', 'eligible')} AS affected_attempt_percentage, {_CASES['definition']} AS check_definition, {_CASES['consequence']} AS analysis_consequence FROM c"""
FIX = " UNION ALL ".join(f"SELECT '{k[0]}' AS name" for k in CHECKS)


def raw_findings(records):
    return frame(FINDINGS, rec=records.hint("merge"), bad=appointments.malformed(records))


def findings(records):
    """One row a warning."""
    return frame(FINDINGS_OUT, fnd=raw_findings(records))


def findings_order():
    """By check, record, source, position and code, as findings are published."""
    names = ("ATTEMPT_AFTER_COMPLETION", "CREATED_BY_ID_VARIES_WITHIN_STUDY", "MALFORMED_APPOINTMENT")
    return [F.array_position(F.array(*map(F.lit, names)), F.col("data_quality_check_name")), "audit_record_id", "finding_source", F.asc_nulls_last("finding_position"), "finding_detail_code"]


def affected(records, assistance, readings):
    """A row for each check and attempt that breaks it, warnings and fatal ones. Tables that grow are joined by sorting."""
    return frame(affected_text(ASSIST_FLOATS), fnd=raw_findings(records), rec=records.hint("merge"), ast=assistance.hint("merge"), rdb=readings)


def summary(records, assistance, readings):
    """Every check, with the attempts, studies and authors that break it. Rows without an ID count as an attempt each; metric rows without one, as one attempt."""
    spark = records.sparkSession
    return frame(SUMMARY, rec=records, ast=assistance.select("record_id"), rdb=readings.select("record_id"), hit=affected(records, assistance, readings), fix=spark.sql(FIX))


# --- overview ------------------------------------------------------------------------------

_C, _I = "is_completed_attempt", "NOT is_completed_attempt"
_D = {"a": "All audit attempts.", "c": "All attempts with ATTEMPT_RESULT equal to COMPLETE.", "i": "All attempts with ATTEMPT_RESULT other than COMPLETE.", "s": "All distinct studies represented by at least one attempt.", "d": "All distinct completed studies.",
      "u": "All distinct attempt authors.", "p": "All distinct nonmissing PI_USER_NAME values."}
_AUTHOR = "attempt_author_user_name"
#: Section, table, metric, label, what is counted, denominator (a condition, or null for all rows), definition, note.
OVERVIEW = (
    ("ATTEMPTS", "att", "all_attempt_count", "All attempts", "true", "true", "a", ""), ("ATTEMPTS", "att", "complete_attempt_count", "Completed attempts", _C, "true", "a", ""),
    ("ATTEMPTS", "att", "incomplete_attempt_count", "Incomplete attempts", _I, "true", "a", ""), ("ATTEMPTS", "att", "ai_error_attempt_count", "AI error attempts", "attempt_result = 'AI_ERROR'", _I, "i", ""),
    ("ATTEMPTS", "att", "ai_error_without_stack_trace_attempt_count", "AI errors without stack trace", "attempt_result = 'AI_ERROR_WITHOUT_STACK_TRACE'", _I, "i", ""),
    ("ATTEMPTS", "att", "user_dropped_attempt_count", "User-dropped attempts", "attempt_result = 'USER_DROPPED'", _I, "i", ""),
    ("ATTEMPTS", "att", "completed_ai_attempt_count", "Completed AI attempts", f"{_C} AND attempt_authoring_mode = 'AI'", _C, "c", ""), ("ATTEMPTS", "att", "completed_manual_attempt_count", "Completed manual attempts", f"{_C} AND attempt_authoring_mode = 'MANUAL'", _C, "c", ""),
    ("ATTEMPTS", "att", "incomplete_ai_attempt_count", "Incomplete AI attempts", f"{_I} AND attempt_authoring_mode = 'AI'", _I, "i", ""), ("ATTEMPTS", "att", "incomplete_manual_attempt_count", "Incomplete manual attempts", f"{_I} AND attempt_authoring_mode = 'MANUAL'", _I, "i", ""),
    ("STUDIES", "stu", "distinct_study_count_with_any_attempt", "Distinct studies with any attempt", "true", "true", "s", ""), ("STUDIES", "stu", "distinct_completed_study_count", "Distinct completed studies", "study_is_completed", "true", "s", ""),
    ("STUDIES", "stu", "distinct_study_count_without_completion", "Distinct studies without completion", "NOT study_is_completed", "true", "s", ""), ("STUDIES", "stu", "distinct_study_count_with_any_ai_attempt", "Studies with any AI attempt", "ai_attempt_count > 0", "true", "s", ""),
    ("STUDIES", "stu", "distinct_study_count_with_any_manual_attempt", "Studies with any manual attempt", "manual_attempt_count > 0", "true", "s", ""),
    ("STUDIES", "stu", "distinct_study_count_with_both_ai_and_manual_attempts", "Studies with both AI and manual attempts", "ai_attempt_count > 0 AND manual_attempt_count > 0", "true", "s", ""),
    ("STUDIES", "stu", "distinct_completed_study_count_final_mode_ai", "Completed studies authored with AI", "completed_attempt_authoring_mode = 'AI'", "study_is_completed", "d", ""),
    ("STUDIES", "stu", "distinct_completed_study_count_final_mode_manual", "Completed studies authored manually", "completed_attempt_authoring_mode = 'MANUAL'", "study_is_completed", "d", ""),
    ("STUDIES", "stu", "distinct_completed_study_count_with_preceding_incomplete_attempts", "Completed studies with preceding incomplete attempts", "study_is_completed AND preceding_incomplete_attempt_count > 0", "study_is_completed", "d", ""),
    ("STUDIES", "stu", "distinct_completed_study_count_with_preceding_ai_error_attempts", "Completed studies with preceding AI errors", "study_is_completed AND preceding_ai_error_attempt_count + preceding_ai_error_without_stack_trace_attempt_count > 0", "study_is_completed", "d", ""),
    ("STUDIES", "stu", "distinct_completed_study_count_with_preceding_user_dropped_attempts", "Completed studies with preceding user-dropped attempts", "study_is_completed AND preceding_user_dropped_attempt_count > 0", "study_is_completed", "d", ""),
    *((("AUTHORS", "att", n, label, f"DISTINCT CASE WHEN {c} THEN {_AUTHOR} END", f"DISTINCT {_AUTHOR}", "u", "")) for n, label, c in (
        ("distinct_author_count_with_any_attempt", "Distinct authors with any attempt", "true"), ("distinct_author_count_with_complete_attempt", "Distinct authors with a completed attempt", _C),
        ("distinct_author_count_with_incomplete_attempt", "Distinct authors with an incomplete attempt", _I), ("distinct_author_count_with_any_ai_attempt", "Distinct authors with any AI attempt", "attempt_authoring_mode = 'AI'"),
        ("distinct_author_count_with_any_manual_attempt", "Distinct authors with any manual attempt", "attempt_authoring_mode = 'MANUAL'"), ("distinct_author_count_with_completed_ai_attempt", "Distinct authors with a completed AI attempt", f"{_C} AND attempt_authoring_mode = 'AI'"),
        ("distinct_author_count_with_completed_manual_attempt", "Distinct authors with a completed manual attempt", f"{_C} AND attempt_authoring_mode = 'MANUAL'"))),
    ("AUTHORS", "aut", "distinct_author_count_with_both_ai_and_manual_attempts", "Distinct authors using both AI and manual modes", "author_adoption_group = 'BOTH_AI_AND_MANUAL'", "true", "u", ""),
    ("PI_IDENTITIES", "att", "distinct_named_pi_count", "Distinct named study PIs", "DISTINCT study_pi_user_name", "DISTINCT study_pi_user_name", "p", "Named PIs and attempt authors classified as PI are distinct concepts."),
    ("PI_IDENTITIES", "aut", "distinct_author_count_classified_as_pi", "Distinct attempt authors classified as PI", "author_is_pi_on_any_attempt", "true", "u", "Uses eResearch role, fallback application role, or username match."),
)


def _count(e):
    return f"count({e})" if e.startswith("DISTINCT") else f"count(CASE WHEN {e} THEN 1 END)"


def overview(t):
    """The published counts, one pass over each table."""
    rows = []
    for name in ("att", "stu", "aut"):
        some = [r for r in OVERVIEW if r[1] == name]
        one = getattr(t, name).agg(*[F.expr(_count(r[4])).alias(f"n{i}") for i, r in enumerate(some)], *[F.expr(_count(r[5])).alias(f"d{i}") for i, r in enumerate(some)])
        told = F.array(*[F.struct(F.lit(r[0]).alias("s"), F.lit(r[2]).alias("m"), F.lit(r[3]).alias("l"), F.col(f"n{i}").alias("n"), F.col(f"d{i}").alias("d"), F.lit(_D[r[6]]).alias("w"), F.lit(r[7]).alias("o")) for i, r in enumerate(some)])
        rows.append(one.select(F.explode(told).alias("x")).select("x.*"))
    return union(rows).selectExpr("s AS overview_section_name", "m AS overview_metric_name", "l AS overview_metric_label", "n AS metric_count", "d AS metric_denominator_count", f"{pct('n', 'd')} AS metric_percentage",
                                  "w AS metric_denominator_definition", "o AS metric_notes")


OVERVIEW_SQL = " UNION ALL ".join(
    f"SELECT '{s}' AS overview_section_name, '{m}' AS overview_metric_name, '{label}' AS overview_metric_label, {_count(n)} AS metric_count, {_count(d)} AS metric_denominator_count, {pct(_count(n), _count(d))} AS metric_percentage, '{_D[w]}' AS metric_denominator_definition, '{o}' AS metric_notes FROM {{{table}}}"
    for s, table, m, label, n, d, w, o in OVERVIEW)

# --- validation ----------------------------------------------------------------------------

_DONE = "ATTEMPT_RESULT = 'COMPLETE'"
RECORD_RULES = {"null_ids": "ID IS NULL", "missing_studies": "coalesce(@blank(STUDY_NUM), true)", "missing_authors": "coalesce(@blank(AUTHOR_USER_NAME), true)", "unsupported_modes": "coalesce(ATTEMPT_TYPE NOT IN ('AI', 'MANUAL'), true)",
                "missing_results": "coalesce(@blank(ATTEMPT_RESULT), true)", "completed_without_end": f"{_DONE} AND END_TIME IS NULL", "completed_without_creator": f"{_DONE} AND CREATED_BY_ID IS NULL",
                "completed_without_date": f"{_DONE} AND CREATED_DATE IS NULL", "completed_without_department": f"{_DONE} AND coalesce(@blank(STUDY_DEPARTMENT), true)", "creator_mismatches": f"{_DONE} AND USER_ID <> CREATED_BY_ID"}
ASSIST_RULES = {"missing_field_names": "coalesce(@blank(field_name), true)", "unsupported_analysis_types": "coalesce(analysis_type NOT IN ('TEXT', 'COMPENSATION', 'LOOKUP'), true)",
                "unsupported_match_types": "coalesce(match_type NOT IN ('EXACT', 'COSMETIC_EQUIVALENT', 'EDITED', 'REMOVED', 'UNASSISTED'), true)",
                "assisted_without_pick": "analysis_type IN ('TEXT', 'COMPENSATION') AND match_type <> 'UNASSISTED' AND (picked_kind IS NULL OR picked_index IS NULL)",
                "unassisted_with_pick": "analysis_type IN ('TEXT', 'COMPENSATION') AND match_type = 'UNASSISTED' AND (picked_kind IS NOT NULL OR picked_index IS NOT NULL)", "negative_indices": "picked_index < 0",
                "lookups_with_pick": "analysis_type = 'LOOKUP' AND (picked_kind IS NOT NULL OR picked_index IS NOT NULL)"}
#: Metrics that must be finite where they are there.
ASSIST_FLOATS = tuple(c for c in fields.FLATTENED if "effort_saved" in c or c in ("ter_rate", "soft_word_edit_distance", "lookup_similarity"))


def nonfinite(columns):
    return " OR ".join(f"coalesce(isnan({c}) OR abs({c}) = CAST('Infinity' AS DOUBLE), false)" for c in columns)


READ_RULES = {"unsupported_roles": "coalesce(text_role NOT IN ('SUGGESTED', 'FINAL'), true)", "suggested_without_marker": "text_role = 'SUGGESTED' AND selected IS NULL", "final_with_marker": "text_role = 'FINAL' AND selected IS NOT NULL",
              "nonfinite": nonfinite(readability.FLOATS)}
#: Metrics of the assistance rows that SQL gives.
SQL_FLOATS = tuple(c for c in ASSIST_FLOATS if not c.startswith(("ter", "soft", "policy")))

#: Fatal checks that a record breaks by itself, and those that an attempt's metric rows break.
_OWN = {"DUPLICATE_AUDIT_ID": "null_ids", "MISSING_STUDY_NUMBER": "missing_studies", "MISSING_AUTHOR_USERNAME": "missing_authors", "COMPLETED_ATTEMPT_MISSING_END_TIME": "completed_without_end",
        "COMPLETED_ATTEMPT_MISSING_CREATED_BY_ID": "completed_without_creator", "COMPLETED_ATTEMPT_MISSING_CREATED_DATE": "completed_without_date",
        "COMPLETED_ATTEMPT_MISSING_STUDY_DEPARTMENT": "completed_without_department", "COMPLETED_ATTEMPT_CREATOR_MISMATCH": "creator_mismatches"}
_OWN = {name: RECORD_RULES[rule] for name, rule in _OWN.items()}
_MET = {"ORPHAN_AI_ASSISTANCE_METRIC_ROW": "assisted = 1 AND known IS NULL", "ORPHAN_READABILITY_METRIC_ROW": "readable = 1 AND known IS NULL", "NONFINITE_METRIC": "odd = 1",
        "SELECTED_MARKER_INCONSISTENCY": "off = 1 OR chosen = 1 AND NOT coalesce(mode = 'AI' AND result = 'COMPLETE', false)"}
_WHO = "STUDY_NUM AS study_num, AUTHOR_USER_NAME AS author"


def _each(rules):
    """A row for each rule that holds, named; other rules give a null. To be asked of rows for which _some holds."""
    return "@each(@list(" + ", ".join(f"CASE WHEN {e} THEN '{n}' END" for n, e in rules.items()) + "))"


def _some(rules):
    return " OR ".join(f"({e})" for e in rules.values())


def _flag(e):
    return f"CASE WHEN {e} THEN 1 ELSE 0 END"


def affected_text(floats):
    """name, ID, study_num and author of what breaks a check. A marker belongs to suggested texts alone, to one of a field at most, and to the one that the completed AI attempt picked."""
    return f"""
WITH own AS (SELECT ID, {_WHO}, {_each(_OWN)} AS name FROM {{rec}} WHERE {_some(_OWN)}),
twice AS (SELECT ID, study_num, author, 'DUPLICATE_AUDIT_ID' AS name FROM (SELECT ID, {_WHO}, count(*) OVER (PARTITION BY ID) AS n FROM {{rec}} WHERE ID IS NOT NULL) x WHERE n > 1),
again AS (SELECT ID, study_num, author, 'MULTIPLE_COMPLETE_ATTEMPTS_PER_STUDY' AS name FROM (SELECT ID, {_WHO}, count(*) OVER (PARTITION BY STUDY_NUM) AS n FROM {{rec}} WHERE {_DONE}) x WHERE n > 1),
unlike AS (SELECT m.record_id FROM {{rdb}} m LEFT JOIN {{ast}} a ON m.record_id = a.record_id AND m.field_name = a.field_name WHERE m.selected AND NOT coalesce(m.suggestion_kind = a.picked_kind AND m.suggestion_index = a.picked_index, false)
  UNION ALL SELECT record_id FROM {{rdb}} WHERE selected GROUP BY record_id, field_name HAVING count(*) > 1),
met AS (SELECT record_id, 1 AS assisted, 0 AS readable, 0 AS chosen, {_flag(nonfinite(floats))} AS odd, 0 AS off FROM {{ast}}
  UNION ALL SELECT record_id, 0, 1, {_flag("selected")}, {_flag(READ_RULES["nonfinite"])}, {_flag("coalesce(text_role = 'SUGGESTED', false) = (selected IS NULL)")} FROM {{rdb}} UNION ALL SELECT record_id, 0, 0, 0, 0, 1 FROM unlike),
per AS (SELECT record_id, max(assisted) AS assisted, max(readable) AS readable, max(chosen) AS chosen, max(odd) AS odd, max(off) AS off FROM met GROUP BY record_id),
held AS (SELECT p.*, r.ID AS known, STUDY_NUM AS study_num, AUTHOR_USER_NAME AS author, ATTEMPT_TYPE AS mode, ATTEMPT_RESULT AS result FROM per p LEFT JOIN {{rec}} r ON p.record_id = r.ID),
told AS (SELECT record_id AS ID, study_num, author, {_each(_MET)} AS name FROM held WHERE {_some(_MET)})
SELECT name, ID, study_num, author FROM {{fnd}} UNION ALL SELECT name, ID, study_num, author FROM own WHERE name IS NOT NULL UNION ALL SELECT name, ID, study_num, author FROM twice UNION ALL SELECT name, ID, study_num, author FROM again
UNION ALL SELECT name, ID, study_num, author FROM told WHERE name IS NOT NULL"""


def _rules(table, rules, prefix):
    return " UNION ALL ".join(f"SELECT '{prefix}{n}' AS rule, count(CASE WHEN {e} THEN 1 END) AS n FROM {{{table}}}" for n, e in rules.items())


def _twice(table, name, keys, where="true"):
    return f"SELECT '{name}' AS rule, coalesce(CAST(sum(CASE WHEN n > 1 THEN n ELSE 0 END) AS BIGINT), 0) AS n FROM (SELECT count(*) AS n FROM {{{table}}} WHERE {where} GROUP BY {keys}) q{name}"


#: Every rule by itself, as plain SQL: what violations() counts in one pass.
VIOLATIONS = " UNION ALL ".join([
    _rules("rec", RECORD_RULES, ""), _twice("rec", "repeated_ids", "ID"), f"SELECT 'completed_twice' AS rule, count(*) AS n FROM (SELECT STUDY_NUM FROM {{rec}} WHERE {_DONE} GROUP BY STUDY_NUM HAVING count(*) > 1) q",
    _rules("ast", ASSIST_RULES | {"nonfinite": nonfinite(c for c in ASSIST_FLOATS if not c.startswith(("ter", "soft", "policy")))}, "assistance_"), _twice("ast", "assistance_repeated", "record_id, field_name"),
    "SELECT 'assistance_orphans' AS rule, count(DISTINCT m.record_id) AS n FROM {ast} m LEFT JOIN {rec} r ON m.record_id = r.ID WHERE r.ID IS NULL",
    "SELECT 'assistance_not_completed_ai' AS rule, count(*) AS n FROM {ast} m LEFT JOIN {rec} r ON m.record_id = r.ID WHERE NOT coalesce(r.ATTEMPT_TYPE = 'AI' AND r.ATTEMPT_RESULT = 'COMPLETE', false)",
    _rules("rdb", READ_RULES, "readability_"), _twice("rdb", "readability_repeated", "record_id, field_name, text_role, suggestion_kind, suggestion_index"), _twice("rdb", "readability_two_finals", "record_id, field_name", "text_role = 'FINAL'"),
    _twice("rdb", "readability_two_selected", "record_id, field_name", "selected"), "SELECT 'readability_orphans' AS rule, count(DISTINCT m.record_id) AS n FROM {rdb} m LEFT JOIN {rec} r ON m.record_id = r.ID WHERE r.ID IS NULL",
    "SELECT 'readability_not_completed' AS rule, count(*) AS n FROM {rdb} m LEFT JOIN {rec} r ON m.record_id = r.ID WHERE NOT coalesce(r.ATTEMPT_RESULT = 'COMPLETE' AND r.ATTEMPT_TYPE = m.attempt_type, false)",
    "SELECT 'selected_not_picked' AS rule, count(*) AS n FROM {rdb} m LEFT JOIN {ast} a ON m.record_id = a.record_id AND m.field_name = a.field_name WHERE m.selected AND NOT coalesce(m.suggestion_kind = a.picked_kind AND m.suggestion_index = a.picked_index, false)"])
COUNTS = """SELECT count(*) AS record_attempt_count, count(DISTINCT STUDY_NUM) AS distinct_study_count, count(CASE WHEN ATTEMPT_RESULT = 'COMPLETE' THEN 1 END) AS completed_attempt_count,
  count(CASE WHEN NOT ATTEMPT_RESULT = 'COMPLETE' THEN 1 END) AS incomplete_attempt_count, (SELECT count(*) FROM {ast}) AS ai_assistance_metric_row_count, (SELECT count(*) FROM {rdb}) AS readability_metric_row_count FROM {rec}"""
#: Counters of a report run.
COUNTERS = """SELECT count(*) AS source_row_count, count(CASE WHEN ATTEMPT_TYPE = 'AI' AND ATTEMPT_RESULT = 'COMPLETE' THEN 1 END) AS analyzed_row_count,
  count(CASE WHEN NOT (ATTEMPT_TYPE = 'AI' AND ATTEMPT_RESULT = 'COMPLETE') THEN 1 END) AS skipped_row_count, (SELECT count(*) FROM {ast}) AS ai_assistance_row_count, (SELECT count(*) FROM {rdb}) AS readability_row_count FROM {rec}"""


def _flags(rules):
    return [F.expr(spelled(e, SPARK)).cast("boolean") for e in rules.values()]


def violations(records, assistance, readings):
    """Counts of all rules: one pass over each table.

    Rows of the three tables become slim rows with a key and what they count for. Groups shrink step by
    step, each pre-aggregated before its shuffle: rows of one text, of one (record, field), of one record or study. What a
    join of two tables would count follows from the numbers on its two sides."""
    done = F.coalesce(F.col("ATTEMPT_RESULT") == "COMPLETE", F.lit(False))
    none, one = F.lit(None).cast("string"), F.lit(1).cast("long")
    zero = F.lit(0).cast("long")

    names = [*_names(RECORD_RULES, ""), *_names(ASSIST_RULES | {"nonfinite": ""}, "assistance_"), *_names(READ_RULES, "readability_")]
    keys = ("id", "study", "field", "role", "kind", "index")

    def slim(rule=F.lit(None), hits=zero, **k):
        """A slim row: keys, null where not given, and counts, zero where not given."""
        other = lambda n: F.lit(None).cast("long") if n in ("id", "index") else none if n in keys else zero
        return F.struct(*[k.get(n, other(n)).alias(n) for n in (*keys, "record", "ai", "assist", "read", "final", "chosen", "left", "right", "done")], rule.cast("int").alias("rule"), hits.alias("hits"))

    def rows(df, prefix, rules, *kinds):
        """df's rows as often as they count for something, and a row for each rule of its own that one breaks: most break none, and so carry nothing of the rules."""
        broken = F.filter(F.array(*[F.when(e, F.lit(names.index(n))) for n, e in zip(_names(rules, prefix), _flags(rules))]), lambda r: r.isNotNull())
        rest = [F.filter(F.array(*[slim(**k) for k in kinds[1:]]), lambda k: (k["done"] > 0) | (k["left"] > 0) | (k["right"] > 0))] if kinds[1:] else []
        return df.select(F.explode(F.concat(F.array(slim(**kinds[0])), *rest, F.transform(broken, lambda r: slim(r, one)))).alias("k")).select("k.*")

    count = lambda c: F.coalesce(c, F.lit(False)).cast("long")
    #: a field's name that no field has: there, what matches is the mode of a record and its readings
    mode = F.lit("\u0000")
    rec = rows(records, "", RECORD_RULES,
               {"id": F.col("ID"), "record": one, "ai": count(done & (F.col("ATTEMPT_TYPE") == "AI"))},
               {"study": F.col("STUDY_NUM"), "role": F.lit("study"), "done": count(done)},
               {"id": F.col("ID"), "field": mode, "kind": F.col("ATTEMPT_TYPE"), "index": zero, "right": count(done)})
    ast = rows(assistance, "assistance_", ASSIST_RULES | {"nonfinite": nonfinite(ASSIST_FLOATS)},
               {"id": F.col("record_id"), "field": F.col("field_name"), "kind": F.col("picked_kind"), "index": F.col("picked_index").cast("long"), "role": F.lit("a"), "assist": one, "right": count(F.lit(True))})
    rdb = rows(readings, "readability_", READ_RULES,
               {"id": F.col("record_id"), "field": F.col("field_name"), "role": F.concat(F.lit("r"), F.col("text_role")), "kind": F.col("suggestion_kind"), "index": F.col("suggestion_index").cast("long"), "read": one,
                "final": count(F.col("text_role") == "FINAL"), "chosen": count(F.col("selected")), "left": count(F.col("selected"))},
               {"id": F.col("record_id"), "field": mode, "kind": F.col("attempt_type"), "index": zero, "left": one})
    u = union([rec, ast, rdb])
    sums = lambda *cs: [F.sum(c).alias(c) for c in (*cs, "hits")]
    several = lambda c: F.when(F.col(c) > 1, F.col(c)).otherwise(0)
    # rows of one text
    g = u.groupBy("rule", "id", "study", "field", "kind", "index", "role").agg(*sums("record", "ai", "assist", "read", "final", "chosen", "left", "right", "done"))
    g = g.withColumn("alike", several("read"))
    # rows that one pick, or one mode, matches
    g = g.groupBy("rule", "id", "study", "field", "kind", "index").agg(*sums("record", "ai", "assist", "read", "final", "chosen", "left", "right", "done", "alike"))
    match = F.col("id").isNotNull() & F.col("field").isNotNull() & F.col("kind").isNotNull() & F.col("index").isNotNull()
    g = g.withColumn("met", F.when(match, F.col("left") * F.col("right")).otherwise(0))
    # rows of one field of a record
    g = g.groupBy("rule", "id", "study", "field").agg(*sums("record", "ai", "assist", "read", "final", "chosen", "left", "right", "done", "alike", "met"))
    own = F.coalesce(F.col("field") != mode, F.lit(False))
    both = F.when(own & F.col("id").isNotNull(), F.greatest(F.col("assist"), F.lit(1))).otherwise(1)
    g = g.withColumns({"twice": several("assist"), "finals": several("final"), "picked": several("chosen"), "missed": F.when(F.coalesce(F.col("field") == mode, F.lit(False)), 0).otherwise(F.col("chosen") * both - F.col("met")),
                       "fits": F.when(F.coalesce(F.col("field") == mode, F.lit(False)), F.col("met")).otherwise(0)})
    # rows of one record, or of one study
    g = g.groupBy("rule", "id", "study").agg(*sums("record", "ai", "assist", "read", "done", "alike", "twice", "finals", "picked", "missed", "fits"))
    known, owned = F.col("id").isNotNull(), F.when(F.col("id").isNotNull(), F.greatest(F.col("record"), F.lit(1))).otherwise(1)
    orphan = lambda c: F.when(known & (F.col(c) > 0) & (F.col("record") == 0), 1).otherwise(0)
    out = {**{n: F.when(F.col("rule") == i, F.col("hits")) for i, n in enumerate(names)}, "repeated_ids": several("record"), "completed_twice": F.when(F.col("done") > 1, 1).otherwise(0), "assistance_repeated": F.col("twice"), "assistance_orphans": orphan("assist"),
           "assistance_not_completed_ai": F.col("assist") * owned - F.when(known, F.col("assist") * F.col("ai")).otherwise(0), "readability_repeated": F.col("alike"), "readability_two_finals": F.col("finals"), "readability_two_selected": F.col("picked"),
           "readability_orphans": orphan("read"), "readability_not_completed": F.col("read") * owned - F.col("fits"), "selected_not_picked": F.col("missed")}
    total = g.agg(*[F.coalesce(F.sum(e), F.lit(0)).cast("long").alias(n) for n, e in out.items()])
    return total.select(F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.col(n).alias("n")) for n in out])).alias("x")).select("x.*")


def _names(rules, prefix):
    return [f"{prefix}{n}" for n in rules]


def check(records, assistance, readings):
    """Raises with the rules that are broken and how often; tells nothing of the texts."""
    bad = {r.rule: r.n for r in violations(records, assistance, readings).where("n > 0").collect()}
    if bad:
        raise ValueError("report breaks rules: " + ", ".join(f"{k} {v}" for k, v in sorted(bad.items())))
    return frame(COUNTS, rec=records, ast=assistance, rdb=readings).first().asDict()
