"""How each study was tried again, up to its completion, or over all its attempts if it has none."""
from pyspark.sql import functions as F

from revisio.sql import frame

#: Categories in order, with the state and mode they imply.
CATEGORIES = (
    ("SINGLE_ATTEMPT_AI_COMPLETION", "COMPLETED", "AI"), ("SINGLE_ATTEMPT_MANUAL_COMPLETION", "COMPLETED", "MANUAL"),
    ("REPEATED_AI_ONLY_TO_AI_COMPLETION", "COMPLETED", "AI"), ("REPEATED_MANUAL_ONLY_TO_MANUAL_COMPLETION", "COMPLETED", "MANUAL"),
    ("AI_TO_MANUAL_COMPLETION", "COMPLETED", "MANUAL"), ("MANUAL_TO_AI_COMPLETION", "COMPLETED", "AI"),
    ("MIXED_OR_ALTERNATING_TO_AI_COMPLETION", "COMPLETED", "AI"), ("MIXED_OR_ALTERNATING_TO_MANUAL_COMPLETION", "COMPLETED", "MANUAL"),
    ("SINGLE_ATTEMPT_AI_NO_COMPLETION_OBSERVED", "NO_COMPLETION_OBSERVED", "AI"), ("SINGLE_ATTEMPT_MANUAL_NO_COMPLETION_OBSERVED", "NO_COMPLETION_OBSERVED", "MANUAL"),
    ("REPEATED_AI_ONLY_NO_COMPLETION_OBSERVED", "NO_COMPLETION_OBSERVED", "AI"), ("REPEATED_MANUAL_ONLY_NO_COMPLETION_OBSERVED", "NO_COMPLETION_OBSERVED", "MANUAL"),
    ("MIXED_MODES_NO_COMPLETION_OBSERVED", "NO_COMPLETION_OBSERVED", "MIXED"),
)
_W = "(PARTITION BY study_num ORDER BY attempt_start_timestamp NULLS LAST, audit_record_id)"
_SOME = ("source_size", "reported_source", "input_method", "source_signature")
CATEGORY = """CASE WHEN n = 1 THEN 'SINGLE_ATTEMPT_' || last_mode || CASE WHEN done THEN '_COMPLETION' ELSE '_NO_COMPLETION_OBSERVED' END
  WHEN NOT done THEN CASE WHEN manuals = 0 THEN 'REPEATED_AI_ONLY_NO_COMPLETION_OBSERVED' WHEN ais = 0 THEN 'REPEATED_MANUAL_ONLY_NO_COMPLETION_OBSERVED' ELSE 'MIXED_MODES_NO_COMPLETION_OBSERVED' END
  WHEN manuals = 0 THEN 'REPEATED_AI_ONLY_TO_AI_COMPLETION' WHEN ais = 0 THEN 'REPEATED_MANUAL_ONLY_TO_MANUAL_COMPLETION' WHEN turns = 1 THEN first_mode || '_TO_' || last_mode || '_COMPLETION'
  ELSE 'MIXED_OR_ALTERNATING_TO_' || last_mode || '_COMPLETION' END"""
#: {cut} is the time of the report's run.
CONTEXT = f"""
WITH x AS (SELECT *, lag(attempt_authoring_mode) OVER {_W} AS p_mode, row_number() OVER {_W} AS nth,
  coalesce(max(CASE WHEN is_completed_attempt THEN 1 ELSE 0 END) OVER (PARTITION BY study_num ORDER BY attempt_start_timestamp NULLS LAST, audit_record_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS over FROM {{att}}),
a AS (SELECT *, count(*) OVER (PARTITION BY study_num) AS size FROM x WHERE over = 0),
t AS (SELECT a.study_num, count(*) AS transitions, {', '.join(f"bool_or({c}_comparison IN ('SAME', 'CHANGED')) AS {c}_ok, bool_or({c}_comparison = 'CHANGED') AS {c}_new" for c in _SOME)}
  FROM {{trn}} t JOIN a ON t.study_num = a.study_num AND t.current_audit_record_id = a.audit_record_id GROUP BY a.study_num),
g AS (SELECT a.study_num, count(*) AS returned FROM {{gen}} g JOIN a ON g.study_num = a.study_num AND g.audit_record_id = a.audit_record_id GROUP BY a.study_num),
f AS (SELECT study_num, count(DISTINCT audit_record_id) AS feedback FROM {{fbk}} WHERE feedback_recorded GROUP BY study_num),
s AS (SELECT study_num, count(*) AS n, count(CASE WHEN attempt_authoring_mode = 'AI' THEN 1 END) AS ais, count(CASE WHEN attempt_authoring_mode = 'MANUAL' THEN 1 END) AS manuals,
  max(CASE WHEN nth = 1 THEN attempt_authoring_mode END) AS first_mode, max(CASE WHEN nth = size THEN attempt_authoring_mode END) AS last_mode, bool_or(is_completed_attempt) AS done,
  count(CASE WHEN attempt_authoring_mode <> p_mode THEN 1 END) AS turns, count(DISTINCT attempt_author_user_name) AS authors, count(CASE WHEN attempt_result IN ('AI_ERROR', 'AI_ERROR_WITHOUT_STACK_TRACE') THEN 1 END) AS errors,
  count(CASE WHEN attempt_result = 'USER_DROPPED' THEN 1 END) AS drops, max(CASE WHEN nth = 1 THEN attempt_start_timestamp END) AS first_at, max(CASE WHEN nth = size THEN attempt_start_timestamp END) AS last_at,
  max(CASE WHEN is_completed_attempt THEN attempt_end_timestamp END) AS done_at FROM a GROUP BY study_num)
SELECT s.study_num, {CATEGORY} AS pathway_category, CASE WHEN done THEN 'COMPLETED' ELSE 'NO_COMPLETION_OBSERVED' END AS completion_state, CASE WHEN n = 1 THEN 'SINGLE_ATTEMPT' ELSE 'MULTIPLE_ATTEMPTS' END AS attempt_frequency,
  n AS all_attempt_count, ais AS ai_attempt_count, manuals AS manual_attempt_count, CASE WHEN ais > 0 AND manuals > 0 THEN 'BOTH' WHEN ais > 0 THEN 'AI_ONLY' ELSE 'MANUAL_ONLY' END AS mode_exposure,
  first_mode, last_mode AS final_or_latest_mode, turns AS mode_transition_count, turns > 0 AS mode_changed, authors AS distinct_author_count, authors > 1 AS author_changed, errors AS ai_error_attempt_count, errors > 0 AS has_ai_error,
  drops AS user_dropped_attempt_count, drops > 0 AS has_user_dropped_attempt, coalesce(returned, 0) AS returned_result_ai_attempt_count, coalesce(returned, 0) > 0 AS has_returned_result_ai,
  coalesce(transitions, 0) > 0 AS source_comparison_eligible, {', '.join(f'coalesce({c}_ok, false) AS {c}_comparison_eligible' for c in _SOME)}, {', '.join(f'coalesce({c}_new, false) AS any_{c}_change' for c in _SOME)},
  coalesce(feedback, 0) AS ai_feedback_record_count, coalesce(feedback, 0) > 0 AS feedback_recorded_on_any_ai_attempt, first_at AS first_attempt_timestamp, last_at AS latest_observed_attempt_timestamp,
  done_at AS completed_timestamp, CASE WHEN NOT done THEN {{cut}} END AS report_run_cutoff_timestamp, @us(first_at, done_at) / 6.0E7 AS minutes_first_attempt_to_completion,
  CASE WHEN NOT done THEN @us(first_at, last_at) / 6.0E7 END AS minutes_first_attempt_to_last_observed_attempt, CASE WHEN NOT done THEN @us(last_at, {{cut}}) / 6.0E7 END AS minutes_latest_attempt_to_report_run_cutoff,
  CASE WHEN NOT done THEN @us(first_at, {{cut}}) / 6.0E7 END AS minutes_first_attempt_to_report_run_cutoff
FROM s LEFT JOIN t ON s.study_num = t.study_num LEFT JOIN g ON s.study_num = g.study_num LEFT JOIN f ON s.study_num = f.study_num"""
#: Columns of attempts that CONTEXT speaks of.
_TAKEN = ("study_num", "audit_record_id", "attempt_start_timestamp", "attempt_end_timestamp", "attempt_authoring_mode", "attempt_result", "is_completed_attempt", "attempt_author_user_name")
ZONE = "America/Detroit"


def local(t, zone=ZONE):
    """A local time as UTC; a time that the clock skips or shows twice fails."""
    utc = F.to_utc_timestamp(t, zone)
    back, later = F.from_utc_timestamp(utc, zone), F.from_utc_timestamp(F.timestamp_add("HOUR", F.lit(1), utc), zone)
    earlier = F.from_utc_timestamp(F.timestamp_add("HOUR", F.lit(-1), utc), zone)
    bad = (back != t) | (later == t) | (earlier == t)
    return F.when(bad, F.raise_error(F.lit(f"a time is ambiguous or nonexistent in {zone}")).cast("timestamp")).otherwise(utc)


def context(att, gen, trn, feedback, cutoff=None, zone=ZONE):
    """One row a study. cutoff: the UTC time of the report's run as text, for studies without a completion; minutes to it are null without one. Attempts' times are local to the zone."""
    c = frame(CONTEXT.replace("{cut}", "CAST(NULL AS TIMESTAMP_NTZ)" if cutoff is None else f"TIMESTAMP_NTZ '{cutoff}'"), kept=("a",), att=att.select(*_TAKEN), gen=gen, trn=trn, fbk=feedback)
    if cutoff is None or zone == "UTC":
        return c
    for name, start in (("minutes_latest_attempt_to_report_run_cutoff", "latest_observed_attempt_timestamp"), ("minutes_first_attempt_to_report_run_cutoff", "first_attempt_timestamp")):
        at = local(F.col(start).cast("timestamp"), zone)
        c = c.withColumn(name, F.when(F.col("report_run_cutoff_timestamp").isNotNull(), (F.unix_micros(F.lit(cutoff).cast("timestamp")) - F.unix_micros(at)) / F.lit(6e7)))
    return c
