"""Histories of attempts, studies and authors from audit records.

Records need unique ids, studies and authors, and one COMPLETE attempt a study at most (see checks). Attempts of a study
are in order of start, nulls last, then id. An attempt precedes the completion if it starts strictly earlier."""
from revisio.sql import frame

_ORDER = "(PARTITION BY STUDY_NUM ORDER BY START_TIME NULLS LAST, ID)"
ATTEMPTS = f"""
WITH x AS (SELECT *, row_number() OVER {_ORDER} AS seq, lag(AUTHOR_USER_NAME) OVER {_ORDER} AS earlier_author, ATTEMPT_RESULT = 'COMPLETE' AS done,
  max(CASE WHEN ATTEMPT_RESULT = 'COMPLETE' THEN START_TIME END) OVER (PARTITION BY STUDY_NUM) AS done_start,
  max(CASE WHEN ATTEMPT_RESULT = 'COMPLETE' THEN AUTHOR_USER_NAME END) OVER (PARTITION BY STUDY_NUM) AS done_author,
  max(CASE WHEN ATTEMPT_RESULT = 'COMPLETE' THEN USER_ID END) OVER (PARTITION BY STUDY_NUM) AS done_user,
  coalesce(AUTHOR_ERESEARCH_ROLE = 'PI', false) AS pi_role, coalesce(AUTHOR_ERESEARCH_ROLE IS NULL AND AUTHOR_STUDY_TEAM_ROLE = 'PRINCIPAL_INVESTIGATOR', false) AS pi_application,
  coalesce(AUTHOR_USER_NAME = PI_USER_NAME, false) AS pi_named FROM {{rec}})
SELECT STUDY_NUM AS study_num, seq AS attempt_sequence_number, ID AS audit_record_id, START_TIME AS attempt_start_timestamp, END_TIME AS attempt_end_timestamp,
  ATTEMPT_TYPE AS attempt_authoring_mode, ATTEMPT_RESULT AS attempt_result, CASE WHEN done THEN 'COMPLETE' ELSE 'INCOMPLETE' END AS attempt_completion_group,
  AUTHOR_USER_NAME AS attempt_author_user_name, USER_ID AS attempt_author_user_id, CREATED_BY_ID AS study_created_by_user_id, done_author AS completion_author_user_name,
  done_user AS completion_author_user_id, PI_USER_NAME AS study_pi_user_name,
  CASE WHEN NOT @blank(AUTHOR_ERESEARCH_ROLE) THEN AUTHOR_ERESEARCH_ROLE WHEN NOT @blank(AUTHOR_STUDY_TEAM_ROLE) THEN AUTHOR_STUDY_TEAM_ROLE ELSE 'UNKNOWN' END AS effective_attempt_author_role,
  pi_role AS author_is_pi_by_eresearch_role, pi_application AS author_is_pi_by_application_role, pi_named AS author_matches_named_pi_user_name,
  pi_role OR pi_application OR pi_named AS attempt_author_is_study_pi, coalesce(AUTHOR_USER_NAME = done_author, false) AS same_author_as_completion_attempt,
  coalesce(AUTHOR_USER_NAME <> earlier_author, false) AS author_changed_from_previous_attempt, AUTHOR_APPOINTMENTS AS author_appointments_raw, PI_APPOINTMENTS AS pi_appointments_raw,
  PRIOR_CREATED_COUNT AS prior_studies_created_before_attempt_start_count, TOTAL_CREATED_COUNT AS total_studies_created_as_of_report_query_count,
  MEMBER_OF_OTHER_STUDIES_COUNT AS other_study_memberships_as_of_report_query_count, LOGIN_DAYS AS distinct_login_days_as_of_report_query_count,
  MIN_LOGIN_TIME AS first_login_timestamp_as_of_report_query, MAX_LOGIN_TIME AS latest_login_timestamp_as_of_report_query,
  @us(MIN_LOGIN_TIME, MAX_LOGIN_TIME) / 8.64E10 AS login_history_span_days_as_of_report_query, TIME_SPENT_ON_STUDY_INFO_PAGE_MS / 6.0E4 AS study_info_page_minutes,
  TIME_TO_FINISH_ADDING_STUDY_MS / 6.0E4 AS total_attempt_duration_minutes, coalesce(NOT done AND START_TIME < done_start, false) AS is_preceding_incomplete_attempt, done AS is_completed_attempt
FROM x"""

_FIRST = "max(CASE WHEN attempt_sequence_number = 1 THEN {0} END)"
_DONE = "max(CASE WHEN is_completed_attempt THEN {0} END)"
_BEFORE = "count(CASE WHEN is_preceding_incomplete_attempt AND {0} THEN 1 END)"
STUDIES = f"""
WITH x AS (SELECT *, max(CASE WHEN is_preceding_incomplete_attempt THEN attempt_sequence_number END) OVER (PARTITION BY study_num) AS last_before,
  max(CASE WHEN is_completed_attempt THEN attempt_start_timestamp END) OVER (PARTITION BY study_num) AS done_start,
  min(CASE WHEN attempt_sequence_number = 1 THEN attempt_start_timestamp END) OVER (PARTITION BY study_num) AS first_start FROM {{att}})
SELECT study_num, {_FIRST.format('study_created_by_user_id')} AS study_created_by_user_id, {_FIRST.format('study_pi_user_name')} AS study_pi_user_name, bool_or(is_completed_attempt) AS study_is_completed,
  count(*) AS all_attempt_count, count(CASE WHEN attempt_authoring_mode = 'AI' THEN 1 END) AS ai_attempt_count, count(CASE WHEN attempt_authoring_mode = 'MANUAL' THEN 1 END) AS manual_attempt_count,
  count(CASE WHEN is_completed_attempt THEN 1 END) AS complete_attempt_count, count(CASE WHEN NOT is_completed_attempt THEN 1 END) AS incomplete_attempt_count,
  count(CASE WHEN attempt_result = 'AI_ERROR' THEN 1 END) AS ai_error_attempt_count, count(CASE WHEN attempt_result = 'AI_ERROR_WITHOUT_STACK_TRACE' THEN 1 END) AS ai_error_without_stack_trace_attempt_count,
  count(CASE WHEN attempt_result = 'USER_DROPPED' THEN 1 END) AS user_dropped_attempt_count, {_FIRST.format('audit_record_id')} AS first_attempt_audit_record_id,
  {_FIRST.format('attempt_author_user_name')} AS first_attempt_author_user_name, {_FIRST.format('attempt_author_user_id')} AS first_attempt_author_user_id,
  {_FIRST.format('attempt_start_timestamp')} AS first_attempt_start_timestamp, {_FIRST.format('attempt_authoring_mode')} AS first_attempt_authoring_mode, {_FIRST.format('attempt_result')} AS first_attempt_result,
  {_DONE.format('audit_record_id')} AS completed_attempt_audit_record_id, {_DONE.format('attempt_author_user_name')} AS completion_author_user_name, {_DONE.format('attempt_author_user_id')} AS completion_author_user_id,
  {_DONE.format('attempt_start_timestamp')} AS completed_attempt_start_timestamp, {_DONE.format('attempt_end_timestamp')} AS completed_attempt_end_timestamp, {_DONE.format('attempt_authoring_mode')} AS completed_attempt_authoring_mode,
  count(DISTINCT attempt_author_user_name) AS distinct_attempt_author_count, bool_or(author_changed_from_previous_attempt) AS author_changed_between_attempts,
  bool_or(is_preceding_incomplete_attempt AND NOT same_author_as_completion_attempt) AS author_changed_before_completion,
  CASE WHEN bool_or(is_completed_attempt) THEN bool_or(attempt_sequence_number = 1 AND same_author_as_completion_attempt) END AS first_attempt_author_matches_completion_author,
  bool_or(CASE WHEN attempt_sequence_number = last_before THEN same_author_as_completion_attempt END) AS immediately_preceding_author_matches_completion_author,
  bool_or(is_preceding_incomplete_attempt AND same_author_as_completion_attempt) AS completion_author_had_preceding_incomplete_attempt,
  bool_or(is_preceding_incomplete_attempt AND NOT same_author_as_completion_attempt) AS other_author_had_preceding_incomplete_attempt,
  {_BEFORE.format('true')} AS preceding_incomplete_attempt_count, {_BEFORE.format('same_author_as_completion_attempt')} AS preceding_incomplete_attempt_count_by_completion_author,
  {_BEFORE.format('NOT same_author_as_completion_attempt')} AS preceding_incomplete_attempt_count_by_other_authors, {_BEFORE.format("attempt_result = 'AI_ERROR'")} AS preceding_ai_error_attempt_count,
  {_BEFORE.format("attempt_result = 'AI_ERROR_WITHOUT_STACK_TRACE'")} AS preceding_ai_error_without_stack_trace_attempt_count, {_BEFORE.format("attempt_result = 'USER_DROPPED'")} AS preceding_user_dropped_attempt_count,
  max(@us(first_start, done_start)) / 6.0E7 AS minutes_first_attempt_to_completion, {_DONE.format('study_info_page_minutes')} AS completed_attempt_study_info_page_minutes,
  {_DONE.format('total_attempt_duration_minutes')} AS completed_attempt_total_duration_minutes, coalesce(bool_or(attempt_start_timestamp > done_start), false) AS has_attempt_after_completion
FROM x GROUP BY study_num"""

_LAST = "max_by({0}, CASE WHEN {0} IS NOT NULL THEN k END)"
_KEPT = ("total_studies_created_as_of_report_query_count", "other_study_memberships_as_of_report_query_count", "distinct_login_days_as_of_report_query_count", "first_login_timestamp_as_of_report_query", "latest_login_timestamp_as_of_report_query",
         "login_history_span_days_as_of_report_query")
_STUDIES = {"distinct_study_count_with_any_attempt": "true", "distinct_completed_study_count_authored": "done", "distinct_study_count_eventually_created": "created", "distinct_study_count_with_any_ai_attempt": "ai", "distinct_study_count_with_any_manual_attempt": "manual",
            "distinct_study_count_with_both_modes": "ai AND manual"}
#: First and latest values and distinct studies come from aggregates that combine before the shuffle: an author's attempts are never in one task.
AUTHORS = f"""
WITH x AS (SELECT *, @order(attempt_start_timestamp, audit_record_id) AS k FROM {{att}}),
s AS (SELECT attempt_author_user_name AS who, study_num, bool_or(is_completed_attempt) AS done, bool_or(completion_author_user_name IS NOT NULL) AS created, bool_or(attempt_authoring_mode = 'AI') AS ai, bool_or(attempt_authoring_mode = 'MANUAL') AS manual
  FROM {{att}} WHERE study_num IS NOT NULL GROUP BY attempt_author_user_name, study_num),
c AS (SELECT who, {', '.join(f'count(CASE WHEN {e} THEN 1 END) AS {n}' for n, e in _STUDIES.items())} FROM s GROUP BY who),
a AS (SELECT attempt_author_user_name AS author_user_name, {_LAST.format('attempt_author_user_id')} AS author_user_id,
  CASE WHEN bool_or(attempt_authoring_mode = 'AI') AND bool_or(attempt_authoring_mode = 'MANUAL') THEN 'BOTH_AI_AND_MANUAL' WHEN bool_or(attempt_authoring_mode = 'AI') THEN 'AI_ONLY' ELSE 'MANUAL_ONLY' END AS author_adoption_group,
  @first(audit_record_id, k) AS first_observed_audit_record_id, @last(audit_record_id, k) AS latest_observed_audit_record_id, @first(attempt_start_timestamp, k) AS first_attempt_start_timestamp, @last(attempt_start_timestamp, k) AS latest_attempt_start_timestamp,
  @last(effective_attempt_author_role, k) AS effective_author_role_at_latest_attempt, bool_or(attempt_author_is_study_pi) AS author_is_pi_on_any_attempt, @last(author_appointments_raw, k) AS author_appointments_at_latest_attempt,
  {', '.join(_LAST.format(c) + ' AS ' + c for c in _KEPT)}, count(CASE WHEN is_completed_attempt AND attempt_authoring_mode = 'AI' THEN 1 END) AS completed_ai_study_count_authored,
  count(CASE WHEN is_completed_attempt AND attempt_authoring_mode = 'MANUAL' THEN 1 END) AS completed_manual_study_count_authored, count(*) AS all_attempt_count,
  count(CASE WHEN attempt_authoring_mode = 'AI' THEN 1 END) AS ai_attempt_count, count(CASE WHEN attempt_authoring_mode = 'MANUAL' THEN 1 END) AS manual_attempt_count,
  count(CASE WHEN attempt_result = 'AI_ERROR' THEN 1 END) AS ai_error_attempt_count, count(CASE WHEN attempt_result = 'AI_ERROR_WITHOUT_STACK_TRACE' THEN 1 END) AS ai_error_without_stack_trace_attempt_count,
  count(CASE WHEN attempt_result = 'USER_DROPPED' THEN 1 END) AS user_dropped_attempt_count FROM x GROUP BY attempt_author_user_name)
SELECT author_user_name, author_user_id, author_adoption_group, first_observed_audit_record_id, latest_observed_audit_record_id, first_attempt_start_timestamp, latest_attempt_start_timestamp, effective_author_role_at_latest_attempt,
  author_is_pi_on_any_attempt, author_appointments_at_latest_attempt, {', '.join(_KEPT)}, {', '.join(f'coalesce({n}, 0) AS {n}' for n in _STUDIES)}, completed_ai_study_count_authored, completed_manual_study_count_authored, all_attempt_count,
  ai_attempt_count, manual_attempt_count, ai_error_attempt_count, ai_error_without_stack_trace_attempt_count, user_dropped_attempt_count
FROM a LEFT JOIN c ON coalesce(a.author_user_name, '') = coalesce(c.who, '') AND (a.author_user_name IS NULL) = (c.who IS NULL)"""

#: Columns of the records that groupings of attempts and studies add.
SOURCED = "SELECT a.*, r.SOURCE_TYPE AS source_type, r.STUDY_CONTENT_SOURCE AS study_content_source FROM {att} a LEFT JOIN {rec} r ON a.audit_record_id = r.ID"
#: A study's columns of its completed attempt, or else its latest one.
SNAPSHOT = """
WITH x AS (SELECT *, row_number() OVER (PARTITION BY STUDY_NUM ORDER BY CASE WHEN ATTEMPT_RESULT = 'COMPLETE' THEN 0 ELSE 1 END, START_TIME DESC NULLS FIRST, ID DESC) AS nth FROM {rec})
SELECT s.*, x.STUDY_DEPARTMENT AS study_department, x.STUDY_PARTICIPANT_TYPE AS study_participant_type, x.SOURCE_TYPE AS source_type, x.STUDY_CONTENT_SOURCE AS study_content_source, x.ID AS snapshot_record_id
FROM {stu} s LEFT JOIN x ON s.study_num = x.STUDY_NUM AND x.nth = 1"""
FEEDBACK = """
SELECT ID AS audit_record_id, STUDY_NUM AS study_num, USER_FEEDBACK_COMMENTS AS user_feedback_comments, coalesce(NOT @blank(USER_FEEDBACK_COMMENTS), false) AS feedback_recorded
FROM {rec} WHERE ATTEMPT_TYPE = 'AI'"""


def attempts(records):
    return frame(ATTEMPTS, rec=records)


def studies(att):
    return frame(STUDIES, att=att)


def authors(att):
    return frame(AUTHORS, att=att)


def sourced(att, records):
    return frame(SOURCED, att=att, rec=records)


def snapshot(stu, records):
    return frame(SNAPSHOT, stu=stu, rec=records)


def feedback(records):
    return frame(FEEDBACK, rec=records)
