"""AI generations that returned a result, what changed from one to the next, and the way to each completion by AI.

Texts are compared trimmed and without case; a missing or blank side makes a comparison MISSING."""
from revisio.sql import frame

GENERATIONS = """
SELECT STUDY_NUM AS study_num, ID AS audit_record_id, START_TIME AS attempt_start_timestamp, ATTEMPT_RESULT AS attempt_result,
  CASE WHEN ATTEMPT_RESULT = 'COMPLETE' THEN 'COMPLETE' ELSE 'INCOMPLETE' END AS attempt_completion_group, ATTEMPT_RESULT = 'COMPLETE' AS is_completed_ai_attempt,
  SOURCE_SIZE_CHARS AS source_size_chars, LATENCY_MS AS latency_ms, SOURCE_TYPE AS source_type, STUDY_CONTENT_SOURCE AS study_content_source,
  LLM_INFERRED_STUDY_CONTENT_SOURCE AS llm_inferred_study_content_source, STUDY_CONTENT_SOURCE_OTHER_VALUE AS study_content_source_other_value,
  LLM_INFERRED_STUDY_CONTENT_SOURCE_OTHER_VALUE AS llm_inferred_study_content_source_other_value
FROM {rec} WHERE ATTEMPT_TYPE = 'AI' AND ATTEMPT_RESULT NOT IN ('AI_ERROR', 'AI_ERROR_WITHOUT_STACK_TRACE')"""


def _compared(a, b):
    return f"CASE WHEN {a} IS NULL OR {b} IS NULL THEN 'MISSING' WHEN {a} = {b} THEN 'SAME' ELSE 'CHANGED' END"


def _both(*kinds):
    return f"CASE WHEN {' OR '.join(k + chr(32) + chr(61) + chr(32) + repr('MISSING') for k in kinds)} THEN 'MISSING' WHEN {' AND '.join(k + ' = ' + repr('SAME') for k in kinds)} THEN 'SAME' ELSE 'CHANGED' END"


_W = "(PARTITION BY study_num ORDER BY attempt_start_timestamp NULLS LAST, audit_record_id)"
_KEYED = "SELECT *, @key(study_content_source) AS source_key, @key(source_type) AS type_key FROM {gen}"
TRANSITIONS = f"""
WITH g AS ({_KEYED}),
x AS (SELECT *, row_number() OVER {_W} - 1 AS nth, {', '.join(f'lag({c}) OVER {_W} AS p_{c}' for c in ('audit_record_id', 'source_size_chars', 'source_key', 'type_key', 'latency_ms'))} FROM g),
c AS (SELECT *, {_compared('p_source_size_chars', 'source_size_chars')} AS sizes, {_compared('p_source_key', 'source_key')} AS sources, {_compared('p_type_key', 'type_key')} AS types FROM x WHERE nth > 0)
SELECT study_num, CAST(nth AS BIGINT) AS transition_sequence_number, p_audit_record_id AS previous_audit_record_id, audit_record_id AS current_audit_record_id, is_completed_ai_attempt AS current_is_completed_ai_attempt,
  sizes AS source_size_comparison, sources AS reported_source_comparison, types AS input_method_comparison, {_both('sizes', 'sources')} AS source_signature_comparison,
  {_both('sizes', 'sources', 'types')} AS full_input_signature_comparison,
  CASE WHEN sizes = 'MISSING' OR sources = 'MISSING' THEN 'SOURCE_COMPARISON_MISSING' WHEN sizes = 'SAME' AND sources = 'SAME' THEN 'SAME_SOURCE_SIGNATURE' WHEN sources = 'SAME' THEN 'SIZE_CHANGED_ONLY'
    WHEN sizes = 'SAME' THEN 'REPORTED_SOURCE_CHANGED_ONLY' ELSE 'SIZE_AND_REPORTED_SOURCE_CHANGED' END AS source_change_category, types AS input_method_change_category,
  p_source_size_chars AS previous_source_size_chars, source_size_chars AS current_source_size_chars, source_size_chars - p_source_size_chars AS source_size_change_chars,
  abs(source_size_chars - p_source_size_chars) AS absolute_source_size_change_chars,
  CASE WHEN p_source_size_chars > 0 THEN (source_size_chars - p_source_size_chars) / CAST(p_source_size_chars AS DOUBLE) END AS relative_source_size_change,
  p_latency_ms AS previous_latency_ms, latency_ms AS current_latency_ms, latency_ms - p_latency_ms AS latency_change_ms FROM c"""


def _sides(prefix, side):
    """Comparisons of the completion with another generation of its path; MISSING without one."""
    at = f"max(CASE WHEN {side} THEN {{0}} END)"
    size, source, kind, latency = (at.format(c) for c in ("source_size_chars", "source_key", "type_key", "latency_ms"))
    done = {c: f"max(CASE WHEN is_completed_ai_attempt THEN {c} END)" for c in ("source_size_chars", "source_key", "type_key", "latency_ms")}
    sizes, sources = _compared(size, done["source_size_chars"]), _compared(source, done["source_key"])
    return (f"{sizes} AS {prefix}_source_size_comparison, {sources} AS {prefix}_reported_source_comparison, {_compared(kind, done['type_key'])} AS {prefix}_input_method_comparison, "
            f"{_both('(' + sizes + ')', '(' + sources + ')')} AS {prefix}_source_signature_comparison, {done['source_size_chars']} - {size} AS {prefix}_source_size_change_chars, "
            f"{done['latency_ms']} - {latency} AS {prefix}_latency_change_ms")


_CHANGES = ("source_size", "reported_source", "input_method", "source_signature")
_CHANGED = [f"count(CASE WHEN {c}_comparison = 'CHANGED' THEN 1 END)" for c in _CHANGES]
PATHWAYS = f"""
WITH g AS ({_KEYED}),
d AS (SELECT *, max(CASE WHEN is_completed_ai_attempt THEN attempt_start_timestamp END) OVER (PARTITION BY study_num) AS ds, max(CASE WHEN is_completed_ai_attempt THEN audit_record_id END) OVER (PARTITION BY study_num) AS di FROM g),
p AS (SELECT *, row_number() OVER {_W} AS nth, count(*) OVER (PARTITION BY study_num) AS n FROM d WHERE attempt_start_timestamp < ds OR (attempt_start_timestamp = ds AND audit_record_id <= di)),
t AS (SELECT p.study_num, {', '.join(f't.{c}_comparison AS {c}_comparison' for c in _CHANGES)} FROM {{trn}} t JOIN p ON t.study_num = p.study_num AND t.current_audit_record_id = p.audit_record_id WHERE p.nth > 1),
c AS (SELECT study_num, count(*) AS transitions, {', '.join(f'{e} AS {c}_change_count' for e, c in zip(_CHANGED, _CHANGES))} FROM t GROUP BY study_num),
b AS (SELECT r.STUDY_NUM AS study_num, count(*) AS before FROM {{rec}} r JOIN (SELECT DISTINCT study_num, ds, di FROM p) x ON r.STUDY_NUM = x.study_num
  WHERE r.START_TIME < x.ds OR (r.START_TIME = x.ds AND r.ID < x.di) GROUP BY r.STUDY_NUM),
s AS (SELECT study_num, max(di) AS completed_attempt_audit_record_id, count(*) AS generations, count(DISTINCT source_size_chars) AS distinct_source_size_count, count(DISTINCT source_key) AS distinct_reported_source_count,
  count(DISTINCT type_key) AS distinct_input_method_count, count(DISTINCT CASE WHEN source_size_chars IS NOT NULL AND source_key IS NOT NULL THEN CAST(source_size_chars AS STRING) || ' ' || source_key END) AS distinct_source_signature_count,
  {', '.join(f'max(CASE WHEN is_completed_ai_attempt THEN {c} END) AS completed_{c}' for c in ('source_size_chars', 'latency_ms', 'source_type', 'study_content_source', 'llm_inferred_study_content_source'))},
  {_sides('first_to_completion', 'nth = 1 AND n > 1')}, {_sides('preceding_to_completion', 'nth = n - 1')} FROM p GROUP BY study_num)
SELECT s.study_num, completed_attempt_audit_record_id, coalesce(before, 0) AS preceding_attempt_count, generations - 1 AS preceding_successful_ai_attempt_count, generations AS successful_ai_generation_attempt_count,
  coalesce(transitions, 0) AS comparable_successful_ai_transition_count, {', '.join(f'coalesce({c}_change_count, 0) AS {c}_change_count' for c in _CHANGES)},
  {', '.join(f'coalesce({c}_change_count, 0) > 0 AS any_{c}_change' for c in _CHANGES)}, distinct_source_size_count, distinct_reported_source_count, distinct_input_method_count, distinct_source_signature_count,
  completed_source_size_chars, completed_latency_ms, completed_source_type, completed_study_content_source, completed_llm_inferred_study_content_source,
  {', '.join(f'{p}_{x}' for p in ('first_to_completion', 'preceding_to_completion') for x in ('source_size_comparison', 'reported_source_comparison', 'input_method_comparison', 'source_signature_comparison', 'source_size_change_chars', 'latency_change_ms'))}
FROM s LEFT JOIN c ON s.study_num = c.study_num LEFT JOIN b ON s.study_num = b.study_num"""


def generations(records):
    return frame(GENERATIONS, rec=records)


def transitions(gen):
    return frame(TRANSITIONS, gen=gen)


def pathways(records, gen, trn):
    return frame(PATHWAYS, kept=("p",), rec=records, gen=gen, trn=trn)
