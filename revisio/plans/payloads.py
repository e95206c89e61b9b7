"""Suggested, selected and final texts over the test tables, and the field and readability analyses of them as DuckDB SQL."""
from pyspark.sql import functions as F

from revisio.functions import readability
from revisio.operators import fields, readings
from revisio.plans.adapters import table
from revisio.sql import frame

#: One row a completed record: <field>_s offered, <field>_p picked, <field>_f final.
PAY = """
WITH i AS (SELECT ID, ATTEMPT_TYPE, ID % n AS a, (ID * 7) % n AS b, (ID * 3) % (n - 2) AS c FROM (SELECT ID, ATTEMPT_TYPE, (SELECT count(*) FROM {part}) AS n FROM {rec} WHERE ATTEMPT_RESULT = 'COMPLETE') q),
p AS (SELECT p_partkey AS k, p_name || ' ' || p_type || ' in size ' || CAST(p_size AS STRING) AS t FROM {part}),
r AS (SELECT ID AS k, ATTEMPT_TYPE AS mode, x.t AS x, y.t AS y, z.t AS z FROM i JOIN p x ON x.k = i.a JOIN p y ON y.k = i.b JOIN p z ON z.k = i.c)
SELECT k AS record_id, mode AS attempt_type, @list(x, y, x) AS title_s, CASE WHEN k % 5 > 0 THEN x END AS title_p, CASE k % 4 WHEN 0 THEN x WHEN 1 THEN upper(x) || '!' WHEN 2 THEN y ELSE x || ' extra' END AS title_f,
  CASE WHEN k % 3 > 0 THEN @list(y, ' ') END AS about_s, CASE WHEN k % 3 > 0 AND k % 2 = 0 THEN y END AS about_p, CASE WHEN k % 8 = 0 THEN ' ' WHEN k % 8 < 5 THEN y || ' and ' || x || ' remain. Beautiful possibilities.' END AS about_f,
  @list(z, x) AS purpose_s, CASE WHEN k % 4 < 3 THEN x END AS purpose_p, CASE WHEN k % 7 < 3 THEN x ELSE z || ', ' || x END AS purpose_f,
  @list(x || ' ' || y || '. ' || z || '.', y || ' ' || z || ' education.') AS description_s, CASE WHEN k % 6 < 4 THEN y || ' ' || z || ' education.' END AS description_p, CASE WHEN k % 5 < 2 THEN y || ' ' || z || ' education' ELSE x || ' is new. ' || z || '!' END AS description_f,
  CASE WHEN k % 4 > 0 THEN @list(x, y, z) ELSE @list() END AS genericCompensation_s, CASE WHEN k % 4 IN (1, 2) THEN x END AS genericCompensation_p, CASE WHEN k % 5 > 0 THEN @list(y, z, x) ELSE @list(z) END AS specificCompensation_s,
  CASE WHEN k % 4 = 3 THEN z END AS specificCompensation_p, CASE WHEN k % 2 = 0 OR k % 9 > 5 THEN x || CASE WHEN k % 3 = 0 THEN ' ' || y ELSE '' END ELSE '' END AS compensation_f,
  CASE WHEN k % 6 < 5 THEN k % 3 = 0 END AS flag_suggested, k % 2 = 0 AS flag_saved, 'me@example.org' AS email_s, 'me@example.org' AS email_p, CASE WHEN k % 2 = 0 THEN 'me@example.org' ELSE 'you@example.org' END AS email_f,
  x AS name_s, CASE WHEN k % 2 = 0 THEN x END AS name_p, x AS name_f, CAST(NULL AS STRING) AS phone_s, CAST(NULL AS STRING) AS phone_p, CASE WHEN k % 3 = 0 THEN '5550' || CAST(k % 100 AS STRING) END AS phone_f,
  'example.org' AS website_s, CASE WHEN k % 3 = 0 THEN 'example.org' END AS website_p, '' AS website_f,
  @list(k % 7, k % 5 + 10) AS department_s, CASE WHEN k % 3 = 1 THEN @list(k % 7) END AS department_p, @list(k % 7) AS department_f, @list(1, 2, 3) AS locations_s, @list(1, 3) AS locations_p, CASE k % 3 WHEN 0 THEN @list(3, 4) WHEN 1 THEN @list(3, 1) ELSE @list(8) END AS locations_f,
  @list(k % 11) AS topics_s, @list() AS topics_p, CASE WHEN k % 4 > 0 THEN @list(k % 11) END AS topics_f FROM r"""


def pay(spark, d, rec):
    # the files of part are small beside its rows, so Spark would take it for a table to broadcast
    return frame(PAY, rec=rec, part=table(spark, d, "part").hint("merge"))


def with_payloads(rec, p):
    """Records with the payloads as JSON."""
    some = lambda c: F.when(F.col(c).isNotNull(), F.array(c))

    def payload(k):
        texts = [(F.col(f"{t}_s") if k == "s" else some(f"{t}_p") if k == "p" else F.col(f"{t}_f")).alias(t) for t in fields.TEXTS]
        money = F.col("compensation_f").alias("compensation") if k == "f" else F.struct(*[(F.col(f"{x}_s") if k == "s" else some(f"{x}_p")).alias(x) for x in fields.KINDS]).alias("compensation")
        contact = F.struct(*[F.col(f"{c}_{k}").alias(c) for c in fields.CONTACT]).alias("contact")
        flag = {"s": [F.col("flag_suggested").alias("offersCompensation")], "p": [], "f": [F.col("flag_saved").alias("offersCompensation")]}[k]
        return F.to_json(F.struct(*texts, money, contact, *[F.col(f"{x}_{k}").cast("array<bigint>").alias(x) for x in fields.LOOKUPS], *flag))

    j = p.select(F.col("record_id").alias("ID"), payload("s").alias("LLM_SUGGESTIONS"), payload("p").alias("SELECTED_SUGGESTIONS"), payload("f").alias("FINAL_SUBMISSION"))
    # Spark guesses a table's size from its files, and three columns' share of it: gigabytes of JSON would be broadcast. A task's records are looked up, so its JSON is not sorted
    return rec.hint("shuffle_hash").join(j, "ID", "left")


def readings_of(p, familiar=None):
    """Readability rows from the payload table."""
    kinds = ", ".join(f"'{k}', {k}_{{0}}" for k in fields.KINDS)
    some = lambda c: f"CASE WHEN {c} IS NOT NULL THEN array({c}) END"
    s = "named_struct(" + ", ".join([*(f"'{t}', {t}_s" for t in readings.TEXTS), f"'compensation', named_struct({kinds.format('s')})"]) + ")"
    k = "named_struct(" + ", ".join([*(f"'{t}', {some(t + '_p')}" for t in readings.TEXTS), "'compensation', named_struct(" + ", ".join(f"'{x}', {some(x + '_p')}" for x in fields.KINDS) + ")"]) + ")"
    f = "named_struct(" + ", ".join(f"'{t}', {t}_f" for t in (*readings.TEXTS, "compensation")) + ")"
    return readings.rows(p.where("attempt_type = 'AI'").selectExpr("record_id", "attempt_type", f"{s} AS s", f"{k} AS p"), p.selectExpr("record_id", "attempt_type", f"{f} AS f"), familiar)


def _text_sql(field, kind, offers, final):
    counts = "'{{' || " + " || ', ' || ".join(f"'\"{k}\": ' || len({o})" for k, o, _ in sorted(offers)) + " || '}}'"
    chosen = lambda values: "CASE " + " ".join(f"WHEN {p} IS NOT NULL THEN {v}" for (_, _, p), v in zip(offers, values)) + " END"
    own = kind == "COMPENSATION"
    return (f"SELECT record_id, '{field}' AS field_name, '{kind}' AS analysis_type, {' + '.join(f'len({o})' for _, o, _ in offers)} AS suggestion_count_total, {counts} AS suggestion_counts_json, {chosen([repr(k) for k, _, _ in offers])} AS picked_kind, "
            f"{chosen([f'list_position({o}, {p}) - 1' for _, o, p in offers])} AS picked_index, {chosen([p for _, _, p in offers])} AS s, coalesce({final}, '') AS f, "
            + (", ".join(("flag_suggested", "flag_saved", "flag_suggested = flag_saved AS flag_accepted", "flag_suggested <> flag_saved AS flag_changed", "flag_saved AS compensation_text_required")) if own else
               ", ".join(f"CAST(NULL AS BOOLEAN) AS {c}" for c in ("flag_suggested", "flag_saved", "flag_accepted", "flag_changed", "compensation_text_required"))) + " FROM {pay} WHERE attempt_type = 'AI'")


_TEXT = [_text_sql(t, "TEXT", [(t, f"coalesce({t}_s, [])", f"{t}_p")], f"{t}_f") for t in fields.TEXTS]
_TEXT += [_text_sql(f"contact.{c}", "TEXT", [(f"contact.{c}", f"CASE WHEN {c}_s <> '' THEN [{c}_s] ELSE [] END", f"{c}_p")], f"{c}_f") for c in fields.CONTACT]
_TEXT.append(_text_sql("compensation", "COMPENSATION", [(k, f"{k}_s", f"{k}_p") for k in fields.KINDS], "compensation_f"))
_PLAINED = "trim(regexp_replace(lower({0}), '[^a-z0-9]+', ' ', 'g'))"
_IDS = "'[' || array_to_string(list_sort({0}), ', ') || ']'"
_LOOK = [f"SELECT record_id, '{x}' AS field_name, list_distinct({x}_s) AS o, list_distinct(coalesce({x}_p, [])) AS k, list_distinct(coalesce({x}_f, [])) AS v FROM {{pay}} WHERE attempt_type = 'AI'" for x in fields.LOOKUPS]
#: The flattened analysis without TER and soft-word metrics, which SQL does not give.
ANALYSIS = f"""
WITH t AS ({' UNION ALL '.join(_TEXT)}),
m AS (SELECT *, CASE WHEN s IS NULL THEN 'UNASSISTED' WHEN trim(f) = '' THEN 'REMOVED' WHEN s = f THEN 'EXACT' WHEN {_PLAINED.format('s')} = {_PLAINED.format('f')} THEN 'COSMETIC_EQUIVALENT' ELSE 'EDITED' END AS match_type,
  CASE WHEN s IS NOT NULL AND trim(f) <> '' THEN levenshtein(s, f) END AS d FROM t),
l AS ({' UNION ALL '.join(_LOOK)}),
i AS (SELECT *, len(list_intersect(k, v)) AS shared, len(list_distinct(list_concat(k, v))) AS either FROM l)
SELECT record_id, field_name, analysis_type, match_type, CAST(suggestion_count_total AS BIGINT) AS suggestion_count_total, suggestion_counts_json, picked_kind, CAST(picked_index AS BIGINT) AS picked_index, d AS character_edit_distance,
  1 - d / length(f) AS character_effort_saved_raw, CASE WHEN d IS NOT NULL THEN least(1, greatest(0, 1 - d / length(f))) END AS character_effort_saved, CASE WHEN d IS NOT NULL THEN greatest(0, length(f) - d) END AS estimated_characters_saved, CASE WHEN d IS NOT NULL THEN length(s) END AS suggestion_character_count,
  CASE WHEN d IS NOT NULL THEN length(f) END AS final_character_count, CASE WHEN d IS NOT NULL THEN len(list_filter(string_split_regex(s, '\\s+'), lambda w: w <> '')) END AS suggestion_word_count,
  CASE WHEN d IS NOT NULL THEN len(list_filter(string_split_regex(f, '\\s+'), lambda w: w <> '')) END AS final_word_count, flag_suggested, flag_saved, flag_accepted, flag_changed, compensation_text_required,
  CAST(NULL AS DOUBLE) AS lookup_similarity, {', '.join(f'CAST(NULL AS VARCHAR) AS {c}' for c in ('offered_ids', 'picked_ids', 'saved_ids', 'kept_ids', 'dropped_ids', 'added_ids', 'saved_not_offered_ids'))} FROM m
UNION ALL BY NAME
SELECT record_id, field_name, 'LOOKUP' AS analysis_type, CASE WHEN len(k) = 0 THEN 'UNASSISTED' WHEN len(k) = len(v) AND shared = len(k) THEN 'EXACT' ELSE 'EDITED' END AS match_type, CASE WHEN len(k) = 0 THEN 0E0 ELSE shared / either END AS lookup_similarity,
  {_IDS.format('o')} AS offered_ids, {_IDS.format('k')} AS picked_ids, {_IDS.format('v')} AS saved_ids, {_IDS.format('list_intersect(k, v)')} AS kept_ids, {_IDS.format('list_filter(k, lambda x: NOT list_contains(v, x))')} AS dropped_ids,
  {_IDS.format('list_filter(v, lambda x: NOT list_contains(k, x))')} AS added_ids, {_IDS.format('list_filter(v, lambda x: NOT list_contains(o, x))')} AS saved_not_offered_ids FROM i"""
_WITHOUT = ("ter_rate", "soft_word_edit_distance", "policy_adjusted_effort_saved")
FIELDS = fields.COMPLETED
for _c in _WITHOUT:
    FIELDS = FIELDS.replace(f" {_c},", f" CAST(NULL AS DOUBLE) AS {_c},")
LEFT_OUT = ("ter_rate", "ter_effort_saved_raw", "ter_effort_saved", "policy_adjusted_effort_saved", "soft_word_edit_distance", "soft_word_effort_saved_raw", "soft_word_effort_saved", "selected_text", "final_text")
_INST = [f"SELECT record_id, attempt_type, '{f}' AS field_name, 'SUGGESTED' AS text_role, '{k}' AS suggestion_kind, unnest(range(len({k}_s))) AS suggestion_index, unnest({k}_s) AS text, list_position({k}_s, {k}_p) - 1 AS first FROM {{pay}} WHERE attempt_type = 'AI'"
         for f, k in [*((t, t) for t in readings.TEXTS), *(("compensation", k) for k in fields.KINDS)]]
_FINAL = [f"SELECT record_id, attempt_type, '{t}' AS field_name, 'FINAL' AS text_role, NULL AS suggestion_kind, NULL AS suggestion_index, {t}_f AS text, NULL AS first FROM {{pay}}" for t in (*readings.TEXTS, "compensation")]
READINGS = f"""
WITH t AS ({' UNION ALL '.join(_INST + _FINAL)}),
m AS (SELECT *, {readability.sql('text').replace('{', '{{').replace('}', '}}')} FROM t WHERE text IS NOT NULL AND trim(text) <> '')
SELECT record_id, attempt_type, field_name, text_role, suggestion_kind, CAST(suggestion_index AS BIGINT) AS suggestion_index, CASE WHEN text_role = 'SUGGESTED' THEN coalesce(suggestion_index = first, false) END AS selected,
  {', '.join(f'{e} AS {m}' for e, m in zip(readability.FORMULAS, readability.MEASURES))} FROM m"""
_M = readability.MEASURES
_D = {m: f"CAST(b.{m} AS DOUBLE) - CAST(a.{m} AS DOUBLE)" for m in _M}
_DOWN, _UP = (" + ".join(f"CASE WHEN {_D[m]} {o} THEN 1 ELSE 0 END" for m in readability.GRADES) for o in ("< -0.1E0", "> 0.1E0"))
PAIRS = f"""
WITH j AS (SELECT a.record_id, study_num, a.field_name, a.suggestion_kind, a.suggestion_index, edit_intensity_category, edit_intensity_threshold_scheme_name, {_DOWN} AS down, {_UP} AS up,
  unnest([{', '.join(f"struct_pack(m := '{m}', x := CAST(a.{m} AS DOUBLE), y := CAST(b.{m} AS DOUBLE))" for m in _M)}]) AS v
  FROM {{rdb}} a JOIN {{rdb}} b ON a.record_id = b.record_id AND a.field_name = b.field_name AND a.text_role = 'SUGGESTED' AND a.selected AND b.text_role = 'FINAL' JOIN {{fld}} f ON f.audit_record_id = a.record_id AND f.field_name = a.field_name)
SELECT record_id AS audit_record_id, study_num, field_name, suggestion_kind, suggestion_index, v.m AS readability_measure_name, v.x AS selected_suggestion_metric_value, v.y AS final_metric_value, v.y - v.x AS change_final_minus_selected,
  CASE WHEN abs(v.y - v.x) <= 0.1E0 THEN 'NO_MATERIAL_CHANGE' WHEN v.y < v.x THEN 'VALUE_DECREASED' WHEN v.y > v.x THEN 'VALUE_INCREASED' END AS readability_direction_category,
  CASE WHEN down = 0 AND up = 0 THEN 'NO_MATERIAL_CHANGE' WHEN down >= 3 AND up = 0 THEN 'CONSENSUS_GRADE_LEVEL_DECREASE' WHEN up >= 3 AND down = 0 THEN 'CONSENSUS_GRADE_LEVEL_INCREASE' ELSE 'MIXED_FORMULA_DIRECTION' END AS consensus_grade_level_direction_category,
  0.1E0 AS unchanged_absolute_tolerance, edit_intensity_category, edit_intensity_threshold_scheme_name, field_name = 'title' AS short_text_readability_caution FROM j"""
