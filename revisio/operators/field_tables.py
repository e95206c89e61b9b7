"""Summaries of fields, suggestions, compensation and readability. Names of tables are as in `tables`."""
from revisio.functions.readability import GRADES, MEASURES
from revisio.operators.context_tables import _n
from revisio.operators.tables import Part, Summary, pct
from revisio.stats import named, one_value

TEXT = "analysis_type IN ('TEXT', 'COMPENSATION')"
WITH_METRICS = "edit_intensity_category IN ('COSMETIC', 'LIGHT_EDIT', 'MODERATE_EDIT', 'HEAVY_EDIT', 'REPLACED')"
ONE_SCHEME = one_value("edit_intensity_threshold_scheme_name")
#: Category, name in counts, name in shares.
INTENSITIES = (("EXACT", "selected_and_exactly_retained", "exact_retention"), ("COSMETIC", "selected_and_cosmetically_changed", "cosmetic_change"), ("LIGHT_EDIT", "selected_and_lightly_edited", "light_edit"),
               ("MODERATE_EDIT", "selected_and_moderately_edited", "moderate_edit"), ("HEAVY_EDIT", "selected_and_heavily_edited", "heavy_edit"), ("EDITED_UNCLASSIFIED", "selected_and_unclassified_edit", "unclassified_edit"),
               ("REPLACED", "selected_and_replaced", "replacement"), ("CLEARED", "selected_then_cleared", "cleared"))


def _ids(cond):
    return f"count(DISTINCT CASE WHEN {cond} THEN audit_record_id END)"


def _adoption():
    n = "completed_ai_attempt_count"
    counts = {n: "count(DISTINCT audit_record_id)", f"{n}_with_suggestion_offered": _ids("suggestion_count_total > 0"), f"{n}_with_suggestion_selected": _ids("picked_index IS NOT NULL"),
              **{f"{n}_{c}": _ids(f"edit_intensity_category = '{k}'") for k, c, _ in INTENSITIES}, f"{n}_unassisted": _ids("edit_intensity_category = 'UNASSISTED'"), "scheme": ONE_SCHEME}
    stats = {"ratio": named("character_edit_ratio_among_edited_attempts", "median mean"), "ter": named("ter_rate_among_edited_attempts", "median mean")}
    picked = f"{n}_with_suggestion_selected"
    return Summary((Part(f"SELECT *, CASE WHEN {WITH_METRICS} THEN character_edit_ratio END AS ratio, CASE WHEN {WITH_METRICS} THEN ter_rate END AS ter FROM {{fld}} WHERE {TEXT}", ("field_name", "analysis_type"), counts=counts, metrics=stats),), f"""
SELECT field_name, analysis_type, {', '.join(c for c in counts if c != 'scheme')}, {pct(picked, f'{n}_with_suggestion_offered')} AS suggestion_selection_percentage_among_attempts_with_offer,
  {', '.join(f'{pct(f"{n}_{c}", picked)} AS {s}_percentage_among_selected_attempts' for _, c, s in INTENSITIES)}, {', '.join(v for s in stats.values() for v in s.values())}, scheme AS edit_intensity_threshold_scheme_name FROM {{g}}""")


def _nontext():
    same = "picked_ids = saved_ids"
    counts = {"n": "count(DISTINCT audit_record_id)", "picked": _ids("picked"), "equal": _ids("picked AND same"), "differ": _ids("picked AND NOT same"), "gone": _ids("gone"), "partial": _ids("picked AND NOT same AND overlap"), "apart": _ids("picked AND NOT same AND NOT overlap")}
    stats = {"similarity": named("selected_final_lookup_similarity", "median mean")}
    source = f"""SELECT audit_record_id, field_name, 'LOOKUP' AS kind, picked_ids <> '[]' AS picked, {same} AS same, saved_ids = '[]' AS gone, kept_ids <> '[]' AS overlap, CASE WHEN picked_ids <> '[]' THEN lookup_similarity END AS similarity FROM {{fld}} WHERE analysis_type = 'LOOKUP'
UNION ALL SELECT audit_record_id, 'offersCompensation', 'BOOLEAN', flag_suggested IS NOT NULL, flag_suggested = flag_saved, flag_saved IS NULL, CAST(NULL AS BOOLEAN), CAST(NULL AS DOUBLE) FROM {{fld}} WHERE analysis_type = 'COMPENSATION'"""
    lookup = "CASE WHEN kind = 'LOOKUP' THEN {0} END AS {1}"
    return Summary((Part(source, ("field_name", "kind"), counts=counts, metrics=stats),), f"""
SELECT field_name, kind AS analysis_type, n AS completed_ai_attempt_count, picked AS attempt_count_with_ai_value_selected, equal AS attempt_count_final_equal_to_selected, differ AS attempt_count_final_different_from_selected, gone AS attempt_count_final_missing,
  {pct('picked', 'n')} AS selection_percentage, {pct('equal', 'picked')} AS final_equal_to_selected_percentage_among_selected, {pct('differ', 'picked')} AS final_different_from_selected_percentage_among_selected,
  {lookup.format('equal', 'attempt_count_exact_set_match')}, {lookup.format('partial', 'attempt_count_partial_set_overlap')}, {lookup.format('apart', 'attempt_count_no_set_overlap')}, {', '.join(stats['similarity'].values())} FROM {{g}}""")


def _compensation_kinds():
    kinds = ("genericCompensation", "specificCompensation")
    cats = {"exactly_retained": "EXACT", "cosmetically_changed": "COSMETIC", "lightly_edited": "LIGHT_EDIT", "moderately_edited": "MODERATE_EDIT", "heavily_edited": "HEAVY_EDIT", "unclassified_edit": "EDITED_UNCLASSIFIED", "replaced": "REPLACED"}
    own = "own AND edit_intensity_category = '{0}'"
    counts = {"completed_ai_attempt_count_with_suggestion": _ids("offered > 0"), "offered_suggestion_count": "CAST(sum(offered) AS BIGINT)", "selected_suggestion_count": _n("own"),
              **{f"selected_suggestion_count_{c}": _n(own.format(k)) for c, k in cats.items()}, "scheme": ONE_SCHEME}
    stats = {"ratio": named("character_edit_ratio", "median mean")}
    change = {"change_final_minus_selected": named("flesch_kincaid_grade_change_final_minus_selected", "median mean")}
    more = {"pairs": "count(DISTINCT audit_record_id)", "count_consensus_grade_level_decrease": _n("consensus_grade_level_direction_category = 'CONSENSUS_GRADE_LEVEL_DECREASE'"), "count_no_material_change": _n("consensus_grade_level_direction_category = 'NO_MATERIAL_CHANGE'"),
            "count_consensus_grade_level_increase": _n("consensus_grade_level_direction_category = 'CONSENSUS_GRADE_LEVEL_INCREASE'"), "count_mixed_formula_direction": _n("consensus_grade_level_direction_category = 'MIXED_FORMULA_DIRECTION'")}
    number = "coalesce(CAST(nullif(regexp_extract(suggestion_counts_json, '\"{0}\": ([0-9]+)', 1), '') AS BIGINT), 0)"
    source = " UNION ALL ".join(f"SELECT *, '{k}' AS kind, {number.format(k)} AS offered, coalesce(picked_kind = '{k}', false) AS own, CASE WHEN picked_kind = '{k}' AND {WITH_METRICS} THEN character_edit_ratio END AS ratio FROM {{fld}} WHERE analysis_type = 'COMPENSATION'" for k in kinds)
    grades = "SELECT *, suggestion_kind AS kind FROM {prs} WHERE field_name = 'compensation' AND readability_measure_name = 'flesch_kincaid_grade'"
    return Summary((Part(source, ("kind",), counts=counts, metrics=stats),), f"""
SELECT g.kind AS compensation_suggestion_kind, {', '.join(c for c in counts if c != 'scheme')}, {pct('selected_suggestion_count', 'offered_suggestion_count')} AS suggestion_selection_percentage, {', '.join(stats['ratio'].values())},
  coalesce(pairs, 0) AS paired_selected_final_readability_count, {', '.join(change['change_final_minus_selected'].values())}, {', '.join(f'coalesce({c}, 0) AS {c}' for c in more if c != 'pairs')}, scheme AS edit_intensity_threshold_scheme_name
FROM {{g}} g LEFT JOIN {{grades}} p ON g.kind = p.kind""", pre={"grades": Part(grades, ("kind",), counts=more, metrics=change)})


def _composition():
    number = "coalesce(CAST(nullif(regexp_extract(suggestion_counts_json, '\"{0}\": ([0-9]+)', 1), '') AS BIGINT), 0)"
    source = f"""SELECT audit_record_id, flag_suggested, flag_saved, a, b, CASE WHEN a > 0 AND b > 0 THEN 'BOTH_KINDS' WHEN a > 0 THEN 'GENERIC_ONLY' WHEN b > 0 THEN 'SPECIFIC_ONLY' ELSE 'NEITHER' END AS mix
  FROM (SELECT *, {number.format('genericCompensation')} AS a, {number.format('specificCompensation')} AS b FROM {{fld}} WHERE analysis_type = 'COMPENSATION') q"""
    pops = (("ALL_COMPLETED_AI_ATTEMPTS", "true"), ("FINAL_COMPENSATION_YES", "flag_saved"))
    rules = (("AI_NO_WITH_TEXT_OFFERS", "AI_VALUE_AVAILABLE_COMPLETED_AI_ATTEMPTS", "flag_suggested IS NOT NULL", "NOT flag_suggested AND mix <> 'NEITHER'"), ("AI_YES_WITH_NO_TEXT_OFFERS", "AI_VALUE_AVAILABLE_COMPLETED_AI_ATTEMPTS", "flag_suggested IS NOT NULL", "flag_suggested AND mix = 'NEITHER'"),
             ("FINAL_YES_WITH_NO_TEXT_OFFERS", "FINAL_COMPENSATION_YES", "flag_saved", "mix = 'NEITHER'"), ("FINAL_YES_WITH_ONE_KIND_ONLY", "FINAL_COMPENSATION_YES", "flag_saved", "mix IN ('GENERIC_ONLY', 'SPECIFIC_ONLY')"),
             ("FINAL_YES_WITH_NON_3_PLUS_3", "FINAL_COMPENSATION_YES", "flag_saved", "NOT (a = 3 AND b = 3)"))
    names = ("grain", "pop", "mix2", "a2", "b2", "rule", "met")
    labels = [(f"CASE WHEN {c} THEN 'OFFER_COMPOSITION' END", f"'{p}'", "mix", "'-'", "'-'", "'-'", "'true'") for p, c in pops] + [(f"CASE WHEN {c} THEN 'OFFER_COUNT_PAIR' END", f"'{p}'", "mix", "CAST(a AS STRING)", "CAST(b AS STRING)", "'-'", "'true'") for p, c in pops]
    labels += [(f"CASE WHEN {d} THEN 'WORKFLOW_CONSISTENCY' END", f"'{p}'", "'-'", "'-'", "'-'", f"'{r}'", f"CASE WHEN {c} THEN 'true' ELSE 'false' END") for r, p, d, c in rules]
    fixed = tuple(("OFFER_COMPOSITION", p, m, "-", "-", "-", "true") for p, _ in pops for m in ("BOTH_KINDS", "GENERIC_ONLY", "SPECIFIC_ONLY", "NEITHER")) + tuple(("WORKFLOW_CONSISTENCY", p, "-", "-", "-", r, "true") for r, p, _, _ in rules)
    on = " AND ".join(f"f.{n} = g.{n}" for n in names)
    total = "sum(n) OVER (PARTITION BY grain, pop, rule)"
    return Summary((Part(source, names, names, tuple(labels), {"n": "count(DISTINCT audit_record_id)"}),), f"""
SELECT grain AS summary_grain, pop AS population_name, nullif(mix2, '-') AS offer_composition_category, CAST(nullif(a2, '-') AS BIGINT) AS generic_suggestion_count, CAST(nullif(b2, '-') AS BIGINT) AS specific_suggestion_count, n AS attempt_count,
  population AS population_attempt_count, {pct('n', 'population')} AS attempt_percentage, CASE WHEN grain = 'OFFER_COUNT_PAIR' THEN a2 = '3' AND b2 = '3' END AS is_exact_three_plus_three, nullif(rule, '-') AS consistency_category
FROM (SELECT *, CAST({total} AS BIGINT) AS population FROM (SELECT {', '.join(f'coalesce(f.{n}, g.{n}) AS {n}' for n in names)}, coalesce(n, 0) AS n FROM {{fix}} f FULL OUTER JOIN {{g}} g ON {on}) j) q WHERE met = 'true'""", (names, fixed))


def _selected_vs_rest():
    parts = ", ".join(f"max(CASE WHEN selected THEN {m} END) - avg(CASE WHEN NOT selected THEN CAST({m} AS DOUBLE) END) AS {m}" for m in MEASURES)
    base = f"SELECT record_id, field_name, {parts} FROM {{rdb}} WHERE text_role = 'SUGGESTED' GROUP BY record_id, field_name HAVING count(CASE WHEN selected THEN 1 END) = 1 AND count(CASE WHEN NOT selected THEN 1 END) > 0"
    stats = {"value": named("selected_minus_mean_unselected_value", "min p25 median mean sd p75 max")}
    counts = {"n": "count(DISTINCT record_id)", "lower_": _n("value < -0.1E0"), "same": _n("abs(value) <= 0.1E0"), "higher": _n("value > 0.1E0")}
    return Summary((Part(base, ("field_name", "measure"), counts=counts, metrics=stats, stacked=MEASURES),), f"""
SELECT field_name, measure AS readability_measure_name, n AS completed_ai_attempt_count_with_selected_and_unselected_suggestions, {', '.join(stats['value'].values())}, lower_ AS attempt_count_selected_value_lower,
  same AS attempt_count_selected_value_equal_within_tolerance, higher AS attempt_count_selected_value_higher, 0.1E0 AS equality_tolerance FROM {{g}}""")


def _change():
    stats = {"change_final_minus_selected": named("change_final_minus_selected", "min p25 median mean sd p75 max")}
    dirs = (("value_decreased", "VALUE_DECREASED"), ("no_material_change", "NO_MATERIAL_CHANGE"), ("value_increased", "VALUE_INCREASED"))
    counts = {"n": "count(DISTINCT audit_record_id)", **{f"attempt_count_{c}": _n(f"readability_direction_category = '{k}'") for c, k in dirs}, "tolerance": one_value("unchanged_absolute_tolerance")}
    return Summary((Part("SELECT * FROM {prs}", ("field_name", "readability_measure_name"), counts=counts, metrics=stats),), f"""
SELECT field_name, readability_measure_name, n AS paired_selected_final_attempt_count, {', '.join(stats['change_final_minus_selected'].values())}, {', '.join(f'attempt_count_{c}' for c, _ in dirs)},
  {', '.join(f'{pct(f"attempt_count_{c}", "n")} AS percentage_{c}' for c, _ in dirs)}, tolerance AS unchanged_absolute_tolerance, field_name = 'title' AS short_text_readability_caution FROM {{g}}""")


def _cross():
    keys = ("field_name", "edit_intensity_threshold_scheme_name", "edit_intensity_category", "consensus_grade_level_direction_category")
    stats = {"change_final_minus_selected": {"median": "median_flesch_kincaid_grade_change_final_minus_selected"}, "turn": {"median": "median_consensus_grade_level_change"}}
    turn = "CASE consensus_grade_level_direction_category WHEN 'CONSENSUS_GRADE_LEVEL_DECREASE' THEN -1E0 WHEN 'CONSENSUS_GRADE_LEVEL_INCREASE' THEN 1E0 ELSE 0E0 END"
    return Summary((Part(f"SELECT *, {turn} AS turn FROM {{prs}} WHERE readability_measure_name = 'flesch_kincaid_grade'", keys, counts={"n": "count(DISTINCT audit_record_id)"}, metrics=stats),), f"""
SELECT g.field_name, g.edit_intensity_threshold_scheme_name, g.edit_intensity_category, consensus_grade_level_direction_category AS readability_direction_category, coalesce(p.n, 0) AS completed_ai_attempt_count,
  g.n AS completed_ai_attempt_count_with_selected_final_pair, {pct('g.n', 'p.n')} AS percentage_within_edit_intensity_category, {', '.join(v for s in stats.values() for v in s.values())}
FROM {{g}} g LEFT JOIN {{also}} p ON g.field_name = p.field_name AND g.edit_intensity_threshold_scheme_name = p.scheme AND g.edit_intensity_category = p.category""",
                   also="SELECT field_name, edit_intensity_threshold_scheme_name AS scheme, edit_intensity_category AS category, count(DISTINCT audit_record_id) AS n FROM {fld} GROUP BY field_name, edit_intensity_threshold_scheme_name, edit_intensity_category")


TARGET_NOTE = "Grade-level formulas are indicators only and do not establish comprehension, accuracy, cultural appropriateness, layout quality, accessibility, or ethical adequacy."


def _targets():
    counts = {"n": "count(*)", "a6": _n("value <= 6"), "a8": _n("value > 6 AND value <= 8"), "a10": _n("value > 8 AND value <= 10"), "over": _n("value > 10")}
    return Summary((Part("SELECT * FROM {rdb} WHERE text_role = 'FINAL'", ("attempt_type", "field_name", "measure"), counts=counts, stacked=GRADES),), f"""
SELECT attempt_type AS attempt_authoring_mode, field_name, measure AS readability_measure_name, n AS final_text_attempt_count, a6 AS attempt_count_at_or_below_grade_6, a8 AS attempt_count_above_grade_6_through_grade_8,
  a10 AS attempt_count_above_grade_8_through_grade_10, over AS attempt_count_above_grade_10, {pct('(a6 + a8)', 'n')} AS percentage_at_or_below_grade_8, field_name = 'title' AS short_text_readability_caution, '{TARGET_NOTE}' AS target_interpretation_note FROM {{g}}""")


def _final_metrics():
    base = "SELECT r.*, f.picked_kind AS own FROM {rdb} r LEFT JOIN (SELECT audit_record_id, field_name AS fn, picked_kind FROM {fld} WHERE field_name = 'compensation') f ON r.record_id = f.audit_record_id AND r.field_name = f.fn WHERE text_role = 'FINAL'"
    unit = "CASE WHEN measure = 'estimated_reading_time_seconds' THEN 'seconds' WHEN measure LIKE '%count' THEN 'count' ELSE 'score' END"
    stats = {"value": named("final_metric_value", n="final_text_attempt_count_with_metric")}
    return Summary((Part(base, ("attempt_type", "field_name", "own", "measure"), counts={"rows_": "count(*)"}, metrics=stats, stacked=MEASURES),), f"""
SELECT attempt_type AS attempt_authoring_mode, field_name, own AS compensation_selected_suggestion_kind, measure AS metric_name, {unit} AS metric_unit, CAST(NULL AS BIGINT) AS final_text_attempt_count_missing_or_blank, {', '.join(stats['value'].values())} FROM {{g}}""")


def _selections():
    """One row an index that any completed attempt was offered; counts of the kind are repeated on its rows."""
    keys = ("field_name", "kind", "idx")
    return Summary((Part("SELECT * FROM {sel}", keys, counts={"at_index": "count(*)", "chosen": _n("chosen")}),), f"""
SELECT g.field_name, g.kind AS suggestion_kind, g.idx AS suggestion_index, a.n AS offered_suggestion_count, a.chosen AS selected_suggestion_count, a.n - a.chosen AS unselected_suggestion_count, a.attempts AS completed_ai_attempt_count_with_at_least_one_suggestion,
  a.picked AS completed_ai_attempt_count_with_selected_suggestion, {pct('a.chosen', 'a.n')} AS suggestion_level_selection_percentage, {pct('a.picked', 'a.attempts')} AS attempt_level_selection_percentage, at_index AS suggestion_count_at_index,
  g.chosen AS selected_suggestion_count_at_index, {pct('g.chosen', 'at_index')} AS selection_percentage_at_index FROM {{g}} g JOIN {{also}} a ON g.field_name = a.field_name AND g.kind = a.kind""",
                   also=f"SELECT field_name, kind, count(*) AS n, {_n('chosen')} AS chosen, count(DISTINCT audit_record_id) AS attempts, {_ids('chosen')} AS picked FROM {{sel}} GROUP BY field_name, kind")


#: Suggestions one by one: the counts decoded, an index a row.
SELECTIONS = """SELECT audit_record_id, field_name, kind, idx, coalesce(picked_kind = kind AND picked_index = idx, false) AS chosen FROM (SELECT *, explode(sequence(0L, n - 1)) AS idx FROM
  (SELECT audit_record_id, field_name, picked_kind, picked_index, explode(from_json(suggestion_counts_json, 'map<string, bigint>')) AS (kind, n) FROM {fld} WHERE analysis_type IN ('TEXT', 'COMPENSATION')) a WHERE n > 0) b"""
SELECTIONS_SQL = """SELECT audit_record_id, field_name, kind, CAST(idx AS BIGINT) AS idx, coalesce(picked_kind = kind AND picked_index = idx, false) AS chosen FROM (SELECT *, unnest(range(n)) AS idx FROM
  (SELECT audit_record_id, field_name, picked_kind, picked_index, e.key AS kind, e.value AS n FROM (SELECT *, unnest(map_entries(CAST(CAST(suggestion_counts_json AS JSON) AS MAP(VARCHAR, BIGINT)))) AS e FROM {fld} WHERE analysis_type IN ('TEXT', 'COMPENSATION')) x) a)"""
FIELDS = {"a11_field_adoption": _adoption(), "a12_nontext": _nontext(), "a13_suggestions": _selections(), "a14_compensation": _compensation_kinds(), "a15_offer_composition": _composition(), "a16_selected_vs_rest": _selected_vs_rest(),
          "a17_readability_change": _change(), "a18_edit_readability": _cross(), "a19_targets": _targets(), "a20_final_metrics": _final_metrics()}
