"""Summaries of sources, repeated generations and retries. Names of tables are as in `tables`."""
from revisio.operators.retries import CATEGORIES
from revisio.operators.tables import Part, Summary, pct
from revisio.stats import named

RULE = "Trim surrounding whitespace and compare using Unicode casefold; null and blank remain missing."
_KEYED = """SELECT *, @key(study_content_source) AS said, @key(llm_inferred_study_content_source) AS seen, @key(source_type) AS kind, @key(study_content_source_other_value) AS said_other,
  @key(llm_inferred_study_content_source_other_value) AS seen_other FROM {gen}"""
GROUPS = (("'ALL'",), ("attempt_completion_group",))
FIXED = (("grp",), (("ALL",), ("COMPLETE",), ("INCOMPLETE",)))


def _n(cond):
    return f"count(CASE WHEN {cond} THEN 1 END)"


def _concordance():
    long_ = "ai_attempt_percentage_with_different_{0}_among_comparable_attempts"
    counts = {"ai_attempt_count": "count(*)", "ai_attempt_count_with_both_content_source_values": _n("said IS NOT NULL AND seen IS NOT NULL"), "ai_attempt_count_with_matching_content_source": _n("said = seen"),
              "ai_attempt_count_with_different_content_source": _n("said <> seen"), "ai_attempt_count_with_both_other_text_values": _n("said_other IS NOT NULL AND seen_other IS NOT NULL"),
              "ai_attempt_count_with_matching_other_text_value": _n("said_other = seen_other"), "ai_attempt_count_with_different_other_text_value": _n("said_other <> seen_other")}
    return Summary((Part(_KEYED, ("grp",), ("grp",), GROUPS, counts),), f"""
SELECT f.grp AS attempt_completion_group, {', '.join(f'coalesce({c}, 0) AS {c}' for c in counts)},
  {pct('ai_attempt_count_with_different_content_source', 'ai_attempt_count_with_both_content_source_values')} AS {long_.format('content_source')},
  {pct('ai_attempt_count_with_different_other_text_value', 'ai_attempt_count_with_both_other_text_values')} AS {long_.format('other_text_value')}, '{RULE}' AS comparison_normalization_rule
FROM {{fix}} f LEFT JOIN {{g}} g ON f.grp = g.grp""", FIXED)


def _matrix():
    by = "sum(n) OVER (PARTITION BY grp, said)"
    return Summary((Part(f"SELECT * FROM ({_KEYED}) k WHERE said IS NOT NULL AND seen IS NOT NULL", ("grp", "said", "seen"), ("grp",), GROUPS, {"n": "count(*)"}),), f"""
SELECT grp AS attempt_completion_group, said AS reported_study_content_source, seen AS inferred_study_content_source, n AS ai_attempt_count, CAST({by} AS BIGINT) AS reported_source_attempt_count,
  {pct('n', by)} AS attempt_percentage_within_reported_source FROM {{g}}""")


POPULATIONS = (("ALL_SUCCESSFUL_AI_GENERATIONS", "true"), ("COMPLETED_AI_ATTEMPTS", "is_completed_ai_attempt"))


def _distribution():
    dims = (("ALL", "'ALL'"), ("INPUT_METHOD", "kind"), ("REPORTED_CONTENT_SOURCE", "said"), ("INFERRED_CONTENT_SOURCE", "seen"))
    labels = tuple((f"CASE WHEN {c} AND {v} IS NOT NULL THEN '{p}' END", f"'{d}'", v) for p, c in POPULATIONS for d, v in dims)
    stats = {"source_size_chars": named("source_size_chars", n="attempt_count_with_source_size", missing="attempt_count_missing_source_size"),
             "latency_ms": named("latency_ms", n="attempt_count_with_latency", missing="attempt_count_missing_latency")}
    counts = {"n": "count(*)", "comparable_content_source_attempt_count": _n("said IS NOT NULL AND seen IS NOT NULL"), "matching_content_source_attempt_count": _n("said = seen"), "different_content_source_attempt_count": _n("said <> seen"),
              "other_category_attempt_count": _n("said = 'other'"), "other_category_attempt_count_with_nonblank_detail": _n("said = 'other' AND said_other IS NOT NULL"), "both_other_category_attempt_count": _n("said = 'other' AND seen = 'other'"),
              "both_other_detail_attempt_count": _n("said = 'other' AND seen = 'other' AND said_other IS NOT NULL AND seen_other IS NOT NULL"), "matching_other_detail_attempt_count": _n("said = 'other' AND seen = 'other' AND said_other = seen_other")}
    own = [c for c in counts if c != "n"]
    shares = {"content_source_match_percentage": ("matching_content_source_attempt_count", "comparable_content_source_attempt_count"),
              "other_detail_completeness_percentage": ("other_category_attempt_count_with_nonblank_detail", "other_category_attempt_count"), "other_detail_match_percentage": ("matching_other_detail_attempt_count", "both_other_detail_attempt_count")}
    names = ("pop", "dim", "val")
    held = [v for s in stats.values() for k, v in s.items() if k in ("n", "missing")]
    rest = [v for s in stats.values() for k, v in s.items() if k not in ("n", "missing")]
    return Summary((Part(_KEYED, names, names, labels, counts, stats),), f"""
WITH x AS (SELECT coalesce(f.pop, g.pop) AS pop, coalesce(f.dim, g.dim) AS dim, coalesce(f.val, g.val) AS val, {', '.join(f'coalesce({c}, 0) AS {c}' for c in ['n', *own, *held])}, {', '.join(rest)}
  FROM {{fix}} f FULL OUTER JOIN {{g}} g ON f.pop = g.pop AND f.dim = g.dim AND f.val = g.val)
SELECT pop AS population_name, dim AS summary_dimension_name, val AS summary_dimension_value, max(CASE WHEN dim = 'ALL' THEN n END) OVER (PARTITION BY pop) AS population_attempt_count,
  CAST(sum(n) OVER (PARTITION BY pop, dim) AS BIGINT) AS eligible_attempt_count, n AS category_attempt_count, {pct('n', 'sum(n) OVER (PARTITION BY pop, dim)')} AS category_attempt_percentage, {', '.join([*held, *rest])},
  {', '.join(f"CASE WHEN dim = 'ALL' THEN {c} END AS {c}" for c in own)}, {', '.join(f"CASE WHEN dim = 'ALL' THEN {pct(a, b)} END AS {c}" for c, (a, b) in shares.items())}, '{RULE}' AS comparison_normalization_rule FROM x""",
                   (names, tuple((p, "ALL", "ALL") for p, _ in POPULATIONS)))


def _sizes():
    """Bands between the distinct quartiles of all generations' sizes, an edge in the lower band; bands without members are left out."""
    names = ("pop", "grp")
    stats = {"source_size_chars": named("source_size_chars", "min median max"), "latency_ms": named("latency_ms", n="attempt_count_with_latency", missing="attempt_count_missing_latency")}
    labels = tuple((f"CASE WHEN {c} AND {v} IS NOT NULL THEN '{p}' END", v) for p, c in POPULATIONS for v in ("'ALL'", "said"))
    source = f"""SELECT *, 1 + CASE WHEN source_size_chars > b1 THEN 1 ELSE 0 END + CASE WHEN b2 <> b1 AND source_size_chars > b2 THEN 1 ELSE 0 END + CASE WHEN b3 <> b2 AND source_size_chars > b3 THEN 1 ELSE 0 END AS band,
  2 + CASE WHEN b2 <> b1 THEN 1 ELSE 0 END + CASE WHEN b3 <> b2 THEN 1 ELSE 0 END AS bands
  FROM (SELECT *, (SELECT b1 FROM {{edge}}) AS b1, (SELECT b2 FROM {{edge}}) AS b2, (SELECT b3 FROM {{edge}}) AS b3 FROM ({_KEYED}) k WHERE source_size_chars IS NOT NULL) q"""
    whole = "sum(CASE WHEN grp = 'ALL' THEN n END) OVER (PARTITION BY pop)"
    return Summary((Part(source, ("pop", "grp", "band", "bands", "b1", "b2", "b3"), names, labels, {"n": "count(*)"}, stats),), f"""
SELECT pop AS population_name, 'ALL_SUCCESSFUL_AI_GENERATION_SOURCE_SIZE_QUARTILES_LINEAR' AS source_size_band_scheme_name, 'Q' || CAST(band AS STRING) || '_OF_' || CAST(bands AS STRING) AS source_size_band_name, band AS source_size_band_sequence,
  max(CASE WHEN grp = 'ALL' THEN minimum_source_size_chars END) OVER (PARTITION BY pop, band) AS source_size_band_lower_bound_chars, max(CASE WHEN grp = 'ALL' THEN maximum_source_size_chars END) OVER (PARTITION BY pop, band) AS source_size_band_upper_bound_chars,
  b1 AS source_size_band_q25_edge_chars, b2 AS source_size_band_q50_edge_chars, b3 AS source_size_band_q75_edge_chars, grp AS reported_source_group, CAST({whole} AS BIGINT) AS population_attempt_count_with_source_size,
  n AS band_attempt_count, {pct('n', whole)} AS band_attempt_percentage, {', '.join(v for s in stats.values() for v in s.values())} FROM {{g}}""",
                   pre={"edge": Part("SELECT 1 AS one, source_size_chars FROM {gen}", ("one",), metrics={"source_size_chars": {"p25": "b1", "median": "b2", "p75": "b3"}})})


DIMENSIONS = (("SOURCE_SIZE", "source_size"), ("REPORTED_CONTENT_SOURCE", "reported_source"), ("INPUT_METHOD", "input_method"), ("SOURCE_SIGNATURE_PROXY", "source_signature"))
NOTE = "Equal source size and reported source form an unchanged-source proxy; they do not prove identical source text."


def _consistency():
    names = ("grain", "dim", "cat")
    stats = {"l": named("latency_change_ms", n="unit_count_with_latency_change", missing="unit_count_missing_latency_change"), "z": {"median": "median_absolute_source_size_change_chars"}}
    counts = {"n": "count(*)", "latency_decrease_count": _n("l < 0"), "latency_no_change_count": _n("l = 0"), "latency_increase_count": _n("l > 0")}
    grains = {"COMPLETED_AI_STUDY": ("SELECT *, first_to_completion_latency_change_ms AS l, CAST(NULL AS BIGINT) AS z FROM {pth} WHERE preceding_successful_ai_attempt_count > 0", "CASE WHEN any_{0}_change THEN 'CHANGED' ELSE 'UNCHANGED' END"),
              "ALL_CONSECUTIVE_SUCCESSFUL_AI_TRANSITION": ("SELECT *, latency_change_ms AS l, absolute_source_size_change_chars AS z FROM {trn}", "{0}_comparison"),
              "COMPLETED_AI_PATH_CONSECUTIVE_SUCCESSFUL_AI_TRANSITION": ("SELECT t.*, latency_change_ms AS l, absolute_source_size_change_chars AS z FROM {trn} t JOIN (SELECT study_num AS k, comparable_successful_ai_transition_count AS c FROM {pth}) p ON t.study_num = p.k AND t.transition_sequence_number <= p.c", "{0}_comparison"),
              "FIRST_SUCCESSFUL_AI_TO_COMPLETION": ("SELECT *, first_to_completion_latency_change_ms AS l, CAST(NULL AS BIGINT) AS z FROM {pth}", "first_to_completion_{0}_comparison"),
              "PRECEDING_SUCCESSFUL_AI_TO_COMPLETION": ("SELECT *, preceding_to_completion_latency_change_ms AS l, CAST(NULL AS BIGINT) AS z FROM {pth}", "preceding_to_completion_{0}_comparison")}
    parts = tuple(Part(source, names, names, tuple((f"'{g}'", f"'{d}'", cat.format(c)) for d, c in DIMENSIONS), counts, stats) for g, (source, cat) in grains.items())
    fixed = tuple((g, d, c) for g in grains for d, _ in DIMENSIONS for c in (("UNCHANGED", "CHANGED") if g == "COMPLETED_AI_STUDY" else ("SAME", "CHANGED", "MISSING")))
    known = "CASE WHEN cat = 'MISSING' THEN 'MISSING' ELSE 'COMPARABLE' END"
    return Summary(parts, f"""
WITH x AS (SELECT f.grain, f.dim, f.cat, {', '.join(f'coalesce({c}, 0) AS {c}' for c in [*counts, 'unit_count_with_latency_change', 'unit_count_missing_latency_change'])}, {', '.join(v for s in stats.values() for k, v in s.items() if k not in ('n', 'missing'))}, coalesce(studies, 0) AS studies
  FROM {{fix}} f LEFT JOIN {{g}} g ON f.grain = g.grain AND f.dim = g.dim AND f.cat = g.cat LEFT JOIN {{also}} a ON f.grain = a.grain)
SELECT grain AS summary_grain, dim AS comparison_dimension_name, cat AS comparison_category, CAST(sum(n) OVER (PARTITION BY grain, dim) AS BIGINT) AS population_unit_count, studies AS contributing_study_count,
  CAST(sum(n) OVER (PARTITION BY grain, dim, {known}) AS BIGINT) AS eligible_unit_count, n AS category_unit_count, {pct('n', f'sum(n) OVER (PARTITION BY grain, dim, {known})')} AS category_unit_percentage, {', '.join(stats['l'].values())},
  latency_decrease_count, latency_no_change_count, latency_increase_count, CASE WHEN dim = 'SOURCE_SIZE' THEN median_absolute_source_size_change_chars END AS median_absolute_source_size_change_chars, '{NOTE}' AS source_signature_interpretation FROM x""",
                   (names, fixed), " UNION ALL ".join(f"SELECT '{g}' AS grain, count(DISTINCT study_num) AS studies FROM ({s}) s{i}" for i, (g, (s, _)) in enumerate(grains.items())))


COMPLETED_TIME = "First recorded attempt start to completed attempt end, in minutes."
OBSERVED_TIME = "First recorded attempt start to latest observed attempt start, in minutes; this is not follow-up time or a final outcome."
DESCRIPTIVE = "Observed retry patterns are descriptive and may support qualitative follow-up; they do not establish motivation, satisfaction, causality, abandonment, or a final unresolved outcome."
TIMES = {"minutes_first_attempt_to_completion": {"n": "study_count_with_completed_timing", "median": "median_minutes_first_to_completion"},
         "minutes_first_attempt_to_last_observed_attempt": {"n": "study_count_with_unresolved_observed_span", "median": "median_minutes_first_to_last_observed_attempt"},
         "minutes_latest_attempt_to_report_run_cutoff": {"median": "median_minutes_latest_attempt_to_report_run_cutoff"}, "minutes_first_attempt_to_report_run_cutoff": {"median": "median_minutes_first_attempt_to_report_run_cutoff"}}
MEDIANS = [s["median"] for s in TIMES.values()]


def _pathways():
    counts = {"study_count": "count(*)", "study_count_with_mode_change": _n("mode_changed"), "study_count_with_author_change": _n("author_changed"), "study_count_with_ai_error": _n("has_ai_error"),
              "study_count_with_user_dropped_attempt": _n("has_user_dropped_attempt"), "study_count_with_returned_result_ai": _n("has_returned_result_ai"), "source_comparison_eligible_study_count": _n("source_comparison_eligible"),
              **{f"study_count_with_{c}_change": _n(f"any_{c}_change") for _, c in DIMENSIONS}, "ai_exposed_study_count": _n("ai_attempt_count > 0"), "study_count_with_feedback_recorded": _n("feedback_recorded_on_any_ai_attempt"),
              "study_count_with_report_run_cutoff": "count(report_run_cutoff_timestamp)"}
    stats = {"all_attempt_count": {"median": "median_attempt_count", "p75": "percentile_75_attempt_count"}, **TIMES}
    total = "sum(coalesce(study_count, 0)) OVER ()"
    return Summary((Part("SELECT * FROM {ctx}", ("pathway_category",), counts=counts, metrics=stats),), f"""
SELECT f.category AS pathway_category, CAST(f.seq AS INT) AS pathway_sequence, f.state AS completion_state, f.mode AS final_or_latest_mode, CAST({total} AS BIGINT) AS population_study_count, {pct('coalesce(study_count, 0)', total)} AS study_percentage,
  {', '.join(f'coalesce({c}, 0) AS {c}' for c in [*counts, 'study_count_with_completed_timing', 'study_count_with_unresolved_observed_span'])}, median_attempt_count, percentile_75_attempt_count, {', '.join(MEDIANS)},
  CASE WHEN f.state = 'COMPLETED' THEN '{COMPLETED_TIME}' ELSE '{OBSERVED_TIME}' END AS timing_definition, '{DESCRIPTIVE}' AS interpretation_note FROM {{fix}} f LEFT JOIN {{g}} g ON f.category = g.pathway_category""",
                   (("category", "state", "mode", "seq"), tuple((*c, str(i)) for i, c in enumerate(CATEGORIES, 1))))


def _characteristics():
    shares = {"multiple_attempt_study_count": ("all_attempt_count > 1", "percentage_with_multiple_attempts", "study_count"), "both_modes_study_count": ("mode_exposure = 'BOTH'", "percentage_with_both_modes", "study_count"),
              "author_change_study_count": ("author_changed", "percentage_with_author_change", "study_count"), "ai_error_study_count": ("has_ai_error", "percentage_with_ai_error", "study_count"),
              "user_dropped_study_count": ("has_user_dropped_attempt", "percentage_with_user_dropped_attempt", "study_count"), "returned_result_ai_study_count": ("has_returned_result_ai", "percentage_with_returned_result_ai", "study_count"),
              "source_signature_change_study_count": ("source_signature_comparison_eligible AND any_source_signature_change", "percentage_with_source_signature_change_among_eligible", "source_comparison_eligible_study_count"),
              "feedback_recorded_study_count": ("ai_attempt_count > 0 AND feedback_recorded_on_any_ai_attempt", "percentage_with_feedback_recorded_among_ai_exposed", "ai_exposed_study_count")}
    counts = {"study_count": "count(*)", "source_comparison_eligible_study_count": _n("source_signature_comparison_eligible"), "ai_exposed_study_count": _n("ai_attempt_count > 0"),
              "study_count_with_report_run_cutoff": "count(report_run_cutoff_timestamp)", **{c: _n(e) for c, (e, _, _) in shares.items()}}
    stats = {"all_attempt_count": {"median": "median_attempt_count"}, **TIMES}
    return Summary((Part("SELECT *, CASE WHEN completion_state = 'COMPLETED' THEN 'COMPLETED_' || final_or_latest_mode ELSE completion_state END AS grp FROM {ctx}", ("grp",), counts=counts, metrics=stats),), f"""
SELECT f.grp AS study_outcome_group, {', '.join(f'coalesce({c}, 0) AS {c}' for c in [*counts, 'study_count_with_completed_timing', 'study_count_with_unresolved_observed_span'])}, {', '.join(f'{pct(c, d)} AS {p}' for c, (_, p, d) in shares.items())},
  median_attempt_count, {', '.join(MEDIANS)}, CASE WHEN f.grp = 'NO_COMPLETION_OBSERVED' THEN '{OBSERVED_TIME}' ELSE '{COMPLETED_TIME}' END AS timing_definition, '{DESCRIPTIVE}' AS interpretation_note FROM {{fix}} f LEFT JOIN {{g}} g ON f.grp = g.grp""",
                   (("grp",), (("COMPLETED_AI",), ("COMPLETED_MANUAL",), ("NO_COMPLETION_OBSERVED",))))


def _cards():
    counts = {"study_count": "count(*)", "ai_only_study_count": _n("mode_exposure = 'AI_ONLY'"), "manual_only_study_count": _n("mode_exposure = 'MANUAL_ONLY'"), "both_modes_study_count": _n("mode_exposure = 'BOTH'")}
    groups = tuple((f"{f}_{s}",) for s in ("COMPLETED", "NO_COMPLETION_OBSERVED") for f in ("SINGLE_ATTEMPT", "MULTIPLE_ATTEMPTS"))
    total = "sum(coalesce(study_count, 0)) OVER ()"
    return Summary((Part("SELECT *, attempt_frequency || '_' || completion_state AS grp FROM {ctx}", ("grp",), counts=counts, metrics={"all_attempt_count": {"median": "median_attempt_count"}}),), f"""
SELECT f.grp AS retry_card_group, {', '.join(f'coalesce({c}, 0) AS {c}' for c in counts)}, CAST({total} AS BIGINT) AS population_study_count, {pct('coalesce(study_count, 0)', total)} AS study_percentage, median_attempt_count
FROM {{fix}} f LEFT JOIN {{g}} g ON f.grp = g.grp""", (("grp",), groups))


CONTEXTS = {"a21_concordance": _concordance(), "a22_matrix": _matrix(), "a23_distribution": _distribution(), "a24_size_latency": _sizes(), "a25_consistency": _consistency(), "a26_pathways": _pathways(),
            "a27_characteristics": _characteristics(), "a28_retry_cards": _cards()}
