"""Published summaries as specifications: where rows come from, the labels they count under, and what is said of a group.

A specification runs on Spark (`frame_of`) and reads as SQL (`sql_of`). Texts name tables as {att} and the like:
att attempts, stu studies, aut authors, atx and stx the same with grouping columns, app appointments, gen generations,
trn transitions, pth pathways, ctx retry context, fld completed AI fields, prs readability pairs, rdb readability rows."""
import re
from dataclasses import dataclass, field

from pyspark.sql import functions as F

from revisio.shared import written
from revisio.sql import frame
from revisio.stats import Labels, described, described_sql, expanded_sql, fixed_rows, fixed_sql, named, union


def pct(n, d):
    return f"1E2 * {n} / nullif({d}, 0)"


@dataclass
class Part:
    source: str
    keys: tuple
    names: tuple = ()
    labels: tuple = ()
    counts: dict = field(default_factory=dict)
    metrics: dict = field(default_factory=dict)
    #: Columns that become rows: their names in `measure`, their values in `value`.
    stacked: tuple = ()

    def taken(self, df):
        """Columns of df that the keys, labels and statistics speak of, one at least."""
        words = set(re.findall(r"[a-z_]\w*", " ".join([*self.keys, *(t for r in self.labels for t in r), *self.counts.values(), *self.metrics, *self.stacked]).lower()))
        return [c for c in df.columns if c.lower() in words] or df.columns[:1]


@dataclass
class Summary:
    parts: tuple
    final: str
    fixed: tuple = None
    also: str = None
    pre: dict = field(default_factory=dict)

    def frame_of(self, t):
        early = {}
        texts = [*(p.source for p in (*self.pre.values(), *self.parts)), self.also or ""]
        once = {n for n in t.LEAN + t.PLAIN if sum(x.count("{" + n + "}") for x in texts) == 1}

        def table(text):
            """The frame of a text; wide tables of which this summary reads only some columns, once, are not written for it."""
            taken = lambda n: t.lean(n) if n in once else getattr(t, n)
            return frame(text, **{n: early[n] if n in early else taken(n).hint("merge") if " JOIN " in text else taken(n) for n in _tables(text)})

        for n, p in self.pre.items():
            early[n] = written(described(table(p.source), list(p.keys), p.metrics, **p.counts))
        done = []
        for p in self.parts:
            x = table(p.source)
            # several aggregates read the rows: where these are more than a written table, the columns they take are written
            if not (p.source.startswith("SELECT * FROM {") and p.source.count(" ") == 3 and p.source[15:18] in vars(t)) or p.source[15:18] in t.PLAIN:
                x = written(x.select(*p.taken(x)))
            if p.stacked:
                x = x.withColumn("__s", F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).cast("double").alias("value")) for m in p.stacked]))).select("*", "__s.*").drop("__s", *p.stacked)
            done.append(described(x, list(p.keys), p.metrics, Labels(p.names, p.labels) if p.labels else None, **p.counts))
        more = {"g": union(done), **early}
        if self.fixed:
            more["fix"] = fixed_rows(t.spark, *self.fixed)
        if self.also:
            more["also"] = table(self.also)
        return frame(self.final, **more)

    def sql_of(self, query):
        texts = []
        for p in self.parts:
            x = f"({p.source.strip()})"
            if p.stacked:
                x = f"(SELECT * EXCLUDE (__s), unnest(__s) FROM (SELECT *, unnest([{', '.join(f'struct_pack(measure := {chr(39)}{m}{chr(39)}, value := CAST({m} AS DOUBLE))' for m in p.stacked)}]) AS __s FROM {x} z))"
            x = expanded_sql(x, p.labels, p.names) if p.labels else x
            items = [", ".join(p.keys), *(f"{e} AS {n}" for n, e in p.counts.items())] + ([described_sql(p.metrics)] if p.metrics else [])
            texts.append(f"SELECT {', '.join(items)} FROM {x} AS x GROUP BY {', '.join(p.keys)}")
        more = {"g": " UNION ALL BY NAME ".join(texts)}
        if self.fixed:
            more["fix"] = f"SELECT * FROM {fixed_sql(*self.fixed)}"
        if self.also:
            more["also"] = self.also
        for n, p in self.pre.items():
            more[n] = f"SELECT {', '.join([*p.keys, *(f'{e} AS {c}' for c, e in p.counts.items()), described_sql(p.metrics)])} FROM ({p.source}) GROUP BY {', '.join(p.keys)}"
        return query(self.final, **more)


def _tables(text):
    return set(re.findall(r"\{(\w+)\}", text))


MISSING = "coalesce({0}, 'MISSING')"
SPENT = {"study_info_page_minutes": named("study_info_page_minutes", n="attempt_count_with_nonmissing_study_info_page_time", missing="attempt_count_missing_study_info_page_time"),
         "total_attempt_duration_minutes": named("total_attempt_minutes", n="attempt_count_with_nonmissing_total_attempt_time", missing="attempt_count_missing_total_attempt_time")}
BEFORE = {"study_count_with_preceding_incomplete_attempts": "count(CASE WHEN preceding_incomplete_attempt_count > 0 THEN 1 END)",
          **{f"total_{c}": f"CAST(sum({c}) AS BIGINT)" for c in ("preceding_incomplete_attempt_count", "preceding_ai_error_attempt_count", "preceding_ai_error_without_stack_trace_attempt_count", "preceding_user_dropped_attempt_count")}}
UNTIL = "minutes_first_attempt_to_completion"

# --- attempts, studies, authors ------------------------------------------------------------


def _study_modes():
    stats = {"preceding_incomplete_attempt_count": named("preceding_incomplete_attempt_count", "min p25 median mean p75 p90 max"), UNTIL: named(UNTIL, "min median mean sd max")}
    counts = {"n": "count(*)", "study_count_with_no_completed_attempt": "count(CASE WHEN NOT study_is_completed THEN 1 END)", **BEFORE,
              "study_count_with_author_change_before_completion": "count(CASE WHEN author_changed_before_completion THEN 1 END)"}
    cols = ", ".join(f"coalesce({c}, 0) AS {c}" for c in counts if c != "n")
    return Summary((Part("SELECT * FROM {stu}", ("mode",), ("mode",), (("'ALL'",), ("CASE WHEN study_is_completed THEN completed_attempt_authoring_mode ELSE 'NOT_COMPLETED' END",)), counts, stats),), f"""
SELECT f.mode AS final_completion_authoring_mode, coalesce(n, 0) AS distinct_study_count, {cols}, {pct('study_count_with_preceding_incomplete_attempts', 'n')} AS study_percentage_with_preceding_incomplete_attempts,
  {', '.join(c for s in stats.values() for c in s.values())}, {pct('study_count_with_author_change_before_completion', 'n')} AS study_percentage_with_author_change_before_completion
FROM {{fix}} f LEFT JOIN {{g}} g ON f.mode = g.mode""", (("mode",), (("ALL",), ("AI",), ("MANUAL",), ("NOT_COMPLETED",))))


def _handoffs():
    keys = ("completed_attempt_authoring_mode", "preceding_attempt_authoring_mode", "preceding_attempt_result", "author_handoff_category")
    stats = {UNTIL: named(UNTIL, "min p25 median mean sd p75 max")}
    return Summary((Part("""
SELECT completed_attempt_authoring_mode, coalesce(m, 'NONE') AS preceding_attempt_authoring_mode, coalesce(r, 'NONE') AS preceding_attempt_result, minutes_first_attempt_to_completion,
  CASE WHEN preceding_incomplete_attempt_count = 0 THEN 'NO_PRECEDING_ATTEMPT' WHEN preceding_incomplete_attempt_count_by_completion_author > 0 AND preceding_incomplete_attempt_count_by_other_authors > 0 THEN 'MIXED_COMPLETION_AND_OTHER_AUTHORS'
    WHEN preceding_incomplete_attempt_count_by_completion_author > 0 THEN 'ALL_PRECEDING_ATTEMPTS_BY_COMPLETION_AUTHOR' ELSE 'ALL_PRECEDING_ATTEMPTS_BY_OTHER_AUTHORS' END AS author_handoff_category
FROM {stu} s LEFT JOIN (SELECT study_num AS k, max_by(attempt_authoring_mode, attempt_sequence_number) AS m, max_by(attempt_result, attempt_sequence_number) AS r FROM {att} WHERE is_preceding_incomplete_attempt GROUP BY study_num) p
  ON s.study_num = p.k WHERE study_is_completed""", keys, counts={"n": "count(*)"}, metrics=stats),), f"""
SELECT {', '.join(keys)}, n AS distinct_completed_study_count, CAST(sum(n) OVER () AS BIGINT) AS population_distinct_completed_study_count, {pct('n', 'sum(n) OVER ()')} AS distinct_completed_study_percentage, {', '.join(stats[UNTIL].values())} FROM {{g}}""")


def _grouped_attempts():
    c, r, m, s, k = "attempt_completion_group", "attempt_result", "attempt_authoring_mode", "source_type", "study_content_source"
    v = {x: MISSING.format(x) for x in (c, r, m, s, k)}
    al, no = "'ALL'", "'NONE'"
    rows = [(al, al, al, "'ALL'", al, no, no), (v[c], al, al, "'COMPLETION_GROUP'", v[c], no, no), (al, v[r], al, "'ATTEMPT_RESULT'", v[r], no, no), (al, al, v[m], "'AUTHORING_MODE'", v[m], no, no),
            (v[c], al, v[m], "'COMPLETION_GROUP'", v[c], "'AUTHORING_MODE'", v[m]), (al, v[r], v[m], "'ATTEMPT_RESULT'", v[r], "'AUTHORING_MODE'", v[m]), (al, al, al, "'SOURCE_TYPE'", v[s], no, no),
            (al, al, al, "'STUDY_CONTENT_SOURCE'", v[k], no, no), (al, al, al, "'SOURCE_TYPE'", v[s], "'STUDY_CONTENT_SOURCE'", v[k])]
    names = ("g1", "g2", "g3", "grouping_dimension_1_name", "grouping_dimension_1_value", "grouping_dimension_2_name", "grouping_dimension_2_value")
    total = "max(CASE WHEN grouping_dimension_1_name = 'ALL' THEN n END) OVER ()"
    return Summary((Part("SELECT * FROM {atx}", names, names, tuple(rows), {"n": "count(*)"}, SPENT),), f"""
SELECT g1 AS attempt_completion_group, g2 AS attempt_result, g3 AS attempt_authoring_mode, {', '.join(names[3:])}, n AS attempt_count, {total} AS population_attempt_count, {pct('n', total)} AS attempt_percentage_within_population,
  {', '.join(x for st in SPENT.values() for x in st.values())} FROM {{g}}""")


APPOINTED = tuple((source, column, f"{source}_{column.upper()}") for source in ("AUTHOR", "PI") for column in ("appointment_title", "appointment_department", "appointment_school"))


def _grouped_studies():
    pops = (("ALL_STUDIES_WITH_ATTEMPTS", "true"), ("COMPLETED_STUDIES", "study_is_completed"), ("STUDIES_WITHOUT_COMPLETION", "NOT study_is_completed"))
    modes = (("ALL", "true"), ("AI", "study_is_completed AND completed_attempt_authoring_mode = 'AI'"), ("MANUAL", "study_is_completed AND completed_attempt_authoring_mode = 'MANUAL'"), ("NOT_COMPLETED", "NOT study_is_completed"))
    cols = ("study_participant_type", "study_department", "source_type", "study_content_source")
    v = {c: MISSING.format(c) for c in cols}
    dims = [("'ALL'", "'ALL'", "'NONE'", "'NONE'"), *((f"'{c.upper()}'", v[c], "'NONE'", "'NONE'") for c in cols), *((f"'{a.upper()}'", v[a], f"'{b.upper()}'", v[b]) for a, b in (cols[:2], cols[2:]))]
    groups = [(f"CASE WHEN ({pc}) AND ({mc}) THEN '{p}' END", f"'{m}'") for p, pc in pops for m, mc in modes]
    names = ("pop", "mode", "d1n", "d1v", "d2n", "d2v", "own")
    stats = {"preceding_incomplete_attempt_count": named("preceding_incomplete_attempt_count", "min p25 median mean p75 max"), UNTIL: named(UNTIL, "min p25 median mean sd p75 max"),
             "completed_attempt_study_info_page_minutes": named("completed_attempt_study_info_page_minutes", "min median mean sd max")}
    counts = {"n": "count(*)", **BEFORE}
    each = "SELECT x.*, y.value, y.dim FROM {stx} x JOIN (SELECT DISTINCT audit_record_id AS k, dim, value FROM (" + " UNION ALL ".join(
        f"SELECT audit_record_id, '{d}' AS dim, {c} AS value FROM {{app}} WHERE appointment_source = '{s}'" for s, c, d in APPOINTED) + ") z) y ON x.snapshot_record_id = y.k"
    total = "max(CASE WHEN mode = 'ALL' AND d1n = 'ALL' THEN n END) OVER (PARTITION BY pop)"
    cols = ", ".join(f"{c}" for c in BEFORE)
    return Summary((Part("SELECT * FROM {stx}", names, names, tuple((*g, *d, "'true'") for g in groups for d in dims), counts, stats),
                    Part(each, names, names, tuple((*g, "dim", "value", "'NONE'", "'NONE'", "'false'") for g in groups), counts, stats)), f"""
SELECT pop AS study_population_name, mode AS final_completion_authoring_mode, d1n AS grouping_dimension_1_name, d1v AS grouping_dimension_1_value, d2n AS grouping_dimension_2_name, d2v AS grouping_dimension_2_value,
  own = 'true' AS group_values_are_mutually_exclusive, n AS distinct_study_count, {total} AS population_distinct_study_count, {pct('n', total)} AS distinct_study_percentage_within_population, {cols},
  {pct('study_count_with_preceding_incomplete_attempts', 'n')} AS study_percentage_with_preceding_incomplete_attempts, {', '.join(x for s in stats.values() for x in s.values())}
FROM (SELECT coalesce(f.pop, g.pop) AS pop, coalesce(f.mode, g.mode) AS mode, coalesce(f.d1n, g.d1n) AS d1n, coalesce(f.d1v, g.d1v) AS d1v, coalesce(f.d2n, g.d2n) AS d2n, coalesce(f.d2v, g.d2v) AS d2v, coalesce(f.own, g.own) AS own,
  coalesce(n, 0) AS n, {', '.join(f'coalesce({c}, 0) AS {c}' for c in BEFORE)}, {', '.join(x for s in stats.values() for x in s.values())}
  FROM {{fix}} f FULL OUTER JOIN {{g}} g ON f.pop = g.pop AND f.mode = g.mode AND f.d1n = g.d1n AND f.d1v = g.d1v AND f.d2n = g.d2n AND f.d2v = g.d2v) q""",
                   (names, tuple((p, "ALL", "ALL", "ALL", "NONE", "NONE", "true") for p, _ in pops)))


def _completed_context():
    names = ("context_dimension_name", "context_dimension_value")
    keys = (*names, "attempt_authoring_mode")
    by = "sum(n) OVER (PARTITION BY context_dimension_name{0})"
    mode, both = by.format(", attempt_authoring_mode"), by.format("")
    return Summary((Part("SELECT * FROM {att} WHERE is_completed_attempt", keys, names, (("'EFFECTIVE_ROLE'", "effective_attempt_author_role"), ("'PI_STATUS'", "CASE WHEN attempt_author_is_study_pi THEN 'PI' ELSE 'NON_PI' END")),
                         {"n": "count(*)", "authors": "count(DISTINCT attempt_author_user_name)"}),), f"""
SELECT context_dimension_name, context_dimension_value, attempt_authoring_mode AS final_completion_authoring_mode, n AS completed_study_count, CAST({mode} AS BIGINT) AS mode_completed_study_count,
  CAST({both} AS BIGINT) AS all_completed_study_count, {pct('n', mode)} AS completed_study_percentage_within_mode, {pct('n', both)} AS completed_study_percentage_overall, authors AS distinct_completion_author_count FROM {{g}}""")


def _grouped_authors():
    names = ("c", "m", "r", "dn", "dv", "own")
    base = [(cc, mm, "'ALL'", "'ALL'", "'ALL'", "'true'") for cc in ("'ALL'", "attempt_completion_group") for mm in ("'ALL'", "attempt_authoring_mode")]
    role = MISSING.format("effective_attempt_author_role")

    def authors(cond):
        return f"count(DISTINCT CASE WHEN {cond} THEN attempt_author_user_name END)"

    ai, manual = "attempt_authoring_mode = 'AI'", "attempt_authoring_mode = 'MANUAL'"
    counts = {"distinct_author_count": "count(DISTINCT attempt_author_user_name)", "distinct_author_count_with_any_ai_attempt": authors(ai), "distinct_author_count_with_any_manual_attempt": authors(manual),
              "either": authors(f"{ai} OR {manual}"), "distinct_author_count_with_completed_attempt": authors("is_completed_attempt"), "distinct_author_count_with_incomplete_attempt": authors("NOT is_completed_attempt"),
              "distinct_named_pi_count": "count(DISTINCT study_pi_user_name)", "distinct_author_count_classified_as_pi": authors("attempt_author_is_study_pi")}
    held = """SELECT * FROM (SELECT a.*, dim, value, row_number() OVER (PARTITION BY dim, value, attempt_author_user_name ORDER BY a.study_num, attempt_start_timestamp NULLS LAST, audit_record_id, appointment_index) AS nth
  FROM {att} a JOIN (""" + " UNION ALL ".join(f"SELECT audit_record_id AS k, appointment_index, '{d}' AS dim, {c} AS value FROM {{app}} WHERE appointment_source = '{s}'" for s, c, d in APPOINTED) + ") p ON a.audit_record_id = p.k) q WHERE nth = 1"
    total = "max(CASE WHEN c = 'ALL' AND m = 'ALL' AND dn = 'ALL' THEN distinct_author_count END) OVER ()"
    return Summary((Part("SELECT * FROM {att}", names, names, (*base, ("'ALL'", "'ALL'", role, "'EFFECTIVE_AUTHOR_ROLE'", role, "'true'")), counts),
                    Part(held, names, names, (("'ALL'", "'ALL'", "'ALL'", "dim", "value", "'false'"),), counts)), f"""
SELECT 'ALL_AUTHORS' AS author_population_name, c AS attempt_completion_group, m AS attempt_authoring_mode, r AS effective_author_role, dn AS grouping_dimension_name, dv AS grouping_dimension_value, own = 'true' AS group_values_are_mutually_exclusive,
  distinct_author_count, {total} AS population_distinct_author_count, {pct('distinct_author_count', total)} AS distinct_author_percentage_within_population, distinct_author_count_with_any_ai_attempt, distinct_author_count_with_any_manual_attempt,
  distinct_author_count_with_any_ai_attempt + distinct_author_count_with_any_manual_attempt - either AS distinct_author_count_with_both_modes, distinct_author_count_with_completed_attempt, distinct_author_count_with_incomplete_attempt,
  distinct_named_pi_count, distinct_author_count_classified_as_pi FROM {{g}}""")


ADOPTION = ("ALL_AUTHORS", "AI_ONLY", "MANUAL_ONLY", "BOTH_AI_AND_MANUAL")


def _start_experience():
    names = ("a", "c", "m")
    x = "prior_studies_created_before_attempt_start_count"
    stats = {x: named("author_attempt_value", n="author_attempt_count_with_nonmissing_metric", missing="author_attempt_count_missing_metric")}
    rows = tuple((a, c, m) for a in ("'ALL_AUTHORS'", "author_adoption_group") for c in ("'ALL'", "attempt_completion_group") for m in ("'ALL'", "attempt_authoring_mode"))
    return Summary((Part("SELECT a.*, u.author_adoption_group FROM {att} a LEFT JOIN {aut} u ON a.attempt_author_user_name = u.author_user_name", names, names, rows, {}, stats),), f"""
SELECT f.a AS author_adoption_group, f.c AS attempt_completion_group, f.m AS attempt_authoring_mode, '{x}' AS experience_metric_name, 'studies' AS experience_metric_unit,
  coalesce(author_attempt_count_with_nonmissing_metric, 0) AS author_attempt_count_with_nonmissing_metric, coalesce(author_attempt_count_missing_metric, 0) AS author_attempt_count_missing_metric,
  {', '.join(v for s, v in stats[x].items() if s not in ('n', 'missing'))}, 'Studies created by the attempt author before START_TIME.' AS experience_value_definition
FROM {{fix}} f LEFT JOIN {{g}} g ON f.a = g.a AND f.c = g.c AND f.m = g.m""", (names, tuple((a, c, m) for a in ADOPTION for c in ("ALL", "COMPLETE", "INCOMPLETE") for m in ("ALL", "AI", "MANUAL"))))


#: Metric, unit, definition.
EXPERIENCE = (("total_studies_created_as_of_report_query_count", "studies", "Total studies created by the author when the report query ran."),
              ("other_study_memberships_as_of_report_query_count", "studies", "Other study memberships when the report query ran."),
              ("distinct_login_days_as_of_report_query_count", "days", "Distinct calendar login days available when the report query ran."),
              ("login_history_span_days_as_of_report_query", "days", "Elapsed days from first to latest login available at query time."))

def _current_experience():
    stats = {"value": named("author_value", n="author_count_with_nonmissing_metric", missing="author_count_missing_metric")}
    return Summary((Part("SELECT * FROM {aut}", ("a", "measure"), ("a",), (("'ALL_AUTHORS'",), ("author_adoption_group",)), {}, stats, tuple(m for m, _, _ in EXPERIENCE)),), f"""
SELECT f.a AS author_adoption_group, f.metric AS experience_metric_name, f.unit AS experience_metric_unit, coalesce(author_count_with_nonmissing_metric, 0) AS author_count_with_nonmissing_metric,
  coalesce(author_count_missing_metric, 0) AS author_count_missing_metric, {', '.join(v for s, v in stats['value'].items() if s not in ('n', 'missing'))}, f.said AS experience_value_definition
FROM {{fix}} f LEFT JOIN {{g}} g ON f.a = g.a AND f.metric = g.measure""", (("a", "metric", "unit", "said"), tuple((a, *m) for a in ADOPTION for m in EXPERIENCE)))


def _short(x):
    return f"CASE WHEN {x} = floor({x}) THEN CAST(CAST({x} AS BIGINT) AS STRING) ELSE CAST({x} AS STRING) END"


def _activity_bins():
    """Boundaries are the overall percentiles; a value on a boundary is in the lower bin; empty bins stay."""
    values = " UNION ALL ".join(f"SELECT author_adoption_group, '{m}' AS metric, CAST({m} AS DOUBLE) AS value FROM {{aut}}" for m, _, _ in EXPERIENCE[:2])
    fixed = tuple((m, a, str(i)) for m, _, _ in EXPERIENCE[:2] for a in ADOPTION for i in (1, 2, 3, 4))
    return Summary((Part(values, ("metric",), metrics={"value": {"median": "b1", "p75": "b2", "p90": "b3"}}),), f"""
WITH v AS (SELECT /*+ BROADCAST(g) */ a.metric, a.author_adoption_group, value, b1, b2, b3, 1 + CASE WHEN value > b1 THEN 1 ELSE 0 END + CASE WHEN value > b2 THEN 1 ELSE 0 END + CASE WHEN value > b3 THEN 1 ELSE 0 END AS bin FROM {{also}} a JOIN {{g}} g ON a.metric = g.metric),
k AS (SELECT metric, author_adoption_group AS grp, CASE WHEN value IS NOT NULL THEN bin END AS bin, count(*) AS n FROM v GROUP BY metric, author_adoption_group, CASE WHEN value IS NOT NULL THEN bin END),
c AS (SELECT f.metric, f.a, CAST(f.bin AS INT) AS bin, CAST(coalesce(sum(CASE WHEN k.bin = CAST(f.bin AS INT) THEN n END), 0) AS BIGINT) AS n, CAST(coalesce(sum(CASE WHEN k.bin IS NOT NULL THEN n END), 0) AS BIGINT) AS seen, CAST(coalesce(sum(CASE WHEN k.bin IS NULL THEN n END), 0) AS BIGINT) AS gone
  FROM {{fix}} f LEFT JOIN k ON f.metric = k.metric AND (f.a = 'ALL_AUTHORS' OR f.a = k.grp) GROUP BY f.metric, f.a, f.bin)
SELECT c.metric AS metric_name, c.a AS author_adoption_group, bin AS bin_sequence, CASE bin WHEN 2 THEN b1 WHEN 3 THEN b2 WHEN 4 THEN b3 END AS lower_bound, CASE bin WHEN 1 THEN b1 WHEN 2 THEN b2 WHEN 3 THEN b3 END AS upper_bound,
  false AS lower_bound_inclusive, bin < 4 AS upper_bound_inclusive, CASE bin WHEN 1 THEN 'At or below overall median (' || {_short('b1')} || ')' WHEN 2 THEN 'Above median through overall 75th percentile (' || {_short('b2')} || ')'
    WHEN 3 THEN 'Above 75th through overall 90th percentile (' || {_short('b3')} || ')' ELSE 'Above overall 90th percentile (' || {_short('b3')} || ')' END AS display_label,
  n AS author_count, seen AS observed_value_denominator, {pct('n', 'seen')} AS author_percentage, gone AS missing_author_count, 'OVERALL_AUTHOR_PERCENTILES_50_75_90' AS binning_scheme
FROM c JOIN {{g}} g ON c.metric = g.metric WHERE b1 IS NOT NULL""", (("metric", "a", "bin"), fixed), values)


ATTEMPTS = {"a02_study_modes": _study_modes(), "a03_handoffs": _handoffs(), "a04_grouped_attempts": _grouped_attempts(), "a05_grouped_studies": _grouped_studies(), "a06_completed_context": _completed_context(),
            "a07_grouped_authors": _grouped_authors(), "a08_start_experience": _start_experience(), "a09_current_experience": _current_experience(), "a10_activity_bins": _activity_bins()}
