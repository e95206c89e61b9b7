"""All tables of an exploration as CSV folders with a manifest, written beside their place and renamed."""
import itertools
import json
import re
from datetime import datetime, timezone
from pathlib import Path

from pyspark.sql import functions as F

from revisio import report
from revisio.derived import Derived
from revisio.operators import quality
from revisio.operators.context_tables import CONTEXTS
from revisio.operators.field_tables import FIELDS
from revisio.operators.tables import ATTEMPTS
from revisio.sources import csv

#: Folder of each published table.
SUMMARIES = {
    "overview/study_attempt_history_summary": "a02_study_modes", "overview/author_handoff_summary": "a03_handoffs", "overview/study_retry_pathway_summary": "a26_pathways", "overview/retry_characteristics_summary": "a27_characteristics",
    "overview/repeated_attempt_source_consistency_summary": "a25_consistency", "attempts/grouped_attempt_summary": "a04_grouped_attempts", "attempts/source_context_distribution_summary": "a23_distribution",
    "attempts/source_size_latency_summary": "a24_size_latency", "attempts/content_source_concordance_summary": "a21_concordance", "attempts/content_source_concordance_matrix": "a22_matrix", "studies/completed_study_author_context_summary": "a06_completed_context",
    "studies/grouped_study_summary": "a05_grouped_studies", "authors/grouped_author_summary": "a07_grouped_authors", "authors/attempt_start_experience_summary": "a08_start_experience", "authors/current_author_experience_summary": "a09_current_experience",
    "fields/field_adoption_editing_summary": "a11_field_adoption", "fields/nontext_field_adoption_summary": "a12_nontext", "fields/suggestion_selection_summary": "a13_suggestions", "fields/compensation_analysis_summary": "a14_compensation",
    "readability/selected_vs_unselected_readability_summary": "a16_selected_vs_rest", "readability/field_readability_change_summary": "a17_readability_change", "readability/field_edit_readability_cross_summary": "a18_edit_readability",
    "readability/field_readability_target_summary": "a19_targets", "readability/final_text_metric_summary": "a20_final_metrics",
}
RECORDS = {"study_attempt_author_history": "att", "study_attempt_history": "stu", "author_history": "aut", "completed_ai_field_analysis": "fld", "completed_ai_readability_pairs": "prs"}
MANIFEST = "analysis_manifest.json"


def _payload(df, order):
    """The rows as one JSON list, keys sorted and nulls kept."""
    rows = df.select(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}).alias("j"), *order)
    return rows.groupBy().agg(F.array_sort(F.collect_list(F.struct(*order, "j"))).alias("x")).select(F.concat(F.lit("["), F.array_join(F.transform("x", lambda r: r["j"]), ","), F.lit("]")).alias("payload"))


def tables(t):
    """{folder: frame} of everything that is published."""
    specs = ATTEMPTS | FIELDS | CONTEXTS
    for s in RECORDS.values():
        getattr(t, s)  # written now, as all that follows reads them
    out = {"quality/data_quality_summary": quality.summary(t.rec, t.ast, t.rdb), "overview/overview_summary": quality.overview(t), **{f: specs[s].frame_of(t) for f, s in SUMMARIES.items()},
           "analysis-audit-records/data_quality_findings": quality.findings(t.rec), **{f"analysis-audit-records/{f}": getattr(t, s) for f, s in RECORDS.items()}}
    bins = _payload(specs["a10_activity_bins"].frame_of(t), ("metric_name", "author_adoption_group", "bin_sequence"))
    key = "authors/current_author_experience_summary"
    out[key] = out[key].withColumn("author_activity_percentile_bins_json", bins.scalar())
    mix, key = specs["a15_offer_composition"].frame_of(t), "fields/compensation_analysis_summary"
    order = ("population_name", "offer_composition_category", "generic_suggestion_count", "specific_suggestion_count", "consistency_category")
    for grain, column in (("OFFER_COMPOSITION", "offer_composition_summary_json"), ("OFFER_COUNT_PAIR", "offer_count_pair_summary_json"), ("WORKFLOW_CONSISTENCY", "workflow_consistency_summary_json")):
        out[key] = out[key].withColumn(column, _payload(mix.where(F.col("summary_grain") == grain), order).scalar())
    return out


def _place(column, names):
    return F.array_position(F.array(*map(F.lit, names)), F.col(column))


#: Order of the rows of tables that are not in order of their groups.
ORDERS = {"quality/data_quality_summary": lambda: [_place("data_quality_check_name", [k[0] for k in quality.CHECKS])], "overview/overview_summary": lambda: [_place("overview_metric_name", [r[2] for r in quality.OVERVIEW])],
          "overview/study_retry_pathway_summary": lambda: ["pathway_sequence"], "analysis-audit-records/data_quality_findings": quality.findings_order,
          "analysis-audit-records/study_attempt_author_history": lambda: ["study_num", "attempt_sequence_number"], "analysis-audit-records/completed_ai_field_analysis": lambda: ["audit_record_id", "field_name"],
          "analysis-audit-records/completed_ai_readability_pairs": lambda: ["audit_record_id", "field_name", "suggestion_kind", "suggestion_index", "readability_measure_name"]}
MEASURED = re.compile(r"(^|_)(count|percentage|rate|minutes|maximum|minimum|median|average)(_|$)")


def order(name, df):
    """Sort expressions of a published table: its own, or its groups, which are the columns before the first number; nulls last."""
    if name in ORDERS:
        return ORDERS[name]()
    return [F.asc_nulls_last(c) for c in itertools.takewhile(lambda c: not MEASURED.search(c), df.columns)]


def publish(spark, source, path):
    """Checks a report, derives and writes all its tables and the manifest; returns the manifest. The report's files are parsed once, and each derived table is made once."""
    loaded = report.load(spark, source)
    t = Derived(spark, {n: (lambda f: lambda: f)(loaded[f]) for n, f in zip(("rec", "ast", "rdb"), report.TABLES)}, report.cutoff(loaded["metadata"]))
    counts = quality.check(t.rec, t.ast, t.rdb)

    def work(folder):
        rows = {name: csv.write(df, f"{folder}/{name}", order=order(name, df)) for name, df in tables(t).items()}
        warned = quality.raw_findings(t.rec).groupBy("name").agg(F.countDistinct("ID").alias("n")).agg(F.sum("n")).first()[0] or 0
        manifest = {"generated_at_utc": datetime.now(timezone.utc).isoformat(), "source_report_directory": str(source), "source_counts": counts, "row_counts": rows, "warning_attempt_count": warned, "output_count": len(rows) + 1}
        report.put_json(folder / MANIFEST, manifest)
        return manifest

    return report.staged(path, work)


def quality_rows(spark, path):
    """The published checks, held against the manifest."""
    manifest = json.loads(Path(f"{path}/{MANIFEST}").read_text("utf-8"))
    names = ("data_quality_check_name", "severity_level", "affected_attempt_count", "affected_distinct_study_count", "affected_distinct_author_count", "eligible_attempt_count", "affected_attempt_percentage", "check_definition", "analysis_consequence")
    rows = [r.asDict() for r in csv.texts(spark, f"{path}/quality/data_quality_summary/*.csv", [(n, "string", True) for n in names], nulls=("\\N",)).collect()]
    known = {k[0]: k for k in quality.CHECKS}
    if len(rows) != manifest["row_counts"]["quality/data_quality_summary"] or {r["data_quality_check_name"] for r in rows} != set(known):
        raise ValueError("published checks do not fit the manifest")
    for r in rows:
        r |= {n: int(r[n]) for n in names[2:6]}
        if known[r["data_quality_check_name"]][1] != r["severity_level"] or r["severity_level"] == "FATAL" and r["affected_attempt_count"] or r["affected_attempt_count"] > max(r["eligible_attempt_count"], 0):
            raise ValueError(f"check {r['data_quality_check_name']} is not as a published one can be")
    if sum(r["affected_attempt_count"] for r in rows if r["severity_level"] == "WARNING") != manifest["warning_attempt_count"]:
        raise ValueError("warnings do not add up to the manifest's")
    order = list(known)
    return sorted(rows, key=lambda r: order.index(r["data_quality_check_name"]))


def quality_text(rows):
    """The checks as a short text."""
    fatal, warn = ([r for r in rows if r["severity_level"] == s] for s in ("FATAL", "WARNING"))
    hit = [r for r in warn if r["affected_attempt_count"]]
    lines = ["Data-quality summary", "", f"Fatal checks passed: {len(fatal)} of {len(fatal)}", f"Warnings found: {len(hit)} of {len(warn)}", ""]
    for r in hit:
        share = "none" if r["affected_attempt_percentage"] is None else f"{float(r['affected_attempt_percentage']):.1f}%"
        lines += [f"- {r['data_quality_check_name']}: {r['affected_attempt_count']} of {r['eligible_attempt_count']} attempts ({share}), {r['affected_distinct_study_count']} studies, {r['affected_distinct_author_count']} authors", f"  {r['analysis_consequence']}"]
    return "\n".join([*lines, *(f"- {r['data_quality_check_name']}: none" for r in warn if not r["affected_attempt_count"])]) + "\n"
