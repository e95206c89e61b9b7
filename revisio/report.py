"""The normalized report: three CSV folders and their metadata, written at once and read back with all checks.

A report is written beside its place and renamed; a failed run leaves nothing. Paths are those of a folder that the driver
and the cluster share."""
import json
import os
import shutil
import uuid
from datetime import datetime, timezone
from pathlib import Path

from pyspark.sql import Observation
from pyspark.sql import functions as F

from revisio.functions import readability
from revisio.operators import fields, readings
from revisio.shared import written
from revisio.sources import convert, csv

#: Columns of the records and their types.
RECORDS = (("ID", "integer"), ("START_TIME", "datetime"), ("END_TIME", "datetime"), ("ATTEMPT_TYPE", "string"), ("ATTEMPT_RESULT", "string"), ("USER_TYPE", "string"), ("STUDY_NUM", "string"), ("CREATED_DATE", "datetime"), ("CREATED_BY_ID", "integer"),
           ("PUBLISHABLE", "boolean"), ("STUDY_DEPARTMENT", "string"), ("STUDY_PARTICIPANT_TYPE", "string"), ("USER_ID", "integer"), ("AUTHOR_USER_NAME", "string"), ("AUTHOR_STUDY_TEAM_ROLE", "string"), ("AUTHOR_ERESEARCH_ROLE", "string"),
           ("AUTHOR_APPOINTMENTS", "string"), ("PI_USER_NAME", "string"), ("PI_APPOINTMENTS", "string"), ("PRIOR_CREATED_COUNT", "integer"), ("TOTAL_CREATED_COUNT", "integer"), ("MEMBER_OF_OTHER_STUDIES_COUNT", "integer"), ("LOGIN_DAYS", "integer"),
           ("MIN_LOGIN_TIME", "datetime"), ("MAX_LOGIN_TIME", "datetime"), ("TIME_SPENT_ON_STUDY_INFO_PAGE_MS", "integer"), ("TIME_TO_FINISH_ADDING_STUDY_MS", "integer"), ("LATENCY_MS", "integer"), ("SOURCE_SIZE_CHARS", "integer"), ("SOURCE_TYPE", "string"),
           ("STUDY_CONTENT_SOURCE", "string"), ("LLM_INFERRED_STUDY_CONTENT_SOURCE", "string"), ("STUDY_CONTENT_SOURCE_OTHER_VALUE", "string"), ("LLM_INFERRED_STUDY_CONTENT_SOURCE_OTHER_VALUE", "string"), ("USER_FEEDBACK_COMMENTS", "string"),
           ("LLM_SUGGESTIONS", "json_object"), ("SELECTED_SUGGESTIONS", "json_object"), ("FINAL_SUBMISSION", "json_object"), ("LLM_METADATA", "json_object"))
_DOUBLES = {c for c in fields.FLATTENED if "effort_saved" in c or c in ("ter_rate", "soft_word_edit_distance", "lookup_similarity")}
_LONGS = {"record_id", "suggestion_count_total", "picked_index", "character_edit_distance", "estimated_characters_saved", "suggestion_character_count", "final_character_count", "suggestion_word_count", "final_word_count"}
_FLAGS = {"flag_suggested", "flag_saved", "flag_accepted", "flag_changed", "compensation_text_required", "selected"}
ASSISTANCE = tuple((c, "float" if c in _DOUBLES else "integer" if c in _LONGS else "boolean" if c in _FLAGS else "string") for c in fields.FLATTENED)
READINGS = tuple((c, "string" if c in ("attempt_type", "field_name", "text_role", "suggestion_kind") else "boolean" if c in _FLAGS else "float" if c in readability.FLOATS else "integer")
                 for c in ("record_id", "attempt_type", "field_name", "text_role", "suggestion_kind", "suggestion_index", "selected", *readability.MEASURES))
TABLES = {"records": RECORDS, "ai_assistance_metrics": ASSISTANCE, "readability_metrics": READINGS}
METADATA = "report_metadata.json"
PROVENANCES = ("REPORT_RUN_CUTOFF", "UNAVAILABLE", "SOURCE_PROVIDED")


def staged(path, work):
    """work(folder) beside path, then renamed to it; an existing path fails before any work."""
    path = Path(path)
    if path.exists():
        raise FileExistsError(f"{path} exists")
    aside = path.with_name(f".{path.name}-{uuid.uuid4().hex}")
    try:
        aside.mkdir(parents=True)
        out = work(aside)
        os.replace(aside, path)
        return out
    finally:
        shutil.rmtree(aside, ignore_errors=True)


def put_json(path, content):
    with open(path, "w", encoding="utf-8") as f:
        json.dump(content, f, indent=2, sort_keys=True)
        f.flush()
        os.fsync(f.fileno())


def analyze(records, include_text=False, familiar=None):
    """(assistance, readings) of records with payloads."""
    ai = fields.payloads(records).withColumn("attempt_type", F.lit("AI"))
    last = records.where("ATTEMPT_RESULT = 'COMPLETE'").select(F.col("ID").alias("record_id"), F.col("ATTEMPT_TYPE").alias("attempt_type"), F.from_json("FINAL_SUBMISSION", ", ".join(f"{t} string" for t in (*readings.TEXTS, "compensation"))).alias("f"))
    return fields.analysis(records, include_text), readings.rows(ai, last, familiar)


def write(records, path, include_text=False, familiar=None, null="\\N"):
    """The report of records; returns its counters. An id that is repeated or null fails.

    The source is read once, into a table of the run that feeds the three writers; rows are counted as they pass."""
    names, seen = [n for n, _ in RECORDS], Observation()
    analyzed = (F.col("ATTEMPT_TYPE") == "AI") & (F.col("ATTEMPT_RESULT") == "COMPLETE")
    records = written(records.select(names).observe(seen, F.count(F.lit(1)).alias("source_row_count"), F.count_if(analyzed).alias("analyzed_row_count")))
    counts = seen.get
    if records.groupBy("ID").count().where("ID IS NULL OR count > 1").limit(1).count():
        raise ValueError("record ids are repeated or null")
    made = dict(zip(TABLES, (records, *analyze(records, include_text, familiar))))

    def work(folder):
        rows = {name: csv.write(df, f"{folder}/{name}", null) for name, df in made.items()}
        now = datetime.now(timezone.utc).isoformat()
        put_json(folder / METADATA, {"schema_version": 1, "report_generated_at_utc": now, "source_snapshot_as_of_utc": now, "source_snapshot_provenance": "REPORT_RUN_CUTOFF"})
        return rows

    rows = staged(path, work)
    return {**counts, "skipped_row_count": counts["source_row_count"] - counts["analyzed_row_count"], "ai_assistance_row_count": rows["ai_assistance_metrics"], "readability_row_count": rows["readability_metrics"]}


def _instant(value, name):
    try:
        at = datetime.fromisoformat(value.replace("Z", "+00:00"))
    except (AttributeError, ValueError):
        at = None
    if at is None or at.tzinfo is None:
        raise ValueError(f"{name} must be a time with a zone")
    return at.astimezone(timezone.utc)


def metadata(path):
    """The decoded metadata, checked: four keys, version 1, a known provenance, a snapshot no later than the report."""
    m = json.loads(Path(path).read_text("utf-8"))
    if not isinstance(m, dict) or set(m) != {"schema_version", "report_generated_at_utc", "source_snapshot_as_of_utc", "source_snapshot_provenance"}:
        raise ValueError("metadata keys are not those of a report")
    if type(m["schema_version"]) is not int or m["schema_version"] != 1 or m["source_snapshot_provenance"] not in PROVENANCES:
        raise ValueError("metadata version or provenance is not supported")
    made = _instant(m["report_generated_at_utc"], "report_generated_at_utc")
    if m["source_snapshot_provenance"] == "UNAVAILABLE":
        if m["source_snapshot_as_of_utc"] is not None:
            raise ValueError("an unavailable snapshot has no time")
        return m
    seen = _instant(m["source_snapshot_as_of_utc"], "source_snapshot_as_of_utc")
    if seen > made or m["source_snapshot_provenance"] == "REPORT_RUN_CUTOFF" and seen != made:
        raise ValueError("the snapshot's time does not fit the report's")
    return m


def cutoff(m):
    """The UTC time of the run as text where the snapshot is the run's, else none."""
    return _instant(m["source_snapshot_as_of_utc"], "").strftime("%Y-%m-%d %H:%M:%S.%f") if m["source_snapshot_provenance"] == "REPORT_RUN_CUTOFF" else None


def load(spark, path):
    """{table: frame} and "metadata"; columns must be those of a report, in order, and values of their types."""
    out = {"metadata": metadata(f"{path}/{METADATA}")}
    for name, columns in TABLES.items():
        schema = [(c, k, True) for c, k in columns]
        out[name] = convert.row(csv.texts(spark, f"{path}/{name}/*.csv", schema, nulls=("\\N",)), schema)
    return out
