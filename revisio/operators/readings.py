"""Readability of suggested and final texts: rows of completed records, and pairs of selected and final texts."""
from pyspark.sql import functions as F

from revisio.functions import readability
from revisio.functions.readability import GRADES, MEASURES
from revisio.operators.fields import BLANK, KINDS
from revisio.stats import union

TEXTS = ("title", "about", "purpose", "description")


def _instances(field, kind, offers, picks):
    """Structs of the nonblank suggestions of one kind; blank ones keep their place."""
    first = F.array_position(offers, F.get(picks, F.lit(0))) - 1
    rows = F.transform(offers, lambda t, i: F.struct(F.lit(field).alias("field_name"), F.lit("SUGGESTED").alias("text_role"), F.lit(kind).alias("suggestion_kind"), i.cast("long").alias("suggestion_index"),
                                                     F.coalesce(i == first, F.lit(False)).alias("selected"), t.alias("text")))
    return F.coalesce(F.filter(rows, lambda r: ~r["text"].rlike(BLANK)), F.array().cast("array<struct<field_name: string, text_role: string, suggestion_kind: string, suggestion_index: bigint, selected: boolean, text: string>>"))


def _measured(rows, familiar):
    """rows of texts with their measures; a text that is not blank but has no words fails."""
    m = readability.measures(F.col("text"), familiar)
    m = F.when(m.isNull(), F.raise_error(F.concat(F.lit("readability failed for "), F.col("field_name"))).cast("struct<" + ", ".join(f"{c}: {'double' if c in readability.FLOATS else 'bigint'}" for c in MEASURES) + ">")).otherwise(m)
    return rows.withColumn("m", m).select("record_id", "attempt_type", "field_name", "text_role", "suggestion_kind", "suggestion_index", "selected", "m.*")


def rows(suggested, final, familiar=None):
    """suggested: record_id, attempt_type and payloads s, p of completed AI records. final: record_id, attempt_type and the texts f of all completed ones."""
    parts = [_instances(t, t, F.col(f"s.{t}"), F.col(f"p.{t}")) for t in TEXTS] + [_instances("compensation", k, F.col(f"s.compensation.{k}"), F.col(f"p.compensation.{k}")) for k in KINDS]
    a = suggested.select("record_id", "attempt_type", F.explode(F.concat(*parts)).alias("x")).select("record_id", "attempt_type", "x.*")
    b = final.select("record_id", "attempt_type", F.explode(F.array(*[F.struct(F.lit(t).alias("field_name"), F.col(f"f.{t}").alias("text")) for t in (*TEXTS, "compensation")])).alias("x")).select("record_id", "attempt_type", "x.*")
    b = b.where(F.col("text").isNotNull() & ~F.col("text").rlike(BLANK)).withColumn("text_role", F.lit("FINAL"))
    return _measured(union([a, b]), familiar)


_LONG = "stack(" + str(len(MEASURES)) + ", " + ", ".join(f"'{m}', CAST(a_{m} AS DOUBLE), CAST(b_{m} AS DOUBLE)" for m in MEASURES) + ") AS (measure, x, y)"


def pairs(readings, fields, tolerance=0.1):
    """Selected against final text, one row a measure; three of the four grade formulas, and none against them, make a consensus."""
    chosen = readings.where("text_role = 'SUGGESTED' AND selected").select("record_id", "field_name", "suggestion_kind", "suggestion_index", *[F.col(m).alias(f"a_{m}") for m in MEASURES])
    last = readings.where("text_role = 'FINAL'").select("record_id", "field_name", *[F.col(m).alias(f"b_{m}") for m in MEASURES])
    known = fields.select(F.col("audit_record_id").alias("record_id"), "study_num", "field_name", "edit_intensity_category", "edit_intensity_threshold_scheme_name")
    # all three grow with the records: sorted by one key, none is broadcast
    j = chosen.join(last.hint("merge"), ["record_id", "field_name"]).join(known.hint("merge"), ["record_id", "field_name"])
    change = {m: F.col(f"b_{m}").cast("double") - F.col(f"a_{m}").cast("double") for m in MEASURES}
    down, up = (sum(((change[m] < -tolerance) if s < 0 else (change[m] > tolerance)).cast("int") for m in GRADES) for s in (-1, 1))
    consensus = (F.when((down == 0) & (up == 0), "NO_MATERIAL_CHANGE").when((down >= 3) & (up == 0), "CONSENSUS_GRADE_LEVEL_DECREASE").when((up >= 3) & (down == 0), "CONSENSUS_GRADE_LEVEL_INCREASE").otherwise("MIXED_FORMULA_DIRECTION"))
    r = j.select("record_id", "study_num", "field_name", "suggestion_kind", "suggestion_index", "edit_intensity_category", "edit_intensity_threshold_scheme_name", consensus.alias("consensus"), F.expr(_LONG))
    d = F.col("y") - F.col("x")
    return r.select(F.col("record_id").alias("audit_record_id"), "study_num", "field_name", "suggestion_kind", "suggestion_index", F.col("measure").alias("readability_measure_name"), F.col("x").alias("selected_suggestion_metric_value"),
                    F.col("y").alias("final_metric_value"), d.alias("change_final_minus_selected"), F.when(F.abs(d) <= tolerance, "NO_MATERIAL_CHANGE").when(d < 0, "VALUE_DECREASED").when(d > 0, "VALUE_INCREASED").alias("readability_direction_category"),
                    F.col("consensus").alias("consensus_grade_level_direction_category"), F.lit(float(tolerance)).alias("unchanged_absolute_tolerance"), "edit_intensity_category", "edit_intensity_threshold_scheme_name",
                    (F.col("field_name") == "title").alias("short_text_readability_caution"))
