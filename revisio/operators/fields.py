"""What became of each suggested field of a completed AI record: twelve rows a record.

Payloads are JSON objects. A field that is not configured, a value of another type, more than one selection, a selection
that was not offered, or a required text that is blank fails the job."""
from functools import reduce

from pyspark.sql import functions as F

from revisio.functions.postedit import METRICS, analyzed

TEXTS = {"about": False, "description": True, "purpose": True, "title": True}
LOOKUPS = ("department", "locations", "topics")
KINDS = ("genericCompensation", "specificCompensation")
CONTACT = {"email": True, "name": True, "phone": False, "website": False}
FIELDS = {*TEXTS, *LOOKUPS, "compensation", "contact", "offersCompensation"}
BLANK = r"(?U)^\s*$"
_CONTACT = "contact struct<" + ", ".join(f"{c}: string" for c in CONTACT) + ">"
_LISTS = ", ".join([*(f"{t} array<string>" for t in TEXTS), "compensation struct<" + ", ".join(f"{k}: array<string>" for k in KINDS) + ">", _CONTACT, *(f"{x} array<bigint>" for x in LOOKUPS), "offersCompensation boolean"])
_PLAIN = ", ".join([*(f"{t} string" for t in TEXTS), "compensation string", _CONTACT, *(f"{x} array<bigint>" for x in LOOKUPS), "offersCompensation boolean"])
FLATTENED = ("record_id", "field_name", "analysis_type", "match_type", "suggestion_count_total", "suggestion_counts_json", "picked_kind", "picked_index", "selected_text", "final_text", "ter_rate", "ter_effort_saved_raw",
             "ter_effort_saved", "policy_adjusted_effort_saved", "character_edit_distance", "character_effort_saved_raw", "character_effort_saved", "soft_word_edit_distance", "soft_word_effort_saved_raw", "soft_word_effort_saved",
             "estimated_characters_saved", "suggestion_character_count", "final_character_count", "suggestion_word_count", "final_word_count", "flag_suggested", "flag_saved", "flag_accepted", "flag_changed",
             "compensation_text_required", "lookup_similarity", "offered_ids", "picked_ids", "saved_ids", "kept_ids", "dropped_ids", "added_ids", "saved_not_offered_ids")
#: What a payload's members may look like, by the schema of parse_json: kinds of JSON type.
_STRINGS, _NUMBERS = r"^(VOID|ARRAY<(VOID|STRING)>)$", r"^(VOID|ARRAY<(VOID|BIGINT)>)$"


def _plain(kinds):
    """A pattern of objects that have none but the given members, by their JSON types in order of names."""
    return "OBJECT<" + "".join(f"(?:{n}: (?:{k})(?:, |(?=>)))?" for n, k in sorted(kinds.items())) + ">"


_WORDS, _TEXT = _STRINGS.strip("^$"), "VOID|STRING"
#: What the members of nearly all payloads look like, as one type: suggestions and selections, and final texts.
_USUAL = {listed: "^" + _plain({**dict.fromkeys(TEXTS, _WORDS if listed else _TEXT), **dict.fromkeys(LOOKUPS, _NUMBERS.strip("^$")), "offersCompensation": "VOID|BOOLEAN", "contact": "VOID|" + _plain(dict.fromkeys(CONTACT, _TEXT)),
                                "compensation": "VOID|" + _plain(dict.fromkeys(KINDS, _WORDS)) if listed else _TEXT}) + "$" for listed in (True, False)}


def fail(bad, message):
    """An expression that is true, or fails where bad is true."""
    return F.when(F.coalesce(bad, F.lit(False)), F.raise_error(message if not isinstance(message, str) else F.lit(message)).cast("boolean")).otherwise(True)


def _checked(column, listed):
    """Payload JSON whose members have the configured names and types: by its type as a whole, which parses it once; one of another type is looked at member by member."""
    v = F.parse_json(column)
    keys = F.json_object_keys(column)
    kind = lambda path: F.coalesce(F.schema_of_variant(F.try_variant_get(v, path, "variant")), F.lit("VOID"))
    text = _STRINGS if listed else r"^(VOID|STRING)$"
    bad = [F.size(F.array_except(keys, F.array(*map(F.lit, sorted(FIELDS))))) > 0, keys.isNull()]
    bad += [~kind(f"$.{t}").rlike(text) for t in TEXTS] + [~kind(f"$.{x}").rlike(_NUMBERS) for x in LOOKUPS] + [~kind("$.offersCompensation").rlike("^(VOID|BOOLEAN)$")]
    bad += [~kind(f"$.compensation.{k}").rlike(_STRINGS) for k in KINDS] if listed else [~kind("$.compensation").rlike(text)]
    bad += [~kind(f"$.contact.{c}").rlike(r"^(VOID|STRING)$") for c in CONTACT]
    bad.append(F.size(F.array_except(F.coalesce(F.json_object_keys(F.get_json_object(column, "$.contact")), F.array().cast("array<string>")), F.array(*map(F.lit, CONTACT)))) > 0)
    told = fail(reduce(lambda a, b: a | b, [F.coalesce(b, F.lit(False)) for b in bad]), "payload has a field that is not configured or a value of the wrong type")
    return F.when(F.schema_of_variant(v).rlike(_USUAL[listed]), True).otherwise(told)


def payloads(records):
    """Completed AI records with decoded payloads s, p and f; a missing end time or payload fails."""
    cols = ("LLM_SUGGESTIONS", "SELECTED_SUGGESTIONS", "FINAL_SUBMISSION")
    r = records.where("ATTEMPT_TYPE = 'AI' AND ATTEMPT_RESULT = 'COMPLETE'")
    missing = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in ("END_TIME", *cols)])
    ok = fail(missing, "completed AI record without end time or payload") & _checked(F.col(cols[0]), True) & _checked(F.col(cols[1]), True) & _checked(F.col(cols[2]), False)
    return r.where(ok).select(F.col("ID").alias("record_id"), F.from_json(cols[0], _LISTS).alias("s"), F.from_json(cols[1], _LISTS).alias("p"), F.from_json(cols[2], _PLAIN).alias("f"))


def _text_row(field, kind, offers, picks, final, required):
    """offers and picks: {kind: array of texts}."""
    none = F.array().cast("array<string>")
    offers, picks = ({k: F.coalesce(x, none) for k, x in d.items()} for d in (offers, picks))
    first = lambda k: F.get(picks[k], F.lit(0))
    # of the first kind with a selection; no lambdas, which Spark does not compile
    chosen = lambda of: reduce(lambda rest, k: F.when(F.size(picks[k]) > 0, of(k)).otherwise(rest), reversed(picks), F.lit(None))
    at = chosen(lambda k: F.array_position(offers[k], first(k))).cast("long")
    counts = [F.concat(F.lit(f'"{k}": '), F.size(x).cast("string")) for k, x in sorted(offers.items())]
    return F.struct(F.lit(field).alias("field_name"), F.lit(kind).alias("analysis_type"), reduce(lambda a, b: a + b, [F.size(x) for x in offers.values()]).cast("long").alias("suggestion_count_total"),
                    F.concat(F.lit("{"), F.concat_ws(", ", *counts), F.lit("}")).alias("suggestion_counts_json"), reduce(lambda a, b: a + b, [F.size(x) for x in picks.values()]).alias("picks"), chosen(F.lit).alias("picked_kind"),
                    (at - 1).alias("picked_index"), chosen(first).alias("selected_text"), F.coalesce(final, F.lit("")).alias("final_text"), required.alias("required"), *[F.lit(None).cast("array<bigint>").alias(c) for c in "okv"])


def _lookup_row(field):
    none = {"suggestion_count_total": "bigint", "suggestion_counts_json": "string", "picks": "int", "picked_kind": "string", "picked_index": "bigint", "selected_text": "string", "final_text": "string", "required": "boolean"}
    sets = lambda c: F.array_distinct(F.coalesce(c, F.array().cast("array<bigint>")))
    return F.struct(F.lit(field).alias("field_name"), F.lit("LOOKUP").alias("analysis_type"), *[F.lit(None).cast(k).alias(c) for c, k in none.items()], *[sets(F.col(f"{x}.{field}")).alias(n) for x, n in (("s", "o"), ("p", "k"), ("f", "v"))])


def _said(ids):
    return F.concat(F.lit("["), F.array_join(F.array_sort(ids).cast("array<string>"), ", "), F.lit("]"))


def field_rows(p):
    """A record's twelve rows, from one look at its payloads: texts, contact parts and compensation with metrics, and lookup fields, sets of identifiers and their Jaccard similarity, 0 where nothing was picked."""
    one = lambda x: F.when(x.isNotNull() & (x != ""), F.array(x))
    rows = [_text_row(t, "TEXT", {t: F.col(f"s.{t}")}, {t: F.col(f"p.{t}")}, F.col(f"f.{t}"), F.lit(need)) for t, need in TEXTS.items()]
    rows += [_text_row(f"contact.{c}", "TEXT", {f"contact.{c}": one(F.col(f"s.contact.{c}"))}, {f"contact.{c}": one(F.col(f"p.contact.{c}"))}, F.col(f"f.contact.{c}"), F.lit(need)) for c, need in CONTACT.items()]
    rows.append(_text_row("compensation", "COMPENSATION", {k: F.col(f"s.compensation.{k}") for k in KINDS}, {k: F.col(f"p.compensation.{k}") for k in KINDS}, F.col("f.compensation"), F.coalesce(F.col("f.offersCompensation"), F.lit(False))))
    rows += [_lookup_row(x) for x in LOOKUPS]
    # an array of its own is compiled, one inside explode is interpreted; as it has twelve rows, explode_outer gives those of explode, for which Spark would decode all payloads once more to see whether there are any
    r = p.select("record_id", F.col("s.offersCompensation").alias("flag_suggested"), F.col("f.offersCompensation").alias("flag_saved"), F.array(*rows).alias("xs"))
    r = r.select("record_id", "flag_suggested", "flag_saved", F.explode_outer("xs").alias("x")).select("record_id", "flag_suggested", "flag_saved", "x.*")
    blank, money, look = F.col("final_text").rlike(BLANK), F.col("analysis_type") == "COMPENSATION", F.col("analysis_type") == "LOOKUP"
    ok = (fail(F.col("picks") > 1, "more than one suggestion selected") & fail((F.col("picks") > 0) & (F.coalesce(F.col("picked_index"), F.lit(-1)) < 0), "a selected text was not offered")
          & fail(blank & F.col("required"), "a required final text is blank") & fail(money & F.col("flag_saved").isNull(), "offersCompensation was not saved")
          & fail(F.size(F.array_except("k", "o")) > 0, "a picked value was not offered"))
    r = analyzed(r.where(ok))
    both, either = F.size(F.array_intersect("k", "v")), F.size(F.array_union("k", "v"))
    same = (F.size("k") == F.size("v")) & (both == F.size("k"))
    looked = F.when(F.size("k") == 0, "UNASSISTED").when(same, "EXACT").otherwise("EDITED")
    r = r.withColumn("match_type", F.when(look, looked).when(F.col("picks") == 0, "UNASSISTED").when(F.col("final_text").rlike(BLANK), "REMOVED").when(F.col("selected_text") == F.col("final_text"), "EXACT").when(F.col("cosmetic"), "COSMETIC_EQUIVALENT").otherwise("EDITED"))
    flags = {"flag_suggested": F.col("flag_suggested"), "flag_saved": F.col("flag_saved"), "flag_accepted": F.col("flag_suggested") == F.col("flag_saved"), "flag_changed": F.col("flag_suggested") != F.col("flag_saved"),
             "compensation_text_required": F.coalesce(F.col("flag_saved"), F.lit(False))}
    policy = F.when(look, None).when(F.col("match_type").isin("EXACT", "COSMETIC_EQUIVALENT"), 1.0).when(F.col("match_type") == "EDITED", F.col("ter_effort_saved")).otherwise(0.0)
    named = {"offered_ids": F.col("o"), "picked_ids": F.col("k"), "saved_ids": F.col("v"), "kept_ids": F.array_intersect("k", "v"), "dropped_ids": F.array_except("k", "v"), "added_ids": F.array_except("v", "k"), "saved_not_offered_ids": F.array_except("v", "o")}
    return r.select("record_id", "field_name", "analysis_type", "match_type", "suggestion_count_total", "suggestion_counts_json", "picked_kind", "picked_index", "selected_text", "final_text", *METRICS,
                    policy.alias("policy_adjusted_effort_saved"), *[F.when(money, e).alias(c) for c, e in flags.items()],
                    F.when(look, F.when(F.size("k") == 0, 0.0).otherwise(both / either)).alias("lookup_similarity"), *[F.when(look, _said(e)).alias(c) for c, e in named.items()])


def analysis(records, include_text=False):
    """The flattened rows of all completed AI records; texts only on request."""
    out = field_rows(payloads(records))
    if not include_text:
        out = out.withColumn("selected_text", F.lit(None).cast("string")).withColumn("final_text", F.lit(None).cast("string"))
    return out.select(*FLATTENED)


SCHEME = "EXPLORATORY_CHARACTER_RATIO_10_30"
#: Derived field analysis: edit ratios and intensities of completed AI attempts.
COMPLETED = f"""
WITH c AS (SELECT ID AS record_id, STUDY_NUM AS study_num FROM {{rec}} WHERE ATTEMPT_TYPE = 'AI' AND ATTEMPT_RESULT = 'COMPLETE'),
x AS (SELECT m.*, c.study_num, character_edit_distance / CAST(greatest(suggestion_character_count, final_character_count, 1) AS DOUBLE) AS ratio FROM {{ast}} m JOIN c ON m.record_id = c.record_id)
SELECT record_id AS audit_record_id, study_num, field_name, analysis_type, match_type, suggestion_count_total, suggestion_counts_json, picked_kind, picked_index, character_edit_distance, suggestion_character_count, final_character_count,
  ratio AS character_edit_ratio, ter_rate, soft_word_edit_distance, policy_adjusted_effort_saved, estimated_characters_saved,
  CASE match_type WHEN 'EXACT' THEN 'EXACT' WHEN 'COSMETIC_EQUIVALENT' THEN 'COSMETIC' WHEN 'REMOVED' THEN 'CLEARED' WHEN 'UNASSISTED' THEN 'UNASSISTED'
    ELSE CASE WHEN suggestion_character_count > 0 AND ratio <= 0.10 THEN 'LIGHT_EDIT' WHEN suggestion_character_count > 0 AND ratio <= 0.30 THEN 'MODERATE_EDIT' WHEN suggestion_character_count > 0 AND ratio > 0.30 THEN 'HEAVY_EDIT' ELSE 'EDITED_UNCLASSIFIED' END END AS edit_intensity_category,
  '{SCHEME}' AS edit_intensity_threshold_scheme_name, lookup_similarity, offered_ids, picked_ids, saved_ids, kept_ids, dropped_ids, added_ids, saved_not_offered_ids, flag_suggested, flag_saved, flag_accepted, flag_changed, compensation_text_required
FROM x"""
