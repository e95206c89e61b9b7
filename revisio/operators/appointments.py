"""Appointments of authors and principal investigators, one row an entry.

Entries are parted by ~|APPOINTMENT|~, or by a comma and white space unless the whole is one entry. An entry is
Title:Department:School, parted at the last two colons; each part is trimmed and none may be blank."""
from pyspark.sql import functions as F

from revisio.stats import union

SEPARATOR = "~|APPOINTMENT|~"
ENTRY = r"(?s)^(.*):([^:]*):([^:]*)$"
BLANK = r"(?U)^\s*$"
EDGES = r"(?U)^\s+|\s+$"


def parts(entry):
    """Array of the three trimmed parts, null if the entry is malformed."""
    p = F.array(*[F.regexp_replace(F.regexp_extract(entry, ENTRY, i), EDGES, "") for i in (1, 2, 3)])
    return F.when(entry.rlike(ENTRY) & F.forall(p, lambda x: x != ""), p)


def split(raw):
    """Array of the entries of a raw value; none for a blank one."""
    marked = F.filter(F.split(raw, r"\Q~|APPOINTMENT|~\E"), lambda x: ~x.rlike(BLANK))
    one = (F.regexp_count(raw, F.lit(":")) == 2) & parts(raw).isNotNull()
    none = F.array().cast("array<string>")
    return F.when(raw.isNull() | raw.rlike(BLANK), none).when(F.instr(raw, SEPARATOR) > 0, marked).when(one, F.array(raw)).otherwise(F.split(raw, r",(?U)\s+"))


def entries(records):
    """audit_record_id, study_num, source, index and raw value of every entry, malformed ones too."""
    rows = [records.select(F.col("ID").alias("audit_record_id"), F.col("STUDY_NUM").alias("study_num"), F.lit(source).alias("appointment_source"),
                           F.posexplode(split(F.col(column))).alias("appointment_index", "appointment_raw")) for column, source in (("AUTHOR_APPOINTMENTS", "AUTHOR"), ("PI_APPOINTMENTS", "PI"))]
    return union(rows).withColumn("p", parts(F.col("appointment_raw")))


def appointments(records):
    p = F.col("p")
    return entries(records).where(p.isNotNull()).select("audit_record_id", "study_num", "appointment_source", "appointment_index", "appointment_raw",
                                                         p[0].alias("appointment_title"), p[1].alias("appointment_department"), p[2].alias("appointment_school"))


def malformed(records):
    return entries(records).where("p is null").select("audit_record_id", "appointment_source", "appointment_index", F.lit("MALFORMED_APPOINTMENT").alias("issue_name"))


SQL = r"""
WITH r AS (SELECT ID AS audit_record_id, STUDY_NUM AS study_num, 'AUTHOR' AS appointment_source, AUTHOR_APPOINTMENTS AS raw FROM {rec} UNION ALL SELECT ID, STUDY_NUM, 'PI', PI_APPOINTMENTS FROM {rec}),
s AS (SELECT *, CASE WHEN contains(raw, '~|APPOINTMENT|~') THEN list_filter(string_split(raw, '~|APPOINTMENT|~'), lambda x: trim(x) <> '')
  WHEN length(raw) - length(replace(raw, ':', '')) = 2 AND NOT regexp_matches(raw, '^\s*:|:\s*:|:\s*$') THEN [raw] ELSE string_split_regex(raw, ',\s+') END AS l FROM r WHERE trim(raw) <> ''),
e AS (SELECT audit_record_id, study_num, appointment_source, unnest(range(len(l))) AS appointment_index, unnest(l) AS appointment_raw FROM s),
p AS (SELECT *, list_transform(list_value(regexp_extract(appointment_raw, '^(.*):([^:]*):([^:]*)$', 1), regexp_extract(appointment_raw, '^(.*):([^:]*):([^:]*)$', 2), regexp_extract(appointment_raw, '^(.*):([^:]*):([^:]*)$', 3)), lambda x: trim(x)) AS p FROM e)
SELECT audit_record_id, study_num, appointment_source, CAST(appointment_index AS INTEGER) AS appointment_index, appointment_raw, p[1] AS appointment_title, p[2] AS appointment_department, p[3] AS appointment_school,
  list_contains(p, '') AS bad FROM p"""
