"""Canonical values of source texts: integer, decimal, float, boolean, date, datetime, json_object and string.

Texts are trimmed, strings are not. Integers are base-10 digits, an underscore between digits is allowed. Decimals and
floats are finite. Booleans are true, false, 1 and 0 in any case. Dates are ISO. Datetimes are ISO 8601, a Z or offset is
turned to UTC, or MM/DD/YYYY HH:MM:SS with up to six digits of seconds. JSON objects are objects. Another text fails
the job, or gives null if not strict. Decimals keep 18 of 38 digits after the point."""
from pyspark.sql import functions as F

#: Columns that say where a row comes from.
FILE, RECORD = "__file", "__record"
TYPES = {"string": "string", "integer": "bigint", "decimal": "decimal(38,18)", "float": "double", "boolean": "boolean", "date": "date", "datetime": "timestamp_ntz", "json_object": "string"}
_INT = r"^[+-]?[0-9]+(_[0-9]+)*$"
_DATE = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"
_ISO = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}([ T][0-9]{2}:[0-9]{2}(:[0-9]{2}(\.[0-9]{1,6})?)?)?$"
_ZONED = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[ T][0-9]{2}:[0-9]{2}(:[0-9]{2}(\.[0-9]{1,6})?)?(Z|[+-][0-9]{2}:?[0-9]{2})$"
_REPORT = r"^[0-9]{2}/[0-9]{2}/[0-9]{4} [0-9]{2}:[0-9]{2}:[0-9]{2}(\.[0-9]{1,6})?$"


def _value(x, kind):
    t = F.regexp_replace(x, r"(?U)^\s+|\s+$", "")
    if kind == "string":
        return x
    if kind == "integer":
        return F.when(t.rlike(_INT), F.replace(t, F.lit("_"), F.lit("")).try_cast("bigint"))
    if kind == "decimal":
        return t.try_cast(TYPES[kind])
    if kind == "float":
        v = t.try_cast("double")
        return F.when(~F.isnan(v) & (F.abs(v) != float("inf")), v)
    if kind == "boolean":
        return F.when(F.lower(t).isin("true", "1"), True).when(F.lower(t).isin("false", "0"), False)
    if kind == "date":
        return F.when(t.rlike(_DATE), t.try_cast("date"))
    if kind == "datetime":
        day = F.concat(F.substring(t, 7, 4), F.lit("-"), F.substring(t, 1, 2), F.lit("-"), F.substring(t, 4, 2), F.substring(t, 11, 30))
        zoned = F.to_utc_timestamp(t.try_cast("timestamp"), F.current_timezone()).cast("timestamp_ntz")
        return F.when(t.rlike(_ISO), t.try_cast("timestamp_ntz")).when(t.rlike(_ZONED), zoned).when(t.rlike(_REPORT), day.try_cast("timestamp_ntz"))
    if kind == "json_object":
        v = F.try_parse_json(x)
        return F.when(F.schema_of_variant(v).startswith("OBJECT"), x)
    raise ValueError(f"unknown type {kind}")


def converted(x, kind, strict=True, name=None, where=None):
    """A text column as a canonical type; null stays null. `where` is a text that goes before an error's."""
    v = _value(x, kind)
    if not strict:
        return v
    return F.when(x.isNotNull() & v.isNull(), failed(f"{name or 'a value'} is no {kind}", kind, where)).otherwise(v)


def failed(message, kind, where=None):
    return F.raise_error(F.lit(message) if where is None else F.concat(where, F.lit(message))).cast(TYPES[kind])


def row(df, schema):
    """df's text columns by schema, a list of (name, type, nullable), in its order; a null where none may be fails.

    Errors tell file and record of rows that carry them as __file and __record, and no value."""
    where = F.concat(F.col(FILE), F.lit(": record "), F.col(RECORD).cast("string"), F.lit(": ")) if {FILE, RECORD} <= set(df.columns) else None
    cols = []
    for name, kind, nullable in schema:
        v = converted(F.col(f"`{name}`"), kind, name=name, where=where)
        if not nullable:
            v = F.when(F.col(f"`{name}`").isNull(), failed(f"{name} is null", kind, where)).otherwise(v)
        cols.append(v.alias(name))
    return df.select(*cols)


EXAMPLES = """SELECT o_orderkey AS k, CASE o_orderkey % 6 WHEN 0 THEN CAST(o_orderkey AS STRING) WHEN 1 THEN ' -' || CAST(o_custkey AS STRING) || ' ' WHEN 2 THEN '1_0' || CAST(o_custkey AS STRING) WHEN 3 THEN '1.0' WHEN 4 THEN '' END AS integer_text,
  CASE o_orderkey % 7 WHEN 0 THEN 'true' WHEN 1 THEN ' FALSE ' WHEN 2 THEN '1' WHEN 3 THEN '0' WHEN 4 THEN 'yes' WHEN 5 THEN 't' END AS boolean_text,
  CASE o_orderkey % 4 WHEN 0 THEN substr(CAST(o_orderdate AS STRING), 1, 10) WHEN 1 THEN '2023-02-30' WHEN 2 THEN '01/02/2023' END AS date_text,
  CASE o_orderkey % 5 WHEN 0 THEN substr(CAST(o_orderdate AS STRING), 1, 10) || 'T01:02:03' WHEN 1 THEN '12/31/2023 23:59:58.25' WHEN 2 THEN '13/31/2023 00:00:00' WHEN 3 THEN 'soon' END AS datetime_text FROM {orders}"""
EXPECTED = """SELECT k, CASE WHEN regexp_full_match(trim(integer_text), '[+-]?[0-9]+(_[0-9]+)*') THEN CAST(replace(trim(integer_text), '_', '') AS BIGINT) END AS integer,
  CASE lower(trim(boolean_text)) WHEN 'true' THEN true WHEN '1' THEN true WHEN 'false' THEN false WHEN '0' THEN false END AS boolean, CASE WHEN date_text LIKE '____-__-__' THEN TRY_CAST(date_text AS DATE) END AS date,
  coalesce(TRY_CAST(datetime_text AS TIMESTAMP), try_strptime(datetime_text, '%m/%d/%Y %H:%M:%S.%f'), try_strptime(datetime_text, '%m/%d/%Y %H:%M:%S')) AS datetime FROM {examples}"""
