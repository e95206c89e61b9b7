"""Query results of databases by JDBC, as a frame of canonical types.

Spark's JDBC source binds no parameters, so they are put in as literals here; dbapi has the driver bind them."""
import re
from dataclasses import dataclass
from datetime import date, datetime
from decimal import Decimal
from pathlib import Path

from pyspark.sql import functions as F

from revisio.sources import schema as schemas
from revisio.sources.convert import row


@dataclass(frozen=True)
class Driver:
    """A JDBC driver: its class and how a connection's parts make a url."""
    name: str
    cls: str
    url: str

    def options(self, **parts):
        blank = [k for k, v in parts.items() if not isinstance(v, str) or not v.strip()]
        if blank:
            raise ValueError(f"connection values are blank: {blank}")
        return {"driver": self.cls, "url": self.url.format(**parts), "user": parts["user"], "password": parts["password"]}


DRIVERS = {"oracle": Driver("oracle", "oracle.jdbc.OracleDriver", "jdbc:oracle:thin:@{dsn}")}


def driver(name):
    if name not in DRIVERS:
        raise ValueError(f"unknown driver {name!r}; known: {sorted(DRIVERS)}")
    return DRIVERS[name]


def read_sql_file(path, encoding="utf-8-sig"):
    """The text as it is; a blank one fails."""
    text = Path(path).read_text(encoding)
    if not text.strip():
        raise ValueError("the SQL file is blank")
    return text


def literal(value):
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "1" if value else "0"
    if isinstance(value, (int, float, Decimal)):
        return repr(value) if not isinstance(value, Decimal) else str(value)
    if isinstance(value, datetime):
        return f"TIMESTAMP '{value:%Y-%m-%d %H:%M:%S.%f}'"
    if isinstance(value, date):
        return f"DATE '{value}'"
    if isinstance(value, str):
        return "'" + value.replace("'", "''") + "'"
    raise TypeError(f"no parameter of type {type(value).__name__}")


def bound(sql, parameters=None):
    """sql with :name outside quotes and comments as literals; every parameter must be there and used."""
    left, used = dict(parameters or {}), set()
    pattern = re.compile(r"'(?:[^']|'')*'|\"[^\"]*\"|--[^\n]*|/\*.*?\*/|(?<![:\w]):(\w+)", re.S)

    def swap(m):
        if not m[1]:
            return m[0]
        if m[1] not in left:
            raise ValueError(f"no value for parameter {m[1]}")
        used.add(m[1])
        return literal(left[m[1]])

    out = pattern.sub(swap, sql)
    if set(left) - used:
        raise ValueError(f"parameters are not used: {sorted(set(left) - used)}")
    return out


def query(spark, options, sql, schema, parameters=None, fetch_size=500, **partitioning):
    """The result of a query; its columns must be the schema's, in any order and case. partitioning (partitionColumn, lowerBound, upperBound, numPartitions) splits the read."""
    if isinstance(fetch_size, bool) or not isinstance(fetch_size, int) or fetch_size < 1:
        raise ValueError("fetch_size must be a positive number")
    if not sql.strip():
        raise ValueError("the query is blank")
    text = bound(sql, parameters).rstrip().rstrip(";") + "\n"
    df = spark.read.format("jdbc").options(**options, dbtable=f"({text}) q", fetchsize=fetch_size, **partitioning).load()
    names = {n.upper(): n for n, _, _ in schema}
    df = df.toDF(*[names.get(c.upper(), c) for c in df.columns])
    schemas.same_names(df.columns, schema)
    kinds = dict(df.dtypes)
    as_text = [F.decode(F.col(f"`{n}`"), "UTF-8").alias(n) if kinds[n] == "binary" else F.regexp_replace(F.col(f"`{n}`").cast("string"), r"^(-?[0-9]+)\.0+$", "$1").alias(n) if kind == "integer" and kinds[n].startswith("decimal") else F.col(f"`{n}`").cast("string").alias(n)
               for n, kind, _ in schema]
    return row(df.select(*as_text), schema)
