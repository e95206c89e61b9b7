"""Query results of databases by DB-API connections, as a frame of canonical types.

The query runs in executors: a data source opens a connection in each task, has the driver bind
the parameters, and fetches in batches, so no value is ever put into the SQL text. A cursor
is read by one task; `parts` gives several sets of parameters to a query (a range of keys each,
say), and each is read by a task of its own."""
import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from datetime import date, datetime
from decimal import Decimal

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from revisio.sources import schema as schemas
from revisio.sources.convert import FILE, RECORD, row


def oracle(dsn, user, password):
    import oracledb
    return oracledb.connect(user=user, password=password, dsn=dsn)


def sqlite(dsn, user=None, password=None):
    import sqlite3
    return sqlite3.connect(dsn)


CONNECT = {"oracle": oracle, "sqlite": sqlite}


def connector(name, **parts):
    """A factory of connections by driver name; blank parts fail."""
    if name not in CONNECT:
        raise ValueError(f"unknown driver {name!r}; known: {sorted(CONNECT)}")
    blank = [k for k, v in parts.items() if not isinstance(v, str) or not v.strip()]
    if blank:
        raise ValueError(f"connection values are blank: {blank}")
    make = CONNECT[name]
    return lambda: make(**parts)


def _number(value):
    return str(int(value)) if isinstance(value, Decimal) and value == value.to_integral_value() else format(value, "f") if isinstance(value, Decimal) else repr(value)


def text(value, kind):
    """A driver's value as the text that convert.row reads as `kind`; TypeError where it is of another type."""
    if value is None:
        return None
    said = isinstance(value, str)
    if kind == "string":
        out = value if said else None
    elif kind == "json_object":
        out = value.decode() if isinstance(value, bytes) else json.dumps(value, allow_nan=False) if isinstance(value, dict) else value if said else None
    elif kind == "boolean":
        out = str(value).lower() if isinstance(value, bool) or said else _number(value) if isinstance(value, (int, Decimal)) and value in (0, 1) else None
    elif kind == "date":
        out = value.isoformat() if isinstance(value, date) and not isinstance(value, datetime) else value if said else None
    elif kind == "datetime":
        out = value.isoformat() if isinstance(value, datetime) else value if said else None
    else:
        numbers = (int, Decimal) if kind == "integer" else (int, float, Decimal)
        out = value if said else _number(value) if isinstance(value, numbers) and not isinstance(value, bool) else None
    if out is None:
        raise TypeError(f"{type(value).__name__} is no {kind}")
    return out


@dataclass
class Part(InputPartition):
    number: int
    parameters: object


class Rows(DataSourceReader):
    """Batches of texts, one for each fetch."""

    def __init__(self, connect, sql, schema, parts, fetch_size):
        self.connect, self.sql, self.schema, self.parts, self.fetch_size = connect, sql, schema, parts, fetch_size

    def partitions(self):
        return [Part(i, p) for i, p in enumerate(self.parts)]

    def read(self, part):
        connection = self.connect()
        try:
            cursor = connection.cursor()
            try:
                cursor.arraysize = self.fetch_size
                cursor.execute(self.sql) if part.parameters is None else cursor.execute(self.sql, part.parameters)
                yield from self.fetched(cursor, part.number)
            finally:
                cursor.close()
        finally:
            connection.close()

    def fetched(self, cursor, number):
        if cursor.description is None:
            raise ValueError("the query gives no result set")
        names = [d.name if hasattr(d, "name") else d[0] for d in cursor.description]
        schemas.same_names(names, self.schema)
        at = [(names.index(n), n, kind) for n, kind, _ in self.schema]
        label, n = "query" if len(self.parts) == 1 else f"query, part {number}", 0
        while rows := cursor.fetchmany(self.fetch_size):
            told = [[self.value(r, i, name, kind, f"{label}: record {n + k}") for i, name, kind in at] for k, r in enumerate(rows, 1)]
            numbers = list(range(n + 1, n + len(rows) + 1))
            n += len(rows)
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.string()) for c in zip(*told)), pa.array([label] * len(rows), pa.string()), pa.array(numbers, pa.int64())], names=[*(n for _, n, _ in at), FILE, RECORD])

    def value(self, r, i, name, kind, where):
        if len(r) != len(self.schema):
            raise ValueError(f"{where} has {len(r)} values, not {len(self.schema)}")
        try:
            v = r[i]
            return text(v.read() if callable(getattr(v, "read", None)) else v, kind)
        except Exception as e:
            raise ValueError(f"{where}: {name}: {e}") from e


def _parameters(p):
    if p is None:
        return None
    if isinstance(p, Mapping):
        if not all(isinstance(k, str) for k in p):
            raise ValueError("names of parameters must be texts")
        return dict(p)
    if isinstance(p, Sequence) and not isinstance(p, (str, bytes, bytearray)):
        return tuple(p)
    raise ValueError("parameters must be a mapping or a sequence")


def texts(spark, connect, sql, schema, parameters=None, fetch_size=500, parts=None):
    """The result as text columns with __file and __record; schema is a list of (name, type, nullable)."""
    if not callable(connect):
        raise ValueError("connect must be callable")
    if not isinstance(sql, str) or not sql.strip():
        raise ValueError("the query is blank")
    if isinstance(fetch_size, bool) or not isinstance(fetch_size, int) or fetch_size < 1:
        raise ValueError("fetch_size must be a positive number")
    if parts is not None and parameters is not None:
        raise ValueError("give parameters or parts")
    reader = Rows(connect, sql, schema, [_parameters(p) for p in parts] if parts is not None else [_parameters(parameters)], fetch_size)
    columns = ", ".join([*(f"`{n}` string" for n, _, _ in schema), f"{FILE} string", f"{RECORD} long"])

    class Query(DataSource):
        @classmethod
        def name(cls):
            return "revisio_query"

        def schema(self):
            return columns

        def reader(self, schema):
            return reader

    spark.dataSource.register(Query)
    return spark.read.format("revisio_query").load()


def query(spark, connect, sql, schema, **options):
    """The same in canonical types; an error tells record and column, and no value."""
    return row(texts(spark, connect, sql, schema, **options), schema)
