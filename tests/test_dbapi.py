"""Queries by DB-API: bound parameters, batches, values read as large objects."""
import sqlite3
from datetime import date, datetime
from decimal import Decimal

import pytest

from revisio.sources import dbapi

SCHEMA = [("note", "string", True), ("id", "integer", False), ("raw", "json_object", True), ("ok", "boolean", True)]


@pytest.fixture
def path(tmp_path):
    p = str(tmp_path / "d.sqlite")
    c = sqlite3.connect(p)
    c.execute("CREATE TABLE r (id INTEGER, note TEXT, raw BLOB, ok INTEGER)")
    c.executemany("INSERT INTO r VALUES (?, ?, ?, ?)", [(k, "it's" if k % 3 else None, b'{"a": "\xc3\xa9"}' if k % 2 else None, k % 2) for k in range(1, 1201)])
    c.commit()
    return p


def test_driver_binds(spark, path):
    connect = lambda: sqlite3.connect(path)
    q = "SELECT id, ok, note, raw FROM r WHERE (note = :t OR note IS :none) AND (raw = :b OR raw IS NULL) AND id <= :top -- :t '"
    got = dbapi.query(spark, connect, q, SCHEMA, parameters={"t": "it's", "none": None, "b": b'{"a": "\xc3\xa9"}', "top": 7}, fetch_size=2).orderBy("id").collect()
    assert [(r.note, r.id, r.raw, r.ok) for r in got] == [("it's" if k % 3 else None, k, '{"a": "é"}' if k % 2 else None, bool(k % 2)) for k in range(1, 8)]
    assert dbapi.query(spark, connect, "SELECT id, ok, note, raw FROM r WHERE note = ?", SCHEMA, parameters=["'; DROP TABLE r --"]).count() == 0
    parts = dbapi.texts(spark, connect, "SELECT id, ok, note, raw FROM r WHERE id >= ? AND id < ?", SCHEMA, parts=[(a, a + 300) for a in range(1, 1201, 300)])
    assert parts.rdd.getNumPartitions() == 4 and parts.count() == 1200 and {r[0] for r in parts.select("__record").distinct().collect()} == set(range(1, 301))


def test_failures_tell_record_and_column(spark, path):
    connect = lambda: sqlite3.connect(path)
    with pytest.raises(Exception, match="record 901: note: int is no string"):
        dbapi.query(spark, connect, "SELECT id, CASE id WHEN 901 THEN 1 ELSE note END AS note, raw, ok FROM r ORDER BY r.id", SCHEMA).collect()
    with pytest.raises(Exception, match="query: record 901: id is no integer"):
        dbapi.query(spark, connect, "SELECT CASE id WHEN 901 THEN 'x' ELSE id END AS id, note, raw, ok FROM r ORDER BY r.id", SCHEMA).collect()
    for sql, message in (("SELECT id FROM r", "unexpected"), ("SELECT id, id AS id, note, raw, ok FROM r", "repeated"), ("CREATE TABLE s (i INT)", "no result set")):
        with pytest.raises(Exception, match=message):
            dbapi.query(spark, connect, sql, SCHEMA).collect()
    for bad in (dict(fetch_size=0), dict(fetch_size=True), dict(parameters="x"), dict(parameters={1: 2}), dict(parameters=(), parts=[()])):
        with pytest.raises(ValueError):
            dbapi.texts(spark, connect, "SELECT 1", SCHEMA, **bad)
    with pytest.raises(ValueError, match="blank"):
        dbapi.texts(spark, connect, " ", SCHEMA)
    with pytest.raises(ValueError, match="unknown driver"):
        dbapi.connector("other")
    with pytest.raises(ValueError, match="blank"):
        dbapi.connector("oracle", dsn=" ", user="u", password="p")


def test_values_of_drivers():
    class Large:
        def read(self):
            return "long text"

    reader = dbapi.Rows(None, "", [("a", "string", True)], [None], 1)
    assert reader.value((Large(),), 0, "a", "string", "record 1") == "long text"
    good = [(Decimal("7.0"), "integer", "7"), (Decimal("7.50"), "integer", "7.50"), (7.0, "float", "7.0"), (Decimal("1E+3"), "decimal", "1000"), (True, "boolean", "true"), (Decimal(1), "boolean", "1"), (date(2024, 1, 2), "date", "2024-01-02"),
            (datetime(2024, 1, 2, 3), "datetime", "2024-01-02T03:00:00"), ({"a": 1}, "json_object", '{"a": 1}'), (None, "integer", None)]
    assert [dbapi.text(v, k) for v, k, _ in good] == [t for _, _, t in good]
    for v, k in ((True, "integer"), (1.0, "integer"), (2, "boolean"), (b"x", "string"), (datetime(2024, 1, 2), "date"), (date(2024, 1, 2), "datetime"), (True, "float"), ([1], "json_object")):
        with pytest.raises(TypeError):
            dbapi.text(v, k)
