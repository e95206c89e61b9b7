"""Sources, the report and its publication, settings and the command line."""
import csv as plain
import io
import json

import pytest
from pyspark.sql import functions as F

from revisio import cli, config, publish, report
from revisio.operators import quality
from revisio.plans import payloads, records
from revisio.sources import csv, jdbc, schema

COLUMNS = [("id", "integer", False), ("t", "string", True), ("x", "float", True), ("ok", "boolean", True), ("at", "datetime", True)]


def test_csv_keeps_blank_and_null_apart(spark, tmp_path):
    d = spark.createDataFrame([(1, 'a,"b"\nc', 0.0001, True), (2, None, None, None), (3, "", 1e-7, False), (4, " x ", 2.0, None)], "id long, t string, x double, ok boolean").withColumn("at", F.lit("2024-01-02T03:04:05").cast("timestamp_ntz"))
    csv.write(d, str(tmp_path / "t"))
    got = csv.read(spark, str(tmp_path / "t" / "*.csv"), COLUMNS, nulls=("\\N",)).orderBy("id").collect()
    assert got == d.orderBy("id").collect()
    assert [r.x for r in csv.told(d).orderBy("id").collect()] == ["0.0001", "\\N", "1.0e-7", "2.0"]
    with pytest.raises(Exception, match="null marker"):
        csv.write(d.withColumn("t", F.lit("\\N")), str(tmp_path / "u"))
    with pytest.raises(Exception, match="finite"):
        csv.told(d.withColumn("x", F.lit(float("nan")))).collect()


def test_csv_dialect_and_arity(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_text("﻿x;id\n'1;5';7\nNA;8\n", "utf-8")
    s = [("id", "integer", False), ("x", "string", True)]
    assert [tuple(r) for r in csv.read(spark, str(p), s, nulls=("NA",), dialect=csv.Dialect(";", "'")).collect()] == [(7, "1;5"), (8, None)]
    for text, message in (("id,x\n1\n", "1 fields"), ("id,id\n1,2\n", "repeated"), ("id,y\n1,2\n", "unexpected"), ("\n", "missing")):
        p.write_text(text)
        with pytest.raises(Exception, match=message):
            csv.read(spark, str(p), s).collect()
    with pytest.raises(ValueError):
        csv.Dialect('"', '"')
    p.write_text("x,id\na,1\n,2\n")
    assert [tuple(r) for r in csv.scan(spark, str(p), s).collect()] == [(1, "a"), (2, None)]


def test_schema_documents():
    assert schema.parse({"columns": [{"name": "a", "type": "integer"}, {"name": "b", "type": "string", "nullable": True}]}) == [("a", "integer", False), ("b", "string", True)]
    for bad in ({}, {"columns": []}, {"columns": [{"name": "a"}]}, {"columns": [{"name": "a", "type": "text"}]}, {"columns": [{"name": "a", "type": "date"}] * 2}, {"columns": [{"name": " ", "type": "date"}]}, {"columns": [{"name": "a", "type": "date", "x": 1}]}):
        with pytest.raises(ValueError):
            schema.parse(bad)
    with pytest.raises(ValueError, match="lacks"):
        schema.require([("a", "date", False)], ["a", "b"])


def test_jdbc_binds_and_checks_columns(spark, tmp_path):
    url = "jdbc:derby:memory:revisio;create=true"
    spark._jvm.java.lang.Class.forName("org.apache.derby.jdbc.EmbeddedDriver")
    c = spark._jvm.java.sql.DriverManager.getConnection(url)
    s = c.createStatement()
    s.execute("CREATE TABLE r (id INT, note CLOB, seen TIMESTAMP)")
    s.execute("INSERT INTO r VALUES (1, 'it''s', TIMESTAMP('2024-01-01 00:00:00')), (2, 'b', NULL), (3, 'c', NULL)")
    o = {"url": url, "driver": "org.apache.derby.jdbc.EmbeddedDriver"}
    columns = [("seen", "datetime", True), ("id", "integer", False), ("note", "string", True)]
    q = "SELECT id, note, seen FROM r WHERE id < :top AND (CAST(note AS VARCHAR(9)) = :text OR id = 2) -- :no"
    got = jdbc.query(spark, o, q, columns, {"top": 3, "text": "it's"}, fetch_size=1).orderBy("id").collect()
    assert [(r.id, r.note, str(r.seen)) for r in got] == [(1, "it's", "2024-01-01 00:00:00"), (2, "b", "None")]
    with pytest.raises(ValueError, match="unexpected"):
        jdbc.query(spark, o, "SELECT id FROM r", columns)
    with pytest.raises(ValueError, match="not used"):
        jdbc.bound("SELECT 1", {"a": 1})
    with pytest.raises(ValueError, match="no value"):
        jdbc.bound("SELECT :a, ':b'")
    with pytest.raises(ValueError, match="unknown driver"):
        jdbc.driver("other")
    (tmp_path / "q.sql").write_text(" \n")
    with pytest.raises(ValueError, match="blank"):
        jdbc.read_sql_file(tmp_path / "q.sql")


def test_settings_precedence(tmp_path):
    s = (config.Setting("a", config.integer, "A", 1), config.Setting("b", config.boolean, "B"), config.Setting("c", config.text, "C", prompt="C?", secret=True))
    (tmp_path / ".env").write_text("# note\nexport A='3'\nB=off\n")
    got = config.resolve(s, {"a": None}, {"A": "2", "B": " "}, config.dotenv(tmp_path / ".env"), lambda prompt, secret: "hidden" if secret else "")
    assert got.values == {"a": 2, "b": False, "c": "hidden"} and got.sources == {"a": "environment", "b": "dotenv", "c": "prompt"} and "hidden" not in repr(got)
    for bad in (dict(explicit={"z": 1}), dict(explicit={"a": "x", "b": "1", "c": "k"}), dict(explicit={"b": "1"})):
        with pytest.raises(ValueError):
            config.resolve(s, **bad)


@pytest.fixture(scope="module")
def source(spark, tmp_path_factory):
    """A CSV of some records with payloads."""
    d = "/root/testdata/sf0.001"
    t = records.tables(spark, d)
    r = payloads.with_payloads(t.rec, t.pay).withColumn("LLM_METADATA", F.lit(None).cast("string"))
    names = [n for n, _ in report.RECORDS]
    some = r.where("hash(STUDY_NUM) % 12 = 0").select(names)
    path = tmp_path_factory.mktemp("report")
    csv.write(some.coalesce(1), str(path / "in"))
    return path


def test_report_to_publication(spark, source):
    out = io.StringIO()
    assert cli.main(["report-csv", "--input", str(source / "in" / "*.csv"), "--output", str(source / "rep")], spark, out) == 0
    x = report.load(spark, source / "rep")
    n = x["records"].count()
    assert f"source_row_count: {n}" in out.getvalue() and x["ai_assistance_metrics"].count() == 12 * x["records"].where("ATTEMPT_TYPE = 'AI' AND ATTEMPT_RESULT = 'COMPLETE'").count() > 0
    assert cli.main(["report-csv", "--input", str(source / "in" / "*.csv"), "--output", str(source / "rep")], spark, out) == 2
    assert cli.main(["validate", "--input", str(source / "rep")], spark, out) == 0 and f"record_attempt_count: {n}" in out.getvalue()
    assert cli.main(["analyze", "--input", str(source / "rep"), "--output", str(source / "exp")], spark, out) == 0
    m = json.loads((source / "exp" / publish.MANIFEST).read_text())
    assert m["output_count"] == 33 and m["row_counts"]["overview/overview_summary"] == 31 and m["row_counts"]["analysis-audit-records/study_attempt_author_history"] == n
    assert not list(source.glob(".exp*"))
    # parts one after another are in the published order
    lines = [r for f in sorted((source / "exp/analysis-audit-records/study_attempt_author_history").glob("part-*.csv")) for r in list(plain.reader(open(f, newline="")))[1:]]
    assert len(lines) == n and [(r[0], int(r[1])) for r in lines] == sorted((r[0], int(r[1])) for r in lines)
    checks = [r for f in sorted((source / "exp/quality/data_quality_summary").glob("part-*.csv")) for r in list(plain.reader(open(f, newline="")))[1:]]
    assert [r[0] for r in checks] == [k[0] for k in quality.CHECKS]
    assert cli.main(["summarize-quality", "--input", str(source / "exp"), "--fail-on-warning"], spark, out) == (3 if m["warning_attempt_count"] else 0)
    assert "Fatal checks passed: 13 of 13" in out.getvalue()
    bins = csv.texts(spark, str(source / "exp/authors/current_author_experience_summary/*.csv"), [(c, "string", True) for c in spark.read.option("header", True).csv(str(source / "exp/authors/current_author_experience_summary")).columns], nulls=("\\N",)).first()
    assert len(json.loads(bins.author_activity_percentile_bins_json)) == 32
    meta = json.loads((source / "rep" / report.METADATA).read_text())
    for change in ({"schema_version": 2}, {"extra": 1}, {"source_snapshot_provenance": "UNAVAILABLE"}, {"source_snapshot_as_of_utc": "2020-01-01T00:00:00"}):
        (source / "m.json").write_text(json.dumps(meta | change))
        with pytest.raises(ValueError):
            report.metadata(source / "m.json")


def test_source_is_read_once(spark, source, tmp_path):
    reads = spark.sparkContext.accumulator(0)

    def told(batches):
        for b in batches:
            reads.add(b.num_rows)
            yield b

    x = report.load(spark, source / "rep")["records"].cache()
    counts = report.write(x.mapInArrow(told, x.schema), tmp_path / "once")
    assert reads.value == x.count() == counts["source_row_count"] and counts["ai_assistance_row_count"] == 12 * counts["analyzed_row_count"] > 0


def test_rules_stop_a_report(spark, source):
    x = report.load(spark, source / "rep")
    tables = [x[n] for n in report.TABLES]
    with pytest.raises(ValueError, match="completed_twice|repeated_ids"):
        quality.check(tables[0].union(tables[0]), *tables[1:])
    with pytest.raises(ValueError, match="assistance_orphans .*missing_authors"):
        quality.check(tables[0].where("ATTEMPT_RESULT <> 'COMPLETE'").withColumn("AUTHOR_USER_NAME", F.lit(" ")), *tables[1:])
    with pytest.raises(ValueError, match="selected_not_picked"):
        quality.check(tables[0], tables[1].withColumn("picked_index", F.lit(7)), tables[2])
    with pytest.raises(ValueError, match="repeated or null"):
        report.write(tables[0].union(tables[0]), source / "no")
