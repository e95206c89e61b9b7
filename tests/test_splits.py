"""CSV records of split files against a parser that reads whole files."""
import csv as plain
import io
import random

import pytest

from revisio.sources import csv

NAMES = ("a", "b", "c")
SCHEMA = [(n, "string", True) for n in NAMES]


@pytest.fixture
def small(spark):
    """Splits of 400 bytes."""
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    cost = spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "400")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", was)
    spark.conf.set("spark.sql.files.openCostInBytes", cost)


def whole(data, dialect, encoding="utf-8-sig"):
    rows = list(plain.reader(io.StringIO(data.decode(encoding), newline=""), **dialect))
    at = [rows[0].index(n) for n in NAMES]
    return [(*(None if r[i] == "\\N" else r[i] for i in at), k) for k, r in enumerate(rows[1:], 1)]


def field(rng, d, newline):
    t = "".join(rng.choice(["x", "y z", d.get("quotechar", '"'), d.get("delimiter", ","), newline, "\n", "é", "\r", "  "]) for _ in range(rng.choice([0, 1, 3, 9, 60])))
    return rng.choice([t, "", "\\N", "plain", "long " * 30])


@pytest.mark.parametrize("dialect,newline", [({}, "\n"), ({}, "\r\n"), ({"delimiter": ";", "quotechar": "'"}, "\n"), ({"escapechar": "\\", "doublequote": False}, "\n"), ({"escapechar": "\\"}, "\n"), ({"strict": False, "skipinitialspace": True}, "\n")])
def test_split_files_equal_whole_ones(spark, small, tmp_path, dialect, newline):
    rng = random.Random(8)
    want = []
    for k in range(3):
        text = io.StringIO()
        w = plain.writer(text, lineterminator=newline, **{n: v for n, v in dialect.items() if n not in ("strict", "skipinitialspace")})
        names = rng.sample(NAMES, 3)
        w.writerow(names)
        for _ in range(40):
            w.writerow([field(rng, dialect, newline) for _ in names])
        t = text.getvalue()
        if "escapechar" not in dialect and k == 1:
            t += f'in"side{dialect.get("delimiter", ",")}b{dialect.get("delimiter", ",")}c'  # a quote within a field, and no line end
        data = (b"\xef\xbb\xbf" if k == 2 else b"") + t.encode()
        (tmp_path / f"{k}.csv").write_bytes(data)
        full = {"delimiter": ",", "quotechar": '"', "escapechar": None, "doublequote": True, "skipinitialspace": False, "strict": True} | dialect
        want += [(*r, f"{k}.csv") for r in whole(data, full)]
    (tmp_path / "empty.csv").write_bytes(b"")
    out = csv.texts(spark, str(tmp_path / "*.csv"), SCHEMA, nulls=("\\N",), dialect=csv.Dialect(**dialect), numbered=True)
    got = [(r.a, r.b, r.c, r["__record"], r["__file"].rsplit("/", 1)[1]) for r in out.collect()]
    assert out.rdd.getNumPartitions() > 12
    assert sorted(got, key=repr) == sorted(want, key=repr) and any("\n" in (r[0] or "") for r in want)


def test_errors_tell_the_record(spark, small, tmp_path):
    p = tmp_path / "n.csv"
    rows = [f'{k},"two\nlines"' for k in range(1, 600)]
    rows[300] = '9x,"two\nlines"'
    p.write_text("id,t\n" + "\n".join(rows) + "\n")
    schema = [("id", "integer", False), ("t", "string", True)]
    with pytest.raises(Exception, match=r"n\.csv: record 301: id is no integer"):
        csv.read(spark, str(p), schema).collect()
    rows[300], rows[500] = '9,"two\nlines"', '7,"two\nlines",8'
    p.write_text("id,t\n" + "\n".join(rows) + "\n")
    with pytest.raises(Exception, match=r"n\.csv: record 501 has 3 fields, not 2"):
        csv.read(spark, str(p), schema).collect()
    rows[500] = ',"two\nlines"'
    p.write_text("id,t\n" + "\n".join(rows))
    with pytest.raises(Exception, match=r"record 501: id is null"):
        csv.read(spark, str(p), schema, nulls=("",)).collect()
    rows[500] = '7,"two\nlines"z'
    p.write_text("id,t\n" + "\n".join(rows))
    with pytest.raises(Exception, match=r"n\.csv: record 501: .*expected after"):
        csv.read(spark, str(p), schema)
    p.write_text("id,t\n" + "\n".join(rows[:400]) + '\n5,"open\n' + "x\n" * 200)
    with pytest.raises(Exception, match=r"n\.csv: record 401: unexpected end"):
        csv.read(spark, str(p), schema)


def test_encodings_without_byte_lines(spark, tmp_path):
    (tmp_path / "u.csv").write_bytes("a,b,c\n1,\"é\nü\",3\n".encode("utf-16"))
    assert [tuple(r) for r in csv.texts(spark, str(tmp_path / "u.csv"), SCHEMA, encoding="utf-16").collect()] == [("1", "é\nü", "3")]
    (tmp_path / "l.csv").write_bytes("a,b,c\n1,\"é\nü\",3\n".encode("latin-1"))
    assert [tuple(r) for r in csv.texts(spark, str(tmp_path / "l.csv"), SCHEMA, encoding="latin-1").collect()] == [("1", "é\nü", "3")]
