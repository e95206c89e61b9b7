"""CSV files with a fixed schema, a dialect and a set of null markers.

`read` keeps blank and null apart, splits files also where quoted fields hold line ends (see splits) and fails on a record of
another width; files without a byte are left out. `scan` is Spark's own reader, for dialects where an unquoted blank may be null."""
from dataclasses import asdict, dataclass

from pyspark.sql import Observation
from pyspark.sql import functions as F

from revisio.sources import schema as schemas
from revisio.sources import splits
from revisio.sources.convert import row


@dataclass(frozen=True)
class Dialect:
    delimiter: str = ","
    quotechar: str = '"'
    escapechar: str | None = None
    doublequote: bool = True
    skipinitialspace: bool = False
    strict: bool = True

    def __post_init__(self):
        for name in ("delimiter", "quotechar", "escapechar"):
            c = getattr(self, name)
            if not (c is None and name == "escapechar") and (not isinstance(c, str) or len(c) != 1):
                raise ValueError(f"{name} must be one character")
        if self.delimiter == self.quotechar:
            raise ValueError("delimiter and quote must differ")
        for name in ("doublequote", "skipinitialspace", "strict"):
            if not isinstance(getattr(self, name), bool):
                raise ValueError(f"{name} must be true or false")


def texts(spark, path, schema, encoding="utf-8-sig", nulls=("", "\\N"), dialect=Dialect(), numbered=False):
    """All columns as text in the schema's order, markers as null; errors tell file and record number, as the columns __file and __record do if asked for.

    Records are those of a csv parser that reads each file as a whole, but files are read in the splits that Spark makes."""
    job = splits.Job([n for n, _, _ in schema], asdict(dialect), encoding, frozenset(nulls))
    rows = job.split(spark, path) if splits.splits(encoding) else job.whole(spark, path)
    return rows if numbered else rows.drop(*splits.HIDDEN)


def read(spark, path, schema, **options):
    """A CSV file or folder in canonical types; schema is a list of (name, type, nullable). A value that is not of its type fails with its file, record and column."""
    return row(texts(spark, path, schema, numbered=True, **options), schema)


def scan(spark, path, schema, nulls=("", "\\N"), encoding="UTF-8", dialect=Dialect()):
    """The same by Spark's reader: unquoted blanks are null whatever the markers."""
    options = {"header": True, "sep": dialect.delimiter, "quote": dialect.quotechar, "escape": dialect.escapechar or dialect.quotechar, "ignoreLeadingWhiteSpace": dialect.skipinitialspace, "multiLine": True, "encoding": encoding}
    first = spark.read.options(**options).csv(path).columns
    schemas.same_names(first, schema)
    df = spark.read.schema(", ".join(f"`{c}` string" for c in first)).options(mode="FAILFAST", emptyValue="", nullValue="\u0000", **options).csv(path)
    return row(df.select(*[F.when(~F.col(f"`{n}`").isin(*nulls), F.col(f"`{n}`")).alias(n) for n, _, _ in schema]), schema)


def told(df, null="\\N"):
    """All columns as canonical text: true and false, shortest numbers, ISO times, sorted JSON; a text equal to the marker and numbers that are not finite fail."""
    cols = []
    for f in df.schema:
        c, kind = F.col(f"`{f.name}`"), f.dataType.typeName()
        if kind in ("double", "float"):
            c = F.when(F.isnan(c) | (F.abs(c) == float("inf")), F.raise_error(F.lit(f"{f.name} is not finite")).cast("double")).otherwise(c)
            whole = F.format_string("%.1f", c)
            plain = F.regexp_replace(F.format_string("%.17f", c), r"0+$", "")
            text = F.when(c == 0, "0.0").when((c == F.floor(c)) & (F.abs(c) < 1e16), whole).when((F.abs(c) < 1e-3) & (F.abs(c) >= 1e-4) & (plain.cast("double") == c), plain).otherwise(F.lower(c.cast("string")))
        elif kind in ("timestamp", "timestamp_ntz"):
            text = F.replace(c.cast("string"), F.lit(" "), F.lit("T"))
        elif kind in ("struct", "array", "map"):
            text = F.to_json(c, {"ignoreNullFields": "false"})
        else:
            text = c.cast("string")
        cols.append(F.when(c.isNull(), null).when(text == null, F.raise_error(F.lit(f"{f.name} holds the null marker")).cast("string")).otherwise(text).alias(f.name))
    return df.select(*cols)


def write(df, path, null="\\N", order=()):
    """A CSV folder, each file with a header, nulls as the marker and blanks quoted; returns the number of rows, counted as they are written.

    By `order`, sort expressions, rows are dealt out in ranges and sorted in each, so the files hold them in order one after another by name."""
    seen = Observation()
    d = df.repartitionByRange(*order).sortWithinPartitions(*order) if order else df
    told(d, null).observe(seen, F.count(F.lit(1)).alias("n")).write.options(header=True, emptyValue='""', escape='"', quoteAll=False, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).mode("errorifexists").csv(path)
    return seen.get["n"]
