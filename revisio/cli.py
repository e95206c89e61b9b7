"""report csv|database, validate, analyze, summarize-quality and run; exit 0, 2 for an error, 3 for quality warnings on request."""
import argparse
import os
import sys

from pyspark.sql import SparkSession

from revisio import config, publish, report
from revisio.operators import quality
from revisio.sources import csv, dbapi, jdbc, schema

CSV_SETTINGS = (config.Setting("input", config.path, "REVISIO_INPUT"), config.Setting("output", config.path, "REVISIO_OUTPUT"), config.Setting("schema", config.path, "REVISIO_SCHEMA", None), config.Setting("encoding", config.text, "REVISIO_ENCODING", "utf-8-sig"),
                config.Setting("delimiter", str, "REVISIO_DELIMITER", ",", blank_is_missing=False), config.Setting("include_text", config.boolean, "REVISIO_INCLUDE_TEXT", False))
DATABASE_SETTINGS = (config.Setting("output", config.path, "REVISIO_OUTPUT"), config.Setting("schema", config.path, "REVISIO_SCHEMA", None), config.Setting("sql", config.path, "REVISIO_SQL"), config.Setting("driver", config.text, "REVISIO_DRIVER", "oracle"),
                     config.Setting("dsn", config.text, "REVISIO_DSN", prompt="Database"), config.Setting("user", config.text, "REVISIO_USER", prompt="User"), config.Setting("password", config.text, "REVISIO_PASSWORD", prompt="Password", secret=True),
                     config.Setting("parameters", config.json_object, "REVISIO_PARAMETERS", "{}"), config.Setting("fetch_size", config.positive, "REVISIO_FETCH_SIZE", 500), config.Setting("include_text", config.boolean, "REVISIO_INCLUDE_TEXT", False))


def parser():
    p = argparse.ArgumentParser(prog="revisio")
    sub = p.add_subparsers(dest="command", required=True)
    for name, settings in (("report-csv", CSV_SETTINGS), ("report-database", DATABASE_SETTINGS)):
        c = sub.add_parser(name)
        c.add_argument("--dotenv")
        for s in settings:
            c.add_argument(f"--{s.name.replace('_', '-')}")
    for name in ("validate", "analyze", "run"):
        c = sub.add_parser(name)
        c.add_argument("--input", required=True)
        if name != "validate":
            c.add_argument("--output", required=True)
    sub.add_parser("summarize-quality").add_argument("--input", required=True)
    sub.choices["summarize-quality"].add_argument("--fail-on-warning", action="store_true")
    sub.choices["run"].add_argument("--report", required=True)
    return p


def _columns(made):
    return schema.load(made["schema"]) if made["schema"] else [(n, k, True) for n, k in report.RECORDS]


def _settings(settings, args, ask):
    given = {s.name: getattr(args, s.name) for s in settings if getattr(args, s.name) is not None}
    return config.resolve(settings, given, os.environ, config.dotenv(args.dotenv) if args.dotenv else {}, ask)


def main(argv=None, spark=None, out=sys.stdout, ask=None):
    try:
        args = parser().parse_args(argv)
    except SystemExit as e:
        return e.code
    spark = spark or SparkSession.builder.appName("revisio").getOrCreate()
    try:
        if args.command == "report-csv":
            made = _settings(CSV_SETTINGS, args, ask)
            columns = _columns(made)
            schema.require(columns, [n for n, _ in report.RECORDS])
            counts = report.write(csv.read(spark, str(made["input"]), columns, encoding=made["encoding"], dialect=csv.Dialect(made["delimiter"])), made["output"], made["include_text"])
            print(*(f"{k}: {v}" for k, v in counts.items()), sep="\n", file=out)
        elif args.command == "report-database":
            made = _settings(DATABASE_SETTINGS, args, ask)
            sql, columns, parts = jdbc.read_sql_file(made["sql"]), _columns(made), {n: made[n] for n in ("dsn", "user", "password")}
            if made["driver"].endswith("-jdbc"):
                rows = jdbc.query(spark, jdbc.driver(made["driver"].removesuffix("-jdbc")).options(**parts), sql, columns, made["parameters"], made["fetch_size"])
            else:
                rows = dbapi.query(spark, dbapi.connector(made["driver"], **parts), sql, columns, parameters=made["parameters"] or None, fetch_size=made["fetch_size"])
            print(*(f"{k}: {v}" for k, v in report.write(rows, made["output"], made["include_text"]).items()), sep="\n", file=out)
        elif args.command == "validate":
            x = report.load(spark, args.input)
            print(*(f"{k}: {v}" for k, v in quality.check(*(x[n] for n in report.TABLES)).items()), sep="\n", file=out)
        elif args.command == "analyze":
            print(f"tables: {publish.publish(spark, args.input, args.output)['output_count'] - 1}", file=out)
        elif args.command == "summarize-quality":
            rows = publish.quality_rows(spark, args.input)
            print(publish.quality_text(rows), end="", file=out)
            if args.fail_on_warning and any(r["severity_level"] == "WARNING" and r["affected_attempt_count"] for r in rows):
                return 3
        else:
            for step in (["report-csv", "--input", args.input, "--output", args.report], ["analyze", "--input", args.report, "--output", args.output], ["summarize-quality", "--input", args.output]):
                if code := main(step, spark, out, ask):
                    return code
        return 0
    except Exception as e:
        print(f"error: {str(e).splitlines()[0]}", file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
