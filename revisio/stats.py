"""Shared statistics: percentages, distributions by group, fixed rows and overlapping populations."""
import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from revisio.shared import written

QUANTILES = {"p25": 0.25, "median": 0.5, "p75": 0.75, "p90": 0.9}
#: Statistics in order, and the words their columns begin with.
WORDS = {"min": "minimum", "p25": "percentile_25", "median": "median", "mean": "average", "sd": "standard_deviation", "p75": "percentile_75", "p90": "percentile_90", "max": "maximum"}


def pct(n, d):
    """100 n / d, null for a zero d."""
    return F.lit(100.0) * n / F.nullif(d, F.lit(0))


def named(metric, which="min p25 median mean sd p75 p90 max", **more):
    """{statistic: column}: minimum_<metric> and so on; `more` names others, such as n and missing."""
    return {s: f"{WORDS[s]}_{metric}" for s in which.split()} | more


@dataclass(frozen=True)
class Labels:
    """The groups that a row counts in: tuples of SQL texts for the columns `names`; a tuple whose first text is null does not apply."""
    names: tuple
    rows: tuple

    def columns(self, df):
        """Columns of df that the texts speak of: rows that agree in them have the same labels."""
        words = set(re.findall(r"[A-Za-z_]\w*", " ".join(t for r in self.rows for t in r)))
        return [c for c in df.columns if c in words]

    def spread(self, df):
        """df once for each label of a row."""
        rows = ", ".join("named_struct(" + ", ".join(f"'{n}', CAST({e} AS STRING)" for n, e in zip(self.names, r)) + ")" for r in self.rows)
        return df.withColumn("__l", F.explode(F.expr(f"filter(array({rows}), r -> r.{self.names[0]} IS NOT NULL)"))).drop(*self.names).select("*", "__l.*").drop("__l")


def quantiles(df, metrics, keys, grain, spread):
    """__g, and a struct of exact linear quantiles for each metric.

    Values are counted at the finest grain and binned by a monotone function of the value. Counts of bins are spread over
    the labels and added up; the ranks looked for are located among their totals. Only values of the bins that hold one are
    ranked, so no task sees a whole group."""
    long = df.select(*grain, F.explode(F.array(*[F.struct(F.lit(m).alias("__m"), finite(m).alias("__v")) for m in metrics])).alias("__x")).select(*grain, "__x.*").where("__v is not null")
    c = long.groupBy(*grain, "__m", "__v").agg(F.count("*").alias("__n")).withColumn("__bin", F.signum("__v") * F.floor(F.log1p(F.abs("__v")) * 512))
    w = Window.partitionBy("__g", "__m")
    b = spread(c.groupBy(*grain, "__m", "__bin").agg(F.sum("__n").alias("__n"))).groupBy(F.struct(*keys).alias("__g"), "__m", "__bin").agg(F.sum("__n").alias("__n")).withColumn("upto", F.sum("__n").over(w.orderBy("__bin"))).withColumn("total", F.sum("__n").over(w))
    ranks = F.array_distinct(F.flatten(F.array(*[F.array(F.floor((F.col("total") - 1) * p), F.ceil((F.col("total") - 1) * p)) for p in QUANTILES.values()])))
    b = b.withColumn("before", F.col("upto") - F.col("__n")).withColumn("ranks", F.filter(ranks, lambda r: (r >= F.col("before")) & (r < F.col("upto")))).where("size(ranks) > 0")
    # written, so that its size is known when the values meet it
    b = written(b.select("__g", "__m", "__bin", "before", "total", "ranks"))
    s = spread(c).withColumn("__g", F.struct(*keys)).join(b, ["__g", "__m", "__bin"]).groupBy("__g", "__m", "__bin", "__v").agg(F.sum("__n").alias("__n"), F.first("before").alias("before"), F.first("total").alias("total"), F.first("ranks").alias("ranks"))
    s = s.withColumn("upto", F.col("before") + F.sum("__n").over(Window.partitionBy("__g", "__m", "__bin").orderBy("__v")))
    s = s.select("__g", "__m", "total", "__v", F.explode(F.filter("ranks", lambda r: (r >= F.col("upto") - F.col("__n")) & (r < F.col("upto")))).alias("r"))
    s = s.groupBy("__g", "__m").agg(F.max("total").alias("total"), F.map_from_entries(F.collect_list(F.struct("r", "__v"))).alias("at"))

    def value(p):
        x = (F.col("total") - 1) * p
        lo, hi = F.element_at("at", F.floor(x)), F.element_at("at", F.ceil(x))
        return lo + (hi - lo) * (x - F.floor(x))

    q = s.select("__g", "__m", F.struct(*[value(p).alias(name) for name, p in QUANTILES.items()]).alias("q"))
    return q.groupBy("__g").agg(*[F.max(F.when(F.col("__m") == m, F.col("q"))).alias(f"q_{m}") for m in metrics])


def finite(metric):
    """A metric as a double; one that is not finite fails."""
    v = F.col(metric).cast("double")
    return F.when(F.isnan(v) | (F.abs(v) == float("inf")), F.raise_error(F.lit(f"{metric} is not finite")).cast("double")).otherwise(v)


_DISTINCT = re.compile(r"count\(DISTINCT (?:CASE WHEN (?P<where>.*) THEN (?P<id>\w+) END|(?P<all>\w+))\)", re.S)
_SUMS = ((re.compile(r"count\(\*\)"), "1"), (re.compile(r"count\(CASE WHEN (.*) THEN 1 END\)", re.S), r"CASE WHEN \1 THEN 1 ELSE 0 END"), (re.compile(r"count\((\w+)\)"), r"CASE WHEN \1 IS NOT NULL THEN 1 ELSE 0 END"),
         (re.compile(r"CAST\(sum\((\w+)\) AS BIGINT\)"), r"\1"))
_ONE = re.compile(r"CASE WHEN min\((\w+)\) = max\(\1\) THEN max\(\1\) END")


def one_value(column):
    """The text of a column's value where a group has but one."""
    return f"CASE WHEN min({column}) = max({column}) THEN max({column}) END"


def _added(text):
    for pattern, term in _SUMS:
        if m := pattern.fullmatch(text):
            return m.expand(term)
    raise ValueError(f"no partial sums for {text}")


def described(df, keys, metrics, labels=None, **aggregates):
    """One row a group of `keys`: `aggregates` (SQL texts), and for each metric its statistics under the given names.

    Rows are aggregated once, at the finest grain that the keys and labels tell apart; labels are spread over these
    partials, which are then merged. Distinct ids are flags a (grain, id) first, and are counted by flag, without copies of
    the rows. sd is the sample's, null for one value; without values all but the counts are null. A value that is not finite fails."""
    grain = [k for k in keys if labels is None or k not in labels.names] + (labels.columns(df) if labels else [])
    grain, spread = list(dict.fromkeys(grain)), labels.spread if labels else lambda d: d
    ids, sums, ones = {}, {}, {}
    for name, e in aggregates.items():
        if m := _DISTINCT.fullmatch(e):
            ids.setdefault(m["id"] or m["all"], {})[name] = m["where"] or "true"
        elif m := _ONE.fullmatch(e):
            ones[name] = m[1]
        else:
            sums[name] = F.expr(_added(e))
    moments = [m for m, stats in metrics.items() if set(stats) - set(QUANTILES)]
    spans = {s for m in moments for s in metrics[m]}
    out = [F.count(F.lit(1)).alias("__rows"), *[F.sum(e).alias(f"__c_{n}") for n, e in sums.items()], *[f(c).alias(f"__{k}_{n}") for n, c in ones.items() for k, f in (("lo", F.min), ("hi", F.max))]]
    for m in moments:
        v = finite(m)
        out += [F.count(v).alias(f"__n_{m}"), F.avg(v).alias(f"__avg_{m}"), F.var_pop(v).alias(f"__var_{m}"), F.min(v).alias(f"__min_{m}"), F.max(v).alias(f"__max_{m}")]
    parts = spread(df.groupBy(*grain).agg(*out)).withColumn("__g", F.struct(*keys))
    number, mean = (lambda m: F.col(f"__n_{m}")), (lambda m: F.col(f"__avg_{m}"))
    merged = [F.sum("__rows").alias("__rows"), *[F.sum(f"__c_{n}").alias(n) for n in sums], *[F.when(F.min(f"__lo_{n}") == F.max(f"__hi_{n}"), F.max(f"__hi_{n}")).alias(n) for n in ones]]
    for m in moments:
        merged += [F.sum(number(m)).alias(f"n_{m}"), (F.sum(number(m) * mean(m)) / F.nullif(F.sum(number(m)), F.lit(0))).alias(f"mean_{m}"), F.min(f"__min_{m}").alias(f"min_{m}"), F.max(f"__max_{m}").alias(f"max_{m}")]
    g = parts.groupBy("__g").agg(*merged)
    if "sd" in spans:
        which = [m for m in moments if "sd" in metrics[m]]
        off = parts.join(g.select("__g", *[f"mean_{m}" for m in which]), "__g").groupBy("__g").agg(*[F.sum(number(m) * (F.col(f"__var_{m}") + (mean(m) - F.col(f"mean_{m}")) ** 2)).alias(f"off_{m}") for m in which])
        g = g.join(off, "__g")
    if ids:
        g = g.join(_distinct(df, ids, grain, spread, keys), "__g", "left").fillna(0, [n for conditions in ids.values() for n in conditions])
    ranked = [m for m, stats in metrics.items() if set(stats) & set(QUANTILES)]
    if ranked:
        g = g.join(quantiles(df, ranked, keys, grain, spread), "__g", "left")
    cols = [F.col(n) for n in aggregates]
    for m, stats in metrics.items():
        n = F.col(f"n_{m}") if m in moments else None
        kinds = {"n": lambda: n, "missing": lambda: F.col("__rows") - n, "min": lambda: F.col(f"min_{m}"), "mean": lambda: F.col(f"mean_{m}"), "max": lambda: F.col(f"max_{m}"), "sd": lambda: F.when(n > 1, F.sqrt(F.col(f"off_{m}") / (n - 1)))}
        cols += [(F.col(f"q_{m}.{s}") if s in QUANTILES else kinds[s]()).alias(name) for s, name in stats.items()]
    return g.select("__g.*", *cols)


def _distinct(df, ids, grain, spread, keys):
    """Distinct ids by condition: {id column: {name: condition}}."""
    width = max(map(len, ids.values()))
    kinds = [F.struct(F.lit(i).alias("__kind"), F.col(c).cast("string").alias("__id"), *[F.coalesce(F.expr(conditions[j]) if j < len(conditions) else F.lit(False), F.lit(False)).alias(f"__f{j}") for j in range(width)])
             for i, (c, by) in enumerate(ids.items()) for conditions in [list(by.values())]]
    flags = [f"__f{j}" for j in range(width)]
    told = [F.bool_or(f).alias(f) for f in flags]
    rows = df.select(*grain, F.explode(F.array(*kinds)).alias("__k")).select(*grain, "__k.*").where("__id IS NOT NULL").groupBy(*grain, "__kind", "__id").agg(*told)
    each = spread(rows).groupBy(F.struct(*keys).alias("__g"), "__kind", "__id").agg(*told)
    return each.groupBy("__g").agg(*[F.count_if((F.col("__kind") == i) & F.col(f"__f{j}")).alias(n) for i, by in enumerate(ids.values()) for j, n in enumerate(by)])


def described_sql(metrics):
    """The same statistics as SQL select items."""
    kinds = {"n": "count({0})", "missing": "count(*) - count({0})", "min": "CAST(min({0}) AS DOUBLE)", "mean": "avg({0})", "sd": "stddev_samp({0})", "max": "CAST(max({0}) AS DOUBLE)"}
    kinds |= {s: f"quantile_cont(CAST({{0}} AS DOUBLE), {p})" for s, p in QUANTILES.items()}
    return ", ".join(f"{kinds[s].format(m)} AS {n}" for m, stats in metrics.items() for s, n in stats.items())


def expanded_sql(source, labels, names):
    rows = ", ".join("struct_pack(" + ", ".join(f"{n} := CAST({e} AS VARCHAR)" for n, e in zip(names, r)) + ")" for r in labels)
    return f"(SELECT * EXCLUDE (__l), unnest(__l) FROM (SELECT *, unnest([{rows}]) AS __l FROM {source}) WHERE __l.{names[0]} IS NOT NULL)"


def fixed_rows(spark, names, rows):
    """A frame of a few given rows of strings, for outputs that keep rows without members."""
    return spark.createDataFrame([tuple(r) for r in rows], ", ".join(f"{n} string" for n in names))


def fixed_sql(names, rows):
    values = ", ".join("(" + ", ".join(f"'{v}'" for v in r) + ")" for r in rows)
    return f"(SELECT * FROM (VALUES {values}) AS t({', '.join(names)}))"


def union(frames):
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
