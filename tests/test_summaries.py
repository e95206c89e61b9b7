"""Summaries from partials: merged statistics against plain ones, and plans without copies of rows or unkeyed joins."""
import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from revisio import stats
from revisio.operators.context_tables import CONTEXTS
from revisio.operators.field_tables import FIELDS
from revisio.operators.tables import ATTEMPTS
from revisio.plans import records


@pytest.mark.parametrize("name", ["a07_grouped_authors", "a10_activity_bins", "a11_field_adoption", "a12_nontext", "a14_compensation", "a24_size_latency"])
def test_plans_copy_no_rows(spark, name):
    plan = (ATTEMPTS | FIELDS | CONTEXTS)[name].frame_of(records.tables(spark, "/root/testdata/sf0.001"))._jdf.queryExecution().executedPlan().toString()
    assert not any(k in plan for k in ("Expand", "CartesianProduct", "BroadcastNestedLoop"))


def test_overlapping_groups_equal_plain_statistics(spark):
    rng = random.Random(11)
    rows = [(rng.choice(["x", "y", None]), rng.choice([True, False]), rng.choice([None, 1e9, 1e9 + 1, rng.random() * 100, -3.5]), f"id{rng.randrange(60)}", rng.random() < 0.3, "one") for _ in range(700)]
    d = spark.createDataFrame(rows, "m string, ok boolean, v double, id string, flag boolean, s string").repartition(6)
    labels = stats.Labels(("g", "h"), (("'ALL'", "'-'"), ("CASE WHEN ok THEN 'OK' END", "'-'"), ("'BY_M'", "coalesce(m, 'MISSING')")))
    counts = {"n": "count(*)", "flags": "count(CASE WHEN flag THEN 1 END)", "ids": "count(DISTINCT id)", "flagged": "count(DISTINCT CASE WHEN flag THEN id END)", "said": stats.one_value("s")}
    got = {(r.g, r.h): r for r in stats.described(d, ["g", "h"], {"v": stats.named("v", n="known", missing="missing")}, labels, **counts).collect()}
    groups = {("ALL", "-"): rows, ("OK", "-"): [r for r in rows if r[1]], **{("BY_M", k or "MISSING"): [r for r in rows if r[0] == k] for k in ("x", "y", None)}}
    assert set(got) == set(groups)
    for k, some in groups.items():
        r, v = got[k], [x[2] for x in some if x[2] is not None]
        assert (r.n, r.flags, r.ids, r.flagged, r.said, r.known, r.missing) == (len(some), sum(x[4] for x in some), len({x[3] for x in some}), len({x[3] for x in some if x[4]}), "one", len(v), len(some) - len(v))
        want = [min(v), *np.quantile(v, [0.25, 0.5]), statistics.fmean(v), statistics.stdev(v), *np.quantile(v, [0.75, 0.9]), max(v)]
        assert np.allclose([r.minimum_v, r.percentile_25_v, r.median_v, r.average_v, r.standard_deviation_v, r.percentile_75_v, r.percentile_90_v, r.maximum_v], want, rtol=1e-9)
    with pytest.raises(Exception, match="v is not finite"):
        stats.described(d.withColumn("v", F.lit(float("nan"))), ["m"], {"v": stats.named("v", "mean")}).collect()
