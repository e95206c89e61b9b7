"""Steps whose work grows with the input: what is planned, and how often a text is looked at."""
import random

import pytest
from pyspark.sql import functions as F

from revisio.functions import postedit, readability
from revisio.operators import fields, quality
from revisio.operators.context_tables import CONTEXTS
from revisio.operators.tables import ATTEMPTS, Part
from revisio.plans import adapters, payloads, records
from test_functions import PAYLOAD, record

SMALL = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["ast", "fld", "prs", "pay"])
def test_tables_that_grow_are_not_broadcast(spark, name):
    assert "BroadcastHashJoin" not in plan(records.tables(spark, SMALL).made(name))


def test_usual_payloads_are_checked_by_their_type_as_a_whole(spark):
    d = spark.createDataFrame([PAYLOAD], "s string, p string, f string").select(*[F.schema_of_variant(F.parse_json(c)) for c in "spf"]).first()
    assert all(spark.range(1).select(F.lit(t).rlike(fields._USUAL[c != 2])).first()[0] for c, t in enumerate(d))
    # of another type, but let through member by member
    odd = PAYLOAD[1].replace("{", '{"contact": "none", ', 1)
    assert len(fields.analysis(record(spark, p=odd)).collect()) == 12


def test_words_are_extracted_once(spark):
    d = spark.createDataFrame([("A text.",)], "t string").select(readability.measures(F.col("t")).alias("m"))
    assert d._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all(lower(") == 1


def test_word_distances_are_kept():
    postedit.word_cost.cache_clear()
    for _ in range(3):
        postedit.soft_distance("alpha beta gamma", "alfa beta delta")
    assert postedit.word_cost.cache_info().misses == 9


def test_alignment_by_bits_is_that_of_the_plain_grid():
    rng = random.Random(8)
    for _ in range(200):
        a, b = ([rng.randrange(4) for _ in range(rng.randrange(12))] for _ in "ab")
        d = postedit.grid(*(postedit.np.array(x, dtype=int) for x in (a, b)))
        i, j, at = len(a), len(b), [0] * len(b)
        while i or j:
            if i and j and d[i, j] == d[i - 1, j - 1] + (a[i - 1] != b[j - 1]):
                i, j = i - 1, j - 1
                at[j] = i
            elif i and d[i, j] == d[i - 1, j] + 1:
                i -= 1
            else:
                j -= 1
                at[j] = i - 1
        assert postedit.aligned(postedit.Bits(b).states(a), a, b)[2] == at


def test_rules_are_not_carried_by_rows_that_break_none(spark):
    t = records.tables(spark, SMALL)
    first = [x for x in plan(quality.violations(t.rec, t.ast, t.rdb)).split("\n") if "partial_sum" in x][-1]
    assert "partial_sum(left" in first and "partial_sum(null_ids" not in first


def test_names_are_dealt_out_and_payloads_read_once(spark):
    p = adapters.pairs(spark, SMALL)
    assert p.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism and "BroadcastHashJoin" not in plan(p)
    t = records.tables(spark, SMALL)
    assert plan(t.made("ast")).count("ArrowEvalPython") >= 1 and "Union" not in plan(t.made("ast"))


def test_distance_is_computed_once(spark):
    d = postedit.analyzed(spark.createDataFrame([("a", "b")], "selected_text string, final_text string"))
    assert d._jdf.queryExecution().optimizedPlan().toString().count("levenshtein(") == 1


@pytest.mark.parametrize("name", ["a04_grouped_attempts", "a06_completed_context", "a26_pathways"])
def test_wide_tables_are_not_written_for_one_reader(spark, monkeypatch, name):
    monkeypatch.setattr(records, "_runs", {})
    t = records.tables(spark, SMALL)
    (ATTEMPTS | CONTEXTS)[name].frame_of(t)
    assert not {"rec", "att", "stu", "ctx"} & set(vars(t))


def test_a_snapshot_is_planned_over_the_columns_it_takes(spark, monkeypatch):
    monkeypatch.setattr(records, "_runs", {})
    t = records.tables(spark, SMALL)
    text = plan(t.made("stx"))
    assert not {"rec", "att", "stu"} & set(vars(t)) and "AUTHOR_APPOINTMENTS" not in text


def test_columns_that_a_part_speaks_of_are_taken(spark):
    d = spark.createDataFrame([("a", "b", 1.0, 2)], "k string, unused string, v double, ID long")
    assert Part("", ("k",), counts={"n": "count(DISTINCT id)"}, metrics={"v": {}}).taken(d) == ["k", "v", "ID"]
    assert Part("", ("grp",), ("grp",), (("'ALL'",),), {"n": "count(*)"}).taken(d) == ["k"]


def test_field_rows_are_compiled_and_payloads_decoded_and_not_sorted(spark):
    t = records.tables(spark, SMALL)
    text, best = plan(t.made("ast")), t.made("ast")._jdf.queryExecution().optimizedPlan().toString()
    assert "explode(array(" not in text and best.count("from_json(") == 3
    assert "BuildLeft" in text and "Sort [" not in text
    # payloads of records made by hand are no business of the analysis, but the report reads their final texts
    assert "(attempt_type" in best and "= AI)" in best
    assert payloads.with_payloads(t.fin, t.pay).where("ATTEMPT_TYPE <> 'AI' AND FINAL_SUBMISSION IS NOT NULL").count() > 0


def test_plain_ascii_texts_are_compared_as_in_python(spark):
    rng = random.Random(3)
    odd = "aB1 \t\n\x0b\x1c\x1d\x1f\x00\x7f!$+<^`~_-." + "éΣ "
    rows = [["".join(rng.choice(odd) for _ in range(rng.randrange(5))) for _ in "ab"] for _ in range(3000)]
    rows += [["A  text!", "a text"], ["a.b", "a b"], ["ab", "a b"], ["", "!"], ["?", "!"], ["\x1d", "\x1c"], ["É t", "e T"]]
    got = postedit.analyzed(spark.createDataFrame(rows, "selected_text string, final_text string"))
    assert "regexp_replace(lower(" in plan(got.select("cosmetic"))
    seen = got.select("selected_text", "final_text", "cosmetic").collect()
    assert len(seen) == len(rows)
    for a, b, same in seen:
        assert same == (postedit.plain(postedit.composed(a)) == postedit.plain(postedit.composed(b)) if postedit.composed(b).split() else None), (a, b)


def test_a_contained_text_needs_no_distance_of_all_pairs(spark):
    rng = random.Random(4)
    rows = [["".join(rng.choice("abé") for _ in range(rng.randrange(7))) for _ in "ab"] for _ in range(500)] + [["ab", "xxabyy"], ["xxabyy", "ab"], ["", "a"]]
    d = spark.createDataFrame(rows, "a string, b string").select("a", "b", postedit.distance(F.col("a"), F.col("b")).alias("far"))
    assert all(far == postedit.characters(a, b) for a, b, far in d.collect())
    assert "Contains(" in plan(postedit.analyzed(spark.createDataFrame([("a", "b")], "selected_text string, final_text string")).select("character_edit_distance"))
