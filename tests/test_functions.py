"""Post-edit metrics, readability, conversions, appointments, quantiles and local times on known cases."""
import random

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from revisio.functions import postedit, readability
from revisio.operators import appointments, fields, retries
from revisio.sources import convert
from revisio.stats import described, named


def test_ter_counts_a_block_shift_once():
    cases = [("the red cat sat", "the red cat sat", 0), ("THE Red cat", "the red CAT", 0), ("d e f a b c", "a b c d e f", 1), ("a b c", "a x c", 1), ("", "a b", 2), ("a b c d", "x", 4), ("b a d c", "a b c d", 2)]
    assert [postedit.ter_edits(s, f) for s, f, _ in cases] == [w for _, _, w in cases]


def test_ter_is_never_above_the_edit_distance_and_at_least_the_unmatched_words():
    rng = random.Random(5)
    for _ in range(150):
        a, b = ([rng.choice("abcde") for _ in range(rng.randint(0, 9))] for _ in "ab")
        plain = int(postedit.grid(*(postedit.np.array([ord(c) for c in x], dtype=int) for x in (a, b)))[-1, -1])
        got = postedit.ter_edits(" ".join(a), " ".join(b))
        assert abs(len(a) - len(b)) <= got <= plain
        if sorted(a) == sorted(b) and a != b:
            assert got >= 1


def test_soft_costs_tell_insertions_from_deletions():
    assert postedit.soft_distance("a", "a b", insertion=2, deletion=3) == 2 and postedit.soft_distance("a b", "a", insertion=2, deletion=3) == 3
    assert postedit.soft_distance("Ab", "ab") == 0.5 and postedit.soft_distance("Ab", "ab", case_sensitive=False) == 0
    assert postedit.soft_distance("é", "é") == 0


def test_bundle(spark):
    rows = [("Café au lait!", "CAFE  au—lait"), ("a b", " "), (None, "x"), ("one two", "one two three"), ("naïve", "naive")]
    got = [r.asDict() for r in postedit.analyzed(spark.createDataFrame(rows, "selected_text string, final_text string")).collect()]
    assert [r["cosmetic"] for r in got] == [True, None, None, False, True]
    assert got[3]["ter_rate"] == pytest.approx(1 / 3) and got[3]["character_edit_distance"] == 6 and got[3]["estimated_characters_saved"] == 7 and got[3]["final_word_count"] == 3
    assert got[4]["character_edit_distance"] == 1 and got[1]["ter_rate"] is None


def test_readability(spark):
    d = spark.createDataFrame([("The cat sat. It was a beautiful day!",), ("",), (None,), ("...",)], "t string")
    got = [r.m for r in d.select(readability.measures(F.col("t")).alias("m")).collect()]
    assert got[1:] == [None, None, None] and got[0].dale_chall_readability_score is None
    assert (got[0].sentence_count, got[0].word_count, got[0].syllable_count, got[0].letter_count, got[0].polysyllable_count) == (2, 8, 10, 28 - 1, 1)
    assert got[0].flesch_kincaid_grade == pytest.approx(0.39 * 4 + 11.8 * 10 / 8 - 15.59)
    easy = F.array(*map(F.lit, ["the", "cat", "sat", "it", "was", "a", "day"]))
    assert d.limit(1).select(readability.measures(F.col("t"), easy)["dale_chall_readability_score"]).first()[0] == pytest.approx(0.1579 * 12.5 + 0.0496 * 4 + 3.6365)


def test_conversion(spark):
    good = {"integer": ("1_000", 1000), "float": (" 1e3 ", 1000.0), "boolean": ("TRUE", True), "json_object": ('{"a": 1}', '{"a": 1}')}
    bad = {"integer": "1.5", "float": "nan", "boolean": "yes", "json_object": "[1]", "date": "2024-1-1", "datetime": "noon", "decimal": "x"}
    d = spark.createDataFrame([(1,)], "i int")
    for kind, (x, want) in good.items():
        assert d.select(convert.converted(F.lit(x), kind)).first()[0] == want
    for kind, x in bad.items():
        assert d.select(convert.converted(F.lit(x), kind, strict=False)).first()[0] is None
        with pytest.raises(Exception, match=kind):
            d.select(convert.converted(F.lit(x), kind)).collect()
    assert str(d.select(convert.converted(F.lit("2024-05-01T10:00:00+02:00"), "datetime")).first()[0]) == "2024-05-01 08:00:00"
    with pytest.raises(Exception, match="null"):
        convert.row(spark.createDataFrame([(None,)], "a string"), [("a", "string", False)]).collect()


def test_appointments(spark):
    raw = ["A:B:C", "A: B :C~|APPOINTMENT|~ ~|APPOINTMENT|~X", "A:B:C, D:E:F", "A, B:C:D", "Lab:Of:Law:School, bad", " ", None]
    d = spark.createDataFrame([(i, "s", x, None) for i, x in enumerate(raw)], "ID long, STUDY_NUM string, AUTHOR_APPOINTMENTS string, PI_APPOINTMENTS string")
    got = {(r.audit_record_id, r.appointment_index): (r.appointment_title, r.appointment_department, r.appointment_school) for r in appointments.appointments(d).collect()}
    assert got == {(0, 0): ("A", "B", "C"), (1, 0): ("A", "B", "C"), (2, 0): ("A", "B", "C"), (2, 1): ("D", "E", "F"), (3, 0): ("A, B", "C", "D"), (4, 0): ("Lab:Of", "Law", "School")}
    assert {(r.audit_record_id, r.appointment_index) for r in appointments.malformed(d).collect()} == {(1, 1), (4, 1)}


def test_quantiles_are_exact(spark):
    rng = random.Random(2)
    x = [rng.choice([-5.5, 0.0, 1e-9, rng.random(), rng.random() * 1e6]) for _ in range(300)]
    rows = [("a", v) for v in x] + [("b", 2.0), ("c", None), (None, 1.0), (None, 4.0)]
    got = {r.k: r for r in described(spark.createDataFrame(rows, "k string, v double"), ["k"], {"v": named("v", n="n", missing="missing")}).collect()}
    s = sorted(x)
    at = lambda p: s[int(p * 299)] + (s[min(299, int(p * 299) + 1)] - s[int(p * 299)]) * (p * 299 % 1)
    assert [got["a"][c] for c in ("percentile_25_v", "median_v", "percentile_75_v", "percentile_90_v")] == pytest.approx([at(p) for p in (0.25, 0.5, 0.75, 0.9)])
    assert got["b"].median_v == 2.0 and got["b"].standard_deviation_v is None and (got["c"].n, got["c"].missing, got["c"].median_v) == (0, 1, None) and got[None].percentile_25_v == 1.75
    with pytest.raises(Exception, match="not finite"):
        described(spark.createDataFrame([("a", float("inf"))], "k string, v double"), ["k"], {"v": named("v")}).collect()


def test_local_times(spark):
    d = lambda t: spark.sql(f"SELECT TIMESTAMP '{t}' AS t").select(retries.local(F.col("t")).cast("string")).first()[0]
    tz = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    try:
        assert d("2026-07-01 12:00:00") == "2026-07-01 16:00:00" and d("2026-01-01 12:00:00") == "2026-01-01 17:00:00"
        for t in ("2026-11-01 01:30:00", "2026-03-08 02:30:00"):
            with pytest.raises(Exception, match="ambiguous or nonexistent"):
                d(t)
    finally:
        spark.conf.set("spark.sql.session.timeZone", tz)


PAYLOAD = ('{"title": ["T one", "T two"], "contact": {"email": "a@b.c", "name": "N"}, "topics": [1, 2], "compensation": {"genericCompensation": ["Pay"]}, "offersCompensation": true}',
           '{"title": ["T two"], "topics": [2]}', '{"title": "t TWO!", "purpose": "p", "description": "d", "contact": {"email": "a@b.c", "name": "M"}, "topics": [2, 3], "compensation": "cash", "offersCompensation": true}')


def record(spark, s=PAYLOAD[0], p=PAYLOAD[1], f=PAYLOAD[2]):
    return spark.createDataFrame([Row(ID=1, ATTEMPT_TYPE="AI", ATTEMPT_RESULT="COMPLETE", END_TIME="x", LLM_SUGGESTIONS=s, SELECTED_SUGGESTIONS=p, FINAL_SUBMISSION=f)],
                                 "ID long, ATTEMPT_TYPE string, ATTEMPT_RESULT string, END_TIME string, LLM_SUGGESTIONS string, SELECTED_SUGGESTIONS string, FINAL_SUBMISSION string")


def test_field_analysis(spark):
    got = {r.field_name: r for r in fields.analysis(record(spark)).collect()}
    assert len(got) == 12
    t = got["title"]
    assert (t.match_type, t.picked_kind, t.picked_index, t.suggestion_counts_json, t.policy_adjusted_effort_saved) == ("COSMETIC_EQUIVALENT", "title", 1, '{"title": 2}', 1.0)
    k = got["topics"]
    assert (k.match_type, k.lookup_similarity, k.kept_ids, k.dropped_ids, k.added_ids, k.saved_not_offered_ids) == ("EDITED", 0.5, "[2]", "[]", "[3]", "[3]")
    c = got["compensation"]
    assert (c.match_type, c.flag_accepted, c.compensation_text_required, c.suggestion_count_total) == ("UNASSISTED", True, True, 1) and t.selected_text is None


@pytest.mark.parametrize("part, old, new, message", [
    (0, '"topics"', '"tropics"', "not configured"), (0, "[1, 2]", '[1, "2"]', "wrong type"), (0, "[1, 2]", "[1, true]", "wrong type"), (0, '["Pay"]', '"Pay"', "wrong type"), (1, '["T two"]', '["T three"]', "not offered"), (1, '["T two"]', '["T two", "T one"]', "more than one"),
    (1, "[2]", "[9]", "not offered"), (2, '"purpose": "p"', '"purpose": " "', "blank"), (2, '"cash"', '""', "blank"), (2, ', "offersCompensation": true', "", "not saved"), (0, '"name": "N"', '"nom": "N"', "not configured")])
def test_field_analysis_refuses(spark, part, old, new, message):
    p = list(PAYLOAD)
    assert old in p[part]
    p[part] = p[part].replace(old, new)
    with pytest.raises(Exception, match=message):
        fields.analysis(record(spark, *p)).collect()
