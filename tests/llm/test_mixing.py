import pytest

from revisio.llm.mixing import mix, targets


def test_capped_targets(spark):
    rows = targets(spark.createDataFrame([("a", 10), ("b", 50), (None, 40)], "source string, source_size long")).collect()
    # 150 in all: a stops at 20; the other 130 go 1 to 2, so null stops at 80 and b gets 50
    assert {r.source: r.target for r in rows} == pytest.approx({"a": 20, "b": 50, None: 80})


def test_nulls_and_empty(spark):
    schema = "doc_id long, source string, text string, size long"
    assert mix(spark.createDataFrame([], schema)).count() == 0
    rows = mix(spark.createDataFrame([(1, None, None, 7), (1, "a", " x\ty ", 7), (None, "a", "", 7)], schema)).collect()
    assert sorted(r.size for r in rows) == [0, 0, 2] and all(r.taken <= 2 * r.size for r in rows)


def test_null_and_repeated_ids_come_near_the_target(spark):
    rows = [(None, "a", f"t{i} " * 10) for i in range(400)] + [(7, "b", f"u{i} " * 10) for i in range(400)] + [(i, "c", "w " * 10) for i in range(400)]
    out = mix(spark.createDataFrame(rows, "doc_id long, source string, text string")).collect()
    for size, target in {(r.source_size, r.target) for r in out}:
        some = [r for r in out if r.target == target]
        assert abs(sum(r.taken for r in some) - target * len(some) / 400) < 0.1 * target * len(some) / 400
