import pytest

from marginalia.operators.records import quarantine, reassociate

ROWS = "policy string, version string, heading_path string, text string"


def test_quarantine(spark):
    rows = spark.createDataFrame([("p", "1.0", "h", "t"), (None, "1.0", "h", "t"), ("p", "1.0", "h", "  ")], ROWS)
    good, bad = quarantine(rows)
    assert good.count() == 1 and sorted(r.problem for r in bad.collect()) == ["blank field: text", "missing field: policy"]
    with pytest.raises(ValueError):
        quarantine(rows, strict=True)


def test_duplicate_texts_are_used_up_in_order(spark):
    items = spark.createDataFrame([(0, i, i, t) for i, t in enumerate("abac")], "query_id int, id int, pos int, text string")
    returned = spark.createDataFrame([(0, o, t) for o, t in enumerate("caxa")], "query_id int, ord int, text string")
    assert [r.id for r in reassociate(items, returned).orderBy("place").collect()] == [3, 0, 2, 1]
