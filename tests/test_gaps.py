"""Gaps within and across days, and that a key's rows are not ordered in one task."""

from datetime import datetime

from larkspur.operators import history


def test_gaps_by_day(spark, capsys):
    clocks = [("a", datetime(2024, 1, d, h)) for d, h in ((1, 1), (1, 4), (2, 3), (5, 0), (5, 2))] + [("b", datetime(2024, 1, 1)), ("c", None), ("c", datetime(2024, 1, 3)), (None, datetime(2024, 1, 3)), (None, datetime(2024, 1, 3, 1))]
    found = history.gaps(spark.createDataFrame(clocks, "k string, ts timestamp_ntz"), "k", "ts")
    assert {r.k: (r.runs, r.latest, r.max_gap_s) for r in found.collect()} == {
        "a": (5, datetime(2024, 1, 5, 2), 69 * 3600), "b": (1, datetime(2024, 1, 1), None), "c": (2, datetime(2024, 1, 3), None), None: (2, datetime(2024, 1, 3, 1), 3600),
    }
    found.explain()
    assert "_day" in capsys.readouterr().out
