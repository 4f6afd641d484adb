"""Positions that start anew in every source must not multiply rows."""

from __future__ import annotations

from gleaner.operators.gate import survivor_budget


def test_three_sources_with_equal_positions(spark):
    rows = [(pos, "listing", f"c{c}", f"http://x/{c}/{pos}", f"t{c}{pos}", "survivor", 90 - 10 * pos - c, 1.0)
            for c in range(3) for pos in range(2)]
    df = spark.createDataFrame(rows, "seq long, adapter string, source string, source_url string, title string, "
                                     "bucket string, triage_score int, wire_pre_score double")
    got = survivor_budget(df, 3).collect()
    assert len(got) == len(rows)
    assert sum(r["bucket"] == "survivor" for r in got) == 3
    assert sum(r["overflow"] for r in got) == 3
