from datetime import datetime

from claimloom.plans import flows


def test_last_window_is_there(spark, rows, tmp_path):
    events = [(datetime(2024, 1, d, 23, 59), t, float(d)) for d in (1, 2, 3) for t in ("click", "view")] + [(datetime(2024, 1, 3, 1), "view", 0.5), (None, "view", 9.0)]
    spark.createDataFrame(events, "ts timestamp, event_type string, value double").write.parquet(str(tmp_path / "events.parquet"))
    want = [(datetime(2024, 1, d), t, 1, float(d)) for d in (1, 2, 3) for t in ("click", "view") if (d, t) != (3, "view")] + [(datetime(2024, 1, 3), "view", 2, 3.5)]
    assert rows(flows.QUERIES["stream_windows"](spark, str(tmp_path))) == sorted(want, key=repr)
