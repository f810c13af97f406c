"""The splits cover every day of the events, however long the history."""

import pytest

from dockwatch.sources import fixtures as fx


@pytest.mark.parametrize("days, want", [
    (30, [("2024-01-01", "2024-01-20"), ("2024-01-21", "2024-01-25"), ("2024-01-26", "2024-01-30")]),
    (60, [("2024-01-01", "2024-02-09"), ("2024-02-10", "2024-02-19"), ("2024-02-20", "2024-02-29")])])
def test_splits_follow_the_table(spark, tmp_path, days, want):
    spark.sql(f"SELECT timestamp_ntz'2024-01-01 00:09:00' + make_dt_interval(id) AS ts FROM range({days})"
              ).write.parquet(f"{tmp_path}/events.parquet")
    assert list(fx.split_days(spark, str(tmp_path)).values()) == want
