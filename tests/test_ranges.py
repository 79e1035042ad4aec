"""Date ranges and pages."""

from __future__ import annotations

from datetime import datetime, timezone

import pytest

from sessionmeter import DateRange, Page
from sessionmeter.ranges import parse_instant

UTC = timezone.utc
ms = lambda *a: int(datetime(*a, tzinfo=UTC).timestamp() * 1000)


@pytest.mark.parametrize("value, want", [
    ("1700000000000", 1700000000000), (" 12 ", 12), (5, 5), ("2025-01-02", ms(2025, 1, 2)), ("", None), ("soon", None),
    ("2025-01-02T03:04:05Z", ms(2025, 1, 2, 3, 4, 5)), ("2025-01-02T03:00:00+02:00", ms(2025, 1, 2, 1)), (None, None)])
def test_instants(value, want):
    assert parse_instant(value) == want


def test_parse_swaps_and_reports():
    assert DateRange.parse(20, 10) == (DateRange(10, 20), [])
    rng, errors = DateRange.parse("never", 10)
    assert rng == DateRange(None, 10) and errors == ["Invalid start date: never"]
    assert DateRange.parse() == (DateRange(), [])


def test_previous_period():
    assert DateRange(1000, 1500).previous() == DateRange(499, 999)
    assert DateRange(1000, None).previous() is None and DateRange(5, 5).previous() is None


def test_previous_year_leap_day():
    rng = DateRange(ms(2024, 2, 29, 12), ms(2024, 12, 31)).previous_year()
    assert rng == DateRange(ms(2023, 3, 1, 12), ms(2023, 12, 31))


def test_last_days():
    now = datetime(2025, 3, 31, 10, tzinfo=UTC)
    assert DateRange.last_days(now) == DateRange(ms(2025, 3, 2), ms(2025, 4, 1) - 1)
    assert DateRange(5, None).or_default(now) == DateRange.last_days(now)
    assert DateRange(5, 6).or_default(now) == DateRange(5, 6)


def test_pages():
    assert (Page(0).limit, Page(9999).limit, Page(10, -4).offset) == (50, 9999, 0)
    assert Page.number(3, 20) == Page(20, 40)


def test_filter_reaches_the_scan(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(100).selectExpr("id as ts").write.parquet(path)
    df = DateRange(10, 20).filter(spark.read.parquet(path))
    assert df.count() == 11
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(ts,10)" in plan and "LessThanOrEqual(ts,20)" in plan


def test_a_day_of_a_zone_and_overlap():
    assert DateRange.of_day("2025-01-02") == DateRange(ms(2025, 1, 2), ms(2025, 1, 3) - 1)
    spring = DateRange.of_day("2025-03-30", "Europe/Berlin")  # 23 hours
    assert spring == DateRange(ms(2025, 3, 29, 23), ms(2025, 3, 30, 22) - 1)
    day = DateRange(10, 20)
    assert [day.overlaps(DateRange(*r)) for r in ((20, 30), (21, 30), (None, 10), (None, 9), (None, None), (12, 13))] == [
        True, False, True, False, True, True]
