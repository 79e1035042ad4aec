"""Date ranges and pages given to the reports."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _ms(moment: datetime) -> int:
    return round(moment.timestamp() * 1000)


def _day(ms: int) -> str:
    """UTC day as the tables name it."""
    return (datetime(1970, 1, 1) + timedelta(milliseconds=ms)).strftime("%Y-%m-%d")


def parse_instant(value, tz: str = "UTC") -> int | None:
    """Milliseconds from a number, a text of digits, or ISO text; None if it is none of them.

    A date alone is UTC midnight; a date and time without offset is in ``tz``.
    """
    if value is None or isinstance(value, bool):
        return None
    if isinstance(value, (int, float)):
        return int(value)
    text = str(value).strip()
    if not text:
        return None
    if text.isascii() and text.isdigit():
        return int(text)
    try:
        moment = datetime.fromisoformat(text)
    except ValueError:
        return None
    if moment.tzinfo is None:
        moment = moment.replace(tzinfo=timezone.utc if len(text) <= 10 else ZoneInfo(tz))
    return _ms(moment)


@dataclass(frozen=True)
class DateRange:
    """An inclusive range of epoch milliseconds; a missing bound is open."""

    start: int | None = None
    end: int | None = None

    @classmethod
    def parse(cls, start=None, end=None, tz: str = "UTC") -> tuple["DateRange", list[str]]:
        """Read both bounds, swap them when reversed, and list what could not be read."""
        errors, bounds = [], []
        for name, raw in (("start", start), ("end", end)):
            given = raw is not None and raw != ""
            value = parse_instant(raw, tz) if given else None
            if given and value is None:
                errors.append(f"Invalid {name} date: {raw}")
            bounds.append(value)
        low, high = bounds
        if low is not None and high is not None and low > high:
            low, high = high, low
        return cls(low, high), errors

    @classmethod
    def last_days(cls, now: datetime, tz: str = "UTC", days: int = 30) -> "DateRange":
        """The ``days`` calendar days that end with the day of ``now`` in ``tz``."""
        zone = ZoneInfo(tz)
        today = now.astimezone(zone).replace(hour=0, minute=0, second=0, microsecond=0)
        first = (today - timedelta(days=days - 1)).replace(tzinfo=zone)
        last = today.replace(hour=23, minute=59, second=59, microsecond=999000, tzinfo=zone)
        return cls(_ms(first), _ms(last))

    @classmethod
    def of_day(cls, day: str, tz: str = "UTC") -> "DateRange":
        """A calendar day (``YYYY-MM-DD``) of a zone."""
        first = datetime.fromisoformat(day)
        bound = lambda moment: _ms(moment.replace(tzinfo=ZoneInfo(tz)))
        return cls(bound(first), bound(first + timedelta(days=1)) - 1)

    def overlaps(self, other: "DateRange") -> bool:
        """Whether the two have a millisecond in common."""
        reaches = lambda start, end: start is None or end is None or start <= end
        return reaches(self.start, other.end) and reaches(other.start, self.end)

    def or_default(self, now: datetime, tz: str = "UTC") -> "DateRange":
        """This range when both bounds are known, else the last 30 days."""
        return self if self.bounded else DateRange.last_days(now, tz)

    @property
    def bounded(self) -> bool:
        return self.start is not None and self.end is not None

    def contains(self, ts: Column) -> Column:
        """The predicate itself, for conditional aggregates."""
        test = F.lit(True)
        if self.start is not None:
            test = test & (ts >= F.lit(self.start))
        if self.end is not None:
            test = test & (ts <= F.lit(self.end))
        return test

    def filter(self, df: DataFrame, ts: str = "ts") -> DataFrame:
        """Keep rows in range; both comparisons reach the Parquet scan.

        Where the frame has the tables' partition column ``day`` (UTC), other days are not opened.
        """
        dated = "day" in df.columns and ts in ("ts", "start_ts")
        for bound, low in ((self.start, True), (self.end, False)):
            if bound is None:
                continue
            at, day = F.col(ts), F.lit(bound)
            df = df.filter(at >= day if low else at <= day)
            if dated:
                text = _day(bound)
                df = df.filter(F.col("day") >= text if low else F.col("day") <= text)
        return df

    def previous(self) -> "DateRange | None":
        """The range of equal length which ends one millisecond before this one."""
        if not self.bounded or self.end <= self.start:
            return None
        return DateRange(self.start - 1 - (self.end - self.start), self.start - 1)

    def previous_year(self, tz: str = "UTC") -> "DateRange":
        """The same dates a calendar year earlier; 29 February becomes 1 March."""
        zone = ZoneInfo(tz)

        def back(value):
            if value is None:
                return None
            local = datetime.fromtimestamp(value // 1000, zone)
            try:
                moved = local.replace(year=local.year - 1)
            except ValueError:
                moved = local.replace(year=local.year - 1, month=3, day=1)
            return _ms(moved) + value % 1000

        return DateRange(back(self.start), back(self.end))


@dataclass(frozen=True)
class Page:
    """Limit and offset of a page; a limit below 1 becomes 50, an offset below 0 becomes 0."""

    limit: int = 50
    offset: int = 0

    def __post_init__(self):
        object.__setattr__(self, "limit", 50 if self.limit < 1 else self.limit)
        object.__setattr__(self, "offset", max(0, self.offset))

    @classmethod
    def number(cls, page: int, limit: int = 50) -> "Page":
        """The page with a 1-based number."""
        size = cls(limit).limit
        return cls(size, max(0, (page - 1) * size))
