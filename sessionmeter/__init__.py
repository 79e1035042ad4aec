"""Usage analytics over AI-agent session logs, as PySpark DataFrames."""

from .ranges import DateRange, Page
from .runtime import configure, new_session

__all__ = ["DateRange", "Page", "configure", "new_session"]
