"""Stored tables: a folder of Parquet tables, facts partitioned by UTC day."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions.scalars import day_text
from ..ranges import DateRange
from ..schemas import SCHEMAS, conform, empty

# Time column of the tables partitioned by day.
DAY_OF = {"session": "ts", "message": "ts", "model_call": "ts", "tool_call": "start_ts", "tool_call_event": "ts",
          "session_context": "ts", "desktop_log_event": "ts", "worktree_event": "ts", "automation_event": "ts"}

# Tables with one row per day; a day is a partition and is written anew as a whole.
ROLLUPS = ("daily_activity", "worktree_daily", "automation_daily")


def _with_day(name: str) -> StructType:
    return StructType([*SCHEMAS[name].fields, StructField("day", StringType())])


class Tables:
    """Reads and writes the library's tables below a folder.

    Fact tables and the ledger only grow. Small tables that change in place are written as a
    new version beside the old one; readers take the newest.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, name: str) -> str:
        if name not in SCHEMAS:
            raise KeyError(name)
        return f"{self.root}/{name}"

    def _folder(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self._path(name))
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return (fs, path) if fs.exists(path) else (fs, None)

    def exists(self, name: str) -> bool:
        """Whether the table was ever written."""
        return self._folder(name)[1] is not None

    def _versions(self, name: str) -> list[int]:
        fs, path = self._folder(name)
        names = [s.getPath().getName() for s in fs.listStatus(path)] if path else []
        marked = [n for n in names if n.startswith("version=")]
        done = [n for n in marked if fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self._path(name)}/{n}/_SUCCESS"))]
        return sorted(int(n.split("=")[1]) for n in done)

    def read(self, name: str, rng: DateRange | None = None, keep_day: bool = False) -> DataFrame:
        """A table, empty if it was never written. With a range, only its days are opened.

        With ``keep_day`` fact tables have their partition column ``day``; a report's own range
        then opens the days it needs (``DateRange.filter``).
        """
        if self._folder(name)[1] is None:
            rows = empty(self.spark, name)
            return rows.withColumn("day", F.lit(None).cast("string")) if keep_day and name in DAY_OF else rows
        if name in ROLLUPS:
            return self.spark.read.schema(_with_day(name)).parquet(self._path(name)).drop("day")
        if name not in DAY_OF:
            versions = self._versions(name)
            path = f"{self._path(name)}/version={versions[-1]}" if versions else self._path(name)
            return self.spark.read.schema(SCHEMAS[name]).parquet(path)
        df = self.spark.read.schema(_with_day(name)).parquet(self._path(name))
        if rng is not None:
            if rng.start is not None:
                df = df.filter(F.col("day") >= day_text(F.lit(rng.start)))
            if rng.end is not None:
                df = df.filter(F.col("day") <= day_text(F.lit(rng.end)))
            df = rng.filter(df, DAY_OF[name])
        return df if keep_day else df.drop("day")

    def append(self, name: str, rows: DataFrame) -> None:
        """Add rows. Days are spread over files evenly, a day with very many rows over several."""
        rows = conform(rows, name)
        if name not in DAY_OF:
            rows.write.mode("append").parquet(self._path(name))
            return
        dated = rows.withColumn("day", day_text(F.col(DAY_OF[name])))
        dated.hint("rebalance", "day").write.mode("append").partitionBy("day").parquet(self._path(name))

    def replace(self, name: str, rows: DataFrame) -> None:
        """Write a new version of a table."""
        versions = self._versions(name)
        version = versions[-1] + 1 if versions else 1
        conform(rows, name).write.mode("overwrite").parquet(f"{self._path(name)}/version={version}")

    def rewrite(self, name: str, rows: DataFrame) -> None:
        """Write the given days of a fact table anew; other days stay. ``rows`` must be materialised."""
        dated = conform(rows, name).withColumn("day", day_text(F.col(DAY_OF[name])))
        (dated.hint("rebalance", "day").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("day").parquet(self._path(name)))

    def write_days(self, name: str, rows: DataFrame) -> None:
        """Write the given days of a rollup table, new or anew; other days stay."""
        (conform(rows, name).withColumn("day", F.col("date")).coalesce(1).write.mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(self._path(name)))
