"""Helpers the operators of this package share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401  used as pa.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a text table are handed to Python functions in slices of about this many bytes.
SLICE_BYTES = 1 << 20


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared scratch folder, ``spark.checkpoint.dir``.

    Only a local session that names none gets a temporary folder of its own.
    """
    folder = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        folder = tempfile.mkdtemp(prefix="llm-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def stored(df: DataFrame) -> DataFrame:
    """Write a frame as Parquet to the shared folder and read it back.

    Later steps neither repeat the work nor depend on executors that hold shuffle files.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/llm-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


HELD = "held_columns"


def packed(docs: DataFrame, *read: str) -> DataFrame:
    """Only the columns an operator reads, and all others in one struct, so that no name clashes with what it adds."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in read]
    return docs.select(*read, F.struct(*rest, F.lit(0).alias("_")).alias(HELD))


def unpacked(done: DataFrame, docs: DataFrame, *read: str, **changed: Column) -> DataFrame:
    """The columns of ``docs`` back in order from what ``packed`` made of it, some of them computed anew."""
    return done.select(*[(changed[c] if c in changed else F.col(c) if c in read else F.col(HELD)[c]).alias(c) for c in docs.columns])


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def slices(batches: Iterable[pa.RecordBatch], text: str = "text") -> Iterator[pa.RecordBatch]:
    """Cut batches so that the texts of one take about SLICE_BYTES; a longer text stands alone."""
    for batch in batches:
        lengths = pa.compute.binary_length(batch.column(text).cast(pa.binary())).to_pylist()
        start = size = 0
        for i, n in enumerate(lengths):
            if size and size + (n or 0) > SLICE_BYTES:
                yield batch.slice(start, i - start)
                start, size = i, 0
            size += n or 0
        if start < len(lengths):
            yield batch.slice(start)


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 of each text; null counts as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


class Remembered:
    """A bounded map in two generations: what was not asked for since the last turn goes."""

    def __init__(self, limit: int):
        self.limit = limit
        self.young: dict = {}
        self.old: dict = {}

    def missing(self, keys: set) -> list:
        """Keys to be added; the others are all in ``young`` afterwards."""
        if len(self.young) > self.limit:
            self.young, self.old = {}, self.young
        fresh = keys.difference(self.young)
        known = fresh.intersection(self.old) if self.old else set()
        self.young.update((k, self.old[k]) for k in known)
        return list(fresh.difference(known))
