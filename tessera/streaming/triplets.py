"""An extension: matrices of append streams of triplets (i, j, v, ts)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..core import SparseMatrix
from ..sources.build import combined


def windowed(stream: DataFrame, length: str, slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Sums by window and cell; rows later than ``late`` are dropped and windows closed by the watermark."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", length, slide), "i", "j").agg(F.sum("v").alias("v"))


def sessions(stream: DataFrame, gap: str, late: str = "1 hour") -> DataFrame:
    return stream.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("window"), "i", "j").agg(F.sum("v").alias("v"))


def merged(stream: DataFrame, read: Callable[[], SparseMatrix], write: Callable[[SparseMatrix], None]):
    """A writer that adds each batch to a stored matrix; ``write`` must replace it as a whole, so that a batch that is run again finds the old one."""

    def batch(delta: DataFrame, epoch: int) -> None:
        a = read()
        write(a.of(combined(a.entries.select("i", "j", "v").union(delta.select("i", "j", "v")), ["i", "j"], "+", None)))

    return stream.writeStream.foreachBatch(batch)
