"""Streaming forms: windowed signatures, idempotent transaction logs, keyed state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigmafold.functions.fields import PrimeField
from sigmafold.operators import laws
from sigmafold.operators.tables import Versions, check_contiguous
from sigmafold.runtime import materialise


def windowed(df: DataFrame, ts: str, keys: list[str], e: Column, field: PrimeField, offset: int, length: str, slide: str | None = None, late: str | None = None) -> DataFrame:
    """Additive and multiset signatures per time window; the same code serves batches and streams."""
    rows = df.withWatermark(ts, late) if late else df
    f = laws.factor(field, e, offset)
    span = F.window(ts, length, slide) if slide else F.window(ts, length)
    return rows.groupBy(span.alias("w"), *keys).agg(
        laws.additive(field, e).alias("state"), laws.multiset_product(field, f).alias("product"), laws.multiset_zeros(f).alias("zeros"), F.count(F.lit(1)).alias("n")
    ).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "state", "product", "zeros", "n")


def sessions(df: DataFrame, ts: str, keys: list[str], e: Column, field: PrimeField, gap: str, late: str | None = None) -> DataFrame:
    """Additive signatures per session: rows of a key with no gap of ``gap`` between them."""
    rows = df.withWatermark(ts, late) if late else df
    return rows.groupBy(F.session_window(ts, gap).alias("w"), *keys).agg(laws.additive(field, e).alias("state"), F.count(F.lit(1)).alias("n")).select(
        F.col("w.start").alias("start"), *keys, "state", "n"
    )


class LogApplier:
    """foreachBatch target that applies a transaction log to a table kept by revision in a folder.

    Table and revision are committed together, so a query that starts again goes on where the folder
    is.  A gap to what was applied fails the batch, and so do two entries of one revision that differ;
    entries that were applied before are passed over, so a batch that is delivered again changes nothing.
    """

    def __init__(self, table: DataFrame, path: str, apply: Callable[[DataFrame, DataFrame], DataFrame], revision: str = "revision"):
        self.versions, self.apply, self.revision = Versions(table.sparkSession, path), apply, revision
        if self.versions.revision is None:
            self.versions.commit(0, {"table": table})

    @property
    def applied(self) -> int:
        return self.versions.revision

    @property
    def table(self) -> DataFrame:
        return self.versions.table("table")

    def __call__(self, batch: DataFrame, epoch: int) -> None:
        applied = self.applied
        new = materialise(batch.where(F.col(self.revision) > applied).distinct(), "batch")
        low, high = new.agg(F.min(self.revision), F.max(self.revision)).first()
        if low is None:
            return
        if low != applied + 1:
            raise ValueError(f"revision {low} follows {applied}")
        check_contiguous(new, self.revision)
        self.versions.commit(high, {"table": self.apply(self.versions.table("table", applied), new)})
