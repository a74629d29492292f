"""Small helpers shared by the operators: the library's scratch tables and components, names, Arrow batches."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from ..operators.components import components
from ..sources.scratch import passing, scratch_dir, stored

__all__ = ["components", "documents", "free_names", "passing", "scratch_dir", "slices", "stored"]


def free_names(columns: Iterable[str], *wanted: str) -> list[str]:
    """The wanted names, each with as many underscores as set it apart from columns (case does not count)."""
    taken, out = {c.lower() for c in columns}, []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        out.append(name)
        taken.add(name.lower())
    return out


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = 1 << 19) -> Iterator[pa.RecordBatch]:
    """Cut batches so that a piece holds about limit bytes of the column, or one longer row."""
    for batch in batches:
        n = batch.num_rows
        sizes = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
        at = total = 0
        for i in range(n):
            total += int(sizes[i])
            if total >= limit:
                yield batch.slice(at, i + 1 - at)
                at, total = i + 1, 0
        if at < n:
            yield batch.slice(at, n - at)
