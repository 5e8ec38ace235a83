"""Folding sorted ranges: shared by the operators that must see rows in order.

Rows are range partitioned on a composite of key and order (Spark samples the quantiles), so a
key with a third of all rows is spread over as many partitions as its rows need. Each partition
is then folded in one pass over Arrow batches; what crosses a partition's edge is stitched by
the caller from the first and last state of each partition.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from lodestream.session import shuffle_partitions


def ranged(df: DataFrame, key: Sequence[str], order: Sequence[str], partitions: int | None = None) -> DataFrame:
    """``df`` in ascending ranges of (key, order), sorted within each partition."""
    by = [*key, *order]
    return df.repartitionByRange(partitions or shuffle_partitions(df.sparkSession), *by).sortWithinPartitions(*by)


def starts(columns: Sequence[pa.Array], before: tuple | None) -> np.ndarray:
    """True where a row differs from the row before it in any column. Nulls equal nulls."""
    n = len(columns[0])
    out = np.zeros(n, dtype=bool)
    if not n:
        return out
    out[0] = before is None or any(c[0].as_py() != b for c, b in zip(columns, before, strict=True))
    for c in columns:
        a, b = c.slice(1), c.slice(0, n - 1)
        differs = pc.fill_null(pc.not_equal(a, b), False).to_numpy(zero_copy_only=False)
        if c.null_count:
            differs = differs | (a.is_null().to_numpy(zero_copy_only=False) != b.is_null().to_numpy(zero_copy_only=False))
        out[1:] |= differs
    return out


def flat(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
