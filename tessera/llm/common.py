"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = "[^\\x20\\x09-\\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(name: str, columns: list[str]) -> str:
    """A column name like `name` that `columns` don't hold."""
    held = {c.lower() for c in columns}
    while name.lower() in held:
        name += "_"
    return name


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column, null as empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


def pieces(batch: pa.RecordBatch, column: str, limit: int = 16 << 20):
    """Slices of a batch whose `column` holds about `limit` bytes each, so that work arrays stay bounded."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    if sizes.sum() <= limit:
        yield batch
        return
    group, first = np.cumsum(sizes) // limit, 0
    for end in [*(np.flatnonzero(np.diff(group)) + 1).tolist(), len(sizes)]:
        yield batch.slice(first, end - first)
        first = end


def joined(texts: list[bytes], gap: bytes = b"\n") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All texts in one byte array, each ended by `gap`; starts and lengths of the texts in it."""
    lens = np.array([len(t) for t in texts], dtype=np.int64)
    buf = np.frombuffer(gap.join(texts) + gap, np.uint8)
    starts = np.concatenate([[0], np.cumsum(lens + len(gap))[:-1]]).astype(np.int64) if len(texts) else np.zeros(0, np.int64)
    return buf, starts, lens


def nth_largest(df: DataFrame, key: str, n: int, digits: int = 16) -> int | None:
    """The `n`th largest value (from 1) of a non-negative long column, null where there are fewer rows.

    Radix selection: four counts of at most 65,536 digits each, so neither a sort
    of all rows nor an unbounded buffer is needed.
    """
    if n <= 0:
        return None
    prefix, left = 0, n
    for shift in (48, 32, 16, 0):
        part = df if shift == 48 else df.filter(F.shiftright(key, shift + digits) == prefix)
        counts = part.groupBy(F.shiftright(key, shift).bitwiseAND((1 << digits) - 1).alias("digit")).count().orderBy(F.desc("digit")).collect()
        for r in counts:
            if left <= r["count"]:
                prefix = (prefix << digits) | r["digit"]
                break
            left -= r["count"]
        else:
            return None
    return prefix
