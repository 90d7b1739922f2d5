"""Small helpers shared by the operators of this package."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from demandloom.session import fresh_path, settle

__all__ = ["fresh_path", "ids_column", "release", "rows_of", "saved", "settle", "table", "take_memory"]

_MEMOS: dict[str, Callable[[], None]] = {}


def take_memory(owner: str, clear: Callable[[], None]) -> None:
    """Called at the start of a task: empties what other operators still remember in this Python worker.

    Workers are reused, and Arrow's pool keeps what earlier tasks freed; it is given back as well.
    """
    for name, forget in list(_MEMOS.items()):
        if name != owner:
            forget()
            del _MEMOS[name]
    _MEMOS[owner] = clear
    release()


def release() -> None:
    import pyarrow as pa

    pa.default_memory_pool().release_unused()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def saved(df: DataFrame, label: str) -> DataFrame:
    """Write rows with large payloads to the shared folder (compressed) and read them back."""
    path = fresh_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ids_column(parts: list[bytes]):
    """Little-endian int32 ids of each row as an Arrow list column."""
    import pyarrow as pa

    values = np.frombuffer(b"".join(parts), dtype="<i4")
    offsets = np.zeros(len(parts) + 1, dtype=np.int32)
    np.cumsum([len(p) // 4 for p in parts], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))


def rows_of(batch, most: int):
    """An Arrow batch in slices of at most ``most`` rows, so that results of one slice stay small."""
    for at in range(0, batch.num_rows, most):
        yield batch.slice(at, most)
    release()
