"""Helpers shared by the corpus operators: work tables in the cluster's shared folder, fixed-size arrays merged from tasks."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.work import WorkTables, new_path, shared_dir, written

__all__ = ["WorkTables", "array_parts", "arrow", "fresh", "merged_array", "new_path", "numbered", "partitions", "repeated", "shared_dir", "written"]


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fresh(taken: Iterable[str], *wanted: str) -> list[str]:
    """The ``wanted`` names, each with as many underscores before it as it takes to differ from those ``taken``."""
    used, out = {t.lower() for t in taken}, []
    for name in wanted:
        while name.lower() in used:
            name = "_" + name
        used.add(name.lower())
        out.append(name)
    return out


def numbered(df: DataFrame) -> DataFrame:
    """``df`` with its columns named c0, c1, ..., so that no internal name can clash with one of them."""
    return df.toDF(*[f"c{k}" for k in range(len(df.columns))])


def repeated(df: DataFrame, n: str) -> DataFrame:
    """Each row as many times as its column ``n`` says, without that column; by 65 536 at a time, so that no row gets large."""
    step, column = 1 << 16, F.col(n)
    parts = df.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(column / step) - 1)))
    size = F.least(F.lit(step).cast("long"), column - F.col("_part") * step).cast("int")
    return parts.withColumn("_copy", F.explode(F.array_repeat(F.lit(0), size))).drop(n, "_part", "_copy")


def arrow(fn: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]]) -> Callable:
    """A mapInArrow function from one that handles a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield from fn(batch)

    return run


def merged_array(df: DataFrame, length: int, dtype: str, how: str, chunks: int = 64) -> np.ndarray:
    """One array of a fixed ``length`` out of the partial arrays that tasks have emitted.

    ``df`` has (chunk int, part binary): zlib-compressed pieces of ``length // chunks`` items of ``dtype``. They are
    merged by ``how`` ("sum" or "or") in two levels, so that no task gets the pieces of every other task at once. The
    driver receives ``length`` items, whatever the input's size.
    """
    n = length // chunks
    combine = np.add if how == "sum" else np.bitwise_or

    def merge(table: pa.Table) -> pa.Table:
        total = np.zeros(n, dtype)
        for part in table["part"]:
            combine(total, np.frombuffer(zlib.decompress(part.as_py()), dtype), out=total)
        return pa.table({"chunk": pa.array([table["chunk"][0].as_py()], pa.int32()), "slot": pa.array([0], pa.int32()), "part": pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())})

    schema = "chunk int, slot int, part binary"
    once = df.withColumn("slot", F.pmod(F.crc32("part"), F.lit(32)).cast("int")).select("chunk", "slot", "part").groupBy("chunk", "slot").applyInArrow(merge, schema)
    out = np.zeros(length, dtype)
    for row in once.groupBy("chunk").applyInArrow(merge, schema).toLocalIterator():
        out[row["chunk"] * n : (row["chunk"] + 1) * n] = np.frombuffer(zlib.decompress(bytes(row["part"])), dtype)
    return out


def array_parts(values: np.ndarray, chunks: int = 64) -> tuple[list[int], list[bytes]]:
    """The compressed pieces of a task's partial array, for :func:`merged_array`; empty pieces are left out."""
    n, ids, parts = len(values) // chunks, [], []
    for k in range(chunks):
        piece = values[k * n : (k + 1) * n]
        if piece.any():
            ids.append(k)
            parts.append(zlib.compress(piece.tobytes(), 1))
    return ids, parts
