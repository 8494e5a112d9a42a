"""Vectors as packed blocks: one row holds the ids and the matrix of many vectors, for work by numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vector: Column) -> Column:
    """Not null, without null components, all finite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    return vector.isNotNull() & F.coalesce(~bad, F.lit(False))


def packed(rows: DataFrame, extra: list[str]) -> DataFrame:
    """One row for each partition of ``rows`` (vec_id, vector array<double> and ``extra`` numbers), in its order.

    Returns block (the partition's number), n, dim, ids, matrix (float64, short vectors filled with zeros)
    and one binary column of float64 for each extra. Partitions must be of bounded size.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = [b for b in batches if b.num_rows]
        if not kept:
            return
        t = pa.Table.from_batches(kept).combine_chunks()
        lists = t["vector"].combine_chunks()
        lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
        sizes = np.diff(lists.offsets.to_numpy())
        flat = lists.flatten().to_numpy(zero_copy_only=False)
        dim = int(sizes.max())
        matrix = np.zeros((t.num_rows, dim))
        matrix[np.repeat(np.arange(t.num_rows), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
        ids = t["vec_id"].to_numpy().astype("<i8")
        yield pa.RecordBatch.from_arrays(
            [pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([t.num_rows], pa.int32()), pa.array([dim], pa.int32()), pa.array([ids.tobytes()], pa.binary()), pa.array([matrix.tobytes()], pa.binary())]
            + [pa.array([t[c].to_numpy().astype("<f8").tobytes()], pa.binary()) for c in extra],
            names=["block", "n", "dim", "ids", "matrix", *extra],
        )

    return rows.select("vec_id", "vector", *extra).mapInArrow(run, "block int, n int, dim int, ids binary, matrix binary" + "".join(f", {c} binary" for c in extra))


def unpacked(row: dict, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and matrix of a packed row, with at least ``dim`` columns."""
    m = np.frombuffer(row["matrix"], "<f8").reshape(row["n"], row["dim"])
    if row["dim"] < dim:
        m = np.pad(m, ((0, 0), (0, dim - row["dim"])))
    return np.frombuffer(row["ids"], "<i8"), m
