"""What several operators of this package share: tables, the shared folder, joins by checked size."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cadentia.sources.stream import shared_dir, written, written_by  # noqa: F401

#: Word of a text: a maximal run of characters other than space and 0x09-0x0D.
WORD = r"[^\x20\x09-\x0D]+"
#: A side of a join is broadcast up to so many rows of a few numbers each; beyond, both sides are shuffled.
BROADCAST_ROWS = 1_000_000

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def small_or_plain(df: DataFrame, rows: int) -> DataFrame:
    """``df`` marked for broadcast if it has few rows; Spark shuffles it otherwise."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def in_fold(doc_id: Column, folds: int, fold: int) -> Column:
    """Whether crc32 of the id's decimal text leaves ``fold`` when divided by ``folds``; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))


def text_slices(batches: Iterable[pa.RecordBatch], column: str, most_bytes: int = 1 << 18) -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    """Cut batches into slices of about ``most_bytes`` of text, so that work arrays stay small. A longer text is a slice of its own."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        start, held = 0, 0
        for i, size in enumerate([*sizes, most_bytes + 1]):
            if i > start and held + size > most_bytes:
                part = batch.slice(start, i - start)
                yield part, part.column(column).to_pylist()
                start, held = i, 0
            held += size
