"""Tables that change as a whole: a new version is staged, checked as it was written, and then becomes the current one, or nothing changes.

A folder holds versions and one small file with the name of the current one. Writers write a version of their own; the name is
written to a file beside and moved over the old one, which file systems do in one step. Readers that have begun go on with their version. A
writer that dies, or whose rows do not pass, leaves a version that nobody reads.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

CURRENT = "_current"


def _file_system(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs
    return hadoop, hadoop.FileContext.getFileContext(hadoop.Path(path).toUri(), spark._jsc.hadoopConfiguration())


def current_version(spark: SparkSession, root: str) -> str | None:
    """The name of the version that readers get, or None before the first."""
    hadoop, files = _file_system(spark, root)
    path = hadoop.Path(f"{root}/{CURRENT}")
    if not files.util().exists(path):
        return None
    stream = files.open(path)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def staged(spark: SparkSession, rows: DataFrame, root: str) -> str:
    """Write rows as a version that nobody reads yet; its name."""
    name = uuid.uuid4().hex
    rows.write.parquet(f"{root}/{name}")
    return name


def make_current(spark: SparkSession, root: str, name: str) -> None:
    hadoop, files = _file_system(spark, root)
    beside, target = hadoop.Path(f"{root}/{CURRENT}-{name}"), hadoop.Path(f"{root}/{CURRENT}")
    flags = spark._jvm.java.util.EnumSet.of(hadoop.CreateFlag.CREATE, hadoop.CreateFlag.OVERWRITE)
    out = files.create(beside, flags, spark.sparkContext._gateway.new_array(hadoop.Options.CreateOpts, 0))
    out.write(name.encode())
    out.close()
    overwrite = spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 1)
    overwrite[0] = hadoop.Options.Rename.OVERWRITE
    files.rename(beside, target, overwrite)


def publish(rows: DataFrame, root: str, errors: Callable[[DataFrame], DataFrame] | None = None) -> str:
    """Make rows the current version of the table in ``root``; its name.

    ``errors`` gives what is wrong with the rows, read as they were written; with any, ValueError is raised and the current version stays.
    """
    spark = rows.sparkSession
    name = staged(spark, rows, root)
    if errors is not None and (bad := errors(spark.read.schema(rows.schema).parquet(f"{root}/{name}")).first()) is not None:
        raise ValueError(f"not published: {bad.asDict()}")
    make_current(spark, root, name)
    return name


def published(spark: SparkSession, root: str) -> DataFrame:
    """The rows of the current version."""
    name = current_version(spark, root)
    if name is None:
        raise ValueError(f"nothing is published in {root}")
    return spark.read.parquet(f"{root}/{name}")
