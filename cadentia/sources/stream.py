"""Results in the folder that executors share: tables that several steps use, and streams run to their end."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_own: str | None = None

_IDLE = "spark.sql.streaming.noDataMicroBatches.enabled"


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset and there is one machine only, a folder of our own."""
    global _own
    if configured := spark.conf.get("spark.checkpoint.dir", None):
        return configured.rstrip("/")
    if not spark.conf.get("spark.master", "").startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    _own = _own or "file://" + tempfile.mkdtemp(prefix="cadentia-")
    return _own


def written(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it again, for results that several steps use."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def written_by(spark: SparkSession, df: DataFrame, name: str, key: str, buckets: int) -> Iterator[DataFrame]:
    """Like ``written``, in buckets by ``key``: within, grouping by it moves no row. After that the catalog forgets the table."""
    called = f"{name}_{uuid.uuid4().hex}"
    df.repartition(buckets, key).write.bucketBy(buckets, key).option("path", f"{shared_dir(spark)}/{called}").saveAsTable(called, format="parquet")
    try:
        yield spark.table(called)
    finally:
        spark.sql(f"drop table if exists {called}")


@contextmanager
def configured(spark: SparkSession, conf: dict[str, str]) -> Iterator[None]:
    """The session with other settings inside, and its own ones again after that."""
    before = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def table_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as a stream of its files. A table that is one file is picked out of its folder, since streams read folders."""
    batch = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    files = batch.inputFiles()
    stream = spark.readStream.schema(batch.schema)
    if len(files) == 1 and files[0].endswith(f"/{name}.parquet") and not files[0].endswith(f"/{name}.parquet/{name}.parquet"):
        return stream.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)
    return stream.parquet(f"{sf_dir}/{name}.parquet")


def files_in_turn(spark: SparkSession, parts: Iterable[DataFrame], name: str) -> DataFrame:
    """A stream that takes what each of ``parts`` holds, one after the other: written as files that are read one by one, in the order of their times.

    A last part with a row far in the future is an end mark: the watermark passes all rows before it, and timers for them run.
    """
    at = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    schema = None
    for part in parts:
        part.write.mode("append").parquet(at)
        schema = part.schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(at)


def drained(spark: SparkSession, stream: DataFrame, name: str) -> DataFrame:
    """Process what is there now and return all output rows."""
    at = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    stream.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/out")


def drained_in_turn(spark: SparkSession, parts: Iterable[DataFrame], live: Callable[[DataFrame], DataFrame], name: str, settled: bool = True) -> DataFrame:
    """All output rows of ``live``, a stream over what each of ``parts`` holds, one after the other.

    A part is one micro-batch, however many files it is written as: the stream goes on from its checkpoint after each. An end mark may be
    the last part (see ``files_in_turn``).

    settled: after each part an empty micro-batch with the part's watermark. Without it only after the last one: what a part's watermark lets go then goes out with
    the next part, which halves the micro-batches. That is for operators that tell late rows by their timers' watermark; Spark's own aggregates tell them by that of
    the micro-batch before.
    """
    at = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    schema = None
    parts = list(parts)
    for i, part in enumerate(parts):
        part.write.mode("append").parquet(f"{at}/in")
        with configured(spark, {} if settled or i == len(parts) - 1 else {_IDLE: "false"}):
            stream = live(spark.readStream.schema(part.schema).parquet(f"{at}/in"))
            schema = stream.schema
            stream.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(schema).parquet(f"{at}/out")
