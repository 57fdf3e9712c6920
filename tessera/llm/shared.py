"""Helpers that the training-data operators share."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a
    session in local mode without that setting (tests) gets a folder of its own."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    path = tempfile.mkdtemp(prefix="tessera-")
    spark.conf.set("spark.checkpoint.dir", path)
    return path


_CLEANUP_KEY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """Write a table to the shared folder and read it: the lineage ends there, and
    lost executors cost nothing that was already written. What the write shuffled goes at
    its end, and not when the driver happens to collect its garbage."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(partition_by)
    written(path)
    before = spark.conf.get(_CLEANUP_KEY, None)
    spark.conf.set(_CLEANUP_KEY, "true")
    try:
        writer.parquet(path)
    finally:
        spark.conf.unset(_CLEANUP_KEY) if before is None else spark.conf.set(_CLEANUP_KEY, before)
    return spark.read.schema(df.schema).parquet(path)


_scratch: ContextVar[list[str] | None] = ContextVar("scratch", default=None)


def written(path: str) -> None:
    """Note a table for the scratch() block around, if there is one."""
    if (tables := _scratch.get()) is not None:
        tables.append(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[list[str]]:
    """Tables that materialize() writes in this block are deleted at its end, whole or failed, but
    for those taken out of the list it gives. What is made of them must be written by then."""
    token = _scratch.set([])
    tables = _scratch.get()
    try:
        yield tables
    finally:
        _scratch.reset(token)
        for path in tables:
            remove(spark, path)


def remove(spark: SparkSession, path: str) -> None:
    context = spark.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def from_files(df: DataFrame) -> bool:
    """Whether rows have a place in files that are there to be read again."""
    try:
        return bool(df.select("_metadata.file_path", "_metadata.row_index").columns)
    except AnalysisException:
        return False


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(c, UPPER, LOWER)


def extended(schema: StructType, more: str) -> StructType:
    """A schema with the columns of a DDL string behind its own."""
    return StructType([*schema.fields, *StructType.fromDDL(more).fields])


def fold(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text; remainders of it make the fixed folds."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary"))


#: Bytes of an Arrow batch: with two tasks and both directions, some ten of them at once.
BATCH_BYTES = 4 << 20
_BATCH_KEY = "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded_batches(spark: SparkSession) -> None:
    """Long texts: Arrow batches end at BATCH_BYTES, not only at 10,000 rows. The setting is
    read when a plan runs, so it can't be put back; one that the caller made stands."""
    if _BATCH_KEY not in spark.conf.getAll:
        spark.conf.set(_BATCH_KEY, str(BATCH_BYTES))


_kept: dict[str, object] = {}


def kept(name: str, build: Callable[[], object]) -> object:
    """The one object (automaton, tokenizer, tables) that a Python worker holds on to between
    tasks. Workers outlive their tasks, so another name's object goes first."""
    if name not in _kept:
        _kept.clear()
        trim()
        _kept[name] = build()
    return _kept[name]


try:
    _trim = ctypes.CDLL(None).malloc_trim
except (AttributeError, OSError):  # another C library
    _trim = None


def trim() -> None:
    """Give freed memory back to the system; a worker would keep its highest level."""
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for mapInArrow, with freed memory given back after each batch."""

    def trimmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in run(batches):
            yield batch
            del batch
            trim()

    return trimmed


def beside(docs: DataFrame, names: list[str], work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``work`` of ``docs``, with the columns of ``docs`` and no others; columns of ``docs``
    that have one of ``names``, which ``work`` sets, are put aside meanwhile."""
    own = {c: f"_own_{i}_{c}" for i, c in enumerate(docs.columns) if c in names}
    return work(docs.withColumnsRenamed(own)).select(*[F.col(f"`{own.get(c, c)}`").alias(c) for c in docs.columns])
