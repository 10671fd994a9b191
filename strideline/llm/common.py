"""Helpers that the document operators share: shared-folder tables, Arrow text access, list-free chunking."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word rules: space and the control characters 9 to 13.
WHITE = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, else one beside the warehouse (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"
    return f"{base.rstrip('/')}/{spark.sparkContext.applicationId}"


_swept: set[str] = set()


def _at_exit(spark: SparkSession, folder: str) -> None:
    """Once the driver's Python ends, nothing reads the written tables any more."""
    if folder not in _swept:
        _swept.add(folder)
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        conf = spark.sparkContext._jsc.hadoopConfiguration()

        def sweep() -> None:
            with contextlib.suppress(Exception):  # the JVM may have ended before
                path.getFileSystem(conf).delete(path, True)

        atexit.register(sweep)


def written(df: DataFrame, instead_of: DataFrame | None = None) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back: a cut of lineage that outlives executors.

    The tables are deleted when the driver ends; that of ``instead_of``, which nothing else reads, at once.
    """
    spark = df.sparkSession
    _at_exit(spark, shared_folder(spark))
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    if instead_of is not None:
        old = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(instead_of._written_to)
        old.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(old, True)
    return out


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def texts(docs: DataFrame, *columns: str, text: str = "text") -> DataFrame:
    """Only the named columns and the text (null: empty); other columns, whatever their names, stay outside."""
    return docs.select(*columns, F.coalesce(F.col(text).cast("string"), F.lit("")).alias(text))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, bytes]:
    """Offsets and the bytes of a string column (null: empty), without a Python string for each row."""
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    return at, data.to_pybytes() if data is not None and len(column) else b""


def chunks(at: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Row ranges whose texts have about ``most`` bytes together; one longer text is a range of its own."""
    first, rows = 0, len(at) - 1
    while first < rows:
        last = max(first + 1, int(np.searchsorted(at, at[first] + most, side="right")) - 1)
        yield first, last
        first = last


def table_rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


@contextlib.contextmanager
def small_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """Plans that run inside hand ``rows`` rows at a time to Python, where a row can be large."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def tidy(scan: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``scan``, after which the worker gives freed memory back: workers live on and serve later stages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from scan(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(AttributeError, OSError):  # only the GNU library has it
            ctypes.CDLL(None).malloc_trim(0)

    return run
