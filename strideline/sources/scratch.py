"""Tables that a plan writes on its way, in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import contextlib
import uuid

from pyspark.sql import DataFrame, SparkSession

_swept: set[str] = set()


def new_folder(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir (unset, as in tests: below the warehouse). All go when the driver's Python ends."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    top = f"{base.rstrip('/')}/_runs/{spark.sparkContext.applicationId}"
    if top not in _swept:
        _swept.add(top)
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(top)
        conf = spark.sparkContext._jsc.hadoopConfiguration()

        def sweep() -> None:
            with contextlib.suppress(Exception):  # the JVM may have ended before
                path.getFileSystem(conf).delete(path, True)

        atexit.register(sweep)
    return f"{top}/{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table, read again: what several branches of a plan use is made once and outlives executors."""
    path = new_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
