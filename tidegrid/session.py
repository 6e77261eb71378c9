"""Session settings and the shared folder for written intermediate tables."""

from __future__ import annotations

import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Bytes of a row group of written tables: what each task buffers while it writes one.
ROW_GROUP = 16 << 20


def session(app: str = "tidegrid", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC times and adaptive execution; ``conf`` keys use ``__`` for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or a new one in local mode."""
    place = spark.conf.get("spark.checkpoint.dir", None)
    if place is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        place = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", place)
    return place.rstrip("/")


def written(df: DataFrame, name: str, free: bool = True) -> DataFrame:
    """Write ``df`` to the shared folder as Parquet and read it again: lineage ends here.

    A lost executor costs its running tasks only, and both the size and the
    statistics of the table are known to later joins. The shuffle files that it
    took are needed no more; Spark deletes them when the driver collects its
    garbage, so that is asked for at once instead of whenever its heap is full
    (``free``; not worth it for small tables).
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tidegrid-{name}-{uuid.uuid4().hex}"
    df.write.option("parquet.block.size", ROW_GROUP).parquet(path)
    for _ in range(2 * free):  # the first pass frees what holds the others
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.1)
    return spark.read.schema(df.schema).parquet(path)
