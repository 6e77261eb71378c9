"""Results as typed bundles: one Parquet folder for each kind, with a declared schema, by record or family."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: What each kind of bundle holds, and what its folders are named by.
KINDS = {
    "quality": ("record_id BIGINT, n BIGINT, valid DOUBLE, first_bad BIGINT, usable INT", None),
    "features": ("record_id BIGINT, segment BIGINT, metric STRING, value DOUBLE, family STRING", "family"),
}


def write(df: DataFrame, root: str, kind: str) -> None:
    """Write ``df`` as a bundle; a column that is missing is an error, others are left out, types are those declared."""
    schema, by = KINDS[kind]
    fields = StructType.fromDDL(schema).fields
    missing = [f.name for f in fields if f.name not in df.columns]
    if missing:
        raise ValueError(f"a bundle of {kind} needs {', '.join(missing)}")
    out = df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in fields]).write.mode("overwrite")
    (out.partitionBy(by) if by else out).parquet(f"{root}/{kind}")


def read(spark: SparkSession, root: str, kind: str) -> DataFrame:
    """A bundle with its declared schema; what is filtered by the folders' name prunes them."""
    return spark.read.schema(KINDS[kind][0]).parquet(f"{root}/{kind}")
