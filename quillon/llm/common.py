"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The named Parquet table of a data folder, by any path that Spark can read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` where the cluster
    names one, else a folder inside the warehouse (which Spark requires to be shared as well)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    return (named or spark.conf.get("spark.sql.warehouse.dir") + "/_shared").rstrip("/")


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet into the shared folder and read it back.

    The files outlive any executor, so a lost one costs only the running tasks."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quillon-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.materialized_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete materialized tables that nothing refers to any more; others are left alone."""
    for df in tables:
        if path := getattr(df, "materialized_at", None):
            spark = df.sparkSession
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def fold(id_col: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; null ids get null."""
    return F.crc32(id_col.cast("string").cast("binary")) % F.lit(parts)


def bounded_sample(ids: DataFrame, id_col: str, rows: int) -> DataFrame:
    """At most ``rows`` of the rows, those whose id has the smallest hash. A cut of the hash by the count
    leaves about twice as many before anything is sorted, whatever the size of the table."""
    ids = ids.withColumn("__h", F.pmod(F.xxhash64(id_col), F.lit(1 << 40)))
    most = min(1.0, 2 * rows / max(1, ids.count()))
    ids = ids.where(F.col("__h") <= int(most * (1 << 40)))
    return ids.orderBy("__h", id_col).limit(rows).drop("__h")


def field(df: DataFrame, name: str, alias: str | None = None) -> T.StructField:
    """The field of column ``name``, nullable, for the schema of a Python-backed step."""
    return T.StructField(alias or name, df.schema[name].dataType, True)


def as_bytes(column: pa.Array) -> Iterator[bytes | None]:
    """The values of a string column as UTF-8, one at a time."""
    wide = pa.types.is_large_string(column.type)
    for x in column.cast(pa.large_binary() if wide else pa.binary()):
        yield x.as_py()


def with_columns(
    df: DataFrame,
    text_col: str,
    new: list[tuple[str, T.DataType, pa.DataType]],
    compute: Callable[[Iterator[bytes | None]], list[list]],
) -> DataFrame:
    """``df`` with columns that ``compute`` makes from the texts of a batch (a list for each).

    A narrow step: rows keep their order and partition, other columns pass through as they are, but
    for those that have a name of the new ones, which are replaced."""
    df = df.drop(*(n for n, _, _ in new if n != text_col))
    at = df.columns.index(text_col)
    names = [*df.columns, *(n for n, _, _ in new)]

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = compute(as_bytes(b.column(at)))
            made = [pa.array(x, kind) for x, (_, _, kind) in zip(made, new, strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, *made], names=names)

    fields = [T.StructField(f.name, f.dataType, True) for f in df.schema.fields]
    fields += [T.StructField(n, kind, True) for n, kind, _ in new]
    return df.mapInArrow(step, T.StructType(fields))
