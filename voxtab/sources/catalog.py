"""Tables of a session folder, saved uploads and result sinks."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxtab.functions.values import finite_or_null


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a local session without one gets its own."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if folder is None:
        if not sc.master.startswith("local"):
            raise ValueError("Set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="checkpoint-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(folder)
    return folder


def checkpoint(df: DataFrame) -> DataFrame:
    """Reliable checkpoint that keeps the partitions as they are; for narrow tables."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """The same rows read back from a table in the shared folder.

    Cuts the lineage and survives lost executors; readers get only the columns
    they use. The folder is scratch space and is the caller's to empty; zstd keeps
    staged texts well below their size under Spark's default codec.
    """
    folder = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def preview(df: DataFrame, order_col: str, n: int = 5) -> DataFrame:
    """First rows, with NaN and infinities as NULL."""
    cells = [
        finite_or_null(F.col(f"`{f.name}`")).alias(f.name)
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f"`{f.name}`")
        for f in df.schema.fields
    ]
    return df.orderBy(order_col).limit(n).select(*cells)


def table_shape(df: DataFrame) -> DataFrame:
    """One row: number of rows, number of columns, column names."""
    names = F.array(*[F.lit(c) for c in df.columns])
    return df.agg(F.count("*").alias("n_rows")).select(
        "n_rows", F.lit(len(df.columns)).cast("long").alias("n_columns"), names.alias("columns"))


def save_upload(df: DataFrame, folder: str, upload_id: str) -> None:
    """Put a table into the upload catalog, one folder per upload; a repeated save replaces the upload."""
    save_uploads(df.withColumn("upload_id", F.lit(upload_id)), folder, "upload_id")


def save_uploads(df: DataFrame, folder: str, id_col: str) -> None:
    """Put many uploads at once, told apart by a column.

    Of the catalog only the folders of uploads in ``df`` are replaced, after all of it
    has been written, so a job that is repeated or fails half way leaves one version of each.
    """
    df.withColumnRenamed(id_col, "upload_id").write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic").partitionBy("upload_id").parquet(folder)


def load_upload(spark: SparkSession, folder: str, upload_id: str) -> DataFrame:
    """One saved table; only its own folder is read."""
    return spark.read.parquet(folder).where(F.col("upload_id") == upload_id)


def json_records(df: DataFrame) -> DataFrame:
    """One JSON text per row."""
    return df.select(F.to_json(F.struct("*")).alias("json"))


def write_json(df: DataFrame, folder: str) -> None:
    df.write.mode("overwrite").json(folder)


def write_reports(df: DataFrame, folder: str, key: str, text_col: str) -> None:
    """Markdown texts keyed by report id; parquet keeps every byte of a text."""
    df.select(key, text_col).write.mode("overwrite").parquet(folder)
