"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxtab.sources.catalog import read_table, written

__all__ = ["read_table", "written"]

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: Bytes of text that a task turns into arrays at once. Longer texts are taken alone.
CHUNK_BYTES = 4 << 20
#: Bytes of a batch sent to a Python worker; Spark's own bound is 64 MB (and 10,000 rows).
BATCH_BYTES = 8 << 20


#: Lower case for A-Z; all of ASCII but letters and digits becomes a blank.
WORD_BYTES = bytes(
    c if c >= 128 else ord(chr(c).lower()) if chr(c).isalnum() else 32 for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    """Words of a UTF-8 text: runs of letters and digits of ASCII and of all other characters."""
    return text.translate(WORD_BYTES).split()


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "documents")


def bound_batches(spark: SparkSession) -> None:
    """Bound the batches that go to Python workers in bytes, unless the session sets a bound itself.

    One longer row still makes a batch of its own. No result depends on the bound.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, str(BATCH_BYTES))


def ascii_lower(text: Column) -> Column:
    """Lower case for A to Z alone."""
    return F.translate(text, UPPER, UPPER.lower())


def numbered(df: DataFrame, *cols: Column | str) -> DataFrame:
    """The columns and a unique row number ``_row``, written out so that it stays the same.

    Ids may be NULL or repeated; the row number tells rows apart in later joins.
    """
    return written(df.select(*cols, F.monotonically_increasing_id().alias("_row")))


def as_column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def whole_row(df: DataFrame) -> Column:
    """All columns as one struct, which an operator can carry as its id."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns])


def free_name(df: DataFrame, name: str) -> str:
    """A column name that the frame doesn't have."""
    while name in df.columns:
        name += "_"
    return name


def schema_with(df: DataFrame, keep: Sequence[str], more: str) -> T.StructType:
    """The kept fields of a frame and further ones given as DDL."""
    return T.StructType([*[df.schema[k] for k in keep], *T.StructType.fromDDL(more).fields])


def raw_texts(batch: pa.RecordBatch, name: str) -> list[bytes | None]:
    """A string column as UTF-8 bytes, without decoding."""
    return batch.column(batch.schema.get_field_index(name)).cast(pa.binary()).to_pylist()


def chunks_of(batches: Iterable[pa.RecordBatch], text: str,
              limit: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of the batches that hold at most ``limit`` bytes of text, or one row.

    NULL texts come out empty; the slice still shows which they were.
    """
    for batch in batches:
        texts = [t or b"" for t in raw_texts(batch, text)]
        start = size = 0
        for i, t in enumerate(texts):
            if i > start and size + len(t) > limit:
                yield batch.slice(start, i - start), texts[start:i]
                start, size = i, 0
            size += len(t)
        if len(texts) > start:
            yield batch.slice(start), texts[start:]


def out_batch(batch: pa.RecordBatch, keep: Sequence[str], **columns) -> pa.RecordBatch:
    """The kept columns of a batch and new ones."""
    names = [*keep, *columns]
    kept = [batch.column(batch.schema.get_field_index(k)) for k in keep]
    new = [c if isinstance(c, pa.Array) else pa.array(c) for c in columns.values()]
    return pa.RecordBatch.from_arrays([*kept, *new], names=names)
