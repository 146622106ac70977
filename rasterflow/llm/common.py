"""What several operators share: the shared folder, written tables, Arrow batches."""

from __future__ import annotations

import contextlib
import os
import re
import string
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.frames import fresh, shared_dir, written

__all__ = ["fresh", "shared_dir", "written"]

#: ASCII white space, as the contracts of the operators define words.
WORD = r"[^\x20\x09-\x0D]+"

#: Arrow batches stop at either bound, so that a run of very long texts stays small.
BATCH_ROWS, BATCH_BYTES = 2000, 4 << 20
#: Bytes of text that are taken apart at once.
SLICE_BYTES = 1 << 20


def new_dir(spark: SparkSession, name: str) -> str:
    """A new folder for files that tasks write; made before any task runs."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    fs, inner = filesystem(path)
    fs.create_dir(inner, recursive=True)
    return path


def discard(table: DataFrame) -> None:
    """Removes the files of a table of :func:`written` that nothing will read any more."""
    for f in {os.path.dirname(f) for f in table.inputFiles()}:
        fs, inner = filesystem(f)
        with contextlib.suppress(FileNotFoundError):
            fs.delete_dir(inner)


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path and the path in it; Spark's names of object stores are known."""
    uri = re.sub("^s3[an]://", "s3://", uri)
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else os.path.abspath(uri))


class SafeFile:
    """A file that appears under its name only when whole, so retried tasks can't mix."""

    def __init__(self, uri: str):
        self.fs, self.final = filesystem(uri)
        self.temp = f"{self.final}.{uuid.uuid4().hex}.tmp"
        self.out = self.fs.open_output_stream(self.temp)
        self.size = 0

    def write(self, data: bytes) -> None:
        self.out.write(data)
        self.size += len(data)

    def close(self) -> None:
        self.out.close()
        self.fs.move(self.temp, self.final)


def partition_id() -> int:
    return TaskContext.get().partitionId()


def map_batches(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterable[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` with batches bounded by rows and bytes."""
    bound_batches(df.sparkSession)
    return df.mapInArrow(f, schema)


def bound_batches(spark: SparkSession) -> None:
    """Bounds the session's Arrow batches by rows and bytes; settings that are stricter stay.

    The plan reads these settings only when it runs, so they can't be put back after it is made.
    """
    for name, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        with contextlib.suppress(Exception):  # a value that is no plain number is replaced
            if 0 < int(spark.conf.get(name)) <= most:
                continue
        spark.conf.set(name, str(most))


def slices(batch: pa.RecordBatch, column: int, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """A batch in runs of rows whose texts have ``most`` bytes together, or of one longer text.

    Lists of the words or ids of a run stay small however texts are ordered.
    """
    import numpy as np
    import pyarrow.compute as pc

    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 64)
    at = 0
    while at < batch.num_rows:
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + most, "right")))
        yield batch.slice(at, to - at)
        at = to


def ascii_lower(text: Column) -> Column:
    """``text`` with A-Z lower-cased and nothing else.

    Texts without other characters that lower-casing changes (upper and title case letters,
    letter numbers and circled letters) take the short way.
    """
    others = text.rlike(r"[[^\x00-\x7F]&&[\p{Lu}\p{Lt}\p{Nl}\p{So}]]")
    return F.when(others, F.translate(text, string.ascii_uppercase, string.ascii_lowercase)).otherwise(F.lower(text))


def word_count(text: Column) -> Column:
    """Number of words of a text; null and empty texts have none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def tokenizer_path(name: str) -> str:
    """Place of a public vocabulary file, found on the machine that asks."""
    import public_tokenizers

    return public_tokenizers.path(name)
