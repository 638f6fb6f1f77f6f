"""What the operators of this package share: reading tables, cutting lineage, slicing Arrow batches."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Texts are handed to numpy in slices of about this many characters, which bounds a worker's memory.
SLICE_CHARS = 2_000_000
ROWS_OF_A_FILE = 100_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir). Where none is set, a temporary one if the session
    runs in this process alone; else an error, as other machines would not see it."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="brindle-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/brindle-{spark.sparkContext.applicationId}"


def materialise(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back: a cut of lineage that survives lost executors. `rows`, the
    number of its (narrow) rows where that is known, keeps small tables from becoming many tiny files.

    checkpoint() would compute the plan twice (once for the action, once for the files).
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    (df if rows is None else df.coalesce(-(-rows // ROWS_OF_A_FILE) or 1)).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> None:
    """Removes the tables that this session's operators have written to the shared folder; their results must be saved before."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def slices(batches: Iterable[pa.RecordBatch], text: str = "text", most: int = SLICE_CHARS) -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    """Cuts batches so that each slice holds about `most` characters; a longer text stands alone, whole."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        ends = np.cumsum(pc.fill_null(pc.utf8_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < batch.num_rows:
            end = max(start + 1, int(np.searchsorted(ends, most + (ends[start - 1] if start else 0), side="right")))
            yield batch.slice(start, end - start), column.slice(start, end - start).to_pylist()
            start = end


def released() -> None:
    """Gives what this process's allocators keep, and no object holds, back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # glibc only
        ctypes.CDLL(None).malloc_trim(0)


#: Bytes of an Arrow batch, in place of Spark's default.
BATCH_SETTING, BATCH_DEFAULT, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", "4m"


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """A function for mapInArrow that gives back, at its task's end, the memory that the worker's allocators have kept: workers
    live on through later stages. A session that has Spark's default for the bytes of a batch gets a lower one, as both sides hold
    several batches for each task."""
    spark = SparkSession.getActiveSession()
    if spark and spark.conf.get(BATCH_SETTING) == BATCH_DEFAULT:
        spark.conf.set(BATCH_SETTING, BATCH_BYTES)

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            released()

    return wrapped


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def unused(taken: Iterable[str], *names: str) -> list[str]:
    """The names, with underscores added to those that `taken` has (in any case)."""
    have, out = {x.lower() for x in taken}, []
    for name in names:
        while name.lower() in have:
            name += "_"
        out.append(name)
    return out


def held_out(key: str, mod: int, rest: int):
    """Whether crc32 of the id as text leaves `rest`; null ids are not held out."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % mod == rest, F.lit(False))


class Bounded(dict):
    """A cache of make(key) that starts afresh when it holds `most` entries."""

    def __init__(self, make, most: int = 300_000):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, key):
        if len(self) >= self.most:
            self.clear()
        value = self[key] = self.make(key)
        return value


def tokenizer_file(name: str = "word_bpe_49k.json") -> str:
    """Where the public tokenizer's file lies; BRINDLE_TOKENIZERS overrides the folder."""
    if folder := os.environ.get("BRINDLE_TOKENIZERS"):
        return f"{folder}/{name}"
    import public_tokenizers

    return str(public_tokenizers.path(name))
