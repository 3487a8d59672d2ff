"""Helpers shared by the operators of this folder."""

from __future__ import annotations

import atexit
import ctypes
import string
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from calibra.session import ship_package

# what ``bytes.split()`` splits on, written for Java's regex
ASCII_SPACE = r"[\x20\x09-\x0D]+"

_LOCAL_FOLDER: dict[str, str] = {}


def lower_az(text: Column) -> Column:
    """A-Z to a-z and nothing else.

    ``lower`` equals that on texts of ASCII alone, which are told by their
    length in bytes; the slower ``translate`` serves the others.
    """
    ascii_only = F.octet_length(text) == F.char_length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(
        F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def split_words(text: Column, separators: str) -> Column:
    """Array of the words between runs of separators; empty for null."""
    return F.coalesce(F.array_remove(F.split(text, separators), ""),
                      F.array().cast("array<string>"))


def split_ascii(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """What ``bytes.split()`` makes of each text (no nulls): all words in a row
    (binary), and where each text's words start, then the end."""
    texts = texts.view(pa.string())  # bytes that are no UTF-8 pass as they are
    lists = pc.ascii_split_whitespace(texts)
    words, upto = lists.flatten().view(pa.binary()), lists.offsets.to_numpy()
    upto = upto - (upto[0] if len(upto) else 0)
    real = pc.greater(pc.binary_length(words), 0)  # space at either end of a text leaves an empty word
    if pc.all(real).as_py() is False:
        upto = np.concatenate([[0], np.cumsum(real.to_numpy(zero_copy_only=False))])[upto]
        words = words.filter(real)
    return words, upto


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; null for a null id."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(n).cast("bigint"))


def shared_folder(spark: SparkSession) -> str:
    """A fresh folder under the shared one that ``spark.checkpoint.dir`` names.

    Only a local session (tests) without that setting gets a folder of its
    own; a cluster without it is an error, since executors would each write
    to their own disk.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = _LOCAL_FOLDER.get(spark.sparkContext.applicationId)
        if not base:
            base = "file://" + tempfile.mkdtemp(prefix="llm-", dir="/tmp")
            _LOCAL_FOLDER[spark.sparkContext.applicationId] = base
    folder = f"{base.rstrip('/')}/llm-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, folder)
    return folder


def _remove(spark: SparkSession, folder: str) -> None:
    """Delete a folder of this run at the end of the program, if Spark still runs."""
    if spark.sparkContext._jsc is None or spark.sparkContext._jsc.sc().isStopped():
        return
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def give_back() -> None:
    """Hand the memory that this worker has freed back to the system.

    Workers live on from task to task, and their allocators with them: Arrow's
    and C's keep what the largest task needed, also while later stages run.
    """
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


def in_arrow(df: DataFrame, run, schema) -> DataFrame:
    """``mapInArrow``, with this package sent to the workers first, which keep no freed memory after a task."""
    ship_package(df.sparkSession)

    def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return df.mapInArrow(tidy, schema)


@contextmanager
def small_batches(spark: SparkSession, size: str = "4m") -> Iterator[None]:
    """Jobs that run inside send rows to Python in batches of about ``size`` bytes.

    Spark's own bound (64 MB, or 10,000 rows) lets a batch be a whole
    partition of texts, held by the JVM and by the Python worker at once.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, size)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows of ``df``, written once to the shared folder and read back.

    Cuts the lineage, so that later jobs neither repeat the work nor lose it
    with an executor.  The table goes when the program ends.
    """
    path = f"{shared_folder(df.sparkSession)}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_enough(df: DataFrame, rows: int) -> bool:
    """Whether ``df`` has at most ``rows`` rows; counts no further than that."""
    return df.limit(rows + 1).count() <= rows
