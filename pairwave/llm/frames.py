"""Shared plumbing: reading tables, writing intermediate tables, batching rows for Arrow functions."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows turned into Python objects at once inside an Arrow function.
SLICE_ROWS = 512
#: Characters of a text that are cut into words at once.
WORD_CHARS = 1 << 20
_SPACE = re.compile(r"\s")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share (spark.checkpoint.dir); a temporary one only in local mode where none is set."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path
    sc = spark.sparkContext
    if not sc.master.startswith("local[") and sc.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="pairwave-"))
    return sc.getCheckpointDir()


#: Lists that take down the paths of tables made inside `noted`, of this thread or task only.
_notes: ContextVar[tuple[list[str], ...]] = ContextVar("_notes", default=())


@contextlib.contextmanager
def noted() -> Iterator[list[str]]:
    """The paths of all temporary tables that this thread makes inside: their maker may `forget` them, nobody else has them."""
    paths: list[str] = []
    token = _notes.set((*_notes.get(), paths))
    try:
        yield paths
    finally:
        _notes.reset(token)


def temporary(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder. What is stored there goes when the session's JVM exits, or earlier by `forget`."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    where, system = _file_system(spark, path)
    system.deleteOnExit(where)
    for paths in _notes.get():
        paths.append(path)
    return path


def stored(df: DataFrame, name: str, level: int = 3) -> tuple[DataFrame, str]:
    """df written once as a Parquet table in the shared folder and read back, and its path: cuts lineage and survives lost executors.

    level: of zstd, a higher one takes more time and less disk. The table stays until `forget` or the JVM's exit, since the returned frame is read lazily.
    """
    spark = df.sparkSession
    path = temporary(spark, name)
    df.write.option("compression", "zstd").option("parquet.compression.codec.zstd.level", level).parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def written(df: DataFrame, name: str, level: int = 3) -> DataFrame:
    """The table of `stored` alone."""
    return stored(df, name, level)[0]


def forget(spark: SparkSession, paths: list[str]) -> None:
    """Deletes temporary tables that nothing will read again: the caller's own."""
    for path in paths:
        where, system = _file_system(spark, path)
        system.delete(where, True)


def _file_system(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


@functools.cache
def _trimmer():
    try:
        return ctypes.CDLL(None).malloc_trim
    except (OSError, AttributeError):
        return None


def trim() -> None:
    """Gives freed memory back to the system, where the C library keeps it: workers live on between stages."""
    if (give := _trimmer()) is not None:
        give(0)


def rows(batches: Iterator[pa.RecordBatch], size: int = SLICE_ROWS) -> Iterator[list[list]]:
    """Column lists for slices of at most `size` rows."""
    for batch in batches:
        for at in range(0, batch.num_rows, size):
            part = batch.slice(at, size)
            yield [column.to_pylist() for column in part.columns]
        trim()


def extended(schema: T.StructType, **added: T.DataType) -> T.StructType:
    """A copy of schema with more columns; one of the same name is replaced."""
    return T.StructType([f for f in schema.fields if f.name not in added] + [T.StructField(k, v) for k, v in added.items()])


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have, whatever the case of letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def crc32(text: str) -> "F.Column":
    """Unsigned CRC-32 of a string column's UTF-8 bytes; null counts as empty."""
    return F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary"))


def words_in_parts(text: str) -> Iterator[list[str]]:
    """text.lower().split(), a part of a very long text at a time."""
    at = 0
    while len(text) - at > 2 * WORD_CHARS and (gap := _SPACE.search(text, at + WORD_CHARS)):
        yield text[at : gap.start()].lower().split()
        at = gap.start()
    yield (text[at:] if at else text).lower().split()


def hashed_words(texts: list[str | None], memo: dict[str, int], most: int, hash_of: Callable[[bytes], int]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all lower-cased words, text after text, and how many each text has. memo: hashes of known words, cleared beyond `most`."""
    parts, held, size, lengths = [np.zeros(0, np.uint64)], [], 0, np.zeros(len(texts), np.int64)

    def flush() -> None:
        if len(memo) > most:
            memo.clear()
        for w in set().union(*held) - memo.keys():
            memo[w] = hash_of(w.encode("utf-8", "surrogatepass"))
        get = memo.__getitem__
        parts.append(np.fromiter((get(w) for ws in held for w in ws), np.uint64, sum(map(len, held))))

    for i, text in enumerate(texts):
        for words in words_in_parts(text or ""):
            held.append(words)
            lengths[i] += len(words)
            size += len(words)
            if size > WORD_CHARS:
                flush()
                held, size = [], 0
    flush()
    return np.concatenate(parts), lengths
