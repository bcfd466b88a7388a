"""Helpers shared by the operators: stored intermediate tables, sizes, packed arrays."""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Iterator

import numpy as np
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

#: Spark removes a finished query's shuffle files at once instead of when the driver collects garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


#: Rows of one Arrow batch between the JVM and Python; Spark's own default is for narrow rows, not documents.
BATCH_ROWS = 1000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batch size to ``BATCH_ROWS``, unless it was set to something else than the default."""
    if int(spark.conf.get(_BATCH)) == 10_000:
        spark.conf.set(_BATCH, str(BATCH_ROWS))


@contextlib.contextmanager
def one_row_batches(spark: SparkSession) -> Iterator[None]:
    """Arrow batches of one row each, for the stores inside: rows that hold blocks of vectors."""
    before = spark.conf.get(_BATCH)
    spark.conf.set(_BATCH, "1")
    try:
        yield
    finally:
        spark.conf.set(_BATCH, before)


def store(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` below the session's shared checkpoint folder and read it back (cuts the lineage)."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/promolens-llm/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    try:
        spark.conf.set(CLEANUP, "true")
        writer = df.write
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        writer.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def drop_stored(*frames: DataFrame, where: str = "") -> None:
    """Delete the files behind frames made by :func:`store`, once nothing reads them any more.

    With ``where`` only those in the partition folders of this name (``kind=0/round=3``).
    """
    for df in frames:
        spark = df.sparkSession
        jvm = spark.sparkContext._jvm
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        parents = {f.rsplit("/", 1)[0] for f in df.inputFiles()}
        for p in parents:
            if "/promolens-llm/" in p and p.endswith(where):
                path = jvm.org.apache.hadoop.fs.Path(p)
                path.getFileSystem(conf).delete(path, True)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def boxed(df: DataFrame) -> DataFrame:
    """One column ``row`` with all of a frame's columns, so that no name clashes with those an operator adds."""
    return df.select(F.struct("*").alias("row"))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_bytes(docs: DataFrame, col: str = "text") -> int:
    """UTF-8 bytes of a text column; one pass, one number to the driver."""
    return docs.agg(F.sum(F.octet_length(col))).first()[0] or 0


def pack(*arrays: np.ndarray) -> bytes:
    """Integer arrays of one length as bytes: differences, compressed."""
    c = zstandard.ZstdCompressor(level=1)
    return c.compress(b"".join(np.diff(a.astype(np.int64), prepend=np.int64(0)).tobytes() for a in arrays))


def unpack(blob: bytes, n_arrays: int) -> list[np.ndarray]:
    a = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), dtype=np.int64)
    return [np.cumsum(x) for x in a.reshape(n_arrays, -1)] if len(a) else [a] * n_arrays


def slices(text: str, size: int = 1 << 20):
    """Parts of about ``size`` characters that end where a word does, so that memory stays bounded."""
    start = 0
    while len(text) - start > size:
        end = start + size
        while end < len(text) and not text[end].isspace():
            end += 1
        yield text[start:end]
        start = end
    yield text[start:]


def few(texts: list, size: int = 1 << 20):
    """(first, last + 1) of consecutive texts of about ``size`` characters together."""
    first = have = 0
    for i, t in enumerate(texts):
        have += len(t)
        if have >= size:
            yield first, i + 1
            first, have = i + 1, 0
    if first < len(texts):
        yield first, len(texts)


def held_out(doc_id, modulus: int, remainder: int):
    """Whether crc32 of the doc_id as text leaves ``remainder``; a null doc_id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % modulus == remainder, F.lit(False))
