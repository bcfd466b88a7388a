"""Cut lineage by writing a table under the session's checkpoint folder.

Iterative jobs (the radix percentile) reuse the result of one step in the
next, and several metrics share one expensive scan (the daily series, the
campaign summary, ...); left lazy, every use would re-plan and re-run it.
``materialize`` writes the frame as Parquet under ``spark.checkpoint.dir``
(a shared folder on a cluster, so the result survives executor loss) and
reads it back: one job, a shallow plan, and file statistics the planner can
use for broadcast decisions.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from ..session import ensure_checkpoint_dir


#: With writers for all values of the partition column open at once, rows need no sort by it.
WRITERS = "spark.sql.maxConcurrentOutputFileWriters"


def materialize(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """``df`` written and read back; ``partition_by`` is a column of a few values, each a folder of its own."""
    spark = df.sparkSession
    root = ensure_checkpoint_dir(spark).rstrip("/")
    path = f"{root}/promolens-tables/{name}-{uuid.uuid4().hex}"
    if partition_by is None:
        df.write.parquet(path)
    else:
        before = spark.conf.get(WRITERS)
        try:
            spark.conf.set(WRITERS, "8")
            df.write.partitionBy(partition_by).parquet(path)
        finally:
            spark.conf.set(WRITERS, before)
    return spark.read.schema(df.schema).parquet(path)    # known schema: no footer inference
