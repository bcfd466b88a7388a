"""Session settings sized from the input volume (applied only where unset).

Targets ~256 MB per shuffle partition and per file split, so a task's
working set stays well inside executor memory at any scale; AQE then
coalesces small partitions and splits skewed ones at runtime. Example: the
load step at 100 TB of raw input on 1,000 executors x 8 cores gets
~400,000 initial shuffle partitions (AQE coalesces what the joins and
partial aggregates shrink), 256 MB splits and skew splitting above 1 GB.
"""

from __future__ import annotations

import math

from pyspark.sql import SparkSession

PARTITION_BYTES = 256 * 1024 ** 2


def scale_conf(input_bytes: int, total_cores: int) -> dict[str, str]:
    parts = max(2 * total_cores, math.ceil(input_bytes / PARTITION_BYTES))
    return {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.shuffle.partitions": str(parts),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(PARTITION_BYTES),
        "spark.sql.files.maxPartitionBytes": str(PARTITION_BYTES),
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(4 * PARTITION_BYTES),
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "5",
    }


def apply_where_unset(spark: SparkSession, conf: dict[str, str]) -> dict[str, str]:
    """Set each runtime SQL setting the session does not already carry; return what was set."""
    applied = {}
    for k, v in conf.items():
        if spark.conf.get(k, None) is None:     # None: neither the platform nor the user set it
            spark.conf.set(k, v)
            applied[k] = v
    return applied
