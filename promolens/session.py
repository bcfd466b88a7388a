"""SparkSession settings used by tests and the bench.

On a cluster the session comes from the platform; only settings that are
unset are filled in here. ``spark.checkpoint.dir`` must name a shared folder
on a cluster; a local scratch folder is set only when nothing is configured
(tests, laptop runs).
"""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

LOCAL_CONF = {
    "spark.ui.enabled": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.shuffle.partitions": "8",
    "spark.driver.memory": "8g",
}


def local_session(master: str = "local[*]", app: str = "promolens", **conf: str) -> SparkSession:
    b = SparkSession.builder.master(master).appName(app)
    for k, v in {**LOCAL_CONF, **conf}.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


_SCRATCH: dict[str, str] = {}


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the session's checkpoint folder, setting a scratch one only if none is set.

    The cluster's ``spark.checkpoint.dir`` wins (read from the session, so it
    also works over Spark Connect); then a folder set on the SparkContext; a
    machine-local temporary folder only for a local master with nothing
    configured (tests, laptop runs). On a cluster without a configured
    folder this raises rather than write where executors cannot read.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    try:
        sc = spark.sparkContext
    except Exception:          # Spark Connect: no SparkContext on the client
        sc = None
    if sc is not None and sc.getCheckpointDir():
        return sc.getCheckpointDir()
    master = spark.conf.get("spark.master", None) or ""
    if master and not master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder: written tables must be "
                           "readable by every executor")
    app = session_key(spark)
    if app not in _SCRATCH:
        _SCRATCH[app] = tempfile.mkdtemp(prefix="promolens-ckpt-")
        if sc is not None:
            sc.setCheckpointDir(_SCRATCH[app])
    return sc.getCheckpointDir() if sc is not None else _SCRATCH[app]


def session_key(spark: SparkSession) -> str:
    """An identifier of the running application (classic or Connect)."""
    try:
        return spark.sparkContext.applicationId
    except Exception:
        return spark.conf.get("spark.app.id", None) or str(id(spark))
