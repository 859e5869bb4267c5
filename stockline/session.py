"""Session settings and the shared scratch folder.

Every operator in this package is a pure DataFrame function; this module only
holds the few settings the operators rely on and the one place that decides
where intermediate tables may be written.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings the operators assume. AQE re-plans joins from runtime sizes (a side
# that turns out small becomes a broadcast, a skewed partition is split) and
# coalesces the small shuffle outputs of the one-row summaries.
RECOMMENDED_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.localShuffleReader.enabled": "true",
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
    "spark.sql.ui.enabled": "false",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(master: str = "local[8]", shuffle_partitions: int = 8,
                  app_name: str = "stockline", extra: dict | None = None) -> SparkSession:
    """Session for tests and the benchmark. On a cluster, use the cluster's
    session and only make sure the settings in RECOMMENDED_CONF are on."""
    builder = (SparkSession.builder.master(master).appName(app_name)
               .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
               .config("spark.driver.memory", os.environ.get("STOCKLINE_DRIVER_MEMORY", "8g")))
    for key, value in {**RECOMMENDED_CONF, **(extra or {})}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    On a cluster this is set by the cluster and points at shared storage; it is
    read from the session and never overridden. Only when it is unset (local
    tests) a private folder is created and registered.
    """
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001 - a Connect session has no SparkContext
        if conf_dir:
            return conf_dir
        raise RuntimeError("spark.checkpoint.dir must be set for this session")
    if conf_dir:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(conf_dir)
        return conf_dir
    current = sc.getCheckpointDir()
    if current:
        return current
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
    local = tempfile.mkdtemp(prefix="stockline-ckpt-")
    sc.setCheckpointDir(local)
    return local


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique path under the shared checkpoint folder."""
    root = checkpoint_root(spark).rstrip("/")
    return f"{root}/stockline/{name}-{uuid.uuid4().hex}"


# Rows of a task where a step's memory goes by rows, not by the bytes they shuffle.
ROWS_PER_PARTITION = 500_000


def partitions_for(rows: int) -> int:
    """Partitions that hold ``ROWS_PER_PARTITION`` rows each, evenly dealt; given to ``repartition`` with a key, AQE
    does not merge them by their bytes."""
    return max(1, -(-rows // ROWS_PER_PARTITION))


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared folder (survives executor loss,
    unlike a local checkpoint)."""
    checkpoint_root(df.sparkSession)
    return df.checkpoint(eager=True)
