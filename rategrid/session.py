"""Session settings the plans are designed for."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

# Runtime SQL settings: adaptive execution (coalesce small shuffles, split
# skewed join partitions even when that adds an exchange), UTC timestamps.
# HotSpot compiles no method above 8,000 bytes of bytecode, so a generated method
# larger than that (the sweep's 19 scores side by side) would stay interpreted;
# with the limit Spark runs such a stage operator by operator, in split methods.
SQL_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


# Suggested settings for a large cluster (applied by the deployment, not by
# the library).  Adaptive execution merges small shuffle partitions up to the
# advisory size but never splits large ones (outside skewed joins), so the
# initial number must follow the data: shuffled bytes / 256 MB, about 400,000
# for 100 TB shuffled; 20,000 suits 5 TB.  spark.checkpoint.dir is set per cluster.
CLUSTER_CONF = {
    "spark.sql.shuffle.partitions": "20000",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "256m",
    "spark.sql.files.maxPartitionBytes": "256m",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1g",
}


def ensure_checkpoint_dir(spark: SparkSession) -> SparkSession:
    """Where a local session names no ``spark.checkpoint.dir``, give it a new
    folder under /tmp; a cluster session must name a shared one itself."""
    if not (spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()):
        if spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local":
            spark.conf.set("spark.checkpoint.dir", tempfile.mkdtemp(prefix="rategrid-ckpt-", dir="/tmp"))
    return spark


# Spark broadcasts a join side whose estimated size is below a threshold, 10 MB by
# default.  The estimate is the compressed file size, without the rows that an
# ``explode`` adds: the dense grid (17 rows per order) comes to about 80 times its
# estimate once it is a hash table on the driver.
BROADCAST_CONF = "spark.sql.autoBroadcastJoinThreshold"
BROADCAST_BYTES = 1 << 20


def limit_broadcasts(spark: SparkSession) -> None:
    """Lower the broadcast threshold to :data:`BROADCAST_BYTES`; a lower one stays, as
    does -1 (no automatic broadcast)."""
    size = spark._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    if size > BROADCAST_BYTES:
        spark.conf.set(BROADCAST_CONF, str(BROADCAST_BYTES))


def configure(spark: SparkSession) -> SparkSession:
    """Apply :data:`SQL_CONF` to an existing session, limit its automatic broadcasts
    and make sure a checkpoint folder is set (only when none is configured)."""
    for k, v in SQL_CONF.items():
        spark.conf.set(k, v)
    limit_broadcasts(spark)
    return ensure_checkpoint_dir(spark)


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g",
                  checkpoint: str | None = None) -> SparkSession:
    """Local session for tests and benchmarks: UI off, and a checkpoint folder
    of its own (``checkpoint`` or a fresh temporary folder) because a local
    run has no cluster-wide one."""
    b = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("rategrid")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", memory)
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.checkpoint.dir", checkpoint or tempfile.mkdtemp(prefix="rategrid-ckpt-", dir="/tmp"))
    )
    for k, v in SQL_CONF.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)
