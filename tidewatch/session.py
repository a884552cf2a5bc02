"""Session settings and table access shared by every plan."""

from __future__ import annotations

import gc
import os
import tempfile
import time
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Runtime settings the plans rely on; all are session-level SQL settings.
RUNTIME = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # A join on (entity, t) may reuse a partitioning by entity, so the window
    # that follows needs no second exchange of the dense grid.
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
    # Logs come in any charset the JVM knows; processors with several state values need this store.
    "spark.sql.legacy.javaCharsets": "true",
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}
#: A side of a join is broadcast when it was hinted or measured to be small, never by estimate: estimates take an exploded grid for the
#: few rows it came from, and a written table for its compressed size.  Few keys in a measured side are no reason against it.
MEASURED_JOINS = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "10m",
    "spark.sql.adaptive.nonEmptyPartitionRatioForBroadcastJoin": "0",
}
_MARK = "tidewatch.prepared"
_SHIPPED = "tidewatch.shipped"


def build_session(cores: str = "*", shuffle_partitions: int | None = None) -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tidewatch")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("TIDEWATCH_DRIVER_MEMORY", "12g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # Call-site capture costs several driver round trips per column expression.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return ship_package(measured_joins(prepare(builder.getOrCreate())))


def ship_package(spark: SparkSession) -> SparkSession:
    """Send this package's sources to all executors, once per session, so that Python workers can import it wherever they run."""
    if spark.conf.get(_SHIPPED, None) is None:
        root = Path(__file__).resolve().parent
        archive = Path(tempfile.mkdtemp(prefix="ship-")) / f"{root.name}.zip"
        with zipfile.ZipFile(archive, "w") as out:
            for source in sorted(root.rglob("*.py")):
                out.write(source, source.relative_to(root.parent))
        spark.sparkContext.addPyFile(str(archive))
        spark.conf.set(_SHIPPED, "yes")
    return spark


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings once per session."""
    if spark.conf.get(_MARK, None) is None:
        for key, value in RUNTIME.items():
            spark.conf.set(key, value)
        spark.conf.set(_MARK, "yes")
    return spark


def measured_joins(spark: SparkSession) -> SparkSession:
    """The session, with ``MEASURED_JOINS`` in force."""
    for key, value in MEASURED_JOINS.items():
        spark.conf.set(key, value)
    return spark


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{root}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: the cluster's checkpoint folder.

    Only a local session that names none gets a fresh local folder; on a cluster executors would write it to disks of their own.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    made = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def scratch_path(spark: SparkSession, label: str) -> str:
    """Fresh path below the shared folder; nothing is ever overwritten there."""
    import uuid

    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


#: Seconds between two looks for shuffle files that nothing needs any more.
RELEASE_SECONDS = 10.0
_released = 0.0


def release(spark: SparkSession) -> None:
    """Let go of the shuffle files of frames that are gone: Spark deletes them once the driver has collected its garbage, which may be long after."""
    global _released
    if time.monotonic() - _released >= RELEASE_SECONDS:
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        _released = time.monotonic()


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Cut lineage by writing to the shared folder and reading the table back."""
    release(df.sparkSession)
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
