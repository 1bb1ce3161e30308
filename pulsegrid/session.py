"""Session construction and lineage-cutting helpers.

Library code never creates its own session: every public function takes
DataFrames (and a session only where it must read or write).  This module is
for entry points, tests and the bench.
"""

from __future__ import annotations

import contextlib
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings every job relies on.  Session time zone is pinned to UTC so that
# TIMESTAMP <-> TIMESTAMP_NTZ conversions never depend on the host.
BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Window stages are CPU-heavy per byte (30-row frames, stddev, slopes):
    # let AQE keep small shuffles spread over the cores instead of coalescing
    # them to one task.  Large shuffles are sized by the advisory partition
    # size as before, so this only matters for small inputs.
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64KB",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Broadcast only what has a measured size: no broadcast from planner
    # estimates; AQE may still turn a join into a broadcast join after the
    # shuffle stage has measured the small side's real size.
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "10MB",
    # Landing folders hold a folder per subject; a listing task for each folder
    # costs more than the listing.
    "spark.sql.sources.parallelPartitionDiscovery.parallelism": "200",
    "spark.ui.enabled": "false",
}


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "pulsegrid", extra: dict | None = None) -> SparkSession:
    """Create (or reuse) a session with the settings the operators assume."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(BASE_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster the setting names a shared (distributed) folder and is used
    as is.  Only when it is unset -- local tests -- do we create one; without
    the setting a cluster job stops here, since executors would not see a
    folder of the driver's machine.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or \
        spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        if not is_local(spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        configured = tempfile.mkdtemp(prefix="pulsegrid-ckpt-")
        spark.conf.set("spark.checkpoint.dir", configured)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(configured)
    return configured


def is_local(master: str) -> bool:
    """Whether driver and executors are one process."""
    return master == "local" or master.startswith("local[")


#: Databases of the open ``scratch_tables`` blocks, innermost last.
_SCRATCH: list[str] = []


@contextlib.contextmanager
def scratch_tables(spark: SparkSession):
    """Tables that ``materialize`` writes inside the block are dropped with
    their files at its end.  For jobs that have written all their results by
    then; a block that returns lazy results must not use it."""
    name = f"pulsegrid_run_{uuid.uuid4().hex}"
    spark.sql(f"CREATE DATABASE {name} LOCATION '{os.path.join(ensure_checkpoint_dir(spark), name)}'")
    _SCRATCH.append(name)
    try:
        yield
    finally:
        _SCRATCH.remove(name)
        spark.sql(f"DROP DATABASE {name} CASCADE")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet under the shared checkpoint folder and read it back.

    This cuts lineage (a lost executor re-reads files instead of recomputing
    the whole upstream plan) and lets several downstream operators share one
    computed table.  Never a machine-local folder on a cluster: the folder is
    the one the cluster names in ``spark.checkpoint.dir``.  Inside
    ``scratch_tables`` the table is dropped at the end of the block; elsewhere
    it stays until the folder is cleaned, since the result is read lazily.
    """
    spark = df.sparkSession
    if _SCRATCH:
        table = f"{_SCRATCH[-1]}.t_{uuid.uuid4().hex}"
        df.write.format("parquet").saveAsTable(table)
        return spark.table(table)
    base = ensure_checkpoint_dir(spark)
    path = os.path.join(base, "tables", f"{name}-{uuid.uuid4().hex}")
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
