"""Session construction and session-scoped settings."""

from __future__ import annotations

import os
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Settings every session of ours gets.  AQE re-plans joins at runtime from
# measured shuffle sizes (the size check behind every dimension broadcast),
# coalesces small partitions and splits skewed ones.
BASE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": str(64 * 1024 * 1024),
    # Plan-time estimates come from file sizes and can make a small fact look
    # broadcastable; keep the static threshold low and let AQE broadcast from
    # measured shuffle sizes instead.
    "spark.sql.autoBroadcastJoinThreshold": str(2 * 1024 * 1024),
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "martlet", extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with the settings above.

    ``master`` defaults to ``local[N]`` with N from ``BENCH_CPUS`` or 8; on a
    cluster pass the master from the launcher instead.
    """
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    builder = SparkSession.builder.appName(app_name).master(master or f"local[{cpus}]")
    conf = dict(BASE_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions or cpus)
    conf.setdefault("spark.driver.memory", "16g")
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def session_key(spark: SparkSession) -> str:
    """An id for the running application (memo keys for per-session caches)."""
    try:
        return spark.sparkContext.applicationId
    except Exception:  # sessions without a local SparkContext
        return spark.conf.get("spark.app.id", None) or str(id(spark))


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the checkpoint folder the cluster names in ``spark.checkpoint.dir``.

    Only a session on a local master (one machine: tests, local runs) gets a
    fresh scratch folder of our own when none is set; any other master must name
    a folder that all its executors share.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    try:
        sc = spark.sparkContext
    except Exception:  # sessions without a local SparkContext
        sc = None
    current = sc.getCheckpointDir() if sc is not None else None
    if configured:
        if sc is not None and not current:
            sc.setCheckpointDir(configured)
        return configured
    if current:
        return current
    master = spark.conf.get("spark.master", "")
    if sc is None or not (master == "local" or master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    path = tempfile.mkdtemp(prefix="martlet-ckpt-")
    sc.setCheckpointDir(path)
    return path


SCOPE = "martlet.tables.scope"


def tables_folder(spark: SparkSession) -> str:
    """Where intermediates go: a folder of the scope that is open in this thread, or the
    shared one."""
    try:
        scope = spark.sparkContext.getLocalProperty(SCOPE)
    except Exception:  # sessions without a local SparkContext
        scope = None
    return scope or f"{ensure_checkpoint_dir(spark).rstrip('/')}/martlet-tables"


@contextmanager
def owned_tables(spark: SparkSession) -> Iterator[str]:
    """Intermediates written inside this scope are deleted when it ends, failed or not.

    The scope is a folder named in a local property, which threads started through
    ``inheritable_thread_target`` take over.  Frames that read those intermediates end with
    it: store or collect a result inside the scope.  A scope inside a scope has a folder of its own."""
    sc = spark.sparkContext
    outer, folder = sc.getLocalProperty(SCOPE), f"{tables_folder(spark)}/scope-{uuid.uuid4().hex}"
    sc.setLocalProperty(SCOPE, folder)
    try:
        yield folder
    finally:
        sc.setLocalProperty(SCOPE, outer)
        path = sc._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_FREEING: dict[int, list] = {}   # by session: how many scopes are open, the setting before the first
_FREEING_LOCK = threading.Lock()


@contextmanager
def freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """Queries that start inside this scope delete their shuffle files when they end, and not
    only when the driver comes to collect its garbage: of a job in stored steps, the disk holds one
    step's shuffles at a time.  The session's own setting comes back with the last open scope."""
    key = id(spark)
    with _FREEING_LOCK:
        held = _FREEING.setdefault(key, [0, spark.conf.get(SHUFFLE_CLEANUP, "false")])
        held[0] += 1
        spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        with _FREEING_LOCK:
            held[0] -= 1
            if not held[0]:
                del _FREEING[key]
                spark.conf.set(SHUFFLE_CLEANUP, held[1])


def materialize(df: DataFrame, label: str, row_group_bytes: int = 16 * 1024 * 1024) -> DataFrame:
    """Write ``df`` as a parquet table under the session's checkpoint folder (inside the open
    scope, if there is one) and return a frame reading it back: lineage is cut, the stored copy
    survives executor loss, and every later job reads the same rows.  Row groups are
    kept moderate so the copy splits into several read tasks; columns are compressed with
    zstd, which takes less room than the default."""
    path = f"{tables_folder(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    (df.write.option("parquet.block.size", row_group_bytes).option("compression", "zstd")
     .parquet(path))
    return df.sparkSession.read.schema(df.schema).parquet(path)
