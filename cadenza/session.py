"""Session construction and cluster-shared locations."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

# Settings every job relies on. AQE re-plans joins at runtime: a shuffled
# side that turns out small becomes a broadcast (its size is measured, not
# guessed), and a skewed partition (one file or key holding a third of the
# rows) is split across tasks. The number of shuffle partitions is left to
# the cluster.
BASE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "4",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "32MB",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # checkpoints (row positions, merged buckets) are removed once unused
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "cadenza", extra: dict | None = None) -> SparkSession:
    """Return (or create) a session with the engine's base settings; the
    package is shipped to the workers. ``shuffle_partitions`` is set only
    when given (tests)."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(BASE_CONF)
    if shuffle_partitions is not None:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ship_package(spark)
    return spark


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers (once per application), so
    that kernels import wherever the workers run."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="cadenza-pkg-"), "cadenza_pkg.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(root):
            for n in sorted(names):
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    sc.addPyFile(path)
    _shipped.add(sc.applicationId)


def _is_local(master: str) -> bool:
    return master == "local" or master.startswith("local[")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster it must be set to a folder that the driver and all
    executors share; an unset folder is an error there. Only on a local
    master (tests) an unset folder is replaced by a scratch folder. The
    folder is registered once per application.
    """
    sc = spark.sparkContext
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if not _is_local(sc.master):
            raise ValueError("spark.checkpoint.dir is not set: name a folder that the driver and "
                             "all executors share")
        d = tempfile.mkdtemp(prefix="cadenza-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
        sc.setCheckpointDir(d)
    elif sc.getCheckpointDir() is None:
        sc.setCheckpointDir(d)
    return d


def checkpoint(df: DataFrame, gather: bool = False) -> DataFrame:
    """Cut the lineage of ``df``: its rows are written to the shared
    checkpoint folder and read from there. With ``gather`` at most twice as
    many tasks write as the cluster has cores, so that tables of few bytes
    a partition do not become many small files."""
    checkpoint_dir(df.sparkSession)
    return (_gathered(df) if gather else df).checkpoint(eager=True)


def _gathered(df: DataFrame) -> DataFrame:
    return df.coalesce(2 * df.sparkSession.sparkContext.defaultParallelism)


_scratch: dict[str, list[str]] = {}


def scratch_table(df: DataFrame, gather: bool = False) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared checkpoint folder and
    read it back: columns and rows not needed later are not read again.
    ``gather`` as in :func:`checkpoint`. ``clear_scratch`` deletes the
    tables of an application."""
    path = scratch_path(df.sparkSession)
    (_gathered(df) if gather else df).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def scratch_path(spark: SparkSession) -> str:
    """A new folder name in the shared checkpoint folder."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/cadenza-{uuid.uuid4().hex}"
    _scratch.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def clear_scratch(spark: SparkSession) -> None:
    """Delete the scratch tables this application wrote, once no frame that
    reads them is needed any more."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for path in _scratch.pop(spark.sparkContext.applicationId, []):
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(conf).delete(where, True)
