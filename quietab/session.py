"""Session construction and the shared checkpoint folder.

On a cluster the session is created by the platform; ``spark.checkpoint.dir``
names a shared folder there and is only *read* here.  Only when it is unset
(local tests, the bench) do we choose a scratch folder of our own.
"""

from __future__ import annotations

import contextlib
import os
import tempfile
import threading
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def get_session(master: str | None = None, shuffle_partitions: int = 8,
                app: str = "quietab") -> SparkSession:
    master = master or os.environ.get("QUIETAB_MASTER", "local[8]")
    # one BLAS thread per Python worker: Spark already runs one worker per core
    for var in ("OMP_NUM_THREADS", "OPENBLAS_NUM_THREADS", "MKL_NUM_THREADS"):
        os.environ.setdefault(var, "1")
    spark = (
        SparkSession.builder.master(master).appName(app)
        .config("spark.executorEnv.OMP_NUM_THREADS", "1")
        .config("spark.executorEnv.OPENBLAS_NUM_THREADS", "1")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("QUIETAB_DRIVER_MEM", "16g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and written intermediate tables.

    Reads ``spark.checkpoint.dir`` from the session; sets a scratch folder only
    on a local master (tests, local runs); elsewhere an unset folder is an error,
    since executors would not see each other's files.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        d = tempfile.mkdtemp(prefix="quietab-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
        spark.conf.set("spark.checkpoint.dir", d)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(d)
    return d


def ship_package(spark: SparkSession) -> None:
    """Give the executors this package, once per Spark context: a zip that Spark
    itself distributes, so workers need not have the driver's Python path."""
    sc = spark.sparkContext
    if getattr(sc, "_quietab_shipped", False):
        return
    here = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="quietab-ship-"), "quietab.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(here):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.join("quietab", os.path.relpath(full, here)))
    sc.addPyFile(path)
    sc._quietab_shipped = True


_written = threading.local()


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder's path under the shared checkpoint folder; an open :func:`scratch` removes it at its end."""
    path = os.path.join(checkpoint_dir(spark), f"{name}-{uuid.uuid4().hex[:12]}")
    for paths in getattr(_written, "open", []):
        paths.append(path)
    return path


def drop_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder on whatever file system holds it."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@contextlib.contextmanager
def scratch(spark: SparkSession):
    """Intermediate tables that this thread writes inside are deleted at the end: results must be written by then."""
    paths: list[str] = []
    _written.open = [*getattr(_written, "open", []), paths]
    try:
        yield
    finally:
        _written.open = [p for p in _written.open if p is not paths]
        for path in paths:
            drop_folder(spark, path)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as parquet under the shared checkpoint folder and read it back.

    Cuts lineage so a lost executor re-reads files instead of recomputing a long
    plan; the folder is the cluster's shared one, never a machine-local path.
    """
    path = scratch_folder(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def scale_conf(input_bytes: int, total_cores: int, target_partition_bytes: int = 256 << 20) -> dict:
    """Shuffle and scan sizing for a job reading ``input_bytes`` on ``total_cores``.

    Initial shuffle partitions are sized so each holds ~``target_partition_bytes``
    of the input (at least 2 per core); AQE then coalesces small ones and splits
    skewed ones towards the same advisory size.  Scan splits use the same target.
    At 100 TB this gives ~400k initial shuffle partitions of ~256 MB, each far
    below executor memory, so sorts and aggregations spill gracefully.
    """
    parts = max(2 * total_cores, -(-input_bytes // target_partition_bytes))
    return {
        "spark.sql.shuffle.partitions": str(parts),
        "spark.sql.files.maxPartitionBytes": str(target_partition_bytes),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(target_partition_bytes),
        "spark.sql.adaptive.skewJoin.enabled": "true",
    }


def apply_scale_conf(spark: SparkSession, input_paths, total_cores: int | None = None) -> dict:
    """Size the session for the given input files (sizes from the file system)."""
    jvm = spark.sparkContext._jvm
    hconf = spark.sparkContext._jsc.hadoopConfiguration()
    total = 0
    for p in input_paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        total += path.getFileSystem(hconf).getContentSummary(path).getLength()
    cores = total_cores or spark.sparkContext.defaultParallelism
    conf = scale_conf(total, cores)
    for k, v in conf.items():
        spark.conf.set(k, v)
    return conf
