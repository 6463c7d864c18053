"""Session settings the library relies on, and the shared staging area.

Only runtime SQL settings are touched, and only those that results or skew
handling depend on. Sizes (shuffle partitions, split sizes, memory) stay with
whoever runs the cluster.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

RUNTIME_SETTINGS = {
    # Results: timestamps are UTC, a later config value wins in a map merge.
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    # Skew: let runtime statistics split hot join partitions, even when the
    # split costs one more exchange for the aggregate above the join.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}

_local_roots: dict[str, str] = {}
_staged: list[str] = []
_namespaces: list[str] = []


def tune(spark: SparkSession) -> SparkSession:
    """Apply the settings above to a running session."""
    for key, value in RUNTIME_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def local_session(cpus: int | str = "*", memory: str = "12g", app: str = "lakeward") -> SparkSession:
    """A single-machine session for tests and the benchmark."""
    partitions = "8" if cpus == "*" else str(cpus)
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", partitions)
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return tune(spark)


def shared_root(spark: SparkSession) -> str:
    """Folder every executor can reach: the session's ``spark.checkpoint.dir``.

    Where that is unset, a temporary folder serves a local master; on a
    cluster a machine-local folder would be wrong, so that is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    return _local_roots.setdefault(
        context.applicationId, tempfile.mkdtemp(prefix="lakeward-")
    )


def fresh_path(spark: SparkSession, label: str) -> str:
    """A new path below the shared folder, remembered for ``release``."""
    path = f"{shared_root(spark)}/lakeward/{label}-{uuid.uuid4().hex}"
    _staged.append(path)
    return path


def stage(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Runs a Spark job when it is called, and so does every function that says it
    stages something. Cuts lineage so that a lost executor rereads files instead of recomputing,
    and gives the optimizer the measured size of the result: a staged side is
    broadcast only when its real size is under ``autoBroadcastJoinThreshold``.
    """
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def delete_path(spark: SparkSession, path: str) -> bool:
    """Delete a path through the file system Spark itself uses."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    return target.getFileSystem(conf).delete(target, True)


def remember_namespace(name: str) -> None:
    """Have ``release`` drop a scratch namespace."""
    _namespaces.append(name)


def release(spark: SparkSession) -> int:
    """Drop scratch namespaces and delete everything staged so far.

    Call it once the readers are done, in a ``finally`` so that a failed job
    leaves nothing behind.
    """
    count = 0
    while _namespaces:
        spark.sql(f"DROP DATABASE IF EXISTS `{_namespaces.pop()}` CASCADE")
    while _staged:
        count += bool(delete_path(spark, _staged.pop()))
    return count
