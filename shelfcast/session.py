"""SparkSession construction and lineage cutting.

The library never creates a session behind the caller's back; `get_session`
is a convenience for tests, the bench and local runs.  On a cluster the
caller's session is used as is, and the shared checkpoint folder comes from
`spark.checkpoint.dir` (a Spark conf the cluster sets).
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"
SHUFFLE_CLEANUP_CONF = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def get_session(master: str | None = None, app: str = "shelfcast",
                shuffle_partitions: int | None = None,
                driver_memory: str = "8g") -> SparkSession:
    """Local session with AQE on, UI off and UTC session time zone."""
    cores = os.environ.get("BENCH_CPUS") or "8"
    master = master or f"local[{cores}]"
    parts = shuffle_partitions or int(cores) * 2
    spark = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", driver_memory)
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of the session (`spark.checkpoint.dir`).  Where it is
    unset, a scratch folder serves a `local[...]` session, whose executors are
    this process (tests, bench); with real executors it is an error, as a
    folder of the driver would not be seen by them."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get(CHECKPOINT_CONF, None)
    if not configured:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError(f"set {CHECKPOINT_CONF} to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="shelfcast-ckpt-")
        spark.conf.set(CHECKPOINT_CONF, configured)
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    root = spark.conf.get(CHECKPOINT_CONF, None) or ensure_checkpoint_dir(spark)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, conf: dict[str, str] | None = None) -> DataFrame:
    """Write `df` once as a parquet table in the shared checkpoint folder and
    read it back.  Cuts lineage like `checkpoint()`, but computes the input a
    single time and stores it columnar and compressed; later jobs (and retries
    after a lost executor) start from the table.  The write's own shuffle files,
    which nothing reads again, go when it ends.  `conf` holds for the write."""
    spark = df.sparkSession
    path = shared_path(spark, f"tables/{name}")
    wanted = {SHUFFLE_CLEANUP_CONF: "true", **(conf or {})}
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return spark.read.schema(df.schema).parquet(path)


_SHIPPED: set = set()


def ship_package(spark: SparkSession) -> None:
    """Make `shelfcast` importable in Python workers, wherever the driver was
    started: the package is zipped once per SparkContext and distributed with
    `addPyFile` (the `--py-files` mechanism), which pandas UDFs, `mapInPandas`
    and `applyInPandasWithState` need to unpickle their functions."""
    import shutil
    sc = spark.sparkContext
    key = sc.applicationId
    if key in _SHIPPED:
        return
    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    out_dir = tempfile.mkdtemp(prefix="shelfcast-pkg-")
    archive = shutil.make_archive(os.path.join(out_dir, "shelfcast"), "zip",
                                  root_dir=os.path.dirname(pkg_dir), base_dir="shelfcast")
    sc.addPyFile(archive)
    _SHIPPED.add(key)
