"""Session helpers: the local session used by tests/bench and the shared
scratch location that jobs write intermediate tables to.
"""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import SparkSession

# Settings every session of this library relies on. On a cluster these come
# from the submit config; ``local_session`` applies them for tests and bench.
BASE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    # Wide projections (the 47-column flights table) generate methods above
    # the JVM's 8000-byte JIT limit; such stages then run in the bytecode
    # interpreter. With this limit Spark splits them instead (4x faster).
    "spark.sql.codegen.hugeMethodLimit": "8000",
    # remove checkpoint files once their DataFrame is garbage collected
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def local_session(cores: int = 8, shuffle_partitions: int = 8, app: str = "tarmac") -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", "8g")
        # small row groups so that the few-MB test tables still split across
        # all local cores (clusters keep the 128 MB default)
        .config("spark.hadoop.parquet.block.size", str(4 * 1024 * 1024))
        .config("spark.sql.files.minPartitionNum", str(cores))
    )
    for k, v in BASE_CONF.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


@contextmanager
def sql_conf(spark: SparkSession, settings: dict[str, str]) -> Iterator[None]:
    """Run the jobs of the block under these SQL settings, then restore the old ones."""
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors (once a session), so that Python
    workers find it wherever they start; what ``--py-files`` does for a
    submitted job."""
    sc = spark.sparkContext
    if getattr(sc, "_tarmac_shipped", False):
        return
    here = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="tarmac-ship-")) / "tarmac.zip"
    with zipfile.ZipFile(target, "w") as z:
        for f in sorted(here.rglob("*.py")):
            z.write(f, f.relative_to(here.parent))
    sc.addPyFile(str(target))
    sc._tarmac_shipped = True


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``
    as a fully qualified URI.

    On a cluster the folder is provided by the deployment (a shared file
    system every executor can reach) and a session without one is refused.
    Only in local mode, where driver and executors are one process, a private
    folder is created and registered when the setting is absent.
    """
    sc = spark.sparkContext
    d = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not d:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        d = tempfile.mkdtemp(prefix="tarmac-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(d)
    return qualified(spark, d)


def qualified(spark: SparkSession, path: str) -> str:
    """``path`` with the scheme and authority of the file system it is on, so
    that Spark and other readers resolve it alike."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    uri = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(p).toString()
    return "file://" + uri[len("file:"):] if uri.startswith("file:/") and not uri.startswith("file://") else uri


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique folder below the shared checkpoint location."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/tarmac-scratch/{name}-{uuid.uuid4().hex[:12]}"


def release(spark: SparkSession, path: str) -> None:
    """Remove a scratch folder whose contents nothing reads any more."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def cut_lineage(df):
    """Write the data once as Parquet into the shared folder: later stages (a
    fit and its transform) read it, with pruned columns, instead of
    recomputing the input; a lost executor does not lose it."""
    path = scratch_path(df.sparkSession, "cut")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
