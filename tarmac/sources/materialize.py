"""Load-or-build materialised tables (SNK-05) in the shared checkpoint folder.

A table is a folder of builds ``g<generation>-<unique>``. A build is written
by one Spark write into a folder of its own and counts once its ``_SUCCESS``
marker exists; nothing is renamed, and no build that another job may be
reading is ever deleted, so this also holds on object stores. Readers take
the newest generation and, of equal builds, the first by name. A job that
loses a race discards only its own build. Later calls read the parquet back,
which also cuts the lineage of everything built on it.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarmac.session import ensure_checkpoint_dir, sql_conf


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p, jvm


def builds(spark: SparkSession, path: str) -> list[tuple[int, str]]:
    """(-generation, folder) of the finished builds, the one to read first."""
    fs, p, jvm = _fs(spark, path)
    if not fs.exists(p):
        return []
    out = []
    for st in fs.listStatus(p):
        name = st.getPath().getName()
        if name.startswith("g") and fs.exists(jvm.org.apache.hadoop.fs.Path(st.getPath(), "_SUCCESS")):
            out.append((-int(name[1:].split("-")[0]), f"{path}/{name}"))
    return sorted(out)


def finished_folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders below ``path`` that hold a finished write."""
    fs, p, jvm = _fs(spark, path)
    if not fs.exists(p):
        return []
    return [st.getPath().getName() for st in fs.listStatus(p)
            if fs.exists(jvm.org.apache.hadoop.fs.Path(st.getPath(), "_SUCCESS"))]


def exists(spark: SparkSession, path: str) -> bool:
    return bool(builds(spark, path))


def table_path(spark: SparkSession, name: str, *key_parts: str) -> str:
    base = ensure_checkpoint_dir(spark).rstrip("/")
    digest = hashlib.sha1("|".join(key_parts).encode()).hexdigest()[:12]
    return f"{base}/tarmac-tables/{name}-{digest}"


def gathered(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows of equal ``columns`` brought together, large groups split and small ones joined at run
    time by their size (AQE's rebalance): folders get few files, and a hot folder many tasks."""
    return df.hint("rebalance", *[F.col(c) for c in columns])


def small_splits(spark: SparkSession):
    """Jobs that shuffle whole rows read this little of a file per task: Parquet packs millions of
    flights into a default split, and as rows they outgrow a task's memory and spill."""
    return sql_conf(spark, {"spark.sql.files.maxPartitionBytes": str(16 << 20)})


def materialize(spark: SparkSession, path: str, build: Callable[[], DataFrame], refresh: bool = False,
                partition_by: list[str] | None = None, options: dict[str, str] | None = None,
                arranged: bool = False) -> DataFrame:
    """Read ``path`` if it holds a finished table, else build, write, read.

    With ``partition_by`` the table is laid out in folders per value, so
    filters on those columns prune whole folders (PartitionFilters); the
    column order of the built frame is restored on read. Rows are gathered by
    those columns first, in pieces of the advisory partition size, so the
    number of files follows the data and no value is one task's. A build that
    is cheaper to gather and sort before its last steps does so itself and
    says so with ``arranged``. ``options`` go to the Parquet writer.
    """
    path = path.rstrip("/")
    found = builds(spark, path)
    if refresh or not found:
        generation = 1 - found[0][0] if found else 0
        mine = f"{path}/g{generation:06d}-{uuid.uuid4().hex[:12]}"
        df = build()
        if partition_by and not arranged:
            df = gathered(df, partition_by)
        w = (df.write.partitionBy(*partition_by) if partition_by else df.write).options(**(options or {}))
        w.parquet(mine)
        found = builds(spark, path)
        if not refresh and found[0][1] != mine:
            fs, own, _ = _fs(spark, mine)  # another job was first; its table is equivalent
            fs.delete(own, True)
    return spark.read.parquet(found[0][1])


def source_key(sf_dir: str, names: list[str], spark: SparkSession | None = None) -> list[str]:
    """Cache key of a derived table: input paths with their size and
    modification time (through the Hadoop file system, so any storage). A
    missing or unreadable input raises."""
    parts = [sf_dir.rstrip("/")]
    spark = spark or SparkSession.getActiveSession()
    for n in names:
        p = f"{sf_dir.rstrip('/')}/{n}.parquet"
        fs, path, _ = _fs(spark, p)
        st = fs.getContentSummary(path)
        mt = max(f.getModificationTime() for f in fs.listStatus(path)) if fs.getFileStatus(path).isDirectory() \
            else fs.getFileStatus(path).getModificationTime()
        parts.append(f"{n}:{st.getLength()}:{mt}")
    return parts
