"""Session, table access, durable intermediate tables and guarded broadcasts."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only when its measured bytes stay below this.
BROADCAST_LIMIT_BYTES = 8 << 20
#: Bytes of a row in a broadcast table beside its values.
ROW_OVERHEAD = 48

_local_dirs: dict[str, str] = {}
_written: list[str] = []
_kept: set[str] = set()
_keeping = False
_releases = 0


def session(master: str = "local[8]", partitions: int = 8, **conf: str) -> SparkSession:
    """A session with the settings the library expects (adaptive execution, UTC, Arrow)."""
    builder = SparkSession.builder.master(master).appName("folioscan")
    settings = {
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    } | conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder for intermediate tables: spark.checkpoint.dir, or a temporary one in local mode only."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    key = spark.sparkContext.applicationId
    if key not in _local_dirs:
        _local_dirs[key] = tempfile.mkdtemp(prefix="folioscan-")
    return _local_dirs[key]


def _file_system(spark: SparkSession, path: str) -> tuple:
    """The gateway, the path and its file system, whichever Spark knows it by."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def write_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    """A file of data on any file system Spark knows, in place of one of that name."""
    _, where, files = _file_system(spark, path)
    out = files.create(where, True)
    out.write(bytearray(data))
    out.close()


def exists(spark: SparkSession, path: str) -> bool:
    _, where, files = _file_system(spark, path)
    return files.exists(where)


@contextmanager
def keeping() -> Iterator[None]:
    """Tables written within outlive release_scratch(), as those of an index do that serves many queries."""
    global _keeping
    before, _keeping = _keeping, True
    try:
        yield
    finally:
        _keeping = before


def _delete(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        _, where, files = _file_system(spark, path)
        files.delete(where, True)


def release_scratch(spark: SparkSession) -> None:
    """Delete the intermediate tables of queries whose results have been used; kept tables stay."""
    _delete(spark, [p for p in _written if p not in _kept])
    _written[:] = [p for p in _written if p in _kept]


def release(spark: SparkSession) -> None:
    """Delete all intermediate tables that this process has written. Frames that read them are of no use afterwards."""
    global _releases
    _releases += 1
    _delete(spark, _written)
    _written.clear()
    _kept.clear()


@atexit.register
def _clean() -> None:
    spark = SparkSession.getActiveSession() if _written else None
    if spark is not None:
        try:
            release(spark)
        except Exception:  # the session may be half down at exit
            pass
    for path in _local_dirs.values():
        shutil.rmtree(path, ignore_errors=True)


def generation(spark: SparkSession) -> tuple[str, int]:
    """A key that holds while intermediate tables written now can be read."""
    return spark.sparkContext.applicationId, _releases


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder, deleted as intermediate tables are."""
    path = os.path.join(shared_dir(spark), f"{label}-{uuid.uuid4().hex}")
    _written.append(path)
    if _keeping:
        _kept.add(path)
    return path


def durable(df: DataFrame, label: str = "table", partition_by: str | None = None) -> DataFrame:
    """Write df as a Parquet table in the shared folder, by a column's values if told so, and return a read of it.

    Lineage ends there, so a lost executor costs a re-read of the table and not
    a recomputation of everything before it.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    (df.write.partitionBy(partition_by) if partition_by else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _width(df: DataFrame) -> Column:
    """Bytes of a row as a broadcast table holds it: its overhead, 8 a column, and what strings, binaries and arrays hold."""
    total = F.lit(ROW_OVERHEAD)
    for name, kind in df.dtypes:
        total = total + 8
        if kind in ("string", "binary"):
            total = total + F.coalesce(F.octet_length(F.col(f"`{name}`")), F.lit(0))
        elif kind.startswith(("array", "map", "struct")):
            total = total + F.coalesce(F.octet_length(F.to_json(F.struct(F.col(f"`{name}`")))), F.lit(0))
    return total


def broadcast_if_small(df: DataFrame, row_bytes: int = 0, limit: int = BROADCAST_LIMIT_BYTES) -> DataFrame:
    """Mark df for broadcast when its measured bytes fit the limit; otherwise leave the choice to the planner.

    Rows are counted up to the limit and strings by their real lengths, each row
    as row_bytes at least. df should be cheap to count (a durable table or a plain scan).
    """
    least = max(row_bytes, ROW_OVERHEAD + 8 * len(df.columns))
    most = max(1, limit // least)
    seen = df.limit(most + 1).agg(F.count(F.lit(1)), F.sum(F.greatest(F.lit(least), _width(df)))).first()
    return F.broadcast(df) if seen[0] <= most and (seen[1] or 0) <= limit else df
