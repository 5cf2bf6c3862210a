"""What every part needs from the session: tables, lineage cuts and the package on the executors."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()
_OWN: dict[str, str | None] = {}
_SCOPES: list[list[str]] = []
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table `name` of a data folder, read by Spark so that any store it knows will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(df: DataFrame) -> DataFrame:
    """An input of fewer partitions than the cluster has cores, dealt out to all of them; any other one as it is.

    A small file is read by one task; what follows may cost far more than moving it."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once a session: they may not share the driver's folders."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="skarn-"), "skarn_code.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(root):
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.join("skarn", os.path.relpath(full, root)))
    sc.addPyFile(path)
    _SHIPPED.add(sc.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Only where driver and executors are one process, as in tests,
    a temporary folder takes its place; on a cluster each executor would write to its own disk."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir is not set: name a folder that driver and executors share")
        app = spark.sparkContext.applicationId
        found = _OWN.setdefault(app, None) or "file://" + tempfile.mkdtemp(prefix="skarn-shared-")
        _OWN[app] = found
    return found


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/skarn-{name}-{uuid.uuid4().hex}"


def goes_with_session(spark: SparkSession, path: str) -> None:
    """What has been written to the path is removed when the driver ends."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)


def removed(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that are written inside are removed at its end, but for those that are kept for the one who called."""
    _SCOPES.append([])
    try:
        yield
    finally:
        for path in _SCOPES.pop():
            removed(spark, path)


@contextmanager
def _set(spark: SparkSession, conf: dict[str, str]) -> Iterator[None]:
    before = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def filtered_early(spark: SparkSession):
    """While this holds, a join of a large side with a `marked` one drops most of what will not match before the shuffle.

    Spark makes a Bloom filter of the marked side, of a few megabytes whatever its size; the join itself stays exact."""
    conf = "spark.sql.optimizer.runtime.bloomFilter."
    return _set(spark, {f"{conf}enabled": "true", f"{conf}applicationSideScanSizeThreshold": "1b", f"{conf}creationSideThreshold": "1g", f"{conf}expectedNumItems": "4000000"})


def concurrent_writers(spark: SparkSession):
    """While this holds, a write by a few values of a column keeps a file open for each instead of sorting all rows."""
    return _set(spark, {"spark.sql.maxConcurrentOutputFileWriters": "8"})


def marked(df: DataFrame, key: str) -> DataFrame:
    """The frame under a condition on its key (long) that always holds: Spark filters by sides that have a condition."""
    return df.where(f"{key} >= -9223372036854775808")


def written(df: DataFrame, name: str = "table", keep: bool = False) -> DataFrame:
    """Cuts the lineage: writes the frame to the shared folder and reads it back.

    A lost executor then costs a re-read, never a recomputation of what lies before. The shuffle files behind it are of
    no use any more, so Spark removes them at the end of the write instead of at some later garbage collection. The table
    itself goes with the innermost `scratch`, with the one around it if it is kept, or else with the session."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    scope = _SCOPES[: len(_SCOPES) - keep]
    if scope:
        scope[-1].append(path)
    with _set(spark, {_CLEANUP: "true"}):
        df.write.parquet(path)
    goes_with_session(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
