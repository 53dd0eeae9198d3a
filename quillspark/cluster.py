"""What a query needs from the cluster it runs on: the shared folder, written tables, the package on the executors."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterable, Iterator
from contextlib import contextmanager, suppress
from pathlib import Path

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()
_FOLDERS: dict[str, str] = {}
_LATEST: list[list[str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors see.

    It is the one in ``spark.checkpoint.dir``. Where that is unset, a local master gets a
    temporary folder; any other master has to be told, as no default is sure to be shared.
    """
    app = spark.sparkContext.applicationId
    if app not in _FOLDERS:
        base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
        if not base:
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors see")
            base = "file://" + tempfile.mkdtemp(prefix="quillspark-")
            spark.sparkContext.setCheckpointDir(base)
        _FOLDERS[app] = f"{base.rstrip('/')}/quillspark-{uuid.uuid4().hex[:12]}"
    return _FOLDERS[app]


def written(df: DataFrame, name: str) -> DataFrame:
    """The same rows, written to the shared folder and read again: later jobs start from the files."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    for noted in _LATEST:
        noted.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def noting() -> Iterator[list[str]]:
    """Collects the paths of the tables that are written meanwhile."""
    paths: list[str] = []
    _LATEST.append(paths)
    try:
        yield paths
    finally:
        _LATEST.remove(paths)


def roots(df: DataFrame) -> list[str]:
    """The paths that a table is read from, as they were given; not those of each file."""
    leaves, out = df._jdf.queryExecution().analyzed().collectLeaves(), []
    for k in range(leaves.size()):
        with suppress(Py4JError):  # other leaves than tables of files
            paths = leaves.apply(k).relation().location().rootPaths()
            out += [paths.apply(n).toString() for n in range(paths.size())]
    return out


def drop(spark: SparkSession, paths: Iterable[str]) -> None:
    """Delete tables that written() made and nothing reads any more."""
    for each in paths:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(each)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Delete what written() has left for this application."""
    folder = _FOLDERS.pop(spark.sparkContext.applicationId, None)
    if folder:
        drop(spark, [folder])


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the executors' Python workers, once for each application."""
    app = spark.sparkContext.applicationId
    if app not in _SHIPPED:
        root = Path(__file__).resolve().parent
        target = os.path.join(tempfile.mkdtemp(prefix="quillspark-zip-"), "quillspark.zip")
        with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as out:
            for p in sorted(root.rglob("*.py")):
                out.write(p, f"quillspark/{p.relative_to(root)}")
        spark.sparkContext.addPyFile(target)
        _SHIPPED.add(app)
    return spark


def small_batches(spark: SparkSession, most: int = 4 << 20) -> None:
    """Batches that go to Python end at so many bytes, unless the session has a limit of its own. The JVM and the worker both hold a whole batch, of up to 64 MB by default."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name) == "67108864b":  # Spark's default; a value that was set comes back as it was given
        spark.conf.set(name, str(most))
