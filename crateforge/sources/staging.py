"""Tables staged in the shared folder: they cut lineage and outlive lost executors."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

_open = threading.local()
#: The temporary folder of each local application that names none; the setting itself cannot be changed in a running session.
_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The shared folder that the session names in ``spark.checkpoint.dir``; a temporary one only where that is unset on a local master."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        app = spark.sparkContext.applicationId
        if app not in _own:
            _own[app] = tempfile.mkdtemp(prefix="crateforge-")
        found = _own[app]
    return found


def _scopes() -> list[list[tuple[SparkSession, str]]]:
    if not hasattr(_open, "scopes"):
        _open.scopes = []
    return _open.scopes


def stage(df: DataFrame) -> tuple[DataFrame, str]:
    """Write ``df`` as Parquet into the shared folder and read it back; and where it lies."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/crateforge-{uuid.uuid4().hex}"
    if _scopes():
        _scopes()[-1].append((spark, path))
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, path: str) -> None:
    """Delete a staged table through Hadoop's file system, whatever store it is in."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def tidy(operator: Callable) -> Callable:
    """The operator, after which nothing that it staged is left but what its result (a DataFrame or a tuple with some) reads.

    An operator inside another one hands what its result reads to the outer one, which deletes it when it is done; the
    caller of the outermost deletes the rest with the shared folder. If the operator fails, all that it staged goes.
    """

    @wraps(operator)
    def run(*args, **kwargs):
        scope: list[tuple[SparkSession, str]] = []
        _scopes().append(scope)
        needed: set[str] = set()
        try:
            out = operator(*args, **kwargs)
            frames = [x for x in (out if isinstance(out, tuple) else (out,)) if isinstance(x, DataFrame)]
            read = [file for x in frames if scope for file in x.inputFiles()]
            needed = {path for _, path in scope if any(path.rsplit("/", 1)[-1] in file for file in read)}
        finally:
            _scopes().pop()
            for spark, path in scope:
                if path not in needed:
                    discard(spark, path)
                elif _scopes():
                    _scopes()[-1].append((spark, path))
        return out

    return run
