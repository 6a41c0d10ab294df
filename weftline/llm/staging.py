"""Tables that cut lineage, in the folder all machines share.

A staged table lives as long as a plan may read it. What a ``scoped`` function has staged is deleted when it returns, but
for the tables that its result reads; those go when an enclosing scoped function returns without them, when ``clean`` is
called after the result was written, or when the driver exits.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable
from functools import wraps
from typing import Any

from py4j.protocol import Py4JError, Py4JNetworkError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions.workers import ship_package

_LOCAL: dict[str, str] = {}


def work_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``.

    Where that is unset, a local session gets a temporary folder of its own, removed at exit; any other master is
    refused, because its machines would not see each other's files.
    """
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = tempfile.mkdtemp(prefix="weftline-")
        atexit.register(shutil.rmtree, _LOCAL[app], True)
    return f"file://{_LOCAL[app]}"


def new_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder, deleted like a staged table."""
    path = f"{work_dir(spark)}/weftline/{name}-{uuid.uuid4().hex}"
    _remember(spark, path)
    return path


def stage(df: DataFrame, name: str, narrow: bool = False) -> DataFrame:
    """Writes ``df`` as Parquet to the shared folder and reads it back: lost executors lose nothing that was staged.

    A ``narrow`` table has few bytes a row (ids, labels, links) and is dealt to two tasks a core at most before it is written, so that
    rounds over it do not leave a file for every shuffle partition; the work before that keeps its own tasks.
    """
    spark = df.sparkSession
    if narrow:
        df = df.repartition(max(2, 2 * spark.sparkContext.defaultParallelism), *[F.col(f"`{c}`") for c in df.columns])  # by a key, which needs no sort
    path = new_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._weftline_path = path
    return out


#: The paths staged by each scoped function that is running, outermost first; those before any, or left by one, come first of all.
_STAGED: list[dict[str, Any]] = [{}]


def _remember(spark: SparkSession, path: str) -> None:
    if not any(_STAGED):
        atexit.register(_delete_all)
    _STAGED[-1][path] = (spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration())


def _delete(path: str) -> None:
    for level in _STAGED:
        if path in level:
            jvm, conf = level.pop(path)
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(conf).delete(at, True)


def discard(df: DataFrame) -> None:
    """Deletes a staged table that no later plan reads."""
    _delete(df._weftline_path)


def sweep(*kept: DataFrame) -> None:
    """Deletes what the running scoped function has staged, but for what the plans of ``kept`` read."""
    read = [f for df in kept for f in df.inputFiles()]
    for path in list(_STAGED[-1]):
        if not any(f"{path.split(':')[-1].lstrip('/')}/" in f for f in read):
            _delete(path)


def clean(spark: SparkSession) -> None:
    """Deletes all that results still read; to be called when they are written."""
    for path in list(_STAGED[0]):
        _delete(path)


def _delete_all() -> None:
    for level in _STAGED:
        for path in list(level):
            try:
                _delete(path)
            except (Py4JError, Py4JNetworkError, OSError):  # the JVM is gone; its own temporary folder, if any, is removed by the driver
                level.pop(path, None)


def scoped(f: Callable) -> Callable:
    """``f``, deleting on return what it has staged and its result, where that is a DataFrame, does not read."""

    @wraps(f)
    def run(*args: Any, **kwargs: Any) -> Any:
        _STAGED.append({})
        try:
            out = f(*args, **kwargs)
            sweep(*([out] if isinstance(out, DataFrame) else []))
            return out
        finally:
            left = _STAGED.pop()
            _STAGED[-1].update(left)

    return run


#: Rows of a batch that goes to a Python worker. Rows are whole documents, so that Spark's 10,000 would be large.
BATCH_ROWS = 1000


def prepare_workers(spark: SparkSession) -> None:
    """Lets Python workers import the package, and from now on gives them batches of BATCH_ROWS rows at most; a smaller setting stays. Spark bounds their bytes too."""
    ship_package(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))
