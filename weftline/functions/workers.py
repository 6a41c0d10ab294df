"""Code on the workers: the package itself, and what else they can import."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile
from collections.abc import Callable
from pathlib import Path
from typing import Any

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

_PACKAGE = Path(__file__).resolve().parent.parent
_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Lets the workers import this package.

    They can already where its folder is the working folder or on PYTHONPATH, which workers inherit. Elsewhere Spark hands a
    zip of it to every worker, once per application.
    """
    root, app = str(_PACKAGE.parent), spark.sparkContext.applicationId
    seen = [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)]
    if app in _shipped or any(p and os.path.realpath(p) == root for p in seen):
        return
    folder = tempfile.mkdtemp(prefix="weftline-")
    atexit.register(shutil.rmtree, folder, True)
    path = os.path.join(folder, "weftline.zip")
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(_PACKAGE.rglob("*.py")):
            z.write(f, f.relative_to(_PACKAGE.parent))
    spark.sparkContext.addPyFile(path)
    _shipped.add(app)


def on_workers(spark: SparkSession, f: Callable[[], Any], n: int | None = None) -> list[Any]:
    """The distinct answers of a function of no arguments, run on every task of a small job."""
    ship_package(spark)
    n = n or max(2, 2 * spark.sparkContext.defaultParallelism)
    ask = F.udf(lambda _: f(), "string")
    return [r[0] for r in spark.range(0, n, 1, n).select(ask("id").alias("a")).distinct().collect()]


def version_here(name: str) -> str | None:
    """The version of a module where this runs; None where it cannot be imported, an empty text where it has none."""
    from importlib import import_module, metadata

    try:
        module = import_module(name)
    except ImportError:
        return None
    try:
        return metadata.version(name)
    except metadata.PackageNotFoundError:
        return str(getattr(module, "__version__", ""))


def udf_ensure_package_in_spark_workers(name: str) -> Callable[[Any], Column]:
    """A UDF of any column: whether its worker can import the module."""
    return F.udf(lambda _: version_here(name) is not None, "boolean")


def udf_lib_version_in_spark_workers(name: str) -> Callable[[Any], Column]:
    """A UDF of any column: the version of the module on its worker, NULL where it is missing."""
    return F.udf(lambda _: version_here(name), "string")


def lib_in_spark_workers(spark: SparkSession, name: str) -> bool:
    """Whether the workers can import a module; RuntimeError if some can and some cannot."""
    answers = {a is not None for a in on_workers(spark, lambda: version_here(name))}
    if len(answers) > 1:
        raise RuntimeError(f"'{name}' is there on some workers only")
    return answers.pop()


def lib_version_in_spark_workers(spark: SparkSession, name: str) -> str:
    """The version of a module on the workers; RuntimeError if it is missing or differs among them."""
    answers = set(on_workers(spark, lambda: version_here(name)))
    if None in answers:
        raise RuntimeError(f"'{name}' is not there on all workers")
    if len(answers) > 1:
        raise RuntimeError(f"Multiple versions of '{name}': {sorted(answers)}")
    return answers.pop()
