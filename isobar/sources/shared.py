"""The folder that driver and executors share, and tables in it that go with the driver."""

from __future__ import annotations

import atexit
import contextlib
import re
import uuid
from collections.abc import Callable

from pyspark.sql import SparkSession

_left: dict[str, Callable[[], None]] = {}


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where that is unset, local mode gets a folder of its own and a cluster an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir is unset; on a cluster it has to name a folder that the driver and all executors share")
        found = "file:///tmp/checkpoints/isobar"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def claim(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; what is written there goes by discard(), or with the driver."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    jvm, conf = spark._jvm, spark._jsparkSession.sessionState().newHadoopConf()

    def delete() -> None:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(conf).delete(at, True)

    _left[path] = delete
    return path


def discard(path: str) -> None:
    """Deletes what claim() gave a path for and nothing reads any more."""
    if delete := _left.pop(path, None):
        delete()


@atexit.register
def discard_all() -> None:
    """Deletes what is left; a driver's end calls it."""
    for path in [*_left]:
        with contextlib.suppress(Exception):  # the JVM may be gone
            discard(path)
