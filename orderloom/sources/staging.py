"""Tables written between the steps of a long plan."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_UNSET: dict[str, str] = {}
_OWNED: ContextVar[list[str] | None] = ContextVar("owned", default=None)


def remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables staged inside are deleted at the end; for work whose results are written inside too."""
    owned: list[str] = []
    before = _OWNED.set(owned)
    try:
        yield
    finally:
        _OWNED.reset(before)
        for path in owned:
            remove(spark, path)


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the folder in ``spark.checkpoint.dir``.

    Without the setting local sessions take a fresh folder, others one in the warehouse.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:  # the setting cannot be changed in a running session, so the choice is kept here
        app = spark.sparkContext.applicationId
        if app not in _UNSET:
            local = spark.sparkContext.master.startswith("local[")
            _UNSET[app] = "file://" + tempfile.mkdtemp(prefix="checkpoints-") if local else spark.conf.get("spark.sql.warehouse.dir") + "/_checkpoints"
        root = _UNSET[app]
    path = f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    if (owned := _OWNED.get()) is not None:
        owned.append(path)
    return path


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to a fresh path and read back.

    Steps that use repaired values many times would otherwise be inlined into each
    other until the plan no longer fits the driver; a written table also spares a
    lost executor the recomputation.
    """
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
