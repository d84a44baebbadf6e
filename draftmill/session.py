"""Sessions, and tables that outlive executors."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()
_tables: list[str] = []


def session(name: str = "draftmill", **conf: str) -> SparkSession:
    """A session with UTC times and runtime re-planning; ``conf`` adds or overrides settings."""
    own = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    return SparkSession.builder.appName(name).config(map=own | conf).getOrCreate()


#: Bytes of an Arrow batch that Python workers get at once, so that long texts don't add up.
BATCH_BYTES = 8 << 20


def bound_batches(spark: SparkSession) -> None:
    """Sets ``spark.sql.execution.arrow.maxBytesPerBatch`` to BATCH_BYTES unless the session has its own bound."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, None) is None:
        spark.conf.set(name, str(BATCH_BYTES))


def lean(scan: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``scan`` that gives freed memory back to the system when its task ends, as workers live on between tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from scan(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
            if trim is not None:
                trim(0)

    return run


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: ``spark.checkpoint.dir`` of the session.

    Where it is unset, a local master (tests) gets a temporary folder; a cluster must set it, as a
    machine-local folder would lose rows there.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    own = tempfile.mkdtemp(prefix="draftmill-")
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def table_path(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder, which ``drop_tables`` deletes too."""
    path = f"{shared_dir(spark).rstrip('/')}/draftmill-{tag}-{uuid.uuid4().hex}"
    _tables.append(path)
    return path


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Writes ``df`` as a Parquet table in the shared folder and reads it back, which cuts its lineage.

    Unlike a local checkpoint the table outlives executors.
    """
    spark = df.sparkSession
    path = table_path(spark, tag)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def tables_so_far() -> int:
    """How many tables have been written (or their paths given out); for ``drop_tables``."""
    return len(_tables)


def drop_tables(spark: SparkSession, since: int = 0) -> None:
    """Deletes the tables written after that many. What was made of them must have been written by then."""
    jvm = spark.sparkContext._jvm
    for path in _tables[since:]:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    del _tables[since:]


def ship(spark: SparkSession) -> None:
    """Sends this package to the Python workers, unless they find it by PYTHONPATH or by a local driver's folder."""
    package = Path(__file__).resolve().parent
    root, context = str(package.parent), spark.sparkContext
    local = context.master.startswith("local") and not context.master.startswith("local-cluster")
    if root in os.environ.get("PYTHONPATH", "").split(os.pathsep) or (local and os.path.realpath(os.getcwd()) == root):
        return
    if context.applicationId in _shipped:
        return
    _shipped.add(context.applicationId)
    archive = Path(tempfile.mkdtemp(prefix="draftmill-")) / "draftmill.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    context.addPyFile(str(archive))
