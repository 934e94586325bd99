"""Where tables live: inputs by name, and intermediate tables that cut lineage.

Intermediate tables go to the folder that all executors share, named by
``spark.checkpoint.dir``. Only when the session names none (tests, a laptop) is
a folder made, once per session. What an application writes there is in a folder
of its own, which is deleted when Python ends, or earlier by :func:`clear`.
"""

from __future__ import annotations

import atexit
import contextlib
import pathlib
import shutil
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}
_SHIPPED: set[str] = set()
_USED: dict[str, str] = {}


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once per application, so that their Python workers can import it wherever
    they run."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = pathlib.Path(__file__).parent
    folder = tempfile.mkdtemp(prefix="spanloom-code-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    with zipfile.ZipFile(f"{folder}/spanloom.zip", "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    spark.sparkContext.addPyFile(f"{folder}/spanloom.zip")
    _SHIPPED.add(app)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The input table ``name`` of ``folder`` (one Parquet file or a folder of them)."""
    ship(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The shared folder of the session; one of our own only where none is set."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = tempfile.mkdtemp(prefix="spanloom-")
        atexit.register(shutil.rmtree, _OWN[app], ignore_errors=True)
        spark.sparkContext.setCheckpointDir("file://" + _OWN[app])
    return "file://" + _OWN[app]


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def scratch(spark: SparkSession, label: str) -> str:
    """A path for a table of this application, not there yet, in the shared folder."""
    app = spark.sparkContext.applicationId
    folder = f"{shared_folder(spark)}/spanloom-{app}"
    if app not in _USED:
        _USED[app] = folder

        def leave() -> None:
            with contextlib.suppress(Exception):  # the session may be gone, and its files with it
                clear(spark)

        atexit.register(leave)
    return f"{folder}/{label}-{uuid.uuid4().hex}"


def clear(spark: SparkSession) -> None:
    """Deletes all tables that this application has written to the shared folder. Results that still read them fail
    afterwards, so it is for when they have been written or collected."""
    folder = _USED.get(spark.sparkContext.applicationId)
    if folder:
        _delete(spark, folder)


def materialise(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write ``df`` once into the shared folder and read it back.

    Cuts the lineage and survives the loss of any executor: a later failure
    re-reads the files instead of recomputing what led to them.
    """
    spark = df.sparkSession
    path = scratch(spark, label)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._spanloom_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete the files of a table made by :func:`materialise` that nothing reads any more."""
    path = getattr(df, "_spanloom_path", None)
    if path:
        _delete(df.sparkSession, path)
