"""Session builder and the shared folder for written intermediate tables."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

_OWN: list[str] = []
#: Written tables that are still there: path -> (Hadoop file system, Hadoop path).
_WRITTEN: dict[str, tuple] = {}


def _remove(path: str) -> None:
    store = _WRITTEN.pop(path, None)
    if store is not None:
        try:
            store[0].delete(store[1], True)
        except Exception:  # noqa: BLE001 - the JVM may be gone; a table left behind harms no result
            pass


def _remove_written() -> None:
    """At the end of the driver its intermediate tables go, on whatever store they are."""
    for path in list(_WRITTEN):
        _remove(path)


atexit.register(_remove_written)


def discard(*tables: DataFrame) -> None:
    """Deletes tables made by ``written`` whose last reader has run; other frames are left alone."""
    for df in tables:
        _remove(getattr(df, "_written_at", ""))


def build_session(master: str | None = None, app: str = "captionflow", **conf: str) -> SparkSession:
    """A session with the settings the operators rely on; explicit arguments win."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": "false",
    }
    for key, value in {**settings, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Makes this package importable in Python workers; once for an application.

    A probe asks a worker first, as a cluster whose workers have the package on their
    path needs no copy; otherwise an archive of its source files is sent to all executors.
    """
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    scope: dict = {"__name__": "__main__"}
    exec("def probe(_):\n    import importlib.util\n    return importlib.util.find_spec('captionflow') is not None", scope)  # noqa: S102 - pickled by value
    n = max(1, spark.sparkContext.defaultParallelism)
    if not all(spark.sparkContext.parallelize(range(n), n).map(scope["probe"]).collect()):
        folder = os.path.dirname(os.path.abspath(__file__))
        archive = os.path.join(tempfile.mkdtemp(prefix="captionflow-"), "captionflow.zip")
        with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
            for place, _, names in os.walk(folder):
                for name in sorted(names):
                    if name.endswith(".py"):
                        path = os.path.join(place, name)
                        out.write(path, os.path.join("captionflow", os.path.relpath(path, folder)))
        spark.sparkContext.addPyFile(archive)
    _SHIPPED.add(app)


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors can reach, from ``spark.checkpoint.dir``.

    Where it is unset, a temporary folder is made, but only for a local master: a
    machine-local folder on a cluster would lose data with its machine.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not _OWN:
        _OWN.append(tempfile.mkdtemp(prefix="captionflow-"))
        atexit.register(lambda: shutil.rmtree(_OWN[0], ignore_errors=True))
    return "file://" + _OWN[0]


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` to the shared folder and read it back.

    A written table is computed once (a checkpoint computes twice), is compressed,
    and survives the loss of any executor. It goes when the driver ends, or by ``discard``.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._written_at = path
    return back


def scratch(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder, removed when the driver ends."""
    path = os.path.join(shared_folder(spark), "captionflow", f"{name}-{uuid.uuid4().hex}")
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    _WRITTEN[path] = (place.getFileSystem(spark._jsc.hadoopConfiguration()), place)
    return path


def spread(df: DataFrame, key: str, task_bytes: int | None = None) -> DataFrame:
    """Spreads rows by a key over all cores if the input comes in fewer than half as many partitions.

    For steps whose work is far greater than their bytes: a small file is one partition.
    Inputs of many files or row groups are left as they are, so nothing is shuffled at scale, unless
    ``task_bytes`` says how many bytes of input are work enough for a task; then there are as many
    partitions at any size.
    """
    wanted = df.sparkSession.sparkContext.defaultParallelism
    if task_bytes:
        size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
        wanted = max(wanted, -(-size // task_bytes))
    return df.repartition(wanted, key) if 2 * df.rdd.getNumPartitions() <= wanted else df
