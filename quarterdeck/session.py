"""Session settings and the shared folder used to pin intermediate tables."""

from __future__ import annotations

import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession

# folders of local sessions that were started without spark.checkpoint.dir
_LOCAL_FOLDERS: dict[str, str] = {}
# where the files of a pinned table are, by the identity of its frame
_PINNED: dict[int, str] = {}


def build_session(app: str = "quarterdeck", master: str | None = None, **conf) -> SparkSession:
    """A session with the settings the operators are written for.

    Join strategy is left to Spark: no operator forces a broadcast, so the size
    check is Spark's own (file or runtime statistics against the broadcast
    threshold) and everything larger is a shuffled join with skew splitting.
    """
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        **conf,
    }
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors can reach, as named by ``spark.checkpoint.dir``.

    Only a local session, whose tasks all run on one machine, may fall back to a
    temporary folder of its own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.conf.get("spark.master", "").startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by the cluster")
    app = spark.conf.get("spark.app.id", "")
    if app not in _LOCAL_FOLDERS:
        _LOCAL_FOLDERS[app] = tempfile.mkdtemp(prefix="quarterdeck-")
    return _LOCAL_FOLDERS[app]


def _run_folder(spark: SparkSession) -> str:
    """The part of the shared folder that belongs to this application alone."""
    return f"{shared_folder(spark)}/quarterdeck/{spark.conf.get('spark.app.id', 'run')}"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in this application's part of the shared folder."""
    return f"{_run_folder(spark)}/{name}-{uuid.uuid4().hex}"


def clear_scratch(spark: SparkSession) -> None:
    """Delete what this application wrote to the shared folder, once its results have been written elsewhere.

    Frames that read pinned tables can't be used afterwards. Other applications' files are not touched.
    """
    _delete(spark, _run_folder(spark))


def pin(df: DataFrame, name: str = "pinned") -> DataFrame:
    """Write ``df`` to the shared folder once and read it back.

    Used where a derived table is read more than once, or where its true size
    must be known before a join: the files give Spark exact statistics, so it
    broadcasts the table only if it is below the threshold. The files also
    survive lost executors.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    pinned = spark.read.schema(df.schema).parquet(path)
    _PINNED[id(pinned)] = path
    weakref.finalize(pinned, _PINNED.pop, id(pinned), None)
    return pinned


def unpin(*frames: DataFrame) -> None:
    """Delete the files of pinned tables that nothing reads any more. Other frames are left alone."""
    for df in frames:
        if path := _PINNED.pop(id(df), None):
            _delete(df.sparkSession, path)


def _delete(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
