"""Session, shared scratch space and staged tables.

Everything that must outlive a stage (iteration state, tables read more than
once) is written below the folder named by ``spark.checkpoint.dir``, which all
executors share.  ``get_spark`` names one for a local master; a session without the
setting on any other master is refused, as its executors would share no folder.
"""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_fallback: dict[str, str] = {}
_written: list[tuple[SparkSession, str]] = []
_CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def get_spark(app: str = "claimloom", master: str = "local[8]", partitions: int = 8) -> SparkSession:
    """A session with the settings the library is written for."""
    builder = SparkSession.builder.master(master)
    if re.match(r"local(\[|$)", master):
        builder = builder.config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="claimloom-"))
    return (
        builder
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def scratch_dir(spark: SparkSession) -> str:
    """The shared scratch folder of this session."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/") + "/claimloom"
    master = spark.sparkContext.master
    if not re.match(r"local(\[|$)", master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if spark.sparkContext.applicationId not in _fallback:
        _fallback[spark.sparkContext.applicationId] = tempfile.mkdtemp(prefix="claimloom-")
    return _fallback[spark.sparkContext.applicationId]


def _delete(spark: SparkSession, path: str) -> None:
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop_path, True)


@atexit.register
def _clean_up() -> None:
    for spark, path in _written:
        try:
            _delete(spark, path)
        except Exception:  # the session may already be gone
            return


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new folder name in the scratch folder, deleted at exit."""
    path = f"{scratch_dir(spark)}/{label}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


class Staged:
    """A table written to the scratch folder, which cuts the lineage.

    A lost executor costs nothing, since the files live in the shared folder.
    ``drop`` removes the files once a later stage replaced them.  With ``release`` the
    shuffle files of the write go as soon as it is done, not when the driver happens to
    collect its garbage.
    """

    def __init__(self, df: DataFrame, label: str = "stage", partition: str | None = None, release: bool = False) -> None:
        self.spark = df.sparkSession
        self.path = scratch_path(self.spark, label)
        before = self.spark.conf.get(_CLEAN_UP, "false")
        if release:
            self.spark.conf.set(_CLEAN_UP, "true")
        try:
            (df.write.partitionBy(partition) if partition else df.write).parquet(self.path)
        finally:
            if release:
                self.spark.conf.set(_CLEAN_UP, before)
        self.schema = df.schema

    @property
    def df(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)

    def drop(self) -> None:
        _delete(self.spark, self.path)
        _written.remove((self.spark, self.path))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one input table of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
