"""Session defaults and the shared work folder."""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(
    cores: int | str = 8, app: str = "tidefeed", memory: str = "16g", shared: str | None = None
) -> SparkSession:
    """A local session for tests and the bench. A cluster brings its own settings."""
    builder = SparkSession.builder
    if shared:
        builder = builder.config("spark.checkpoint.dir", shared)
    return (
        builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(cores) if str(cores).isdigit() else "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a local session may go without the setting: there, driver and executors share one
    disk, so a temporary folder will do. A cluster without it is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return _local_folder()


@functools.cache
def _local_folder() -> str:
    return tempfile.mkdtemp(prefix="tidefeed-")


def new_folder(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has written to yet.

    All paths of one application lie under its id, so they can go together when it has ended.
    """
    application = spark.sparkContext.applicationId
    return f"{shared_folder(spark)}/tidefeed/{application}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    This cuts the lineage: what follows starts from files that survive a lost executor, and
    several readers see exactly the same rows.
    """
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered_folders(spark: SparkSession, path: str, prefix: str) -> list[int]:
    """Numbers of the completely written ``<prefix><number>`` folders under ``path``."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(folder):
        return []
    done = []
    for status in files.listStatus(folder):
        name = status.getPath().getName()
        marker = spark._jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")
        if name.startswith(prefix) and files.exists(marker):
            done.append(int(name[len(prefix):]))
    return sorted(done)
