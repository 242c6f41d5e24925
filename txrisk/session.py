"""Session defaults and the shared scratch folder."""

import atexit
import functools
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(app_name="txrisk", master=None, **conf):
    """A session with this package's defaults; anything given in ``conf`` wins.

    Shuffle partition counts, memory and the like are left to the cluster's own settings.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


@functools.cache
def _own_folder():
    folder = tempfile.mkdtemp(prefix="txrisk-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def scratch_path(spark, name):
    """A fresh path below the folder the cluster names in ``spark.checkpoint.dir``.

    Paths of one application share a parent, so they can be removed together when it is done. On a
    cluster the setting is needed, as no folder of the driver's own would reach the executors. A
    ``local`` session, whose one process is driver and executors, may do without: it then has a
    folder of its own until it ends.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = _own_folder()
    application = spark.sparkContext.applicationId
    return f"{base.rstrip('/')}/txrisk/{application}/{name}-{uuid.uuid4().hex}"


def clear_scratch(spark):
    """Removes what this application stored below the shared folder; its tables end with it."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(scratch_path(spark, "x")).getParent()
    files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return files.delete(folder, True)


def written(df, name, *partition_columns):
    """Write ``df`` to the shared scratch folder and read it back.

    Cuts the lineage with a table every executor can reach again after a loss.
    """
    path = scratch_path(df.sparkSession, name)
    writer = df.write.partitionBy(*partition_columns) if partition_columns else df.write
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
