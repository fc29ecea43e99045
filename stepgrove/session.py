"""Session helpers: a local session for tests and benches, and the checkpoint folder."""

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Observation, SparkSession
from pyspark.sql import functions as F

#: (application, folder) pairs whose folder the executors were seen to share.
_SHARED = set()


def local_session(cores="*", shuffle_partitions=8, name="stepgrove"):
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )


def _is_shared(spark, folder):
    """Whether the driver finds what tasks write below ``folder``: one row per core is written and counted."""
    rows = spark.sparkContext.defaultParallelism
    path = f"{folder}/probe-{uuid.uuid4().hex}"
    spark.range(0, rows, 1, rows).write.parquet(path)
    found = spark.read.schema("id bigint").parquet(path).count()
    drop_table(spark, path)
    return found == rows


def _qualified(spark, folder):
    """``folder`` with its file system; a path alone lies on Hadoop's default one, as everywhere in Spark.

    If that is the local disk, the folder must be a shared mount; this is tried once, so that no rows get lost.
    """
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    if place.toUri().getScheme():
        return folder
    full = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(place).toString()
    seen = (spark.sparkContext.applicationId, full)
    if full.startswith("file:") and seen not in _SHARED:
        if not _is_shared(spark, full):
            raise ValueError(f"spark.checkpoint.dir is not shared with the executors: {folder}")
        _SHARED.add(seen)
    return full


def checkpoint_folder(spark):
    """The folder named by ``spark.checkpoint.dir``.

    A cluster must name a shared one, by its file system (``hdfs://``, ``s3a://``, ``file://`` of a shared mount) or by a
    path on the default file system. A single-process master that names none gets a folder of its own, which goes when
    the process ends.
    """
    master = spark.conf.get("spark.master", "")
    single = master == "local" or master.startswith("local[")
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured if single else _qualified(spark, configured)
    if not single:
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    folder = tempfile.mkdtemp(prefix="stepgrove-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def drop_table(spark, path):
    """Delete a stored table that nothing reads any more."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def store(df, partition_by=()):
    """Write ``df`` below the checkpoint folder. Returns (path, number of rows).

    A written table cuts lineage, survives lost executors, and gives later joins its real size.
    """
    path = f"{checkpoint_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("rows")).write.partitionBy(*partition_by).parquet(path)
    return path, seen.get["rows"]


def materialize(df, partition_by=()):
    """``df`` written out and read back."""
    path, _ = store(df, partition_by)
    return df.sparkSession.read.schema(df.schema).parquet(path)
