"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.session import _monkey_patch_RDD


#: The temporary folder of each local application that names none.
_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``.  Where it is unset, a local master gets a temporary folder once for the application; a cluster
    does not, as its executors would write where the driver cannot read."""
    folder = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
    if not folder:
        app = spark.sparkContext.applicationId
        if app not in _LOCAL:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            _LOCAL[app] = f"file://{tempfile.mkdtemp(prefix='tidemark-')}"
            spark.sparkContext.setCheckpointDir(_LOCAL[app])
        folder = _LOCAL[app]
    return folder.rstrip("/")


def materialize(df: DataFrame, tag: str, **options: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage is cut and lost executors lose nothing.

    options are the writer's.  The table goes when the driver's process ends, as what is returned may be read until then.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def in_own_session(df: DataFrame, options: dict[str, str]) -> DataFrame:
    """df in a copy of its session that has some options besides; the caller's session stays as it is."""
    spark = df.sparkSession
    own = SparkSession(spark.sparkContext, spark._jsparkSession.cloneSession())
    _monkey_patch_RDD(spark)  # a new session takes RDD.toDF over: it is the caller's again
    for key, value in options.items():
        own.conf.set(key, value)
    return DataFrame(spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(own._jsparkSession, df._jdf.logicalPlan()), own)


#: Whole texts come in batches of so many rows, as the engine's 10,000 would hold some dozens of megabytes several times over.
TEXT_ROWS = 500


def text_batches(df: DataFrame) -> DataFrame:
    """df, whose Python functions get whole texts, in a session of its own with small Arrow batches; a size that a user has chosen holds."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    return in_own_session(df, {key: str(TEXT_ROWS)} if df.sparkSession.conf.get(key, "10000") == "10000" else {})
