"""Steps of a job as tables in the folder that the cluster names."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: The folders of local sessions that name none, by application.
LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir). Only a local session may lack it: it gets a new folder."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        # The setting cannot be changed in a running session, so the folder is remembered here.
        app = spark.sparkContext.applicationId
        where = LOCAL.get(app) or LOCAL.setdefault(app, tempfile.mkdtemp(prefix="cinderline-"))
    return where


def materialise(df: DataFrame) -> DataFrame:
    """Cut the lineage: write to the shared folder and read it again, so that lost executors cost nothing before it."""
    spark = df.sparkSession
    path = f"{steps_dir(spark)}/step-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame) -> DataFrame:
    """Rows dealt to all shuffle partitions, for work that is far dearer than its input is large: a small file is few tasks."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def steps_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/steps-{spark.sparkContext.applicationId}"


def remove_steps(spark: SparkSession) -> None:
    """Deletes this application's steps. To be called once its results are written: what reads them afterwards fails."""
    path = spark._jvm.org.apache.hadoop.fs.Path(steps_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
