"""Session and table helpers shared by queries, tests and the benchmark."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = 8, memory: str = "8g") -> SparkSession:
    """A local session; a cluster run uses the session it is given instead."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("opweave")
        .config("spark.driver.memory", os.environ.get("OPWEAVE_MEMORY", memory))
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables; Spark resolves the path, so any store it can read will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared(spark: SparkSession) -> str:
    """The folder that driver and executors share, ``spark.checkpoint.dir``. Only a local session may go without:
    it has one made, as driver and executors are one process there."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None) or getattr(sc, "_opweave_shared", None)
    if not found:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = sc._opweave_shared = tempfile.mkdtemp(prefix="opweave-")
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(found)
    return found.rstrip("/")


def written(df: DataFrame) -> DataFrame:
    """The same rows, read back from Parquet in the shared folder; the lineage ends here, and a lost executor
    costs nothing that came before."""
    spark = df.sparkSession
    path = f"{shared(spark)}/{uuid.uuid4().hex}.parquet"
    schema = df.schema
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Removes the files of a frame that ``written`` gave, once nothing reads them any more."""
    sc = df.sparkSession.sparkContext
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = sc._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)
