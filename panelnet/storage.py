"""Written tables that cut lineage and survive the loss of executors."""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``, or the one given to setCheckpointDir().

    Only a local master may do without, as in tests: it gets a folder of its own. On a cluster a local folder would be another one on
    every machine, so that is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        master = spark.sparkContext.master
        if master.split("[")[0] != "local":
            raise RuntimeError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="panelnet-"))
        folder = spark.sparkContext.getCheckpointDir()
    return folder.rstrip("/")


def saved(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet into the shared folder and read back: later steps neither recompute it nor depend on one executor."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/panelnet-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if not _made:
        atexit.register(_clean)
    _made.append((spark, path))
    back = spark.read.schema(df.schema).parquet(path)
    back._panelnet_path = path
    return back


def dropped(df: DataFrame) -> None:
    """Deletes the files of a table that saved() returned and nothing will read again."""
    path = getattr(df, "_panelnet_path", None)
    if path:
        _delete(df.sparkSession, path)
        _made[:] = [x for x in _made if x[1] != path]


def collected(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of DataFrames that nothing refers to, which it does when the driver's garbage is collected."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def _delete(spark: SparkSession, path: str) -> None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def _clean() -> None:
    for spark, path in _made:
        try:
            _delete(spark, path)
        except Exception:  # the session has ended; whoever owns the folder clears it
            return
