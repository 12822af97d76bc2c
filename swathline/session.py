"""Session factory and the shared-folder helpers every multi-pass operator uses."""

from __future__ import annotations

import os
import tempfile
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession


def get_session(app: str = "swathline", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A UTC session with adaptive execution; cluster settings given outside win."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return (
        b.config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Only where neither the setting nor a checkpoint folder exists (local tests)
    a temporary folder of this machine is set.
    """
    sc = spark.sparkContext
    set_ = sc._jsc.sc().getCheckpointDir()
    if set_.isDefined():
        return set_.get()
    conf = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if conf is None:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        conf = os.path.join(tempfile.gettempdir(), "swathline-shared")
    sc.setCheckpointDir(conf)
    return sc._jsc.sc().getCheckpointDir().get()


def _file(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder, deleted when the driver ends (results read it lazily until then)."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    fs, p = _file(spark, path)
    fs.mkdirs(p)  # a path that is not there is not noted for deletion
    fs.deleteOnExit(p)
    fs.delete(p, True)
    return path


def delete_path(spark: SparkSession, path: str) -> None:
    fs, p = _file(spark, path)
    fs.delete(p, True)


def publish(spark: SparkSession, path: str, text: str) -> bool:
    """Write a small file that nobody has written yet, whole or not at all; False if it is there.

    The text goes to a file of its own that is then renamed: a writer that is killed leaves no half-written file and
    blocks nobody.
    """
    sc = spark.sparkContext
    fs, p = _file(spark, path)
    _, own = _file(spark, f"{path}.{uuid.uuid4().hex}.tmp")
    out = fs.create(own, False)
    out.write(bytearray(text.encode()))
    out.close()
    hadoop = sc._jvm.org.apache.hadoop.fs
    context = hadoop.FileContext.getFileContext(own.getFileSystem(sc._jsc.hadoopConfiguration()).getUri(), sc._jsc.hadoopConfiguration())
    try:
        context.rename(own, p, sc._gateway.new_array(getattr(hadoop, "Options$Rename"), 0))
    except Py4JJavaError as e:
        fs.delete(own, False)
        if "FileAlreadyExists" in e.java_exception.getClass().getName():
            return False
        raise
    return True


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage through the shared folder; survives the loss of executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def partitions_for(spark: SparkSession, rows: int, rows_per_partition: int) -> int:
    """At least the session's shuffle partitions, more once partitions would outgrow their size."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // rows_per_partition))


def spread(df: DataFrame) -> DataFrame:
    """Over all cores, where an input of few files would keep some idle; larger inputs stay where they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.queryExecution().toRdd().getNumPartitions() < cores else df
