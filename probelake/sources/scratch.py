"""A folder for files that queries write and read back."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession

_OWN: list[str] = []


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir``; only a session on one machine may go without that setting."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not _OWN:
            _OWN.append(tempfile.mkdtemp(prefix="probelake-files-"))
            atexit.register(shutil.rmtree, _OWN[0], True)
        root = _OWN[0]
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def move_only_part(spark: SparkSession, folder: str, target: str) -> None:
    """Give the one part file of a written folder a name of its own."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path
    fs = path(folder).getFileSystem(conf)
    part = fs.globStatus(path(f"{folder}/part-*"))[0].getPath()
    fs.mkdirs(path(target).getParent())
    if not fs.rename(part, path(target)):
        raise OSError(f"{part} could not become {target}")
    fs.delete(path(folder), True)
