"""Shared storage: where intermediate tables go, and small files through Hadoop's file systems."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from ..plans.errors import EngineError


#: The folder of each local application that has none set.
LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir). Only where all run on one machine is a local one made if none is set."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local[") and context.master != "local":
        raise EngineError("CONFIGURATION_INVALID", "spark.checkpoint.dir must name a folder that all executors share")
    if context.applicationId not in LOCAL:
        own = tempfile.mkdtemp(prefix="maskwright-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        LOCAL[context.applicationId] = f"file://{own}"
    return LOCAL[context.applicationId]


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write df to the shared folder and read it again."""
    path = f"{shared_dir(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Files:
    """Small files and renames on whatever file system a path is on."""

    def __init__(self, spark: SparkSession):
        self.jvm, self.conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def path(self, path: str):
        found = self.jvm.org.apache.hadoop.fs.Path(str(path))
        return found.getFileSystem(self.conf), found

    def exists(self, path: str) -> bool:
        fs, p = self.path(path)
        return fs.exists(p)

    def is_dir(self, path: str) -> bool:
        fs, p = self.path(path)
        return fs.exists(p) and fs.getFileStatus(p).isDirectory()

    def read(self, path: str) -> bytes:
        fs, p = self.path(path)
        stream = fs.open(p)
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()

    def write(self, path: str, data: bytes, overwrite: bool = False) -> None:
        """Create a file; without overwrite an existing one is an error, which makes it a lock."""
        fs, p = self.path(path)
        stream = fs.create(p, overwrite)
        try:
            stream.write(bytearray(data))
            stream.hflush()
        finally:
            stream.close()

    def rename(self, source: str, target: str) -> None:
        fs, p = self.path(source)
        if fs.exists(self.path(target)[1]) or not fs.rename(p, self.path(target)[1]):
            raise FileExistsError(target)

    def delete(self, path: str) -> None:
        fs, p = self.path(path)
        fs.delete(p, True)

    def free(self, path: str) -> int | None:
        """Bytes left on the file system of a path; None where it doesn't say."""
        fs, _ = self.path(path)
        try:
            left = fs.getStatus().getRemaining()
        except Exception:
            return None
        return None if left <= 0 or left >= (1 << 62) else left

    def list(self, path: str) -> list[tuple[str, int]]:
        """(path relative to the folder, size) of each file below it, hidden ones included, in order."""
        fs, p = self.path(path)
        if not fs.exists(p):
            return []
        root = fs.getFileStatus(p).getPath().toString().rstrip("/") + "/"
        found, files = [], fs.listFiles(p, True)
        while files.hasNext():
            f = files.next()
            found.append((f.getPath().toString().removeprefix(root), f.getLen()))
        return sorted(found)
