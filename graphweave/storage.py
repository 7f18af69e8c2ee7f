"""Files in the folder that driver and executors share, through the file system that the path names."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid
from urllib.parse import unquote, urlparse

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a local session without one gets a temporary folder until Python ends."""
    place = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not place:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        own = tempfile.mkdtemp(prefix="graphweave-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        place = f"file://{own}"
        spark.conf.set("spark.checkpoint.dir", place)
    return place.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing uses yet."""
    return join_path(shared_dir(spark), "graphweave", f"{name}-{uuid.uuid4().hex}")


def written(df: DataFrame, name: str) -> DataFrame:
    """df as Parquet in the shared folder, read back: its lineage ends there."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def join_path(*parts: str) -> str:
    return "/".join([parts[0].rstrip("/"), *(p.strip("/") for p in parts[1:])])


def _place(spark: SparkSession, path: str) -> tuple:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def listed(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, none if it isn't there."""
    p, fs = _place(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def read_text(spark: SparkSession, path: str) -> str:
    p, fs = _place(spark, path)
    stream = fs.open(p)
    try:
        return bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


def delete(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        p, fs = _place(spark, path)
        fs.delete(p, True)


def create_once(spark: SparkSession, path: str, text: str) -> bool:
    """Creates a file with its whole text; False, and nothing done, if it is there. Of several callers one succeeds."""
    p, fs = _place(spark, path)
    fs.mkdirs(p.getParent())
    draft = f"{path}.{uuid.uuid4().hex}.tmp"
    q, _ = _place(spark, draft)
    stream = fs.create(q, False)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    try:
        if fs.getScheme() == "file":  # renaming there overwrites; a link doesn't
            local = lambda x: unquote(urlparse(x).path) if x.startswith("file:") else x
            try:
                os.link(local(draft), local(path))
                return True
            except FileExistsError:
                return False
        if fs.exists(p):
            return False
        return bool(fs.rename(q, p))
    finally:
        fs.delete(q, False)
