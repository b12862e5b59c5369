"""The folder that driver and executors share, and files and tables in it."""

from __future__ import annotations

import atexit
import contextlib
import mmap
import os
import shutil
import tempfile
import uuid
from urllib.parse import unquote, urlparse

import numpy as np
from pyspark.sql import DataFrame, SparkSession


def fresh(columns: list[str], *added: str) -> None:
    """Raise ValueError if a column that is to be added is there already; Spark's names don't differ by case."""
    there = {c.lower() for c in columns}
    if clash := [c for c in added if c.lower() in there]:
        raise ValueError(f"columns exist already: {clash}")


def inner_name(columns: list[str], name: str) -> str:
    """A name for a column of the operator's own that none of columns has."""
    there = {c.lower() for c in columns}
    while name.lower() in there:
        name += "_"
    return name


def shared_dir(spark: SparkSession) -> str:
    """URI of the folder in spark.checkpoint.dir; one is set only where that is unset (local runs and tests)."""
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if base:
        return base.rstrip("/")
    if not sc.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    own = tempfile.mkdtemp(prefix="binmap-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    sc.setCheckpointDir(own)
    spark.conf.set("spark.checkpoint.dir", f"file://{own}")
    return f"file://{own}"


def new_folder(spark: SparkSession, name: str) -> str:
    """URI of a fresh folder for one run of one operator. All folders of an application are removed when its driver ends."""
    own = f"{shared_dir(spark)}/binmap/{spark.sparkContext.applicationId}"
    if own not in _OWN:
        _OWN.add(own)
        atexit.register(_remove, own)
    return f"{own}/{name}-{uuid.uuid4().hex}"


_OWN: set[str] = set()


def _remove(uri: str) -> None:
    """Remove a folder as far as it can be."""
    with contextlib.suppress(Exception):
        if (path := _local(uri)) is not None:
            shutil.rmtree(path, ignore_errors=True)
        else:
            from pyarrow import fs

            store, path = fs.FileSystem.from_uri(uri)
            store.delete_dir(path)


#: Files for each core of a table that is written again and again, at least a quarter of the shuffle's partitions.
FILES_PER_CORE = 8


def written(df: DataFrame, name: str, again: bool = False) -> DataFrame:
    """df as a table in the shared folder: lineage is cut, and the files outlive any executor.

    again: one of many narrow tables behind a shuffle, as in rounds of an iteration. It gets fewer files: small ones cost more to make
    than to fill, as each needs folders and permissions, which local file systems set by processes of their own.
    """
    spark = df.sparkSession
    path = new_folder(spark, name)
    if again:
        df = df.coalesce(max(FILES_PER_CORE * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")) // 4))
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _local(uri: str) -> str | None:
    parts = urlparse(uri)
    return unquote(parts.path) if parts.scheme in ("", "file") else None


def write_file(uri: str, chunks) -> int:
    """Write byte chunks to a file that appears whole or not at all; a retried task replaces it by the same bytes."""
    n = 0
    if (path := _local(uri)) is not None:
        os.makedirs(os.path.dirname(path), exist_ok=True)
        part = f"{path}.{uuid.uuid4().hex}.tmp"
        try:
            with open(part, "wb") as out:
                for chunk in chunks:
                    n += out.write(chunk)
            os.replace(part, path)
        finally:
            with contextlib.suppress(FileNotFoundError):
                os.remove(part)
        return n
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    store.create_dir(path.rpartition("/")[0], recursive=True)
    part = f"{path}.{uuid.uuid4().hex}.tmp"
    with store.open_output_stream(part) as out:
        for chunk in chunks:
            out.write(chunk)
            n += len(chunk)
    store.move(part, path)
    return n


def open_file(uri: str):
    """A seekable binary reader of a shared file."""
    if (path := _local(uri)) is not None:
        return open(path, "rb")
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    return store.open_input_file(path)


def map_array(uri: str, dtype) -> np.ndarray:
    """A read-only array over a memory-mapped shared file; a remote file is first copied to an unlinked scratch file."""
    with contextlib.ExitStack() as held:
        if (path := _local(uri)) is not None:
            f = held.enter_context(open(path, "rb"))
        else:
            f = held.enter_context(tempfile.TemporaryFile())
            with open_file(uri) as src:
                shutil.copyfileobj(src, f, 1 << 22)
            f.flush()
        if os.fstat(f.fileno()).st_size == 0:
            return np.empty(0, dtype)
        return np.frombuffer(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ, trackfd=False), dtype)  # holds no descriptor: many may be mapped
