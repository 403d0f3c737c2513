"""Files of whatever store Spark reads: whether they are there, and where tables in between go."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _path(spark: SparkSession, path: str) -> tuple:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str | None) -> bool:
    if not path:
        return False
    where, fs = _path(spark, path)
    return fs.exists(where)


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder beside the checkpoints, removed when the application ends."""
    import uuid

    context = spark.sparkContext
    folder = context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        checkpointed(spark.range(1))
        folder = context.getCheckpointDir()
    path = f"{folder.rstrip('/')}/sitelens-{name}-{uuid.uuid4().hex}"
    where, fs = _path(spark, path)
    fs.deleteOnExit(where)
    return path


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the folder that ``spark.checkpoint.dir`` names. Where the session names none, a local one is made, in local mode only."""
    spark = df.sparkSession
    context = spark.sparkContext
    if not context.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(folder or f"file://{tempfile.mkdtemp(prefix='sitelens-')}")
    return df.checkpoint(eager=True)


def store_of(uri: str) -> tuple:
    """pyarrow's file system of a path, and the path there."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def there(uri: str | None) -> bool:
    """Whether a path is a file of a store that pyarrow knows."""
    from pyarrow import fs

    if not uri:
        return False
    store, path = store_of(uri)
    return store.get_file_info(path).type == fs.FileType.File


def write_bytes(uri: str, data: bytes) -> None:
    """Under a temporary name first, so that no reader sees half a file."""
    store, path = store_of(uri)
    store.create_dir(path.rpartition("/")[0], recursive=True)
    with store.open_output_stream(f"{path}.tmp") as out:
        out.write(data)
    store.move(f"{path}.tmp", path)


def read_text(uri: str) -> str:
    store, path = store_of(uri)
    with store.open_input_stream(path) as f:
        return f.read().decode()


def list_files(spark: SparkSession, folder: str, suffix: str = "") -> DataFrame:
    """``path``, ``length`` of files with a suffix, empty ones too, which Spark's scans leave out.

    The driver sees the names in the folder itself only; what is below its folders is listed by tasks, a folder each.
    """
    from pyarrow import fs

    store, path = store_of(folder)
    found = store.get_file_info(fs.FileSelector(path, allow_not_found=True))
    prefix = folder.rstrip("/") if "://" in folder or folder.startswith("file:") else f"file://{folder.rstrip('/')}"
    own = [(f"{prefix}/{f.base_name}", f.size) for f in found if f.type == fs.FileType.File and f.base_name.endswith(suffix)]
    top = spark.createDataFrame(own, "path string, length long")
    below = [(f"{prefix}/{f.base_name}",) for f in found if f.type == fs.FileType.Directory]
    if not below:
        return top

    def listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for uri in batch["folder"]:
                store, at = store_of(uri)
                files = [f for f in store.get_file_info(fs.FileSelector(at, recursive=True)) if f.type == fs.FileType.File and f.path.endswith(suffix)]
                yield pd.DataFrame({"path": [uri + f.path[len(at) :] for f in files], "length": [f.size for f in files]}).astype({"path": object, "length": "int64"})

    folders = spark.createDataFrame(below, "folder string").repartition(min(len(below), 10_000))
    return top.unionByName(folders.mapInPandas(listed, "path string, length long"))


def copy_files(files: DataFrame) -> DataFrame:
    """Copies ``source`` to ``target`` of each row, in tasks; gives ``target`` and ``bytes``. Rows that share a target: the last source by name is copied."""

    def copied(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sizes = []
            for source, target in zip(batch["source"], batch["target"], strict=True):
                store, path = store_of(source)
                with store.open_input_stream(path) as f:
                    data = f.read()
                write_bytes(target, data)
                sizes.append(len(data))
            yield pd.DataFrame({"target": batch["target"], "bytes": sizes})

    one = files.groupBy("target").agg(F.max("source").alias("source"))
    return checkpointed(one.mapInPandas(copied, "target string, bytes long"))
