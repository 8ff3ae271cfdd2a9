"""Files that the driver and all executors see: tables that cut lineage, and archives.

The folder is the one that the cluster names in ``spark.checkpoint.dir``. Where the setting is absent (tests on one
machine), a folder below the warehouse is used. Executors may be lost: tables are written by Spark's committer, archive
files under a name of their own and then renamed, so a second attempt replaces the first.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Archives are closed beyond this many bytes; they are streamed, so a writer holds a member at a time.
ARCHIVE_BYTES = 128 << 20
#: Bytes of an Arrow batch on its way to Python: batches of long texts hold fewer rows.
ARROW_BYTES = 4 << 20


def root(spark: SparkSession) -> str:
    """The shared folder as a full URI, so that Spark and a task's own reads and writes mean the same place."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(base)
    whole = str(path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path)).rstrip("/")
    return re.sub("^file:/+", "file:///", whole)


def free(df: DataFrame, *names: str) -> list[str]:
    """The names, or longer ones where a column of the table is called so (case does not count)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def folder(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{root(spark)}/textloom/{name}-{uuid.uuid4().hex}"


def save(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it again: lineage ends, and a lost executor costs no recomputation."""
    path = folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop(*frames: DataFrame) -> None:
    """Delete saved tables that nothing reads any more."""
    for df in frames:
        for file in df.inputFiles()[:1]:
            if "/textloom/" in file:
                discard(df.sparkSession, file.rsplit("/", 1)[0])


def discard(spark: SparkSession, directory: str) -> None:
    """Delete a folder that nothing reads any more."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(directory)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def filesystem(uri: str):
    """(file system, path) of a URI or a plain path, on any machine."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if ":" in uri.split("/")[0] else (fs.LocalFileSystem(), uri)


def bound_batches(spark: SparkSession) -> None:
    """Bound what a Python worker receives at once, for this session."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


class File:
    """A file written as a stream under a name of its own, and renamed when it is whole."""

    def __init__(self, directory: str, name: str):
        self.fs, base = filesystem(directory)
        self.fs.create_dir(base, recursive=True)
        self.trial, self.path, self.uri = f"{base}/.{name}.{uuid.uuid4().hex}", f"{base}/{name}", f"{directory}/{name}"
        self.out, self.at = self.fs.open_output_stream(self.trial), 0

    def write(self, data) -> int:
        self.out.write(data)
        self.at += len(data)
        return len(data)

    def tell(self) -> int:
        return self.at

    def flush(self) -> None:
        pass

    def close(self) -> None:
        self.out.close()
        self.fs.move(self.trial, self.path)


def commit(directory: str, name: str, data) -> str:
    """Write a file as a whole: readers see nothing or all of it, and a second attempt replaces the first."""
    fs, base = filesystem(directory)
    fs.create_dir(base, recursive=True)
    trial = f"{base}/.{name}.{uuid.uuid4().hex}"
    with fs.open_output_stream(trial) as out:
        out.write(data)
    fs.move(trial, f"{base}/{name}")
    return f"{directory}/{name}"
