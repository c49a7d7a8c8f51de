"""Scans of trees of files, of a version-controlled snapshot, and of single objects."""

from __future__ import annotations

import os
import subprocess

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


def scan_tree(spark: SparkSession, root: str, glob: str | None = None, with_content: bool = True) -> DataFrame:
    """path, length, modificationTime (and content) of all files under a folder; contents are read by the executors."""
    r = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        r = r.option("pathGlobFilter", glob)
    df = r.load(root)
    return df if with_content else df.drop("content")


def with_hash(files: DataFrame) -> DataFrame:
    """A scan with the XXH64 of each file's bytes."""

    @F.pandas_udf("string")
    def digest(s):
        import xxhash

        return s.map(lambda b: None if b is None else xxhash.xxh64_hexdigest(bytes(b)))

    return files.withColumn("file_hash", digest("content"))


def get_object(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path)


def delete_object(spark: SparkSession, path: str) -> bool:
    """Remove an object; says whether it was there."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, False)


class _Repo(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _SnapshotReader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths = [p for p in options.get("path", "").split(os.pathsep) if p]

    def partitions(self):
        return [_Repo(p) for p in self.paths]

    def read(self, partition):
        out = subprocess.run(["git", "-C", partition.path, "ls-tree", "-r", "-z", "HEAD"], capture_output=True, check=True).stdout
        for entry in out.split(b"\0"):
            if entry:
                meta, _, name = entry.partition(b"\t")
                mode, kind, sha = meta.split()
                if kind == b"blob":
                    yield (partition.path, name.decode("utf-8", "replace"), sha.decode())


class GitSnapshot(DataSource):
    """`spark.read.format("git_snapshot").load("/repo")`: repo_path, file_path, file_hash at HEAD, one task per repository."""

    @classmethod
    def name(cls):
        return "git_snapshot"

    def schema(self):
        return "repo_path string, file_path string, file_hash string"

    def reader(self, schema):
        return _SnapshotReader(self.options)
