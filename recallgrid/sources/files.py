"""Scans of folders and delimited text, and the partitioned sink of an index."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Folders that a scan leaves out; fixed values.
SKIPPED = (".git", "node_modules", "dist", ".turbo")


KINDS = "path string, length long, modified timestamp, content binary"
#: Folders that a partition of a scan is one of, where there are so many.
SPREAD = 64


@dataclass
class Below(InputPartition):
    """A folder of a scan, how deep it lies, and whether what lies below it is part of the partition too."""

    folder: str
    depth: int
    whole: bool


class FolderReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root, self.skipped = options["path"], set(options["skipped"].split("/"))
        self.most_bytes, self.most_depth = int(options["maxbytes"]), int(options["maxdepth"])

    def entries(self, folder: str, depth: int) -> tuple[list[str], list[os.DirEntry]]:
        """The folders to go on with and the files to read. Links aren't followed, and nothing but regular files is opened."""
        with os.scandir(folder) as found:
            kept = sorted((e for e in found if not e.is_symlink() and e.name not in self.skipped), key=lambda e: e.name)
        folders = [e.path for e in kept if e.is_dir(follow_symlinks=False)] if depth < self.most_depth else []
        return folders, [e for e in kept if e.is_file(follow_symlinks=False) and e.stat(follow_symlinks=False).st_size <= self.most_bytes]

    def partitions(self) -> list[Below]:
        """Goes down a level at a time until there are enough folders; only names are read here."""
        if os.path.isfile(self.root):
            return [Below(self.root, 0, False)]
        done, level, depth = [], [self.root], 1
        while level and len(level) < SPREAD:
            done += [Below(f, depth, False) for f in level]
            level, depth = [x for f in level for x in self.entries(f, depth)[0]], depth + 1
        return done + [Below(f, depth, True) for f in level]

    def read(self, partition: Below) -> Iterator[tuple]:
        if os.path.isfile(partition.folder):
            found = os.stat(partition.folder)
            if found.st_size <= self.most_bytes:
                yield self.row(partition.folder, found)
            return
        queue = [(partition.folder, partition.depth)]
        while queue:
            folder, depth = queue.pop()
            folders, files = self.entries(folder, depth)
            queue += [(f, depth + 1) for f in folders] if partition.whole else []
            for e in files:
                yield self.row(e.path, e.stat(follow_symlinks=False))

    @staticmethod
    def row(path: str, found: os.stat_result) -> tuple:
        with open(path, "rb") as file:
            return path, found.st_size, datetime.fromtimestamp(found.st_mtime, tz=UTC), file.read()


class FolderSource(DataSource):
    """Files below a folder that all machines see, with its options maxBytes, maxDepth and skipped, names parted by /."""

    @classmethod
    def name(cls) -> str:
        return "folder"

    def schema(self) -> str:
        return KINDS

    def reader(self, schema) -> FolderReader:
        return FolderReader({k.lower(): v for k, v in self.options.items()})


def scan_folder(spark: SparkSession, path: str, *, max_bytes: int = 10 << 20, max_depth: int = 16, skipped: tuple[str, ...] = SKIPPED) -> DataFrame:
    """(path, length, modified, fingerprint, content) of the regular files under ``path``: not in or named like skipped ones, not
    behind links, not deeper than max_depth, not larger than max_bytes. What is left out is never opened: folders are listed in
    tasks. A path of another scheme than file is listed by Spark, and names and sizes are filtered before contents are read."""
    local = re.sub("^file:/*", "/", path)
    if "://" not in local:
        spark.dataSource.register(FolderSource)
        files = spark.read.format("folder").options(maxBytes=max_bytes, maxDepth=max_depth, skipped="/".join(skipped)).load(local)
        return files.select("path", "length", "modified", F.sha2("content", 256).alias("fingerprint"), "content")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    root = re.escape(re.sub("^[a-z]+:/*", "/", path.rstrip("/")))
    below = F.regexp_replace(F.regexp_replace("path", "^[a-z]+:/*", "/"), f"^{root}", "")
    parts = F.filter(F.split(below, "/"), lambda p: p != "")
    kept = files.where((F.col("length") <= max_bytes) & (F.size(parts) <= max_depth) & ~F.arrays_overlap(parts, F.array(*map(F.lit, skipped))))
    return kept.select("path", "length", F.col("modificationTime").alias("modified"), F.sha2("content", 256).alias("fingerprint"), "content")


def read_delimited(spark: SparkSession, path: str, columns: int) -> DataFrame:
    """(cells array<string>) of the lines of delimited text: short lines are filled with nulls, empty lines left out."""
    names = [f"c{i}" for i in range(columns)]
    schema = ", ".join(f"{n} string" for n in names)
    table = spark.read.schema(schema).option("mode", "PERMISSIVE").option("ignoreLeadingWhiteSpace", False).csv(path)
    return table.select(F.array(*names).alias("cells")).where(F.exists("cells", lambda c: c.isNotNull()))


def write_generation(chunks: DataFrame, path: str) -> None:
    """Writes chunks by their ``generation``; only the generations that are in ``chunks`` are replaced."""
    chunks.write.partitionBy("generation").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(path)


def read_generation(spark: SparkSession, path: str, generation: int) -> DataFrame:
    """One generation; the filter prunes the folders of the others."""
    return spark.read.parquet(path).where(F.col("generation") == generation)
