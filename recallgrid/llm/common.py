"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Lower-cases A-Z only, on UTF-8 bytes; every other byte stays.
LOWER_ASCII = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster shares: spark.checkpoint.dir, or the checkpoint folder that the session has set."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not named and sc.master.startswith("local"):
        named = tempfile.mkdtemp(prefix="recallgrid-")  # one machine, so it is shared
    if not named:
        raise ValueError("name a folder that all machines share in spark.checkpoint.dir")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(named)
    return named.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back: lineage ends there and survives lost executors."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def row_id(docs: DataFrame) -> DataFrame:
    """docs with a long ``__rid`` per row: the file's place among the files and the row's place in it.

    So a row has the same number in every job, whatever the cores or split sizes at the time. docs is a scan of Parquet
    files, or a projection or filter of one; rows that come from elsewhere are stored first.
    """
    from_files = bool(docs.inputFiles())
    if from_files:
        try:
            files = docs.select(F.col("_metadata.file_path").alias("f")).distinct()
        except AnalysisException:
            from_files = False
    if not from_files:
        docs = stored(docs, "rows")
        files = docs.select(F.col("_metadata.file_path").alias("f")).distinct()
    names = sorted(r["f"] for r in files.collect())  # a name per file, as the scan itself holds
    table = pa.table({"__f": pa.array(names, pa.string()), "__first": pa.array([i << 40 for i in range(len(names))], pa.int64())})
    places = docs.sparkSession.createDataFrame(table)  # as a local relation, so that equal plans share their exchange
    numbered = docs.select("*", F.col("_metadata.file_path").alias("__f"), F.col("_metadata.row_index").alias("__row"))
    return numbered.join(F.broadcast(places), "__f").withColumn("__rid", F.col("__first") + F.col("__row")).drop("__f", "__first", "__row")


def with_row_id(docs: DataFrame, *columns: str) -> DataFrame:
    """``rid`` (see row_id) and the columns asked for; two calls on the same files number alike."""
    return row_id(docs).select(F.col("__rid").alias("rid"), *[F.col(f"`{c}`").alias(c) for c in columns])


def with_place(docs: DataFrame, *columns: str) -> DataFrame:
    """A long ``rid`` per row, consecutive in a task's batches. The numbers hold within one job only."""
    return docs.select(F.monotonically_increasing_id().alias("rid"), *[F.col(f"`{c}`").alias(c) for c in columns])


def texts(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    return ["" if t is None else t for t in batch.column(name).to_pylist()]


def slices(batches: Iterable[pa.RecordBatch], name: str = "text", most: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut so that the text in each is about ``most`` bytes: a worker's memory then doesn't depend on text lengths."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        lengths = np.array(pc.fill_null(pc.binary_length(batch.column(name)), 0), dtype=np.int64)
        part = np.cumsum(lengths) // most
        edges = np.flatnonzero(np.diff(part)) + 1
        for a, b in zip([0, *edges], [*edges, batch.num_rows]):
            yield batch.slice(int(a), int(b - a))


def list_array(values: pa.Array, offsets: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), values)


def record_batch(fields: dict[str, object]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in fields.values()], names=list(fields))


def give_back() -> None:
    """Returns freed memory to the system: a worker goes on with other work, and what it keeps is taken from that."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
    if trim is not None:
        trim(0)


def map_arrow(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from function(batches)
        give_back()

    return df.mapInArrow(run, schema)


class Bounded(dict):
    """A memo of a function; it is emptied when it grows past ``most`` entries, so its memory is bounded."""

    def __init__(self, make: Callable, most: int = 500_000):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, key):
        value = self[key] = self.make(key)
        return value

    def trim(self) -> None:
        if len(self) > self.most:
            self.clear()
