"""Shared pieces of the corpus operators: table access, reliable materialisation, Arrow batches."""

from __future__ import annotations

import atexit
import re
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The words of a text are maximal runs of anything but ASCII white space.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
#: Rows that a Python worker holds at a time.
SLICE = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir; a temporary one only where it is unset and Spark runs on this machine alone."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="sitegauge-")
        spark.sparkContext.setCheckpointDir(named)
    return named


def materialize(df: DataFrame) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: a cut lineage that survives lost executors.

    Later jobs read the files instead of repeating a shuffle, and an
    order-dependent result (range boundaries, say) stays the same for every
    reader. The files go when the session ends, or by discard().
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_remove, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def discard(*written: DataFrame) -> None:
    """Deletes the files of materialised DataFrames that nothing reads any more."""
    for df in written:
        _remove(df.sparkSession, df.written_to)


def _remove(spark: SparkSession, path: str) -> None:
    jsc = spark.sparkContext._jsc
    if jsc is None or jsc.sc().isStopped():
        return
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(jsc.hadoopConfiguration()).delete(where, True)


class Shipped:
    """A value for every task, broadcast with the classes it is made of, so that workers need not find this package."""

    def __init__(self, spark: SparkSession, value: object) -> None:
        self._packed = spark.sparkContext.broadcast(cloudpickle.dumps(value))

    @property
    def value(self) -> object:
        return cloudpickle.loads(self._packed.value)

    def release(self) -> None:
        """Frees it everywhere, once no task can need it any more."""
        self._packed.destroy()


def by_slice(
    work: Callable[[pa.RecordBatch], pa.RecordBatch | None], rows: int = SLICE
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A mapInArrow function that hands `work` at most `rows` rows at a time, so that long texts don't pile up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, rows):
            out = work(piece)
            if out is not None and out.num_rows:
                yield out

    return run


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of at most `rows` rows."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), f"{SPACE}+"), lambda x: x != "")


def crc_fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5; rows of fold 0 are held out of all training. A null id counts as ''."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5


cloudpickle.register_pickle_by_value(sys.modules[__name__])
