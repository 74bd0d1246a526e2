"""Helpers of the corpus operators: settings, tables in the shared folder, Arrow batches.

Intermediate tables go to the folder that ``spark.checkpoint.dir`` names, which every executor
sees; a local folder is used only by a local session that has none.
"""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.staging import ship
from ..session import prepare as base_settings

ship(__name__)

# Texts may be long, so batches for Python workers are bounded by bytes as well.
SETTINGS = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20),
}


def prepare(spark: SparkSession) -> SparkSession:
    base_settings(spark)
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_LOCAL: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """A folder of this application inside the shared one."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if not _LOCAL:
            _LOCAL.append(tempfile.mkdtemp(prefix="corpus-"))
        root = _LOCAL[0]
    return f"{root.rstrip('/')}/corpus-{spark.sparkContext.applicationId}"


def folder_exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def _clean(spark: SparkSession, path: str) -> None:
    try:
        delete(spark, path)
    except Exception:  # the session has ended; the folder is left to its owner
        pass


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    Cuts the lineage at a place that survives lost executors, and gives later joins a plain
    scan on both sides, so adaptive execution can split hot keys.
    """
    spark = df.sparkSession
    folder = shared_folder(spark)
    path = f"{folder}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    atexit.register(_clean, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def give_back() -> None:
    """Return what this process has freed, but holds for its next use, to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


Batches = Iterator[pa.RecordBatch]


def tidy(run: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    """``run`` for ``mapInArrow``, with the memory given back when the task ends.

    Workers stay for the next stage, which may use other ones or none.
    """

    def tidied(batches: Batches) -> Batches:
        try:
            yield from run(batches)
        finally:
            give_back()

    return tidied


def add_columns(
    df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], dict]], new: str, rows: int = 0
) -> DataFrame:
    """Add the columns of the DDL ``new``, computed in Python from Arrow batches.

    ``make()`` runs once in each task and gives a function from a batch to a dict of arrays.
    All other columns pass through; a column of the same name is replaced. With ``rows`` the
    function gets slices of so many rows, and memory is given back after each batch.
    """
    made = T.StructType.fromDDL(new)
    kept = [f for f in df.schema.fields if f.name not in made.fieldNames()]
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make()
        for whole in batches:
            for at in range(0, whole.num_rows, rows or max(1, whole.num_rows)):
                batch = whole.slice(at, rows or None)
                old = {n: batch.column(n) for n in names}
                yield pa.RecordBatch.from_pydict(old | fn(batch))
            if rows:
                give_back()

    return df.mapInArrow(tidy(run), T.StructType(kept + made.fields))


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """The texts of a batch; null counts as empty."""
    return [x or "" for x in batch.column(name).to_pylist()]


def unused(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have: ``name`` behind as many underscores as it takes."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def crc_of_id(name: str = "doc_id") -> Column:
    return F.crc32(F.col(name).cast("string"))


def total_bytes(df: DataFrame, name: str = "text") -> int:
    """Bytes of all texts: one aggregate, one number."""
    return df.agg(F.sum(F.octet_length(name))).first()[0] or 0
