"""What the operators of this subpackage share: session set-up, Arrow batch mapping and shared-folder tables."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

#: Rows that are turned into Python objects at once; Arrow batches hold at most BATCH_BYTES.
SLICE_ROWS = 256
BATCH_BYTES = 16 << 20

_ROOT = str(Path(__file__).resolve().parents[2])


def attach(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package and bound the Arrow batches sent to them."""
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if _ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*paths, _ROOT])
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") != str(BATCH_BYTES):
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder, from ``spark.checkpoint.dir``. Only a local master may do without: one is chosen for it."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if found:
        return found
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all machines of the cluster share")
    return os.path.join(tempfile.gettempdir(), "lineloom-checkpoints", sc.applicationId)


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` computed once and cut off from its lineage, kept in the shared folder until the driver drops its last reference
    (where ``spark.cleaner.referenceTracking.cleanCheckpoints`` is set) or the folder is cleared."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def forget(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of tables that nothing refers to any more, where a checkpoint has cut what needed them.

    Spark deletes them once the driver has collected its references, which an idle driver does too seldom for large jobs.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def slices(batches: Iterable[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


_held: dict[str, Callable[[], object]] = {}


def working(owner: str, release: Callable[[], object] = lambda: None) -> None:
    """Tell that a task of an operator starts in this Python process; what other operators keep for later tasks is dropped.

    Workers outlive tasks, so without this the caches of all operators of a pipeline would add up.
    """
    others = [n for n in _held if n != owner]
    for name in others:
        _held.pop(name)()
    if others:  # give the memory back, not only to this process
        gc.collect()
        pa.default_memory_pool().release_unused()
        if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
            libc.malloc_trim(0)
    _held[owner] = release


def hidden(df: DataFrame) -> DataFrame:
    """``df`` with its columns named _c0, _c1, .., so that an operator's own names can't clash with them."""
    return df.toDF(*[f"_c{i}" for i in range(len(df.columns))])


def place(df: DataFrame, column: str) -> str:
    """The name that ``hidden`` gives to a column."""
    return f"_c{next(i for i, c in enumerate(df.columns) if c.lower() == column.lower())}"


def with_columns(df: DataFrame, make: Callable[[], Callable], fields: list[T.StructField], source: str, release: Callable[[], object] = lambda: None) -> DataFrame:
    """Add ``fields``, computed in Arrow batches from column ``source``; input columns of the same names are replaced.

    ``make()`` is called once in each task and returns a function from a list of values to lists of values. ``release``
    drops what it keeps in the worker for later tasks.
    """
    names = {f.name.lower() for f in fields}
    kept = [f for f in df.schema.fields if f.name.lower() not in names]
    at = next(i for i, f in enumerate(df.schema.fields) if f.name.lower() == source.lower())
    index = [i for i, f in enumerate(df.schema.fields) if f.name.lower() not in names]
    types = [_arrow(f.dataType) for f in fields]
    labels = [f.name for f in kept] + [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        working(make.__module__, release)
        work = make()
        for part in slices(batches):
            made = work(part.column(at).to_pylist())
            arrays = [part.column(i) for i in index] + [pa.array(m, t) for m, t in zip(made, types, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, names=labels)

    return df.mapInArrow(run, T.StructType([*kept, *fields]))


def _arrow(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the cluster's shared checkpoint folder, and read again."""
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/lineloom-{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a table that ``stored`` has written."""
    spark = df.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for parent in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(parent)
        path.getFileSystem(conf).delete(path, True)
