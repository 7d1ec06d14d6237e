"""What the operators share: reading tables, shared scratch tables, Arrow maps."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Rows and bytes in an Arrow batch that Python works on at once; texts may be long, so batches stay small.
BATCH_ROWS, BATCH_BYTES = 256, 16 << 20

#: Folders that this driver has made, with the session that can delete them.
_folders: dict[str, SparkSession] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession, lasting: bool = False) -> str:
    """A new folder below spark.checkpoint.dir, which driver and executors share.

    Only where the setting is missing in a local session (tests) a temporary
    folder takes its place; on a cluster its absence is an error, since no
    machine's own folder is seen by the others. Folders go when the driver ends,
    or before that by scratch(); a lasting one stays.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        own = tempfile.mkdtemp(prefix="quire-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        base = f"file://{own}"
        spark.conf.set("spark.checkpoint.dir", base)
    # Complete with scheme and host, so that other readers than Spark find the same place.
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{base.rstrip('/')}/quire-{uuid.uuid4().hex}")
    full = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    full = re.sub("^file:/+", "file:///", full)
    if not lasting:
        if not _folders:
            atexit.register(_drop, _folders)
        _folders[full] = spark
    return full


def _drop(folders: dict[str, SparkSession]) -> None:
    """Deletes the folders; one that can't be deleted any more is left."""
    while folders:
        full, spark = folders.popitem()
        with contextlib.suppress(Exception):
            path = spark._jvm.org.apache.hadoop.fs.Path(full)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextlib.contextmanager
def scratch() -> Iterator[None]:
    """Deletes at its end what was stored inside it; results that are still needed must be written elsewhere before."""
    before = set(_folders)
    try:
        yield
    finally:
        _drop({f: _folders.pop(f) for f in set(_folders) - before})


def dropped(path: str) -> None:
    """Deletes a folder of shared_folder(), once nothing reads it any more."""
    _drop({path: _folders.pop(path)})


def stored(df: DataFrame, codec: str = "zstd", path: str | None = None) -> DataFrame:
    """df written as Parquet to the shared folder, or to path, and read again.

    Cuts the lineage: what follows survives the loss of any executor without
    computing df again.
    """
    spark = df.sparkSession
    path = path or shared_folder(spark)
    limits = {"maxRecordsPerBatch": str(BATCH_ROWS), "maxBytesPerBatch": f"{BATCH_BYTES}b"}
    names = {k: f"spark.sql.execution.arrow.{k}" for k in limits}
    own = {k: spark.conf.get(n) for k, n in names.items()}
    try:  # what is written here goes to Python in small batches; the session's own limits come back
        for k, n in names.items():
            spark.conf.set(n, limits[k])
        df.write.option("compression", codec).parquet(path)
    finally:
        for k, n in names.items():
            spark.conf.set(n, own[k])
    return spark.read.schema(df.schema).parquet(path)


def arrow_map(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow in slices of BATCH_ROWS rows, in workers that give memory back after each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin(f"{fn.__module__}.{fn.__qualname__}")
        yield from fn(b.slice(at, BATCH_ROWS) for b in batches for at in range(0, max(b.num_rows, 1), BATCH_ROWS))
        tidy()

    return df.mapInArrow(run, schema)


_resident: dict[object, object] = {}


_owner = ""


def begin(owner: str) -> None:
    """Drops what a worker has kept for another step than the one whose task begins."""
    global _owner
    if owner != _owner:
        _resident.clear()
        _owner = owner
        tidy()


def resident(key: object, make: Callable[[], object]) -> object:
    """An object that a worker keeps for its later tasks: what an operator has loaded or remembered.

    There is one at a time, so workers that serve several operators in turn don't
    add up what each of them holds.
    """
    if key not in _resident:
        _resident.clear()
        _resident[key] = make()
    return _resident[key]


def tidy() -> None:
    """Returns freed memory to the system; allocators otherwise keep much of it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def batch_of(columns: dict[str, pa.Array]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))
