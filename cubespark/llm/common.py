"""Shared plumbing of the corpus operators: tables, shared folder, Arrow maps, packed arrays."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; only a local session may fall back to a folder of its own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return "file:/tmp/checkpoints" if tempfile.gettempdir() == "/tmp" else f"file:{tempfile.gettempdir()}/checkpoints"


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/llm-{name}-{uuid.uuid4().hex}"


#: Rows that go to a Python worker at a time; texts can be long.
BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def saved(df: DataFrame, name: str, batch_rows: int | None = None) -> DataFrame:
    """Cut lineage: write to the shared folder and read back, so a lost executor costs nothing already done.

    discard() deletes the table once nothing that is still to run reads it. batch_rows holds for this write only: fewer rows at a time take less memory in the executor and its workers.
    """
    spark = df.sparkSession
    path, before = fresh_path(spark, name), spark.conf.get(BATCH_ROWS)
    if batch_rows:
        spark.conf.set(BATCH_ROWS, str(batch_rows))
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(BATCH_ROWS, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.saved_path = path
    return out


def discard(*tables: DataFrame | None) -> None:
    """Delete tables of saved(); others, and None, are passed over."""
    for df in tables:
        if (path := getattr(df, "__dict__", {}).get("saved_path")) is not None:
            spark = df.sparkSession
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def unused(columns: list[str], name: str) -> str:
    """The name, with as many underscores after it as it takes for no column to begin with it (names fold case)."""
    while any(c.lower().startswith(name.lower()) for c in columns):
        name += "_"
    return name


def crc_mod(id_col: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id gives 0."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % n, F.lit(0))


def hashed_share(df: DataFrame, share: float, *columns: str) -> DataFrame:
    """The rows whose hash of the columns falls into a share of all hashes; the same rows whatever their layout."""
    if share >= 1:
        return df
    return df.where(F.shiftrightunsigned(F.xxhash64(*columns), 1) < F.lit(max(1, int(share * (1 << 63)))))


def slices(batch: pa.RecordBatch, size: int | None) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows of about size bytes."""
    rows = batch.num_rows if size is None else max(1, int(batch.num_rows * min(1.0, size / max(batch.nbytes, 1))))
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def arrow_map(df: DataFrame, fn: Callable[[pa.RecordBatch], dict | None], schema: str, slice_bytes: int | None = 8 << 20) -> DataFrame:
    """mapInArrow with fn from a record batch of about slice_bytes to a dict of columns in the schema's order."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    target = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()  # what the worker's last task held
        for batch in batches:
            for part in slices(batch, slice_bytes) if batch.num_rows else ():
                if (out := fn(part)) is not None:
                    yield pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) for f in target], schema=target)
            if batch.nbytes > 1 << 20:
                release()
        release()  # the worker waits for its next task with as little as it can

    return df.mapInArrow(run, schema)


def text_bytes(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.binary()).to_pylist()


def pack(array: np.ndarray, level: int = 1) -> bytes:
    return zstandard.ZstdCompressor(level=level).compress(np.ascontiguousarray(array).tobytes())


def unpack(blob: bytes, dtype: str) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), dtype=dtype)


def free_shuffles(spark: SparkSession) -> None:
    """Let the driver collect its garbage, upon which Spark deletes the shuffle files of plans that are gone.

    What Python lets go of reaches the JVM a moment later, so it collects twice.
    """
    for _ in range(2):
        gc.collect()
        time.sleep(0.3)
        spark._jvm.System.gc()


def release() -> None:
    """Give a Python worker's freed memory back to the system: workers live on beside the executor's JVM."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambler of 64-bit words (the splitmix finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def runs(sorted_keys: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal values in a sorted array."""
    if not len(sorted_keys):
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.concatenate(([True], sorted_keys[1:] != sorted_keys[:-1])))
