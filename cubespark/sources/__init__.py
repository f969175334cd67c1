"""Reading and writing cubes and sample sets as Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cubespark.cube import Cube, from_cells
from cubespark.operators.geometry import chunk_number, total_chunks


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read_cube(spark: SparkSession, path: str, dims: list[str], chunks: dict[str, int] | None = None, level: int | None = None) -> Cube:
    """A cube written by write_cube, on any file system Spark reads; level picks one of a pyramid's folders."""
    df = spark.read.parquet(path if level is None else f"{path}/level={level}")
    return from_cells(df.drop("chunk_id"), dims, chunks)


def write_cube(cube: Cube, path: str, chunks: dict[str, int] | None = None, mode: str = "overwrite", files: int | None = None) -> None:
    """Cells ordered by chunk, so that a chunk's index ranges prune row groups; a new chunking rewrites the cube."""
    if chunks is not None and not isinstance(chunks, dict):
        if not isinstance(chunks, (tuple, list)):
            raise ValueError("chunks must be a dict, tuple or list")
        chunks = dict(zip(cube.dims, chunks, strict=True))
    n = files or max(1, min(total_chunks(cube, chunks), cube.cells // 2_000_000 + 1))
    cells = cube.df.withColumn("chunk_id", chunk_number(cube, chunks))
    cells.repartitionByRange(n, "chunk_id").sortWithinPartitions("chunk_id", *cube.index()).write.mode(mode).parquet(path)


def rechunk(spark: SparkSession, source: str, dims: list[str], chunks: dict[str, int], target: str) -> Cube:
    write_cube(read_cube(spark, source, dims), target, chunks)
    return read_cube(spark, target, dims, chunks)


def write_samples(samples: DataFrame, path: str, mode: str = "append") -> None:
    """Create or append; train and test go to partitions of their own."""
    samples.write.mode(mode).partitionBy("split").parquet(path)


def read_samples(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(train, test); the split is a partition, so each reads its own files only."""
    df = spark.read.parquet(path)
    train = F.col("split").cast("string").isin("true", "1", "1.0")
    return df.where(train).drop("split"), df.where(~train).drop("split")


def whole_groups(samples: DataFrame, size: int, *order: str) -> DataFrame:
    """The first floor(n / size) * size samples in order: what stores with fixed chunks can hold.

    order must tell rows apart. Fewer than size rows are left out, so they are found as a top-k; no task orders them all.
    """
    return _parted(samples, size, *order)[0]


def _parted(samples: DataFrame, size: int, *order: str) -> tuple[DataFrame, DataFrame]:
    """Whole groups, and the last rows in order that fill none."""
    last = samples.orderBy(*[F.col(c).desc() for c in order]).limit(samples.count() % size)
    return samples.join(last.select(*order), list(order), "left_anti").select(*samples.columns), last


def append_whole_groups(samples: DataFrame, path: str, size: int, *order: str) -> int:
    """Append whole groups of samples and carry the rest to the next append; returns how many rows are carried.

    The carried rows lie in <path>-rest/<k>; each append reads the latest and writes the next, so one that fails and is
    repeated loses none.
    """
    spark = samples.sparkSession
    rest = spark._jvm.org.apache.hadoop.fs.Path(f"{path}-rest")
    files = rest.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [int(x.getPath().getName()) for x in files.listStatus(rest)] if files.exists(rest) else []
    rows = samples.unionByName(spark.read.schema(samples.schema).parquet(f"{path}-rest/{max(found)}")) if found else samples
    whole, last = _parted(rows, size, *order)
    last.write.mode("overwrite").parquet(f"{path}-rest/{max(found, default=-1) + 1}")
    whole.write.mode("append").parquet(path)
    for k in found:
        files.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{path}-rest/{k}"), True)
    return spark.read.schema(samples.schema).parquet(f"{path}-rest/{max(found, default=-1) + 1}").count()


def list_results(spark: SparkSession, folder: str, pattern: str = "*_*.parquet") -> DataFrame:
    """path and gap_size (the number after the last underscore of the name) of a folder's result sets."""
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{pattern}")
    found = where.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(where) or []
    rows = [x.getPath().toString() for x in found]
    df = spark.createDataFrame([(r,) for r in rows], "path string")
    return df.withColumn("gap_size", F.regexp_extract("path", r"_([0-9.]+?)(?:\.[a-z]+)?$", 1).try_cast("double"))
