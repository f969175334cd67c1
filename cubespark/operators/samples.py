"""The sample pipeline: chunks to windows or points, masked, dropped, filled, scaled, split and batched."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cubespark.cube import Cube
from cubespark.functions import uniform
from cubespark.operators.cleaning import drop_missing, drop_unmasked_samples, fill_missing, filter_points, mask_cells
from cubespark.operators.geometry import as_arrays, chunk_by_index, total_chunks, window_keys, windows, with_chunks
from cubespark.operators.scaling import scale, scale_params
from cubespark.operators.splitting import create_split, fraction_split


def sample_cells(cube: Cube, size: dict[str, int] | None = None, overlap: dict[str, float] | None = None, block: dict[str, int] | None = None) -> tuple[DataFrame, list[str]]:
    """Cells of samples and the columns that name a sample: a window, or a point without a size."""
    if size is None:
        return with_chunks(cube, block).withColumn("pos", F.lit(0).cast("bigint")), ["chunk_id", *cube.index()]
    return windows(cube, size, overlap, block), window_keys(cube)


def process(cube: Cube, size: dict[str, int] | None = None, overlap: dict[str, float] | None = None, block: dict[str, int] | None = None, use_filter: bool = True, drop_sample: bool = False, mask: str = "filter_mask", drop: str | None = "auto", fill: str | None = None, const: float | None = None, seed: int = 0) -> tuple[DataFrame, list[str]]:
    """Split, filter, drop, fill, in that order; all chunks in one plan."""
    cells, keys = sample_cells(cube, size, overlap, block)
    names = [v for v in cube.data_variables if v != mask]
    masked = use_filter and mask in cube.variables
    if masked:
        if size is None:
            cells = filter_points(cells, names, mask)
        elif drop_sample:
            cells = drop_unmasked_samples(cells, keys, mask)
        else:
            cells = mask_cells(cells, names, mask)
    if drop:
        cells = cells.na.drop(subset=names) if size is None else drop_missing(cells, keys, names, drop, mask if masked else None)
    return fill_missing(cells, names, fill, ["chunk_id"], keys if size else None, const, seed, cube.cell_number()), keys


def chunk_validity(cells: DataFrame, variables: list[str], cube: Cube, block: dict[str, int] | None = None) -> DataFrame:
    """(chunk_id, valid) of all chunks: valid where no value is missing after processing; a chunk without samples is valid."""
    ok = cells.groupBy("chunk_id").agg(F.bool_and(F.lit(True) if not variables else sum((F.col(v).isNull().cast("int") for v in variables), F.lit(0)) == 0).alias("_ok"))
    every = cells.sparkSession.range(total_chunks(cube, block)).withColumnRenamed("id", "chunk_id")
    return every.join(ok, "chunk_id", "left").select("chunk_id", F.coalesce("_ok", F.lit(True)).alias("valid"))


def choose_chunks(validity: DataFrame, n: int | None, seed: int | None = None, patience: int = 500) -> DataFrame:
    """The first n valid chunks in visit order (by hash, or by number without a seed), stopping after patience invalid
    ones in a row. One row a chunk, so the order fits one task."""
    order = [F.col("chunk_id")] if seed is None else [uniform(seed, "chunk_id"), F.col("chunk_id")]
    visit = validity.withColumn("at", F.row_number().over(Window.orderBy(*order)))
    up_to = Window.orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    visit = visit.withColumn("taken", F.sum(F.col("valid").cast("int")).over(up_to)).withColumn("last", F.coalesce(F.max(F.when(F.col("valid"), F.col("at"))).over(up_to), F.lit(0)))
    stop = visit.agg(F.min(F.when(F.col("at") - F.col("last") >= patience, F.col("at")))).first()[0]
    picked = visit.where("valid") if n is None else visit.where(F.col("valid") & (F.col("taken") <= n))
    return (picked if stop is None else picked.where(F.col("at") < stop)).select("chunk_id")


class SampleSet:
    """An in-memory style sample set as lazy DataFrames: chosen chunks, processed, scaled, split."""

    def __init__(self, cube: Cube, chunks: list[int] | int | None = None, seed: int | None = None, block: dict[str, int] | None = None, size: dict[str, int] | None = None, overlap: dict[str, float] | None = None, callback: Callable[[DataFrame], DataFrame] | None = None, scale_by: str | None = "standardize", fit_on: str = "all", patience: int = 500, **options):
        cells, self.keys = process(cube, size, overlap, block, **options)
        self.variables = [v for v in cube.data_variables if v != options.get("mask", "filter_mask")]
        if isinstance(chunks, list):
            cells = cells.where(F.col("chunk_id").isin(chunks))
        elif chunks is not None:
            picked = choose_chunks(chunk_validity(cells, self.variables, cube, block), chunks, seed, patience)
            cells = cells.join(picked, "chunk_id", "left_semi")
        cells = callback(cells) if callback else cells
        fitted = cells.where("split") if fit_on == "train" and "split" in cells.columns else cells
        self.params = scale_params(fitted, self.variables, scale_by) if scale_by in ("normalize", "standardize") else {}
        self.cells = scale(cells, self.params, scale_by or "")

    def split(self, target: str, features: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
        """Point samples as (features, label) of train and test."""
        picked = features or [v for v in self.variables if v != target]
        return create_split(self.cells, target, picked)


class ChunkDataset:
    """Chunks by number: len() and [k], a pandas frame of the chunk's cells, processed if asked for."""

    def __init__(self, cube: Cube, chunks: list[int] | int | None = None, seed: int | None = None, block: dict[str, int] | None = None, callback: Callable | None = None, processed: bool = False, **options):
        self.cube, self.block, self.callback, self.processed, self.options = cube, block, callback, processed, options
        total = total_chunks(cube, block)
        if isinstance(chunks, list):
            self.chunks = chunks
        else:
            order = range(total) if seed is None else [r[0] for r in cube.df.sparkSession.range(total).orderBy(uniform(seed, "id"), "id").collect()]
            self.chunks = list(order)[: total if chunks is None else chunks]

    def __len__(self) -> int:
        return len(self.chunks)

    def __getitem__(self, k: int):
        part = chunk_by_index(self.cube, self.chunks[k], self.block)
        if self.processed:
            cells, keys = process(Cube(part.df, part.axes, part.variables, dict(part.sizes)), **self.options)
            cells = cells.orderBy(*keys, "pos")
        else:
            cells = part.df.orderBy(*part.index())
        frame = cells.toPandas()
        return self.callback(frame) if self.callback else frame


class ChunkSampler:
    """Sample sets larger than memory: one job from the scan to train and test partitions of a Parquet folder.

    The scale parameters are those of the whole cube (fit_on "train": of its training cells). Without a split variable,
    each chunk's samples are split by share in hash order. A window that straddles both roles goes to both, the other
    role's cells missing in it.
    """

    def __init__(self, cube: Cube, path: str, share: float = 0.8, chunk_share: float = 1.0, seed: int = 0, block: dict[str, int] | None = None, size: dict[str, int] | None = None, overlap: dict[str, float] | None = None, callback: Callable[[DataFrame], DataFrame] | None = None, scale_by: str | None = "standardize", fit_on: str = "all", **options):
        self.cube, self.path, self.share, self.chunk_share, self.seed, self.block = cube, path, share, chunk_share, seed, block
        self.size, self.overlap, self.callback, self.options = size, overlap, callback, options
        self.variables = [v for v in cube.data_variables if v != options.get("mask", "filter_mask")]
        self.scale_by = scale_by
        base = cube.df.where("split") if fit_on == "train" and "split" in cube.variables else cube.observed
        self.params = scale_params(base, self.variables, scale_by) if scale_by in ("normalize", "standardize") else {}

    def _samples(self, cube: Cube) -> tuple[DataFrame, list[str]]:
        cells, keys = process(cube, self.size, self.overlap, self.block, **self.options)
        total = total_chunks(cube, self.block)
        if self.chunk_share < 1:
            ids = cells.sparkSession.range(total).orderBy(uniform(self.seed, "id"), "id").limit(int(total * self.chunk_share + 1e-9))
            cells = cells.join(ids.withColumnRenamed("id", "chunk_id"), "chunk_id", "left_semi")
        cells = self.callback(cells) if self.callback else cells
        return scale(cells, self.params, self.scale_by or ""), keys

    def _rows(self, cells: DataFrame, keys: list[str]) -> DataFrame:
        return cells.select(*keys, *self.variables) if self.size is None else as_arrays(cells, keys, self.variables)

    def create(self, mode: str = "overwrite") -> None:
        from cubespark.sources import write_samples

        if "split" in self.cube.variables:
            out = None
            for role in (True, False):
                kept = {v: F.when(F.col("split") == role, F.col(v)) for v in self.variables}
                cells, keys = self._samples(self.cube.with_df(self.cube.df.withColumns(kept)))
                rows = self._rows(cells, keys).withColumn("split", F.lit(role))
                out = rows if out is None else out.unionByName(rows)
        else:
            cells, keys = self._samples(self.cube)
            rows = self._rows(cells, keys)
            out = fraction_split(rows, ["chunk_id"], self.share, self.seed, *keys)
        write_samples(out, self.path, mode)

    def datasets(self) -> tuple[DataFrame, DataFrame]:
        from cubespark.sources import read_samples

        return read_samples(self.cube.df.sparkSession, self.path)


def batches(df: DataFrame, size: int, seed: int | None, *keys: str, drop_last: bool = True) -> DataFrame:
    """batch_id of each row in hash order (by key without a seed), numbered in two steps: rows are counted by a coarse
    range of the hash, so that no single task orders them all."""
    draw = uniform(seed, *keys) if seed is not None else None
    if draw is None:
        ranked = df.withColumn("_rn", F.row_number().over(Window.orderBy(*keys)))
        total = F.count("*").over(Window.partitionBy())
        out = ranked.withColumn("_n", total)
    else:
        dealt = df.withColumn("_u", draw).withColumn("_slice", F.floor(F.col("_u") * 256).cast("int"))
        counts = dealt.groupBy("_slice").agg(F.count("*").alias("_c"))
        before = counts.select("_slice", (F.sum("_c").over(Window.orderBy("_slice")) - F.col("_c")).alias("_before"), F.sum("_c").over(Window.partitionBy()).alias("_n"))
        rank = F.row_number().over(Window.partitionBy("_slice").orderBy("_u", *keys))
        out = dealt.withColumn("_r", rank).join(F.broadcast(before), "_slice").withColumn("_rn", F.col("_r") + F.col("_before")).drop("_u", "_slice", "_r", "_before")
    out = out.withColumn("batch_id", F.floor((F.col("_rn") - 1) / size).cast("bigint"))
    return (out.where((F.col("batch_id") + 1) * size <= F.col("_n")) if drop_last else out).drop("_rn", "_n")


def iterate_batches(df: DataFrame, key: str = "batch_id") -> Iterator[list]:
    """Batches in turn on the driver, one partition at a time."""
    held, at = [], None
    for row in df.orderBy(key).toLocalIterator():
        if at is not None and row[key] != at:
            yield held
            held = []
        held.append(row)
        at = row[key]
    if held:
        yield held


def lag_features(cube: Cube, variable: str, dim: str, lags: tuple[int, ...]) -> DataFrame:
    """Earlier values of each pixel along a dimension beside the value."""
    by = Window.partitionBy(*cube.index(*[d for d in cube.dims if d != dim])).orderBy(f"i_{dim}")
    return cube.df.select(*cube.index(), variable, *[F.lag(variable, k).over(by).alias(f"{variable}_lag{k}") for k in lags])

