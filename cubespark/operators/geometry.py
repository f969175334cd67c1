"""Chunks, blocks and sliding windows as columns."""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cubespark.cube import Cube, row_major


def block_sizes(cube: Cube, block: dict[str, int] | None = None) -> dict[str, int]:
    """Chunk size of each dimension: the override by name, else the cube's own, else the whole axis."""
    sizes = cube.chunks | {d: b for d, b in (block or {}).items() if b}
    return {d: min(sizes.get(d, n), n) or 1 for d, n in cube.sizes.items()}


def chunk_counts(cube: Cube, block: dict[str, int] | None = None) -> dict[str, int]:
    return {d: math.ceil(cube.sizes[d] / b) for d, b in block_sizes(cube, block).items()}


def total_chunks(cube: Cube, block: dict[str, int] | None = None) -> int:
    return math.prod(chunk_counts(cube, block).values())


def chunk_number(cube: Cube, block: dict[str, int] | None = None) -> Column:
    """Row-major number of a cell's chunk."""
    sizes, counts = block_sizes(cube, block), chunk_counts(cube, block)
    return row_major([(F.floor(F.col(f"i_{d}") / sizes[d]).cast("bigint"), counts[d]) for d in cube.dims])


def with_chunks(cube: Cube, block: dict[str, int] | None = None) -> DataFrame:
    return cube.df.withColumn("chunk_id", chunk_number(cube, block))


def chunk_ranges(cube: Cube, number: int, block: dict[str, int] | None = None) -> dict[str, tuple[int, int]]:
    """Half-open index range of a chunk in each dimension; the last chunk of an axis may be short."""
    if not 0 <= number < total_chunks(cube, block):
        raise ValueError(f"chunk {number} of {total_chunks(cube, block)}")
    sizes, counts, out = block_sizes(cube, block), chunk_counts(cube, block), {}
    for d in reversed(cube.dims):
        number, k = divmod(number, counts[d])
        out[d] = (k * sizes[d], min((k + 1) * sizes[d], cube.sizes[d]))
    return {d: out[d] for d in cube.dims}


def chunk_by_index(cube: Cube, number: int, block: dict[str, int] | None = None) -> Cube:
    """The cells of one chunk, picked by index ranges that reach the scan of a written cube."""
    ranges = chunk_ranges(cube, number, block)
    return isel(cube, ranges)


def isel(cube: Cube, ranges: dict[str, tuple[int, int]]) -> Cube:
    """Half-open index ranges; indices start anew from 0."""
    df, axes = cube.df, dict(cube.axes)
    for d, (low, high) in ranges.items():
        df = df.where((F.col(f"i_{d}") >= low) & (F.col(f"i_{d}") < high)).withColumn(f"i_{d}", F.col(f"i_{d}") - low)
        axes[d] = axes[d][low:high]
    return Cube(df, axes, cube.variables, cube.chunks)


def iter_blocks(cube: Cube, block: dict[str, int] | None = None) -> Iterator[tuple[int, Cube]]:
    """Chunks in row-major order, one lazy cube each."""
    for k in range(total_chunks(cube, block)):
        yield k, chunk_by_index(cube, k, block)


def windows(cube: Cube, size: dict[str, int], overlap: dict[str, float] | None = None, block: dict[str, int] | None = None) -> DataFrame:
    """Cells of all whole windows inside each chunk: chunk_id, w_<dim> (window number), pos (row-major place in the window).

    The stride is size - int(size * overlap). A trailing window that would not be whole is left out; overlapping windows
    share cells, so rows multiply by the windows that hold them: project first.
    """
    sizes, overlap = block_sizes(cube, block), overlap or {}
    df, places = with_chunks(cube, block), []
    for d in cube.dims:
        s, b, n = size[d], sizes[d], cube.sizes[d]
        stride = s - (int(s * overlap.get(d, 0.0)) if s > 1 else 0)
        if stride < 1:
            raise ValueError("windows must move on")
        i = F.col(f"i_{d}")
        local = i % b
        extent = F.least(F.lit(b), F.lit(n) - F.floor(i / b) * b)
        count = F.floor((extent - s) / stride) + 1
        if stride == s:
            k = F.floor(local / s)
            df = df.withColumn(f"w_{d}", k.cast("bigint")).where((extent >= s) & (k < count))
        else:
            low = F.greatest(F.lit(0), F.ceil((local - s + 1) / stride)).cast("bigint")
            high = F.least(count - 1, F.floor(local / stride)).cast("bigint")
            # sequence() counts down when low > high, so that case goes first
            df = df.where((extent >= s) & (low <= high)).withColumn(f"w_{d}", F.explode(F.sequence(low, high)))
        places.append((local - F.col(f"w_{d}") * stride, s))
    return df.withColumn("pos", row_major(places))


def window_keys(cube: Cube) -> list[str]:
    return ["chunk_id", *(f"w_{d}" for d in cube.dims)]


def as_arrays(samples: DataFrame, keys: list[str], variables: list[str]) -> DataFrame:
    """One row a sample, each variable an array in place order (missing values stay as NULL)."""
    ordered = F.array_sort(F.collect_list(F.struct("pos", *variables)))
    rows = samples.groupBy(*keys).agg(ordered.alias("_cells"))
    return rows.select(*keys, *[F.col(f"_cells.{v}").alias(v) for v in variables])


def dim_range(cube: Cube, dim: str) -> tuple:
    """First and last label by value; dates as YYYY-MM-DD."""
    low, high = min(cube.axes[dim]), max(cube.axes[dim])
    return tuple(x.strftime("%Y-%m-%d") if hasattr(x, "strftime") else x for x in (low, high))
