"""Slices, layers, masks and alignment."""

from __future__ import annotations

from bisect import bisect_left
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cubespark.cube import Cube
from cubespark.functions import uniform
from cubespark.operators.geometry import isel

#: Land-cover codes that fold into their group.
LAND_COVER_GROUPS = {11: 10, 12: 10, 61: 60, 62: 60, 71: 70, 72: 70, 81: 80, 82: 80, 121: 120, 122: 120, 151: 150, 152: 150, 153: 150, 201: 200, 202: 200}


def slice_labels(cube: Cube, **ranges: tuple) -> Cube:
    """Label ranges, both ends inclusive, in either order; the predicate is on labels, so it reaches a scan."""
    df, axes = cube.df, dict(cube.axes)
    for d, (a, b) in ranges.items():
        low, high = min(a, b), max(a, b)
        kept = [k for k, x in enumerate(axes[d]) if low <= x <= high]
        if not kept:
            raise ValueError(f"no label of {d} lies in {low} .. {high}")
        df = df.where(F.col(d).between(low, high)).withColumn(f"i_{d}", F.col(f"i_{d}") - kept[0])
        axes[d] = [axes[d][k] for k in kept]
    return Cube(df, axes, cube.variables, cube.chunks)


def every(cube: Cube, dim: str, step: int) -> Cube:
    """Every step-th label of a dimension, as a coarser level of a pyramid has."""
    df = cube.df.where(F.col(f"i_{dim}") % step == 0).withColumn(f"i_{dim}", F.floor(F.col(f"i_{dim}") / step))
    return Cube(df, dict(cube.axes) | {dim: cube.axes[dim][::step]}, cube.variables, cube.chunks)


def layer_by_index(cube: Cube, dim: str, index: int) -> Cube:
    return isel(cube, {dim: (index, index + 1)})


def layer_by_label(cube: Cube, dim: str, label) -> Cube:
    return layer_by_index(cube, dim, cube.axes[dim].index(label))


def nearest_index(cube: Cube, dim: str, label) -> int:
    """Index of the closest label; the smaller one of two."""
    axis = cube.axes[dim]
    k = bisect_left(axis, label)
    near = [i for i in (k - 1, k) if 0 <= i < len(axis)]
    return min(near, key=lambda i: (abs(axis[i] - label), i))


def layer_nearest(cube: Cube, dim: str, label) -> Cube:
    return layer_by_index(cube, dim, nearest_index(cube, dim, label))


def random_index(cube: Cube, dim: str, seed: int) -> DataFrame:
    """(i_<dim>, <dim>) of one layer, the same for a seed wherever it runs."""
    axis = cube.axis_table(dim)
    return axis.orderBy(uniform(seed, f"i_{dim}"), f"i_{dim}").limit(1)


def without_layer(cube: Cube, dim: str, index: int) -> DataFrame:
    """The history of a layer: all others."""
    return cube.df.where(F.col(f"i_{dim}") != index)


def assign_mask(cube: Cube, mask: DataFrame, name: str = "filter_mask", stack_dim: str | None = "time") -> Cube:
    """A mask on the other dimensions repeated along stack_dim (None: the mask has all). mask has label or index columns
    of its dimensions and a Boolean column called mask."""
    if stack_dim is not None and stack_dim not in cube.dims:
        raise ValueError(f"no dimension {stack_dim}")
    dims = [d for d in cube.dims if d != stack_dim]
    keys = [d if d in mask.columns else f"i_{d}" for d in dims]
    side = mask.select(*keys, F.col("mask").cast("boolean").alias(name))
    return cube.with_df(cube.df.drop(name).join(side, keys, "left"), [*dict.fromkeys([*cube.variables, name])])


def align(cubes: list[Cube]) -> DataFrame:
    """Variables of several cubes on the same axes side by side."""
    keys = cubes[0].index()
    return reduce(lambda a, b: a.join(b, keys, "full_outer"), [c.df.select(*keys, *c.variables) for c in cubes])


def asof_index(axis: list, label, descending: bool) -> int:
    """Index before the first predictor label at or below (descending axis) or at or above (ascending) the label, held to
    the axis; the one before is taken even where labels are equal."""
    hit = next((i for i, p in enumerate(axis) if (p <= label if descending else p >= label)), 0)
    return min(max(hit - 1, 0), len(axis) - 1)


def extract_by_coordinates(cube: Cube, dims: tuple[str, str], predictor: DataFrame, axes: tuple[list, list], value: str) -> DataFrame:
    """A predictor on another grid read at the cube's coordinates: the first axis descends, the second ascends.

    predictor has p0, p1 (indices on its axes) and value. Each axis is mapped on its own, so the join is on equal indices.
    """
    spark = cube.df.sparkSession
    out = None
    for k, (d, axis, down) in enumerate(zip(dims, axes, (True, False), strict=True)):
        side = spark.createDataFrame([(i, asof_index(axis, x, down)) for i, x in enumerate(cube.axes[d])], f"i_{d} bigint, p{k} bigint")
        out = side if out is None else out.crossJoin(side)
    return out.join(predictor, ["p0", "p1"], "left").select(*[f"i_{d}" for d in dims], value)


def remap(value: Column, groups: dict[int, int]) -> Column:
    """Codes folded into groups; others stay."""
    table = F.create_map(*[F.lit(x) for pair in groups.items() for x in pair])
    return F.coalesce(F.element_at(table, value.cast("int")), value.cast("int"))
