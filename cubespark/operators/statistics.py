"""Ranges, statistics, gap counts and cube reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cubespark.cube import Cube
from cubespark.functions import percent
from cubespark.operators.geometry import block_sizes, chunk_counts, chunk_number, dim_range


def _kept(cube: Cube, exclude: list[str] | None) -> list[str]:
    return [v for v in cube.data_variables if v not in (exclude or [])]


def value_range(cube: Cube, exclude: list[str] | None = None) -> DataFrame:
    """One row: <var>_min and <var>_max of all variables in one pass, missing values skipped."""
    return cube.observed.agg(*[f(v).alias(f"{v}_{n}") for v in _kept(cube, exclude) for n, f in (("min", F.min), ("max", F.max))])


def statistics(cube: Cube, exclude: list[str] | None = None) -> DataFrame:
    """One row: <var>_mean and <var>_std (population)."""
    return cube.observed.agg(*[f(v).alias(f"{v}_{n}") for v in _kept(cube, exclude) for n, f in (("mean", F.avg), ("std", F.stddev_pop))])


def gap_summary(df: DataFrame, variable: str, *by: str) -> DataFrame:
    """Cells, gaps and their ratio to two places (half to even), overall or by group."""
    counted = df.groupBy(*by).agg(F.count("*").alias("cells"), (F.count("*") - F.count(variable)).alias("gaps"))
    return counted.withColumn("ratio", F.bround(F.col("gaps") / F.col("cells"), 2))


def seen_by(cube: Cube, variable: str, *dims: str) -> DataFrame:
    """Cells, seen values, their least and greatest, of each place of some dimensions.

    Only places are gridded: the cells of each are known from the sizes of the other axes, and what is missing is what
    wasn't seen.
    """
    cells = 1
    for d, n in cube.sizes.items():
        cells *= 1 if d in dims else n
    found = cube.observed.groupBy(*dims).agg(F.count(variable).alias("seen"), F.min(variable).alias("lo"), F.max(variable).alias("hi"))
    out = cube.grid(*dims).drop("_cell").join(found, [*dims], "left")
    return out.select(*cube.index(*dims), *dims, F.lit(cells).cast("bigint").alias("cells"), F.coalesce("seen", F.lit(0).cast("bigint")).alias("seen"), "lo", "hi")


def layer_gaps(cube: Cube, variable: str, dim: str) -> DataFrame:
    """gap_summary by layer."""
    layers = seen_by(cube, variable, dim)
    return layers.select(f"i_{dim}", dim, "cells", (F.col("cells") - F.col("seen")).alias("gaps")).withColumn("ratio", F.bround(F.col("gaps") / F.col("cells"), 2))


def layer_extremes(cube: Cube, variable: str, dim: str) -> DataFrame:
    """One row: layers with the most and fewest gaps; the first of equals; none where no layer has gaps (or values)."""
    layers = layer_gaps(cube, variable, dim)
    some, not_all = F.col("ratio") > 0, F.col("ratio") < 1
    pick = lambda f, c, sign: f(F.when(c, F.struct(F.col("ratio") * sign, -F.col(f"i_{dim}"), F.col(dim), F.col("ratio").alias("r"))))
    both = layers.agg(pick(F.max, some, 1.0).alias("a"), pick(F.max, not_all, -1.0).alias("b"))
    return both.select(F.col(f"a.{dim}").alias("most_layer"), F.col("a.r").alias("most_ratio"), F.col(f"b.{dim}").alias("least_layer"), F.col("b.r").alias("least_ratio"))


def insights(cube: Cube, variable: str, layer_dim: str | None = None) -> DataFrame:
    """One row with sizes, ranges of the axes, gaps, extremes of the values and of the layers' gaps."""
    dim = layer_dim or cube.dims[0]
    layers = seen_by(cube, variable, dim).withColumn("ratio", F.bround((F.col("cells") - F.col("seen")) / F.col("cells"), 2))
    pick = lambda c, sign: F.max(F.when(c, F.struct(F.col("ratio") * sign, -F.col(f"i_{dim}"), F.col(dim), F.col("ratio").alias("r"))))
    one = layers.agg(F.sum("cells").alias("cells"), F.sum("seen").alias("seen"), F.min("lo").alias("min"), F.max("hi").alias("max"), pick(F.col("ratio") > 0, 1.0).alias("a"), pick(F.col("ratio") < 1, -1.0).alias("b"))
    ratio = F.bround((F.col("cells") - F.col("seen")) / F.col("cells"), 2)
    axes = [F.lit(x).alias(f"{d}_{n}") for d in cube.dims for n, x in zip(("size", "first", "last"), (cube.sizes[d], *map(_shown, dim_range(cube, d))), strict=True)]
    return one.select(*axes, "cells", (F.col("cells") - F.col("seen")).alias("gaps"), ratio.alias("ratio"), percent(ratio).alias("percent"), "min", "max", F.col(f"a.{dim}").cast("string").alias("most_layer"), F.col("a.r").alias("most_ratio"), F.col(f"b.{dim}").cast("string").alias("least_layer"), F.col("b.r").alias("least_ratio"))


def _shown(x):
    return round(x, 3) if isinstance(x, float) else x


def gap_heat_map(cube: Cube, variable: str, count_dim: str) -> DataFrame:
    """Observed values of each pixel along a dimension."""
    other = [d for d in cube.dims if d != count_dim]
    return seen_by(cube, variable, *other).select(*cube.index(*other), *other, F.col("seen").alias("n_obs"))


def chunk_statistics(chunked: DataFrame, variable: str) -> DataFrame:
    return chunked.groupBy("chunk_id").agg(F.count("*").alias("cells"), F.count(variable).alias("seen"), F.avg(variable).alias("mean"), F.min(variable).alias("min"), F.max(variable).alias("max"))


def chunk_report(cube: Cube, variable: str, block: dict[str, int] | None = None) -> DataFrame:
    """chunk_statistics of all chunks of a cube; their cells are known from their place."""
    sizes, counts, stride, cells = block_sizes(cube, block), chunk_counts(cube, block), 1, F.lit(1).cast("bigint")
    for d in reversed(cube.dims):
        k = F.expr(f"(id div {stride}) % {counts[d]}")
        cells, stride = cells * F.least(F.lit(sizes[d]), F.lit(cube.sizes[d]) - k * sizes[d]), stride * counts[d]
    chunks = cube.observed.sparkSession.range(stride).select(F.col("id").alias("chunk_id"), cells.alias("cells"))
    found = cube.known(variable).groupBy(chunk_number(cube, block).alias("chunk_id")).agg(F.count(variable).alias("seen"), F.avg(variable).alias("mean"), F.min(variable).alias("min"), F.max(variable).alias("max"))
    return chunks.join(found, "chunk_id", "left").withColumn("seen", F.coalesce("seen", F.lit(0).cast("bigint"))).select("chunk_id", "cells", "seen", "mean", "min", "max")
