"""Deterministic train/test splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cubespark.cube import RESERVED, Cube
from cubespark.functions import uniform
from cubespark.operators.geometry import chunk_number


def random_split(cube: Cube, share: float = 0.8, seed: int = 0) -> Cube:
    """split: true for about a share of the cells."""
    return cube.assign(split=uniform(seed, cube.cell_number()) < share)


def block_split(cube: Cube, block: dict[str, int], share: float = 0.8, seed: int = 0) -> Cube:
    """split is the same for all cells of a block."""
    return cube.assign(split=uniform(seed, chunk_number(cube, block)) < share)


def fraction_split(df: DataFrame, keys: list[str], share: float, seed: int, *cell: str) -> DataFrame:
    """In each group, exactly int(n * share) rows in hash order are train."""
    by = Window.partitionBy(*keys)
    rank = F.row_number().over(by.orderBy(uniform(seed, *cell), *cell))
    return df.withColumn("split", rank <= F.floor(F.count("*").over(by) * share + 1e-9))


def create_split(df: DataFrame, target: str, features: list[str] | None = None, exclude: list[str] | None = None, keys: list[str] | None = None, mask: str = "filter_mask") -> tuple[DataFrame, DataFrame]:
    """Train and test rows as (keys, features array, label); rows with a missing value are dropped.

    features defaults to all columns but the target, the split, the mask, keys and excluded ones.
    """
    known = set(df.columns)
    keys = keys or []
    if features is None:
        skip = {target, mask, *RESERVED, *(exclude or []), *keys}
        features = [c for c in df.columns if c not in skip]
    unknown = {target, *features} - known
    if unknown:
        raise ValueError(f"no variable {sorted(unknown)}")
    rows = df.na.drop(subset=[target, *features])
    made = rows.select(*keys, "split", F.array(*[F.col(f).cast("double") for f in features]).alias("features"), F.col(target).cast("double").alias("label"))
    return made.where("split").drop("split"), made.where("not split").drop("split")
