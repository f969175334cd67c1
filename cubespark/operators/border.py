"""The border of a mask on a grid: its cells with a neighbour outside, widened by one cell."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _grow(cells: DataFrame, x: str, y: str) -> DataFrame:
    """Cells and their four neighbours."""
    step = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in ((0, 0), (1, 0), (-1, 0), (0, 1), (0, -1))]))
    return cells.withColumn("_s", step).select((F.col(x) + F.col("_s.a")).alias(x), (F.col(y) + F.col("_s.b")).alias(y)).distinct()


def mask_border(grid: DataFrame, x: str, y: str, mask: str) -> DataFrame:
    """grid with a Boolean column border. Erosion takes the cells whose four neighbours all lie in the mask (the grid's
    outside counts as outside); the rest of the mask is dilated once."""
    inside = grid.where(F.col(mask)).select(x, y)
    spread = inside.withColumn("_s", F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in ((0, 0), (1, 0), (-1, 0), (0, 1), (0, -1))])))
    votes = spread.select((F.col(x) + F.col("_s.a")).alias(x), (F.col(y) + F.col("_s.b")).alias(y)).groupBy(x, y).agg(F.count("*").alias("_n"))
    edge = inside.join(votes.where("_n = 5").select(x, y), [x, y], "left_anti")
    return grid.join(_grow(edge, x, y).withColumn("border", F.lit(True)), [x, y], "left").withColumn("border", F.coalesce("border", F.lit(False)))
