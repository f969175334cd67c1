"""Artificial gaps, predictors of a pixel, and gap filling by one small model a pixel."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cubespark.cube import Cube
from cubespark.functions import uniform
from cubespark.operators.svr import fit_svr, search


def pixel_dims(cube: Cube, layer_dim: str) -> list[str]:
    return [d for d in cube.dims if d != layer_dim]


def layer_report(layer: DataFrame, variable: str) -> DataFrame:
    """Pixels, gaps, whole percent of gaps and known pixels of a layer."""
    n = layer.agg(F.count("*").alias("pixels"), F.count(variable).alias("known"))
    return n.select("pixels", "known", (F.col("pixels") - F.col("known")).alias("gaps"), F.bround((F.col("pixels") - F.col("known")) / F.col("pixels") * 100, 0).alias("gap_percent"))


def artificial_gaps(layer: DataFrame, variable: str, sizes: list[float], seed: int, *pixel: str) -> DataFrame:
    """gap_size and the pixel of exactly round(size * pixels) observed values a size, in hash order; sizes larger than the
    observed values are skipped. A layer is two-dimensional, so the ranks are small next to the cube."""
    spark = layer.sparkSession
    g = spark.createDataFrame([(float(s),) for s in sizes], "gap_size double")
    n = layer.agg(F.count("*").alias("_n"), F.count(variable).alias("_seen"))
    g = g.crossJoin(n).withColumn("_take", F.bround(F.col("gap_size") * F.col("_n"), 0).cast("bigint")).where("_take <= _seen")
    rows = layer.where(F.col(variable).isNotNull()).crossJoin(F.broadcast(g))
    rank = F.row_number().over(Window.partitionBy("gap_size").orderBy(uniform(seed, "gap_size", *pixel), *pixel))
    return rows.withColumn("_rn", rank).where("_rn <= _take").select("gap_size", *pixel)


def random_points(known: DataFrame, n: int, seed: int, *pixel: str) -> DataFrame:
    """n known pixels in hash order; all where there are fewer."""
    return known.orderBy(uniform(seed, *pixel), *pixel).limit(n)


def _distance(pixel: list[str]):
    return sum(((F.col(f"g_{p}") - F.col(p)) * (F.col(f"g_{p}") - F.col(p)) for p in pixel), F.lit(0))


def _extent(known: DataFrame, gaps: DataFrame, pixel: list[str]) -> int:
    """A bound on how far apart pixels can be in one dimension."""
    both = known.select(*pixel).unionByName(gaps.select(*pixel))
    row = both.agg(*[f(p).alias(f"{p}{k}") for p in pixel for k, f in enumerate((F.min, F.max))]).first()
    return max([(row[f"{p}1"] or 0) - (row[f"{p}0"] or 0) for p in pixel], default=0) + 1


def nearest_known(gaps: DataFrame, known: DataFrame, pixel: list[str], k: int, same: str | list[str] | None = None, value: str | None = None, extent: int | None = None, tile: int = 32) -> DataFrame:
    """For each gap pixel the k nearest known ones (ties in row-major order), among those equal in same if given.

    Pixels meet by tiles: a gap joins the known pixels of its tile and those around, which hold all within a tile's side of
    it. If its k-th is no farther, it is done; what is left goes on with tiles four times as wide, until a tile's side
    reaches the extent (pixels along the longest dimension; looked up if not given) and nothing can lie outside.
    """
    same = [same] if isinstance(same, str) else same or []
    held = [c for c in gaps.columns if c not in {*pixel, *same}]
    extent = _extent(known, gaps, pixel) if extent is None else extent
    keys = [*held, *[f"g_{p}" for p in pixel]]
    left = gaps.select(*held, *same, *[F.col(p).alias(f"g_{p}") for p in pixel])
    right = known.select(*pixel, *same, *([value] if value else []))
    by = Window.partitionBy(*keys, *same)
    found = None
    while True:
        asked = left
        for p in pixel:
            home = F.floor(F.col(f"g_{p}") / tile)
            # a tile as wide as the layer has no neighbours that matter but the one across its edge
            asked = asked.withColumn(f"t_{p}", F.explode(F.sequence(home - 1, home + 1)))
        tiled = right.select("*", *[F.floor(F.col(p) / tile).alias(f"t_{p}") for p in pixel])
        pairs = asked.join(tiled, [*same, *[f"t_{p}" for p in pixel]]).drop(*[f"t_{p}" for p in pixel]).withColumn("d2", _distance(pixel).cast("bigint"))
        near = pairs.withColumn("rank", F.row_number().over(by.orderBy("d2", *pixel)).cast("bigint")).where(F.col("rank") <= k)
        out = [*keys, *pixel, *([value] if value else []), "d2", "rank"]
        if tile >= extent:
            near = near.select(*out)
            return near if found is None else found.unionByName(near)
        near = near.withColumn("_kth", F.max(F.when(F.col("rank") == k, F.col("d2"))).over(by)).where(F.col("_kth") <= tile * tile).persist()
        found = near.select(*out) if found is None else found.unionByName(near.select(*out))
        left = left.join(near.select(*keys, *same).distinct(), [*keys, *same], "left_anti")
        tile *= 4


def interpolate(gaps: DataFrame, known: DataFrame, pixel: list[str], value: str, min_known: int = 11, extent: int | None = None) -> DataFrame:
    """The nearest known value of each gap pixel, ties in row-major order; NULL with fewer than min_known known ones."""
    held = [c for c in gaps.columns if c not in pixel]
    n = known.agg(F.count("*").alias("_known"))  # one row
    best = nearest_known(gaps, known, pixel, 1, value=value, extent=extent)
    best = best.select(*held, *[F.col(f"g_{p}").alias(p) for p in pixel], F.col(value).alias("filled"))
    out = gaps.select(*held, *pixel).join(best, [*held, *pixel], "left").crossJoin(F.broadcast(n))
    return out.select(*held, *pixel, F.when(F.col("_known") >= min_known, F.col("filled")).alias("filled"))


def predictor_matrix(predictors: DataFrame, cube: Cube, variable: str, layer_dim: str, keys: list[str]) -> DataFrame:
    """Per gap and layer, the predictors' values in rank order: the rows of the pixel's training table."""
    pixel = [f"i_{d}" for d in pixel_dims(cube, layer_dim)]
    joined = predictors.join(cube.df.select(f"i_{layer_dim}", *pixel, variable), pixel)
    ordered = F.array_sort(F.collect_list(F.struct("rank", F.col(variable).alias("v"))))
    return joined.groupBy(*keys, f"i_{layer_dim}").agg(ordered.alias("_x")).select(*keys, f"i_{layer_dim}", F.col("_x.v").alias("x"))


def gap_scores(filled: DataFrame, actual: str, predicted: str, *by: str) -> DataFrame:
    """Mean absolute error to three places."""
    return filled.groupBy(*by).agg(F.count(predicted).alias("filled"), F.bround(F.avg(F.abs(F.col(actual) - F.col(predicted))), 3).alias("mae"))


def _pixel_model(history: np.ndarray, own: np.ndarray, now: np.ndarray, strategy: str, seed: int) -> tuple[float, float] | None:
    """Prediction and cross-validated error for one gap pixel; None where nothing can be fitted."""
    history, now = history[:, ~np.isnan(now)], now[~np.isnan(now)]
    ok = ~np.isnan(own) & ~np.isnan(history).any(axis=1)
    x, y = history[ok], own[ok]
    if len(y) < 6 or not x.shape[1]:
        return None
    both = np.vstack([x, now])
    std = both.std(axis=0)
    both = (both - both.mean(axis=0)) / np.where(std == 0, 1, std)
    rng = np.random.default_rng(seed)
    c, epsilon, error = search(both[:-1], y, strategy, rng)
    w, bias = fit_svr(both[:-1], y, c, epsilon)
    return float(both[-1] @ w + bias), error


def fill_gaps(cube: Cube, variable: str, layer_dim: str, layer: int, gaps: DataFrame, predictor: str = "RandomPoints", classes: DataFrame | None = None, hyperparameters: str = "RandomGridSearch", n_points: int = 100, k: int = 40, seed: int = 0) -> DataFrame:
    """gap_size, pixel, actual, filled, cv_error and how (model or nearest) of each gap pixel.

    gaps has gap_size and the pixel's index columns. Predictors are known pixels of the layer: random ones, all
    (AllPoints), or the nearest of the gap's class. One model a gap pixel is fitted on the other layers, with the rows of a
    gap brought together; pixels without enough history take the nearest known value.
    """
    pixel = [f"i_{d}" for d in pixel_dims(cube, layer_dim)]
    keys = ["gap_size", *[f"g_{p}" for p in pixel]]
    target = cube.df.where(F.col(f"i_{layer_dim}") == layer).select(*pixel, F.col(variable).alias("now"))
    extent = max(cube.sizes[d] for d in pixel_dims(cube, layer_dim))
    sizes = gaps.select("gap_size").distinct()
    # known in a variant of the layer: observed and not one of its gaps
    known = sizes.crossJoin(target.where("now is not null")).join(gaps, ["gap_size", *pixel], "left_anti")
    renamed = gaps.select("gap_size", *[F.col(p).alias(f"g_{p}") for p in pixel])
    if predictor == "classes":
        side = classes.select(*pixel, "class")
        asked = gaps.select("gap_size", *pixel).join(side, pixel).withColumn("_size", F.col("gap_size"))
        chosen = nearest_known(asked, known.join(side, pixel).withColumn("_size", F.col("gap_size")), pixel, k, same=["_size", "class"], value="now", extent=extent).select(*keys, *pixel, "rank", "now")
    else:
        order = [uniform(seed, *pixel), *map(F.col, pixel)] if predictor == "RandomPoints" else list(map(F.col, pixel))
        rank = F.row_number().over(Window.partitionBy("gap_size").orderBy(*order))
        points = known.withColumn("rank", rank)
        points = points.where(F.col("rank") <= n_points) if predictor == "RandomPoints" else points
        chosen = renamed.join(points, "gap_size").select(*keys, *pixel, "rank", "now")
    history = cube.df.where(F.col(f"i_{layer_dim}") != layer).select(F.col(f"i_{layer_dim}").alias("t"), *pixel, F.col(variable).alias("v"))
    rows = chosen.join(history.groupBy(*pixel).agg(F.array_sort(F.collect_list(F.struct("t", "v"))).alias("past")), pixel)
    own = history.groupBy(*[F.col(p).alias(f"g_{p}") for p in pixel]).agg(F.array_sort(F.collect_list(F.struct("t", "v"))).alias("own"))
    rows = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("rank", "now", F.col("past.v").alias("past")))).alias("points")).join(own, [f"g_{p}" for p in pixel])
    packed = rows.select(*keys, F.transform("points", lambda p: p["now"]).alias("now"), F.transform("points", lambda p: p["past"]).alias("past"), F.col("own.v").alias("own"))

    def fit(batches):
        for pdf in batches:
            found = []
            for row in pdf.itertuples(index=False):
                past = np.array([np.asarray(x, float) for x in row.past], float).T
                found.append(_pixel_model(past, np.asarray(row.own, float), np.asarray(row.now, float), hyperparameters, seed) or (np.nan, np.nan))
            yield pd.DataFrame({c: pdf[c] for c in keys}).assign(model=[f[0] for f in found], cv_error=[f[1] for f in found])

    spec = ", ".join([f"gap_size double, {', '.join(f'`g_{p}` bigint' for p in pixel)}", "model double, cv_error double"])
    # models take long and rows are few, so they are dealt out by number, not by size
    spark = cube.df.sparkSession
    n = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    fitted = packed.repartition(n, *keys).mapInPandas(fit, spec)
    near = nearest_known(gaps.select("gap_size", *pixel).withColumn("_size", F.col("gap_size")), known.withColumn("_size", F.col("gap_size")), pixel, 1, same=["_size"], value="now", extent=extent)
    near = near.select(*keys, F.col("now").alias("near"))
    actual = target.select(*[F.col(p).alias(f"g_{p}") for p in pixel], F.col("now").alias("actual"))
    out = renamed.join(actual, [f"g_{p}" for p in pixel], "left").join(near, keys, "left").join(fitted, keys, "left")
    return out.select("gap_size", *[F.col(f"g_{p}").alias(p) for p in pixel], "actual", F.coalesce("model", "near").alias("filled"), "cv_error", F.when(F.col("model").isNotNull(), "model").when(F.col("near").isNotNull(), "nearest").alias("how"))


def study(cube: Cube, variable: str, layer_dim: str, layer: object = None, sizes: list[float] | None = None, seed: int = 0, **options) -> tuple[DataFrame, DataFrame]:
    """Fill one layer's gaps and score it: (filled pixels, one row a gap size with errors).

    layer is a label (the nearest is taken) or None for one picked by the seed. With sizes, artificial gaps of those shares
    are filled and scored against the values they hide; without, the layer's own gaps are filled, and nothing is scored.
    """
    from cubespark.operators.selection import nearest_index, random_index

    index = random_index(cube, layer_dim, seed).first()[0] if layer is None else nearest_index(cube, layer_dim, layer)
    pixel = [f"i_{d}" for d in pixel_dims(cube, layer_dim)]
    target = cube.df.where(F.col(f"i_{layer_dim}") == index).select(*pixel, variable)
    if sizes:
        gaps = artificial_gaps(target, variable, sizes, seed, *pixel)
    else:
        share = layer_report(target, variable).select(F.round(F.col("gaps") / F.col("pixels"), 3).cast("double").alias("gap_size"))
        gaps = target.where(F.col(variable).isNull()).crossJoin(F.broadcast(share)).select("gap_size", *pixel)
    filled = fill_gaps(cube, variable, layer_dim, index, gaps, seed=seed, **options)
    scores = filled.groupBy("gap_size").agg(F.count("*").alias("gaps"), F.count("filled").alias("filled"), F.bround(F.avg(F.abs(F.col("actual") - F.col("filled"))), 3).alias("mae"), F.bround(F.avg("cv_error"), 3).alias("cv_mae"))
    return filled, scores
