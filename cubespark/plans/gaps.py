"""Queries for gap filling and the mask border."""

from __future__ import annotations

from pyspark.sql import functions as F

from cubespark.operators import border, gapfill
from cubespark.plans import query
from cubespark.plans.fixtures import E, ecube, rounded, u
from cubespark.sources import read_table

PIXEL = ["i_h", "i_e"]
SIZES = [0.05, 0.1, 0.25]
_G = E + f""", y as (select * from c where i_t = 12), n as (select count(*) n, count(v) seen from y), z as (select unnest([0.05, 0.1, 0.25])::double gap_size),
q as (select gap_size, i_h, i_e, row_number() over (partition by gap_size order by {u(4, "gap_size || '|' || i_h || '|' || i_e")}, i_h, i_e) rn, round_even(gap_size * n, 0) take, seen from y, n, z where v is not null),
g as (select gap_size, i_h, i_e from q where rn <= take and take <= seen)
"""
_IDX = "cast(i_h as bigint) i_h, cast(i_e as bigint) i_e"


def _layer(cube):
    return cube.df.where("i_t = 12").select(*PIXEL, "v")


def _gaps(cube):
    return gapfill.artificial_gaps(_layer(cube), "v", SIZES, 4, *PIXEL)


@query("layer_report", E + "select count(*) pixels, count(v) known, count(*) - count(v) gaps, round_even((count(*) - count(v)) / count(*) * 100, 0) gap_percent from c where i_t = 12")
def layer_report(spark, d):
    return gapfill.layer_report(_layer(ecube(spark, d)), "v")


@query("artificial_gaps", _G + f"select gap_size, {_IDX} from g")
def artificial_gaps(spark, d):
    return _gaps(ecube(spark, d))


@query("random_points", E + f"select {_IDX} from c where i_t = 12 and v is not null order by {u(6, chr(39) * 2 + ' || i_h || ' + chr(39) + '|' + chr(39) + ' || i_e')}, i_h, i_e limit 50")
def random_points(spark, d):
    return gapfill.random_points(_layer(ecube(spark, d)).where("v is not null"), 50, 6, *PIXEL).select(*PIXEL)


_KNN = _G + """, w as (select i_h, i_e, v, i_h // 6 cl from y where v is not null), a as (select gap_size, g.i_h gh, g.i_e ge, g.i_h // 6 cl from g where gap_size = 0.1),
b as (select a.gh, a.ge, w.i_h, w.i_e, (a.gh - w.i_h) * (a.gh - w.i_h) + (a.ge - w.i_e) * (a.ge - w.i_e) d2 from a join w using (cl) where not exists (select 1 from g where g.gap_size = 0.1 and g.i_h = w.i_h and g.i_e = w.i_e)),
r as (select *, row_number() over (partition by gh, ge order by d2, i_h, i_e) rn from b)
"""


def _neighbours(cube, k):
    known = _layer(cube).where("v is not null").withColumn("class", F.floor(F.col("i_h") / 6))
    gaps = _gaps(cube).where("gap_size = 0.1").drop("gap_size").withColumn("class", F.floor(F.col("i_h") / 6))
    return gapfill.nearest_known(gaps, known.join(gaps.select(*PIXEL), PIXEL, "left_anti"), PIXEL, k, same="class", extent=24)


@query("knn_predictors", _KNN + "select cast(gh as bigint) g_i_h, cast(ge as bigint) g_i_e, cast(i_h as bigint) i_h, cast(i_e as bigint) i_e, cast(d2 as bigint) d2, cast(rn as bigint) rank from r where rn <= 5")
def knn_predictors(spark, d):
    return _neighbours(ecube(spark, d), 5)


@query("predictor_matrix", _KNN + "select cast(gh as bigint) g_i_h, cast(ge as bigint) g_i_e, cast(c.i_t as bigint) i_t, string_agg(coalesce(cast(cast(floor(c.v) as bigint) as varchar), '-'), ',' order by rn) x from r join c on c.i_h = r.i_h and c.i_e = r.i_e where rn <= 5 group by 1, 2, 3")
def predictor_matrix(spark, d):
    cube = ecube(spark, d)
    rows = gapfill.predictor_matrix(_neighbours(cube, 5), cube, "v", "t", ["g_i_h", "g_i_e"])
    return rows.withColumn("x", F.array_join(F.transform("x", lambda v: F.coalesce(F.floor(v).cast("bigint").cast("string"), F.lit("-"))), ","))


_NEAR = _G + """, w as (select z.gap_size, i_h, i_e, v from y, z where v is not null and not exists (select 1 from g where g.gap_size = z.gap_size and g.i_h = y.i_h and g.i_e = y.i_e)),
b as (select g.gap_size, g.i_h, g.i_e, w.v, row_number() over (partition by g.gap_size, g.i_h, g.i_e order by (g.i_h - w.i_h) * (g.i_h - w.i_h) + (g.i_e - w.i_e) * (g.i_e - w.i_e), w.i_h, w.i_e) rn from g join w on w.gap_size = g.gap_size),
f as (select gap_size, i_h, i_e, v filled from b where rn = 1)
"""


def _nearest(cube, size):
    gaps = _gaps(cube).where(F.col("gap_size") == size)
    known = _layer(cube).where("v is not null").join(gaps.select(*PIXEL), PIXEL, "left_anti")
    return gapfill.interpolate(gaps, known, PIXEL, "v", extent=24)


@query("nearest_interpolation", _NEAR + f"select gap_size, {_IDX}, round(filled, 6) filled from f where gap_size = 0.25")
def nearest_interpolation(spark, d):
    return rounded(_nearest(ecube(spark, d), 0.25), "filled")


@query("gapfill_nearest_mae", _NEAR + "select gap_size, count(filled) filled, round_even(avg(abs(y.v - f.filled)), 3) mae from f join y on y.i_h = f.i_h and y.i_e = f.i_e group by gap_size")
def gapfill_nearest_mae(spark, d):
    cube = ecube(spark, d)
    filled = None
    for size in SIZES:
        one = _nearest(cube, size)
        filled = one if filled is None else filled.unionByName(one)
    return gapfill.gap_scores(filled.join(_layer(cube), PIXEL), "v", "filled", "gap_size")


@query("gapfill_svr")
def gapfill_svr(spark, d):
    """Not told in SQL: each pixel's model is solved iteratively."""
    cube = ecube(spark, d)
    out = gapfill.fill_gaps(cube, "v", "t", 12, _gaps(cube).where("gap_size = 0.1"), n_points=20, hyperparameters="Custom", seed=1)
    return rounded(out, "actual", "filled", "cv_error", places=4)


@query("gapfill_svr_classes")
def gapfill_svr_classes(spark, d):
    cube = ecube(spark, d)
    classes = _layer(cube).select(*PIXEL, F.floor(F.col("i_h") / 6).alias("class"))
    out = gapfill.fill_gaps(cube, "v", "t", 12, _gaps(cube).where("gap_size = 0.05"), predictor="classes", classes=classes, k=10, seed=1)
    return rounded(out, "actual", "filled", "cv_error", places=4)


@query("gapfill_study")
def gapfill_study(spark, d):
    """Real gaps of a layer filled by the models, with their cross-validated error."""
    return gapfill.study(ecube(spark, d), "v", "t", seed=2, n_points=15, hyperparameters="Custom")[1]


_B = """with g as (select s_suppkey % 20 x, s_suppkey // 20 y, s_nationkey < 15 m from supplier), i as (select x, y from g where m),
er as (select i.x, i.y from i where (select count(*) from i j where abs(j.x - i.x) + abs(j.y - i.y) = 1) = 4), ed as (select * from i except select * from er)
select x, y, m, exists (select 1 from ed where abs(ed.x - g.x) + abs(ed.y - g.y) <= 1) as border from g"""


@query("mask_border", _B)
def mask_border(spark, d):
    grid = read_table(spark, d, "supplier").select((F.col("s_suppkey") % 20).alias("x"), F.floor(F.col("s_suppkey") / 20).alias("y"), (F.col("s_nationkey") < 15).alias("m"))
    return border.mask_border(grid, "x", "y", "m")
