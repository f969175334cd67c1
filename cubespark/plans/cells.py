"""Queries on cells, chunks, windows, cleaning, scaling and splits."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from cubespark.functions import missing_to_null, uniform
from cubespark.operators import cleaning, geometry, samples, scaling, selection, splitting, statistics
from cubespark.plans import query
from cubespark.plans.fixtures import BLOCK, E, L, ecube, lcube, masked, rounded, u
from cubespark.sources import read_table

CELL = "cast(i_t as bigint) as i_t, cast(i_h as bigint) as i_h, cast(i_e as bigint) as i_e"


@query("gap_heat_map", E + "select cast(i_h as bigint) i_h, cast(i_e as bigint) i_e, cast(h as bigint) h, e, count(v) as n_obs from c group by all")
def gap_heat_map(spark, d):
    return statistics.gap_heat_map(ecube(spark, d), "v", "t")


@query("value_range", L + "select round(min(qty), 6) qty_min, round(max(qty), 6) qty_max, round(min(price), 6) price_min, round(max(price), 6) price_max, round(min(disc), 6) disc_min, round(max(disc), 6) disc_max from k")
def value_range(spark, d):
    df = statistics.value_range(lcube(spark, d))
    return rounded(df, *df.columns)


@query("statistics", L + "select round(avg(qty), 6) qty_mean, round(stddev_pop(qty), 6) qty_std, round(avg(price), 4) price_mean, round(stddev_pop(price), 4) price_std from k")
def statistics_(spark, d):
    df = statistics.statistics(lcube(spark, d), exclude=["disc"])
    return rounded(rounded(df, "qty_mean", "qty_std"), "price_mean", "price_std", places=4)


@query("dim_range", E + "select cast(min(t) as varchar) t_first, cast(max(t) as varchar) t_last, cast(min(h) as bigint) h_first, cast(max(h) as bigint) h_last, min(e) e_first, max(e) e_last from c")
def dim_range(spark, d):
    cube = ecube(spark, d)
    return spark.range(1).select(*[F.lit(x).cast("bigint" if n == "h" else "string").alias(f"{n}_{w}") for n in cube.dims for w, x in zip(("first", "last"), geometry.dim_range(cube, n), strict=True)])


@query("layer_gap_ratio", E + "select cast(i_t as bigint) i_t, cast(t as varchar) t, count(*) cells, count(*) - count(v) gaps, round_even((count(*) - count(v)) / count(*), 2) ratio from c group by i_t, t")
def layer_gap_ratio(spark, d):
    return statistics.layer_gaps(ecube(spark, d), "v", "t").withColumn("t", F.col("t").cast("string"))


@query("layer_extremes", E + ", g as (select i_t, t, round_even((count(*) - count(v)) / count(*), 2) r from c group by all) select cast((select t from g where r > 0 order by r desc, i_t limit 1) as varchar) most_layer, (select r from g where r > 0 order by r desc, i_t limit 1) most_ratio, cast((select t from g where r < 1 order by r, i_t limit 1) as varchar) least_layer, (select r from g where r < 1 order by r, i_t limit 1) least_ratio")
def layer_extremes(spark, d):
    return statistics.layer_extremes(ecube(spark, d), "v", "t").withColumns({c: F.col(c).cast("string") for c in ("most_layer", "least_layer")})


@query("insights", E + """, g as (select i_t, t, round_even((count(*) - count(v)) / count(*), 2) r from c group by all), o as (select count(*) n, count(*) - count(v) gaps, min(v) lo, max(v) hi from c)
select 30 t_size, cast((select min(t) from c) as varchar) t_first, cast((select max(t) from c) as varchar) t_last, 24 h_size, 0 h_first, 23 h_last, 5 e_size, (select min(e) from c) e_first, (select max(e) from c) e_last,
n cells, gaps, round_even(gaps / n, 2) ratio, cast(floor(round_even(gaps / n, 2) * 100 + 1e-9) as int) percent, round(lo, 6) "min", round(hi, 6) "max",
cast((select t from g where r > 0 order by r desc, i_t limit 1) as varchar) most_layer, (select r from g where r > 0 order by r desc, i_t limit 1) most_ratio,
cast((select t from g where r < 1 order by r, i_t limit 1) as varchar) least_layer, (select r from g where r < 1 order by r, i_t limit 1) least_ratio from o""")
def insights(spark, d):
    return rounded(statistics.insights(ecube(spark, d), "v", "t"), "min", "max")


@query("total_chunks", E + "select count(distinct chunk_id) as n from c")
def total_chunks(spark, d):
    return spark.range(1).select(F.lit(geometry.total_chunks(ecube(spark, d))).cast("bigint").alias("n"))


@query("chunk_by_index", E + f"select {CELL}, round(v, 6) v from (select i_t - 10 as i_t, i_h - 8 as i_h, i_e - 3 as i_e, v from c where chunk_id = 9)")
def chunk_by_index(spark, d):
    part = geometry.chunk_by_index(ecube(spark, d), 9)
    return rounded(part.df.select(*part.index(), "v"), "v")


@query("chunk_stats", E + "select cast(chunk_id as bigint) chunk_id, count(*) cells, count(v) seen, round(avg(v), 6) mean, round(min(v), 6) \"min\", round(max(v), 6) \"max\" from c group by 1")
def chunk_stats(spark, d):
    return rounded(statistics.chunk_report(ecube(spark, d), "v"), "mean", "min", "max")


@query("block_iter", E + ", f as (select i_t, i_h, i_e, v, (i_t // 7 * 2 + i_h // 12) * 5 + i_e as block from c) select cast(block as bigint) block, count(*) cells, count(v) seen, cast(max(i_t - i_t // 7 * 7) as bigint) last_t from f group by block")
def block_iter(spark, d):
    cube = ecube(spark, d)
    block = {"t": 7, "h": 12, "e": 1}
    return cube.df.withColumn("block", geometry.chunk_number(cube, block)).groupBy("block").agg(F.count("*").alias("cells"), F.count("v").alias("seen"), F.max(F.col("i_t") % 7).alias("last_t"))


@query("split_chunk_points", E + "select cast(chunk_id as bigint) chunk_id, cast(cell as bigint) cell, round(v, 6) v from c")
def split_chunk_points(spark, d):
    cube = ecube(spark, d)
    return rounded(geometry.with_chunks(cube).select("chunk_id", cube.cell_number().alias("cell"), "v"), "v")


_WINDOWS = E + """, w as (select chunk_id, i_t % 10 lt, i_h % 8 lh, i_e % 3 le, v, least(10, 30 - i_t // 10 * 10) xt, least(8, 24 - i_h // 8 * 8) xh, least(3, 5 - i_e // 3 * 3) xe from c),
x as (select chunk_id, kt, kh, ke, v from w, (select unnest(range(12)) kt), (select unnest(range(12)) kh), (select unnest(range(12)) ke)
  where kt * {st} + {t} <= xt and kh * {sh} + {h} <= xh and ke * {se} + {e} <= xe
    and lt >= kt * {st} and lt < kt * {st} + {t} and lh >= kh * {sh} and lh < kh * {sh} + {h} and le >= ke * {se} and le < ke * {se} + {e})
select cast(chunk_id as bigint) chunk_id, kt w_t, kh w_h, ke w_e, count(*) cells, count(v) seen, round(avg(v), 9) mean from x group by all"""


def _windowed(spark, d, size, overlap=None):
    cube = ecube(spark, d)
    rows = geometry.windows(cube.select("v"), size, overlap)
    return rounded(rows.groupBy(*geometry.window_keys(cube)).agg(F.count("*").alias("cells"), F.count("v").alias("seen"), F.avg("v").alias("mean")), "mean", places=9)


@query("split_chunk_windows", _WINDOWS.format(st=3, t=3, sh=4, h=4, se=2, e=2))
def split_chunk_windows(spark, d):
    return _windowed(spark, d, {"t": 3, "h": 4, "e": 2})


@query("split_chunk_overlap", _WINDOWS.format(st=2, t=4, sh=3, h=5, se=1, e=1))
def split_chunk_overlap(spark, d):
    return _windowed(spark, d, {"t": 4, "h": 5, "e": 1}, {"t": 0.5, "h": 0.5, "e": 0.5})


@query("window_arrays", E + ", w as (select chunk_id, i_t % 10 kt, i_h % 8 // 4 kh, i_h % 4 p, v, i_e % 3 ke from c) select cast(chunk_id as bigint) chunk_id, cast(kt as bigint) w_t, cast(kh as bigint) w_h, cast(ke as bigint) w_e, string_agg(coalesce(cast(cast(floor(v) as bigint) as varchar), '-'), ',' order by p) v from w group by all")
def window_arrays(spark, d):
    cube = ecube(spark, d)
    rows = geometry.as_arrays(geometry.windows(cube.select("v"), {"t": 1, "h": 4, "e": 1}), geometry.window_keys(cube), ["v"])
    return rows.withColumn("v", F.array_join(F.transform("v", lambda x: F.coalesce(F.floor(x).cast("bigint").cast("string"), F.lit("-"))), ","))


@query("label_slice", E + f", s as (select min(t) + 5 as lo, min(t) + 12 as hi from c) select {CELL}, cast(t as varchar) t, round(v, 6) v from (select i_t - 5 as i_t, i_h - 6 as i_h, i_e, t, v from c, s where t between lo and hi and h between 6 and 9)")
def label_slice(spark, d):
    cube = ecube(spark, d)
    t = cube.axes["t"]
    part = selection.slice_labels(cube, t=(t[12], t[5]), h=(6, 9))
    return rounded(part.df.select(*part.index(), F.col("t").cast("string").alias("t"), "v"), "v")


@query("nearest_layer", E + ", s as (select t from ax_t order by abs(t - date '2024-01-10'), t limit 1) select cast(t as varchar) t, cast(h as bigint) h, e, round(v, 6) v from c join s using (t)")
def nearest_layer(spark, d):
    part = selection.layer_nearest(ecube(spark, d), "t", datetime.date(2024, 1, 10))
    return rounded(part.df.select(F.col("t").cast("string").alias("t"), "h", "e", "v"), "v")


@query("random_layer", E + f"select cast(i_t as bigint) i_t, cast(t as varchar) t from ax_t order by {u(3, 'i_t')}, i_t limit 1")
def random_layer(spark, d):
    return selection.random_index(ecube(spark, d), "t", 3).withColumn("t", F.col("t").cast("string"))


@query("history", E + "select cast(i_t as bigint) i_t, count(*) cells, count(v) seen from c where i_t <> 4 group by 1")
def history(spark, d):
    return selection.without_layer(ecube(spark, d), "t", 4).groupBy("i_t").agg(F.count("*").alias("cells"), F.count("v").alias("seen"))


@query("assign_mask", E + "select cast(i_t as bigint) i_t, filter_mask, count(*) cells, count(v) seen from m group by 1, 2")
def assign_mask(spark, d):
    return masked(ecube(spark, d)).df.groupBy("i_t", "filter_mask").agg(F.count("*").alias("cells"), F.count("v").alias("seen"))


@query("asof_extract", E + """, p as (select unnest([20, 14, 9, 3]) label, unnest(range(4)) i), q as (select i_e, e from ax_e), r as (select unnest(['b', 'm', 'q']) label, unnest(range(3)) i),
a as (select h, greatest(coalesce((select min(i) from p where label <= h), 0) - 1, 0) p0 from ax_h), b as (select i_e, greatest(coalesce((select min(i) from r where label >= e), 0) - 1, 0) p1 from q)
select cast(h as bigint) i_h, cast(i_e as bigint) i_e, cast(p0 * 10 + p1 as bigint) code from a, b""")
def asof_extract(spark, d):
    grid = spark.createDataFrame([(i, j, i * 10 + j) for i in range(4) for j in range(3)], "p0 bigint, p1 bigint, code bigint")
    return selection.extract_by_coordinates(ecube(spark, d), ("h", "e"), grid, ([20, 14, 9, 3], ["b", "m", "q"]), "code")


@query("class_remap", "select s_suppkey, cast(case code when 11 then 10 when 12 then 10 when 61 then 60 when 71 then 70 when 151 then 150 else code end as int) as \"class\" from (select s_suppkey, [10, 11, 12, 61, 71, 90, 151][s_suppkey % 7 + 1] as code from supplier)")
def class_remap(spark, d):
    code = F.element_at(F.array(*[F.lit(x) for x in (10, 11, 12, 61, 71, 90, 151)]), (F.col("s_suppkey") % 7 + 1).cast("int"))
    return read_table(spark, d, "supplier").select("s_suppkey", selection.remap(code, selection.LAND_COVER_GROUPS).alias("class"))


@query("variable_align", E + ", n as (select cast(ts as date) t, cast(hour(ts) as bigint) h, event_type e, max(value) w from events group by all) select cast(i_t as bigint) i_t, count(v) n_v, count(w) n_w, round(sum(w - v), 4) diff from c left join n using (t, h, e) group by i_t")
def variable_align(spark, d):
    from cubespark.cube import from_table

    one = ecube(spark, d)
    df = read_table(spark, d, "events").select("ts", "event_type", "value")
    two = from_table(df, {"t": F.col("ts").cast("date"), "h": F.hour("ts").cast("bigint"), "e": F.col("event_type")}, {"w": F.max("value")}, axes=one.axes)
    return rounded(selection.align([one, two]).groupBy("i_t").agg(F.count("v").alias("n_v"), F.count("w").alias("n_w"), F.sum(F.col("w") - F.col("v")).alias("diff")), "diff", places=4)


@query("date_part_filter", "select cast(count(*) as bigint) n, cast(count(distinct cast(ts as date)) as bigint) n_days from events where year(ts) = 2024 and month(ts) = 1")
def date_part_filter(spark, d):
    return read_table(spark, d, "events").where((F.year("ts") == 2024) & (F.month("ts") == 1)).agg(F.count("*").alias("n"), F.count_distinct(F.col("ts").cast("date")).alias("n_days"))


@query("missing_marker", "select event_id, case when event_id % 7 = 0 then null else round(value, 6) end as value from events")
def missing_marker(spark, d):
    x = missing_to_null(F.when(F.col("event_id") % 7 == 0, F.lit(float("nan"))).otherwise(F.col("value")))
    return read_table(spark, d, "events").select("event_id", F.round(x, 6).alias("value"))


@query("filter_points", E + f"select {CELL}, round(v, 6) v from m where v is not null")
def filter_points(spark, d):
    cube = masked(ecube(spark, d))
    return rounded(cleaning.filter_points(cube.df, ["v"]).select(*cube.index(), "v"), "v")


@query("filter_mask_cells", E + f"select {CELL}, round(case when filter_mask then v end, 6) v from m")
def filter_mask_cells(spark, d):
    cube = masked(ecube(spark, d))
    return rounded(cleaning.mask_cells(cube.df, ["v"]).select(*cube.index(), "v"), "v")


# samples of one day and four hours of one type
_SAMPLE = E + ", s as (select *, i_h // 4 as k from m)"


def _day_samples(spark, d):
    cube = masked(ecube(spark, d))
    return cube, cube.df.withColumn("k", F.floor(F.col("i_h") / 4)), ["i_t", "k", "i_e"]


def _told(df, keys):
    return rounded(df.groupBy(*keys).agg(F.count("*").alias("cells"), F.count("v").alias("seen"), F.sum("v").alias("total")), "total")


_TELL = "select cast(i_t as bigint) i_t, cast(k as bigint) k, cast(i_e as bigint) i_e, count(*) cells, count(v) seen, round(sum(v), 6) total from s group by i_t, k, i_e"


@query("filter_drop_sample", _SAMPLE + _TELL + " having bool_and(filter_mask)")
def filter_drop_sample(spark, d):
    _, df, keys = _day_samples(spark, d)
    return _told(cleaning.drop_unmasked_samples(df, keys), keys)


@query("drop_nan_auto", _SAMPLE + _TELL + " having count(v) = count(*)")
def drop_nan_auto(spark, d):
    _, df, keys = _day_samples(spark, d)
    return _told(cleaning.drop_missing(df, keys, ["v"]), keys)


@query("drop_nan_all", _SAMPLE + _TELL + " having count(v) > 0")
def drop_nan_all(spark, d):
    _, df, keys = _day_samples(spark, d)
    return _told(cleaning.drop_missing(df, keys, ["v"], "if_all_nan"), keys)


@query("drop_nan_masked", _SAMPLE + _TELL + " having bool_or(filter_mask) and count(v) > 0 and bool_and(v is not null or not filter_mask)")
def drop_nan_masked(spark, d):
    _, df, keys = _day_samples(spark, d)
    return _told(cleaning.drop_missing(df, keys, ["v"], "masked", "filter_mask"), keys)


@query("fill_mean", E + f"select {CELL}, round(coalesce(v, avg(v) over (partition by chunk_id)), 6) v from c")
def fill_mean(spark, d):
    cube = ecube(spark, d)
    return rounded(cleaning.fill_missing(geometry.with_chunks(cube), ["v"], "mean", ["chunk_id"]).select(*cube.index(), "v"), "v")


@query("fill_sample_mean", _SAMPLE + f"select {CELL}, round(coalesce(v, avg(v) over (partition by i_t, k, i_e)), 6) v from s")
def fill_sample_mean(spark, d):
    cube, df, keys = _day_samples(spark, d)
    return rounded(cleaning.fill_missing(df, ["v"], "sample_mean", sample=keys).select(*cube.index(), "v"), "v")


@query("fill_constant", E + f"select {CELL}, round(coalesce(v, -1.5), 6)::double v from c")
def fill_constant(spark, d):
    cube = ecube(spark, d)
    return rounded(cleaning.fill_missing(cube.df, ["v"], "constant", const=-1.5).select(*cube.index(), "v"), "v")


@query("fill_noise", E + f"select {CELL}, round(coalesce(v, lo + (hi - lo) * ({u(5, chr(39) + 'v|' + chr(39) + ' || cell')})), 6) v from (select *, min(v) over (partition by chunk_id) lo, max(v) over (partition by chunk_id) hi from c)")
def fill_noise(spark, d):
    cube = ecube(spark, d)
    return rounded(cleaning.fill_missing(geometry.with_chunks(cube), ["v"], "noise", ["chunk_id"], seed=5, cell=cube.cell_number()).select(*cube.index(), "v"), "v")


_LC = "cast(i_m as bigint) i_m, cast(i_s as bigint) i_s, cast(i_l as bigint) i_l"


def _scaled(spark, d, method, back=False):
    cube = lcube(spark, d)
    params = scaling.scale_params(cube.observed, ["qty", "price"], method)
    df = scaling.scale(cube.df, params, method)
    return rounded((scaling.unscale(df, params, method) if back else df).select(*cube.index(), "qty", "price"), "qty", "price", places=4 if back else 6)


@query("normalize", L + f", p as materialized (select min(qty) aq, max(qty) - min(qty) sq, min(price) ap, max(price) - min(price) sp from obs) select {_LC}, round((qty - aq) / sq, 6) qty, round((price - ap) / sp, 6) price from k, p")
def normalize(spark, d):
    return _scaled(spark, d, "normalize")


@query("standardize", L + f", p as materialized (select avg(qty) aq, stddev_pop(qty) sq, avg(price) ap, stddev_pop(price) sp from obs) select {_LC}, round((qty - aq) / sq, 6) qty, round((price - ap) / sp, 6) price from k, p")
def standardize(spark, d):
    return _scaled(spark, d, "standardize")


@query("undo_normalize", L + f"select {_LC}, round(qty, 4) qty, round(price, 4) price from k")
def undo_normalize(spark, d):
    return _scaled(spark, d, "normalize", back=True)


@query("undo_standardize", L + f"select {_LC}, round(qty, 4) qty, round(price, 4) price from k")
def undo_standardize(spark, d):
    return _scaled(spark, d, "standardize", back=True)


@query("rand_split", E + f"select cast(cell as bigint) cell, {u(7, 'cell')} < 0.7 as split from c")
def rand_split(spark, d):
    cube = ecube(spark, d)
    return splitting.random_split(cube, 0.7, 7).df.select(cube.cell_number().alias("cell"), "split")


@query("block_split", E + f"select cast(cell as bigint) cell, {u(7, 'chunk_id')} < 0.7 as split from c")
def block_split(spark, d):
    cube = ecube(spark, d)
    return splitting.block_split(cube, BLOCK, 0.7, 7).df.select(cube.cell_number().alias("cell"), "split")


@query("fraction_split", E + f", r as (select chunk_id, cell, row_number() over (partition by chunk_id order by {u(7, 'cell')}, cell) rn, count(*) over (partition by chunk_id) n from c) select cast(cell as bigint) cell, rn <= floor(n * 0.7 + 1e-9) as split from r")
def fraction_split(spark, d):
    cube = ecube(spark, d)
    df = geometry.with_chunks(cube).withColumn("cell", cube.cell_number())
    return splitting.fraction_split(df, ["chunk_id"], 0.7, 7, "cell").select("cell", "split")


_LCELL = "(i_m * (select count(*) from ax_s) + i_s) * (select count(*) from ax_l) + i_l"


@query("create_split", L + f", t as (select *, {u(7, _LCELL)} < 0.8 as split from k where qty is not null) select case when split then 'train' else 'test' end as role, count(*) n, round(sum(qty), 4) qty, round(sum(disc), 4) disc, round(sum(price), 2) label from t group by 1")
def create_split(spark, d):
    cube = splitting.random_split(lcube(spark, d), 0.8, 7)
    train, test = splitting.create_split(cube.df, "price", ["qty", "disc"], keys=cube.index())
    both = train.withColumn("role", F.lit("train")).unionByName(test.withColumn("role", F.lit("test")))
    out = both.groupBy("role").agg(F.count("*").alias("n"), F.round(F.sum(F.col("features")[0]), 4).alias("qty"), F.round(F.sum(F.col("features")[1]), 4).alias("disc"), F.round(F.sum("label"), 2).alias("label"))
    return out


_PROCESS = E + """, w as (select chunk_id, i_t % 10 kt, i_h % 8 // 4 kh, i_h % 4 p, i_e % 3 ke, case when filter_mask then v end v from m),
g as (select chunk_id, kt, kh, ke from w group by all having count(v) > 0),
f as (select w.*, avg(v) over (partition by w.chunk_id, w.kt, w.kh, w.ke) mean from w join g using (chunk_id, kt, kh, ke))
"""


@query("process_chunk", _PROCESS + "select cast(chunk_id as bigint) chunk_id, cast(kt as bigint) w_t, cast(kh as bigint) w_h, cast(ke as bigint) w_e, p pos, round(coalesce(v, mean), 6) v from f")
def process_chunk(spark, d):
    cells, keys = samples.process(masked(ecube(spark, d)), {"t": 1, "h": 4, "e": 1}, drop="if_all_nan", fill="sample_mean")
    return rounded(cells.select(*keys, "pos", "v"), "v")


@query("choose_chunks", E + f", g as (select chunk_id, count(*) - count(v) bad from c group by 1), o as (select chunk_id, bad < 25 ok, row_number() over (order by {u(2, 'chunk_id')}, chunk_id) rn from g) select cast(chunk_id as bigint) chunk_id from (select *, sum(ok::int) over (order by rn) k from o) where ok and k <= 5")
def choose_chunks(spark, d):
    counts = geometry.with_chunks(ecube(spark, d)).groupBy("chunk_id").agg((F.count("*") - F.count("v") < 25).alias("valid"))
    return samples.choose_chunks(counts, 5, seed=2)


@query("sample_set", E + ", p as (select v, chunk_id from c where chunk_id in (0, 3, 4) and v is not null) select count(*) n, round(avg(v - a), 6) + 0.0 mean, round(stddev_pop((v - a) / s), 6) std from p, (select avg(v) a, stddev_pop(v) s from p)")
def sample_set(spark, d):
    cells = samples.SampleSet(ecube(spark, d), chunks=[0, 3, 4]).cells
    return cells.agg(F.count("*").alias("n"), (F.abs(F.round(F.avg("v"), 6)) + 0.0).alias("mean"), F.round(F.stddev_pop("v"), 6).alias("std"))


@query("batches", E + f", r as (select cell, row_number() over (order by {u(9, 'cell')}, cell) rn, count(*) over () n from c where v is not null) select cast(cell as bigint) cell, cast((rn - 1) // 64 as bigint) batch_id from r where ((rn - 1) // 64 + 1) * 64 <= n")
def batches(spark, d):
    cube = ecube(spark, d)
    points = cube.known("v").select(cube.cell_number().alias("cell"))
    return samples.batches(points, 64, 9, "cell")


@query("lag_features", E + f"select {CELL}, round(v, 6) v, round(lag(v, 1) over w, 6) v_lag1, round(lag(v, 2) over w, 6) v_lag2 from c window w as (partition by i_h, i_e order by i_t)")
def lag_features(spark, d):
    return rounded(samples.lag_features(ecube(spark, d), "v", "t", (1, 2)), "v", "v_lag1", "v_lag2")


@query("to_grid", E + "select cast(i_t as bigint) i_t, cast(h as bigint) h, round(max(case when i_e = 0 then v end), 6) a, round(max(case when i_e = 1 then v end), 6) b from c group by 1, 2")
def to_grid(spark, d):
    wide = ecube(spark, d).df.groupBy("i_t", "h").pivot("i_e", [0, 1]).agg(F.max("v"))
    return rounded(wide.select("i_t", "h", F.col("0").alias("a"), F.col("1").alias("b")), "a", "b")


@query("sentinel_replace", "select event_id, nullif(case when event_id % 5 = 0 then -100 else floor(value) end, -100)::double as value from events")
def sentinel_replace(spark, d):
    x = F.when(F.col("event_id") % 5 == 0, F.lit(-100.0)).otherwise(F.floor("value").cast("double"))
    return read_table(spark, d, "events").select("event_id", F.nullif(x, F.lit(-100.0)).alias("value"))


@query("hash_uniform", f"select o_orderkey, {u(11, 'o_orderkey')} as u from orders")
def hash_uniform(spark, d):
    return read_table(spark, d, "orders").select("o_orderkey", uniform(11, "o_orderkey").alias("u"))
