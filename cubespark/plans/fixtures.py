"""The two test cubes, in Spark and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cubespark.cube import Cube, from_table
from cubespark.sources import read_table

BLOCK = {"t": 10, "h": 8, "e": 3}


def ecube(spark: SparkSession, folder: str) -> Cube:
    """Average event value by day, hour and type: small, with gaps."""
    df = read_table(spark, folder, "events").select("ts", "event_type", "value")
    dims = {"t": F.col("ts").cast("date"), "h": F.hour("ts").cast("bigint"), "e": F.col("event_type")}
    return from_table(df, dims, {"v": F.avg("value")}, axes={"h": range(24)}, chunks=BLOCK)


def lcube(spark: SparkSession, folder: str) -> Cube:
    """Average quantity, price and discount by ship month, supplier and line number."""
    df = read_table(spark, folder, "lineitem").select("l_shipdate", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount")
    dims = {"m": F.trunc(F.col("l_shipdate").cast("date"), "month"), "s": F.col("l_suppkey"), "l": F.col("l_linenumber").cast("bigint")}
    values = {"qty": F.avg("l_quantity"), "price": F.avg("l_extendedprice"), "disc": F.avg("l_discount")}
    return from_table(df, dims, values, chunks={"m": 12, "s": 50, "l": 7})


def masked(cube: Cube) -> Cube:
    """ecube with a mask of its hours 6 to 20, stacked along days."""
    from cubespark.operators.selection import assign_mask

    spark = cube.df.sparkSession
    pixels = spark.createDataFrame([(h, e, 6 <= h <= 20 and e != cube.axes["e"][0]) for h in cube.axes["h"] for e in cube.axes["e"]], "h bigint, e string, mask boolean")
    return assign_mask(cube, pixels, stack_dim="t")


def rounded(df: DataFrame, *columns: str, places: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, places) for c in columns})


#: The events cube in SQL: c has i_t, i_h, i_e, t, h, e, v; m adds the mask.
E = """
with ax_t as (select t, row_number() over (order by t) - 1 as i_t from (select distinct cast(ts as date) as t from events)),
ax_h as (select unnest(range(24)) as h),
ax_e as (select e, row_number() over (order by e) - 1 as i_e from (select distinct event_type as e from events)),
obs as (select cast(ts as date) as t, cast(hour(ts) as bigint) as h, event_type as e, avg(value) as v from events group by all),
c as (select i_t, b.h as i_h, i_e, a.t, b.h, x.e, o.v, (i_t * 24 + b.h) * (select count(*) from ax_e) + i_e as cell,
        (i_t // 10 * 3 + b.h // 8) * 2 + i_e // 3 as chunk_id
      from ax_t a cross join ax_h b cross join ax_e x left join obs o on o.t = a.t and o.h = b.h and o.e = x.e),
m as (select *, h between 6 and 20 and i_e > 0 as filter_mask from c)
"""

#: The lineitem cube in SQL: k has i_m, i_s, i_l, m, s, l, qty, price, disc.
L = """
with ax_m as (select m, row_number() over (order by m) - 1 as i_m from (select distinct cast(date_trunc('month', l_shipdate) as date) as m from lineitem)),
ax_s as (select s, row_number() over (order by s) - 1 as i_s from (select distinct l_suppkey as s from lineitem)),
ax_l as (select l, row_number() over (order by l) - 1 as i_l from (select distinct cast(l_linenumber as bigint) as l from lineitem)),
obs as (select cast(date_trunc('month', l_shipdate) as date) as m, l_suppkey as s, cast(l_linenumber as bigint) as l,
          avg(l_quantity) as qty, avg(l_extendedprice) as price, avg(l_discount) as disc from lineitem group by all),
k as (select i_m, i_s, i_l, a.m, b.s, x.l, o.qty, o.price, o.disc from ax_m a cross join ax_s b cross join ax_l x left join obs o on o.m = a.m and o.s = b.s and o.l = x.l)
"""


def u(seed: int, key: str) -> str:
    """The hash uniform in SQL."""
    return f"cast('0x' || substr(md5('{seed}|' || {key}), 1, 8) as bigint) / 4294967296.0::double"
