"""Queries for models, sinks and streams."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import functions as F

from cubespark import sources, streaming
from cubespark.functions import uniform
from cubespark.operators import samples, scaling, selection, splitting, training
from cubespark.plans import query
from cubespark.plans.fixtures import BLOCK, E, L, ecube, lcube, rounded, u
from cubespark.sources import read_table


def scratch(spark, name: str) -> str:
    """A folder of its own in the session's shared folder; a local session may use a temporary one."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        top = tempfile.gettempdir() + "/checkpoints"
    return f"{top}/cube-{name}-{uuid.uuid4().hex}"


@query("ols_fit", L + "select round(regr_slope(price, qty), 4) slope, round(regr_intercept(price, qty), 2) bias from k")
def ols_fit(spark, d):
    p = training.fit_linear(lcube(spark, d).observed, ["qty"], "price")
    return spark.createDataFrame([(round(p["qty"], 4), round(p["bias"], 2))], "slope double, bias double")


@query("predict_missing", L + """, h as (select *, case when (i_m + i_s + i_l) % 5 <> 0 then price end y from k where qty is not null), f as (select regr_slope(y, qty) a, regr_intercept(y, qty) b from h)
select cast(i_m as bigint) i_m, cast(i_s as bigint) i_s, cast(i_l as bigint) i_l, y is null as predicted, round(coalesce(y, b + a * qty), 6) y from h, f""")
def predict_missing(spark, d):
    cube = lcube(spark, d)
    df = cube.known("qty").withColumn("y", F.when((F.col("i_m") + F.col("i_s") + F.col("i_l")) % 5 != 0, F.col("price")))
    params = training.fit_linear(df, ["qty"], "y")
    return rounded(training.predict_missing(df.select(*cube.index(), "qty", "y"), params, "y").select(*cube.index(), "predicted", "y"), "y")


@query("predict_unscaled", L + """, n as (select * from k where qty is not null), s as (select avg(qty) aq, stddev_pop(qty) sq, avg(price) ap, stddev_pop(price) sp, regr_slope(price, qty) a from n)
select cast(i_m as bigint) i_m, cast(i_s as bigint) i_s, cast(i_l as bigint) i_l, round((qty - aq) * a + ap, 3) price from n, s""")
def predict_unscaled(spark, d):
    cube = lcube(spark, d)
    df = cube.known("qty")
    scales = scaling.scale_params(df, ["qty", "price"], "standardize")
    scaled = scaling.scale(df, scales, "standardize")
    out = training.predict(scaled.drop("price"), training.fit_linear(scaled, ["qty"], "price"), "price")
    return rounded(scaling.unscale(out, {"price": scales["price"]}, "standardize").select(*cube.index(), "price"), "price", places=3)


_SGD = L + f""", n as materialized (select *, {u(7, "((i_m * (select count(*) from ax_s) + i_s) * (select count(*) from ax_l) + i_l)")} < 0.8 as split from k where qty is not null),
s as materialized (select avg(qty) aq, stddev_pop(qty) sq, avg(price) ap, stddev_pop(price) sp from n),
z as materialized (select split, (qty - aq) / sq x, (price - ap) / sp y from n, s),
m as materialized (select split, avg(x) x, avg(y) y, avg(x * x) xx, avg(x * y) xy, avg(y * y) yy from z group by split),
e as (with recursive e(epoch, a, b) as (
    select 0, 0.0::double, 0.0::double union all
    select epoch + 1, a - 0.4 * (a * xx + b * x - xy), b - 0.4 * (a * x + b - y) from e, m where m.split and epoch < 5) select * from e),
l as (select epoch, split, a * a * xx + b * b + yy + 2 * a * b * x - 2 * a * xy - 2 * b * y as loss from e, m),
h as (select f.epoch, f.loss as train_loss, g.loss as valid_loss, coalesce(g.loss < min(g.loss) over (order by f.epoch rows between unbounded preceding and 1 preceding), true) as better
      from l f join l g on g.epoch = f.epoch + 1 where f.split and not g.split),
w as (select *, epoch - max(case when better then epoch end) over (order by epoch) as strikes from h)
select cast(epoch as bigint) epoch, round(train_loss, 6) train_loss, round(valid_loss, 6) valid_loss from w where epoch <= coalesce((select min(epoch) from w where strikes >= 2), 99)"""


@query("sgd_fit", _SGD)
def sgd_fit(spark, d):
    cube = lcube(spark, d)
    df = cube.known("qty").withColumn("split", uniform(7, cube.cell_number()) < 0.8)
    df = scaling.scale(df, scaling.scale_params(df, ["qty", "price"], "standardize"), "standardize").select("qty", "price", "split")
    t = training.Trainer(["qty"], "price", rate=0.2, epochs=5, patience=2)
    t.train(df.where("split"), df.where("not split"))
    return spark.createDataFrame([(e, round(a, 6), round(b, 6)) for e, a, b in t.history], "epoch bigint, train_loss double, valid_loss double")


@query("rechunk", E + "select cast(chunk as bigint) chunk_id, count(*) cells, count(v) seen from (select (i_t // 5 * 4 + i_h // 6) * 5 + i_e as chunk, v from c) group by 1")
def rechunk(spark, d):
    one, two = scratch(spark, "source"), scratch(spark, "target")
    sources.write_cube(ecube(spark, d), one, BLOCK)
    chunks = {"t": 5, "h": 6, "e": 1}
    sources.rechunk(spark, one, ["t", "h", "e"], chunks, two)
    return spark.read.parquet(two).groupBy("chunk_id").agg(F.count("*").alias("cells"), F.count("v").alias("seen"))


@query("sample_sink", E + f"select {u(7, 'cell')} < 0.7 as train, count(*) n, round(sum(v), 4) total from c where v is not null group by 1")
def sample_sink(spark, d):
    path = scratch(spark, "samples")
    cube = splitting.random_split(ecube(spark, d), 0.7, 7)
    for part in range(2):  # two appends, as batches of chunks come
        sources.write_samples(cube.df.where(f"v is not null and i_t % 2 = {part}").select("v", "split"), path)
    train, test = sources.read_samples(spark, path)
    both = train.withColumn("train", F.lit(True)).unionByName(test.withColumn("train", F.lit(False)))
    return rounded(both.groupBy("train").agg(F.count("*").alias("n"), F.sum("v").alias("total")), "total", places=4)


@query("whole_groups", "with r as (select event_id, row_number() over (order by event_id) rn, count(*) over () n from events) select event_id from r where rn <= n // 184 * 184")
def whole_groups(spark, d):
    return sources.whole_groups(read_table(spark, d, "events").select("event_id"), 184, "event_id")


@query("stream_append", "select event_type, count(*) n, round(sum(value), 4) total from events group by event_type")
def stream_append(spark, d):
    path, events = scratch(spark, "stream"), f"{d}/events.parquet"
    stream = spark.readStream.schema(spark.read.parquet(events).schema).option("pathGlobFilter", "*.parquet").parquet(f"{d}/events*.parquet")
    q = streaming.append_batches(stream.select("event_id", "event_type", "value"), path, path + "-state")
    q.awaitTermination()
    return rounded(spark.read.parquet(path).groupBy("event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")), "total", places=4)


@query("append_carried", "with r as (select event_id, row_number() over (order by event_id) rn, count(*) over () n from events) select event_id from r where rn <= n // 184 * 184")
def append_carried(spark, d):
    """Three appends of thirds, whole groups only; what one leaves goes with the next."""
    path, events = scratch(spark, "carried"), read_table(spark, d, "events").select("event_id")
    third = events.agg(F.max("event_id")).first()[0] // 3 + 1
    for k in range(3):
        sources.append_whole_groups(events.where(F.col("event_id").between(k * third, (k + 1) * third - 1)), path, 184, "event_id")
    return spark.read.parquet(path)


_POINTS = E + f""", k as (select *, min(v) over () lo, max(v) over () hi from c),
r as (select (v - lo) / (hi - lo) v, row_number() over (partition by chunk_id order by {u(3, "chunk_id || '|' || i_t || '|' || i_h || '|' || i_e")}, chunk_id, i_t, i_h, i_e) <= floor(count(*) over (partition by chunk_id) * 0.8 + 1e-9) as train from k where v is not null)
select train, count(*) n, round(sum(v), 4) total from r group by train"""


@query("chunk_sampler", _POINTS)
def chunk_sampler(spark, d):
    """Points of all chunks, normalised, split by chunk, through a folder."""
    sampler = samples.ChunkSampler(ecube(spark, d), scratch(spark, "sampler"), share=0.8, seed=3, scale_by="normalize")
    sampler.create()
    train, test = sampler.datasets()
    both = train.withColumn("train", F.lit(True)).unionByName(test.withColumn("train", F.lit(False)))
    return rounded(both.groupBy("train").agg(F.count("*").alias("n"), F.sum("v").alias("total")), "total", places=4)


@query("chunk_dataset", E + "select cast(i_t - 10 as bigint) i_t, cast(i_h - 8 as bigint) i_h, cast(i_e as bigint) i_e, round(v, 6) v from c where chunk_id = 8")
def chunk_dataset(spark, d):
    """One chunk by number, as a frame on the driver."""
    frame = samples.ChunkDataset(ecube(spark, d), chunks=[3, 8])[1]
    rows = [(int(t), int(h), int(e), None if v != v else round(float(v), 6)) for t, h, e, v in frame[["i_t", "i_h", "i_e", "v"]].itertuples(index=False)]
    return spark.createDataFrame(rows, "i_t bigint, i_h bigint, i_e bigint, v double")


@query("batches_with_tail", E + f", r as (select cell, row_number() over (order by {u(9, 'cell')}, cell) rn from c where v is not null) select cast(cell as bigint) cell, cast((rn - 1) // 64 as bigint) batch_id from r")
def batches_with_tail(spark, d):
    cube = ecube(spark, d)
    return samples.batches(cube.known("v").select(cube.cell_number().alias("cell")), 64, 9, "cell", drop_last=False)


@query("warm_start", L + """, m as materialized (select avg(qty) x, avg(price) y, avg(qty * qty) xx, avg(qty * price) xy from k where qty is not null)
select round(2.0 - 0.002 * (2 * xx + 5 * x - xy), 4) qty, round(5.0 - 0.002 * (2 * x + 5 - y), 4) bias from m""")
def warm_start(spark, d):
    """One step from another model's parameters; a name that this one lacks is passed over."""
    t = training.Trainer(["qty"], "price", rate=0.001, epochs=1, warm_start={"qty": 2.0, "bias": 5.0, "other": 1.0})
    p = t.train(lcube(spark, d).observed)
    return spark.createDataFrame([(round(p["qty"], 4), round(p["bias"], 4))], "qty double, bias double")


@query("sample_callback", E + "select count(*) n, round(sum(2 * v), 4) total from c where chunk_id in (0, 3, 4) and v is not null")
def sample_callback(spark, d):
    cells = samples.SampleSet(ecube(spark, d), chunks=[0, 3, 4], scale_by=None, callback=lambda df: df.withColumn("v", F.col("v") * 2)).cells
    return rounded(cells.agg(F.count("*").alias("n"), F.sum("v").alias("total")), "total", places=4)


@query("pyramid_level", E + "select cast(i_t as bigint) i_t, count(*) cells, count(v) seen, round(sum(v), 4) total from c where i_h % 2 = 0 group by 1")
def pyramid_level(spark, d):
    """Every other hour written as level 1 of a pyramid and read back."""
    cube, path = ecube(spark, d), scratch(spark, "pyramid")
    sources.write_cube(cube, f"{path}/level=0", BLOCK)
    sources.write_cube(selection.every(cube, "h", 2), f"{path}/level=1", BLOCK)
    part = sources.read_cube(spark, path, cube.dims, level=1)
    return rounded(part.df.groupBy("i_t").agg(F.count("*").alias("cells"), F.count("v").alias("seen"), F.sum("v").alias("total")), "total", places=4)


@query("windowed_cells", "select cast(cast(ts as date) as varchar) as day, event_type, count(*) n, round(avg(value), 6) mean from events group by all")
def windowed_cells(spark, d):
    """Cells of a stream's daily windows; the last ones wait behind the watermark, so an even later row closes them."""
    path, events = scratch(spark, "windows"), read_table(spark, d, "events").select("ts", "event_type", "value")
    late = events.agg(F.max("ts").alias("ts")).select((F.col("ts") + F.expr("interval 30 days")).alias("ts"), F.lit("end").alias("event_type"), F.lit(0.0).alias("value"))
    events.coalesce(1).write.parquet(f"{path}/in")
    late.write.mode("append").parquet(f"{path}/in")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    # instants whose UTC clock shows ts, whatever the session's zone
    instant = F.expr("timestamp_micros(timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts))")
    cells = streaming.windowed_cells(stream.withColumn("ts", instant), "ts", "1 day", "1 day", ["event_type"], {"n": F.count("*"), "mean": F.avg("value")})
    q = cells.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    out = spark.read.parquet(f"{path}/out").where("event_type <> 'end'")
    return rounded(out.select(F.expr("cast(date_add(date'1970-01-01', cast(unix_micros(ts) div 86400000000 as int)) as string)").alias("day"), "event_type", "n", "mean"), "mean")
