"""Small cases of the operators' semantics, held against plain NumPy."""

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from cubespark import sources
from cubespark.cube import Cube, from_table
from cubespark.functions import percent
from cubespark.operators import border, cleaning, gapfill, geometry, metrics, samples, scaling, selection, splitting, statistics, svr, training


def cube_of(spark, a, chunks=None, names=("t", "y", "x")):
    rows = [(*[int(k) for k in i], *[int(k) * 10 for k in i], None if np.isnan(a[i]) else float(a[i])) for i in np.ndindex(a.shape)]
    schema = ", ".join([f"i_{n} bigint" for n in names] + [f"{n} bigint" for n in names] + ["v double"])
    return Cube(spark.createDataFrame(rows, schema), {n: [k * 10 for k in range(s)] for n, s in zip(names, a.shape, strict=True)}, ("v",), chunks or {})


def gappy(shape, seed=0, share=0.3):
    rng = np.random.default_rng(seed)
    a = rng.normal(size=shape)
    a[rng.random(shape) < share] = np.nan
    return a


def test_chunks_cover_the_cube(spark):
    cube = cube_of(spark, gappy((5, 4, 3)), {"t": 2, "y": 3, "x": 2})
    assert geometry.total_chunks(cube) == 3 * 2 * 2
    assert geometry.total_chunks(cube, {"y": 4}) == 3 * 1 * 2
    sizes = {r["chunk_id"]: r["count"] for r in geometry.with_chunks(cube).groupBy("chunk_id").count().collect()}
    assert sum(sizes.values()) == 60 and len(sizes) == 12
    for k in range(12):
        assert geometry.chunk_by_index(cube, k).df.count() == sizes[k]
    with pytest.raises(ValueError):
        geometry.chunk_ranges(cube, 12)


@pytest.mark.parametrize("size,overlap", [((2, 2, 1), 0.0), ((3, 2, 2), 0.5), ((1, 4, 3), 0.5), ((6, 1, 1), 0.0)])
def test_windows_like_numpy(spark, size, overlap):
    a = gappy((5, 7, 3), 3)
    block = {"t": 5, "y": 5, "x": 3}
    cube = cube_of(spark, a, block)
    rows = geometry.windows(cube, dict(zip("tyx", size, strict=True)), dict.fromkeys("tyx", overlap))
    arrays = geometry.as_arrays(rows, geometry.window_keys(cube), ["v"]).collect()
    want = []
    for y0 in (0, 5):
        part = a[:, y0 : y0 + 5]
        stride = [s - (int(s * overlap) if s > 1 else 0) for s in size]
        n = [max(0, (length - s) // d + 1) for length, s, d in zip(part.shape, size, stride, strict=True)]
        for i in np.ndindex(*n):
            w = part[tuple(slice(k * d, k * d + s) for k, d, s in zip(i, stride, size, strict=True))].ravel()
            want.append(tuple(None if np.isnan(x) else float(x) for x in w))
    assert sorted(map(str, want)) == sorted(str(tuple(r["v"])) for r in arrays)


def test_no_stride_is_an_error(spark):
    with pytest.raises(ValueError):
        geometry.windows(cube_of(spark, gappy((4, 2, 2))), {"t": 2, "y": 1, "x": 1}, {"t": 1.0})


def test_dense_cells_of_a_table(spark):
    df = spark.createDataFrame([(1, "a", 2.0), (1, "a", 4.0), (3, "b", float("nan")), (3, "a", None)], "k long, s string, x double")
    cube = from_table(df, {"k": F.col("k"), "s": F.col("s")}, {"x": F.avg("x")})
    got = {(r["i_k"], r["i_s"]): r["x"] for r in cube.df.collect()}
    assert got == {(0, 0): 3.0, (0, 1): None, (1, 0): None, (1, 1): None}


@pytest.mark.parametrize("mode", ["auto", "if_all_nan", "masked"])
def test_drop_missing_like_numpy(spark, mode):
    rng = np.random.default_rng(5)
    a, mask = gappy((20, 4), 6, 0.35), rng.random((20, 4)) < 0.5
    df = spark.createDataFrame([(i, None if np.isnan(a[i, j]) else float(a[i, j]), bool(mask[i, j])) for i in range(20) for j in range(4)], "s long, v double, m boolean")
    seen = ~np.isnan(a)
    keep = {"auto": seen.all(1), "if_all_nan": seen.any(1), "masked": mask.any(1) & seen.any(1) & (seen | ~mask).all(1)}[mode]
    got = {r["s"] for r in cleaning.drop_missing(df, ["s"], ["v"], mode, "m").select("s").distinct().collect()}
    assert got == set(np.flatnonzero(keep).tolist())
    assert cleaning.drop_missing(df, ["s"], [], mode).count() == 80


def test_fill_rules(spark):
    df = spark.createDataFrame([(0, 1.0), (0, None), (1, None)], "s long, v double")
    assert sorted(r["v"] for r in cleaning.fill_missing(df, ["v"], "mean").collect()) == [1.0, 1.0, 1.0]
    assert [r["v"] for r in cleaning.fill_missing(df, ["v"], "sample_mean", sample=["s"]).orderBy("s").collect()][-1] is None
    with pytest.raises(ValueError):
        cleaning.fill_missing(df, ["v"], "constant")
    assert cleaning.fill_missing(df, ["v"], "unknown").collect() == df.collect()


def test_filters(spark):
    df = spark.createDataFrame([(0, 1.0, True), (0, None, True), (1, 2.0, False), (1, 3.0, True)], "s long, v double, filter_mask boolean")
    assert cleaning.filter_points(df, ["v"]).count() == 3
    assert cleaning.filter_points(df, ["v"], strict_mask=True).count() == 2
    assert {r["s"] for r in cleaning.drop_unmasked_samples(df, ["s"]).collect()} == {0}
    assert sorted(r["v"] for r in cleaning.mask_cells(df, ["v"]).collect() if r["v"]) == [1.0, 3.0]


@pytest.mark.parametrize("method", ["normalize", "standardize"])
def test_scaling_undone(spark, method):
    df = spark.createDataFrame([(float(x), 5.0) for x in (1, 4, 7)] + [(None, 5.0)], "a double, b double")
    params = scaling.scale_params(df, ["a", "b"], method)
    scaled = scaling.scale(df, params, method)
    back = scaling.unscale(scaled, params, method)
    assert sorted(r["a"] for r in back.collect() if r["a"] is not None) == pytest.approx([1, 4, 7])
    assert {r["b"] for r in scaled.collect()} == ({5.0} if method == "normalize" else {0.0})


def test_splits(spark):
    cube = cube_of(spark, gappy((6, 6, 4)))
    one = splitting.random_split(cube, 0.7, 3).df.select("i_t", "i_y", "i_x", "split")
    assert one.collect() == splitting.random_split(cube, 0.7, 3).df.select("i_t", "i_y", "i_x", "split").collect()
    block = {"t": 3, "y": 2, "x": 4}
    by = splitting.block_split(cube, block, 0.5, 1).df.withColumn("b", geometry.chunk_number(cube, block)).groupBy("b").agg(F.count_distinct("split").alias("n"))
    assert {r["n"] for r in by.collect()} == {1}
    exact = splitting.fraction_split(geometry.with_chunks(cube), ["chunk_id"], 0.3, 1, *cube.index())
    assert exact.where("split").count() == int(144 * 0.3)
    train, test = splitting.create_split(splitting.random_split(cube, 0.7, 3).df, "v", ["t"])
    assert train.count() + test.count() == cube.df.where("v is not null").count()
    with pytest.raises(ValueError):
        splitting.create_split(cube.df, "v", ["absent"])


def test_choose_chunks_and_patience(spark):
    v = spark.createDataFrame([(k, k in (1, 5, 6)) for k in range(10)], "chunk_id long, valid boolean")
    ids = lambda df: sorted(r["chunk_id"] for r in df.collect())
    assert ids(samples.choose_chunks(v, 2)) == [1, 5]
    assert ids(samples.choose_chunks(v, None)) == [1, 5, 6]
    assert ids(samples.choose_chunks(v, 3, patience=3)) == [1]


def test_process_and_sample_set(spark):
    a = gappy((4, 6, 2), 9)
    cube = cube_of(spark, a, {"t": 2, "y": 6, "x": 2})
    cells, keys = samples.process(cube, {"t": 1, "y": 3, "x": 2}, drop="if_all_nan", fill="sample_mean")
    assert cells.where("v is null").count() == 0
    assert cells.select(*keys).distinct().count() == sum(not np.isnan(a[t, y : y + 3]).all() for t in range(4) for y in (0, 3))
    s = samples.SampleSet(cube, chunks=1)
    assert s.cells.select("chunk_id").distinct().count() == 1
    assert s.cells.agg(F.avg("v")).first()[0] == pytest.approx(0, abs=1e-9)


def test_batches(spark):
    df = spark.range(103)
    out = samples.batches(df, 10, 4, "id")
    assert {r["count"] for r in out.groupBy("batch_id").count().collect()} == {10} and out.count() == 100
    assert samples.batches(df, 10, 4, "id", drop_last=False).count() == 103
    assert [len(b) for b in samples.iterate_batches(out)] == [10] * 10


def test_selection(spark):
    cube = cube_of(spark, gappy((4, 3, 2)))
    assert selection.nearest_index(cube, "t", 14) == 1 and selection.nearest_index(cube, "t", 15) == 1 and selection.nearest_index(cube, "t", 99) == 3
    assert selection.slice_labels(cube, t=(20, 10)).sizes["t"] == 2
    assert selection.layer_by_label(cube, "t", 20).df.count() == 6
    with pytest.raises(ValueError):
        selection.assign_mask(cube, cube.df.select("y", "x", F.lit(True).alias("mask")), stack_dim="z")
    axis = [50, 40, 30, 20]
    for v in (60, 50, 45, 20, 5):
        hit = np.array(axis) <= v
        assert selection.asof_index(axis, v, True) == int(np.clip(hit.argmax() - 1, 0, 3))


def test_layer_extremes_without_gaps(spark):
    r = statistics.layer_extremes(cube_of(spark, np.ones((3, 2, 2))), "v", "t").first()
    assert r["most_layer"] is None and r["least_layer"] == 0
    assert statistics.gap_heat_map(cube_of(spark, np.ones((3, 2, 2))), "v", "t").select("n_obs").distinct().collect()[0][0] == 3
    assert spark.range(1).select(percent(F.lit(0.29))).first()[0] == 29


def test_median_variants(spark):
    df = spark.createDataFrame([(float(e), 0.0) for e in (1, 2, 4, 8)], "y double, p double")
    for framework, want in (("pytorch", 2.0), ("sklearn", 3.0), ("tensorflow", 4.0)):
        assert metrics.Evaluator(framework).get_metrics(["med_ae"])["med_ae"](df).first()[0] == want
    with pytest.raises(KeyError):
        metrics.Evaluator().get_metrics(["absent"])


def most_read(spark, df):
    """The rows of df, and the most bytes that one of its tasks read from a shuffle."""
    sc = spark.sparkContext
    sc.setJobGroup("most_read", "")
    rows = df.collect()
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    sc._jsc.clearJobGroup()
    tracker, store = sc.statusTracker(), sc._jsc.sc().statusStore()
    stages = {k for j in tracker.getJobIdsForGroup("most_read") for k in tracker.getJobInfo(j).stageIds if tracker.getStageInfo(k)}
    tasks = [t.apply(i).taskMetrics().get() for k in stages for t in [store.taskList(k, 0, 1000)] for i in range(t.size())]
    return rows, max(m.shuffleReadMetrics().localBytesRead() + m.shuffleReadMetrics().remoteBytesRead() for m in tasks)


@pytest.mark.parametrize(("framework", "want"), [("pytorch", 149999.25), ("sklearn", 149999.75), ("tensorflow", 150000.25)])
def test_median_without_a_list_of_errors(spark, framework, want):
    n = 300_000  # errors 0.25 to 299999.25, in no order
    df = spark.range(0, n, numPartitions=8).select((F.lit(0.25) + F.col("id") * 7919 % n).alias("y"), F.lit(0.0).alias("p"))
    rows, read = most_read(spark, metrics.Evaluator(framework).get_metrics(["med_ae"])["med_ae"](df))
    assert rows[0][0] == want and 0 < read < 500_000


ODD = {
    "none": [], "missing": [None], "one": [3.5], "two": [-1.0, 2.0], "ties": [1.0] * 5 + [2.0] * 5 + [None], "zeros": [0.0, -0.0, 0.0], "endless": [1.0, float("inf"), float("-inf"), float("inf")],
    "nan": [1.0, float("nan"), 2.0, float("nan"), 5.0], "extremes": [5e-324, 1e-323, 1.7e308, 2.2e-308, 1e-200, 1e200], "neighbours": [float(x) for x in (1 + np.arange(-40, 41) * 2.0**-52)],
    "one far": [float(x) for x in np.arange(1000) * 1e-9] + [1e300], "wide": [float(x) for x in 10.0 ** np.random.default_rng(5).uniform(-300, 300, 501)],
    "dense": [float(x) for x in np.random.default_rng(6).integers(0, 2**47, 400) * 2.0**-52 + 1], "whole": list(range(-7, 9)),
}


@pytest.mark.parametrize("name", ODD)
@pytest.mark.parametrize("framework", ["pytorch", "sklearn", "tensorflow"])
def test_median_of_odd_errors(spark, framework, name):
    df = spark.createDataFrame([(e, 0) if isinstance(e, int) else (e, 0.0) for e in ODD[name]], "y bigint, p bigint" if name == "whole" else "y double, p double")
    got = metrics.Evaluator(framework).get_metrics(["med_ae"])["med_ae"](df)
    errors = sorted((abs(float(e)) for e in ODD[name] if e is not None), key=lambda e: (np.isnan(e), e))
    n = len(errors)
    low, high = (errors[(n - 1) // 2], errors[n // 2]) if n else (None, None)
    want = {"pytorch": low, "tensorflow": high, "sklearn": low if low == high else 0.5 * low + 0.5 * high}[framework]
    assert got.columns == ["med_ae"] and [str(r[0]) for r in got.collect()] == [str(want)]


def test_roc_auc_like_pairs(spark):
    rng = np.random.default_rng(2)
    y, s = rng.integers(0, 3, 60), np.round(rng.random((60, 3)), 1)
    want = np.mean([np.mean([(a > b) + 0.5 * (a == b) for a in s[y == c, c] for b in s[y != c, c]]) for c in range(3)])
    df = spark.createDataFrame([(int(a), b.tolist()) for a, b in zip(y, s, strict=True)], "y int, s array<double>")
    assert metrics.roc_auc(df).first()[0] == pytest.approx(want)


def test_svr_meets_its_conditions():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 4))
    y = x @ [1.0, -2, 0.5, 0] + 3 + rng.normal(size=60) * 0.05
    w, b = svr.fit_svr(x, y, 10.0, 0.1)
    assert np.allclose(w, [1, -2, 0.5, 0], atol=0.1) and abs(b - 3) < 0.1

    def loss(w, b):
        return 0.5 * w @ w + 10 * np.maximum(np.abs(x @ w + b - y) - 0.1, 0).sum()

    best = loss(w, b)
    for _ in range(200):
        assert loss(w + rng.normal(size=4) * 0.01, b + rng.normal() * 0.01) >= best - 1e-2


def test_gaps(spark):
    a = gappy((1, 8, 8), 4, 0.2)
    layer = cube_of(spark, a).df.select("i_y", "i_x", "v")
    gaps = gapfill.artificial_gaps(layer, "v", [0.1, 0.5, 0.99], 3, "i_y", "i_x")
    assert {r["gap_size"]: r["count"] for r in gaps.groupBy("gap_size").count().collect()} == {0.1: 6, 0.5: 32}
    few = layer.where("v is not null").limit(5)
    assert {r["filled"] for r in gapfill.interpolate(gaps, few, ["i_y", "i_x"], "v").collect()} == {None}


def test_gap_filling_follows_a_pattern(spark):
    rng = np.random.default_rng(8)
    base, season = rng.normal(size=(6, 6)), rng.normal(size=30)
    a = base[None] + 3 * season[:, None, None] * (1 + np.arange(6)[None, None, :] / 10)
    cube = cube_of(spark, a)
    layer = cube.df.where("i_t = 7").select("i_y", "i_x", "v")
    gaps = gapfill.artificial_gaps(layer, "v", [0.1], 3, "i_y", "i_x")
    out = gapfill.fill_gaps(cube, "v", "t", 7, gaps, n_points=10, hyperparameters="FullGridSearch").collect()
    assert len(out) == 4 and {r["how"] for r in out} == {"model"}
    assert all(abs(r["filled"] - r["actual"]) < 1.0 for r in out)


def test_border(spark):
    m = np.zeros((9, 9), bool)
    m[2:7, 1:8] = True
    pad = np.pad(m, 1)
    eroded = m & pad[:-2, 1:-1] & pad[2:, 1:-1] & pad[1:-1, :-2] & pad[1:-1, 2:]
    edge = np.pad(m & ~eroded, 1)
    want = edge[1:-1, 1:-1] | edge[:-2, 1:-1] | edge[2:, 1:-1] | edge[1:-1, :-2] | edge[1:-1, 2:]
    grid = spark.createDataFrame([(i, j, bool(m[i, j])) for i in range(9) for j in range(9)], "x long, y long, m boolean")
    got = np.zeros((9, 9), bool)
    for r in border.mask_border(grid, "x", "y", "m").collect():
        got[r["x"], r["y"]] = r["border"]
    assert (got == want).all()


def test_training(spark):
    rows = [(float(x), float(z), 2.0 * x - z + 1) for x in range(-5, 6) for z in range(-3, 4)]
    df = spark.createDataFrame(rows, "x double, z double, y double")
    p = training.fit_linear(df, ["x", "z"], "y")
    assert p == pytest.approx({"x": 2, "z": -1, "bias": 1})
    t = training.Trainer(["x", "z"], "y", rate=0.04, epochs=40, warm_start={"x": 1.5, "other": 9.0})
    t.train(df)
    assert t.history[-1][2] < 0.01 and set(t.params) == {"x", "z", "bias"}
    stopped = training.Trainer(["x"], "y", rate=5.0, epochs=50, patience=2)
    stopped.train(df)
    assert len(stopped.history) <= 4


def test_cube_round_trip(spark, tmp_path):
    cube = cube_of(spark, gappy((4, 5, 3)), {"t": 2, "y": 5, "x": 3})
    sources.write_cube(cube, str(tmp_path / "a"))
    back = sources.rechunk(spark, str(tmp_path / "a"), ["t", "y", "x"], {"t": 1, "y": 2, "x": 3}, str(tmp_path / "b"))
    assert sorted(map(str, back.df.select(*cube.index(), "v").collect())) == sorted(map(str, cube.df.select(*cube.index(), "v").collect()))
    assert geometry.total_chunks(back) == 12
    with pytest.raises(ValueError):
        sources.write_cube(cube, str(tmp_path / "c"), chunks=3)


def test_dates_as_labels(spark):
    df = spark.createDataFrame([(datetime.date(2020, 1, k), float(k)) for k in (1, 2, 5)], "d date, x double")
    cube = from_table(df, {"d": F.col("d")}, {"x": F.avg("x")})
    assert geometry.dim_range(cube, "d") == ("2020-01-01", "2020-01-05")


def test_chunk_dataset(spark):
    cube = cube_of(spark, gappy((4, 6, 2)), {"t": 2, "y": 4, "x": 2})
    ds = samples.ChunkDataset(cube, seed=3)
    assert len(ds) == 4 and sorted(ds.chunks) == [0, 1, 2, 3] and sum(len(ds[k]) for k in range(4)) == 48
    part = samples.ChunkDataset(cube, chunks=[1], processed=True, drop="auto", callback=lambda f: f["v"])
    assert part[0].notna().all()


@pytest.mark.parametrize("split", [True, False])
def test_chunk_sampler(spark, tmp_path, split):
    cube = cube_of(spark, gappy((4, 6, 2)), {"t": 2, "y": 6, "x": 2})
    cube = splitting.block_split(cube, {"t": 1, "y": 3, "x": 2}, 0.5, 2) if split else cube
    points = samples.ChunkSampler(cube, str(tmp_path / "points"), share=0.5, scale_by="normalize")
    points.create()
    train, test = points.datasets()
    n = cube.df.where("v is not null").count()
    assert train.count() + test.count() == n and 0 < train.count() < n
    assert train.unionByName(test).agg(F.min("v"), F.max("v")).first() == (0.0, 1.0)
    wide = samples.ChunkSampler(cube, str(tmp_path / "windows"), size={"t": 1, "y": 3, "x": 2}, drop="if_all_nan", fill="sample_mean", scale_by=None)
    wide.create()
    assert {len(r["v"]) for part in wide.datasets() for r in part.collect()} == {6}


def test_study_of_a_layer(spark):
    season = np.random.default_rng(1).normal(size=24)
    a = 2 * season[:, None, None] + np.arange(5)[None, :, None] * np.ones((1, 1, 5))
    a[7, 2, 2] = np.nan
    cube = cube_of(spark, a)
    filled, scores = gapfill.study(cube, "v", "t", layer=71, hyperparameters="FullGridSearch", n_points=8)
    row = filled.first()
    assert (row["i_y"], row["i_x"], row["actual"]) == (2, 2, None) and abs(row["filled"] - (2 * season[7] + 2)) < 0.7
    assert scores.first()["mae"] is None and scores.first()["gap_size"] == 0.04
    assert gapfill.study(cube, "v", "t", sizes=[0.2], seed=1, hyperparameters="Custom", n_points=8)[1].first()["gaps"] == 5


def test_rename_and_filter(spark):
    cube = cube_of(spark, gappy((2, 3, 2)), {"t": 1}).rename_dims(["time", "lat"])
    assert cube.dims == ["time", "lat", "x"] and cube.chunks == {"time": 1} and {"i_time", "lat", "i_x"} <= set(cube.df.columns)
    assert cleaning.apply_filter(cube.df, ["v"]).count() == 12
    masked = cube.df.withColumn("filter_mask", F.col("i_x") == 0)
    assert cleaning.apply_filter(masked, ["v"], ["i_time", "i_lat"], drop_sample=True).count() == 0


@pytest.mark.parametrize("tile", [2, 5, 64])
def test_nearest_by_tiles(spark, tile):
    """Tiles of any width give the nearest of all pairs, also where most of a layer is missing or a class is rare."""
    rng = np.random.default_rng(tile)
    cells = [(int(y), int(x), int(rng.integers(0, 3)) if rng.random() < 0.97 else 9, float(rng.random())) for y in range(40) for x in range(23)]
    seen = [c for c in cells if rng.random() < (0.5 if c[1] < 6 else 0.02)]
    ask = [c for c in cells if c not in seen][::7]
    known = spark.createDataFrame(seen, "y bigint, x bigint, c int, v double")
    gaps = spark.createDataFrame([(n, y, x, c) for n, (y, x, c, _) in enumerate(ask)], "n bigint, y bigint, x bigint, c int")
    far = lambda a, b: ((a[0] - b[0]) ** 2 + (a[1] - b[1]) ** 2, b[0], b[1])
    for same in (None, "c"):
        got = {}
        for r in gapfill.nearest_known(gaps, known, ["y", "x"], 4, same=same, value="v", tile=tile).collect():
            got[r["n"], r["rank"]] = (r["d2"], r["y"], r["x"], r["v"])
        want = {}
        for n, a in enumerate(ask):
            for k, b in enumerate(sorted((b for b in seen if same is None or b[2] == a[2]), key=lambda b: far(a, b))[:4]):
                want[n, k + 1] = (*far(a, b), b[3])
        assert got == want


def test_axes_are_read_once_and_only_if_asked(spark):
    df = spark.createDataFrame([(1, "a", 1.0), (2, "b", None), (5, "a", 3.0), (None, "a", 4.0)], "k long, s string, x double")
    asked = []
    from cubespark import cube as cubes

    built = cubes.from_table(df, {"k": F.col("k"), "s": F.col("s")}, {"v": F.max("x")})
    load = built.axes._load
    built.axes._load = lambda names: asked.append(names) or load(names)
    assert statistics.value_range(built).collect()[0][:] == (1.0, 3.0) and not asked
    assert built.sizes == {"k": 3, "s": 2} and built.axes["s"] == ["a", "b"] and asked == [["k", "s"]]
    assert sorted((r["i_k"], r["i_s"], r["v"]) for r in built.known().collect()) == [(0, 0, 1.0), (2, 0, 3.0)]
    assert built.df.count() == 6 and statistics.layer_gaps(built, "v", "s").orderBy("i_s").collect()[1]["gaps"] == 3


def test_axis_too_long_is_an_error(spark, monkeypatch):
    from cubespark import cube as cubes

    monkeypatch.setattr(cubes, "MAX_AXIS", 3)
    cells = spark.range(5).select(F.col("id").alias("i_k"), F.col("id").alias("k"), F.lit(1.0).alias("v"))
    with pytest.raises(ValueError):
        cubes.from_cells(cells, ["k"]).sizes  # noqa: B018
    with pytest.raises(ValueError):
        cubes.from_table(cells, {"k": F.col("k")}, {"w": F.max("v")}).sizes  # noqa: B018


def test_rest_is_carried(spark, tmp_path):
    path = f"{tmp_path}/out"
    assert [sources.append_whole_groups(spark.range(a, b), path, 10, "id") for a, b in ((0, 7), (7, 25), (25, 31), (31, 40))] == [7, 5, 1, 0]
    assert sorted(r["id"] for r in spark.read.parquet(path).collect()) == list(range(40))


def test_results_are_listed(spark, tmp_path):
    for name in ("day_0.25", "day_0.1", "other"):
        spark.range(1).write.parquet(f"{tmp_path}/{name}.parquet")
    got = sources.list_results(spark, str(tmp_path)).orderBy("gap_size").collect()
    assert [r["gap_size"] for r in got] == [0.1, 0.25] and got[0]["path"].endswith("day_0.1.parquet")


def test_entry_without_the_corpus_operators(monkeypatch):
    """A library that only they need is missing: the engine's queries stay, and it is said."""
    import sys

    import __spark_entry__

    for name in [n for n in sys.modules if n.startswith("cubespark.llm") or n in ("corpus_pipeline", "zstandard")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "zstandard", None)
    monkeypatch.setitem(sys.modules, "cubespark.llm", None)
    assert "gap_heat_map" in __spark_entry__.queries() and not any(n.startswith("op1_") for n in __spark_entry__.queries())
