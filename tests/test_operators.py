"""Small cases with values worked out by hand, and properties."""

import datetime as dt
import hashlib
import json
import math
import random
import statistics
import struct
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterflow.functions import columns as C
from rasterflow.functions.frames import counted_median, digest_rank, order_key, placed, value_rank
from rasterflow.operators import composite, encode, metrics, rules, scoring, spatial, splits, strata, tiling
from rasterflow.plans import jobs
from rasterflow.sources import tables


def column(df, name="out", order=None):
    return [r[name] for r in (df.orderBy(order) if order else df).collect()]


def test_bin_edges_are_open_left(spark):
    edges = composite.bin_edges(spark, "2019-01-01 00:00:00", "2020-01-01 00:00:00", "month")
    assert edges.count() == 12
    times = [dt.datetime(2019, 1, 1), dt.datetime(2019, 2, 1), dt.datetime(2019, 2, 1, 0, 0, 1), dt.datetime(2020, 1, 1)]
    obs = spark.createDataFrame([(i, t) for i, t in enumerate(times)], "i int, time timestamp_ntz")
    assert {r.i: r.bin for r in composite.assign_bin(obs, edges).collect()} == {1: 1, 2: 2, 3: 12}
    assert {r.i: r.lo.month for r in composite.month_bin(obs, year=2019).collect()} == {1: 1, 2: 2, 3: 12}


def test_medians_skip_missing(spark):
    rows = [("a", v) for v in (1.0, 2.0, 3.0, 10.0)] + [("b", 1.0), ("b", 2.0), ("b", None), ("b", float("nan"))] + [("c", None)]
    got = composite.median_composite(spark.createDataFrame(rows, "k string, value double"), ["k"])
    assert {r.k: r.median for r in got.collect()} == {"a": 2.5, "b": 1.5, "c": None}


SERIES = [
    ([None, 2, None, 6], [0, 2, 4, 6]), ([None, 2, None], [None, 2, None]), ([1, None, None], [1, None, None]), ([None] * 3, [None] * 3),
    ([1, 2, None, None], [1, 2, 3, 4]), ([None, None, 5, 4, None, 0, None], [7, 6, 5, 4, 2, 0, -2]),
]


def test_gap_fill_by_windows_and_by_arrays(spark):
    rows = [(k, 10 * i, None if v is None else float(v)) for k, (given, _) in enumerate(SERIES) for i, v in enumerate(given)]
    df = spark.createDataFrame(rows, "k int, x int, v double").repartition(3)
    got = composite.fill_gaps(df, ["k"], "x", "v")
    arrays = df.groupBy("k").agg(F.array_sort(F.collect_list(F.struct("x", "v"))).alias("s")).select("k", composite.fill_series(F.transform("s", lambda p: p["v"]), F.transform("s", lambda p: p["x"])).alias("out"))
    by_array = {r.k: r.out for r in arrays.collect()}
    for k, (_, want) in enumerate(SERIES):
        found = column(got.where(F.col("k") == k), "filled", "x")
        assert found == [None if v is None else pytest.approx(v) for v in want]
        assert by_array[k] == [None if v is None else pytest.approx(v) for v in want]


def test_tiling(spark):
    assert tiling.tile_step(8, 3) == (4, 2) and tiling.tile_step(366, 61) == (61, 6) and tiling.tile_step(5, 5) == (5, 1)
    with pytest.raises(ValueError):
        tiling.tile_step(4, 5)
    pixels = spark.range(64).select(F.lit("p").alias("path"), F.expr("cast(id div 8 as int)").alias("y"), (F.col("id") % 8).cast("int").alias("x"), F.col("id").alias("value"))
    assert tiling.tile(pixels, 8, 3).count() == 36
    tiles = tiling.gather_tiles(tiling.tile(pixels, 8, 4), ["path"])
    back = tiling.mosaic(tiling.spread_tiles(tiles, 4), 4)
    assert sorted((r.y, r.x, r.value) for r in back.collect()) == [(i // 8, i % 8, i) for i in range(64)]
    image = tiling.mosaic_rows(tiling.tile(pixels, 8, 4), ["path"], 4).orderBy("y").collect()
    assert [v for r in image for v in r["values"]] == list(range(64))
    assert {r.id for r in tiles.select(F.explode("values").alias("id")).collect()} == set(range(64))


def test_resample_repeats(spark):
    got = composite.resample(spark.createDataFrame([(0, 1, 7)], "y int, x int, v int"), 6)
    assert sorted((r.y, r.x, r.v) for r in got.collect()) == [(y, 6 + x, 7) for y in range(6) for x in range(6)]


def test_fraction_boundaries():
    f = lambda *s: [{"target": str(i)} | ({} if x is None else {"split": x}) for i, x in enumerate(s)]
    ends = lambda *s: [b for _, b in splits.fraction_boundaries(f(*s))]
    assert ends(0.8, 0.1, 0.1) == pytest.approx([0.8, 0.9, 1.0]) and ends(0.5, None, None) == [0.5, 0.75, 1.0]
    with pytest.raises(ValueError):
        ends(0.8, 0.3)


@pytest.mark.parametrize(("n", "shares", "sizes"), [(25, (0.8, 0.1, 0.1), (20, 2, 3)), (100, (0.05, 0.01, 0.01), (5, 1, 1))])
def test_random_split_sizes_and_stability(spark, n, shares, sizes):
    df = spark.range(n).withColumnRenamed("id", "k")
    targets = [{"target": t, "split": s} for t, s in zip("abc", shares, strict=True)]
    one = {r.k: r.target for r in splits.random_split(df, "k", "0", targets, 1).collect()}
    assert one == {r.k: r.target for r in splits.random_split(df.repartition(7), "k", "0", targets, 1).collect()}
    assert one != {r.k: r.target for r in splits.random_split(df, "k", "0", targets, 2).collect()}
    assert tuple(list(one.values()).count(t) for t in "abc") == sizes


def test_ranks_without_one_task(spark):
    df = spark.range(5000).select((F.col("id") * 7919 % 5003).alias("v"), (F.col("id") % 3).alias("g"))
    got = sorted((r.v, r.rank) for r in value_rank(df, "v", "g").collect())
    assert [r for _, r in got] == list(range(1, 5001))
    hot = spark.range(2000).select(F.when(F.col("id") % 3 > 0, 5.0).when(F.col("id") % 2 == 0, F.col("id") / 7).alias("v"), F.col("id").alias("g"))
    ranked = sorted(value_rank(hot, "v", "g").collect(), key=lambda r: r.rank)
    assert [r.rank for r in ranked] == list(range(1, 2001))
    assert [r.g for r in ranked] == [r.g for r in sorted(ranked, key=lambda r: (r.v is not None, r.v or 0, hashlib.md5(str(r.g).encode()).hexdigest()))]
    ranks = digest_rank(df, "s", F.col("v"), ["g"]).collect()
    for g in range(3):
        assert sorted(r.rank for r in ranks if r.g == g) == list(range(1, 1 + sum(1 for r in ranks if r.g == g)))


PATCHES = "path string, year int, tile string, patch_x int, patch_y int"


def test_rules(spark):
    tree = [
        {"year": 2019, "target": "train"},
        {"year": 2020, "tile": "31TCG", "rules": [{"patch_x": {"max": 14}, "target": "test"}, {"patch_x": {"in": [15]}, "target": "val"}]},
        {"year": 2020, "tile": "31TCG", "target": "never"},
        {"year": 2021, "target": [{"target": "train"}, {"target": "val"}]},
        {"year": 2022, "assert_none": True},
        {"year": 2022, "assert_none": False, "target": "train"},
    ]
    rows = [("a", 2019, "x", 0, 0), ("b", 2020, "31TCG", 14, 0), ("c", 2020, "31TCG", 15, 0), ("d", 2020, "31TCG", 16, 0), ("e", 2021, "x", 0, 0), ("f", 2018, "x", 0, 0), ("g", None, None, None, None)]
    got = {r.path: (r.target, r.rule_loc) for r in rules.apply_rules(spark.createDataFrame(rows, PATCHES), tree).collect()}
    assert got == {"a": ("train", [0]), "b": ("test", [1, 0]), "c": ("val", [1, 1]), "e": (None, [3])}
    assert list(rules.random_rules(tree)) == [(3,)]
    with pytest.raises(Exception, match="bad/path"):
        rules.apply_rules(spark.createDataFrame([("bad/path", 2022, "x", 0, 0)], PATCHES), tree).collect()
    for bad in ([{"year": 1}], [{"target": "a", "rules": []}], [{"yaer": 1, "target": "a"}]):
        with pytest.raises(ValueError):
            rules.compile_rules(bad)
    with pytest.raises(ValueError):
        rules.filter_expr(F.col("year"), {"above": 1})


def test_duplicates_go_in_split_order(spark):
    rows = [("p", "train"), ("p", "test"), ("q", "val"), ("q", "train"), ("r", "test"), ("r", "test"), ("s", "val"), (None, "test"), ("t", None)]
    got = splits.drop_duplicates_by_split(spark.createDataFrame(rows, "path string, target string"), "path", ["test", "val"])
    assert sorted(map(tuple, got.collect()), key=str) == sorted([("p", "train"), ("q", "train"), ("s", "val"), (None, "test"), ("t", None)], key=str)


def test_stratified_split_is_proportional(spark):
    rows = [(i, "abcd"[min(3, i % 10 // 3)]) for i in range(1000)] + [(5000, None)]
    df = spark.createDataFrame(rows, "k long, s string")
    got = splits.stratified_split(df, "k", "s", [{"target": "x", "split": 0.6}, {"target": "y", "split": 0.25}, {"target": "z", "split": 0.15}], 3).collect()
    count = lambda t, s=None: sum(1 for r in got if r.target == t and (s is None or r.s == s))
    assert (count("x"), count("y"), count("z")) == (601, 250, 150)
    assert all(abs(count("x", s) - 0.6 * n) <= 1 for s, n in (("a", 300), ("b", 300), ("c", 300), ("d", 100)))
    with pytest.raises(ValueError):
        splits.stratified_split(df, "k", "s", [{"target": "x"}], 3)


def test_equal_width_bins(spark):
    got = strata.bin_equal_width(spark.createDataFrame([(0.0,), (5.0,), (10.0,), (None,), (float("nan"),)], "v double"), "v", 2, "out")
    assert column(got) == [0, 0, 1, -1, -1]
    assert column(strata.bin_equal_width(spark.createDataFrame([(3,), (3,)], "v int"), "v", 4, "out")) == [1, 1]
    assert max(column(strata.bin_equal_width(spark.range(100).withColumnRenamed("id", "v"), "v", None, "out"))) == 4
    with pytest.raises(TypeError):
        strata.bin_equal_width(spark.createDataFrame([("a",)], "v string"), "v", 2)


def merged_slowly(counts, draw):
    """The rule by the book: lone bins one after the other, in any order; each looks for a partner itself."""
    where = {b: b for b in counts}
    for d in range(1, max(counts, default=0) - min(counts, default=0) + 1):
        now = Counter()
        for b, n in counts.items():
            now[where[b]] += n
        lone, moves = [b for b in now if now[b] == 1], set()
        draw.shuffle(lone)
        for b in lone:
            if b in moves:
                continue
            partners = sorted((x for x in (b - d, b + d) if x in now), key=lambda x: (now[x] != 1, x))
            if partners:
                moves.update((b, partners[0]))
        ordered = sorted(moves)
        sizes = [2] * (len(ordered) // 2)
        if len(ordered) % 2:
            sizes[0] = 3
        for size in sizes:
            run, ordered = ordered[:size], ordered[size:]
            middle = math.floor(statistics.median([b for b in run for _ in range(now[b])]))
            where = {b: middle if x in run else x for b, x in where.items()}
    return where


def test_lone_bins_merge(spark):
    draw = random.Random(8)
    cases = [{0: 10, 1: 1, 5: 10}, {0: 1, 1: 5}, dict.fromkeys(range(5), 1), {0: 5, 4: 1, 6: 1}, {3: 1}, {1: 1, 9: 7}, {-1: 1, 0: 1, 7: 2}]
    cases += [{b: draw.choice([1, 1, 1, 2, 9]) for b in draw.sample(range(-1, 30), draw.randrange(1, 20))} for _ in range(150)]
    rows = [(k, b, n) for k, c in enumerate(cases) for b, n in c.items()]
    hist = spark.createDataFrame(rows, "k int, b int, n long").groupBy("k").agg(F.collect_list(F.struct(F.col("b").alias("bin"), "n")).alias("h"))
    got = {r.k: {x["bin"]: x["new"] for x in r.m} for r in hist.select("k", strata.lone_bins_merged(F.col("h")).alias("m")).collect()}
    assert got == {k: merged_slowly(c, draw) for k, c in enumerate(cases)}
    assert got[0] == {0: 0, 1: 0, 5: 5} and got[2] == {0: 1, 1: 1, 2: 1, 3: 3, 4: 3}


def test_strata_of_two_columns_merge(spark):
    rows = [(0, 0)] * 5 + [(0, 1)] + [(1, 7)] * 2 + [(9, 2)]
    table = spark.createDataFrame(rows, "a int, b int")
    got = strata.merge_singletons(table, ["a", "b"])
    counts = {(r.a, r.b): r["count"] for r in got.groupBy("a", "b").count().collect()}
    assert sum(counts.values()) == 9 and all(n > 1 for n in counts.values())
    assert "Python" not in got._jdf.queryExecution().toString() and "Pandas" not in got._jdf.queryExecution().toString()
    assert strata.merge_singletons(table.where("false"), ["a", "b"]).count() == 0


def test_many_strata_get_their_quotas(spark):
    """A million strata: totals come out exactly, and no stratum is off by a row or more."""
    df = spark.range(1_500_000).select(F.col("id").alias("k"), F.when(F.col("id") < 1_000_000, F.col("id")).otherwise(F.lit(-1)).alias("s"))
    got = splits.stratified_split(df, "k", "s", [{"target": "x", "split": 0.5}, {"target": "y", "split": 0.5}], 3)
    each = got.groupBy("s").agg(F.count(F.when(F.col("target") == "x", 1)).alias("x"), F.count("*").alias("n"))
    assert each.agg(F.sum("x"), F.max(F.abs(F.col("x") - F.col("n") / 2)), F.count("*")).first()[:] == (750_000, 0.5, 1_000_001)


def test_ranges_cut_hot_keys(spark):
    """A third of the rows under one key, and a third equal in every column: no range is above twice the mean."""
    df = spark.range(30_000).select(F.when(F.col("id") % 3 == 0, F.lit("hot")).when(F.col("id") % 3 == 1, F.lit("same")).otherwise(F.col("id").cast("string")).alias("k"), F.when(F.col("id") % 3 == 1, 0).otherwise(F.col("id")).alias("v"))
    for shape in (df, df.repartition(13), df.orderBy(F.desc("v"))):
        table = placed(shape, [F.md5("k")])
        sizes = [r["count"] for r in table.groupBy(F.shiftright("_place", 33)).count().collect()]
        assert sum(sizes) == 30_000 and max(sizes) <= 2 * 30_000 / 4
    ranks = lambda d: sorted(map(tuple, digest_rank(d, 1, F.col("k")).collect()))
    assert ranks(df) == ranks(df.repartition(7, "v")) and sorted(r[2] for r in ranks(df)) == list(range(1, 30_001))


def test_order_of_doubles(spark):
    draw = random.Random(2)
    values = [0.0, -0.0, 1.0, -1.0, 5e-324, -5e-324, 2.2250738585072014e-308, 2.225073858507201e-308, 1.7976931348623157e308, float("inf"), float("-inf"), 0.1, 0.3, 7.999999999999999, 8.0, 8.000000000000002]
    values += [struct.unpack("<d", draw.randbytes(8))[0] for _ in range(3000)]
    values = sorted({v for v in values if v == v})
    got = spark.createDataFrame([(v,) for v in values], "v double").select("v", order_key(F.col("v")).alias("k")).collect()
    ours = {r.v: r.k for r in got}
    keys = [ours[v] for v in values]
    assert all(a < b for a, b in zip(keys, keys[1:], strict=False))
    assert all(ours[v] == struct.unpack("<q", struct.pack("<d", v))[0] for v in values if v > 0)
    assert spark.createDataFrame([(None,), (float("nan"),)], "v double").where(order_key(F.col("v")).isNotNull()).count() == 0


def test_medians_by_counting(spark):
    draw = random.Random(6)
    rows = [(k, draw.choice([None, float("nan"), draw.gauss(0, 10.0 ** draw.randrange(-3, 9)), float(draw.randrange(5))])) for k in ["hot"] * 3000 + [f"g{i % 40}" for i in range(3000)] + ["one", "two", "two", None, None]]
    rows += [("none", None), ("edge", -1.0), ("edge", 1.0), ("far", 1e-300), ("far", 1e300), ("far", 2e300)]
    df = spark.createDataFrame(rows, "k string, v double")
    own = {}
    for k, v in rows:
        if v is not None and v == v:
            own.setdefault(k, []).append(v)
    for most in (10_000, 40, 1):
        got = {r.k: r for r in counted_median(df, ["k"], "v", most=most).collect()}
        assert {k: r.median for k, r in got.items()} == {k: statistics.median(v) for k, v in own.items()}
        assert all(r.n == len(own[k]) and math.isclose(r["mean"], statistics.fmean(own[k]), rel_tol=1e-9, abs_tol=1e-9) for k, r in got.items())
        assert all(math.isclose(got[k]["std"], statistics.pstdev(own[k]), rel_tol=1e-7, abs_tol=1e-7) for k in own if k not in ("far",))
    assert counted_median(df.where("false"), ["k"], "v").count() == 0


def test_working_columns_leave_the_callers_alone(spark):
    names = ["_a", "_b", "_n", "_x", "_p", "_digest", "_bucket", "_key", "_row", "_rank", "_lane", "_part", "_lo", "_hi", "_rows", "_top", "_day", "_before", "_value", "_t", "_most", "_place", "_s", "_c", "_cell", "_0", "_dy", "_dx"]
    extra = lambda df: df.select("*", *[F.lit(f"own {n}").alias(n) for n in names])
    rows = extra(spark.range(60).select(F.col("id").alias("k"), (F.col("id") % 7).cast("double").alias("v"), (F.col("id") % 2).cast("string").alias("target"), F.timestamp_seconds(F.col("id") * 3600 + 60).cast("timestamp_ntz").alias("time")))
    edges = composite.bin_edges(spark, "1970-01-01 00:00:00", "1970-01-05 00:00:00", "day")
    boxes = extra(spark.range(9).selectExpr("id AS xmin", "id + 1 AS xmax", "id AS ymin", "id + 1 AS ymax"))
    results = [
        digest_rank(rows, 1, F.col("k"), ["target"]), value_rank(rows, "v", "k"), composite.fill_gaps(rows, ["target"], "k", "v"), composite.assign_bin(rows, edges), composite.resample(rows.withColumn("y", F.lit(0)).withColumn("x", F.lit(0)), 2),
        splits.random_split(rows, "k", "s", [{"target": "a"}, {"target": "b"}], 1), splits.stratified_split(rows, "k", "v", [{"target": "a", "split": 1.0}], 1), splits.subsample(rows, "k", {"0": 0.5}, 1), splits.assign_blocks(rows, "v", 7, key="k"), splits.top_k_per_block(rows, "target", "v", "k", 3),
        strata.bin_equal_width(rows, "v", 3), composite.preview(rows, ["target"], ["v"]), spatial.boxes_touching(boxes, boxes.drop(*names)),
    ]
    for got in results:
        assert {tuple(r[n] for n in names) for r in got.collect()} == {tuple(f"own {n}" for n in names)}


def test_boxes_that_repeat_come_back_as_often(spark):
    rows = [(0, 1, 0, 1, "a"), (0, 1, 0, 1, "a"), (0, 1, 0, 1, "b"), (5, 6, 5, 6, "c"), (None, 1, 0, 1, "d")]
    boxes = spark.createDataFrame(rows, "xmin int, xmax int, ymin int, ymax int, id string").withColumn("m", F.create_map(F.lit("x"), F.lit(1)))
    others = spark.createDataFrame([(1, 2, 1, 2), (0, 3, 0, 3)], "xmin int, xmax int, ymin int, ymax int")
    assert sorted(column(spatial.boxes_touching(boxes, others), "id")) == ["a", "a", "b"]


def test_composite_job_is_its_parts_in_two_shuffles(spark):
    edges = composite.bin_edges(spark, "2020-01-01 00:00:00", "2020-06-01 00:00:00", "month")
    rng = random.Random(4)
    rows = [("p", b, dt.datetime(2020, rng.randint(1, 5), rng.randint(2, 28)), y, x, rng.random()) for b, side in (("B02", 4), ("B05", 2)) for y in range(side) for x in range(side) for _ in range(rng.randint(0, 4))]
    obs = spark.createDataFrame(rows, "path string, band string, time timestamp_ntz, y int, x int, value double")
    got = jobs.composite_job(obs, edges, ["B02", "B05"], 4, 2)
    pixel = ["path", "band", "y", "x"]
    medians = composite.median_composite(composite.assign_bin(obs, edges), [*pixel, "bin"])
    filled = composite.fill_gaps(composite.complete_bins(medians, pixel, edges), pixel, "lo", "median")
    fine = composite.resample(filled.where("band = 'B02'"), 1).unionByName(composite.resample(filled.where("band = 'B05'"), 2))
    want = tiling.tile(composite.align_bands(fine, ["path", "bin", "y", "x"], ["B02", "B05"], value="filled"), 4, 2)
    key = lambda df: sorted([(r.path, r.bin, r.tile_y, r.tile_x, r.dy, r.dx, *(v if v is None else round(v, 9) for v in (r.B02, r.B05))) for r in df.collect()], key=str)
    assert key(got) == key(want)
    plan = got._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("Exchange hashpartitioning") == 2 and "Window" not in plan and "SortMergeJoin" not in plan


def test_apply_splits_with_strata(spark):
    tree = [{"year": 2020, "stratify_on": [{"column": "elev", "bins": 3}], "target": [{"target": "train", "split": 0.5}, {"target": "test", "split": 0.5}]}, {"target": [{"target": "train", "split": 0.1}]}]
    rows = [(f"p{i}", 2020 + i % 2, "t", i, i, float(i)) for i in range(200)]
    df = spark.createDataFrame(rows, PATCHES + ", elev double")
    got = splits.apply_splits(rules.apply_rules(df, tree), tree, 1)
    assert {r.target: r["count"] for r in got.groupBy("target").count().collect()} == {"train": 60, "test": 50}


def test_blocks_and_top_k(spark):
    rows = spark.createDataFrame([("a", 1, 1.0), ("b", 1, None), ("c", 1, 3.0), ("d", 1, 2.0), ("e", 1, float("nan"))], "s string, block int, score double")
    assert column(splits.top_k_per_block(rows, "block", "score", "s", 2), "s", "s") == ["c", "d"]
    assert column(splits.assign_blocks(spark.range(10), "id", 4), "block_id", "id") == [0, 0, 0, 0, 1, 1, 1, 1, 2, 2]
    assert sorted(column(splits.assign_blocks(spark.range(10), None, 4, seed=1, key="id"), "block_id")) == [0] * 4 + [1] * 4 + [2] * 2
    assert splits.block_size(2, 10, 4) == 80


def test_encoder_and_weights(spark):
    encoder = encode.encoder_table(spark, [{"name": "a", "id": [1, 2]}, {"name": "b", "id": 110}, {"name": "c", "id": [911, 2]}])
    assert {r.raw_id: (r.class_id, r.name) for r in encoder.collect()} == {1: (0, "a"), 2: (2, "c"), 110: (1, "b"), 911: (2, "c")}
    assert column(encode.remap(spark.createDataFrame([(110,), (911,), (5,), (None,)], "raw int"), encoder, "raw"), "class_id") == [1, 2, 0, 0]
    counts = spark.createDataFrame([(0, 50), (110, 3), (911, 1)], "label int, n long")
    freq = encode.class_frequencies(counts, encoder)
    assert {r.class_id: r.frequency for r in freq.collect()} == {0: 0.0, 1: 0.75, 2: 0.25}
    assert {r.class_id: r.weight for r in encode.class_weights(freq).collect()} == pytest.approx({0: 0.0, 1: 4 / 9, 2: 4 / 3})
    assert {r.class_id: r.weight for r in encode.class_weights(freq, 0.1).collect()} == pytest.approx({0: 0.9, 1: 0.9 + 0.4 / 9, 2: 0.9 + 0.4 / 3})
    assert {r.class_id: r.weight for r in encode.class_weights(freq, None).collect()} == {0: None, 1: None, 2: None}
    assert {r.class_id: r.logit for r in encode.prior_logits(freq).collect()} == pytest.approx({0: -np.log(3), 1: np.log(3), 2: -np.log(3)})
    maps = encode.count_maps(counts.withColumn("path", F.lit("p")), ["path"]).first()
    assert maps.counts == {0: 50, 110: 3, 911: 1}
    only_zero = encode.wide_counts(spark.createDataFrame([("p", 0, 9)], "path string, label int, n long"), ["path"], [0, 1]).first()
    assert (only_zero.pixel_count_0, only_zero.pixel_count_1, only_zero.pixel_count_max) == (9, 0, None)


LOGP = "s int, label int, logp array<double>"


def test_losses(spark):
    rows = [(1, 0, [-9.0, -5.0]), (1, 1, [-7.0, -1.0]), (1, 1, [-7.0, -3.0]), (2, 0, [-1.0, -1.0])]
    df = spark.createDataFrame(rows, LOGP)
    assert metrics.masked_nll(df).first().loss == 2
    assert {r.s: r.score for r in scoring.loss_score(df, ["s"]).collect()} == {1: 6.5, 2: None}
    assert {r.s: r.score for r in scoring.loss_score(df, ["s"], mask_numerator=True).collect()} == {1: 2.0, 2: None}
    assert {r.s: r.score for r in scoring.margin_score(df, ["s"]).collect()} == {1: ((-5 + 9) + (-7 + 1) + (-7 + 3)) / 2, 2: None}
    assert scoring.parse_terms(["loss", "-0.5*iho", "none", "2*none"]) == [(1.0, "loss"), (-0.5, "iho")]
    with pytest.raises(ValueError):
        scoring.combine_scores({}, ["none"], ["s"])


def test_scores_against_numpy(spark):
    rng = random.Random(2)
    pairs = [(rng.randrange(4), rng.randrange(4)) for _ in range(500)]
    df = spark.createDataFrame(pairs, "label int, predicted int")
    got = metrics.scores(metrics.confusion(df)).first()
    f1 = [2 * sum(a == b == c for a, b in pairs) / (sum(a == c for a, _ in pairs) + sum(b == c for _, b in pairs)) for c in range(4)]
    support = [sum(a == c for a, _ in pairs) for c in range(4)]
    assert (got.pixels, got.accuracy) == (500, pytest.approx(sum(a == b for a, b in pairs) / 500))
    assert (got.f1_macro, got.f1_weighted) == (pytest.approx(np.mean(f1)), pytest.approx(np.dot(f1, support) / 500))
    assert sum(r.n for r in metrics.dense(metrics.confusion(df), 6).collect()) == 500 and metrics.dense(metrics.confusion(df), 6).count() == 36
    assert metrics.scores(metrics.confusion(df.where("false"))).count() == 0


def test_small_expressions(spark):
    row = spark.createDataFrame([("2019/31TCG/2019_31TCG_patch_13_11.nc", [0.5, 0.9, 0.9], 3.0)], "path string, p array<double>, v double")
    got = row.select(C.patch_name(F.col("path")).alias("n"), C.argmax_class(F.col("p")).alias("a"), C.preview_byte(F.col("v"), F.lit(3.0)).alias("b"), C.preview_byte(F.col("v"), F.lit(0.0)).alias("z"), C.patch_name(F.lit("other.nc")).alias("no"), C.map_label(F.lit(7), {7: 2}).alias("m")).first()
    assert tuple(got.n) == (2019, "31TCG", 13, 11) and (got.a, got.b, got.z, got.no, got.m) == (1, 255, None, None, 2)
    assert C.composite_name("1MS", ["B02", "B03"], 61, 61) == "1MS_B02B03_61x61"


@pytest.mark.parametrize(("lon", "lat", "zone"), [(3.0, 45.0, 31), (0.2, 41.7, 31), (5.9, 48.1, 31), (-70.3, -33.4, -19)])
def test_reprojection_inverts_the_forward_one(spark, lon, lat, zone):
    x, y = spatial.lonlat_to_utm(lon, lat, zone)
    got = spark.range(1).select(spatial.utm_to_lonlat(F.lit(x), F.lit(y), F.lit(zone)).alias("p")).first().p
    assert (got.lon, got.lat) == (pytest.approx(lon, abs=1e-9), pytest.approx(lat, abs=1e-9))
    assert spatial.lonlat_to_utm(3.0, 0.0, 31) == (500000.0, 0.0)


def test_known_point_and_codes(spark):
    x, y = spatial.lonlat_to_utm(2.294495, 48.858222, 31)
    assert (x, y) == (pytest.approx(448252, abs=2), pytest.approx(5411943, abs=15))
    zones = spark.createDataFrame([("EPSG:32631",), ("+init=epsg:32733",)], "c string").select(spatial.utm_zone(F.col("c")).alias("out"))
    assert column(zones) == [31, -33]
    with pytest.raises(Exception, match="not a UTM"):
        spark.range(1).select(spatial.utm_zone(F.lit("EPSG:3857"))).collect()


def test_points_on_borders_belong_to_one_square(spark):
    ring = lambda x, y: [(x, y), (x + 1.0, y), (x + 1.0, y + 1.0), (x, y + 1.0), (x, y)]
    squares = spark.createDataFrame([(f"{x}{y}", ring(float(x), float(y))) for x in range(3) for y in range(3)], "id string, ring array<struct<x: double, y: double>>")
    points = spark.createDataFrame([(i / 2, j / 2, float(i)) for i in range(6) for j in range(6)], "lon double, lat double, elev double")
    got = spatial.zonal_join(points, squares).collect()
    assert len(got) == 36 and all(r.id == f"{int(r.lon)}{int(r.lat)}" for r in got)
    stats = spatial.zonal_stats(points, squares, "id").where("id = '10'").first()
    assert (stats.elevation_mean, stats.elevation_std, stats.elevation_median) == (2.5, 0.5, 2.5)


def test_sources_and_sinks(spark, tmp_path):
    for target, names in {"train": ["netcdf/2019_31TCG_patch_13_11.nc", "2020_31TCF_patch_0_1.nc"], "val": [], "test": ["2020_31TCF_patch_2_1.nc"]}.items():
        (tmp_path / f"s_{target}.json").write_text(json.dumps({"images": [{"id": i, "file_name": n} for i, n in enumerate(names)]}, indent=1))
    split = tables.read_annotation_splits(spark, f"{tmp_path}/s")
    assert sorted(map(tuple, split.collect())) == [("2019/31TCG/2019_31TCG_patch_13_11.nc", "train"), ("2020/31TCF/2020_31TCF_patch_0_1.nc", "train"), ("2020/31TCF/2020_31TCF_patch_2_1.nc", "test")]
    tables.write_split(split, f"{tmp_path}/split")
    assert tables.read_split(spark, f"{tmp_path}/split", "test").count() == 1
    tables.write_split_lists(split, f"{tmp_path}/lists")
    assert tables.read_split(spark, f"{tmp_path}/lists", "train", text=True).count() == 2
    for r in split.collect():
        (tmp_path / "raw" / r.path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "raw" / r.path).write_text("x")
    listed = tables.list_patches(spark, f"{tmp_path}/raw")
    assert sorted(r.path for r in listed.collect()) == sorted(r.path for r in split.collect())
    assert column(tables.list_patches(spark, f"{tmp_path}/raw", limit=1), "patch_x") == [13]
    tables.write_scores(spark.createDataFrame([("p", 0.5)], "path string, accuracy double"), f"{tmp_path}/scores")
    assert spark.read.option("header", "true").csv(f"{tmp_path}/scores").first().accuracy == "0.5"
    tiles = spark.createDataFrame([("a", 0, 0, "B02", [61]), ("b", 0, 0, "B02", [60])], "path string, tile_y int, tile_x int, band string, img_size array<int>")
    with pytest.raises(Exception, match="differ in size"):
        tables.composite_meta(tiles).collect()
    tables.write_tiles(tiles.withColumn("year", F.lit(2019)), f"{tmp_path}/tiles")
    assert tables.read_tiles(spark, f"{tmp_path}/tiles", tiles.where("path = 'a'"), strict=True).count() == 1
    with pytest.raises(Exception, match="no composite of zz"):  # part of the plan: no job while it is made
        tables.read_tiles(spark, f"{tmp_path}/tiles", spark.createDataFrame([("zz",)], "path string"), strict=True).collect()


def test_split_job(spark):
    rows = spark.createDataFrame([(f"p{i}", 2019, "t", i, i) for i in range(50)], PATCHES)
    labels = spark.createDataFrame([(f"p{i}", i % 3) for i in range(50)], "path string, label int")
    tree = [{"target": [{"target": "train", "split": 0.6}, {"target": "val"}]}]
    out = jobs.split_job(rows, tree, fractions={"train": 0.5}, labels=labels, processors=[lambda d: d.withColumn("f", F.lit(1))])
    assert {r.target: r.patches for r in out["patch_counts"].collect()} == {"train": 15, "val": 20}
    assert out["split"].columns[-2:] != [] and sum(r.n for r in out["pixel_counts"].collect()) == 35
    annotated = rows.select("path", F.lit("test").alias("target"))
    assert jobs.split_job(rows, annotated=annotated, duplicates=["test"])["split"].count() == 50
    with pytest.raises(ValueError):
        jobs.split_job(rows)
    twins = rows.withColumn("same", F.when(F.col("patch_x") < 10, F.lit("x")).otherwise(F.col("path")))
    assert jobs.split_job(twins, annotated=annotated, duplicates=["test"], same="same")["split"].count() == 40


def test_classifier_learns(spark):
    rows = spark.createDataFrame([(float(i % 2) + i / 1000, float(i % 7), i % 2, 1.0) for i in range(300)], "a double, b double, label int, w double")
    for kind in ("logistic", "forest"):
        model = jobs.fit_classifier(rows, ["a", "b"], weight="w", kind=kind)
        got = metrics.scores(metrics.confusion(jobs.predict(model, rows))).first()
        assert got.accuracy > 0.95


def test_classifier_job_scores_every_target(spark):
    rows = spark.createDataFrame([(float(i % 3), float(i % 7), i % 3, ("train", "val", "test")[i % 5 % 3]) for i in range(300)], "a double, b double, label int, target string")
    got = {r.target: r for r in jobs.classifier_job(rows, ["a", "b"], 3).collect()}
    assert set(got) == {"train", "val", "test"} and all(r.accuracy == 1 for r in got.values()) and sum(r.pixels for r in got.values()) == 200


def test_boxes_of_all_sizes_meet(spark):
    draw = random.Random(11)

    def some(n):
        out = []
        for i in range(n):
            size = lambda: draw.choice([0.0, 1e-6, 0.01, 1.0, 2.0, 3.7, 1000.0, 1e9]) * draw.choice([1, draw.random()])
            x, y = (draw.choice([0.0, 5.0, draw.uniform(-20, 20), draw.uniform(-1e6, 1e6)]) for _ in range(2))
            out.append((x, x + size(), y, y + size(), i))
        return [*out, (None, 1.0, 0.0, 1.0, n), (float("nan"), 1.0, 0.0, 1.0, n + 1)]

    mine, theirs = some(300), some(40)
    fields = "xmin double, xmax double, ymin double, ymax double, i int"
    got = spatial.boxes_touching(spark.createDataFrame(mine, fields), spark.createDataFrame(theirs, fields))
    real = lambda rows: [r for r in rows if r[0] is not None and r[0] == r[0]]
    want = [a[4] for a in real(mine) if any(a[0] <= b[1] and a[1] >= b[0] and a[2] <= b[3] and a[3] >= b[2] for b in real(theirs))]
    assert sorted(column(got, "i")) == want and 0 < len(want) < 300


def test_points_in_polygons_of_all_sizes(spark):
    draw = random.Random(12)
    rings = []
    for i in range(60):
        r, x, y = 10.0 ** draw.uniform(-5, 4), draw.uniform(-30, 30), draw.uniform(-30, 30)
        k = draw.randrange(3, 9)
        ring = [(x + r * math.cos(2 * math.pi * j / k), y + r * draw.uniform(0.4, 1) * math.sin(2 * math.pi * j / k)) for j in range(k)]
        rings.append((i, [*ring, ring[0]]))
    rings += [(900, []), (901, None), (902, [(0.0, 0.0)])]
    points = [(i, draw.uniform(-40, 40), draw.uniform(-40, 40)) for i in range(500)] + [(1000 + i, *rings[i][1][0]) for i in range(60)] + [(-1, None, 1.0), (-2, float("nan"), 1.0), (-3, 1e300, -1e300)]
    zones = spark.createDataFrame([(i, r and [{"x": x, "y": y} for x, y in r]) for i, r in rings], "id int, ring array<struct<x: double, y: double>>")
    got = spatial.zonal_join(spark.createDataFrame(points, "p int, lon double, lat double"), zones)

    def holds(ring, x, y):
        crossed = 0
        for (ax, ay), (bx, by) in zip(ring or [], (ring or [])[1:], strict=False):
            crossed += ((ay <= y) != (by <= y)) and x < ax + (y - ay) / (by - ay) * (bx - ax)
        return crossed % 2 == 1

    want = sorted((p, i) for p, x, y in points if x is not None and x == x for i, ring in rings if holds(ring, x, y))
    assert sorted((r.p, r.id) for r in got.collect()) == want and len(want) > 100


def test_a_box_of_a_million_small_cells_has_a_handful_of_keys(spark):
    rows = [(0.0, 1e6, 0.0, 1e6), (10.0, 10.001, 10.0, 10.001), (-3.0, 4.0, -5.0, 6.0), (7.0, 7.0, 7.0, 7.0), (0.0, 0.0, 0.0, 0.0), (1e15, 1e15 + 1, 0.0, 1.0)]
    ends = [F.col(c) for c in ("a", "b", "c", "d")]
    got = spark.createDataFrame(rows, "a double, b double, c double, d double").select(spatial.box_level(*ends).alias("l"), "*").select("l", F.size(spatial.box_cells(F.col("l"), *ends)).alias("n"))
    assert [(r.l, r.n) for r in got.collect()][:3] == [(20, 1), (-9, 1), (4, 4)] and all(1 <= r.n <= 4 for r in got.collect())


def test_a_crowded_cell_is_shared(spark):
    """A third of the points in one cell: no lane holds more than a share; of equal points those of a partition stay together."""
    points = spark.range(30_000).select("id", F.when(F.col("id") % 3 == 0, 0.5).otherwise(F.col("id") / 7 + 100).alias("lon"), F.lit(0.5).alias("lat"))
    cells = points.withColumn("cell", spatial.cell_at(F.lit(0), F.col("lon"), F.col("lat")))
    zones = spark.createDataFrame([(i, 0.0 if i < 5 else 200.0 + i) for i in range(20)], "z int, lon double").withColumn("cell", spatial.cell_at(F.lit(0), F.col("lon"), F.lit(0.5)))
    left, right = spatial.deal_cells(cells.repartition(8), zones, "cell", "lane")
    sizes = [r["count"] for r in left.groupBy("cell", "lane").count().collect()]
    assert max(sizes) <= 30_000 / 200
    equal = spatial.deal_cells(cells.drop("id").repartition(8), zones, "cell", "lane")[0].where("lon = 0.5")
    assert max(r["count"] for r in equal.groupBy("cell", "lane").count().collect()) <= 2 * 10_000 / 8
    both = left.select("cell", "lane").join(right, ["cell", "lane"]).groupBy("z").count().collect()
    assert {r.z: r["count"] for r in both if r.z < 5} == dict.fromkeys(range(5), 10_000)
    square = lambda i, x, w: (i, [{"x": a, "y": b} for a, b in ((x, 0.0), (x + w, 0.0), (x + w, 1.0), (x, 1.0), (x, 0.0))])
    rings = spark.createDataFrame([square(1, 0.0, 1.0), square(2, -10.0, 1e6), square(3, 100.0, 1.0)], "id int, ring array<struct<x: double, y: double>>")
    found = {r.id: r["count"] for r in spatial.zonal_join(points.drop("id"), rings).groupBy("id").count().collect()}
    assert found == {1: 10_000, 2: 30_000, 3: sum(1 for i in range(30_000) if i % 3 and 100 <= i / 7 + 100 < 101)}


def test_stored_tables_are_joined_without_a_shuffle(spark, tmp_path):
    tiles = spark.range(600).select((F.col("id") % 40).alias("path"), (F.col("id") % 3).cast("int").alias("tile_y"), F.lit(0).alias("tile_x"), (F.col("id") % 12 + 1).alias("bin"), F.lit("b").alias("band"), F.array(F.col("id").cast("float")).alias("values"))
    labels = tiles.select("path", "tile_y", "tile_x").distinct().withColumn("labels", F.array(F.lit(2).cast("smallint")))
    split = spark.range(30).select(F.col("id").alias("path"), F.lit("train").alias("target"))
    stored = []
    for name, df in (("tiles_t", tiles), ("labels_t", labels), ("split_t", split)):
        tables.write_stored(df, name, f"file://{tmp_path}/{name}", 4)
        stored.append(tables.read_stored(spark, name))
    encoder = encode.encoder_table(spark, [{"name": "none", "id": []}, {"name": "a", "id": [2]}])
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        fed = composite.feed(*stored, encoder, "train", bins=(1, 12))
        some = tables.tiles_of(stored[0], stored[2], strict=True)
        for df in (fed, some, tables.tiles_of(stored[0], stored[2])):
            plan = df._jdf.queryExecution().executedPlan().toString()
            assert "Exchange hashpartitioning" not in plan and "SortMergeJoin" in plan
        assert fed.count() == some.count() == 450 and {r.labels[0] for r in fed.collect()} == {1}
        with pytest.raises(Exception, match="no composite of 77"):
            tables.tiles_of(stored[0], stored[2].unionAll(spark.createDataFrame([(77, "train")], split.schema)), strict=True).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    spark.sql("DROP TABLE labels_t")
    again = tables.read_stored(spark, "labels_t", f"file://{tmp_path}/labels_t", 4)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, labels.collect()))
    for name in ("tiles_t", "labels_t", "split_t"):
        spark.sql(f"DROP TABLE {name}")


def test_every_labelled_pixel_is_scored(spark):
    rows = [(i, None if i % 4 == 0 else float("nan") if i % 5 == 0 else float(i % 7), float(i % 3), None, 1 + i % 2 if i % 11 else None, "val" if i % 3 == 0 else "train") for i in range(400)]
    df = spark.createDataFrame(rows, "i int, f double, g double, h double, label int, target string")
    for features in (["f", "g", "h"], ["g"], ["h"]):
        got = {r.target: r.pixels for r in jobs.classifier_job(df, features, 3, maxIter=3).collect()}
        assert got == Counter(r[5] for r in rows if r[4] is not None)


def test_a_row_to_score_may_lack_what_training_rows_have(spark):
    train = spark.createDataFrame([(float(i), i % 2) for i in range(50)], "f double, label int")
    model = jobs.fit_classifier(train, ["f"], maxIter=3)
    assert jobs.predict(model, spark.createDataFrame([(None, 0), (float("nan"), 1), (3.0, 1)], "f double, label int")).count() == 3


def test_annotation_documents_by_lines(spark, tmp_path):
    rows = [(i, f"netcdf/2019_T{i % 3}_patch_{i}_0.nc", "train" if i % 4 else "test") for i in range(500)]
    split = spark.createDataFrame(rows, "id int, file string, target string").repartition(3)
    tables.write_annotation_splits(split, f"{tmp_path}/a", images=20, documents=4)
    got = tables.read_annotation_splits(spark, f"{tmp_path}/a", lines=True)
    assert sorted(map(tuple, got.collect())) == sorted((f"2019/T{i % 3}/2019_T{i % 3}_patch_{i}_0.nc", t) for i, _, t in rows)
    files = [p for p in tmp_path.glob("a/target=*/*.json")]
    assert all(len(p.read_text().splitlines()) <= 4 for p in files) and len({p.parent for p in files}) == 2
    assert tables.read_annotation_splits(spark, f"{tmp_path}/a", ("test",), lines=True).count() == 125


def test_composite_product_is_its_parts(spark, tmp_path):
    edges = composite.bin_edges(spark, "2020-01-01 00:00:00", "2020-04-01 00:00:00", "month")
    rng = random.Random(9)
    ratio = {"A": 1, "B": 2, "C": 3}
    rows = [(p, b, dt.datetime(2020, rng.randint(1, 3), rng.randint(2, 28)), y, x, rng.random()) for p in "pq" for b, r in ratio.items() for y in range(12 // r) for x in range(12 // r) for _ in range(rng.choice([1, 2, 3]) if (p, b) != ("q", "B") or (y, x) != (0, 0) else 0)]
    obs = spark.createDataFrame(rows, "path string, band string, time timestamp_ntz, y int, x int, value double").withColumn("year", F.lit(2020))
    labels = spark.createDataFrame([("p", y, x, 12 * y + x) for y in range(12) for x in range(12) if (y, x) != (5, 5)], "path string, y int, x int, label int")
    out = jobs.composite_product(obs, edges, list(ratio), 12, 4, f"file://{tmp_path}/product", ratio, labels, by=["year"])
    series = composite.filled_series(composite.assign_bin(obs, edges), ["path", "band", "y", "x"], edges)
    want = {}
    for r in series.collect():
        k = ratio[r.band]
        for e in r.series:
            for y in range(r.y * k, r.y * k + k):
                for x in range(r.x * k, r.x * k + k):
                    want[r.path, y // 4, x // 4, e["bin"], r.band, y % 4 * 4 + x % 4] = e["filled"]
    got = {(r.path, r.tile_y, r.tile_x, r.bin, r.band, i): v for r in out["tiles"].collect() for i, v in enumerate(r["values"])}
    missing = {k for k, v in got.items() if v is None and k not in want}
    assert len(missing) == 3 * 4 and {k[:2] + (k[4],) for k in missing} == {("q", 0, "B")}
    assert all(v == pytest.approx(want[k], rel=1e-6) if want[k] is not None else v is None for k, v in got.items() if k in want) and len(got) == len(want) + 12
    held = {(r.path, r.tile_y, r.tile_x): r for r in out["tile_labels"].collect()}
    assert len(held) == 9 and held["p", 1, 1]["labels"][5] == 0 and held["p", 0, 1]["labels"][:4] == [4, 5, 6, 7] and all(r.has_label and r.year == 2020 for r in held.values())
    meta = out["meta"].first()
    assert (meta.bands, meta.img_size, meta.num_patches, meta.num_subpatches_per_patch) == (["A", "B", "C"], [12, 12], 2, 9)


def test_block_selection(spark):
    rows = [(i, None if i % 10 == 3 else float("nan") if i == 0 else float(i * 7 % 11)) for i in range(100)]
    df = spark.createDataFrame(rows, "k int, score double")
    own = {k: v for k, v in rows if v is not None and v == v}
    got = scoring.select_blocks(df.select("k"), {"a": df}, ["2*a"], "k", "k", 20, 5)
    best = lambda b: sorted(range(20 * b, 20 * b + 20), key=lambda k: (-own.get(k, -1), k))[:5]
    assert sorted((r.block_id, r.k, r.score) for r in got.collect()) == sorted((b, k, 2 * own[k]) for b in range(5) for k in best(b))
    whole = scoring.select_blocks(df.select("k"), {}, [], "k", "k", 20, 20)
    assert whole.count() == 100 and {r.block_id for r in whole.collect()} == set(range(5))
    with pytest.raises(ValueError):
        scoring.select_blocks(df.select("k"), {}, ["none"], "k", "k", 20, 5)
    with pytest.raises(Exception, match="no score in block 1"):
        scoring.select_blocks(df.select("k"), {"a": df.where("k < 20 or k >= 40")}, ["a"], "k", "k", 20, 5).collect()
