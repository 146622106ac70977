"""One query for each operator on the driver's tables, with its SQL twin.

How tables stand for rasters: ``events`` are band observations (user = patch, type =
band), ``embeddings`` are 8 x 8 images and, by their first ten numbers, a model's logits,
``orders`` are patches, ``part`` a label raster and an elevation grid. Doubles are rounded
to six digits on both sides.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import columns as C
from .functions.frames import digest_rank, shared_dir, written
from .operators import composite as co
from .operators import encode as en
from .operators import metrics as me
from .operators import rules as ru
from .operators import scoring as sc
from .operators import spatial as sp
from .operators import splits as sl
from .operators import strata as st
from .operators import tiling as ti
from .plans import jobs
from .sources import tables as so

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def place_for(spark: SparkSession, name: str) -> str:
    """A new place in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def r6(name: str):
    return F.round(F.col(name).cast("double"), 6).alias(name)


# --- band observations -------------------------------------------------------------------

KEYS = ["user_id", "event_type"]
START, END, DAYS, BINS = "2024-01-01", "2024-01-31", 3, 10
EDGES = f"edges AS (SELECT (i + 1)::INT AS bin, TIMESTAMP '{START}' + i * INTERVAL {DAYS} DAY AS lo, TIMESTAMP '{START}' + (i + 1) * INTERVAL {DAYS} DAY AS hi FROM range({BINS}) t(i))"
BINNED = f"{EDGES}, binned AS (SELECT events.*, bin, lo FROM events JOIN edges ON ts > lo AND ts <= hi)"
MEDIANS = f"{BINNED}, med AS (SELECT user_id, event_type, bin, median(value) AS median FROM binned GROUP BY ALL)"
GRID = f"{MEDIANS}, g AS (SELECT k.user_id, k.event_type, e.bin, e.lo, med.median FROM (SELECT DISTINCT user_id, event_type FROM med) k CROSS JOIN edges e LEFT JOIN med ON med.user_id = k.user_id AND med.event_type = k.event_type AND med.bin = e.bin)"
FILLED = f"""{GRID}, ends AS (
  SELECT user_id, event_type, list(median ORDER BY lo) FILTER (WHERE median IS NOT NULL) AS ys, list(epoch(lo) ORDER BY lo) FILTER (WHERE median IS NOT NULL) AS xs FROM g GROUP BY ALL
), near AS (
  SELECT g.*, epoch(lo) AS x,
    last_value(CASE WHEN median IS NOT NULL THEN epoch(lo) END IGNORE NULLS) OVER b AS ax, last_value(median IGNORE NULLS) OVER b AS ay,
    first_value(CASE WHEN median IS NOT NULL THEN epoch(lo) END IGNORE NULLS) OVER a AS bx, first_value(median IGNORE NULLS) OVER a AS by_
  FROM g WINDOW b AS (PARTITION BY user_id, event_type ORDER BY lo ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
    a AS (PARTITION BY user_id, event_type ORDER BY lo ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
), filled AS (
  SELECT user_id, event_type, bin, lo, CASE WHEN median IS NOT NULL OR coalesce(len(ys), 0) < 2 THEN median
    WHEN ax IS NULL THEN ys[1] + (ys[2] - ys[1]) * (x - xs[1]) / (xs[2] - xs[1])
    WHEN bx IS NULL THEN ys[-2] + (ys[-1] - ys[-2]) * (x - xs[-2]) / (xs[-1] - xs[-2])
    ELSE ay + (by_ - ay) * (x - ax) / (bx - ax) END AS filled
  FROM near JOIN ends USING (user_id, event_type)
)"""


def edges(spark: SparkSession) -> DataFrame:
    return co.bin_edges(spark, f"{START} 00:00:00", f"{END} 00:00:00", "day", DAYS)


def binned(spark: SparkSession, sf: str) -> DataFrame:
    return co.assign_bin(table(spark, sf, "events"), edges(spark), "ts")


def medians(spark: SparkSession, sf: str) -> DataFrame:
    return co.median_composite(binned(spark, sf), [*KEYS, "bin"])


def filled(spark: SparkSession, sf: str) -> DataFrame:
    return co.fill_gaps(co.complete_bins(medians(spark, sf), KEYS, edges(spark)), KEYS, "lo", "median")


@query("SELECT event_id, event_type, value FROM events WHERE event_type IN ('click', 'view')")
def s2_band_projection(spark, sf):
    return so.read_bands(spark, f"{sf}/events.parquet", ["click", "view"], "event_type").select("event_id", "event_type", "value")


@query("SELECT p_partkey, p_size::SMALLINT AS label FROM part")
def s3_label_source(spark, sf):
    return so.read_labels(table(spark, sf, "part").select("p_partkey", F.col("p_size").alias("label")))


@query(f"WITH {BINNED} SELECT event_id, bin FROM binned")
def p2_assign_bin(spark, sf):
    return binned(spark, sf).select("event_id", "bin")


@query("SELECT l_suppkey, l_returnflag, date_trunc('month', l_shipdate - INTERVAL 1 MICROSECOND)::TIMESTAMP AS lo, round(median(l_quantity), 6) AS median FROM lineitem GROUP BY ALL")
def p2_month_bin(spark, sf):
    rows = co.month_bin(table(spark, sf, "lineitem"), "l_shipdate")
    return co.median_composite(rows, ["l_suppkey", "l_returnflag", "lo"], "l_quantity").select("l_suppkey", "l_returnflag", "lo", r6("median"))


@query(f"WITH {MEDIANS} SELECT user_id, event_type, bin, round(median, 6) AS median FROM med")
def a1_median_composite(spark, sf):
    return medians(spark, sf).select(*KEYS, "bin", r6("median"))


@query(f"WITH {GRID} SELECT user_id, event_type, bin, round(median, 6) AS median FROM g")
def j9_complete_bins(spark, sf):
    return co.complete_bins(medians(spark, sf), KEYS, edges(spark)).select(*KEYS, "bin", r6("median"))


@query(f"WITH {FILLED} SELECT user_id, event_type, bin, round(filled, 6) AS filled FROM filled")
def w1_gap_fill(spark, sf):
    return filled(spark, sf).select(*KEYS, "bin", r6("filled"))


@query(f"WITH {FILLED} SELECT user_id, event_type, bin, lo, round(median, 6) AS median, round(f.filled, 6) AS filled FROM filled f JOIN g USING (user_id, event_type, bin, lo)")
def w1_gap_fill_arrays(spark, sf):
    """The same by arrays: median, completion and filling in one shuffle, no window."""
    series = co.filled_series(binned(spark, sf), KEYS, edges(spark))
    return series.select(*KEYS, F.explode("series").alias("e")).select(*KEYS, "e.bin", "e.lo", F.round("e.median", 6).alias("median"), F.round("e.filled", 6).alias("filled"))


BANDS = ["click", "view", "purchase"]


@query(f"WITH {FILLED} SELECT user_id, bin, round(max(filled) FILTER (event_type = 'click'), 6) AS click, round(max(filled) FILTER (event_type = 'view'), 6) AS view, round(max(filled) FILTER (event_type = 'purchase'), 6) AS purchase FROM filled GROUP BY ALL")
def j8_align_bands(spark, sf):
    return co.align_bands(filled(spark, sf), ["user_id", "bin"], BANDS, "event_type", "filled").select("user_id", "bin", *map(r6, BANDS))


@query(f"WITH {MEDIANS} SELECT user_id, event_type, bin, round(median / 10000, 9) AS value FROM med WHERE bin BETWEEN 4 AND 9")
def f5_p4_bins_normalised(spark, sf):
    return co.select_bins(medians(spark, sf)).select(*KEYS, "bin", F.round(C.normalise(F.col("median")), 9).alias("value"))


@query(
    f"""WITH {FILLED}, wide AS (SELECT user_id, bin, max(filled) FILTER (event_type = 'click') AS click, max(filled) FILTER (event_type = 'view') AS view, max(filled) FILTER (event_type = 'purchase') AS purchase FROM filled GROUP BY ALL),
top AS (SELECT user_id, max(greatest(click, view, purchase)) AS m FROM wide WHERE bin = 4 GROUP BY 1)
SELECT user_id, CASE WHEN m <> 0 THEN greatest(0, least(255, floor(click / m * 256)))::INT END AS click, CASE WHEN m <> 0 THEN greatest(0, least(255, floor(view / m * 256)))::INT END AS view, CASE WHEN m <> 0 THEN greatest(0, least(255, floor(purchase / m * 256)))::INT END AS purchase FROM wide JOIN top USING (user_id) WHERE bin = 4 AND click IS NOT NULL AND view IS NOT NULL AND purchase IS NOT NULL"""
)
def p11_preview(spark, sf):
    wide = co.align_bands(co.select_bins(filled(spark, sf), 4, 4), ["user_id", "bin"], BANDS, "event_type", "filled")
    return co.preview(wide, ["user_id"], BANDS).dropna(subset=BANDS).select("user_id", *BANDS)


# --- rasters -----------------------------------------------------------------------------

PIXELS = "px AS (SELECT vec_id, (i - 1) // 8 AS y, (i - 1) % 8 AS x, embedding[i] AS value FROM embeddings, range(1, 65) t(i))"


def pixels(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "value"))
    return rows.select("vec_id", F.expr("i div 8").cast("int").alias("y"), (F.col("i") % 8).alias("x"), "value")


@query("SELECT vec_id, ((i - 1) // 8 * 2 + dy)::INT AS y, ((i - 1) % 8 * 2 + dx)::INT AS x, embedding[i] AS value FROM embeddings, range(1, 65) t(i), range(2) a(dy), range(2) b(dx)")
def p3_resample(spark, sf):
    return co.resample(pixels(spark, sf), 2).select("vec_id", "y", "x", "value")


def _tile_sql(window: int, step: int, n: int) -> str:
    return f"WITH {PIXELS} SELECT vec_id, (y // {step})::INT AS tile_y, (x // {step})::INT AS tile_x, (y % {step})::INT AS dy, (x % {step})::INT AS dx, value FROM px WHERE y % {step} < {window} AND x % {step} < {window} AND y // {step} < {n} AND x // {step} < {n}"


@query(_tile_sql(4, 4, 2))
def w2_tile(spark, sf):
    return ti.tile(pixels(spark, sf), 8, 4).select("vec_id", "tile_y", "tile_x", "dy", "dx", "value")


@query(_tile_sql(3, 4, 2))
def w2_tile_with_gaps(spark, sf):
    return ti.tile(pixels(spark, sf), 8, 3).select("vec_id", "tile_y", "tile_x", "dy", "dx", "value")


@query(f"WITH {PIXELS} SELECT vec_id, y::INT AS y, x::INT AS x, value FROM px")
def w11_mosaic(spark, sf):
    tiles = ti.gather_tiles(ti.tile(pixels(spark, sf), 8, 4), ["vec_id"])
    return ti.mosaic(ti.spread_tiles(tiles, 4), 4).select("vec_id", "y", "x", "value")


@query(f"WITH {PIXELS} SELECT vec_id, y::INT AS y, x::INT AS x, value FROM px WHERE y BETWEEN 2 AND 5 AND x BETWEEN 2 AND 5")
def f10_border_crop(spark, sf):
    return pixels(spark, sf).where(C.interior(F.col("y"), F.col("x"), 8, 8, 2))


@query(f"WITH {PIXELS} SELECT vec_id, (y // 4)::INT AS tile_y, (x // 4)::INT AS tile_x FROM px GROUP BY ALL HAVING max(floor(abs(value) * 4)) > 0")
def f6_skip_empty_tiles(spark, sf):
    labelled = ti.tile(pixels(spark, sf), 8, 4).withColumn("label", F.floor(F.abs("value") * 4).cast("int"))
    return ti.skip_empty(labelled, ["vec_id", "tile_y", "tile_x"])


@query("SELECT vec_id, t AS tile_y, u AS tile_x FROM (SELECT vec_id FROM embeddings ORDER BY vec_id LIMIT 6), (SELECT i::INT AS t FROM range(2) a(i)), (SELECT i::INT AS u FROM range(2) b(i))")
def w12_first_patches(spark, sf):
    tiles = ti.tile(pixels(spark, sf), 8, 4).select("vec_id", "tile_y", "tile_x").distinct()
    return sl.first_patches(tiles, "vec_id", 6)


@query("""WITH t AS (SELECT DISTINCT user_id, event_id % 3 AS tile_y, event_id % 2 AS tile_x FROM events), n AS (SELECT count(*) AS n FROM t GROUP BY user_id), b AS (SELECT list_sort(list(DISTINCT event_type)) AS bands FROM events)
SELECT bands, [8, 8] AS img_size, (SELECT count(*) FROM n) AS num_patches, (SELECT max(n) FROM n)::INT AS num_subpatches_per_patch, '3D_' || array_to_string(bands, '') || '_8x8' AS name FROM b""")
def s9_p18_composite_meta(spark, sf):
    tiles = table(spark, sf, "events").select(F.col("user_id").alias("path"), (F.col("event_id") % 3).alias("tile_y"), (F.col("event_id") % 2).alias("tile_x"), F.col("event_type").alias("band"), F.array(F.lit(8), F.lit(8)).alias("img_size"))
    size = lambda i: F.get("img_size", F.lit(i))
    return so.composite_meta(tiles).select("bands", "img_size", "num_patches", F.col("num_subpatches_per_patch").cast("int").alias("num_subpatches_per_patch"), C.composite_name("3D", F.col("bands"), size(0), size(1)).alias("name"))


@query(f"WITH {PIXELS} SELECT vec_id AS path, (y // 4)::INT AS tile_y, (x // 4)::INT AS tile_x, (y % 4 * 4 + x % 4)::INT AS place, value FROM px JOIN embeddings USING (vec_id) WHERE label < 5")
def j3_s7_s8_split_join_composite(spark, sf):
    """Tiles and a split stored in buckets of the path, and joined as they lie; every patch of the split has tiles."""
    tiles = ti.gather_tiles(ti.tile(pixels(spark, sf), 8, 4), ["vec_id"]).withColumnRenamed("vec_id", "path")
    split = table(spark, sf, "embeddings").where("label < 5").select(F.col("vec_id").alias("path"))
    stored = [stored_table(spark, name, df) for name, df in (("tiles", tiles), ("split", split))]
    return so.tiles_of(*stored, strict=True).select("path", "tile_y", "tile_x", F.posexplode("values").alias("place", "value"))


def stored_table(spark: SparkSession, name: str, df: DataFrame, buckets: int = 8) -> DataFrame:
    """``df`` in buckets of the path, under a new name."""
    place = place_for(spark, name)
    unique = f"{name}_{uuid.uuid4().hex}"
    so.write_stored(df, unique, place, buckets)
    return so.read_stored(spark, unique)


@query(
    """SELECT vec_id AS path, b::INT AS bin, round(embedding[b] / 10000.0, 9) AS value, CASE WHEN label IN (2, 3) THEN 1 WHEN label = 5 THEN 2 ELSE 0 END::INT AS class_id FROM embeddings, range(4, 10) t(b) WHERE label IN (2, 3, 5) AND vec_id % 3 = 0"""
)
def f6_j4_feed(spark, sf):
    vec = table(spark, sf, "embeddings")
    base = vec.select(F.col("vec_id").alias("path"), F.lit(0).alias("tile_y"), F.lit(0).alias("tile_x"), "embedding", "label")
    tiles = base.select("path", "tile_y", "tile_x", F.posexplode("embedding").alias("i", "v")).select("path", "tile_y", "tile_x", (F.col("i") + 1).alias("bin"), F.lit("b").alias("band"), F.array("v").alias("values"))
    labels = base.select("path", "tile_y", "tile_x", F.array("label").alias("labels"))
    split = base.select("path", F.when(F.col("path") % 3 == 0, "train").otherwise("val").alias("target"))
    encoder = en.encoder_table(spark, [{"name": "none", "id": []}, {"name": "a", "id": [2, 3]}, {"name": "b", "id": 5}])
    fed = co.feed(tiles, labels, split, encoder, "train", skip_empty=True)
    return fed.select("path", "bin", F.round(F.col("values")[0], 9).alias("value"), F.col("labels")[0].alias("class_id"))


# --- patches, rules, splits --------------------------------------------------------------

ORDERS = "o AS (SELECT *, year(o_orderdate) || '_' || o_orderpriority || '_patch_' || o_orderkey % 30 || '_' || o_orderkey // 30 % 30 AS name FROM orders)"
PARTS = f"{ORDERS}, p AS (SELECT o_orderkey, o_totalprice, name, year(o_orderdate)::INT AS year, o_orderpriority AS tile, (o_orderkey % 30)::INT AS patch_x, (o_orderkey // 30 % 30)::INT AS patch_y FROM o)"
RULES = [
    {"year": {"max": 1995}, "target": "train"},
    {"tile": ["1-URGENT", "2-HIGH"], "rules": [{"patch_x": {"min": 10, "max": 19}, "target": "test"}, {"patch_x": {"in": [1, 2, 3, 25]}, "patch_y": {"max": 14}, "target": "val"}]},
    {"year": 1996, "tile": "5-LOW", "target": [{"target": "train", "split": 0.5}, {"target": "val"}, {"target": "test"}]},
    {"year": {"min": 1997, "max": 1998}, "target": [{"target": "train", "split": 0.05}, {"target": "val", "split": 0.01}, {"target": "test", "split": 0.01}]},
    {"year": 1800, "assert_none": True},
]
RULED = f"""{PARTS}, r AS (SELECT *, CASE WHEN year <= 1995 THEN 'train|0' WHEN tile IN ('1-URGENT', '2-HIGH') THEN CASE WHEN patch_x BETWEEN 10 AND 19 THEN 'test|1,0' WHEN patch_x IN (1, 2, 3, 25) AND patch_y <= 14 THEN 'val|1,1' END
 WHEN year = 1996 AND tile = '5-LOW' THEN '|2' WHEN year BETWEEN 1997 AND 1998 THEN '|3' END AS rule FROM p),
ruled AS (SELECT *, nullif(split_part(rule, '|', 1), '') AS target, split_part(rule, '|', 2) AS loc FROM r WHERE rule IS NOT NULL)"""
SPLIT = f"""{RULED}, ranked AS (SELECT *, row_number() OVER (PARTITION BY loc ORDER BY md5('42|' || loc || '|' || o_orderkey), o_orderkey::VARCHAR) AS k, count(*) OVER (PARTITION BY loc) AS n FROM ruled WHERE target IS NULL),
split AS (SELECT o_orderkey, name, tile, o_totalprice, target FROM ruled WHERE target IS NOT NULL
 UNION ALL SELECT o_orderkey, name, tile, o_totalprice, CASE WHEN loc = '2' THEN CASE WHEN k <= round_even(0.5 * n, 0) THEN 'train' WHEN k <= round_even(0.75 * n, 0) THEN 'val' WHEN k <= n THEN 'test' END
  ELSE CASE WHEN k <= round_even((0.05::DOUBLE) * n, 0) THEN 'train' WHEN k <= round_even((0.05::DOUBLE + 0.01::DOUBLE) * n, 0) THEN 'val' WHEN k <= round_even((0.05::DOUBLE + 0.01::DOUBLE + 0.01::DOUBLE) * n, 0) THEN 'test' END END FROM ranked)"""


def patches(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    name = F.concat_ws("_", F.year("o_orderdate"), "o_orderpriority", F.lit("patch"), F.col("o_orderkey") % 30, F.expr("o_orderkey div 30 % 30"))
    named = o.select("o_orderkey", "o_totalprice", name.alias("name"), F.concat(name, F.lit(".nc")).alias("path"))
    return named.select("o_orderkey", "o_totalprice", "name", "path", C.patch_name(F.col("path")).alias("n")).select("o_orderkey", "o_totalprice", "name", "path", "n.*")


def stored_patches(spark: SparkSession, sf: str) -> DataFrame:
    """Names are parsed once; rules read them many times."""
    return written(patches(spark, sf), "patches")


def ruled(spark: SparkSession, sf: str) -> DataFrame:
    return ru.apply_rules(stored_patches(spark, sf), RULES)


def split(spark: SparkSession, sf: str) -> DataFrame:
    return sl.apply_splits(ruled(spark, sf), RULES, 42, "o_orderkey")


@query(f"WITH {PARTS} SELECT o_orderkey, year, tile, patch_x, patch_y FROM p")
def p1_patch_name(spark, sf):
    return patches(spark, sf).select("o_orderkey", "year", "tile", "patch_x", "patch_y")


@query(f"WITH {PARTS} SELECT o_orderkey FROM p WHERE year IN (1996, 1999) AND patch_x >= 3 AND patch_x <= 20 AND tile = '5-LOW'")
def f1_rule_filter(spark, sf):
    where = ru.filter_expr(F.col("year"), [1996, 1999]) & ru.filter_expr(F.col("patch_x"), {"min": 3, "max": 20}) & ru.filter_expr(F.col("tile"), "5-LOW")
    return patches(spark, sf).where(where).select("o_orderkey")


@query(f"WITH {RULED} SELECT o_orderkey, target, loc FROM ruled")
def f2_f3_rules(spark, sf):
    return ruled(spark, sf).select("o_orderkey", "target", F.concat_ws(",", F.transform("rule_loc", lambda i: i.cast("string"))).alias("loc"))


@query(f"WITH {SPLIT} SELECT o_orderkey, target FROM split WHERE target IS NOT NULL")
def w3_f4_random_split(spark, sf):
    return split(spark, sf).select("o_orderkey", "target")


@query(
    """WITH n AS (SELECT count(*) AS total FROM orders), s AS (SELECT o_orderpriority AS stratum, count(*) AS n FROM orders GROUP BY 1),
q AS (SELECT *, round_even(0.7::DOUBLE * total, 0) AS want, n * round_even(0.7::DOUBLE * total, 0) / total::DOUBLE AS share FROM s, n),
f AS (SELECT *, floor(share) AS base, row_number() OVER (ORDER BY round(share - floor(share), 9) DESC, md5('42|0|' || stratum)) AS place, want - sum(floor(share)) OVER () AS more FROM q),
k AS (SELECT stratum, base + (place <= more)::INT AS quota FROM f),
r AS (SELECT o_orderkey, o_orderpriority AS stratum, row_number() OVER (PARTITION BY o_orderpriority ORDER BY md5('42|strata|' || o_orderkey), o_orderkey::VARCHAR) AS rank FROM orders)
SELECT o_orderkey, stratum, CASE WHEN rank <= quota THEN 'train' ELSE 'test' END AS target FROM r JOIN k USING (stratum)"""
)
def w4_stratified_split(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderkey", F.col("o_orderpriority").alias("stratum"))
    return sl.stratified_split(rows, "o_orderkey", "stratum", [{"target": "train", "split": 0.7}, {"target": "test", "split": 0.3}], 42)


def _lone_bins_sql(name: str, histogram: str) -> str:
    """Recursive steps over the distances for ``histogram(g, hist)``; ``name_map(g, bin, new)`` is what they end in."""
    return f"""{name}(g, d, rows_, moved) AS (
  SELECT g, 1, list_sort(hist), list_transform(list_sort(hist), lambda x: {{'bin': x.bin, 'new': x.bin}}) FROM {histogram}
  UNION ALL SELECT g, d + 1, CASE WHEN len(runs) = 0 THEN rows_ ELSE list_transform(list_sort(list_distinct(list_transform(renamed, lambda x: x.bin))), lambda v: {{'bin': v, 'n': list_sum(list_transform(list_filter(renamed, lambda x: x.bin = v), lambda x: x.n))::BIGINT}}) END,
    list_transform(moved, lambda m: {{'bin': m.bin, 'new': coalesce(list_filter(runs, lambda r: r.bin = m.new)[1].new, m.new)}})
  FROM (SELECT *, list_transform(rows_, lambda x: {{'bin': coalesce(list_filter(runs, lambda r: r.bin = x.bin)[1].new, x.bin), 'n': x.n}}) AS renamed
  FROM (SELECT *, list_transform(placed, lambda x: {{'bin': x.bin, 'new': (list_filter(expanded, lambda e: e.run = x.run)[1].med)}}) AS runs
  FROM (SELECT *, list_transform(list_distinct(list_transform(placed, lambda x: x.run)), lambda r: {{'run': r, 'med': floor(list_median(flatten(list_transform(list_filter(placed, lambda x: x.run = r), lambda x: list_transform(range(x.n), lambda k: x.bin)))))::INT}}) AS expanded
  FROM (SELECT *, list_transform(taken, lambda x, i: {{'bin': x.bin, 'n': x.n, 'run': greatest(0, (i - 1 - len(taken) % 2) // 2)}}) AS placed
  FROM (SELECT *, list_filter(seen, lambda x: x.n = 1 AND (x.below OR x.above) OR list_contains(along, x.bin)) AS taken
  FROM (SELECT *, list_transform(list_filter(seen, lambda x: x.n = 1 AND NOT x.near AND (x.below OR x.above)), lambda x: CASE WHEN x.below THEN x.bin - d ELSE x.bin + d END) AS along
  FROM (SELECT *, list_transform(rows_, lambda x: {{'bin': x.bin, 'n': x.n, 'below': list_contains(bs, x.bin - d), 'above': list_contains(bs, x.bin + d), 'near': list_contains(lone, x.bin - d) OR list_contains(lone, x.bin + d)}}) AS seen
  FROM (SELECT *, list_transform(rows_, lambda x: x.bin) AS bs, list_transform(list_filter(rows_, lambda x: x.n = 1), lambda x: x.bin) AS lone FROM {name} WHERE d <= rows_[-1].bin - rows_[1].bin)))))))) WHERE len(lone) > 0
), {name}_map AS (SELECT g, m.bin, m.new FROM (SELECT g, unnest(moved) AS m FROM (SELECT g, arg_max(moved, d) AS moved FROM {name} GROUP BY g)))"""


def _bin_sql(column: str, n: int) -> str:
    return f"(CASE WHEN max({column}) OVER () = min({column}) OVER () THEN ceil({n} * 0.5) - 1 ELSE greatest(0, least({n - 1}, ceil(({column} - min({column}) OVER ())::DOUBLE / (max({column}) OVER () - min({column}) OVER ())::DOUBLE * {n}) - 1)) END)::INT"


@query(
    f"""WITH RECURSIVE binned AS (SELECT p_partkey, {_bin_sql("p_size", 7)} AS b1, {_bin_sql("p_retailprice", 40)} AS b2 FROM part),
h1 AS (SELECT 0 AS g, list({{'bin': b1, 'n': n}}) AS hist FROM (SELECT b1, count(*) AS n FROM binned GROUP BY 1)), {_lone_bins_sql("one", "h1")},
first AS (SELECT p_partkey, m.new AS b1, b2 FROM binned JOIN one_map m ON b1 = m.bin),
h2 AS (SELECT b1 AS g, list({{'bin': b2, 'n': n}}) AS hist FROM (SELECT b1, b2, count(*) AS n FROM first GROUP BY ALL) GROUP BY 1), {_lone_bins_sql("two", "h2")}
SELECT p_partkey, b1 || '__' || m.new AS stratum FROM first JOIN two_map m ON b1 = m.g AND b2 = m.bin"""
)
def w5_merged_strata(spark, sf):
    rows = st.bin_equal_width(st.bin_equal_width(table(spark, sf, "part").select("p_partkey", "p_size", "p_retailprice"), "p_size", 7, "b1"), "p_retailprice", 40, "b2")
    return st.stratum_key(st.merge_singletons(rows, ["b1", "b2"]), ["b1", "b2"]).select("p_partkey", "stratum")


@query(
    """WITH d AS (SELECT d.doc_id % 700 AS key, d.doc_id, CASE d.source WHEN 'src0' THEN 'test' WHEN 'src1' THEN 'val' ELSE 'train' END AS target FROM documents d),
a AS (SELECT *, count(*) OVER (PARTITION BY key) AS n FROM d), b AS (SELECT * FROM a WHERE NOT (target = 'test' AND n > 1)),
c AS (SELECT doc_id, key, target, count(*) OVER (PARTITION BY key) AS n FROM b) SELECT doc_id, target FROM c WHERE NOT (target = 'val' AND n > 1)"""
)
def w6_drop_duplicates(spark, sf):
    target = F.when(F.col("source") == "src0", "test").when(F.col("source") == "src1", "val").otherwise("train")
    rows = table(spark, sf, "documents").select("doc_id", (F.col("doc_id") % 700).alias("key"), target.alias("target"))
    return sl.drop_duplicates_by_split(rows, "key", ["test", "val"]).select("doc_id", "target")


@query(f"WITH {SPLIT}, k AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY md5('7|subsample|' || o_orderkey), o_orderkey::VARCHAR) AS rank, count(*) OVER (PARTITION BY target) AS n FROM split WHERE target IS NOT NULL) SELECT o_orderkey, target FROM k WHERE target = 'test' OR rank <= round_even(CASE target WHEN 'train' THEN 0.25::DOUBLE ELSE 0.6::DOUBLE END * n, 0)")
def w7_subsample(spark, sf):
    return sl.subsample(split(spark, sf), "o_orderkey", {"train": 0.25, "val": 0.6}, 7).select("o_orderkey", "target")


@query("SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY md5('3|limit|' || o_orderkey), o_orderkey::VARCHAR) AS k, count(*) OVER () AS n FROM orders) WHERE k <= round_even(0.1::DOUBLE * n, 0)")
def f8_fraction_limit(spark, sf):
    return sl.fraction_limit(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey", 0.1, 3)


@query("SELECT o_orderkey, row_number() OVER (ORDER BY md5('9|' || o_orderkey), o_orderkey::VARCHAR) AS rank FROM orders")
def w9_seeded_order(spark, sf):
    return digest_rank(table(spark, sf, "orders").select("o_orderkey"), 9, F.col("o_orderkey"))


@query("SELECT o_orderkey, ((row_number() OVER (ORDER BY o_totalprice, md5(o_orderkey::VARCHAR), o_orderkey) - 1) // 256)::BIGINT AS block_id FROM orders")
def w10_blocks(spark, sf):
    return sl.assign_blocks(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", 256, key="o_orderkey").select("o_orderkey", "block_id")


@query(f"WITH {SPLIT} SELECT o_orderkey, CASE target WHEN 'train' THEN 'val' WHEN 'val' THEN 'train' ELSE target END AS target FROM split WHERE target IS NOT NULL")
def p15_swap(spark, sf):
    return sl.swap_targets(split(spark, sf)).select("o_orderkey", "target")


@query(f"WITH {SPLIT} SELECT target, count(*) AS patches FROM split WHERE target IS NOT NULL GROUP BY 1")
def a5_patches_per_target(spark, sf):
    return en.patches_per_target(split(spark, sf))


@query(f"WITH {SPLIT} SELECT name || '.nc' AS path FROM split WHERE target = 'val'")
def s5_s6_split_lists(spark, sf):
    """Text lists of paths written for each target, and one of them read back."""
    place = place_for(spark, "lists")
    so.write_split_lists(split(spark, sf), place)
    return so.read_split(spark, place, "val", text=True).select("path")


@query(f"WITH {SPLIT}, n AS (SELECT count(*) AS patches FROM split WHERE target = 'train') SELECT ceil(patches * 36 / 128.0)::BIGINT AS batches, floor(patches * 36 / 128.0)::BIGINT AS whole FROM n")
def a27_expected_batches(spark, sf):
    n = en.patches_per_target(split(spark, sf)).where("target = 'train'")
    return n.select(C.batches_expected(F.col("patches"), F.lit(36), 128).alias("batches"), C.batches_expected(F.col("patches"), F.lit(36), 128, True).alias("whole"))


@query("SELECT p_partkey, (CASE WHEN p_size = lo THEN 0 ELSE greatest(0, least(6, ceil((p_size - lo) / (hi - lo)::DOUBLE * 7) - 1)) END)::INT AS bin FROM part, (SELECT min(p_size) AS lo, max(p_size) AS hi FROM part)")
def p16_equal_width(spark, sf):
    return st.bin_equal_width(table(spark, sf, "part").select("p_partkey", "p_size"), "p_size", 7, "bin").select("p_partkey", "bin")


@query("SELECT p_partkey, p_brand || '__' || p_size AS stratum FROM part")
def p17_stratum_key(spark, sf):
    return st.stratum_key(table(spark, sf, "part"), ["p_brand", "p_size"]).select("p_partkey", "stratum")


@query("SELECT 'train' AS target, o_orderkey FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT 'val', o_orderkey FROM orders WHERE o_orderstatus = 'O'")
def u1_union_sources(spark, sf):
    o = table(spark, sf, "orders")
    one, two = (o.where(F.col("o_orderstatus") == s).select(F.lit(t).alias("target"), "o_orderkey") for s, t in (("F", "train"), ("O", "val")))
    return one.unionByName(two)


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'HOUSEHOLD')")
def u2_keep_listed(spark, sf):
    listed = table(spark, sf, "customer").where("c_mktsegment = 'HOUSEHOLD'").select(F.col("c_custkey").alias("o_custkey"))
    return sl.keep_listed(table(spark, sf, "orders"), listed, "o_custkey", "o_orderkey").select("o_orderkey", "o_custkey")


DEDUPED = f"{SPLIT}, d AS (SELECT *, count(*) OVER (PARTITION BY name) AS same FROM split WHERE target IS NOT NULL), e AS (SELECT * FROM d WHERE NOT (target = 'test' AND same > 1))"


@query(f"WITH {DEDUPED}, k AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY md5('42|subsample|' || o_orderkey), o_orderkey::VARCHAR) AS rank, count(*) OVER (PARTITION BY target) AS n FROM e) SELECT o_orderkey, target, o_totalprice * 2 AS twice FROM k WHERE target = 'test' OR rank <= round_even(CASE target WHEN 'train' THEN 0.25::DOUBLE ELSE 0.6::DOUBLE END * n, 0)")
def l2_l3_split_job(spark, sf):
    """Rules, a processor, random splits, duplicates by patch name, subsample and shuffle, as one job."""
    rows = stored_patches(spark, sf).withColumnRenamed("name", "patch")
    out = jobs.split_job(rows, RULES, key="o_orderkey", seed=42, processors=[lambda d: d.withColumn("twice", F.col("o_totalprice") * 2)], duplicates=["test"], same="patch", fractions={"train": 0.25, "val": 0.6})
    return out["split"].select("o_orderkey", "target", "twice")


@query(f"WITH {DEDUPED} SELECT target, count(*) AS patches FROM e GROUP BY 1")
def l3_patch_counts(spark, sf):
    rows = stored_patches(spark, sf).withColumnRenamed("name", "patch")
    return jobs.split_job(rows, RULES, key="o_orderkey", seed=42, duplicates=["test"], same="patch")["patch_counts"]


BY_YEAR = "CASE WHEN year <= 1995 THEN 'train' WHEN year = 1996 THEN 'val' ELSE 'test' END"


@query(f"WITH {PARTS} SELECT DISTINCT name || '.nc' AS path, year, tile, patch_x, patch_y FROM p ORDER BY path LIMIT 100")
def s1_first_patches(spark, sf):
    """The listing's limit is the feature: the first paths in order."""
    return so.first_paths(patches(spark, sf).select("path", "year", "tile", "patch_x", "patch_y").distinct(), 100)


@query(f"WITH {PARTS} SELECT DISTINCT year || '/' || tile || '/' || name || '.nc' AS path, year, tile, patch_x, patch_y FROM p")
def s1_list_patches(spark, sf):
    """An empty file for every patch, beside others, and the listing of all folders."""
    place = place_for(spark, "patch-files")
    named = patches(spark, sf).select(F.concat_ws("/", "year", "tile", "path").alias("path")).distinct()
    so.write_empty_files(named.unionAll(spark.createDataFrame([("1995/notes.txt",), ("index.json",)], "path string")), place)
    return so.list_patches(spark, place)


@query(f"WITH {PARTS} SELECT year || '/' || tile || '/' || name || '.nc' AS path, {BY_YEAR} AS target FROM p")
def s4_annotation_splits(spark, sf):
    """Annotation documents written for each target, in one pass, and read as a split."""
    place = place_for(spark, "annotations")
    named = patches(spark, sf).select(F.col("o_orderkey").alias("id"), F.concat(F.lit("netcdf/"), "path").alias("file"), F.expr(BY_YEAR).alias("target"))
    so.write_annotation_splits(named, place)
    return so.read_annotation_splits(spark, place, lines=True)


# --- labels, counts, weights -------------------------------------------------------------

LABELS = [{"name": "rest", "id": [99]}, {"name": "small", "id": [1, 2, 3, 4, 5]}, {"name": "odd", "id": [11, 13, 15]}, {"name": "forty", "id": 40}, {"name": "again", "id": [5, 6]}]
ENC = "enc(raw_id, class_id, name) AS (VALUES (99, 0, 'rest'), (1, 1, 'small'), (2, 1, 'small'), (3, 1, 'small'), (4, 1, 'small'), (11, 2, 'odd'), (13, 2, 'odd'), (15, 2, 'odd'), (40, 3, 'forty'), (5, 4, 'again'), (6, 4, 'again'))"
RAW = "raw AS (SELECT p_partkey, p_brand AS path, CASE WHEN p_size % 10 = 0 AND p_size <> 40 THEN 0 ELSE p_size END AS label FROM part)"
COUNTS = f"{RAW}, counts AS (SELECT path, label, count(*) AS n FROM raw GROUP BY ALL)"
FREQ = f"{ENC}, {COUNTS}, cls AS (SELECT coalesce(class_id, 0) AS class_id, sum(n) AS n FROM counts LEFT JOIN enc ON label = raw_id GROUP BY 1), alln AS (SELECT c.class_id, CASE WHEN c.class_id = 0 THEN 0 ELSE coalesce(cls.n, 0) END::BIGINT AS n FROM (SELECT DISTINCT class_id FROM enc) c LEFT JOIN cls USING (class_id)), freq AS (SELECT *, n / sum(n) OVER () AS f FROM alln)"


def raw_labels(spark: SparkSession, sf: str) -> DataFrame:
    size = F.when((F.col("p_size") % 10 == 0) & (F.col("p_size") != 40), 0).otherwise(F.col("p_size"))
    return table(spark, sf, "part").select("p_partkey", F.col("p_brand").alias("path"), size.alias("label"))


def part_counts(spark: SparkSession, sf: str) -> DataFrame:
    return en.class_counts(raw_labels(spark, sf), ["path"])


def brand_split():
    return F.when(F.length("path") % 2 == 0, "train").when(F.col("path") < "Brand#15", "val").otherwise("test")


BRANDS = "bs AS (SELECT DISTINCT p_brand AS path, CASE WHEN length(p_brand) % 2 = 0 THEN 'train' WHEN p_brand < 'Brand#15' THEN 'val' ELSE 'test' END AS target FROM part)"


@query(f"WITH {ENC}, {RAW} SELECT p_partkey, coalesce(class_id, 0)::INT AS class_id FROM raw LEFT JOIN enc ON label = raw_id")
def s10_j1_remap(spark, sf):
    return en.remap(raw_labels(spark, sf), en.encoder_table(spark, LABELS), "label").select("p_partkey", "class_id")


@query(f"WITH {RAW} SELECT p_partkey, CASE WHEN label IN (7, 8) THEN 1 WHEN label = 9 THEN 2 ELSE 0 END::INT AS class_id FROM raw")
def p6_map_label(spark, sf):
    return raw_labels(spark, sf).select("p_partkey", C.map_label(F.col("label"), {7: 1, 8: 1, 9: 2}).alias("class_id"))


@query(f"WITH {ENC}, {RAW} SELECT p_partkey, coalesce(name, '') AS class_name FROM raw LEFT JOIN enc ON label = raw_id")
def j2_p19_class_names(spark, sf):
    return en.with_class_names(raw_labels(spark, sf), en.encoder_table(spark, LABELS), "label").select("p_partkey", "class_name")


@query(f"WITH {COUNTS} SELECT path, label, n FROM counts")
def a2_class_counts(spark, sf):
    return part_counts(spark, sf)


@query(f"WITH {COUNTS}, {BRANDS}, s AS (SELECT target, label, sum(n) AS n FROM counts JOIN bs USING (path) GROUP BY ALL) SELECT t.target, l.label, coalesce(s.n, 0)::BIGINT AS n FROM (SELECT DISTINCT target FROM bs) t CROSS JOIN (SELECT DISTINCT label FROM counts) l LEFT JOIN s ON s.target = t.target AND s.label = l.label")
def a3_s13_counts_per_target(spark, sf):
    """Counts written and read back."""
    counts = part_counts(spark, sf)
    targets = table(spark, sf, "part").select(F.col("p_brand").alias("path")).distinct().withColumn("target", brand_split())
    place = place_for(spark, "counts")
    so.write_counts(en.patches_per_target(targets), en.counts_per_target(counts, targets), place)
    return spark.read.parquet(f"{place}/pixel_counts").select("target", "label", "n")


@query(f"WITH {COUNTS} SELECT path, coalesce(sum(n) FILTER (label = 0), 0)::BIGINT AS pixel_count_0, coalesce(sum(n) FILTER (label = 7), 0)::BIGINT AS pixel_count_7, coalesce(sum(n) FILTER (label = 40), 0)::BIGINT AS pixel_count_40, max(n) FILTER (label <> 0) AS pixel_count_max FROM counts GROUP BY 1")
def a4_wide_counts(spark, sf):
    return en.wide_counts(part_counts(spark, sf), ["path"], [0, 7, 40])


@query(f"WITH {RAW} SELECT DISTINCT label FROM raw")
def a26_u3_distinct_classes(spark, sf):
    return raw_labels(spark, sf).select("label").distinct()


@query(f"WITH {FREQ} SELECT class_id::INT AS class_id, n, round(f, 6) AS frequency FROM freq")
def a7_class_frequencies(spark, sf):
    f = en.class_frequencies(part_counts(spark, sf), en.encoder_table(spark, LABELS))
    return f.select("class_id", "n", r6("frequency"))


@query(f"WITH {FREQ} SELECT class_id::INT AS class_id, round(0.1 * CASE WHEN f > 0 THEN 1 / (count(*) OVER () * f) ELSE 0 END + 0.9, 6) AS weight FROM freq")
def p12_p13_class_weights(spark, sf):
    f = en.class_frequencies(part_counts(spark, sf), en.encoder_table(spark, LABELS))
    return en.class_weights(f, 0.1).select("class_id", r6("weight"))


@query(f"WITH {FREQ}, g AS (SELECT class_id, greatest(f, min(f) FILTER (f > 0) OVER ()) AS f FROM freq) SELECT class_id::INT AS class_id, round(-ln((1 - f) / f), 6) AS logit FROM g")
def p14_prior_logits(spark, sf):
    f = en.class_frequencies(part_counts(spark, sf), en.encoder_table(spark, LABELS))
    return en.prior_logits(f).select("class_id", r6("logit"))


# --- predictions and metrics -------------------------------------------------------------

PRED = """pred AS (SELECT vec_id, vec_id // 36 AS path, label, list_position(embedding[1:10], list_max(embedding[1:10])) - 1 AS predicted,
 list_transform(embedding[1:10], lambda x: x::DOUBLE - ln(s)) AS logp, list_transform(embedding[11:20], lambda x: x::DOUBLE - ln(s2)) AS logp2
 FROM (SELECT *, list_sum(list_transform(embedding[1:10], lambda x: exp(x::DOUBLE))) AS s, list_sum(list_transform(embedding[11:20], lambda x: exp(x::DOUBLE))) AS s2 FROM embeddings))"""
WEIGHTS = "w(class_id, weight) AS (SELECT i, 1 + i / 10.0 FROM range(10) t(i))"


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings")
    first, second = (C.log_softmax(F.slice("embedding", a, 10)) for a in (1, 11))
    rows = e.select("vec_id", F.expr("vec_id div 36").alias("path"), "label", first.alias("logp"), second.alias("logp2"))
    return rows.withColumn("predicted", C.argmax_class(F.col("logp")))


def weights(spark: SparkSession) -> DataFrame:
    return spark.range(10).select(F.col("id").cast("int").alias("class_id"), (1 + F.col("id") / 10.0).alias("weight"))


def _scores_sql(by: str, where: str, macro_where: str = "TRUE") -> str:
    """Accuracy, weighted and macro F1 of ``pred``."""
    key, group = (f"{by}, ", f"GROUP BY {by}") if by else ("", "")
    return f"""WITH {PRED}, q AS (SELECT {by or "1"} AS g, label, predicted FROM pred WHERE {where}),
sides AS (SELECT g, label AS c, (label = predicted)::INT AS tp, 0 AS fp, (label <> predicted)::INT AS fn FROM q UNION ALL SELECT g, predicted, 0, (label <> predicted)::INT, 0 FROM q),
each AS (SELECT g, c, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn, CASE WHEN 2 * sum(tp) + sum(fp) + sum(fn) > 0 THEN 2 * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn)) ELSE 0 END AS f1 FROM sides GROUP BY ALL)
SELECT {"g AS " + by + ", " if by else ""}sum(tp + fn)::BIGINT AS pixels, round(sum(tp) / sum(tp + fn), 6) AS accuracy, round(sum(f1 * (tp + fn)) / sum(tp + fn), 6) AS f1_weighted, round(avg(f1) FILTER ({macro_where}), 6) AS f1_macro FROM each {"GROUP BY g" if by else ""}"""


def _rounded(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(*keys, "pixels", r6("accuracy"), r6("f1_weighted"), r6("f1_macro"))


@query(f"WITH {PRED} SELECT vec_id, predicted::INT AS predicted FROM pred")
def p9_argmax(spark, sf):
    return predictions(spark, sf).select("vec_id", "predicted")


@query(f"WITH {PRED} SELECT vec_id, CASE WHEN label = 0 THEN 255 ELSE (label <> predicted)::INT END::INT AS error FROM pred")
def p10_error_map(spark, sf):
    return predictions(spark, sf).select("vec_id", C.error_code(F.col("label"), F.col("predicted")).alias("error"))


@query(f"WITH {PRED} SELECT l.i::INT AS label, p.i::INT AS predicted, count(vec_id) AS n FROM range(1, 10) l(i) CROSS JOIN range(1, 10) p(i) LEFT JOIN pred ON label = l.i AND predicted = p.i GROUP BY ALL")
def a8_confusion(spark, sf):
    return me.dense(me.confusion(predictions(spark, sf), ignore=0), 10, first=1)


@query(_scores_sql("", "TRUE"))
def a9_a10_a11_scores(spark, sf):
    return _rounded(me.scores(me.confusion(predictions(spark, sf))))


@query(_scores_sql("", "label <> 0"))
def f7_parcel_scores(spark, sf):
    return _rounded(me.scores(me.confusion(predictions(spark, sf), ignore=0)))


@query(_scores_sql("", "label <> 0", "c <> 0"))
def a11_macro_without_ignored(spark, sf):
    return _rounded(me.scores(me.confusion(predictions(spark, sf), ignore=0), include_ignored=False))


@query(f"WITH {PRED}, q AS (SELECT * FROM pred WHERE label <> 0), sides AS (SELECT label AS c, (label = predicted)::INT AS tp, 0 AS fp, (label <> predicted)::INT AS fn FROM q UNION ALL SELECT predicted, 0, (label <> predicted)::INT, 0 FROM q), e AS (SELECT c, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn FROM sides GROUP BY 1) SELECT c::INT AS class, (tp + fn)::BIGINT AS pixel_count, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1 FROM e WHERE c >= 1")
def a12_class_scores(spark, sf):
    s = me.class_scores(me.confusion(predictions(spark, sf), ignore=0), floor=1)
    return s.select("class", "pixel_count", r6("precision"), r6("recall"), r6("f1"))


@query(_scores_sql("path", "label <> 0"))
def a13_f11_patch_scores(spark, sf):
    return _rounded(me.scores(me.confusion(predictions(spark, sf), ["path"], ignore=0), ["path"]), "path")


@query(_scores_sql("path", "label <> 0"))
def s11_score_files(spark, sf):
    """Per-patch scores written as CSV and read back."""
    place = place_for(spark, "scores")
    so.write_scores(_rounded(me.scores(me.confusion(predictions(spark, sf), ["path"], ignore=0), ["path"]), "path"), place)
    return spark.read.option("header", "true").schema("path long, pixels long, accuracy double, f1_weighted double, f1_macro double").csv(place)


@query(_scores_sql("path", "label <> 0 AND (vec_id % 36) // 6 BETWEEN 1 AND 4 AND (vec_id % 36) % 6 BETWEEN 1 AND 4"))
def a14_cropped_scores(spark, sf):
    inner = C.interior(F.expr("vec_id % 36 div 6"), F.expr("vec_id % 36 % 6"), 6, 6, 1)
    return _rounded(me.scores(me.confusion(predictions(spark, sf), ["path"], ignore=0, where=inner), ["path"]), "path")


@query(f"WITH {PRED}, {WEIGHTS} SELECT round(avg(-weight * logp[label + 1]), 6) AS loss FROM pred JOIN w ON class_id = label WHERE label <> 0")
def a15_masked_nll(spark, sf):
    return me.masked_nll(predictions(spark, sf), weights(spark)).select(r6("loss"))


@query("SELECT event_type, round(sum(value * (event_id % 5 + 1)) / sum(event_id % 5 + 1), 6) AS mean FROM events GROUP BY 1")
def a16_weighted_mean(spark, sf):
    rows = table(spark, sf, "events").withColumn("w", F.col("event_id") % 5 + 1)
    return me.weighted_mean(rows, "value", "w", ["event_type"]).select("event_type", r6("mean"))


def _loss_sql(value: str, name: str = "score") -> str:
    return f"WITH {PRED}, {WEIGHTS} SELECT path, round(sum({value}) / nullif(count(*) FILTER (label <> 0), 0), 6) AS {name} FROM pred JOIN w ON class_id = label GROUP BY 1"


@query(_loss_sql("-weight * logp[label + 1]"))
def a17_loss_score(spark, sf):
    return sc.loss_score(predictions(spark, sf), ["path"], weights(spark)).select("path", r6("score"))


@query(_loss_sql("-weight * logp2[label + 1]"))
def a18_irreducible_score(spark, sf):
    return sc.loss_score(predictions(spark, sf), ["path"], weights(spark), logp="logp2").select("path", r6("score"))


@query(_loss_sql("-weight * (logp[label + 1] - logp2[label + 1])"))
def a19_reducible_score(spark, sf):
    p = predictions(spark, sf)
    model, fixed = (sc.loss_score(p, ["path"], weights(spark), logp=c) for c in ("logp", "logp2"))
    return sc.reducible_score(model, fixed, ["path"]).select("path", r6("score"))


@query(_loss_sql("list_max(list_filter(logp, lambda v, i: i <> label + 1)) - logp[label + 1]"))
def a20_margin_score(spark, sf):
    return sc.margin_score(predictions(spark, sf), ["path"]).select("path", r6("score"))


@query("SELECT o_orderkey, round(('0x' || substr(md5('5|' || o_orderkey), 1, 8))::BIGINT / 4294967296.0, 6) AS score FROM orders")
def a21_random_score(spark, sf):
    return sc.random_score(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey", 5).select("o_orderkey", r6("score"))


@query(f"WITH {PRED}, {WEIGHTS} SELECT path, round(0.5 * sum(-weight * logp[label + 1]) / nullif(count(*) FILTER (label <> 0), 0) + 2 * sum(list_max(list_filter(logp, lambda v, i: i <> label + 1)) - logp[label + 1]) / nullif(count(*) FILTER (label <> 0), 0), 6) AS score FROM pred JOIN w ON class_id = label GROUP BY 1")
def a22_combined_score(spark, sf):
    p = predictions(spark, sf)
    tables = {"loss": sc.loss_score(p, ["path"], weights(spark)), "margin": sc.margin_score(p, ["path"])}
    return sc.combine_scores(tables, ["0.5*loss", "none", "2*margin"], ["path"]).select("path", r6("score"))


@query(_scores_sql("path", "label <> 0").replace("SELECT g AS path, sum(tp + fn)::BIGINT AS pixels, round(sum(tp) / sum(tp + fn), 6) AS accuracy, round(sum(f1 * (tp + fn)) / sum(tp + fn), 6) AS f1_weighted, round(avg(f1) FILTER (TRUE), 6) AS f1_macro", "SELECT g AS path, round(sum(f1 * (tp + fn)) / sum(tp + fn), 6) AS score"))
def a23_metric_score(spark, sf):
    return sc.metric_score(predictions(spark, sf), ["path"]).select("path", r6("score"))


@query(f"WITH {PRED}, s AS (SELECT path, max((label = predicted)::INT) AS k, count(*) FILTER (label <> 0) AS p FROM pred GROUP BY 1) SELECT count(*) AS considered, sum(k)::BIGINT AS seen, sum(CASE WHEN k = 1 THEN p ELSE 0 END)::BIGINT AS pixels FROM s")
def a24_seen(spark, sf):
    rows = predictions(spark, sf).select(F.col("path").alias("sample"), (F.col("label") == F.col("predicted")).alias("kept"), "label")
    return me.seen(rows, "kept")


@query(
    """WITH m AS (SELECT day(ts)::INT AS epoch, event_type AS metric, avg(value) AS value FROM events GROUP BY ALL), b AS (SELECT epoch AS best_epoch FROM m WHERE metric = 'click' ORDER BY value DESC, epoch LIMIT 1)
SELECT metric, round(max(value), 6) AS best, round(max_by(value, epoch), 6) AS last, round(max(value) FILTER (epoch = best_epoch), 6) AS at_best FROM m, b GROUP BY 1"""
)
def a25_run_summary(spark, sf):
    m = table(spark, sf, "events").groupBy(F.dayofmonth("ts").alias("epoch"), F.col("event_type").alias("metric")).agg(F.avg("value").alias("value"))
    return me.run_summary(m, "click").select("metric", r6("best"), r6("last"), r6("at_best"))


@query(f"WITH {PRED}, s AS (SELECT vec_id, vec_id // 100 AS block_id, logp[label + 1] AS score FROM pred) SELECT vec_id, block_id FROM (SELECT *, row_number() OVER (PARTITION BY block_id ORDER BY score DESC, vec_id) AS k FROM s) WHERE k <= 10")
def w8_top_k_per_block(spark, sf):
    rows = predictions(spark, sf).select("vec_id", F.expr("vec_id div 100").alias("block_id"), F.element_at("logp", F.col("label") + 1).alias("score"))
    return sl.top_k_per_block(rows, "block_id", "score", "vec_id", 10).select("vec_id", "block_id")


@query(
    f"""WITH {PRED}, {WEIGHTS}, s AS (SELECT vec_id, 0.5 * CASE WHEN label <> 0 THEN -weight * logp[label + 1] END + 2 * CASE WHEN label <> 0 THEN list_max(list_filter(logp, lambda v, i: i <> label + 1)) - logp[label + 1] END AS score FROM pred JOIN w ON class_id = label),
b AS (SELECT *, (row_number() OVER (ORDER BY vec_id) - 1) // 64 AS block_id FROM s)
SELECT vec_id, block_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY block_id ORDER BY score DESC NULLS LAST, vec_id) AS k FROM b) WHERE k <= 16"""
)
def w8_block_selection(spark, sf):
    """Blocks of 64 samples in their order, and of each the 16 best by a weighted sum of loss and margin."""
    p = predictions(spark, sf)
    tables = {"loss": sc.loss_score(p, ["vec_id"], weights(spark)), "margin": sc.margin_score(p, ["vec_id"])}
    return sc.select_blocks(p.select("vec_id"), tables, ["0.5*loss", "none", "2*margin"], "vec_id", "vec_id", 64, 16).select("vec_id", "block_id", r6("score"))


@query(f"WITH {PRED} SELECT a.vec_id, a.predicted::INT AS predicted, e.label FROM pred a JOIN embeddings e USING (vec_id)")
def j5_prediction_join_label(spark, sf):
    p = predictions(spark, sf).select("vec_id", "predicted")
    return p.join(table(spark, sf, "embeddings").select("vec_id", "label"), "vec_id").select("vec_id", "predicted", "label")


# --- spatial -----------------------------------------------------------------------------

GRID_POINTS = "pt AS (SELECT p_partkey, (p_partkey % 50)::DOUBLE AS lon, (p_partkey // 50)::DOUBLE AS lat, p_retailprice AS elev FROM part)"
ZONES = "zn AS (SELECT s_suppkey, s_suppkey % 43 + 0.25 AS x0, s_suppkey % 31 - 0.25 AS y0 FROM supplier)"


def grid_points(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select("p_partkey", (F.col("p_partkey") % 50).cast("double").alias("lon"), F.expr("p_partkey div 50").cast("double").alias("lat"), F.col("p_retailprice").alias("elev"))


def zones(spark: SparkSession, sf: str) -> DataFrame:
    x, y = F.col("s_suppkey") % 43 + 0.25, F.col("s_suppkey") % 31 - 0.25
    corner = lambda dx, dy: F.struct((x + dx).alias("x"), (y + dy).alias("y"))
    return table(spark, sf, "supplier").select("s_suppkey", F.array(corner(0, 0), corner(7, 1), corner(3, 6), corner(0, 0)).alias("ring"))


def _cross(ax: str, ay: str, bx: str, by: str) -> str:
    return f"(({ay} <= lat) <> ({by} <= lat) AND lon < {ax} + (lat - ({ay})) / ({by} - ({ay})) * ({bx} - ({ax})))::INT"


INSIDE = f"({_cross('x0', 'y0', 'x0 + 7', 'y0 + 1')} + {_cross('x0 + 7', 'y0 + 1', 'x0 + 3', 'y0 + 6')} + {_cross('x0 + 3', 'y0 + 6', 'x0', 'y0')}) % 2 = 1"


@query(f"WITH {GRID_POINTS}, {ZONES} SELECT p_partkey, s_suppkey FROM pt JOIN zn ON lon BETWEEN x0 AND x0 + 7 AND lat BETWEEN y0 AND y0 + 6 WHERE {INSIDE}")
def j7_zonal_join(spark, sf):
    return sp.zonal_join(grid_points(spark, sf), zones(spark, sf)).select("p_partkey", "s_suppkey")


@query(f"WITH {GRID_POINTS}, {ZONES} SELECT s_suppkey, round(avg(elev), 6) AS elevation_mean, round(stddev_pop(elev), 6) AS elevation_std, round(median(elev), 6) AS elevation_median FROM pt JOIN zn ON lon BETWEEN x0 AND x0 + 7 AND lat BETWEEN y0 AND y0 + 6 WHERE {INSIDE} GROUP BY 1")
def a6_zonal_stats(spark, sf):
    return sp.zonal_stats(grid_points(spark, sf), zones(spark, sf), "s_suppkey").select("s_suppkey", r6("elevation_mean"), r6("elevation_std"), r6("elevation_median"))


@query("WITH b AS (SELECT c_custkey, c_custkey % 97 AS xmin, c_custkey % 97 + 2 AS xmax, c_custkey % 89 AS ymin, c_custkey % 89 + 1 AS ymax FROM customer), o AS (SELECT s_suppkey * 7 % 97 AS xmin, s_suppkey * 7 % 97 + 1 AS xmax, s_suppkey * 3 % 89 AS ymin, s_suppkey * 3 % 89 + 2 AS ymax FROM supplier) SELECT c_custkey FROM b WHERE EXISTS (SELECT 1 FROM o WHERE b.xmin <= o.xmax AND b.xmax >= o.xmin AND b.ymin <= o.ymax AND b.ymax >= o.ymin)")
def j6_boxes_touching(spark, sf):
    box = lambda df, x, y, w, h: df.withColumns({"xmin": x, "xmax": x + w, "ymin": y, "ymax": y + h})
    c = table(spark, sf, "customer").select("c_custkey")
    s = table(spark, sf, "supplier")
    mine = box(c, F.col("c_custkey") % 97, F.col("c_custkey") % 89, 2, 1)
    return sp.boxes_touching(mine, box(s, F.col("s_suppkey") * 7 % 97, F.col("s_suppkey") * 3 % 89, 1, 2)).select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE c_custkey % 97 <= 40 AND c_custkey % 97 + 2 >= 30 AND c_custkey % 89 <= 60 AND c_custkey % 89 + 1 >= 20")
def f9_bounding_box(spark, sf):
    x, y = F.col("c_custkey") % 97, F.col("c_custkey") % 89
    return table(spark, sf, "customer").where(C.boxes_meet(x, x + 2, y, y + 1, 30, 40, 20, 60)).select("c_custkey")


@query("SELECT c_custkey, round(300000 + c_custkey * 10.0, 6) AS x0, round(4600000 - c_custkey * 5.0, 6) AS y0, round(300000 + c_custkey * 10.0 + 10 * 366, 6) AS x1, round(4600000 - c_custkey * 5.0 - 10 * 300, 6) AS y1 FROM customer")
def p7_footprint(spark, sf):
    c = table(spark, sf, "customer")
    number = lambda v: F.lit(float(v))
    transform = F.array(number(10), number(0), 300000 + F.col("c_custkey") * 10.0, number(0), number(-10), 4600000 - F.col("c_custkey") * 5.0)
    ring = c.select("c_custkey", sp.footprint(transform, F.lit(300), F.lit(366)).alias("r"))
    return ring.select("c_custkey", F.round(F.col("r")[0]["x"], 6).alias("x0"), F.round(F.col("r")[0]["y"], 6).alias("y0"), F.round(F.col("r")[2]["x"], 6).alias("x1"), F.round(F.col("r")[2]["y"], 6).alias("y1"))


def _utm_sql() -> str:
    n = sp.FLATTENING / (2 - sp.FLATTENING)
    radius = sp.SEMI_MAJOR / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    beta = [n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96 - n**4 / 360, n**2 / 48 + n**3 / 15 - 437 * n**4 / 1440, 17 * n**3 / 480 - 37 * n**4 / 840, 4397 * n**4 / 161280]
    delta = [2 * n - 2 * n**2 / 3 - 2 * n**3 + 116 * n**4 / 45, 7 * n**2 / 3 - 8 * n**3 / 5 - 227 * n**4 / 45, 56 * n**3 / 15 - 136 * n**4 / 35, 4279 * n**4 / 630]
    e = lambda v: f"{v!r}::DOUBLE"
    xi1 = "xi" + "".join(f" - {e(b)} * sin({2 * k} * xi) * cosh({2 * k} * eta)" for k, b in enumerate(beta, 1))
    eta1 = "eta" + "".join(f" - {e(b)} * cos({2 * k} * xi) * sinh({2 * k} * eta)" for k, b in enumerate(beta, 1))
    lat = "chi" + "".join(f" + {e(d)} * sin({2 * k} * chi)" for k, d in enumerate(delta, 1))
    return f"""WITH a AS (SELECT c_custkey, (4000000 + c_custkey * 7.0)::DOUBLE / {e(sp.SCALE * radius)} AS xi, (300000 + c_custkey * 11.0 - 500000)::DOUBLE / {e(sp.SCALE * radius)} AS eta FROM customer),
b AS (SELECT *, {xi1} AS xi1, {eta1} AS eta1 FROM a), c AS (SELECT *, asin(sin(xi1) / cosh(eta1)) AS chi FROM b)
SELECT c_custkey, round(degrees(atan2(sinh(eta1), cos(xi1))) + 3, 6) AS lon, round(degrees({lat}), 6) AS lat FROM c"""


@query(_utm_sql())
def p8_reproject(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", (300000 + F.col("c_custkey") * 11.0).cast("double").alias("x"), (4000000 + F.col("c_custkey") * 7.0).cast("double").alias("y"))
    at = sp.utm_to_lonlat(F.col("x"), F.col("y"), sp.utm_zone(F.lit("+init=epsg:32631")))
    return c.select("c_custkey", at.alias("p")).select("c_custkey", F.round("p.lon", 6).alias("lon"), F.round("p.lat", 6).alias("lat"))


@query("WITH z AS (SELECT s_suppkey, s_suppkey % 43 + 0.25 AS x, s_suppkey % 31 - 0.25 AS y FROM supplier), c(place, dx, dy) AS (VALUES (0, 0, 0), (1, 7, 1), (2, 3, 6), (3, 0, 0)) SELECT s_suppkey, place::INT AS place, (x + dx)::DOUBLE AS lon, (y + dy)::DOUBLE AS lat FROM z, c")
def s12_polygons(spark, sf):
    """Features written as lines of GeoJSON and read back, point by point."""
    place = place_for(spark, "polygons")
    so.write_polygons(zones(spark, sf), place)
    feature = "type string, properties struct<s_suppkey: bigint>, geometry struct<type: string, coordinates: array<array<array<double>>>>"
    rings = spark.read.schema(feature).json(place).where("type = 'Feature' AND geometry.type = 'Polygon'")
    points = rings.select("properties.s_suppkey", F.posexplode(F.col("geometry.coordinates")[0]).alias("place", "p"))
    return points.select("s_suppkey", "place", F.col("p")[0].alias("lon"), F.col("p")[1].alias("lat"))


# --- jobs --------------------------------------------------------------------------------


@query(f"WITH {FILLED}, wide AS (SELECT user_id, bin, max(filled) FILTER (event_type = 'click') AS click, max(filled) FILTER (event_type = 'view') AS view FROM filled GROUP BY ALL) SELECT user_id AS path, bin, (user_id % 8 // 4)::INT AS tile_y, (user_id // 8 % 8 // 4)::INT AS tile_x, round(click, 6) AS click, round(view, 6) AS view FROM wide WHERE click IS NOT NULL OR view IS NOT NULL")
def l4_composite_job(spark, sf):
    obs = table(spark, sf, "events").select(F.col("user_id").alias("path"), F.col("event_type").alias("band"), F.col("ts").alias("time"), (F.col("user_id") % 8).alias("y"), F.expr("user_id div 8 % 8").alias("x"), "value")
    out = jobs.composite_job(obs, edges(spark), ["click", "view"], 8, 4)
    return out.where("click IS NOT NULL OR view IS NOT NULL").select("path", "bin", "tile_y", "tile_x", r6("click"), r6("view"))


CUBE = """ratio(band, r) AS (VALUES ('click', 1), ('view', 2), ('purchase', 6)),
obs AS (SELECT user_id % 23 AS path, event_type AS band, ts, value, event_id % (12 // r) AS y, event_id // (12 // r) % (12 // r) AS x FROM events JOIN ratio ON band = event_type)"""
CUBE_FILLED = FILLED.replace("events", "obs").replace("k.user_id, k.event_type", "k.path, k.band, k.y, k.x").replace("med.user_id = k.user_id AND med.event_type = k.event_type", "med.path = k.path AND med.band = k.band AND med.y = k.y AND med.x = k.x").replace("user_id, event_type", "path, band, y, x").replace("epoch(lo) AS x,", "epoch(lo) AS sec,").replace("(x - ", "(sec - ")


@query(
    f"""WITH {CUBE}, {CUBE_FILLED},
fine AS (SELECT path, band, bin, y * r + dy AS y, x * r + dx AS x, filled::FLOAT AS v FROM filled JOIN ratio USING (band), range(6) a(dy), range(6) b(dx) WHERE dy < r AND dx < r),
tl AS (SELECT path, y // 6 AS tile_y, x // 6 AS tile_x, bin, band, count(v) AS n, round(sum(v::DOUBLE * (y % 6 * 6 + x % 6 + 1)), 2) AS total FROM fine GROUP BY ALL),
lb AS (SELECT path, y // 6 AS tile_y, x // 6 AS tile_x, sum(label * (y % 6 * 6 + x % 6 + 1)) AS label_total FROM (SELECT p_partkey % 23 AS path, p_partkey // 23 % 12 AS y, p_partkey // 276 % 12 AS x, max(p_size) AS label FROM part GROUP BY ALL) GROUP BY ALL),
meta AS (SELECT count(*) AS num_patches, max(c)::INT AS num_subpatches_per_patch FROM (SELECT path, count(DISTINCT tile_y * 2 + tile_x) AS c FROM tl GROUP BY 1))
SELECT path, tile_y::INT AS tile_y, tile_x::INT AS tile_x, bin, band, n, total, label_total::BIGINT AS label_total, num_patches, num_subpatches_per_patch FROM tl LEFT JOIN lb USING (path, tile_y, tile_x), meta"""
)
def l4_composite_product(spark, sf):
    """The whole product: bands of three resolutions, labels, tiles and metadata, written, read back and put beside each other."""
    e, ratio = table(spark, sf, "events"), {"click": 1, "view": 2, "purchase": 6}
    grid = F.try_element_at(F.create_map(*[F.lit(v) for b, r in ratio.items() for v in (b, 12 // r)]), F.col("event_type"))
    obs = e.select((F.col("user_id") % 23).alias("path"), F.col("event_type").alias("band"), F.col("ts").alias("time"), "value", "event_id", grid.alias("g"))
    obs = obs.select("path", "band", "time", "value", (F.col("event_id") % F.col("g")).alias("y"), F.expr("event_id div g % g").alias("x"))
    p = table(spark, sf, "part")
    labels = p.groupBy((F.col("p_partkey") % 23).alias("path"), F.expr("p_partkey div 23 % 12").alias("y"), F.expr("p_partkey div 276 % 12").alias("x")).agg(F.max("p_size").alias("label"))
    made = jobs.composite_product(obs, edges(spark), list(ratio), 12, 6, place_for(spark, "product"), ratio, labels)
    weighed = lambda c: F.aggregate(F.transform(c, lambda v, i: v.cast("double") * (i + 1)), F.lit(0.0), lambda t, v: t + F.coalesce(v, F.lit(0.0)))
    n = F.size(F.filter("values", lambda v: v.isNotNull())).cast("long")
    tiles = made["tiles"].select("path", "tile_y", "tile_x", "bin", "band", n.alias("n"), F.when(n > 0, F.round(weighed("values"), 2)).alias("total"))
    held = made["tile_labels"].select("path", "tile_y", "tile_x", weighed("labels").cast("long").alias("label_total"))
    meta = made["meta"].select("num_patches", F.col("num_subpatches_per_patch").cast("int").alias("num_subpatches_per_patch"))
    return tiles.join(held, ["path", "tile_y", "tile_x"], "left").join(F.broadcast(meta), F.lit(True))


ZONE_STATS = f"{GRID_POINTS}, {ZONES}, ht AS (SELECT s_suppkey, avg(elev) AS elevation_mean, median(elev) AS elevation_median FROM pt JOIN zn ON lon BETWEEN x0 AND x0 + 7 AND lat BETWEEN y0 AND y0 + 6 WHERE {INSIDE} GROUP BY 1)"
ZONE_LABELS = "zl AS (SELECT 1 + p_partkey % (SELECT count(*) FROM supplier) AS s_suppkey, p_size % 4 AS label, count(*) AS n FROM part GROUP BY ALL)"
HEIGHTS = [{"patch_x": {"max": 2}, "target": "test"}, {"year": [0, 1, 2], "stratify_on": [{"column": "elevation_mean", "bins": 12}], "target": [{"target": "train", "split": 0.6}, {"target": "val", "split": 0.4}]}]
BY_HEIGHT = f"""{ZONE_STATS}, {ZONE_LABELS}, all_ AS (SELECT s_suppkey, elevation_mean, elevation_median, s_suppkey % 9 AS patch_x, s_suppkey % 4 AS year FROM supplier LEFT JOIN ht USING (s_suppkey)),
drawn AS (SELECT s_suppkey, CASE WHEN elevation_mean IS NULL THEN -1 ELSE {{0}} END::INT AS b FROM all_ WHERE patch_x > 2 AND year <= 2),
hist_ AS (SELECT 0 AS g, list({{{{'bin': b, 'n': n}}}}) AS hist FROM (SELECT b, count(*) AS n FROM drawn GROUP BY 1)), {{1}},
strata AS (SELECT s_suppkey, m.new::VARCHAR AS stratum FROM drawn JOIN merged_map m ON b = m.bin),
quota AS (SELECT stratum, base + (row_number() OVER (ORDER BY round(share - base, 9) DESC, md5('42|0|' || stratum)) <= want - sum(base) OVER ())::INT AS quota FROM (SELECT stratum, want, n * want / total::DOUBLE AS share, floor(n * want / total::DOUBLE) AS base FROM (SELECT stratum, count(*) AS n FROM strata GROUP BY 1), (SELECT count(*) AS total, round_even(0.6::DOUBLE * count(*), 0) AS want FROM strata))),
split_ AS (SELECT s_suppkey, 'test' AS target FROM all_ WHERE patch_x <= 2
  UNION ALL SELECT s_suppkey, CASE WHEN row_number() OVER (PARTITION BY stratum ORDER BY md5('42|strata|' || s_suppkey), s_suppkey::VARCHAR) <= quota THEN 'train' ELSE 'val' END FROM strata JOIN quota USING (stratum))""".format(_bin_sql("elevation_mean", 12), _lone_bins_sql("merged", "hist_"))


def height_split(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    """Patches of ``supplier`` split by rules, in strata of their elevation, with their counts of labelled pixels."""
    n = F.broadcast(table(spark, sf, "supplier").agg(F.count("*").alias("n")))
    labels = table(spark, sf, "part").join(n, F.lit(True)).select((1 + F.col("p_partkey") % F.col("n")).alias("s_suppkey"), (F.col("p_size") % 4).alias("label"))
    features = zones(spark, sf).withColumns({"patch_x": (F.col("s_suppkey") % 9).cast("int"), "year": (F.col("s_suppkey") % 4).cast("int"), "tile": F.lit("t"), "patch_y": F.lit(0), "path": F.col("s_suppkey").cast("string")})
    steps = [jobs.with_elevation(grid_points(spark, sf), "s_suppkey"), jobs.with_pixel_counts(labels, [1, 2], "s_suppkey")]
    return jobs.split_job(features, HEIGHTS, key="s_suppkey", seed=42, processors=steps, labels=labels, shuffle=False)


@query(f"WITH RECURSIVE {BY_HEIGHT} SELECT s_suppkey, target, round(elevation_mean, 6) AS elevation_mean, round(elevation_median, 6) AS elevation_median, coalesce(sum(n) FILTER (label = 1), 0)::BIGINT AS pixel_count_1, coalesce(sum(n) FILTER (label = 2), 0)::BIGINT AS pixel_count_2, max(n) FILTER (label <> 0) AS pixel_count_max FROM split_ JOIN all_ USING (s_suppkey) LEFT JOIN zl USING (s_suppkey) GROUP BY ALL")
def l3_split_by_elevation(spark, sf):
    """The split job with features: footprints, elevation and pixel counts before the splits, strata of elevation."""
    out = height_split(spark, sf)["split"]
    return out.select("s_suppkey", "target", r6("elevation_mean"), r6("elevation_median"), "pixel_count_1", "pixel_count_2", "pixel_count_max")


@query(f"WITH RECURSIVE {BY_HEIGHT} SELECT target, l.label, coalesce(sum(n), 0)::BIGINT AS n FROM (SELECT DISTINCT target FROM split_) t CROSS JOIN (SELECT DISTINCT label FROM zl) l LEFT JOIN (SELECT target, label, n FROM split_ JOIN zl USING (s_suppkey)) c USING (target, label) GROUP BY ALL")
def l3_pixels_by_elevation_split(spark, sf):
    """Pixels of each class in each of those splits."""
    return height_split(spark, sf)["pixel_counts"]


@query(f"WITH RECURSIVE {BY_HEIGHT}, c AS (SELECT target, count(*) AS patches FROM split_ GROUP BY 1), x AS (SELECT target, coalesce(sum(n) FILTER (label > 0), 0)::BIGINT AS labelled FROM split_ LEFT JOIN zl USING (s_suppkey) GROUP BY 1) SELECT CASE target WHEN 'train' THEN 'val' WHEN 'val' THEN 'train' ELSE target END AS target, patches, labelled FROM c JOIN x USING (target)")
def p15_swap_tables(spark, sf):
    """Train and val swapped in all tables of a split job: patches and labelled pixels of each target."""
    swapped = jobs.swap_job(height_split(spark, sf))
    pixels_ = swapped["pixel_counts"].groupBy("target").agg(F.sum(F.when(F.col("label") > 0, F.col("n")).otherwise(0)).alias("labelled"))
    return swapped["patch_counts"].join(pixels_, "target").select("target", "patches", "labelled")


@query(f"WITH {ZONE_STATS}, a AS (SELECT s_suppkey, CASE WHEN s_suppkey % 5 = 0 THEN 'test' WHEN s_suppkey % 5 = 1 THEN 'val' ELSE 'train' END AS target FROM supplier WHERE s_suppkey % 7 > 0) SELECT s_suppkey, target, round(elevation_mean, 6) AS elevation_mean FROM a LEFT JOIN ht USING (s_suppkey)")
def l3_annotated_split(spark, sf):
    """The job's other branch: splits from annotation documents, joined with the patches and their elevation."""
    place = place_for(spark, "annotated")
    s = F.col("s_suppkey")
    target = F.when(s % 5 == 0, "test").when(s % 5 == 1, "val").otherwise("train")
    images = table(spark, sf, "supplier").where(s % 7 > 0).select(s.alias("id"), F.concat(F.lit("netcdf/2020_T_patch_"), s.cast("string"), F.lit("_0.nc")).alias("file"), target.alias("target"))
    so.write_annotation_splits(images, place)
    features = zones(spark, sf).withColumn("path", F.concat(F.lit("2020/T/2020_T_patch_"), s.cast("string"), F.lit("_0.nc")))
    out = jobs.split_job(features, annotated=so.read_annotation_splits(spark, place, lines=True), processors=[jobs.with_elevation(grid_points(spark, sf))], shuffle=False)
    return out["split"].select("s_suppkey", "target", r6("elevation_mean"))


@query("SELECT CASE vec_id % 4 WHEN 0 THEN 'val' WHEN 1 THEN 'test' ELSE 'train' END AS target, count(*) AS pixels FROM embeddings WHERE label <> 0 GROUP BY 1")
def l1_scored_pixels(spark, sf):
    """Pixels scored by a classifier whose features are missing in many rows: all that have a label."""
    gap = lambda i: F.when(F.col("vec_id") % (i + 2) == 0, F.lit(float("nan")) if i % 2 else F.lit(None)).otherwise(F.col("embedding")[i].cast("double"))
    rows = table(spark, sf, "embeddings").select("vec_id", "label", *[gap(i).alias(f"f{i}") for i in range(6)])
    target = F.when(F.col("vec_id") % 4 == 0, "val").when(F.col("vec_id") % 4 == 1, "test").otherwise("train")
    return jobs.classifier_job(written(rows.withColumn("target", target), "features"), [f"f{i}" for i in range(6)], classes=10, alpha=0.5, maxIter=2).select("target", "pixels")


@query()
def l1_pixel_classifier(spark, sf):
    """A pixel classifier on all 64 numbers, weighted by class frequency, trained, validated and tested; its coefficients aren't for SQL."""
    rows = table(spark, sf, "embeddings").select("vec_id", "label", *[F.col("embedding")[i].cast("double").alias(f"f{i}") for i in range(64)])
    target = F.when(F.col("vec_id") % 4 == 0, "val").when(F.col("vec_id") % 4 == 1, "test").otherwise("train")
    stored = written(rows.withColumn("target", target), "features")  # read three times
    out = jobs.classifier_job(stored, [f"f{i}" for i in range(64)], classes=10, alpha=0.5, maxIter=20)
    return out.select("target", "pixels", r6("accuracy"), r6("f1_weighted"), r6("f1_macro"))
