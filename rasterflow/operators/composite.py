"""Temporal composites: calendar bins, medians, gap filling, alignment on one grid."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.frames import fresh


def bin_edges(spark: SparkSession, start: str, end: str, freq: str = "month", every: int = 1) -> DataFrame:
    """``(bin, lo, hi)``: bins from ``start`` to ``end``, numbered from 1, open left and closed right.

    A remainder shorter than a step has no bin.
    """
    unit = {"week": 7, "quarter": 3}.get(freq, 1) * every
    step = f"INTERVAL {unit} {'MONTH' if freq in ('month', 'quarter') else 'DAY'}"
    edges = spark.sql(f"SELECT sequence(TIMESTAMP_NTZ '{start}', TIMESTAMP_NTZ '{end}', {step}) AS e")
    pairs = edges.select(F.expr("transform(slice(e, 1, size(e) - 1), (x, i) -> struct(i + 1 AS bin, x AS lo, e[i + 1] AS hi))").alias("p"))
    return pairs.select(F.explode("p").alias("p")).select("p.*")


def assign_bin(obs: DataFrame, edges: DataFrame, time: str = "time") -> DataFrame:
    """``obs`` with ``bin`` and ``lo``; observations in no bin, and those at the very first edge, are dropped.

    A hash join on the day, with the bins that touch it (a row for each day and bin), then
    the exact edges.
    """
    day, lo, hi = fresh(obs, "_day", "_lo", "_hi")
    days = edges.select("bin", F.col("lo").alias(lo), F.col("hi").alias(hi), F.explode(F.sequence(F.to_date("lo"), F.to_date("hi"), F.expr("INTERVAL 1 DAY"))).alias(day))
    inside = (F.to_date(F.col(time)) == F.col(day)) & (F.col(time) > F.col(lo)) & (F.col(time) <= F.col(hi))
    rest = obs.drop("bin", "lo")
    return rest.join(F.broadcast(days), inside).select(*[F.col(f"`{c}`") for c in rest.columns], "bin", F.col(lo).alias("lo"))


def month_bin(obs: DataFrame, time: str = "time", year: int | None = None) -> DataFrame:
    """``obs`` with ``lo``, the month whose left-open bin holds it, without a join; only ``year`` if given."""
    lo = F.date_trunc("month", F.col(time) - F.expr("INTERVAL 1 MICROSECOND")).cast("timestamp_ntz")
    out = obs.withColumn("lo", lo)
    return out if year is None else out.where(F.year("lo") == year)


def median_composite(obs: DataFrame, keys: list[str], value: str = "value", out: str = "median") -> DataFrame:
    """Exact median of each group; null and NaN are missing, an even count gives the middle two's mean.

    With many small groups ``spark.sql.objectHashAggregate.sortBased.fallbackThreshold`` is
    best set to some thousands in the session; it is not changed here.
    """
    v = F.col(value)
    present = v if obs.schema[value].dataType.typeName() not in ("double", "float") else F.when(~F.isnan(v), v)
    return obs.groupBy(*keys).agg(F.median(present).alias(out))


def complete_bins(composite: DataFrame, keys: list[str], edges: DataFrame) -> DataFrame:
    """A row for each key and every bin, null where there was none; ``composite`` is read once.

    A key's rows, one for each bin, are gathered and laid beside all bins.
    """
    rest = [c for c in composite.columns if c not in (*keys, "bin", "lo")]
    bins, own, row = fresh(composite, "_bins", "_own", "_row")
    every = edges.agg(F.collect_list(F.struct("bin", "lo")).alias(bins))  # one row
    entry = F.struct("bin", *[F.col(f"`{c}`") for c in rest])
    gathered = composite.groupBy(*keys).agg(F.collect_list(entry).alias(own)).join(F.broadcast(every), F.lit(True))
    found = lambda b: F.filter(own, lambda e: e["bin"] == b["bin"])
    line = lambda b, e: F.struct(b["bin"].alias("bin"), b["lo"].alias("lo"), e.alias("e"))
    lines = F.transform(bins, lambda b: _let(found(b), lambda es: F.when(F.size(es) > 0, F.transform(es, lambda e: line(b, e))).otherwise(F.array(line(b, F.get(es, F.lit(0)))))))
    return gathered.select(*keys, F.explode(F.flatten(lines)).alias(row)).select(*keys, f"{row}.bin", f"{row}.lo", *[F.col(f"{row}.e.`{c}`").alias(c) for c in rest])


def _seconds(x: Column) -> Column:
    return F.unix_micros(x.cast("timestamp")).cast("double") / 1e6


def fill_gaps(composite: DataFrame, keys: list[str], x: str, value: str, out: str = "filled") -> DataFrame:
    """Linear filling along ``x`` (a number or a time) within each key, extrapolated at both ends.

    Ends follow the line through their two nearest values. Keys with fewer than two values
    stay as they are. One window sort for each key: neighbours by running frames, the ends'
    lines from the first and last two values.
    """
    place = F.col(x).cast("double") if composite.schema[x].dataType.typeName() in ("integer", "long", "double", "float", "short") else _seconds(F.col(x))
    at, point, back, ahead, n, first, second, last, prior = fresh(composite, "_x", "_p", "_a", "_b", "_n", "_first", "_second", "_last", "_before")
    rows = composite.withColumn(at, place).withColumn(point, F.when(F.col(value).isNotNull(), F.struct(F.col(at).alias("x"), F.col(value).cast("double").alias("y"))))
    w = Window.partitionBy(*keys).orderBy(at)
    so_far, on = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumns({back: F.last(point, True).over(so_far), ahead: F.first(point, True).over(on), n: F.count(point).over(whole)})
    rows = rows.withColumns({first: F.nth_value(point, 1, True).over(whole), second: F.nth_value(point, 2, True).over(whole), last: F.last(point, True).over(whole)})
    # the one before the last: the last value among rows that precede the last one
    rows = rows.withColumn(prior, F.max(F.when(F.col(f"{point}.x") < F.col(f"{last}.x"), F.col(point))).over(whole))
    line = lambda p, q: F.col(f"{p}.y") + (F.col(f"{q}.y") - F.col(f"{p}.y")) * F.try_divide(F.col(at) - F.col(f"{p}.x"), F.col(f"{q}.x") - F.col(f"{p}.x"))
    filled = F.when(F.col(value).isNotNull() | (F.col(n) < 2), F.col(value).cast("double")).when(F.col(back).isNull(), line(first, second)).when(F.col(ahead).isNull(), line(prior, last)).otherwise(line(back, ahead))
    return rows.select(*[F.col(f"`{c}`") for c in composite.columns if c != out], filled.alias(out))


def filled_series(binned: DataFrame, keys: list[str], edges: DataFrame, value: str = "value", out: str = "series") -> DataFrame:
    """``(*keys, series)``: for each key an array of ``(bin, lo, median, filled)``, one for every bin, in order.

    Median, completion of the bins and filling in one shuffle by the keys: ``binned`` is
    aggregated to medians, these are gathered by key (a key has as many as there are
    bins), and arrays do the rest. What :func:`median_composite`, :func:`complete_bins` and
    :func:`fill_gaps` give, without their second aggregation, join and window.
    """
    # dealt by key once: the medians' groups and the keys' arrays are made where the rows then lie
    medians = median_composite(binned.select(*keys, "bin", value).repartition(*keys), [*keys, "bin"], value, "_median")
    found = medians.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("bin", "_median"))).alias("_medians"))
    bins = edges.agg(F.array_sort(F.collect_list(F.struct("bin", "lo"))).alias("_bins"))  # one row
    joined = found.join(F.broadcast(bins), F.lit(True))
    values = F.transform("_bins", lambda b: F.try_element_at(F.col("_medians"), b["bin"]))
    series = joined.withColumn("_values", values)
    filled = fill_series(F.col("_values"), F.transform("_bins", lambda b: _seconds(b["lo"])))
    rows = series.withColumn("_filled", filled)
    entries = F.transform("_bins", lambda b, i: F.struct(b["bin"].alias("bin"), b["lo"].alias("lo"), F.get("_values", i).alias("median"), F.get("_filled", i).alias("filled")))
    return rows.select(*keys, entries.alias(out))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often ``body`` names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def fill_series(values: Column, places: Column) -> Column:
    """:func:`fill_gaps` on arrays: one row for each key, no window; arrays are in order of place.

    The values that are there, and for each place the line that it lies on, are worked out
    once: each place looks at them one time.
    """

    def on_line(points: Column, at: Column, x: Column) -> Column:
        """The value at ``x`` of the line that begins at point number ``at``."""
        p, q = F.try_element_at(points, at), F.try_element_at(points, at + 1)
        return p["y"] + (q["y"] - p["y"]) * F.try_divide((x - p["x"]).cast("double"), (q["x"] - p["x"]).cast("double"))

    def fill(entries: Column, points: Column) -> Column:
        # the line between a place's neighbours; before the first and after the last value the nearest line goes on
        before = lambda e: F.size(F.filter(points, lambda p: p["x"] < e["x"]))
        begins = lambda e: F.greatest(F.least(before(e), F.size(points) - 1), F.lit(1))
        return F.transform(entries, lambda e: F.when(e["y"].isNotNull(), e["y"].cast("double")).otherwise(_let(begins(e), lambda at: on_line(points, at, e["x"]))))

    entries = F.arrays_zip(places.alias("x"), values.alias("y"))
    return _let(entries, lambda es: _let(F.filter(es, lambda e: e["y"].isNotNull()), lambda points: fill(es, points)))


def resample(pixels: DataFrame, ratio: Column | int, y: str = "y", x: str = "x") -> DataFrame:
    """Pixels of a coarser band repeated ``ratio`` times along both axes of the reference grid."""
    r = F.lit(ratio) if isinstance(ratio, int) else ratio
    steps = F.sequence(F.lit(0), r - 1)
    dy, dx = fresh(pixels, "_dy", "_dx")
    out = pixels.withColumn(dy, F.explode(steps)).withColumn(dx, F.explode(steps))
    return out.withColumns({y: F.col(y) * r + F.col(dy), x: F.col(x) * r + F.col(dx)}).drop(dy, dx)


def align_bands(composite: DataFrame, keys: list[str], bands: list[str], band: str = "band", value: str = "value") -> DataFrame:
    """One row for each key, a column for each band, null where a band lacks the key."""
    return composite.groupBy(*keys).pivot(band, bands).agg(F.first(value, True))


def preview(composite: DataFrame, by: list[str], bands: list[str]) -> DataFrame:
    """Bands as picture bytes, scaled by the largest value of all of them within ``by``."""
    from ..functions.columns import preview_byte

    (name,) = fresh(composite, "_top")
    tops = [F.max(b).over(Window.partitionBy(*by)) for b in bands]
    top = F.greatest(*tops) if len(tops) > 1 else tops[0]
    return composite.withColumn(name, top).withColumns({b: preview_byte(F.col(b), F.col(name)) for b in bands}).drop(name)


def select_bins(df: DataFrame, first: int = 4, last: int = 9, column: str = "bin") -> DataFrame:
    """Bins by number, both ends included."""
    return df.where(F.col(column).between(first, last))


def feed(tiles: DataFrame, tile_labels: DataFrame, split: DataFrame, encoder: DataFrame, target: str, bins: tuple[int, int] = (4, 9), scaled: bool = True, skip_empty: bool = False) -> DataFrame:
    """Tiles of one split's patches with mapped labels.

    ``tiles(path, tile_y, tile_x, bin, band, values)``, ``tile_labels(path, tile_y, tile_x,
    labels)``. Filters reach the scans: the split's target, the bins. With ``skip_empty``
    tiles whose labels are all of the ignored class are left out. Tiles and labels meet on
    their path; a patch has few tiles, whose places are compared row by row. So tables that
    are stored in buckets of the path (:func:`read_stored`) are joined as they lie.
    """
    wanted = split.where(F.col("target") == target).select("path").distinct()
    rows = select_bins(tiles, *bins).join(wanted, "path", "left_semi")
    if scaled:
        rows = rows.withColumn("values", F.transform("values", lambda v: v / 10000.0))
    table = F.broadcast(encoder.agg(F.map_from_entries(F.collect_list(F.struct(F.col("raw_id").cast("int"), F.col("class_id").cast("int")))).alias("_classes")))
    labels = tile_labels.join(wanted, "path", "left_semi").join(table, F.lit(True))
    labels = labels.withColumn("labels", F.transform("labels", lambda v: F.coalesce(F.try_element_at(F.col("_classes"), v.cast("int")), F.lit(0)))).drop("_classes")
    if skip_empty:
        labels = labels.where(F.exists("labels", lambda v: v != 0))
    held = labels.select(F.col("path").alias("_path"), F.col("tile_y").alias("_tile_y"), F.col("tile_x").alias("_tile_x"), "labels")
    # differences, so that the places don't become keys of the join, which buckets of the path would not serve
    same = (F.col("tile_y") - F.col("_tile_y") == 0) & (F.col("tile_x") - F.col("_tile_x") == 0)
    return rows.join(held, (F.col("path") == F.col("_path")) & same).drop("_path", "_tile_y", "_tile_x")
