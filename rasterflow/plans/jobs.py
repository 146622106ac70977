"""The composite job, the split job, processor chains and the pixel classifier."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import Imputer, SQLTransformer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import band_ratio
from ..functions.frames import written
from ..operators.composite import assign_bin, filled_series, resample
from ..operators.encode import class_counts, class_frequencies, class_weights, counts_per_target, patches_per_target, wide_counts
from ..operators.metrics import confusion, scores
from ..operators.rules import apply_rules
from ..operators.spatial import zonal_stats
from ..operators.splits import apply_splits, drop_duplicates_by_split, seeded_shuffle, subsample, swap_targets
from ..operators.tiling import tile, tile_step
from ..sources.tables import composite_meta

Step = Callable[[DataFrame], DataFrame]


def chain(df: DataFrame, steps: list[Step]) -> DataFrame:
    """Processors in order; each takes and returns a DataFrame."""
    for step in steps:
        df = df.transform(step)
    return df


def composite_job(obs: DataFrame, edges: DataFrame, bands: list[str], side: int, window: int, ratio: dict[str, int] | None = None, path: str = "path") -> DataFrame:
    """Observations ``(path, band, time, y, x, value)`` to tiled composites, a column for each band.

    Median for each pixel and bin, missing bins filled along time (arrays, one row for each
    pixel and band), coarse bands repeated onto the reference grid, bands side by side,
    pixels in tiles. Two shuffles: by (path, band, y, x), and by pixel of the fine grid with
    the whole series of a band in a row. ``ratio`` defaults to what the bands' own
    resolutions give; names that are no such band have 1.
    """
    kept = assign_bin(obs.where(F.col("band").isin(bands)), edges)
    series = filled_series(kept, [path, "band", "y", "x"], edges)
    ratios = F.create_map(*[F.lit(v) for b in bands for v in (b, (ratio or {}).get(b, band_ratio(b)))])
    fine = resample(series.withColumn("_r", F.try_element_at(ratios, F.col("band"))), F.col("_r")).drop("_r")
    each = [F.first(F.when(F.col("band") == b, F.col("series")), True).alias(f"_s{i}") for i, b in enumerate(bands)]
    side_by_side = fine.groupBy(path, "y", "x").agg(*each)
    # a band that lacks the pixel is null in all bins
    some = F.coalesce(*[F.col(f"_s{i}") for i in range(len(bands))])
    bins = F.transform(some, lambda e, k: F.struct(e["bin"].alias("bin"), *[F.get(f"_s{i}", k)["filled"].alias(b) for i, b in enumerate(bands)]))
    rows = side_by_side.select(path, F.explode(bins).alias("e"), "y", "x").select(path, "e.bin", "y", "x", *[f"e.`{b}`" for b in bands])
    return tile(rows, side, window)


LABEL = "label"


def composite_tiles(obs: DataFrame, edges: DataFrame, bands: list[str], side: int, window: int, ratio: dict[str, int] | None = None, labels: DataFrame | None = None, path: str = "path") -> DataFrame:
    """Observations ``(path, band, time, y, x, value)`` to a row for each tile, ``(path, tile_y, tile_x, tiles, labels)``.

    ``tiles`` are ``(bin, band, values)``: the filled medians of a band and bin, row by row,
    null where the band lacks a pixel. ``labels(path, y, x, label)`` on the reference grid
    become one array beside them, 0 where there is none; without them it is null.

    Two shuffles: by (path, band, y, x) for the series, and by tile. A pixel of a coarse
    band crosses the second one once for each tile that it touches, with its whole series,
    and is repeated onto the reference grid only where the tile is put together; labels
    cross it as one more band. A tile has a bounded number of pixels.
    """
    step, n = tile_step(side, window)
    kept = assign_bin(obs.where(F.col("band").isin(bands)), edges)
    series = filled_series(kept, [path, "band", "y", "x"], edges)
    ratios = F.create_map(*[F.lit(v) for b in bands for v in (b, (ratio or {}).get(b, band_ratio(b)))])
    coarse = series.select(path, "band", F.try_element_at(ratios, F.col("band")).alias("r"), F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), F.transform("series", lambda e: e["filled"]).alias("values"))
    if labels is not None:
        coarse = coarse.unionByName(labels.select(path, F.lit(LABEL).alias("band"), F.lit(1).alias("r"), F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), F.array(F.col("label").cast("double")).alias("values")))
    touched = lambda c: F.sequence(F.floor(F.col(c) * F.col("r") / step).cast("int"), F.floor(((F.col(c) + 1) * F.col("r") - 1) / step).cast("int"))
    placed = coarse.withColumn("tile_y", F.explode(touched("y"))).withColumn("tile_x", F.explode(touched("x"))).where((F.col("tile_y") < n) & (F.col("tile_x") < n))
    dealt = placed.repartition(path, "tile_y", "tile_x")
    fine = dealt.withColumn("dy", F.explode(F.sequence(F.lit(0), F.col("r") - 1))).withColumn("dx", F.explode(F.sequence(F.lit(0), F.col("r") - 1)))
    inner = lambda c: F.col(c) * F.col("r") + F.col(f"d{c}") - F.col(f"tile_{c}") * step
    fine = fine.select(path, "tile_y", "tile_x", "band", inner("y").alias("dy"), inner("x").alias("dx"), "values").where("dy >= 0 and dx >= 0").where((F.col("dy") < window) & (F.col("dx") < window))
    banded = fine.groupBy(path, "tile_y", "tile_x", "band").agg(F.array_sort(F.collect_list(F.struct((F.col("dy") * window + F.col("dx")).alias("at"), "values"))).alias("pixels"))
    whole = F.sequence(F.lit(0), F.lit(window * window - 1))
    # a complete band is in order; in another one each place is looked up
    full = F.when(F.size("pixels") == window * window, F.transform("pixels", lambda p: p["values"])).otherwise(F.transform(whole, lambda k: F.get(F.filter("pixels", lambda p: p["at"] == k), F.lit(0))["values"]))
    banded = banded.withColumn("pixels", full)
    bins = F.broadcast(edges.agg(F.array_sort(F.collect_list("bin")).alias("_bins")))
    by_bin = F.transform("_bins", lambda b, k: F.struct(b.alias("bin"), F.col("band").alias("band"), F.transform("pixels", lambda v: F.get(v, k).cast("float")).alias("values")))
    rows = banded.join(bins, F.lit(True)).select(path, "tile_y", "tile_x", "band", "pixels", F.when(F.col("band") != LABEL, by_bin).alias("tiles"))
    own = F.first(F.when(F.col("band") == LABEL, F.transform("pixels", lambda v: F.coalesce(F.get(v, F.lit(0)).cast("smallint"), F.lit(0).cast("smallint")))), True)
    return rows.groupBy(path, "tile_y", "tile_x").agg(F.array_sort(F.flatten(F.collect_list("tiles"))).alias("tiles"), own.alias("labels"))


def composite_product(obs: DataFrame, edges: DataFrame, bands: list[str], side: int, window: int, place: str, ratio: dict[str, int] | None = None, labels: DataFrame | None = None, path: str = "path", by: list[str] | None = None) -> dict[str, DataFrame]:
    """Tiles, tile labels and metadata of a composite, written to folders of ``place`` and read again: ``tiles``, ``tile_labels`` and ``meta``.

    ``tiles(path, tile_y, tile_x, bin, band, values)``, ``tile_labels(path, tile_y, tile_x,
    labels, has_label)``, both partitioned by the columns ``by`` of ``obs``, such as year
    and tile name, which a patch has one of each; ``meta`` is the row of
    :func:`composite_meta`. The composite is worked out once.
    """
    spark = obs.sparkSession
    whole = written(composite_tiles(obs, edges, bands, side, window, ratio, labels, path), "composite")
    if by:
        whole = whole.join(obs.select(path, *by).distinct(), path)
    tiles = whole.select(path, *(by or []), "tile_y", "tile_x", F.explode("tiles").alias("t")).select(path, *(by or []), "tile_y", "tile_x", "t.bin", "t.band", "t.values")
    tiles.write.mode("overwrite").partitionBy(*(by or [])).parquet(f"{place}/tiles")
    held = whole.where(F.col("labels").isNotNull()).select(path, *(by or []), "tile_y", "tile_x", "labels", F.exists("labels", lambda v: v != 0).alias("has_label"))
    held.write.mode("overwrite").partitionBy(*(by or [])).parquet(f"{place}/tile_labels")
    found = whole.select(F.col(path).alias("path"), "tile_y", "tile_x", F.explode(F.array_distinct(F.transform("tiles", lambda t: t["band"]))).alias("band"), F.array(F.lit(side), F.lit(side)).alias("img_size"))
    composite_meta(found).write.mode("overwrite").parquet(f"{place}/meta")
    return {name: spark.read.parquet(f"{place}/{name}") for name in ("tiles", "tile_labels", "meta")}


def with_elevation(cells: DataFrame, key: str = "path", value: str = "elev", ring: str = "ring") -> Step:
    """A processor that adds mean, deviation and median elevation of each patch's polygon; null where no cell lies in it."""

    def step(split: DataFrame) -> DataFrame:
        polygons = split.select(key, ring).dropDuplicates([key])
        return split.join(zonal_stats(cells, polygons, key, value, ring=ring), key, "left").select(*split.columns, "elevation_mean", "elevation_std", "elevation_median")

    return step


def with_pixel_counts(labels: DataFrame, classes: list[int], key: str = "path") -> Step:
    """A processor that adds ``pixel_count_<class>`` and ``pixel_count_max`` of each patch; 0 and null for patches without labels."""

    def step(split: DataFrame) -> DataFrame:
        wide = wide_counts(class_counts(labels, [key]), [key], classes)
        names = [f"pixel_count_{c}" for c in classes]
        return split.join(wide, key, "left").select(*split.columns, *[F.coalesce(n, F.lit(0)).alias(n) for n in names], "pixel_count_max")

    return step


def split_job(
    patches: DataFrame,
    rules: list[dict] | None = None,
    annotated: DataFrame | None = None,
    *,
    key: str = "path",
    seed: int = 42,
    processors: list[Step] | None = None,
    duplicates: list[str] | None = None,
    same: str | None = None,
    fractions: dict[str, float] | None = None,
    shuffle: bool = True,
    labels: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """``split``, ``patch_counts`` and, with labels, ``pixel_counts``; exactly one of rules and annotations is needed.

    Of the splits in ``duplicates`` rows go that agree with others in column ``same`` (the
    key, if not given).
    """
    if (rules is None) == (annotated is None):
        raise ValueError("give either rules or annotated splits")
    if rules is not None:
        split = apply_splits(chain(apply_rules(patches, rules), processors or []), rules, seed, key)
    else:
        split = chain(annotated.join(patches, key), processors or [])
    if duplicates:
        split = drop_duplicates_by_split(split, same or key, duplicates)
    split = written(subsample(split, key, fractions or {}, seed), "split")
    out = {"split": seeded_shuffle(split, key, seed) if shuffle else split, "patch_counts": patches_per_target(split)}
    if labels is not None:
        out["pixel_counts"] = counts_per_target(class_counts(labels, [key]), split, key)
    return out


def swap_job(made: dict[str, DataFrame], a: str = "train", b: str = "val") -> dict[str, DataFrame]:
    """What :func:`split_job` made, with two targets swapped in the split, its patch counts and its pixel counts."""
    return {name: swap_targets(df, a, b) for name, df in made.items()}


def fit_classifier(train: DataFrame, features: list[str], label: str = "label", weight: str | None = None, kind: str = "logistic", **options) -> PipelineModel:
    """A pixel classifier on per-pixel features, with class weights as row weights.

    A missing feature (null or NaN) is replaced by the median of the training rows' values,
    and each feature that some training row lacks has an indicator beside it; a feature that
    no training row has counts as 0. So every row is trained on and every row is scored.
    """
    value = lambda c: F.col(f"`{c}`").cast("double")
    absent = lambda c: value(c).isNull() | F.isnan(value(c))
    lacking = train.agg(*[F.max(absent(c)).alias(f"l{i}") for i, c in enumerate(features)]).first()
    gaps = [c for i, c in enumerate(features) if lacking[f"l{i}"]]
    plain = [c for c in features if c not in gaps]
    numbers = ", ".join(f"CAST(`{c}` AS DOUBLE) AS `_in_{i}`" for i, c in enumerate(features))
    ids = {c: i for i, c in enumerate(features)}
    # all features are filled, as rows to be scored may lack what no training row does
    fills = Imputer(strategy="median", relativeError=0.001, inputCols=[f"_in_{i}" for i in range(len(features))], outputCols=[f"_full_{i}" for i in range(len(features))])
    empty = {c: train.where(~absent(c)).isEmpty() for c in gaps}
    known = [c for c in features if not empty.get(c)]
    fills = fills.setInputCols([f"_in_{ids[c]}" for c in known]).setOutputCols([f"_full_{ids[c]}" for c in known])
    zero = "".join(f", coalesce(nanvl(`_in_{ids[c]}`, 0D), 0D) AS `_full_{ids[c]}`" for c in features if empty.get(c))
    marks = "".join(f", CAST(`_in_{ids[c]}` IS NULL OR isnan(`_in_{ids[c]}`) AS DOUBLE) AS `_gap_{ids[c]}`" for c in gaps)
    model = {"logistic": LogisticRegression, "forest": RandomForestClassifier}[kind](featuresCol="_features", labelCol=label, predictionCol="_prediction", probabilityCol="_probability", rawPredictionCol="_raw", **options)
    if weight:
        model = model.setWeightCol(weight)
    inputs = [f"_full_{ids[c]}" for c in (*plain, *gaps)] + [f"_gap_{ids[c]}" for c in gaps]
    stages = [SQLTransformer(statement=f"SELECT *, {numbers} FROM __THIS__"), *([fills] if known else []), SQLTransformer(statement=f"SELECT *{zero}{marks} FROM __THIS__"), VectorAssembler(inputCols=inputs, outputCol="_features", handleInvalid="error"), model]
    return Pipeline(stages=stages).fit(train)


def classifier_job(rows: DataFrame, features: list[str], classes: int, alpha: float | None = 1.0, label: str = "label", target: str = "target", ignore: int | None = 0, kind: str = "logistic", **options) -> DataFrame:
    """Trains on the rows of target ``train`` and gives the scores of all targets: ``(target, pixels, accuracy, f1_weighted, f1_macro)``.

    Rows weigh as their class does, blended towards equal weights by ``alpha`` (null:
    unweighted). The ignored class, and rows without a label, are neither trained on nor
    scored; all other rows are, whatever features they lack: see :func:`fit_classifier`.
    """
    kept = rows.where(F.col(label).isNotNull() if ignore is None else F.col(label) != ignore)
    train = kept.where(F.col(target) == "train")
    encoder = rows.sparkSession.range(classes).select(F.col("id").cast("int").alias("raw_id"), F.col("id").cast("int").alias("class_id"), F.lit("").alias("name"))
    weights = class_weights(class_frequencies(class_counts(train, []), encoder, parcel=ignore == 0, label=label), alpha).select(F.col("class_id").alias("_class"), F.col("weight").alias("_weight"))
    weighted = train.join(F.broadcast(weights), train[label] == weights["_class"])  # a row for each class
    model = fit_classifier(weighted, features, label, None if alpha is None else "_weight", kind, **options)
    return scores(confusion(predict(model, kept), [target], ignore, label), [target])


def predict(model: PipelineModel, df: DataFrame, floor: float = 1e-12) -> DataFrame:
    """``df`` with ``predicted`` and ``logp``, as the metrics take them."""
    logp = F.transform(vector_to_array("_probability"), lambda p: F.log(F.greatest(p, F.lit(floor))))
    return model.transform(df).select(*df.columns, F.col("_prediction").cast("int").alias("predicted"), logp.alias("logp"))
