"""Confusion matrices and what follows from them.

Pixels are aggregated once, to ``(by, label, predicted, n)``; all scores are computed from
that table, whose size is the number of class pairs for each group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def confusion(df: DataFrame, by: list[str] | None = None, ignore: int | None = None, label: str = "label", predicted: str = "predicted", where=None) -> DataFrame:
    """``(by, label, predicted, n)``: pairs that occur; rows of the ignored label don't count."""
    rows = df if ignore is None else df.where(F.col(label) != ignore)
    rows = rows if where is None else rows.where(where)
    return rows.groupBy(*(by or []), F.col(label).alias("label"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"))


def dense(matrix: DataFrame, classes: int, first: int = 0) -> DataFrame:
    """All pairs of classes ``first`` to ``classes - 1``, 0 where a pair doesn't occur."""
    ids = F.sequence(F.lit(first), F.lit(classes - 1))
    grid = matrix.sparkSession.range(1).select(F.explode(ids).alias("label")).select("label", F.explode(ids).alias("predicted"))
    return grid.join(matrix, ["label", "predicted"], "left").select("label", "predicted", F.coalesce("n", F.lit(0)).alias("n"))


def class_scores(matrix: DataFrame, by: list[str] | None = None, floor: int | None = None) -> DataFrame:
    """``(by, class, tp, fp, fn, pixel_count, precision, recall, f1)`` of classes that occur as label or prediction; 0/0 is 0."""
    by = by or []
    hit = (F.col("label") == F.col("predicted")).cast("long") * F.col("n")
    zero, missed = F.lit(0).cast("long"), F.col("n") - hit
    side = lambda c, tp, fp, fn: F.struct(F.col(c).alias("class"), tp.alias("tp"), fp.alias("fp"), fn.alias("fn"))
    # both sides of a pair of classes come from its one row, so the pixels are read once
    sides = matrix.select(*by, F.explode(F.array(side("label", hit, zero, missed), side("predicted", zero, missed, zero))).alias("s")).select(*by, "s.*")
    rows = sides.groupBy(*by, "class").agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"))
    ratio = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    tp, fp, fn = map(F.col, ("tp", "fp", "fn"))
    out = rows.withColumns({"pixel_count": tp + fn, "precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "f1": ratio(2 * tp, 2 * tp + fp + fn)})
    return out if floor is None else out.where(F.col("class") >= floor)


def scores(matrix: DataFrame, by: list[str] | None = None, include_ignored: bool = True) -> DataFrame:
    """``(by, pixels, accuracy, f1_weighted, f1_macro)``.

    The macro mean is over classes with a label or a prediction; the ignored class, which
    can enter by predictions alone, is left out of it unless ``include_ignored``. Groups
    without counted pixels are absent.
    """
    by = by or []
    each = class_scores(matrix, by)
    macro = F.avg("f1") if include_ignored else F.avg(F.when(F.col("class") != 0, F.col("f1")))
    total = F.sum("pixel_count").cast("double")
    return each.groupBy(*by).agg(F.sum("pixel_count").alias("pixels"), F.try_divide(F.sum("tp").cast("double"), total).alias("accuracy"), F.try_divide(F.sum(F.col("f1") * F.col("pixel_count")), total).alias("f1_weighted"), macro.alias("f1_macro")).where("pixels IS NOT NULL")


def masked_nll(df: DataFrame, weights: DataFrame | None = None, by: list[str] | None = None, ignore: int = 0, label: str = "label", logp: str = "logp") -> DataFrame:
    """Mean of ``-w[label] * logp[label]`` over rows of other labels; divided by their number, not by weights."""
    rows = df.where(F.col(label) != ignore)
    if weights is not None:
        rows = rows.join(weights.select(F.col("class_id").alias("_c"), F.col("weight").alias("_w")), F.col(label) == F.col("_c"), "left")
    w = F.coalesce("_w", F.lit(0.0)) if weights is not None else F.lit(1.0)
    return rows.groupBy(*(by or [])).agg(F.avg(-w * F.element_at(logp, F.col(label) + 1)).alias("loss"))


def weighted_mean(df: DataFrame, value: str, weight: str, by: list[str] | None = None) -> DataFrame:
    v, w = F.col(value).cast("double"), F.when(F.col(value).isNotNull(), F.col(weight)).cast("double")
    return df.groupBy(*(by or [])).agg(F.try_divide(F.sum(v * w), F.sum(w)).alias("mean"))


def run_summary(metrics: DataFrame, monitored: str, by: list[str] | None = None, epoch: str = "epoch", metric: str = "metric", value: str = "value") -> DataFrame:
    """``(by, metric, best, last, at_best)``: largest and last value of each metric, and its value in the monitored metric's best epoch.

    NaN is missing; of equally good epochs the first is best.
    """
    by = by or []
    v = F.col(value).cast("double")
    rows = metrics.where(v.isNotNull() & ~F.isnan(v))
    best = rows.where(F.col(metric) == monitored).groupBy(*by).agg(F.max_by(epoch, F.struct(v, -F.col(epoch))).alias("_best"))
    best = F.broadcast(best) if not by else best
    joined = rows.join(best, by, "left") if by else rows.join(best, F.lit(True), "left")
    return joined.groupBy(*by, metric).agg(F.max(v).alias("best"), F.max_by(v, F.col(epoch)).alias("last"), F.max(F.when(F.col(epoch) == F.col("_best"), v)).alias("at_best"))


def seen(df: DataFrame, kept: str, label: str = "label", ignore: int = 0) -> DataFrame:
    """Samples considered and kept, and labelled pixels of the kept ones, from ``(sample, kept, label)`` rows."""
    each = df.groupBy("sample").agg(F.max(F.col(kept).cast("int")).alias("_k"), F.count(F.when(F.col(label) != ignore, 1)).alias("_p"))
    return each.agg(F.count("*").alias("considered"), F.sum("_k").alias("seen"), F.sum(F.when(F.col("_k") == 1, F.col("_p")).otherwise(0)).alias("pixels"))
