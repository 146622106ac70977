"""Label encoders, class counts, frequencies and weights."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import blend_weight, class_weight, prior_logit



def encoder_table(spark: SparkSession, labels: list[dict]) -> DataFrame:
    """``(raw_id, class_id, name)`` from a list of ``{name, id}``; ``id`` is one id or a list.

    A class's number is its place in the list; of several entries for an id the last counts.
    """
    # the list is the caller's, so the last entry of an id is found here and plans need no shuffle for it
    classes = {raw: (i, x["name"]) for i, x in enumerate(labels) for raw in (x["id"] if isinstance(x["id"], list) else [x["id"]])}
    return spark.createDataFrame([(raw, *c) for raw, c in classes.items()], "raw_id int, class_id int, name string")


def remap(df: DataFrame, encoder: DataFrame, raw: str, out: str = "class_id") -> DataFrame:
    """``df`` with the class of a raw id; ids that aren't listed are class 0."""
    table = encoder.select(F.col("raw_id").alias("_raw"), F.col("class_id").alias("_class"))
    return df.join(table, df[raw] == table["_raw"], "left").withColumn(out, F.coalesce("_class", F.lit(0))).drop("_raw", "_class")


def with_class_names(df: DataFrame, classes: DataFrame, raw: str, out: str = "class_name") -> DataFrame:
    """``df`` with the name of a raw id, blank where there is none."""
    table = classes.select(F.col("raw_id").alias("_raw"), F.col("name").alias("_name")).dropDuplicates(["_raw"])
    return df.join(table, df[raw] == table["_raw"], "left").withColumn(out, F.coalesce("_name", F.lit(""))).drop("_raw", "_name")


def class_counts(labels: DataFrame, keys: list[str], label: str = "label") -> DataFrame:
    """Pixels of each class in each patch: ``(*keys, label, n)``."""
    return labels.groupBy(*keys, label).agg(F.count("*").alias("n"))


def count_maps(counts: DataFrame, keys: list[str], label: str = "label") -> DataFrame:
    """The same as one map for each patch; a patch has few classes."""
    return counts.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(label, "n")))).alias("counts"))


def counts_per_target(counts: DataFrame, split: DataFrame, key: str = "path", label: str = "label") -> DataFrame:
    """Pixels of every class seen anywhere, for every target, 0 where a target has none: ``(target, label, n)``."""
    sums = counts.join(split.select(key, "target"), key).groupBy("target", label).agg(F.sum("n").alias("n"))
    seen = counts.agg(F.collect_set(label).alias("_l"))  # distinct classes, a short list
    grid = split.select("target").distinct().join(F.broadcast(seen), F.lit(True)).select("target", F.explode("_l").alias(label))
    return grid.join(sums, ["target", label], "left").select("target", label, F.coalesce("n", F.lit(0)).alias("n"))


def wide_counts(counts: DataFrame, keys: list[str], classes: list[int], label: str = "label") -> DataFrame:
    """A column ``pixel_count_<c>`` for each class, and the largest count of a class other than 0 (null if there is none)."""
    sums = [F.coalesce(F.sum(F.when(F.col(label) == c, F.col("n"))), F.lit(0)).alias(f"pixel_count_{c}") for c in classes]
    return counts.groupBy(*keys).agg(*sums, F.max(F.when(F.col(label) != 0, F.col("n"))).alias("pixel_count_max"))


def patches_per_target(split: DataFrame, target: str = "target") -> DataFrame:
    return split.groupBy(target).agg(F.count("*").alias("patches"))


def class_frequencies(counts: DataFrame, encoder: DataFrame, parcel: bool = True, label: str = "label") -> DataFrame:
    """``(class_id, n, frequency)`` of every class of the encoder and class 0; with ``parcel`` class 0 counts nothing."""
    sums = remap(counts, encoder, label).groupBy("class_id").agg(F.sum("n").alias("_n"))
    classes = encoder.select("class_id").union(encoder.sparkSession.range(1).select(F.lit(0).alias("class_id"))).distinct()
    n = F.when((F.col("class_id") == 0) & F.lit(parcel), 0).otherwise(F.coalesce("_n", F.lit(0)))
    rows = classes.join(sums, "class_id", "left").select("class_id", n.cast("long").alias("n"))
    whole = F.sum("n").over(Window.partitionBy())  # a row for each class
    return rows.withColumn("frequency", F.coalesce(F.try_divide(F.col("n").cast("double"), whole), F.lit(0.0)))


def class_weights(frequencies: DataFrame, alpha: float | None = 1.0) -> DataFrame:
    """``frequencies`` with ``weight``, blended towards no weighting by ``alpha`` (null: no weights)."""
    n = F.count("*").over(Window.partitionBy())
    return frequencies.withColumn("weight", blend_weight(class_weight(F.col("frequency"), n), alpha))


def prior_logits(frequencies: DataFrame) -> DataFrame:
    """``frequencies`` with ``logit``; absent classes count as the rarest that occurs."""
    floor = F.min(F.when(F.col("frequency") > 0, F.col("frequency"))).over(Window.partitionBy())
    return frequencies.withColumn("logit", prior_logit(F.col("frequency"), floor))
