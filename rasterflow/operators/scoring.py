"""Relevance scores of samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.frames import text_digest, written
from .metrics import confusion, scores
from .splits import assign_blocks, top_k_per_block


def _per_sample(rows: DataFrame, by: list[str], value: Column, ignore: int, mask: bool, label: str, out: str) -> DataFrame:
    counted = F.col(label) != ignore
    total = F.sum(F.when(counted, value)) if mask else F.sum(value)
    return rows.groupBy(*by).agg(F.try_divide(total.cast("double"), F.nullif(F.count(F.when(counted, 1)), F.lit(0)).cast("double")).alias(out))


def loss_score(pred: DataFrame, by: list[str], weights: DataFrame | None = None, ignore: int = 0, mask_numerator: bool = False, label: str = "label", logp: str = "logp", out: str = "score") -> DataFrame:
    """Weighted loss of all pixels of a sample by its number of labelled pixels; null without any.

    With ``mask_numerator`` ignored pixels don't enter the sum either. A second model's
    predictions give the irreducible score by the same call.
    """
    rows = pred
    if weights is not None:
        rows = pred.join(weights.select(F.col("class_id").alias("_c"), F.col("weight").alias("_w")), F.col(label) == F.col("_c"), "left")
    w = F.coalesce("_w", F.lit(0.0)) if weights is not None else F.lit(1.0)
    return _per_sample(rows, by, -w * F.element_at(logp, F.col(label) + 1), ignore, mask_numerator, label, out)


def margin_score(pred: DataFrame, by: list[str], ignore: int = 0, mask_numerator: bool = False, label: str = "label", logp: str = "logp", out: str = "score") -> DataFrame:
    """Best log-probability of another class less the true class's, averaged like the loss."""
    other = F.array_max(F.filter(logp, lambda v, i: i != F.col(label)))
    return _per_sample(pred, by, other - F.element_at(logp, F.col(label) + 1), ignore, mask_numerator, label, out)


def random_score(df: DataFrame, key: str, seed: int, out: str = "score") -> DataFrame:
    """A number in [0, 1) from md5 of (seed, key)."""
    return df.withColumn(out, F.conv(F.substring(text_digest(seed, F.col(key)), 1, 8), 16, 10).cast("double") / float(1 << 32))


def metric_score(pred: DataFrame, by: list[str], metric: str = "f1_weighted", ignore: int | None = 0, label: str = "label", predicted: str = "predicted", out: str = "score") -> DataFrame:
    """A metric of each sample: ``accuracy``, ``f1_weighted`` or ``f1_macro``."""
    return scores(confusion(pred, by, ignore, label, predicted), by).select(*by, F.col(metric).alias(out))


def parse_terms(terms: list[str]) -> list[tuple[float, str]]:
    """``"0.5*loss"`` is (0.5, "loss"), ``"loss"`` (1, "loss"); ``none`` is left out."""
    out = []
    for t in terms:
        weight, _, name = t.rpartition("*")
        if name.strip() != "none":
            out.append((float(weight) if weight else 1.0, name.strip()))
    return out


def combine_scores(tables: dict[str, DataFrame], terms: list[str], key: list[str], score: str = "score", out: str = "score") -> DataFrame:
    """The weighted sum of score tables; null where one of them lacks the sample or its score."""
    parsed = parse_terms(terms)
    if not parsed:
        raise ValueError("no score to combine")
    rows = None
    for i, (_, name) in enumerate(parsed):
        one = tables[name].select(*key, F.col(score).alias(f"_s{i}"))
        rows = one if rows is None else rows.join(one, key, "full")
    total = sum((F.col(f"_s{i}") * w for i, (w, _) in enumerate(parsed)), F.lit(0.0))
    return rows.select(*key, total.alias(out))


def reducible_score(model: DataFrame, fixed: DataFrame, key: list[str], score: str = "score") -> DataFrame:
    """A model's loss less that of a fixed one."""
    return combine_scores({"a": model, "b": fixed}, ["a", "-1*b"], key, score)


def select_blocks(samples: DataFrame, tables: dict[str, DataFrame], terms: list[str], key: str, order: str, size: int, want: int, block: str = "block_id") -> DataFrame:
    """Of each block of ``size`` samples in their ``order`` the ``want`` best by a weighted sum of scores, with ``block`` and ``score``.

    Missing scores come last, ties by key. Blocks of no more than ``want`` samples stay whole
    and need no score; for others a block without any score is an error, and so is a list of
    terms that names none. The result keeps ``order`` as a column, by which blocks are read.
    """
    if size <= want:
        return assign_blocks(samples, order, size, key=key, out=block).withColumn("score", F.lit(None).cast("double"))
    scored = samples.join(combine_scores(tables, terms, [key]).withColumnRenamed("score", "_score"), key, "left")
    blocks = written(assign_blocks(scored, order, size, key=key, out=block), "blocks")
    counts = blocks.groupBy(F.col(block).alias("_b")).agg(F.count("*").alias("_n"), F.count(F.when(~F.isnan("_score"), F.col("_score"))).alias("_with"))
    rows = top_k_per_block(blocks, block, "_score", key, want).join(counts, F.col(block) == F.col("_b"))
    lost = F.raise_error(F.concat(F.lit("no score in block "), F.col(block).cast("string"))).cast("double")
    score = F.when((F.col("_with") > 0) | (F.col("_n") <= want), F.col("_score")).otherwise(lost)
    return rows.select(*samples.columns, block, score.alias("score"))
