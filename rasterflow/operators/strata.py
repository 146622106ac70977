"""Strata for splitting: equal-width bins, merging of lone bins, keys."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.frames import fresh


def bin_equal_width(df: DataFrame, column: str, bins: int | None = None, out: str | None = None) -> DataFrame:
    """``df`` with the equal-width bin of ``column``: closed right, the lowest value in bin 0, missing values -1.

    Without ``bins`` there are ``min(100, rows // 20)``, at least one. All values equal: the
    middle bin. The range is one small aggregation, joined back as a single row.
    """
    if df.schema[column].dataType.typeName() not in ("byte", "short", "integer", "long", "float", "double", "decimal"):
        raise TypeError(f"{column} is not a number")
    lo, hi, rows_, n_ = fresh(df, "_lo", "_hi", "_rows", "_n")
    v = F.col(column).cast("double")
    v = F.when(~F.isnan(v), v)
    n = F.lit(bins) if bins else F.greatest(F.least(F.lit(100), F.floor(F.col(rows_) / 20)), F.lit(1))
    span = df.agg(F.min(v).alias(lo), F.max(v).alias(hi), F.count("*").alias(rows_))
    rows = df.join(F.broadcast(span), F.lit(True)).withColumn(n_, n.cast("int"))
    place = F.ceil((v - F.col(lo)) / (F.col(hi) - F.col(lo)) * F.col(n_)) - 1
    found = F.when(v.isNull(), -1).when(F.col(hi) == F.col(lo), F.ceil(F.col(n_) * 0.5) - 1).otherwise(F.greatest(F.lit(0), F.least(F.col(n_) - 1, place)))
    return rows.withColumn(out or f"{column}_bin", found.cast("int")).drop(lo, hi, rows_, n_)


def stratum_key(df: DataFrame, columns: list[str], out: str = "stratum") -> DataFrame:
    return df.withColumn(out, F.concat_ws("__", *[F.col(c).cast("string") for c in columns]))


BINS = "array<struct<bin:int,n:bigint>>"
MOVED = "array<struct<bin:int,new:int>>"


def lone_bins_merged(histogram: Column) -> Column:
    """The new bin ``(bin, new)`` of each bin of a histogram ``array<(bin, n)>``, after bins of one row were merged.

    For each distance d from 1 on, until no bin has a single row:

    * a lone bin moves if a bin lies d below or above it. If one of those is lone too, both
      move anyway; if not, it takes the one below along, or else the one above;
    * of the bins that move, two neighbours in order form a run; of an odd number the first
      three do;
    * a run becomes one bin, that of the median of its rows, rounded down.

    So what moves at a distance follows from each bin's own surroundings, and nothing
    depends on the order in which bins are looked at. A histogram has no more entries than
    the column was cut into bins.
    """
    return F.aggregate(
        F.sequence(F.lit(1), F.greatest(F.lit(1), F.array_max(F.transform(histogram, lambda x: x["bin"])) - F.array_min(F.transform(histogram, lambda x: x["bin"])))),
        F.struct(F.array_sort(histogram).cast(BINS).alias("rows"), F.transform(histogram, lambda x: F.struct(x["bin"].alias("bin"), x["bin"].alias("new"))).cast(MOVED).alias("moved")),
        lambda state, d: F.when(F.exists(state["rows"], lambda x: x["n"] == 1), _step(state, d)).otherwise(state),
        lambda state: state["moved"],
    )


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _step(state: Column, d: Column) -> Column:
    """One distance: bins that move are found, put into runs and renamed."""
    holds = lambda rows, b, alone: F.exists(rows, lambda y: (y["bin"] == b) & ((y["n"] == 1) | ~F.lit(alone)))

    def seen(rows: Column) -> Column:
        return F.transform(rows, lambda x: F.struct(x["bin"].alias("bin"), x["n"].alias("n"), holds(rows, x["bin"] - d, False).alias("below"), holds(rows, x["bin"] + d, False).alias("above"), (holds(rows, x["bin"] - d, True) | holds(rows, x["bin"] + d, True)).alias("lone_near")))

    def moving(bins: Column) -> Column:
        alone = F.filter(bins, lambda x: (x["n"] == 1) & ~x["lone_near"] & (x["below"] | x["above"]))
        along = F.transform(alone, lambda x: F.when(x["below"], x["bin"] - d).otherwise(x["bin"] + d))
        goes = lambda x: F.when(x["n"] == 1, x["below"] | x["above"]).otherwise(False)
        return _let(along, lambda taken: F.filter(bins, lambda x: goes(x) | F.array_contains(taken, x["bin"])))

    def runs(bins: Column) -> Column:
        """``(members, new)`` of each run."""
        odd, count = F.size(bins) % 2, F.floor(F.size(bins) / 2).cast("int")
        cut = lambda k: F.slice(bins, F.when(k == 0, 1).otherwise(2 * k + 1 + odd), F.when(k == 0, 2 + odd).otherwise(2))
        return F.transform(F.sequence(F.lit(0), count - 1), lambda k: _let(cut(k), lambda own: F.struct(F.transform(own, lambda x: x["bin"]).alias("members"), middle(own).alias("new"))))

    def middle(own: Column) -> Column:
        total = F.aggregate(own, F.lit(0).cast("long"), lambda t, x: t + x["n"])

        def at(k: Column) -> Column:
            upto = F.transform(own, lambda x, i: F.struct(x["bin"].alias("bin"), F.aggregate(F.slice(own, 1, i + 1), F.lit(0).cast("long"), lambda t, z: t + z["n"]).alias("to")))
            return F.element_at(F.filter(upto, lambda x: x["to"] > k), 1)["bin"]

        return _let(total, lambda t: F.floor((at(F.floor((t - 1) / 2)) + at(F.floor(t / 2))) / 2).cast("int"))

    def renamed(found: Column) -> Column:
        new = lambda b: F.coalesce(F.get(F.filter(found, lambda r: F.array_contains(r["members"], b)), F.lit(0))["new"], b)
        at = F.transform(state["rows"], lambda x: F.struct(new(x["bin"]).alias("bin"), x["n"].alias("n")))
        names = lambda rows: F.array_sort(F.array_distinct(F.transform(rows, lambda x: x["bin"])))
        rows = _let(at, lambda all_: F.transform(names(all_), lambda b: F.struct(b.alias("bin"), F.aggregate(F.filter(all_, lambda x: x["bin"] == b), F.lit(0).cast("long"), lambda t, x: t + x["n"]).alias("n"))))
        moved = F.transform(state["moved"], lambda x: F.struct(x["bin"].alias("bin"), new(x["new"]).alias("new")))
        return F.struct(rows.cast(BINS).alias("rows"), moved.cast(MOVED).alias("moved"))

    return _let(_let(seen(state["rows"]), moving), lambda bins: F.when(F.size(bins) > 1, _let(runs(bins), renamed)).otherwise(state))


def merge_singletons(df: DataFrame, columns: list[str]) -> DataFrame:
    """Bins of one row merged into neighbours, column by column, within groups of the columns before.

    A missing value's bin, -1, stands beside the lowest bin. Works on the histogram (a row
    for each combination of bins), gathered for each combination of the earlier columns: a
    gathered histogram has as many entries as the column has bins. The merge map is joined
    back.
    """
    n, bins, map_ = fresh(df, "_n", "_bins", "_map")
    for i, column in enumerate(columns):
        above = columns[:i]
        entries = F.collect_list(F.struct(F.col(column).cast("int").alias("bin"), F.col(n).alias("n")))
        counts = df.groupBy(*above, column).agg(F.count("*").alias(n)).where(F.col(column).isNotNull())
        grouped = counts.groupBy(*above).agg(entries.alias(bins)) if above else counts.agg(entries.alias(bins)).where(F.size(bins) > 0)
        keys = [f"{map_}_{j}" for j in range(i)]
        table = grouped.select(*[F.col(c).alias(k) for c, k in zip(above, keys, strict=True)], F.explode(lone_bins_merged(F.col(bins))).alias(map_))
        on = [F.col(c).eqNullSafe(F.col(k)) for c, k in zip(above, keys, strict=True)] + [F.col(column) == F.col(f"{map_}.bin")]
        df = df.join(table, on, "left").withColumn(column, F.col(f"{map_}.new")).drop(map_, *keys)
    return df
