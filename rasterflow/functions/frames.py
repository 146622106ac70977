"""Helpers on whole DataFrames: written tables, distributed ranks.

Joins carry a broadcast hint only where the side's size is bounded by construction (one row,
bin edges, rank offsets). Elsewhere Spark decides at run time by the side's real size.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The shared folder ``spark.checkpoint.dir``; where none is set, one of our own, in a local session only."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        found = f"file://{tempfile.mkdtemp(prefix='spark-shared-')}"
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """The rows of ``df`` as a Parquet table in the shared folder, read again.

    Cuts the lineage: a lost executor costs its tasks only, and what a task has drawn from
    its place in a partition is fixed for all later reads.
    """
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names for working columns that no column of ``df`` has, with more underscores in front where needed."""
    have, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in have:
            n = f"_{n}"
        have.add(n.lower())
        out.append(n)
    return out


def text_digest(*parts: Column | str | int) -> Column:
    """Hex md5 of the parts joined by ``|``: the source of all seeded orders."""
    return F.md5(F.concat_ws("|", *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts]))


def row_hash(df: DataFrame, salt: int = 0) -> Column:
    """64 bits of all columns of a row, others for another salt; maps are taken as JSON."""
    plain = lambda f: F.to_json(F.col(f"`{f.name}`")) if "map<" in f.dataType.simpleString() else F.col(f"`{f.name}`")
    return F.xxhash64(F.lit(salt), *map(plain, df.schema.fields))


def placed(df: DataFrame, order: list[Column | str], scope: list[str] | None = None, place: str = "_place") -> DataFrame:
    """``df`` as a written table dealt into ranges of ``order`` within ``scope``; ``place`` tells partition (its upper bits) and row.

    Rows are told apart down to a digest of all their columns and, where these are equal
    too, to their place in the partition that they come from. So no key, value or group of equal rows is
    too large to be cut: a range ends at any row. The ranges come from Spark's sample of
    the rows; their number is that of shuffle partitions, which a session sets by its data.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    whole, origin = fresh(df.select("*", F.lit(0).alias(place)), "_whole", "_origin")
    # numbered in a fixed order, so that a task that is run again numbers its rows alike
    rows = df.withColumn(whole, row_hash(df)).sortWithinPartitions(whole).withColumn(origin, F.monotonically_increasing_id())
    keys = [*map(F.col, scope or []), *[F.col(c) if isinstance(c, str) else c for c in order], F.col(whole), F.col(origin)]
    dealt = rows.repartitionByRange(n, *keys).sortWithinPartitions(*keys).drop(whole, origin)
    return written(dealt.withColumn(place, F.monotonically_increasing_id()), "ranked")


def ordered_rank(df: DataFrame, order: list[Column | str], scope: list[str] | None = None, out: str = "rank") -> DataFrame:
    """1-based rank of rows by ``order`` within ``scope``, without a window over rows.

    Rows that agree in ``order`` stand in the order of a digest of all their columns, so the
    result is the same under any partitioning. A written range shuffle gives each row's
    place; a small table of counts, a row for each range and group that meets it, gives
    what stands before each range.
    """
    scope = scope or []
    place, part, n, first, before = fresh(df, "_place", "_part", "_n", "_first", "_before")
    rows = placed(df, order, scope, place)
    counts = rows.groupBy(*scope, F.shiftright(place, 33).alias(part)).agg(F.count("*").alias(n), F.min(place).alias(first))
    starts = counts.withColumn(before, F.sum(n).over(Window.partitionBy(*scope).orderBy(part)) - F.col(n))
    starts = starts.select(*[F.col(f"`{c}`").alias(f"{before}_{i}") for i, c in enumerate(scope)], F.col(part).alias(f"{part}_b"), first, before)
    on = (F.shiftright(place, 33) == F.col(f"{part}_b")) & reduce(lambda a, b: a & b, [F.col(f"`{c}`").eqNullSafe(F.col(f"{before}_{i}")) for i, c in enumerate(scope)], F.lit(True))
    # without a scope there is a row for each range
    joined = rows.join(starts if scope else F.broadcast(starts), on)
    return joined.select(*[F.col(f"`{c}`") for c in df.columns if c != out], (F.col(before) + F.col(place) - F.col(first) + 1).alias(out))


def digest_rank(df: DataFrame, seed: int | str, key: Column, scope: list[str] | None = None, out: str = "rank") -> DataFrame:
    """1-based rank of rows by md5 of (seed, key) within ``scope``, then by key; see :func:`ordered_rank`."""
    return ordered_rank(df, [text_digest(seed, key), key.cast("string")], scope, out)


def value_rank(df: DataFrame, value: str, ties: str, out: str = "rank") -> DataFrame:
    """1-based rank of all rows by a column (nulls first), then md5 of ``ties``, then ``ties``; see :func:`ordered_rank`."""
    return ordered_rank(df, [F.col(value).asc_nulls_first(), text_digest(F.col(ties)), F.col(ties)], None, out)


def order_key(value: Column) -> Column:
    """A long that stands in the order of a double: the bits of its magnitude, with the sign.

    Zero and negative zero are equal; null and NaN give null. Powers of two are exact, so
    nothing is rounded.
    """
    v = F.abs(value.cast("double"))
    guess = F.greatest(F.floor(F.log2(v)), F.lit(-1022)).cast("int")
    # the logarithm may be one off next to a power of two
    e = F.when(v >= F.pow(F.lit(2.0), guess + 1), guess + 1).when((v < F.pow(F.lit(2.0), guess)) & (guess > -1022), guess - 1).otherwise(guess)
    scaled = v / F.pow(F.lit(2.0), e)
    high = (e + 1023).cast("long") - F.when(scaled < 1, 1).otherwise(0)
    bits = high * F.lit(1 << 52) + ((scaled - F.when(scaled < 1, 0.0).otherwise(1.0)) * float(1 << 52)).cast("long")
    finite = F.when(v == float("inf"), F.lit(2047 << 52)).when(v == 0, F.lit(0)).otherwise(bits)
    return F.when(value.isNotNull() & ~F.isnan(value.cast("double")), F.when(value < 0, -finite).otherwise(finite)).cast("long")


def exact_mean(df: DataFrame, keys: list[str], value: Column, count: Column, out: str = "mean", total: str = "n") -> DataFrame:
    """``(*keys, total, out)`` of each group: the number of values and their mean, each value taken ``count`` times.

    The mean has the same bits in whatever order rows are added: values of one exponent are
    summed as whole numbers, the two halves of their mantissas apart, and the at most 2047
    exponents of a group are put together in their order, with what each addition rounds off
    kept. It is rounded once where all values have one exponent. Infinite values and NaN give
    what plain doubles give. A group may have 2 to the 36 values; more raise an overflow.
    """
    power, high, low, n, parts, odd, bits, v = fresh(df, "_power", "_high", "_low", "_n", "_parts", "_odd", "_bits", "_v")
    half, frac = F.lit(1 << 27), F.lit((1 << 52) - 1)
    rows = df.withColumn(v, value.cast("double")).withColumn(n, count.cast("long")).withColumn(bits, order_key(F.col(v)))
    size = F.abs(bits)
    mantissa = (size.bitwiseAND(frac) + F.when(size > frac, F.lit(1 << 52)).otherwise(F.lit(0))) * F.signum(bits).cast("long")
    rows = rows.withColumn(power, F.greatest(F.shiftright(size, 52), F.lit(1))).withColumn(high, F.floor(mantissa / half).cast("long")).withColumn(low, mantissa - F.col(high) * half)
    sums = rows.groupBy(*keys, power).agg(F.sum(F.col(high) * F.col(n)).alias(high), F.sum(F.col(low) * F.col(n)).alias(low), F.sum(n).alias(n), F.sum(F.when(F.isnan(v) | (F.abs(v) == float("inf")), F.col(v))).alias(odd))
    whole = sums.groupBy(*keys).agg(F.sum(n).alias(n), F.sum(odd).alias(odd), F.array_sort(F.collect_list(F.struct(F.col(power), (F.col(high).cast("decimal(28,0)") * half.cast("decimal(9,0)") + F.col(low)).cast("decimal(38,0)").alias("sum")))).alias(parts))
    times = F.col(n).cast("decimal(20,0)")

    def terms(p: Column) -> Column:
        """A sum divided by the number of values: the quotient, which is whole, and the rest."""
        quotient = F.floor(p["sum"] / times).cast("decimal(20,0)")
        unit = F.pow(F.lit(2.0), p[power].cast("double") - 1075)
        return F.struct((quotient.cast("double") * unit).alias("q"), ((p["sum"] - quotient * times).cast("double") / F.col(n).cast("double") * unit).alias("r"))

    def added(state: Column, t: Column) -> Column:
        s = state["s"] + t["q"]
        b = s - state["s"]
        return F.struct(s.alias("s"), (state["c"] + ((state["s"] - (s - b)) + (t["q"] - b)) + t["r"]).alias("c"))

    zero = F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("c"))
    mean = F.aggregate(F.transform(parts, terms), zero, added, lambda e: e["s"] + e["c"])
    return whole.select(*keys, F.col(n).alias(total), F.coalesce(odd, mean).alias(out))


def counted_median(df: DataFrame, keys: list[str], value: str, out: str = "median", most: int = 10_000) -> DataFrame:
    """``(*keys, n, mean, std, out)`` of each group: number of values, mean, population deviation, exact median.

    For groups of any size: equal values are counted first, so a group spreads over as many
    tasks as it has different values. Mean and deviation don't depend on the order of rows:
    see :func:`exact_mean`. Then the middle is selected by counting passes: values
    are taken as 64 bits in order, a histogram of their upper 16 bits finds the values next
    to the middle, and so on with the bits below, until no group has more than ``most``
    different values left. Null and NaN are missing; groups without values are absent.
    """
    if not keys:
        raise ValueError("give at least one key")
    n, bits, before, total, mean, part, upto = fresh(df, "_n", "_bits", "_before", "_total", "_mean", "_part", "_upto")
    v = F.col(value).cast("double")
    counted = df.where(v.isNotNull() & ~F.isnan(v)).groupBy(*keys, v.alias(value)).agg(F.count("*").alias(n))
    left = written(counted.withColumn(bits, order_key(F.col(value))), "values")
    sums = written(exact_mean(left, keys, F.col(value), F.col(n), mean, total), "value-sums")
    names = [f"{part}_{i}" for i in range(len(keys))]
    on = lambda b: reduce(lambda x, y: x & y, [F.col(f"`{k}`").eqNullSafe(b[a]) for k, a in zip(keys, names, strict=True)])
    renamed = lambda d: d.select(*[F.col(f"`{k}`").alias(a) for k, a in zip(keys, names, strict=True)], *[c for c in d.columns if c not in keys])
    other = renamed(sums)
    squares = exact_mean(left.join(other, on(other)), [*keys, mean], F.pow(F.col(value) - F.col(mean), 2), F.col(n), part, total)
    spread = squares.select(*keys, F.col(total).alias("n"), F.col(mean).alias("mean"), F.sqrt(part).alias("std"))
    # rows of a group that lie below those that are left
    below = sums.select(*keys, total, F.lit(0).cast("long").alias(before))
    middle = lambda lo, hi: (F.expr(f"(`{total}` - 1) div 2") < hi) & (F.expr(f"`{total}` div 2") >= lo)
    for shift in (48, 32, 16, 0):
        if (left.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0) <= most:
            break
        cut = F.shiftright(bits, shift)
        histogram = left.groupBy(*keys, cut.alias(part)).agg(F.sum(n).alias(n))
        own = renamed(below)
        running = Window.partitionBy(*keys).orderBy(part).rowsBetween(Window.unboundedPreceding, 0)  # no more than 65,536 rows for each of two upper parts
        cumulated = histogram.join(own, on(own)).withColumn(upto, F.col(before) + F.sum(n).over(running))
        kept = written(cumulated.where(middle(F.col(upto) - F.col(n), F.col(upto))).select(*keys, F.col(part), total, (F.col(upto) - F.col(n)).alias(before)), "middle")
        other = renamed(kept)
        left = written(left.join(other, on(other) & (cut == other[part])).select(*left.columns), "values")
        below = kept.groupBy(*keys).agg(F.first(total).alias(total), F.min(before).alias(before))
    own = renamed(below)
    running = Window.partitionBy(*keys).orderBy(bits).rowsBetween(Window.unboundedPreceding, 0)
    last = left.join(own, on(own)).withColumn(upto, F.col(before) + F.sum(n).over(running))
    found = last.where(middle(F.col(upto) - F.col(n), F.col(upto))).groupBy(*keys).agg(((F.min(value) + F.max(value)) / 2).alias(out))
    other = renamed(found)
    return spread.join(other, on(other)).select(*keys, "n", "mean", "std", out)
