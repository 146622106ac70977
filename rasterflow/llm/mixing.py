"""Mixing sources to target weights by systematic sampling.

Sources share the total size by weight, with targets capped at ``cap`` times a source's
own size. A document of source s is expected ``target(s) / size(s)`` times; these
expectations are prefix-summed within the source, one random offset is added, and the
document is emitted once for each integer boundary that its stretch crosses. Documents
stand in order of size, so what a source yields differs from its target by less than its
largest document.

Cost: one range shuffle, whose boundaries fall between single rows, equal ones included, so
a source with a third of all rows spreads over as many partitions as it fills. Offsets
between partitions come from one small count for each (partition, source). Texts take no
part in it.
"""

from __future__ import annotations

from hashlib import sha256

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.frames import placed, row_hash
from .common import fresh, word_count, written

WEIGHTS = (5, 2, 1)
CAP = 3
#: Rows that are broadcast at most (some dozens of bytes each).
BROADCAST_ROWS = 100_000


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """``(source, source_size)`` with ``weight`` and ``target``.

    Weights repeat over the sources by code point, null last. Targets add up to all
    sizes; a target above ``cap`` times its source's size stops there and the excess is
    shared again by weight, until none is above. Sources of size zero have target zero.
    """
    place = F.row_number().over(Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))) - 1
    table = written(sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int"))), "mix-sources")
    total = table.agg(F.sum("source_size")).first()[0] or 0
    level, most = None, cap * F.col("source_size")
    while True:  # the level only rises; each round caps at least one source more
        capped = F.lit(False) if level is None else most <= F.lit(level) * F.col("weight")
        held, free = table.agg(F.sum(F.when(capped, most)), F.sum(F.when(~capped, F.col("weight")))).first()
        new = (total - (held or 0)) / free if free else None
        if new is None or new == level:
            break
        level = new
    share = most.cast("double") if free is None else F.least(most.cast("double"), F.lit(float(level or 0)) * F.col("weight"))
    return table.withColumn("target", F.when(F.col("source_size") > 0, share).otherwise(F.lit(0.0)))


def offset(source: Column, seed: int) -> Column:
    """One number in [0, 1) for each source, the same on every run."""
    digest = F.sha2(F.concat(F.lit(f"{seed}|"), F.coalesce(F.concat(F.lit("s"), source), F.lit("n"))), 256)
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / float(1 << 32)


def mix_copies(docs: DataFrame, source: str = "source", text: str = "text", size: Column | None = None, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, seed: int = 42) -> DataFrame:
    """``docs`` with columns ``_size _source_size _target _copies``: how often the mix takes a row.

    ``size`` is the number of words unless given; null texts and null sizes count 0. Null
    sources form a source of their own. Rows that are equal in every column are
    interchangeable and each has copies of its own. No row gets more than ``cap`` copies.
    An empty table gives an empty result. Other columns pass unchanged. Rows are written as
    they are, so leave out texts that needn't pass; :func:`mix` does.
    """
    keep = docs.drop(*[c for c in docs.columns if c.lower() in ("_size", "_source_size", "_target", "_copies")])
    sized = F.coalesce(size if size is not None else word_count(F.col(text)), F.lit(0)).cast("long")
    packed = keep.select(F.struct("*").alias("row"), F.col(source).alias("source"), sized.alias("size"), row_hash(keep).alias("one"), row_hash(keep, 1).alias("two"))
    out = _copies(packed, weights, cap, seed)
    return out.select("row.*", F.col("size").alias("_size"), F.col("source_size").alias("_source_size"), F.col("target").alias("_target"), F.col("copies").alias("_copies"))


def _copies(packed: DataFrame, weights: tuple[int, ...], cap: int, seed: int) -> DataFrame:
    """``(row, source, size, one, two)`` with ``source_size, target, copies``; ``one`` and ``two`` tell rows of a size apart."""
    rows = placed(packed, [F.col("source").isNull(), "source", "size", "one", "two"], place="at")
    part = F.shiftright("at", 33)
    counts = rows.groupBy(F.col("source").alias("p_source"), part.alias("p_part")).agg(F.count("*").alias("n"), F.sum("size").alias("words"), F.min("at").alias("first"))
    counts = written(counts.withColumn("before", F.sum("n").over(Window.partitionBy("p_source").orderBy("p_part")) - F.col("n")), "mix-counts")
    sizes = counts.groupBy(F.col("p_source").alias("source")).agg(F.sum("words").alias("source_size"))
    targets = source_targets(sizes, weights, cap).select(F.col("source").alias("t_source"), "source_size", "target")
    starts = counts.join(targets, F.col("p_source").eqNullSafe(F.col("t_source"))).select("p_source", "p_part", "first", "before", "source_size", "target")
    # a partition holds a contiguous range, so there are at most partitions + sources rows here
    joined = rows.join(F.broadcast(starts) if counts.count() <= BROADCAST_ROWS else starts, (part == F.col("p_part")) & F.col("source").eqNullSafe(F.col("p_source")))
    rank = F.col("before") + F.col("at") - F.col("first")
    each = F.coalesce(F.try_divide(F.col("target"), F.col("source_size").cast("double")), F.lit(0.0))
    start = offset(F.col("source"), seed)
    crossed = F.floor((rank + 1) * each + start) - F.floor(rank * each + start)
    return joined.select("row", "size", "source_size", "target", F.least(crossed, F.lit(cap)).cast("int").alias("copies"))


def mix(docs: DataFrame, source: str = "source", text: str = "text", weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, seed: int = 42) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as it is taken, possibly not at all.

    Null and empty texts count no words and are taken as often as others of their source;
    null sources form one source; repeated rows have copies of their own; an empty table
    gives an empty result. ``docs`` is read again for its texts, so it has to be a table,
    or a plan that gives the same rows each time.

    Only 128 bits of each row, its source and its size are ordered and written. The rows
    that are taken are then found by these bits, in one join. Rows that are equal in all
    columns have the same bits: one of them, the first that a task meets, stands for all.
    """
    one, two, n, taken, place = fresh(docs, "_one", "_two", "_n", "_taken", "_place")
    keyed = docs.withColumns({one: row_hash(docs), two: row_hash(docs, 1)})
    bits = F.col(one).alias("one"), F.col(two).alias("two")
    packed = keyed.select(F.struct(*bits).alias("row"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"), *bits)
    copies = _copies(packed, weights, cap, seed).groupBy("row").agg(F.count("*").alias(n), F.sum("copies").alias(taken)).where(F.col(taken) > 0)
    copies = written(copies.select(F.col("row.one").alias(f"{one}_b"), F.col("row.two").alias(f"{two}_b"), n, taken), "mix-copies")
    again = F.explode(F.sequence(F.lit(1), F.col(taken).cast("int"))).alias(n)

    def met(wanted: DataFrame) -> DataFrame:
        few = F.broadcast(wanted) if wanted.count() <= BROADCAST_ROWS else wanted
        return keyed.join(few, (F.col(one) == F.col(f"{one}_b")) & (F.col(two) == F.col(f"{two}_b")))

    out = met(copies.where(F.col(n) == 1)).select(*docs.columns, again).drop(n)
    several = copies.where(F.col(n) > 1)
    if several.isEmpty():
        return out
    first = met(several).withColumn(place, F.row_number().over(Window.partitionBy(one, two).orderBy(two))).where(F.col(place) == 1)
    return out.unionByName(first.select(*docs.columns, again).drop(n))


def unit_offset(source: str | None, seed: int) -> float:
    """The offset of a source computed without Spark, for checks."""
    return int(sha256(f"{seed}|{'n' if source is None else 's' + source}".encode()).hexdigest()[:8], 16) / float(1 << 32)
