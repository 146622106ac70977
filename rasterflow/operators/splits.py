"""Fractions, stratification, duplicates, subsamples and blocks.

Every seeded choice orders rows by md5 of (seed, scope, key), so it depends on neither
partitioning nor row order; ranks come from bucket counts, never from a single-task window.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.frames import digest_rank, fresh, ordered_rank, text_digest, value_rank, written
from .rules import random_rules

Targets = list[dict]


def fraction_boundaries(targets: Targets) -> list[tuple[str, float]]:
    """``(name, upper end)`` of each target's share of [0, 1]; targets without ``split`` share what is left."""
    given = [t.get("split") for t in targets]
    rest = 1 - sum(g for g in given if g is not None)
    if rest < -1e-9:
        raise ValueError("fractions add up to more than 1")
    each = rest / max(1, given.count(None))
    out, at = [], 0.0
    for t, g in zip(targets, given, strict=True):
        at += each if g is None else g
        out.append((t["target"], at))
    return out


def random_split(df: DataFrame, key: str, scope: str, targets: Targets, seed: int) -> DataFrame:
    """``df`` with ``target``: the first ``rint(fraction * n)`` rows of a seeded order, and so on.

    Fractions below 1 leave rows without a target.
    """
    rank, n = fresh(df, "_rank", "_n")
    ranked = digest_rank(df, f"{seed}|{scope}", F.col(key), out=rank).join(F.broadcast(df.agg(F.count("*").alias(n))), F.lit(True))
    target = None
    for name, upper in fraction_boundaries(targets):
        take = F.col(rank) <= F.rint(F.lit(upper) * F.col(n))
        target = F.when(take, name) if target is None else target.when(take, name)
    return ranked.withColumn("target", target).drop(rank, n)


def stratified_split(df: DataFrame, key: str, stratum: str, targets: Targets, seed: int) -> DataFrame:
    """``df`` with ``target``, each target drawn proportionally from every stratum.

    Targets are served in turn from what earlier ones left; a target's quota over the
    strata follows the largest remainders (ties by the stratum's digest), and the last
    target takes the rest. Every target needs ``split``. Strata may be as many as rows: they
    are a table of counts, whose totals are joined as one row and whose remainders are
    ranked by ranges.
    """
    if any("split" not in t for t in targets):
        raise ValueError("stratified targets need their split")
    bounds = fraction_boundaries(targets)
    # a row for each stratum from here on
    quotas = written(df.groupBy(F.col(stratum).alias("s")).agg(F.count("*").alias("left")).withColumn("before", F.lit(0).cast("long")), "strata")
    total = F.broadcast(quotas.agg(F.sum("left").alias("total")))
    parts, lower = [], 0.0
    for i, (name, upper) in enumerate(bounds):
        last = i == len(bounds) - 1 and upper > 1 - 1e-9
        sums = quotas.agg(F.sum("left").alias("all_left")).join(total, F.lit(True))
        want = F.col("all_left") if last else F.least(F.col("all_left"), F.rint((F.lit(upper) - F.lit(lower)) * F.col("total")).cast("long"))
        share = F.col("left") * F.col("want").cast("double") / F.greatest(F.lit(1), F.col("all_left")).cast("double")
        shared = quotas.join(F.broadcast(sums.withColumn("want", want)), F.lit(True)).withColumn("share", share)
        shared = written(shared.select("s", "left", "before", "want", F.floor("share").alias("base"), F.round(F.col("share") - F.floor("share"), 9).alias("rest")), "shares")
        more = F.broadcast(shared.agg((F.max("want") - F.sum("base")).alias("more")))  # those strata with the largest rests get one row more
        ranked = ordered_rank(shared, [F.desc("rest"), text_digest(seed, i, F.col("s"))], out="place").join(more, F.lit(True))
        quota = F.least(F.col("base") + (F.col("place") <= F.col("more")).cast("long"), F.col("left"))
        served = written(ranked.select("s", "left", "before", quota.alias("quota")), "quotas")
        parts.append(served.select("s", F.lit(name).alias("t"), F.col("before").alias("lo"), (F.col("before") + F.col("quota")).alias("hi")))
        quotas = served.select("s", (F.col("left") - F.col("quota")).alias("left"), (F.col("before") + F.col("quota")).alias("before"))
        lower = upper
    rank, s, t, lo, hi = fresh(df, "_rank", "_s", "_t", "_lo", "_hi")
    table = reduce(DataFrame.unionAll, parts).withColumnsRenamed({"s": s, "t": t, "lo": lo, "hi": hi})
    ranked = digest_rank(df, f"{seed}|strata", F.col(key), [stratum], rank)
    inside = F.col(stratum).eqNullSafe(F.col(s)) & (F.col(rank) > F.col(lo)) & (F.col(rank) <= F.col(hi))
    return ranked.join(table, inside, "left").select(*[F.col(f"`{c}`") for c in df.columns if c != "target"], F.col(t).alias("target"))


def apply_splits(split: DataFrame, rules: list[dict], seed: int, key: str = "path") -> DataFrame:
    """Random and stratified splits of all rules that ask for one; rows left without a target are dropped.

    ``split`` has ``target`` and ``rule_loc``. Rules with ``stratify_on`` (columns with
    optional ``bins``) split within strata of equal-width bins.
    """
    from .strata import bin_equal_width, merge_singletons, stratum_key

    wanted = sorted(random_rules(rules).items())
    plain = [(loc, r) for loc, r in wanted if "stratify_on" not in r]
    loc = F.concat_ws("-", F.transform("rule_loc", lambda i: i.cast("string")))
    strat = ["-".join(map(str, at)) for at, r in wanted if "stratify_on" in r]
    simple = split.where(F.col("target").isNotNull() | ~loc.isin(strat)) if strat else split
    # all unstratified rules in one pass: rank and count within the rule's rows
    ranked = digest_rank(simple.withColumn("_loc", F.when(F.col("target").isNull(), loc)), seed, F.concat_ws("|", loc, F.col(key)), ["_loc"], "_rank")
    counts = simple.where("target IS NULL").groupBy(loc.alias("_at")).agg(F.count("*").alias("_n"))
    rows = ranked.join(F.broadcast(counts.where(F.col("_at").isin(["-".join(map(str, at)) for at, _ in plain]))), F.col("_loc") == F.col("_at"), "left")
    target = F.when(F.col("target").isNotNull(), F.col("target"))
    for at, rule in plain:
        for name, upper in fraction_boundaries(rule["target"]):
            target = target.when((F.col("_at") == "-".join(map(str, at))) & (F.col("_rank") <= F.rint(F.lit(upper) * F.col("_n"))), name)
    done = rows.withColumn("target", target).select(*split.columns)
    for at, rule in wanted:
        if "stratify_on" not in rule:
            continue
        scope = "-".join(map(str, at))
        part = split.where(F.col("target").isNull() & (loc == scope)).drop("target")
        names = []
        for f in rule["stratify_on"]:
            column, bins = (f, None) if isinstance(f, str) else (f["column"], f.get("bins", f.get("n_bins")))
            names.append(f"strat_{scope}_{column}")
            part = bin_equal_width(part, column, bins, names[-1])
        part = stratum_key(merge_singletons(part, names), names, "_stratum")
        done = done.unionByName(stratified_split(part, key, "_stratum", rule["target"], seed).drop("_stratum", *names))
    return done.dropna(subset=["target"])


def drop_duplicates_by_split(df: DataFrame, key: str, order: list[str], target: str = "target") -> DataFrame:
    """For each named split in turn: its rows whose key occurs more than once among the rows still there go.

    All copies within one split go together. Counts for each key and split decide, so the
    rows are joined once, whatever the number of splits.
    """
    counts = df.groupBy(key).agg(F.count("*").alias("_all"), *[F.count(F.when(F.col(target) == t, 1)).alias(f"_n{i}") for i, t in enumerate(order)])
    left = F.col("_all")
    for i in range(len(order)):
        gone = (F.col(f"_n{i}") > 0) & (left > 1)
        counts = counts.withColumn(f"_drop{i}", gone)
        left = left - F.when(gone, F.col(f"_n{i}")).otherwise(0)
    drops = F.array_compact(F.array(*[F.when(F.col(f"_drop{i}"), F.lit(t)) for i, t in enumerate(order)]))
    bad = counts.select(F.col(key).alias("_key"), drops.alias("_splits")).where(F.size("_splits") > 0)
    joined = df.join(bad, df[key] == bad["_key"], "left")
    return joined.where(F.col("_splits").isNull() | ~F.coalesce(F.array_contains("_splits", F.col(target)), F.lit(False))).select(*df.columns)


def subsample(df: DataFrame, key: str, fractions: dict[str, float], seed: int, target: str = "target") -> DataFrame:
    """``rint(fraction * n)`` rows of each named target, by a seeded order; other targets stay whole."""
    if not fractions:
        return df
    pairs = F.create_map(*[F.lit(x) for p in fractions.items() for x in p])
    rank, n, t, most = fresh(df, "_rank", "_n", "_t", "_most")
    limits = df.groupBy(target).agg(F.count("*").alias(n)).select(F.col(target).alias(t), F.rint(F.try_element_at(pairs, F.col(target)) * F.col(n)).alias(most))
    ranked = digest_rank(df, f"{seed}|subsample", F.col(key), [target], rank)
    joined = ranked.join(limits, F.col(target).eqNullSafe(F.col(t)), "left")
    return joined.where(F.col(most).isNull() | (F.col(rank) <= F.col(most))).select(*[F.col(f"`{c}`") for c in df.columns])


def fraction_limit(df: DataFrame, key: str, fraction: float, seed: int) -> DataFrame:
    """The first ``rint(fraction * n)`` rows of a seeded order."""
    return random_split(df, key, "limit", [{"target": "kept", "split": fraction}], seed).where("target = 'kept'").drop("target")


def seeded_shuffle(df: DataFrame, key: str, seed: int) -> DataFrame:
    return df.orderBy(text_digest(seed, F.col(key)), key)


def swap_targets(df: DataFrame, a: str = "train", b: str = "val", target: str = "target") -> DataFrame:
    t = F.col(target)
    return df.withColumn(target, F.when(t == a, b).when(t == b, a).otherwise(t))


def assign_blocks(df: DataFrame, order: str | None, size: int, seed: int | None = None, key: str | None = None, out: str = "block_id") -> DataFrame:
    """Consecutive groups of ``size`` rows in the order of a column, or of a seeded shuffle by ``key``."""
    (rank,) = fresh(df, "_rank")
    ranked = value_rank(df, order, key or order, rank) if seed is None else digest_rank(df, seed, F.col(key), out=rank)
    return ranked.withColumn(out, F.floor((F.col(rank) - 1) / size).cast("long")).drop(rank)


def top_k_per_block(df: DataFrame, block: str, score: str, key: str, k: int) -> DataFrame:
    """The k best rows of each block; missing scores come last, ties by key. Blocks are of bounded size."""
    score_ = F.col(score)
    clean = F.when(~F.isnan(score_), score_) if df.schema[score].dataType.typeName() in ("double", "float") else score_
    order = Window.partitionBy(block).orderBy(clean.desc_nulls_last(), F.col(key))
    (place,) = fresh(df, "_place")
    return df.withColumn(place, F.row_number().over(order)).where(F.col(place) <= k).drop(place)


def block_size(factor: float, batches: int, batch: int) -> int:
    return round(factor * batches * batch)


def first_patches(tiles: DataFrame, path: str = "path", n: int = 6) -> DataFrame:
    """All tiles of the first ``n`` patches by path."""
    first = tiles.select(path).distinct().orderBy(path).limit(n)
    return tiles.join(F.broadcast(first), path, "left_semi")


def keep_listed(df: DataFrame, listed: DataFrame, key: str, order: Column | str) -> DataFrame:
    """Rows whose key is listed, in their own order."""
    return df.join(listed.select(key).distinct(), key, "left_semi").orderBy(order)
