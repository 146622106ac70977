"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints within ``radius`` bits of each other both lie within ``radius / 2`` of
some fingerprint between them. So each distinct fingerprint emits itself and all variants
with up to ``radius // 2`` bits flipped, variants are shuffled, and fingerprints that meet
in a variant are verified and linked.

Cost: copies of a fingerprint collapse before anything is emitted, so a variant's bucket
holds at most one row for each point of its ball (65 for radius 2), whatever the data. A
bucket gives links from its smallest member, never all pairs; members of one bucket are
within ``radius`` of each other, so no connection is lost. Components come from
alternating large-star and small-star steps over the links. In each, the nodes that change
are a written table, so the join that relabels links reads two plain tables and Spark can
split the links of a hub over many tasks. Texts go to Python and never come back: written
tables hold ids, digests and sketches.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, fresh, map_batches, written

SEED = 42
#: Hashes are summed in blocks of this many, so that a very long text needs little memory.
BLOCK = 1 << 16
#: MinHash values of a sketch, and those that form a band: at similarity 0.8 a pair shares a band with probability 0.9999.
PERMUTATIONS, BAND_ROWS = 120, 5
#: A candidate whose estimate lies this far below the similarity that is asked for is not compared (its standard error is 0.037 at 0.8).
HOPELESS = 0.2
#: Bands whose centres are tried first; in the others a centre is compared only with texts that these haven't joined to it.
FIRST_BANDS = 4
#: Levels of differences: the least part of them that a partner has to share, and the rows of a band.
LEVELS = ((0.4, 2), (0.55, 3), (0.7, 4), (0.85, 6), (0.95, 9))
#: Keys of texts are broadcast up to this many (about 50 bytes each), else shuffled.
BROADCAST_ROWS = 100_000


def text_fingerprint(text: str | None, width: int = 3, seed: int = SEED) -> int:
    """64-bit SimHash of the ``width``-word shingles of a text, repeats included.

    A-Z is lowered and words are runs of non-white-space ASCII. A text with fewer words
    than ``width`` has one shingle, the whole sequence; null, empty and blank texts have
    fingerprint zero. A bit is set if more than half of the shingles' XXH64 have it.
    """
    import numpy as np
    from xxhash import xxh64_intdigest

    words = (text or "").encode().lower().split()
    if not words:
        return 0
    width = min(width, len(words))
    n = len(words) - width + 1
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, n, BLOCK):
        part = words[at : min(at + BLOCK, n) + width - 1]
        hashes = np.array([xxh64_intdigest(b" ".join(x), seed) for x in zip(*(part[k:] for k in range(width)), strict=False)], dtype="<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > n, bitorder="little").tobytes(), "little")


def signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def from_text(docs: DataFrame, text: str, columns: str, f: Callable[[list], list], keep_text: bool = False) -> DataFrame:
    """``docs`` with what ``f`` makes of each batch of texts, in the order of ``columns``.

    The text itself comes back only if it is to be kept.
    """
    names = docs.columns
    at = names.index(text)
    back = [i for i in range(len(names)) if keep_text or i != at]
    new = [x.split()[0].strip("`") for x in columns.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in back), *f(b.column(at).to_pylist())], names=[*(names[i] for i in back), *new])

    fields = docs.schema.fields
    return map_batches(docs, run, ", ".join([*(f"`{fields[i].name}` {fields[i].dataType.simpleString()}" for i in back), columns]))


def fingerprints(docs: DataFrame, text: str = "text", width: int = 3, seed: int = SEED, out: str = "_fp", keep_text: bool = True) -> DataFrame:
    """``docs`` with the SimHash of ``text`` as a signed long in column ``out``; the text is dropped unless kept."""
    return from_text(docs, text, f"`{out}` long", lambda texts: [pa.array([signed(text_fingerprint(t, width, seed)) for t in texts], pa.int64())], keep_text)


def ball_links(distinct: DataFrame, fp: str = "fp", radius: int = 2) -> DataFrame:
    """Links ``(a, b)``, a < b, that join all distinct fingerprints within ``radius`` bits.

    Each link is a verified pair; pairs that share a smaller neighbour may be linked
    through it. Radius 0 or 1 emits no flipped bits and tests direct variants alone.
    """
    if radius < 0 or radius > 4:
        raise ValueError("radius must be 0 to 4")
    half = (radius + 1) // 2
    bits = [1 << b if b < 63 else -(1 << 63) for b in range(64)]
    masks = [0]
    for _ in range(half):
        masks = sorted({m ^ b for m in masks for b in [0, *bits]})
    # what crosses the shuffle is the variant and its flipped bits, which are nearly all zeros
    flipped = distinct.select(F.col(fp).alias("fp"), F.explode(F.array(*[F.lit(m).cast("long") for m in masks])).alias("m")).select(F.col("fp").bitwiseXOR(F.col("m")).alias("variant"), "m")
    variants = flipped.repartition("variant").select("variant", F.col("variant").bitwiseXOR(F.col("m")).alias("b"))
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius
    if radius % 2 == 0:  # members of a bucket are all within the radius: links from the smallest are enough
        pairs = variants.withColumn("a", F.min("b").over(Window.partitionBy("variant"))).where("a < b")
    else:  # some are not; a bucket has no more members than its ball has points
        members = variants.groupBy("variant").agg(F.array_sort(F.collect_set("b")).alias("members"))
        pairs = members.select("members", F.posexplode("members").alias("i", "a")).select("a", F.explode(F.expr("slice(members, i + 2, size(members))")).alias("b"))
    return pairs.where(near).select("a", "b").distinct()


def connected_components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """The written table ``(node, root)`` for every node of ``links(a, b)``; root is the smallest node reachable.

    Large-star and small-star in turn until nothing changes; each round is written to the
    shared folder. A large star moves the links of nodes that have a smaller neighbour to
    the smallest one; a small star joins the smaller neighbours of a node to the smallest.
    Only nodes that change are looked up, so a hub that is its own root stays as it is, and
    neighbourhoods are aggregated, never gathered.
    """
    edges = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "cc")

    def instead(new: DataFrame, *used: DataFrame) -> DataFrame:
        """``new`` as the written links, in place of the old ones, which go with what else was used for them."""
        table = written(new, "cc")
        for old in (edges, *used):
            discard(old)
        return table

    for _ in range(max_rounds):
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        inner = written(both.groupBy(F.col("u").alias("n")).agg(F.min("v").alias("m"), F.max("v").alias("x")).where("m < n and n < x").select("n", "m"), "cc-inner")
        moved = not inner.isEmpty()
        if moved:
            edges = instead(edges.join(inner, F.col("v") == F.col("n"), "left").select("u", F.coalesce("m", "v").alias("v")).distinct(), inner)
        several = written(edges.groupBy(F.col("u").alias("n")).agg(F.min("v").alias("m"), F.max("v").alias("x")).where("m < x").select("n", "m"), "cc-several")
        if several.isEmpty():
            if not moved:
                break
            continue
        found = edges.join(several, F.col("u") == F.col("n"), "left")
        small = found.select(F.when(F.col("m").isNull() | (F.col("v") == F.col("m")), F.col("u")).otherwise(F.col("v")).alias("u"), F.coalesce("m", "v").alias("v"))
        edges = instead(small.distinct(), several)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return instead(edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 3, radius: int = 2, seed: int = SEED, keep_text: bool = True) -> DataFrame:
    """``docs`` with ``fingerprint`` (16 hex digits) and ``component_id``.

    ``component_id`` is the smallest ``doc_id`` of all rows whose fingerprints can be
    reached by links of at most ``radius`` differing bits; null only if all of these ids
    are null. Null, empty and blank texts have fingerprint zero and are linked like any
    other. Repeated rows share a component and are all returned; an empty table gives an
    empty result. Other columns pass; those named like a result are replaced. Without
    ``keep_text`` the result lacks the texts, and none are written.
    """
    keep = docs.drop(*[c for c in docs.columns if c.lower() in ("fingerprint", "component_id")])
    (fp,) = fresh(keep, "_fp")
    rows = written(fingerprints(keep, text, width, seed, fp, keep_text), "simhash")
    return with_components(rows, doc_id, radius, fp, "component_id").withColumn("fingerprint", F.lower(F.lpad(F.hex(fp), 16, "0"))).drop(fp)


def with_components(rows: DataFrame, doc_id: str, radius: int, fp: str = "_fp", out: str = "_component") -> DataFrame:
    """``rows`` with the smallest id of their component in ``out``, from the fingerprints in ``fp``."""
    distinct = written(rows.groupBy(F.col(fp).alias("fp")).agg(F.min(doc_id).alias("first")), "fingerprints")
    roots = connected_components(ball_links(distinct, "fp", radius))
    rooted = written(distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root")), "rooted")
    smallest = written(rooted.groupBy("root").agg(F.min("first").alias("smallest")), "smallest")
    (key,) = fresh(rows, "_key")
    labels = written(rooted.join(smallest, "root").select(F.col("fp").alias(key), F.col("smallest").alias(out)), "components")
    return rows.join(labels, rows[fp] == labels[key]).drop(key)


def text_sketch(text: str | None, width: int, seed: int = SEED) -> tuple[bytes, list[int]]:
    """``PERMUTATIONS`` MinHash values of a text's word shingles (32 bits each), and a hash of each band of them."""
    import numpy as np
    from xxhash import xxh3_64_intdigest

    words = (text or "").encode().lower().split()
    width = max(1, min(width, len(words)))
    n = len(words) - width + 1
    factors, terms = permutations(seed)
    least = np.full(PERMUTATIONS, 2**64 - 1, np.uint64)
    for at in range(0, n, 1024):
        part = words[at : min(at + 1024, n) + width - 1]
        hashes = np.array([xxh3_64_intdigest(b" ".join(x)) for x in zip(*(part[k:] for k in range(width)), strict=False)], np.uint64)
        np.minimum(least, (np.unique(hashes) * factors + terms).min(axis=1), out=least)
    values = (least >> np.uint64(32)).astype("<u4")
    bands = values.reshape(-1, BAND_ROWS)
    return values.tobytes(), [xxh3_64_intdigest(b.tobytes(), k) - (1 << 63) for k, b in enumerate(bands)]


@lru_cache(maxsize=2)
def permutations(seed: int):
    import numpy as np

    draw = np.random.default_rng(seed)
    size = (PERMUTATIONS, 1)
    return draw.integers(0, 2**64, size, np.uint64, endpoint=False) | np.uint64(1), draw.integers(0, 2**64, size, np.uint64, endpoint=False)


def with_sketch(docs: DataFrame, text: str, width: int, seed: int, fp: str, values: str, bands: str) -> DataFrame:
    """``docs`` without ``text``, with its fingerprint, MinHash values and bands."""

    def work(texts: list) -> list:
        found = [(signed(text_fingerprint(t, width, seed)), *text_sketch(t, width, seed)) for t in texts]
        return [pa.array([x[k] for x in found], t) for k, t in enumerate((pa.int64(), pa.binary(), pa.list_(pa.int64())))]

    return from_text(docs, text, f"`{fp}` long, `{values}` binary, `{bands}` array<long>", work)


def text_key(text: Column) -> Column:
    """128 bits of a text, null as the empty one: equal texts have equal keys."""
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def similar_components(sketches: DataFrame, radius: int, verify: Callable[[DataFrame], DataFrame], ready: Callable[[DataFrame], None], meet: Callable[[DataFrame], list[Callable[[DataFrame], DataFrame]]]) -> DataFrame:
    """``(node, root)`` of ``sketches(node, fp, bands)``, joined by the candidates that ``verify`` keeps.

    Candidates are fingerprints that ball hashing brings together and texts that share a
    band. Every similar pair of a band's bucket is compared or has been connected by
    others. First each bucket proposes its members with one centre, drawn anew for each
    band, in ``FIRST_BANDS`` and then in all bands, which joins a group of any size at a
    pair for each member and band. The members of buckets that still hold several
    components then go to ``meet``, which proposes pairs of different components that can be
    similar, step by step, see :func:`rare_pairs`. ``ready`` gets the nodes that any candidate may
    name, before the first is verified.
    """
    first = written(sketches.groupBy("fp").agg(F.min("node").alias("rep")), "first")
    same = sketches.join(first, "fp").where("node <> rep").select(F.col("rep").alias("a"), F.col("node").alias("b"))
    near = ball_links(first, "fp", radius)
    one, two = first.select(F.col("fp").alias("a"), F.col("rep").alias("x")), first.select(F.col("fp").alias("b"), F.col("rep").alias("y"))
    balls = written(near.join(one, "a").join(two, "b").select(F.col("x").alias("a"), F.col("y").alias("b")).union(same), "balls")
    spread = sketches.select("node", F.posexplode("bands").alias("band", "hash"))
    mixed = F.struct(F.xxhash64("band", "node"), "node")  # a different order of nodes in each band
    centres = written(spread.groupBy("band", "hash").agg(F.count("*").alias("n"), F.min(mixed).alias("least")).where("n > 1").select("band", "hash", F.col("least.node").alias("a")), "centres")
    shared = written(spread.join(centres, ["band", "hash"]), "buckets")
    banded = shared.where("a <> node").select("band", "a", F.col("node").alias("b"))
    ready(shared.select("node").union(balls.select(F.col("a").alias("node"))).union(balls.select("b")).distinct())
    roots: DataFrame | None = None
    seen: list[DataFrame] = []

    def join(pairs: DataFrame) -> None:
        """Verifies pairs that were not met before, and joins components by them."""
        nonlocal roots
        new = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        for met in seen:
            new = new.join(met, ["a", "b"], "left_anti")
        pairs = written(new, "candidates")
        seen.append(pairs)
        found = verify(pairs)
        roots = connected_components(found if roots is None else found.union(roots.select(F.col("node").alias("a"), F.col("root").alias("b"))))

    def rooted(members: DataFrame) -> DataFrame:
        return members.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))

    join(balls.union(banded.where(F.col("band") < FIRST_BANDS).select("a", "b")))
    of = roots.select(F.col("node").alias("a"), F.col("root").alias("p")), roots.select(F.col("node").alias("b"), F.col("root").alias("q"))
    rest = banded.where(F.col("band") >= FIRST_BANDS).select("a", "b").distinct().join(of[0], "a", "left").join(of[1], "b", "left")
    join(rest.where(F.coalesce("p", "a") != F.coalesce("q", "b")).select("a", "b"))
    own = rooted(shared.select("band", "hash", "node"))
    several = written(own.groupBy("band", "hash").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("band", "hash"), "several")
    if several.isEmpty():
        return roots
    held = written(own.join(several, ["band", "hash"]).select("band", "hash", "node"), "held")
    # texts that share buckets, directly or through others, are a cluster
    first = held.groupBy("band", "hash").agg(F.min("node").alias("b"))
    clusters = connected_components(held.join(first, ["band", "hash"]).select(F.col("node").alias("a"), "b").distinct())
    apart = written(clusters.select("node", F.col("root").alias("cluster")), "apart")
    for propose in meet(apart):
        join(propose(written(rooted(apart.select("node")), "apart-roots")))
    return roots


def rare_pairs(members: DataFrame, sets: DataFrame, similarity: float, seed: int = SEED) -> list[Callable[[DataFrame], DataFrame]]:
    """What proposes pairs ``(a, b)`` of ``members(node, cluster)`` that can share ``similarity`` of their shingles.

    Each of the results takes ``(node, root)`` of the members and proposes pairs of one
    cluster and different roots; roots are to be found anew after each.

    First: shingles are ordered from the rarest in the cluster to the most frequent. Two
    sets of n shingles that are similar enough have one in common among their first
    ``n - ceil(similarity * n) + 1``. In each of these each member meets the one that has
    the fewest rarer shingles of its own. A text from which many others were made by edits
    is such a one; it joins them at a pair for each.

    Second and third: members are compared by what sets them apart from their cluster, so
    that edits of one text that are too far from each other don't meet, whether that text is
    in the table or not, see :func:`difference_keys`. What a member differs in bounds whom it
    can be similar to; members that no other root of the cluster can hold a partner of have no
    keys, so the texts around the middle that are one root already, and those too far from
    it, go no further. In each bucket of keys the others meet one of them, and then, outside
    the largest root of the cluster, all. Only members that lie close to the middle of their
    cluster, and have little to be told by, meet the rest in rare shingles again.
    """

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for b in batches:
            for node, cluster, n, raw in zip(*(b.column(i) for i in range(4)), strict=True):
                hashes = np.frombuffer(raw.as_buffer(), "<i8")
                for at in range(0, len(hashes), BLOCK):
                    part = hashes[at : at + BLOCK]
                    yield pa.RecordBatch.from_arrays([*(pa.array([x.as_py()] * len(part), pa.int64()) for x in (node, cluster, n)), pa.array(part)], names=["node", "cluster", "n", "hash"])

    tokens = written(map_batches(sets.join(members, "node").select("node", "cluster", "n", "hashes"), spread, "node long, cluster long, n long, hash long"), "tokens")
    often = written(tokens.groupBy("cluster", "hash").agg(F.count("*").alias("times")).where("times > 1"), "often")
    order = Window.partitionBy("node").orderBy(F.desc("times"), F.desc("hash"))  # places count from the end, where the frequent ones are
    placed = tokens.join(often, ["cluster", "hash"]).withColumn("place", F.col("n") + 1 - F.row_number().over(order))
    rare = written(placed.where(F.col("place") <= F.col("n") - F.ceil(F.lit(similarity) * F.col("n") - 1e-9) + 1).select("cluster", "hash", "node", "n", "place"), "rare")
    shared = F.lit(similarity / (1 + similarity)) * (F.col("n") + F.col("n_b")) - 1e-9  # shingles in common that are needed
    can = (F.least("n", "n_b") >= F.lit(similarity) * F.greatest("n", "n_b") - 1e-9) & (F.least(F.col("n") - F.col("place"), F.col("n_b") - F.col("place_b")) + 1 >= shared)
    columns = ("node", "root", "n", "place")

    def meeting(keys: DataFrame, others: DataFrame, also: Column | bool = True) -> DataFrame:
        return keys.join(others, ["cluster", "hash"]).where((F.col("root") != F.col("root_b")) & can & also).select(F.col("node").alias("a"), F.col("node_b").alias("b")).distinct()

    def first_few(roots: DataFrame) -> DataFrame:
        keys = written(rare.join(roots, "node"), "rare-rooted")
        least = F.min(F.struct(F.col("place") / F.col("n"), F.xxhash64("hash", "node"), *columns))
        centre = keys.groupBy("cluster", "hash").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), least.alias("x")).where("lo < hi")
        return meeting(keys, written(centre.select("cluster", "hash", *[F.col(f"x.{c}").alias(f"{c}_b") for c in columns]), "rare-centres"))

    made: list[DataFrame] = []

    def differences() -> DataFrame:
        """What :func:`difference_keys` tells of each member."""
        if not made:
            sizes = members.groupBy("cluster").agg(F.count("*").alias("members"))
            most = often.join(sizes, "cluster").where("2 * times > members").select("cluster", "hash", (F.col("times") <= F.col("members") - 2).alias("told"))
            most = written(most.groupBy("cluster").agg(F.collect_list("hash").alias("middle"), F.collect_list("told").alias("told")), "middles")  # no more than twice the shingles of a text
            found = tokens.join(often, ["cluster", "hash"]).groupBy("node", "cluster").agg(F.first("n").alias("n"), F.collect_list("hash").alias("hashes"))  # no more than a text has
            whole = found.join(most, "cluster", "left").select("node", "cluster", "n", "hashes", "middle", "told")
            made.append(written(map_batches(whole, lambda batches: difference_keys(batches, similarity, seed), "node long, cluster long, off double, reach double, own int, keys array<struct<level: int, key: long>>"), "difference-keys"))
        return made[0]

    bucket = ["cluster", "level", "key"]
    facts = ("node", "root", "own", "off", "reach")
    meets = (F.col("off") <= F.col("reach_b") + 1e-9) & (F.col("off_b") <= F.col("reach") + 1e-9)

    def rooted(roots: DataFrame) -> DataFrame:
        return written(differences().select("cluster", "node", "own", "off", "reach").join(roots, "node"), "difference-rooted")

    def able(places: DataFrame) -> DataFrame:
        """The rows of ``places`` that some row of their cluster with another root may be similar to."""
        # on this scale a cluster has some hundreds of cells, whatever its size
        cell = F.signum("off") * F.floor(F.log1p(F.abs("off")) * 32)
        cells = places.groupBy("cluster", cell.alias("cell")).agg(F.min("off").alias("off"), F.max("reach").alias("reach"), F.min("root").alias("lo"), F.max("root").alias("hi"))
        cells = written(cells.groupBy("cluster").agg(F.collect_list(F.struct("off", "reach", "lo", "hi")).alias("cells")), "difference-cells")
        open_to = F.exists("cells", lambda c: (c.off <= F.col("reach") + 1e-9) & (F.col("off") <= c.reach + 1e-9) & ((c.lo != F.col("root")) | (c.hi != F.col("root"))))
        return written(places.join(cells, "cluster").where(open_to).drop("cells"), "difference-able")

    def with_keys(some: DataFrame) -> DataFrame:
        """A row for each key of the members ``some``."""
        some = some.where("own > 0")
        return written(some.join(differences().select("node", "keys"), "node").select(*some.columns, F.inline("keys")), "difference-buckets")

    def by_centres(roots: DataFrame) -> DataFrame:
        places = rooted(roots)
        keys = with_keys(able(places))
        one = F.min(F.struct(F.xxhash64("key", "node"), *facts)).alias("x")
        centre = keys.groupBy(*bucket).agg(F.min("root").alias("lo"), F.max("root").alias("hi"), one).where("lo < hi")
        centre = written(centre.select(*bucket, *[F.col(f"x.{c}").alias(f"{c}_b") for c in facts]), "difference-centres")
        apart = keys.join(centre, bucket).where((F.least("own", "own_b") == F.col("level")) & (F.col("root") != F.col("root_b")) & meets)
        closest = places.groupBy("cluster").agg(F.min(F.struct("off", "node", "root")).alias("x")).select("cluster", *[F.col(f"x.{c}").alias(f"{c}_b") for c in ("off", "node", "root")])
        # so close to the middle, together, that they are surely similar
        near = places.join(closest, "cluster").where((F.col("root") != F.col("root_b")) & (F.col("off") + F.col("off_b") <= 1e-9))
        return apart.select(F.col("node").alias("a"), F.col("node_b").alias("b")).union(near.select("node", "node_b")).distinct()

    def all_left(roots: DataFrame) -> DataFrame:
        left = able(rooted(roots))
        # of two roots one isn't the largest: members of the largest don't meet each other
        largest = left.groupBy("cluster", "root").agg(F.count("*").alias("times")).groupBy("cluster").agg(F.max(F.struct("times", "root")).alias("x"))
        keys = with_keys(left.join(largest, "cluster").select("cluster", *facts, (F.col("root") == F.col("x.root")).alias("main")))
        again = keys.withColumnsRenamed({c: f"{c}_b" for c in (*facts, "main")})
        # pairs meet at the lower one's level
        apart = keys.where("not main").join(again, bucket).where((F.least("own", "own_b") == F.col("level")) & (F.col("main_b") | (F.col("node") < F.col("node_b"))) & (F.col("root") != F.col("root_b")) & meets)
        ends = rare.join(left.select(*facts), "node")
        rest = ends.withColumnsRenamed({c: f"{c}_b" for c in (*columns, "own", "off", "reach")})
        return apart.select(F.col("node").alias("a"), F.col("node_b").alias("b")).union(meeting(ends.where("own = 0"), rest, meets)).distinct()

    return [first_few, by_centres, all_left]


def difference_keys(batches: Iterator[pa.RecordBatch], similarity: float, seed: int) -> Iterator[pa.RecordBatch]:
    """``(node, cluster, off, reach, own, keys)`` from ``(node, cluster, n, hashes, middle, told)``.

    The middle of a cluster are the shingles that most of its members have. Let d be the
    number of shingles in which a text differs from it. Texts a and b of n and m shingles
    that are ``similarity`` t alike differ in no more than ``(n + m) (1 - t) / (1 + t)``, so
    they share half of ``d(a) + d(b)`` less this of their differences from the middle: half
    of the sum of ``off = d - n (1 - t) / (1 + t)``. A difference that no other member has
    can't be shared. With s that can be, and ``off >= q s`` in both, the two sets of
    differences are alike at least ``q / (2 - q)``. So each text has a level by its q, and
    bands of MinHash values of its differences for its own level and all below; a pair
    meets at the lower level of the two with probability 0.9999. At level 0 nothing is
    known of what is shared; there are no keys for it.

    Differences that can't be shared, p, all tell a pair apart, as do at least
    ``|s(a) - s(b)|`` of the others. So a pair can be similar only if ``p(a) + p(b) +
    |s(a) - s(b)|`` is no more than the bound above: if neither ``off``, which is ``s + p -
    n (1 - t) / (1 + t)``, is above the other's ``reach = s - p + n (1 - t) / (1 + t)``.

    ``hashes`` are the shingles that some other member has too, ``n`` the number of all.
    Without a middle the texts themselves are compared.
    """
    import numpy as np
    from xxhash import xxh3_64_intdigest

    plan = [(q, rows, math.ceil(math.log(1e-4) / math.log1p(-((q / (2 - q)) ** rows)))) for q, rows in LEVELS]
    count = max(r * b for _, r, b in plan)
    draw = np.random.default_rng(seed + 1)
    factors, terms = (draw.integers(0, 2**64, (count, 1), np.uint64, endpoint=False) for _ in range(2))
    factors |= np.uint64(1)
    counts = np.array([bands for _, _, bands in plan], np.int32)
    for batch in batches:
        offs, reaches, owns, ends, keys = [], [], [], [0], []
        for i in range(batch.num_rows):
            n = batch.column(2)[i].as_py()
            hashes, middle = (batch.column(k)[i].values for k in (3, 4))
            hashes = hashes.to_numpy().view(np.uint64)
            middle = np.empty(0, np.uint64) if middle is None else middle.to_numpy().view(np.uint64)
            told = np.array(batch.column(5)[i].as_py() or [], bool)
            absent = ~np.isin(middle, hashes)
            more = np.setdiff1d(hashes, middle)
            differs = np.concatenate([more, ~middle[absent & told]])
            alone, allowed = n - len(hashes) + int((absent & ~told).sum()), n * (1 - similarity) / (1 + similarity)
            off = len(differs) + alone - allowed
            own = sum(off >= q * len(differs) for q, _, _ in plan) if len(differs) and off > 0 else 0
            if own:
                least = np.full(count, 2**64 - 1, np.uint64)
                for at in range(0, len(differs), 128):
                    np.minimum(least, (differs[at : at + 128] * factors + terms).min(axis=1), out=least)
                least >>= np.uint64(32)
                keys.append(np.array([xxh3_64_intdigest(least[j * r : (j + 1) * r].tobytes(), j) - (1 << 63) for _, r, bands in plan[:own] for j in range(bands)], np.int64))
            ends.append(ends[-1] + int(counts[:own].sum()))
            if off > 0 and not len(differs):
                own = -1  # nothing that it could share: no partner but near the middle
            offs.append(off)
            reaches.append(len(differs) - alone + allowed)
            owns.append(own)
        levels = [np.repeat(np.arange(1, own + 1, dtype=np.int32), counts[:own]) for own in owns if own > 0]
        flat = pa.StructArray.from_arrays([pa.array(np.concatenate([np.empty(0, np.int32), *levels])), pa.array(np.concatenate([np.empty(0, np.int64), *keys]))], names=["level", "key"])
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(offs, pa.float64()), pa.array(reaches, pa.float64()), pa.array(owns, pa.int32()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)], names=["node", "cluster", "off", "reach", "own", "keys"])


def hopeful(pairs: DataFrame, sketches: DataFrame, least: float) -> DataFrame:
    """The ``pairs(a, b)`` whose sketches agree in ``least`` of their values."""
    left, right = sketches.select(F.col("node").alias("a"), F.col("mins").alias("p")), sketches.select(F.col("node").alias("b"), F.col("mins").alias("q"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for b in batches:
            p, q = (np.frombuffer(b"".join(b.column(i).to_pylist()), "<u4").reshape(-1, PERMUTATIONS) for i in (2, 3))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array((p == q).mean(axis=1) >= least))

    return map_batches(pairs.join(left, "a").join(right, "b").select("a", "b", "p", "q"), compare, "a long, b long")


def shingle_hashes(text: str | None, width: int):
    """The distinct 64-bit hashes of a text's word shingles, ascending."""
    import numpy as np
    from xxhash import xxh3_64_intdigest

    words = (text or "").encode().lower().split()
    width = max(1, min(width, len(words)))
    n = len(words) - width + 1
    parts = [np.empty(0, np.uint64)]
    for at in range(0, n, BLOCK):
        part = words[at : min(at + BLOCK, n) + width - 1]
        parts.append(np.unique(np.array([xxh3_64_intdigest(b" ".join(x)) for x in zip(*(part[k:] for k in range(width)), strict=False)], np.uint64)))
    return np.unique(np.concatenate(parts))


def similar(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The ``pairs(a, b)`` of ``sets(node, n, hashes)`` that share at least ``similarity`` of their distinct shingles."""
    sizes = sets.select("node", "n")
    sized = pairs.join(sizes.select(F.col("node").alias("a"), F.col("n").alias("n_a")), "a").join(sizes.select(F.col("node").alias("b"), F.col("n").alias("n_b")), "b")
    # sets of too different sizes can't be similar
    able = sized.where(F.least("n_a", "n_b") >= F.lit(similarity) * F.greatest("n_a", "n_b")).select("a", "b")
    left, right = sets.select(F.col("node").alias("a"), F.col("hashes").alias("s")), sets.select(F.col("node").alias("b"), F.col("hashes").alias("t"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for b in batches:
            keep = []
            for s, t in zip(b.column(2), b.column(3), strict=True):
                p, q = np.frombuffer(s.as_buffer(), "<u8"), np.frombuffer(t.as_buffer(), "<u8")
                both = len(np.intersect1d(p, q, assume_unique=True))
                keep.append(both >= similarity * (len(p) + len(q) - both))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return map_batches(able.join(left, "a").join(right, "b").select("a", "b", "s", "t"), compare, "a long, b long")


def shingle_sets(texts: DataFrame, width: int) -> DataFrame:
    """``(node, n, hashes)`` of ``texts(node, text)``: the number of distinct shingles and their hashes, little-endian."""

    def work(texts: list) -> list:
        found = [shingle_hashes(t, width) for t in texts]
        return [pa.array(map(len, found), pa.int64()), pa.array([x.astype("<u8").tobytes() for x in found], pa.binary())]

    return from_text(texts, "text", "n long, hashes binary", work)


def deduplicate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 5, radius: int = 2, similarity: float = 0.8, seed: int = SEED) -> DataFrame:
    """One row of each group of near-duplicates, with the columns of ``docs``.

    Near-duplicates share at least ``similarity`` of their ``width``-word shingles. Texts at
    that similarity differ in many more bits of a fingerprint than ball hashing can span,
    so MinHash bands propose candidates beside it. The MinHash values only discard
    candidates whose estimate lies ``HOPELESS`` or more below; the distinct shingles of the
    others are compared exactly. The row with the smallest ``doc_id`` stays (null last; of
    rows with equal ids the one with the smallest digest of its text). Equal texts are told
    by 128 bits. Null and empty texts are equal, and texts without words are duplicates of
    each other by definition. Of rows repeated with id and text any one stays, whole. An
    empty table gives an empty result. ``docs`` is read again for its texts, so it has to
    be a table, or a plan that gives the same rows each time.
    """
    (key,) = fresh(docs, "_text_key")
    keyed = docs.withColumn(key, text_key(F.col(text)))
    mine = F.col(doc_id)
    ids = written(with_sketch(keyed.select(mine.isNull().alias("none"), mine.alias("id"), F.col(key).alias("key"), F.col(text).alias("text")), "text", width, seed, "fp", "mins", "bands"), "simhash")
    # copies collapse: what follows works on different texts
    texts = ids.groupBy("key").agg(F.first("fp").alias("fp"), F.first("mins").alias("mins"), F.first("bands").alias("bands"))
    sketches = written(texts.withColumn("node", F.monotonically_increasing_id()), "sketches")
    sets: list[DataFrame] = []

    def ready(nodes: DataFrame) -> None:
        """Shingles of the texts that candidates may name."""
        wanted = few(written(sketches.join(nodes, "node").select("key", "node"), "wanted"))
        found = keyed.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text")).join(wanted, "key")
        once = found.groupBy("node").agg(F.first("text").alias("text"))
        sets.append(written(shingle_sets(once, width), "shingles"))

    def verify(pairs: DataFrame) -> DataFrame:
        return similar(written(hopeful(pairs, sketches, similarity - HOPELESS), "hopeful"), sets[0], similarity)

    roots = similar_components(sketches, radius, verify, ready, lambda members: rare_pairs(members, sets[0], similarity, seed))
    labels = written(sketches.select("key", "node").join(roots, "node", "left").select("key", F.coalesce("root", "node").alias("root")), "labels")
    rows = ids.groupBy("none", "id", "key").agg(F.count("*").alias("n"))
    grouped = written(rows.join(labels, "key"), "grouped")
    first = written(grouped.groupBy("root").agg(F.min(F.struct("none", "id", "key")).alias("x")).select("root", F.col("x.id").alias("i"), F.col("x.key").alias("k")), "kept")
    kept = grouped.join(first, "root").withColumn("stays", F.col("id").eqNullSafe(F.col("i")) & (F.col("key") == F.col("k")))
    drop = written(kept.where("not stays or n > 1").select(F.col("id").alias("_i"), F.col("key").alias("_k"), (F.col("stays") & (F.col("n") > 1)).alias("_again")), "simhash-gone")
    same = lambda other: mine.eqNullSafe(other["_i"]) & (F.col(key) == other["_k"])
    gone = few(drop)
    out = keyed.join(gone, same(gone), "left_anti").drop(key)
    again = few(drop.where("_again"))
    if again.isEmpty():
        return out
    # rows repeated with id and text: one of each
    repeated = keyed.join(again, same(again), "left_semi").groupBy(mine, key).agg(F.first(F.struct(*[F.col(f"`{c}`") for c in docs.columns])).alias("row"))
    return out.unionByName(repeated.select("row.*"))


def few(table: DataFrame) -> DataFrame:
    """A written table of keys, to be broadcast while it is counted as small."""
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table
