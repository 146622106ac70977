from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from rasterflow.functions.frames import placed
from rasterflow.llm import mixing, queries


def slow_targets(sizes, weights=(5, 2, 1), cap=3):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, held = sum(sizes.values()), set()
    while True:
        free = [s for s in order if s not in held]
        if not free:
            return {s: float(cap * sizes[s]) for s in order}
        level = (total - sum(cap * sizes[s] for s in held)) / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > cap * sizes[s]}
        if not over:
            return {s: float(cap * sizes[s]) if s in held else level * weight[s] for s in order}
        held |= over


def test_query_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    size = {d.doc_id: len((d.text or "").encode().split()) for d in docs}
    sizes = Counter()
    for d in docs:
        sizes[d.source] += size[d.doc_id]
    want = slow_targets(sizes)
    got = queries.op3_mixing(spark, sf).collect()
    assert {r.doc_id: r.size for r in got} == size
    taken = Counter()
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        assert r.taken in {k * r.size for k in range(4)}
        taken[r.source] += r.taken
    for s in sizes:
        assert abs(taken[s] - want[s]) <= max(size[d.doc_id] for d in docs if d.source == s)
    assert sum(want.values()) == pytest.approx(sum(sizes.values()))
    assert sorted(map(tuple, got)) == sorted(map(tuple, queries.op3_mixing(spark, sf).collect()))


def test_copies_follow_the_prefix_sums(spark):
    rows = [(i, f"s{i % 7}", (i * i) % 50) for i in range(3000)] + [(9000 + i, "tiny", 1) for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, words long").repartition(7)
    got = mixing.mix_copies(docs, size=F.col("words")).collect()
    by = defaultdict(list)
    for r in got:
        by[r.source].append(r)
    want = slow_targets({s: sum(r.words for r in v) for s, v in by.items()})
    for s, v in by.items():
        each, u = want[s] / max(1, v[0]._source_size), mixing.unit_offset(s, 42)
        v.sort(key=lambda r: r._size)
        n = len(v)
        assert sum(r._copies for r in v) == int(n * each + u) - int(u)
        assert abs(sum(r._copies * r._size for r in v) - want[s]) <= 50
        assert max(r._copies for r in v) <= 3
    assert want["tiny"] == 15.0 and {r._copies for r in by["tiny"]} == {3}


def test_odd_rows(odd, none):
    got = mixing.mix_copies(odd).collect()
    assert len(got) == odd.count()
    assert all(r._size == len((r.text or "").encode().split()) for r in got)
    assert {r._target for r in got if r.source is None} == {0.0}
    mixed = mixing.mix(odd)
    assert mixed.columns == odd.columns and {r._copy for r in mixed.collect()} == {9}
    assert mixed.count() == sum(r._copies for r in got)
    assert mixing.mix_copies(none).count() == 0 and mixing.mix(none).count() == 0


def test_equal_rows_are_dealt_and_mixed(spark):
    """A third of all rows are one row, of one source with half of all: no range is crowded, and the mix takes what the copies say."""
    rows = [(1, "same text here", "hot") if i % 3 == 0 else (i, f"text {i} " * (i % 7), "hot" if i % 2 else "cold") for i in range(9000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(6)
    packed = docs.select(F.struct("doc_id").alias("row"), "source", F.lit(3).alias("size"))
    sizes = [r["count"] for r in placed(packed, ["source", "size"], place="at").groupBy(F.shiftright("at", 33)).count().collect()]
    assert sum(sizes) == 9000 and max(sizes) <= 2 * 9000 / 4
    copies = Counter()
    for r in mixing.mix_copies(docs).collect():
        copies[r.doc_id, r.text, r.source] += r._copies
    mixed = mixing.mix(docs)
    assert Counter(map(tuple, mixed.collect())) == +copies
    assert mixed.columns == docs.columns
