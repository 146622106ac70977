import math
import random
import re
import zlib
from hashlib import sha256

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from rasterflow.llm import importance, queries
from tests.helpers import duckdb_rows, spark_rows

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def grams(text, longest=3):
    w = WORD.findall((text or "").translate(LOWER))
    return w, [" ".join(w[k : k + n]).encode() for n in range(1, longest + 1) for k in range(len(w) - n + 1)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="aB1é юÜ .\n", max_size=60), max_size=6), st.integers(1, 4))
def test_prefixes_give_the_crc_of_every_gram(texts, longest):
    crcs, owner = importance.gram_crcs([importance.WORD.findall(t.encode().lower()) for t in texts], longest)
    for k, t in enumerate(texts):
        assert sorted(crcs[owner == k].tolist()) == sorted(zlib.crc32(g) for g in grams(t, longest)[1])


def test_shift_is_appending_zeros():
    draw = random.Random(3)
    n = np.array([draw.choice([0, 1, 2, 7, 255, 256, 70_000]) for _ in range(50)], np.int64)
    a = [draw.randbytes(9) for _ in n]
    b = [draw.randbytes(int(k)) for k in n]
    whole = np.array([zlib.crc32(x + y) for x, y in zip(a, b, strict=True)], np.uint32)
    assert (whole ^ importance.shifted(np.array([zlib.crc32(x) for x in a], np.uint32), n) == np.array([zlib.crc32(y) for y in b], np.uint32)).all()
    assert (importance.space_after(np.array([zlib.crc32(x) for x in a], np.uint32)) == np.array([zlib.crc32(x + b" ") for x in a], np.uint32)).all()


def slow(docs, target, percent=5, least=20, buckets=10_000):
    def count(texts):
        out = np.zeros(buckets, int)
        for t in texts:
            for g in grams(t)[1]:
                out[zlib.crc32(g) % buckets] += 1
        return out

    s, t = count(x for _, x in docs), count(target)
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s.sum() + buckets) / ((s[b] + 1) * (t.sum() + buckets)))) for b in range(buckets)]
    rows = []
    for i, text in docs:
        w, g = grams(text)
        h = int(sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[zlib.crc32(x) % buckets] for x in g)
        rows.append((i, len(w), len(g), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))))
    able = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    ranks = [(r[:1] + r[2:], k + 1) for k, r in enumerate(able[: percent * len(able) // 100])]
    return rows, ranks


def test_against_brute_force(spark):
    draw = random.Random(5)
    vocabulary = ["a", "b", "The", "é", "x1", "юг", "w" * 300]
    docs = [(k if k % 9 else None, " ".join(draw.choices(vocabulary, k=draw.choice([0, 1, 2, 19, 20, 40, 90])))) for k in range(400)]
    docs += [(5, docs[4][1])] * 60 + [(None, None)]
    target = [" ".join(draw.choices(vocabulary[:3], k=30)) for _ in range(20)] + [None, ""]
    table = spark.createDataFrame(docs, "doc_id long, text string").repartition(6)
    got = importance.resample(table, spark.createDataFrame([(t,) for t in target], "text string"), percent=20).collect()
    rows, ranks = slow(docs, target, percent=20)
    assert sorted(((r.doc_id, r.n_words, r.n_features, r.weight, r.score) for r in got), key=repr) == sorted(rows, key=repr)
    drawn = sorted((r for r in got if r["rank"]), key=lambda r: r["rank"])
    assert [r["rank"] for r in drawn] == list(range(1, len(ranks) + 1))
    assert [(r.score, r.doc_id) for r in drawn] == [(x[3], x[0]) for x, _ in ranks]


def test_query_against_sql(spark, sf):
    assert spark_rows(queries.op13_importance(spark, sf)) == duckdb_rows(queries.ORACLE_SQL["op13_importance"], sf)


def test_odd_rows(spark, odd, none):
    target = spark.createDataFrame([("one two",), (None,)], "text string")
    got = importance.resample(odd, target)
    kept = [c for c in odd.columns if c not in ("text", "score")]
    assert got.columns == [*kept, "n_words", "n_features", "weight", "score", "rank"] and got.count() == odd.count()
    assert {r.weight for r in got.collect() if r.n_words == 0} == {0}
    assert importance.resample(none, target).count() == 0
    assert importance.resample(odd, target.where("false")).count() == odd.count()


def test_equal_rows_spread(spark):
    """A third of the rows are one row: their ranks are dealt over partitions."""
    rows = [(None, "a b " * 20) if i % 3 == 0 else (i, f"w{i} " * 25) for i in range(6000)]
    got = importance.resample(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([("a b",)], "text string"), percent=100)
    assert sorted(r["rank"] for r in got.select("rank").collect()) == list(range(1, 6001))
