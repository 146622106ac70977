import random
import re
from hashlib import sha256

import pytest

from rasterflow.llm import decontamination, queries
from tests.helpers import duckdb_rows, spark_rows

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def slow(docs, items, window=10, containment=1.0):
    """For each text the hit words and the items, by looking everywhere."""
    wins = set()
    for i, t in items:
        w = words(t)
        n = min(window, len(w))
        wins |= {("" if i is None else str(i), tuple(w[k : k + n])) for k in range(len(w) - n + 1) if n}
    out = []
    for t in docs:
        w, hit, found = words(t), set(), set()
        for i, win in wins:
            need = max(1, -(-len(win) * containment // 1) if containment < 1 else len(win))
            for k in range(len(w) - len(win) + 1):
                if sum(a == b for a, b in zip(win, w[k:], strict=False)) >= need:
                    hit |= set(range(k, k + len(win)))
                    found.add(i)
        out.append((len(w), hit, sorted(found)))
    return out


def check(got, want):
    for r, (n, hit, items) in zip(got, want, strict=True):
        assert r.n_words == n and r.n_hit == len(hit) and r["items"] == items
        assert {p for s in r.spans for p in range(s.lo, s.hi)} == hit
        assert all(a.hi < b.lo for a, b in zip(r.spans, r.spans[1:], strict=False))


def corpus(seed, rows=150):
    draw = random.Random(seed)
    vocabulary = ["a", "b", "the", "Of", "é", "Ünï", "x1", "юг"]
    items = [(k, " ".join(draw.choices(vocabulary, k=draw.choice([0, 1, 2, 3, 9, 10, 11, 30])))) for k in range(12)]
    items += [(3, "a b the"), (None, "one two three"), (50, None), (51, "?!"), (52, items[5][1]), (53, items[5][1])]
    docs = []
    for _ in range(rows):
        text = draw.choices(vocabulary, k=draw.choice([0, 1, 5, 12, 60]))
        for _, t in draw.sample(items, 2):
            w = words(t)
            if w:
                a = draw.randrange(len(w))
                piece = w[a : a + draw.randrange(1, 25)]
                if draw.random() < 0.3:
                    piece[draw.randrange(len(piece))] = "changed"
                at = draw.randrange(len(text) + 1)
                text[at:at] = piece
        docs.append(", ".join(text).upper() if draw.random() < 0.2 else " ".join(text))
    return docs, items


@pytest.mark.parametrize(("containment", "window"), [(1.0, 10), (0.8, 10), (0.7, 6)])
def test_against_brute_force(spark, containment, window):
    docs, items = corpus(1)
    table = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").repartition(5)
    got = decontamination.contamination(table, spark.createDataFrame(items, "item_id long, text string"), window=window, containment=containment)
    check(sorted(got.collect(), key=lambda r: r.doc_id), slow(docs, items, window, containment))


def test_blocks_and_lanes(spark, monkeypatch):
    monkeypatch.setattr(decontamination, "BROADCAST_ROWS", 7)
    monkeypatch.setattr(decontamination, "ROW_WINDOWS", 1)
    docs, items = corpus(2, 30)
    table = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    got = decontamination.contamination(table, spark.createDataFrame(items, "item_id long, text string"))
    check(sorted(got.collect(), key=lambda r: r.doc_id), slow(docs, items))


def test_query_against_sql(spark, sf):
    got = spark_rows(queries.op12_decontamination(spark, sf))
    assert got == duckdb_rows(queries.ORACLE_SQL["op12_decontamination"], sf)


def test_no_text_is_shuffled_and_nothing_leaves_the_engine(spark, sf):
    df = queries.op12_decontamination(spark, sf)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan


def test_odd_rows(spark, odd, none):
    items = spark.createDataFrame([(1, "one two three four"), (1, "lorem ipsum"), (None, "no id here"), (2, None), (3, "")], "item_id long, text string")
    got = decontamination.contamination(odd, items)
    assert got.drop("n_words", "spans", "n_hit", "items").columns == odd.columns
    rows = got.collect()
    want = slow([r.text for r in rows], [tuple(r) for r in items.collect()])
    check(rows, want)
    assert len(rows) == odd.count() and sum(r.n_hit == 40_000 for r in rows) == 2
    assert decontamination.contamination(none, items).count() == 0
    assert {r.n_hit for r in decontamination.contamination(odd, items.where("false")).collect()} == {0}
    kept = decontamination.drop_contaminated(odd, items)
    assert kept.columns == odd.columns
    assert sorted(map(repr, kept.collect())) == sorted(repr(o) for o, w in zip(odd.collect(), slow([o.text for o in odd.collect()], [tuple(r) for r in items.collect()]), strict=True) if not w[1])


def test_hot_passage_and_hot_rows(spark):
    """A passage that a third of all rows hold, in rows that are equal to each other."""
    passage = " ".join(f"w{k}" for k in range(40))
    rows = [(None if i % 3 == 0 else i, passage if i % 3 == 0 else f"clean text number {i}") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    items = spark.createDataFrame([(7, passage), (8, passage + " more"), (9, "unrelated words of an item that is in no document at all")], "item_id long, text string")
    got = decontamination.contamination(docs, items).groupBy("n_hit", "items").count().collect()
    assert {(r.n_hit, tuple(r["items"]), r["count"]) for r in got} == {(40, ("7", "8"), 1000), (0, (), 2000)}


def test_digest_of_items(spark, sf):
    rows = queries.op12_decontamination(spark, sf).collect()
    clean = [r for r in rows if not r.contaminated]
    assert clean and {r.items_sha256 for r in clean} == {sha256(b"").hexdigest()} and {(r.n_hit, r.n_items) for r in clean} == {(0, 0)}
