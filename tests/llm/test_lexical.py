import math
import random
import re
from collections import Counter

import numpy as np

from rasterflow.llm import lexical, queries
from tests.helpers import duckdb_rows, spark_rows

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def terms(text):
    return [t.translate(LOWER) for t in TERM.findall(text or "")]


def slow(docs, items, most=10):
    """All scores of all pairs."""
    tf = [Counter(terms(t)) for _, t in docs]
    n, words = sum(bool(c) for c in tf), sum(c.total() for c in tf)
    df = Counter(t for c in tf for t in c)
    out = []
    for number, (item, text) in enumerate(items):
        scored = []
        for (i, _), c in zip(docs, tf, strict=True):
            m = 100 - 75 + (75 * c.total() * n) // words if words else 0
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in terms(text) if c[t])
            if score > 0:
                scored.append((-score, i is None, i))
        out += [(number, item, k + 1, i, -s) for k, (s, _, i) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:most])]
    return out


def corpus(seed, rows=400):
    draw = random.Random(seed)
    vocabulary = [f"t{int(draw.paretovariate(0.7)) % 300}" for _ in range(2000)] + ["É", "É", "юг", "DE", "de"]
    docs = [(k if k % 11 else None, " ".join(draw.choices(vocabulary, k=draw.choice([0, 1, 3, 30, 30, 200])))) for k in range(rows)]
    docs += [docs[7]] * 30 + [(1000 + k, docs[8][1]) for k in range(30)] + [(77, None)]
    items = [(k, " ".join(draw.choices(vocabulary, k=draw.choice([0, 1, 2, 40])))) for k in range(25)] + [(3, "t1 t1, T1"), (None, "de"), (9, None), (10, "nowhere"), (11, docs[8][1])]
    return docs, items


def found(df):
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in df.collect()), key=repr)


def test_against_brute_force(spark):
    docs, items = corpus(1)
    table = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    queries_ = spark.createDataFrame(items, "item_id long, text string")
    want = sorted((x[1:] for x in slow(docs, items)), key=repr)
    assert found(lexical.search(table, queries_)) == want
    assert found(lexical.search(table, queries_, first=1)) == want


def test_blocks_of_queries(spark, monkeypatch):
    monkeypatch.setattr(lexical, "QUERY_TERMS", 60)
    monkeypatch.setattr(lexical, "AT_ONCE", 16)
    monkeypatch.setattr(lexical, "BLOCK_ROWS", 10)
    monkeypatch.setattr(lexical, "BROADCAST_ROWS", 3)
    docs, items = corpus(2, 120)
    got = lexical.search(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), most=3)
    assert found(got) == sorted((x[1:] for x in slow(docs, items, 3)), key=repr)


def test_bounds_are_never_below_the_scores():
    docs, items = corpus(4, 200)
    blocks = lexical.Blocks()
    done = [b for i, t in docs if (b := blocks.add(i, t)) is not None] + [blocks.close(k) for k in sorted(blocks.open)]
    n, words = sum(b.column("n_docs")[0].as_py() for b in done), sum(b.column("n_terms")[0].as_py() for b in done)
    df = Counter(t for _, x in docs for t in set(terms(x)))
    block = lexical.Queries([], [], [], [], n, words)
    for number, (_, text) in enumerate(items):
        own = sorted((t, k) for t, k in Counter(terms(text)).items() if df[t])
        if own:
            block.numbers.append(number)
            block.starts.append(len(block.terms))
            block.terms += [t.encode() for t, _ in own]
            block.weights += [k * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) for t, k in own]
    block.starts.append(len(block.terms))
    score, texts, tight = block.scorer(), {__import__("hashlib").md5((t or "").encode()).digest(): t for _, t in docs}, []
    for b in done:
        lengths, digests = b.column("lengths")[0].as_py(), b.column("digests")[0].as_py()
        bounds = np.concatenate([s for _, s in block.bounds(b.column("bits")[0].as_py(), lengths, b.column("slices")[0].as_py())])
        for d, digest in enumerate(digests):
            exact = score(texts[digest], set(range(len(block.numbers))))
            for q in range(len(block.numbers)):
                assert bounds[q, d] >= exact[q]
                tight.append(bounds[q, d] <= exact[q] * 1.3 + 1)
    assert sum(tight) > 0.8 * len(tight)


def test_query_against_sql(spark, sf):
    got = spark_rows(queries.op11_lexical_search(spark, sf))
    assert got[1] and got == duckdb_rows(queries.ORACLE_SQL["op11_lexical_search"], sf)


def test_odd_rows(spark, odd, none):
    items = [(1, "one two"), (None, "id lorem"), (2, None), (2, ""), (3, "ÜNÏCODE e ﬁne")]
    table = spark.createDataFrame(items, "item_id long, text string")
    docs = [(r.doc_id, r.text) for r in odd.collect()]
    assert found(lexical.search(odd, table)) == sorted((x[1:] for x in slow(docs, items)), key=repr)
    for d, q in ((none, table), (odd, table.where("false")), (none, table.where("false"))):
        assert lexical.search(d, q).collect() == []
