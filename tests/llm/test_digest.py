import hashlib
import unicodedata

from pyspark.sql import functions as F

from rasterflow.llm import digest, queries


def slow_canonical(text):
    folded = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text or "").casefold())
    return " ".join(folded.split())


def slow_edited(rows):
    """rows: (doc_id, text), in the order of the query."""
    rows = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), hashlib.md5((r[1] or "").encode()).hexdigest()))
    out = []
    for k, (doc_id, text) in enumerate(rows):
        text, nxt = text or "", rows[(k + 1) % len(rows)][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + nxt[:half]
        out.append((doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), slow_canonical(text), slow_canonical(edited), slow_canonical(nxt)))
    return out


def compare(got, want):
    assert sorted(((r.doc_id, r.n_chars, r.edited_sha256, r.near_edited, r.near_next) for r in got), key=str) == sorted(((i, n, e, float(a == b), float(a == c)) for i, n, e, a, b, c in want), key=str)
    names = {}
    by = {(w[0], w[1], w[2]): w for w in want}
    for r in got:
        w = by[r.doc_id, r.n_chars, r.edited_sha256]
        for name, canon in ((r.fingerprint, w[3]), (r.edited_fingerprint, w[4])):
            assert names.setdefault(name, canon) == canon
    assert len(names) == len(set(names.values()))


def test_query_against_brute_force(spark, sf):
    want = slow_edited([(d.doc_id, d.text) for d in spark.read.parquet(f"{sf}/documents.parquet").collect()])
    compare(queries.op6_exact_digest(spark, sf).collect(), want)


def test_different_texts_of_one_digest_are_told_apart(spark, sf, odd):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(60).union(spark.read.parquet(f"{sf}/documents.parquet").limit(5)).cache()
    canons = {}
    for r in digest.exact_fingerprints(docs, bits=4).collect():
        assert canons.setdefault(r.fingerprint, slow_canonical(r.text)) == slow_canonical(r.text)
    assert len(canons) == len(set(canons.values())) > 16
    rows = odd.where("doc_id is not null").dropDuplicates(["doc_id"])
    compare(digest.edited_fingerprints(rows, bits=4).collect(), slow_edited([(r.doc_id, r.text) for r in rows.collect()]))


def test_shuffled_keys(odd, monkeypatch):
    monkeypatch.setattr(digest, "BROADCAST_ROWS", -1)
    compare(digest.edited_fingerprints(odd).collect(), slow_edited([(r.doc_id, r.text) for r in odd.collect()]))


def test_odd_rows(odd, none):
    compare(digest.edited_fingerprints(odd).collect(), slow_edited([(r.doc_id, r.text) for r in odd.collect()]))
    got = digest.exact_fingerprints(odd)
    assert sorted(got.columns) == sorted(odd.columns)
    by = {}
    for r in got.collect():
        by.setdefault(r.fingerprint, set()).add(slow_canonical(r.text))
    assert all(len(v) == 1 for v in by.values())
    assert digest.exact_fingerprints(none).count() == 0 and digest.edited_fingerprints(none).count() == 0


def test_null_and_repeated_ids_are_spread(spark):
    rows = [(None, f"text {i}") for i in range(400)] + [(7, f"other {i}") for i in range(400)] + [(i, f"own {i}") for i in range(-50, 50)] + [(2**60 + i, f"big {i % 3}") for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), hashlib.md5(r[1].encode()).hexdigest()))
    nexts = digest.with_next(docs)
    assert sorted(((r.doc_id, r.text, r.next_text) for r in nexts.collect()), key=str) == sorted(((i, t, order[(k + 1) % len(order)][1]) for k, (i, t) in enumerate(order)), key=str)
    assert len({r.p for r in nexts.where("doc_id is null").select(F.spark_partition_id().alias("p")).collect()}) > 1
