from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline
from rasterflow.llm import mixing, toxicity
from tests.llm.test_bpe import digest, library
from tests.llm.test_pii import SLOW, luhn
from tests.llm.test_simhash import slow_groups


def test_stages_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    stage = dict(corpus_pipeline.STAGES)
    assert len(stage) == 5
    lexicon = toxicity.learn_lexicon(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    fold = toxicity.Folder()
    clean = stage["toxicity"](spark, docs, sf)
    assert clean.columns == docs.columns
    want = [d for d in docs.collect() if lexicon.score(fold(d.text)) < 0.5]
    assert sorted(clean.collect()) == sorted(want)
    single = stage["near duplicates"](spark, clean, sf)
    assert single.columns == docs.columns
    want.sort(key=lambda d: d.doc_id)
    found = {d.doc_id for d in single.collect()}
    reps = lambda similarity: {want[i].doc_id for i in slow_groups([d.text for d in want], similarity)}
    assert found == reps(0.8)
    private = stage["personal data"](spark, single, sf)
    assert private.columns == docs.columns
    old = {d.doc_id: d for d in want}
    for r in private.collect():
        changed = any(k != "card" or luhn(x) for k, p in SLOW.items() for x in p.findall(old[r.doc_id].text))
        assert (r.text != old[r.doc_id].text) == changed and r.n_chars == (len(r.text) if changed else old[r.doc_id].n_chars)
    mixed = stage["mixing"](spark, private, sf)
    assert mixed.columns == docs.columns
    copies = {r.doc_id: r._copies for r in mixing.mix_copies(private).collect()}
    assert Counter(r.doc_id for r in mixed.collect()) == Counter({i: n for i, n in copies.items() if n})
    own = library()
    last = stage["byte-level BPE"](spark, mixed, sf).collect()
    text = {r.doc_id: r.text for r in mixed.collect()}
    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256) for r in last) == Counter({(i, len(x := own.encode_ordinary(t)), digest(x)): copies[i] for i, t in text.items()})
    assert sorted((r.doc_id, r.ids_sha256) for r in corpus_pipeline.run(spark, sf).collect()) == sorted((r.doc_id, r.ids_sha256) for r in last)


def test_stages_stand_odd_rows(spark, odd, sf):
    docs = odd.select("doc_id", "text", F.lit("en").alias("lang"), "source", F.length("text").cast("long").alias("n_chars"), F.lit(1).alias("_copy"))
    for rows in (docs, docs.where("false")):
        for _, f in corpus_pipeline.STAGES[:-1]:
            rows = f(spark, rows, sf)
            assert rows.columns == docs.columns
        corpus_pipeline.STAGES[-1][1](spark, rows, sf).collect()


def test_near_duplicate_groups_are_exact(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = sorted(docs.collect(), key=lambda d: d.doc_id)
    single = dict(corpus_pipeline.STAGES)["near duplicates"](spark, docs, sf)
    assert {r.doc_id for r in single.collect()} == {rows[i].doc_id for i in slow_groups([d.text for d in rows])}
