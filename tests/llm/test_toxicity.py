import math
import random
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from rasterflow.llm import queries, toxicity
from rasterflow.llm.toxicity import Folder, Lexicon


def test_folding():
    fold = Folder()
    assert fold("You 1D10T, you!!") == " you idiot you "
    assert fold("ѕсum ＳＣＵＭ sc.um 2024 a@b") == " scum scum sc um 2024 aab "
    assert fold(None) == fold("") == " " and fold("... --") == "  "


def test_matching_weights_exceptions_and_length():
    lexicon = Lexicon({" trash ": 3.0, " mor": 2.0, " moron ": 4.0}, (" trash can", " morning"), (-2.0, 2.0, 0.0))
    assert lexicon.evidence(" a moron ") == (4.0, 200.0)
    assert lexicon.evidence(" trash can of trash ")[0] == 3.0
    assert lexicon.evidence(" morning ")[0] == 0.0
    assert lexicon.evidence(" ")[0] == 0.0
    assert lexicon.score(" moron ") > 0.5 > lexicon.score(" fine ")
    assert lexicon.evidence(" moron moron ")[0] == pytest.approx(4 * (1 + math.log(2))) and lexicon.evidence(" x" * 99 + " moron ")[1] == pytest.approx(4.0)
    assert Lexicon({}).score(" anything ") == 0.5


def slow_evidence(lexicon, folded):
    """Looks for every pattern at every place."""
    free = [(a, a + len(e) - 1) for e in lexicon.exceptions for a in range(len(folded)) if folded.startswith(e, a)]
    found = {}
    for a in range(len(folded)):
        here = [(w, len(p)) for p, w in lexicon.weights.items() if folded.startswith(p, a)]
        if here and not any(x <= a < z for x, z in free):
            weight, length = max(here)
            found.setdefault(folded[a : a + length].strip(" ") if folded[a] != " " else " " + folded[a : a + length].strip(" "), []).append(weight)
    total = sum(max(w) * (1 + math.log(len(w))) for w in found.values())
    return total, 100 * total / max(1, folded.count(" ") - 1)


@settings(max_examples=300, deadline=None)
@given(st.dictionaries(st.text("ab ", min_size=1, max_size=4).map(lambda p: " a" + p), st.floats(0.5, 4), max_size=6), st.lists(st.text("ab ", min_size=2, max_size=5).map(lambda p: " " + p), max_size=3), st.text("ab ", max_size=60))
def test_matching_against_a_search_at_every_place(weights, exceptions, text):
    lexicon = Lexicon({p: w for p, w in weights.items() if p not in exceptions}, tuple(exceptions))
    assert lexicon.evidence(f" {text} ") == pytest.approx(slow_evidence(lexicon, f" {text} "))


def test_patterns_against_a_plain_count(spark):
    docs, labels = planted(900, seed=5)
    d, la = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    lexicon = toxicity.learn_lexicon(d, la)
    fold, toxic, texts = Folder(), dict(labels), {}
    for i, t in docs:
        if zlib.crc32(str(i).encode()) % 5:
            f = fold(t)
            key = (toxicity.signature(f), toxic[i])
            texts[key] = min(texts.get(key, f), f)
    counts = {}
    for (_, label), f in texts.items():
        for x in {f" {w} " for w in f.split()} | {f" {w[:k]}" for w in f.split() for k in range(3, min(8, len(w)) + 1)}:
            counts.setdefault(x, [0, 0])[label] += 1
    n = [sum(1 for _, y in texts if y == label) for label in (0, 1)]
    odds = lambda c, t: math.log((t + 0.5) / (n[1] + 1)) - math.log((c + 0.5) / (n[0] + 1))
    sure = {x: odds(c, t) - 2.6 * math.sqrt(1 / (t + 0.5) + 1 / (c + 0.5)) for x, (c, t) in counts.items()}
    want = {x: s for x, s in sure.items() if s > 0.7 and odds(*counts[x]) > 2.2 and counts[x][1] >= 3}
    longer = lambda x: max((counts[y][1] for y in want if y != x and y.startswith(x) and y[-1] != " "), default=0)
    want = {x: s for x, s in want.items() if x[-1] == " " or longer(x) < 0.9 * counts[x][1]}
    assert lexicon.weights == pytest.approx(want) and " zorg" in want


def planted(n, seed=3):
    rng = random.Random(seed)
    words = ["".join(rng.choice("aehinrt") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    docs, labels = [], []
    for i in range(n):
        bad = rng.random() < 0.15
        text = [rng.choice(words) for _ in range(rng.randint(20, 200))]
        for _ in range(rng.randint(1, 3) * bad):
            text.insert(rng.randrange(len(text)), "zorg" + rng.choice(["on", "ella", "ik", "um", "et"]) if rng.random() < 0.7 else "blarf")
        docs.append((i, " ".join(text)))
        labels.append((i, int(bad)))
    return docs, labels


def test_held_out_accuracy_on_planted_stems(spark):
    docs, labels = planted(3000)
    d, la = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    lexicon = toxicity.learn_lexicon(d, la)
    scores = {r.doc_id: r.score for r in toxicity.score_documents(d, lexicon).collect()}
    held = [(scores[i], y) for i, y in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum((s >= 0.5) == bool(y) for s, y in held) / len(held) > 0.97
    assert all(0 <= s <= 1 for s, _ in held)


def test_query(spark):
    got = queries.op7_toxicity(spark, "/root/testdata/sf0.01").collect()
    labels = {r.doc_id: r.toxic for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    assert len(got) == 1000 and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.5) for r in got)
    known = [r for r in got if r.doc_id in labels and r.held_out]
    assert sum(r.predicted == labels[r.doc_id] for r in known) / len(known) > 0.9


def test_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(i % 12, i % 2, None) for i in range(40)] + [(None, 1, "x"), (3, None, None)], "doc_id long, toxic int, text string")
    lexicon = toxicity.learn_lexicon(odd, labels)
    got = toxicity.score_documents(odd, lexicon)
    assert got.count() == odd.count() and got.where("score is null or score < 0 or score > 1").count() == 0
    assert toxicity.reject_toxic(odd, lexicon).columns == odd.columns
    assert toxicity.score_documents(none, lexicon).count() == 0
    for no in (labels.where("false"), labels.where("toxic = 0")):
        empty = toxicity.learn_lexicon(odd, no)
        assert not empty.weights and toxicity.score_documents(odd, empty).where("score > 0.5").count() == 0


def test_rows_that_share_an_id_count_once(spark):
    docs, labels = planted(900, seed=5)
    d, la = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    one = next(i for i, y in labels if y == 0 and zlib.crc32(str(i).encode()) % 5)
    hot = spark.createDataFrame([(one, f"zorgon {k} number {k * 7} of many") for k in range(500)], "doc_id long, text string")
    weights = toxicity.learn_lexicon(d.union(hot), la).weights
    assert " zorg" in weights and weights == toxicity.learn_lexicon(hot.repartition(7).union(d.repartition(5)), la).weights


def test_query_against_a_search_at_every_place(spark, sf):
    """All scores of the query again: patterns looked for at every place of the folded text, and the logistic formula."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    lexicon = toxicity.learn_lexicon(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    fold, (a, b, c) = Folder(), lexicon.coefficients
    got = {r.doc_id: r for r in queries.op7_toxicity(spark, sf).collect()}
    for d in docs.collect():
        total, dense = slow_evidence(lexicon, fold(d.text)) if len(d.text or "") < 3000 else lexicon.evidence(fold(d.text))
        score = 1 / (1 + math.exp(-(a + b * math.log1p(total) + c * math.log1p(dense))))
        r = got.pop(d.doc_id)
        assert r.score == pytest.approx(score, abs=1e-9) and r.predicted == int(score >= 0.5)
        assert r.held_out == (zlib.crc32(str(d.doc_id).encode()) % 5 == 0)
    assert not got
