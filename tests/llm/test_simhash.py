import itertools
import random
import re
from collections import defaultdict

import xxhash
from pyspark.sql import functions as F

from rasterflow.llm import queries, simhash

WORD = re.compile("[^\x20\x09-\x0d]+")


def slow_fingerprint(text):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(ids, fps, radius=2):
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(ids)), 2):
        if (fps[i] ^ fps[j]).bit_count() <= radius:
            root[find(i)] = find(j)
    least = defaultdict(list)
    for i, x in enumerate(ids):
        if x is not None:
            least[find(i)].append(x)
    return [min(least[find(i)], default=None) for i in range(len(ids))]


def test_query_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()
    ids, fps = [d.doc_id for d in docs], [slow_fingerprint(d.text) for d in docs]
    want = set(zip(ids, [f"{f:016x}" for f in fps], slow_components(ids, fps), strict=True))
    assert {tuple(r) for r in queries.op2_simhash(spark, sf).collect()} == want


def test_fingerprint_of_long_text_is_that_of_its_blocks(monkeypatch):
    text = " ".join(random.Random(1).choice("abcdefgh") * random.Random(k).randint(1, 3) for k in range(500))
    monkeypatch.setattr(simhash, "BLOCK", 7)
    assert simhash.text_fingerprint(text) == slow_fingerprint(text)


def test_links_and_components_of_planted_fingerprints(spark):
    rng = random.Random(5)
    fps = []
    for _ in range(30):
        f = rng.getrandbits(64)
        for _ in range(rng.randint(1, 6)):  # chains of two-bit steps
            fps.append(f)
            f ^= 1 << rng.randrange(64) ^ (1 << rng.randrange(64))
    for radius in (1, 2, 3, 4):
        ids = list(range(len(fps)))
        signed = [(i, f - (1 << 64) if f >> 63 else f) for i, f in zip(ids, fps, strict=True)]
        rows = spark.createDataFrame(signed, "id long, _fp long")
        got = simhash.with_components(rows, "id", radius)
        assert {(r.id, r._component) for r in got.collect()} == set(zip(ids, slow_components(ids, fps, radius), strict=True)), radius


def test_long_chain_of_links(spark):
    links = spark.range(200).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    got = simhash.connected_components(links).collect()
    assert len(got) == 201 and {r.root for r in got} == {0}


def test_odd_rows(odd, none):
    got = simhash.near_duplicates(odd).collect()
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    fps = [slow_fingerprint(t) for _, t in rows]
    want = sorted(zip([i for i, _ in rows], [f"{f:016x}" for f in fps], slow_components([i for i, _ in rows], fps), strict=True), key=str)
    assert sorted(((r.doc_id, r.fingerprint, r.component_id) for r in got), key=str) == want
    assert simhash.near_duplicates(none).count() == 0
    kept = simhash.deduplicate(odd)
    assert kept.columns == odd.columns and {(r._fp, r._row) for r in kept.collect()} == {("p", "r")}
    # copies and texts without words are one group each; a no-break space parts no words
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted([1, 2, 5, 7, 8, 9, 10, None], key=str)
    assert simhash.deduplicate(none).count() == 0


def shingles(text, width=5):
    w = text.encode().lower().split()
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))}


def near_copies(seed=4):
    """Texts of 300 words with copies in which some words are changed, and unrelated ones."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("aehinrst") for _ in range(rng.randint(2, 7)))
    texts = []
    for _ in range(40):
        base = [word() for _ in range(300)]
        texts.append(base)
        for _ in range(rng.randint(0, 4)):
            copy = list(base)
            for _ in range(rng.randint(1, 4)):
                copy[rng.randrange(300)] = word()
            texts.append(copy)
    return [" ".join(t) for t in texts]


def slow_groups(texts, similarity=0.8):
    sets = [shingles(t) for t in texts]
    root = list(range(len(texts)))

    def find(i):
        return i if root[i] == i else find(root[i])

    for i, j in itertools.combinations(range(len(texts)), 2):
        if len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j]):
            a, b = sorted((find(i), find(j)))
            root[b] = a
    return [find(i) for i in range(len(texts))]


def test_near_copies_go_and_others_stay(spark):
    texts = near_copies()
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert {r.doc_id for r in simhash.deduplicate(rows).collect()} == set(slow_groups(texts))


def test_sketch_estimates_similarity():
    import numpy as np

    a, b = near_copies()[:2]
    x, y = shingles(a), shingles(b)
    got = np.mean(np.frombuffer(simhash.text_sketch(a, 5)[0], "<u4") == np.frombuffer(simhash.text_sketch(b, 5)[0], "<u4"))
    assert abs(got - len(x & y) / len(x | y)) < 0.12
    assert simhash.text_sketch(None, 5) == simhash.text_sketch("  ", 5) and simhash.text_sketch("A b", 5) == simhash.text_sketch("a  B", 5)


def test_deduplicate_with_shuffled_keys(odd, monkeypatch):
    monkeypatch.setattr(simhash, "BROADCAST_ROWS", -1)
    assert simhash.deduplicate(odd).count() == 8


def test_every_pair_of_a_bucket_is_compared_or_connected(spark, monkeypatch):
    rng = random.Random(8)
    texts = []
    for _ in range(8):
        base = [str(rng.randrange(10**6)) for _ in range(100)]
        texts += [" ".join(base), " ".join([*base[:50], "new", *base[51:]])]
    real = simhash.with_sketch
    monkeypatch.setattr(simhash, "with_sketch", lambda *a: (d := real(*a)).withColumn(a[-1], F.array(F.lit(7).cast("long"))).select(*d.columns))
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert {r.doc_id for r in simhash.deduplicate(rows).collect()} == set(range(0, 16, 2))


def test_pairs_next_to_the_similarity_are_decided_exactly(spark):
    rng = random.Random(9)
    texts = []
    for changed in [(20, 60)] * 30 + [(20, 50, 80)] * 30:  # 86 of 106 and 81 of 111 shingles
        base = [str(rng.randrange(10**6)) for _ in range(100)]
        texts += [" ".join(base), " ".join("new" if i in changed else w for i, w in enumerate(base))]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert {r.doc_id for r in simhash.deduplicate(rows).collect()} == set(slow_groups(texts)) == {*range(0, 60, 2), *range(60, 120)}


def test_rare_pairs_hold_every_similar_pair(spark):
    rng = random.Random(12)
    passage = [str(rng.randrange(10**6)) for _ in range(60)]
    texts = []
    for _ in range(40):  # all share a passage; some are near copies besides
        own = [*passage, *(str(rng.randrange(10**6)) for _ in range(rng.randint(5, 60)))]
        texts.append(" ".join(own))
        for _ in range(rng.randint(0, 2)):
            own[rng.randrange(len(own))] = "new"
            texts.append(" ".join(own))
    texts += ["", "a", "a b", "a b c d e f", "a b c d e f"]
    rows = spark.createDataFrame(list(enumerate(texts)), "node long, text string").repartition(3)
    members = rows.select("node", F.col("node").alias("root"))
    steps = simhash.rare_pairs(members.select("node", F.lit(0).cast("long").alias("cluster")), simhash.shingle_sets(rows, 5), 0.8)
    got = {tuple(sorted(r)) for step in steps[1:] for r in step(members).collect()}
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if (w := t.encode().lower().split()) else set() for t in texts]
    alike = lambda i, j: bool(sets[i]) and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])
    want = {(i, j) for i, j in itertools.combinations(range(len(texts)), 2) if alike(i, j)}
    assert joined({p for p in got if alike(*p)}, len(texts)) == joined(want, len(texts)) and len(got) < 2 * len(want)
    apart = members.withColumn("root", F.col("node") % 2)
    assert all((i - j) % 2 for i, j in (tuple(r) for step in steps for r in step(apart).collect()))


def joined(pairs, n):
    root = list(range(n))
    for _ in range(n):
        for i, j in pairs:
            root[i] = root[j] = min(root[i], root[j])
    return root


def edits(count, changed=10, words=500):
    """Edits of one text that is not among them."""
    rng = random.Random(3)
    base = [f"w{rng.randrange(10**6)}" for _ in range(words)]
    out = []
    for _ in range(count):
        copy = list(base)
        for k in rng.sample(range(words), changed):
            copy[k] = f"x{rng.randrange(10**9)}"
        out.append(" ".join(copy))
    return out


def test_edits_of_an_absent_text_dont_meet_in_all_pairs(spark, monkeypatch):
    """None is similar to another; twice as many texts bring little more than twice as many candidates."""
    met, real = [], simhash.hopeful
    monkeypatch.setattr(simhash, "hopeful", lambda pairs, *a: met.append(pairs.count()) or real(pairs, *a))
    sums = []
    for n in (200, 400):
        met.clear()
        assert simhash.deduplicate(spark.createDataFrame(list(enumerate(edits(n))), "doc_id long, text string").repartition(4)).count() == n
        sums.append(sum(met))
    assert sums[1] < 3 * sums[0] and sums[1] < 400 * 399 / 2 / 6


def test_edits_of_an_absent_text_that_are_similar_are_joined(spark):
    """Some within the similarity of each other, some not: the groups of brute force."""
    texts = edits(60, 4, 120) + edits(40, 2, 100) + edits(30, 9, 300)
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert {r.doc_id for r in simhash.deduplicate(rows).collect()} == set(slow_groups(texts))


def test_texts_never_come_back_from_python_nor_are_written(spark, sf, monkeypatch):
    kept, real = [], simhash.written
    monkeypatch.setattr(simhash, "written", lambda df, name, **o: kept.append(df.columns) or real(df, name, **o))
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    simhash.near_duplicates(docs, keep_text=False)
    assert kept and not any("text" in c for c in kept)
    simhash.deduplicate(docs)
    assert not any("text" in c for c in kept)


def test_rows_repeated_with_id_and_text_leave_one(spark):
    rows = spark.createDataFrame([(1, "one two three", k) for k in range(5)] + [(1, "other words here", 9), (None, "one two three", 7), (2, None, 1), (2, "", 2)], "doc_id long, text string, k int")
    got = simhash.deduplicate(rows).collect()
    assert sorted(((r.doc_id, r.text or "") for r in got), key=str) == [(1, "one two three"), (1, "other words here"), (2, "")]


def test_edits_of_one_text_are_joined_through_it_without_all_pairs(spark, monkeypatch):
    rng = random.Random(13)
    base = [str(rng.randrange(10**6)) for _ in range(100)]
    texts = [" ".join(base)]
    for _ in range(80):  # each within 0.8 of the base, hardly any of another
        copy = list(base)
        for at in rng.sample(range(5, 95), 2):
            copy[at] = str(rng.randrange(10**6))
        texts.append(" ".join(copy))
    sizes, real = [], simhash.hopeful
    monkeypatch.setattr(simhash, "hopeful", lambda pairs, *a: sizes.append(pairs.count()) or real(pairs, *a))
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert [r.doc_id for r in simhash.deduplicate(rows).collect()] == [0]
    assert set(slow_groups(texts)) == {0} and sum(sizes) < 80 * 79 / 4


def far_and_near_edits(count=150, words=150):
    """A text and edits of it, from one word changed to a fifth of them: those near it are one group, the others alone."""
    rng = random.Random(21)
    base = [f"w{rng.randrange(10**6)}" for _ in range(words)]
    out = [" ".join(base)]
    for i in range(count):
        copy = list(base)
        for at in rng.sample(range(words), 1 + i * 30 // count):
            copy[at] = rng.choice(("the", "of", "and", "thing", "other"))
        out.append(" ".join(copy))
    return out


def test_far_edits_meet_few_of_a_group_of_near_ones(spark):
    texts = far_and_near_edits()
    groups, sets = slow_groups(texts), [shingles(t) for t in texts]
    rows = spark.createDataFrame(list(enumerate(texts)), "node long, text string").repartition(3)
    members = rows.select("node", F.lit(0).cast("long").alias("cluster"))
    steps = simhash.rare_pairs(members, simhash.shingle_sets(rows, 5), 0.8)
    roots = spark.createDataFrame(list(enumerate(groups)), "node long, root long")
    met = {tuple(sorted(r)) for r in steps[2](roots).collect()}
    across = [(i, j) for i, j in itertools.combinations(range(len(texts)), 2) if groups[i] != groups[j]]
    assert met <= set(across) and len(met) < len(across) / 20, (len(met), len(across))
    # a text taken out of its group meets one of it again
    alone = max(i for i, g in enumerate(groups) if g == 0)
    cut = spark.createDataFrame([(i, 10**6 if i == alone else g) for i, g in enumerate(groups)], "node long, root long")
    again = {tuple(sorted(r)) for step in steps[1:] for r in step(cut).collect()}
    assert any(alone in p and len(sets[p[0]] & sets[p[1]]) >= 0.8 * len(sets[p[0]] | sets[p[1]]) for p in again)


def test_similar_texts_are_within_reach_of_each_other():
    import pyarrow as pa

    texts = far_and_near_edits(60) + edits(20, 3, 120)
    hashes = [simhash.shingle_hashes(t, 5) for t in texts]
    times = defaultdict(int)
    for h in itertools.chain(*map(set, hashes)):
        times[h] += 1
    middle = [h for h in times if 2 * times[h] > len(texts)]
    signed = lambda x: [simhash.signed(int(h)) for h in x]
    rows = [(i, 0, len(h), signed(x for x in h if times[x] > 1), signed(middle), [times[x] <= len(texts) - 2 for x in middle]) for i, h in enumerate(hashes)]
    names = ["node", "cluster", "n", "hashes", "middle", "told"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.bool_())]
    batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
    (got,) = simhash.difference_keys(iter([batch]), 0.8, 42)
    got = got.to_pylist()
    apart = 0
    for a, b in itertools.combinations(got, 2):
        x, y = set(hashes[a["node"]]), set(hashes[b["node"]])
        able = a["off"] <= b["reach"] + 1e-9 and b["off"] <= a["reach"] + 1e-9
        assert able or len(x & y) < 0.8 * len(x | y)
        apart += not able
    assert apart > len(texts) ** 2 / 8
    assert all(len(r["keys"]) >= 143 for r in got if r["own"] > 0) and all(not r["keys"] for r in got if r["own"] <= 0)
