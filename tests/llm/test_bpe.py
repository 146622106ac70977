import base64
import hashlib
import random
import time

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from rasterflow.llm import bpe, queries

NAME = "byte_bpe_multi_50k.tiktoken"


def library():
    with open(public_tokenizers.path(NAME), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def digest(ids):
    return hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()


def test_query_against_the_library(spark, sf):
    own = library()
    want = {(d.doc_id, len(ids := own.encode_ordinary(d.text or "")), digest(ids), hashlib.sha256((d.text or "").encode()).hexdigest()) for d in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert {tuple(r) for r in queries.op8_byte_bpe(spark, sf).collect()} == want


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=80), st.text("aehnrt ", max_size=300), st.text("a", max_size=70)), max_size=5))
def test_texts_like_the_library(texts):
    ranks, own = bpe.load_ranks(NAME), library()
    for text, (ids, said) in zip(texts, bpe.encode_texts(texts, ranks), strict=True):
        assert ids == own.encode_ordinary(text)
        assert said == ",".join(map(str, ids))
        assert bpe.decode(ids, ranks) == text.encode()


def test_segment_trees_against_plain_merging():
    ranks = bpe.load_ranks(NAME)

    def plain(piece):
        parts = [bytes([b]) for b in piece]
        while True:
            pairs = [(ranks.ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in ranks.ranks]
            if not pairs:
                return [ranks.ranks[p] for p in parts]
            _, i = min(pairs)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    pieces = [b"a" * 37, b"thequickbrownfox", bytes(range(256)), "straßenbahnhöfe".encode(), b"\xff\xfe", b"xy" * 100]
    assert [ranks.ranks[p] for p in (b"a",)] == ranks.merge_all([b"a"])[0]
    for piece, ids in zip(pieces, ranks.merge_all(pieces), strict=True):
        if piece not in ranks.ranks:
            assert ids == plain(piece)


def test_table_of_met_pieces_may_overflow(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE", 3)
    monkeypatch.setattr(bpe, "CACHED_BYTES", 6)
    own, texts = library(), ["some words that do not fit in it", "others follow, extraordinarily"]
    assert [i for i, _ in bpe.encode_texts(texts, bpe.Ranks(bpe.load_ranks(NAME).ranks))] == list(map(own.encode_ordinary, texts))


def test_odd_rows(odd, none):
    own = library()
    got = bpe.encode_documents(odd, with_ids=True).collect()
    want = [(r.doc_id, own.encode_ordinary(r.text or "")) for r in odd.collect()]
    assert [(r.doc_id, r.n_tokens, r.ids_sha256) for r in got] == [(i, len(ids), digest(ids)) for i, ids in want]
    assert [len(r.ids) for r in got] == [4 * len(ids) for _, ids in want]
    assert bpe.encode_documents(none).count() == 0


def test_long_single_pieces_take_seconds():
    rng, own, ranks = random.Random(6), library(), bpe.load_ranks(NAME)
    texts = ["".join(rng.choice("aehinrst") for _ in range(200_000)), "a" * 300_001, "é" * 50_000, "".join(rng.choice("xyzw") for _ in range(70_000))]
    began = time.monotonic()
    got = [ids for ids, _ in bpe.encode_texts(texts, ranks)]
    assert time.monotonic() - began < 60
    pieces = {t: bpe.piece_pattern().findall(t) for t in texts}
    assert all(len(p) == 1 for p in pieces.values())
    for text, ids in zip(texts, got, strict=True):
        assert bpe.decode(ids, ranks) == text.encode()
        assert ids == own.encode_ordinary(text)


@pytest.mark.parametrize("few", [0, 1, 1000])
def test_lock_step_and_single_walks_agree(monkeypatch, few):
    monkeypatch.setattr(bpe, "FEW", few)
    rng, own = random.Random(7), library()
    texts = ["".join(rng.choice("aehinrst") for _ in range(rng.randint(1, 90))) for _ in range(300)]
    assert [ids for ids, _ in bpe.encode_texts(texts, bpe.Ranks(bpe.load_ranks(NAME).ranks))] == list(map(own.encode_ordinary, texts))
