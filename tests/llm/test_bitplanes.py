import io
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from rasterflow.llm import bitplanes, queries

NAME = "word_bpe_49k.json"


def library(name=NAME):
    t = Tokenizer.from_file(public_tokenizers.path(name))
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def slow(rows):
    """In order of doc_id (null first) and text."""
    own, at, out = library(), 0, []
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode())):
        ids = [*own(text), 2]
        out.append((doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return sorted(out, key=str)


def test_query_against_the_library(spark, sf):
    rows = [(d.doc_id, d.text) for d in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert sorted(map(tuple, queries.op4_bitplanes(spark, sf).collect()), key=str) == slow(rows)


@pytest.mark.parametrize("kind", ["byte", "bit"])
def test_odd_rows(odd, none, kind):
    got = bitplanes.token_planes(odd, kind=kind, chunk_ids=1000)
    assert sorted(map(tuple, got.collect()), key=str) == slow([(r.doc_id, r.text) for r in odd.collect()])
    assert bitplanes.token_planes(none, kind=kind).count() == 0


@settings(max_examples=50, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2**32 - 1), max_size=30), max_size=8), st.sampled_from(["byte", "bit"]), st.integers(1, 40))
def test_round_trip(docs, kind, chunk):
    out = io.BytesIO()
    writer = bitplanes.PlaneWriter(out, kind, chunk)
    for k, ids in enumerate(docs):
        writer.add(k if k % 3 else None, np.array(ids, "<u4"))
    assert writer.close() == (len(docs), sum(map(len, docs)))
    reader = bitplanes.PlaneReader(out)
    back = [(i, [int(x) for p in pieces for x in p]) for i, pieces in reader.documents()]
    assert back == [(k if k % 3 else None, ids) for k, ids in enumerate(docs)]
    flat = [x for ids in docs for x in ids]
    for k in range(len(reader.index)):  # any chunk alone
        assert reader.chunk(k).tolist() == flat[k * chunk : (k + 1) * chunk]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=60), st.text("abtheEÄéß'sr .,-0123²½İΣσſḰ ", max_size=60)), max_size=4))
def test_words_like_the_library(texts):
    own = library()
    got = bitplanes.word_encoder(NAME).encode(texts)
    assert [np.frombuffer(b, "<u4").tolist() for b in got] == [own(t) for t in texts]


def test_special_strings_become_their_tokens():
    assert np.frombuffer(bitplanes.word_encoder(NAME).encode(["a<|endoftext|>B <|startoftext|>"])[0], "<u4").tolist() == library()("a<|endoftext|>B <|startoftext|>")
    assert np.frombuffer(bitplanes.word_encoder(NAME).encode(["<|endoftext|>"])[0], "<u4").tolist() == [49407]


def test_a_vocabulary_of_other_rules_gets_whole_texts():
    encoder, texts = bitplanes.WordEncoder("byte_bpe_50k.json"), ["Some  words, the same<|endoftext|>", None, " x", "don't É"]
    assert not encoder.known
    assert [np.frombuffer(b, "<u4").tolist() for b in encoder.encode(texts)] == [library("byte_bpe_50k.json")(t) for t in texts]


def test_an_id_of_a_third_of_all_rows_is_cut(spark):
    """Files hold like numbers of documents, and starts follow the ids."""
    rows = [(None if i % 3 == 0 else 7 if i % 3 == 1 else i, f"text {i % 50}" if i % 3 else "same") for i in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(12)
    path = bitplanes.new_dir(spark, "planes-test")
    files = bitplanes.write_planes(docs, path).collect()
    assert sum(f.n_docs for f in files) == 6000 and max(f.n_docs for f in files) <= 2 * 6000 / 4
    got = sorted(bitplanes.token_planes(docs).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted((r[0] for r in rows), key=lambda i: (i is not None, i or 0))
    assert all(a.start + a.n_tokens == b.start for a, b in zip(got, got[1:], strict=False))
