import numpy as np
import pytest

from rasterflow.llm import queries, token_files
from rasterflow.llm.common import filesystem, new_dir


def test_query_against_the_library(spark, sf):
    own, _ = token_files.byte_encoding("byte_bpe_multi_50k.tiktoken")
    want = {d.doc_id: len(own.encode_ordinary(d.text or "")) for d in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert {r.doc_id: r.n_tokens for r in queries.op1_token_counts(spark, sf).collect()} == want


def slow_scan(ids, separator):
    out, start = [], 0
    for i, x in enumerate(ids):
        if x == separator:
            out.append((start, i - start))
            start = i + 1
    return out + [(start, len(ids) - start)] * (start < len(ids))


@pytest.mark.parametrize("block", [2, 6, 14, 64, 4096])
def test_scan_of_any_blocks(spark, block, monkeypatch):
    monkeypatch.setattr(token_files, "GROUP_BLOCKS", 3)
    rng = np.random.default_rng(block)
    path, want = new_dir(spark, "scan"), {}
    fs, inner = filesystem(path)
    cases = [rng.integers(0, k, n) for k, n in ((3, 50), (2, 40), (9, 131), (1, 12))] + [np.ones(30), np.array([0]), np.array([1, 1, 0]), np.array([])]
    for k, ids in enumerate(cases):
        with fs.open_output_stream(f"{inner}/{k}.tokens") as f:
            f.write(ids.astype("<u2").tobytes())
        want[str(k)] = slow_scan(ids.astype(int).tolist(), 0)
    got = {}
    for r in token_files.scan_separators(spark, path, 0, block_bytes=block).collect():
        got.setdefault(r.file.split("/")[-1].split(".")[0], []).append((r.ordinal, r.start, r.n_tokens))
    assert {k: [x[1:] for x in sorted(v)] for k, v in got.items()} == {k: v for k, v in want.items() if v}
    assert all([x[0] for x in sorted(v)] == list(range(len(v))) for v in got.values())


def test_odd_rows(odd, none):
    own, _ = token_files.byte_encoding("byte_bpe_multi_50k.tiktoken")
    got = token_files.token_counts(odd, block_bytes=64)
    assert sorted(((r.doc_id, r.n_tokens) for r in got.collect()), key=str) == sorted(((r.doc_id, len(own.encode_ordinary(r.text or ""))) for r in odd.collect()), key=str)
    assert token_files.token_counts(none).count() == 0
