"""Token counts from flat, unindexed token files.

The files hold nothing but ids, each document ended by one separator id. A scan cuts every
file into fixed blocks, finds separators in a block with one vectorised comparison, and
stitches documents that cross block boundaries with a prefix scan over block summaries
(number of separators, last separator). The scan runs on two levels, groups of blocks and
blocks within a group, so that one huge file does not become one task.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SafeFile, filesystem, map_batches, new_dir, partition_id, tokenizer_path, written

#: Bytes of a block and blocks of a group.
BLOCK_BYTES, GROUP_BLOCKS = 2 << 20, 1024


@lru_cache(maxsize=2)
def byte_encoding(vocabulary: str):
    """The tiktoken encoding of a rank file, without special tokens, and its first free id."""
    import public_tokenizers
    import tiktoken

    with open(tokenizer_path(vocabulary), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), len(ranks)


def write_token_files(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", vocabulary: str = "byte_bpe_multi_50k.tiktoken") -> DataFrame:
    """Writes ids as 16-bit little-endian numbers, one file for each partition; null is empty.

    Returns the written list of ``(part, ordinal, doc_id)``: which document is the n-th of
    a file. The separator is the first id that the vocabulary leaves free.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        encoding, separator = byte_encoding(vocabulary)
        part, done, out = partition_id(), 0, None
        for b in batches:
            out = out or SafeFile(f"{path}/part-{part:06d}.tokens")
            for t in b.column(1).to_pylist():
                out.write(np.array([*encoding.encode_ordinary(t or ""), separator], dtype="<u2").tobytes())
            n = b.num_rows
            yield pa.RecordBatch.from_arrays([pa.array([part] * n, pa.int32()), pa.array(range(done, done + n), pa.int64()), b.column(0)], names=["part", "ordinal", "doc_id"])
            done += n
        if out:
            out.close()

    kind = docs.schema[doc_id].dataType.simpleString()
    return written(map_batches(docs.select(doc_id, text), run, f"part int, ordinal long, doc_id {kind}"), "token-list")


def scan_separators(spark: SparkSession, path: str, separator: int, dtype: str = "<u2", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``(file, ordinal, start, n_tokens)`` of every document in the files under ``path``.

    ``start`` counts ids from the file's beginning, separators included; ``n_tokens`` is
    without the separator. Ids after a file's last separator are a document too (it was
    not ended); a file that ends with a separator has no such document. Consecutive
    separators enclose documents of no tokens. A file whose size is no multiple of an id's
    size is refused.
    """
    import numpy as np

    width = np.dtype(dtype).itemsize
    if block_bytes % width:
        raise ValueError("a block must hold whole ids")
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), F.col("length").alias("bytes"))
    files = files.where(F.when(F.col("bytes") % width == 0, True).otherwise(F.raise_error(F.concat(F.lit("not whole ids: "), F.col("file"))).isNull()))
    blocks = files.where("bytes > 0").select("file", "bytes", F.explode(F.expr(f"sequence(0L, (bytes - 1) div {block_bytes}L)")).alias("block"))
    blocks = blocks.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "file", "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                fs, inner = filesystem(row["file"])
                at = row["block"] * block_bytes
                with fs.open_input_file(inner) as f:
                    ids = np.frombuffer(f.read_at(min(block_bytes, row["bytes"] - at), at), dtype=dtype)
                found = np.flatnonzero(ids == separator) + at // width
                yield pa.RecordBatch.from_pylist([row | {"found": found.tolist(), "n": len(found), "last": int(found[-1]) if len(found) else -1}], schema=schema)

    schema = pa.schema([("file", pa.string()), ("bytes", pa.int64()), ("block", pa.int64()), ("found", pa.list_(pa.int64())), ("n", pa.int64()), ("last", pa.int64())])
    summary = written(map_batches(blocks, run, "file string, bytes long, block long, found array<long>, n long, last long").withColumn("group", F.expr(f"block div {GROUP_BLOCKS}")), "token-blocks")
    groups = summary.groupBy("file", "group").agg(F.sum("n").alias("n"), F.max("last").alias("last"))
    earlier = Window.partitionBy("file").orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.select("file", "group", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("g_n"), F.coalesce(F.max("last").over(earlier), F.lit(-1)).alias("g_last"))
    earlier = Window.partitionBy("file", "group").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    stitched = summary.withColumns({"b_n": F.coalesce(F.sum("n").over(earlier), F.lit(0)), "b_last": F.coalesce(F.max("last").over(earlier), F.lit(-1))}).join(groups, ["file", "group"])
    stitched = stitched.withColumns({"base": F.col("g_n") + F.col("b_n"), "carry": F.greatest("g_last", "b_last")})
    final = (F.col("block") == F.expr(f"(bytes - 1) div {block_bytes}L")) & (F.greatest("carry", "last") < F.expr(f"bytes div {width}") - 1)
    ends = F.when(final, F.concat("found", F.array(F.expr(f"bytes div {width}")))).otherwise(F.col("found"))
    docs = stitched.select("file", "base", "carry", "found", F.posexplode(ends).alias("i", "end"))
    start = F.when(F.col("i") == 0, F.col("carry")).otherwise(F.expr("found[i - 1]")) + 1
    return docs.select("file", (F.col("base") + F.col("i")).alias("ordinal"), start.alias("start"), (F.col("end") - start).alias("n_tokens"))


def token_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", vocabulary: str = "byte_bpe_multi_50k.tiktoken", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``(doc_id, part, start, n_tokens)``: counts read back from token files of ``docs``.

    Null and empty texts have no tokens. Repeated rows and null ids are counted row by
    row. An empty table writes no file and gives an empty result. Other columns are not
    read.
    """
    spark = docs.sparkSession
    path = new_dir(spark, "tokens")
    listed = write_token_files(docs, path, doc_id, text, vocabulary)
    found = scan_separators(spark, path, byte_encoding(vocabulary)[1], "<u2", block_bytes).withColumn("part", F.regexp_extract("file", r"part-(\d+)\.tokens$", 1).cast("int"))
    return listed.join(found, ["part", "ordinal"]).select("doc_id", "part", "start", "n_tokens")
