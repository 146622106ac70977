"""Target-distribution importance resampling with n-gram hashes from prefix CRCs.

A document is normalised to its words with one space between them and scanned once: the
running CRC-32 at the end of each word is kept. Appending n bytes to a text shifts its CRC
by n bytes in GF(2), so the CRC of any stretch is the prefix CRC at its end, exclusive-or
the prefix CRC at its begin shifted by the stretch's length. All n-grams of all lengths
follow from these prefixes, for a whole batch at once; no n-gram is ever put together.

Buckets of n-gram hashes are counted over all documents and over the target. A bucket's
gain is the logarithm of how much likelier the target is to have it, a document's weight
the sum of the gains of its n-grams, and documents are drawn without replacement by their
weight plus a Gumbel deviate of their id.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, map_batches, written
from .simhash import from_text

#: Words in UTF-8, after A-Z was lowered: letters, digits, and bytes of characters that are not ASCII.
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
BUCKETS, LONGEST, PERCENT, LEAST_WORDS, SEED = 10_000, 3, 5, 20, 42
#: Bytes of text whose words are taken apart at once.
AT_ONCE = 1 << 20


@lru_cache(maxsize=64)
def shift_table(power: int):
    """Tables of the shift by ``2 ** power`` bytes: entry ``[k, b]`` is what byte k of a CRC contributes with value b.

    The shift is linear in GF(2). By one byte it is the step of the CRC itself for a zero
    byte; squaring the operator doubles the bytes.
    """
    import numpy as np

    bits = np.uint32(1) << np.arange(32, dtype=np.uint32)
    if power == 0:
        column = bits.copy()
        for _ in range(8):
            column = (column >> np.uint32(1)) ^ np.where(column & np.uint32(1), np.uint32(0xEDB88320), np.uint32(0))
    else:
        column = apply_shift(shift_table(power - 1), apply_shift(shift_table(power - 1), bits))
    values = np.arange(256, dtype=np.uint32)
    out = np.zeros((4, 256), np.uint32)
    for k in range(4):
        for b in range(8):
            out[k] ^= np.where(values >> np.uint32(b) & np.uint32(1), column[8 * k + b], np.uint32(0))
    return out


def apply_shift(table, crc):
    return table[0][crc & 255] ^ table[1][crc >> 8 & 255] ^ table[2][crc >> 16 & 255] ^ table[3][crc >> 24]


def shifted(crc, n):
    """CRCs shifted by ``n`` bytes each."""
    import numpy as np

    out, rest, power = crc.copy(), n.astype(np.int64), 0
    while rest.any():
        odd = np.flatnonzero(rest & 1)
        out[odd] = apply_shift(shift_table(power), out[odd])
        rest, power = rest >> 1, power + 1
    return out


def space_after(crc):
    """CRCs of the same texts with a space behind them."""
    import numpy as np

    state = crc ^ np.uint32(0xFFFFFFFF)
    low = (state ^ np.uint32(0x20)) & np.uint32(0xFF)
    return shift_table(0)[0][low] ^ (state >> np.uint32(8)) ^ np.uint32(0xFFFFFFFF)


def prefix_crcs(words: list[bytes]) -> list[int]:
    """The running CRC-32 of the normalised text at the end of each word."""
    return list(accumulate([words[0], *[b" " + w for w in words[1:]]], lambda c, p: zlib.crc32(p, c), initial=0))[1:] if words else []


def gram_crcs(texts: list[list[bytes]], longest: int = LONGEST):
    """For texts as lists of words: CRC-32 of every run of 1 to ``longest`` words, and the number of the text each is from."""
    import numpy as np

    sizes = np.array([len(w) for w in texts], np.int64)
    ends = np.array([c for words in texts for c in prefix_crcs(words)], np.uint32)
    lengths = np.array([len(w) for words in texts for w in words], np.int64)
    owner = np.repeat(np.arange(len(texts)), sizes)
    first = np.zeros(len(ends), bool)
    first[(np.cumsum(sizes) - sizes)[sizes > 0]] = True
    before = np.zeros(len(ends), np.uint32)
    before[1:] = space_after(ends[:-1])
    before[first] = 0
    total = np.concatenate([[0], np.cumsum(lengths + 1)])
    crcs, owners = [], []
    for n in range(1, longest + 1):
        begin = np.arange(max(0, len(ends) - n + 1))
        begin = begin[owner[begin] == owner[begin + n - 1]]
        crcs.append(ends[begin + n - 1] ^ shifted(before[begin], total[begin + n] - total[begin] - 1))
        owners.append(owner[begin])
    return np.concatenate(crcs), np.concatenate(owners)


def parts(texts: list[str | None]) -> Iterator[list[list[bytes]]]:
    """Texts as words, in runs whose lists stay small."""
    run, size = [], 0
    for t in texts:
        raw = (t or "").encode().lower()
        if run and size + len(raw) > AT_ONCE:
            yield run
            run, size = [], 0
        run.append(WORD.findall(raw))
        size += len(raw)
    if run:
        yield run


def bucket_counts(docs: DataFrame, text: str = "text", buckets: int = BUCKETS, longest: int = LONGEST) -> DataFrame:
    """``(bucket, n)``: n-grams of all texts by bucket; each task counts its own first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        n = np.zeros(buckets, np.int64)
        for b in batches:
            for run in parts(b.column(0).to_pylist()):
                n += np.bincount(gram_crcs(run, longest)[0] % np.uint32(buckets), minlength=buckets)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(n[some])], names=["bucket", "n"])

    return map_batches(docs.select(text), count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(docs: DataFrame, target: DataFrame, text: str = "text", target_text: str = "text", buckets: int = BUCKETS, longest: int = LONGEST) -> list[int]:
    """The gain of each bucket, in thousandths, rounded down; ``buckets`` numbers come to the driver, whatever the data."""
    spark = docs.sparkSession
    s, t = bucket_counts(docs, text, buckets, longest), bucket_counts(target, target_text, buckets, longest)
    both = spark.range(buckets).withColumnRenamed("id", "bucket").join(s.withColumnRenamed("n", "s"), "bucket", "left").join(t.withColumnRenamed("n", "t"), "bucket", "left")
    counts = written(both.select("bucket", F.coalesce("s", F.lit(0)).alias("s"), F.coalesce("t", F.lit(0)).alias("t")), "buckets")
    sums = counts.agg(F.sum("s").alias("all_s"), F.sum("t").alias("all_t"))
    ratio = ((F.col("t") + 1) * (F.col("all_s") + buckets)).cast("double") / ((F.col("s") + 1) * (F.col("all_t") + buckets)).cast("double")
    rows = counts.join(F.broadcast(sums), F.lit(True)).select("bucket", F.floor(1000 * F.log(ratio)).cast("long").alias("gain")).collect()
    gains = [0] * buckets
    for r in rows:
        gains[r.bucket] = r.gain
    return gains


def weigh(docs: DataFrame, gains: list[int], text: str = "text", longest: int = LONGEST, columns: tuple[str, str, str] = ("n_words", "n_features", "weight")) -> DataFrame:
    """``docs`` without ``text``, with its number of words and n-grams and the sum of their gains."""

    def work(texts: list) -> list:
        import numpy as np

        table = np.array(gains, np.int64)
        words, grams, weights = [], [], []
        for run in parts(texts):
            crcs, owner = gram_crcs(run, longest)
            sums = np.zeros(len(run), np.int64)
            np.add.at(sums, owner, table[crcs % np.uint32(len(table))])
            words += map(len, run)
            grams += np.bincount(owner, minlength=len(run)).tolist()
            weights += sums.tolist()
        return [pa.array(x, pa.int64()) for x in (words, grams, weights)]

    return from_text(docs, text, ", ".join(f"`{c}` long" for c in columns), work)


def gumbel(doc_id: Column, seed: int = SEED) -> Column:
    """A Gumbel deviate of an id in thousandths, rounded down, the same on every run; a null id counts as an empty one."""
    digits = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8)
    u = (F.conv(digits, 16, 10).cast("double") + 0.5) / float(1 << 32)
    return F.floor(-1000 * F.log(-F.log(u))).cast("long")


def resample(docs: DataFrame, target: DataFrame, doc_id: str = "doc_id", text: str = "text", target_text: str = "text", percent: int = PERCENT, least_words: int = LEAST_WORDS, buckets: int = BUCKETS, longest: int = LONGEST, seed: int = SEED) -> DataFrame:
    """``docs`` without ``text``, with ``n_words``, ``n_features``, ``weight``, ``score`` and ``rank``.

    ``percent`` of the documents that have ``least_words`` are drawn: those with the highest
    scores, equal ones in order of ``doc_id`` (null last; rows that agree in both too in any
    order). The rank of others is null. Null and empty texts have no words and weight 0;
    repeated rows are documents of their own; an empty table gives an empty result, an
    empty target gains that only follow the documents. Other columns pass; those named like
    a result are replaced.

    Ranks come from a range shuffle of the scored rows, which have no text. Rows are told
    apart by their place in a written table, so a score that many rows share spreads over
    partitions; each partition's offset is a sum over the counts of partitions.
    """
    results = ("n_words", "n_features", "weight", "score", "rank")
    keep = docs.drop(*[c for c in docs.columns if c.lower() in results])
    row, place, part, n, first, before = fresh(keep, "_row", "_place", "_part", "_n", "_first", "_before")
    gains = bucket_gains(docs, target, text, target_text, buckets, longest)
    scored = written(weigh(keep, gains, text, longest).withColumn("score", F.col("weight") + gumbel(F.col(doc_id), seed)), "scored")
    able = scored.where(F.col("n_words") >= least_words)
    drawn = percent * able.count() // 100
    order = [F.desc("score"), F.col(doc_id).asc_nulls_last(), F.col(row)]
    parts_ = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = written(able.withColumn(row, F.monotonically_increasing_id()).repartitionByRange(parts_, *order).sortWithinPartitions(*order).drop(row).withColumn(place, F.monotonically_increasing_id()), "places")
    counts = placed.groupBy(F.shiftright(place, 33).alias(part)).agg(F.count("*").alias(n), F.min(place).alias(first))
    offsets = written(counts.withColumn(before, F.sum(n).over(Window.orderBy(part)) - F.col(n)).select(F.col(part), first, before), "offsets")  # a row for each partition
    ranked = placed.withColumn(part, F.shiftright(place, 33)).join(F.broadcast(offsets), part)
    rank = F.col(before) + F.col(place) - F.col(first) + 1
    out = ranked.withColumn("rank", F.when(rank <= drawn, rank)).select(*scored.columns, "rank")
    return out.unionAll(scored.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long")).select(*out.columns))
