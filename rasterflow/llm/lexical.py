"""Ranked lexical search on bit-sliced Bloom signatures.

Every document has a Bloom signature of its terms: for each of them the facts "occurs at
least 1, 2, 3, 5 times" that hold. Documents of similar size are put together in blocks
and their signatures transposed: slice b of a block is a bitmap over its documents, their
bit b. A fact's slices, taken together by AND, mark all documents for which it holds, and
some others. So they bound from above how often a term occurs in each document, and the
weighted sum over a query's terms bounds its score. Nothing of the index depends on the
queries.

A search reads the slices of the query's terms. The documents with the highest bounds are
scored exactly; the tenth best of these scores is a threshold that no document of the
result lies under. All documents whose bound reaches it are scored exactly, from their
texts. So the result is exact, however good the signatures are.

Queries are taken in blocks of bounded size, against all documents. Copies of a text have
one digest and are scored once; of each text only the smallest ids can be in a result.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, map_batches, written

#: Terms in UTF-8, after A-Z was lowered, and the same for texts in Spark.
TERM = re.compile(rb"[0-9a-z\x80-\xff]+")
TERM_TEXT = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: A signature has facts for these numbers of occurrences.
LEVELS = (1, 2, 3, 5)
#: Bits of a fact, and least bits of a signature for each fact.
PROBES, FACT_BITS = 4, 8
#: Documents and bytes of a block.
BLOCK_ROWS, BLOCK_BYTES = 1024, 1 << 20
#: Documents whose bounds are highest that are scored first, for each query.
FIRST = 40
#: Terms of queries that one block of them has, and those that are looked up at once.
QUERY_TERMS, AT_ONCE = 100_000, 2048
#: Rows that are broadcast at most.
BROADCAST_ROWS = 50_000


def terms_of(text: str | None) -> list[bytes]:
    return TERM.findall((text or "").encode().lower())


def hashed(term: bytes) -> int:
    from xxhash import xxh3_64_intdigest

    return xxh3_64_intdigest(term)


def places(hashes, level: int, bits: int):
    """The ``PROBES`` bits of a fact: row i has those of ``hashes[i]`` at a level, in a signature of ``bits``."""
    import numpy as np

    salt = np.arange(1, PROBES + 1, dtype=np.uint64) + np.uint64(level * PROBES)
    x = hashes[:, None] ^ (salt * np.uint64(0x9E3779B97F4A7C15))[None, :]
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((x ^ (x >> np.uint64(29))) >> np.uint64(8)) % np.uint64(bits)


class Blocks:
    """Blocks of an index that are being filled, one for each size class of signatures."""

    def __init__(self):
        self.open: dict[int, list] = {}

    def add(self, doc_id, text: str | None) -> pa.RecordBatch | None:
        from hashlib import md5

        import numpy as np

        counts = Counter(terms_of(text))
        facts = [np.array([hashed(t) for t, n in counts.items() if n >= least], np.uint64) for least in LEVELS]
        bits = FACT_BITS << max(4, (sum(map(len, facts)) - 1).bit_length())
        set_ = np.concatenate([places(h, k, bits).ravel() for k, h in enumerate(facts)])
        rows = self.open.setdefault(bits, [])
        rows.append((doc_id, md5((text or "").encode()).digest(), sum(counts.values()), set_))
        return self.close(bits) if len(rows) >= BLOCK_ROWS or len(rows) * bits >= 8 * BLOCK_BYTES else None

    def close(self, bits: int) -> pa.RecordBatch:
        import numpy as np

        rows = self.open.pop(bits)
        stride = -(-len(rows) // 8)
        slices = np.zeros((bits, stride), np.uint8)
        for i, (_, _, _, set_) in enumerate(rows):
            slices[set_.astype(np.int64), i >> 3] |= 128 >> (i & 7)
        n = [r[2] for r in rows]
        values = [[bits], [[r[0] for r in rows]], [[r[1] for r in rows]], [n], [sum(x > 0 for x in n)], [sum(n)], [slices.tobytes()]]
        kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.binary()), pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds, strict=True)], names=["bits", "ids", "digests", "lengths", "n_docs", "n_terms", "slices"])


INDEX = "bits long, ids array<long>, digests array<binary>, lengths array<long>, n_docs long, n_terms long, slices binary"


def build_index(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The written index of ``docs``: a row for each block, with its documents' ids, text digests and lengths, and its slices.

    Null texts are empty; they are in the index, with no terms.
    """

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = Blocks()
        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if (done := blocks.add(i, t)) is not None:
                    yield done
        for bits in sorted(blocks.open):
            yield blocks.close(bits)

    return written(map_batches(docs.select(F.col(doc_id).cast("long"), F.col(text)), build, INDEX), "signatures")


@dataclass
class Queries:
    """A block of queries: number, terms, times and weight of each distinct term, query by query."""

    numbers: list[int]
    terms: list[bytes]
    weights: list[int]  # a term's weight by its repeats
    starts: list[int]  # where the queries begin, and the end
    docs: int
    words: int

    def damping(self, length: int) -> int:
        return 100 - 75 + (75 * length * self.docs) // self.words

    def scorer(self):
        """A function of (text, places of queries) that gives their exact scores."""
        ours: dict[bytes, list[tuple[int, int]]] = {}
        for q in range(len(self.numbers)):
            for k in range(self.starts[q], self.starts[q + 1]):
                ours.setdefault(self.terms[k], []).append((q, self.weights[k]))

        def score(text: str | None, wanted: set[int]) -> Counter:
            found = terms_of(text)
            m, sums = self.damping(len(found)), Counter()
            for term, tf in Counter(t for t in found if t in ours).items():
                part = 1_000_000_000 * tf // (1000 * tf + 8 * m)
                for q, w in ours[term]:
                    if q in wanted:
                        sums[q] += w * part
            return sums

        return score

    def bounds(self, bits: int, lengths, slices: bytes) -> Iterator[tuple[int, object]]:
        """(place of the first query, upper bounds of some queries' scores for a block's documents)."""
        import numpy as np

        n = len(lengths)
        rows = np.frombuffer(slices, np.uint8).reshape(bits, -1)
        sizes, back = np.unique(np.asarray(lengths, np.int64), return_inverse=True)
        # a level's documents have fewer occurrences than the next level asks for; the last one's no more than words
        most = [*(x - 1 for x in LEVELS[1:]), None]
        part = [[0] * len(sizes), *([1_000_000_000 * (k := t if t else max(1, int(s))) // (1000 * k + 8 * self.damping(int(s))) for s in sizes] for t in most)]
        part = np.array(part, np.int64)[:, back]
        hashes, weights, starts = np.array([hashed(t) for t in self.terms], np.uint64), np.array(self.weights, np.int64), np.array(self.starts)
        lo = 0
        while lo < len(self.numbers):
            hi = max(lo + 1, int(np.searchsorted(starts, starts[lo] + AT_ONCE, "right")) - 1)
            sums = np.zeros((hi - lo, n), np.int64)
            for a in range(starts[lo], starts[hi], AT_ONCE):
                b = min(a + AT_ONCE, starts[hi])
                level = np.zeros((b - a, n), np.uint8)
                holds = np.ones((b - a, n), bool)
                for k in range(len(LEVELS)):
                    at = places(hashes[a:b], k, bits).astype(np.int64)
                    both = rows[at[:, 0]]
                    for p in range(1, PROBES):
                        both = both & rows[at[:, p]]
                    holds &= np.unpackbits(both, axis=1, count=n).view(bool)
                    level += holds
                value = np.take_along_axis(part, level.astype(np.int64), axis=0) * weights[a:b, None]
                of = np.searchsorted(starts, np.arange(a, b), "right") - 1 - lo
                here = np.flatnonzero(np.diff(of, prepend=-1))
                sums[of[here]] += np.add.reduceat(value, here, axis=0)
            yield lo, sums
            lo = hi


def frequencies(docs: DataFrame, text: str, terms: DataFrame) -> DataFrame:
    """``(term, df)``: documents that hold each of ``terms(term)``."""
    found = docs.select(F.explode(F.array_distinct(F.regexp_extract_all(ascii_lower(F.col(text)), F.lit(TERM_TEXT), F.lit(0)))).alias("term"))
    return found.join(F.broadcast(terms), "term").groupBy("term").agg(F.count("*").alias("df"))


def query_blocks(queries: DataFrame, docs: DataFrame, text: str, index: DataFrame) -> Iterator[Queries]:
    """Queries ``(number, term, times)`` in blocks of about ``QUERY_TERMS`` terms, with weights from the statistics of all ``docs``."""
    n, words = index.agg(F.sum("n_docs"), F.sum("n_terms")).first()
    if not words:
        return
    sizes = queries.agg(F.count("*")).first()[0]
    count = -(-sizes // QUERY_TERMS)
    for k in range(count):
        block = written(queries.where(F.pmod(F.xxhash64("number"), F.lit(count)) == k), "queries")
        df = frequencies(docs, text, block.select("term").distinct())
        rows = sorted(block.join(df, "term").select("number", "term", "times", "df").collect())  # bounded: a block of queries
        out = Queries([], [], [], [], n, words)
        for r in rows:
            if not out.numbers or out.numbers[-1] != r.number:
                out.numbers.append(r.number)
                out.starts.append(len(out.terms))
            out.terms.append(r.term.encode())
            out.weights.append(r.times * math.floor(1000 * math.log((2 * n + 2) / (2 * r.df + 1))))
        out.starts.append(len(out.terms))
        yield out


def highest(index: DataFrame, block: Queries, first: int) -> DataFrame:
    """``(query, digest)``: for each query the ``first`` texts with the highest bounds."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        best: list[dict[bytes, int]] = [{} for _ in block.numbers]
        least = np.zeros(len(best), np.int64)
        for b in batches:
            for bits, digests, lengths, slices in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                for lo, sums in block.bounds(bits, lengths, slices):
                    for q in np.flatnonzero(sums.max(axis=1) > least[lo : lo + len(sums)]):
                        bound, top = sums[q], best[lo + q]
                        some = np.flatnonzero(bound > least[lo + q])
                        top.update((digests[i], int(bound[i])) for i in some)
                        if len(top) > first:
                            best[lo + q] = dict(sorted(top.items(), key=lambda x: (-x[1], x[0]))[:first])
                            least[lo + q] = min(best[lo + q].values())
        rows = [(q, d, u) for q, top in enumerate(best) for d, u in top.items()]
        for at in range(0, len(rows), 5000):
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows[at : at + 5000]], t) for k, t in enumerate((pa.int32(), pa.binary(), pa.int64()))], names=["query", "digest", "bound"])

    tops = map_batches(index.select("bits", "digests", "lengths", "slices"), scan, "query int, digest binary, bound long").distinct()
    order = Window.partitionBy("query").orderBy(F.desc("bound"), "digest")
    return written(tops.withColumn("place", F.row_number().over(order)).where(F.col("place") <= first).select("query", "digest"), "first")


def reaching(index: DataFrame, block: Queries, least: list[int]) -> DataFrame:
    """``(query, digest)``: all texts whose bound for a query is its ``least`` or more."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        bar = np.array(least, np.int64)
        for b in batches:
            for bits, digests, lengths, slices in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                for lo, sums in block.bounds(bits, lengths, slices):
                    q, i = np.nonzero(sums >= bar[lo : lo + len(sums), None])
                    pairs = sorted({(int(lo + a), digests[d]) for a, d in zip(q, i, strict=True)})
                    if pairs:
                        yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int32()), pa.array([p[1] for p in pairs], pa.binary())], names=["query", "digest"])

    return written(map_batches(index.select("bits", "digests", "lengths", "slices"), scan, "query int, digest binary").distinct(), "reaching")


def owners(index: DataFrame, digests: DataFrame, most: int) -> DataFrame:
    """``(digest, ids)``: the ``most`` smallest ids of the documents with each of ``digests``, null last."""
    rows = index.select(F.explode(F.arrays_zip("ids", "digests")).alias("d")).select(F.col("d.ids").alias("id"), F.col("d.digests").alias("digest"))
    wanted = rows.join(broadcast_if_small(digests), "digest")
    order = Window.partitionBy("digest").orderBy(F.col("id").asc_nulls_last())
    few = wanted.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)
    return few.groupBy("digest").agg(F.array_sort(F.collect_list(F.struct(F.col("id").isNull().alias("none"), "id"))).alias("ids"))


def broadcast_if_small(table: DataFrame) -> DataFrame:
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table


def rescored(pairs: DataFrame, docs: DataFrame, doc_id: str, text: str, index: DataFrame, block: Queries, most: int) -> DataFrame:
    """The written ``(query, digest, score, ids)`` of all ``pairs(query, digest)`` that have a score above 0, from the texts."""
    by = written(pairs.groupBy("digest").agg(F.collect_list("query").alias("queries")), "rescored")  # no longer than a block of queries
    ids = written(owners(index, by.select("digest"), most), "owners")
    wanted = by.join(ids, "digest").select("digest", "queries", F.col("ids")[0]["id"].alias("own"))
    # of copies the one with the smallest id is read
    one = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"), F.unhex(F.md5(F.coalesce(F.col(text), F.lit("")))).alias("digest"))
    found = one.join(broadcast_if_small(written(wanted, "wanted")), "digest").where(F.col("id").eqNullSafe(F.col("own"))).select("digest", "queries", "text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = block.scorer()
        for b in batches:
            rows = [(q, d, s) for d, wanted, t in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True) for q, s in score(t, set(wanted)).items() if s > 0]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int32(), pa.binary(), pa.int64()))], names=["query", "digest", "score"])

    return written(map_batches(found, work, "query int, digest binary, score long").distinct().join(ids, "digest"), "scores")


def ranked(scores: DataFrame, most: int) -> DataFrame:
    """The ``most`` best rows ``(query, rank, id, score)`` of each query; equal scores by id, null last."""
    rows = scores.select("query", "score", F.explode("ids").alias("o")).select("query", "score", "o.none", "o.id")
    order = Window.partitionBy("query").orderBy(F.desc("score"), "none", "id")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most).select("query", "rank", "id", "score")


def search(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", most: int = 10, first: int = FIRST) -> DataFrame:
    """``(item_id, rank, doc_id, score)``: the ``most`` best documents of each item, those with a score above 0.

    Ranks count from 1; equal scores stand in order of ``doc_id`` (null last). Null and
    empty texts have no terms: such documents are found by no item, such items find none.
    Repeated documents have a rank each. Every row of ``items`` is an item, whatever its
    id. Of an empty table, or for no items, the result is empty. ``docs`` is read several
    times, so it has to be a table, or a plan that gives the same rows each time.
    """
    index = build_index(docs, doc_id, text)
    numbered = written(items.select(F.col(item_id).alias("item"), F.col(item_text).alias("text")).withColumn("number", F.monotonically_increasing_id()), "items")
    terms = numbered.select("number", F.explode(F.regexp_extract_all(ascii_lower(F.col("text")), F.lit(TERM_TEXT), F.lit(0))).alias("term"))
    out = None
    for block in query_blocks(written(terms.groupBy("number", "term").agg(F.count("*").alias("times")), "terms"), docs, text, index):
        tops = rescored(highest(index, block, first), docs, doc_id, text, index, block, most)
        least = [1] * len(block.numbers)
        for r in ranked(tops, most).where(F.col("rank") == most).collect():  # a row for each query of the block
            least[r["query"]] = r["score"]
        rest = reaching(index, block, least).join(tops.select("query", "digest"), ["query", "digest"], "left_anti")
        scores = tops.unionAll(rescored(rest, docs, doc_id, text, index, block, most))
        names = docs.sparkSession.createDataFrame(list(enumerate(block.numbers)), "query int, number long")
        result = ranked(scores, most).join(F.broadcast(names), "query").select("number", "rank", "id", "score")
        out = result if out is None else out.unionAll(result)
    if out is None:
        return numbered.where("false").select(F.col("item").alias("item_id"), F.lit(0).alias("rank"), F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score"))
    return out.join(numbered.select("number", "item"), "number").select(F.col("item").alias("item_id"), "rank", F.col("id").alias("doc_id"), "score")
