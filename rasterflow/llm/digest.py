"""Exact document fingerprints of a canonical form.

Canonical form: Unicode NFKC, case folding, NFKC again, every run of white space one space,
none at the ends. The fingerprint is the wide (128-bit) XXH3 of its UTF-8. Equal
fingerprints are not taken on trust: within each bucket of equal digests the canonical
bytes are compared, and should two texts differ, all but the first in byte order get a
numbered fingerprint of their own.

Cost: digests are computed where the rows lie. Only rows of buckets with two or more
members have their canonical texts compared, as smallest and largest of the bucket, which
Spark combines before the shuffle; so a bucket of a third of all rows is no single task's
work, and no bucket is ever gathered.
"""

from __future__ import annotations

import hashlib
import math
import unicodedata
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, map_batches, written

#: Digests with several members are broadcast up to this many (about 50 bytes each), else shuffled.
BROADCAST_ROWS = 200_000


def canonical(text: str | None) -> str:
    """Null is empty."""
    t = text or ""
    if t.isascii():
        return " ".join(t.lower().split())
    t = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", t).casefold())
    return " ".join(t.split())


def digest_hex(canon: str, bits: int = 128) -> str:
    from xxhash import xxh3_128_hexdigest

    return xxh3_128_hexdigest(canon.encode("utf-8", "surrogatepass"))[: bits // 4]


def add_columns(df: DataFrame, columns: str, f: Callable[[dict], list]) -> DataFrame:
    """``df`` with what ``f`` makes of each batch's columns, in the order of ``columns``."""
    names = df.columns
    new = [x.split() for x in columns.split(", ")]
    types = {"string": pa.string(), "long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "int": pa.int32(), "binary": pa.binary()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = f({n: b.column(i) for i, n in enumerate(names)})
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(v, types[t]) for v, (_, t) in zip(made, new, strict=True))], names=[*names, *(n for n, _ in new)])

    return map_batches(df, run, ", ".join([*(f"`{x.name}` {x.dataType.simpleString()}" for x in df.schema), columns]))


def with_digest(docs: DataFrame, text: str = "text", out: str = "_digest", bits: int = 128) -> DataFrame:
    return add_columns(docs, f"{out} string", lambda c: [[digest_hex(canonical(t), bits) for t in c[text].to_pylist()]])


def members_of(rows: DataFrame, digests: DataFrame, digest: str) -> DataFrame:
    """Rows whose digest is in ``digests``, a written table of distinct values in column ``_many``."""
    many = F.broadcast(digests) if digests.count() <= BROADCAST_ROWS else digests
    return rows.join(many, rows[digest] == many["_many"], "left_semi")


def collisions(texts: DataFrame, digest: str, text: str) -> DataFrame | None:
    """``(digest, canon, number)`` of different canonical texts that share a digest, or None as good as always.

    ``texts`` has rows whose digests occur more than once. Of each bucket only the smallest
    and the largest text are kept, before the shuffle. Numbers start at 0.
    """
    canon = add_columns(texts.select(digest, text), "canon string", lambda c: [[canonical(t) for t in c[text].to_pylist()]]).select(F.col(digest).alias("digest"), "canon")
    bad = written(canon.groupBy(F.col("digest").alias("_many")).agg(F.min("canon").alias("lo"), F.max("canon").alias("hi")).where("lo <> hi").select("_many"), "differing")
    if bad.isEmpty():
        return None
    differ = members_of(canon.distinct(), bad, "digest")
    return written(differ.withColumn("number", F.row_number().over(Window.partitionBy("digest").orderBy("canon")) - 1), "collisions")


def resolve(rows: DataFrame, digest: str, text: str, differ: DataFrame | None, out: str) -> DataFrame:
    """``rows`` with fingerprints: the digest, and a number where bytes differed from the bucket's first."""
    if differ is None:
        return rows.withColumn(out, F.col(digest))
    own, d, c, n = fresh(rows, "_canon", "_d", "_c", "_number")
    canon = add_columns(rows, f"{own} string", lambda x: [[canonical(t) for t in x[text].to_pylist()]])
    named = differ.select(F.col("digest").alias(d), F.col("canon").alias(c), F.col("number").alias(n))
    found = canon.join(named, (F.col(digest) == F.col(d)) & (F.col(own) == F.col(c)), "left")
    return found.withColumn(out, F.when(F.col(n) > 0, F.concat_ws("-", digest, n)).otherwise(F.col(digest))).drop(own, d, c, n)


def exact_fingerprints(docs: DataFrame, text: str = "text", out: str = "fingerprint", bits: int = 128) -> DataFrame:
    """``docs`` with the verified fingerprint of ``text`` in column ``out``.

    Rows have equal fingerprints just if their canonical texts are equal byte for byte.
    Null is empty, and empty and blank texts share a fingerprint. Repeated rows all stay;
    an empty table gives an empty result; a column named ``out`` is replaced.
    """
    (name,) = fresh(docs, "_digest")
    rows = with_digest(docs.drop(out), text, name, bits)
    many = written(rows.groupBy(F.col(name).alias("_many")).count().where("count > 1").select("_many"), "digests")
    differ = collisions(members_of(rows.select(name, text), many, name), name, text)
    return resolve(rows, name, text, differ, out).drop(name)


def with_next(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, text, next_text)``: each row with the text of the row that follows in descending ``doc_id``.

    After the last comes the first; a single row follows itself. Null ids stand last, and
    rows with equal ids in order of the md5 of their texts. Null texts count as empty. An
    empty table gives an empty result.

    Ids are cut into lanes of about equal size at approximate quantiles; each lane is sorted
    by itself, and the first row of a lane is a guest at the end of the lane before. An id
    that fills a lane or more, and null ids, are cut into 256 lanes by the digest of the
    text. (Rows that are equal in id and text stay in one lane. Ids of 2 ** 53 and more are
    cut by quantiles only.)
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    lanes = 3 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = rows.stat.approxQuantile("doc_id", [k / lanes for k in range(1, lanes)], 0.2 / lanes)
    hot = sorted({a for a, b in zip(found, found[1:], strict=False) if a == b and abs(a) < 2**53})
    edges = sorted({*found, *(math.nextafter(h, math.inf) for h in hot)}) or [0.0]  # an empty table, or one without ids
    bucket = Bucketizer(splits=[-math.inf, *edges, math.inf], inputCol="_place", outputCol="_bucket")
    rows = bucket.transform(rows.withColumn("_place", F.coalesce(F.col("doc_id").cast("double"), F.lit(0.0))))
    lane = F.when(F.col("doc_id").isNull(), len(edges) + 1).otherwise(F.lit(len(edges)) - F.col("_bucket").cast("int"))
    wide = F.col("doc_id").isNull() | F.col("_place").isin(hot) if hot else F.col("doc_id").isNull()
    rows = rows.withColumn("digest", F.md5(F.col("text").cast("binary")))
    rows = rows.select("doc_id", "text", "digest", (lane * 256 + F.when(wide, F.conv(F.substring("digest", 1, 2), 16, 10).cast("int")).otherwise(0)).alias("lane"))
    heads = rows.groupBy("lane").agg(F.max("doc_id").alias("top")).withColumnRenamed("lane", "of")
    # first rows of lanes, at most one for each
    at_top = (F.col("lane") == F.col("of")) & F.col("doc_id").eqNullSafe(F.col("top"))
    firsts = rows.join(F.broadcast(heads), at_top).groupBy("lane").agg(F.min(F.struct("digest", "text")).alias("x"), F.first("doc_id").alias("doc_id"))
    around = Window.orderBy("lane")
    to = F.coalesce(F.lag("lane").over(around), F.max("lane").over(around.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    guests = firsts.select("doc_id", "x.text", "x.digest", to.alias("lane"), F.lit(1).alias("guest"))
    every = rows.withColumn("guest", F.lit(0)).unionByName(guests)
    following = Window.partitionBy("lane").orderBy("guest", F.col("doc_id").desc_nulls_last(), "digest", "text")
    nexts = every.withColumns({"next_id": F.lead("doc_id").over(following), "next_text": F.lead("text").over(following)})
    return nexts.where("guest = 0").select("doc_id", "text", "next_id", "next_text")


def edited_fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", bits: int = 128) -> DataFrame:
    """Each row's fingerprint beside that of its edited text and of the next row.

    The edited text: the last ``floor(n_chars / 2)`` code points are replaced by as many
    from the beginning of the next text (all, if it has fewer), see :func:`with_next`.
    ``near_edited`` and ``near_next`` are 1.0 where the fingerprints are equal, that is,
    where the canonical texts are equal, and 0.0 otherwise. Null texts are empty; null ids
    and repeated rows have a result each; an empty table gives an empty result; other
    columns are not read.
    """

    def work(c: dict) -> list:
        out: list = [[] for _ in range(6)]
        for t, n in zip(c["text"].to_pylist(), c["next_text"].to_pylist(), strict=True):
            half = len(t) // 2
            edited = t[: len(t) - half] + n[:half]
            own, other, follow = canonical(t), canonical(edited), canonical(n)
            for column, value in zip(out, (len(t), hashlib.sha256(edited.encode()).hexdigest(), digest_hex(own, bits), digest_hex(other, bits), float(own == other), float(own == follow)), strict=True):
                column.append(value)
        return out

    columns = "n_chars long, edited_sha256 string, _digest string, _edited_digest string, near_edited double, near_next double"
    near = add_columns(with_next(docs, doc_id, text), columns, work)
    rows = written(near.select("*", F.xxhash64("text").alias("_key"), F.xxhash64("next_text").alias("_next_key")).drop("text", "next_text"), "edited")
    result = rows.withColumnsRenamed({"_digest": "fingerprint", "_edited_digest": "edited_fingerprint"}).drop("next_id", "_key", "_next_key")
    both = rows.select(F.col("_digest").alias("_many")).unionAll(rows.select("_edited_digest"))
    many = written(both.groupBy("_many").count().where("count > 1").select("_many"), "digests")
    if many.isEmpty():
        return result
    # texts of such buckets, read again; an edited text is made again from its two rows
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    own = members_of(with_digest(texts.select("text"), "text", "_digest", bits), many, "_digest")
    edits = members_of(rows, many, "_edited_digest").groupBy("_edited_digest", "_key", "_next_key").agg(F.min(F.struct("doc_id", "next_id")).alias("x")).select("_edited_digest", "_key", "_next_key", "x.*")
    edits = written(edits, "edits")
    needed = written(edits.select(F.col("doc_id").alias("_id"), F.col("_key").alias("_k")).unionAll(edits.select("next_id", "_next_key")).distinct(), "edit-keys")
    keys = F.broadcast(needed) if needed.count() <= BROADCAST_ROWS else needed
    found = texts.join(keys, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_k"))).groupBy("_id", "_k").agg(F.min("text").alias("_text"))
    first = found.select(F.col("_id").alias("i1"), F.col("_k").alias("k1"), F.col("_text").alias("text"))
    second = found.select(F.col("_id").alias("i2"), F.col("_k").alias("k2"), F.col("_text").alias("next_text"))
    pairs = edits.join(first, F.col("doc_id").eqNullSafe(F.col("i1")) & (F.col("_key") == F.col("k1"))).join(second, F.col("next_id").eqNullSafe(F.col("i2")) & (F.col("_next_key") == F.col("k2")))
    made = add_columns(pairs.select("text", "next_text"), "edited string, _digest string", lambda c: _edits(c, bits))
    own = own.select("_digest", "text").unionByName(made.select("_digest", F.col("edited").alias("text")))
    differ = collisions(own, "_digest", "text")
    if differ is None:
        return result
    # rare: name every row by its canonical texts
    made = add_columns(with_next(docs, doc_id, text), "edited string, _edited_digest string", lambda c: _edits(c, bits))
    full = add_columns(with_digest(made, "text", "_digest", bits), columns.replace("_digest", "_unused").replace("_edited_unused", "_unused2"), work)
    named = resolve(resolve(full, "_digest", "text", differ, "fingerprint"), "_edited_digest", "edited", differ, "edited_fingerprint")
    return named.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def _edits(c: dict, bits: int) -> list:
    edited = [t[: len(t) - len(t) // 2] + n[: len(t) // 2] for t, n in zip(c["text"].to_pylist(), c["next_text"].to_pylist(), strict=True)]
    return [edited, [digest_hex(canonical(e), bits) for e in edited]]
