"""Token ids in files of shuffled planes.

File layout, numbers little-endian:

    b"PLN1" | chunks | document table | chunk index | footer (JSON) | footer length u32 | b"PLN1"

A chunk holds up to ``chunk_ids`` ids. Its ids are transposed into planes: byte planes (all
first bytes, then all second bytes, ...) or bit planes (bit 0 of all ids, then bit 1, ...),
and each plane is compressed by itself with zstandard. The chunk index has, for each
chunk, its offset, number of ids and the compressed size of each plane, so any chunk can
be read alone. The document table has doc_id, a null flag and the number of ids of each
document, in file order.
"""

from __future__ import annotations

import io
import json
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SafeFile, filesystem, map_batches, new_dir, partition_id, slices, tokenizer_path, written

MAGIC = b"PLN1"
CHUNK_IDS = 1 << 16
END_ID = 2
#: Entries that a worker keeps of what it has encoded; all go when there are more.
CACHE = 1_000_000


def to_planes(ids: np.ndarray, kind: str) -> list[bytes]:
    """The planes of 32-bit ids: 4 byte planes or 32 bit planes."""
    raw = np.ascontiguousarray(ids, dtype="<u4").view(np.uint8).reshape(-1, 4)
    if kind == "byte":
        return [raw[:, k].tobytes() for k in range(4)]
    bits = np.unpackbits(raw, axis=1, bitorder="little")
    return [np.packbits(bits[:, k], bitorder="little").tobytes() for k in range(32)]


def from_planes(planes: list[bytes], n: int, kind: str) -> np.ndarray:
    if kind == "byte":
        return np.ascontiguousarray(np.stack([np.frombuffer(p, np.uint8) for p in planes], axis=1)).view("<u4").reshape(-1)
    bits = np.stack([np.unpackbits(np.frombuffer(p, np.uint8), count=n, bitorder="little") for p in planes], axis=1)
    return np.packbits(bits, axis=1, bitorder="little").view("<u4").reshape(-1)


class PlaneWriter:
    """Ids go in document by document; no more than a chunk is held."""

    def __init__(self, out, kind: str = "byte", chunk_ids: int = CHUNK_IDS, level: int = 3):
        import zstandard

        self.out, self.kind, self.chunk_ids = out, kind, chunk_ids
        self.pack = zstandard.ZstdCompressor(level=level).compress
        self.held, self.n_held, self.index, self.docs, self.at = [], 0, [], [], len(MAGIC)
        out.write(MAGIC)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append((doc_id, len(ids)))
        while len(ids):
            part, ids = ids[: self.chunk_ids - self.n_held], ids[self.chunk_ids - self.n_held :]
            self.held.append(part)
            self.n_held += len(part)
            if self.n_held == self.chunk_ids:
                self._flush()

    def _flush(self) -> None:
        if self.n_held:
            planes = [self.pack(p) for p in to_planes(np.concatenate(self.held), self.kind)]
            self.index.append([self.at, self.n_held, *map(len, planes)])
            for p in planes:
                self.out.write(p)
                self.at += len(p)
            self.held, self.n_held = [], 0

    def close(self) -> tuple[int, int]:
        """Number of documents and ids."""
        self._flush()
        ids = np.array([0 if d is None else d for d, _ in self.docs], dtype="<i8")
        null = np.array([d is None for d, _ in self.docs], dtype=np.uint8)
        sizes = np.array([n for _, n in self.docs], dtype="<i8")
        tables = [self.pack(x.tobytes()) for x in (ids, null, sizes, np.array(self.index, dtype="<i8"))]
        footer = json.dumps({"planes": self.kind, "docs": len(self.docs), "chunks": len(self.index), "ids": int(sizes.sum()), "at": self.at, "tables": list(map(len, tables))}).encode()
        for x in (*tables, footer, np.uint32(len(footer)).astype("<u4").tobytes(), MAGIC):
            self.out.write(x)
        return len(self.docs), int(sizes.sum())


class PlaneReader:
    def __init__(self, file):
        """``file``: seekable, with ``seek`` and ``read``."""
        import zstandard

        self.file, self.unpack = file, zstandard.ZstdDecompressor().decompress
        size = file.seek(0, io.SEEK_END) if isinstance(file, io.IOBase) else file.size()
        tail = self._read(size - 8, 8)
        if tail[4:] != MAGIC or self._read(0, 4) != MAGIC:
            raise ValueError("not a file of planes")
        n = int(np.frombuffer(tail[:4], "<u4")[0])
        self.footer = json.loads(self._read(size - 8 - n, n))
        at, tables = self.footer["at"], []
        for length in self.footer["tables"]:
            tables.append(self.unpack(self._read(at, length)))
            at += length
        self.doc_ids, self.null, self.sizes = np.frombuffer(tables[0], "<i8"), np.frombuffer(tables[1], np.uint8), np.frombuffer(tables[2], "<i8")
        planes = 4 if self.footer["planes"] == "byte" else 32
        self.index = np.frombuffer(tables[3], "<i8").reshape(-1, 2 + planes)

    def _read(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def chunk(self, k: int) -> np.ndarray:
        at, n, *lengths = self.index[k].tolist()
        planes, raw = [], self._read(at, sum(lengths))
        for length in lengths:
            planes.append(self.unpack(raw[:length]))
            raw = raw[length:]
        return from_planes(planes, n, self.footer["planes"])

    def documents(self) -> Iterator[tuple[int | None, list[np.ndarray]]]:
        """Each document's id and its ids in pieces, reading one chunk at a time."""
        k, ids = 0, np.empty(0, "<u4")
        for doc_id, null, n in zip(self.doc_ids.tolist(), self.null.tolist(), self.sizes.tolist(), strict=True):
            pieces = []
            while n:
                if not len(ids):
                    ids, k = self.chunk(k), k + 1
                pieces.append(ids[:n])
                n -= len(pieces[-1])
                ids = ids[len(pieces[-1]) :]
            yield None if null else doc_id, pieces


#: Letters for which lower-casing and normalising act on single characters alone.
PLAIN = "A-Za-zÀ-ÖØ-öø-ÿ"
#: The rules of a vocabulary file whose texts may be cut up here before the library sees them.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
SPLIT = {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True}


@lru_cache(maxsize=1)
def word_encoder(vocabulary: str) -> WordEncoder:
    return WordEncoder(vocabulary)


class WordEncoder:
    """Ids of whole texts by the tokenizers library, which sees each piece of text once.

    The vocabulary's rules drop white space, and no piece spans it, so a text's ids are
    those of its white-space-separated words in order. Plain Latin text is lowered and cut
    into the runs that the vocabulary's own rule makes of it; any other word, and one with
    a special token's string in it, goes to the library whole. Only what was not met before
    reaches the library. With a vocabulary file of other rules every text goes there whole.

    The strings of special tokens become those tokens, as the library has it by default.
    """

    def __init__(self, vocabulary: str):
        import os
        import re

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        path = tokenizer_path(vocabulary)
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            rules = json.load(f)
        added = rules.get("added_tokens") or []
        self.special = [t["content"] for t in added]
        steps = (rules.get("pre_tokenizer") or {}).get("pretokenizers") or [None]
        simple = not any(t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"] or len(t["content"].split()) != 1 for t in added)
        self.known = rules.get("normalizer") == NORMALIZER and steps[0] == SPLIT and len(steps) == 2 and steps[1].get("type") == "ByteLevel" and not steps[1].get("use_regex") and not steps[1].get("add_prefix_space") and simple
        self.plain = re.compile(rf"[\t-\r -~{PLAIN}]*").fullmatch
        self.pieces = re.compile(rf"[{PLAIN}]+|[0-9]|'(?:s|t|re|ve|m|ll|d)|[^{PLAIN}0-9\t-\r ]+").findall
        self.met: dict[str, bytes] = {}

    def cut(self, text: str | None) -> list[str]:
        if not text:
            return []
        if not self.known:
            return [text]
        special = [s for s in self.special if s in text]
        if not special and self.plain(text):
            return self.pieces(text.lower())
        words = [w.decode() for w in text.encode().split()]  # bytes split at ASCII white space only
        whole = lambda w: any(s in w for s in special) or not self.plain(w)
        return [p for w in words for p in ([w] if whole(w) else self.pieces(w.lower()))]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as 32-bit little-endian numbers; null is empty."""
        if not self.known:
            found = self.tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)
            return [np.array(e.ids, dtype="<u4").tobytes() for e in found]
        cut = [self.cut(t) for t in texts]
        new = {p for p in set().union(*cut) if p not in self.met}
        if new:
            if len(self.met) + len(new) > CACHE:
                self.met, new = {}, set().union(*cut)
            order = list(new)
            for at in range(0, len(order), 5000):
                some = order[at : at + 5000]
                found = [e.ids for e in self.tokenizer.encode_batch(some, add_special_tokens=False)]
                flat = np.array([i for ids in found for i in ids], dtype="<u4").tobytes()
                at = 0
                for p, ids in zip(some, found, strict=True):
                    self.met[p] = flat[at : (at := at + 4 * len(ids))]
        look = self.met.__getitem__
        return [b"".join(map(look, pieces)) for pieces in cut]


def write_planes(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", vocabulary: str = "word_bpe_49k.json", end_id: int = END_ID, kind: str = "byte", chunk_ids: int = CHUNK_IDS) -> DataFrame:
    """Writes ids in ascending ``doc_id`` order, one file for each range of ids.

    Returns the written list ``(part, n_docs, n_ids, before)``; ``before`` counts the ids
    of all earlier files. Null ids come first. Rows with equal ids stand in order of
    the first 32 characters of their text, then of a digest of it, and equal rows by the
    partition that they come from, so that an id that many rows have is cut into ranges like
    any other.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, part, encoder, end = None, partition_id(), word_encoder(vocabulary), np.array([end_id], "<u4").tobytes()
        for b in batches:
            if out is None:
                file = SafeFile(f"{path}/part-{part:06d}.planes")
                out = PlaneWriter(file, kind, chunk_ids)
            for some in slices(b, 1):
                for d, ids in zip(some.column(0).to_pylist(), encoder.encode(some.column(1).to_pylist()), strict=True):
                    out.add(d, np.frombuffer(ids + end, "<u4"))
        if out:
            n_docs, n_ids = out.close()
            file.close()
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([n_docs], pa.int64()), pa.array([n_ids], pa.int64())], names=["part", "n_docs", "n_ids"])

    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(doc_id).cast("long").alias("_id"), F.col(text).alias("_text"))
    order = ["_id", F.substring("_text", 1, 32), F.md5("_text"), "_from"]
    dealt = rows.withColumn("_from", F.spark_partition_id()).repartitionByRange(parts, *order).sortWithinPartitions(*order).drop("_from")
    files = written(map_batches(dealt, run, "part int, n_docs long, n_ids long"), "plane-files")
    return files.withColumn("before", F.sum("n_ids").over(Window.orderBy("part")) - F.col("n_ids"))  # a row for each file


def read_planes(files: DataFrame, path: str) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` of every document, from the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                fs, inner = filesystem(f"{path}/part-{part:06d}.planes")
                rows = []
                with fs.open_input_file(inner) as f:
                    for doc_id, pieces in PlaneReader(f).documents():
                        crc, n = 0, 0
                        for p in pieces:
                            crc, n = zlib.crc32(p.tobytes(), crc), n + len(p)
                        rows.append((doc_id, start, n, crc))
                        start += n
                        if len(rows) == 5000:
                            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], names=names)
                            rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], names=names)

    names = ["doc_id", "start", "n_tokens", "ids_crc32"]
    parts = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return map_batches(files.select("part", "before").repartition(parts, "part"), run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_planes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", vocabulary: str = "word_bpe_49k.json", end_id: int = END_ID, kind: str = "byte", chunk_ids: int = CHUNK_IDS) -> DataFrame:
    """Encodes ``docs`` to files of planes and reads them back: ``(doc_id, start, n_tokens, ids_crc32)``.

    ``n_tokens`` counts the end id. Null and empty texts are the end id alone. Repeated
    rows and null ids are kept, one result each. An empty table writes no file and gives
    an empty result. Other columns are not read.
    """
    path = new_dir(docs.sparkSession, "planes")
    return read_planes(write_planes(docs, path, doc_id, text, vocabulary, end_id, kind, chunk_ids), path)
