"""Byte-level BPE: encoding by a segment tree over byte positions, and decoding.

A piece of n bytes is a segment tree with a leaf for each byte position. A leaf that
begins a live token holds the rank of the pair it forms with its right neighbour (or
nothing); an inner node holds the smaller rank of its two children, the left one on ties.
The root therefore gives the lowest rank, and walking down from it, left on ties, the
leftmost position with it. A merge changes three leaves - the pair's, the dead right
half's, and the left neighbour's - and each change is repaired on the path to the root.

Trees of distinct pieces with the same number of leaves advance in lock step as numpy
arrays, one merge in each at a time, so a step's cost is shared by all of them. Where few
trees are left to advance, each is walked by itself in plain integers, so a long piece
costs microseconds a merge and no more. Pieces that were met before come from a bounded
table.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_batches, slices, tokenizer_path

NOTHING = np.int32(2**31 - 1)
#: Leaves of all trees that advance together, entries of the table of met pieces, and the longest piece kept in it.
LEAVES, CACHE, CACHED_BYTES = 1 << 17, 300_000, 64
#: Slots of the pair table are this many times its entries, at least.
SPREAD = 4
#: So many trees or fewer don't advance in lock step any more.
FEW = 16


class Ranks:
    """A vocabulary of byte strings by rank, with the pairs that merge."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.byte_ids = np.array([ranks.get(bytes([b]), -1) for b in range(256)], np.int32)
        if (self.byte_ids < 0).any():
            raise ValueError("the vocabulary lacks single bytes")
        pairs = [(ranks[t[:k]] << 32 | ranks[t[k:]], r) for t, r in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks]
        self._table(np.array([p for p, _ in pairs], np.int64), np.array([r for _, r in pairs], np.int32))
        self.met: dict[str, str] = {}  # decimal ids of a piece

    def _table(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Open addressing in numpy: a key lies at most ``probes`` slots after its own."""
        self.bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * SPREAD))))
        self.slots, self.found = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, NOTHING, np.int32)
        self.probes, left = 0, np.arange(len(keys))
        while len(left):
            at = self._slot(keys[left], self.probes)
            free = self.slots[at] < 0
            _, first = np.unique(np.where(free, at, -1), return_index=True)
            put = first[free[first]]
            self.slots[at[put]], self.found[at[put]] = keys[left[put]], values[left[put]]
            left, self.probes = np.delete(left, put), self.probes + 1

    def _slot(self, keys: np.ndarray, probe: int) -> np.ndarray:
        mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return ((mixed >> np.uint64(64 - self.bits)).astype(np.int64) + probe) & ((1 << self.bits) - 1)

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of the token that two neighbours make, or NOTHING."""
        keys = left.astype(np.int64) << 32 | right
        at = self._slot(keys, 0)
        out = np.where(self.slots[at] == keys, self.found[at], NOTHING)
        open_ = np.flatnonzero((out == NOTHING) & (self.slots[at] >= 0))
        for probe in range(1, self.probes):
            if not len(open_):
                break
            at = self._slot(keys[open_], probe)
            hit = self.slots[at] == keys[open_]
            out[open_[hit]] = self.found[at[hit]]
            open_ = open_[~hit & (self.slots[at] >= 0)]
        return out

    def merge_all(self, pieces: list[bytes]) -> list[list[int]]:
        """Ids of each piece, by segment trees."""
        out: list[list[int]] = [[] for _ in pieces]
        by_leaves: dict[int, list[int]] = {}
        for i, p in enumerate(pieces):
            if len(p) == 1 or p in self.ranks:
                out[i] = [self.ranks[p]]
            elif p:
                by_leaves.setdefault(1 << (len(p) - 1).bit_length(), []).append(i)
        for leaves, members in by_leaves.items():
            step = max(1, LEAVES // leaves)
            for at in range(0, len(members), step):
                some = members[at : at + step]
                for i, ids in zip(some, self._forest([pieces[i] for i in some], leaves), strict=True):
                    out[i] = ids
        return out

    def _forest(self, pieces: list[bytes], leaves: int) -> list[list[int]]:
        n = len(pieces)
        lengths = np.array(list(map(len, pieces)))
        raw = np.frombuffer(b"".join(p.ljust(leaves, b"\0") for p in pieces), np.uint8).reshape(n, leaves)
        ids = self.byte_ids[raw]
        places = np.arange(1, leaves + 1, dtype=np.int32)
        inside = places <= lengths[:, None]
        # neighbours of live positions; position `leaves` stands for the end
        after = np.where(places < lengths[:, None], places, np.int32(leaves))
        before = np.broadcast_to(np.arange(-1, leaves - 1, dtype=np.int32), (n, leaves)).copy()
        tree = np.full((n, 2 * leaves), NOTHING, np.int32)
        step = max(1, LEAVES // n)
        for at in range(0, leaves - 1, step):
            row, col = np.nonzero(places[at : min(at + step, leaves - 1)] < lengths[:, None])
            tree[row, leaves + at + col] = self.pair_ranks(ids[row, at + col], ids[row, at + col + 1])
        width = leaves
        while width > 1:
            tree[:, width // 2 : width] = np.minimum(tree[:, width : 2 * width : 2], tree[:, width + 1 : 2 * width : 2])
            width //= 2
        live = inside
        # flat views: a row's leaves begin at row * leaves, its tree at row * 2 * leaves
        tree_, ids_, after_, before_, live_ = (x.reshape(-1) for x in (tree, ids, after, before, live))
        work = np.flatnonzero(tree[:, 1] != NOTHING)
        while len(work):
            if len(work) <= FEW:
                for k in work.tolist():
                    self._walk(*(memoryview(x[k]) for x in (tree, ids, after, before, live)), leaves)
                break
            root, row = work * (2 * leaves), work * leaves
            rank = tree_[root + 1]
            node, width = np.ones(len(work), np.int64), 1
            while width < leaves:  # all trees have the same depth
                node = 2 * node
                node += tree_[root + node] != rank  # left on ties
                width *= 2
            at = node - leaves
            dead = after_[row + at]
            beyond, left = after_[row + dead], before_[row + at]
            ids_[row + at] = rank
            live_[row + dead] = False
            after_[row + at] = beyond
            more, prior = np.flatnonzero(beyond < leaves), np.flatnonzero(left >= 0)
            before_[row[more] + beyond[more]] = at[more]
            firsts = np.concatenate([(row + at)[more], row[prior] + left[prior]])
            seconds = np.concatenate([row[more] + beyond[more], (row + at)[prior]])
            ranks = self.pair_ranks(ids_[firsts], ids_[seconds])
            tree_[root + node] = NOTHING
            tree_[root + leaves + dead] = NOTHING
            tree_[root[more] + node[more]] = ranks[: len(more)]
            tree_[root[prior] + leaves + left[prior]] = ranks[len(more) :]
            # repair the paths above the three leaves, level by level
            trees = np.concatenate([root, root, root[prior]])
            nodes = np.concatenate([node, leaves + dead, leaves + left[prior]]) >> 1
            while width > 1:
                child = trees + 2 * nodes
                tree_[trees + nodes] = np.minimum(tree_[child], tree_[child + 1])
                nodes = nodes >> 1
                width //= 2
            work = work[tree_[root + 1] != NOTHING]
        flat, counts = ids[live].tolist(), live.sum(axis=1).tolist()
        out: list[list[int]] = []
        at = 0
        for c in counts:
            out.append(flat[at : at + c])
            at += c
        return out

    def _walk(self, tree: memoryview, ids: memoryview, after: memoryview, before: memoryview, live: memoryview, leaves: int) -> None:
        """All merges of one tree."""
        tokens, rank_of, nothing = self.tokens, self.ranks.get, int(NOTHING)

        def put(at: int, value: int) -> None:
            """A leaf's value, and the path above it as far as it changes."""
            node = leaves + at
            tree[node] = value
            while node > 1:
                other = tree[node ^ 1]
                value = value if value < other else other
                node >>= 1
                if tree[node] == value:
                    break
                tree[node] = value

        while (rank := tree[1]) != nothing:
            node = 1
            while node < leaves:
                node *= 2
                if tree[node] != rank:  # left on ties
                    node += 1
            at = node - leaves
            dead, left = after[at], before[at]
            beyond = after[dead]
            ids[at], live[dead], after[at] = rank, False, beyond
            put(dead, nothing)
            if beyond < leaves:
                before[beyond] = at
                put(at, rank_of(tokens[rank] + tokens[ids[beyond]], nothing))
            else:
                put(at, nothing)
            if left >= 0:
                put(left, rank_of(tokens[ids[left]] + tokens[rank], nothing))

    def learn(self, texts_pieces: list[list[str]]) -> dict[str, str]:
        """The table of pieces, in which all of these are; those too long to keep are in a copy."""
        wanted = {p for p in set().union(*texts_pieces) if p not in self.met}
        if wanted:
            if len(self.met) + len(wanted) > CACHE:
                self.met = {}
                wanted = set().union(*texts_pieces)
            order = list(wanted)
            made = {p: ",".join(map(str, ids)) for p, ids in zip(order, self.merge_all([p.encode() for p in order]), strict=True)}
            long = {p: v for p, v in made.items() if len(p) > CACHED_BYTES}
            self.met.update((p, v) for p, v in made.items() if p not in long)
            if long:
                return self.met | long
        return self.met


@lru_cache(maxsize=2)
def load_ranks(vocabulary: str) -> Ranks:
    with open(tokenizer_path(vocabulary), "rb") as f:
        return Ranks({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)})


@lru_cache(maxsize=2)
def piece_pattern():
    import public_tokenizers
    import regex

    return regex.compile(public_tokenizers.PATTERN)


def encode_texts(texts: list[str | None], ranks: Ranks) -> Iterator[tuple[list[int], str]]:
    """Ids of each text, and their decimals joined by commas; null is empty."""
    findall = piece_pattern().findall
    pieces = [findall(t or "") for t in texts]
    known = ranks.learn(pieces)
    for p in pieces:
        said = ",".join([known[x] for x in p])
        yield list(map(int, said.split(","))) if said else [], said


def decode(ids: list[int], ranks: Ranks) -> bytes:
    """The bytes of ids; an id without a token raises ``IndexError``."""
    return b"".join(map(ranks.tokens.__getitem__, ids))


def encode_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", vocabulary: str = "byte_bpe_multi_50k.tiktoken", with_ids: bool = False) -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256)``, and ``ids`` (32-bit little-endian) if asked for.

    ``ids_sha256`` is of the decimal ids joined by commas, ``decoded_sha256`` of the bytes
    decoded from the ids. Null and empty texts have no tokens. Repeated rows and null ids
    are kept, one result each; an empty table gives an empty result; other columns are
    not read.
    """
    kind = docs.schema[doc_id].dataType.simpleString()
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * with_ids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = load_ranks(vocabulary)
        for b in batches:
            for some in slices(b, 1):
                n, sha, back, packed = [], [], [], []
                for ids, said in encode_texts(some.column(1).to_pylist(), ranks):
                    n.append(len(ids))
                    sha.append(hashlib.sha256(said.encode()).hexdigest())
                    back.append(hashlib.sha256(decode(ids, ranks)).hexdigest())
                    if with_ids:
                        packed.append(np.array(ids, "<u4").tobytes())
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(n, pa.int64()), pa.array(sha, pa.string()), pa.array(back, pa.string()), *[pa.array(packed, pa.binary())] * with_ids], names=names)

    return map_batches(docs.select(doc_id, text), run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * with_ids)
