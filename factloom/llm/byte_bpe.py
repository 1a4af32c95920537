"""Byte-level BPE as a monoid.

The encodings of byte strings form a monoid under join: join(enc(x), enc(y)) == enc(x + y). A piece
(one match of the split pattern) is encoded by halving it recursively down to LEAF bytes and joining the
halves; across pieces no merge can happen, so join is plain concatenation there, and a text's pieces are
concatenated up a balanced tree too. Pieces met before come from a cache of bounded size.

join re-encodes a window around the boundary and doubles it, on the side that is not yet stable,
until the tokens outside provably stay. The proof: a token sequence is the encoding of its bytes if
and only if each adjacent pair t, u is, that is enc(t + u) == [t, u]. (Take the first merge in the
whole string that crosses a token boundary. Until then every token has merged as it does alone, so
in enc(t + u) the same merge would come up as the lowest rank, leftmost.) Pairs left of the window
were adjacent in enc(x), pairs right of it in enc(y), pairs inside in the window's encoding; only
the two seams are tested. The window is at most everything, so join ends.

Decoding maps ids to bytes and concatenates up the tree.
"""

from __future__ import annotations

import base64
import hashlib
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import chain

import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession

from .shared import table

#: Bytes of a leaf of the tree.
LEAF = 1
#: Nodes and windows of up to this many bytes are remembered.
NODE = 8
#: Windows above this many bytes are merged with a heap.
HEAP = 128
#: Pieces whose encodings are concatenated at once, at the leaves of a text's tree.
PIECES = 1024
NONE = 1 << 40


class ByteBPE:
    """Encodings by a rank file. `cache` pieces of up to 64 bytes are kept in each of two generations: a piece
    used again moves to the younger one. joins and windows count what the tree has done."""

    def __init__(self, path: str, pattern: str, cache: int = 150_000):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.bytes_of = {r: b for b, r in self.ranks.items()}
        self.digits = {r: str(r) for r in self.bytes_of}
        self.find = regex.compile(pattern).findall
        self.pair_ok = lru_cache(100_000)(self._pair_ok)
        self._node = lru_cache(200_000)(self._merge)  # short nodes of the tree: words share their halves
        self._window = lru_cache(200_000)(self._leaf)
        self._pieces: dict[str, tuple[int, ...]] = {}
        self._old: dict[str, tuple[int, ...]] = {}
        self._cache = cache
        self.joins = self.windows = 0

    def _leaf(self, b: bytes) -> tuple[int, ...]:
        """Lowest rank first, leftmost first."""
        rank = self.ranks.get
        n = len(b)
        if n > HEAP:
            return self._leaf_long(b)
        parts = [b[i:i + 1] for i in range(n)]
        rs = [rank(b[i:i + 2], NONE) for i in range(n - 1)]  # of each adjacent pair
        while rs:
            best = min(rs)
            if best == NONE:
                break
            at = rs.index(best)
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
            del rs[at]
            if at < len(rs):
                rs[at] = rank(parts[at] + parts[at + 1], NONE)
            if at:
                rs[at - 1] = rank(parts[at - 1] + parts[at], NONE)
        return tuple([self.ranks[p] for p in parts])

    def _leaf_long(self, b: bytes) -> tuple[int, ...]:
        """The same with a heap of pairs over a linked list, in n log n steps."""
        rank, n = self.ranks.get, len(b)
        end = list(range(1, n + 1))  # of the part that starts here; 0: no part starts here
        prev = list(range(-1, n - 1))
        heap = [(r, i, i + 1, i + 2) for i in range(n - 1) if (r := rank(b[i:i + 2])) is not None]
        heapify(heap)
        while heap:
            _, i, m, e = heappop(heap)
            if end[i] != m or m >= n or end[m] != e:
                continue  # one of the two has merged since
            end[i], end[m] = e, 0
            if e < n:
                prev[e] = i
                if (r := rank(b[i:end[e]])) is not None:
                    heappush(heap, (r, i, e, end[e]))
            if (p := prev[i]) >= 0 and (r := rank(b[p:e])) is not None:
                heappush(heap, (r, p, i, e))
        out, i = [], 0
        while i < n:
            out.append(self.ranks[b[i:end[i]]])
            i = end[i]
        return tuple(out)

    def _pair_ok(self, t: int, u: int) -> bool:
        return self._leaf(self.bytes_of[t] + self.bytes_of[u]) == (t, u)

    def join(self, x: tuple[int, ...], y: tuple[int, ...]) -> tuple[int, ...]:
        """The encoding of the bytes of two encodings."""
        self.joins += 1
        if not x or not y or self.pair_ok(x[-1], y[0]):
            return x + y
        i, j = min(2, len(x)), min(2, len(y))
        while True:
            self.windows += 1
            b = b"".join(map(self.bytes_of.__getitem__, x[-i:] + y[:j]))
            window = self._window(b) if len(b) <= NODE else self._leaf(b)
            left = i == len(x) or self.pair_ok(x[-i - 1], window[0])
            right = j == len(y) or self.pair_ok(window[-1], y[j])
            if left and right:
                return x[:-i] + window + y[j:]
            i = i if left else min(2 * i, len(x))
            j = j if right else min(2 * j, len(y))

    def merge(self, b: bytes) -> tuple[int, ...]:
        """The encoding of one piece by its merges alone: halves, joined."""
        return self._node(b) if len(b) <= NODE else self._merge(b)

    def _merge(self, b: bytes) -> tuple[int, ...]:
        if len(b) <= LEAF:
            return self._leaf(b)
        half = len(b) // 2
        return self.join(self.merge(b[:half]), self.merge(b[half:]))

    def _piece(self, p: str) -> tuple[int, ...]:
        """The encoding of a piece that the younger generation does not hold."""
        ids = self._old.get(p)
        if ids is None:
            b = p.encode("utf-8", "surrogatepass")
            ids = (self.ranks[b],) if b in self.ranks else self.merge(b)
            if len(b) > 64:
                return ids
        if len(self._pieces) >= self._cache:
            self._old, self._pieces = self._pieces, {}
        self._pieces[p] = ids
        return ids

    def _concatenated(self, pieces: list[str], lo: int, hi: int) -> list[int]:
        """The balanced tree over the encodings of pieces lo..hi: without merges between them, join is +."""
        if hi - lo > PIECES:
            half = (lo + hi) // 2
            return self._concatenated(pieces, lo, half) + self._concatenated(pieces, half, hi)
        part = pieces[lo:hi]
        ids = list(map(self._pieces.get, part))
        if None in ids:
            ids = [self._piece(p) if i is None else i for p, i in zip(part, ids)]
        return list(chain.from_iterable(ids))

    def encode(self, text: str | None) -> list[int]:
        pieces = self.find(text or "")
        return self._concatenated(pieces, 0, len(pieces))

    def decode(self, ids: list[int]) -> bytes:
        """Ids to bytes, concatenated up the tree."""
        if len(ids) <= 4096:
            return b"".join(map(self.bytes_of.__getitem__, ids))
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])


@lru_cache(2)
def load(path: str, pattern: str) -> ByteBPE:
    return ByteBPE(path, pattern)


def encode_documents(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """docs (doc_id, text, others) -> doc_id, ids array<int>, decoded binary.

    path: a rank file that executors can read, pattern: the regular expression that splits text
    first. Null text is empty: no ids, no bytes. Rows are independent: repeated rows give equal results, other
    columns do not matter, and an empty table gives no rows. A text of any length is encoded whole, in memory in
    proportion to it; pieces of a text are independent, and a piece is a tree of depth log2 of its bytes.
    """

    def run(batches):
        bpe = load(path, pattern)
        for b in batches:
            for at in range(0, len(b), 256):
                ids = [bpe.encode(t) for t in b["text"].iloc[at:at + 256]]
                yield pd.DataFrame({"doc_id": b["doc_id"].iloc[at:at + 256].to_numpy(), "ids": ids,
                    "decoded": [bpe.decode(i) for i in ids]})

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, ids array<int>, decoded binary")


def digest_documents(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """As encode_documents (also for null, repeated, very long and no rows), but only digests of ids and bytes
    leave the workers: doc_id, n_tokens, ids_sha256, decoded_sha256."""

    def run(batches):
        bpe = load(path, pattern)
        for b in batches:
            rows = []
            for doc_id, text in zip(b["doc_id"], b["text"]):
                ids = bpe.encode(text)
                rows.append((doc_id, len(ids), hashlib.sha256(",".join(map(bpe.digits.__getitem__, ids)).encode()).hexdigest(),
                    hashlib.sha256(bpe.decode(ids)).hexdigest()))
            yield pd.DataFrame(rows, columns=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text of documents, encoded and decoded: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    import public_tokenizers

    return digest_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"),
        public_tokenizers.PATTERN)
