"""Packing documents into sequences: best fit, then a swap-based local search.

Tokenised documents become pieces; only documents longer than a sequence are cut. Pieces are dealt
by a hash of their row into blocks of about BLOCK pieces, so copies and hot keys spread evenly, and
each block is packed by itself: one best-fit pass in order of arrival, then a local search over the underfull
bins. A step exchanges one piece for one, two for one, or moves a piece, always so that the sum of
squared fills grows; a bin that runs empty is gone. The bins that stay open are packed again in
a second round, with those of the other blocks, so the loss is less than a bin for each block of that round.

Only lengths move, never token ids.
"""

from __future__ import annotations

import re
import zlib
from codecs import charmap_decode
from dataclasses import dataclass
from functools import lru_cache
from heapq import heapify, heappop, heappush
from struct import pack as pack_ids

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import cut, table

CAPACITY, END_ID = 4096, 1
#: Pieces packed by one task at a time, and the fill from which a bin of the first round is closed.
BLOCK, CLOSED = 20_000, 0.995
#: Texts of these characters only are split here: their NFC form is themselves, and white space, letters and
#: digits are the same to Python and to the library.
_PLAIN = re.compile("[\t\n\r -~\xa0-\xb1\xb4-\xb8\xba\xbb\xbf-\u012f\u0131-\u024f]*")
_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\s\w]|_)+")


def _byte_chars() -> str:
    """The character that stands for each byte in a byte-level vocabulary; a space stays the separator."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in own]
    return "".join(" " if b == 32 else chr(b) if b in own else chr(256 + others.index(b)) for b in range(256))


_BYTE_CHARS = _byte_chars()
_FORMATS = [f"<{n}I" for n in range(64)]


class WordBPE:
    """Ids of a tokenizers file, as the bytes of little-endian unsigned 32-bit numbers.

    Merges do not cross white space, so the ids of a plain text are those of its runs between white
    space, and a run's are those of its words, each encoded by the library's model. Texts that hold an added
    token, or other characters, go to the library as they are. Runs are kept in two generations of at most
    `cache` each: what is used again moves to the younger.
    """

    def __init__(self, path: str, cache: int = 200_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self._merge = self.tokenizer.model.tokenize  # of one word, in the characters that stand for its bytes
        self._runs: dict[str, bytes] = {}
        self._old: dict[str, bytes] = {}
        self._most = cache

    def _library(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _word(self, w: str) -> bytes:
        ids = [t.id for t in self._merge(w if w.isascii() else charmap_decode(w.encode(), "strict", _BYTE_CHARS)[0])]
        return pack_ids(_FORMATS[len(ids)] if len(ids) < 64 else f"<{len(ids)}I", *ids)

    def _run(self, r: str) -> bytes:
        """The ids of a run that the younger generation does not hold."""
        ids = self._old.get(r)
        if ids is None:
            if r.isalpha():
                ids = self._word(r)
            else:  # most are a word with a mark behind it
                words = _WORDS.findall(r)
                known = list(map(self._runs.get, words))
                ids = b"".join([self._run(p) if k is None else k for p, k in zip(words, known)] if len(words) > 1 else map(self._word,
                    words))
        self._runs[r] = ids
        return ids

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if not _PLAIN.fullmatch(text) or any(t in text for t in self.added):
            return np.array(self._library(text), "<u4").tobytes()
        runs = text.lower().split()
        ids = list(map(self._runs.get, runs))
        if None in ids:
            known, run = self._runs.get, self._run
            ids = [(known(r) or run(r)) if i is None else i for r, i in zip(runs, ids)]
            if len(self._runs) > self._most:
                self._old, self._runs = self._runs, {}
        return b"".join(ids)


@lru_cache(1)
def load(path: str) -> WordBPE:
    return WordBPE(path)


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """docs (doc_id, text, others) -> one row per piece: doc_id, piece, start, length, ids_crc32.

    Null or empty text has the end id only. Repeated rows give repeated pieces, an empty table none. A text of any
    length is encoded whole and cut every `capacity` ids; other columns do not matter.
    """

    def run(batches):
        words, end, step = load(path), np.array([END_ID], "<u4").tobytes(), 4 * capacity
        for b in batches:
            rows = []
            for doc_id, text in zip(b["doc_id"], b["text"]):
                ids = words.encode(text) + end
                rows.extend((doc_id, k, at // 4, min(step, len(ids) - at) // 4, zlib.crc32(ids[at:at + step])) for k,
                    at in enumerate(range(0, len(ids), step)))
            yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", "text").mapInPandas(run, PIECES)


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """One pass in the order given: each piece goes to the fullest bin that has room. Positions of each bin's pieces."""
    bins: list[list[int]] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    used = 0  # bit r: some bin has room r
    for p, n in enumerate(lengths):
        fits = used >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            k = by_room[room].pop()
            if not by_room[room]:
                used ^= 1 << room
        else:
            k, room = len(bins), capacity
            bins.append([])
        bins[k].append(p)
        by_room[room - n].append(k)
        used |= 1 << (room - n)
    return bins


@dataclass
class Steps:
    """What a local search has done."""

    moves: int = 0
    swaps: int = 0
    doubles: int = 0
    sweeps: int = 0
    emptied: int = 0

    @property
    def taken(self) -> int:
        return self.moves + self.swaps + self.doubles


class _Donors:
    """Pieces of the bins that can still give, by length; bit n of `mask` tells whether there is one of length n."""

    def __init__(self, capacity: int):
        self.by_length: list[dict[int, None]] = [{} for _ in range(capacity + 1)]
        self.mask = 0

    def add(self, p: int, n: int) -> None:
        self.by_length[n][p] = None
        self.mask |= 1 << n

    def drop(self, p: int, n: int) -> None:
        del self.by_length[n][p]
        if not self.by_length[n]:
            self.mask ^= 1 << n

    def longest(self, low: int, high: int) -> int:
        """The largest length in low..high that a piece has; 0 if none."""
        found = (self.mask >> low) & ((1 << max(0, high - low + 1)) - 1)
        return low + found.bit_length() - 1 if found else 0

    def one(self, n: int) -> int:
        return next(reversed(self.by_length[n]))


def _best_pair(pieces: list[int], lengths: list[int], low: int, high: int) -> tuple[int, int, int] | None:
    """Two of the pieces whose lengths add up to the most in low..high: (sum, a, b)."""
    order = sorted(pieces, key=lengths.__getitem__)
    i, j, best = 0, len(order) - 1, None
    while i < j:
        both = lengths[order[i]] + lengths[order[j]]
        if both > high:
            j -= 1
            continue
        if both >= low and (best is None or both > best[0]):
            best = (both, order[i], order[j])
        i += 1
    return best


def local_search(bins: list[list[int]], lengths: list[int], capacity: int) -> tuple[list[list[int]], Steps]:
    """Fill the fullest underfull bins from emptier ones until bins run empty.

    In a sweep the fullest open bin receives, then the fullest of the others, and so on; every bin less full
    gives. The receiver takes, until it is full or nothing helps, what fills it best: a piece that fits
    (a move), a longer piece for one of its own, or two pieces of the emptiest bin for one of its own. The receiver is
    at least as full as the giver and gains, so each step increases the sum of squared fills, and the search ends. It
    stops at the least number of bins, total length / capacity rounded up, or when a sweep takes no step. No
    number of tries is limited; only the two pieces of a double step come from one given bin, the emptiest.
    """
    fill = [sum(lengths[p] for p in b) for b in bins]
    home = {p: k for k, b in enumerate(bins) for p in b}
    least, left, steps = -(-sum(fill) // capacity), sum(1 for b in bins if b), Steps()

    while left > least:
        before = steps.taken
        steps.sweeps += 1
        open_ = [k for k in range(len(bins)) if bins[k] and fill[k] < capacity]
        donors = _Donors(capacity)
        waiting = set(open_)
        for k in sorted(open_, key=lambda k: (-fill[k], k)):  # pieces of the emptiest bins come last: they go first
            for p in bins[k]:
                donors.add(p, lengths[p])
        fullest = [(-fill[k], k) for k in open_]
        heapify(fullest)
        emptiest = [(fill[k], k) for k in open_]
        heapify(emptiest)

        def shift(p: int, to: int) -> None:
            k, n = home[p], lengths[p]
            bins[k].remove(p)
            bins[to].append(p)
            fill[k] -= n
            fill[to] += n
            home[p] = to
            if k in waiting:
                donors.drop(p, n)
            if to in waiting:
                donors.add(p, n)

        def touched(k: int) -> int:
            """A giver has changed: 1 if it has run empty."""
            if not bins[k]:
                waiting.discard(k)
                return 1
            heappush(fullest, (-fill[k], k))
            heappush(emptiest, (fill[k], k))
            return 0

        while fullest and left > least:
            f, to = heappop(fullest)
            if to not in waiting or -f != fill[to]:
                continue
            waiting.discard(to)
            for p in bins[to]:
                donors.drop(p, lengths[p])
            while left > least and (room := capacity - fill[to]) and donors.mask:
                fits = donors.longest(1, room)
                best, come, goes = fits, (donors.one(fits),) if fits else (), None
                if best < room:
                    swap = 0
                    for n, q in {lengths[q]: q for q in bins[to]}.items():
                        gain = donors.longest(n + 1, n + room) - n
                        if gain > swap:
                            swap, longer, shorter = gain, n + gain, q
                    if swap == room or swap and not fits:
                        best, come, goes = swap, (donors.one(longer),), shorter
                if best < room and not fits:
                    while emptiest and (emptiest[0][1] not in waiting or emptiest[0][0] != fill[emptiest[0][1]]):
                        heappop(emptiest)
                    giver = bins[emptiest[0][1]] if emptiest else []
                    for n, q in {lengths[q]: q for q in bins[to]}.items():
                        pair = _best_pair(giver, lengths, n + 1 + best, n + room)
                        if pair:
                            best, come, goes = pair[0] - n, pair[1:], q
                if not best:
                    break
                giver = home[come[0]]
                for p in come:
                    shift(p, to)
                if goes is None:
                    steps.moves += 1
                else:
                    shift(goes, giver)
                    if len(come) == 1:
                        steps.swaps += 1
                    else:
                        steps.doubles += 1
                gone = touched(giver)
                left -= gone
                steps.emptied += gone
        if steps.taken == before:
            break
    return [b for b in bins if b], steps


_PACKED = "_fl_row long, sequence_id long, offset long, search_steps long, bins_emptied long, open boolean"


def _packer(round_: int, capacity: int):
    def pack(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("_fl_row", ignore_index=True)
        lengths = g["_fl_length"].tolist()
        bins, steps = local_search(best_fit(lengths, capacity), lengths, capacity)
        rows, block = g["_fl_row"].to_numpy(), int(g["_fl_block"].iloc[0])
        bins.sort(key=lambda b: -sum(lengths[p] for p in b))
        out = []
        for k, b in enumerate(bins):
            offset, full = 0, sum(lengths[p] for p in b)
            for p in b:
                # the counts of a block stand at its first piece, in its fullest bin, so that sums are those of the searches
                did = (0, 0) if out else (steps.taken, steps.emptied)
                out.append((rows[p], (round_ << 60) | (block << 24) | k, offset, *did, round_ == 1 and full < CLOSED * capacity))
                offset += lengths[p]
        return pd.DataFrame(out, columns=["_fl_row", "sequence_id", "offset", "search_steps", "bins_emptied", "open"])

    return pack


def pack(piece_rows: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """piece_rows (length long, 1..capacity, any other columns) -> the same with sequence_id, offset, search_steps and
    bins_emptied (columns of piece_rows by these names are replaced). The last two are what the local search of a
    block did, at one piece of each block and 0 elsewhere.

    Rows are told apart by their place in the cut table, so repeated rows are pieces of their own, and ties are
    broken by it. A piece of full length is a sequence of its own. An empty table gives no rows; texts of any
    length only mean more pieces.
    """
    rows = cut(piece_rows.drop("sequence_id", "offset", "search_steps", "bins_emptied").withColumn("_fl_row",
        F.monotonically_increasing_id()))
    small = rows.where(F.col("length") < capacity).select("_fl_row", F.col("length").alias("_fl_length"))
    n = small.count()

    def packed(df: DataFrame, n: int, round_: int) -> DataFrame:
        blocks = max(1, -(-n // BLOCK))
        keyed = df.withColumn("_fl_block", F.pmod(F.xxhash64("_fl_row", F.lit(round_)), F.lit(blocks)))
        return keyed.groupBy("_fl_block").applyInPandas(_packer(round_, capacity), _PACKED)

    first = cut(packed(small, n, 1))
    open_ = first.where("open")
    again = packed(small.join(open_.select("_fl_row"), "_fl_row", "left_semi"), open_.count(), 2)
    placed = first.where("NOT open").union(again).drop("open")
    zero = F.lit(0).cast("long")
    full = rows.where(F.col("length") >= capacity).withColumn("sequence_id",
        F.col("_fl_row").bitwiseOR(F.lit(3 << 60))).withColumn("offset", zero)
    full = full.withColumn("search_steps", zero).withColumn("bins_emptied", zero)
    return rows.join(placed, "_fl_row").drop("_fl_row").unionByName(full.drop("_fl_row"))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 4096 tokens, one row per piece."""
    import public_tokenizers

    return pack(pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "search_steps", "bins_emptied")
