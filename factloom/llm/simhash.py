"""SimHash near-duplicates with Golay-code fuzzy hashing.

A 64-bit fingerprint is three segments of 23, 23 and 18 bits (the last padded with zeros). For a
23-bit word x let K(x) be the Golay codewords within distance 4 of x: one if x is within 2 of a
codeword, else six. The code is perfect with radius 3, so words at distance 2 or less share a codeword
of K: the nearest codeword of a word midway is within 4 of both.

Links are fingerprints that differ in 4 bits or fewer. By pigeonhole over the segments, either
some segment is equal, and then one of the other two has 2 errors or fewer: key (equal segment,
codeword of the other). Or every segment has an error, so each has 2 or fewer and all three share a codeword: key (the
three codewords). Every link therefore meets in some bucket (about 180 keys a fingerprint on average, of 30
to 36 bits), and every meeting is verified on the 64 bits: no link is lost.

Buckets do not emit all their pairs. Rows are dealt by key and sorted; a bucket becomes edges that
span the components of its links (at most one edge fewer than members), so copies and near copies cost
rows in proportion to their number. Buckets above BLOCK members go to a second round, in which each
pair of blocks of a bucket is a task of its own. Identical fingerprints are one class before all this.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import connected_components
from .shared import cut, table

WORDS, MAX_BITS, SEED = 4, 4, 42
#: Members of a bucket that one task compares; larger buckets are split into blocks.
BLOCK = 1024
#: Rows of keys that one task makes, about.
ROWS = 2_000_000
#: Buckets up to this size are compared together, all their pairs at once.
SMALL = 6
_SEGMENTS = ((0, 23), (23, 23), (46, 18))
_GENERATOR = 0b101011100011  # of the cyclic [23,12,7] code


def fingerprint(text: str | None) -> int:
    """Bit set if set in over half of the hashes of the word shingles, repeats included."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    n = max(1, len(words) - WORDS + 1)
    whole = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    last = ends[min(WORDS, len(words)) - 1:]
    h = xxhash.xxh64_intdigest
    hashes = np.fromiter((h(whole[s:e], SEED) for s, e in zip(starts[:n].tolist(), last.tolist())), np.uint64, n)
    counts = np.zeros(64, np.int64)
    for at in range(0, n, 4096):
        counts += np.unpackbits(hashes[at:at + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, others) -> doc_id, text_hash (XXH64 of the text, to tell rows of one id apart), fp long (the
    fingerprint's bits, two's complement)."""

    def run(batches):
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "text_hash": b["text_hash"],
                "fp": np.array([fingerprint(t) for t in b["text"]], np.uint64).view(np.int64)})

    return docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")).mapInPandas(run, "doc_id long, text_hash long, fp long")


def _syndromes(x: np.ndarray) -> np.ndarray:
    s = x.copy()
    for bit in range(22, 10, -1):
        s ^= np.where(s >> bit & 1, _GENERATOR << (bit - 11), 0)
    return s


def _golay() -> tuple[np.ndarray, np.ndarray]:
    """By syndrome: error patterns that lead to the codewords of K, and their number."""
    errors, n = np.zeros((2048, 6), np.int64), np.zeros(2048, np.int64)
    lightest = np.full(2048, 9)
    for weight in range(5):
        patterns = np.array([sum(1 << i for i in c) for c in combinations(range(23), weight)], np.int64)
        for p, s in zip(patterns, _syndromes(patterns)):
            lightest[s] = min(lightest[s], weight)
            if weight < 4 or lightest[s] == 3:  # the code's distance is 7: else weight 4 has no codeword
                errors[s, n[s]] = p
                n[s] += 1
    return errors, n


_ERRORS, _COUNT = _golay()


def _codewords(seg: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """seg (n) -> indices (0..4095) of the codewords of K (n x 6), their number."""
    syn = _syndromes(seg)
    return (seg[:, None] ^ _ERRORS[syn]) >> 11, _COUNT[syn]  # systematic: the message is the upper 12 bits


def _segments(fp: np.ndarray) -> list[np.ndarray]:
    u = fp.view(np.uint64)
    return [((u >> np.uint64(at)) & np.uint64((1 << width) - 1)).astype(np.int64) for at, width in _SEGMENTS]


def bucket_keys(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints -> (key, row), each key of a row once. A key's family is in its top bits."""
    seg = _segments(fp)
    code = [_codewords(s) for s in seg]
    slot, keys, rows = np.arange(6), [], []

    def put(key: np.ndarray, used: np.ndarray) -> None:
        row, at = np.nonzero(used)
        keys.append(key[row, at] | (len(keys) << 40))
        rows.append(row)

    for i in range(3):
        for j in range(3):
            if i != j:
                put((seg[i][:, None] << 12) | code[j][0], slot < code[j][1][:, None])
    (k0, n0), (k1, n1), (k2, n2) = code
    used = (slot < n0[:, None])[:, :, None, None] & (slot < n1[:, None])[:, None, :, None] & (slot < n2[:, None])[:, None, None, :]
    put(((k0[:, :, None, None] << 24) | (k1[:, None, :, None] << 12) | k2[:, None, None, :]).reshape(-1, 216), used.reshape(-1, 216))
    return np.concatenate(keys), np.concatenate(rows)


def _bits(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x.view(np.uint64))


def spanning_links(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges that span the components of the links among fps, found breadth first."""
    rest, a, b = fps, [], []
    while len(rest):
        queue, rest = [rest[:1]], rest[1:]
        while queue and len(rest):
            x = queue.pop()
            near = _bits(rest ^ x) <= MAX_BITS
            if near.any():
                found, rest = rest[near], rest[~near]
                a.append(np.repeat(x, len(found)))
                b.append(found)
                queue.extend(found[k:k + 1] for k in range(len(found)))
    none = np.empty(0, np.int64)
    return (np.concatenate(a), np.concatenate(b)) if a else (none, none)


_EDGE = "a long, b long, key long"


def _edges_of(k: np.ndarray, f: np.ndarray, over: int | None) -> pd.DataFrame:
    """Whole buckets (keys ascending) -> edges (a, b, null), or (fp, null, key) of buckets above BLOCK."""
    starts = np.concatenate(([0], np.nonzero(np.diff(k))[0] + 1))
    size = np.diff(np.concatenate((starts, [len(k)])))
    big = (size > BLOCK) | ((k[starts] == over) if over is not None else False)
    a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for n in range(2, SMALL + 1):  # buckets of the same small size at once
        at = starts[(size == n) & ~big]
        for i, j in combinations(range(n), 2):
            x, y = f[at + i], f[at + j]
            ok = _bits(x ^ y) <= MAX_BITS
            a.append(x[ok])
            b.append(y[ok])
    middle = (size > SMALL) & ~big
    for s, n in zip(starts[middle].tolist(), size[middle].tolist()):
        x, y = spanning_links(f[s:s + n])
        a.append(x)
        b.append(y)
    x, y = np.concatenate(a), np.concatenate(b)
    edges = pd.DataFrame({"a": x, "b": y}).drop_duplicates()
    through = np.repeat(big, size)
    return pd.DataFrame({"a": np.concatenate((edges["a"], f[through])), 
                         "b": pd.array([*edges["b"].tolist(), *[None] * int(through.sum())], "Int64"),
                         "key": pd.array([*[None] * len(edges), *k[through].tolist()], "Int64")})


def _buckets(batches):
    """Rows (key, fp) sorted by key, in batches -> what _edges_of gives; holds at most BLOCK rows and a batch."""
    k, f = np.empty(0, np.int64), np.empty(0, np.int64)
    over: int | None = None  # a large bucket that is passing through
    for batch in batches:
        k, f = np.concatenate((k, batch["key"].to_numpy(np.int64))), np.concatenate((f, batch["fp"].to_numpy(np.int64)))
        if not len(k):
            continue
        whole = int(np.searchsorted(k, k[-1]))  # the last bucket may go on in the next batch
        if whole:
            yield _edges_of(k[:whole], f[:whole], over)
            k, f = k[whole:], f[whole:]
        if len(k) > BLOCK or k[0] == over:
            over = int(k[0])
            yield _edges_of(k, f, over)
            k, f = k[:0], f[:0]
    if len(k):
        yield _edges_of(k, f, over)


def fingerprint_links(fps: DataFrame) -> DataFrame:
    """fps (fp long, distinct) -> a, b: links that span every component of the link graph."""

    def keyed(batches):
        for b in batches:
            fp = b["fp"].to_numpy(np.int64)
            for at in range(0, len(fp), 4096):
                key, row = bucket_keys(fp[at:at + 4096])
                yield pd.DataFrame({"key": key, "fp": fp[at:at + 4096][row]})

    # a fingerprint becomes about 180 rows: it is dealt by that, to tasks of about ROWS rows
    tasks = max(int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-fps.count() * 180 // ROWS))
    rows = fps.select("fp").repartition(tasks, "fp").mapInPandas(keyed, "key long, fp long")
    dealt = rows.repartition("key").sortWithinPartitions("key")
    found = cut(dealt.mapInPandas(_buckets, _EDGE))
    edges = found.where("key IS NULL").select("a", "b")
    large = found.where("key IS NOT NULL").select("key", F.col("a").alias("fp"))
    sizes = large.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    if sizes.limit(1).count():
        # every pair of blocks of a bucket is a group of at most about 2 x BLOCK rows
        split = large.join(sizes, "key").withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int")).withColumn(
            "block", F.pmod(F.xxhash64("fp", "key"), F.col("blocks")).cast("int"))
        pairs = split.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).where("other != block").select(
            "key", "fp", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"))

        def span(g: pd.DataFrame) -> pd.DataFrame:
            a, b = spanning_links(g["fp"].to_numpy(np.int64))
            return pd.DataFrame({"a": a, "b": b})

        edges = edges.union(pairs.groupBy("key", "lo", "hi").applyInPandas(span, "a long, b long"))
    return edges.distinct()


def _node(low: str, fp: str) -> Column:
    """A class in the link graph: its smallest doc_id, if it has one, and its fingerprint. Nameless classes come last."""
    return F.struct(F.col(low).isNull().alias("nameless"), F.coalesce(low, F.lit(0)).alias("id"), F.col(fp).alias("fp"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, others) -> one row per row: doc_id, text_hash, fp, component_id (smallest doc_id reachable by
    links, itself included), component_fp (the fingerprint of the class that has it, which names the component).

    Null or blank text has fingerprint zero and is linked like any other; repeated rows are one
    class. Rows of one doc_id with different texts are linked by their texts only. Null doc_ids take part but never name a
    component, unless it has no other. An empty table gives no rows; texts of any length count whole.
    """
    rows = cut(fingerprints(docs))
    classes = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("low")).select("fp", _node("low", "fp").alias("node")))
    links = fingerprint_links(classes)
    for side in ("a", "b"):  # links between nodes: a component is then named by its smallest doc_id as it is found
        links = links.join(classes.select(F.col("fp").alias(side), F.col("node").alias(f"{side}_node")), side)
    parts = connected_components(links.select(F.col("a_node").alias("a"), F.col("b_node").alias("b")))
    label = classes.join(parts, "node", "left").select("fp", F.coalesce("component", "node").alias("component"))
    return rows.join(label, "fp").select("doc_id", "text_hash", "fp",
        F.when(~F.col("component.nameless"), F.col("component.id")).alias("component_id"),
                                         F.col("component.fp").alias("component_fp"))


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
