"""Approximate nearest neighbours by multiprobe p-stable hashing.

Each of TABLES hash tables cuts HASHES Gaussian (2-stable) projections into slots of width W times the typical
distance; a vector's bucket in a table is its tuple of slots. The score of a bucket for a query is the sum of the
squared distances from the query to the slot borders that must be crossed to get there, so buckets in order of
score are the perturbed buckets in order of estimated success. Of that sequence only buckets that hold rows are
generated: occupied buckets are scored from a table of border distances, and visited in that order.

How far to go follows from stability: the projections of a point at distance d differ from the query's by d times a
Gaussian, so the scores of a few hundred Gaussian draws give the score below which such a point lies with probability
p. A first round visits about FIRST rows of the query's own cell in every table; the k-th distance found there (or in a
bounded sample) bounds the true one, and the second round visits every bucket up to the score that finds a point
at that distance, in one table or the other, with probability SUCCESS. As nearer rows turn up the stop
moves down. Candidates of all tables are merged and ranked by exact Euclidean distance in double precision.

Rows are dealt by table and cell, the slots of the first few projections in four classes each; a query goes only to the
cells whose own border distances are below its stop. Cells above SHARD rows are split by a hash; so are queries of a
cell above QUERIES. The directory of cells has at most 4 ** MAX_PREFIX entries a table, whatever the number of rows.

Equal vectors are candidates once, with the k + 1 smallest ids: ties go to the smaller id, so no other copy can be
among the k nearest. A group of copies therefore costs one row for each task before any vector is dealt.

Fitted on at most about SAMPLE rows (of each vector length, there is mostly one): slot width, slot classes, the first bound.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .shared import cut, table

TABLES, HASHES, W = 2, 24, 0.8
#: Probability that a row at the distance of the k-th found is visited, and Gaussian draws to estimate it.
SUCCESS, DRAWS = 0.88, 300
#: Rows of a query's own cell that the first round visits in each table.
FIRST = 256
SHARD, QUERIES, SAMPLE, MAX_PREFIX, SEED = 8192, 2048, 1000, 8, 20_011
#: The stop is known for these shares of the first bound.
_LEVELS = 1 - np.arange(10) / 10


@lru_cache(8)
def _functions(dim: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    return rng.standard_normal((TABLES, dim, HASHES)), rng.random((TABLES, 1, HASHES))


@lru_cache(1)
def _draws() -> np.ndarray:
    return np.random.default_rng(SEED + 1).standard_normal((DRAWS, HASHES))


@dataclass
class Plan:
    """What is fitted for vectors of one length."""

    dim: int
    width: float
    prefix: int  # projections that make a cell
    middle: np.ndarray  # TABLES x prefix: cells are slots below middle - 1, middle - 1, middle, above
    sample_ids: np.ndarray
    sample: np.ndarray

    def project(self, x: np.ndarray) -> np.ndarray:
        """x (n x dim) -> TABLES x n x HASHES, in slots."""
        a, b = _functions(self.dim)
        return x @ a / self.width + b

    def cells(self, y: np.ndarray) -> np.ndarray:
        """Projections -> TABLES x n cell numbers."""
        s = np.floor(y[:, :, :self.prefix]).astype(np.int64) - self.middle[:, None, :]
        return (np.clip(s + 2, 0, 3) << (2 * np.arange(self.prefix))).sum(axis=2)

    def cell_scores(self, y: np.ndarray, t: int) -> np.ndarray:
        """One query's projections (HASHES) in table t -> the score of each of the 4 ** prefix cells."""
        out = np.zeros(1)
        for i in range(self.prefix):
            m = self.middle[t, i]
            edges = np.array([-np.inf, m - 1, m, m + 1, np.inf])
            gap = np.maximum(np.maximum(edges[:-1] - y[i], y[i] - edges[1:]), 0) ** 2
            out = (out[None, :] + gap[:, None]).ravel()
        return out

    def stops(self, y: np.ndarray, bound: float) -> np.ndarray:
        """One query's projections (TABLES x HASHES), the distance to reach -> TABLES x levels: scores to go up to."""
        if not np.isfinite(bound):
            return np.full((TABLES, len(_LEVELS)), np.inf)
        p = 1 - (1 - SUCCESS) ** (1 / TABLES)
        z = np.floor(y[:, None, None, :] + (bound / self.width * _LEVELS)[None, :, None, None] * _draws())
        here = y[:, None, None, :]
        score = (np.maximum(np.maximum(z - here, here - (z + 1)), 0) ** 2).sum(axis=3)
        return np.quantile(score, p, axis=2)


def fit(dim: int, n: int, ids: np.ndarray, x: np.ndarray) -> Plan:
    """A plan for n vectors of a length from a sample of them."""
    pairs = np.random.default_rng(SEED).integers(0, len(x), (2, 2000))
    typical = float(np.median(np.sqrt(((x[pairs[0]] - x[pairs[1]]) ** 2).sum(axis=1))))
    plan = Plan(dim, W * typical or 1.0, 0, np.zeros((TABLES, 0), np.int64), ids, x)
    slots = np.floor(plan.project(x)).astype(np.int64)[:, :, :min(MAX_PREFIX, HASHES)]
    middle = np.floor(np.median(slots, axis=1)).astype(np.int64)
    classes = np.clip(slots - middle[:, None, :] + 2, 0, 3)
    share = np.stack([(classes == c).mean(axis=1) for c in range(4)])
    kinds = float(np.exp(-(share * np.log(np.maximum(share, 1e-12))).sum(axis=0)).mean())  # as many classes, equally full
    prefix = int(np.clip(np.log(max(1.0, n / SHARD)) / np.log(kinds), 0, slots.shape[2])) if kinds > 1.01 else 0
    return Plan(dim, plan.width, prefix, middle[:, :prefix], ids, x)


def search(plan: Plan, t: int, ids: np.ndarray, x: np.ndarray, qids: np.ndarray, q: np.ndarray, k: int, first: int,
           stops: np.ndarray | None = None, bounds: np.ndarray | None = None) -> list[tuple[int, int, float, int]]:
    """One table's buckets of rows (ids, x), visited by queries -> (query, place of the row, distance, 0) for the k nearest
    found, and (query, -1, nan, rows visited).

    stops (queries x levels): the score to go up to, for each level of the distance bound; without stops the `first` rows
    are visited.
    """
    y = plan.project(x)[t]
    slots = np.floor(y).astype(np.int64)
    low = slots.min(axis=0)
    buckets, of_row = np.unique(slots - low, axis=0, return_inverse=True)
    span = int(buckets.max()) + 1
    one_hot = np.zeros((len(buckets), HASHES * span), np.float32)
    one_hot[np.arange(len(buckets))[:, None], np.arange(HASHES) * span + buckets] = 1
    borders = low[:, None] + np.arange(span)
    of_row = of_row.ravel()
    out = []
    for at in range(0, len(q), 64):
        here = plan.project(q[at:at + 64])[t][:, :, None]
        gaps = np.maximum(np.maximum(borders - here, here - (borders + 1)), 0) ** 2
        scores = gaps.reshape(len(here), -1).astype(np.float32) @ one_hot.T
        for i in range(len(here)):
            mine, v = qids[at + i], q[at + i]
            score = scores[i][of_row]
            able = ids != mine
            if stops is None:
                cand = np.nonzero(able)[0]
                if len(cand) > first:
                    cand = cand[np.argpartition(score[cand], first - 1)[:first]]
                stop, level = np.inf, None
            else:
                level = stops[at + i]
                stop = level[0] * (1 + 1e-6) + 1e-9
                cand = np.nonzero(able & (score <= stop))[0]
            cand = cand[np.argsort(score[cand], kind="stable")]
            best, near, seen, step = np.empty(0), np.empty(0, np.int64), 0, 256
            while seen < len(cand) and score[cand[seen]] <= stop:
                part = cand[seen:seen + step]
                part = part[score[part] <= stop]
                d = np.sqrt(((x[part] - v) ** 2).sum(axis=1))
                best, near = np.concatenate((best, d)), np.concatenate((near, part))
                if len(best) > k:
                    keep = np.nonzero(best <= np.partition(best, k - 1)[k - 1])[0]
                    best, near = best[keep], near[keep]
                seen += len(part)
                step *= 2
                if level is not None and len(best) >= k:
                    reach = np.nonzero(bounds[at + i] * _LEVELS >= best.max())[0]
                    if len(reach):
                        stop = min(stop, level[reach[-1]] * (1 + 1e-6) + 1e-9)
            top = np.lexsort((ids[near], best))[:k]
            out.extend((mine, int(near[j]), float(best[j]), 0) for j in top)
            out.append((mine, -1, float("nan"), seen))
    return out


def valid_vectors(df: DataFrame) -> DataFrame:
    """vec_id, v array<double>: vectors that are not null, empty or zero and have no null or non-finite component."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    return df.select("vec_id", v.alias("v")).where("vec_id IS NOT NULL").where(
        F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0))


def _candidates(valid: DataFrame, k: int) -> DataFrame:
    """vec_id, v, n (rows that repeat both), dim; of equal vectors the k + 1 smallest ids."""
    once = valid.groupBy("v", "vec_id").agg(F.count(F.lit(1)).alias("n"))
    rank = F.dense_rank().over(Window.partitionBy("v").orderBy("vec_id"))
    return once.withColumn("rank", rank).where(F.col("rank") <= k + 1).select("vec_id", "v", "n", F.size("v").alias("dim"))


_KEY = "dim int, t int, cell long, salt int, block int"


def _plans(rows: DataFrame) -> dict[int, Plan]:
    sizes = {r["dim"]: r["n"] for r in rows.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return {}
    share = F.create_map(*[F.lit(x) for d, n in sizes.items() for x in (d, min(1.0, SAMPLE / n))])
    taken = rows.where(F.pmod(F.xxhash64("vec_id", "v"), F.lit(1 << 30)) < share[F.col("dim")] * (1 << 30))
    found: dict[int, list] = {}
    for r in taken.select("dim", "vec_id", "v").collect():
        found.setdefault(r["dim"], []).append((r["vec_id"], r["v"]))
    out = {}
    for d, n in sizes.items():
        some = sorted(found.get(d) or rows.where(F.col("dim") == d).select("vec_id", "v").limit(1).collect())
        out[d] = fit(d, n, np.array([i for i, _ in some], np.int64), np.array([v for _, v in some], float))
    return out


def _mix(ids: np.ndarray) -> np.ndarray:
    """Ids to 31 well mixed bits."""
    with np.errstate(over="ignore"):
        return (ids.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64)


def _by_length(b: pd.DataFrame):
    for d, g in b.groupby("dim", sort=False):
        yield int(d), g, np.stack(g["v"].to_numpy())


def _count_cells(df: DataFrame, plans: dict[int, Plan]) -> dict[tuple[int, int], np.ndarray]:
    """Rows in each cell, by (dim, table): at most 4 ** MAX_PREFIX numbers each."""

    def run(batches):
        for b in batches:
            for d, g, x in _by_length(b):
                for t, c in enumerate(plans[d].cells(plans[d].project(x))):
                    cell, n = np.unique(c, return_counts=True)
                    yield pd.DataFrame({"dim": d, "t": t, "cell": cell, "n": n})

    out = {(d, t): np.zeros(4 ** p.prefix, np.int64) for d, p in plans.items() for t in range(TABLES)}
    for r in df.select("dim", "v").mapInPandas(run, "dim int, t int, cell long, n long").groupBy("dim", "t",
        "cell").agg(F.sum("n").alias("n")).collect():
        out[r["dim"], r["t"]][r["cell"]] = r["n"]
    return out


def _deal_rows(rows: DataFrame, plans: dict, salts: dict, blocks: dict) -> DataFrame:
    """Rows to the tasks of their cells that queries go to: once for each block of queries."""

    def run(batches):
        for b in batches:
            for d, g, x in _by_length(b):
                ids, n = g["vec_id"].to_numpy(), g["n"].to_numpy()
                mix = _mix(ids)
                for t, cell in enumerate(plans[d].cells(plans[d].project(x))):
                    salt, many = mix % salts[d, t][cell], blocks[d, t][cell]
                    at = np.repeat(np.arange(len(ids)), many)
                    block = np.arange(len(at)) - np.repeat(np.cumsum(many) - many, many)
                    for lo in range(0, len(at), 4096):
                        p = at[lo:lo + 4096]
                        yield pd.DataFrame({"dim": d, "t": t, "cell": cell[p], "salt": salt[p], "block": block[lo:lo + 4096],
                            "vec_id": ids[p], "n": n[p], "v": list(x[p])})

    return rows.mapInPandas(run, f"{_KEY}, vec_id long, n long, v array<double>")


def _with_blocks(sent: DataFrame, blocks: dict) -> DataFrame:
    def run(batches):
        for b in batches:
            many = np.array([blocks[d, t][c] for d, t, c in zip(b["dim"], b["t"], b["cell"])], np.int64)
            b["block"] = _mix(b["query_id"].to_numpy()) % np.maximum(many, 1)
            yield b

    return sent.mapInPandas(run, sent.schema)


def nearest(df: DataFrame, is_query, k: int = 10) -> DataFrame:
    """df (vec_id, embedding, others), is_query: a condition on vec_id -> query_id, rank (from 1), vec_id, score, visited:
    the k nearest of the other rows that were found, nearest first, ties to the smaller vec_id; visited is the number
    of exact distances that the query took, over all tables (of equal vectors, few count).

    Vectors of different lengths have no distance: each length is searched by itself. Rows that repeat a vec_id are rows
    of their own as candidates; a query never finds its own id, and is asked once (with the smallest of its vectors).
    Null, zero and non-finite vectors take no part, other columns do not matter, and without valid vectors there are no rows.
    """
    spark = df.sparkSession
    schema = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("rank", T.IntegerType()),
        T.StructField("vec_id", T.LongType()),
                           T.StructField("score", T.DoubleType()), T.StructField("visited", T.LongType())])
    valid = valid_vectors(df)
    rows = cut(_candidates(valid, k))
    plans = _plans(rows)
    if not plans:
        return spark.createDataFrame([], schema)
    asked = cut(valid.where(is_query).groupBy("vec_id").agg(F.min("v").alias("v")).withColumn("dim", F.size("v")))
    counts = _count_cells(rows, plans)
    salts = {key: np.maximum(1, -(-c // SHARD)) for key, c in counts.items()}

    def blocks_of(queries: dict) -> dict:
        return {key: -(-c // QUERIES) for key, c in queries.items()}

    def run(key, r: pd.DataFrame, s: pd.DataFrame) -> pd.DataFrame:
        d, t = key[0], key[1]
        if not len(s) or not len(r):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": [], "n": [], "seen": []})
        ids, n = r["vec_id"].to_numpy(), r["n"].to_numpy()
        some = s["stops"].iloc[0] is not None
        first_rows = max(2 * k, FIRST // int(salts[d, t][key[2]]))
        found = search(plans[d], t, ids, np.stack(r["v"].to_numpy()), s["query_id"].to_numpy(), np.stack(s["v"].to_numpy()), k, first_rows,
                       np.stack(s["stops"].to_numpy()) if some else None, s["bound"].to_numpy() if some else None)
        at = np.array([f[1] for f in found])
        return pd.DataFrame({"query_id": [f[0] for f in found], "vec_id": pd.array(np.where(at < 0, 0, ids[at]), "Int64").copy(),
            "score": [f[2] for f in found],
                             "n": np.where(at < 0, 0, n[at]), "seen": [f[3] for f in found]})

    def visit(sent: DataFrame, queries: dict) -> DataFrame:
        blocks = blocks_of(queries)
        dealt = _deal_rows(rows, plans, salts, blocks)
        keys = ["dim", "t", "cell", "salt", "block"]
        return dealt.groupBy(*keys).cogroup(_with_blocks(sent, blocks).groupBy(*keys)).applyInPandas(
            run, "query_id long, vec_id long, score double, n long, seen long")

    def home(batches):
        for b in batches:
            for d, g, x in _by_length(b):
                for t, cell in enumerate(plans[d].cells(plans[d].project(x))):
                    many = salts[d, t][cell]
                    at = np.repeat(np.arange(len(cell)), many)
                    salt = np.arange(len(at)) - np.repeat(np.cumsum(many) - many, many)
                    yield pd.DataFrame({"dim": d, "t": t, "cell": cell[at], "salt": salt, "block": 0,
                        "query_id": g["vec_id"].to_numpy()[at], "v": list(x[at]), "bound": np.nan, "stops": None})

    sent_schema = f"{_KEY}, query_id long, v array<double>, bound double, stops array<double>"
    opening = cut(visit(asked.mapInPandas(home, sent_schema), _count_cells(asked, plans)))
    real = opening.where("seen = 0 AND n > 0").select("query_id", F.struct("score", "vec_id", "n").alias("x")).distinct()
    # at most k rows of each table and query; repeated rows count
    reached = real.groupBy("query_id").agg(F.sort_array(F.collect_list("x")).alias("x")).select(
        "query_id", F.get(F.flatten(F.transform("x", lambda e: F.array_repeat(e["score"], F.least(e["n"], F.lit(k)).cast("int")))),
        k - 1).alias("reached"))
    bounded = asked.join(reached, asked["vec_id"] == reached["query_id"], "left").select("vec_id", "v", "dim", "reached")

    def route(batches):
        for b in batches:
            out = []
            for d, g, x in _by_length(b):
                plan = plans[d]
                y = plan.project(x)
                for i, (mine, reached_) in enumerate(zip(g["vec_id"], g["reached"])):
                    others = np.sqrt(((plan.sample - x[i]) ** 2).sum(axis=1))[plan.sample_ids != mine]
                    bound = np.partition(others, k - 1)[k - 1] if len(others) >= k else np.inf
                    bound = min(bound, reached_) if reached_ == reached_ else bound
                    stops = plan.stops(y[:, i], bound)
                    for t in range(TABLES):
                        to = np.nonzero((counts[d, t] > 0) & (plan.cell_scores(y[t, i], t) <= stops[t, 0] + 1e-9))[0]
                        for cell in to.tolist():
                            out.extend((d, t, cell, salt, 0, mine, x[i], bound, stops[t]) for salt in range(int(salts[d, t][cell])))
                        if len(out) > 2000:
                            yield pd.DataFrame(out, columns=["dim", "t", "cell", "salt", "block", "query_id", "v", "bound", "stops"])
                            out = []
            yield pd.DataFrame(out, columns=["dim", "t", "cell", "salt", "block", "query_id", "v", "bound", "stops"])

    sent = cut(bounded.mapInPandas(route, sent_schema))
    queries = {key: np.zeros(len(c), np.int64) for key, c in counts.items()}
    for r in sent.where("salt = 0").groupBy("dim", "t", "cell").agg(F.count(F.lit(1)).alias("n")).collect():  # at most as many as cells
        queries[r["dim"], r["t"]][r["cell"]] = r["n"]
    near = opening.union(visit(sent, queries))
    # the k best of each query, in two steps: first for parts of the ids, as a query may have come to many cells
    entry = F.when(F.col("n") > 0, F.struct("score", "vec_id", "n"))
    parts = near.groupBy("query_id", F.pmod("vec_id", F.lit(16)).alias("part")).agg(
        F.slice(F.sort_array(F.collect_set(entry)), 1, k).alias("best"), F.sum("seen").alias("seen"))
    best = parts.groupBy("query_id").agg(F.slice(F.sort_array(F.flatten(F.collect_list("best"))), 1, k).alias("best"),
        F.sum("seen").alias("visited"))
    repeated = F.flatten(F.transform("best",
        lambda e: F.array_repeat(F.struct(e["score"].alias("score"), e["vec_id"].alias("vec_id")), F.least(e["n"], F.lit(k)).cast("int"))))
    return best.select("query_id", "visited", F.posexplode(F.slice(repeated, 1, k)).alias("rank", "b")).select(
        "query_id", (F.col("rank") + 1).alias("rank"), "b.vec_id", "b.score", "visited")


def op1_ann_multiprobe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest of every row whose vec_id is divisible by 100, among all other rows of embeddings."""
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)
