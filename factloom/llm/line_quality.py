"""Document quality from a linear-chain conditional random field over lines.

Each line is good (1) or bad (0). A line's unary score is linear in its own features and those of
the lines before and after it; neighbouring labels have a transition score. Forward-backward gives the marginal
of every line, a document's quality is their mean weighted by line length, and a two-parameter
logistic fit on the training documents turns it into a probability.

The labels mark documents, so line labels are latent. A document's label constrains its aggregate: by the length-weighted
mean of its marginals, at least SHARE of a good document is good and at most 1 - SHARE of a bad one. Training alternates:
the lines' marginals under the model, tilted by the smallest amount that meets the constraint (one number a document
that is added to each line's score in proportion to its weight), are the targets; then the likelihood of these
targets is raised by gradient steps. It starts from own features alone, so that a line is first judged by itself. Junk
lines of a good document come out bad, and clean lines of a bad one good.
"""

import pickle
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .language_id import held_out
from .shared import cut_rdd, table, written

#: Labelled documents that the driver fits on at most, with all their lines: op7 takes the first by a hash of doc_id, fit_all spreads more.
SAMPLE = 6000
#: Share of a good document that is good at least, by length.
SHARE = 0.7
#: Lines that are in memory padded at once.
CHUNK = 100_000
#: Lines of a partition of a spread fit, about, and lines that are padded there at once: a block of some 0.5 MB.
SPREAD, SPREAD_CHUNK = 25_000, 7_000
THRESHOLD = 0.3
_SYMBOLS = b"#$%&*@^~<>{}[]\\_=+/`"
_MARKS = b".,;:!?"
_UPPER = bytes(range(65, 91))
_DIGITS = b"0123456789"
_HIGH = bytes(range(128, 256))
WIDTH = 16


def line_features(line: str) -> list[float]:
    b = line.encode("utf-8", "surrogatepass")
    n = len(b)
    words = b.split()
    w = len(words)
    if not w:
        return [1.0] + [0.0] * (WIDTH - 1)

    def share(chars: bytes) -> float:
        return (n - len(b.translate(None, chars))) / n

    different = len(set(words))
    letters = n - w + 1
    return [0.0, min(np.log1p(n) / 8, 2.0), min(np.log1p(w) / 6, 2.0), min(10 * share(_SYMBOLS), 3.0), min(10 * share(b"|"), 3.0),
            min(10 * share(_DIGITS), 3.0), min(5 * share(_UPPER), 3.0), min(10 * share(_MARKS), 3.0), share(_HIGH),
            sum(map(eq, words, words[1:])) / w, 1 - different / w, min(letters / w / 10, 3.0), min(max(map(len, words)) / 30, 3.0),
            float(words[-1][-1:] in (b".", b"!", b"?")), float(words[0][:1].isupper()), float(w < 4)]


def document_features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Features (lines x WIDTH) and lengths of the lines of a whole text."""
    lines = (text or "").split("\n")
    return np.array([line_features(x) for x in lines], np.float32), np.array([len(x) for x in lines], np.float32)


def unary(own: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Scores of "good" (docs x lines) from padded features (docs x lines x WIDTH): own, line before, line after, bias."""
    out = own @ w[:WIDTH] + w[-1]
    out[:, 1:] += own[:, :-1] @ w[WIDTH:2 * WIDTH]
    out[:, :-1] += own[:, 1:] @ w[2 * WIDTH:3 * WIDTH]
    return out


def _unary_gradient(own: np.ndarray, delta: np.ndarray) -> np.ndarray:
    def dot(x: np.ndarray, d: np.ndarray) -> np.ndarray:
        return np.einsum("dsf,ds->f", x, d)

    return np.concatenate((dot(own, delta), dot(own[:, :-1], delta[:, 1:]), dot(own[:, 1:], delta[:, :-1]), [delta.sum()]))


@dataclass
class LineCRF:
    w: np.ndarray  # of the score of "good"; "bad" scores 0
    t: np.ndarray  # transitions, from x to
    scale: float = 1.0
    shift: float = 0.0


def marginals(unary: np.ndarray, n: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """unary (docs x steps, scores of good; beyond n of no effect) -> P(good) of each line (docs x steps) and
    the expected transitions (docs x 2 x 2), by forward-backward in logarithms."""
    docs, steps = unary.shape
    emit = np.stack([np.zeros_like(unary), unary], axis=2)
    inside = np.arange(steps)[None] < n[:, None]
    fwd, bwd = np.zeros((docs, steps, 2)), np.zeros((docs, steps, 2))
    fwd[:, 0] = emit[:, 0]
    for k in range(1, steps):
        a = fwd[:, k - 1, :, None] + t[None]
        fwd[:, k] = np.where(inside[:, k, None], np.logaddexp(a[:, 0], a[:, 1]) + emit[:, k], fwd[:, k - 1])
    for k in range(steps - 2, -1, -1):
        a = t[None] + (emit[:, k + 1] + bwd[:, k + 1])[:, None, :]
        bwd[:, k] = np.where(inside[:, k + 1, None], np.logaddexp(a[:, :, 0], a[:, :, 1]), 0)
    both = fwd + bwd
    total = np.logaddexp(both[:, 0, 0], both[:, 0, 1])
    good = np.where(inside, np.exp(np.minimum(both[:, :, 1] - total[:, None], 0)), 0)
    pairs = np.zeros((docs, 2, 2))
    for k in range(1, steps):
        p = fwd[:, k - 1, :, None] + t[None] + (emit[:, k] + bwd[:, k])[:, None, :] - total[:, None, None]
        pairs += np.where(inside[:, k, None, None], np.exp(np.minimum(p, 0)), 0)
    return good, pairs


def _batches(own: list[np.ndarray], lengths: list[np.ndarray], chunk: int = CHUNK):
    """Documents of like length together, at most `chunk` padded lines at once (a longer document is alone): places,
    features, numbers of lines, weights of lines (adding up to 1)."""
    order = sorted(range(len(own)), key=lambda i: len(own[i]))
    at = 0
    while at < len(order):
        end = at + 1
        while end < len(order) and (end + 1 - at) * len(own[order[end]]) <= chunk and len(own[order[end]]) <= max(8,
            2 * len(own[order[at]])):
            end += 1
        some = order[at:end]
        n = np.array([len(own[i]) for i in some])
        x, weight = np.zeros((len(some), n.max(), WIDTH), np.float32), np.zeros((len(some), n.max()))
        for row, i in enumerate(some):
            x[row, :n[row]] = own[i]
            size = lengths[i].astype(float) + 1
            weight[row, :n[row]] = size / size.sum()
        yield np.array(some), x, n, weight
        at = end


def _raw_scores(own: list[np.ndarray], lengths: list[np.ndarray], m: LineCRF) -> np.ndarray:
    """Length-weighted mean of the marginals of each document."""
    out = np.zeros(len(own))
    for some, x, n, weight in _batches(own, lengths):
        good, _ = marginals(unary(x, m.w), n, m.t)
        out[some] = (good * weight).sum(axis=1)
    return np.clip(out, 1e-6, 1 - 1e-6)


def line_marginals(text: str | None, m: LineCRF) -> np.ndarray:
    """P(good) of each line of a text."""
    own, _ = document_features(text)
    return marginals(unary(own[None], m.w), np.array([len(own)]), m.t)[0][0]


def probability(own: list[np.ndarray], lengths: list[np.ndarray], m: LineCRF) -> np.ndarray:
    p = _raw_scores(own, lengths, m)
    return 1 / (1 + np.exp(-np.clip(m.scale * np.log(p / (1 - p)) + m.shift, -30, 30)))


def constrained(u: np.ndarray, n: np.ndarray, t: np.ndarray, weight: np.ndarray, y: np.ndarray, share: float = SHARE) -> tuple[np.ndarray,
    np.ndarray]:
    """Marginals and expected transitions, tilted as little as the documents' labels ask: the weighted mean is at least
    `share` for label 1 and at most 1 - share for label 0. The tilt of a document is found by bisection."""
    tilt = weight * n[:, None]  # of mean 1 over a document's lines
    sign = np.where(y == 1, 1.0, -1.0)
    low, high = np.zeros(len(n)), np.full(len(n), 40.0)
    good, pairs = marginals(u, n, t)

    def meets(g: np.ndarray, rows: np.ndarray) -> np.ndarray:
        mean = (g * weight[rows]).sum(axis=1)
        return np.where(y[rows] == 1, mean, 1 - mean) >= share

    left = np.nonzero(~meets(good, np.arange(len(n))))[0]
    if not len(left):
        return good, pairs

    def tilted(by: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return marginals(u[left] + (sign[left] * by)[:, None] * tilt[left], n[left], t)

    for _ in range(10):
        middle = (low[left] + high[left]) / 2
        fits = meets(tilted(middle)[0], left)
        high[left] = np.where(fits, middle, high[left])
        low[left] = np.where(fits, low[left], middle)
    good[left], pairs[left] = tilted(high[left])
    return good, pairs


def _ascend(begin, gradient, lines: int, rounds: int, steps: int, l2: float, l2_context: float) -> np.ndarray:
    """Adam on the mean likelihood of `lines` lines, in rounds: begin(round, theta) sets the targets that gradient(theta) is of."""
    theta = np.zeros(3 * WIDTH + 5)
    penalty = np.full(len(theta), l2)
    penalty[WIDTH:3 * WIDTH] = penalty[-4:] = l2_context
    first = np.zeros_like(theta)
    first[:WIDTH] = first[3 * WIDTH] = 1  # own features and bias
    for turn in range(rounds + 1):
        begin(turn, theta)
        m1, m2 = 0.0, 0.0
        for k in range(1, steps * (2 if turn == 0 else 1) + 1):
            g = gradient(theta) / lines - penalty * theta
            if turn == 0:
                g = g * first
            m1, m2 = 0.9 * m1 + 0.1 * g, 0.99 * m2 + 0.01 * g * g
            theta = theta + 0.1 * (m1 / (1 - 0.9 ** k)) / (np.sqrt(m2 / (1 - 0.99 ** k)) + 1e-8)
    return theta


def _logistic(sums, least: float = 0.0) -> tuple[float, float]:
    """Newton steps of the penalised logistic until none is above `least`; sums(a, b) adds up over documents, for q their
    probability at a z + b and h = q (1 - q): (y - q) z, y - q, h z z, h z, h."""
    a, b = 1.0, 0.0
    for _ in range(50):
        g1, g2, zz, z, one = sums(a, b)
        g = np.array([g1 - 0.1 * (a - 1), g2 - 0.1 * b])
        step = np.linalg.solve(np.array([[zz + 0.1, z], [z, one + 0.1]]), g)
        a, b = a + np.clip(step[0], -1, 1), b + np.clip(step[1], -2, 2)
        if np.abs(step).max() <= least:
            break
    return max(float(a), 1e-3), float(b)


def _target(turn: int, theta: np.ndarray, x: np.ndarray, n: np.ndarray, weight: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals and transitions that a round aims at: at first a document's label on all its lines."""
    if turn == 0:
        return np.where(np.arange(x.shape[1])[None] < n[:, None], y[:, None], 0.0), np.zeros((len(n), 2, 2))
    return constrained(unary(x, theta[:-4]), n, theta[-4:].reshape(2, 2), weight, y)


def fit_crf(own: list[np.ndarray], lengths: list[np.ndarray], y: np.ndarray, rounds: int = 3, steps: int = 30,
            l2: float = 2e-3, l2_context: float = 0.1) -> LineCRF:
    """Raise the likelihood of the targets with Adam, in rounds of new targets, then fit the logistic.

    Lines of a document are alike, so their features could stand for each other's: what neighbours say is penalised more
    than what a line itself says, or a line would be judged by the lines around it alone.
    """
    batches, targets = list(_batches(own, lengths)), {}

    def begin(turn: int, theta: np.ndarray) -> None:
        for k, (some, x, n, weight) in enumerate(batches):
            targets[k] = _target(turn, theta, x, n, weight, y[some])

    def gradient(theta: np.ndarray) -> np.ndarray:
        grad = np.zeros_like(theta)
        for b, (_, x, n, _) in enumerate(batches):
            good, pairs = marginals(unary(x, theta[:-4]), n, theta[-4:].reshape(2, 2))
            grad[:-4] += _unary_gradient(x, targets[b][0] - good)
            grad[-4:] += (targets[b][1] - pairs).sum(axis=0).ravel()
        return grad

    theta = _ascend(begin, gradient, sum(map(len, own)), rounds, steps, l2, l2_context)
    model = LineCRF(theta[:-4], theta[-4:].reshape(2, 2))
    p = _raw_scores(own, lengths, model)
    z = np.log(p / (1 - p))

    def sums(a: float, b: float) -> tuple:
        q = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        h = q * (1 - q)
        return ((y - q) * z).sum(), (y - q).sum(), (h * z * z).sum(), (h * z).sum(), h.sum()

    return LineCRF(model.w, model.t, *_logistic(sums))


def fit_spread(rows: DataFrame, lines: int, rounds: int = 3, steps: int = 30, l2: float = 2e-3, l2_context: float = 0.1) -> LineCRF:
    """fit_crf of rows (doc_id, x, n, quality) that stay spread: the same steps on the same sums, up to their rounding.

    Documents of like length are padded together and cut; a step is one pass over them, of which the driver gets the sums of
    each task. Only the sums of a round's targets are kept, as the gradient is linear in them. A pass reads pickled blocks one by
    one: as Arrow batches of Parquet rows, all blocks of a task were in an executor's memory several times.
    """
    def padded(batches):
        for b in batches:
            own = [np.asarray(x, np.float32).reshape(-1, WIDTH) for x in b["x"]]
            y = b["quality"].to_numpy(float)
            for some, x, n, weight in _batches(own, [np.asarray(v, np.float32) for v in b["n"]], SPREAD_CHUNK):
                yield pd.DataFrame({"block": [pickle.dumps((x, n, weight, y[some]), 5)]})

    spark = rows.sparkSession
    alike = rows.repartitionByRange(1 + lines // SPREAD, F.size("n"), F.xxhash64("doc_id"))
    blocks = cut_rdd(spark, alike.mapInPandas(padded, "block binary").rdd.map(lambda r: bytes(r["block"])))
    blocks = blocks.coalesce(2 * spark.sparkContext.defaultParallelism)

    def total(of) -> np.ndarray:
        def run(part):
            yield sum((np.concatenate(of(*pickle.loads(block))) for block in part), np.zeros(3 * WIDTH + 5))

        return np.sum(blocks.mapPartitions(run).collect(), axis=0)  # a row a task

    aim = np.zeros(3 * WIDTH + 5)

    def begin(turn: int, theta: np.ndarray) -> None:
        def of(x, n, weight, y):
            good, pairs = _target(turn, theta, x, n, weight, y)
            return _unary_gradient(x, good), pairs.sum(axis=0).ravel()

        aim[:] = total(of)

    def gradient(theta: np.ndarray) -> np.ndarray:
        def of(x, n, weight, y):
            good, pairs = marginals(unary(x, theta[:-4]), n, theta[-4:].reshape(2, 2))
            return _unary_gradient(x, good), pairs.sum(axis=0).ravel()

        return aim - total(of)

    theta = _ascend(begin, gradient, lines, rounds, steps, l2, l2_context)
    w, t = theta[:-4], theta[-4:].reshape(2, 2)

    def logits(block):
        x, n, weight, y = pickle.loads(block)
        p = np.clip((marginals(unary(x, w), n, t)[0] * weight).sum(axis=1), 1e-6, 1 - 1e-6)
        return zip(np.log(p / (1 - p)).tolist(), y.tolist())

    scored = written(spark.createDataFrame(blocks.flatMap(logits), "z double, y double"), "quality-logits")

    def sums(a: float, b: float) -> tuple:
        q = 1 / (1 + F.exp(-F.greatest(F.least(F.col("z") * float(a) + float(b), F.lit(30.0)), F.lit(-30.0))))
        of = scored.select("z", "y", q.alias("q")).selectExpr("z", "y - q AS d", "q * (1 - q) AS h")
        return tuple(of.selectExpr("sum(d * z)", "sum(d)", "sum(h * z * z)", "sum(h * z)", "sum(h)").first())

    return LineCRF(w, t, *_logistic(sums, 1e-9))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> LineCRF:
    """docs (doc_id, text), labels (doc_id, quality) -> model. At most `sample` labelled documents are used, the first by a
    hash of doc_id, each with all its lines; rows without text or label do not count, of labels that repeat a doc_id the
    larger counts, of rows that repeat it the one with the smallest text. The driver holds about 200 bytes for each line of them.

    Labels of one kind only, or none, give a model that scores every text near their share.
    """
    some = labels.where("quality IN (0, 1)").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    some = some.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)  # at most `sample` ids: small enough to broadcast
    return _fit_collected(_features(docs, F.broadcast(some)))


def fit_all(docs: DataFrame, labels: DataFrame, held: int = SAMPLE) -> LineCRF:
    """As fit, but of every labelled document, however many. Up to `held` of them are fitted on the driver; more stay spread."""
    some = labels.where("quality IN (0, 1)").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    rows = written(_features(docs, some), "quality-features")
    n, good, lines = rows.agg(F.count("*"), F.sum("quality"), F.sum(F.size("n"))).first()
    if n <= held:
        return _fit_collected(rows)
    return fit_spread(rows, lines) if 0 < good < n else _constant(good, n)


def _features(docs: DataFrame, some: DataFrame) -> DataFrame:
    """docs (doc_id, text) with labels some (doc_id, quality) -> doc_id, features x and lengths n of all lines, quality."""
    rows = docs.where("text IS NOT NULL").select("doc_id", "text").join(some, "doc_id")
    rows = rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("quality").alias("quality"))

    def features(batches):
        for b in batches:
            found = [document_features(t) for t in b["text"]]
            yield pd.DataFrame({"doc_id": b["doc_id"], "x": [x.ravel() for x, _ in found], "n": [n for _, n in found],
                "quality": b["quality"]})

    return rows.mapInPandas(features, "doc_id long, x array<float>, n array<float>, quality int")


def _constant(good: float, n: int) -> LineCRF:
    share = (good + 1) / (n + 2)
    return LineCRF(np.zeros(3 * WIDTH + 1), np.zeros((2, 2)), 1e-3, float(np.log(share / (1 - share))))


def _fit_collected(rows: DataFrame) -> LineCRF:
    got = rows.toPandas().sort_values("doc_id")
    own = [np.asarray(x, np.float32).reshape(-1, WIDTH) for x in got["x"]]
    y = got["quality"].to_numpy(float)
    if len(set(y)) < 2:
        return _constant(y.sum(), len(y))
    return fit_crf(own, [np.asarray(n, np.float32) for n in got["n"]], y)


def score(docs: DataFrame, model: LineCRF, name: str = "quality_score") -> DataFrame:
    """All columns of docs (text, others) with the column `name`, which replaces one of that name. Null text is scored as
    empty text: one blank line. Whole texts count, whatever their length; equal texts score alike; no rows give none."""

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for text in batches:
            out = []
            for at in range(0, len(text), 256):
                found = [document_features(t) for t in text.iloc[at:at + 256]]
                out.append(probability([x for x, _ in found], [n for _, n in found], model))
            yield pd.Series(np.concatenate(out) if out else np.zeros(0))

    return docs.withColumn(name, run("text"))


def train_and_score(docs: DataFrame, labels: DataFrame, name: str = "quality_score", fitted=fit) -> DataFrame:
    return score(docs, fitted(docs, labels.where(~held_out(F.col("doc_id")))), name)


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document scored by a model of the labelled documents that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = train_and_score(docs, table(spark, sf_dir, "labels"))
    return out.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"),
                      F.col("quality_score").alias("score"), (F.col("quality_score") >= THRESHOLD).cast("int").alias("predicted"))
