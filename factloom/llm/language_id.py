"""Language identification with hyperdimensional n-gram profiles.

Each letter has a random vector of +1 and -1, drawn from its code point. A trigram is the product of
its letters' vectors, the first permuted twice and the second once (a rotation), a text the sum of
its trigrams, a language the sum of its texts. A text's language is the prototype with the largest
cosine. Sums are of integers, so prototypes do not depend on the order of rows.
"""

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import table, written

DIM = 1024
#: Labelled rows that op2's prototypes are bundled from, in expectation, if there are more.
SAMPLE = 20_000
#: A text of MIN_LETTERS letters or more is of no learned language if its cosine is below MIN_SHARE of what is typical.
MIN_LETTERS, MIN_SHARE = 100, 0.45
#: Characters that are turned into vectors at once.
_CHUNK = 200_000
#: Texts whose vectors are held at once.
_ROWS = 256
#: Ranges that the scores of a language are counted in, at each step towards their median.
_RANGES = 1024
_ALPHA: np.ndarray | None = None
_LETTERS: dict[int, np.ndarray] = {}


def _alpha() -> np.ndarray:
    global _ALPHA
    if _ALPHA is None:
        _ALPHA = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _ALPHA


def _letter(code: int, dim: int) -> np.ndarray:
    v = _LETTERS.get(code)
    if v is None or len(v) != dim:
        if len(_LETTERS) > 5000:
            _LETTERS.clear()
        v = _LETTERS[code] = np.random.default_rng(7_000_003 + code).integers(0, 2, dim, dtype=np.int8) * 2 - 1
    return v


def _bundle(texts: list[str], dim: int) -> np.ndarray:
    """Vectors (len(texts) x dim) of texts that together are not much longer than _CHUNK."""
    lower = [t.lower() for t in texts]
    codes = np.frombuffer(" ".join(["", *lower, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    doc = np.repeat(np.arange(len(texts)), [len(t) + 1 for t in lower])  # with the space before it
    doc = np.append(doc, len(texts) - 1)
    x = np.where(_alpha()[codes], codes, 32)
    # every text: one space, then its words with one space between
    keep = (x != 32) | (np.concatenate(([0], x[:-1])) != 32) | (np.diff(doc, prepend=-1) != 0)
    x, doc = x[keep], doc[keep]
    keep = (x != 32) | (np.diff(doc, append=-1) == 0)  # not one behind the last word
    x, doc = np.append(x[keep], 32), np.append(doc[keep], len(texts) - 1)
    if len(x) < 3:
        return np.zeros((len(texts), dim), np.float32)
    letters = np.nonzero(np.bincount(x))[0]
    small = np.zeros(letters[-1] + 1, np.int64)
    small[letters] = np.arange(len(letters))
    k, s = len(letters), small[x]
    # the space after a word at a text's end is the next text's
    inside = doc[:-2] == doc[1:-1]
    key = ((s[:-2] * k + s[1:-1]) * k + s[2:])[inside]
    owner = doc[:-2][inside]
    if k ** 3 <= 4_000_000:
        grams = np.nonzero(np.bincount(key, minlength=1))[0]
        place = np.zeros(k ** 3, np.int64)
        place[grams] = np.arange(len(grams))
        at = place[key]
    else:
        grams, at = np.unique(key, return_inverse=True)
    base = np.stack([_letter(int(c), dim) for c in letters])
    twice, once = np.roll(base, 2, axis=1), np.roll(base, 1, axis=1)
    out = np.zeros((len(texts), dim), np.float32)
    for lo in range(0, len(grams), 4096):
        g = grams[lo:lo + 4096]
        vec = (twice[g // (k * k)] * once[g // k % k] * base[g % k]).astype(np.float32)
        mine = (at >= lo) & (at < lo + len(g))
        counts = np.bincount(owner[mine] * len(g) + at[mine] - lo, minlength=len(texts) * len(g)).reshape(len(texts), len(g))
        out += counts.astype(np.float32) @ vec
    return out


def document_vectors(texts: list[str | None], dim: int = DIM) -> np.ndarray:
    """Vectors of whole texts. Very long texts are bundled in parts that overlap in two characters."""
    out = np.zeros((len(texts), dim), np.float64)
    group: list[tuple[int, str]] = []

    def flush() -> None:
        if group:
            np.add.at(out, [i for i, _ in group], _bundle([t for _, t in group], dim))
            group.clear()

    size = 0
    for i, t in enumerate(texts):
        for at in range(0, len(t or ""), _CHUNK):
            part = t[max(0, at - 2):at + _CHUNK]
            if size + len(part) > _CHUNK or len(group) >= 128:
                flush()
                size = 0
            group.append((i, part))
            size += len(part)
    flush()
    return out


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def _sampled(rows: DataFrame, sample: int | None) -> DataFrame:
    if sample is None:
        return rows
    n = rows.count()
    if n <= sample:
        return rows
    return rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(sample / n * (1 << 30)))


def fit(docs: DataFrame, sample: int | None = SAMPLE, dim: int = DIM) -> tuple[list[str], np.ndarray]:
    """docs (doc_id, text, lang) -> languages and their prototypes. Rows without text or lang do not count; rows that repeat count each
    time, and those without doc_id are drawn like any other.

    If there are more rows than `sample`, a share of sample / rows of them is used, chosen by a hash
    of doc_id; None uses every row. What reaches the driver is one vector for each language.
    """
    rows = _sampled(docs.where("text IS NOT NULL AND lang IS NOT NULL").select("doc_id", "text", "lang"), sample)

    def bundle(batches):
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            for lo in range(0, len(b), _ROWS):
                part = b.iloc[lo:lo + _ROWS]
                vectors = document_vectors(part["text"].tolist(), dim)
                for lang, at in part.groupby("lang").indices.items():
                    sums[lang] = sums.get(lang, 0) + vectors[at].sum(axis=0)
        if sums:
            yield pd.DataFrame({"lang": list(sums), "v": [s.astype(np.int64) for s in sums.values()]})

    def total(key, g):
        return pd.DataFrame({"lang": [key[0]], "v": [np.sum(np.stack(g["v"]), axis=0)]})

    parts = rows.mapInPandas(bundle, "lang string, v array<long>")
    found = parts.groupBy("lang").applyInPandas(total, "lang string, v array<long>").toPandas().sort_values("lang")
    if found.empty:
        return [], np.zeros((0, dim))
    p = np.stack(found["v"]).astype(np.float64)
    return found["lang"].tolist(), p / np.maximum(np.linalg.norm(p, axis=1, keepdims=True), 1e-12)


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray], name: str = "language") -> DataFrame:
    """All columns of docs (text, others) with the struct `name` (a column of that name is replaced): lang_pred
    and score, the prototype of largest cosine (ties: the first language by name) and that cosine, from 0 to 1.

    Null text and text without a letter: und, 0. The same without any prototype.
    """
    langs, protos = model

    @F.pandas_udf("lang_pred string, score double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for text in batches:
            pred, score = np.full(len(text), "und", object), np.zeros(len(text))
            for lo in range(0, len(text) if langs else 0, _ROWS):
                v = document_vectors(text.iloc[lo:lo + _ROWS].tolist(), protos.shape[1])
                norm = np.linalg.norm(v, axis=1)
                cos = v @ protos.T / np.maximum(norm, 1e-12)[:, None]
                some = np.nonzero(norm > 0)[0]
                pred[lo + some] = np.array(langs, object)[cos.argmax(axis=1)][some]
                score[lo + some] = np.clip(cos.max(axis=1), 0, 1)[some]
            yield pd.DataFrame({"lang_pred": pred, "score": score})

    return docs.withColumn(name, run.asNondeterministic()("text"))  # computed once, however often it is used


def train_and_predict(docs: DataFrame, name: str = "language") -> DataFrame:
    return predict(docs, fit(docs.where(~held_out(F.col("doc_id")))), name)


def typical_scores(docs: DataFrame, model: tuple[list[str], np.ndarray]) -> dict[str, float]:
    """docs (text, lang) -> for each language of the model the median cosine of all its own texts with MIN_LETTERS letters
    or more, of two middle ones the lower. A language without such texts is left out."""
    rows = docs.where("text IS NOT NULL AND lang IS NOT NULL").where(letters(F.col("text")) >= MIN_LETTERS).select("text", "lang")
    own = predict(rows, model, "_fl_own").where("lang = _fl_own.lang_pred").select("lang", F.col("_fl_own.score").alias("score"))
    return _medians(written(own, "language-scores"))


def _medians(rows: DataFrame) -> dict[str, float]:
    """rows (lang, score) -> the exact median of each language, of two middle ones the lower.

    The values between the smallest and the largest are counted in _RANGES equal ranges; the one with the median is counted
    the same way, from its own smallest to its own largest value, until these are one. The driver gets the counts.
    """
    def counted(of: DataFrame, *keys: str) -> list:
        return of.groupBy(*keys).agg(F.count("*").alias("n"), F.min("score").alias("low"), F.max("score").alias("high")).orderBy(*keys).collect()

    # by language the place of the median among the values from low to high
    at = {r["lang"]: ((r["n"] - 1) // 2, r["low"], r["high"]) for r in counted(rows, "lang")}
    while left := [(lang, low, high) for lang, (_, low, high) in at.items() if low < high]:
        bounds = F.broadcast(rows.sparkSession.createDataFrame(left, "lang string, low double, high double"))
        part = F.least(F.floor((F.col("score") - F.col("low")) / (F.col("high") - F.col("low")) * _RANGES), F.lit(_RANGES - 1))
        inside = rows.join(bounds, "lang").where("score BETWEEN low AND high").select("lang", "score", part.alias("part"))
        then, before = {}, {lang: 0 for lang, _, _ in left}
        for r in counted(inside, "lang", "part"):  # by rising values
            place = at[r["lang"]][0] - before[r["lang"]]
            before[r["lang"]] += r["n"]
            if 0 <= place < r["n"]:
                then[r["lang"]] = (place, r["low"], r["high"])
        at |= then
    return {lang: low for lang, (_, low, _) in at.items()}


def letters(text: Column) -> Column:
    return F.length(F.regexp_replace(text, r"[^\p{L}]+", ""))


def accepted(docs: DataFrame, share: float = MIN_SHARE) -> DataFrame:
    """The rows of docs (doc_id, text, lang, others) that are in a language that the labelled rows among them teach.

    A row is refused if its text is null or has no letter, or if it has MIN_LETTERS letters or more and its cosine is below
    `share` of the median cosine of that language's own texts: another script, random letters or the same few words over and over.
    Prototypes and medians are those of every labelled row that is not held out. Shorter texts have too few trigrams to tell,
    and stay. Without any labelled row nothing can be refused but texts without letters. Repeated rows are judged alike; an empty table stays empty.
    """
    train = docs.where(~held_out(F.col("doc_id")))
    model = fit(train, None)
    if not model[0]:
        return docs.where(letters(F.col("text")) > 0)
    cuts = [F.lit(x) for lang, v in typical_scores(train, model).items() for x in (lang, share * v)]
    out = predict(docs, model, "_fl_language")
    cut_ = F.coalesce(F.create_map(*cuts)[F.col("_fl_language.lang_pred")], F.lit(0.0)) if cuts else F.lit(0.0)
    stays = (F.col("_fl_language.score") >= cut_) | (letters(F.col("text")) < MIN_LETTERS)  # letters are counted for the few below
    return out.where((F.col("_fl_language.lang_pred") != "und") & stays).drop("_fl_language")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from the labelled rows that are not held out."""
    docs = table(spark, sf_dir, "documents")
    out = predict(docs.select("doc_id", "text"), fit(docs.where(~held_out(F.col("doc_id")))))
    return out.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "language.*")
