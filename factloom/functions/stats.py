"""Metrics and intervals as column expressions. Undefined is null, not zero."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F

Z95 = NormalDist().inv_cdf(0.975)


def ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a.cast("double"), b.cast("double"))


def precision_recall_f1(tp: Column, fp: Column, fn: Column) -> tuple[Column, Column, Column]:
    """F1 is null only if both are; zero if either is null or zero."""
    p, r = ratio(tp, tp + fp), ratio(tp, tp + fn)
    f1 = F.when(p.isNull() & r.isNull(), None).when((F.coalesce(p, F.lit(0.0)) == 0) | (F.coalesce(r, F.lit(0.0)) == 0),
        0.0).otherwise(2 * p * r / (p + r))
    return p, r, f1


def wilson(successes: Column, n: Column, z: float = Z95) -> tuple[Column, Column]:
    """Score interval of a share, null without trials; exactly 0 and 1 at the ends."""
    m = n.cast("double")
    share = ratio(successes, n)
    centre, scale = share + z * z / (2 * m), 1 + z * z / m
    half = z * F.sqrt(share * (1 - share) / m + z * z / (4 * m * m))
    low = F.when(successes == 0, 0.0).otherwise(F.greatest(F.lit(0.0), (centre - half) / scale))
    high = F.when(successes == n, 1.0).otherwise(F.least(F.lit(1.0), (centre + half) / scale))
    return F.when(n > 0, low), F.when(n > 0, high)


def confidence_bin(c: Column, bins: int = 10) -> Column:
    return F.least(F.floor(c * bins + 1e-9), F.lit(bins - 1)).cast("int")


def mcnemar(gained: Column, lost: Column) -> Column:
    """Exact two-sided p: the tail of a fair coin over the flips, in logarithms."""
    flips, few = gained + lost, F.least(gained, lost)
    # ln C(n, k) as a running sum; the tail adds its exponentials
    start = F.struct(F.lit(0.0).alias("log"), F.lit(0.0).alias("tail"))
    ln_half = F.lit(-0.6931471805599453)
    tail = F.aggregate(F.sequence(F.lit(0).cast("long"), few.cast("long")), start, lambda s, k: F.struct(
        (s["log"] + F.ln((flips - k) / (k + 1))).alias("log"), (s["tail"] + F.exp(s["log"] + flips * ln_half)).alias("tail")),
        lambda s: s["tail"])
    return F.when(flips > 0, F.least(F.lit(1.0), 2 * tail)).otherwise(1.0)


def prediction_powered(judged: Column, judge_true: Column, n: Column, label_true: Column, judge_true_labelled: Column, disagree: Column,
    z: float = Z95):
    """Judge's share corrected by labels, with its interval clipped to 0..1: (value, low, high)."""
    value = ratio(judge_true, judged) + ratio(label_true - judge_true_labelled, n)
    share = (label_true + 2) / (n + 4.0)
    spread = share * (1 - share) / judged + (disagree + 2) / (n + 4.0) * (1.0 / n - 1.0 / judged)

    def clip(c: Column) -> Column:
        return F.least(F.lit(1.0), F.greatest(F.lit(0.0), c))

    return clip(value), clip(value - z * F.sqrt(spread)), clip(value + z * F.sqrt(spread))


def detection_limit(d: Column, n: Column, z: float = Z95) -> Column:
    return z * F.sqrt(d.cast("double") / n)
