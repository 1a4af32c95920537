"""Queries that once did a part of their job, against counts made another way."""

from math import comb, sqrt

import pytest
from conftest import SF
from pyspark.sql import functions as F

from factloom.eval import metrics as M
from factloom.plans import entities, evaluation


def table_of(spark, folder, name, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
    return str(folder)


def exact_p(gained, lost):
    n = gained + lost
    return min(1.0, 2 * sum(comb(n, k) for k in range(min(gained, lost) + 1)) / 2**n) if n else 1.0


@pytest.mark.parametrize("gained, lost, same", [(9, 2, 10), (1500, 1400, 100)])  # the second is past what pow(0.5, n) can hold
def test_mcnemar_reads_every_label(spark, tmp_path, gained, lost, same):
    marks = [(0, 0)] * gained + [(1, 1)] * lost + [(1, 0)] * same
    d = table_of(spark, tmp_path, "labels", [(k, q, t) for k, (q, t) in enumerate(marks)], "doc_id long, quality int, toxic int")
    r = evaluation.mcnemar_flips(spark, d).first()
    assert (r["items"], r["gained"], r["lost"]) == (len(marks), gained, lost) and r["p_value"] == pytest.approx(exact_p(gained, lost),
        abs=1e-6)


def test_mcnemar_against_the_whole_table(spark, duck):
    items, gained, lost = duck.sql("SELECT count(*), count_if(quality = 0 AND toxic = 0), count_if(quality = 1 AND toxic = 1) FROM labels").fetchall()[0]
    r = evaluation.mcnemar_flips(spark, SF).first()
    assert (r["items"], r["gained"], r["lost"]) == (items, gained, lost) and r["p_value"] == pytest.approx(exact_p(gained, lost), abs=1e-6)


PART = "p_partkey long, p_brand string, p_name string, p_size int"


def test_blocks_of_21_to_100_rows_are_paired_whole(spark, tmp_path):
    rows = [(k, "Brand#1", f"bolt x{k}", k) for k in range(1, 31)]  # five countries, none with more than six
    d = table_of(spark, tmp_path, "part", rows, PART)
    keys = sorted(f"Part:{k}" for k in range(1, 31))
    assert sorted(map(tuple, entities.blocked_pairs_names(spark, d).collect())) == [(a, b) for a in keys for b in keys if a < b]


def test_blocks_above_100_rows_are_split_by_country(spark, tmp_path):
    rows = [(10 * k + 1, "Brand#1", f"bolt x{k}", k) for k in range(125)]  # five countries of 25; such ids have no host and no number
    d = table_of(spark, tmp_path, "part", rows, PART)
    assert entities.blocked_pairs_names(spark, d).count() == 5 * 25 * 24 // 2


def test_links_of_country_parts_of_21_to_100_rows(spark, tmp_path):
    rows = [(k, "Brand#1", f"bolt galvanised steel {k:03d}x", 5) for k in range(1, 31)]
    d = table_of(spark, tmp_path, "part", rows, PART)
    assert entities.name_similarity_links(spark, d).where("kind = 'similar'").count() > 0


@pytest.mark.parametrize("gained, lost, verdict",
    [(60, 10, "better"), (10, 60, "worse"), (30, 28, "inconclusive"), (4, 0, "inconclusive"),
    (0, 0, "inconclusive")])  # four one-way flips: p is 0.125
def test_paired_bootstrap_of_passes(spark, gained, lost, verdict):
    runs = [(0, 1)] * gained + [(1, 0)] * lost + [(1, 1)] * (200 - gained - lost)
    items = spark.createDataFrame([(k, *r) for k, r in enumerate(runs)], "i long, a int, b int")
    r = M.paired_bootstrap(spark, items).first()
    assert (r["items"], r["flips"], r["draws"], r["verdict"]) == (200, gained + lost, 2000, verdict)
    assert r["difference"] == pytest.approx((gained - lost) / 200) and r["p_value"] == pytest.approx(exact_p(gained, lost), abs=1e-9)
    spread = sqrt((gained + lost) / 200 - ((gained - lost) / 200) ** 2) / sqrt(200)
    assert r["high"] - r["low"] == pytest.approx(2 * 1.96 * spread, rel=0.15, abs=1e-9)
    assert r["detection_limit"] == (pytest.approx(2.801585 * sqrt((gained + lost) / 200 / 200), rel=1e-6) if gained + lost else None)


def test_paired_bootstrap_of_counts(spark):
    items = spark.createDataFrame([(k, (3, 1), (3, 1 if k % 2 else 0)) for k in range(100)],
        "i long, a struct<tp:int,fp:int>, b struct<tp:int,fp:int>")

    def precision(run):
        tp, fp = (F.sum(F.col(f"{run}.{c}") * F.col("w")) for c in ("tp", "fp"))
        return F.try_divide(tp.cast("double"), tp + fp)

    r = M.paired_bootstrap(spark, items, precision).first()
    assert (r["a"], r["b"], r["flips"], r["verdict"], r["p_value"]) == (0.75, pytest.approx(300 / 350), 50, "better", None)
    assert r["low"] < r["difference"] < r["high"] and r["detection_limit"] > 0


def test_bootstrap_f1_has_the_reference_number_of_draws(spark):
    assert evaluation.bootstrap_f1(spark, SF).first()["draws"] == 2000
