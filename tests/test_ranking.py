"""Distributed row numbers, ranks and first rows against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from shopstar.operators import ranking as R

ROWS = [(random.Random(i).choice(["a", "b", None]), random.Random(i * 7).choice([None, 1, 2, 2, 2, 2, 9]), i) for i in range(400)]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(ROWS, "g string, x int, i int").repartition(5)


def _key(v, down=False):
    return (v is None, -(v or 0)) if down else (v is not None, v or 0)


def test_row_numbers_of_groups(rows):
    got = R.number_rows(rows, ["x", "i"], ["g"], out="n", total="t").collect()
    assert len(got) == len(ROWS)
    for g in ("a", "b", None):
        want = sorted((r for r in ROWS if r[0] == g), key=lambda r: (_key(r[1]), r[2]))
        assert [(r.g, r.x, r.i) for r in sorted((r for r in got if r.g == g), key=lambda r: r.n)] == want
        assert sorted(r.n for r in got if r.g == g) == list(range(len(want)))
        assert {r.t for r in got if r.g == g} == {len(want)}


@pytest.mark.parametrize("down", [True, False])
def test_rank_with_ties_across_partitions(spark, rows, down):
    got = {r.i: r.rank for r in R.rank_rows(rows, [("x", down)], ["g"]).collect()}
    for g, x, i in ROWS:
        assert got[i] == 1 + sum(1 for r in ROWS if r[0] == g and _key(r[1], down) < _key(x, down))
    one = spark.range(1000).select(F.lit(3).alias("x"))  # one tie over all partitions
    assert R.rank_rows(one, [("x", True)]).where("rank <> 1").count() == 0


def test_hot_sort_key_is_spread(spark):
    rows = spark.range(0, 4000, 1, 8).select(F.lit(1).alias("x"), "id")
    n = R.number_rows(rows, ["x"], out="n")
    assert sorted(r.n for r in n.collect()) == list(range(4000))
    sizes = [r["count"] for r in rows.withColumn("s", F.monotonically_increasing_id()).repartitionByRange(8, "x", "s")
             .groupBy(F.spark_partition_id()).count().collect()]
    assert max(sizes) < 2000


def test_first_rows_by_tournament(rows):
    for size in (5, 10_000):
        got = R.first_rows(rows, ["g"], [F.desc("x"), "i"], 4, group_rows=size).collect()
        for g in ("a", "b", None):
            want = sorted((r for r in ROWS if r[0] == g), key=lambda r: (_key(r[1], True), r[2]))[:4]
            assert [(r.g, r.x, r.i) for r in sorted((r for r in got if r.g == g), key=lambda r: r.rank)] == want


def test_empty_and_clashing_names(spark):
    df = spark.createDataFrame([(1, 2, 3)], "__salt int, __part int, __number int")
    assert R.rank_rows(df, [("__part", True)], ["__salt"]).collect()[0].asDict() == {"__salt": 1, "__part": 2, "__number": 3, "rank": 1}
    assert R.rank_rows(df.limit(0), [("__part", True)]).count() == 0
    assert R.first_rows(df.limit(0), ["__salt"], ["__part"], 3).count() == 0
