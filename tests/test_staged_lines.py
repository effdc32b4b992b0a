"""Facts written from lines that are joined once; compiled Z-order values; the calendar joined last. All on rows made here."""

import os

import pytest
from pyspark.sql import functions as F

from shopstar.operators import layout as L
from shopstar.operators import marts as M
from shopstar.plans import examples as D
from shopstar.plans import layoutops as Y
from shopstar.plans import tableops as X
from shopstar.sources.tables import DRIVER_SCHEMAS
from shopstar.sources.testmarts import DerivedMarts

ROWS = {"orders": 40, "lineitem": 240, "part": 10, "supplier": 5, "customer": 12, "nation": 3, "region": 2, "events": 1}


@pytest.fixture()
def marts(spark, scratch_dir):
    """Small tables whose keys meet; one line in nine has no order, one key is negative, one order comes twice."""
    key = {"l_orderkey": F.when(F.col("id") % 9 == 0, F.lit(None)).otherwise(F.col("id") % 41 - 1), "o_orderkey": F.when(F.col("id") == 39, 3).otherwise(F.col("id") - 1),
           "l_partkey": F.col("id") % 10, "l_suppkey": F.col("id") % 5, "o_custkey": F.col("id") % 12, "o_orderpriority": F.concat(F.col("id") % 5 + 1, F.lit("-P")),
           "l_discount": F.col("id") % 10 / 100, "l_tax": F.col("id") % 7 / 100, "l_returnflag": F.when(F.col("id") % 4 == 0, "R").otherwise("N"), "l_linenumber": F.col("id") % 7 + 1,
           "o_orderdate": F.timestamp_add("DAY", F.col("id").cast("int") * 25, F.lit("1994-10-01").cast("timestamp_ntz"))}
    default = {"bigint": F.col("id"), "int": F.col("id") % 3, "double": F.col("id") * 1.5 + 1, "string": F.concat(F.lit("s"), F.col("id")),
               "timestamp_ntz": F.lit("1996-04-04").cast("timestamp_ntz")}
    for name, n in ROWS.items():
        cols = [c.split() for c in DRIVER_SCHEMAS[name].split(", ")]
        spark.range(n).select(*[key.get(c, default[t]).cast(t).alias(c) for c, t in cols]).write.parquet(f"{scratch_dir}/{name}.parquet")
    return DerivedMarts(spark, scratch_dir)


def test_staged_facts_read_their_channel_only(marts, scratch_dir):
    staged = marts.stage_lines(f"{scratch_dir}/lines")
    for t in M.FACT_TABLES:
        own, plan = getattr(staged, t), getattr(staged, t)._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters: [isnotnull(line_channel" in plan and "Join" not in plan
        assert own.schema == getattr(marts, t).schema
        assert own.exceptAll(getattr(marts, t)).count() == 0 and own.count() == getattr(marts, t).count() > 0


def test_no_line_at_all_can_be_staged(spark, marts, scratch_dir):
    marts.t._cache["lineitem"] = marts.t.lineitem.where("false")
    assert marts.stage_lines(f"{scratch_dir}/lines").fact_web_sales.count() == 0


@pytest.mark.parametrize("run", [Y.quarter_revenue, Y.best_keys, Y.footer_partitions, Y.star_join_by_statistics, Y.footer_row_counts,
                                 X.reloaded_months, X.table_statistics, X.damaged_months, X.undated_partition, X.verification])
def test_lines_are_joined_once_and_their_copy_goes(spark, marts, monkeypatch, run):
    staged = []

    def stage(self, path, real=DerivedMarts.stage_lines):
        staged.append(path)
        return real(self, path)
    monkeypatch.setattr(DerivedMarts, "stage_lines", stage)
    once = sorted(map(str, run(marts).collect()))
    assert len(staged) == 1 and not os.path.exists(staged[0].removeprefix("file:"))
    monkeypatch.delattr(DerivedMarts, "stage_lines")  # marts of other kinds have their facts written as they are
    assert once == sorted(map(str, run(marts).collect()))


def test_z_values_are_compiled(spark):
    rows = spark.range(1000).select(F.when(F.col("id") % 10 != 0, F.col("id") % 64).alias("a"), (F.col("id") * 7 % 1000).alias("b"), F.lit(None).cast("bigint").alias("none"))
    z = L.z_value(rows, ["a", "b", "none"], bits=3)
    assert "lambda" not in z._jdf.queryExecution().executedPlan().toString()
    at = [i / 8 for i in range(1, 8)]
    cuts = rows.agg(*[F.percentile_approx(k, at).alias(k) for k in ("a", "b")]).first()
    assert z.columns == ["a", "b", "none", "z"]
    for r in z.collect():
        part = [0 if r[k] is None else sum(r[k] >= c for c in cuts[k]) for k in ("a", "b")] + [0]
        assert r.z == sum(((part[i] >> b) & 1) << (b * 3 + 2 - i) for i in range(3) for b in range(3))

def test_calendar_columns_are_not_shuffled(marts):
    spark, keys = marts.spark, ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    old = {k: spark.conf.get(k) for k in keys}
    for k in keys:
        spark.conf.set(k, "-1")
    try:
        plan = D.star_join(marts, ("customer_id", "state"), ("promo_name",))._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    joins = [x for x in plan.splitlines() if "Join" in x]
    assert "date_sk" in joins[0] and "BroadcastHashJoin" in joins[0] and len(joins) > 4
