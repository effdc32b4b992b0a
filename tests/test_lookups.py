"""Key lookups that skip data, counts from footers, joins ordered by statistics, the landing ledger."""

import glob
import os
import random

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from shopstar.operators import layout as L
from shopstar.operators import marts as M
from shopstar.sources.ledger import Ledger

DAY0 = 2451545  # 2000-01-01


def plan(df):
    return df._jdf.queryExecution().toString()


# ------------------------------------------------------------ S17
def sales(spark, n=20_000):
    r = random.Random(4)
    rows = [(DAY0 + i % 50 if i % 97 else None, r.randrange(1000) or None, 2 * r.randrange(1000), i) for i in range(n)]
    return spark.createDataFrame(rows, "ss_sold_date_sk int, ss_item_sk long, ss_customer_sk long, ss_number long")


def spoil(path, keep):
    """Overwrite the data pages (not the dictionaries, footers and filters) of the row groups that ``keep`` does not name."""
    meta, spoilt = pq.ParquetFile(path).metadata, 0
    chunks = []
    for g in range(meta.num_row_groups):
        columns = {meta.row_group(g).column(c).path_in_schema: meta.row_group(g).column(c) for c in range(meta.num_columns)}
        if not keep(path, columns):
            start = {c.data_page_offset: c.total_compressed_size - (c.data_page_offset - (c.dictionary_page_offset or c.data_page_offset))
                     for c in columns.values()}
            chunks += start.items()
            spoilt += 1
    with open(path, "r+b") as f:
        for at, size in chunks:
            f.seek(at)
            f.write(b"\xff" * size)
    crc = os.path.join(os.path.dirname(path), f".{os.path.basename(path)}.crc")
    if os.path.exists(crc):
        os.remove(crc)
    return spoilt


@pytest.mark.parametrize("key,value", [("ss_customer_sk", 346), ("ss_item_sk", 77)])
def test_lookups_by_either_key_skip_files_by_range(spark, scratch_dir, key, value):
    df = sales(spark)
    L.write_clustered(df, scratch_dir, "ss_sold_date_sk", ["ss_item_sk", "ss_customer_sk"], partitions=4, rows_per_file=500)
    files = glob.glob(f"{scratch_dir}/sold_ym=*/*.parquet")
    spoilt = sum(spoil(p, lambda _, c: c[key].statistics.min <= value <= c[key].statistics.max) for p in files)
    assert spoilt > len(files) / 2  # a file holds a part of the range of either key
    want = df.where(F.col(key) == value)
    got = spark.read.parquet(scratch_dir).where(F.col(key) == value)
    assert sorted(r.ss_number for r in got.collect()) == sorted(r.ss_number for r in want.collect()) != []


def test_lookups_skip_row_groups_by_bloom_filter(spark, scratch_dir):
    df = sales(spark, 4000)
    L.write_clustered(df, scratch_dir, "ss_sold_date_sk", ["ss_item_sk", "ss_customer_sk"], partitions=2, rows_per_file=400, distinct=2000)
    files, value = glob.glob(f"{scratch_dir}/sold_ym=*/*.parquet"), 346
    holding = {os.path.basename(r.f) for r in spark.read.parquet(scratch_dir).where(F.col("ss_customer_sk") == value).select(F.input_file_name().alias("f")).collect()}
    in_range = []

    def keep(path, c):
        if c["ss_customer_sk"].statistics.min <= value <= c["ss_customer_sk"].statistics.max:
            in_range.append(path)
        return os.path.basename(path) in holding
    for p in files:
        spoil(p, keep)
    assert len(in_range) > len(holding) > 0  # the range alone would read spoilt files
    got = spark.read.parquet(scratch_dir).where(F.col("ss_customer_sk") == value)
    want = df.where(F.col("ss_customer_sk") == value)
    assert sorted(r.ss_number for r in got.collect()) == sorted(r.ss_number for r in want.collect())


def test_z_value_interleaves_parts_of_equal_rows(spark):
    df = spark.createDataFrame([(i, i * i) for i in range(256)] + [(None, None)], "a long, b long")
    got = {r.a: r.z for r in L.z_value(df, ["a", "b"], bits=2).collect()}
    part = lambda i: min(3, sum(i >= c for c in (64, 128, 192)))
    near = [i for i in range(256) if all(abs(i - c) > 2 for c in (64, 128, 192))]
    for i in near:
        high, low = divmod(part(i), 2)
        assert got[i] == high * 12 + low * 3  # the bits of both parts: aabb
    assert got[None] == 0
    assert L.z_value(df.where("a is null"), ["a", "b"]).first().z == 0
    with pytest.raises(ValueError):
        L.z_value(df, ["a", "b"], bits=40)


# ------------------------------------------------------------ S06, S19
def test_footer_counts_read_no_column(spark, scratch_dir):
    df = sales(spark, 3000)
    L.write_fact(df, f"{scratch_dir}/f", "ss_sold_date_sk")
    whole, months = (L.footer_counts(spark, f"{scratch_dir}/f", "ss_sold_date_sk", by) for by in (False, True))
    for out in (whole, months):
        text = plan(out).split("== Physical Plan ==")[1]
        assert "PushedAggregation: [COUNT(*)" in text and "PushedAggregation: [MIN(ss_sold_date_sk), MAX(ss_sold_date_sk)" in text
        assert "ss_item_sk" not in text
    assert tuple(whole.first()) == (3000, DAY0, DAY0 + 49)
    want = {(r.sold_ym, r.n, r.a, r.b) for r in df.groupBy(L.sold_ym("ss_sold_date_sk").alias("sold_ym")).agg(
        F.count(F.lit(1)).alias("n"), F.min("ss_sold_date_sk").alias("a"), F.max("ss_sold_date_sk").alias("b")).collect()}
    assert {tuple(r) for r in months.select("sold_ym", "rows", "min_key", "max_key").collect()} == want
    L.write_fact(df.limit(0), f"{scratch_dir}/none", "ss_sold_date_sk")
    spark.createDataFrame([], "k long").write.parquet(f"{scratch_dir}/empty")
    assert tuple(L.footer_counts(spark, f"{scratch_dir}/empty", "k").first()) == (0, None, None)
    for key in ("spark.sql.sources.useV1SourceList", "spark.sql.parquet.aggregatePushdown"):
        assert spark.conf.get(key) != "" or key.endswith("List") and "parquet" in spark.conf.get(key)


# ------------------------------------------------------------ S18
def test_joins_follow_the_statistics(spark, scratch_dir):
    db = "stats_" + os.path.basename(scratch_dir).replace("-", "_").lower()
    fact = spark.range(4000).select(F.lit(DAY0).alias("ss_sold_date_sk"), (F.col("id") % 1000).alias("ss_item_sk"), (F.col("id") % 500).alias("ss_store_sk"))
    L.write_fact(fact, f"{scratch_dir}/fact_store_sales", "ss_sold_date_sk")
    # items match every sale; two of 500 stores do
    spark.range(1000).select(F.col("id").alias("item_sk"), F.lit("x" * 50).alias("category")).write.parquet(f"{scratch_dir}/dim_item")
    spark.range(2).select(F.col("id").alias("store_sk"), F.lit("s").alias("state")).write.parquet(f"{scratch_dir}/dim_store")
    stats = {r.table_name: r.statistics for r in M.analyze_marts(spark, scratch_dir, db).collect()}
    assert stats.keys() == {"fact_store_sales", "dim_item", "dim_store"} and "4000 rows" in stats["fact_store_sales"]
    col = {r.info_name: r.info_value for r in spark.sql(f"DESCRIBE EXTENDED {db}.fact_store_sales ss_store_sk").collect()}
    assert 475 <= int(col["distinct_count"]) <= 525 and col["histogram"] != "NULL"

    def report(m):
        f, i, s = m.fact_store_sales, m.dim_item, m.dim_store
        return (f.join(i, f.ss_item_sk == i.item_sk).join(s, f.ss_store_sk == s.store_sk)
                .groupBy("state").agg(F.count(F.lit(1)).alias("n"), F.count("category").alias("c")))

    by_stats, as_written = report(M.CatalogMarts(spark, db)), report(M.WrittenMarts(spark, scratch_dir))
    # the table scanned lowest in the logical plan joins the fact first
    first = lambda df: min(("store_sk#", "item_sk#"), key=lambda c: -_depth(df, c))
    assert first(as_written) == "item_sk#" and first(by_stats) == "store_sk#"
    assert by_stats.collect() == as_written.collect() and by_stats.first().n == 16
    assert spark.conf.get("spark.sql.cbo.enabled") == "false"
    with pytest.raises(AttributeError):
        M.CatalogMarts(spark, db).dim_customer
    spark.sql(f"DROP DATABASE {db} CASCADE")


def _depth(df, name):
    """How deep the join condition on a column stands in the optimised plan."""
    for line in df._jdf.queryExecution().optimizedPlan().toString().splitlines():
        if "Join Inner" in line and f" {name}" in line.replace("(", " ").replace("=", " "):
            return len(line) - len(line.lstrip(" :+-|"))
    raise AssertionError(name)


# ------------------------------------------------------------ S11
def put(folder, name, *rows):
    os.makedirs(f"{folder}/reason.dat", exist_ok=True)
    with open(f"{folder}/reason.dat/{name}", "w") as f:
        f.writelines(r + "\n" for r in rows)


def test_ledger_lands_every_content_once(spark, scratch_dir, monkeypatch):
    src, led = f"{scratch_dir}/src", Ledger(spark, f"{scratch_dir}/raw", "reason")
    assert led.load(src).count() == 0 and led.read().count() == 0  # no source yet
    put(src, "a.txt", "1|R1|one", "2|R2|two")
    put(src, "b.txt", "3|R3|three", "x|R4|bad")
    state = lambda out: {(r.file, r.state, r.lines) for r in out.collect()}
    keys = lambda: sorted(r.r_reason_sk for r in led.read().collect())
    assert state(led.load(src, "one")) == {("a.txt", "new", 2), ("b.txt", "new", 2)} and keys() == [1, 2, 3]
    assert state(led.load(src, "again")) == {("a.txt", "known", 2), ("b.txt", "known", 2)} and keys() == [1, 2, 3]
    put(src, "copy.txt", "2|R2|two", "1|R1|one")  # the rows of a.txt
    put(src, "c.txt", "5|R5|five")
    put(src, "c2.txt", "5|R5|five")
    put(src, "b.txt", "3|R3|three", "4|R4|mended")
    put(src, "empty.txt")
    assert state(led.load(src, "three")) == {("a.txt", "known", 2), ("copy.txt", "known", 2), ("c.txt", "new", 1), ("c2.txt", "known", 1),
                                             ("b.txt", "changed", 2)}
    assert keys() == [1, 2, 3, 5]
    with pytest.raises(ValueError):
        led.load(src, "one")
    with pytest.raises(ValueError):
        led.load(src, "a/b")
    with monkeypatch.context() as m:  # dies between its rows and its entries
        m.setattr(type(led), "_record", lambda *a: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            led.load(src, "dies", replace=True)
    assert keys() == [1, 2, 3, 5]
    assert ("b.txt", "new", 2) in state(led.load(src, "dies", replace=True))
    assert keys() == [1, 2, 3, 4, 5]
    assert led.held().count() == 3 and led.entries().count() == 14
