"""Delimited ingest (S01-S07, S14), staging rules (T01-T24) and mart builders (M01-M08) on hand-made files."""
import datetime as dt
import os
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from shopstar.operators import marts as M
from shopstar.operators.staging import STAGING_RULES, stage
from shopstar.sources import delimited as D
from shopstar.sources.schemas import LOAD_ORDER, RAW_DDL, char_columns, raw_schema


def write(dirname, table, lines):
    with open(os.path.join(dirname, f"{table}.dat"), "w") as fh:
        fh.write("\n".join(lines) + "\n")


def test_registry_has_24_tables_425_columns():
    assert len(RAW_DDL) == 24 and len(LOAD_ORDER) == 24
    assert sum(len(raw_schema(t).fields) for t in RAW_DDL) == 425
    assert set(STAGING_RULES) == set(RAW_DDL)


def test_row_classification(spark, scratch_dir):
    # reason: r_reason_sk int, r_reason_id char(16), r_reason_desc char(100)
    write(scratch_dir, "reason", [
        "1|AAAA   |Did not like   ",          # exact, CHAR padding
        "2|BBBB",                              # short row: padded with NULL
        "3|CCCC|x \"quoted\" text|",           # one surplus empty token (stripped delimiter)
        "4|DDDD|desc|extra",                   # surplus token -> reject
        "x5|EEEE|bad int",                     # type error -> reject
        "6|" + "F" * 17 + "|too long id",      # CHAR(16) overflow -> reject
        "|GGGG|null key",                      # NULL key: accepted in raw, dropped by staging
        "8||   ",                              # empty field = NULL; blanks only kept as data
    ])
    df = D.read_raw(spark, scratch_dir, "reason")
    rows = {r.r_reason_sk: r for r in D.accepted(df).collect()}
    assert set(rows) == {1, 2, 3, None, 8}
    assert rows[1].r_reason_id == "AAAA" and rows[1].r_reason_desc == "Did not like"   # rtrim of CHAR
    assert rows[2].r_reason_desc is None
    assert rows[3].r_reason_desc == 'x "quoted" text'                                # quotes are data
    assert rows[8].r_reason_id is None and rows[8].r_reason_desc == ""               # CHAR blanks -> ''
    rej = {r._reject_reason for r in D.rejected(df).collect()}
    assert rej == {"surplus columns", "type or range", "string too long"}


def test_decimal_overflow_rejected(spark, scratch_dir):
    cols = len(raw_schema("store_sales").fields)
    ok = ["1"] * 11 + ["12.50"] * (cols - 11)                     # 9 keys, ticket, quantity, money
    bad = ["2"] * 11 + ["100000.00"] + ["1.00"] * (cols - 12)   # NUMERIC(7,2) max 99999.99
    write(scratch_dir, "store_sales", ["|".join(ok), "|".join(bad)])
    df = D.read_raw(spark, scratch_dir, "store_sales")
    assert D.accepted(df).count() == 1
    assert D.rejected(df).first()._reject_reason == "type or range"


def test_missing_file_is_skipped(spark, scratch_dir):
    assert D.read_raw(spark, scratch_dir, "call_center") is None


def test_land_and_report(spark, scratch_dir):
    src = os.path.join(scratch_dir, "src")
    os.makedirs(src)
    write(src, "income_band", ["1|0|10000", "2|10001|20000", "20|190001|200000", "3|1|2|3|4"])
    write(src, "ship_mode", ["1|AAAAAAAAAAAAAAAA|EXPRESS|AIR|UPS|contract"])
    out = os.path.join(scratch_dir, "raw")
    done = D.load_all(spark, src, out, tables=["income_band", "ship_mode", "warehouse"])
    assert done["warehouse"] is None
    rep = D.load_report(spark, out, tables=["income_band", "ship_mode"]).collect()
    assert [(r.table, r.rows) for r in rep] == [("income_band", 3), ("ship_mode", 1)]
    landed = D.read_landed(spark, out, "income_band")
    assert landed.columns == [f.name for f in raw_schema("income_band").fields]


def test_staging_trim_blank_to_null_and_keys(spark):
    cust = spark.createDataFrame(
        [(1, " C1 ", "  ", " x@y ", "Mr."), (None, "C2", "US", None, None)],
        "c_customer_sk int, c_customer_id string, c_birth_country string, c_email_address string, c_salutation string")
    out = stage("customer", cust).collect()
    assert len(out) == 1
    r = out[0]
    assert (r.c_customer_id, r.c_birth_country, r.c_email_address, r.c_salutation) == ("C1", None, "x@y", "Mr.")
    reason = spark.createDataFrame([(1, "R1", "  Price  ")], "r_reason_sk int, r_reason_id string, r_reason_desc string")
    rr = stage("reason", reason).first()
    assert rr.r_reason_desc == "  Price  " and rr.r_reason_desc_clean == "Price"
    inv = spark.createDataFrame([(1, 2, None, 5), (None, 2, 1, 5), (1, None, 1, 5)],
                                "inv_date_sk int, inv_item_sk int, inv_warehouse_sk int, inv_quantity_on_hand int")
    assert stage("inventory", inv).count() == 1          # warehouse may be NULL


def _empty_raw(spark, table):
    return spark.createDataFrame([], raw_schema(table))


def test_dim_date_flags_and_golden_row(spark):
    sch = raw_schema("date_dim")
    row = {f.name: None for f in sch.fields}
    row.update(d_date_sk=2451911, d_date=dt.date(2001, 1, 1), d_year=2001, d_qoy=1, d_moy=1, d_dom=1, d_dow=1,
               d_day_name="Monday", d_holiday="N", d_weekend="N", d_current_year=None)
    df = spark.createDataFrame([tuple(row[f.name] for f in sch.fields)], sch)
    r = M.build_dim_date(df).first()
    assert (r.date_sk, r.full_date, r.year, r.quarter, r.month, r.day_of_week, r.day_name) == \
        (2451911, dt.date(2001, 1, 1), 2001, 1, 1, 1, "Monday")
    assert (r.is_holiday, r.is_weekend, r.is_current_year) == (False, False, False)


def test_dim_customer_left_joins_preserve_rows(spark):
    c = spark.createDataFrame([(1, "C1", 10, 100), (2, "C2", None, 999)],
                              "c_customer_sk int, c_customer_id string, c_current_cdemo_sk int, c_current_addr_sk int")
    for col in ["c_first_name", "c_last_name", "c_salutation", "c_email_address", "c_preferred_cust_flag",
                "c_birth_country"]:
        c = c.withColumn(col, F.lit(None).cast("string"))
    c = c.withColumn("c_birth_year", F.lit(None).cast("int"))
    cd = spark.createDataFrame([(10, "F", "M", "College", 500, "Good", 2)],
                               "cd_demo_sk int, cd_gender string, cd_marital_status string, cd_education_status string, "
                               "cd_purchase_estimate int, cd_credit_rating string, cd_dep_count int")
    ca = spark.createDataFrame([(100, "Paris", "TX", "75001", "US", Decimal("-6.00"))],
                               "ca_address_sk int, ca_city string, ca_state string, ca_zip string, ca_country string, "
                               "ca_gmt_offset decimal(5,2)")
    d = M.build_dim_customer(c, cd, ca)
    assert d.count() == 2 and len(d.columns) == 22
    rows = {r.customer_sk: r for r in d.collect()}
    assert rows[1].gender == "F" and rows[1].state == "TX" and rows[2].gender is None and rows[2].state is None


def test_fact_builders_column_counts(spark):
    assert len(M.build_fact(_empty_raw(spark, "store_sales"), "store_sales").columns) == 20
    assert len(M.build_fact(_empty_raw(spark, "web_sales"), "web_sales").columns) == 25
    assert len(M.build_fact(_empty_raw(spark, "catalog_sales"), "catalog_sales").columns) == 25
    assert len(M.build_dim_item(_empty_raw(spark, "item")).columns) == 19
    assert len(M.build_dim_store(_empty_raw(spark, "store")).columns) == 17
    assert len(M.build_dim_promotion(_empty_raw(spark, "promotion")).columns) == 15


def test_key_checks(spark):
    ok = spark.createDataFrame([(1,), (2,)], "k int")
    bad = spark.createDataFrame([(1,), (1,), (None,)], "k int")
    M.assert_primary_key(ok, "k")
    with pytest.raises(M.ConstraintError):
        M.assert_primary_key(bad, "k")
    with pytest.raises(M.ConstraintError):
        M.assert_not_null(bad, ["k"], "t")


def test_char_columns_known():
    assert "c_customer_id" in char_columns("customer") and "c_birth_country" not in char_columns("customer")


def test_dim_customer_duplicate_lookup_key_is_caught(spark):
    c = spark.createDataFrame([(1, 10, 100)], "c_customer_sk int, c_current_cdemo_sk int, c_current_addr_sk int")
    for col in ["c_customer_id", "c_first_name", "c_last_name", "c_salutation", "c_email_address",
                "c_preferred_cust_flag", "c_birth_country"]:
        c = c.withColumn(col, F.lit(None).cast("string"))
    c = c.withColumn("c_birth_year", F.lit(None).cast("int"))
    cd = spark.createDataFrame([(10, "F"), (10, "M")], "cd_demo_sk int, cd_gender string")
    for col in ["cd_marital_status", "cd_education_status", "cd_credit_rating"]:
        cd = cd.withColumn(col, F.lit(None).cast("string"))
    for col in ["cd_purchase_estimate", "cd_dep_count"]:
        cd = cd.withColumn(col, F.lit(None).cast("int"))
    ca = spark.createDataFrame([(100,)], "ca_address_sk int")
    for col in ["ca_city", "ca_state", "ca_zip", "ca_country"]:
        ca = ca.withColumn(col, F.lit(None).cast("string"))
    ca = ca.withColumn("ca_gmt_offset", F.lit(None).cast("decimal(5,2)"))
    with pytest.raises(M.ConstraintError):
        M.assert_primary_key(cd, "cd_demo_sk", "customer_demographics")
    assert M.build_dim_customer(c, cd, ca).count() == 2  # what the check prevents
