"""Star-schema marts derived from the driver's TPC-H-like tables.

The warehouse queries are written against TPC-DS-shaped marts.  The test
data is TPC-H-like, so the marts are derived by fixed, documented rules
that the DuckDB oracle states the same way (``plans/oracle.py``).  Every
derived table is a lazy DataFrame over the driver's parquet, so its work
grows with the input; nothing is collected.

Rules (all deterministic):

* sale line = ``lineitem JOIN orders``; channel by ``l_orderkey % 7``:
  0-3 store, 4-5 catalog, 6 web (the 4:2:1 volume split of the source
  warehouse).
* sold date = order date, ship date = line ship date, keys are Julian days.
* money is ``DECIMAL(12,2)``; discount and tax rates ``DECIMAL(4,2)``;
  ``ext_list_price = l_extendedprice``,
  ``ext_discount_amt = round(ext_list_price * discount, 2)``,
  ``ext_sales_price = net_paid = ext_list_price - ext_discount_amt`` (no coupons),
  ``ext_wholesale_cost = round(ext_list_price * 0.95, 2)`` (profit may be negative),
  ``ext_tax = round(net_paid * tax, 2)``, ``ext_ship_cost = round(ext_list_price * 0.02, 2)``;
  web/catalog profit also subtracts shipping, as the data-model docs define.
* customer key NULL where ``l_orderkey % 11 = 0`` (anonymous sales).
* promotion = order priority digit 1-4; ``5-LOW`` means no promotion.
* returns = lines with ``l_returnflag = 'R'``; inventory = monthly
  per part x supplier quantity sums keyed on the month's first day.
"""

from __future__ import annotations

import datetime as dt
import threading
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from shopstar.functions.dates import julian_key
from shopstar.functions.numeric import dec, money
from shopstar.operators.layout import restrict_years
from shopstar.operators.marts import build_fact
from shopstar.operators.staging import stage
from shopstar.sources.rawtables import raw_table
from shopstar.sources.schemas import raw_schema
from shopstar.sources.tables import DriverTables

STORE, CATALOG, WEB = "store", "catalog", "web"
PREFIX = {STORE: "ss", WEB: "ws", CATALOG: "cs"}

# Small code tables of the derived warehouse.
DAY_NAMES = ["Sunday", "Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday"]
WEB_PAGE_TYPES = ["welcome", "protected", "feedback", "general", "order", "ad", "dynamic"]
CATALOG_DEPARTMENTS = ["DEPARTMENT", "HOME", "SPORTS", "TOYS", "GARDEN", "JEWELRY", "BOOKS"]
SHIP_MODE_TYPES = ["EXPRESS", "LIBRARY", "NEXT DAY", "OVERNIGHT", "REGULAR"]
CALL_CENTER_NAMES = ["NY Metro", "Mid Atlantic", "North Midwest", "Pacific Northwest"]
EDUCATION = ["Primary", "Secondary", "College"]

# Folder column of the staged lines.
LINE_CHANNEL = "line_channel"

# A promotion is the number before the dash of an order priority.
PROMO_KEY = "^([0-9]+)"


def _padded(col: str, width: int):
    """A key as text with leading zeros; longer keys stay whole."""
    text = F.col(col).cast("string")
    return F.lpad(text, F.greatest(F.lit(width), F.length(text)), F.lit("0"))


def _code_table(spark: SparkSession, key: str, values: list[str], value_col: str) -> DataFrame:
    rows = [(i + 1, v) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, f"{key} int, {value_col} string")


class DerivedMarts:
    """The warehouse's marts and staging tables as lazy DataFrames."""

    _per_session: dict = {}
    _lock = threading.Lock()

    @classmethod
    def for_session(cls, spark: SparkSession, sf_dir: str) -> "DerivedMarts":
        """One set of marts per session and folder, shared by every report of the session."""
        key = (id(spark), sf_dir)
        with cls._lock:
            hit = cls._per_session.get(key)
            if hit is None or hit.spark is not spark:
                hit = cls._per_session[key] = cls(spark, sf_dir)
            return hit

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir
        self.t = DriverTables(spark, sf_dir)
        self._staged_rows: DataFrame | None = None  # the joined lines, read from a written copy

    # ------------------------------------------------------------------ lines
    def _lines(self) -> DataFrame:
        return self._line_rows

    def stage_lines(self, path: str) -> "DerivedMarts":
        """Write the joined sale lines once and derive every fact from the written copy.

        Building the marts touches the lines seven times (three facts,
        three return tables, staging store sales); staging them turns seven
        ``lineitem JOIN orders`` into one join plus seven pruned scans, and
        cuts the lineage of everything built afterwards.  Only what the join
        brings together is written, in a folder a channel; the measures are
        derived from it at every scan.
        """
        joined = self._joined(self.t.orders)
        joined.withColumn(LINE_CHANNEL, self.channel_of(F.col("l_orderkey") % 7)).write.mode("overwrite") \
            .option("partitionOverwriteMode", "static").partitionBy(LINE_CHANNEL).parquet(path)
        staged = DerivedMarts(self.spark, self.sf_dir)
        staged._staged_rows = self.spark.read.schema(StructType([*joined.schema.fields, StructField(LINE_CHANNEL, StringType())])).parquet(path)
        return staged

    @cached_property
    def _line_rows(self) -> DataFrame:
        return self._line_columns(self._joined(self.t.orders) if self._staged_rows is None else self._staged_rows)

    def _lines_in_years(self, years) -> DataFrame:
        """Sale lines of a year range; the bounds go to the order dates themselves, so they reach the scan."""
        if self._staged_rows is not None:
            return restrict_years(self._line_rows, "sold_date_sk", years)
        day = F.col("o_orderdate")
        first, end = dt.datetime(years[0], 1, 1), dt.datetime(years[1] + 1, 1, 1)
        bound = lambda t: F.lit(t).cast("timestamp_ntz")
        return self._line_columns(self._joined(self.t.orders.filter((day >= bound(first)) & (day < bound(end)))))

    def _joined(self, orders: DataFrame) -> DataFrame:
        """Every line with its order."""
        li = self.t.lineitem.select(
            "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
            "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_shipdate")
        od = orders.select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority")
        return li.join(od, li.l_orderkey == od.o_orderkey)

    @staticmethod
    def _line_columns(j: DataFrame) -> DataFrame:
        """One row per sale line with channel-neutral column names."""
        ext = money("l_extendedprice")
        disc = F.col("l_discount").cast("decimal(4,2)")
        tax = F.col("l_tax").cast("decimal(4,2)")
        prio = F.nullif(F.regexp_extract("o_orderpriority", PROMO_KEY, 1), F.lit(""))
        cols = [
            F.col("l_orderkey").alias("order_number"),
            F.col("l_linenumber").alias("line_number"),
            F.col("l_returnflag").alias("return_flag"),
            julian_key("o_orderdate").alias("sold_date_sk"),
            julian_key("l_shipdate").alias("ship_date_sk"),
            ((F.col("l_orderkey") * 7919 + F.col("l_linenumber") * 104729) % 86400)
            .cast("int").alias("sold_time_sk"),
            F.col("l_partkey").alias("item_sk"),
            F.col("l_suppkey").alias("supp_sk"),
            F.when(F.col("l_orderkey") % 11 != 0, F.col("o_custkey")).alias("customer_sk"),
            F.col("o_custkey").alias("order_custkey"),
            F.when(prio != "5", prio.cast("int")).alias("promo_sk"),
            F.col("l_quantity").cast("int").alias("quantity"),
            ext.alias("ext_list_price"),
            F.round(ext * disc, 2).cast("decimal(12,2)").alias("ext_discount_amt"),
            F.round(ext * dec("0.95"), 2).cast("decimal(12,2)").alias("ext_wholesale_cost"),
            tax.alias("tax_rate"),
            (F.col("l_orderkey") % 7).cast("int").alias("channel_code"),
        ]
        base = j.select(*cols)
        sales = (F.col("ext_list_price") - F.col("ext_discount_amt")).cast("decimal(12,2)")
        base = base.withColumn("ext_sales_price", sales).withColumn("net_paid", F.col("ext_sales_price"))
        base = base.withColumn("ext_tax", F.round(F.col("net_paid") * F.col("tax_rate"), 2).cast("decimal(12,2)"))
        qty = F.when(F.col("quantity") != 0, F.col("quantity"))
        return base.select(
            "*",
            F.round(F.col("ext_wholesale_cost") / qty, 2).cast("decimal(12,2)").alias("wholesale_cost"),
            F.round(F.col("ext_list_price") / qty, 2).cast("decimal(12,2)").alias("list_price"),
            F.round(F.col("ext_sales_price") / qty, 2).cast("decimal(12,2)").alias("sales_price"),
            dec("0.00").cast("decimal(12,2)").alias("coupon_amt"),
            (F.col("net_paid") + F.col("ext_tax")).cast("decimal(12,2)").alias("net_paid_inc_tax"),
            (F.col("net_paid") - F.col("ext_wholesale_cost")).cast("decimal(12,2)").alias("net_profit"),
            F.round(F.col("ext_list_price") * dec("0.02"), 2).cast("decimal(12,2)").alias("ext_ship_cost"),
        ).drop("tax_rate")

    @staticmethod
    def channel_of(code):
        return F.when(code <= 3, F.lit(STORE)).when(code <= 5, F.lit(CATALOG)).otherwise(F.lit(WEB))

    @staticmethod
    def channel_filter(channel: str):
        code = F.col("channel_code")
        if channel == STORE:
            return code <= 3
        if channel == CATALOG:
            return (code == 4) | (code == 5)
        return code == 6

    def _channel_lines(self, channel: str) -> DataFrame:
        if self._staged_rows is not None:
            return self._line_columns(self._staged_rows.filter(F.col(LINE_CHANNEL) == channel))
        return self._lines().filter(self.channel_filter(channel))

    # ------------------------------------------------------------------ facts
    def sales_in_years(self, fact: str, years) -> DataFrame:
        """A sales fact cut to a year range."""
        channel = fact.split("_")[1]
        lines = self._lines_in_years(years).filter(self.channel_filter(channel))
        return build_fact(self._staging_sales(channel, lines), f"{channel}_sales")

    def _staging_sales(self, channel: str, lines: DataFrame | None = None) -> DataFrame:
        """Staging-shaped sales of one channel: every source column the rules define, in source order."""
        p = PREFIX[channel]
        c = {
            f"{p}_sold_date_sk": F.col("sold_date_sk"),
            f"{p}_sold_time_sk": F.col("sold_time_sk"),
            f"{p}_item_sk": F.col("item_sk"),
            f"{p}_promo_sk": F.col("promo_sk"),
            f"{p}_quantity": F.col("quantity"),
        }
        for m in ("wholesale_cost", "list_price", "sales_price", "ext_discount_amt", "ext_sales_price",
                  "ext_wholesale_cost", "ext_list_price", "ext_tax", "coupon_amt", "net_paid", "net_paid_inc_tax"):
            c[f"{p}_{m}"] = F.col(m)
        hdemo = F.when(F.col("customer_sk").isNotNull(), F.col("customer_sk") % 20 + 1).cast("int")
        if channel == STORE:
            c.update({"ss_customer_sk": F.col("customer_sk"), "ss_hdemo_sk": hdemo,
                      "ss_cdemo_sk": F.col("customer_sk") % 40 + 1, "ss_addr_sk": F.col("customer_sk"),
                      "ss_store_sk": F.col("supp_sk"), "ss_ticket_number": F.col("order_number"),
                      "ss_net_profit": F.col("net_profit")})
        else:
            ship_cust = (F.when(F.col("line_number") % 4 == 0, F.lit(None).cast("bigint"))
                         .when(F.col("line_number") % 4 == 1, F.col("order_custkey") + 1)
                         .otherwise(F.col("order_custkey")))
            c.update({
                f"{p}_ship_date_sk": F.col("ship_date_sk"),
                f"{p}_bill_customer_sk": F.col("customer_sk"),
                f"{p}_bill_hdemo_sk": hdemo,
                f"{p}_ship_customer_sk": ship_cust,
                f"{p}_bill_cdemo_sk": F.col("customer_sk") % 40 + 1,
                f"{p}_bill_addr_sk": F.col("customer_sk"),
                f"{p}_ship_cdemo_sk": ship_cust % 40 + 1,
                # every third order goes to the payer's own address, whoever receives it
                f"{p}_ship_addr_sk": F.when(F.col("order_number") % 3 == 0, F.col("customer_sk")).otherwise(ship_cust),
                f"{p}_ship_mode_sk": (F.col("order_number") % 5 + 1).cast("int"),
                f"{p}_warehouse_sk": F.col("supp_sk"),
                f"{p}_order_number": F.col("order_number"),
                f"{p}_ext_ship_cost": F.col("ext_ship_cost"),
                f"{p}_net_paid_inc_ship": (F.col("net_paid") + F.col("ext_ship_cost")).cast("decimal(12,2)"),
                f"{p}_net_paid_inc_ship_tax": (F.col("net_paid_inc_tax") + F.col("ext_ship_cost")).cast("decimal(12,2)"),
                f"{p}_net_profit": (F.col("net_profit") - F.col("ext_ship_cost")).cast("decimal(12,2)"),
            })
            if channel == WEB:
                c["ws_web_page_sk"] = F.col("line_number")
                c["ws_web_site_sk"] = (F.col("supp_sk") % 3 + 1).cast("int")
            else:
                c["cs_call_center_sk"] = (F.col("supp_sk") % 4 + 1).cast("int")
                c["cs_catalog_page_sk"] = F.col("line_number")
        order = [f.name for f in raw_schema(f"{channel}_sales").fields if f.name in c]
        lines = self._channel_lines(channel) if lines is None else lines
        return lines.select(*[c[n].alias(n) for n in order])

    @cached_property
    def store_sales(self) -> DataFrame:
        return self._staging_sales(STORE)

    @cached_property
    def web_sales(self) -> DataFrame:
        return self._staging_sales(WEB)

    @cached_property
    def catalog_sales(self) -> DataFrame:
        return self._staging_sales(CATALOG)

    @cached_property
    def fact_store_sales(self) -> DataFrame:
        """M06 applied to the staging-shaped store sales (20 mart columns)."""
        return build_fact(self.store_sales, "store_sales")

    @cached_property
    def fact_web_sales(self) -> DataFrame:
        """M07 (25 mart columns)."""
        return build_fact(self.web_sales, "web_sales")

    @cached_property
    def fact_catalog_sales(self) -> DataFrame:
        """M08 (25 mart columns)."""
        return build_fact(self.catalog_sales, "catalog_sales")

    def all_channel_lines(self, *measures: str, years=None) -> DataFrame:
        """The three facts as one frame (``channel``, item, date, measures).

        Union of the three channel facts.  Over the derived marts this is a
        single scan of the joined lines (the channel split is a partition of
        them), so a cross-channel report reads the source once.
        """
        ch = self.channel_of(F.col("channel_code"))
        lines = self._lines() if years is None else self._lines_in_years(years)
        if "net_profit" in measures:
            # web and catalog profit also carries the shipping cost
            lines = lines.withColumn("net_profit", F.when(F.col("channel_code") <= 3, F.col("net_profit"))
                                     .otherwise(F.col("net_profit") - F.col("ext_ship_cost")).cast("decimal(12,2)"))
        return lines.select(ch.alias("channel"), "item_sk", "sold_date_sk", *measures)

    # ---------------------------------------------------------------- returns
    def _returns(self, channel: str) -> DataFrame:
        p = {STORE: "sr", WEB: "wr", CATALOG: "cr"}[channel]
        num = "sr_ticket_number" if channel == STORE else f"{p}_order_number"
        amt = "cr_return_amount" if channel == CATALOG else f"{p}_return_amt"
        b = self._channel_lines(channel).filter(F.col("return_flag") == "R")
        cust = "sr_customer_sk" if channel == STORE else f"{p}_returning_customer_sk"
        cols = [
            (F.col("ship_date_sk") + 14).cast("int").alias(f"{p}_returned_date_sk"),
            F.col("item_sk").alias(f"{p}_item_sk"),
            F.col("customer_sk").alias(cust),
            F.col("line_number").alias(f"{p}_reason_sk"),
            F.col("order_number").alias(num),
            F.col("quantity").alias(f"{p}_return_quantity"),
            F.col("net_paid").alias(amt),
            F.round(F.col("net_paid") * dec("0.10"), 2).cast("decimal(12,2)").alias(f"{p}_net_loss"),
        ]
        if channel == STORE:
            cols.insert(3, F.col("supp_sk").alias("sr_store_sk"))
        else:
            cols.insert(3, F.when(F.col("line_number") % 3 == 0, F.col("order_custkey") + 2)
                        .otherwise(F.col("customer_sk")).alias(f"{p}_refunded_customer_sk"))
        return b.select(*cols)

    def all_returns(self) -> DataFrame:
        """All channels' returns from one pass over the lines."""
        ch = self.channel_of(F.col("channel_code"))
        return self._lines().filter(F.col("return_flag") == "R").select(
            ch.alias("channel"), "order_number", "item_sk",
            F.round(F.col("net_paid") * dec("0.10"), 2).cast("decimal(12,2)").alias("net_loss"))

    @cached_property
    def store_returns(self) -> DataFrame:
        return self._returns(STORE)

    @cached_property
    def web_returns(self) -> DataFrame:
        return self._returns(WEB)

    @cached_property
    def catalog_returns(self) -> DataFrame:
        return self._returns(CATALOG)

    # --------------------------------------------------------------- dimensions
    @cached_property
    def _span(self) -> tuple[int, int]:
        """First and last year in the data: one row of two minima and maxima, read once a session.

        The calendar is bounded by days, so no report that uses it reads the sales again for its span.
        """
        first, last, _ = self._bounds
        return (first.year, last.year) if last else (0, 0)

    @cached_property
    def _bounds(self) -> tuple:
        """First and last day of orders and shipments, and the last shipment."""
        day = lambda t, c: t.agg(F.min(c).alias("lo"), F.max(c).alias("hi"))
        shipped = day(self.t.lineitem, "l_shipdate").withColumn("ship", F.col("hi"))
        both = day(self.t.orders, "o_orderdate").unionByName(shipped, allowMissingColumns=True)
        return tuple(both.agg(F.min("lo"), F.max("hi"), F.max("ship")).first())

    @cached_property
    def dim_date(self) -> DataFrame:
        """Every day from Jan 1 of the first to Dec 31 of the last year in the data."""
        lo, hi = self._span
        days = self.spark.range(1 if hi else 0).select(
            F.explode(F.sequence(F.make_date(F.lit(lo), F.lit(1), F.lit(1)),
                                 F.make_date(F.lit(hi), F.lit(12), F.lit(31)))).alias("full_date"),
            F.lit(hi).alias("last_year"))
        y, m, d = F.year("full_date"), F.month("full_date"), F.dayofmonth("full_date")
        dow = (F.dayofweek("full_date") - 1).cast("int")
        q = F.quarter("full_date")
        out = days.select(
            julian_key("full_date").alias("date_sk"),
            "full_date",
            y.alias("year"), q.alias("quarter"), m.alias("month"), d.alias("day_of_month"),
            dow.alias("day_of_week"),
            F.date_format("full_date", "EEEE").alias("day_name"),
            (F.floor((julian_key("full_date") - F.lit(2415021)) / 7) + 1).cast("int").alias("week_seq"),
            ((y - 1900) * 12 + m - 1).cast("int").alias("month_seq"),
            ((y - 1900) * 4 + q - 1).cast("int").alias("quarter_seq"),
            (((m == 1) & (d == 1)) | ((m == 7) & (d == 4)) | ((m == 12) & (d == 25))).alias("is_holiday"),
            dow.isin(0, 6).alias("is_weekend"),
            (y == F.col("last_year")).alias("is_current_year"),
            (y * 100 + m).cast("int").alias("sold_ym"),
            julian_key(F.add_months("full_date", -12)).alias("same_day_ly"),
            julian_key(F.add_months("full_date", -3)).alias("same_day_lq"),
        )
        return out

    @cached_property
    def dim_item(self) -> DataFrame:
        p = self.t.part
        size = F.col("p_size")
        return p.select(
            F.col("p_partkey").alias("item_sk"),
            F.concat(F.lit("ITEM"), _padded("p_partkey", 12)).alias("item_id"),
            F.col("p_name").alias("product_name"),
            F.col("p_brand").alias("brand"),
            F.nullif(F.regexp_extract("p_brand", "([0-9]+)$", 1), F.lit("")).cast("int").alias("brand_id"),
            F.when(size <= 10, "small").when(size <= 25, "medium").otherwise("large").alias("class"),
            F.col("p_type").alias("category"),
            F.concat(F.lit("Manufact#"), (F.col("p_partkey") % 10).cast("string")).alias("manufacturer"),
            (F.col("p_partkey") % 10).cast("int").alias("manager_id"),
            money("p_retailprice", 7).alias("current_price"),
            F.round(money("p_retailprice", 7) * dec("0.60"), 2).cast("decimal(7,2)").alias("wholesale_cost"),
            F.lit("1995-01-01").cast("date").alias("valid_from"),
            F.when(F.col("p_partkey") % 10 == 0, F.lit("2000-12-31").cast("date")).alias("valid_to"),
        )

    @cached_property
    def dim_customer(self) -> DataFrame:
        c = self.t.customer
        n = self.t.nation.select("n_nationkey", "n_name", "n_regionkey")
        r = self.t.region.select("r_regionkey", "r_name")
        k = F.col("c_custkey")
        j = c.join(n, c.c_nationkey == n.n_nationkey, "left").join(r, F.col("n_regionkey") == r.r_regionkey, "left")
        return j.select(
            k.alias("customer_sk"),
            F.col("c_name").alias("customer_id"),
            F.when(k % 3 == 0, "Y").when(k % 3 == 1, "N").alias("preferred_flag"),
            (F.lit(1930) + k % 60).cast("int").alias("birth_year"),
            (F.lit(1) + k % 12).cast("int").alias("birth_month"),
            (F.lit(1) + k % 31).cast("int").alias("birth_day"),
            F.when(k % 5 == 0, F.lit(None).cast("string")).when(k % 2 == 1, "M").otherwise("F").alias("gender"),
            F.when(k % 4 == 0, EDUCATION[0]).when(k % 4 == 1, EDUCATION[1])
            .when(k % 4 == 2, EDUCATION[2]).alias("education_status"),
            F.col("c_mktsegment").alias("credit_rating"),
            F.col("n_name").alias("state"),
            F.col("r_name").alias("country"),
            (-(F.col("c_nationkey") % 12)).cast("decimal(5,2)").alias("gmt_offset"),
            (k % 20 + 1).cast("int").alias("hdemo_sk"),
        )

    @cached_property
    def dim_store(self) -> DataFrame:
        s = self.t.supplier
        n = self.t.nation.select("n_nationkey", "n_name", "n_regionkey")
        r = self.t.region.select("r_regionkey", "r_name")
        k = F.col("s_suppkey")
        j = s.join(n, s.s_nationkey == n.n_nationkey, "left").join(r, F.col("n_regionkey") == r.r_regionkey, "left")
        return j.select(
            k.alias("store_sk"),
            F.concat(F.lit("STORE"), _padded("s_suppkey", 11)).alias("store_id"),
            F.col("s_name").alias("store_name"),
            (F.lit(50) + k % 250).cast("int").alias("employees"),
            F.when(k % 13 != 0, (k * 7919) % 400000).cast("int").alias("floor_space"),
            F.col("n_regionkey").alias("market_id"),
            F.col("n_name").alias("city"),
            F.col("r_name").alias("state"),
            F.col("n_regionkey").alias("division_id"),
            F.col("r_name").alias("division_name"),
            (k % 2 + 1).cast("int").alias("company_id"),
            F.concat(F.lit("Company "), (k % 2 + 1).cast("string")).alias("company_name"),
            F.when(k % 17 == 0, F.lit(2452091)).cast("int").alias("closed_date_sk"),
        )

    @cached_property
    def dim_promotion(self) -> DataFrame:
        """Order priorities 1-4 become promotions (5-LOW = no promotion).

        One promotion has cost 0 and one has cost NULL so the divide guards
        and NULL ordering are exercised.
        """
        pr = (self.t.orders.select(F.regexp_extract("o_orderpriority", PROMO_KEY, 1).alias("digit"),
                                   F.col("o_orderpriority").alias("priority"))
              .filter(~F.col("digit").isin("", "5")).groupBy("digit").agg(F.min("priority").alias("priority")))
        sk = F.col("digit").cast("int")
        return pr.select(
            sk.alias("promo_sk"),
            F.concat(F.lit("PROMO"), _padded("digit", 11)).alias("promo_id"),
            F.regexp_extract("priority", "^[0-9]+-(.*)$", 1).alias("promo_name"),
            F.when(sk % 2 == 1, "Unknown").otherwise("Sales").alias("purpose"),
            F.when(sk == 2, dec("0.00")).when(sk == 3, F.lit(None))
            .otherwise(sk * dec("1000.00")).cast("decimal(15,2)").alias("cost"),
            F.lit(1).alias("response_target"),
            F.when(sk <= 2, "Y").otherwise("N").alias("channel_email"),
            F.when(sk % 2 == 0, "Y").otherwise("N").alias("channel_catalog"),
            F.when(sk % 2 == 1, "Y").otherwise("N").alias("channel_tv"),
            (F.lit(2449719) + (sk - 1) * 365).cast("int").alias("start_date_sk"),
            (F.lit(2449719) + (sk - 1) * 365 + 500).cast("int").alias("end_date_sk"),
            F.when(sk == 4, F.lit(1)).cast("int").alias("item_sk"),
        )

    # ------------------------------------------------------- staging reference
    # the staged reference tables that some reports read beside the marts
    @cached_property
    def date_dim(self) -> DataFrame:
        return stage("date_dim", raw_table(self.t, "date_dim"))

    @cached_property
    def customer(self) -> DataFrame:
        return stage("customer", raw_table(self.t, "customer"))

    @cached_property
    def customer_demographics(self) -> DataFrame:
        return stage("customer_demographics", raw_table(self.t, "customer_demographics"))

    @cached_property
    def customer_address(self) -> DataFrame:
        return stage("customer_address", raw_table(self.t, "customer_address"))

    @cached_property
    def item(self) -> DataFrame:
        return stage("item", raw_table(self.t, "item"))

    @cached_property
    def store(self) -> DataFrame:
        return stage("store", raw_table(self.t, "store"))

    @cached_property
    def promotion(self) -> DataFrame:
        return stage("promotion", raw_table(self.t, "promotion"))

    @cached_property
    def warehouse(self) -> DataFrame:
        s = self.t.supplier
        n = self.t.nation.select("n_nationkey", "n_name")
        return s.join(n, s.s_nationkey == n.n_nationkey, "left").select(
            F.col("s_suppkey").alias("w_warehouse_sk"),
            F.concat(F.lit("Warehouse "), F.col("s_suppkey").cast("string")).alias("w_warehouse_name"),
            F.col("n_name").alias("w_state"))

    @cached_property
    def inventory(self) -> DataFrame:
        return self._positions(self.t.lineitem)

    @cached_property
    def inventory_latest(self) -> DataFrame:
        """The last month's positions; the month is known from the session's bounds, so the scan reads only it."""
        last = self._bounds[2]
        start = dt.datetime(last.year, last.month, 1) if last else dt.datetime(9999, 1, 1)
        return self._positions(self.t.lineitem.filter(F.col("l_shipdate") >= F.lit(start).cast("timestamp_ntz")))

    @staticmethod
    def _positions(li: DataFrame) -> DataFrame:
        return (li.groupBy(julian_key(F.trunc(F.col("l_shipdate").cast("date"), "month")).alias("inv_date_sk"),
                           F.col("l_partkey").alias("inv_item_sk"),
                           F.col("l_suppkey").alias("inv_warehouse_sk"))
                .agg(F.sum("l_quantity").cast("int").alias("inv_quantity_on_hand")))

    @cached_property
    def reason(self) -> DataFrame:
        rs = self.t.lineitem.select(F.col("l_linenumber").alias("r_reason_sk")).distinct()
        desc = F.concat(F.lit(" Reason "), F.col("r_reason_sk").cast("string"), F.lit("  "))
        return rs.select("r_reason_sk", desc.alias("r_reason_desc"),
                         F.trim(desc).alias("r_reason_desc_clean"))

    @cached_property
    def time_dim(self) -> DataFrame:
        """Seconds of the day; shift by hour (first 8-15, second 16-23, third 0-7)."""
        t = self.spark.range(0, 86400).select(F.col("id").cast("int").alias("t_time_sk"))
        h = (F.col("t_time_sk") / 3600).cast("int")
        return t.select("t_time_sk", h.alias("t_hour"),
                        F.when(h < 8, "third").when(h < 16, "first").otherwise("second").alias("t_shift"))

    @cached_property
    def web_page(self) -> DataFrame:
        return _code_table(self.spark, "wp_web_page_sk", WEB_PAGE_TYPES, "wp_type")

    @cached_property
    def catalog_page(self) -> DataFrame:
        return _code_table(self.spark, "cp_catalog_page_sk", CATALOG_DEPARTMENTS, "cp_department")

    @cached_property
    def ship_mode(self) -> DataFrame:
        return _code_table(self.spark, "sm_ship_mode_sk", SHIP_MODE_TYPES, "sm_type")

    @cached_property
    def call_center(self) -> DataFrame:
        return _code_table(self.spark, "cc_call_center_sk", CALL_CENTER_NAMES, "cc_name")

    @cached_property
    def household_demographics(self) -> DataFrame:
        hd = self.dim_customer.select(F.col("hdemo_sk").alias("hd_demo_sk")).distinct()
        return hd.select("hd_demo_sk", ((F.col("hd_demo_sk") - 1) % 20 + 1).cast("int").alias("hd_income_band_sk"))

    @cached_property
    def income_band(self) -> DataFrame:
        ib = self.household_demographics.select(F.col("hd_income_band_sk").alias("ib_income_band_sk")).distinct()
        k = F.col("ib_income_band_sk")
        return ib.select(k, ((k - 1) * 10000 + F.when(k > 1, 1).otherwise(0)).cast("int").alias("ib_lower_bound"),
                         (k * 10000).cast("int").alias("ib_upper_bound"))

    # ---------------------------------------------------------- operations data
    @cached_property
    def run_log(self) -> DataFrame:
        """Run log rows derived from ``events`` (type, start time, status, size)."""
        e = self.t.events
        return e.select(
            F.col("event_id").alias("id"),
            F.concat(F.lit("dump_"), F.col("event_type")).alias("backup_type"),
            F.col("ts").alias("started_at"),
            F.when(F.col("value") < 45, "success").otherwise("failed").alias("status"),
            F.round(F.col("value") * 1000000).cast("bigint").alias("size_bytes"),
            F.floor("value").cast("int").alias("duration_secs"),
            F.col("props").alias("notes"))

    @cached_property
    def metrics(self) -> DataFrame:
        """Metric samples derived from ``events``: each event is one counter reading."""
        e = self.t.events
        return e.select(
            F.col("ts"),
            F.concat(F.lit("node-"), (F.col("user_id") % 3).cast("string")).alias("instance"),
            F.concat(F.lit("db"), (F.col("user_id") % 4).cast("string")).alias("datname"),
            F.concat(F.lit("pg_"), F.col("event_type")).alias("metric"),
            F.col("value").cast("decimal(12,2)").alias("value"))
