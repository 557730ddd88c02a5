"""Stand-in incident event log derived from the driver's TPC-H-style tables.

One line item is one event, one order is one incident. The mapping is a plain
join + projection, so its cost grows with ``lineitem``:

    lineitem ⋈ orders (order key) ⋈ part (part key) ⋈ customer ⋈ nation

Event order inside a ticket is carried by ``event_seq``, a bigint computed per
row (no window, so no ticket is ever gathered into one task):

    days(l_shipdate)·2^44 + l_linenumber·2^40 + 40-bit integer tie-break

The tie-break mixes (partkey, suppkey, quantity, price) with plain integer
arithmetic, so DuckDB computes the identical value for the oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SHIP_SHIFT = 1 << 44
LINE_SHIFT = 1 << 40
TIE_MOD = 1 << 40
KEY_DIGITS = 7


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def ticket_number(orderkey: F.Column) -> F.Column:
    """'INC' + order key zero-padded to 7 digits (never truncated for longer keys)."""
    k = orderkey.cast("string")
    return F.concat(F.lit("INC"), F.when(F.length(k) >= KEY_DIGITS, k).otherwise(F.lpad(k, KEY_DIGITS, "0")))


def _hours(ts: str, n) -> F.Column:
    return F.timestamp_add("HOUR", n, F.col(ts))


def stand_in_event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read_table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
        "l_extendedprice", "l_discount", "l_returnflag", "l_linestatus", "l_shipdate")
    orders = read_table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority")
    part = read_table(spark, sf_dir, "part").select("p_partkey", "p_type", "p_brand")
    customer = read_table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    # nation has 25 rows by the TPC-H spec: a fixed-size broadcast.
    nation = F.broadcast(read_table(spark, sf_dir, "nation").select("n_nationkey", "n_name"))
    cust_loc = customer.join(nation, customer.c_nationkey == nation.n_nationkey).select("c_custkey", "n_name")

    qty = F.col("l_quantity")
    ln = F.col("l_linenumber")
    tie = F.pmod(F.col("l_partkey") * 1000003 + F.col("l_suppkey") * 1009
                 + F.round(qty * 100).cast("bigint") * 31 + F.round(F.col("l_extendedprice") * 100).cast("bigint"),
                 F.lit(TIE_MOD))
    event_seq = (F.unix_date(F.col("l_shipdate").cast("date")).cast("bigint") * SHIP_SHIFT
                 + ln.cast("bigint") * LINE_SHIFT + tie)
    whole_qty = qty.cast("int")  # cast truncates toward zero

    made_sla = (F.when((F.col("l_returnflag") == "N") & (ln % 2 == 0), F.lit(None).cast("string"))
                 .when((ln == 7) & (F.col("l_returnflag") == "A"), F.lit("unknown"))
                 .when(qty * ln > 110, F.lit("False"))
                 .otherwise(F.lit(" TRUE ")))

    # What a line item alone decides is computed before the joins, and the orders meet their customers first: line items
    # are shuffled twice (part, order), with the columns that are asked for. The order is met by the ticket number (one for
    # each order key), so what groups the events by ticket finds them together and sorted, without another shuffle.
    own = li.select(
        "l_orderkey", "l_partkey", "l_suppkey", ln, event_seq.alias("event_seq"),
        whole_qty.alias("sys_mod_count"),
        F.round(F.col("l_discount") * 100).cast("int").alias("reassignment_count"),
        F.when(F.col("l_returnflag") == "R", ln % 3).otherwise(F.lit(0)).alias("reopen_count"),
        F.when(F.col("l_linestatus") == "O", F.lit(None)).otherwise(whole_qty * ln).alias("hours_open"),
        "l_shipdate", made_sla.alias("made_sla"))
    opened = orders.join(cust_loc, orders.o_custkey == cust_loc.c_custkey)
    ev = own.join(part, own.l_partkey == part.p_partkey).join(
        opened, ticket_number(own.l_orderkey) == ticket_number(opened.o_orderkey))

    return ev.select(
        ticket_number(F.col("l_orderkey")).alias("number"),
        "event_seq", "sys_mod_count", "reassignment_count", "reopen_count",
        F.when(ln == 1, F.lit(None).cast("string")).otherwise(F.col("p_type")).alias("category"),
        F.col("p_brand").alias("subcategory"),
        F.when(F.col("o_orderpriority") == "4-NOT SPECIFIED", F.lit(None).cast("string"))
         .otherwise(F.col("o_orderpriority")).alias("priority"),
        F.when(ln == 2, F.lit(None).cast("string"))
         .otherwise(F.concat(F.lit("Group "), F.col("l_suppkey").cast("string"))).alias("assignment_group"),
        F.concat(F.lit("Caller "), F.col("o_custkey").cast("string")).alias("caller_id"),
        F.concat(F.lit("Opened by "), (F.col("o_custkey") % 50).cast("string")).alias("opened_by"),
        F.col("n_name").alias("location"),
        _hours("o_orderdate", ln - 1).alias("opened_at"),
        _hours("o_orderdate", F.col("hours_open")).cast("timestamp_ntz").alias("resolved_at"),
        F.col("l_shipdate").alias("sys_updated_at"),
        "made_sla",
    )


__all__ = ["stand_in_event_log", "read_table"]
