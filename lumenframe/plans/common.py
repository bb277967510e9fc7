"""Bindings that the queries share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.session import table

HOUR = 3_600_000_000
DAY = 24 * HOUR


def micros(column: str) -> Column:
    """Microseconds since 1970 of a timestamp column."""
    return F.unix_micros(F.col(column).cast("timestamp"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events with t, microseconds since 1970, and k, the item in props."""
    rows = table(spark, sf_dir, "events")
    return rows.withColumns({"t": micros("ts"), "k": F.get_json_object("props", "$.k").cast("long")})


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The orders with d, the day of the order since 1970."""
    return table(spark, sf_dir, "orders").withColumn("d", F.floor(micros("o_orderdate") / DAY).cast("long"))


def lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The line items with d, the day of shipping since 1970."""
    return table(spark, sf_dir, "lineitem").withColumn("d", F.floor(micros("l_shipdate") / DAY).cast("long"))


#: DuckDB counterparts of events(), orders() and lineitem(), as common table expressions.
EV = "ev as (select *, epoch_us(ts) as t, try_cast(json_extract_string(props, '$.k') as bigint) as k from events)"
OD = "od as (select *, epoch_us(o_orderdate) // 86400000000 as d from orders)"
LI = "li as (select *, epoch_us(l_shipdate) // 86400000000 as d from lineitem)"
