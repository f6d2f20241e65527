"""A transactions table over the driver's orders and customers, in Spark and in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VIEW = """
select o.o_orderkey as tx_id, {ts} as timestamp,
  cast(cf.c_nationkey as {string}) as from_bank, concat('A', cast(o.o_custkey as {string})) as from_account,
  cast(ct.c_nationkey as {string}) as to_bank, concat('A', cast(o.to_key as {string})) as to_account,
  o.o_totalprice as amount_received, o.o_totalprice as amount_paid, o.o_orderpriority as payment_format,
  case when o.o_orderkey % 53 = 0 or (o.o_custkey % 50 < 3 and o.o_orderkey % 2 = 0) then 1 else 0 end as is_laundering
from (select *, case
        when o_orderkey % 40 = 0 then o_custkey
        when o_orderkey % 3 = 0 then (o_custkey - o_custkey % 50) + (o_orderkey * 7) % 50
        else (o_custkey - o_custkey % 50) + greatest(o_custkey % 50 - 1 - o_orderkey % 5, 0) end as to_key
      from {orders}) o
join {customer} cf on cf.c_custkey = o.o_custkey
join {customer} ct on ct.c_custkey = o.to_key
"""
DUCKDB = VIEW.format(ts="o.o_orderdate + ((o.o_orderkey * 7919) % 86400) * interval 1 second", string="varchar", orders="orders", customer="customer")


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = VIEW.format(ts="o.o_orderdate + make_dt_interval(0, 0, 0, (o.o_orderkey * 7919) % 86400)", string="string", orders="{orders}", customer="{customer}")
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    out = spark.sql(text, orders=read("orders"), customer=read("customer"))
    return out.withColumns({c: F.lit(None).cast("string") for c in ("receiving_currency", "payment_currency")})
