"""Queries of table manifests over the test tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.operators import manifest
from tidewell.sources.adapters import read

COLUMNS = ["o_custkey", "o_orderstatus", "o_orderpriority", "o_cents"]


def orders(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "orders").withColumn("o_cents", F.round(F.col("o_totalprice") * 100).cast("long"))


def edited(spark: SparkSession, d: str) -> DataFrame:
    """The orders with a few other prices, one row more and some less."""
    o = orders(spark, d)
    far = F.col("o_orderkey") % 1000 == 7
    o = o.where(F.col("o_orderkey") % 5000 != 11).withColumn("o_cents", F.when(far, F.col("o_cents") + 1).otherwise(F.col("o_cents")))
    return o.union(o.where("o_orderkey = 1").withColumn("o_orderkey", F.lit(-1).cast("long")))


def table_manifest(spark: SparkSession, d: str) -> DataFrame:
    return manifest.table_manifest(orders(spark, d), ["o_orderkey"], COLUMNS)


def manifest_changes(spark: SparkSession, d: str) -> DataFrame:
    now = manifest.table_manifest(edited(spark, d).repartition("o_custkey"), ["o_orderkey"], COLUMNS)
    return manifest.manifest_changes(table_manifest(spark, d), now)


NUMBER = "('0x' || substr(md5({}), 1, 15))::bigint"


def _manifest_sql(name: str, rows: str) -> str:
    cells = ", ".join(f"{{'col': '{c}', 'nul': {c} is null, 'txt': coalesce({c}::varchar, chr(0) || 'null')}}" for c in COLUMNS)
    key = NUMBER.format("k")
    return f"""{name}c as (select o_orderkey::varchar k, unnest([{{'col': 'key', 'nul': false, 'txt': ''}}, {cells}]) c from {rows}),
{name} as (select ({key} % 16)::int as block, c.col as column, count(*) n, count(*) filter (c.nul) n_null, sum({NUMBER.format("k || chr(1) || c.col || chr(1) || c.txt")}::hugeint)::varchar digest from {name}c group by all)"""


ORDERS_SQL = "od as (select *, round(o_totalprice * 100)::bigint o_cents from orders)"

ORACLE = {
    "table_manifest": f"with {ORDERS_SQL}, {_manifest_sql('m', 'od')} select * from m",
    "manifest_changes": f"""with {ORDERS_SQL}, e0 as (select * replace (case when o_orderkey % 1000 = 7 then o_cents + 1 else o_cents end as o_cents) from od where o_orderkey % 5000 <> 11),
ed as (select * from e0 union all select * replace (-1::bigint as o_orderkey) from e0 where o_orderkey = 1), {_manifest_sql('a', 'od')}, {_manifest_sql('b', 'ed')}
select coalesce(a.block, b.block) as block, coalesce(a.column, b.column) as column, case when a.block is null then 'added' when b.block is null then 'missing'
 when a.n = b.n and a.n_null = b.n_null and a.digest = b.digest then 'equal' else 'changed' end as status, a.n n_kept, b.n n_now from a full join b on a.block = b.block and a.column = b.column""",
}

QUERIES = {"table_manifest": table_manifest, "manifest_changes": manifest_changes}
