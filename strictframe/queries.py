"""The engine's registered queries over the test tables, each with its twin in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import types as S
from .cli import Database
from .engine import Engine
from .functions import wide
from .functions.digest import bounds, column_digests, digest, result_hash
from .operators import relational as R
from .plans.parser import table_names
from .session import configure, scratch_folder
from .sources.catalog import append_csv, from_arrow, random_table, read_csv, to_arrow
from .streaming.append import append_stream, current_digests, digests, table

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "benchmark", "labels", "conversations")

_SQL: dict[str, tuple[str, tuple, str]] = {}
_FRAMES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def _engine(spark: SparkSession, sf_dir: str, text: str) -> Engine:
    e = Engine(spark, sorted_groups=False)  # results are compared as sets
    for t in table_names(text):
        e.catalog.add_parquet(t, f"{sf_dir}/{t}.parquet")
    return e


def _frame(name: str, oracle: str | None = None):
    def add(f):
        _FRAMES[name] = (f, oracle)
        return f

    return add


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return configure(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def _sql(name: str, text: str, oracle: str | None = None, params: tuple = ()) -> None:
    _SQL[name] = (text, params, oracle or text)


#: The tables' doubles have two decimals; by way of these both engines get the same exact decimal.
_D = "cast(cast({} as decimal(15,2)) as decimal(20,10))"
_QTY, _PRICE, _DISC, _TAX = (_D.format(f"l_{c}") for c in ("quantity", "extendedprice", "discount", "tax"))

# Sources and projections.
_sql("sql01_scan", "select r_regionkey, r_name from region")
_sql("sql02_no_table", "select 1 + 1 as two, 'no table' as word, true as yes", "select cast(2 as decimal(20,0)) as two, 'no table' as word, true as yes")
_sql("sql11_projection", "select o_orderkey, o_orderstatus as status from orders")
_sql("sql13_star", "select *, 3 as three from nation", "select *, cast(3 as bigint) as three from nation")
_sql("sql15_literals", "select n_nationkey, 45.70 as d, -7 as i, 'it''s' as s from nation", "select n_nationkey, cast(45.7 as decimal(3,1)) as d, cast(-7 as bigint) as i, 'it''s' as s from nation")
# Filters and predicates.
_sql("sql12_filter_eq", "select l_partkey from lineitem where l_linenumber = 1")
_sql("sql12_filter_many", "select * from orders where ((o_custkey = 7) or (o_orderstatus = 'F')) and (not (o_orderpriority = '1-URGENT'))", f"select o_orderkey, o_custkey, o_orderstatus, {_D.format('o_totalprice')} as o_totalprice, o_orderdate, o_orderpriority from orders where ((o_custkey = 7) or (o_orderstatus = 'F')) and (not (o_orderpriority = '1-URGENT'))")
_sql("sql16_params", "select c_custkey, c_mktsegment = $1 as same, $2::bigint as given from customer where c_custkey > $2", "select c_custkey, c_mktsegment = 'BUILDING' as same, cast(40 as bigint) as given from customer where c_custkey > 40", ("BUILDING", 40))
_sql("sql17_and", "select o_orderkey from orders where o_orderstatus = 'O' and o_custkey > 100")
_sql("sql18_or_mix", "select l_orderkey, l_linenumber, l_returnflag from lineitem where l_returnflag = 'R' and l_linestatus = 'F' or l_orderkey = 1")
_sql("sql19_not", "select l_orderkey, l_linenumber from lineitem where not (l_returnflag = 'N' or l_linenumber > 2)")
_sql("sql20_two_columns", "select l_orderkey, l_linenumber, l_suppkey from lineitem where l_linenumber = l_suppkey")
_sql("sql21_compound", "select l_orderkey, l_linenumber, l_partkey from lineitem where (l_partkey > l_suppkey * l_suppkey and l_linenumber < l_suppkey + 10) or (l_linestatus = 'F')")
_sql("sql22_at_most", "select l_orderkey, l_linenumber from lineitem where l_linenumber <= 3 and l_orderkey >= 50")
_sql("sql23_not_equal", "select o_orderkey from orders where o_orderstatus <> 'O' and o_custkey != 3")
_sql("sql30_boolean_order", "select n_nationkey, (n_regionkey = 1) < true as below from nation")
_sql("sql31_timestamp", "select event_id from events where ts > timestamp '2024-01-05T00:00:00Z'", "select event_id from events where ts > timestamp '2024-01-05 00:00:00'")
_sql("sql31_timestamp_offset", "select o_orderkey from orders where o_orderdate >= timestamp '1997-01-01T04:00:00+04:00'", "select o_orderkey from orders where o_orderdate >= timestamp '1997-01-01 00:00:00'")
_sql("sql32_epoch", "select o_orderkey from orders where o_orderdate < to_timestamp(800000000)", "select o_orderkey from orders where o_orderdate < make_timestamp(800000000000000)")
_sql("sql33_binary", "select r_regionkey, 0x0a0b = 0x0a0b as same from region", "select r_regionkey, true as same from region")
# Exact arithmetic.
_sql("sql24_add", "select l_orderkey, l_linenumber, l_quantity + l_tax as r from lineitem", f"select l_orderkey, l_linenumber, cast({_QTY} + {_TAX} as decimal(21,10)) as r from lineitem")
_sql("sql24_arithmetic", "select l_suppkey + l_linenumber as r0, l_suppkey * l_linenumber - 2 as r1, l_returnflag from lineitem where l_linenumber <= l_suppkey and l_linenumber >= 0", "select cast(l_suppkey + l_linenumber as decimal(20,0)) as r0, cast(l_suppkey * l_linenumber - 2 as decimal(31,0)) as r1, l_returnflag from lineitem where l_linenumber <= l_suppkey and l_linenumber >= 0")
_sql("sql25_subtract", "select l_orderkey, l_linenumber, l_extendedprice - l_quantity as r from lineitem", f"select l_orderkey, l_linenumber, cast({_PRICE} - {_QTY} as decimal(21,10)) as r from lineitem")
_sql("sql26_multiply", "select l_orderkey, l_linenumber, l_linenumber * l_discount as r from lineitem", f"select l_orderkey, l_linenumber, cast(cast(l_linenumber as decimal(10,0)) * {_DISC} as decimal(31,10)) as r from lineitem")
_sql("sql27_minus", "select o_orderkey, -o_custkey as r from orders", "select o_orderkey, cast(-o_custkey as decimal(38,0)) as r from orders")
_sql("sql28_casts", "select o_orderkey, (cast(o_orderstatus = $1 as bigint) - cast(o_orderstatus = $2 as bigint)) * o_custkey as balance from orders", "select o_orderkey, cast((cast(o_orderstatus = 'F' as bigint) - cast(o_orderstatus = 'O' as bigint)) * o_custkey as decimal(38,0)) as balance from orders", ("F", "O"))
_sql("sql28_timestamp_cast", "select event_id, cast(ts as bigint) as t from events", "select event_id, cast(epoch_us(ts) as bigint) as t from events")
_sql("sql29_scales", "select l_orderkey, l_linenumber from lineitem where l_discount = 0.05")
_sql("sql29_scales_sum", "select l_orderkey, l_linenumber, l_linenumber + 0.5 as r from lineitem where l_quantity > 10.25", "select l_orderkey, l_linenumber, cast(l_linenumber + 0.5 as decimal(12,1)) as r from lineitem where l_quantity > 10.25")
_sql("sql36_precedence", "select n_nationkey, 2 + 3 * n_nationkey - 1 as r from nation where not n_regionkey = 1 and n_nationkey > 2 or n_nationkey = 0", "select n_nationkey, cast(2 + 3 * n_nationkey - 1 as decimal(33,0)) as r from nation where (not n_regionkey = 1) and n_nationkey > 2 or n_nationkey = 0")
# Expressions over results.
_sql("sql41_compare_results", "select l_returnflag, sum(l_linenumber) > 5000 as many from lineitem group by l_returnflag")
_sql("sql42_integers_over_results", "select o_orderstatus, 2 * count(*) + 1 as r from orders group by o_orderstatus", "select o_orderstatus, cast(2 * count(*) + 1 as bigint) as r from orders group by o_orderstatus")
_sql("sql43_divide_integers", "select l_orderkey, l_linenumber, l_partkey / l_linenumber as r from lineitem", "select l_orderkey, l_linenumber, cast(l_partkey // l_linenumber as bigint) as r from lineitem")
_sql("sql43_divide_decimals", "select l_orderkey, l_linenumber, l_quantity / l_linenumber as r from lineitem", "select l_orderkey, l_linenumber, cast(concat(q // 1000000000000000000000, '.', lpad(cast(q % 1000000000000000000000 as varchar), 21, '0')) as decimal(31,21)) as r from (select *, cast(l_quantity as hugeint) * 1000000000000000000000 // l_linenumber as q from lineitem)")
_sql("sql55_sum_over_count", "select l_returnflag, sum(l_linenumber) / count(*) as r, sum(l_linenumber) as s from lineitem group by l_returnflag", "select l_returnflag, cast(sum(l_linenumber) // count(*) as bigint) as r, cast(sum(l_linenumber) as int) as s from lineitem group by l_returnflag")
# Joins.
_sql("sql44_join", "select n_name, r_name from nation join region on n_regionkey = r_regionkey")
_sql("sql44_join_filtered", "select o_orderkey, c_name, c_acctbal from orders o join customer c on o.o_custkey = c.c_custkey where c_mktsegment = 'BUILDING'", f"select o_orderkey, c_name, {_D.format('c_acctbal')} as c_acctbal from orders join customer on o_custkey = c_custkey where c_mktsegment = 'BUILDING'")
_sql("sql44_join_group", "select c_mktsegment, count(*) as n, sum(l_linenumber) as s from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey group by c_mktsegment", "select c_mktsegment, count(*) as n, cast(sum(l_linenumber) as int) as s from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey group by c_mktsegment")
_sql("sql45_cross", "select n_nationkey, r_regionkey from nation cross join region")
# Aggregates.
_sql("sql48_group_count", "select l_suppkey, count(*) as n from lineitem where (l_linestatus = 'F') and (l_linenumber <= l_suppkey) and (l_suppkey > 0) group by l_suppkey")
_sql("sql48_flagship", "select l_returnflag, sum(l_quantity) as sum_qty, count(*) as n from lineitem where l_discount > 0.05 group by l_returnflag order by l_returnflag", f"select l_returnflag, cast(sum({_QTY}) as decimal(20,10)) as sum_qty, count(*) as n from lineitem where {_DISC} > 0.05 group by l_returnflag")
_sql("sql50_sum_filtered", "select sum(l_partkey) as s from lineitem where l_linenumber = l_suppkey or l_returnflag = 'R'", "select cast(sum(l_partkey) as bigint) as s from lineitem where l_linenumber = l_suppkey or l_returnflag = 'R'")
_sql("sql50_sum_expression", "select l_linestatus, sum(2 * l_linenumber + 1) as s, count(*) as n from lineitem group by l_linestatus", "select l_linestatus, cast(sum(2 * l_linenumber + 1) as decimal(31,0)) as s, count(*) as n from lineitem group by l_linestatus")
_sql("sql51_counts", "select o_orderstatus, count(*) as a, count(o_custkey) as b, count(1) as c from orders group by o_orderstatus")
_sql("sql52_max", "select o_orderpriority, max(o_totalprice) as m, count(*) as n from orders group by o_orderpriority", f"select o_orderpriority, max({_D.format('o_totalprice')}) as m, count(*) as n from orders group by o_orderpriority")
_sql("sql53_min", "select c_nationkey, min(c_acctbal) as m from customer group by c_nationkey", f"select c_nationkey, min({_D.format('c_acctbal')}) as m from customer group by c_nationkey")
_sql("sql54_shared_aggregates", "select o_orderstatus, sum(o_custkey) + 2 as a, sum(o_custkey) * 3 as b from orders group by o_orderstatus", "select o_orderstatus, cast(sum(o_custkey) + 2 as bigint) as a, cast(sum(o_custkey) * 3 as bigint) as b from orders group by o_orderstatus")
_sql("sql56_group_only", "select p_brand, true as listed from part group by p_brand")
_sql("sql57_global", "select sum(l_quantity) as s, max(l_linenumber) as m, count(*) as n from lineitem where l_returnflag = 'A'", f"select cast(sum({_QTY}) as decimal(20,10)) as s, max(l_linenumber) as m, count(*) as n from lineitem where l_returnflag = 'A'")
_sql("sql57_global_none", "select count(*) as n from lineitem where l_linenumber > 100")
_sql("sql59_many_keys", "select l_returnflag, l_linestatus, sum(l_extendedprice * (1 - l_discount)) as revenue, count(*) as n from lineitem group by l_returnflag, l_linestatus", f"select l_returnflag, l_linestatus, cast(sum(cast({_PRICE} * cast(1 - {_DISC} as decimal(18,10)) as decimal(38,20))) as decimal(38,20)) as revenue, count(*) as n from lineitem group by l_returnflag, l_linestatus")
# Order, slices, unions.
_sql("sql61_order", "select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey asc limit 25", f"select o_orderkey, {_D.format('o_totalprice')} as o_totalprice from orders order by 2 desc, 1 limit 25")
_sql("sql63_limit_all", "select n_name from nation order by n_name limit all")
_sql("sql64_offset", "select c_custkey from customer order by c_custkey limit 2 offset 3")
_sql("sql64_offset_from_end", "select o_orderkey from orders order by o_orderkey offset -2", "select o_orderkey from (select o_orderkey from orders order by o_orderkey desc limit 2)")
_sql("sql65_offset_beyond", "select r_name from region order by r_name offset 50")
_sql("sql67_top", "select p_partkey, p_retailprice from part order by p_retailprice desc, p_partkey limit 3", f"select p_partkey, {_D.format('p_retailprice')} as p_retailprice from part order by 2 desc, 1 limit 3")
_sql("sql68_union_all", "select n_name as name, n_nationkey as k from nation union all select r_name as other, r_regionkey as j from region", "select n_name as name, n_nationkey as k from nation union all select r_name, r_regionkey from region")
_sql("sql68_union_no_table", "select 'Ada' as name, 13 as age union all select 'Max' as name, 2 as age", "select 'Ada' as name, cast(13 as bigint) as age union all select 'Max', cast(2 as bigint)")


# Operators beyond the dialect.
@_frame("sql46_key_union", "select n_regionkey as k from nation union select r_regionkey from region")
def key_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.key_union(_read(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("k")), _read(spark, sf_dir, "region").select(F.col("r_regionkey").alias("k")), "k")


@_frame("sql47_multiplicity", "select c_custkey as k, count(o_custkey) as multiplicity from customer left join orders on c_custkey = o_custkey group by c_custkey")
def multiplicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = _read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")).distinct()
    return R.multiplicities(keys, _read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k")), "k")


@_frame("sql44_join_operator", "select l_orderkey as k, l_linenumber, o_custkey from lineitem join orders on l_orderkey = o_orderkey")
def join_operator(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = _read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), "l_linenumber")
    return R.join_inner(left, _read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "k", "o_orderkey")


@_frame("sql66_slice_join", "select o_orderkey, c_name from orders join customer on o_custkey = c_custkey order by o_orderkey limit 3 offset 2")
def slice_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = R.join_inner(_read(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey")), _read(spark, sf_dir, "customer").select("c_custkey", "c_name"), "c_custkey", "c_custkey")
    return R.sliced(R.ordered(joined.select("o_orderkey", "c_name"), (("o_orderkey", True),)), 2, 3)


@_frame("sql69_digest")
def table_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _engine(spark, sf_dir, "select * from orders")
    df, schema = e.catalog.get("orders")
    return column_digests(R.with_row_index(df, ["o_orderkey"]), schema, "rho")


@_frame("sql69_digest_rows", "select count(*) as n, min(o_orderkey) as o_orderkey_least, max(o_orderkey) as o_orderkey_greatest, min(o_custkey) as o_custkey_least, max(o_custkey) as o_custkey_greatest, true as repeats from orders")
def digest_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can say of the digest, and whether rows laid out anew and in another order give the same one."""
    e = _engine(spark, sf_dir, "select * from orders")
    df, schema = e.catalog.get("orders")
    one = column_digests(R.with_row_index(df, ["o_orderkey"]), schema, "rho").first()
    again = column_digests(R.with_row_index(df.repartition(7, "o_custkey"), ["o_orderkey"]), schema, "rho")
    same = F.lit(again.first() == one)
    return again.select("n", *(f"{c}_{b}" for c in ("o_orderkey", "o_custkey") for b in ("least", "greatest")), same.alias("repeats"))


def _parts(spark: SparkSession, sf_dir: str, first: int) -> tuple[Engine, list[str]]:
    """Orders as a whole and cut after the first rows, with the tail's rows numbered on."""
    e = _engine(spark, sf_dir, "select * from orders")
    df, schema = e.catalog.get("orders")
    numbered = R.with_row_index(df, ["o_orderkey"], "__rho")
    e.catalog.add("head", numbered.filter(F.col("__rho") < first).drop("__rho"), schema)
    e.catalog.add("tail", numbered.filter(F.col("__rho") >= first).drop("__rho"), schema)
    e.catalog.update_offset("tail", first)
    return e, list(schema)


def _algebra(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, "first_row long, end_row long, o_orderkey_least long, o_orderkey_greatest long, kind string, same boolean")


def _summary(d, kind: str, same: bool) -> tuple:
    b = d.columns["o_orderkey"][2]
    return d.start, d.end, b.least, b.greatest, kind, same


_ORDERS = "from (select o_orderkey, row_number() over (order by o_orderkey) as k from orders)"


@_frame("sql70_append_digest", f"select 0::bigint as first_row, count(*) as end_row, min(o_orderkey) as o_orderkey_least, max(o_orderkey) as o_orderkey_greatest, 'sharp' as kind, true as same {_ORDERS}")
def appended_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, _ = _parts(spark, sf_dir, 500)
    whole, both = e.catalog.digest("orders", ["o_orderkey"]), e.catalog.digest("head", ["o_orderkey"]).add(e.catalog.digest("tail", ["o_orderkey"]))
    return _algebra(spark, [_summary(both, both.columns["o_orderkey"][2].kind, both == whole)])


@_frame("sql71_extend_digest", f"select 0::bigint as first_row, count(*) as end_row, min(o_orderkey) as o_orderkey_least, max(o_orderkey) as o_orderkey_greatest, 'sharp' as kind, true as same {_ORDERS}")
def extended_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _engine(spark, sf_dir, "select * from orders")
    df, schema = e.catalog.get("orders")
    names = list(schema)
    numbered = R.with_row_index(df, ["o_orderkey"])
    left, right = ({c: schema[c] for c in part} for part in (names[:2], names[2:]))
    both = digest(numbered, left).extend(digest(numbered, right))
    return _algebra(spark, [_summary(both, "sharp", both == digest(numbered, schema))])


@_frame("sql72_subtract_digest", f"select 0::bigint as first_row, 500::bigint as end_row, min(o_orderkey) as o_orderkey_least, max(o_orderkey) as o_orderkey_greatest, 'bounded' as kind, true as same {_ORDERS}")
def subtracted_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, names = _parts(spark, sf_dir, 500)
    head, rest = e.catalog.digest("head", ["o_orderkey"]), e.catalog.digest("orders", ["o_orderkey"]).subtract(e.catalog.digest("tail", ["o_orderkey"]))
    return _algebra(spark, [_summary(rest, rest.columns["o_orderkey"][2].kind, all(head.columns[c][1] == rest.columns[c][1] for c in names))])


@_frame("sql73_bounds", "select min(o_orderkey) as o_orderkey_least, max(o_orderkey) as o_orderkey_greatest, min(o_orderdate) as o_orderdate_least, max(o_orderdate) as o_orderdate_greatest from orders")
def column_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bounds(_read(spark, sf_dir, "orders"), ["o_orderkey", "o_orderdate"])


@_frame("sql74_result_hash")
def hashed_result(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _engine(spark, sf_dir, _SQL["sql48_flagship"][0])
    return spark.createDataFrame([(result_hash(e.sql(_SQL["sql48_flagship"][0])),)], "hash string")


@_frame("sql74_result_hash_checks", "select 64 as digits, true as order_free, true as sees_change")
def checked_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _read(spark, sf_dir, "orders")
    h = result_hash(df)
    changed = df.withColumn("o_custkey", F.when(F.col("o_orderkey") == 1, -1).otherwise(F.col("o_custkey")))
    return spark.createDataFrame([(len(h), h == result_hash(df.repartition(5, "o_custkey").orderBy("o_orderdate")), h != result_hash(changed))], "digits int, order_free boolean, sees_change boolean")


@_frame("sql75_tables", "select unnest(['lineitem', 'orders', 'customer']) as name")
def referenced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(t,) for t in table_names(_SQL["sql44_join_group"][0])], "name string")


_LINE = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate"


@_frame("sql76_row_index", f"select *, cast(row_number() over (order by {_LINE}) - 1 as decimal(38,0)) as rho from lineitem")
def row_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.with_row_index(_read(spark, sf_dir, "lineitem"), _LINE.split(", "))


_LINE = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate"


@_frame("sql76_row_index", f"select *, cast(row_number() over (order by {_LINE}) - 1 as decimal(38,0)) as rho from lineitem")
def row_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.with_row_index(_read(spark, sf_dir, "lineitem"), _LINE.split(", "))


@_frame("sql77_gather", "select n_name from (select n_name, n_regionkey, row_number() over (order by n_nationkey) - 1 as rho from nation) n join region on rho = r_regionkey * 2")
def gathered(spark: SparkSession, sf_dir: str) -> DataFrame:
    indexed = R.with_row_index(_read(spark, sf_dir, "nation").select("n_nationkey", "n_name"), ["n_nationkey"])
    return R.gather(indexed, _read(spark, sf_dir, "region").select((F.col("r_regionkey") * 2).cast("decimal(38,0)").alias("rho"))).select("n_name")


@_frame("sql79_declared", "select n_nationkey as k, n_name as name from nation")
def declared(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _read(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("bigint").alias("k"), F.col("n_name").alias("name"))
    return R.coerced(df, {"k": S.INT, "name": S.VARCHAR})


@_frame("sql80_catalog", "select t.name, c.column_name, c.place, t.first_row from (select unnest(['a.nation', 'nation']) as name, unnest([0, 7]) as first_row) t cross join (select unnest(['n_nationkey', 'n_name']) as column_name, unnest([0, 1]) as place) c")
def catalog_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = Engine(spark)
    nation = _read(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    e.catalog.add("a.nation", nation)
    e.catalog.add("nation", nation, offset=3)
    e.catalog.update_offset("nation", 7)
    return spark.createDataFrame([(t, c, k, e.catalog.offset(t)) for t in e.catalog.tables for k, c in enumerate(e.catalog.columns(t))], "name string, column_name string, place int, first_row int")


@_frame("sql39_display_names", """select o_orderstatus, cast(sum(o_custkey) as bigint) as "SUM(orders.o_custkey)", count(*) as "COUNT(Int64(1))", cast(sum(o_custkey) * 2 as bigint) as "SUM(orders.o_custkey) * Int64(2)" from orders group by o_orderstatus""")
def display_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = Engine(spark, sorted_groups=False, display_names=True)
    e.catalog.add_parquet("orders", f"{sf_dir}/orders.parquet")
    return e.sql("select o_orderstatus, sum(o_custkey), count(*), sum(o_custkey) * 2 from orders group by o_orderstatus")


@_frame("sql57_strict_empty", "select count(*) as n, cast(sum(l_linenumber) as int) as s from lineitem where l_linenumber > 100 having count(*) > 0")
def strict_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = Engine(spark, strict_empty=True)
    e.catalog.add_parquet("lineitem", f"{sf_dir}/lineitem.parquet")
    return e.sql("select count(*) as n, sum(l_linenumber) as s from lineitem where l_linenumber > 100")


@_frame("sql09_database", "select c_custkey, c_name from customer where c_custkey > 40 and c_nationkey = 3")
def database(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The CSV database: create, append in two parts, query."""
    folder = scratch_folder(spark)
    rows = _read(spark, sf_dir, "customer").select(F.col("c_custkey").cast("bigint").alias("c_custkey"), "c_name", F.col("c_nationkey").cast("bigint").alias("c_nationkey"))
    db = Database(spark, f"{folder}/db")
    db.create("customer", "c_custkey bigint, c_name varchar, c_nationkey bigint")
    for k in range(2):
        append_csv(rows.filter(F.col("c_custkey") % 2 == k), f"{folder}/part{k}")
        db.append("customer", f"{folder}/part{k}")
    query = "select c_custkey, c_name from customer where c_custkey > 40 and c_nationkey = 3"
    if not db.verify(db.run(query, 10)):
        raise AssertionError("the same query over the same tables has another hash")
    return db.engine(query).sql(query)


@_frame("sql04_arrow", "select r_regionkey, r_name from region")
def arrow_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, _ = from_arrow(configure(spark), pq.read_table(f"{sf_dir}/region.parquet", columns=["r_regionkey", "r_name"]))
    table: pa.Table = to_arrow(df)
    return from_arrow(spark, table)[0]


@_frame("sql06_csv", f"select c_custkey, c_name, {_D.format('c_acctbal')} as c_acctbal from customer")
def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{scratch_folder(spark)}/csv"
    append_csv(_read(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal"), folder)
    return read_csv(spark, folder)


@_frame("sql10_random")
def random_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = {"a": S.BIGINT, "b": S.TINYINT, "c": S.VARCHAR, "d": S.BOOLEAN, "e": S.decimal(12, 2), "f": S.timestamp("s"), "g": S.VARBINARY, "h": S.UINT8}
    return random_table(configure(spark), kinds, 1000)


@_frame("sql10_random_bounds", "select 1000::bigint as n, true as repeats, true as within, true as spread, 10 as longest")
def random_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same seed gives the same rows, numbers lie within their bound and strings within ten characters."""
    kinds = {"a": S.BIGINT, "b": S.TINYINT, "c": S.VARCHAR}
    one, again, other = (random_table(configure(spark), kinds, 1000, 50, seed) for seed in (1, 1, 2))
    r = one.agg(F.count(F.lit(1)).alias("n"), F.min("a").alias("lo"), F.max("a").alias("hi"), F.count_distinct("a").alias("values"), F.max(F.char_length("c")).alias("longest")).first()
    repeats = result_hash(one) == result_hash(again) != result_hash(other)
    return spark.createDataFrame([(r["n"], repeats, -50 <= r["lo"] <= r["hi"] <= 50, r["values"] > 80, r["longest"])], "n long, repeats boolean, within boolean, spread boolean, longest int")


@_frame("sql_wide_products", "select o_orderkey, cast(cast(o_orderkey as hugeint) * o_custkey * 1000000000000000000000000 as varchar) as r from orders")
def wide_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = wide.from_number(_read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "a", F.col("o_orderkey"))
    df = wide.from_text(wide.from_number(df, "b", F.col("o_custkey")), "c", F.lit("1" + "0" * 24))
    return wide.to_text(wide.multiply(wide.multiply(df, "d", "a", "b"), "e", "d", "c"), "r", "e").select("o_orderkey", "r")


@_frame("sql_wide_sum", "select o_orderstatus, cast(sum(cast(o_orderkey as hugeint) * 1000000000000000000000000) as varchar) as r from orders group by o_orderstatus")
def wide_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = wide.from_number(_read(spark, sf_dir, "orders").select("o_orderstatus", "o_orderkey"), "a", F.col("o_orderkey"))
    df = wide.multiply(wide.from_text(df, "b", F.lit("1" + "0" * 24)), "w", "a", "b")
    return wide.to_text(wide.total(df, ["o_orderstatus"], "s", "w"), "r", "s").select("o_orderstatus", "r")


@_frame("sql_stream_append", "select event_id, user_id, event_type from events")
def stream_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_folder(spark)
    schema = _read(spark, sf_dir, "events").select("event_id", "user_id", "event_type").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet*").parquet(sf_dir)
    append_stream(stream, f"{folder}/table", f"{folder}/state").awaitTermination()
    rows = table(spark, f"{folder}/table")
    if digests(spark, f"{folder}/table") != current_digests(rows):
        raise AssertionError("the table and its digests differ")
    return rows


def run(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    text, params, _ = _SQL[name]
    return _engine(spark, sf_dir, text).sql(text, *params)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def of(name: str) -> Callable[[SparkSession, str], DataFrame]:
        return lambda spark, sf_dir: run(name, spark, sf_dir)

    return {n: of(n) for n in _SQL} | {n: f for n, (f, _) in _FRAMES.items()}


def oracle_sql() -> dict[str, str]:
    return {n: o for n, (_, _, o) in _SQL.items() if o} | {n: o for n, (_, o) in _FRAMES.items() if o}
