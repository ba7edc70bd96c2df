"""One query for each operator of the keyed engine, and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keystrata.functions import codecs, exact
from keystrata.functions.types import ColumnDef, ColumnType, EngineError, half_even, truncate_time, truncate_timestamp
from keystrata.operators import access, dml, partition, versions
from keystrata.operators.access import Condition
from keystrata.operators.partition import MAX, MIN, Part, RangeRule
from keystrata.procs import seckill, tpcc, vote
from keystrata.sources import csv_copy, kv
from keystrata.sources.catalog import Catalog, TableDef

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None):
    def add(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            SQL[fn.__name__] = sql
        return fn

    return add


def t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# --- scans and predicates ----------------------------------------------------------------------------------------------
@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def full_scan(spark, sf):
    return t(spark, sf, "nation").select("n_nationkey", "n_name", "n_regionkey")


@query("SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderkey = 42")
def point_read(spark, sf):
    return access.point(t(spark, sf, "orders"), {"o_orderkey": 42}, ["o_orderkey", "o_custkey", "o_orderstatus"])


@query("SELECT conv_id, turn, role FROM conversations WHERE conv_id = 3")
def key_prefix_read(spark, sf):
    return access.prefix(t(spark, sf, "conversations"), ("conv_id", "turn"), (3,), ["conv_id", "turn", "role"])


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey >= 100 AND o_orderkey <= 500")
def key_range_incl(spark, sf):
    return access.key_range(t(spark, sf, "orders"), "o_orderkey", 100, 500).select("o_orderkey", "o_totalprice")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey > 100 AND o_orderkey < 500")
def key_range_excl(spark, sf):
    return access.key_range(t(spark, sf, "orders"), "o_orderkey", 100, 500, False, False).select("o_orderkey", "o_totalprice")


@query("SELECT conv_id, turn, role FROM conversations WHERE conv_id = 3 AND turn >= 1")
def key_prefix_range(spark, sf):
    own = [Condition("conv_id", "=", 3), Condition("turn", ">=", 1)]
    return access.where_all(t(spark, sf, "conversations"), own).select("conv_id", "turn", "role")


@query("SELECT p_partkey, p_size FROM part WHERE p_size >= 20 AND p_brand = 'Brand#12' AND p_retailprice < 1500")
def residual_filter(spark, sf):
    own = [Condition("p_size", ">=", 20), Condition("p_brand", "=", "Brand#12"), Condition("p_retailprice", "<", 1500.0)]
    return access.where_all(t(spark, sf, "part"), own).select("p_partkey", "p_size")


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus != 'F'")
def residual_ne(spark, sf):
    return access.where_all(t(spark, sf, "orders"), [Condition("o_orderstatus", "!=", "F")]).select("o_orderkey", "o_orderstatus")


@query("SELECT p_partkey FROM (SELECT p_partkey, NULLIF(p_size, 10) AS s FROM part) WHERE s != 11")
def null_residual(spark, sf):
    return access.where_all(t(spark, sf, "part").withColumn("s", F.nullif("p_size", F.lit(10))), [Condition("s", "!=", 11)]).select("p_partkey")


@query("SELECT p_partkey FROM part WHERE p_size = NULL")
def null_comparison(spark, sf):
    return access.where_all(t(spark, sf, "part"), [Condition("p_size", "=", None)]).select("p_partkey")


@query("SELECT c_name AS name, c_custkey AS id, c_name AS again FROM customer")
def projection_alias(spark, sf):
    return t(spark, sf, "customer").select(F.col("c_name").alias("name"), F.col("c_custkey").alias("id"), F.col("c_name").alias("again"))


@query("SELECT n_nationkey FROM nation WHERE 7 > n_nationkey")
def literal_first_compare(spark, sf):
    return access.where_all(t(spark, sf, "nation"), [Condition("n_nationkey", access.MIRROR[">"], 7)]).select("n_nationkey")


@query("SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
def select_distinct(spark, sf):
    return t(spark, sf, "orders").select("o_orderstatus", "o_orderpriority").distinct()


@query("SELECT e.event_id, e.event_type FROM events e WHERE e.user_id = 7 AND e.value > 10.0")
def parameter_query(spark, sf):
    t(spark, sf, "events").createOrReplaceTempView("ks_events")
    return spark.sql("SELECT event_id, event_type FROM ks_events WHERE user_id = ? AND value > ?", args=[7, 10.0])


@query("SELECT min(o_orderkey) AS first_key, max(o_orderkey) AS last_key FROM orders")
def ordered_ends(spark, sf):
    ends = access.ends(t(spark, sf, "orders").select("o_orderkey"), ["o_orderkey"])
    return ends.select(F.col("first.o_orderkey").alias("first_key"), F.col("last.o_orderkey").alias("last_key"))


# --- aggregates --------------------------------------------------------------------------------------------------------
@query("SELECT count(*) AS n FROM lineitem")
def count_star(spark, sf):
    return exact.aggregate(t(spark, sf, "lineitem"), [("count", None, "n")])


@query("SELECT count(s) AS n FROM (SELECT NULLIF(p_size, 10) AS s FROM part)")
def count_col(spark, sf):
    return exact.aggregate(t(spark, sf, "part").select(F.nullif("p_size", F.lit(10)).alias("s")), [("count", "s", "n")])


@query("SELECT CAST(sum(p_size) AS BIGINT) AS total, CAST(sum(p_partkey) AS BIGINT) AS keys FROM part")
def sum_int(spark, sf):
    return exact.aggregate(t(spark, sf, "part"), [("sum", "p_size", "total"), ("sum", "p_partkey", "keys")])


@query("SELECT CAST(CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DECIMAL(18,2)) AS VARCHAR) AS total FROM orders")
def sum_numeric(spark, sf):
    return exact.aggregate(t(spark, sf, "orders").select(F.col("o_totalprice").cast("decimal(18,2)").alias("p")), [("sum", "p", "total")]).select(F.col("total").cast("string"))


@query(
    "SELECT CAST(CAST((q + CASE WHEN 2 * r > n OR (2 * r = n AND q % 2 = 1) THEN 1 ELSE 0 END) AS DECIMAL(30,0)) * CAST(0.000001 AS DECIMAL(7,6)) AS VARCHAR) AS mean FROM (SELECT sum(p_size) * 1000000 // count(p_size) AS q, sum(p_size) * 1000000 % count(p_size) AS r, count(p_size) AS n FROM part)"
)
def avg_int(spark, sf):
    return exact.aggregate(t(spark, sf, "part"), [("avg", "p_size", "mean")]).select(F.col("mean").cast("string"))


@query(
    "SELECT CAST(CAST(CAST((q + CASE WHEN 2 * r > n OR (2 * r = n AND q % 2 = 1) THEN 1 ELSE 0 END) AS DECIMAL(28,0)) * CAST(0.00000001 AS DECIMAL(9,8)) AS DECIMAL(18,8)) AS VARCHAR) AS mean FROM (SELECT s // n AS q, s % n AS r, n FROM (SELECT CAST(sum(CAST(p_retailprice AS DECIMAL(18,2))) * 100 AS HUGEINT) * 1000000 AS s, count(*) AS n FROM part))"
)
def avg_numeric(spark, sf):
    return exact.aggregate(t(spark, sf, "part").select(F.col("p_retailprice").cast("decimal(18,2)").alias("p")), [("avg", "p", "mean")]).select(F.col("mean").cast("string"))


@query("SELECT round(sum(o_totalprice), 2) AS total FROM orders")
def sum_float(spark, sf):
    return exact.aggregate(t(spark, sf, "orders"), [("sum", "o_totalprice", "total")]).select(F.round("total", 2).alias("total"))


@query("SELECT round(avg(s_acctbal), 6) AS mean FROM supplier")
def avg_float(spark, sf):
    return exact.aggregate(t(spark, sf, "supplier"), [("avg", "s_acctbal", "mean")]).select(F.round("mean", 6).alias("mean"))


@query("SELECT min(s) AS low, max(s) AS high, min(p_name) AS first_name, max(p_retailprice) AS dearest FROM (SELECT *, NULLIF(p_size, 1) AS s FROM part)")
def min_max(spark, sf):
    return exact.aggregate(t(spark, sf, "part").withColumn("s", F.nullif("p_size", F.lit(1))), [("min", "s", "low"), ("max", "s", "high"), ("min", "p_name", "first_name"), ("max", "p_retailprice", "dearest")])


@query("SELECT count(*) AS n, CAST(sum(l_linenumber) AS BIGINT) AS lines, min(l_quantity) AS low, max(l_quantity) AS high FROM lineitem WHERE l_returnflag = 'R'")
def multi_agg(spark, sf):
    rows = access.where_all(t(spark, sf, "lineitem"), [Condition("l_returnflag", "=", "R")])
    return exact.aggregate(rows, [("count", None, "n"), ("sum", "l_linenumber", "lines"), ("min", "l_quantity", "low"), ("max", "l_quantity", "high")])


@query("SELECT count(*) AS n, CAST(sum(p_size) AS BIGINT) AS total, min(p_size) AS low FROM part WHERE p_size < 0")
def agg_empty_input(spark, sf):
    return exact.aggregate(access.where_all(t(spark, sf, "part"), [Condition("p_size", "<", 0)]), [("count", None, "n"), ("sum", "p_size", "total"), ("min", "p_size", "low")])


@query("SELECT count(*) AS n FROM conversations WHERE conv_id = 3 AND role = 'user'")
def agg_prefix_residual(spark, sf):
    return exact.aggregate(access.where_all(t(spark, sf, "conversations"), [Condition("conv_id", "=", 3), Condition("role", "=", "user")]), [("count", None, "n")])


# --- writes ------------------------------------------------------------------------------------------------------------
@query("SELECT p_partkey, p_name, p_size FROM part UNION ALL SELECT p_partkey + 10000000, p_name, p_size + 1 FROM part WHERE p_size > 25")
def insert_rows(spark, sf):
    base = t(spark, sf, "part").select("p_partkey", "p_name", "p_size")
    new = base.where("p_size > 25").select((F.col("p_partkey") + 10_000_000).alias("p_partkey"), "p_name", (F.col("p_size") + 1).alias("p_size"))
    return dml.insert(base, new, ("p_partkey",), check=False)


@query("SELECT p_partkey FROM part WHERE p_size > 25")
def insert_duplicate_reject(spark, sf):
    base = t(spark, sf, "part").select("p_partkey", "p_size")
    new = base.select(F.when(F.col("p_size") > 25, F.col("p_partkey")).otherwise(F.col("p_partkey") + 10_000_000).alias("p_partkey"), "p_size")
    return dml.conflicts(base, new, ("p_partkey",))


@query("SELECT p_partkey, CASE WHEN p_partkey = 77 THEN 'renamed' ELSE p_name END AS p_name, CAST(CASE WHEN p_partkey = 77 THEN 99 ELSE p_size END AS INTEGER) AS p_size FROM part")
def update_absolute(spark, sf):
    return dml.update(t(spark, sf, "part").select("p_partkey", "p_name", "p_size"), {"p_partkey": 77}, {"p_name": "renamed", "p_size": 99})


@query("SELECT p_partkey, CAST(CASE WHEN p_partkey = 77 THEN p_size + 5 - 2 ELSE p_size END AS INTEGER) AS p_size FROM part")
def update_delta(spark, sf):
    return dml.update(t(spark, sf, "part").select("p_partkey", "p_size"), {"p_partkey": 77}, deltas=[dml.Delta("p_size", "add", 5), dml.Delta("p_size", "sub", 2)])


@query("SELECT p_partkey, CAST(p_size + coalesce(d, 0) AS BIGINT) AS p_size FROM part LEFT JOIN (SELECT l_partkey, CAST(sum(l_linenumber) AS BIGINT) AS d FROM lineitem GROUP BY l_partkey) ON p_partkey = l_partkey")
def delta_fold(spark, sf):
    base = t(spark, sf, "part").select("p_partkey", F.col("p_size").cast("long").alias("p_size"))
    deltas = t(spark, sf, "lineitem").select(F.col("l_partkey").alias("p_partkey"), F.col("l_linenumber").alias("amount"))
    return dml.fold_deltas(base, deltas, ("p_partkey",), "p_size")


@query(
    "SELECT p_partkey, CAST(((p_size + 10 - 10 - coalesce(d, 0)) % 91 + 91) % 91 + 10 AS BIGINT) AS quantity FROM part LEFT JOIN (SELECT l_partkey, CAST(sum(l_linenumber) AS BIGINT) AS d FROM lineitem GROUP BY l_partkey) ON p_partkey = l_partkey"
)
def sub_wrap(spark, sf):
    base = t(spark, sf, "part").select("p_partkey", (F.col("p_size") + 10).cast("long").alias("quantity"))
    deltas = t(spark, sf, "lineitem").select(F.col("l_partkey").alias("p_partkey"), F.col("l_linenumber").alias("amount"))
    return dml.fold_sub_wrap(base, deltas, ("p_partkey",), "quantity", 10, 91)


@query("SELECT conv_id, turn, role FROM conversations WHERE NOT (conv_id = 3 AND turn = 1)")
def delete_key(spark, sf):
    return dml.delete(t(spark, sf, "conversations").select("conv_id", "turn", "role"), {"conv_id": 3, "turn": 1})


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderpriority NOT LIKE '1%'")
def delete_many(spark, sf):
    o = t(spark, sf, "orders")
    return dml.delete_many(o.select("o_orderkey", "o_orderstatus"), o.where("o_orderpriority like '1%'").select("o_orderkey"), ("o_orderkey",))


@query("SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'new' ELSE p_name END AS p_name FROM part")
def update_many(spark, sf):
    base = t(spark, sf, "part").select("p_partkey", "p_name", "p_size")
    return dml.update_many(base.drop("p_size"), base.where("p_size % 3 = 0").select("p_partkey", F.lit("new").alias("p_name")), ("p_partkey",))


@query("SELECT c_custkey, CASE WHEN c_nationkey = 3 THEN 'moved' ELSE c_name END AS c_name FROM customer UNION ALL SELECT c_custkey + 10000000, 'added' FROM customer WHERE c_nationkey = 4")
def upsert(spark, sf):
    c = t(spark, sf, "customer")
    new = c.where("c_nationkey = 3").select("c_custkey", F.lit("moved").alias("c_name")).union(c.where("c_nationkey = 4").select(F.col("c_custkey") + 10_000_000, F.lit("added")))
    return dml.upsert(c.select("c_custkey", "c_name"), new, ("c_custkey",))


# --- versions ----------------------------------------------------------------------------------------------------------
@query("SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 1 THEN 'X' ELSE o_orderstatus END AS o_orderstatus FROM orders WHERE o_orderkey % 5 != 0")
def overlay_merge(spark, sf):
    base = t(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    gone = base.where("o_orderkey % 5 = 0").withColumn("op", F.lit(versions.DELETE))
    put = base.where("o_orderkey % 5 = 1").select("o_orderkey", F.lit("X").alias("o_orderstatus"), F.lit(versions.PUT).alias("op"))
    return versions.overlay(base, gone.unionByName(put), ("o_orderkey",))


@query(
    "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS k FROM events WHERE event_id <= 5000) WHERE k = 1 AND event_type != 'view'"
)
def mvcc_visible(spark, sf):
    e = t(spark, sf, "events")
    log = e.select("user_id", "event_id", "event_type", F.col("event_id").alias("xid"), F.when(F.col("event_type") == "view", versions.DELETE).otherwise(versions.PUT).alias("op"))
    return versions.visible(log, ("user_id",), 5000)


# --- partitions --------------------------------------------------------------------------------------------------------
ORDERS_RULE = RangeRule("r_orders", ("o_orderkey",), (Part("p0", (MIN,), (1000,)), Part("p1", (1000,), (2000,)), Part("p2", (2000,), (MAX,))))
TALK_RULE = RangeRule("r_talk", ("conv_id", "turn"), (Part("a", (MIN, MIN), (10, 2)), Part("b", (10, 2), (50, MIN)), Part("c", (50, MIN), (MAX, MAX))))


@query("SELECT CASE WHEN o_orderkey < 1000 THEN 'p0' WHEN o_orderkey < 2000 THEN 'p1' ELSE 'p2' END AS part_id, count(*) AS n FROM orders GROUP BY 1")
def partition_route(spark, sf):
    o = partition.with_partition(t(spark, sf, "orders").select("o_orderkey"), ORDERS_RULE, ["o_orderkey"])
    return o.groupBy("part_id").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT CASE WHEN (conv_id, turn) < (10, 2) THEN 'a' WHEN conv_id < 50 THEN 'b' ELSE 'c' END AS part_id, count(*) AS n FROM conversations GROUP BY 1")
def partition_route_composite(spark, sf):
    c = partition.with_partition(t(spark, sf, "conversations").select("conv_id", "turn"), TALK_RULE, ["conv_id", "turn"])
    return c.groupBy("part_id").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey < 2000")
def partition_prune(spark, sf):
    names = ORDERS_RULE.prune((500,), (1000,), True, True)  # p1 starts at the inclusive limit
    return partition.scan_partitions(t(spark, sf, "orders"), ORDERS_RULE, ["o_orderkey"], names).select("o_orderkey", "o_custkey")


@query("SELECT o_orderkey, CASE WHEN o_orderkey < 1000 THEN 'p0' ELSE 'p2' END AS part_id FROM orders WHERE o_orderkey < 1000 OR o_orderkey >= 2000")
def partition_scan_union(spark, sf):
    o = t(spark, sf, "orders").select("o_orderkey")
    parts = [partition.scan_partitions(o, ORDERS_RULE, ["o_orderkey"], [p]).withColumn("part_id", F.lit(p)) for p in ("p0", "p2")]
    return parts[0].unionByName(parts[1])


# --- key/value, CSV, codecs --------------------------------------------------------------------------------------------
def _events_kv(spark, sf):
    return t(spark, sf, "events").select(F.format_string("k%08d", "event_id").cast("binary").alias("key"), F.col("event_type").cast("binary").alias("value"))


@query("SELECT printf('k%08d', event_id) AS k, event_type AS v FROM events WHERE event_id >= 120 AND event_id < 480")
def kv_range(spark, sf):
    return kv.scan(_events_kv(spark, sf), b"k00000120", b"k00000480", ordered=False).select(F.col("key").cast("string").alias("k"), F.col("value").cast("string").alias("v"))


@query("SELECT event_type AS v FROM events WHERE event_id = 250")
def kv_get(spark, sf):
    return kv.get(_events_kv(spark, sf), b"k00000250").select(F.col("value").cast("string").alias("v"))


@query("SELECT printf('k%08d', event_id) AS k, CASE WHEN event_id >= 2900 THEN 'new' ELSE event_type END AS v FROM events WHERE event_id NOT BETWEEN 10 AND 19")
def kv_put_delete(spark, sf):
    rows = _events_kv(spark, sf)
    new = kv.scan(rows, b"k00002900", ordered=False).select("key", F.lit("new").cast("binary").alias("value"))
    left = kv.delete(kv.put(rows, new), kv.scan(rows, b"k00000010", b"k00000020", ordered=False))
    return left.select(F.col("key").cast("string").alias("k"), F.col("value").cast("string").alias("v"))


def _def(name: str, key: tuple[str, ...], *columns: tuple[str, ColumnType]) -> TableDef:
    return TableDef(name, tuple(ColumnDef(n, kind, n not in key) for n, kind in columns), key)


@query("SELECT p_partkey, p_name, p_size, CAST(CAST(p_retailprice AS DECIMAL(12,2)) AS VARCHAR) AS price FROM part")
def copy_roundtrip(spark, sf):
    from keystrata.sources.scratch import scratch

    table = _def("part_copy", ("p_partkey",), ("p_partkey", ColumnType("i64")), ("p_name", ColumnType("string")), ("p_size", ColumnType("i32")), ("price", ColumnType("numeric", (12, 2))))
    path = scratch(spark, "copy")
    csv_copy.copy_to(t(spark, sf, "part").select("p_partkey", "p_name", "p_size", F.col("p_retailprice").cast("decimal(12,2)").alias("price")), table, path, single=False)
    return csv_copy.copy_from(spark, table, path).withColumn("price", F.col("price").cast("string"))


@query("SELECT r_regionkey, r_name FROM region")
def json_roundtrip(spark, sf):
    r = t(spark, sf, "region").select("r_regionkey", "r_name")
    return codecs.rows_from_json(codecs.rows_to_json(r), r.schema)


@query("SELECT '\"' || r_name || '\"' AS name, CAST(r_regionkey AS VARCHAR) AS id FROM region")
def textual_format(spark, sf):
    return t(spark, sf, "region").select(codecs.to_text(F.col("r_name"), T.StringType()).alias("name"), codecs.to_text(F.col("r_regionkey"), T.IntegerType()).alias("id"))


@query("SELECT l_orderkey, l_partkey, l_linenumber, CAST(CAST(round_even(CAST(l_linenumber AS DECIMAL(12,3)) * 0.125, 2) AS DECIMAL(12,2)) AS VARCHAR) AS x FROM lineitem")
def numeric_half_even(spark, sf):
    x = F.col("l_linenumber").cast("decimal(12,3)") * F.lit("0.125").cast("decimal(4,3)")
    return t(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", half_even(x, 12, 2).cast("string").alias("x"))


@query("SELECT event_id, (event_id * 1234567 - 5000000) - (((event_id * 1234567 - 5000000) % 1000) + 1000) % 1000 AS micros, date_trunc('second', ts) AS at_second FROM events")
def temporal_truncate(spark, sf):
    e = t(spark, sf, "events")
    return e.select("event_id", truncate_time(F.col("event_id") * 1234567 - 5000000, 3).alias("micros"), truncate_timestamp(F.col("ts"), 0).cast("timestamp_ntz").alias("at_second"))


@query("SELECT * FROM (VALUES ('part', 'p_partkey', 'i64', false, 0), ('part', 'p_name', 'string', true, -1)) v(table_name, column_name, family, nullable, key_position)")
def catalog_scan(spark, sf):
    catalog = Catalog()
    catalog.create(_def("part", ("p_partkey",), ("p_partkey", ColumnType("i64")), ("p_name", ColumnType("string"))))
    return catalog.table_rows(spark).fillna(-1, ["key_position"])


@query("SELECT 10 AS size, '3456' AS piece, '012345AB89' AS changed, '' AS beyond")
def object_read(spark, sf):
    """A file of an object: its size, a piece of it, the whole after a write at an offset, and what lies beyond its end."""
    from keystrata.sources.objects import Objects, new_id
    from keystrata.sources.scratch import scratch

    o, key = Objects(spark, scratch(spark, "objects")), new_id()
    o.write(key, "d/a.bin", b"0123456789")
    size, part = o.readdir(key, "d")[0][2], o.pread(key, "d/a.bin", 3, 4).decode()
    o.pwrite(key, "d/a.bin", 6, b"AB")
    return spark.createDataFrame([(size, part, o.pread(key, "d/a.bin").decode(), o.pread(key, "d/a.bin", 99, 5).decode())], "size int, piece string, changed string, beyond string")


# --- procedures as sets ------------------------------------------------------------------------------------------------
@query("SELECT count(*) AS n FROM lineitem WHERE l_orderkey = 1 AND l_quantity < 30")
def stock_level(spark, sf):
    return exact.aggregate(access.where_all(t(spark, sf, "lineitem"), [Condition("l_orderkey", "=", 1), Condition("l_quantity", "<", 30.0)]), [("count", None, "n")])


@query("SELECT o_custkey % 10 AS no_w_id, o_custkey % 100 AS no_d_id, min(o_orderkey) AS no_o_id FROM orders WHERE o_orderstatus = 'O' GROUP BY 1, 2")
def delivery_min_order(spark, sf):
    o = t(spark, sf, "orders").where("o_orderstatus = 'O'")
    return tpcc.pending_set(o.select((F.col("o_custkey") % 10).alias("no_w_id"), (F.col("o_custkey") % 100).alias("no_d_id"), F.col("o_orderkey").alias("no_o_id")))


def _payments(spark, sf):
    return t(spark, sf, "orders").select((F.col("o_custkey") % 5).alias("w_id"), (F.col("o_custkey") % 10).alias("d_id"), F.col("o_custkey").alias("c_id"), (F.col("o_orderkey") % 900 + 1).alias("amount"))


@query(
    "WITH p AS (SELECT o_custkey AS c, count(*) AS n, CAST(sum(o_orderkey % 900 + 1) AS DECIMAL(12,2)) AS a FROM orders GROUP BY 1) "
    "SELECT c_custkey AS c_id, CAST(CAST(CAST(c_acctbal AS DECIMAL(12,2)) - coalesce(a, 0) AS DECIMAL(12,2)) AS VARCHAR) AS c_balance, CAST(CAST(coalesce(a, 0) AS DECIMAL(12,2)) AS VARCHAR) AS c_ytd_payment, CAST(coalesce(n, 0) AS INTEGER) AS c_payment_cnt FROM customer LEFT JOIN p ON c_custkey = c"
)
def payment_fold(spark, sf):
    zero = F.lit(0).cast("decimal(12,2)")
    c = t(spark, sf, "customer").select((F.col("c_custkey") % 5).alias("c_w_id"), (F.col("c_custkey") % 10).alias("c_d_id"), F.col("c_custkey").alias("c_id"), F.col("c_acctbal").cast("decimal(12,2)").alias("c_balance"), zero.alias("c_ytd_payment"), F.lit(0).alias("c_payment_cnt"))
    d = c.select(F.col("c_w_id").alias("d_w_id"), F.col("c_d_id").alias("d_id"), zero.alias("d_ytd")).distinct()
    w = c.select(F.col("c_w_id").alias("w_id"), zero.alias("w_ytd")).distinct()
    return tpcc.payment_set(c, d, w, _payments(spark, sf))[0].select("c_id", F.col("c_balance").cast("string"), F.col("c_ytd_payment").cast("string"), "c_payment_cnt")


@query("SELECT c_custkey AS c_id, o_orderstatus AS o_status FROM (SELECT c_custkey, max(o_orderkey) AS k FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY 1) JOIN orders ON k = o_orderkey")
def order_status(spark, sf):
    o = t(spark, sf, "orders").select(F.lit(1).alias("o_w_id"), F.lit(1).alias("o_d_id"), F.col("o_orderkey").alias("o_id"), F.col("o_orderstatus").alias("o_status"), F.col("o_custkey").alias("c"))
    last = o.groupBy(F.col("c").alias("c_id")).agg(F.max("o_id").alias("c_last_order_id"))
    customer = t(spark, sf, "customer").select(F.lit(1).alias("c_w_id"), F.lit(1).alias("c_d_id"), F.col("c_custkey").alias("c_id")).join(last, "c_id", "left")
    return tpcc.order_status_set(customer, o).select("c_id", "o_status")


@query("SELECT o_orderkey AS xid, CAST(1000 + row_number() OVER (PARTITION BY o_custkey % 10 ORDER BY o_orderkey) - 1 AS INTEGER) AS o_id FROM orders")
def new_order_ids(spark, sf):
    requests = t(spark, sf, "orders").select(F.lit(1).alias("d_w_id"), (F.col("o_custkey") % 10).alias("d_id"), F.col("o_orderkey").alias("xid"))
    district = requests.select("d_w_id", "d_id").distinct().withColumn("d_next_o_id", F.lit(1000))
    return tpcc.number_orders(requests, district).select("xid", "o_id")


@query("SELECT event_id AS xid, CASE WHEN row_number() OVER (PARTITION BY user_id % 50 ORDER BY event_id) <= 20 THEN 'ok' ELSE 'sold_out' END AS result FROM events")
def seckill_buy(spark, sf):
    requests = t(spark, sf, "events").select((F.col("user_id") % 50).alias("si_id"), F.col("event_id").alias("xid"))
    return seckill.buy_set(requests.select("si_id").distinct().withColumn("si_stock", F.lit(20)), requests).select("xid", "result")


@query("SELECT o_custkey % 7 AS vote_id, l_linenumber AS option_id, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus != 'F' GROUP BY 1, 2")
def vote_join(spark, sf):
    actions = t(spark, sf, "orders").select(F.col("o_orderkey").alias("action_id"), (F.col("o_custkey") % 7).alias("vote_id"), F.when(F.col("o_orderstatus") == "F", 1).otherwise(0).alias("is_withdrawn"))
    choices = t(spark, sf, "lineitem").select(F.col("l_orderkey").alias("action_id"), F.col("l_linenumber").alias("option_id"))
    return vote.results(choices, actions)


@query("SELECT o_orderkey, o_custkey, o_totalprice, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_custkey = 17")
def vote_history_join(spark, sf):
    o = access.where_all(t(spark, sf, "orders"), [Condition("o_custkey", "=", 17)])
    return o.join(t(spark, sf, "customer"), o["o_custkey"] == F.col("c_custkey")).select("o_orderkey", "o_custkey", "o_totalprice", "c_name")


# --- the whole engine: statements in a session -------------------------------------------------------------------------
@query(
    "SELECT p_partkey, CASE WHEN p_partkey = 5 THEN 'five' ELSE p_name END AS p_name, CAST(CASE WHEN p_partkey = 6 THEN p_size + 4 ELSE p_size END AS INTEGER) AS p_size FROM part WHERE p_partkey != 7 UNION ALL SELECT 99999999, 'added', 1"
)
def session_script(spark, sf):
    from keystrata.plans.engine import Engine
    from keystrata.sources.scratch import scratch

    s = Engine(spark, scratch(spark, "engine")).session()
    s.execute("CREATE TABLE part (p_partkey BIGINT PRIMARY KEY, p_name TEXT, p_size INT)")
    s.insert_frame("part", t(spark, sf, "part").select("p_partkey", "p_name", "p_size"))
    s.begin()
    s.execute("UPDATE part SET p_name = ? WHERE p_partkey = ?", ("five", 5))
    s.execute("UPDATE part SET p_size = p_size + 4 WHERE p_partkey = 6")
    s.execute("DELETE FROM part WHERE p_partkey = 7")
    s.execute("INSERT INTO part (p_partkey, p_name, p_size) VALUES (99999999, 'added', 1)")
    s.commit()
    return s.query("SELECT p_partkey, p_name, p_size FROM part")


@query("SELECT c_mktsegment, count(*) AS n, round(max(c_acctbal), 2) AS top FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 1 GROUP BY c_mktsegment HAVING count(*) > 1")
def general_sql(spark, sf):
    """Beyond keyed statements: joins, grouping and the rest are Spark SQL over the session's tables."""
    from keystrata.plans.engine import Engine
    from keystrata.sources.scratch import scratch

    s = Engine(spark, scratch(spark, "engine")).session()
    s.batch("CREATE TABLE customer (c_custkey BIGINT PRIMARY KEY, c_nationkey INT, c_acctbal DOUBLE, c_mktsegment TEXT); CREATE TABLE nation (n_nationkey INT PRIMARY KEY, n_regionkey INT)")
    s.insert_frame("customer", t(spark, sf, "customer"))
    s.insert_frame("nation", t(spark, sf, "nation"))
    return s.query("SELECT c_mktsegment, count(*) AS n, round(max(c_acctbal), 2) AS top FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = ? GROUP BY c_mktsegment HAVING count(*) > 1 ORDER BY 1", (1,))


# --- reads through statements ------------------------------------------------------------------------------------------
_databases: dict[tuple[str, str], object] = {}

SCHEMA = """
CREATE PARTITION RULE r_orders RANGE (o_orderkey) (PARTITION p0 VALUES FROM (MINVALUE) TO (1000), PARTITION p1 VALUES FROM (1000) TO (2000), PARTITION p2 VALUES FROM (2000) TO (MAXVALUE));
CREATE TABLE orders (o_orderkey BIGINT PRIMARY KEY, o_custkey BIGINT, o_orderstatus TEXT, o_totalprice DOUBLE, o_orderpriority TEXT) PARTITION BY GLOBAL RULE r_orders REFERENCES (o_orderkey);
CREATE TABLE customer (c_custkey BIGINT PRIMARY KEY, c_name TEXT, c_nationkey INT, c_acctbal DOUBLE, c_mktsegment TEXT);
CREATE TABLE nation (n_nationkey INT PRIMARY KEY, n_name TEXT, n_regionkey INT);
CREATE TABLE region (r_regionkey INT PRIMARY KEY, r_name TEXT);
CREATE TABLE part (p_partkey BIGINT PRIMARY KEY, p_name TEXT, p_brand TEXT, p_size INT, p_retailprice DOUBLE);
CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role TEXT, PRIMARY KEY (conv_id, turn));
"""


def _db(spark, sf):
    """A session over the driver's tables, whole, as engine tables; loaded once for an application and folder."""
    from keystrata.plans.engine import Engine
    from keystrata.sources.scratch import scratch

    at = spark.sparkContext.applicationId, sf
    if at not in _databases:
        engine = Engine(spark, scratch(spark, "tables"))
        s = engine.session()
        s.batch(SCHEMA)
        for name in ("orders", "customer", "nation", "region", "part", "conversations"):
            s.insert_frame(name, t(spark, sf, name))
        _databases[at] = engine
    return _databases[at].session()


def _empty(spark, script=""):
    """A session over an engine with nothing but what a script makes."""
    from keystrata.plans.engine import Engine
    from keystrata.sources.scratch import scratch

    s = Engine(spark, scratch(spark, "engine")).session()
    if script:
        s.batch(script)
    return s


def statement(name: str, text: str, args: tuple = (), sql: str | None = None, ordered: bool = False, doc: str = ""):
    """Register a query that runs one statement through a session; sql: for DuckDB, where it differs from the text."""

    def run(spark, sf):
        return _db(spark, sf).query(text, args, ordered)

    run.__name__, run.__doc__ = name, doc or text
    query(sql or text)(run)


statement("engine_point_read", "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderkey = ?", (1042,), "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderkey = 1042")
statement("engine_prefix_read", "SELECT conv_id, turn, role FROM conversations WHERE conv_id = $1", (3,), "SELECT conv_id, turn, role FROM conversations WHERE conv_id = 3")
statement("engine_prefix_range", "SELECT conv_id, turn, role FROM conversations WHERE conv_id = 3 AND turn > 1")
statement("engine_partition_prune", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey >= 1500 AND o_orderkey < 2100")
statement("engine_full_scan", "SELECT o_orderkey, o_orderstatus FROM orders")
statement("engine_select_star", "SELECT * FROM nation")
statement("engine_key_not_equal", "SELECT n_nationkey, n_name FROM nation WHERE n_nationkey != 7")
statement("engine_residual", "SELECT p_partkey FROM part WHERE p_size >= 20 AND p_brand = 'Brand#12' AND 1500 > p_retailprice")
statement("engine_parentheses", "SELECT p_partkey FROM part WHERE (p_size >= 20 AND (p_size < 30)) AND (p_partkey > 100)")
statement("engine_or_in_like", "SELECT p_partkey FROM part WHERE p_size IN (1, 5, 7) OR p_size BETWEEN 40 AND 42 OR (p_brand LIKE 'Brand#1%' AND p_name IS NOT NULL AND NOT p_size < 25)")
statement("engine_column_to_column", "SELECT n_nationkey FROM nation WHERE n_nationkey > n_regionkey * 6")
statement("engine_arithmetic", "SELECT p_partkey, p_size * 2 + 1 AS twice, p_partkey % 7 AS rest FROM part WHERE p_size - 3 > 40")
statement("engine_distinct", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
statement("engine_qualified_names", "SELECT public.nation.n_name AS name, nation.n_nationkey AS id FROM public.nation WHERE nation.n_regionkey = 2", sql="SELECT n_name AS name, n_nationkey AS id FROM nation WHERE n_regionkey = 2")
statement("engine_aggregates", "SELECT COUNT(*) AS n, COUNT(p_name) AS named, SUM(p_size) AS total, MIN(p_size) AS low, MAX(p_size) AS high FROM part WHERE p_partkey < 500", sql="SELECT count(*) AS n, count(p_name) AS named, CAST(sum(p_size) AS BIGINT) AS total, min(p_size) AS low, max(p_size) AS high FROM part WHERE p_partkey < 500")
statement("engine_mixed_aggregate", "SELECT o_orderstatus, count(*) AS n, min(o_orderkey) AS first_key FROM orders GROUP BY o_orderstatus")
statement("engine_having", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 12")
statement("engine_cube", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
statement("engine_rollup", "SELECT n_regionkey, n_nationkey, count(*) AS n FROM nation GROUP BY ROLLUP (n_regionkey, n_nationkey)")
statement("engine_filter_distinct", "SELECT count(DISTINCT o_custkey) AS buyers, count(*) FILTER (WHERE o_orderstatus = 'F') AS finished, count(DISTINCT o_orderstatus) FILTER (WHERE o_custkey > 50) AS kinds FROM orders")
statement("engine_inner_join", "SELECT o.o_orderkey, c.c_name FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey WHERE c.c_nationkey = 3")
statement("engine_left_join", "SELECT c.c_custkey, o.o_orderkey FROM customer c LEFT JOIN orders o ON o.o_custkey = c.c_custkey AND o.o_orderstatus = 'F' WHERE c.c_nationkey = 5")
statement("engine_full_join", "SELECT r.r_name, n.n_name FROM region r FULL JOIN nation n ON r.r_regionkey = n.n_regionkey AND n.n_nationkey > 12")
statement("engine_cross_join", "SELECT r.r_name, n.n_name FROM region r CROSS JOIN nation n WHERE n.n_nationkey < 3")
statement("engine_lateral_join", "SELECT r.r_name, x.n FROM region r, LATERAL (SELECT count(*) AS n FROM nation n WHERE n.n_regionkey = r.r_regionkey) x")
statement("engine_semi_anti_join", "SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'F') AND c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)")
statement("engine_window_rank", "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS before FROM orders", sql="SELECT o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS INTEGER) AS k, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS before FROM orders")
statement("engine_window_frame", "SELECT n_nationkey, sum(n_nationkey) OVER (PARTITION BY n_regionkey ORDER BY n_nationkey ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) AS near FROM nation", sql="SELECT n_nationkey, CAST(sum(n_nationkey) OVER (PARTITION BY n_regionkey ORDER BY n_nationkey ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) AS BIGINT) AS near FROM nation")
statement("engine_union", "SELECT n_regionkey AS k FROM nation UNION SELECT r_regionkey + 3 FROM region UNION ALL SELECT 99")
statement("engine_intersect_except", "(SELECT o_custkey AS k FROM orders INTERSECT SELECT c_custkey FROM customer) EXCEPT SELECT c_custkey FROM customer WHERE c_nationkey = 2")
statement("engine_case_cast", "SELECT p_partkey, CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'middle' ELSE 'large' END AS kind, COALESCE(NULLIF(p_size, 7), -1) AS size, CAST(p_partkey AS VARCHAR(20)) AS text, CAST(p_retailprice AS DECIMAL(12,2)) > 1200 AS dear FROM part")
statement("engine_subquery", "WITH top AS (SELECT o_custkey, max(o_totalprice) AS most FROM orders GROUP BY o_custkey) SELECT c_custkey, most FROM top JOIN customer ON c_custkey = o_custkey WHERE most > (SELECT avg(o_totalprice) FROM orders)")
statement("engine_order_limit", "SELECT o_orderkey, o_custkey FROM orders ORDER BY o_custkey DESC, o_orderkey LIMIT 20")


@query("SELECT o_orderkey, CAST(row_number() OVER (ORDER BY o_orderkey) - 1 AS BIGINT) AS place FROM orders ORDER BY o_orderkey LIMIT 25")
def engine_key_order(spark, sf):
    """The first rows of a scan in key order (which is the order of the partitions, too), with their places."""
    rows = _db(spark, sf).query("SELECT o_orderkey FROM orders", ordered=True).limit(25).collect()
    return spark.createDataFrame([(r.o_orderkey, i) for i, r in enumerate(rows)], "o_orderkey long, place long")


@query("SELECT o_orderkey, CASE WHEN o_orderkey < 1000 THEN 'p0' WHEN o_orderkey < 2000 THEN 'p1' ELSE 'p2' END AS part_id, CAST(row_number() OVER (ORDER BY o_orderkey) - 1 AS BIGINT) AS place FROM orders WHERE o_orderkey BETWEEN 990 AND 1010")
def partition_order(spark, sf):
    """Rows on both sides of a partition's bound, in the order of the partitions and the key."""
    o = partition.with_partition(t(spark, sf, "orders").select("o_orderkey").where("o_orderkey between 990 and 1010"), ORDERS_RULE, ["o_orderkey"])
    rows = partition.ordered_scan(o, ORDERS_RULE, ["o_orderkey"], ["o_orderkey"]).collect()
    return spark.createDataFrame([(r.o_orderkey, r.part_id, i) for i, r in enumerate(rows)], "o_orderkey long, part_id string, place long")


@query("SELECT printf('k%08d', event_id) AS k, CAST(row_number() OVER (ORDER BY event_id) - 1 AS BIGINT) AS place FROM events WHERE event_id >= 100 AND event_id < 130")
def kv_order(spark, sf):
    """A range of keys in byte order, with their places."""
    rows = kv.scan(_events_kv(spark, sf), b"k00000100", b"k00000130").collect()
    return spark.createDataFrame([(bytes(r.key).decode(), i) for i, r in enumerate(rows)], "k string, place long")


@query("SELECT 'path key; key [(''o_orderkey'', ''='')]; residual [(''o_orderstatus'', ''='')]' AS head, true AS pushed, true AS one_partition")
def engine_explain(spark, sf):
    """The head of a plan's text: the access path; and that the key reaches the scan, of one partition's folder."""
    plan = _db(spark, sf).one("EXPLAIN SELECT o_custkey FROM orders WHERE o_orderkey = 42 AND o_orderstatus = 'F'").plan
    return spark.createDataFrame([(plan.split("\n")[0], "EqualTo(o_orderkey,42)" in plan, "part_id" in plan and "p0" in plan)], "head string, pushed boolean, one_partition boolean")


@query("SELECT low, o_orderkey FROM orders JOIN (VALUES (0), (999), (1000), (1999), (2000), (14000)) v(low) ON o_orderkey BETWEEN low AND low + 1")
def engine_partition_bounds(spark, sf):
    """Reads on both sides of every partition's bound, each of the partitions that its range leaves."""
    s, out = _db(spark, sf), None
    for low in (0, 999, 1000, 1999, 2000, 14_000):
        some = s.query("SELECT o_orderkey FROM orders WHERE o_orderkey >= ? AND o_orderkey <= ?", (low, low + 1)).select(F.lit(low).alias("low"), "o_orderkey")
        out = some if out is None else out.union(some)
    return out


@query("SELECT * FROM (VALUES ('r', 0, 'p0', '(''MINVALUE'',)', '(5,)'), ('r', 1, 'p1', '(5,)', '(''MAXVALUE'',)')) v(rule, position, partition, start_bound, end_bound)")
def engine_partition_rules(spark, sf):
    s = _empty(spark, "CREATE PARTITION RULE r RANGE (a) (PARTITION p0 VALUES FROM (MINVALUE) TO (5), PARTITION p1 VALUES FROM (5) TO (MAXVALUE))")
    return s.catalog().rule_rows(spark)


@query("SELECT * FROM (VALUES ('r', 'p0', 3), ('r', 'p1', 4)) v(rule, partition, worker)")
def engine_placement(spark, sf):
    s = _empty(spark, "CREATE PARTITION RULE r RANGE (a) (PARTITION p0 VALUES FROM (MINVALUE) TO (5), PARTITION p1 VALUES FROM (5) TO (MAXVALUE)); CREATE PARTITION PLACEMENT FOR RULE r (PARTITION p0 ON WORKER 3, PARTITION p1 ON WORKER 4)")
    return s.catalog().placement_rows(spark)


@query("SELECT * FROM (VALUES ('doc', 'file'), ('box', 'directory')) v(name, kind)")
def engine_file_types(spark, sf):
    s = _empty(spark, "CREATE TYPE doc FILESYSTEM FILE; CREATE TYPE box FILESYSTEM DIRECTORY; CREATE TYPE gone FILESYSTEM FILE; DROP TYPE gone")
    return s.catalog().fs_type_rows(spark)


@query("SELECT 32 AS id_length, 'abcXYf' AS content, false AS after_update, false AS after_delete")
def engine_file_hooks(spark, sf):
    """A column of a file type gets an object; a new value or a deleted row takes the old object away."""
    s = _empty(spark, "CREATE TYPE doc FILESYSTEM FILE; CREATE TABLE f (id INT PRIMARY KEY, body doc); INSERT INTO f (id) VALUES (1)")
    first = s.one("SELECT body FROM f WHERE id = 1").body
    s.fs_write(first, "text", b"abcdef")
    s.fs_write(first, "text", b"XY", offset=3)
    content = s.fs_read(first, "text").decode()
    s.execute("UPDATE f SET body = NULL WHERE id = 1")
    second = s.one("SELECT body FROM f WHERE id = 1").body
    s.fs_write(second, "text", b"new")
    s.execute("DELETE FROM f WHERE id = 1")
    there = []
    for key in (first, second):
        try:
            s.fs_read(key, "text")
            there.append(True)
        except EngineError:
            there.append(False)
    return spark.createDataFrame([(len(first), content, *there)], "id_length int, content string, after_update boolean, after_delete boolean")


@query("SELECT * FROM (VALUES ('b', 'k', 'i32')) v(table_name, column_name, family)")
def engine_create_drop(spark, sf):
    s = _empty(spark, "CREATE TABLE a (k INT PRIMARY KEY); CREATE TABLE b (k INT PRIMARY KEY); CREATE TABLE IF NOT EXISTS b (k INT PRIMARY KEY); DROP TABLE a; DROP TABLE IF EXISTS a")
    return s.catalog().table_rows(spark).select("table_name", "column_name", "family")


@query("SELECT * FROM (VALUES ('id', 'integer', 0), ('name', 'string', 1), ('price', 'decimal(12,2)', 2)) v(name, type, place)")
def engine_describe(spark, sf):
    s = _empty(spark, "CREATE TABLE d (id INT PRIMARY KEY, name TEXT, price NUMERIC(12,2))")
    fields = s.describe("SELECT id, name, price FROM d WHERE id = ?").fields
    return spark.createDataFrame([(f.name, "integer" if f.dataType.simpleString() == "int" else f.dataType.simpleString(), i) for i, f in enumerate(fields)], "name string, type string, place int")


@query("SELECT p_partkey, CASE WHEN p_partkey = 3 THEN 'three' ELSE p_name END AS p_name, CAST(CASE WHEN p_partkey = 4 THEN p_size + 5 ELSE p_size END AS INTEGER) AS p_size FROM part WHERE p_partkey != 5 UNION ALL SELECT 99999999, 'typed', 8")
def engine_typed_rows(spark, sf):
    """The typed row interface: insert, absolute values, increments, delete; and a restart from what was committed."""
    from keystrata.plans.engine import Engine

    s = _empty(spark, "CREATE TABLE part (p_partkey BIGINT PRIMARY KEY, p_name TEXT, p_size INT)")
    s.insert_frame("part", t(spark, sf, "part"))
    s.relation_insert("part", {"p_partkey": 99999999, "p_name": "typed", "p_size": 8})
    s.relation_update("part", {"p_partkey": 3}, {"p_name": "three"})
    s.relation_update("part", {"p_partkey": 4}, deltas=[dml.Delta("p_size", "add", 7), dml.Delta("p_size", "sub", 2)])
    s.relation_delete("part", {"p_partkey": 5})
    return Engine(spark, s.engine.storage.root).session().query("SELECT p_partkey, p_name, p_size FROM part")


@query("SELECT * FROM (VALUES (1, 107, 'a'), (2, 20, 'theirs'), (3, 30, 'mine'), (4, 40, 'd')) v(id, v, note)")
def engine_concurrent_sessions(spark, sf):
    """Two sessions commit changes of different keys, increments of one key commute, and a second writer of a key fails."""
    s = _empty(spark, "CREATE TABLE t (id INT PRIMARY KEY, v INT, note TEXT); INSERT INTO t VALUES (1, 100, 'a'), (2, 20, 'b'), (3, 30, 'c'), (4, 40, 'd')")
    other, third = s.engine.session(), s.engine.session()
    for x in (s, third):
        x.begin()
    s.execute("UPDATE t SET v = v + 5 WHERE id = 1")
    other.execute("UPDATE t SET v = v + 2 WHERE id = 1")
    other.execute("UPDATE t SET note = 'theirs' WHERE id = 2")
    s.commit()
    third.execute("UPDATE t SET note = 'late' WHERE id = 2")
    try:
        third.commit()
    except EngineError:
        s.execute("UPDATE t SET note = 'mine' WHERE id = 3")
    return s.query("SELECT id, v, note FROM t")


@query("SELECT id, v FROM (VALUES (1, 10), (2, 20)) t(id, v)")
def engine_rollback(spark, sf):
    s = _empty(spark, "CREATE TABLE t (id INT PRIMARY KEY, v INT); INSERT INTO t VALUES (1, 10), (2, 20)")
    s.execute("BEGIN")
    s.execute("UPDATE t SET v = 0 WHERE id = 1")
    s.execute("DELETE FROM t WHERE id = 2")
    s.execute("INSERT INTO t VALUES (3, 30)")
    s.execute("ROLLBACK")
    return s.query("SELECT id, v FROM t")


@query("SELECT 'order=1;lines=2;qty=15;amount=33;all_local=false;status=NEW' AS placed, 'NEW' AS status, '-50.00' AS balance, 'delivered order=1 carrier=7' AS delivered, 'DELIVERED' AS later")
def procedure_invoke(spark, sf):
    """A package is installed, and its procedures called by name, each in a transaction of its own."""
    s = _empty(spark)
    s.engine.install(tpcc)
    call = lambda name, *args: s.engine.invoke("tpcc", "tpcc", name, *args)
    call("seed", 2, 1, 1, 2, 50)
    placed, status = call("new_order", 1, 1, 1, [1, 2], [1, 2], [12, 3]), call("order_status", 1, 1, 1)
    balance = str(call("payment", 1, 1, 1, 50))
    return spark.createDataFrame([(placed, status, balance, call("delivery", 1, 1, 7), call("order_status", 1, 1, 1))], "placed string, status string, balance string, delivered string, later string")


@query("SELECT event_type AS v, count(*) AS n FROM events WHERE event_id < 700 GROUP BY 1")
def engine_key_value(spark, sf):
    """A session's key/value data: put as a frame, a key deleted and put again, and read as a range."""
    s = _empty(spark)
    s.put_frame(_events_kv(spark, sf))
    old = s.get(b"k00000010")
    s.delete(b"k00000010")
    if s.get(b"k00000010") is None:
        s.put(b"k00000010", old)
    return s.range(b"", b"k00000700").groupBy(F.col("value").cast("string").alias("v")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT p_partkey, CAST(CAST(CAST(p_retailprice AS DECIMAL(20,8)) + coalesce(d, 0) AS DECIMAL(20,8)) AS VARCHAR) AS price FROM part LEFT JOIN (SELECT l_partkey, sum(l_linenumber * CAST(0.00000001 AS DECIMAL(9,8))) AS d FROM lineitem GROUP BY l_partkey) ON p_partkey = l_partkey")
def delta_fold_numeric(spark, sf):
    """Increments of the eighth decimal place."""
    base = t(spark, sf, "part").select("p_partkey", F.col("p_retailprice").cast("decimal(20,8)").alias("price"))
    deltas = t(spark, sf, "lineitem").select(F.col("l_partkey").alias("p_partkey"), (F.col("l_linenumber") * F.lit("0.00000001").cast("decimal(9,8)")).alias("amount"))
    return dml.fold_deltas(base, deltas, ("p_partkey",), "price").withColumn("price", F.col("price").cast("string"))


@query("SELECT p_partkey FROM part WHERE p_partkey != 7")
def key_not_equal(spark, sf):
    return access.where_all(t(spark, sf, "part"), [Condition("p_partkey", "!=", 7)]).select("p_partkey")


@query("SELECT 'r_name' AS name, 'string' AS type UNION ALL SELECT 'r_regionkey', 'int'")
def schema_probe(spark, sf):
    s = _db(spark, sf)
    return spark.createDataFrame([(f.name, f.dataType.simpleString()) for f in s.describe("SELECT * FROM region").fields], "name string, type string")


@query("SELECT p_partkey, p_name, p_size FROM part WHERE p_size > 25")
def foreign_roundtrip(spark, sf):
    """A table of another database, written over JDBC and read in parallel pieces, the filter done by that database."""
    from keystrata.sources import foreign
    from keystrata.sources.scratch import scratch

    url = f"derby:///{scratch(spark, 'derby').removeprefix('file:').lstrip('/')}"
    rows = t(spark, sf, "part").select("p_partkey", "p_name", "p_size")
    foreign.write(rows, url, "part_copy", connections=2)
    low, top = rows.agg(F.min("p_partkey"), F.max("p_partkey")).first()
    return foreign.read(spark, url, "part_copy", split=None if top is None else ("p_partkey", low, top, 4)).where("p_size > 25")


@query("SELECT k, price, day, moment, CAST(ratio AS DOUBLE) AS ratio FROM (VALUES (1, '2.34', '2024-01-02', '2024-01-02 03:04:05.987', 3.0), (2, '-0.50', '1999-12-31', '1999-12-31 23:59:59.000', 0.25)) v(k, price, day, moment, ratio)")
def engine_implicit_casts(spark, sf):
    """Literals are fitted to their columns: rounded half to even, parsed, cut to the column's precision."""
    s = _empty(spark, "CREATE TABLE c (k INT PRIMARY KEY, price NUMERIC(9,2), day DATE, moment TIMESTAMP(3), ratio DOUBLE); INSERT INTO c VALUES (1, '2.345', '2024-01-02', '2024-01-02T03:04:05.987654', 3), (2, -0.5, '1999-12-31', '1999-12-31T23:59:59', 0.25)")
    return s.query("SELECT k, price, day, moment, ratio FROM c").select("k", F.col("price").cast("string").alias("price"), F.col("day").cast("string").alias("day"), F.date_format("moment", "yyyy-MM-dd HH:mm:ss.SSS").alias("moment"), "ratio")


@query("SELECT 1 AS k, 0 AS n, '' AS t, '0.00' AS d, CAST(NULL AS INTEGER) AS free")
def engine_type_defaults(spark, sf):
    """Where the engine is told to, NOT NULL columns that an INSERT leaves out take the default of their type."""
    from keystrata.plans.engine import Engine
    from keystrata.sources.scratch import scratch

    s = Engine(spark, scratch(spark, "defaults"), compat=frozenset({"default_for_not_null"})).session()
    s.batch("CREATE TABLE d (k INT PRIMARY KEY, n INT NOT NULL, t TEXT NOT NULL, d NUMERIC(9,2) NOT NULL, free INT); INSERT INTO d (k) VALUES (1)")
    return s.query("SELECT k, n, t, d, free FROM d").withColumn("d", F.col("d").cast("string"))


@query("SELECT k, c.c_name AS name FROM (VALUES (0, 3), (1, 5), (2, 8)) v(k, id) JOIN customer c ON c.c_custkey = v.id")
def engine_prepared(spark, sf):
    """One template, bound three times."""
    p = _db(spark, sf).prepare("SELECT c_name FROM customer WHERE c_custkey = $1")
    rows = [(k, p.bind(i).query().first().c_name) for k, i in enumerate((3, 5, 8))]
    return spark.createDataFrame(rows, "k int, name string")


@query("SELECT * FROM (VALUES (1, 30, 'ada'), (2, 15, 'bob')) v(user_id, balance, name)")
def wallet_transfers(spark, sf):
    from keystrata.procs import wallet

    s = _empty(spark)
    s.engine.install(wallet)
    call = lambda name, *args: s.engine.invoke("wallet", "wallet", name, *args)
    for user, name in ((1, "ada"), (2, "bob"), (3, "cyd")):
        call("create_user", user, name, f"{name}@example.org")
    call("deposit", 1, 50)
    call("transfer", 1, 2, 20)
    call("withdraw", 2, 5)
    call("delete_user", 3)
    try:
        call("purchase", 2, 99, 1)
    except (EngineError, TypeError):
        pass
    return s.query("SELECT w.user_id, w.balance, u.name FROM wallets w JOIN wallet_users u ON w.user_id = u.user_id")


@query("SELECT 'v1+more' AS changed, 'user:a=v1+more,user:b=v2' AS listed, false AS gone_found, 'kv_insert,kv_read,kv_read_modify_write,kv_scan,kv_update' AS procedures")
def key_value_procedures(spark, sf):
    """The key/value package: insert, read-modify-write, a scan of a range, and a key that is not there."""
    from keystrata.procs.ycsb import KV

    s = _empty(spark)
    names = s.engine.install(KV)
    call = lambda name, *args: s.engine.invoke("kv", "kv", f"kv_{name}", *args)
    for k, v in (("a", "v1"), ("b", "v2"), ("d", "v4")):
        call("insert", k, v)
    changed = call("read_modify_write", "a", "+more")
    try:
        call("update", "x", "1")
        found = True
    except EngineError:
        found = False
    return spark.createDataFrame([(changed, ",".join(call("scan", "a", "c")), found, ",".join(names))], "changed string, listed string, gone_found boolean, procedures string")


@query("SELECT n_nationkey AS id, n_name AS label FROM nation WHERE n_regionkey = 2")
def engine_entities(spark, sf):
    """Rows as objects of a class and back."""
    import dataclasses

    @dataclasses.dataclass
    class Nation:
        n_nationkey: int
        n_name: str
        n_regionkey: int

    own = _db(spark, sf).entities("nation", Nation, {"n_regionkey": 2})
    s = _empty(spark, "CREATE TABLE copy (n_nationkey INT PRIMARY KEY, n_name TEXT, n_regionkey INT)")
    s.begin()
    for x in own:
        s.put_entity("copy", x)
    s.commit()
    return s.query("SELECT n_nationkey AS id, n_name AS label FROM copy")


@query("SELECT true AS there, false AS other")
def key_exists(spark, sf):
    rows = _events_kv(spark, sf)
    return spark.createDataFrame([(kv.exists(rows, b"k00000007"), kv.exists(rows, b"nothing"))], "there boolean, other boolean")


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def engine_copy_statements(spark, sf):
    """COPY of a table to a file and from it into another."""
    from keystrata.sources.scratch import scratch

    s, path = _empty(spark, "CREATE TABLE a (n_nationkey INT PRIMARY KEY, n_name TEXT, n_regionkey INT); CREATE TABLE b (n_nationkey INT PRIMARY KEY, n_name TEXT, n_regionkey INT)"), scratch(spark, "copy")
    s.insert_frame("a", t(spark, sf, "nation"))
    s.execute(f"COPY a TO '{path}'")
    s.execute(f"COPY b FROM '{path}'")
    return s.query("SELECT * FROM b")
