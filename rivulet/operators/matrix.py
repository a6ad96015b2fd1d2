"""A query for each operator, and the SQL that gives the same rows.

Every query fills its tables with nine tenths of the rows, creates its view, and
then applies two batches: the other tenth comes and every seventh row goes; then
those come back.  So the view ends on the whole tables, having seen inserts and
deletes, and must equal plain SQL over them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rivulet.engine import Engine
from rivulet.functions import zset as Z
from rivulet.plans.nodes import Grouping, Node, Recursive, Table

KEYS = {"orders": "o_orderkey", "lineitem": "l_orderkey", "customer": "c_custkey", "part": "p_partkey", "supplier": "s_suppkey", "nation": "n_nationkey", "region": "r_regionkey", "events": "event_id"}

CENTS = "CAST(round(l_extendedprice * 100) AS BIGINT)"
PRICE = "CAST(round(o_totalprice * 100) AS BIGINT)"
VALUE = "CAST(round(value * 100) AS BIGINT)"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def started(spark: SparkSession, sf_dir: str, tables) -> Engine:
    e = Engine(spark)
    for t in tables:
        e.track(t, read(spark, sf_dir, t).where(F.pmod(KEYS[t], F.lit(10)) != 0))
    return e


def batches(e: Engine, spark: SparkSession, sf_dir: str, tables) -> None:
    come, go = {}, {}
    for t in tables:
        df = read(spark, sf_dir, t)
        late, seventh = F.pmod(KEYS[t], F.lit(10)) == 0, F.pmod(KEYS[t], F.lit(7)) == 0
        come[t] = Z.plus(Z.weighted(df.where(late)), Z.weighted(df.where(seventh & ~late), -1))
        go[t] = Z.weighted(df.where(seventh & ~late))
    e.apply_batch(come)
    e.apply_batch(go)


def maintained(tables: tuple[str, ...], *views: tuple[str, Callable[[Engine], Node] | str]) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        e = started(spark, sf_dir, tables)
        for name, plan in views:
            e.create_view(name, plan if isinstance(plan, str) else plan(e))
        batches(e, spark, sf_dir, tables)
        return e.query(views[-1][0])

    return query


T = Table
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def add(name: str, tables: tuple[str, ...], plan, sql: str, *before) -> None:
    QUERIES[name] = maintained(tables, *before, ("v", plan))
    SQL[name] = sql


def _same(name: str, tables: tuple[str, ...], sql: str) -> None:
    """A view given in SQL that both engines read alike."""
    add(name, tables, sql, sql)


REVENUE = """SELECT o_orderpriority, CAST(SUM(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS revenue, COUNT(*) AS n
FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_shipdate >= TIMESTAMP '1995-06-01 00:00:00' GROUP BY o_orderpriority"""


def revenue(e: Engine) -> Node:
    joined = T("orders").select("o_orderkey", "o_orderpriority").join(T("lineitem").where("l_shipdate >= timestamp'1995-06-01 00:00:00'").select("l_orderkey", f"{CENTS} AS cents"), {"o_orderkey": "l_orderkey"})
    return joined.sums(["o_orderpriority"], revenue=("sum", "cents"), n=("count", None))


add("revenue_by_priority", ("orders", "lineitem"), revenue, REVENUE)

# Scans, projection, filter
add("filter_project", ("lineitem",), lambda e: T("lineitem").where("l_quantity > 40 AND l_returnflag <> 'N'").select("l_orderkey", "l_linenumber", f"{CENTS} AS cents"), f"SELECT l_orderkey, l_linenumber, {CENTS} AS cents FROM lineitem WHERE l_quantity > 40 AND l_returnflag <> 'N'")
add("expressions", ("orders",), lambda e: T("orders").select("o_orderkey", "upper(o_orderstatus) AS st", "CASE WHEN o_totalprice > 100000 THEN 'high' WHEN o_totalprice > 50000 THEN 'mid' ELSE 'low' END AS band", "nullif(o_custkey % 5, 0) AS m", "coalesce(nullif(o_custkey % 5, 0), -1) AS c"), "SELECT o_orderkey, upper(o_orderstatus) AS st, CASE WHEN o_totalprice > 100000 THEN 'high' WHEN o_totalprice > 50000 THEN 'mid' ELSE 'low' END AS band, nullif(o_custkey % 5, 0) AS m, coalesce(nullif(o_custkey % 5, 0), -1) AS c FROM orders")
add("null_filter", ("customer",), lambda e: T("customer").select("c_custkey", "nullif(c_nationkey, 3) AS nk").where("nk <> 5"), "SELECT c_custkey, nk FROM (SELECT c_custkey, nullif(c_nationkey, 3) AS nk FROM customer) WHERE nk <> 5")

# Joins
CUST, NAT = T("customer").select("c_custkey", "nullif(c_nationkey, 3) AS nk"), T("nation").select("nullif(n_nationkey, 7) AS k", "n_name", "n_regionkey")
_C, _N = "(SELECT c_custkey, nullif(c_nationkey, 3) AS nk FROM customer) c", "(SELECT nullif(n_nationkey, 7) AS k, n_name, n_regionkey FROM nation) n"
add("inner_join", ("customer", "orders"), lambda e: T("customer").select("c_custkey", "c_mktsegment").join(T("orders").select("o_custkey", "o_orderkey"), {"c_custkey": "o_custkey"}), "SELECT c_custkey, c_mktsegment, o_custkey, o_orderkey FROM customer JOIN orders ON c_custkey = o_custkey")
for how in ("left", "right", "full"):
    add(f"{how}_outer_join", ("customer", "nation"), lambda e, how=how: CUST.join(NAT, {"nk": "k"}, how, "c_custkey % 2 = n_regionkey % 2"), f"SELECT * FROM {_C} {how.upper()} JOIN {_N} ON nk = k AND c_custkey % 2 = n_regionkey % 2")
add("null_safe_join", ("customer", "nation"), lambda e: CUST.join(NAT, {"nk": "k"}, null_safe=True), f"SELECT * FROM {_C} JOIN {_N} ON nk IS NOT DISTINCT FROM k")
add("theta_join", ("customer", "orders"), lambda e: T("customer").select("c_custkey", "c_acctbal").join(T("orders").select("o_custkey", "o_orderkey", "o_totalprice"), {"c_custkey": "o_custkey"}, cond="o_totalprice > c_acctbal * 10"), "SELECT c_custkey, c_acctbal, o_custkey, o_orderkey, o_totalprice FROM customer JOIN orders ON c_custkey = o_custkey AND o_totalprice > c_acctbal * 10")
add("range_join", ("supplier", "nation"), lambda e: T("supplier").select("s_suppkey").join(T("nation").select("n_nationkey"), how="inner", cond="s_suppkey < n_nationkey * 2"), "SELECT s_suppkey, n_nationkey FROM supplier JOIN nation ON s_suppkey < n_nationkey * 2")
add("cross_join", ("nation", "region"), lambda e: T("nation").select("n_name").join(T("region").select("r_name"), how="cross"), "SELECT n_name, r_name FROM nation CROSS JOIN region")
add("semi_join", ("customer", "orders"), lambda e: T("customer").select("c_custkey").join(T("orders").where("o_totalprice > 200000"), {"c_custkey": "o_custkey"}, "left_semi"), "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000)")
add("anti_join", ("customer", "orders"), lambda e: T("customer").select("c_custkey").join(T("orders"), {"c_custkey": "o_custkey"}, "left_anti"), "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
add("self_join", ("nation",), lambda e: T("nation").select("n_nationkey AS a", "n_regionkey AS ra").join(T("nation").select("n_nationkey AS b", "n_regionkey AS rb"), {"ra": "rb"}, cond="a < b"), "SELECT x.n_nationkey AS a, x.n_regionkey AS ra, y.n_nationkey AS b, y.n_regionkey AS rb FROM nation x JOIN nation y ON x.n_regionkey = y.n_regionkey AND x.n_nationkey < y.n_nationkey")
add("three_way_join", ("supplier", "nation", "region"), lambda e: T("supplier").select("s_suppkey", "s_nationkey").join(T("nation").select("n_nationkey", "n_regionkey"), {"s_nationkey": "n_nationkey"}).join(T("region"), {"n_regionkey": "r_regionkey"}).select("s_suppkey", "r_name"), "SELECT s_suppkey, r_name FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
add("mark_in", ("customer", "nation"), lambda e: CUST.mark(NAT.where("n_regionkey <> 2"), "nk", "k"), f"SELECT c_custkey, nk, nk IN (SELECT k FROM {_N} WHERE n_regionkey <> 2) AS mark FROM {_C}")
_same("in_subquery", ("customer", "orders"), "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
_same("not_in_subquery", ("customer", "orders"), "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 100000)")
_same("exists_residual", ("customer", "orders"), "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > c_acctbal * 40)")
_same("scalar_subquery", ("customer",), "SELECT c_custkey FROM customer WHERE c_acctbal > (SELECT median(c_acctbal) FROM customer)")
_same("correlated_scalar", ("orders",), "SELECT o_orderkey FROM orders o WHERE o_totalprice >= (SELECT max(o_totalprice) FROM orders i WHERE i.o_custkey = o.o_custkey)")
_same("lateral_join", ("nation", "region"), "SELECT r_name, x.n FROM region, LATERAL (SELECT count(*) AS n FROM nation WHERE n_regionkey = r_regionkey) x")

# Aggregates
add("sum_count_avg", ("lineitem",), lambda e: T("lineitem").select("l_returnflag", "l_linestatus", f"{CENTS} AS cents", "nullif(l_linenumber, 2) AS ln").sums(["l_returnflag", "l_linestatus"], total=("sum", "cents"), n=("count", None), nn=("count", "ln"), mean=("avg", "ln")), f"SELECT l_returnflag, l_linestatus, CAST(SUM({CENTS}) AS BIGINT) AS total, COUNT(*) AS n, COUNT(nullif(l_linenumber, 2)) AS nn, AVG(nullif(l_linenumber, 2)) AS mean FROM lineitem GROUP BY ALL")
add("global_aggregate", ("orders",), lambda e: T("orders").select(f"{PRICE} AS p").sums([], total=("sum", "p"), n=("count", None)), f"SELECT CAST(SUM({PRICE}) AS BIGINT) AS total, COUNT(*) AS n FROM orders")
add("global_aggregate_empty", ("orders",), lambda e: T("orders").where("o_totalprice < 0").group([], n="count(1)", top="max(o_orderkey)"), "SELECT COUNT(*) AS n, MAX(o_orderkey) AS top FROM orders WHERE o_totalprice < 0")


def grouped(name: str, sql: str, **aggs: str) -> None:
    add(name, ("orders",), lambda e: T("orders").select("o_orderpriority AS pr", "nullif(o_custkey % 7, 0) AS m", f"{PRICE} AS p", "o_orderkey AS k", "o_orderstatus AS st").group(["pr"], **aggs), f"SELECT pr, {sql} FROM (SELECT o_orderpriority AS pr, nullif(o_custkey % 7, 0) AS m, {PRICE} AS p, o_orderkey AS k, o_orderstatus AS st FROM orders) GROUP BY pr")


grouped("min_max", "MIN(p) AS lo, MAX(p) AS hi", lo="min(p)", hi="max(p)")
grouped("first_value_agg", "MIN(m) AS f", f="min(m)")
grouped("string_agg", "string_agg(st, '|' ORDER BY k) AS s", s="listagg(st, '|') WITHIN GROUP (ORDER BY k)")
grouped("array_agg", "CAST(array_to_string(array_agg(coalesce(CAST(m AS VARCHAR), 'null') ORDER BY k), ',') AS VARCHAR) AS s", s="array_join(transform(array_sort(collect_list(struct(k, m))), x -> x.m), ',', 'null')")
grouped("median", "median(p) AS md", md="median(p)")
grouped("quantile_cont", "quantile_cont(p, 0.9) AS q", q="percentile_cont(0.9) WITHIN GROUP (ORDER BY p)")
grouped("quantile_disc", "quantile_disc(p, 0.25) AS q", q="cast(percentile_disc(0.25) WITHIN GROUP (ORDER BY p) AS bigint)")
grouped("mode", "", mo="mode() WITHIN GROUP (ORDER BY m)")
SQL["mode"] = "SELECT pr, mm AS mo FROM (SELECT pr, m AS mm, row_number() OVER (PARTITION BY pr ORDER BY count(*) DESC, m) AS r FROM (SELECT o_orderpriority AS pr, nullif(o_custkey % 7, 0) AS m FROM orders) WHERE m IS NOT NULL GROUP BY pr, m) WHERE r = 1"
grouped("distinct_aggregates", "COUNT(DISTINCT m) AS c, CAST(SUM(DISTINCT m) AS BIGINT) AS s, AVG(DISTINCT m) AS a", c="count(DISTINCT m)", s="sum(DISTINCT m)", a="avg(DISTINCT m)")
grouped("filtered_aggregates", "COUNT(*) FILTER (WHERE m > 3) AS c, CAST(SUM(p) FILTER (WHERE st = 'F') AS BIGINT) AS s, COUNT(DISTINCT m) FILTER (WHERE st = 'O') AS d", c="count(1) FILTER (WHERE m > 3)", s="sum(p) FILTER (WHERE st = 'F')", d="count(DISTINCT m) FILTER (WHERE st = 'O')")
grouped("more_aggregates", "round(stddev_samp(m), 6) AS sd, bool_and(p > 0) AS b, arg_max(k, p) AS best", sd="round(stddev_samp(m), 6)", b="bool_and(p > 0)", best="max_by(k, p)")


add("mad", ("orders",), lambda e: T("orders").select("o_orderpriority AS pr", f"CAST({PRICE} AS DOUBLE) AS p").group(["pr"], md="mad(p)"), f"SELECT pr, mad(CAST(p AS DOUBLE)) AS md FROM (SELECT o_orderpriority AS pr, {PRICE} AS p FROM orders) GROUP BY pr")
add("having", ("orders",), lambda e: T("orders").sums(["o_custkey"], n=("count", None)).where("n > 12"), "SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey HAVING COUNT(*) > 12")
add("group_null_keys", ("customer",), lambda e: CUST.sums(["nk"], n=("count", None)), f"SELECT nk, COUNT(*) AS n FROM {_C} GROUP BY nk")
_SETS = {"grouping_sets": [("l_returnflag", "l_linestatus"), ("l_linestatus",)], "rollup": [("l_returnflag", "l_linestatus"), ("l_returnflag",), ()], "cube": [("l_returnflag", "l_linestatus"), ("l_returnflag",), ("l_linestatus",), ()]}
for _name, _sets in _SETS.items():
    _how = {"grouping_sets": "GROUPING SETS ((l_returnflag, l_linestatus), (l_linestatus))", "rollup": "ROLLUP (l_returnflag, l_linestatus)", "cube": "CUBE (l_returnflag, l_linestatus)"}[_name]
    add(_name, ("lineitem",), lambda e, s=_sets: Grouping(T("lineitem"), ["l_returnflag", "l_linestatus"], s, {"n": "count(1)", "hi": "max(l_quantity)"}), f"SELECT l_returnflag, l_linestatus, COUNT(*) AS n, MAX(l_quantity) AS hi, CAST(GROUPING(l_returnflag, l_linestatus) AS BIGINT) AS grouping_id FROM lineitem GROUP BY {_how}")

# Windows
EV = T("events").select("event_id", "user_id", "event_type", f"nullif({VALUE}, 0) AS x")
_EV = f"(SELECT event_id, user_id, event_type, nullif({VALUE}, 0) AS x FROM events)"


def windowed(name: str, spark_expr: str, duck_expr: str | None = None, by: str = "user_id") -> None:
    part = f"PARTITION BY {by} " if by else ""
    add(name, ("events",), lambda e: EV.window([by] if by else [], y=spark_expr.format(p=part)).select("event_id", "y"), f"SELECT event_id, {(duck_expr or spark_expr).format(p=part)} AS y FROM {_EV}")


windowed("row_number", "CAST(row_number() OVER ({p}ORDER BY event_id) AS BIGINT)")
windowed("rank", "CAST(rank() OVER ({p}ORDER BY event_type) AS BIGINT)")
windowed("dense_rank", "CAST(dense_rank() OVER ({p}ORDER BY event_type) AS BIGINT)")
windowed("ntile", "CAST(ntile(4) OVER ({p}ORDER BY event_id) AS BIGINT)")
windowed("lag", "lag(x, 2) OVER ({p}ORDER BY event_id)")
windowed("lead", "lead(x, 1) OVER ({p}ORDER BY event_id)")
windowed("first_value", "first_value(x) OVER ({p}ORDER BY event_id ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)")
windowed("last_value", "last_value(x) OVER ({p}ORDER BY event_id ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING)")
windowed("last_value_ignore_nulls", "last_value(x) IGNORE NULLS OVER ({p}ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)", "last_value(x IGNORE NULLS) OVER ({p}ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")
windowed("nth_value", "nth_value(x, 3) OVER ({p}ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)")
windowed("window_sum_rows", "CAST(sum(x) OVER ({p}ORDER BY event_id ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING) AS BIGINT)")
windowed("window_range_peers", "CAST(sum(x) OVER ({p}ORDER BY event_type RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT)")
windowed("window_groups_frame", "CAST(count(x) OVER ({p}ORDER BY event_type RANGE BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT)", "CAST(count(x) OVER ({p}ORDER BY event_type GROUPS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT)")
windowed("window_min_max", "max(x) OVER ({p}) - min(x) OVER ({p})")
windowed("window_avg", "avg(x) OVER ({p}ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")
windowed("percent_rank", "percent_rank() OVER ({p}ORDER BY event_id)")
windowed("cume_dist", "cume_dist() OVER ({p}ORDER BY event_id)")

# Sort, limit, distinct on
add("order_limit_offset", ("orders",), lambda e: T("orders").select("o_orderkey", "o_totalprice").top(["o_totalprice DESC", "o_orderkey"], 50, 10), "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50 OFFSET 10")
add("order_by", ("nation",), lambda e: T("nation").select("nullif(n_regionkey, 2) AS r", "n_name").top(["r NULLS FIRST", "n_name DESC"]), "SELECT nullif(n_regionkey, 2) AS r, n_name FROM nation ORDER BY r NULLS FIRST, n_name DESC")
add("limit_percent", ("customer",), lambda e: T("customer").select("c_custkey", "c_acctbal").top(["c_acctbal DESC", "c_custkey"], percent=10), "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 10%")
add("distinct_on", ("orders",), lambda e: T("orders").select("o_custkey", "o_orderkey", "o_totalprice").distinct_on(["o_custkey"], ["o_totalprice DESC", "o_orderkey"]), "SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey, o_totalprice FROM orders ORDER BY o_custkey, o_totalprice DESC, o_orderkey")

# Distinct and set operations
add("distinct", ("lineitem",), lambda e: T("lineitem").select("l_returnflag", "l_linenumber").distinct(), "SELECT DISTINCT l_returnflag, l_linenumber FROM lineitem")
_A, _B = ("customer", "c_nationkey", "c_custkey % 3"), ("supplier", "s_nationkey", "s_suppkey % 3")
add("union_all", ("customer", "supplier"), lambda e: T("customer").select("c_nationkey AS k").union_all(T("supplier").select("s_nationkey AS k")), "SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier")
for kind, word in (("union", "UNION"), ("intersect", "INTERSECT"), ("intersect_all", "INTERSECT ALL"), ("except", "EXCEPT"), ("except_all", "EXCEPT ALL")):
    add(kind, ("customer", "supplier"), lambda e, kind=kind: T("customer").select("nullif(c_nationkey, 3) AS k", "c_custkey % 3 AS m").set_op(kind, T("supplier").select("nullif(s_nationkey, 3) AS k", "s_suppkey % 3 AS m")), f"SELECT nullif(c_nationkey, 3) AS k, c_custkey % 3 AS m FROM customer {word} SELECT nullif(s_nationkey, 3), s_suppkey % 3 FROM supplier")

# CTEs and recursion
_same("cte", ("orders",), "WITH big AS (SELECT o_custkey, o_orderkey FROM orders WHERE o_totalprice > 150000) SELECT a.o_orderkey AS x, b.o_orderkey AS y FROM big a JOIN big b ON a.o_custkey = b.o_custkey WHERE a.o_orderkey < b.o_orderkey")


def _reach(e: Engine) -> Node:
    edges = lambda at: at["supplier"].selectExpr("s_suppkey AS a", "(s_suppkey * 7 + 3) % 40 AS b", "__w AS __w2")
    body = lambda f, at: f.join(edges(at), F.col("y") == F.col("a")).select("x", F.col("b").alias("y"), (F.col("__w") * F.col("__w2")).alias("__w"))
    return Recursive(T("supplier").select("s_suppkey AS x", "(s_suppkey * 7 + 3) % 40 AS y"), body, {"supplier"}, cut=e.store.fixed)


add("recursive_union", ("supplier",), _reach, "WITH RECURSIVE e AS (SELECT s_suppkey AS a, (s_suppkey * 7 + 3) % 40 AS b FROM supplier), r AS (SELECT a AS x, b AS y FROM e UNION SELECT x, b FROM r JOIN e ON y = a) SELECT x, y FROM r")


def _chain(e: Engine) -> Node:
    body = lambda f, at: f.join(at["nation"].selectExpr("n_nationkey AS k2", "__w AS __w2"), F.col("k2") == F.col("k") + 5).select(F.col("k2").alias("k"), (F.col("d") + 1).alias("d"), (F.col("__w") * F.col("__w2")).alias("__w"))
    return Recursive(T("nation").where("n_nationkey < 5").select("n_nationkey AS k", "0 AS d"), body, {"nation"}, all_rows=True, cut=e.store.fixed)


add("recursive_union_all", ("nation",), _chain, "WITH RECURSIVE r AS (SELECT n_nationkey AS k, 0 AS d FROM nation WHERE n_nationkey < 5 UNION ALL SELECT n_nationkey, d + 1 FROM r JOIN nation ON n_nationkey = k + 5) SELECT k, d FROM r")

# Views on views, propagation, capture
add("view_on_view", ("orders",), lambda e: T("per").where("n > 5").sums([], customers=("count", None), orders=("sum", "n")), "SELECT COUNT(*) AS customers, CAST(SUM(n) AS BIGINT) AS orders FROM (SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY 1) WHERE n > 5", ("per", lambda e: T("orders").sums(["o_custkey"], n=("count", None))))
add("diamond_views", ("orders",), lambda e: T("hi").union_all(T("lo")).sums(["tag"], n=("count", None)), "SELECT tag, COUNT(*) AS n FROM (SELECT CASE WHEN o_totalprice > 100000 THEN 'hi' ELSE 'lo' END AS tag FROM orders) GROUP BY tag", ("hi", lambda e: T("orders").where("o_totalprice > 100000").select("o_orderkey", "'hi' AS tag")), ("lo", lambda e: T("orders").where("o_totalprice <= 100000").select("o_orderkey", "'lo' AS tag")))
add("sql_view_on_view", ("nation",), "SELECT r, count(*) AS n FROM base GROUP BY r", "SELECT n_regionkey AS r, count(*) AS n FROM nation GROUP BY 1", ("base", "SELECT n_nationkey AS k, n_regionkey AS r FROM nation"))


def _with(name: str, sql: str):
    def register(f):
        QUERIES[name], SQL[name] = f, sql
        return f

    return register


@_with("changes_feed", "SELECT o_orderkey, o_orderstatus, CAST(1 AS BIGINT) AS weight FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT o_orderkey, o_orderstatus, CAST(-1 AS BIGINT) FROM orders WHERE o_orderstatus <> 'F'")
def _changes(spark, sf_dir):
    e = Engine(spark)
    df = read(spark, sf_dir, "orders")
    e.track("orders", df.where("o_orderstatus <> 'F'"))
    e.create_view("v", T("orders").select("o_orderkey", "o_orderstatus"))
    e.apply_batch({"orders": Z.plus(Z.weighted(df.where("o_orderstatus = 'F'")), Z.weighted(df.where("o_orderstatus <> 'F'"), -1))})
    return e.changes("v")


@_with("scan_and_diff", "SELECT c_mktsegment, COUNT(*) AS n FROM customer GROUP BY 1")
def _sync(spark, sf_dir):
    e = started(spark, sf_dir, ("customer",))
    e.create_view("v", T("customer").sums(["c_mktsegment"], n=("count", None)))
    e.sync("customer", {"customer": read(spark, sf_dir, "customer")})
    return e.query("v")


@_with("update_delete_merge", "SELECT s_suppkey, CASE WHEN s_nationkey = 3 THEN 's3' ELSE s_name END AS s_name FROM supplier WHERE s_nationkey <> 5")
def _dml(spark, sf_dir):
    e = started(spark, sf_dir, ("supplier",))
    e.create_view("v", T("supplier").select("s_suppkey", "s_name"))
    e.merge("supplier", read(spark, sf_dir, "supplier"), ["s_suppkey"])
    e.update("supplier", {"s_name": "'s3'"}, "s_nationkey = 3")
    e.delete("supplier", "s_nationkey = 5")
    return e.query("v")


@_with("sql_writes", "SELECT s_suppkey, CASE WHEN s_nationkey = 3 THEN 's3' ELSE s_name END AS s_name FROM supplier WHERE s_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)")
def _sql_writes(spark, sf_dir):
    e = started(spark, sf_dir, ("supplier", "nation"))
    e.create_view("v", T("supplier").select("s_suppkey", "s_name"))
    read(spark, sf_dir, "supplier").createOrReplaceTempView("rivulet_incoming")
    read(spark, sf_dir, "nation").createOrReplaceTempView("rivulet_nations")
    with e.transaction():
        e.sql("INSERT INTO supplier SELECT * FROM rivulet_incoming WHERE s_suppkey % 10 = 0")
        e.sql("UPDATE supplier SET s_name = 's3' WHERE s_nationkey = 3")
        e.sql("DELETE FROM supplier WHERE s_nationkey IN (SELECT n_nationkey FROM rivulet_nations WHERE n_regionkey = 1)")
    return e.query("v")


@_with("tracked_by_a_view", "SELECT r_name, COUNT(*) AS n FROM region JOIN nation ON r_regionkey = n_regionkey GROUP BY 1")
def _tracked(spark, sf_dir):
    e = started(spark, sf_dir, ("region",))
    read(spark, sf_dir, "nation").where("n_nationkey % 2 = 0").createOrReplaceTempView("rivulet_nation")
    e.create_view("v", "SELECT r_name, count(*) AS n FROM region JOIN rivulet_nation ON r_regionkey = n_regionkey GROUP BY r_name")
    batches(e, spark, sf_dir, ("region",))
    read(spark, sf_dir, "nation").createOrReplaceTempView("rivulet_nation")
    e.sync()
    return e.query("v")


@_with("duplicate_weights", "SELECT n_regionkey, 2 * COUNT(*) AS n FROM nation GROUP BY 1")
def _twice(spark, sf_dir):
    e = started(spark, sf_dir, ("nation",))
    e.create_view("all", T("nation").select("n_regionkey"))
    e.create_view("v", T("all").group(["n_regionkey"], n="count(1)"))
    df = read(spark, sf_dir, "nation")
    with e.transaction():
        e.notify_insert("nation", df)
        e.notify_insert("nation", df)
    e.notify_delete("nation", df.where("n_nationkey % 10 <> 0"))
    return e.query("v")


@_with("ddl_create_replace", "SELECT r_regionkey AS k, upper(r_name) AS u FROM region")
def _ddl(spark, sf_dir):
    e = started(spark, sf_dir, ("region",))
    e.sql("CREATE MATERIALIZED VIEW v AS SELECT r_regionkey AS k FROM region")
    e.sql("CREATE MATERIALIZED VIEW w AS SELECT count(*) AS n FROM v;")
    e.sql("CREATE OR REPLACE MATERIALIZED VIEW v AS SELECT r_regionkey AS k, upper(r_name) AS u FROM region")
    e.sql("DROP MATERIALIZED VIEW IF EXISTS w")
    batches(e, spark, sf_dir, ("region",))
    return e.query("v")


@_with("save_and_load", "SELECT s_nationkey, COUNT(*) AS n FROM supplier GROUP BY 1")
def _saved(spark, sf_dir):
    e = started(spark, sf_dir, ("supplier",))
    e.create_view("v", "SELECT s_nationkey, count(*) AS n FROM supplier GROUP BY s_nationkey")
    e.save()
    e = Engine.load(spark, e.store.path)
    batches(e, spark, sf_dir, ("supplier",))
    return e.query("v")


@_with("stream_runner", "SELECT event_type, COUNT(*) AS n FROM events GROUP BY 1")
def _stream(spark, sf_dir):
    from rivulet.streaming.runner import run

    e = Engine(spark)
    df = read(spark, sf_dir, "events")
    e.track("events", df.limit(0))
    e.create_view("v", T("events").sums(["event_type"], n=("count", None)))
    stream = spark.readStream.schema(df.schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    run(e, "events", stream, f"{e.store.path}/stream").awaitTermination()
    return e.query("v")


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
