"""Queries of the plan operators, and whole queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import aggregates as G
from weftline.functions import variants as V
from weftline.operators.joins import Above, salted_join
from weftline.plans.dataset import Dataset
from weftline.streaming import sessions, windowed

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable[[Callable[..., Dataset | DataFrame]], Query]:
    def register(fn: Callable[..., Dataset | DataFrame]) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            def read(table: str) -> Dataset:
                return Dataset.from_frame(spark.read.parquet(f"{sf_dir}/{table}.parquet"))

            out = fn(read)
            return out.df if isinstance(out, Dataset) else out

        key = name or fn.__name__
        QUERIES[key] = run
        if sql is not None:
            ORACLE_SQL[key] = sql
        return run

    return register


@query("SELECT sum(l_extendedprice * l_discount)::DECIMAL(18, 2)::DOUBLE AS revenue, count(*) AS n FROM lineitem WHERE l_shipdate >= TIMESTAMP '1996-01-01' AND l_shipdate < TIMESTAMP '1997-01-01' AND l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24")
def q6_revenue(t):
    lines = t("lineitem").where(lambda r: (r.l_shipdate >= F.lit("1996-01-01").cast("timestamp_ntz")) & (r.l_shipdate < F.lit("1997-01-01").cast("timestamp_ntz")) & r.l_discount.between(0.05, 0.07) & (r.l_quantity < 24))
    return lines.select(v=F.col("l_extendedprice") * F.col("l_discount")).aggregate([F.round(F.sum("v"), 2).alias("revenue"), G.count().alias("n")])


@query("SELECT round(100 * sum(CASE WHEN p_type LIKE 'PROMO%' THEN l_extendedprice * (1 - l_discount) ELSE 0 END) / sum(l_extendedprice * (1 - l_discount)), 4) AS promo FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_shipdate >= TIMESTAMP '1996-09-01' AND l_shipdate < TIMESTAMP '1996-10-01'")
def q14_promotion(t):
    lines = t("lineitem").where(lambda r: (r.l_shipdate >= F.lit("1996-09-01").cast("timestamp_ntz")) & (r.l_shipdate < F.lit("1996-10-01").cast("timestamp_ntz")))
    paid = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return lines.join_on(t("part"), "l_partkey", "p_partkey").aggregate([F.round(100 * F.sum(F.when(F.col("p_type").like("PROMO%"), paid).otherwise(0)) / F.sum(paid), 4).alias("promo")])


@query("SELECT l_returnflag, l_linestatus, sum(l_quantity) AS qty, round(sum(l_extendedprice), 2) AS price, round(avg(l_discount), 6) AS discount, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2")
def q1_pricing(t):
    lines = t("lineitem").where(lambda r: r.l_shipdate <= F.lit("1998-09-02").cast("timestamp_ntz"))
    return lines.group_by_agg(["l_returnflag", "l_linestatus"], [F.sum("l_quantity").alias("qty"), F.round(F.sum("l_extendedprice"), 2).alias("price"), F.round(F.avg("l_discount"), 6).alias("discount"), G.count().alias("n")])


@query("SELECT o_orderkey, o_orderdate, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey WHERE c_mktsegment = 'BUILDING' GROUP BY 1, 2 ORDER BY revenue DESC, o_orderkey LIMIT 10")
def q3_top_orders(t):
    buyers = t("customer").filter("c_mktsegment = 'BUILDING'").select("c_custkey")
    rows = t("orders").semi_join_on(buyers, "o_custkey", "c_custkey").join_on(t("lineitem"), "o_orderkey", "l_orderkey")
    grouped = rows.group_by_agg(["o_orderkey", "o_orderdate"], [F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue")])
    return grouped.sort_by_exprs(("revenue", "desc"), "o_orderkey").limit(10)


@query("SELECT * FROM region")
def root(t):
    return t("region")


@query("SELECT p_partkey FROM part WHERE p_size > 25")
def filter(t):  # noqa: A001
    return t("part").filter(F.col("p_size") > 25).select("p_partkey")


@query("SELECT p_partkey, p_size * 2 AS twice FROM part")
def map(t):  # noqa: A001
    return t("part").select("p_partkey", "p_size").map(lambda r: (r.p_partkey, r.p_size * 2), "p_partkey long, twice int")


@query("SELECT p_partkey, unnest(range(0, p_size % 3))::BIGINT AS i FROM part")
def flat_map(t):
    return t("part").select("p_partkey", "p_size").flat_map(lambda r: [(r.p_partkey, i) for i in range(r.p_size % 3)], "p_partkey long, i long")


@query("SELECT upper(p_name) AS name FROM part")
def select_rows(t):
    return t("part").select("p_name").select_rows(lambda r: (r.p_name.upper(),), "name string")


@query("SELECT p_partkey, p_retailprice * 2 AS double_price FROM part")
def select_exprs(t):
    return t("part").select("p_partkey", double_price=F.col("p_retailprice") * 2)


@query("SELECT DISTINCT p_brand, p_type FROM part")
def distinct(t):
    return t("part").select("p_brand", "p_type").distinct()


@query("SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 20")
def limit(t):
    return t("orders").select("o_orderkey").sort_by_expr("o_orderkey").limit(20)


@query("SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier")
def union(t):
    return t("customer").select(k="c_nationkey").union(t("supplier").select(k="s_nationkey"))


@query("SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def intersect(t):
    return t("customer").select(k="c_nationkey").intersect(t("supplier").select(k="s_nationkey"))


@query("SELECT p_size AS k FROM part EXCEPT SELECT s_nationkey FROM supplier")
def except_(t):
    return t("part").select(k="p_size").except_(t("supplier").select(k="s_nationkey"))


NEAR = "s_nationkey = c_nationkey AND s_acctbal > c_acctbal + 9000"
KEY = "s_suppkey * 30 = c_custkey"


def _near():
    return Above("s_acctbal", F.col("c_acctbal") + 9000, (("s_nationkey", "c_nationkey"),))


def _sides(t):
    return t("supplier").select("s_suppkey", "s_nationkey", "s_acctbal"), t("customer").select("c_custkey", "c_nationkey", "c_acctbal")


for _name, _method, _sql in (("inner_join", "join", "JOIN"), ("left_join", "left_join", "LEFT JOIN"), ("right_join", "right_join", "RIGHT JOIN"), ("full_join", "full_join", "FULL JOIN")):

    @query(f"SELECT s_suppkey, c_custkey FROM supplier {_sql} customer ON {NEAR}", name=_name)
    def _predicate(t, method=_method):
        l, r = _sides(t)
        return getattr(l, method)(r, _near()).select("s_suppkey", "c_custkey")

    @query(f"SELECT s_suppkey, c_custkey FROM supplier {_sql} customer ON {KEY}", name=f"{_name}_on")
    def _keyed(t, method=_method):
        l, r = _sides(t)
        return getattr(l, f"{method}_on")(r, F.col("s_suppkey") * 30, "c_custkey").select("s_suppkey", "c_custkey")


@query("SELECT s_suppkey, c_custkey FROM supplier JOIN customer ON s_acctbal > c_acctbal + 9500")
def theta_join(t):
    l, r = _sides(t)
    return l.join(r, Above("s_acctbal", F.col("c_acctbal") + 9500)).select("s_suppkey", "c_custkey")


@query("SELECT s_suppkey, c_custkey FROM supplier JOIN customer ON s_nationkey = c_nationkey AND s_suppkey * 10 = c_custkey")
def inner_join_on_keys(t):
    l, r = _sides(t)
    return l.join_on(r, ["s_nationkey", F.col("s_suppkey") * 10], ["c_nationkey", "c_custkey"]).select("s_suppkey", "c_custkey")


@query(f"SELECT s_suppkey FROM supplier WHERE NOT EXISTS (SELECT 1 FROM customer WHERE {NEAR})")
def left_anti_join(t):
    l, r = _sides(t)
    return l.anti_join(r, _near()).select("s_suppkey")


@query(f"SELECT s_suppkey FROM supplier WHERE NOT EXISTS (SELECT 1 FROM customer WHERE {KEY})")
def left_anti_join_on(t):
    l, r = _sides(t)
    return l.anti_join_on(r, F.col("s_suppkey") * 30, "c_custkey").select("s_suppkey")


@query(f"SELECT s_suppkey FROM supplier WHERE EXISTS (SELECT 1 FROM customer WHERE {KEY})")
def left_semi_join_on(t):
    l, r = _sides(t)
    return l.semi_join_on(r, F.col("s_suppkey") * 30, "c_custkey").select("s_suppkey")


@query("SELECT o_orderkey, l_linenumber::BIGINT AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey")
def salted_key_join(t):
    lines = t("lineitem").df.select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_linenumber").cast("long").alias("n"))
    return salted_join(lines, t("orders").df.select("o_orderkey"), "o_orderkey", 4)


@query("SELECT o_orderpriority, o_custkey, o_orderkey FROM orders ORDER BY ALL LIMIT 15")
def sort(t):
    return t("orders").select("o_orderpriority", "o_custkey", "o_orderkey").sort().limit(15)


@query("SELECT o_orderkey FROM orders ORDER BY o_orderkey % 1000 DESC, o_orderkey LIMIT 15")
def sort_by(t):
    return t("orders").select("o_orderkey").sort_by(lambda r: -(r.o_orderkey % 1000) * 10_000_000 + r.o_orderkey, "long").limit(15)


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 15")
def sort_by_expr(t):
    return t("orders").select("o_orderkey", "o_totalprice").sort_by_expr(F.struct("o_totalprice", "o_orderkey")).limit(15)


@query("SELECT o_orderkey, o_orderstatus FROM orders ORDER BY o_orderstatus DESC, o_orderkey LIMIT 15")
def sort_by_exprs(t):
    return t("orders").select("o_orderkey", "o_orderstatus").sort_by_exprs(("o_orderstatus", "desc"), ("o_orderkey", "asc")).limit(15)


@query("SELECT true AS near, true AS within, true AS again")
def sample(t):
    """The share of rows, that all are rows of the table, once each, and that a seed gives the same rows twice."""
    keys = t("orders").select("o_orderkey")
    some, again = (keys.sample(0.1, seed=7).select(F.col("o_orderkey").alias("k"), F.lit(i).alias("i")) for i in (1, 2))
    each = some.union(again).group_by_agg(["k"], [F.sum("i").alias("i"), G.count().alias("n")])
    found = keys.left_join_on(each, "o_orderkey", "k").aggregate([G.count().alias("rows"), F.count("k").alias("kept"), F.bool_and((F.col("i") == 3) & (F.col("n") == 2)).alias("same")])
    counted = each.aggregate([G.count().alias("all")])
    return Dataset(found.df.crossJoin(counted.df)).select((F.abs(F.col("kept") - 0.1 * F.col("rows")) < 4 * F.sqrt(0.09 * F.col("rows"))).alias("near"), (F.col("kept") == F.col("all")).alias("within"), F.col("same").alias("again"))


@query("SELECT p_partkey, p_brand || '/' || p_type || '!' AS label, length(p_type) AS n FROM part WHERE p_brand || 'x' > 'Brand#3'")
def text_lambdas(t):
    rows = t("part").where(lambda r: r.p_brand + "x" > "Brand#3")
    return rows.select("p_partkey", label=lambda r: r.p_brand + "/" + r.p_type + "!", n=lambda r: r.p_type.length.cast("long"))


@query("SELECT count(*) AS n, count(DISTINCT o_orderkey) AS keys, sum(range)::BIGINT AS total, max(range) AS top FROM (SELECT o_orderkey, row_number() OVER () - 1 AS range FROM orders)")
def zip_with_index(t):
    return t("orders").rebalance(5).zip_with_index("i").aggregate([G.count().alias("n"), F.count_distinct("o_orderkey").alias("keys"), F.sum("i").alias("total"), F.max("i").alias("top")])


@query("SELECT count(*) AS n, count(*) AS ids FROM orders")
def zip_with_unique_id(t):
    return t("orders").zip_with_unique_id("i").aggregate([G.count().alias("n"), F.count_distinct("i").alias("ids")])


@query("SELECT n_name FROM nation")
def persist(t):
    return t("nation").select("n_name").persist()


@query("SELECT n_nationkey, n_name FROM nation")
def checkpoint(t):
    return t("nation").select("n_nationkey", "n_name").checkpoint()


@query("SELECT n_nationkey, n_nationkey < 10 AS low FROM nation")
def partition(t):
    low, high = t("nation").select("n_nationkey").partition(F.col("n_nationkey") < 10)
    return low.with_fields(low=F.lit(True)).union(high.with_fields(low=F.lit(False)))


@query("SELECT n_name, n_regionkey FROM nation")
def rebalance(t):
    return t("nation").select("n_name", "n_regionkey").rebalance(3).rebalance()


@query("SELECT o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1 HAVING count(*) > 10")
def group_by_agg(t):
    return t("orders").group_by_agg(["o_orderpriority"], [G.count().alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total")]).filter("n > 10")


@query("SELECT count(*) AS n, max(o_totalprice) AS top FROM orders")
def aggregate(t):
    return t("orders").aggregate([G.count().alias("n"), F.max("o_totalprice").alias("top")])


@query("SELECT o_orderkey, rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC) AS r FROM orders")
def with_window(t):
    return t("orders").with_window(["o_custkey"], [("o_totalprice", "desc")], r=F.rank()).select("o_orderkey", F.col("r").cast("long").alias("r"))


@query("SELECT r_regionkey, r_name FROM region")
def narrow(t):
    from pyspark.sql.types import IntegerType, StringType, StructField, StructType

    return t("region").narrow(StructType([StructField("r_regionkey", IntegerType(), False), StructField("r_name", StringType(), False)]))


@query("SELECT event_id, props FROM events ORDER BY event_id LIMIT 0", name="empty_limit")
def _empty(t):
    return t("events").select("event_id", "props").limit(0)


@query("SELECT vec_id, unnest(embedding)::DOUBLE AS x FROM embeddings")
def explode(t):
    return t("embeddings").df.select("vec_id", F.explode("embedding").alias("x")).select("vec_id", F.col("x").cast("double").alias("x"))


@query("SELECT vec_id, unnest(CASE WHEN vec_id % 3 = 0 THEN [NULL] ELSE [1, 2] END)::BIGINT AS x FROM embeddings")
def explode_outer(t):
    return t("embeddings").df.select("vec_id", F.explode_outer(F.when(F.col("vec_id") % 3 != 0, F.array(F.lit(1).cast("long"), F.lit(2).cast("long")))).alias("x"))


@query("SELECT vec_id, (generate_subscripts(embedding, 1) - 1)::BIGINT AS pos, unnest(embedding)::DOUBLE AS x FROM embeddings")
def posexplode(t):
    return t("embeddings").df.select("vec_id", F.posexplode("embedding").alias("pos", "x")).select("vec_id", F.col("pos").cast("long").alias("pos"), F.col("x").cast("double").alias("x"))


@query("SELECT p_partkey, unnest([p_size, p_size + 1])::BIGINT AS a, unnest(['x', 'y']) AS b FROM part")
def inline(t):
    s = F.col("p_size").cast("long")
    return t("part").df.select("p_partkey", F.inline(F.array(F.struct(s.alias("a"), F.lit("x").alias("b")), F.struct((s + 1).alias("a"), F.lit("y").alias("b")))))


@query("SELECT event_id, 'k' AS key, json_extract_string(props, '$.k') AS value FROM events WHERE json_extract(props, '$.k') IS NOT NULL")
def variant_explode(t):
    rows = V.variant_explode(t("events").df.select("event_id", V.parse_json("props").alias("v")), "v")
    return rows.where("key = 'k'").select("event_id", "key", F.col("value").cast("string").alias("value"))


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def event_windows(t):
    return windowed(t("events").df, "ts", "1 hour", ["event_type"], [G.count().alias("n")], late="1 hour").select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@query("WITH s AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), g AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM s) SELECT user_id, min(ts) AS start, count(*) AS n FROM g GROUP BY user_id, g")
def event_sessions(t):
    return sessions(t("events").df, "ts", "30 minutes", ["user_id"], [G.count().alias("n")]).select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n")
