"""Relational core: filters, joins, aggregates, row updates and limits over the star schema and the ledger."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.functions import scores
from millrace.operators import mutations
from millrace.plans.core import query
from millrace.sources.tables import load


@query("""SELECT user_id AS workflow_id, ts::DATE AS day, round(sum(value), 4) AS total_cost, count(*) AS call_count, round(coalesce(sum(value) FILTER (event_type = 'view'), 0), 4) AS local_cost,
round(coalesce(sum(value) FILTER (event_type = 'purchase'), 0), 4) AS quality_cost, round(coalesce(sum(value) FILTER (event_type = 'error'), 0), 4) AS judge_cost FROM events GROUP BY ALL""")
def daily_cost(spark, sf):
    part = lambda tier: F.round(F.coalesce(F.sum(F.when(F.col("event_type") == tier, F.col("value"))), F.lit(0.0)), 4)
    return load(spark, sf, "events").groupBy(F.col("user_id").alias("workflow_id"), F.to_date("ts").alias("day")).agg(F.round(F.sum("value"), 4).alias("total_cost"), F.count("*").alias("call_count"), part("view").alias("local_cost"), part("purchase").alias("quality_cost"), part("error").alias("judge_cost"))


@query("SELECT user_id AS workflow_id, count(*) AS calls, round(coalesce(sum(value), 0), 4) AS cost, round(avg(value), 6) AS mean_cost, max(ts) AS last_at FROM events GROUP BY user_id")
def workflow_cost(spark, sf):
    return load(spark, sf, "events").groupBy(F.col("user_id").alias("workflow_id")).agg(F.count("*").alias("calls"), F.round(F.coalesce(F.sum("value"), F.lit(0.0)), 4).alias("cost"), F.round(F.avg("value"), 6).alias("mean_cost"), F.max("ts").alias("last_at"))


@query("""WITH w AS (SELECT user_id AS workflow_id, sum(value) AS spent, count(*) AS done FROM events GROUP BY user_id)
SELECT workflow_id, done, round(spent, 4) AS spent, round(spent / done * (300 - done), 4) AS projected, CASE WHEN spent >= 5000 THEN 'halt' WHEN spent + spent / done * (300 - done) >= 5000 THEN 'alert' WHEN spent >= 1000 THEN 'downgrade' ELSE 'ok' END AS action FROM w""")
def cost_projection(spark, sf):
    w = load(spark, sf, "events").groupBy(F.col("user_id").alias("workflow_id")).agg(F.sum("value").alias("spent"), F.count("*").alias("done"))
    rest = F.col("spent") / F.col("done") * (300 - F.col("done"))
    action = F.when(F.col("spent") >= 5000, "halt").when(F.col("spent") + rest >= 5000, "alert").when(F.col("spent") >= 1000, "downgrade").otherwise("ok")
    return w.select("workflow_id", "done", F.round("spent", 4).alias("spent"), F.round(rest, 4).alias("projected"), action.alias("action"))


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderstatus IN ('O', 'P') AND o_totalprice > 1000 ORDER BY o_orderdate, o_orderkey LIMIT 100")
def pending_rows(spark, sf):
    return load(spark, sf, "orders").where(F.col("o_orderstatus").isin("O", "P") & (F.col("o_totalprice") > 1000)).orderBy("o_orderdate", "o_orderkey").limit(100).select("o_orderkey", "o_custkey", "o_totalprice")


@query("SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders WHERE o_orderpriority LIKE '1%' OR o_totalprice >= 300000 ORDER BY o_orderkey LIMIT 25 OFFSET 50")
def browse_page(spark, sf):
    return load(spark, sf, "orders").where(F.col("o_orderpriority").startswith("1") | (F.col("o_totalprice") >= 300000)).orderBy("o_orderkey").offset(50).limit(25).select("o_orderkey", "o_orderpriority", "o_totalprice")


@query("SELECT n_name, count(DISTINCT o_orderkey) AS n_orders, count(*) AS n_lines FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN nation ON n_nationkey = c_nationkey GROUP BY n_name")
def sample_counts(spark, sf):
    """Chain of inner joins with a count per top-level row."""
    lines = load(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("k"))  # combined before the join
    orders = load(spark, sf, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey")).groupBy("o_custkey").agg(F.count("*").alias("orders"), F.sum("k").alias("k"))
    return orders.join(load(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(load(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(F.sum("orders").alias("n_orders"), F.sum("k").alias("n_lines"))


@query("SELECT c_custkey, c_name, coalesce(k, 0) AS n_orders FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS k FROM orders GROUP BY 1) ON o_custkey = c_custkey")
def listing_with_counts(spark, sf):
    k = load(spark, sf, "orders").groupBy("o_custkey").agg(F.count("*").alias("k"))
    return load(spark, sf, "customer").join(k, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "c_name", F.coalesce("k", F.lit(0)).alias("n_orders"))


@query("SELECT l_orderkey, l_linenumber FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') ORDER BY l_orderkey, l_linenumber LIMIT 200")
def chunks_of_files(spark, sf):
    c = load(spark, sf, "customer").where(F.col("c_mktsegment").isin("BUILDING", "MACHINERY")).select("c_custkey")
    o = load(spark, sf, "orders").join(c, F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("o_orderkey")
    return load(spark, sf, "lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey"), "left_semi").orderBy("l_orderkey", "l_linenumber").limit(200).select("l_orderkey", "l_linenumber")


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' AND o_orderkey % 5 < 3 THEN 'P' ELSE o_orderstatus END AS status FROM orders")
def claim_rows(spark, sf):
    return load(spark, sf, "orders").select("o_orderkey", F.when((F.col("o_orderstatus") == "O") & (F.col("o_orderkey") % 5 < 3), "P").otherwise(F.col("o_orderstatus")).alias("status"))


_STATUS = "['new', 'in_progress', 'ready', 'unresolvable'][(o_orderkey % 4 + 1)::INT]"


@query(f"SELECT o_orderkey, CASE WHEN {_STATUS} IN ('ready', 'unresolvable') THEN {_STATUS} WHEN o_totalprice > 150000 THEN 'ready' WHEN o_custkey % 4 + 1 >= 3 THEN 'unresolvable' ELSE 'new' END AS status FROM orders")
def finalise_rows(spark, sf):
    status = F.get(F.array(*map(F.lit, ("new", "in_progress", "ready", "unresolvable"))), (F.col("o_orderkey") % 4).cast("int"))
    return load(spark, sf, "orders").select("o_orderkey", scores.finalise(status, F.col("o_totalprice") > 150000, F.col("o_custkey") % 4).alias("status"))


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_custkey % 10 = 0)")
def cascade_delete(spark, sf):
    gone = load(spark, sf, "orders").where("o_custkey % 10 = 0")
    return mutations.cascade_delete(load(spark, sf, "lineitem"), "l_orderkey", gone, "o_orderkey").select("l_orderkey", "l_linenumber")


_IGNORED = "SELECT c_custkey AS id, c_name AS name FROM customer UNION ALL SELECT s_suppkey * 3, s_name FROM supplier WHERE s_suppkey * 3 NOT IN (SELECT c_custkey FROM customer)"


@query(_IGNORED)
def insert_ignore_all(spark, sf):
    """All customers stay; of the suppliers, numbered in threes so that some ids are new, those come in whose id is free."""
    base = load(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    return mutations.insert_ignore(base, load(spark, sf, "supplier").select((F.col("s_suppkey") * 3).alias("id"), F.col("s_name").alias("name")), ["id"])


@query(_IGNORED)
def insert_ignore(spark, sf):
    return insert_ignore_all(spark, sf)


@query("""WITH a AS (SELECT user_id % 50 AS batch_id, list_sort(list(event_id)) AS ids, count(*) AS total FROM events WHERE event_id % 2 = 0 GROUP BY 1), b AS (SELECT user_id % 60 AS batch_id, list_sort(list(event_id)) AS ids, count(*) AS total FROM events WHERE event_id % 2 = 1 GROUP BY 1)
SELECT coalesce(a.batch_id, b.batch_id) AS batch_id, list_concat(coalesce(a.ids, []), coalesce(b.ids, [])) AS record_indices, coalesce(b.total, a.total) AS total_records FROM a FULL JOIN b ON a.batch_id = b.batch_id""")
def upsert_arrays(spark, sf):
    e = load(spark, sf, "events")
    side = lambda rest, m: e.where(F.col("event_id") % 2 == rest).groupBy((F.col("user_id") % m).alias("batch_id")).agg(F.sort_array(F.collect_list("event_id")).alias("record_indices"), F.count("*").alias("total_records"))
    return mutations.upsert_append(side(0, 50), side(1, 60), ["batch_id"], append=["record_indices"], replace=["total_records"])


@query("SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, max(ts) AS ts FROM events GROUP BY user_id")
def latest_by_key(spark, sf):
    return load(spark, sf, "events").groupBy("user_id").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"), F.max("ts").alias("ts"))


@query("SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k <= 5")
def bounded_log(spark, sf):
    w = W.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return load(spark, sf, "events").withColumn("k", F.row_number().over(w)).where("k <= 5").select("user_id", "event_id")


@query("SELECT event_id, ts FROM events WHERE ts >= TIMESTAMP '2024-01-30' - INTERVAL 72 HOUR")
def ttl_filter(spark, sf):
    return load(spark, sf, "events").where(F.col("ts") >= F.expr("timestamp'2024-01-30' - interval 72 hours")).select("event_id", "ts")


@query("SELECT event_id, (props->>'$.k')::BIGINT AS k, coalesce((props->>'$.missing'), 'none') AS missing FROM events")
def json_access(spark, sf):
    return load(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), F.coalesce(F.get_json_object("props", "$.missing"), F.lit("none")).alias("missing"))


@query("""SELECT doc_id, CASE WHEN score >= 0.88 THEN 'green' WHEN score >= 0.70 THEN 'grey' ELSE 'red' END AS zone FROM (SELECT doc_id, CASE WHEN quality = 1 THEN 0.6 ELSE 0.3 END + (doc_id % 40) * 0.01 AS score FROM labels)""")
def review_zones(spark, sf):
    return load(spark, sf, "labels").select("doc_id", scores.zone(F.round(F.when(F.col("quality") == 1, F.lit(0.6)).otherwise(0.3) + (F.col("doc_id") % 40) * 0.01, 6)).alias("zone"))


@query("""WITH m AS (SELECT unnest([{'m': 'a', 'cut': DATE '2024-01-05'}, {'m': 'b', 'cut': DATE '2024-01-15'}, {'m': 'c', 'cut': DATE '2024-01-25'}], recursive := true)) SELECT m AS model, count(*) AS n_after_cutoff FROM events JOIN m ON ts::DATE > cut GROUP BY m""")
def post_cutoff(spark, sf):
    """Inequality join with a fixed handful of models, counted by day first."""
    days = load(spark, sf, "events").groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("k"))
    models = spark.createDataFrame([("a", "2024-01-05"), ("b", "2024-01-15"), ("c", "2024-01-25")], "model string, cut string").withColumn("cut", F.to_date("cut"))
    return days.join(F.broadcast(models), F.col("day") > F.col("cut")).groupBy("model").agg(F.sum("k").alias("n_after_cutoff"))


@query("SELECT event_type, date_trunc('day', ts) AS day, round(sum(value), 4) AS cost FROM events GROUP BY ROLLUP (event_type, day)")
def cost_rollup(spark, sf):
    return load(spark, sf, "events").rollup("event_type", F.date_trunc("day", "ts").alias("day")).agg(F.round(F.sum("value"), 4).alias("cost"))


@query("""WITH d AS (SELECT ts::DATE AS day, avg(value) AS q FROM events GROUP BY 1), f AS (SELECT *, coalesce(lag(q) OVER (ORDER BY day) - q > 0.02, false) AS down FROM d), g AS (SELECT *, sum(CASE WHEN down THEN 0 ELSE 1 END) OVER (ORDER BY day) AS island FROM f)
SELECT day, round(q, 6) AS quality, down, sum(down::INT) OVER (PARTITION BY island ORDER BY day)::BIGINT AS streak FROM g""")
def regression_streak(spark, sf):
    """Gaps and islands over one row per cycle."""
    order = W.orderBy("day")
    d = load(spark, sf, "events").groupBy(F.to_date("ts").alias("day")).agg(F.avg("value").alias("q"))
    d = d.withColumn("down", F.coalesce(F.lag("q").over(order) - F.col("q") > 0.02, F.lit(False)))
    d = d.withColumn("island", F.sum(F.when(F.col("down"), 0).otherwise(1)).over(order))
    return d.select("day", F.round("q", 6).alias("quality"), "down", F.sum(F.col("down").cast("int")).over(W.partitionBy("island").orderBy("day")).alias("streak"))


@query("SELECT day, round(cost, 4) AS cost, round(avg(cost) OVER (ORDER BY day ROWS BETWEEN 29 PRECEDING AND CURRENT ROW), 4) AS rolling FROM (SELECT ts::DATE AS day, sum(value) AS cost FROM events GROUP BY 1)")
def rolling_mean(spark, sf):
    d = load(spark, sf, "events").groupBy(F.to_date("ts").alias("day")).agg(F.sum("value").alias("cost"))
    return d.select("day", F.round("cost", 4).alias("cost"), F.round(F.avg("cost").over(W.orderBy("day").rowsBetween(-29, 0)), 4).alias("rolling"))
