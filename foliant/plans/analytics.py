"""Audit analytics, aggregations, window and set operations over ``events`` and the star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliant.operators import quantiles as Q
from foliant.sources.tables import read_table as read

from .registry import query


@query("""
    select event_type, count(*) as n, min(value) as low, max(value) as high, round(avg(value), 6) as mean, round(quantile_cont(value, 0.95), 6) as p95,
      round(100.0 * count(*) / nullif((select count(*) from events), 0), 6) as share, round(sum(case when value > 50 then 1 else 0 end) / count(*), 6) as slow_rate,
      greatest(coalesce(max(value), 0) - coalesce(avg(value), 0), 0) > 10 as has_tail
    from events group by event_type
""")
def audit_by_mode(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events")
    v = F.col("value")
    by = e.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"), F.min(v).alias("low"), F.max(v).alias("high"), F.round(F.avg(v), 6).alias("mean"),
        F.round(F.sum(F.when(v > 50, 1).otherwise(0)) / F.count(F.lit(1)), 6).alias("slow_rate"), (F.greatest(F.coalesce(F.max(v), F.lit(0)) - F.coalesce(F.avg(v), F.lit(0)), F.lit(0)) > 10).alias("has_tail"),
    )
    p95 = Q.percentile_cont(e, ["event_type"], "value", {"p95": 0.95}).select(F.col("event_type").alias("mode"), F.round("p95", 6).alias("p95"))
    by = by.join(p95, by["event_type"].eqNullSafe(p95["mode"]), "left").drop("mode")
    total = by.agg(F.sum("n").alias("total"))
    return by.crossJoin(F.broadcast(total)).withColumn("share", F.round(100.0 * F.col("n") / F.nullif("total", F.lit(0)), 6)).drop("total")


@query("select user_id, event_type, count(*) as n from events group by user_id, event_type order by n desc, user_id, event_type limit 10")
def top_buckets(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "user_id", "event_type").limit(10)


@query("select time_bucket(interval '1 hour', ts) as hour, event_type, count(*) as n, round(sum(value), 4) as total from events group by all")
def hourly_tumbling(spark: SparkSession, d: str) -> DataFrame:
    from foliant.streaming.windows import tumbling

    return tumbling(read(spark, d, "events"), "1 hour").select(F.col("window.start").alias("hour"), "event_type", "n", F.round("total", 4).alias("total"))


@query("""
    with w as (select unnest([time_bucket(interval '15 minutes', ts) - interval '45 minutes', time_bucket(interval '15 minutes', ts) - interval '30 minutes', time_bucket(interval '15 minutes', ts) - interval '15 minutes', time_bucket(interval '15 minutes', ts)]) as start, event_type, value from events)
    select start, event_type, count(*) as n, round(sum(value), 4) as total from w group by all
""")
def hourly_sliding(spark: SparkSession, d: str) -> DataFrame:
    from foliant.streaming.windows import sliding

    return sliding(read(spark, d, "events"), "1 hour", "15 minutes").select(F.col("window.start").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("""
    with g as (select user_id, ts, event_id, case when ts - lag(ts) over (partition by user_id order by ts, event_id) < interval '30 minutes' then 0 else 1 end as fresh from events),
    s as (select user_id, ts, sum(fresh) over (partition by user_id order by ts, event_id) as sid from g)
    select user_id, min(ts) as start, count(*) as n from s group by user_id, sid
""")
def user_sessions(spark: SparkSession, d: str) -> DataFrame:
    from foliant.streaming.windows import sessions

    return sessions(read(spark, d, "events"), "user_id", "30 minutes").select("user_id", F.col("window.start").alias("start"), "n")


@query("""
    with g as (select user_id, event_id, ts, case when ts - lag(ts) over (partition by user_id order by ts, event_id) <= interval '30 minutes' then 0 else 1 end as fresh from events)
    select user_id, event_id, cast(sum(fresh) over (partition by user_id order by ts, event_id) as bigint) as grp from g
""")
def gap_groups(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    at = F.col("ts").cast("timestamp").cast("double")
    gap = at - F.lag(at).over(w)
    return read(spark, d, "events").withColumn("fresh", F.when(gap <= 1800, 0).otherwise(1)).select("user_id", "event_id", F.sum("fresh").over(w).alias("grp"))


@query("select l_returnflag, l_linestatus, sum(l_quantity) as qty, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue, count(*) as n from lineitem where l_shipdate <= timestamp '1998-09-02' group by all")
def pricing_summary(spark: SparkSession, d: str) -> DataFrame:
    rev = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return read(spark, d, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp")).groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("qty"), F.round(F.sum(rev), 2).alias("revenue"), F.count(F.lit(1)).alias("n"))


@query("select l_partkey, count(*) as n, count(distinct l_suppkey) as suppliers from lineitem group by l_partkey having count(*) >= 2 order by n desc, l_partkey limit 100")
def duplicate_buckets(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "lineitem").groupBy("l_partkey").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("l_suppkey").alias("suppliers")).where("n >= 2").orderBy(F.desc("n"), "l_partkey").limit(100)


@query("select count(distinct l_partkey) as parts, count(distinct l_suppkey) as suppliers, count(distinct l_orderkey) as orders from lineitem")
def cardinalities(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "lineitem").agg(*[F.count_distinct(f"l_{c}").alias(a) for c, a in (("partkey", "parts"), ("suppkey", "suppliers"), ("orderkey", "orders"))])


@query("select distinct o_custkey from orders")
def distinct_sources(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "orders").select("o_custkey").distinct()


@query("select visibility, count(*) as n from (select case o_orderstatus when 'F' then 'PUBLIC' when 'O' then 'DEPT' else 'PRIVATE' end as visibility from orders) group by visibility")
def visibility_counts(spark: SparkSession, d: str) -> DataFrame:
    v = F.when(F.col("o_orderstatus") == "F", "PUBLIC").when(F.col("o_orderstatus") == "O", "DEPT").otherwise("PRIVATE")
    return read(spark, d, "orders").groupBy(v.alias("visibility")).agg(F.count(F.lit(1)).alias("n"))


@query("""
    select coalesce(c_custkey, o_custkey) as k, case when c_custkey is null then 'right' when o_custkey is null then 'left' else 'both' end as side, n from customer full join (select o_custkey, count(*) as n from orders group by 1) on c_custkey = o_custkey
""")
def index_alignment(spark: SparkSession, d: str) -> DataFrame:
    o = read(spark, d, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    j = read(spark, d, "customer").select("c_custkey").join(o, F.col("c_custkey") == F.col("o_custkey"), "full")
    return j.select(F.coalesce("c_custkey", "o_custkey").alias("k"), F.when(F.col("c_custkey").isNull(), "right").when(F.col("o_custkey").isNull(), "left").otherwise("both").alias("side"), "n")


@query("select p_partkey from part where p_partkey not in (select l_partkey from lineitem where l_quantity > 40)")
def missing_keys(spark: SparkSession, d: str) -> DataFrame:
    gone = read(spark, d, "lineitem").where("l_quantity > 40").select(F.col("l_partkey").alias("p_partkey"))
    return read(spark, d, "part").select("p_partkey").join(gone, "p_partkey", "left_anti")


@query("(select o_custkey as k from orders where o_orderpriority = '1-URGENT' intersect select c_custkey from customer where c_acctbal > 0) union (select s_suppkey from supplier except select n_nationkey from nation)")
def set_operations(spark: SparkSession, d: str) -> DataFrame:
    a = read(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("k")).intersect(read(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("k")))
    b = read(spark, d, "supplier").select(F.col("s_suppkey").alias("k")).subtract(read(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("k")))
    return a.union(b).distinct()


@query("""
    select o_orderkey, l_linenumber from orders join lineitem on l_orderkey = o_orderkey where o_orderkey in (select l_orderkey from lineitem where l_quantity >= 49) and l_linenumber between 2 and 4
""")
def neighbour_window(spark: SparkSession, d: str) -> DataFrame:
    """Chunks around hits: an equi-join on the document with a range residual, prefiltered by a semi-join."""
    items = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    hits = items.where("l_quantity >= 49").select("l_orderkey").distinct()
    near = items.where("l_linenumber between 2 and 4").join(hits, "l_orderkey", "left_semi")
    return read(spark, d, "orders").select("o_orderkey").join(near, F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderkey", "l_linenumber")


@query("""
    with t as (select o_custkey, o_orderkey, o_totalprice, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as rn from orders)
    select o_custkey, round(max(case when rn = 1 then o_totalprice end) / (sum(o_totalprice) / count(*)), 6) as flatness, count(*) as n from t where rn <= 5 group by o_custkey
""")
def flatness_ratio(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    t = read(spark, d, "orders").withColumn("rn", F.row_number().over(w)).where("rn <= 5")
    return t.groupBy("o_custkey").agg(F.round(F.max(F.when(F.col("rn") == 1, F.col("o_totalprice"))) / F.avg("o_totalprice"), 6).alias("flatness"), F.count(F.lit(1)).alias("n"))


@query("""
    select r_name, n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue from lineitem join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey
    where l_returnflag <> 'R' group by r_name, n_name
""")
def revenue_by_department(spark: SparkSession, d: str) -> DataFrame:
    """The fact table is combined by supplier first; names are joined to the sums."""
    rev = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    by = read(spark, d, "lineitem").where("l_returnflag <> 'R'").groupBy("l_suppkey").agg(F.sum(rev).alias("rev"))
    n, r = read(spark, d, "nation"), read(spark, d, "region")
    j = by.join(read(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(F.broadcast(n), F.col("s_nationkey") == F.col("n_nationkey")).join(F.broadcast(r), F.col("n_regionkey") == F.col("r_regionkey"))
    return j.groupBy("r_name", "n_name").agg(F.round(F.sum("rev"), 2).alias("revenue"))


@query("""
    select event_id, ts from events where ts > (select max(ts) - interval '2 days' from events) order by ts, event_id limit 100
""")
def watermark_pull(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events").select("event_id", "ts")
    seen = e.agg((F.max("ts") - F.expr("interval 2 days")).alias("seen"))
    return e.crossJoin(F.broadcast(seen)).where("ts > seen").select("event_id", "ts").orderBy("ts", "event_id").limit(100)


@query("select event_id, event_type from events where event_type = 'signup' order by event_id limit 50")
def claim_pending(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "events").where("event_type = 'signup'").select("event_id", "event_type").orderBy("event_id").limit(50)


@query("""
    with a as (select event_id, date_diff('minute', ts, (select max(ts) from events)) as age, event_type from events where event_type in ('signup', 'error'))
    select case when age >= 60 then 'ERROR' when age >= 15 then 'REQUEUE' else 'WAIT' end as action, event_type, count(*) as n from a group by all
""")
def stuck_task_recovery(spark: SparkSession, d: str) -> DataFrame:
    from foliant.streaming.tasks import recovery_action

    e = read(spark, d, "events")
    now = e.agg(F.max("ts").alias("now"))
    minute = lambda c: F.floor(F.unix_seconds(F.col(c).cast("timestamp")) / 60)
    minutes = minute("now") - minute("ts")
    a = e.where(F.col("event_type").isin("signup", "error")).crossJoin(F.broadcast(now)).select("event_type", recovery_action(minutes).alias("action"))
    return a.groupBy("action", "event_type").agg(F.count(F.lit(1)).alias("n"))


@query("select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 20 offset 40")
def paged_listing(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").offset(40).limit(20)


@query("""
    select doc_id, quality, toxic, case when quality = 1 and toxic = 0 then 'keep' when toxic = 1 then 'reject' else 'review' end as gate from documents join labels using (doc_id)
""")
def label_gate(spark: SparkSession, d: str) -> DataFrame:
    g = F.when((F.col("quality") == 1) & (F.col("toxic") == 0), "keep").when(F.col("toxic") == 1, "reject").otherwise("review")
    return read(spark, d, "documents").select("doc_id").join(read(spark, d, "labels"), "doc_id").select("doc_id", "quality", "toxic", g.alias("gate"))
