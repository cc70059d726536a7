"""Joins, counts, top lists and set operations of the service's tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.ordered import latest_per_key, latest_with_ties, top_per_group
from ..registry import query
from ..sources.tables import COMPANIES_SQL, companies, table


@query("latest_snapshot_per_key", "SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
def latest_snapshot(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice", "o_orderdate")
    return latest_per_key(orders, ["o_custkey"], "o_orderdate", "o_orderkey").select("o_custkey", "o_orderkey", "o_totalprice")


@query("latest_snapshot_selfjoin", "SELECT o.o_custkey, o_orderkey FROM orders o JOIN (SELECT o_custkey, max(o_orderdate) AS m FROM orders GROUP BY 1) l ON o.o_custkey = l.o_custkey AND o_orderdate = m")
def latest_selfjoin(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    return latest_with_ties(orders, "o_custkey", "o_orderdate").select("o_custkey", "o_orderkey")


@query("cards_join_companies", f"WITH {COMPANIES_SQL} SELECT sector, count(*) AS n, round(avg(e.vec_id), 4) AS mean_id FROM embeddings e JOIN companies c ON c.company_id = e.label GROUP BY 1")
def cards_companies(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").select(F.col("label").cast("long").alias("company_id"), "vec_id")
    return e.join(companies(spark, d), "company_id").groupBy("sector").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("vec_id"), 4).alias("mean_id"))


@query("recent_sessions_top10", "SELECT o_orderkey, c_name, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey = 3 ORDER BY o_orderdate DESC, o_orderkey LIMIT 10")
def recent_sessions(spark: SparkSession, d: str) -> DataFrame:
    some = table(spark, d, "customer").where("c_nationkey = 3")
    both = table(spark, d, "orders").join(some, F.col("o_custkey") == F.col("c_custkey"))
    return both.orderBy(F.desc("o_orderdate"), "o_orderkey").limit(10).select("o_orderkey", "c_name", "o_totalprice")


@query("semi_has_filing", "SELECT d.doc_id, lang FROM documents d WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND quality = 1)")
def semi_filing(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "lang").join(table(spark, d, "labels").where("quality = 1"), "doc_id", "left_semi")


@query("anti_missing_filing", "SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def anti_filing(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, d, "orders").select("o_orderkey").join(items, "o_orderkey", "left_anti")


@query("having_min_cards", "SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM lineitem GROUP BY 1 HAVING count(*) >= 10)")
def having_min(spark: SparkSession, d: str) -> DataFrame:
    many = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.count(F.lit(1)).alias("n")).where("n >= 10")
    return table(spark, d, "supplier").select("s_suppkey", "s_name").join(many, "s_suppkey", "left_semi")


@query("count_per_group", "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1")
def count_group(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


@query("conditional_counts", "SELECT lang, count(*) AS n, count(*) FILTER (n_chars > 1000) AS long_texts, count(source) AS with_source FROM documents GROUP BY 1")
def conditional(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").groupBy("lang").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("n_chars") > 1000).alias("long_texts"), F.count("source").alias("with_source")
    )


@query("coverage_percent", "SELECT count(*) AS n, CASE WHEN count(*) > 0 THEN round(100.0 * count(l.doc_id) / count(*), 4) ELSE 0 END AS labelled FROM documents d LEFT JOIN labels l USING (doc_id)")
def coverage(spark: SparkSession, d: str) -> DataFrame:
    both = table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels").withColumn("has", F.lit(1)), "doc_id", "left")
    n = F.count(F.lit(1))
    return both.agg(n.alias("n"), F.when(n > 0, F.round(100.0 * F.count("has") / n, 4)).otherwise(0.0).alias("labelled"))


@query("relational_division", "SELECT l_suppkey FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_returnflag) = (SELECT count(DISTINCT l_returnflag) FROM lineitem)")
def division(spark: SparkSession, d: str) -> DataFrame:
    flags = table(spark, d, "lineitem").select("l_suppkey", "l_returnflag").distinct()
    need = flags.agg(F.countDistinct("l_returnflag").alias("need"))
    return flags.groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n")).crossJoin(F.broadcast(need)).where("n = need").select("l_suppkey")


@query("left_join_chain", "SELECT c_custkey, n_name, r_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey")
def left_chain(spark: SparkSession, d: str) -> DataFrame:
    nation, region = table(spark, d, "nation"), table(spark, d, "region")
    both = table(spark, d, "customer").join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return both.join(F.broadcast(region), F.col("n_regionkey") == F.col("r_regionkey"), "left").select("c_custkey", "n_name", "r_name")


@query("common_session_latest", """SELECT max(d) AS latest, min(d) AS earliest, count(*) AS n FROM (
  SELECT l_shipdate::DATE AS d FROM lineitem WHERE l_suppkey = 1 INTERSECT SELECT l_shipdate::DATE FROM lineitem WHERE l_suppkey = 2)""")
def common_session(spark: SparkSession, d: str) -> DataFrame:
    days = lambda k: table(spark, d, "lineitem").where(F.col("l_suppkey") == k).select(F.to_date("l_shipdate").alias("d"))
    return days(1).intersect(days(2)).agg(F.max("d").alias("latest"), F.min("d").alias("earliest"), F.count(F.lit(1)).alias("n"))


@query("set_difference", "SELECT c_nationkey FROM customer WHERE c_acctbal > 0 EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000")
def difference(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "customer").where("c_acctbal > 0").select("c_nationkey")
    return a.subtract(table(spark, d, "supplier").where("s_acctbal > 5000").select("s_nationkey"))


#: Months in one word of bits.
MONTHS = 62


@query("expiry_common_nearest", """SELECT a.l_suppkey AS left_id, b.l_suppkey AS right_id, min(a.e) AS expiry FROM
  (SELECT DISTINCT l_suppkey, date_trunc('month', l_shipdate)::DATE AS e FROM lineitem) a
  JOIN (SELECT DISTINCT l_suppkey, date_trunc('month', l_shipdate)::DATE AS e FROM lineitem) b ON a.e = b.e AND a.l_suppkey < b.l_suppkey
  WHERE a.e >= DATE '1996-01-01' GROUP BY 1, 2""")
def common_expiry(spark: SparkSession, d: str) -> DataFrame:
    """The first month that each pair of suppliers has in common: a supplier is one row of bits, a pair one test of two rows."""
    months = F.months_between(F.trunc("l_shipdate", "month"), F.lit("1996-01-01").cast("date")).cast("int")
    e = table(spark, d, "lineitem").where("l_shipdate >= DATE '1996-01-01' AND l_suppkey IS NOT NULL").select(F.col("l_suppkey").alias("id"), months.alias("m")).distinct()
    words = (e.agg(F.max("m")).first()[0] or 0) // MONTHS + 1
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("m") % MONTHS)
    held = [F.coalesce(F.bit_or(F.when(F.floor(F.col("m") / MONTHS) == k, bit)), F.lit(0).cast("long")).alias(f"w{k}") for k in range(words)]
    rows = e.groupBy("id").agg(*held)
    side = lambda s: rows.select(F.col("id").alias(f"{s}_id"), *[F.col(f"w{k}").alias(f"{s}_w{k}") for k in range(words)])
    common = [F.col(f"left_w{k}").bitwiseAND(F.col(f"right_w{k}")) for k in range(words)]
    met = reduce(lambda x, y: x | y, [c != 0 for c in common])
    spread = side("left").repartition(4 * spark.sparkContext.defaultParallelism)
    pairs = spread.join(F.broadcast(side("right")), (F.col("left_id") < F.col("right_id")) & met)
    first = F.coalesce(*[F.when(c != 0, k * MONTHS + F.bit_count(c.bitwiseAND(-c) - 1)) for k, c in enumerate(common)])
    return pairs.select("left_id", "right_id", F.add_months(F.lit("1996-01-01").cast("date"), first.cast("int")).alias("expiry"))


@query("upsert_prune", """WITH old AS (SELECT c_custkey AS id, c_acctbal AS bal FROM customer WHERE c_custkey % 3 <> 0),
new AS (SELECT c_custkey AS id, c_acctbal + 1 AS bal FROM customer WHERE c_custkey % 2 = 0), merged AS (SELECT coalesce(n.id, o.id) AS id, coalesce(n.bal, o.bal) AS bal FROM old o FULL JOIN new n ON o.id = n.id)
SELECT id, bal FROM merged WHERE id IN (SELECT o_custkey FROM orders)""")
def upsert_prune(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("bal"))
    old, new = c.where("id % 3 <> 0").alias("o"), c.where("id % 2 = 0").withColumn("bal", F.col("bal") + 1).alias("n")
    merged = old.join(new, F.col("o.id") == F.col("n.id"), "full").select(F.coalesce("n.id", "o.id").alias("id"), F.coalesce("n.bal", "o.bal").alias("bal"))
    return merged.join(table(spark, d, "orders").select(F.col("o_custkey").alias("id")), "id", "left_semi")


@query("replace_refresh", """SELECT l_suppkey, count(*) AS n, round(sum(l_quantity), 4) AS q FROM (SELECT l_suppkey, l_quantity FROM lineitem WHERE l_suppkey NOT IN (1, 2)
  UNION ALL SELECT l_suppkey, l_quantity FROM lineitem WHERE l_suppkey IN (1, 2) AND l_shipdate >= TIMESTAMP '1998-01-01') GROUP BY 1""")
def replace_refresh(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "lineitem").select("l_suppkey", "l_quantity", "l_shipdate")
    due = spark.createDataFrame([(1,), (2,)], "l_suppkey long")
    kept = items.join(F.broadcast(due), "l_suppkey", "left_anti")
    fresh = items.join(F.broadcast(due), "l_suppkey", "left_semi").where("l_shipdate >= TIMESTAMP_NTZ '1998-01-01 00:00:00'")
    return kept.unionByName(fresh).groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 4).alias("q"))


@query("dynamic_sort_nulls_last", "SELECT s_suppkey, v FROM (SELECT s_suppkey, CASE WHEN s_suppkey % 5 = 0 THEN NULL ELSE s_acctbal END AS v FROM supplier) ORDER BY v DESC NULLS LAST, s_suppkey LIMIT 15")
def nulls_last(spark: SparkSession, d: str) -> DataFrame:
    v = F.when(F.col("s_suppkey") % 5 != 0, F.col("s_acctbal")).alias("v")
    return table(spark, d, "supplier").select("s_suppkey", v).orderBy(F.desc_nulls_last("v"), "s_suppkey").limit(15)


@query("rerank_after_exclusion", "SELECT s_suppkey, CASE WHEN k <= 10 THEN k END AS rank FROM (SELECT s_suppkey, row_number() OVER (ORDER BY s_acctbal DESC, s_suppkey) AS k FROM supplier WHERE s_nationkey <> 4 ORDER BY s_acctbal DESC, s_suppkey LIMIT 20)")
def rerank(spark: SparkSession, d: str) -> DataFrame:
    top = table(spark, d, "supplier").where("s_nationkey <> 4").orderBy(F.desc("s_acctbal"), "s_suppkey").limit(20)
    k = F.row_number().over(Window.orderBy(F.desc("s_acctbal"), "s_suppkey")).cast("long")  # twenty rows
    return top.select("s_suppkey", F.when(k <= 10, k).alias("rank"))


@query("subject_strengths_top3", "SELECT l_suppkey, l_returnflag, round(q, 4) AS q FROM (SELECT l_suppkey, l_returnflag, sum(l_quantity) AS q FROM lineitem GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY l_returnflag ORDER BY q DESC, l_suppkey) <= 3")
def strengths(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "lineitem").groupBy("l_suppkey", "l_returnflag").agg(F.sum("l_quantity").alias("q"))
    return top_per_group(q, ["l_returnflag"], [F.desc("q"), F.asc("l_suppkey")], 3).select("l_suppkey", "l_returnflag", F.round("q", 4).alias("q"))


@query("date_range_chunks", """WITH r AS (SELECT user_id, min(ts)::DATE AS a, max(ts)::DATE AS b FROM events GROUP BY 1)
SELECT user_id, f::DATE AS chunk_from, least(f::DATE + 6, b) AS chunk_to FROM (SELECT user_id, b, unnest(generate_series(a::TIMESTAMP, b::TIMESTAMP, INTERVAL 7 DAY)) AS f FROM r)""")
def date_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Each user's span of events in chunks of seven days, the last one cut at its end."""
    day = F.to_date("ts")
    spans = table(spark, d, "events").groupBy("user_id").agg(F.min(day).alias("a"), F.max(day).alias("b")).where("a IS NOT NULL")
    chunks = spans.select("user_id", "b", F.explode(F.sequence("a", "b", F.expr("INTERVAL 7 DAYS"))).alias("chunk_from"))
    return chunks.select("user_id", "chunk_from", F.least(F.date_add("chunk_from", 6), F.col("b")).alias("chunk_to"))


@query("completeness_percent", "SELECT s_suppkey, round(100.0 * ((s_acctbal > 0)::INT + (s_name IS NOT NULL)::INT + (s_suppkey % 3 <> 0)::INT) / 3, 4) AS completeness FROM supplier")
def completeness(spark: SparkSession, d: str) -> DataFrame:
    values = F.array(F.when(F.col("s_acctbal") > 0, 1), F.when(F.col("s_name").isNotNull(), 1), F.when(F.col("s_suppkey") % 3 != 0, 1))
    return table(spark, d, "supplier").select("s_suppkey", F.round(100.0 * F.size(F.array_compact(values)) / 3, 4).alias("completeness"))


@query("definitive_ratio_confidence", "SELECT o_custkey, round(avg((o_orderstatus <> 'P')::INT), 6) AS confidence FROM orders GROUP BY 1")
def definitive(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.round(F.avg((F.col("o_orderstatus") != "P").cast("int")), 6).alias("confidence"))


@query("order_preserving_dedupe", "SELECT conv_id, string_agg(role, ',' ORDER BY t) AS roles FROM (SELECT conv_id, role, min(turn) AS t FROM conversations GROUP BY 1, 2) GROUP BY 1")
def preserving_dedupe(spark: SparkSession, d: str) -> DataFrame:
    first = table(spark, d, "conversations").groupBy("conv_id", "role").agg(F.min("turn").alias("t"))
    return first.groupBy("conv_id").agg(F.array_join(F.sort_array(F.collect_list(F.struct("t", "role")))["role"], ",").alias("roles"))


@query("worker_confidence", """WITH c AS (SELECT o_custkey, avg((o_orderstatus <> 'P')::INT) AS definitive, bool_or(o_orderkey % 29 = 0) AS timed_out FROM orders GROUP BY 1)
SELECT c_custkey, round(coalesce(definitive, 1.0) * CASE WHEN timed_out THEN 0.7 ELSE 1.0 END, 6) AS confidence FROM customer LEFT JOIN c ON o_custkey = c_custkey""")
def worker_confidence(spark: SparkSession, d: str) -> DataFrame:
    """The share of conditions with an answer, times 0.7 after a timeout; 1 without conditions."""
    orders = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.avg((F.col("o_orderstatus") != "P").cast("int")).alias("definitive"), F.bool_or(F.col("o_orderkey") % 29 == 0).alias("timed_out"))
    each = table(spark, d, "customer").select("c_custkey").join(orders, "c_custkey", "left")
    return each.select("c_custkey", F.round(F.coalesce("definitive", F.lit(1.0)) * F.when(F.col("timed_out"), 0.7).otherwise(1.0), 6).alias("confidence"))
