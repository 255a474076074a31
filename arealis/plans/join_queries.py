"""Queries that join: lookups, as-of, interval, cascades, crosswalks, rule routing, set operations and survey averages."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from arealis.operators import joins as J
from arealis.operators import panel as P
from arealis.operators import polls as S
from arealis.plans.catalog import CELL, PANEL, Tables, query, rounded


@query("join_equi_inner", "SELECT o_orderkey, c_name, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey")
def join_equi_inner(spark, d):
    t = Tables(spark, d)
    return t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name", "o_totalprice")


@query("join_equi_left", f"WITH {PANEL}, m AS (SELECT event, avg(A) AS mean_A FROM panel WHERE event % 2 = 0 GROUP BY 1) SELECT unit, event, round(mean_A, 6) AS mean_A FROM panel LEFT JOIN m USING (event)")
def join_equi_left(spark, d):
    panel = Tables(spark, d).panel()
    means = P.event_means(panel.where("event % 2 = 0"), ["event"], ["A"])
    return rounded(panel.join(means, "event", "left").select("unit", "event", "mean_A"))


@query("join_semi", "SELECT o_orderkey FROM orders SEMI JOIN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45) ON l_orderkey = o_orderkey")
def join_semi(spark, d):
    t = Tables(spark, d)
    return t.orders.join(t.lineitem.where("l_quantity > 45"), F.col("l_orderkey") == F.col("o_orderkey"), "left_semi").select("o_orderkey")


@query("join_anti", "SELECT o_orderkey FROM orders ANTI JOIN lineitem ON l_orderkey = o_orderkey")
def join_anti(spark, d):
    t = Tables(spark, d)
    return t.orders.join(t.lineitem, F.col("l_orderkey") == F.col("o_orderkey"), "left_anti").select("o_orderkey")


@query("join_dim_lookup", "SELECT c_custkey, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def join_dim_lookup(spark, d):
    t = Tables(spark, d)
    places = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    return t.customer.join(places, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name", "r_name")


@query("join_coalesce_geo", "WITH a AS (SELECT s_nationkey, avg(s_acctbal) AS v FROM supplier WHERE s_nationkey % 3 = 0 GROUP BY 1), b AS (SELECT n_regionkey, avg(s_acctbal) AS v FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey <> 2 GROUP BY 1) SELECT n_nationkey, round(coalesce(a.v, b.v, -1), 6) AS v FROM nation LEFT JOIN a ON s_nationkey = n_nationkey LEFT JOIN b USING (n_regionkey)")
def join_coalesce_geo(spark, d):
    t = Tables(spark, d)
    own = t.supplier.where("s_nationkey % 3 = 0").groupBy("s_nationkey").agg(F.avg("s_acctbal").alias("own"))
    near = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).where("n_regionkey <> 2").groupBy("n_regionkey").agg(F.avg("s_acctbal").alias("near"))
    out = t.nation.join(own, F.col("s_nationkey") == F.col("n_nationkey"), "left").join(near, "n_regionkey", "left")
    return rounded(out.select("n_nationkey", F.coalesce("own", "near", F.lit(-1.0)).alias("v")))


@query("join_cascade_source", "WITH a AS (SELECT s_nationkey AS k, min(s_acctbal) AS v FROM supplier WHERE s_nationkey % 4 = 0 GROUP BY 1), b AS (SELECT c_nationkey AS k, min(c_acctbal) AS v FROM customer WHERE c_nationkey % 2 = 0 GROUP BY 1) SELECT n_nationkey AS k, coalesce(a.v, b.v) AS v, CASE WHEN a.v IS NOT NULL THEN 'supplier' ELSE 'customer' END AS source FROM nation LEFT JOIN a ON a.k = n_nationkey LEFT JOIN b ON b.k = n_nationkey WHERE coalesce(a.v, b.v) IS NOT NULL")
def join_cascade_source(spark, d):
    t = Tables(spark, d)
    a = t.supplier.where("s_nationkey % 4 = 0").groupBy(F.col("s_nationkey").alias("k")).agg(F.min("s_acctbal").alias("v"))
    b = t.customer.where("c_nationkey % 2 = 0").groupBy(F.col("c_nationkey").alias("k")).agg(F.min("c_acctbal").alias("v"))
    return J.cascade(t.nation.select(F.col("n_nationkey").alias("k")), [("supplier", a), ("customer", b)], ["k"], "v")


@query("join_cascade_missing", "WITH known AS (SELECT DISTINCT l_orderkey FROM lineitem), missing AS (SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM known)), a AS (SELECT o_custkey, max(o_totalprice) AS v FROM orders WHERE o_orderstatus = 'P' GROUP BY 1) SELECT o_orderkey, coalesce(a.v, 0) AS v, CASE WHEN a.v IS NULL THEN 'default' ELSE 'customer' END AS source FROM missing LEFT JOIN a USING (o_custkey)")
def join_cascade_missing(spark, d):
    t = Tables(spark, d)
    missing = t.orders.join(t.lineitem, F.col("l_orderkey") == F.col("o_orderkey"), "left_anti").select("o_orderkey", "o_custkey")
    a = t.orders.where("o_orderstatus = 'P'").groupBy("o_custkey").agg(F.max("o_totalprice").alias("v"))
    out = J.cascade(missing, [("customer", a)], ["o_custkey"], "v", keep_missing=True)
    return out.select("o_orderkey", F.coalesce("v", F.lit(0.0)).alias("v"), F.coalesce("source", F.lit("default")).alias("source"))


@query("join_override_finer", "WITH f AS (SELECT c_custkey, c_nationkey, CASE WHEN c_custkey % 3 = 0 THEN c_acctbal END AS v FROM customer), p AS (SELECT c_nationkey, max(c_acctbal) AS p FROM customer GROUP BY 1) SELECT c_custkey, c_nationkey, coalesce(v, p) AS v, v IS NOT NULL AS is_fine FROM f JOIN p USING (c_nationkey)")
def join_override_finer(spark, d):
    people = Tables(spark, d).customer
    fine = people.select("c_custkey", "c_nationkey", F.when(F.col("c_custkey") % 3 == 0, F.col("c_acctbal")).alias("v"))
    coarse = people.groupBy("c_nationkey").agg(F.max("c_acctbal").alias("v"))
    return J.override(fine, coarse, "c_custkey", "c_nationkey", "v")


@query("join_crosswalk_weighted", "WITH w AS (SELECT l_partkey, s_nationkey, sum(l_quantity) AS w FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2) SELECT s_nationkey, p_type, round(sum(w * p_retailprice) / sum(w), 6) AS p_retailprice FROM w JOIN part ON p_partkey = l_partkey GROUP BY 1, 2")
def join_crosswalk_weighted(spark, d):
    t = Tables(spark, d)
    weights = t.lineitem.join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey")).groupBy(F.col("l_partkey").alias("p_partkey"), "s_nationkey").agg(F.sum("l_quantity").alias("w"))
    return rounded(J.crosswalk(t.part.select("p_partkey", "p_type", "p_retailprice"), weights, "p_partkey", "s_nationkey", ["p_type"], "p_retailprice", "w"))


READ = "r AS (SELECT user_id, CAST(ts AS DATE) + INTERVAL 1 DAY AS published, avg(value) AS v FROM events GROUP BY user_id, CAST(ts AS DATE))"


def readings(t: Tables):
    """Daily mean per user, published the next day."""
    daily = t.events.groupBy("user_id", F.to_date("ts").alias("day")).agg(F.avg("value").alias("v"))
    return daily.select("user_id", F.date_add("day", 1).cast("timestamp_ntz").alias("published"), "v")


@query("join_asof_backward", f"WITH {READ} SELECT event_id, round(v, 6) AS v FROM events e ASOF LEFT JOIN r ON e.user_id = r.user_id AND e.ts >= r.published")
def join_asof_backward(spark, d):
    t = Tables(spark, d)
    seen = t.events.select("event_id", "user_id", F.col("ts").cast("timestamp_ntz").alias("ts"))
    return rounded(J.asof(seen, readings(t), ["user_id"], "ts", "published", ["v"]).select("event_id", "v"))


@query("join_asof_strict", "WITH o AS (SELECT o_custkey, o_orderdate AS at, max(o_totalprice) AS v FROM orders WHERE o_orderstatus IN ('F', 'O') GROUP BY 1, 2) SELECT o_orderkey, v FROM (SELECT * FROM orders WHERE o_orderstatus = 'P') p ASOF LEFT JOIN o ON p.o_custkey = o.o_custkey AND p.o_orderdate > o.at")
def join_asof_strict(spark, d):
    orders = Tables(spark, d).orders
    known = orders.where("o_orderstatus in ('F', 'O')").groupBy("o_custkey", F.col("o_orderdate").alias("at")).agg(F.max("o_totalprice").alias("v"))
    asked = orders.where("o_orderstatus = 'P'").select("o_orderkey", "o_custkey", "o_orderdate")
    return J.asof(asked, known, ["o_custkey"], "o_orderdate", "at", ["v"], strict=True).select("o_orderkey", "v")


@query("join_asof_shifted", f"WITH {READ} SELECT event_id, round(a.v - b.v, 6) AS change FROM (SELECT event_id, v FROM events e ASOF LEFT JOIN r ON e.user_id = r.user_id AND e.ts >= r.published) a JOIN (SELECT event_id, v FROM (SELECT event_id, user_id, ts - INTERVAL 5 DAY AS ts FROM events) e ASOF LEFT JOIN r ON e.user_id = r.user_id AND e.ts >= r.published) b USING (event_id)")
def join_asof_shifted(spark, d):
    t = Tables(spark, d)
    seen = t.events.select("event_id", "user_id", F.col("ts").cast("timestamp_ntz").alias("ts"))
    r = readings(t)
    now = J.asof(seen, r, ["user_id"], "ts", "published", ["v"])
    both = J.asof(now.withColumn("then", F.expr("ts - interval 5 days")), r.withColumnRenamed("v", "v5"), ["user_id"], "then", "published", ["v5"])
    return rounded(both.select("event_id", (F.col("v") - F.col("v5")).alias("change")))


DATES = ["2024-01-08", "2024-01-15", "2024-01-22", "2024-01-29"]
POLL = f"p AS (SELECT CAST(unnest({DATES}) AS DATE) AS poll_date)"
SURVEY = f"""{POLL}, s AS (SELECT poll_date, user_id % 10 AS institute, CAST(ts AS DATE) AS day, event_type AS block, sum(value) AS v FROM events JOIN p ON CAST(ts AS DATE) BETWEEN poll_date - 7 AND poll_date GROUP BY 1, 2, 3, 4),
n AS (SELECT poll_date, institute, day, block, 100 * v / sum(v) OVER (PARTITION BY poll_date, institute, day) AS share, count(*) OVER (PARTITION BY poll_date, institute, day) AS k FROM s), c AS (SELECT * FROM n WHERE k = 5)"""


def surveys(t: Tables):
    dates = t.spark.createDataFrame([(x,) for x in DATES], "poll_date string").select(F.to_date("poll_date").alias("poll_date"))
    rows = t.events.select("ts", (F.col("user_id") % 10).alias("institute"), F.col("event_type").alias("block"), "value")
    near = J.interval(rows, dates, "ts", "poll_date", 7)
    return S.shares(near.withColumn("day", F.to_date("ts")), ["poll_date", "institute", "day"], "block", "value", 5)


@query("join_interval", f"WITH {POLL} SELECT poll_date, count(*) AS n, round(sum(value), 4) AS total FROM events JOIN p ON CAST(ts AS DATE) BETWEEN poll_date - 7 AND poll_date GROUP BY 1")
def join_interval(spark, d):
    t = Tables(spark, d)
    dates = spark.createDataFrame([(x,) for x in DATES], "poll_date string").select(F.to_date("poll_date").alias("poll_date"))
    return rounded(J.interval(t.events.select("ts", "value"), dates, "ts", "poll_date", 7).groupBy("poll_date").agg(F.count("*").alias("n"), F.sum("value").alias("total")), 4)


@query("agg_poll_shares", f"WITH {SURVEY} SELECT poll_date, institute, day, block, round(share, 6) AS share FROM c")
def agg_poll_shares(spark, d):
    return rounded(surveys(Tables(spark, d)).select("poll_date", "institute", "day", "block", "share"))


@query("agg_poll_average", f"WITH {SURVEY}, i AS (SELECT poll_date, institute, block, avg(share) AS share FROM c GROUP BY 1, 2, 3) SELECT poll_date, block, round(avg(share), 6) AS share FROM i GROUP BY 1, 2")
def agg_poll_average(spark, d):
    return rounded(S.average(surveys(Tables(spark, d)), ["poll_date"], "institute", "block"))


TRUTH = "truth AS (SELECT poll_date, block, avg(share) AS truth FROM c GROUP BY 1, 2)"


@query("agg_house_effects", f"WITH {SURVEY}, {TRUTH} SELECT institute, block, count(*) AS n, round(avg(share - truth) * count(*) / (count(*) + 2), 6) AS effect FROM c JOIN truth USING (poll_date, block) GROUP BY 1, 2")
def agg_house_effects(spark, d):
    s = surveys(Tables(spark, d))
    return rounded(S.house_effects(s, s.groupBy("poll_date", "block").agg(F.avg("share").alias("truth")), ["poll_date", "block"], "institute", "block"))


@query("topk_errors", f"WITH {SURVEY}, {TRUTH}, h AS (SELECT institute, block, avg(share - truth) * count(*) / (count(*) + 2) AS effect FROM c JOIN truth USING (poll_date, block) GROUP BY 1, 2) SELECT institute, block, round(effect, 6) AS effect FROM h ORDER BY abs(effect) DESC, institute, block LIMIT 5")
def topk_errors(spark, d):
    s = surveys(Tables(spark, d))
    h = S.house_effects(s, s.groupBy("poll_date", "block").agg(F.avg("share").alias("truth")), ["poll_date", "block"], "institute", "block")
    return rounded(h.select("institute", "block", "effect").orderBy(F.desc(F.abs("effect")), "institute", "block").limit(5))


@query("agg_weighted_recent", f"WITH {SURVEY}, w AS (SELECT *, exp(-0.1 * date_diff('day', day, poll_date)) AS w FROM c), r AS (SELECT poll_date, block, sum(w * share) / sum(w) AS share FROM w GROUP BY 1, 2) SELECT poll_date, block, round(100 * share / sum(share) OVER (PARTITION BY poll_date), 6) AS share FROM r")
def agg_weighted_recent(spark, d):
    return rounded(S.recent(surveys(Tables(spark, d)), "poll_date", "day", "block", 0.1))


@query(
    "st_lambda_selection",
    f"WITH {SURVEY}, {TRUTH}, g AS (SELECT unnest(CAST([0.0, 0.05, 0.1, 0.2, 0.5, 1.0, 2.0] AS DOUBLE[])) AS rate), r AS (SELECT rate, poll_date, block, sum(exp(-rate * date_diff('day', day, poll_date)) * share) / sum(exp(-rate * date_diff('day', day, poll_date))) AS e FROM c, g GROUP BY 1, 2, 3) SELECT rate, round(sqrt(avg((e - truth) * (e - truth))), 6) AS rmse FROM r JOIN truth USING (poll_date, block) GROUP BY 1",
)
def st_lambda_selection(spark, d):
    s = surveys(Tables(spark, d))
    return rounded(S.rate_errors(s, s.groupBy("poll_date", "block").agg(F.avg("share").alias("truth")), "poll_date", "day", "block", [0.0, 0.05, 0.1, 0.2, 0.5, 1.0, 2.0]))


MAP = "CASE WHEN p_type IN ('ECONOMY', 'PROMO') THEN 'low' WHEN p_brand LIKE 'Brand#1%' THEN 'one' WHEN p_brand LIKE '%5%' THEN 'five' ELSE 'other' END"


@query("map_party_block", f"SELECT p_partkey, {MAP} AS block FROM part")
def map_party_block(spark, d):
    part = Tables(spark, d).part
    exact = J.rule_chain(F.col("p_type"), [("exact", {"ECONOMY": "low", "PROMO": "low"})], "")
    rest = J.rule_chain(F.col("p_brand"), [("prefix", [("Brand#1", "one")]), ("substring", [("5", "five")])], "other")
    return part.select("p_partkey", F.coalesce(F.nullif(exact, F.lit("")), rest).alias("block"))


@query("map_overrides", f"SELECT p_partkey, CASE WHEN p_partkey IN (1, 5, 9) THEN 'hand' ELSE {MAP} END AS block FROM part")
def map_overrides(spark, d):
    hand = spark.createDataFrame([(1, "hand"), (5, "hand"), (9, "hand")], "p_partkey long, by_hand string")
    routed = map_party_block(spark, d)
    return routed.join(F.broadcast(hand), "p_partkey", "left").select("p_partkey", F.coalesce("by_hand", "block").alias("block"))


@query("map_rare_to_unknown", "SELECT l_orderkey, l_linenumber, CASE WHEN count(*) OVER (PARTITION BY l_partkey, l_suppkey) < 2 THEN 'unknown' ELSE CAST(l_partkey AS VARCHAR) END AS name FROM lineitem")
def map_rare_to_unknown(spark, d):
    lines = Tables(spark, d).lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    name = J.rare_to_unknown(lines, ["l_partkey", "l_suppkey"], "l_partkey", 2)
    return name.select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("name"))


@query("map_lineage", "WITH o AS (SELECT o_custkey, o_orderdate AS at, min(o_orderstatus) AS s FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1, 2) SELECT o_orderkey, coalesce(s, 'none') AS status FROM (SELECT * FROM orders WHERE o_orderstatus = 'P') p ASOF LEFT JOIN o ON p.o_custkey = o.o_custkey AND p.o_orderdate > o.at")
def map_lineage(spark, d):
    orders = Tables(spark, d).orders
    known = orders.where("o_orderstatus <> 'P'").groupBy("o_custkey", F.col("o_orderdate").alias("at")).agg(F.min("o_orderstatus").alias("s"))
    asked = orders.where("o_orderstatus = 'P'").select("o_orderkey", "o_custkey", "o_orderdate")
    return J.asof(asked, known, ["o_custkey"], "o_orderdate", "at", ["s"], strict=True).select("o_orderkey", F.coalesce("s", F.lit("none")).alias("status"))


@query("map_name_resolution", "WITH x AS (SELECT c_custkey, c_nationkey, CASE WHEN c_custkey % 4 = 0 THEN c_name END AS name FROM customer), f AS (SELECT c_nationkey, min(name) AS first FROM x WHERE name IS NOT NULL GROUP BY 1) SELECT c_custkey, coalesce(name, first, 'unknown') AS name FROM x LEFT JOIN f USING (c_nationkey)")
def map_name_resolution(spark, d):
    x = Tables(spark, d).customer.select("c_custkey", "c_nationkey", F.when(F.col("c_custkey") % 4 == 0, F.col("c_name")).alias("name"))
    first = J.first_by(x.where("name is not null"), ["c_nationkey"], ["name"]).select("c_nationkey", F.col("name").alias("first"))
    return x.join(first, "c_nationkey", "left").select("c_custkey", F.coalesce("name", "first", F.lit("unknown")).alias("name"))


@query("map_pipeline", f"SELECT block, round(sum(l_quantity), 6) AS votes FROM (SELECT CASE WHEN p_partkey IN (1, 5, 9) THEN 'hand' ELSE {MAP} END AS block, l_quantity FROM lineitem JOIN part ON l_partkey = p_partkey) GROUP BY 1")
def map_pipeline(spark, d):
    lines = Tables(spark, d).lineitem
    return rounded(lines.join(map_overrides(spark, d), F.col("l_partkey") == F.col("p_partkey")).groupBy("block").agg(F.sum("l_quantity").alias("votes")))


@query("agg_mapping_coverage", f"SELECT p_type, round(100.0 * count(*) FILTER ({MAP} <> 'other') / count(*), 6) AS mapped FROM part GROUP BY 1")
def agg_mapping_coverage(spark, d):
    part = Tables(spark, d).part.join(map_party_block(spark, d), "p_partkey")
    return rounded(part.groupBy("p_type").agg(P.ratio(F.count_if(F.col("block") != "other"), F.count("*"), 100.0).alias("mapped")))


@query("join_exact_date_key", f"WITH {CELL}, k AS (SELECT unit, CAST(round(event * 1.0 * 100) AS INTEGER) AS event_key, sum(votes) AS votes FROM cell GROUP BY 1, 2) SELECT unit, event_key, votes FROM k WHERE event_key IN (199600, 199700)")
def join_exact_date_key(spark, d):
    from arealis.functions.text import event_key

    keyed = Tables(spark, d).cell().groupBy("unit", event_key(F.col("event") * F.lit(1.0)).alias("event_key")).agg(F.sum("votes").alias("votes"))
    dates = spark.createDataFrame([(1996.0,), (1997.0,)], "years double").select(event_key(F.col("years")).alias("event_key"))
    return keyed.join(F.broadcast(dates), "event_key").select("unit", "event_key", "votes")


@query("join_previous_event_attr", "WITH a AS (SELECT o_custkey, min(o_orderpriority) AS before FROM orders WHERE year(o_orderdate) = 1996 GROUP BY 1) SELECT o_orderkey, before FROM orders LEFT JOIN a USING (o_custkey) WHERE year(o_orderdate) = 1997")
def join_previous_event_attr(spark, d):
    orders = Tables(spark, d).orders
    before = J.first_by(orders.where(F.year("o_orderdate") == 1996), ["o_custkey"], ["o_orderpriority"]).select("o_custkey", F.col("o_orderpriority").alias("before"))
    return orders.where(F.year("o_orderdate") == 1997).join(before, "o_custkey", "left").select("o_orderkey", "before")


@query("set_intersect_keys", "SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT' INTERSECT SELECT o_custkey FROM orders WHERE o_orderpriority = '5-LOW'")
def set_intersect_keys(spark, d):
    orders = Tables(spark, d).orders
    keys = lambda p: orders.where(F.col("o_orderpriority") == p).select("o_custkey")
    return keys("1-URGENT").intersect(keys("5-LOW"))


@query("set_except_keys", "SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders")
def set_except_keys(spark, d):
    t = Tables(spark, d)
    return t.customer.select("c_custkey").subtract(t.orders.select("o_custkey"))


@query("set_union_all", "SELECT s_nationkey AS k, s_acctbal AS v, NULL AS name FROM supplier UNION ALL SELECT c_nationkey, c_acctbal, c_name FROM customer")
def set_union_all(spark, d):
    t = Tables(spark, d)
    a = t.supplier.select(F.col("s_nationkey").alias("k"), F.col("s_acctbal").alias("v"))
    return a.unionByName(t.customer.select(F.col("c_nationkey").alias("k"), F.col("c_acctbal").alias("v"), F.col("c_name").alias("name")), allowMissingColumns=True)


@query("set_union_levels", "WITH u AS (SELECT 'nation' AS level, CAST(n_nationkey AS BIGINT) AS k, n_name AS name, 1 AS p FROM nation UNION ALL SELECT 'region', CAST(r_regionkey AS BIGINT), r_name, 2 FROM region UNION ALL SELECT 'nation', CAST(n_nationkey AS BIGINT), 'late', 3 FROM nation) SELECT level, k, arg_min(name, p) AS name FROM u GROUP BY 1, 2")
def set_union_levels(spark, d):
    t = Tables(spark, d)
    one = lambda df, level, k, name, p: df.select(F.lit(level).alias("level"), F.col(k).cast("long").alias("k"), name.alias("name"), F.lit(p).alias("p"))
    parts = one(t.nation, "nation", "n_nationkey", F.col("n_name"), 1).unionByName(one(t.region, "region", "r_regionkey", F.col("r_name"), 2)).unionByName(one(t.nation, "nation", "n_nationkey", F.lit("late"), 3))
    return J.first_by(parts, ["level", "k"], ["p"]).select("level", "k", "name")


@query("dedup_first", "SELECT o_custkey, arg_min(o_orderkey, struct_pack(d := o_orderdate, k := o_orderkey)) AS o_orderkey FROM orders GROUP BY 1")
def dedup_first(spark, d):
    return J.first_by(Tables(spark, d).orders.select("o_custkey", "o_orderkey", "o_orderdate"), ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey")


@query("dedup_exact", "SELECT DISTINCT l_returnflag, l_linestatus, CAST(year(l_shipdate) AS BIGINT) AS y FROM lineitem")
def dedup_exact(spark, d):
    return Tables(spark, d).lineitem.select("l_returnflag", "l_linestatus", F.year("l_shipdate").cast("long").alias("y")).distinct()


@query("sort_global", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey")
def sort_global(spark, d):
    return Tables(spark, d).orders.select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey")


@query("win_poll_delta", f"WITH {SURVEY}, a AS (SELECT poll_date, block, avg(share) AS share FROM c GROUP BY 1, 2) SELECT poll_date, block, round(share - lag(share) OVER (PARTITION BY block ORDER BY poll_date), 6) AS change FROM a")
def win_poll_delta(spark, d):
    a = surveys(Tables(spark, d)).groupBy("poll_date", "block").agg(F.avg("share").alias("share"))
    return rounded(a.select("poll_date", "block", (F.col("share") - F.lag("share").over(Window.partitionBy("block").orderBy("poll_date"))).alias("change")))
