"""Queries over the panel: shares, levels, deviations, lags, leaders and roll-ups."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from arealis.operators import panel as P
from arealis.plans.catalog import CELL, PANEL, Tables, query, rounded

B = ["A", "N", "R"]


@query("agg_share", f"WITH {CELL} SELECT unit, event, block, round(100 * votes / sum(votes) OVER (PARTITION BY unit, event), 6) AS share FROM cell")
def agg_share(spark, d):
    return rounded(P.share(Tables(spark, d).cell(), ["unit", "event"], "votes").select("unit", "event", "block", "share"))


@query("join_back_group", f"WITH {CELL} SELECT unit, event, block, votes, sum(votes) OVER w AS total, count(*) OVER w AS n_blocks FROM cell WINDOW w AS (PARTITION BY unit, event)")
def join_back_group(spark, d):
    w = Window.partitionBy("unit", "event")
    return Tables(spark, d).cell().select("unit", "event", "block", "votes", F.sum("votes").over(w).alias("total"), F.count("*").over(w).alias("n_blocks"))


@query("agg_block_pivot", f"WITH {PANEL} SELECT unit, parent, event, round(A, 6) AS A, round(N, 6) AS N, round(R, 6) AS R, weight FROM panel")
def agg_block_pivot(spark, d):
    return rounded(Tables(spark, d).panel())


@query("agg_event_mean", f"WITH {PANEL} SELECT event, round(avg(A), 6) AS mean_A, round(avg(N), 6) AS mean_N, round(avg(R), 6) AS mean_R FROM panel GROUP BY event")
def agg_event_mean(spark, d):
    return rounded(P.event_means(Tables(spark, d).panel(), ["event"], B))


@query("agg_event_mean_weighted", f"WITH {PANEL} SELECT event, round(sum(A * weight) / sum(weight), 6) AS mean_A FROM panel GROUP BY event")
def agg_event_mean_weighted(spark, d):
    return rounded(P.event_means(Tables(spark, d).panel(), ["event"], ["A"], "weight"))


@query("win_delta_from_event_mean", f"WITH {PANEL} SELECT unit, event, round(A - avg(A) OVER w, 6) AS dev_A, round(N - avg(N) OVER w, 6) AS dev_N, round(R - avg(R) OVER w, 6) AS dev_R FROM panel WINDOW w AS (PARTITION BY event)")
def win_delta_from_event_mean(spark, d):
    return rounded(P.deviations(Tables(spark, d).panel(), ["event"], B).select("unit", "event", "dev_A", "dev_N", "dev_R"))


@query("win_lag_cross_type", f"WITH {PANEL}, x AS (SELECT *, A - avg(A) OVER (PARTITION BY event) AS dev_A FROM panel) SELECT unit, event, round(lag(A) OVER w, 6) AS A_lag1, round(lag(A, 2) OVER w, 6) AS A_lag2, round(lag(dev_A) OVER w, 6) AS dev_A_lag1, round(lag(dev_A, 2) OVER w, 6) AS dev_A_lag2 FROM x WINDOW w AS (PARTITION BY unit ORDER BY event)")
def win_lag_cross_type(spark, d):
    dev = P.deviations(Tables(spark, d).panel(), ["event"], ["A"])
    return rounded(P.lags(dev, ["unit"], ["event"], ["A", "dev_A"], 2).select("unit", "event", "A_lag1", "A_lag2", "dev_A_lag1", "dev_A_lag2"))


TYPED = """typed AS (SELECT CAST(c_nationkey AS BIGINT) AS unit, o_orderpriority AS kind, CAST(year(o_orderdate) AS BIGINT) AS event, avg(o_totalprice) AS level, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2, 3)"""


def typed(t: Tables):
    """unit, event type, event: mean price and number of orders."""
    joined = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    return joined.groupBy(F.col("c_nationkey").cast("long").alias("unit"), F.col("o_orderpriority").alias("kind"), F.year("o_orderdate").cast("long").alias("event")).agg(F.avg("o_totalprice").alias("level"), F.count("*").alias("n"))


@query("win_lag_same_type", f"WITH {TYPED} SELECT unit, kind, event, round(lag(level) OVER w, 4) AS level_lag1, round(lag(level, 2) OVER w, 4) AS level_lag2 FROM typed WINDOW w AS (PARTITION BY unit, kind ORDER BY event)")
def win_lag_same_type(spark, d):
    return rounded(P.lags(typed(Tables(spark, d)), ["unit", "kind"], ["event"], ["level"], 2).select("unit", "kind", "event", "level_lag1", "level_lag2"), 4)


@query("win_trend", f"WITH {PANEL} SELECT unit, event, round(lag(A) OVER w - lag(A, 2) OVER w, 6) AS trend FROM panel WINDOW w AS (PARTITION BY unit ORDER BY event)")
def win_trend(spark, d):
    lagged = P.lags(Tables(spark, d).panel(), ["unit"], ["event"], ["A"], 2)
    return rounded(lagged.select("unit", "event", (F.col("A_lag1") - F.col("A_lag2")).alias("trend")))


@query("win_lag_national", f"WITH {TYPED}, m AS (SELECT kind, event, avg(level) AS level FROM typed GROUP BY 1, 2), l AS (SELECT *, lag(level) OVER (PARTITION BY kind ORDER BY event) AS before FROM m) SELECT unit, kind, event, round(before, 4) AS before FROM typed JOIN l USING (kind, event)")
def win_lag_national(spark, d):
    t = typed(Tables(spark, d))
    level = P.lags(t.groupBy("kind", "event").agg(F.avg("level").alias("m")), ["kind"], ["event"], ["m"])
    return rounded(t.join(level, ["kind", "event"]).select("unit", "kind", "event", F.col("m_lag1").alias("before")), 4)


@query("win_event_gap", f"WITH {TYPED}, e AS (SELECT DISTINCT kind, event FROM typed WHERE (event + length(kind)) % 3 <> 0) SELECT kind, event, event - lag(event) OVER (PARTITION BY kind ORDER BY event) AS gap FROM e")
def win_event_gap(spark, d):
    events = typed(Tables(spark, d)).select("kind", "event").distinct().where("(event + length(kind)) % 3 <> 0")
    return P.event_gap(events, ["kind"], "event")


@query("win_first_difference", f"WITH {PANEL} SELECT unit, event, round(A - lag(A) OVER w, 6) AS d_A, round(R - lag(R) OVER w, 6) AS d_R FROM panel WINDOW w AS (PARTITION BY unit ORDER BY event)")
def win_first_difference(spark, d):
    return rounded(P.first_difference(Tables(spark, d).panel(), ["unit"], ["event"], ["A", "R"]).select("unit", "event", "d_A", "d_R"))


@query("win_delta_lags", f"WITH {PANEL}, x AS (SELECT *, A - avg(A) OVER (PARTITION BY event) AS dev_A FROM panel) SELECT unit, event, round(lag(A) OVER w, 6) AS A_lag1, round(lag(dev_A) OVER w, 6) AS dev_A_lag1 FROM x WINDOW w AS (PARTITION BY unit ORDER BY event)")
def win_delta_lags(spark, d):
    dev = P.deviations(Tables(spark, d).panel(), ["event"], ["A"])
    return rounded(P.lags(dev, ["unit"], ["event"], ["A", "dev_A"]).select("unit", "event", "A_lag1", "dev_A_lag1"))


@query("win_group_transform", f"WITH {PANEL} SELECT unit, event, round(median(A) OVER (PARTITION BY parent, event), 6) AS middle, sum(weight) OVER (PARTITION BY parent, event) AS total FROM panel")
def win_group_transform(spark, d):
    """A group's median and total beside each of its rows: aggregated in part and joined back, so that no task holds a group."""
    panel, keys = Tables(spark, d).panel(), ["parent", "event"]
    middle = P.quantiles(panel, "A", lambda n: [F.lit(0.5)], keys).select(*keys, F.col("quantiles")[0].alias("middle"))
    total = panel.groupBy(*keys).agg(F.sum("weight").alias("total"))
    return rounded(panel.select("unit", *keys).join(middle.join(total, keys), keys).select("unit", "event", "middle", "total"))


@query("agg_parent_mean", f"WITH {PANEL} SELECT parent, event, round(avg(A), 6) AS A, round(avg(N), 6) AS N FROM panel GROUP BY 1, 2")
def agg_parent_mean(spark, d):
    return rounded(P.parent_means(Tables(spark, d).panel(), ["parent"], ["event"], ["A", "N"]))


@query("win_lag_parent", f"WITH {PANEL}, m AS (SELECT parent, event, avg(A) AS A FROM panel GROUP BY 1, 2) SELECT parent, event, round(A, 6) AS A, round(lag(A) OVER (PARTITION BY parent ORDER BY event), 6) AS A_lag1 FROM m")
def win_lag_parent(spark, d):
    return rounded(P.lags(P.parent_means(Tables(spark, d).panel(), ["parent"], ["event"], ["A"]), ["parent"], ["event"], ["A"]))


FINE = """fine AS (SELECT CAST(c_custkey AS BIGINT) AS unit, CAST(c_nationkey AS BIGINT) AS parent, CAST(year(o_orderdate) AS BIGINT) AS event, avg(o_totalprice) AS level, CAST(count(*) AS DOUBLE) AS size FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2, 3)"""


@query(
    "win_lag_repair",
    f"""WITH {FINE}, own AS (SELECT *, lag(level) OVER w AS before, size / lag(size) OVER w AS change FROM fine WINDOW w AS (PARTITION BY unit ORDER BY event)),
m AS (SELECT parent, event, avg(level) AS level FROM fine GROUP BY 1, 2), ml AS (SELECT parent, event, lag(level) OVER (PARTITION BY parent ORDER BY event) AS above FROM m),
x AS (SELECT unit, parent, event, CASE WHEN coalesce(change > 3 OR change < 1 / 3.0, false) THEN NULL ELSE before END AS before, above FROM own JOIN ml USING (parent, event))
SELECT unit, parent, event, round(coalesce(before, above), 4) AS level_lag, before IS NULL AS lag_fallback FROM x""",
)
def win_lag_repair(spark, d):
    t = Tables(spark, d)
    joined = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    fine = joined.groupBy(F.col("c_custkey").cast("long").alias("unit"), F.col("c_nationkey").cast("long").alias("parent"), F.year("o_orderdate").cast("long").alias("event")).agg(F.avg("o_totalprice").alias("level"), F.count("*").cast("double").alias("size"))
    return rounded(P.repaired_lags(fine, "unit", "parent", ["event"], ["level"], "size").select("unit", "parent", "event", "level_lag", "lag_fallback"), 4)


@query("agg_slate_presence", "SELECT o_orderkey, coalesce(bool_or(l_returnflag = 'A'), false) AS has_A, coalesce(bool_or(l_returnflag = 'N'), false) AS has_N, coalesce(bool_or(l_returnflag = 'R'), false) AS has_R FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def agg_slate_presence(spark, d):
    t = Tables(spark, d)
    return P.presence(t.orders.select("o_orderkey").join(t.lineitem.select("l_orderkey", "l_returnflag"), F.col("l_orderkey") == F.col("o_orderkey"), "left"), ["o_orderkey"], "l_returnflag", B)


@query("join_default_true", "WITH p AS (SELECT l_orderkey, bool_or(l_returnflag = 'A') AS has_A FROM lineitem GROUP BY 1) SELECT o_orderkey, coalesce(has_A, true) AS has_A FROM orders LEFT JOIN p ON l_orderkey = o_orderkey")
def join_default_true(spark, d):
    t = Tables(spark, d)
    known = P.presence(t.lineitem, ["l_orderkey"], "l_returnflag", ["A"])
    return t.orders.join(known, F.col("l_orderkey") == F.col("o_orderkey"), "left").select("o_orderkey", F.coalesce("has_A", F.lit(True)).alias("has_A"))


@query("flt_contested", "SELECT l_orderkey, l_linenumber FROM (SELECT *, count(*) OVER (PARTITION BY l_orderkey) AS c FROM lineitem) WHERE c > 1")
def flt_contested(spark, d):
    return P.contested(Tables(spark, d).lineitem.select("l_orderkey", "l_linenumber"), ["l_orderkey"])


@query("flt_small_units", f"WITH {PANEL}, big AS (SELECT unit, event FROM panel WHERE weight >= 1500) SELECT unit, event, block, votes FROM cell SEMI JOIN big USING (unit, event)")
def flt_small_units(spark, d):
    t = Tables(spark, d)
    return t.cell().select("unit", "event", "block", "votes").join(t.panel().where("weight >= 1500").select("unit", "event"), ["unit", "event"], "left_semi")


@query("flt_zero_vote", f"WITH {PANEL} SELECT unit, event, round(A, 6) AS A FROM panel WHERE A < 99.99 AND weight > 0")
def flt_zero_vote(spark, d):
    return rounded(Tables(spark, d).panel().where("A < 99.99 and weight > 0").select("unit", "event", "A"))


@query("flt_complete_case", f"WITH {PANEL}, x AS (SELECT unit, event, A, lag(A) OVER w AS l1, lag(A, 2) OVER w AS l2 FROM panel WINDOW w AS (PARTITION BY unit ORDER BY event)) SELECT unit, event, round(A, 6) AS A, round(l1, 6) AS A_lag1, round(l2, 6) AS A_lag2 FROM x WHERE l1 IS NOT NULL AND l2 IS NOT NULL")
def flt_complete_case(spark, d):
    return rounded(P.lags(Tables(spark, d).panel(), ["unit"], ["event"], ["A"], 2).select("unit", "event", "A", "A_lag1", "A_lag2").dropna())


@query("win_leader_runner_up", f"WITH {PANEL}, l AS (SELECT unit, event, unnest([{{'v': A, 'i': 0, 'b': 'A'}}, {{'v': N, 'i': 1, 'b': 'N'}}, {{'v': R, 'i': 2, 'b': 'R'}}]) AS s FROM panel), r AS (SELECT unit, event, s.v AS v, s.b AS b, row_number() OVER (PARTITION BY unit, event ORDER BY s.v DESC, s.i) AS k FROM l) SELECT unit, event, max(b) FILTER (k = 1) AS lead, max(b) FILTER (k = 2) AS runner_up, round(max(v) FILTER (k = 1) - max(v) FILTER (k = 2), 6) AS margin FROM r GROUP BY 1, 2")
def win_leader_runner_up(spark, d):
    return rounded(P.leader(Tables(spark, d).panel(), B).select("unit", "event", "lead", "runner_up", "margin"))


LED = f"{PANEL}, led AS (SELECT *, CASE WHEN A >= N AND A >= R THEN 'A' WHEN N >= R THEN 'N' ELSE 'R' END AS lead, greatest(A, N, R) - (A + N + R - greatest(A, N, R) - least(A, N, R)) AS margin FROM panel)"


@query("agg_observed_lead", f"WITH {LED} SELECT lead, count(*) AS n_units FROM led GROUP BY 1")
def agg_observed_lead(spark, d):
    return P.leader(Tables(spark, d).panel(), B).groupBy("lead").agg(F.count("*").alias("n_units"))


@query("agg_margin_bands", f"WITH {LED} SELECT event, count(*) FILTER (margin < 3) AS under_3, count(*) FILTER (margin < 8) AS under_8, coalesce(sum(weight) FILTER (margin < 8), 0) AS weight_8 FROM led GROUP BY 1")
def agg_margin_bands(spark, d):
    m = F.col("margin")
    return P.leader(Tables(spark, d).panel(), B).groupBy("event").agg(F.count_if(m < 3).alias("under_3"), F.count_if(m < 8).alias("under_8"), F.coalesce(F.sum(F.when(m < 8, F.col("weight"))), F.lit(0.0)).alias("weight_8"))


@query("sc_margin_band", f"WITH {LED} SELECT unit, event, CASE WHEN margin >= 8 THEN 'clear' WHEN margin >= 3 THEN 'tight' ELSE 'uncertain' END AS band FROM led")
def sc_margin_band(spark, d):
    m = F.col("margin")
    return P.leader(Tables(spark, d).panel(), B).select("unit", "event", F.when(m >= 8, "clear").when(m >= 3, "tight").otherwise("uncertain").alias("band"))


@query("sc_tipping_point", f"WITH {PANEL} SELECT unit, event, round(greatest(0, (A - R) / 1.5, (N - R) / 1.5), 6) AS tip FROM panel")
def sc_tipping_point(spark, d):
    return rounded(P.tipping_point(Tables(spark, d).panel(), "R", ["A", "N"]).select("unit", "event", "tip"))


@query("sc_swing_weights", f"WITH {PANEL} SELECT round(sum(A * weight) / sum(weight), 6) AS A, round(sum(N * weight) / sum(weight), 6) AS N, round(sum(R * weight) / sum(weight), 6) AS R FROM panel")
def sc_swing_weights(spark, d):
    return rounded(P.swing_weights(Tables(spark, d).panel(), B, "weight"))


@query("sc_conserved_swing", f"WITH {PANEL} SELECT unit, event, round(A - 3 * 0.25, 6) AS new_A, round(N - 3 * 0.75, 6) AS new_N, round(R + 3, 6) AS new_R FROM panel")
def sc_conserved_swing(spark, d):
    return rounded(P.conserved_swing(Tables(spark, d).panel(), {"R": 3.0}, {"A": 0.25, "N": 0.75, "R": 1.0}).select("unit", "event", "new_A", "new_N", "new_R"))


@query("sc_resulting_share", f"WITH {PANEL} SELECT unit, event, round((A / 100 * weight + 0.05 * weight) / (weight + 0.05 * weight) * 100, 6) AS share FROM panel")
def sc_resulting_share(spark, d):
    voters, added = F.col("weight"), F.col("weight") * 0.05
    return rounded(Tables(spark, d).panel().select("unit", "event", (P.ratio(F.col("A") / 100 * voters + added, voters + added) * 100).alias("share")))


@query("agg_commune_rollup", f"WITH {PANEL} SELECT parent, event, round(sum(A * weight) / sum(weight), 6) AS A, round(sum(N * weight) / sum(weight), 6) AS N, round(sum(R * weight) / sum(weight), 6) AS R, sum(weight) AS weight, count(*) AS n_units FROM panel GROUP BY 1, 2")
def agg_commune_rollup(spark, d):
    return rounded(P.rollup(Tables(spark, d).panel(), ["parent", "event"], B, "weight"))


@query(
    "agg_district_rollup",
    f"""WITH {PANEL}, g AS (SELECT parent, event, sum(A * weight) / sum(weight) AS A, sum(N * weight) / sum(weight) AS N, sum(R * weight) / sum(weight) AS R, arg_max(unit, weight) AS anchor FROM panel GROUP BY 1, 2),
s AS (SELECT *, CASE WHEN A >= N AND A >= R THEN 'A' WHEN N >= R THEN 'N' ELSE 'R' END AS lead, CASE WHEN A - 1.5 >= N - 1.5 AND A - 1.5 >= R + 3 THEN 'A' WHEN N - 1.5 >= R + 3 THEN 'N' ELSE 'R' END AS after FROM g)
SELECT parent, event, lead, anchor, lead <> after AS flips FROM s""",
)
def agg_district_rollup(spark, d):
    panel = Tables(spark, d).panel()
    shares = P.rollup(panel, ["parent", "event"], B, "weight").join(panel.groupBy("parent", "event").agg(F.max_by("unit", "weight").alias("anchor")), ["parent", "event"])
    moved = P.conserved_swing(P.leader(shares, B).select("parent", "event", "lead", "anchor", *B), {"R": 3.0}, {"A": 0.5, "N": 0.5, "R": 1.0})
    after = P.leader(moved.select("parent", "event", F.col("lead").alias("was"), "anchor", *[F.col(f"new_{b}").alias(b) for b in B]), B)
    return after.select("parent", "event", F.col("was").alias("lead"), "anchor", (F.col("was") != F.col("lead")).alias("flips"))


@query("agg_weighted_accuracy", f"WITH {LED}, x AS (SELECT *, lag(lead) OVER (PARTITION BY unit ORDER BY event) AS said FROM led) SELECT event, round(sum(CASE WHEN said = lead THEN weight ELSE 0 END) / sum(weight), 6) AS accuracy FROM x WHERE said IS NOT NULL GROUP BY 1")
def agg_weighted_accuracy(spark, d):
    led = P.lags(P.leader(Tables(spark, d).panel(), B), ["unit"], ["event"], ["lead"]).where("lead_lag1 is not null")
    hit = F.when(F.col("lead") == F.col("lead_lag1"), F.col("weight")).otherwise(0.0)
    return rounded(led.groupBy("event").agg(P.ratio(F.sum(hit), F.sum("weight")).alias("accuracy")))


@query("agg_flat_baseline", f"WITH {LED}, m AS (SELECT event, CASE WHEN sum(A * weight) >= sum(N * weight) AND sum(A * weight) >= sum(R * weight) THEN 'A' WHEN sum(N * weight) >= sum(R * weight) THEN 'N' ELSE 'R' END AS said FROM panel GROUP BY 1) SELECT event, round(sum(CASE WHEN said = lead THEN weight ELSE 0 END) / sum(weight), 6) AS accuracy FROM led JOIN m USING (event) GROUP BY 1")
def agg_flat_baseline(spark, d):
    led = P.leader(Tables(spark, d).panel(), B)
    favourite = P.leader(P.rollup(led, ["event"], B, "weight"), B).select("event", F.col("lead").alias("said"))
    hit = F.when(F.col("lead") == F.col("said"), F.col("weight")).otherwise(0.0)
    return rounded(led.join(favourite, "event").groupBy("event").agg(P.ratio(F.sum(hit), F.sum("weight")).alias("accuracy")))


@query("agg_weighted_r2", f"WITH {PANEL}, x AS (SELECT A AS y, lag(A) OVER (PARTITION BY unit ORDER BY event) AS p, weight AS w, event FROM panel), z AS (SELECT *, sum(w * y) OVER (PARTITION BY event) / sum(w) OVER (PARTITION BY event) AS m FROM x WHERE p IS NOT NULL) SELECT event, round(1 - sum(w * (y - p) * (y - p)) / sum(w * (y - m) * (y - m)), 5) AS r2 FROM z GROUP BY 1")
def agg_weighted_r2(spark, d):
    x = P.lags(Tables(spark, d).panel(), ["unit"], ["event"], ["A"]).where("A_lag1 is not null")
    w = Window.partitionBy("event")
    x = x.withColumn("m", P.ratio(F.sum(F.col("weight") * F.col("A")).over(w), F.sum("weight").over(w)))
    miss, spread = (F.sum(F.col("weight") * (F.col("A") - F.col(c)) ** 2) for c in ("A_lag1", "m"))
    return rounded(x.groupBy("event").agg((1 - P.ratio(miss, spread)).alias("r2")), 5)


@query("agg_weighted_median", "WITH m AS (SELECT c_nationkey, c_acctbal AS v, sum(c_custkey % 7 + 1) AS w FROM customer GROUP BY 1, 2), p AS (SELECT *, (sum(w) OVER (PARTITION BY c_nationkey ORDER BY v) - w / 2) / sum(w) OVER (PARTITION BY c_nationkey) AS p FROM m), e AS (SELECT c_nationkey, max(v) FILTER (p <= 0.5) AS lv, max(p) FILTER (p <= 0.5) AS lp, min(v) FILTER (p >= 0.5) AS hv, min(p) FILTER (p >= 0.5) AS hp FROM p GROUP BY 1) SELECT c_nationkey, round(CASE WHEN lv IS NULL THEN hv WHEN hv IS NULL OR hp = lp THEN lv ELSE lv + (hv - lv) * (0.5 - lp) / (hp - lp) END, 4) AS weighted_median FROM e")
def agg_weighted_median(spark, d):
    people = Tables(spark, d).customer.select("c_nationkey", "c_acctbal", (F.col("c_custkey") % 7 + 1).cast("double").alias("w"))
    return rounded(P.weighted_median(people, ["c_nationkey"], "c_acctbal", "w"), 4)


@query("win_quantile_bins", f"WITH {PANEL}, e AS (SELECT list_distinct([quantile_cont(A, 0.2), quantile_cont(A, 0.4), quantile_cont(A, 0.6), quantile_cont(A, 0.8)]) AS edges FROM panel) SELECT unit, event, CAST(len(list_filter(edges, lambda x: x < A)) AS INTEGER) AS bin FROM panel, e")
def win_quantile_bins(spark, d):
    return P.in_bins(Tables(spark, d).panel(), "A", 5).select("unit", "event", "bin")


@query("topk_groups", f"WITH {PANEL} SELECT unit, event, round(A, 6) AS A, weight FROM panel ORDER BY weight DESC, unit, event LIMIT 12")
def topk_groups(spark, d):
    return rounded(Tables(spark, d).panel().select("unit", "event", "A", "weight").orderBy(F.desc("weight"), "unit", "event").limit(12))


@query("win_rank_label", f"WITH {PANEL} SELECT unit, event, CAST(row_number() OVER (PARTITION BY event ORDER BY weight DESC, unit) AS INTEGER) AS rank FROM panel")
def win_rank_label(spark, d):
    return Tables(spark, d).panel().select("unit", "event", F.row_number().over(Window.partitionBy("event").orderBy(F.desc("weight"), "unit")).alias("rank"))


@query("agg_threshold_counts", f"WITH {PANEL} SELECT event, count(*) FILTER (A > 25) AS over_25, count(*) FILTER (A > 30) AS over_30, count(*) FILTER (abs(A - 25) <= 3) AS near_25 FROM panel GROUP BY 1")
def agg_threshold_counts(spark, d):
    a = F.col("A")
    return Tables(spark, d).panel().groupBy("event").agg(F.count_if(a > 25).alias("over_25"), F.count_if(a > 30).alias("over_30"), F.count_if(F.abs(a - 25) <= 3).alias("near_25"))


@query("agg_summary_totals", f"WITH {PANEL} SELECT count(*) AS n_cells, count(DISTINCT unit) AS n_units, sum(weight) AS weight, round(sum(A * weight) / sum(weight), 6) AS A FROM panel")
def agg_summary_totals(spark, d):
    return rounded(Tables(spark, d).panel().agg(F.count("*").alias("n_cells"), F.countDistinct("unit").alias("n_units"), F.sum("weight").alias("weight"), P.ratio(F.sum(F.col("A") * F.col("weight")), F.sum("weight")).alias("A")))


@query("agg_historic_floor", f"WITH {PANEL} SELECT p.unit, p.event, round(least(min(h.A), p.A), 6) AS floor FROM panel p JOIN panel h ON h.unit = p.unit AND h.event < p.event GROUP BY p.unit, p.event, p.A")
def agg_historic_floor(spark, d):
    w = Window.partitionBy("unit").orderBy("event").rowsBetween(Window.unboundedPreceding, -1)
    past = Tables(spark, d).panel().withColumn("past", F.min("A").over(w)).where("past is not null")
    return rounded(past.select("unit", "event", F.least("past", "A").alias("floor")))


@query("sc_conjunctural", f"WITH {PANEL}, x AS (SELECT unit, event, A, min(A) OVER (PARTITION BY unit ORDER BY event ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS floor FROM panel) SELECT unit, event, round(greatest(0, A - floor), 6) AS conjunctural FROM x WHERE floor IS NOT NULL")
def sc_conjunctural(spark, d):
    w = Window.partitionBy("unit").orderBy("event").rowsBetween(Window.unboundedPreceding, -1)
    x = Tables(spark, d).panel().withColumn("floor", F.min("A").over(w)).where("floor is not null")
    return rounded(x.select("unit", "event", F.greatest(F.lit(0.0), F.col("A") - F.col("floor")).alias("conjunctural")))


@query("agg_deployment", f"WITH {PANEL}, x AS (SELECT *, min(A) OVER (PARTITION BY unit ORDER BY event ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS floor FROM panel) SELECT parent, round(sum(weight * greatest(0, A - floor) / 100), 4) AS reach FROM x WHERE floor IS NOT NULL GROUP BY 1 ORDER BY reach DESC, parent LIMIT 3")
def agg_deployment(spark, d):
    w = Window.partitionBy("unit").orderBy("event").rowsBetween(Window.unboundedPreceding, -1)
    x = Tables(spark, d).panel().withColumn("floor", F.min("A").over(w)).where("floor is not null")
    reach = F.sum(F.col("weight") * F.greatest(F.lit(0.0), F.col("A") - F.col("floor")) / 100)
    return rounded(x.groupBy("parent").agg(reach.alias("reach")).orderBy(F.desc("reach"), "parent").limit(3), 4)


@query("agg_context_rates", "SELECT o_orderpriority, round(100.0 * count(*) FILTER (o_orderstatus = 'F') / count(*), 6) AS rate_f, round(100.0 * count(*) FILTER (o_orderstatus = 'P') / count(*), 6) AS rate_p FROM orders GROUP BY 1")
def agg_context_rates(spark, d):
    rate = lambda s: P.ratio(F.count_if(F.col("o_orderstatus") == s), F.count("*"), 100.0)
    return rounded(Tables(spark, d).orders.groupBy("o_orderpriority").agg(rate("F").alias("rate_f"), rate("P").alias("rate_p")))


@query("agg_latest_per_key", "SELECT o_custkey, arg_max(o_orderkey, struct_pack(d := o_orderdate, k := o_orderkey)) AS o_orderkey FROM orders GROUP BY 1")
def agg_latest_per_key(spark, d):
    return Tables(spark, d).orders.groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("o_orderkey"))


@query("agg_median_impute", "WITH x AS (SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN NULL ELSE p_retailprice END AS price FROM part) SELECT p_partkey, round(coalesce(price, (SELECT median(price) FROM x)), 6) AS price FROM x")
def agg_median_impute(spark, d):
    x = Tables(spark, d).part.select("p_partkey", F.when(F.col("p_size") % 5 != 0, F.col("p_retailprice")).alias("price"))
    middle = x.agg(F.median("price").alias("m"))
    return rounded(x.crossJoin(F.broadcast(middle)).select("p_partkey", F.coalesce("price", "m").alias("price")))


@query("agg_median_price", "SELECT p_brand, round(median(p_retailprice), 6) AS median_price, count(*) AS n FROM part GROUP BY 1")
def agg_median_price(spark, d):
    return rounded(Tables(spark, d).part.groupBy("p_brand").agg(F.median("p_retailprice").alias("median_price"), F.count("*").alias("n")))


@query("agg_distinct", "SELECT count(DISTINCT l_orderkey) AS orders, count(DISTINCT l_partkey) AS parts, count(DISTINCT l_returnflag) AS flags FROM lineitem")
def agg_distinct(spark, d):
    lines = Tables(spark, d).lineitem
    return lines.agg(F.countDistinct("l_orderkey").alias("orders"), F.countDistinct("l_partkey").alias("parts"), F.countDistinct("l_returnflag").alias("flags"))


@query("agg_grouped_counts", "SELECT o_orderpriority, CAST(year(o_orderdate) AS BIGINT) AS event, count(*) AS n FROM orders GROUP BY 1, 2")
def agg_grouped_counts(spark, d):
    return Tables(spark, d).orders.groupBy("o_orderpriority", F.year("o_orderdate").cast("long").alias("event")).agg(F.count("*").alias("n"))


@query("agg_source_stats", "SELECT p_type, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS percent FROM part GROUP BY 1")
def agg_source_stats(spark, d):
    counts = Tables(spark, d).part.groupBy("p_type").agg(F.count("*").alias("n"))
    return rounded(counts.crossJoin(F.broadcast(counts.agg(F.sum("n").alias("total")))).select("p_type", "n", P.ratio("n", "total", 100.0).alias("percent")))


@query("agg_pivot_wide", "SELECT c_nationkey, coalesce(avg(c_acctbal) FILTER (c_mktsegment = 'BUILDING'), 0) AS building, coalesce(avg(c_acctbal) FILTER (c_mktsegment = 'MACHINERY'), 0) AS machinery FROM (SELECT c_nationkey, c_mktsegment, round(c_acctbal, 0) AS c_acctbal FROM customer) GROUP BY 1".replace("coalesce(avg(c_acctbal)", "round(coalesce(avg(c_acctbal)").replace(", 0) AS b", ", 0), 6) AS b").replace(", 0) AS m", ", 0), 6) AS m"))
def agg_pivot_wide(spark, d):
    people = Tables(spark, d).customer.select("c_nationkey", "c_mktsegment", F.round("c_acctbal", 0).alias("c_acctbal"))
    wide = people.groupBy("c_nationkey").pivot("c_mktsegment", ["BUILDING", "MACHINERY"]).agg(F.avg("c_acctbal"))
    return rounded(wide.select("c_nationkey", F.coalesce("BUILDING", F.lit(0.0)).alias("building"), F.coalesce("MACHINERY", F.lit(0.0)).alias("machinery")))


@query("agg_bbox_audit", "WITH p AS (SELECT vec_id, label, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y FROM embeddings), b AS (SELECT label, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM p WHERE vec_id % 10 <> 0 GROUP BY 1) SELECT vec_id FROM p JOIN b USING (label) WHERE x < x0 - 0.01 OR x > x1 + 0.01 OR y < y0 - 0.01 OR y > y1 + 0.01")
def agg_bbox_audit(spark, d):
    e = F.col("embedding")
    points = Tables(spark, d).embeddings.select("vec_id", "label", e[0].cast("double").alias("x"), e[1].cast("double").alias("y"))
    box = points.where("vec_id % 10 <> 0").groupBy("label").agg(*[f(c).alias(f"{c}{i}") for c in "xy" for i, f in ((0, F.min), (1, F.max))])
    return points.join(box, "label").where("x < x0 - 0.01 or x > x1 + 0.01 or y < y0 - 0.01 or y > y1 + 0.01").select("vec_id")


@query("agg_centroid_points", "SELECT label, round(avg(CAST(embedding[1] AS DOUBLE)), 6) AS x, round(avg(CAST(embedding[2] AS DOUBLE)), 6) AS y, count(*) AS n FROM embeddings GROUP BY 1")
def agg_centroid_points(spark, d):
    e = F.col("embedding")
    return rounded(Tables(spark, d).embeddings.groupBy("label").agg(F.avg(e[0].cast("double")).alias("x"), F.avg(e[1].cast("double")).alias("y"), F.count("*").alias("n")))


@query("agg_centroid_weighted", "WITH p AS (SELECT label, CAST(embedding[1] AS DOUBLE) AS x, CAST(vec_id % 3 AS DOUBLE) AS w FROM embeddings) SELECT label, round(CASE WHEN sum(w) = 0 THEN avg(x) ELSE sum(w * x) / sum(w) END, 6) AS x, sum(w) AS weight, count(*) AS n_units FROM p GROUP BY 1")
def agg_centroid_weighted(spark, d):
    points = Tables(spark, d).embeddings.select("label", F.col("embedding")[0].cast("double").alias("x"), (F.col("vec_id") % 3).cast("double").alias("w"))
    return rounded(P.rollup(points, ["label"], ["x"], "w"))
